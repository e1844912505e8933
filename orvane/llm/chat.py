"""Chat formatting by schema fingerprint, in DataFrame functions only.

Records of mixed layouts (prompt and completion, instruction and output,
message lists) lie in one wide schema, as a JSON reader would infer it.  The
nested paths of the fields that are present in a record are hashed; the hash
selects a declarative mapping to canonical turns ``array<struct<role, text>>``.
The template marks turns with control strings and escapes these, and the
escape sign, inside texts, so that the output can be parsed back.

Nulls and odd input: null texts and roles are empty strings; rows with equal
turn numbers are ordered by role and text; a null conv_id is one conversation;
an unknown fingerprint is reported in ``_unmapped`` and gives no turns; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Control strings.  The first three are the template's own.
START, MIDDLE, END = "<|turn|>", "<|says|>", "<|over|>"
CONTROL = (START, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: fixed roles for single fields, or a list with the names of its role and text fields."""

    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()  # (role, field)
    messages: tuple[str, str, str] | None = None  # (list field, role, text)

    @property
    def fingerprint(self) -> str:
        """Hash of the sorted paths."""
        import hashlib

        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()

    def turns(self) -> Column:
        if self.messages:
            name, role, text = self.messages
            return F.transform(F.col(name), lambda m: F.struct(F.coalesce(m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))).cast(TURNS)
        return F.array(*(F.struct(F.lit(role).alias("role"), F.coalesce(F.col(field), F.lit("")).alias("text")) for role, field in self.fields)).cast(TURNS)


#: Layouts known from the start.
MAPPINGS = (
    Mapping(("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("input", "instruction", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("messages[]", "messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Mapping(("conversations[]", "conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
)


def present_paths(schema: T.StructType, at: Column | None = None, prefix: str = "") -> Column:
    """Array of the nested paths that hold a value in a record; lists count their elements' fields together."""
    found = [F.array().cast("array<string>")]
    for f in schema.fields:
        here, name = (F.col(f"`{f.name}`") if at is None else at[f.name]), prefix + f.name
        found.append(F.when(here.isNotNull(), _below(f.dataType, here, name)).otherwise(F.array().cast("array<string>")))
    return reduce(lambda a, b: F.concat(a, b), found)


def _below(kind: T.DataType, here: Column, name: str) -> Column:
    if isinstance(kind, T.StructType):
        return present_paths(kind, here, f"{name}.")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        paths = F.flatten(F.transform(here, lambda x: present_paths(kind.elementType, x, f"{name}[].")))
        return F.concat(F.array(F.lit(f"{name}[]")), F.array_distinct(paths))
    return F.array(F.lit(name))


def fingerprint(schema: T.StructType) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(present_paths(schema))), "\n"), 256)


def canonical(df: DataFrame, key: str, mappings=MAPPINGS) -> DataFrame:
    """(key, turns, _unmapped) of the records in ``df``; a mapping counts if the schema has all its fields."""
    body = T.StructType([f for f in df.schema.fields if f.name != key])
    names = {f.name for f in body.fields}
    marked = df.withColumn("_print", fingerprint(body))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        if {p.split("[")[0].split(".")[0] for p in m.paths} <= names:
            turns = F.when(F.col("_print") == m.fingerprint, m.turns()).otherwise(turns)
    return marked.select(key, turns.alias("_turns")).select(key, F.coalesce("_turns", F.array().cast(TURNS)).alias("turns"), F.col("_turns").isNull().alias("_unmapped"))


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns_df: DataFrame, key: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(key, formatted, loss array<struct<start, length>>) in code points of ``formatted``.

    The offsets are running sums over a conversation's turns.
    """
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escaped(t["role"]), F.lit(MIDDLE)).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*learned).alias("learn")))
    df = turns_df.select(key, pieces.alias("_pieces"))
    sums = F.aggregate(
        "_pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long").alias("at"),
            F.when(p["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    whole = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return df.select(key, whole.alias("formatted"), sums["spans"].alias("loss"))


def parsed(df: DataFrame, key: str) -> DataFrame:
    """(key, turns, loss_text, formatted) read back from ``formatted`` and ``loss``."""
    quoted = lambda s: "\\Q" + s + "\\E"
    pieces = F.split("formatted", quoted(END))
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.split(F.substring(p, len(START) + 1, 2**31 - 1), quoted(MIDDLE)))
    loss = F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    read = df.select(key, "formatted", turns.alias("_turns"), loss.alias("_loss"))
    return read.select(
        key, "formatted",
        F.transform("_turns", lambda p: F.struct(unescaped(F.get(p, F.lit(0))).alias("role"), unescaped(F.get(p, F.lit(1))).alias("text"))).alias("turns"),
        F.array_join(F.transform("_loss", unescaped), "").alias("loss_text"),
    )


def records(rows: DataFrame) -> DataFrame:
    """One record of mixed layout for each conversation of rows (conv_id, turn, role, text).

    A user and an assistant turn make a prompt and completion record, a
    system turn before them an instruction record, all else a message list.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    talks = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), "\n")
    text = lambda i: F.get(F.col("t"), F.lit(i))["content"]
    two, three = roles == "user\nassistant", roles == "system\nuser\nassistant"
    return talks.select(
        "conv_id",
        F.when(two, text(0)).alias("prompt"), F.when(two, text(1)).alias("completion"),
        F.when(three, text(0)).alias("instruction"), F.when(three, text(1)).alias("input"), F.when(three, text(2)).alias("output"),
        F.when(~two & ~three, F.transform("t", lambda x: F.struct(x["role"], x["content"]))).alias("messages"),
    )


def op5_chat_format(spark, sf_dir) -> DataFrame:
    """Format all conversations and conversation -7, and read the output back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    turns = canonical(records(rows.unionByName(more)), "conv_id")
    back = parsed(formatted(turns, "conv_id"), "conv_id")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role || text) AS n0, role || chr(10) || text AS said FROM t),
m AS (SELECT *, length(said) - length(replace(said, '\', '')) AS slashes, (%s) AS marks FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(said || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n0 + slashes + marks + %d)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
""" % (" + ".join(f"(length(said) - length(replace(said, '{c}', ''))) // {len(c)}" for c in CONTROL), len(START + MIDDLE + END))
