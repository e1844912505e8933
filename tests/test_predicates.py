import datetime as dt
import math
import random

import pytest

from orvane.functions.predicates import And, Eq, In, Not, Or, Range, compiled, normalized, selectivity

ROWS = [(i, random.Random(i).randint(-3, 3), random.Random(i + 1).choice([-0.0, 0.0, 1.5, -1.5, math.nan, None]), random.Random(i + 2).choice("abc"), i % 3 == 0, random.Random(i + 3).choice([None, 0, 1]), dt.date(2023 + i % 5, 1, 1), dt.datetime(2023 + i % 5, 1, 1, 12)) for i in range(60)]
FIELDS = ["id", "integer", "floating", "group", "active", "optional", "day", "stamp"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, integer int, floating double, `group` string, active boolean, optional int, day date, stamp timestamp_ntz").cache()


def same(a, b):
    """Equality by value and domain, written apart from the compiler."""
    if a is None or b is None:
        return a is b
    kinds = [("n" if isinstance(x, (bool, int, float)) else type(x).__name__) for x in (a, b)]
    if kinds[0] != kinds[1]:
        return False
    if kinds[0] == "n":
        if a != a or b != b:
            return a != a and b != b
        if a == 0 and b == 0:
            neg = lambda x: isinstance(x, float) and math.copysign(1, x) < 0
            return neg(a) == neg(b)
    return a == b


def holds(f, row):
    if isinstance(f, Eq):
        return f.field in row and same(row[f.field], f.value)
    if isinstance(f, In):
        return f.field in row and any(same(row[f.field], v) for v in f.values)
    if isinstance(f, Range):
        v = row.get(f.field)
        if v is None or isinstance(v, bool) or v != v or (isinstance(v, (int, float)) != isinstance(f.low, (int, float))) or (not isinstance(v, (int, float)) and type(v) is not type(f.low)):
            return False
        return f.low <= v <= f.high
    if isinstance(f, And):
        return all(holds(p, row) for p in f.parts)
    if isinstance(f, Or):
        return any(holds(p, row) for p in f.parts)
    return not holds(f.part, row)


def leaf(r):
    return r.choice([
        lambda: Eq("integer", r.choice([0, 2, 2.0, -0.0, "2", None, True])), lambda: Eq("floating", r.choice([0.0, -0.0, 0, 1.5, math.nan, None])), lambda: Eq("active", r.choice([True, False, 1, 0, 2, "x"])),
        lambda: Eq("optional", r.choice([None, 0, 1])), lambda: Eq("absent", r.choice([None, 1])), lambda: In("group", r.choice([["a"], ["a", "b", "a"], [], [1, "c"]])), lambda: In("floating", [math.nan, -0.0, None]),
        lambda: Range("floating", -1, 1), lambda: Range("integer", -1.5, 2), lambda: Range("day", dt.date(2024, 1, 1), dt.date(2026, 1, 1)), lambda: Range("stamp", dt.datetime(2024, 1, 1), dt.datetime(2025, 6, 1)),
        lambda: Range("group", 1, 2), lambda: Range("active", 0, 1), lambda: Eq("day", dt.datetime(2024, 1, 1)), lambda: Eq("day", dt.date(2024, 1, 1)), lambda: Eq("stamp", dt.datetime(2024, 1, 1, 12)),
    ])()


def tree(r, depth):
    if depth == 0 or r.random() < 0.3:
        return leaf(r)
    return r.choice([lambda: Not(tree(r, depth - 1)), lambda: And(*(tree(r, depth - 1) for _ in range(r.randint(0, 3)))), lambda: Or(*(tree(r, depth - 1) for _ in range(r.randint(0, 3))))])()


def test_random_trees_against_an_evaluator(table):
    r = random.Random(7)
    trees = [leaf(r) for _ in range(40)] + [tree(r, 3) for _ in range(60)]
    got = table.select("id", *(compiled(t, table.schema).alias(f"f{k}") for k, t in enumerate(trees))).collect()
    for row in got:
        value = dict(zip(FIELDS, ROWS[row["id"]], strict=True))
        for k, t in enumerate(trees):
            assert row[f"f{k}"] == holds(t, value), (t, value)


def test_limits_and_errors():
    with pytest.raises(ValueError):
        Range("a", 2, 1)
    with pytest.raises(ValueError):
        Range("a", 1, dt.date(2024, 1, 1))
    with pytest.raises(ValueError):
        Range("a", math.nan, 1)
    with pytest.raises(TypeError):
        In("a", "abc")
    deep = Eq("a", 1)
    for _ in range(64):
        deep = Not(deep)
    with pytest.raises(ValueError):
        normalized(deep)
    with pytest.raises(ValueError):
        normalized(And(*(Eq("a", i) for i in range(4096))))
    assert In("a", [1, 2, 1]) == In("a", [1, 2])
    assert hash(And(Eq("a", 1), Not(Eq("b", 2)))) == hash(And(Eq("a", 1), Not(Eq("b", 2))))


def test_mapping_and_selectivity(table):
    assert normalized({"group": "a"}) == And(Eq("group", "a"))
    row = selectivity(table, {"active": True}).first()
    assert (row["matches"], row["total"]) == (20, 60)
    assert selectivity(table.limit(0), {"active": True}).first()["selectivity"] == 0.0
