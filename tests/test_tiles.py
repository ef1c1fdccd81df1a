import random

import pytest
from conftest import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from vendastat.operators.tiles import global_ntile, last_ranks

DDL = "key string, x bigint, y decimal(10,2)"
SCORES = {"a": ("x", "asc"), "b": ("x", "desc"), "c": ("y", "desc")}


def tiles(df, **options):
    out = global_ntile(df, SCORES, "key", **options)
    return sorted(tuple(r) for r in out.select("key", *SCORES).collect())


def rows_of(kind, n):
    rnd = random.Random(n)
    value = {
        "tied": lambda i: 1,
        "mixed": lambda i: rnd.randint(-50, 50),
        "unknown": lambda i: rnd.choice([None, None, 1, 2]),
        "all unknown": lambda i: None,
    }[kind]
    return [(f"k{i}", value(i), value(i)) for i in range(n)]


@pytest.mark.parametrize("kind", ["tied", "mixed", "unknown", "all unknown"])
@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 23])
def test_search_equals_window(spark, kind, n):
    df = frame(spark, [(k, x, None if y is None else __import__("decimal").Decimal(y)) for k, x, y in rows_of(kind, n)], DDL)
    assert tiles(df, distributed=True) == tiles(df, distributed=False)


@pytest.mark.parametrize("kind", ["tied", "mixed", "unknown"])
def test_search_narrows_over_several_rounds(spark, kind):
    rows = [(k, x, None) for k, x, _ in rows_of(kind, 3000)]
    df = frame(spark, rows, DDL)
    got = tiles(df, distributed=True, sample_rows=40)
    assert got == tiles(df, distributed=False)


def test_repeated_tie_break_is_refused(spark):
    df = frame(spark, [("same", 1, None)] * 200, DDL)
    with pytest.raises(ValueError, match="unique"):
        tiles(df, distributed=True, sample_rows=40)


def test_large_input_has_no_single_task_step(spark):
    df = frame(spark, [(f"k{i}", i % 3, None) for i in range(100)], DDL)
    plan = global_ntile(df, SCORES, "key")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


@given(st.integers(0, 500), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_tile_sizes(n, count):
    bounds = [0, *last_ranks(n, count), n]
    sizes = [b - a for a, b in zip(bounds, bounds[1:])]
    assert sum(sizes) == n
    assert max(sizes) - min(sizes) <= 1 or n < count
    assert sizes == sorted(sizes, reverse=True)


def test_too_small_samples_are_refused(spark):
    with pytest.raises(ValueError, match="sample_rows"):
        global_ntile(frame(spark, [], DDL), SCORES, "key", sample_rows=5)


def test_forms_agree_on_extreme_values(spark):
    inf, nan = float("inf"), float("nan")
    doubles = [nan, inf, -inf, 0.0, -0.0, None, 1.5, -1.5]
    longs = [-(2**63), 2**63 - 1, 0, None, -1, 1]
    rows = [(f"k{i}", doubles[i % 8], longs[i % 6]) for i in range(100)]
    df = frame(spark, rows, "key string, d double, x bigint")
    scores = {f"{c}_{o}": (c, o) for c in ("d", "x") for o in ("asc", "desc")}
    both = [
        sorted(tuple(r) for r in global_ntile(df, scores, "key", distributed=form).select("key", *scores).collect())
        for form in (True, False)
    ]
    assert both[0] == both[1]


@pytest.mark.parametrize("kind", ["tied", "mixed", "unknown"])
def test_all_cuts_of_all_scores_take_three_passes(spark, kind, monkeypatch):
    from vendastat.operators import tiles as module

    df = frame(spark, [(k, x, None) for k, x, _ in rows_of(kind, 3000)], DDL)
    passes, one_pass = [], module._one_pass

    def counted(few):
        passes.append(few._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return one_pass(few)

    monkeypatch.setattr(module, "_one_pass", counted)
    # Short intervals are sorted in one task, long ones by ranges, which reads the stored ranges once more.
    assert tiles(df, distributed=True, sample_rows=1500) == tiles(df, distributed=False)
    assert passes == [1, 1, 1]
    passes.clear()
    assert tiles(df, distributed=True, sample_rows=100) == tiles(df, distributed=False)
    assert len(passes) == 3


def test_places_are_those_of_a_plain_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from vendastat.operators.ranks import global_places

    rnd = random.Random(1)
    df = frame(spark, [(f"k{i}", rnd.choice([None, 1, 1, 1, rnd.randint(0, 99)]), None) for i in range(2000)], DDL)
    order = [F.desc_nulls_first("x"), F.asc("key")]
    got = global_places(df, order)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    assert global_places(df.limit(0), order).collect() == []
