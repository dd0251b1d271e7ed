"""Prefix scans over range partitions, and order statistics by histograms, against plain Python."""

import decimal
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import serving
from tidemark.operators import ordered
from tidemark.operators.ordered import in_order, running_before

SCHEMA = "u string, g string, seq bigint, v bigint"


def rows_of_a_hot_user(n=6000):
    """A third of the rows are one user's, their orders microseconds far apart with dense bursts between."""
    rng = random.Random(1)
    rows, at = [], 0
    for _ in range(n):
        at += rng.choice([1, 1, 1, 3_600_000_000])
        user = "hot" if rng.random() < 0.34 else rng.choice([None, "", *map(str, range(300))])
        rows.append((user, rng.choice(["a", "b"]), at, rng.choice([None, rng.randrange(-50, 1000)])))
    return rows


def truth(rows, how):
    seen, out = {}, set()
    for u, g, seq, v in sorted(rows, key=lambda r: r[2]):
        before = seen.get((u, g))
        out.add((u, g, seq, v, before))
        if v is not None:
            seen[u, g] = v if before is None else max(before, v) if how == "max" else before + v
    return out


@pytest.mark.parametrize("how", ["max", "sum"])
@pytest.mark.parametrize("parts", [None, 0, 1, 40])
def test_running_values_equal_a_loop(spark, how, parts):
    rows = rows_of_a_hot_user()
    got = running_before(spark.createDataFrame(rows, SCHEMA).repartition(5), ["u", "g"], "seq", "v", "before", how, parts)
    assert got.columns == ["u", "g", "seq", "v", "before"]
    assert set(map(tuple, got.collect())) == truth(rows, how)


def test_no_part_holds_a_hot_group(spark):
    rows = rows_of_a_hot_user()
    placed = in_order(spark.createDataFrame(rows, SCHEMA).repartition(5), ["u", "g", "seq", "v"], 40)
    sizes = {r._part: r["count"] for r in placed.groupBy("_part").count().collect()}
    assert len(sizes) > 30 and max(sizes.values()) < 3 * len(rows) / 40
    hot = placed.where("u = 'hot'").groupBy("g").agg(F.count_distinct("_part").alias("parts")).collect()
    assert all(r.parts >= 5 for r in hot)


def test_the_log_is_read_once(spark, tmp_path):
    spark.createDataFrame(rows_of_a_hot_user(500), SCHEMA).write.parquet(str(tmp_path / "log"))
    out = running_before(spark.read.parquet(str(tmp_path / "log")), ["u", "g"], "seq", "v", "before")
    assert str(tmp_path / "log") not in out._jdf.queryExecution().toString()  # read when the parts were written, not again


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Not the session's width: what a task puts in order would grow with the log."""
    monkeypatch.setattr(ordered, "ROWS", 100)
    rows = spark.range(2000).selectExpr("concat('u', id % 500) u", "'g' g", "id seq", "id % 7 v")
    assert running_before(rows, ["u", "g"], "seq", "v", "before", parts=4).rdd.getNumPartitions() == 20


def test_running_values_of_nothing(spark):
    assert running_before(spark.createDataFrame([], SCHEMA), ["u"], "seq", "v", "before").collect() == []


def statistics(values):
    """Positions 0, a third, two medians and the last, nulls aside, NaN above all."""
    kept = sorted((v for v in values if v is not None), key=lambda v: (isinstance(v, float) and math.isnan(v), v))
    n = len(kept)
    at = {"first": 0, "third": n // 3, "below": (n - 1) // 2, "above": n // 2, "last": n - 1}
    return n, {name: kept[k] if n else None for name, k in at.items()}


def ranks(n):
    third, half = F.floor(n / 3), F.floor(n / 2)
    return {"first": F.lit(0), "third": third, "below": F.floor((n - 1) / 2), "above": half, "last": n - 1}


@pytest.mark.parametrize("kind,values", [
    ("double", [random.Random(2).lognormvariate(0, 3) for _ in range(3000)]),
    ("double", [random.Random(3).uniform(-1e-9, 1e-9) + 5.0 for _ in range(3000)]),
    ("double", [*([7.25] * 2000), *(random.Random(4).choice([0.0, -0.0, -1e300, 1e-320, float("inf"), float("-inf"), 3.0]) for _ in range(500)), None]),
    ("double", [1.0, float("nan"), None, 2.0]), ("double", [None]), ("double", []), ("double", [42.5]),
    ("bigint", [random.Random(5).randrange(-(10**6), 10**6) for _ in range(3000)]),
    ("decimal(10,3)", [decimal.Decimal(random.Random(6).randrange(10**6)) / 1000 for _ in range(500)]),
])
def test_order_statistics_equal_sorting(spark, kind, values):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(4)
    got = serving.order_statistics(rows, "x", ranks).first().asDict()
    n, want = statistics(values)
    assert got.pop("n") == n
    assert {k: repr(v + 0 if v is not None else v) for k, v in got.items()} == {k: repr(v + 0 if v is not None else v) for k, v in want.items()}


def test_order_statistics_open_few_cells(spark):
    """A value's neighbours are counted in three steps; the last one groups few values, not all of them."""
    plan = serving.order_statistics(spark.range(10).select(F.col("id").cast("double").alias("x")), "x", ranks)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 10") == 3 and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()
    cells = spark.range(200_000).select(serving._outer_cell(F.col("id") / 7).alias("c")).distinct().count()
    assert cells < 1400
    steps = Counter(r.c for r in spark.range(100).select(serving._outer_cell((F.col("id") - 50) / 3).alias("c"), "id").orderBy("id").collect())
    assert list(steps) == sorted(steps)  # cells never fall as values grow
