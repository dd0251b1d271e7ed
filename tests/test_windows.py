import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.intervals import to_micros
from tidemark.operators import windows
from tidemark.operators.profiles import latest_profile
from tidemark.operators.windows import select_current_windows, windowed_features

T0 = dt.datetime(2026, 9, 29, 12, 0, 0)
SCHEMA = (
    "user_id string, event_type string, product_id string, category string, amount double, "
    "event_ts timestamp_ntz, device string"
)


def events(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("event_ts", F.col("event_ts").cast("timestamp"))


def row(user="u1", kind="view", seconds=0, amount=10.0, product="p1", category="books", device=None):
    at = None if seconds is None else T0 + dt.timedelta(seconds=seconds)
    return (user, kind, product, category, amount, at, device)


FIXTURE = [
    row(),
    row(kind="add_to_cart", seconds=10),
    row(kind="purchase", seconds=20, amount=30.0),
    row(kind="add_to_cart", seconds=30, product="p2"),
    row(kind="purchase", seconds=40, amount=50.0, product="p2"),
    row(kind="refund", seconds=50, amount=30.0),
    row(user="u2"),
]
ALL = [dict(), dict(exact=True), dict(exact=True, strategy="direct"), dict(strategy="panes")]


@pytest.mark.parametrize("options", ALL)
def test_feature_values(spark, options):
    out = {r.user_id: r for r in windowed_features(events(spark, FIXTURE), "1 minute", "1 minute", **options).collect()}
    u1, u2 = out["u1"], out["u2"]
    assert (u1.event_count, u1.view_count, u1.cart_count, u1.purchase_count) == (6, 1, 2, 2)
    assert (u1.spend, u1.refund_amount, u1.avg_order_value, u1.cart_conversion) == (80.0, 30.0, 40.0, 1.0)
    assert (u1.distinct_products, u1.distinct_categories) == (2, 1)
    start_ms = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert u1.last_event_ms == start_ms + 50_000 and u1.window_end_ms == start_ms + 60_000
    assert u2.avg_order_value is None and u2.cart_conversion is None


@pytest.mark.parametrize("options", ALL)
def test_unknown_types_null_times_and_null_amounts(spark, options):
    rows = [
        row(kind="signup"), row(seconds=None), row(kind="purchase", amount=None, user="u2"),
        row(kind="purchase", amount=None, user="u3"), row(kind="purchase", amount=2.5, user="u3"),
        row(kind="purchase", amount=None, user="u4"), row(user="u4"),
    ]
    out = {r.user_id: r for r in windowed_features(events(spark, rows), "1 minute", "1 minute", **options).collect()}
    assert out["u1"].event_count == 1 and out["u1"].view_count == 0 and out["u1"].spend == 0.0
    assert out["u2"].spend is None and out["u2"].avg_order_value is None and out["u2"].purchase_count == 1
    assert out["u3"].spend == 2.5 and out["u3"].avg_order_value == 1.25
    assert out["u4"].spend == 0.0


def test_amounts_off_the_decimal_grid_are_kept(spark):
    rows = [row(kind="purchase", amount=a, seconds=i) for i, a in enumerate([1e-5] * 1000 + [1e20, 2.0])]
    rows += [row(kind="purchase", amount=float("nan"), user="u2"), row(kind="purchase", amount=3.0, user="u2")]
    out = {r.user_id: r for r in windowed_features(events(spark, rows), "1 hour", "1 hour").collect()}
    assert out["u1"].spend == pytest.approx(1e20)
    assert out["u2"].spend != out["u2"].spend  # NaN, as a plain sum gives


def test_boundary_and_copies(spark):
    def starts(window, slide, second):
        got = windowed_features(events(spark, [row(seconds=second)]), window, slide, exact=True).collect()
        return sorted(r.window_start for r in got)

    assert starts("1 minute", "1 minute", 60)[0].minute == 1
    assert len(starts("5 minutes", "1 minute", 7)) == 5
    assert len(starts("1 hour", "10 minutes", 7)) == 6


def test_rounds_half_up_on_printed_value(spark):
    rows = [row(kind="purchase", amount=69.58), row(kind="purchase", amount=69.59, seconds=1)]
    got = windowed_features(events(spark, rows), "1 minute", "1 minute").first()
    assert got.avg_order_value == 69.59  # 69.585


def test_conversion_may_exceed_one(spark):
    rows = [row(kind="purchase"), row(kind="purchase", seconds=1), row(kind="add_to_cart", seconds=2)]
    assert windowed_features(events(spark, rows), "1 minute", "1 minute").first().cart_conversion == 2.0


@pytest.mark.parametrize("window,slide", [("5 minutes", "1 minute"), ("7 minutes", "3 minutes"), ("10 minutes", "10 minutes")])
def test_panes_equal_direct_with_a_hot_user(spark, window, slide):
    rng = random.Random(5)
    rows = [
        row(
            user="hot" if rng.random() < 0.4 else f"u{rng.randrange(5)}",
            kind=rng.choice(["view", "add_to_cart", "purchase", "refund", "signup"]),
            seconds=rng.randrange(-3000, 3000),
            amount=rng.choice([None, round(rng.random() * 100, 2)]),
            product=rng.choice([None, "a", "b", "c", "d"]),
            category=rng.choice([None, "x", "y"]),
        )
        for _ in range(600)
    ]
    ev = events(spark, rows)
    panes = windowed_features(ev, window, slide, exact=True)
    direct = windowed_features(ev, window, slide, exact=True, strategy="direct")
    assert panes.exceptAll(direct).count() == 0 and direct.exceptAll(panes).count() == 0


@pytest.mark.parametrize("block", [1, 2])
@pytest.mark.parametrize("window,slide", [("5 minutes", "1 minute"), ("7 minutes", "3 minutes"), ("90 minutes", "40 minutes")])
def test_windows_across_blocks(spark, monkeypatch, window, slide, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    rng = random.Random(6)
    rows = [
        row(user=f"u{rng.randrange(3)}", kind=rng.choice(["view", "purchase"]), seconds=rng.randrange(-9000, 9000),
            product=rng.choice([None, "a", "b"]), category=rng.choice([None, "x", "y"]))
        for _ in range(300)
    ]
    ev = events(spark, rows + rows[:20])
    panes = windowed_features(ev, window, slide, exact=True)
    direct = windowed_features(ev, window, slide, exact=True, strategy="direct")
    assert panes.exceptAll(direct).count() == 0 and direct.exceptAll(panes).count() == 0
    sketched = windowed_features(ev, window, slide, strategy="panes").drop("distinct_products", "distinct_categories")
    assert sketched.exceptAll(direct.drop("distinct_products", "distinct_categories")).count() == 0


def test_tasks_follow_the_windows(spark, monkeypatch):
    """Not the session's width: windows of ever more events would grow in each task."""
    monkeypatch.setattr(windows, "ROWS", 50)
    ev = events(spark, [row(user=f"u{i}", seconds=60 * i) for i in range(100)])
    out = windowed_features(ev, "5 minutes", "1 minute", exact=True)
    assert out.rdd.getNumPartitions() == 10
    assert max(len(part) for part in out.rdd.glom().collect()) < 150


def test_stream_refuses_exact(spark, sf_dir):
    stream = spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp")).parquet(sf_dir)
    with pytest.raises(ValueError):
        windowed_features(stream, "5 minutes", "1 minute", exact=True)
    with pytest.raises(ValueError):
        windowed_features(stream, "5 minutes", "1 minute", strategy="panes")


def test_intervals():
    assert to_micros("1 hour 30 minutes") == 5_400_000_000
    for bad in ("", "5", "1 month", "0 minutes"):
        with pytest.raises(ValueError):
            to_micros(bad)


def test_current_window(spark):
    rows = [("u1", T0 + dt.timedelta(minutes=m)) for m in (1, 2, 3, 4, 5)]
    rows += [("u2", T0 - dt.timedelta(minutes=m)) for m in (10, 5)]
    rows += [("u3", T0 + dt.timedelta(seconds=30)), ("u3", T0)]  # an end at now is closed
    df = spark.createDataFrame(rows, "user_id string, window_end timestamp_ntz")
    df = df.withColumn("window_end", F.col("window_end").cast("timestamp")).withColumn("tag", F.col("window_end"))
    now = F.lit((T0 + dt.timedelta(seconds=30)).isoformat(sep=" ")).cast("timestamp")
    got = {r.user_id: r for r in select_current_windows(df, now).withColumn("t", F.col("window_end").cast("string")).collect()}
    assert got["u1"].t == "2026-09-29 12:01:00"
    assert got["u2"].t == "2026-09-29 11:55:00"
    assert got["u3"].t == "2026-09-29 12:00:30"
    assert all(r.tag == r.window_end for r in got.values())


def test_latest_profile(spark):
    rows = [row(device="web"), row(kind="purchase", seconds=5, device="ios", product="p9")]
    got = latest_profile(events(spark, rows)).collect()
    assert [(r.last_event_type, r.last_device, r.last_product_id) for r in got] == [("purchase", "ios", "p9")]


def test_latest_profile_breaks_ties_by_event_id(spark):
    ev = events(spark, [row(device=d) for d in ("web", "ios", "android")])
    ids = F.when(F.col("device") == "ios", "z").otherwise("a")
    assert latest_profile(ev.withColumn("event_id", ids)).first().last_device == "ios"


def test_some_distinct_values_are_counted_to_one(spark):
    """Hundred products in a window: registers of 5 % would miss one in twenty windows by more than that."""
    ev = spark.range(4000).selectExpr(
        "concat('u', id div 100) as user_id", "'view' as event_type", "concat('p', id) as product_id", "concat('c', id % 30) as category",
        "1.0D as amount", "timestamp'2024-05-01 12:00:00' as event_ts",
    )
    rows = windowed_features(ev, "5 minutes", "5 minutes").collect()
    assert len(rows) == 40 and all(abs(r.distinct_products - 100) <= 1 and r.distinct_categories == 30 for r in rows)
