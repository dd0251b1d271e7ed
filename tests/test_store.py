import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import expiry
from tidemark.operators import store as ops
from tidemark.plans.store import _totals
from tidemark.session import shared_dir
from tidemark.sources.feature_store import FeatureStore

LOG = "user_id string, grp string, seq bigint, guard bigint, write_ts timestamp, f int, h int"
T = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(u, g, s, guard, T + dt.timedelta(hours=s), f, h) for u, g, s, guard, f, h in rows], LOG)


def sequential(rows, on_null="keep"):
    """The store one write at a time."""
    state, applied, skipped = {}, 0, 0
    for user, grp, seq, guard, f, h in sorted(rows, key=lambda r: r[2]):
        if guard is None:
            continue
        held = state.get((user, grp))
        if held and held["guard"] > guard:
            skipped += 1
            continue
        applied += 1
        new = {"f": f, "h": h}
        if on_null == "keep" and held:
            new = {k: v if v is not None else held[k] for k, v in new.items()}
        state[(user, grp)] = {**new, "guard": guard}
    return state, applied, skipped


def folded(df):
    return {(r.user_id, r.grp): {"f": r.f, "h": r.h, "guard": r.guard} for r in df.collect()}


def random_log(seed, n=400):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "b", "hot", "hot"]), rng.choice(["5m", "1h"]), s, rng.choice([None, *range(max(0, s // 4 - 30), s // 4 + 30)]),
         rng.choice([None, rng.randrange(99)]), rng.choice([None, None, rng.randrange(99)]))
        for s in range(n)
    ]


@pytest.mark.parametrize("on_null", ["keep", "replace"])
@pytest.mark.parametrize("parts", [None, 0, 1, 7])
def test_fold_equals_one_write_at_a_time(spark, on_null, parts):
    for seed in (1, 2):
        rows = random_log(seed)
        marked = ops.mark_accepted(log(spark, rows), parts)
        state, applied, skipped = sequential(rows, on_null)
        assert folded(ops.fold(marked, on_null)) == state
        assert folded(ops.fold_log(log(spark, rows), on_null, parts)) == state
        counts = ops.write_counts(marked).agg(F.sum("applied"), F.sum("skipped")).first()
        assert (counts[0], counts[1]) == (applied, skipped)


def test_any_split_and_any_replay_converge(spark):
    rows = random_log(3, 200)
    whole = folded(ops.fold_log(log(spark, rows)))
    for cut in (0, 60, 199):
        early, late = log(spark, rows[:cut]), log(spark, rows[cut:])
        assert folded(ops.compact(ops.fold_log(early), late)) == whole
    again = rows + [(u, g, s + 1000, guard, f, h) for u, g, s, guard, f, h in rows]  # all writes once more, later
    guards = {k: v["guard"] for k, v in folded(ops.fold_log(log(spark, again))).items()}
    assert guards == {k: v["guard"] for k, v in whole.items()}


def test_stale_row_supplies_nothing(spark):
    rows = [("u", "5m", 0, 10, 1, None), ("u", "5m", 1, 5, 2, 7), ("u", "5m", 2, 10, None, None), ("u", "5m", 3, 12, 4, None)]
    marked = ops.mark_accepted(log(spark, rows))
    assert folded(ops.fold(marked)) == {("u", "5m"): {"f": 4, "h": None, "guard": 12}}
    assert ops.write_counts(marked).first()[1:] == (3, 1)


def test_groups_are_independent_and_null_guards_ignored(spark):
    rows = [("u", "5m", 0, 5, 10, None), ("u", "1h", 1, 1, 99, None), ("v", "5m", 2, None, 1, 1)]
    assert folded(ops.fold_log(log(spark, rows))) == {
        ("u", "5m"): {"f": 10, "h": None, "guard": 5}, ("u", "1h"): {"f": 99, "h": None, "guard": 1},
    }


def test_expiry_is_per_user(spark):
    rows = [("u", "5m", 0, 1, 1, 1), ("u", "profile", 20, 1, 1, 1), ("v", "5m", 0, 1, 1, 1)]
    state = ops.fold_log(log(spark, rows))
    now = F.lit((T + dt.timedelta(hours=30))).cast("timestamp")
    assert [r.user_id for r in ops.live_users(state, now).collect()] == ["u"]
    assert ops.store_size(state).first().users == 2


def test_text_form(spark):
    rows = spark.createDataFrame([("u1", 12.5, 3, None), ("u2", 1 / 3, 0, 1.0)], "user_id string, spend double, event_count bigint, cart_conversion double")
    got = {(r.user_id, r.field): r.value for r in ops.to_long(rows, "_5m").collect()}
    assert got == {
        ("u1", "spend_5m"): "12.5", ("u1", "event_count_5m"): "3",
        ("u2", "spend_5m"): "0.333333", ("u2", "event_count_5m"): "0", ("u2", "cart_conversion_5m"): "1.0",
    }
    profile = spark.createDataFrame([("u1", "ios")], "user_id string, last_device string")
    assert [(r.field, r.value) for r in ops.to_long(profile).collect()] == [("last_device", "ios")]


def test_parse_values(spark):
    texts = ["7", "007", "-3", "2.5", "1e3", "nan", "-inf", "ios", "1d", "", "99999999999999999999", "p007"]
    long = spark.createDataFrame([("u", str(i), t) for i, t in enumerate(texts)], "user_id string, field string, value string")
    got = {texts[int(r.field)]: (r.kind, r.int_value, r.double_value, r.text_value) for r in ops.parse_values(long).collect()}
    assert got["7"][:2] == ("int", 7) and got["007"][:2] == ("int", 7) and got["-3"][:2] == ("int", -3)
    assert got["2.5"][0] == "float" and got["2.5"][2] == 2.5 and got["1e3"][2] == 1000.0
    assert got["nan"][0] == "float" and got["-inf"][2] == float("-inf")
    assert got["99999999999999999999"][0] == "float"
    assert all(got[t][0] == "text" and got[t][3] == t for t in ("ios", "1d", "", "p007"))


def test_folds_join_nothing(spark):
    """Fetching the settling rows by a join would shuffle every row of the log again; joins meet carried rows only."""
    rows = [("u1", "a", 1, 1, 1, None), ("u1", "a", 2, 3, None, 5), ("u1", "a", 3, 2, 9, 9), ("u2", "a", 1, None, 4, 4), ("u1", "a", 2, 3, None, 7)]
    out = ops.fold_log(log(spark, rows))
    assert folded(out) == {("u1", "a"): {"f": 1, "h": 7, "guard": 3}}
    assert "SortMergeJoin" not in out._jdf.queryExecution().toString()


def test_totals_beyond_64_bits_are_kept(spark):
    """Six million times a time in milliseconds passes 2**63."""
    rows = [("u", f, str(v)) for f, v in (("at", 2**62), ("at", 2**62), ("at", 2**62), ("n", 2), ("n", -5), ("x", 0.5), ("x", 1.25))]
    long = spark.createDataFrame(rows, "user_id string, field string, value string")
    got = {r.field: (r.kind, r.values_read, r.int_total, r.double_total) for r in _totals(ops.parse_values(long)).collect()}
    assert got == {"at": ("int", 3, None, 3.0 * 2**62), "n": ("int", 2, -3, None), "x": ("float", 2, None, 1.75)}


def test_maps_and_keys(spark):
    rows = spark.createDataFrame([("u1", 2, "x")], "user_id string, b int, a string")
    assert list(ops.feature_maps(ops.to_long(rows)).first().features) == ["a", "b"]
    keys = spark.range(1).select(ops.user_key("fs", F.lit("u1")).alias("k"), ops.metrics_key("fs", F.lit("profile")).alias("m"))
    back = keys.select("k", "m", ops.user_of_key("fs", F.col("k")).alias("u"), ops.user_of_key("fs", F.col("m")).alias("n")).first()
    assert tuple(back) == ("fs:user:u1", "fs:metrics:profile", "u1", None)


def test_store_files(spark):
    store = FeatureStore(spark, shared_dir(spark, "test-store"), buckets=4)
    now = F.lit(T).cast("timestamp")

    def write(batch_id, rows, grp="5m"):
        store.append(spark.createDataFrame(rows, "user_id string, event_count int, spend double, window_end_ms bigint"), grp, batch_id, now)

    def served(users=None):
        return {r.user_id: (r.event_count_5m, r.spend_5m) for r in store.vectors(users).collect()}

    write(0, [(f"u{i}", i, 1.0, 2000) for i in range(50)])
    write(1, [("u1", 9, 5.0, 1000), ("u2", 7, None, 2000)])
    write(1, [("u1", 9, 5.0, 1000), ("u2", 7, None, 2000)])  # replay of the same batch
    write(2, [("u3", 1, 1.0, None)])  # no guard, not written
    expected = {f"u{i}": (i, 1.0) for i in range(50)} | {"u2": (7, 1.0)}
    assert served() == expected
    assert store.compact() == 1 and served() == expected
    write(3, [("u5", 55, 5.5, 3000)])
    expected["u5"] = (55, 5.5)
    assert served() == expected and served(["u5", "u2", "nobody"]) == {"u5": (55, 5.5), "u2": (7, 1.0)}
    assert store.vacuum() == 3 and served() == expected
    assert store.compact() == 2 and served() == expected
    write(4, [("u5", 1, 1.0, 10)])  # late
    assert served() == expected
    plan = store.snapshot("5m", 2, ["u5"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "PushedFilters" in plan


def _profiles(spark, store, batch_id, rows):
    frame = spark.createDataFrame(rows, "user_id string, last_device string, last_seen_ms bigint")
    store.append(frame, "profile", batch_id, F.lit(T).cast("timestamp"))


def _devices(store, users=None):
    return {r.user_id: r.last_device for r in store.fold("profile", users).collect()}


def test_batch_in_flight_is_neither_read_nor_folded_nor_deleted(spark):
    root = shared_dir(spark, "test-in-flight")
    store = FeatureStore(spark, root, buckets=4)
    for batch, user in enumerate("abcd"):
        _profiles(spark, store, batch, [(user, f"d{batch}", 10 + batch)])
    marker, fs = store._path(f"{root}/log/grp=profile/batch_id=2/_SUCCESS")
    fs.delete(marker, False)  # batch 2 is still being written
    assert _devices(store) == {"a": "d0", "b": "d1", "d": "d3"}
    assert store.compact() == 1 and store.manifest()[1] == {"profile": 1}
    assert store.vacuum() == 2
    fs.create(marker, True).close()  # and now ends
    assert _devices(store) == {"a": "d0", "b": "d1", "c": "d2", "d": "d3"}
    assert store.compact() == 2 and store.manifest()[1] == {"profile": 3}
    assert _devices(store) == {"a": "d0", "b": "d1", "c": "d2", "d": "d3"}


def test_reopened_store_keeps_its_buckets_and_null_rule(spark):
    root = shared_dir(spark, "test-reopen")
    store = FeatureStore(spark, root, buckets=64, on_null="replace")
    _profiles(spark, store, 0, [(f"u{i}", "web", 1) for i in range(20)])
    store.compact()
    again = FeatureStore(spark, root, buckets=7)
    assert (again.buckets, again.on_null) == (64, "replace")
    assert len(_devices(again, [f"u{i}" for i in range(20)])) == 20
    _profiles(spark, again, 1, [("u3", None, 2)])
    assert _devices(again, ["u3"]) == {"u3": None}


def test_text_of_numbers_reads_like_the_shortest_form(spark):
    values = [12345678.5, 1e-05, 1.5e-06, 0.0001, 0.00012, 100.0, 1e15, 1e16, 2.5e17, 1e100, -3.25, -1e-05, 0.0, 7.0, float("nan"), float("inf")]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", ops.number_text(F.col("v")).alias("t"))
    assert [r.t for r in frame.collect()] == [repr(v) for v in values]


def lives_one_by_one(rows, ttl):
    """The store one write at a time, with users that expire whole."""
    held, out = {}, []
    for user, grp, seq, guard, ts in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[4], r[2])):
        life, last, guards = held.get(user, (None, None, {}))
        if last is None or last + ttl <= ts:
            life, guards = ts, {}
        accepted = guards.get(grp, guard) <= guard
        if accepted:
            guards[grp], last = guard, ts
        held[user] = (life, last, guards)
        out.append((user, grp, seq, guard, ts, life, accepted))
    return out


def writes(seed, n=500):
    """Guards that often stand far ahead for longer than the time to live, so that lives end behind refused writes."""
    rng = random.Random(seed)
    rows, ts = [], {}
    for s in range(n):
        user = rng.choice(["a", "b", "hot", "hot", None])
        ts[user] = ts.get(user, T) + dt.timedelta(minutes=rng.choice([5, 20, 59, 60, 61, 200]))
        guard = rng.choice([None, s, s, s + rng.choice([0, 100, 400])])
        rows.append((user, rng.choice(["5m", "1h"]), s, guard, ts[user]))
    return rows


def expiring(spark, rows):
    return spark.createDataFrame([(u, g, s, guard, ts, s, s if s % 3 else None) for u, g, s, guard, ts in rows], LOG)


HOUR = dt.timedelta(hours=1)


@pytest.mark.parametrize("parts", [None, 0, 6])
def test_expiry_forgets_guards(spark, parts):
    rows = writes(5)
    marked = expiry.mark_lives(expiring(spark, rows), 3600, parts)
    got = sorted(((r.user_id, r.grp, r.seq, r.guard, r.write_ts, r.life, r.accepted) for r in marked.collect()), key=lambda r: r[2])
    assert got == sorted(lives_one_by_one(rows, HOUR), key=lambda r: r[2])


def test_a_lower_guard_after_expiry_is_accepted(spark):
    rows = [("u", "5m", 0, 100, T), ("u", "5m", 1, 50, T + HOUR / 2), ("u", "5m", 2, 60, T + HOUR), ("u", "5m", 3, 55, T + 1.5 * HOUR)]
    marked = {r.seq: r.accepted for r in expiry.mark_lives(expiring(spark, rows), 3600).collect()}
    assert marked == {0: True, 1: False, 2: True, 3: False}  # the refused write did not keep the user alive
    state = expiry.fold_with_expiry(expiring(spark, rows), 3600).collect()
    assert [(r.guard, r.f, r.write_ts) for r in state] == [(60, 2, T + HOUR)]


def test_groups_of_an_expired_user_go(spark):
    rows = [("u", "5m", 0, 1, T), ("u", "1h", 1, 1, T + 2 * HOUR), ("v", "5m", 2, 1, T), ("v", "1h", 3, 1, T + HOUR / 2)]
    state = expiry.fold_with_expiry(expiring(spark, rows), 3600).collect()
    assert sorted((r.user_id, r.grp, r.write_ts) for r in state) == [("u", "1h", T + 2 * HOUR), ("v", "1h", T + HOUR / 2), ("v", "5m", T + HOUR / 2)]


def test_folding_an_expiring_store_in_steps(spark):
    rows = writes(6, 200)
    whole = sorted(map(repr, expiry.fold_with_expiry(expiring(spark, rows), 3600).collect()))
    cut = sorted({r[4] for r in rows})[len(rows) // 2]
    early, late = [r for r in rows if r[4] < cut], [r for r in rows if r[4] >= cut]
    state = expiry.fold_with_expiry(expiring(spark, early), 3600)
    assert sorted(map(repr, expiry.fold_with_expiry(state.unionByName(expiring(spark, late)), 3600).collect())) == whole


def test_files_of_a_batch_are_bounded_by_buckets(spark):
    store = FeatureStore(spark, shared_dir(spark, "files"), buckets=3)
    rows = spark.range(400).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit(5).cast("bigint").alias("last_seen_ms"), F.col("id").alias("f"))
    for batch in range(2):
        store.append(rows.repartition(40), "profile", batch, F.lit(T).cast("timestamp"))
        files = {r[0] for r in store.log("profile", [batch]).select("_metadata.file_path").distinct().collect()}
        assert len(files) == 3
    one = store.log("profile", [0, 1], ["u17"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.count() == 2 and [r.f for r in store.fold("profile", ["u17"]).collect()] == [17]
    assert sorted(r.f for b in range(3) for r in store.fold("profile", bucket=b).collect()) == list(range(400))


def test_files_of_a_batch_without_adaptive_execution(spark):
    """As sinks of stateful streams write: each task had a file in each bucket, with a megabyte of filter in each."""
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    store = FeatureStore(session, shared_dir(spark, "files"), buckets=3)
    rows = session.range(400).select(F.concat(F.lit("u"), "id").alias("user_id"), F.lit(5).cast("bigint").alias("last_seen_ms"), F.col("id").alias("f"))
    store.append(rows.repartition(40), "profile", 0, F.lit(T).cast("timestamp"))
    store.compact()
    for part in (store.log("profile", [0]), store.snapshot("profile", 1)):
        files = part.select("_metadata.file_path", "_metadata.file_size").distinct().collect()
        assert len(files) == 3 and max(r.file_size for r in files) < 50_000
    assert [r.f for r in store.fold("profile", ["u17"]).collect()] == [17]


def test_log_vectors_equal_joined_folds(spark):
    rows = random_log(9, 200)
    frame = log(spark, rows)
    parts = {g: ops.fold_log(frame.where(F.col("grp") == g)) for g in ("5m", "1h")}
    want = ops.feature_vectors(parts)
    got = ops.log_vectors(frame, {"5m": ["f", "h"], "1h": ["f", "h"]})
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
