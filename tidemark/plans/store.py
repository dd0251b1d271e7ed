"""Guarded folds, compaction, expiry, text form and vectors of the feature store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import expiry
from tidemark.operators import store as ops
from tidemark.operators.profiles import latest_profile
from tidemark.operators.windows import windowed_features
from tidemark.plans import sql
from tidemark.plans.derived import at, events, expiring_log, folds, guarded_log, plain, profile_log, vectors, window_log
from tidemark.session import shared_dir
from tidemark.sources.feature_store import FeatureStore

TTL_NOW = "2024-01-30 18:00:00"
TTL_SECONDS = 6 * 3600
FORGET_SECONDS = 24 * 3600
PREFIX = "features"


def _guarded_fold(on_null: str):
    return lambda spark, sf: plain(ops.fold_log(guarded_log(spark, sf), on_null))


def _compaction(spark, sf):
    """Snapshot of the writes before mid-month, later writes folded in: same as folding everything."""
    log = guarded_log(spark, sf)
    cut = F.col("write_ts") < at("2024-01-15 00:00:00")
    return plain(ops.compact(ops.fold_log(log.where(cut)), log.where(~cut)))


def _union_log(spark, sf):
    parts = [
        window_log(spark, sf, "5m", "5 minutes", "1 minute", 60),
        window_log(spark, sf, "1h", "1 hour", "10 minutes", 600),
        profile_log(spark, sf),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def _keys(spark, sf):
    users = events(spark, sf).select("user_id").distinct()
    key = ops.user_key(PREFIX, F.col("user_id"))
    return users.select(
        key.alias("key"), ops.user_of_key(PREFIX, key).alias("user_id"),
        ops.user_of_key(PREFIX, ops.metrics_key(PREFIX, F.lit("profile"))).alias("not_a_user"),
    )


def _long(spark, sf):
    feats = windowed_features(events(spark, sf), "1 hour", "10 minutes", exact=True)
    rows = feats.drop("window_start", "window_end")
    return ops.to_long(rows, "_1h", exclude=("user_id", "window_end_ms"))


def _parsed(spark, sf):
    """The text form read back, summed up per field: text is compared by value, not by spelling."""
    return _totals(ops.parse_values(_long(spark, sf)))


def _totals(parsed):
    """Whole numbers are summed exactly; a total that no 64-bit number holds stands in ``double_total`` instead."""
    sums = parsed.groupBy("field", "kind").agg(
        F.count(F.lit(1)).alias("values_read"),
        F.sum(F.col("int_value").cast("decimal(20,0)")).alias("whole"),
        F.sum(F.col("double_value").cast("decimal(18,4)")).cast("double").alias("double_total"),
    )
    total = F.col("whole").try_cast("bigint")
    beyond = F.when(total.isNull(), F.col("whole").cast("double"))
    return sums.select(
        "field", "kind", "values_read", total.alias("int_total"), F.coalesce("double_total", beyond).alias("double_total")
    )


def _text(spark, sf):
    """The written text itself, with values outside the range of plain digits among them."""
    feats = windowed_features(events(spark, sf), "1 hour", "10 minutes", exact=True)
    rows = feats.select(
        "user_id", "window_end_ms", "spend", "avg_order_value", "cart_conversion", "event_count",
        (F.col("event_count") * 1e9 + 0.5).alias("large"), (F.col("event_count") * 1e16).alias("huge"), (F.col("spend") / 1e7).alias("small"),
    )
    keyed = rows.withColumn("user_id", F.concat_ws(":", "user_id", "window_end_ms")).drop("window_end_ms")
    return ops.to_long(keyed).groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows_written"))


LOOKUP_CUT, LOOKUP_BUCKETS = "2024-01-16 00:00:00", 4


def _pruned_lookup(spark, sf):
    """Two batches of profiles, the first compacted; the store is opened with another bucket count and asked for all
    users, bucket by bucket."""
    root = shared_dir(spark, "lookup")
    ev = events(spark, sf)
    store = FeatureStore(spark, root, buckets=LOOKUP_BUCKETS)
    early = F.coalesce(F.col("event_ts") < at(LOOKUP_CUT), F.lit(False))
    for batch, part in enumerate((early, ~early)):
        store.append(latest_profile(ev.where(part)), "profile", batch, at(LOOKUP_CUT))
        if batch == 0:
            store.compact()
    opened = FeatureStore(spark, root, buckets=7)
    found = [opened.fold("profile", bucket=b) for b in range(LOOKUP_BUCKETS)]
    return reduce(DataFrame.unionByName, found).select("user_id", *ops.feature_columns(found[0]))


def _profile_maps(spark, sf):
    long = ops.to_long(folds(spark, sf)["profile"], exclude=("user_id", *ops.LOG_COLUMNS))
    return ops.feature_maps(long).select(
        "user_id",
        F.array_join(F.map_keys("features"), ",").alias("names"),
        F.array_join(F.map_values("features"), ",").alias("texts"),
    )


def _expiry_refolded(spark, sf):
    """Writes before mid-month folded first: with the later ones the same state as from all writes."""
    log = expiring_log(spark, sf)
    cut = F.col("write_ts") < at("2024-01-15 00:00:00")
    early = expiry.fold_with_expiry(log.where(cut), FORGET_SECONDS)
    return plain(expiry.fold_with_expiry(early.unionByName(log.where(~cut)), FORGET_SECONDS))


QUERIES = {
    "lives_marked": lambda spark, sf: plain(
        expiry.mark_lives(expiring_log(spark, sf), FORGET_SECONDS).select("user_id", "grp", "seq", "life", "accepted")
    ),
    "fold_with_expiry": lambda spark, sf: plain(expiry.fold_with_expiry(expiring_log(spark, sf), FORGET_SECONDS)),
    "expiry_refolded": _expiry_refolded,
    "guarded_fold": _guarded_fold("keep"),
    "guarded_fold_replace": _guarded_fold("replace"),
    "guarded_accepted": lambda spark, sf: ops.mark_accepted(guarded_log(spark, sf)).select("user_id", "seq", "accepted"),
    "guarded_counts": lambda spark, sf: ops.write_counts(ops.mark_accepted(guarded_log(spark, sf))),
    "compaction_equiv": _compaction,
    "live_users_ttl": lambda spark, sf: plain(
        ops.live_users(ops.fold_log(guarded_log(spark, sf)), at(TTL_NOW), TTL_SECONDS)
    ),
    "unexpired_vectors": lambda spark, sf: ops.unexpired(
        ops.feature_vectors({"profile": folds(spark, sf)["profile"]}), at(TTL_NOW), TTL_SECONDS
    ).drop("last_write"),
    "store_size": lambda spark, sf: ops.store_size(ops.fold_log(_union_log(spark, sf))),
    "store_keys": _keys,
    "feature_log_counts": lambda spark, sf: ops.write_counts(ops.mark_accepted(_union_log(spark, sf))),
    "feature_long": lambda spark, sf: _long(spark, sf).groupBy("field").agg(F.count("value").alias("values_written")),
    "feature_parsed": _parsed,
    "feature_text": _text,
    "store_lookup_pruned": _pruned_lookup,
    "feature_maps": _profile_maps,
    "feature_vector": lambda spark, sf: plain(vectors(spark, sf)),
}

GUARDED = """
glog as (
  select user_id, 'profile' as grp, n as seq, n * 7919 % 10007 + n * 3 as guard, event_ts as write_ts,
         device as last_device, category as last_category, case when event_type = 'purchase' then amount end as spend
  from ev where event_type <> 'signup'
),
marked as (
  select *, coalesce(guard >= max(guard) over (
    partition by user_id, grp order by seq rows between unbounded preceding and 1 preceding), true) as accepted
  from glog
)"""

# One write after the other: the life, its last applied write, and the guards of both groups.
LIVES = f"""
turns as (
  select *, row_number() over (partition by user_id order by write_ts, seq) as turn from (
    select * replace (if(seq % 2 = 0, 'profile', '5m') as grp) from glog)
),
lives as (
  select user_id, turn, write_ts as life, write_ts as last, if(grp = '5m', guard, null) as g5, if(grp = '5m', null, guard) as gp, true as accepted
  from turns where turn = 1
  union all
  select user_id, turn, if(gone, write_ts, life), if(fits, write_ts, last),
         if(grp = '5m' and fits, guard, if(gone, null, g5)), if(grp <> '5m' and fits, guard, if(gone, null, gp)), fits
  from (
    select t.*, l.life, l.last, l.g5, l.gp, l.last + interval {FORGET_SECONDS} second <= t.write_ts as gone,
           gone or t.guard >= coalesce(if(t.grp = '5m', l.g5, l.gp), t.guard) as fits
    from lives l join turns t on t.user_id = l.user_id and t.turn = l.turn + 1)
),
lived as (select t.*, l.life, l.accepted from turns t join lives l using (user_id, turn))"""

LIVES_MARKED = "with recursive " + sql.with_(sql.EVENTS, GUARDED, LIVES).strip().removeprefix("with ") + "select user_id, grp, seq, life, accepted from lived"

_LAST_LIVES = "with recursive " + sql.with_(sql.EVENTS, GUARDED, LIVES).strip().removeprefix("with ") + """
select user_id, grp, max(seq) as seq, max(guard) as guard, any_value(ended) as write_ts,
       arg_max(last_device, seq) filter (where last_device is not null) as last_device,
       arg_max(last_category, seq) filter (where last_category is not null) as last_category,
       arg_max(spend, seq) filter (where spend is not null) as spend
from (select *, max(life) over (partition by user_id) as newest, max(write_ts) over (partition by user_id) as ended
      from lived where accepted)
where life = newest group by user_id, grp"""

_GUARDED_FOLD = sql.with_(sql.EVENTS, GUARDED) + """
select user_id, grp, max(seq) as seq, max(guard) as guard, max(write_ts) as write_ts,
       arg_max(last_device, seq) filter (where last_device is not null) as last_device,
       arg_max(last_category, seq) filter (where last_category is not null) as last_category,
       arg_max(spend, seq) filter (where spend is not null) as spend
from marked where accepted group by user_id, grp"""

_FIELDS = [
    "event_count", "view_count", "cart_count", "purchase_count", "spend", "refund_amount", "avg_order_value",
    "cart_conversion", "distinct_products", "distinct_categories", "last_event_ms",
]


def logged(name: str, length: int, slide: int) -> str:
    """CTEs: the log of all windows with late ones among them, and its fold with older values kept where newer are null."""
    kept = ",\n".join(f"arg_max({f}, seq) filter (where {f} is not null) as {f}" for f in [*_FIELDS, "window_end_ms"])
    return sql.windows(f"f_{name}", length, slide) + f""",
seq_{name} as (
  select *, window_end_ms // {slide * 1000} * 2 + case when window_end_ms // {slide * 1000} % 11 = 0 then 7 else 0 end as seq
  from f_{name}
),
log_{name} as (
  select *, coalesce(window_end_ms >= max(window_end_ms) over (
    partition by user_id order by seq rows between unbounded preceding and 1 preceding), true) as accepted
  from seq_{name}
),
fold_{name} as (
  select user_id, max(window_end) as write_ts, {kept} from log_{name} where accepted group by user_id
)"""


VECTORS = (
    logged("5m", 300, 60) + ",\n" + logged("1h", 3600, 600) + ",\n" + sql.PROFILE + """,
vectors as (
  select p.user_id, greatest(a.write_ts, b.write_ts, make_timestamp(last_seen_ms * 1000)) as last_write,
         """ + ", ".join(f"a.{f} as {f}_5m, b.{f} as {f}_1h" for f in [*_FIELDS, "window_end_ms"]) + """,
         last_event_type, last_category, last_product_id, last_device, last_seen_ms
  from profile p join fold_5m a using (user_id) join fold_1h b using (user_id)
)"""
)

_ROUND_LARGE = "event_count * 1e9::double + 0.5"
_LONG = ", ".join(f"('{f}_1h', cast({f} as double))" for f in _FIELDS)
_LONG_ROWS = sql.with_(sql.EVENTS, sql.windows("feats", 3600, 600)) + f""",
long as (
  select v.field, v.value from feats, lateral (values {_LONG}) v(field, value) where v.value is not null
)"""
_DOUBLES = "('spend_1h', 'refund_amount_1h', 'avg_order_value_1h', 'cart_conversion_1h')"

ORACLES = {
    "lives_marked": LIVES_MARKED,
    "fold_with_expiry": _LAST_LIVES,
    "expiry_refolded": _LAST_LIVES,
    "guarded_fold": _GUARDED_FOLD,
    "guarded_fold_replace": sql.with_(sql.EVENTS, GUARDED) + """
select user_id, grp, seq, guard, write_ts, last_device, last_category, spend from (
  select *, row_number() over (partition by user_id, grp order by seq desc) as rn from marked where accepted)
where rn = 1""",
    "guarded_accepted": sql.with_(sql.EVENTS, GUARDED) + "select user_id, seq, accepted from marked",
    "guarded_counts": sql.with_(sql.EVENTS, GUARDED) + """
select grp, count(*) filter (where accepted) as applied, count(*) filter (where not accepted) as skipped
from marked group by grp""",
    "compaction_equiv": _GUARDED_FOLD,
    "live_users_ttl": sql.with_(sql.EVENTS, GUARDED) + f"""
select user_id, max(write_ts) as last_write from marked where accepted group by user_id
having max(write_ts) + interval {TTL_SECONDS} second > timestamp '{TTL_NOW}'""",
    "unexpired_vectors": sql.with_(sql.EVENTS, sql.PROFILE) + f"""
select * from profile where make_timestamp(last_seen_ms * 1000) + interval {TTL_SECONDS} second > timestamp '{TTL_NOW}'""",
    "store_size": sql.with_(sql.EVENTS) + "select count(distinct user_id) as users from ev",
    "store_keys": sql.with_(sql.EVENTS) + f"""
select distinct '{PREFIX}:user:' || user_id as key, user_id, cast(null as varchar) as not_a_user from ev""",
    "feature_log_counts": sql.with_(sql.EVENTS, VECTORS) + """
select '5m' as grp, count(*) filter (where accepted) as applied, count(*) filter (where not accepted) as skipped from log_5m
union all select '1h', count(*) filter (where accepted), count(*) filter (where not accepted) from log_1h
union all select 'profile', count(*), 0 from profile""",
    "feature_long": _LONG_ROWS + "select field, count(*) as values_written from long group by field",
    "feature_parsed": _LONG_ROWS + f"""
select field, case when field in {_DOUBLES} then 'float' else 'int' end as kind, count(*) as values_read,
       case when field not in {_DOUBLES} then cast(sum(cast(value as hugeint)) as bigint) end as int_total,
       case when field in {_DOUBLES} then cast(sum(cast(value as decimal(18,4))) as double) end as double_total
from long group by field""",
    "feature_text": sql.with_(sql.EVENTS, sql.windows("feats", 3600, 600)) + f"""
select field, value, count(*) as rows_written from (
  select unnest(['spend', 'avg_order_value', 'cart_conversion', 'event_count', 'large', 'huge', 'small']) as field,
         unnest([cast({sql.rounded("spend", 6)} as varchar), cast({sql.rounded("avg_order_value", 6)} as varchar),
                 cast({sql.rounded("cart_conversion", 6)} as varchar), cast(event_count as varchar),
                 cast({_ROUND_LARGE} as varchar), cast(event_count * 1e16::double as varchar), cast({sql.rounded("spend / 1e7", 6)} as varchar)]) as value
  from feats) where value is not null group by field, value""",
    "store_lookup_pruned": sql.with_(sql.EVENTS) + f""",
parts as (
  select *, coalesce(event_ts < timestamp '{LOOKUP_CUT}', false) as early from ev),
newest as (select * from parts qualify row_number() over (partition by user_id, early order by event_ts desc, event_id desc) = 1)
select user_id, arg_max(event_type, not early) as last_event_type, arg_max(category, not early) as last_category,
       arg_max(product_id, not early) as last_product_id,
       arg_max(device, not early) filter (where device is not null) as last_device,
       max(epoch_us(event_ts) // 1000) as last_seen_ms
from newest group by user_id""",
    "feature_maps": sql.with_(sql.EVENTS, sql.PROFILE) + """
select user_id,
       array_to_string(list(f order by f), ',') as names, array_to_string(list(v order by f), ',') as texts
from (
  select user_id, unnest(['last_category','last_device','last_event_type','last_product_id','last_seen_ms']) as f,
         unnest([last_category, last_device, last_event_type, last_product_id, cast(last_seen_ms as varchar)]) as v
  from profile) where v is not null group by user_id""",
    "feature_vector": sql.with_(sql.EVENTS, VECTORS) + "select * from vectors",
}
