"""Adapter, sliding windows, current windows, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profiles import latest_profile
from tidemark.operators.windows import select_current_windows, windowed_features
from tidemark.plans import sql
from tidemark.plans.derived import NOW, at, events, plain

SPECS = {
    "5m": ("5 minutes", "1 minute", 300, 60),
    "1h": ("1 hour", "10 minutes", 3600, 600),
    "1d": ("1 day", "4 hours", 86400, 14400),
    "90m": ("90 minutes", "40 minutes", 5400, 2400),  # window is no multiple of the slide
    "year": ("365 days", "365 days", 365 * 86400, 365 * 86400),  # the whole history of a user
}


DISTINCT = ["distinct_products", "distinct_categories"]


def distinct_checked(guess: DataFrame, truth: DataFrame, keys: list[str], share: float = 0.15) -> DataFrame:
    """``guess`` with ``distinct_close`` in place of its approximate counts: within ``share`` (three standard errors of
    the 5 % that is promised) or 1 of the exact counts. A window that only one side has is not close."""
    exact = truth.select(*keys, *[F.col(n).alias(f"true_{n}") for n in DISTINCT])
    both = guess.join(exact, keys, "full")
    close = [
        F.coalesce(F.abs(F.col(n) - F.col(f"true_{n}")) <= F.greatest(F.lit(1.0), share * F.col(f"true_{n}")), F.lit(False))
        for n in DISTINCT
    ]
    return both.withColumn("distinct_close", close[0] & close[1]).select(
        *[c for c in guess.columns if c not in DISTINCT], "distinct_close"
    )


def _counts(grp: str, **options):
    window, slide, *_ = SPECS[grp]

    def query(spark, sf):
        ev = events(spark, sf)
        guess = windowed_features(ev, window, slide, **options)
        return plain(distinct_checked(guess, windowed_features(ev, window, slide, exact=True), ["user_id", "window_start"]))

    return query


def _features(grp: str, **options):
    window, slide, *_ = SPECS[grp]
    return lambda spark, sf: plain(windowed_features(events(spark, sf), window, slide, **options))


def _current(grp: str):
    window, slide, *_ = SPECS[grp]
    return lambda spark, sf: plain(
        select_current_windows(windowed_features(events(spark, sf), window, slide, exact=True), at(NOW))
    )


def _distinct_check(strategy: str):
    """Approximate distincts of whole histories against exact ones: how many stray by over 15 % (and 1)."""

    def query(spark, sf) -> DataFrame:
        window, slide, *_ = SPECS["year"]
        keys = ["user_id", "window_start"]
        names = ["distinct_products", "distinct_categories"]
        ev = events(spark, sf)
        guess = windowed_features(ev, window, slide, strategy=strategy)
        truth = windowed_features(ev, window, slide, exact=True)
        both = guess.select(*keys, *names).join(
            truth.select(*keys, *[F.col(n).alias(f"true_{n}") for n in names]), keys, "full"
        )
        too_far = [
            F.coalesce(
                F.abs(F.col(n) - F.col(f"true_{n}")) > F.greatest(F.lit(1.0), 0.15 * F.col(f"true_{n}")), F.lit(True)
            )
            for n in names
        ]
        return both.agg(F.count(F.lit(1)).alias("windows"), F.count_if(too_far[0] | too_far[1]).alias("out_of_bounds"))

    return query


QUERIES = {
    "storefront_events": lambda spark, sf: plain(events(spark, sf)),
    "windowed_features_5m": _features("5m", exact=True),
    "windowed_features_1h": _features("1h", exact=True),
    "windowed_features_1d": _features("1d", exact=True),
    "windowed_features_90m": _features("90m", exact=True),
    "windowed_features_direct_1d": _features("1d", exact=True, strategy="direct"),
    "windowed_counts_1h": _counts("1h"),
    "windowed_counts_sketch_5m": _counts("5m", strategy="panes"),
    "distinct_approx_bounded": _distinct_check("direct"),
    "distinct_sketch_bounded": _distinct_check("panes"),
    "current_windows_5m": _current("5m"),
    "current_windows_1h": _current("1h"),
    "latest_profile": lambda spark, sf: latest_profile(events(spark, sf)),
}


def _features_sql(grp: str, columns: str = "*") -> str:
    _, _, length, slide = SPECS[grp]
    return sql.with_(sql.EVENTS, sql.windows("feats", length, slide)) + f"select {columns} from feats"


def _current_sql(grp: str) -> str:
    _, _, length, slide = SPECS[grp]
    return sql.with_(sql.EVENTS, sql.windows("feats", length, slide)) + f"""
select * exclude (rn) from (
  select *, row_number() over (
    partition by user_id
    order by window_end > timestamp '{NOW}' desc,
             case when window_end > timestamp '{NOW}' then window_end end asc nulls last,
             window_end desc) as rn
  from feats) where rn = 1"""


_NO_DISTINCT = "* exclude (distinct_products, distinct_categories), true as distinct_close"
_BOUNDED = _features_sql("year", "count(*) as windows, cast(0 as bigint) as out_of_bounds")

ORACLES = {
    "storefront_events": sql.with_(sql.EVENTS) + "select * exclude (n) from ev",
    "windowed_features_5m": _features_sql("5m"),
    "windowed_features_1h": _features_sql("1h"),
    "windowed_features_1d": _features_sql("1d"),
    "windowed_features_90m": _features_sql("90m"),
    "windowed_features_direct_1d": _features_sql("1d"),
    "windowed_counts_1h": _features_sql("1h", _NO_DISTINCT),
    "windowed_counts_sketch_5m": _features_sql("5m", _NO_DISTINCT),
    "distinct_approx_bounded": _BOUNDED,
    "distinct_sketch_bounded": _BOUNDED,
    "current_windows_5m": _current_sql("5m"),
    "current_windows_1h": _current_sql("1h"),
    "latest_profile": sql.with_(sql.EVENTS, sql.PROFILE) + "select * from profile",
}
