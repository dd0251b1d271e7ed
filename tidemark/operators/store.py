"""The online feature store as set operations over an append-only log.

A log row is ``user_id, grp, seq, guard, write_ts`` plus the feature columns of its group. ``seq`` is the
micro-batch that wrote it, ``guard`` the window end or last-seen time that may never go backwards.
Writing one row at a time under a compare-and-set equals: order by ``seq``, accept a row unless an earlier
row of the same user and group carries a greater guard, then keep per field the last accepted value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import PARTS, in_order, running_before, running_over

KEYS = ["user_id", "grp"]
LOG_COLUMNS = [*KEYS, "seq", "guard", "write_ts"]

# Feature groups and the suffix of their fields in a user's vector.
GROUP_SUFFIX = {"5m": "_5m", "1h": "_1h", "profile": ""}
GUARDS = {"5m": "window_end_ms", "1h": "window_end_ms", "profile": "last_seen_ms"}


def feature_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in (*LOG_COLUMNS, "accepted")]


def to_log(rows: DataFrame, grp: str, seq: Column | int, guard: str, write_ts: Column) -> DataFrame:
    """Feature rows of one group as log rows; rows without a guard are not written at all."""
    seq = seq if isinstance(seq, Column) else F.lit(seq)
    return rows.where(F.col(guard).isNotNull()).select(
        "user_id",
        F.lit(grp).alias("grp"),
        seq.cast("bigint").alias("seq"),
        F.col(guard).cast("bigint").alias("guard"),
        write_ts.cast("timestamp").alias("write_ts"),
        *[c for c in rows.columns if c != "user_id"],
    )


def _unbeaten() -> Column:
    return F.coalesce(F.col("guard") >= F.col("_seen"), F.lit(True))


def mark_accepted(log: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """Add ``accepted``: no earlier write of this user and group had a greater guard (equal is fine)."""
    guarded = log.where(F.col("guard").isNotNull())
    seen = running_before(guarded, KEYS, "seq", "guard", "_seen", parts=parts)
    return seen.withColumn("accepted", _unbeaten()).drop("_seen")


def write_counts(marked: DataFrame) -> DataFrame:
    """Applied and stale writes per group."""
    return marked.groupBy("grp").agg(
        F.count_if("accepted").alias("applied"), F.count_if(~F.col("accepted")).alias("skipped")
    )


def _settled(accepted: DataFrame, fields: Sequence[str], on_null: str) -> DataFrame:
    """One row per user and group from its accepted rows: each field as the row of the greatest seq has it, of rows with
    equal seq the greatest value.

    Rows with a ``_part`` (see ``ordered.in_order``) are put together per part first. They were windowed by the same keys
    and are in their order, so this neither shuffles nor sorts nor holds them; a row per part, user and group is left.
    """
    if on_null not in ("keep", "replace"):
        raise ValueError("on_null must be 'keep' or 'replace'")

    def last(name: str) -> Column:
        held = F.struct("seq", F.col(name).alias("value"))
        return F.max(F.when(F.col(name).isNotNull(), held) if on_null == "keep" else held).alias(name)

    newest = [F.max(c).alias(c) for c in ("seq", "guard", "write_ts")]
    first = ["_part"] if "_part" in accepted.columns else []
    held = accepted.groupBy(*first, *KEYS).agg(*newest, *[last(c) for c in fields])
    if first:
        held = held.groupBy(*KEYS).agg(*newest, *[F.max(c).alias(c) for c in fields])
    return held.select(*KEYS, "seq", "guard", "write_ts", *[F.col(c)["value"].alias(c) for c in fields])


def fold(marked: DataFrame, on_null: str = "keep") -> DataFrame:
    """One row per user and group: what the store holds after all writes.

    ``keep``: a null in an accepted row leaves the field's older value in place, as writing only the
    present fields does. ``replace``: the last accepted row wins whole. The result is itself a log frame,
    so a fold can be folded again with later rows.
    """
    return _settled(marked.where("accepted"), feature_columns(marked), on_null)


def fold_log(log: DataFrame, on_null: str = "keep", parts: int | None = PARTS) -> DataFrame:
    """:func:`fold` of a log, which is read once: its rows are written in order, in parts, and judged and folded within
    them. This runs jobs at once; ``parts=None`` does not, see ``running_before``."""
    fields, guarded = feature_columns(log), log.where(F.col("guard").isNotNull())
    if parts is None:
        return fold(mark_accepted(log, parts), on_null)
    rows = in_order(guarded, [*KEYS, "seq", "guard"], parts)
    return _settled(running_over(rows, KEYS, "seq", "guard", "_seen").where(_unbeaten()), fields, on_null)


def compact(snapshot: DataFrame, later: DataFrame, on_null: str = "keep", parts: int | None = PARTS) -> DataFrame:
    """Fold later log rows into an existing fold; equals folding everything from the start.

    The snapshot row carries the greatest guard so far and sits before every later row, so it decides
    acceptance exactly as the rows it stands for.
    """
    return fold_log(snapshot.unionByName(later, allowMissingColumns=True), on_null, parts)


def live_users(folded: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """Users whose vector has not expired: any applied write keeps all of a user's groups alive."""
    return (
        folded.groupBy("user_id")
        .agg(F.max("write_ts").alias("last_write"))
        .where(F.col("last_write") + F.make_interval(secs=F.lit(ttl_seconds)) > now)
    )


def unexpired(vectors: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """Vectors of live users. Guards and fields of a user who expired and came back are not forgotten."""
    return vectors.where(F.col("last_write") + F.make_interval(secs=F.lit(ttl_seconds)) > now)


def store_size(folded: DataFrame) -> DataFrame:
    return folded.select("user_id").distinct().agg(F.count(F.lit(1)).alias("users"))


def feature_vectors(folds: Mapping[str, DataFrame]) -> DataFrame:
    """One wide row per user from the folds of the feature groups, fields suffixed by group.

    Each group has at most one row per user, so a single grouping by user over the union replaces a
    chain of outer joins.
    """
    parts = []
    for grp, folded in folds.items():
        suffix = GROUP_SUFFIX.get(grp, f"_{grp}")
        fields = [F.col(c).alias(f"{c}{suffix}") for c in feature_columns(folded)]
        parts.append(folded.select("user_id", "write_ts", *fields))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    fields = [c for c in union.columns if c not in ("user_id", "write_ts")]
    return union.groupBy("user_id").agg(
        F.max("write_ts").alias("last_write"), *[F.max(c).alias(c) for c in fields]
    )


def log_vectors(
    log: DataFrame, groups: Mapping[str, Sequence[str]], on_null: str = "keep", parts: int | None = PARTS
) -> DataFrame:
    """:func:`feature_vectors` from the log of all groups, folded once. ``groups`` names each group's fields."""
    folded = fold_log(log, on_null, parts)
    fields = list(dict.fromkeys(c for names in groups.values() for c in names))
    users = folded.groupBy("user_id").agg(
        F.max("write_ts").alias("last_write"), F.collect_list(F.struct("grp", *fields)).alias("_rows")  # a row per group
    )

    def own(grp: str, name: str) -> Column:
        row = F.get(F.filter("_rows", lambda r: r["grp"] == grp), F.lit(0))
        return row[name].alias(f"{name}{GROUP_SUFFIX.get(grp, f'_{grp}')}")

    return users.select("user_id", "last_write", *[own(grp, c) for grp, names in groups.items() for c in names])


def number_text(value: Column) -> Column:
    """A double as text: plain digits from 0.0001 up to 1e16, else an exponent of at least two digits.

    Every text has the fewest digits that read back as the same number.
    """
    java = value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    wide = F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2")
    size = F.abs(value)
    return (
        F.when(value.isNull() | (value == 0), java)
        .when(F.isnan(value) | (size == float("inf")), F.lower(F.replace(java, F.lit("Infinity"), F.lit("inf"))))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.replace(F.regexp_replace(wide, r"E(\d)", "e+$1"), F.lit("E-"), F.lit("e-")))
    )


def to_long(rows: DataFrame, suffix: str = "", exclude: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """``user_id, field, value``: the text form of a feature row, nulls left out, doubles to 6 places."""
    pairs = []
    for field in rows.schema.fields:
        if field.name in exclude:
            continue
        value = F.col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            value = number_text(F.round(value, 6))
        pairs.append(F.struct(F.lit(field.name + suffix).alias("field"), value.cast("string").alias("value")))
    return (
        rows.select("user_id", F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    )


# Fixed pattern: text that reads back as a floating-point number.
_NUMBER = r"(?i)^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"
_WHOLE = r"^[+-]?[0-9]+$"


def parse_values(long: DataFrame) -> DataFrame:
    """Text -> typed: whole numbers that fit 64 bits, else numbers, else text.

    The text form cannot tell the text ``007`` from the number 7; typed feature columns never go through it.
    """
    whole = F.when(F.col("value").rlike(_WHOLE), F.col("value").try_cast("bigint"))
    number = F.when(whole.isNull() & F.col("value").rlike(_NUMBER), F.col("value").try_cast("double"))
    return long.select(
        "user_id",
        "field",
        whole.alias("int_value"),
        number.alias("double_value"),
        F.when(whole.isNull() & number.isNull(), F.col("value")).alias("text_value"),
        F.when(whole.isNotNull(), "int").when(number.isNotNull(), "float").otherwise("text").alias("kind"),
    )


def feature_maps(long: DataFrame) -> DataFrame:
    """``user_id, features``: a map whose keys come in name order. A user has one entry per field name."""
    entries = F.array_sort(F.collect_list(F.struct("field", "value")))
    return long.groupBy("user_id").agg(F.map_from_entries(entries).alias("features"))


def user_key(prefix: str, user_id: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), F.lit("user"), user_id)


def metrics_key(prefix: str, query: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), F.lit("metrics"), query)


def user_of_key(prefix: str, key: Column) -> Column:
    """Inverse of :func:`user_key`; null for keys of another kind."""
    head = f"{prefix}:user:"
    return F.when(key.startswith(head), F.substring(key, len(head) + 1, 2**31 - 1))
