"""Mixing sources to target weights: floor(rate) copies of each document plus a hash-seeded Bernoulli copy.

DataFrame functions only. Sizes are summed per source before anything is shuffled; the only table that meets all
documents is one row per source. The draw of a document depends on the seed, its id and its text, so reruns
and lost executors give the same mix.

Defined results: null text has size 0; sources rank by code point with null last; a mix of no words has target 0
and takes nothing; repeated rows draw the same number; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read, text_or_empty, wrapped, written_once

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20


def size(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def draw(id_col: str = "doc_id", text_col: str = "text") -> Column:
    seen = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col(id_col).cast("string"), F.md5(text_or_empty(text_col))))
    return F.conv(F.substring(seen, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, draw`` of each document; draw is uniform in [0, 1) from 52 bits of a digest."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size(text_col).alias("size"),
        draw(id_col, text_col).alias("draw"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target, rate``, one row per source.

    Sources share all words by weight; a source stops at ``most`` times its size and the others share the rest.
    Sources fill up in the order of size over weight, so those that are full are the first ones in that order:
    source k is full if the weight share of what is left without the sources before it would exceed its limit.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    order = (F.col("source_size") / F.col("weight"), F.col("rank"))
    every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    left = (
        ranked.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("words", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("words") * F.col("weight") >= most * F.col("source_size") * F.col("shares"))
    )
    # once a source is not full, no later one is; the first of them fixes the level for all that follow
    level = F.min(F.when(~F.col("full"), F.struct("rank_by_ratio", "words", "shares"))).over(every)
    filled = left.withColumn("rank_by_ratio", F.count(F.lit(1)).over(so_far)).withColumn("level", level)
    limit = F.col("source_size") * F.lit(float(most))
    share = F.col("level.words") * F.col("weight") / F.col("level.shares")
    is_full = F.col("level").isNull() | (F.col("rank_by_ratio") < F.col("level.rank_by_ratio"))
    target = F.when(is_full, limit).otherwise(F.least(share, limit))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return filled.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies() -> Column:
    """floor(rate) copies, and one more with probability of the fraction."""
    whole = F.floor("rate")
    return (whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, **columns: str) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, rate, copies, taken``."""
    sized = written_once(sizes(docs, **columns), "mix-sizes")
    per = written_once(targets(sized, weights, most), "mix-targets").withColumnRenamed("source", "of")
    return (
        sized.join(per, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", copies())
        .select("doc_id", "size", "source", "source_size", "target", "rate", "copies")
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    per = written_once(targets(sizes(docs), weights, most), "mix-targets")
    rows = wrapped(docs, source=F.col("source"), draw=draw())
    found = rows.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return found.select("row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op8_mixing": op8_mixing}

ORACLES = {
    "op8_mixing": r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         cast(('0x' || md5(concat_ws('|', '20', cast(doc_id as varchar), md5(coalesce(text, ''))))[1:13]) as bigint)
           / 4503599627370496.0 as draw
  from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double
           else 1.0::double end as w
  from d group by source),
fill as (
  select 0 as step, source, source_size, w, false as closed, 0.0::double as target from per
  union all
  select * from (
    select step + 1, source, source_size, w,
           closed or share >= 3 * source_size as closed,
           case when closed then target when share >= 3 * source_size then 3.0::double * source_size else share end as target
    from (select *, (sum(source_size) over ()
                     - sum(case when closed then target else 0 end) over ())::double * w
                    / sum(case when closed then 0 else w end) over () as share,
                 step as s from fill)
    where step <= (select count(*) from per))),
final as (select * from fill where step = (select count(*) + 1 from per)),
rated as (
  select *, case when source_size > 0 then least(target / source_size, 3.0) else 0 end as rate from final)
select doc_id, size::bigint as size, source_size, target,
       (floor(rate) + (draw < rate - floor(rate))::int)::bigint as copies,
       (size * (floor(rate) + (draw < rate - floor(rate))::int))::bigint as taken
from d join rated r on d.source is not distinct from r.source""",
}
