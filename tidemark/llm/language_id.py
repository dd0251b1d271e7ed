"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (one to three letters, words padded with a blank), most
frequent first. The profile of a language comes from all its training texts: tasks count n-grams and send sums, never
texts. A document gets the language whose profile its own is least out of place with; the distance is the sum over
its n-grams of the difference in rank, or the profile's length where the language lacks the n-gram.

An n-gram is a 63-bit number, three code points of 21 bits, so counting is sorting numbers; ties in count are broken
by that number. Texts are counted in blocks, so a very long one needs memory for its code points only.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything when no row can
be learned from; null ids count as the empty string for the fold; languages at equal distance resolve to the
smallest; repeated rows count as often as they come; an empty table gives an empty result. Labels that no text with a
letter carries are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches, text_or_empty, wrapped, written_once

LENGTH = 400
UNKNOWN = "und"
BLOCK = 1 << 18
#: Distinct n-grams a task holds for a language before it sends their sums.
HELD = 1 << 20
#: A profile per language is broadcast; more languages than this are refused.
MOST_LANGUAGES = 2000


def tables():
    """For each code point: is it a letter."""
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_blocks(text: str, letter) -> Iterator:
    """Arrays of n-gram numbers of the text, block by block; a blank is code point 32."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = np.where(letter[c], c, 32)
    c = np.concatenate(([32], c, [32]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # one blank between words
    if len(c) < 3:
        return
    for begin in range(0, len(c), BLOCK):
        one = c[begin : begin + BLOCK]
        two = c[begin : begin + BLOCK + 1]
        three = c[begin : begin + BLOCK + 2]
        grams = [one[one != 32], (two[:-1] << 21) | two[1:]]
        if len(three) >= 3:
            grams.append(((three[:-2] << 42) | (three[1:-1] << 21) | three[2:])[three[1:-1] != 32])
        yield np.concatenate(grams)


def summed(values, counts):
    import numpy as np

    found, place = np.unique(values, return_inverse=True)
    return found, np.bincount(place, weights=counts, minlength=len(found)).astype(np.int64)


def text_grams(text: str, letter):
    """Distinct n-grams of a text and their counts."""
    import numpy as np

    parts = [np.unique(g, return_counts=True) for g in gram_blocks(text, letter)]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def top(grams, counts, length: int):
    """The most frequent ``length`` n-grams in order of rank."""
    import numpy as np

    if len(grams) > length:  # only those that can be among them are put in order
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:length]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``lang, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        letter, held = tables(), {}

        def merged(parts):
            return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        def out(lang, grams, counts):
            return pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": counts})

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = held.setdefault(lang, [])
                parts.append(text_grams(text, letter))
                if sum(len(p[0]) for p in parts[1:]) > HELD:
                    held[lang] = [merged(parts)]
                    if len(held[lang][0][0]) > HELD:
                        yield out(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield out(lang, grams, counts)

    partial = labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, length: int = LENGTH) -> DataFrame:
    """``lang, gram, rank`` of each language's most frequent n-grams."""
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = gram_counts(labelled).withColumn("rank", F.row_number().over(order) - 1)
    return ranked.where(F.col("rank") < length).drop("n")


class LanguageModel:
    """Profiles in the workers: ``predict`` turns a text column into struct<lang_pred, score, letters>."""

    def __init__(self, found: DataFrame, length: int = LENGTH):
        import numpy as np

        spark = found.sparkSession
        names = sorted(r[0] for r in found.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
        if len(names) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        rows = found.collect()  # at most MOST_LANGUAGES * length short rows
        every = np.array(sorted({r["gram"] for r in rows}), np.int64)
        place = {n: k for k, n in enumerate(names)}
        ranks = np.full((len(names), len(every)), -1, np.int32)
        for r in rows:
            ranks[place[r["lang"]], np.searchsorted(every, r["gram"])] = r["rank"]
        shared = spark.sparkContext.broadcast((names, every, ranks))

        @F.arrow_udf("struct<lang_pred: string, score: double, letters: boolean>")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            names, every, ranks = shared.value
            letter, own = tables(), np.arange(length)
            for texts in batches:
                langs, scores, letters = [], [], []
                for text in texts.to_pylist():
                    best = top(*text_grams(text, letter), length)
                    letters.append(len(best) > 0)
                    if not len(best) or not names:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    at = np.minimum(np.searchsorted(every, best), len(every) - 1)
                    there = ranks[:, at]
                    lacking = (every[at] != best)[None, :] | (there < 0)
                    far = np.where(lacking, length, np.abs(there - own[None, : len(best)])).sum(axis=1)
                    k = int(far.argmin())
                    langs.append(names[k])
                    scores.append(1.0 - float(far[k]) / (length * len(best)))
                yield pa.StructArray.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())],
                    ["lang_pred", "score", "letters"],
                )

        self._predict = predict

    def predict(self, text: str | Column) -> Column:
        return self._predict(text_or_empty(text))


def fold(id_col: str | Column, parts: int) -> Column:
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def learned(docs: DataFrame, length: int = LENGTH) -> LanguageModel:
    """Profiles from the texts outside the held-out fold that have a language."""
    train = small_batches(docs).where(F.col("lang").isNotNull() & (fold("doc_id", 4) != 2) & F.col("text").isNotNull())
    return LanguageModel(written_once(profiles(train.select("lang", "text"), length), "language-profiles"), length)


def languages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    seen = docs.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), learned(docs, length).predict("text").alias("found")
    )
    return seen.select("doc_id", "held_out", "found.lang_pred", "found.score")


def drop_unknown(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows whose text has a letter, with all their columns; also where there was nothing to learn a language from."""
    found = learned(docs, length).predict("text")
    return wrapped(docs, found=found).where("found.letters").select("row.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
