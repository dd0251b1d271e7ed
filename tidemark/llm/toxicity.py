"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train linear numpy classifiers. The risk is estimated as for labelled data,
with the class prior in place of the missing negatives: prior * R(P, toxic) + max(0, R(U, clean) - prior * R(P, clean)).
Where the last bracket turns negative the classifier has begun to memorise, and the step is taken back up instead.

- Features are words and their first four to six letters, hashed to ``1 << BITS`` and counted once a text. Their scale
  is the logarithm of their share among toxic over unlabelled texts, as far as the counts are sure; weights stay non-negative, so a text gathers
  evidence and its length speaks neither for nor against it.
- The fit uses samples of at most ``MOST_TOXIC`` and ``MOST_UNLABELLED`` texts of the learning fold, drawn by hash.
  The ids of the toxic sample are the one thing broadcast with a join, under that limit. Each of ``MODELS``
  classifiers is fitted by one task on two thirds of the samples, and their mean is the score.
- The class prior is the share of toxic among the labels of the learning fold, or ``PRIOR`` where no label says clean.
- Every whole text is scored; a task remembers the weighted features of at most ``REMEMBERED`` words.

Defined results: empty and null texts get the score of a text without evidence; without any toxic example every score
is 0; null ids count as the empty string for the fold and match no label; a document with several labels is toxic if
one says so; labels that are null count for nothing; repeated rows get a row each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.llm.common import read, small_batches, text_or_empty, written_once
from tidemark.llm.language_id import fold

BITS = 18
PREFIXES = (4, 5, 6)
MOST_TOXIC = 6_000
MOST_UNLABELLED = 12_000
MODELS = 3
PRIOR = 0.1
REMEMBERED = 500_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    low = text.lower()
    if len(low) > 1 << 20:  # as a set at once: the list of a very long text would be large
        return {m.group() for m in WORD.finditer(low)}
    return set(WORD.findall(low))


def word_features(word: str) -> list[int]:
    names = {word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)}
    return [zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names]


def fit(features: list, toxic, prior: float, seed: int, epochs: int = 8, batch: int = 256, steps: int = 600):
    """Bias and weights (with the scale in them) of one classifier; ``features`` are arrays of feature numbers."""
    import numpy as np

    size, rng, n = 1 << BITS, np.random.default_rng(seed), len(features)
    n_p, n_u = max(1, (toxic == 1).sum()), max(1, (toxic == 0).sum())
    counts = [
        np.bincount(np.concatenate([features[i] for i in np.flatnonzero(toxic == t)] or [[]]).astype(np.int64), minlength=size)
        for t in (1, 0)
    ]
    # the toxic share as surely as two deviations tell; unlabelled texts hold prior times that share at least
    sure = np.maximum(counts[0] - 2 * np.sqrt(counts[0]), 0) / n_p
    share = np.maximum((counts[1] + 1) / n_u, prior * counts[0] / n_p)
    scale = np.maximum(np.log(np.maximum(sure, 1e-12) / share), 0)
    w, b, rate, shrink, step = np.zeros(size), 0.0, 0.005, 0.02, 0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    while step < max(steps, epochs * -(-n // batch)):
        order = rng.permutation(n)
        for begin in range(0, n, batch):
            ids = order[begin : begin + batch]
            own = [features[i] for i in ids]
            at, row = np.concatenate(own).astype(np.int64), np.repeat(np.arange(len(ids)), [len(x) for x in own])
            x = scale[at]
            score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at] * x, minlength=len(ids)) + b, -30, 30)))
            p = toxic[ids] == 1
            slope, n_p, n_u = score * (1 - score), max(1, p.sum()), max(1, (~p).sum())
            memorised = score[~p].sum() / n_u < prior * score[p].sum() / n_p
            pull = np.where(p, (prior if memorised else -2 * prior) / n_p, (-1 if memorised else 1) / n_u) * slope
            grad = np.bincount(at, weights=pull[row] * x, minlength=size)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * pull.sum(), 0.999 * vb + 0.001 * pull.sum() ** 2
            up, down = 1 - 0.9**step, 1 - 0.999**step
            w = np.maximum(w - rate * (m / up) / (np.sqrt(v / down) + 1e-8) - rate * shrink, 0)
            b -= rate * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return b, (w * scale).astype(np.float32)


@F.arrow_udf(BinaryType())
def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Feature numbers of each text as 32-bit integers."""
    import numpy as np

    for texts in batches:
        found = ({f for w in words_of(t) for f in word_features(w)} for t in texts.to_pylist())
        yield pa.array([np.array(sorted(f), np.int32).tobytes() for f in found], pa.binary())


def _share(rows: DataFrame, most: int, total: int, *of: Column) -> DataFrame:
    """About ``most`` of ``total`` rows, never more, by a hash of ``of``: the same rows in every run."""
    drawn = F.xxhash64(F.lit("sample"), *of)
    if total > most:
        rows = rows.where(F.pmod(drawn, F.lit(1 << 30)) < int((1 << 30) * most / total))
    return rows.orderBy(drawn, *of).limit(most)


def samples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``toxic, features`` of both samples, and the class prior."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = own.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    learn = small_batches(docs).select("doc_id", "text").where(fold("doc_id", 5) != 0)
    ids = _share(own.where("toxic = 1").select("doc_id"), MOST_TOXIC, n_toxic, F.col("doc_id"))
    confirmed = learn.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64(F.lit("sample"), "doc_id", "text"), "doc_id").limit(MOST_TOXIC)
    unlabelled = _share(learn, MOST_UNLABELLED, learn.count(), F.col("doc_id"), F.xxhash64("text"))
    both = confirmed.select(F.lit(1).alias("toxic"), "text").unionByName(unlabelled.select(F.lit(0).alias("toxic"), "text"))
    rows = both.select("toxic", features(text_or_empty("text")).alias("features"))
    return written_once(rows, "toxicity-samples"), n_toxic / n if n_toxic < n else PRIOR


class ToxicityModel:
    """Fitted classifiers; ``score`` turns a text column into scores."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        import numpy as np

        rows, prior = samples(docs, labels)

        def train(key, group):
            import pandas as pd

            texts = [np.frombuffer(f, np.int32) for f in group["features"]]
            toxic = group["toxic"].to_numpy()
            order = np.lexsort((group["features"].to_numpy(), toxic))  # rows arrive in any order
            bias, weights = fit([texts[i] for i in order], toxic[order], prior, int(key[0]))
            return pd.DataFrame({"model": [key[0]], "bias": [bias], "weights": [weights.tobytes()]})

        part = F.pmod(F.xxhash64("features"), F.lit(MODELS)).cast("int")
        of = F.filter(F.array(*map(F.lit, range(MODELS))), lambda k: k != part)
        spread = rows.select("toxic", "features", F.explode(of).alias("model"))
        fitted = spread.groupBy("model").applyInPandas(train, "model int, bias double, weights binary")
        found = fitted.orderBy("model").collect() if rows.where("toxic = 1").limit(1).collect() else []
        weights = [np.frombuffer(r["weights"], np.float32) for r in found]
        shared = docs.sparkSession.sparkContext.broadcast(([r["bias"] for r in found], weights))

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            biases, weights = shared.value
            table = np.stack(weights).astype(np.float64) if weights else np.zeros((0, 1 << BITS))
            heavy, known = table.any(axis=0), {}
            for texts in batches:
                out = []
                for text in texts.to_pylist():
                    if len(known) > REMEMBERED:
                        known.clear()
                    found = set()
                    for word in words_of(text):
                        own = known.get(word)
                        if own is None:
                            own = known[word] = tuple(f for f in word_features(word) if heavy[f])
                        if own:
                            found.update(own)
                    sums = table[:, sorted(found)].sum(axis=1) + biases
                    out.append(float((1 / (1 + np.exp(-np.clip(sums, -30, 30)))).mean()) if biases else 0.0)
                yield pa.array(out, pa.float64())

        self._score = score

    def score(self, text: str | Column) -> Column:
        return self._score(text_or_empty(text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = ToxicityModel(docs, labels)
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), model.score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
