"""Token counts through a digest cache: only texts whose digest has no stored count are encoded, each once.

The cache is a folder of Parquet rows (text digest, tokenizer digest, tokens). The tokenizer digest is taken from
the tokenizer's file, so another version finds nothing of the first. Texts go through one shuffle by digest, after
equal texts of a task were combined; the anti-join and the choice of one text per digest share it. Counts come back
to the rows by a join on the digest, where rows are small and adaptive execution splits a hot digest.

Normalised content is the text as the tokenizer sees it: null becomes empty; a file with a normaliser has it applied
before the digest is taken.

Defined results: null and empty texts have 0 tokens; repeated rows share one count; an empty table appends nothing.
Appending twice after a lost driver stores a count twice; readers take one of the equal rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, shared_dir, small_batches, text_or_empty, written_once

TOKENIZER = "byte_bpe_50k.json"
MOST_TOKENIZER_BYTES = 256 << 20
LIMIT = 1024
#: White space that is neither a single space nor a single line feed between two other characters.
ODD = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]\Z")
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Words whose counts a task remembers; it starts anew beyond that.
REMEMBERED = 600_000


class WordCounts:
    """Counts tokens of texts as the library does, encoding each word once.

    The byte-level pattern always splits before a single space between two non-space characters and on both sides
    of a single line feed between two such characters, also when a special token stands beside them. A text is cut
    there, words are looked up, and the library encodes the words not seen before. A text with any other white
    space, or with several such characters on end, is cut at the single spaces only.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        (self.feed,) = self.encode(["\n"])

    def encode(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    @staticmethod
    def parts(text: str) -> tuple[list[str], list[str], int]:
        """Strings counted as they are, words counted with a space before them, and lone line feeds."""
        if ODD.search(text):
            return [text[a:b] for a, b in itertools.pairwise([0, *(m.start() for m in SAFE.finditer(text)), len(text)])], [], 0
        heads, tails, lines = [], [], text.split("\n")
        for line in lines:
            first, *rest = line.split(" ")
            heads.append(first)
            tails += rest
        return heads, tails, len(lines) - 1

    def count(self, texts: list[str]) -> list[int]:
        if len(self.heads) + len(self.tails) > REMEMBERED:
            self.heads.clear()
            self.tails.clear()
        split = [self.parts(t) for t in texts]
        for known, k, lead in ((self.heads, 0, ""), (self.tails, 1, " ")):
            new = list(set().union(*(x[k] for x in split)) - known.keys())
            for begin in range(0, len(new), 4096):
                some = new[begin : begin + 4096]
                known.update(zip(some, self.encode([lead + w for w in some]), strict=True))
        head, tail = self.heads.__getitem__, self.tails.__getitem__
        return [sum(map(head, h)) + sum(map(tail, t)) + n * self.feed for h, t, n in split]


class TokenCache:
    """Counts of one tokenizer version below ``path``, which outlives sessions."""

    def __init__(self, spark: SparkSession, path: str | None = None, tokenizer_path: str | None = None):
        import public_tokenizers

        with open(tokenizer_path or public_tokenizers.path(TOKENIZER), "rb") as file:
            content = file.read(MOST_TOKENIZER_BYTES + 1)
        if len(content) > MOST_TOKENIZER_BYTES:
            raise ValueError(f"the tokenizer file is larger than {MOST_TOKENIZER_BYTES} bytes")
        self.spark, self.path = spark, path or shared_dir(spark, "token-cache")
        self.version = hashlib.sha256(content).hexdigest()
        shared = spark.sparkContext.broadcast(content.decode())
        from tokenizers import Tokenizer

        self.normalises = Tokenizer.from_str(content.decode()).normalizer is not None

        @F.arrow_udf("string")
        def normal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = WordCounts(shared.value).tokenizer.normalizer
            for texts in batches:
                yield pa.array([own.normalize_str(t) for t in texts.to_pylist()], pa.string())

        @F.arrow_udf("bigint")
        def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = WordCounts(shared.value)
            for texts in batches:
                some, counts = texts.to_pylist(), []
                for begin in range(0, len(some), 256):
                    counts += own.count(some[begin : begin + 256])
                yield pa.array(counts, pa.int64())

        self._normal, self._tokens = normal, tokens
        spark.createDataFrame([], "digest string, version string, n_tokens bigint").write.mode("append").parquet(self.path)

    def digest(self, text: F.Column) -> F.Column:
        return F.sha2(self._normal(text) if self.normalises else text, 256)

    def stored(self) -> DataFrame:
        schema = "digest string, version string, n_tokens bigint"
        rows = self.spark.read.schema(schema).parquet(self.path).where(F.col("version") == self.version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def misses(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``digest, text``: one text for each digest without a stored count.

        The anti-join asks for an aggregate, so it stays behind the grouping: below it every copy of a text would be
        shuffled, and a text of many copies would arrive whole in one task.
        """
        text = text_or_empty(text_col)
        seen = small_batches(docs).select(self.digest(text).alias("digest"), text.alias("text"))
        one = seen.groupBy("digest").agg(F.first("text").alias("text"), F.max("digest").alias("key"))
        known = self.stored().select("digest").hint("merge")
        return one.join(known, one["key"] == known["digest"], "left_anti").select("digest", "text")

    def fill(self, docs: DataFrame, text_col: str = "text") -> None:
        new = self.misses(docs, text_col).select("digest", F.lit(self.version).alias("version"), self._tokens("text").alias("n_tokens"))
        new.write.mode("append").parquet(self.path)


def token_counts(
    docs: DataFrame, cache: TokenCache | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; fills the cache first."""
    cache = cache or TokenCache(docs.sparkSession)
    cache.fill(docs, text_col)
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), cache.digest(text).alias("digest")
    )
    known = written_once(cache.stored().join(rows.select("digest").distinct(), "digest"), "token-known")
    return rows.join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
