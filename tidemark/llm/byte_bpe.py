"""Byte-level BPE encoding and decoding with a local rank file.

The driver reads the rank file once and broadcasts its bytes (checked against ``MOST_RANK_BYTES``); a task builds
one encoder from them and streams Arrow batches through it. Texts longer than ``LONG`` characters are cut before a
single space between two non-space characters. There the pattern always ends one match and starts the next, so the
pieces give the ids of the whole text while the pattern never runs over more than a piece. A text without such a
place stays whole, but white space of more than ``LONG`` characters on end is encoded apart, as the matches the pattern
makes of it: all of it at the end of a text, else all but the last character. Ids travel as little-endian unsigned 32-bit integers.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows are encoded each; an empty
table gives an empty result. Decoding returns raw bytes, which need not be valid text when ids were cut.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches, text_or_empty

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG = 1 << 16
MOST_RANK_BYTES = 64 << 20
#: Python's white space includes all that the pattern's does, so this finds no unsafe place.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space on end, of the pattern's kind, which lacks four control characters of Python's.
SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    begin = 0
    while len(text) - begin > long:
        place = SAFE.search(text, begin + long)
        if place is None:
            break
        yield text[begin : place.start()]
        begin = place.start()
    yield text[begin:]


def matches(text: str, long: int = LONG) -> Iterator[tuple[str, bool]]:
    """Parts of the text in order, and whether a part is one match of the pattern: the pattern itself would go back
    through white space without end one character at a time."""
    begin = 0
    for run in SPACES.finditer(text) if len(text) > long else ():
        last = run.end() if run.end() == len(text) else run.end() - 1
        if last - run.start() > long:
            if run.start() > begin:
                yield from ((p, False) for p in pieces(text[begin : run.start()], long))
            yield text[run.start() : last], True
            begin = last
    if begin < len(text) or not text:
        yield from ((p, False) for p in pieces(text[begin:], long))


class ByteBpe:
    """``ids`` and ``raw`` turn columns of text into ids and columns of ids into bytes."""

    def __init__(self, spark: SparkSession, ranks_path: str | None = None, pattern: str | None = None, long: int = LONG):
        import public_tokenizers

        with open(ranks_path or public_tokenizers.path(RANKS), "rb") as file:
            content = file.read(MOST_RANK_BYTES + 1)
        if len(content) > MOST_RANK_BYTES:
            raise ValueError(f"the rank file is larger than {MOST_RANK_BYTES} bytes")
        shared = spark.sparkContext.broadcast((content, pattern or public_tokenizers.PATTERN))

        def encoder():
            import tiktoken

            lines, pattern = shared.value
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines.splitlines() if line)}
            return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(own, text: str) -> bytes:
            import numpy as np

            found = (
                np.array(own._encode_single_piece(p)) if one else own.encode_to_numpy(p, disallowed_special=())
                for p, one in matches(text, long)
            )
            return b"".join(p.astype("<u4").tobytes() for p in found)

        def decode(own, ids: bytes) -> bytes:
            import numpy as np

            return own.decode_bytes(np.frombuffer(ids, "<u4").tolist())

        @F.arrow_udf("binary")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = encoder()
            for texts in batches:
                yield pa.array([encode(own, t) for t in texts.to_pylist()], pa.binary())

        @F.arrow_udf("binary")
        def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = encoder()
            for rows in batches:
                yield pa.array([decode(own, r) for r in rows.to_pylist()], pa.binary())

        @F.arrow_udf("struct<ids: binary, decoded: binary>")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = encoder()
            for texts in batches:
                coded = [encode(own, t) for t in texts.to_pylist()]
                back = pa.array([decode(own, c) for c in coded], pa.binary())
                yield pa.StructArray.from_arrays([pa.array(coded, pa.binary()), back], ["ids", "decoded"])

        self._ids, self._raw, self._both = ids, raw, both

    def ids(self, text: str | Column) -> Column:
        return self._ids(text_or_empty(text))

    def both(self, text: str | Column) -> Column:
        """``ids`` and the bytes they decode to, from one worker with one encoder."""
        return self._both(text_or_empty(text))

    def raw(self, ids: str | Column) -> Column:
        return self._raw(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.lit(b"")))


def encoded(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``."""
    coded = small_batches(docs).select(F.col(id_col).alias("doc_id"), bpe.both(text_col).alias("both")).select("doc_id", "both.*")
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", "decoded")


def token_digests(docs: DataFrame, bpe: ByteBpe | None = None) -> DataFrame:
    coded = encoded(docs, bpe or ByteBpe(docs.sparkSession))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
