"""SentencePiece encoding and decoding by a table of last tokens.

Merging pairs best score first has a local test: a sequence of tokens is the encoding of its text exactly if every
token is the encoding of itself and every two neighbours are the encoding of their concatenation. So each prefix of a
text has one last token: the only token that ends there and is compatible with the last token of what lies before it.
The tokens that end at a place come from an automaton over the vocabulary; compatibility replays the merges of both
tokens along the border, in order of their scores, and asks whether one across the border would have come first. The
table is filled from left to right in linear time and the ids are read off backwards.

A word's mark stands at its beginning only (checked when the model is loaded), so texts are cut before marks, and words
before a last character that no piece holds behind the one before it; a task remembers the ids of the words it has
seen. Normalising and decoding are the library's own.

The driver reads the model once and broadcasts its bytes with the merges of its tokens (bounded by
``MOST_MODEL_BYTES``). Models that are not of the merging kind, lack byte fallback or hold pieces defined by users or
marked unused are refused.

Defined results: null and empty texts have no ids but the end id, if asked for; characters outside the vocabulary
become their bytes' ids; repeated rows are encoded each; an empty table gives an empty result. Texts without a space
are one word of any length.
"""

from __future__ import annotations

import gc
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, small_batches, text_or_empty

MODEL = "piece_bpe_32k.model"
MOST_MODEL_BYTES = 64 << 20
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: The same where no piece holds a line feed.
LINE_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
#: Words a task remembers, and the longest of them; it starts anew beyond that. Pairs of tokens likewise.
REMEMBERED, LONG_WORD, PAIRS = 600_000, 64, 1_000_000
NEVER = float("inf")


def merges(word: str, ranks: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """The symbols that pairwise merging leaves of a word, and for each merge its rank and the first and last symbol
    behind it. The best rank goes first, then the leftmost."""
    symbols, events = list(word), []
    while len(symbols) > 1:
        found = [ranks.get(a + b, NEVER) for a, b in itertools.pairwise(symbols)]
        best = min(found)
        if best == NEVER:
            break
        k = found.index(best)
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        events.append((best, symbols[0], symbols[-1]))
    return symbols, events


def border_events(ranks: dict[str, float]) -> dict[str, tuple[list, list]]:
    """For each token that is the encoding of itself: its merges as (rank, first symbol) and as (rank, last symbol)."""
    out = {}
    for token in ranks:
        symbols, events = merges(token, ranks)
        if len(symbols) == 1:
            out[token] = [(r, a) for r, a, _ in events], [(r, b) for r, _, b in events]
    return out


class PrefixTable:
    """Encodes words: strings in which every token may stand anywhere."""

    def __init__(self, ranks: dict[str, float], events: dict[str, tuple[list, list]]):
        import ahocorasick

        self.ranks, self.events = ranks, events
        self.after: dict[str, dict[str, bool]] = {}
        self.tested = 0
        self.automaton = ahocorasick.Automaton()
        for token in events:
            self.automaton.add_word(token, (token, len(token)))
        self.automaton.make_automaton()

    def compatible(self, left: str, right: str) -> bool:
        """Whether the encoding of both together is the two of them."""
        ahead = self.events[left][1] if left in self.events else []
        behind = self.events[right][0] if right in self.events else []
        a, b, i, j = left[-1], right[0], 0, 0
        while True:
            across = self.ranks.get(a + b, NEVER)
            one = ahead[i][0] if i < len(ahead) else NEVER
            two = behind[j][0] if j < len(behind) else NEVER
            if across < one and across <= two:
                return False
            if one == two == NEVER:
                return True
            if one <= two:
                a, i = ahead[i][1], i + 1
            else:
                b, j = behind[j][1], j + 1

    def tested_pair(self, left: str, right: str) -> bool:
        if self.tested >= PAIRS:
            self.after.clear()
            self.tested = 0
        self.tested += 1
        known = self.after.setdefault(left, {})[right] = self.compatible(left, right)
        return known

    def tokens(self, word: str) -> list[str]:
        """The tokens of a word; a character outside the vocabulary is a token of its own."""
        last: list[str] = [""] * (len(word) + 1)
        after, nothing = self.after, {}
        for at, (token, size) in self.automaton.iter(word):
            if last[at + 1]:
                continue
            before = at + 1 - size
            if before:
                # a place without a token lies behind a character that no token ends with
                left = last[before] or word[before - 1]
                fits = after.get(left, nothing).get(token)
                if fits is None:
                    fits = self.tested_pair(left, token)
                if not fits:
                    continue
            last[at + 1] = token
        out, at = [], len(word)
        while at:
            token = last[at] or word[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]


class Pieces:
    """Columns of ids and of decoded text for one model."""

    def __init__(self, spark: SparkSession, model_path: str | None = None, end_id: bool = True):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(model_path or public_tokenizers.path(MODEL), "rb") as file:
            content = file.read(MOST_MODEL_BYTES + 1)
        if len(content) > MOST_MODEL_BYTES:
            raise ValueError(f"the model file is larger than {MOST_MODEL_BYTES} bytes")
        model = proto.ModelProto.FromString(content)
        kinds = proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("the model does not merge pairs with byte fallback")
        if {p.type for p in model.pieces} & {kinds.USER_DEFINED, kinds.UNUSED}:
            raise ValueError("the model has pieces defined by users or marked unused")
        ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("the model has pieces with a mark behind other characters")
        ranks = {p: -model.pieces[k].score for p, k in ids.items()}
        octets = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        end = [SentencePieceProcessor(model_proto=content).eos_id()] if end_id else []
        beside = {a + b for p in ids for a, b in itertools.pairwise(p)}
        words = WORD if any("\n" in p for p in ids) else LINE_WORD
        shared = spark.sparkContext.broadcast((content, ranks, border_events(ranks), ids, octets))

        class Coder:
            def __init__(self):
                gc.disable()  # words and their ids are many small objects without cycles
                content, ranks, events, self.ids, self.octets = shared.value
                self.library = SentencePieceProcessor(model_proto=content)
                self.table, self.seen = PrefixTable(ranks, events), {}
                self.end = packed(end)

            def word(self, word: str) -> bytes:
                if len(word) > 1 and word[-2:] not in beside:
                    out = b"".join([self.seen.get(w) or self.tokens(w) for w in (word[:-1], word[-1])])
                else:
                    out = self.tokens(word)
                if len(word) <= LONG_WORD:
                    if len(self.seen) >= REMEMBERED:
                        self.seen.clear()
                    self.seen[word] = out
                return out

            def tokens(self, word: str) -> bytes:
                out = []
                for token in self.table.tokens(word):
                    own = self.ids.get(token)
                    out += [own] if own is not None else [self.octets[b] for b in token.encode()]
                return packed(out)

            def __call__(self, text: str):
                import numpy as np

                seen, own = self.seen, self.word
                parts = [seen.get(w) or own(w) for w in words.findall(self.library.normalize(text))]
                return np.frombuffer(b"".join(parts) + self.end, "<i4")

        def packed(ids: list[int]) -> bytes:
            return b"".join(k.to_bytes(4, "little") for k in ids)

        def lists(rows: list) -> pa.Array:
            import numpy as np

            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))

        @F.arrow_udf("struct<ids: array<int>, decoded: string>")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = Coder()
            for texts in batches:
                coded = [own(t) for t in texts.to_pylist()]
                back = [own.library.decode(c.tolist()) for c in coded]
                yield pa.StructArray.from_arrays([lists(coded), pa.array(back, pa.string())], ["ids", "decoded"])

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = Coder()
            for texts in batches:
                yield lists([own(t) for t in texts.to_pylist()])

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            library = SentencePieceProcessor(model_proto=shared.value[0])
            for rows in batches:
                yield pa.array([library.decode(r) for r in rows.to_pylist()], pa.string())

        self._both, self._ids, self._text = both, encode, decode

    def ids(self, text: str | Column) -> Column:
        return self._ids(text_or_empty(text))

    def text(self, ids: str | Column) -> Column:
        """The library's decoding; null ids give no text."""
        return self._text(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<int>")))

    def both(self, text: str | Column) -> Column:
        """``ids`` and the text they decode to, from one worker."""
        return self._both(text_or_empty(text))


def encoded(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""
    coded = small_batches(docs).select(F.col(id_col).alias("doc_id"), pieces.both(text_col).alias("both"))
    return coded.select("doc_id", "both.*")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), Pieces(spark)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_pieces": op12_pieces}
