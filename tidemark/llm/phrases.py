"""Phrase collocation mining with Rabin-Karp fingerprints.

1. Texts are cut into words once and written as blocks of one language, in buckets: the block's words and, per place,
   the number of its word (0 between pieces). Words are told apart by prefix polynomials over the bytes and then by the
   bytes.
2. Prefix polynomials over the words of a block give the fingerprint of every phrase by one subtraction. A block sends
   each of its words and pairs of words once: fingerprint, occurrences and a pointer (block and place) to one of them,
   packed into one row per bucket of fingerprints. Buckets hold about ``BUCKET`` places of the corpus each; there the
   occurrences are added up, and fingerprints below the least count are gone.
3. Phrases of one word more are only looked at where both their parts have frequent fingerprints, which are sent back
   to the blocks that have them. A fingerprint that two phrases share only counts too much, so nothing frequent is lost.
4. Pointers also carry a check, a digest of the words themselves. Where all checks of a frequent fingerprint agree, it is
   read at one pointer; only here phrases become text. Where they differ, phrases collided: every pointer of that
   fingerprint is read, and the counts of equal texts are added up.

Within a block occurrences of one fingerprint are compared word by word, so a pointer stands for equal words only.

Defined results: a null text has no words, a null language counts as ``und``; ids are not read, so null and repeated
ids matter not and a repeated row counts again; an empty table gives an empty result. Words hold any character but the
blanks and breaks. A piece without a break is held in memory whole; longer texts are cut at breaks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import read, shared_dir, small_batches, text_or_empty, written_once

LONGEST, LEAST, TOP, COVERS = 5, 100, 2000, 100
#: Bytes of text in a block.
BLOCK = 6 << 20
#: Places of the corpus for each bucket of fingerprints.
BUCKET = 1 << 20
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a place in a block, and bits of a fingerprint that hold the number of words.
PLACE_BITS, SIZE_BITS = 31, 3
#: Odd factors of the polynomials over bytes and over words.
BYTE_FACTOR, WORD_FACTOR = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _mixed(x):
    """A 64-bit finaliser (xor of shifts and odd factors)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hashes(values, factor: int, begins, ends):
    """Polynomials of ``values[begin:end]``, modulo 2 to the 64th, from one array of prefix sums."""
    import numpy as np

    power = np.full(len(values), factor, np.uint64)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power, out=prefix[1:])
    back = np.full(len(values), pow(factor, -1, 1 << 64), np.uint64)
    back[:1] = 1
    return (prefix[ends] - prefix[begins]) * np.multiply.accumulate(back)[begins]


def word_hashes(raw, begins, ends):
    import numpy as np

    table = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_FACTOR))
    return _mixed(prefix_hashes(table[raw], BYTE_FACTOR, begins, ends))


def _same_bytes(raw, a, b, sizes) -> bool:
    """Whether the strings of ``sizes`` at ``a`` and at ``b`` are equal, eight bytes at a time."""
    import numpy as np

    eight = np.lib.stride_tricks.as_strided(np.append(raw, np.zeros(8, np.uint8)).view(), (len(raw) + 1, 8), (1, 1))
    while len(a):
        x, y = (np.ascontiguousarray(eight[k]).view(np.uint64)[:, 0] for k in (a, b))
        left = np.minimum(sizes, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        if ((x ^ y) & mask).any():
            return False
        more = sizes > 8
        a, b, sizes = a[more] + 8, b[more] + 8, sizes[more] - 8
    return True


def numbered(text: bytes) -> tuple[list[bytes], object, object]:
    """Distinct words, their counts, and the numbers (from 1) of the words in order with a 0 between pieces."""
    import numpy as np

    raw = np.frombuffer(text, np.uint8)
    apart = np.ones(len(raw) + 2, bool)
    apart[1:-1] = (raw == 32) | (raw == 10)
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    _, first, number, counts = np.unique(word_hashes(raw, begins, ends), return_index=True, return_inverse=True, return_counts=True)
    sizes = ends - begins
    if (sizes != sizes[first][number]).any() or not _same_bytes(raw, begins, begins[first][number], sizes):
        words, first, number, counts = np.unique(  # two words of one hash: by the bytes themselves
            np.array([text[a:b] for a, b in zip(begins.tolist(), ends.tolist())], object),
            return_index=True, return_inverse=True, return_counts=True,
        )
    rank = np.argsort(-counts, kind="stable")
    place = np.empty(len(rank), np.int32)
    place[rank] = np.arange(1, len(rank) + 1)
    piece = np.cumsum(raw == 10, dtype=np.int32)[begins]
    new = np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1])))
    out = np.zeros(len(number) + int(new[-1]), np.int32)
    out[np.arange(len(number)) + new] = place[number]
    return [text[begins[k] : ends[k]] for k in first[rank].tolist()], counts[rank], out


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, words, counts, places, size`` from rows ``lang, text``."""
    import numpy as np

    lower = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(BREAKS) + b" ")
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def done(lang):
        words, counts, places = numbered(b"\n".join(held.pop(lang)))
        del sizes[lang]
        planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        row = {"lang": lang, "words": pa.compress(b"\n".join(words), "zstd", asbytes=True), "word_bytes": sum(map(len, words)) + max(0, len(words) - 1),
               "counts": counts.astype("<i8").tobytes(), "places": pa.compress(planes, "zstd", asbytes=True), "n_places": len(places)}
        return pa.RecordBatch.from_pylist([row], pa.schema([("lang", pa.string()), ("words", pa.binary()), ("word_bytes", pa.int64()),
                                                            ("counts", pa.binary()), ("places", pa.binary()), ("n_places", pa.int64())]))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw, begin = text.encode().translate(lower), 0
            while begin < len(raw):
                end = len(raw)
                if end - begin > block:
                    cut = raw.rfind(b"\n", begin, begin + block)
                    end = (cut if cut > begin else raw.find(b"\n", begin + block)) + 1 or end
                held.setdefault(lang, []).append(raw[begin:end])
                sizes[lang] = sizes.get(lang, 0) + end - begin
                begin = end
                if sizes[lang] >= block:
                    yield done(lang)
            if sum(sizes.values()) > 4 * block:
                yield done(max(sizes, key=sizes.get))
    for lang in list(held):
        yield done(lang)


class Block:
    """A block row in a task: its words, places and the fingerprints of its phrases."""

    def __init__(self, lang: str, words: bytes, word_bytes: int, places: bytes, n_places: int, bits: int):
        import numpy as np
        import xxhash

        if n_places >> PLACE_BITS:
            raise ValueError("a piece of text is too long for a pointer")
        self.raw = pa.decompress(words, word_bytes, "zstd", asbytes=True)
        planes = np.frombuffer(pa.decompress(places, 4 * n_places, "zstd", asbytes=True), np.uint8).reshape(4, -1)
        self.places = np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64)
        self.lang, self.bits = xxhash.xxh3_64_intdigest(lang.encode()), bits
        cuts = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10)
        begins, ends = np.append(0, cuts + 1), np.append(cuts, len(self.raw))
        self.hashes = np.concatenate(([0], word_hashes(np.frombuffer(self.raw, np.uint8), begins, ends))).astype(np.uint64)
        self.digests = np.array([0, *map(xxhash.xxh3_64_intdigest, self.raw.split(b"\n"))], np.uint64)

    def finished(self, x, n: int):
        """Fingerprints, of which the lowest bits tell the number of words; another language has others."""
        import numpy as np

        with np.errstate(over="ignore"):
            x = _mixed(x + np.uint64(self.lang) * np.uint64(2 * n + 1))
        return ((x >> np.uint64(64 - self.bits)) << np.uint64(SIZE_BITS) | np.uint64(n)).view(np.int64)

    def fingerprints(self, at, n: int):
        return self.finished(prefix_hashes(self.hashes[self.places], WORD_FACTOR, at, at + n), n)

    def checks(self, numbers):
        """32 bits of a digest of the language and the words, given by their numbers: one list per word of the phrases."""
        import numpy as np

        out = np.full(len(numbers[0]), self.lang, np.uint64)
        for w in numbers:
            out = _mixed(out + self.digests[w])
        return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def phrases(self, at, n: int):
        """``fingerprint, place, count, check`` of the distinct phrases of ``n`` words at ``at``."""
        import numpy as np

        if not len(at):
            return at, at, at, at.astype(np.int32)
        prints = self.fingerprints(at, n)
        order = np.argsort(prints, kind="stable")
        words = [self.places[at + j] for j in range(n)]
        other = lambda x: x[order][1:] != x[order][:-1]
        new, differ = other(prints), np.logical_or.reduce([other(w) for w in words])
        if (differ & ~new).any():
            order = np.lexsort((*words, prints))
            new = other(prints) | np.logical_or.reduce([other(w) for w in words])
        first = np.append(0, np.flatnonzero(new) + 1)
        counts, first = np.diff(np.append(first, len(at))), order[first]
        return prints[first], at[first], counts, self.checks([w[first] for w in words])


#: What a task needs of a block.
COLUMNS = ["block", "lang", "words", "word_bytes", "places", "n_places"]
#: Phrases of a block whose fingerprints belong to one bucket: a number of each list for each phrase.
PACKED = "bucket int, block long, prints binary, places binary, counts binary, checks binary"
#: What is left of them: fingerprints that are frequent, and the pointers to read with the occurrences they stand for.
FREQUENT = "block long, prints binary, read_print binary, read_place binary, read_count binary"


def _packed(block: int, prints, places, counts, checks, buckets: int) -> pa.RecordBatch:
    import numpy as np

    own = _mixed(prints.view(np.uint64)) % np.uint64(buckets)
    order = np.argsort(own.astype(np.uint16) if buckets < 1 << 16 else own, kind="stable")
    found, first = np.unique(own[order], return_index=True)
    columns = [x.astype(t)[order] for x, t in ((prints, "<i8"), (places, "<i4"), (counts, "<i8"), (checks, "<i4"))]
    packed = [[p.tobytes() for p in np.split(c, first[1:])] if len(found) else [] for c in columns]
    arrays = [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), block)), *[pa.array(p, pa.binary()) for p in packed]]
    return pa.record_batch(arrays, names=["bucket", "block", "prints", "places", "counts", "checks"])


def _summed(table: pa.Table, least: int) -> pa.Table:
    """A bucket's frequent fingerprints, for each block that has them.

    Where all checks of a fingerprint agree, one pointer is to be read for all occurrences, otherwise every pointer for
    its own.
    """
    import numpy as np

    def joined(name: str, kind: str):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    prints, places, counts, checks = joined("prints", "<i8"), joined("places", "<i4"), joined("counts", "<i8"), joined("checks", "<i4")
    sizes = [len(p) // 8 for p in table.column("prints").to_pylist()]
    row = np.repeat(np.argsort(np.argsort(table.column("block").to_numpy())), sizes)  # rows in order of their blocks
    order = np.lexsort((places, row, prints))
    prints, places, counts, checks, row = (x[order] for x in (prints, places, counts, checks, row))
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    length = np.diff(np.append(first, len(prints)))
    total = np.add.reduceat(counts, first)
    agree = np.minimum.reduceat(checks, first) == np.maximum.reduceat(checks, first)
    lead = np.zeros(len(prints), bool)
    lead[first] = True
    agree, total = np.repeat(agree, length), np.repeat(total, length)
    stay = total >= least
    read = stay & (lead | ~agree)
    counts = np.where(agree, total, counts)
    back = np.argsort(row, kind="stable")
    blocks, out = np.sort(table.column("block").to_numpy()), {n: [] for n in ("block", "prints", "read_print", "read_place", "read_count")}
    edges = np.searchsorted(row[back], np.arange(len(blocks) + 1))
    for k, block in enumerate(blocks.tolist()):
        at = back[edges[k] : edges[k + 1]]
        own, asked = at[stay[at]], at[read[at]]
        if len(own):
            out["block"].append(block)
            out["prints"].append(prints[own].tobytes())
            for name, x in (("read_print", prints), ("read_place", places), ("read_count", counts)):
                out[name].append(x[asked].tobytes())
    types = [pa.int64(), *[pa.binary()] * 4]
    return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types)})


def _each(batches: Iterator[pa.RecordBatch], bits: int):
    """A ``Block`` and its further columns for each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            block, lang, words, word_bytes, places, n_places = (c[0].as_py() for c in row.columns[: len(COLUMNS)])
            yield block, lang, Block(lang, words, word_bytes, places, n_places, bits), row.columns[len(COLUMNS) :]


def _short(batches, bits: int, longest: int, buckets: int):
    """Words, whose place is the word's number, and pairs of words."""
    import numpy as np

    for block, _, own, (counts,) in _each(batches, bits):
        n = np.frombuffer(counts[0].as_py(), "<i8")
        numbers = np.arange(1, len(n) + 1)
        yield _packed(block, own.finished(own.hashes[1:], 1), numbers, n, own.checks([numbers]), buckets)
        if longest > 1:
            yield _packed(block, *own.phrases(np.flatnonzero((own.places[:-1] > 0) & (own.places[1:] > 0)), 2), buckets)


def _longer(batches, bits: int, n: int, buckets: int):
    """Phrases of ``n`` words of which both parts of one word less are frequent."""
    import numpy as np

    for block, _, own, (frequent,) in _each(batches, bits):
        gaps = np.cumsum(np.append(0, own.places == 0))
        at = np.flatnonzero(gaps[n - 1 :] == gaps[: len(gaps) - n + 1])
        known = np.zeros(len(own.places), bool)
        frequent = np.frombuffer(b"".join(frequent[0].as_py()), "<i8")
        known[at] = np.isin(own.fingerprints(at, n - 1), frequent[frequent & ((1 << SIZE_BITS) - 1) == n - 1])
        yield _packed(block, *own.phrases(np.flatnonzero(known[:-1] & known[1:]), n), buckets)


def _texts(batches, bits: int):
    """``lang, phrase, count`` of the pointers to read."""
    import numpy as np

    for block, lang, own, (lists,) in _each(batches, bits):
        names, numbers, out, counts = own.raw.split(b"\n"), own.places, [], []
        for part in lists[0].as_py():
            sizes = np.frombuffer(part["read_print"], "<i8") & ((1 << SIZE_BITS) - 1)
            for n, place in zip(sizes.tolist(), np.frombuffer(part["read_place"], "<i4").tolist()):
                out.append(names[place - 1] if n == 1 else b" ".join([names[w - 1] for w in numbers[place : place + n].tolist()]))
            counts.append(np.frombuffer(part["read_count"], "<i8"))
        yield pa.record_batch(
            [pa.array([lang] * len(out)), pa.array([t.decode() for t in out], pa.string()), pa.array(np.concatenate(counts))],
            names=["lang", "phrase", "count"],
        )


def _blocks_table(rows: DataFrame, block: int) -> DataFrame:
    """The blocks, written in buckets by their number: lists for blocks then meet them without moving them again."""
    spark = rows.sparkSession
    schema = "lang string, words binary, word_bytes long, counts binary, places binary, n_places long"
    cut = rows.mapInArrow(lambda b: _blocks(b, block), schema).withColumn("block", F.monotonically_increasing_id())
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"phrase_blocks_{uuid.uuid4().hex}"
    path = shared_dir(spark, "phrase-blocks")
    cut.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    return spark.table(table)


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", block: int = BLOCK, bits: int = 64 - SIZE_BITS
) -> tuple[DataFrame, DataFrame]:
    """``lang, n, phrase, count`` of phrases of 1 to ``longest`` words, and ``lang, words`` with all words counted.

    ``bits`` cuts fingerprints short, which costs time but changes no result.
    """
    if not 1 <= longest < 1 << SIZE_BITS:
        raise ValueError(f"phrases have 1 to {(1 << SIZE_BITS) - 1} words")
    rows = small_batches(docs).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    blocks = _blocks_table(rows, block)
    own = blocks.select(*COLUMNS)
    places = blocks.agg(F.sum("n_places")).first()[0] or 0
    buckets = max(1, -(-places // BUCKET))

    def frequent(packed: DataFrame, n: int) -> DataFrame:
        summed = packed.groupBy("bucket").applyInArrow(lambda table: _summed(table, least), FREQUENT)
        return written_once(summed, f"phrase-{n}")

    def sent_back(rows: DataFrame, column) -> DataFrame:
        lists = rows.groupBy("block").agg(F.collect_list(column).alias("list"))
        return own.join(lists.hint("merge"), "block").select(*COLUMNS, "list")

    short = blocks.select(*COLUMNS, "counts").mapInArrow(lambda b: _short(b, bits, longest, buckets), PACKED)
    found = last = frequent(short, 2)
    for n in range(3, longest + 1):
        longer = sent_back(last, F.col("prints")).mapInArrow(lambda b, n=n: _longer(b, bits, n, buckets), PACKED)
        last = frequent(longer, n)
        found = found.unionByName(last)
    asked = found.where(F.octet_length("read_place") > 0)
    texts = sent_back(asked, F.struct("read_print", "read_place", "read_count")).mapInArrow(
        lambda b: _texts(b, bits), "lang string, phrase string, count long"
    )
    known = texts.groupBy("lang", "phrase").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    known = known.withColumn("n", F.size(F.split("phrase", " ", -1)))

    sizes = blocks.select("lang", "counts").mapInArrow(_totals, "lang string, words long")
    return written_once(known.select("lang", "n", "phrase", "count"), "phrase-known"), sizes.groupBy("lang").agg(F.sum("words").alias("words"))


def _totals(batches):
    import numpy as np

    for batch in batches:
        sizes = [int(np.frombuffer(c, "<i8").sum()) for c in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["lang", "words"])


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covers: int = COVERS,
    lang_col: str = "lang", text_col: str = "text", **how,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases by their weakest cut.

    A phrase goes if a longer frequent one that contains it has at least ``covers`` percent of its occurrences. One
    word more is enough to look at: what lies between the two occurs at least as often as the longer one.
    """
    known, words = frequent_phrases(docs, longest, least, lang_col, text_col, **how)
    part = known.select("lang", "phrase", "count")
    phrases = known.where("n > 1").select("lang", "n", "phrase", F.col("count").alias("a"))
    split = F.split("phrase", " ", -1)
    cuts = phrases.select("lang", "phrase", "n", "a", split.alias("w"), F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("tail"),
    )
    heads = part.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    tails = part.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(words.withColumnRenamed("words", "n"), "lang")
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    scored = scored.withColumn("score", F.expr(f"(cast(1000 as decimal(4, 0)) * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")

    w = F.split("phrase", " ", -1)
    inner = phrases.where("n > 2").select(
        "lang", "a", F.explode(F.array(
            F.array_join(F.slice(w, F.lit(1), F.col("n") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("n") - 1), " ")
        )).alias("phrase"),
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(covers)} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


QUERIES = {"op13_phrases": op13_phrases}

ORACLES = {
    "op13_phrases": """
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents)
  ) WHERE len(words) > 0
), totals AS (
  SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(words[place : place + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS place
        FROM pieces, (SELECT unnest(range(1, 6)) AS size) WHERE len(words) >= size)
), freq AS (
  SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r, t.n,
    (1000::HUGEINT * c.a::HUGEINT * t.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM freq WHERE size > 1) c
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
  JOIN totals t ON t.lang = c.lang
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM weakest c WHERE NOT EXISTS (
    SELECT 1 FROM freq f WHERE f.lang = c.lang AND f.size > c.size AND 100 * f.a >= 100 * c.a
      AND contains(' ' || f.phrase || ' ', ' ' || c.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
    a, l, r, n::BIGINT AS n, score::BIGINT AS score
  FROM kept
) WHERE rank <= 2000
"""
}
