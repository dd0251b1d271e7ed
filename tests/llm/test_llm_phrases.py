"""Phrases, SentencePiece and hard negatives against brute force, the library and SQL."""

import collections
import hashlib
import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import public_tokenizers as P
import pytest
from check import compare, database
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tidemark.llm import exact_dedup, negatives, phrases, pieces, token_counts

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# --- phrases


def phrase_truth(rows, longest, least, top, covers):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        kept = []
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            longer = [q for q in frequent if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
            if any(100 * frequent[q] >= covers * a for q in longer):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows():
    rnd = random.Random(4)
    words = ["the", "of", "New", "york", "city", "é", "state x", "hall", "a", "b"]
    rows = []
    for _ in range(250):
        said = [rnd.choice(words) if rnd.random() < 0.7 else "new york city hall" for _ in range(rnd.choice([0, 1, 2, 5, 30]))]
        rows.append((rnd.choice([" ", "  ", "\t", " . ", ", ", "\r\n", "\x0b", "!"]).join(said), rnd.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" .\n", "fr"), ("ha " * 400, "fr"), ("x" * 70_000 + " y", "fr"), (rows[3][0], rows[3][1])] * 2


@pytest.mark.parametrize("longest,least,top,covers,how", [
    (5, 3, 2000, 100, {}), (5, 3, 7, 100, {"bits": 7, "block": 900}), (3, 2, 50, 60, {"block": 400}), (2, 5, 9, 100, {"bits": 3}), (1, 1, 5, 100, {}),
])
def test_phrases_equal_brute_force(spark, longest, least, top, covers, how):
    rows = phrase_rows()
    full = [(i, t, lang, 1, "p") for i, (t, lang) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, n long, phrase string").repartition(3)
    got = phrases.collocations(docs, longest, least, top, covers, **how)
    assert sorted(map(tuple, got.collect())) == phrase_truth(rows, longest, least, top, covers)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(none, least=1).collect() == []


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(phrases, "word_hashes", lambda raw, begins, ends: np.zeros(len(begins), np.uint64))
    words, counts, places = phrases.numbered(b"b a bb a\na b")
    assert [words[k - 1] if k else None for k in places.tolist()] == [b"b", b"a", b"bb", b"a", None, b"a", b"b"]
    assert dict(zip(words, counts.tolist())) == {b"a": 3, b"b": 2, b"bb": 1}


def test_phrases_equal_sql(spark, sf_dir):
    good, note = compare(spark, database(sf_dir), phrases.op13_phrases, phrases.ORACLES["op13_phrases"], sf_dir)
    assert good, note


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=P.path(pieces.MODEL))


def piece_texts(library):
    rnd = random.Random(5)
    known = [library.id_to_piece(k).replace("▁", " ") for k in range(259, library.get_piece_size())]
    odd = [".", ",", "\n", ". ", "\x00", "　", "</s>", "<0x41>", "😀", "ꙮ", "▁", "  ", "\t"]
    texts = ["".join(rnd.choice(known + odd * 50) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    return [None, "", " ", "\n", "\n\n a", "a.\nb", "ab" * 100_000, " " * 50_000, "é" * 30_000, "word " * 40_000, *texts, texts[0], texts[0]]


def test_pieces_equal_the_library(spark, library):
    texts = piece_texts(library)
    docs = spark.createDataFrame([(k, t, "i", "d") for k, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string").repartition(4)
    own = pieces.Pieces(spark)
    rows = pieces.encoded(docs, own).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_eos=True)
        assert list(r.ids) == ids, repr(texts[r.doc_id])[:100]
        assert r.decoded == library.decode(ids)
    bare = pieces.Pieces(spark, end_id=False)
    for r in docs.where("doc_id < 100").select("doc_id", bare.ids("text").alias("x"), bare.text(bare.ids("text")).alias("t")).collect():
        assert list(r.x) == library.encode(texts[r.doc_id] or "") and r.t == library.decode(list(r.x))
    assert pieces.encoded(docs.limit(0), own).count() == 0


def test_piece_digests(spark, library, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pieces.op12_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_last_tokens_for_any_vocabulary():
    """Scores in any order, so that merges make pairs better than themselves and some pieces are never reached."""
    rnd = random.Random(6)
    for _ in range(60):
        made = {"a", "b", "c"} | {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))) for _ in range(14)}
        ranks = {p: float(r) for p, r in zip(sorted(made), rnd.sample(range(100), len(made)))}
        table = pieces.PrefixTable(ranks, pieces.border_events(ranks))
        for _ in range(60):
            word = "".join(rnd.choice("abcx") for _ in range(rnd.randint(1, 12)))
            assert table.tokens(word) == pieces.merges(word, ranks)[0], (word, ranks)


# --- hard negatives


def negative_truth(rows, positives, negatives_, share):
    kept = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = [math.floor(256 * x) for x in v]
        if sum(x * x for x in c) < 2**63:
            kept.append((k, i, label, c))
    last = lambda i: (i is None, i)
    out = []
    for k, i, label, c in kept:
        if i is None or i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(c, d)), last(j), m, other) for m, j, other, d in kept if m != k and len(d) == len(c)]
        near = sorted(s for s in scored if s[3] == label)[:positives]
        for score, j, _, _ in near:
            high = -score
            fit = sorted(s for s in scored if s[3] != label and share * high <= -100 * s[0] <= 100 * high)
            out += [(i, j[1], rank, s[1][1], high, -s[0]) for rank, s in enumerate(fit[:negatives_], 1)]
    return sorted(out, key=repr)


def vector_rows(seed, n, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, size))
    rows = []
    for k in range(n):
        v = (centres[rng.integers(6)] + 0.6 * rng.standard_normal(size)) * rng.choice([0.02, 1.0, 1.0, 3.0])
        rows.append((k, v.tolist(), int(rng.integers(4))))
    common = rows[0][1]
    rows += [(1000 + k, common, k % 3) for k in range(n // 3)]  # one vector of a third of the rows
    rows += [rows[0], rows[0], (None, rows[1][1], 1), (5000, None, 1), (5100, [1.0] * size, None), (5200, [], 2)]
    rows += [(5300, [float("nan")] * size, 1), (5400, [None] * size, 1), (5500, [0.0] * size, 2), (5600, [1e300] * size, 1), (5700, [1e5] * size, 1)]
    rows += [(5800, [1e6] + [-1e6] * (size - 1), 2), (5900, [1.0, 2.0], 1), (6000, [1.0, 2.0], 2), (6001, [1.5, 2.0], 1), (6002, [1.25, 2.0], 2)]
    return rows


@pytest.mark.parametrize("bucket,positives,most,share", [(2048, 5, 5, 80), (64, 3, 2, 50), (64, 1, 4, 95)])
def test_negatives_equal_brute_force(spark, monkeypatch, bucket, positives, most, share):
    rows = vector_rows(7, 600)
    # group and label are names the operator uses inside
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, `group` int, raw string").repartition(3)
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, positives, most, share, bucket=bucket)
    assert sorted(map(tuple, got.collect()), key=repr) == negative_truth(rows, positives, most, share)


def test_negatives_in_many_chunks(spark, monkeypatch):
    """Anchors of several chunks and slices, rows of many groups."""
    monkeypatch.setattr(negatives, "CHUNK", 16)
    monkeypatch.setattr(negatives, "SLICE", 5)
    rows = [(k * 100 if k < 40 else k + 10_001, v, label) for k, (_, v, label) in enumerate(vector_rows(8, 1500)[:1500])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [tuple(r) for r in table.collect()]
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == negative_truth(rows, 5, 5, 80)


def test_negatives_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(table, F.col("vec_id") % 100 == 0).collect() == []


def test_negatives_equal_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    good, note = compare(spark, database(sf_dir), negatives.op11_negatives, negatives.ORACLES["op11_negatives"], sf_dir)
    assert good, note


# --- earlier operators


def test_rerun_of_a_named_batch_keeps_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    first = sorted(map(tuple, exact_dedup.exact_dedup(docs, str(tmp_path / "index"), batch="monday").collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, str(tmp_path / "index"), batch="monday").collect())) == first
    assert [r.kept for r in exact_dedup.exact_dedup(docs, str(tmp_path / "index"), batch="tuesday").collect()] == [False] * 3


def test_equal_texts_meet_before_the_shuffle(spark, sf_dir):
    cache = token_counts.TokenCache(spark)
    plan = cache.misses(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    join, grouping = plan.index("LeftAnti"), plan.index("Aggregate [digest")
    assert join < grouping, plan


def test_queries_run_where_workers_lack_the_package(tmp_path):
    """Only the driver's own path has the package, added after the start; workers start in another folder."""
    script = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2") \\
    .config("spark.checkpoint.dir", "{tmp_path}/shared").config("spark.sql.warehouse.dir", "{tmp_path}/warehouse").getOrCreate()
sys.path.insert(0, {REPO!r})
from tidemark.llm import catalog
for name in ("op5_token_counts", "op6_vector_dedup", "op9_byte_bpe", "op11_negatives", "op12_pieces", "op13_phrases"):
    print(name, len(catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()), flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and len(done.stdout.split("\n")) >= 6, done.stderr[-3000:]
