"""Operators on texts against brute force, on fixtures with nulls, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
import xxhash

from tidemark.llm import byte_bpe, exact_dedup, language_id, mixing, simhash, suffix_dedup, token_counts, toxicity
from tidemark.llm.suffixes import joined, permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, `key` long, fp long"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, lang, s, None if t is None else len(t), "d", "r", 1, 2) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def some_rows(n=120, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    rows = []
    for i in range(n):
        k = rnd.random()
        if k < 0.2 and rows:
            text = rnd.choice(rows)[1]
            text = text and (text if k < 0.1 else re.sub(" ", "\n ", text))
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 4, 40, 300])))
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "Z", "é", None])))
    extra = [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \t\n", "de", "b"), (n + 3, "x" * 300_000, "en", "Z")]
    repeated = [rows[5], rows[5], (None, rows[7][1], "en", "a"), (None, None, None, None), (n + 4, "1 2 <|endoftext|> 3", "en", "b")]
    return rows + extra + repeated


@pytest.fixture(scope="module")
def rows():
    return some_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).limit(0)


def plain(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- exact dedup


def exact_truth(rows):
    norm = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest() for _, t, *_ in rows]
    best, size = {}, Counter(norm)
    for (i, t, *_), d in zip(rows, norm):
        key = (-len(t or ""), i is None, i or 0)
        best[d] = min(best.get(d, (key, i)), (key, i), key=lambda x: x[0])
    return sorted(((i, best[d][1], size[d], d) for (i, *_), d in zip(rows, norm)), key=repr)


def test_exact_dedup(docs, rows):
    out = exact_dedup.exact_dedup(docs)
    assert plain(out, "doc_id", "keep_id", "group_size", "text_sha256") == exact_truth(rows)
    kept = out.where("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in kept}) == out.select("text_sha256").distinct().count()
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_index_remembers(spark, tmp_path):
    path = str(tmp_path / "index")
    first = table(spark, [(5, "a b", None, None), (2, "ab", None, None), (9, "c", None, None)])
    second = table(spark, [(1, "ab", None, None), (3, "d", None, None), (4, "d", None, None)])
    assert plain(exact_dedup.exact_dedup(first, path).where("kept"), "doc_id") == [(5,), (9,)]
    out = exact_dedup.exact_dedup(second, path)
    assert plain(out, "doc_id", "keep_id", "kept") == [(1, 5, False), (3, 3, True), (4, 3, False)]
    index = exact_dedup.DigestIndex(spark, path)
    assert plain(index.rows(), "keep_id") == [(3,), (5,), (9,)]
    assert not exact_dedup.exact_dedup(second, path).where("kept").count()


def test_exact_stage_keeps_rows_whole(docs, rows):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({d for *_, d in exact_truth(rows)})


def test_exact_stage_keeps_the_text_with_most_code_points(spark):
    rows = [(i, "a b c" + " " * k, "en", "a") for i in (None, 5) for k in range(40)] + [(7, "x  y", "en", "a"), (7, " x y", "en", "a")]
    out = plain(exact_dedup.drop_copies(table(spark, rows)), "doc_id", "text")
    assert len(out) == 2 and out[0] == (5, "a b c" + " " * 39) and out[1][0] == 7


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


# --- mixing


def mix_truth(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    per = Counter()
    for (_, _, _, s), n in zip(rows, size):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(per.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * per[s]]
        target |= {s: 3 * per[s] for s in full} if full else share
        open_ = open_ - set(full) if full else set()
    return size, per, target


def test_mixing(docs, rows):
    size, per, target = mix_truth(rows)
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    assert sorted(r["size"] for r in out) == sorted(size)
    for r in out:
        assert r.source_size == per[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r["size"] * r.copies and r.copies <= 3
        assert r.copies in (int(r.rate), int(r.rate) + 1)
    again = mixing.mixed(docs.repartition(7))
    assert plain(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r["size"], r.taken) for r in out), key=repr)


def test_mixing_takes_near_the_target(spark):
    df = spark.range(6000).selectExpr(
        "id as doc_id", "concat('a b ', repeat('c ', cast(id % 7 as int))) as text", "case when id % 3 = 0 then 'x' when id % 60 = 1 then 'y' else 'z' end as source"
    )
    out = mixing.mixed(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.1) for r in out)


def test_mix_emits_copies(docs):
    want = Counter({(r.doc_id, r["size"]): 0 for r in []})
    for r in mixing.mixed(docs).collect():
        want[r.doc_id] += r.copies
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_mixing_empty(empty, spark):
    assert mixing.mixed(empty).count() == 0 and mixing.emit(empty).count() == 0
    none = mixing.mixed(table(spark, [(1, None, None, "a"), (2, " ", None, "b")])).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0), (0.0, 0)]


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    lines = open(P.path(byte_bpe.RANKS), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, encoding):
    want = []
    for i, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(byte_bpe.token_digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_long_texts_are_cut_where_it_is_safe(encoding):
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b's", " ", " ", "\n", "  ", "1", "!", "é", "你", "\t", "　", "\x1c"]) for _ in range(200))
        cut = list(byte_bpe.pieces(text, 20))
        assert "".join(cut) == text
        assert [x for p in cut for x in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_long_white_space_is_encoded_apart(encoding):
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choice(["a", "b's", "1", "!", "\x1c", *(c * rnd.randint(1, 40) for c in " \n\t\x85\u3000")]) for _ in range(30))
        found = [encoding._encode_single_piece(p) if one else encoding.encode_ordinary(p) for p, one in byte_bpe.matches(text, 20)]
        assert [x for ids in found for x in ids] == encoding.encode_ordinary(text)
        assert "".join(p for p, _ in byte_bpe.matches(text, 20)) == text


def test_a_million_blanks(spark, encoding):
    n = 1_100_000
    rows = [(k, t, "en", "a") for k, t in enumerate([" " * n, "a" + "\n" * n + "b", "a" + " " * n + "b c"])]
    out = {r.doc_id: r for r in byte_bpe.encoded(table(spark, rows), byte_bpe.ByteBpe(spark)).collect()}
    for k, text, *_ in rows:
        assert bytes(out[k].decoded).decode() == text
    tail = np.frombuffer(bytes(out[2].ids), "<u4").tolist()
    assert tail[-2:] == encoding.encode_ordinary(" b c") and tail[0] == encoding.encode_ordinary("a")[0]


def test_ids_decode_on_their_own(spark, docs, rows):
    bpe = byte_bpe.ByteBpe(spark)
    coded = docs.select("doc_id", bpe.ids("text").alias("coded"))
    back = coded.select(bpe.raw("coded").alias("raw")).collect()
    assert sorted(bytes(r.raw) for r in back) == sorted((t or "").encode() for _, t, *_ in rows)


def test_byte_bpe_empty(empty):
    assert byte_bpe.token_digests(empty).count() == 0


# --- token counts


def test_token_counts(spark, docs, rows, tmp_path):
    own = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        n = len(own.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 1024))
    cache = token_counts.TokenCache(spark, str(tmp_path / "cache"))
    assert plain(token_counts.token_counts(docs, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert cache.stored().count() == len({t or "" for _, t, *_ in rows})
    assert cache.misses(docs).count() == 0
    more = table(spark, [(1, "new text", None, None), (2, rows[5][1], None, None)])
    assert plain(cache.misses(more), "text") == [("new text",)]
    other = token_counts.TokenCache(spark, str(tmp_path / "cache"), P.path("word_bpe_49k.json"))
    assert other.stored().count() == 0


def test_word_counts_equal_the_library():
    own = token_counts.WordCounts(open(P.path("byte_bpe_50k.json")).read())
    rnd = random.Random(2)
    signs = [" ", " ", "\n", "a", "b", "'s", "'ll", "!", "1", "é", "<|endoftext|>", "\t", "\r", "\xa0", "　", "\x1c", "\x85", "你", "​", "\x00"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(20_000)]
    assert own.count(texts) == own.encode(texts)


def test_token_counts_empty(empty):
    assert token_counts.token_counts(empty).count() == 0


# --- SimHash


def simhash_truth(rows, words=4, most=4):
    fps = []
    for _, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        hashes = [xxhash.xxh64_intdigest(" ".join(found[k : k + words]).encode(), 42) for k in range(max(1, len(found) - words + 1))]
        bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if bits[b]) if found else 0)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(root(k))) for k, ((i, *_), f) in enumerate(zip(rows, fps))), key=repr)


def test_simhash(docs, rows):
    assert plain(simhash.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == simhash_truth(rows)


@pytest.mark.parametrize("small", [64, 3])
def test_simhash_links_equal_all_pairs(spark, monkeypatch, small):
    """Dense balls around a few centres: large groups go through their first members and the second look."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rnd = random.Random(4)
    fps = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.choice([3, 4, 9, 21, 22, 30, 42, 43, 50, 63])
            fps.add(x)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.label for r in simhash.linked(df).collect()}
    groups = lambda of: {frozenset(f for f in fps if of(f) == k) for k in {of(f) for f in fps}}
    assert groups(lambda f: got.get(signed(f), signed(f))) == groups(root)


def test_simhash_stage(docs, rows):
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns
    truth = simhash_truth(rows)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted({c for _, _, c in truth if c is not None})


def test_simhash_stage_with_null_and_shared_ids(spark):
    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
    rows = [(None, text(), "en", "a") for _ in range(60)] + [(1, text(), "en", "a") for _ in range(20)]
    rows += [(None, rows[0][1], "en", "a"), (1, rows[60][1], "en", "a"), (9, rows[1][1].upper(), "en", "a"), (3, rows[2][1], "en", "a")]
    shared = text()
    rows += [(20, shared, "en", "a"), (21, shared.upper(), "en", "a"), (21, text(), "en", "a"), (21, shared, "en", "a")]
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t.lower(), []).append(i)
    want = sorted(((min((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()), key=repr)
    out = simhash.drop_near_copies(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text.lower()) for r in out), key=repr) == want


def test_simhash_empty(empty):
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.drop_near_copies(empty).count() == 0


# --- suffix arrays


def test_suffix_array_equals_sorting():
    rnd = random.Random(5)
    for _ in range(400):
        letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(256))])
        segments = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 5))]
        t, symbols, _ = joined(segments)
        found, plain_t = suffix_array(t, symbols, len(segments)), t.tolist()
        assert found.tolist() == sorted(range(len(t)), key=lambda i: plain_t[i:])
        prefix = permuted_prefixes(t, found, segments)
        for a, b in zip(found[:-1], found[1:]):
            n = 0
            while plain_t[a + n] == plain_t[b + n]:
                n += 1
            assert prefix[b] == n


def suffix_truth(rows, span):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[k : k + span] for b in texts for k in range(len(b) - span + 1))
    out = []
    for (i, *_), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("classes", [2048, 3])
def test_suffix_dedup(spark, monkeypatch, classes):
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    rnd = random.Random(6)
    make = lambda n: "".join(rnd.choice("abcdef gé\n") for _ in range(n))
    passages = [make(rnd.randint(90, 400)) for _ in range(5)]
    rows = []
    for i in range(120):
        k = rnd.random()
        text = make(rnd.randint(0, 200))
        if k < 0.5:
            text += rnd.choice(passages)[rnd.randint(0, 60) :] + make(rnd.randint(0, 90))
        elif k < 0.6 and rows:
            text = rnd.choice(rows)[1]
        elif k < 0.7:
            text = make(4) * rnd.randint(1, 200)
        rows.append((i, text, None, None))
    rows += [(200, None, None, None), (201, "", None, None), (None, rows[3][1], None, None), (None, passages[0], None, None), rows[9], (202, "x" * 3000, None, None)]
    out = suffix_dedup.without_repeats(table(spark, rows), span=100)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=repr)
    assert got == suffix_truth(rows, 100)


def test_suffix_dedup_query_goes_by_400_bytes(spark, tmp_path):
    """Of two repeated passages of 57 words, the one of 399 bytes stays; ``n_bytes`` is the whole text's length."""
    rnd = random.Random(8)
    make = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(57))
    short, long = make() + "x", make() + "xy"
    assert (len(short), len(long)) == (399, 400)
    rows = [(i, f"{i} {i * 7919}{p}{i}" + "-" * i, None, None) for i, p in enumerate([short, short, long, long, make(), "", long])]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in suffix_truth(rows, 400)]
    assert [r.doc_id for r in sorted(out) if r.removed] == [2, 3, 6]
    assert [n for _, n, *_ in got] == [len(t) for _, t, *_ in rows]


def test_anchors_of_a_text_do_not_depend_on_blocks(monkeypatch):
    raw = bytes(random.Random(7).choice(b"abcdefgh ") for _ in range(5000))
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(raw, 400))]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchors(raw, 400))]
    grams = [np.repeat(g, b - a + 1) for a, b, g in (whole, parts)]
    assert (grams[0] == grams[1]).all() and len(grams[0]) == 4601


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.without_repeats(empty).count() == 0


# --- language ID


def language_truth(rows, length):
    def grams(text):
        c = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        return Counter(c[k : k + n] for n in (1, 2, 3) for k in range(len(c) - n + 1) if c[k : k + n].strip() and " " not in c[k : k + n][1:-1])

    code = lambda g: (sum(ord(x) << 21 * (len(g) - 1 - k) for k, x in enumerate(g)))
    first = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:length]
    per = {}
    for i, t, lang, _ in rows:
        if lang is not None and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2 and grams(t or ""):
            per.setdefault(lang, Counter()).update(grams(t))
    place = {lang: {g: k for k, g in enumerate(first(c))} for lang, c in per.items()}
    out = []
    for i, t, *_ in rows:
        best = first(grams(t or ""))
        far = sorted((sum(abs(k - place[x][g]) if g in place[x] else length for k, g in enumerate(best)), x) for x in place)
        out.append((i, far[0][1], round(1 - far[0][0] / (length * len(best)), 9)) if best else (i, "und", 0.0))
    return sorted(out, key=repr)


def test_language_id(docs, rows):
    out = language_id.languages(docs, length=60).collect()
    assert sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in out), key=repr) == language_truth(rows, 60)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in out)


def test_language_blocks(monkeypatch):
    letter = language_id.tables()
    text = " ".join(some_rows(30)[k][1] or "" for k in range(30))
    whole = language_id.text_grams(text, letter)
    monkeypatch.setattr(language_id, "BLOCK", 50)
    parts = language_id.text_grams(text, letter)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = language_id.languages(docs).where("held_out").join(docs, "doc_id").where("lang is not null")
    assert both.where("lang = lang_pred").count() >= 0.95 * both.count()


def test_language_nothing_to_learn(spark, empty):
    assert language_id.languages(empty).count() == 0
    out = language_id.languages(table(spark, [(1, "words here", None, None), (3, None, "en", None)])).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}


def test_language_stage(docs):
    out = language_id.drop_unknown(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in docs.collect())


def test_language_stage_with_nothing_to_learn(spark):
    rows = [(1, "words here", None, None), (2, "and é there", None, "a"), (3, None, "en", None), (4, " 12 !", None, "a"), (None, "x", None, None)]
    out = language_id.drop_unknown(table(spark, rows))
    assert plain(out, "doc_id") == [(1,), (2,), (None,)]


# --- toxicity


def toxic_rows(spark, n=900):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.15
        text = rnd.sample(words, 30) + (rnd.sample(["grumble", "zounds", "fiend", "knave"], 2) if toxic else [])
        rnd.shuffle(text)
        docs.append((i, " ".join(text), None, None))
        if rnd.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_rows(spark)
    more = [(None, "zounds knave", None, None), (2000, None, None, None), (2001, "", None, None)]
    own = labels + [(None, 1, 1), (5, None, None), labels[0]]
    out = toxicity.toxicity(table(spark, docs + more), spark.createDataFrame(own, "doc_id long, quality int, toxic int")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [(by[i].predicted, t) for i, _, t in labels if by[i].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert by[2000].score == by[2001].score and by[2000].predicted == 0 and by[None].predicted == 1
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in out)


def test_risk_stays_non_negative_where_it_would_memorise():
    rng = np.random.default_rng(0)
    features = [np.unique(rng.integers(0, 1 << toxicity.BITS, 20)).astype(np.int32) for _ in range(80)]
    toxic = np.array([1] * 20 + [0] * 60)
    b, w = toxicity.fit(features, toxic, 0.3, 1)
    assert (w >= 0).all() and np.isfinite(b)
    assert not any(w[f].sum() + b > 0 for f in features)  # nothing that two texts share: nothing learned


def test_toxicity_without_examples(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(empty, labels).count() == 0
    out = toxicity.toxicity(table(spark, [(1, "a", None, None), (2, None, None, None)]), labels).collect()
    assert {(r.score, r.predicted) for r in out} == {(0.0, 0)}
