"""Vectors, components, archives and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from check import compare, database

from tidemark.llm import catalog, fixity, vector_dedup
from tidemark.llm.components import connected_components

# --- components


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(400 + k, 401 + k) for k in range(40)]
    edges += [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (4, None)]
    parent = {}

    def root(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in out.collect()} == {k: root(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors


def vector_truth(rows, cosine):
    x = np.zeros((len(rows), 64))
    for k, (_, v) in enumerate(rows):
        if v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v):
            x[k] = np.array(v) / np.linalg.norm(v)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in zip(*np.nonzero(near)):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, int(near[k].sum()), least.get(root(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(0)
    x = []
    for _ in range(30):
        centre = rng.standard_normal(64)
        x += [centre + rng.standard_normal(64) * rng.choice([0.05, 0.1, 0.2, 0.3]) for _ in range(rng.integers(1, 40))]
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    x += [np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, 3, 150)]  # a chain far wider than the cosine
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000 + k, rows[0][1]) for k in range(20)] + [rows[3], rows[3], (None, rows[5][1]), (None, None)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, [1.0] * 63 + [None])]
    return rows + [(2005, [1.0] * 63 + [float("inf")]), (2006, [1e300] * 64), (2007, [1e-300] * 64), (2008, [1.0, 2.0])]


@pytest.mark.parametrize(("block", "part"), [(512, 4096), (7, 20)])
def test_near_vectors(spark, monkeypatch, vector_rows, block, part):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "SLICE", part)
    schema = "vec_id long, embedding array<double>, label int, node long, raw string"
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in vector_rows], schema).repartition(4)
    rows = [(i, [c / 1e300 for c in v] if i == 2006 else [c * 1e300 for c in v] if i == 2007 else v) for i, v in vector_rows]
    out = vector_dedup.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr) == vector_truth(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_near_vectors_recall_on_the_given_table(spark):
    """The table itself has no link; every tenth vector gets another one beside it, at cosine 0.951 to 0.97."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table.collect()]
    rng = np.random.default_rng(10)
    for i, v in rows[::10]:
        a = np.array(v) / np.linalg.norm(v)
        off = rng.standard_normal(len(a))
        off -= (off @ a) * a
        near = rng.uniform(0.951, 0.97)
        rows.append((1_000_000 + i, (near * a + np.sqrt(1 - near**2) * off / np.linalg.norm(off)).tolist()))
    want = {i: n for i, n, _ in vector_truth(rows, 0.95)}
    planted = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(planted).collect()}
    assert sum(want.values()) >= 2 * (len(rows) // 11) and all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_near_vectors_finds_lone_pairs_near_the_cosine(spark):
    """A third of the rows in one topic, at cosine 0.8 to each other; 300 lone pairs in it and 300 beside it."""
    n, k = 12_000, 300
    rng = np.random.default_rng(9)
    length = lambda x: np.linalg.norm(x, axis=1, keepdims=True)
    x = rng.standard_normal((n, 64))
    x[:, 0] = 0.0
    x /= length(x)
    x[: n // 3] *= np.sqrt(0.2)
    x[: n // 3, 0] = np.sqrt(0.8)
    for first in (0, n // 2):
        a = x[first : first + k]
        off = rng.standard_normal((k, 64))
        off -= (off * a).sum(axis=1, keepdims=True) * a
        near = rng.uniform(0.9505, 0.96, (k, 1))
        x[first + k : first + 2 * k] = near * a + np.sqrt(1 - near**2) * off / length(off)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    label = {r.vec_id: r.component_id for r in vector_dedup.near_vectors(df).collect()}
    for first in (0, n // 2):
        assert np.mean([label[i] == label[i + k] for i in range(first, first + k)]) >= 0.99


def test_near_vectors_empty(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- archives


def test_audit_finds_every_kind_of_damage(spark):
    rnd = random.Random(3)
    ours, theirs = [], []
    for file in (0, 1, 70, 5000):
        offset = 0
        for _ in range(200):
            size = rnd.randint(100, 40_000)
            row = (file, offset, size, hashlib.sha256(rnd.randbytes(8)).hexdigest())
            ours.append(row)
            theirs.append(row)
            offset += size
    changed, gone, cut = theirs[17], theirs[250], theirs[799]
    theirs[17] = (*changed[:3], "0" * 64)
    theirs[799] = (*cut[:2], 7, cut[3])
    del theirs[250]
    theirs.append((9, 0, 10, "1" * 64))
    schema = "file long, offset long, length long, digest string"
    one, two = (spark.createDataFrame(r, schema).repartition(3) for r in (ours, theirs))
    found = {(r.file, r.offset): r.status for r in fixity.audit(one, two).collect()}
    assert found == {changed[:2]: "changed", cut[:2]: "changed", gone[:2]: "missing", (9, 0): "extra"}
    assert fixity.audit(one, one).count() == 0
    none = spark.createDataFrame([], schema)
    assert fixity.audit(none, none).count() == 0
    assert {r.status for r in fixity.audit(none, two).collect()} == {"extra"}


def test_audit_opens_differing_branches_only(spark):
    rows = [(f, o * 5000, 5000, hashlib.sha256(f"{f} {o}".encode()).hexdigest()) for f in range(100) for o in range(50)]
    df = spark.createDataFrame(rows, "file long, offset long, length long, digest string")
    steps = fixity.levels(99)
    tree = fixity.merkle_tree(df, steps, "t")
    assert [t.count() for t in tree][0] == 5000 and tree[-1].count() == 1
    most = max(c for t in tree for (c,) in t.groupBy("file", "place").count().select("count").collect())
    assert most == 1


def test_page_records_with_nulls(spark):
    rows = [(1, "u", "body"), (1, "u", "body"), (None, None, None), (None, "x", "é"), (700, "y", "")]
    out = fixity.page_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = out.collect()
    assert len(found) == 5
    assert len({(r.file, r.offset) for r in found}) == 5
    for r in found:
        if r.page_id == 700:
            text = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: y\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            assert (r.length, r.digest) == (len(text), hashlib.sha256(text.encode()).hexdigest())


# --- registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, sf_dir, name):
    good, note = compare(spark, database(sf_dir), catalog.queries()[name], catalog.oracles()[name], sf_dir)
    assert good, note


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in e.queries() if q.startswith("op")}
    assert "pipeline" in e.queries()


def test_pipeline(spark, sf_dir):
    """Each stage against its contract on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        seen.append((name, docs.toPandas(), out.toPandas()))
        docs = out
    for _, _, out in seen[:-1]:
        assert list(out.columns) == columns
    before, after = seen[0][1:]
    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text) if t and any(c.isalpha() for c in t)}
    before, after = seen[1][1:]
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    assert Counter(map(strip, after.text)) == Counter(set(map(strip, before.text)))
    before, after = seen[2][1:]
    from test_llm_text import simhash_truth

    rows = list(zip(before.doc_id.tolist(), before.text))
    assert set(after.doc_id) == {c for _, _, c in simhash_truth(rows)} and after.doc_id.is_unique
    before, after = seen[3][1:]
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 3
    from tidemark.llm.mixing import mixed

    want = {r.doc_id: r.copies for r in mixed(spark.createDataFrame(before)).collect()}
    assert Counter(after.doc_id) == Counter({k: n for k, n in want.items() if n})
    before, after = seen[4][1:]
    decoded = Counter(hashlib.sha256(t.encode()).hexdigest() for t in before.text)
    assert Counter(after.decoded_sha256) == decoded
