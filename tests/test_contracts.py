import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as ops
from tidemark.sources.contracts import SCHEMA_DIR, packaged_schemas, schema_files, writer_schemas

V1, V2 = (json.loads(s) for s in packaged_schemas().values())


def table(spark, rows):
    texts = [(s, v, i, t if isinstance(t, str) else json.dumps(t)) for s, v, i, t in rows]
    return spark.createDataFrame(texts, "subject string, version int, schema_id int, schema string")


def changed(schema, edit):
    copy = json.loads(json.dumps(schema))
    edit(copy["fields"])
    return copy


def record(*fields):
    return {"type": "record", "name": "R", "fields": list(fields)}


def issues(spark, old, new):
    return [r.issue for r in ops.compat_issues(table(spark, [("s", 1, 1, old), ("s", 2, 2, new)])).collect()]


def test_schema_files_in_number_order(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"v{n}.avsc").write_text(json.dumps(V1))
    (tmp_path / "vnext.avsc").write_text("{}")
    assert [r.version for r in schema_files(spark, str(tmp_path)).collect()] == [1, 2, 10]
    assert [json.loads(r.schema) for r in schema_files(spark, SCHEMA_DIR).collect()] == [V1, V2]


def test_packaged_versions_are_compatible(spark):
    assert issues(spark, V1, V2) == []


def test_breaking_changes(spark):
    voucher = changed(V2, lambda f: f.append({"name": "voucher", "type": "string"}))
    amount = changed(V2, lambda f: next(x for x in f if x["name"] == "amount").update(type="string"))
    dropped = changed(V2, lambda f: f.pop())
    nullable = changed(V2, lambda f: f.append({"name": "note", "type": ["null", "string"], "default": None}))
    assert issues(spark, V2, voucher) == ["new field 'voucher' has no default"]
    assert issues(spark, V2, amount) == ["field 'amount' changed type 'double' -> 'string'"]
    assert issues(spark, V2, dropped) == [] and issues(spark, V2, nullable) == []


def test_type_compare_ignores_key_order(spark):
    a = record({"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}})
    b = record({"name": "t", "type": {"logicalType": "timestamp-millis", "type": "long"}})
    assert issues(spark, a, b) == []


def test_gate(spark):
    c = table(spark, [("a", 1, 1, V1), ("a", 2, 2, V2), ("b", 1, 3, V2), ("b", 4, 4, changed(V2, lambda f: f.append({"name": "c", "type": "int"}))), ("c", 1, 5, "{no")])
    got = {r.subject: (r.versions, r.unparsable, r.issues, r.passed) for r in ops.compat_gate(c).collect()}
    assert got == {"a": (2, 0, 0, True), "b": (2, 0, 1, False), "c": (1, 1, 0, False)}


def test_validity(spark):
    texts = [json.dumps(V1), "{}", "[]", "{bad", json.dumps({"type": "enum", "name": "E", "fields": []}),
             json.dumps(record({"name": "x"})), json.dumps(record())]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.ok for r in df.select("i", ops.is_valid_schema(F.col("t")).alias("ok")).orderBy("i").collect()] == [True, False, False, False, False, False, True]


def test_diff(spark):
    one = record({"name": "user_id", "type": "string"}, {"name": "amount", "type": "double"})
    two = record(*one["fields"], {"name": "device", "type": ["null", "string"], "default": None}) | {"doc": "with device"}
    three = record(*two["fields"][1:])
    rows = ops.contract_diff(table(spark, [("s", 1, 11, one), ("s", 2, 12, two), ("s", 3, 13, three), ("e", 1, 1, record()), ("e", 2, 2, one)])).collect()
    got = {(r.subject, r.version): r for r in rows}
    assert [(f.name, f.type, f.added) for f in got["s", 2].fields] == [("user_id", "string", False), ("amount", "double", False), ("device", "null | string", True)]
    assert (got["s", 2].schema_id, got["s", 2].doc, got["s", 1].doc) == (12, "with device", "")
    assert list(got["s", 3].removed) == ["user_id"] and not any(f.added for f in got["s", 1].fields)
    assert list(got["e", 1].fields) == [] and not any(f.added for f in got["e", 2].fields)


def test_type_text(spark):
    rows = [('{"type":"long","logicalType":"timestamp-millis"}',), ('["null",{"type":"long","logicalType":"date"}]',), ("string",), ('{"items":"int"}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ops.type_text(F.col("t"))).collect()]
    assert got == ["timestamp-millis", "null | date", "string", "record"]


def test_writer_schemas(spark):
    c = table(spark, [("s", 2, 12, V2), ("s", 1, 11, V1), ("other", 9, 99, V1)])
    writers, reader = writer_schemas(c, "s")
    assert set(writers) == {11, 12} and json.loads(reader) == V2
    with pytest.raises(ValueError):
        writer_schemas(c, "none")


def test_candidates(spark):
    c = table(spark, [("s", 1, 1, V1), ("s", 2, 2, V2)])
    cand = spark.createDataFrame(
        [("s", json.dumps(changed(V2, lambda f: f.append({"name": "n", "type": "int"})))), ("fresh", json.dumps(V1))], "subject string, schema string"
    )
    got = {r.subject: (r.compatible, list(r.messages)) for r in ops.is_compatible(c, cand).collect()}
    assert got == {"s": (False, ["new field 'n' has no default"]), "fresh": (True, [])}


def test_levels(spark):
    c = table(spark, [("a", 1, 1, V1), ("b", 1, 2, V1)])
    levels = spark.createDataFrame([("a", "FULL"), (None, "NONE")], "subject string, level string")
    assert {r.subject: r.level for r in ops.compat_levels(c, levels).collect()} == {"a": "FULL", "b": "NONE"}
    assert {r.level for r in ops.compat_levels(c, levels.where("subject is not null")).collect()} == {"FULL", "BACKWARD"}


def test_levels_are_obeyed(spark):
    less = changed(V1, lambda f: f.pop())
    more = changed(V1, lambda f: f.append({"name": "n", "type": "int"}))
    names = ["BACKWARD", "FORWARD", "FULL", "NONE"]
    c = table(spark, [(n, 1, k, V1) for k, n in enumerate(names, 1)])
    levels = spark.createDataFrame([(n, n) for n in names[1:]], "subject string, level string")
    removed = "default" in V1["fields"][-1]  # whether the old schema could fill the field it loses
    for schema, want in ((more, {"BACKWARD": False, "FORWARD": True, "FULL": False, "NONE": True}),
                         (less, {"BACKWARD": True, "FORWARD": removed, "FULL": removed, "NONE": True})):
        cand = spark.createDataFrame([(n, 1, json.dumps(schema)) for n in names], "subject string, seq int, schema string")
        got = {r.subject: r.compatible for r in ops.is_compatible(c, cand.drop("seq"), levels).collect()}
        assert got == want
        status = {r.subject: r.status for r in ops.register(c, cand, levels=levels).collect()}
        assert status == {n: "registered" if ok else "refused" for n, ok in want.items()}


def lint(old, new):
    was = {f["name"]: f for f in old["fields"]}
    for f in new["fields"]:
        if f["name"] not in was:
            if "default" not in f:
                return False
        elif json.dumps(f["type"], sort_keys=True) != json.dumps(was[f["name"]]["type"], sort_keys=True):
            return False
    return True


def one_by_one(start, candidates):
    """Register candidates one after another per subject; stop a subject at its first refusal."""
    out = {}
    for subject in {c[0] for c in candidates}:
        known = sorted(((v, t) for s, v, _, t in start if s == subject), key=lambda x: x[0])
        stopped = False
        for _, seq, schema in sorted((c for c in candidates if c[0] == subject), key=lambda c: c[1]):
            if stopped:
                out[subject, seq] = ("not_reached", None)
            elif isinstance(schema, str) or (known and not lint(known[-1][1], schema)):
                out[subject, seq], stopped = ("refused", None), True
            elif any(t == schema for _, t in known):
                out[subject, seq] = ("unchanged", min(v for v, t in known if t == schema))
            else:
                known.append(((known[-1][0] if known else 0) + 1, schema))
                out[subject, seq] = ("registered", known[-1][0])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_register_equals_one_by_one(spark, seed):
    rng = random.Random(seed)

    def some_schema():
        names = rng.sample("abcd", rng.randrange(2, 5))
        return record(*[{"name": n, "type": rng.choice(["int", "int", "int", "int", "string"]), "default": None} if rng.random() < 0.9 else {"name": n, "type": "int"} for n in sorted(names)])

    start = [(s, v, 10 * i + v, some_schema()) for i, s in enumerate(["x", "y", "z"]) for v in (1, 2)]
    candidates = [(s, q, some_schema() if rng.random() < 0.8 else start[0][3]) for s in ("x", "y", "z", "new") for q in range(12)]
    candidates = [(s, q, "{no schema" if s == "z" and q == 2 else t) for s, q, t in candidates]
    texts = [(s, q, t if isinstance(t, str) else json.dumps(t)) for s, q, t in candidates]
    frame = spark.createDataFrame(texts, "subject string, seq bigint, schema string")
    rows = ops.register(table(spark, start), frame, parts=4).collect()
    assert {(r.subject, r.seq): (r.status, r.version) for r in rows} == one_by_one(start, candidates)
    fresh = [r.schema_id for r in rows if r.status == "registered"]
    assert len(set(fresh)) == len(fresh) and min(fresh, default=99) > max(i for _, _, i, _ in start)
