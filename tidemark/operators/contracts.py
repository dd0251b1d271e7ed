"""Contract versions of many subjects compared, checked and registered as sets.

A contracts frame is ``subject, version, schema_id, schema``; one job covers every subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.once import computed_once
from tidemark.operators.ordered import PARTS, running_before
from tidemark.session import written_once

DEFAULT_LEVEL = "BACKWARD"
_ID_BUCKETS = 4096


def subject_name(topic: Column) -> Column:
    return F.concat(topic, F.lit("-value"))


def _is_json(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")


def canonical_type(text: Column) -> Column:
    """Type text that is equal for equal types: JSON with keys sorted at every level, names as they are."""
    return F.when(_is_json(text), F.to_json(F.try_parse_json(text))).otherwise(text)


def type_text(text: Column) -> Column:
    """How a type is shown: union branches joined by bars, a logical type name before its base type."""

    def one(t: Column) -> Column:
        parts = F.from_json(t, "map<string,string>")
        named = F.coalesce(F.nullif(parts["logicalType"], F.lit("")), parts["type"], F.lit("record"))
        return F.when(t.startswith("{"), named).otherwise(t)

    union = F.array_join(F.transform(F.from_json(text, "array<string>"), one), " | ")
    return F.when(text.startswith("["), union).otherwise(one(text))


def parsed_fields(schema: Column) -> Column:
    """Fields of a schema in order: name, shown type, canonical type, whether it has a default.

    Fields are parsed as maps, which keeps "no default" apart from "default null". Text that is no record
    has no fields.
    """
    fields = F.from_json(schema, "fields array<map<string,string>>")["fields"]
    described = F.transform(
        fields,
        lambda f: F.struct(
            f["name"].alias("name"),
            type_text(f["type"]).alias("type"),
            canonical_type(f["type"]).alias("canonical"),
            F.map_contains_key(f, "default").alias("has_default"),
        ),
    )
    return F.coalesce(described, F.array().cast(_FIELDS))


_FIELDS = "array<struct<name:string,type:string,canonical:string,has_default:boolean>>"


def contract_fields(contracts: DataFrame) -> DataFrame:
    """One row per field of each version."""
    kept = [c for c in contracts.columns if c != "schema"]
    return contracts.select(*kept, F.posexplode(parsed_fields(F.col("schema"))).alias("pos", "f")).select(
        *kept, "pos", "f.*"
    )


def schema_doc(schema: Column) -> Column:
    return F.coalesce(F.get_json_object(schema, "$.doc"), F.lit(""))


def is_valid_schema(schema: Column) -> Column:
    """A record with a name whose fields all have a name and a type."""
    parsed = F.from_json(schema, "type string, name string, fields array<map<string,string>>")
    complete = F.forall(
        parsed["fields"],
        lambda f: F.map_contains_key(f, "name") & F.map_contains_key(f, "type") & f["name"].isNotNull()
        & f["type"].isNotNull(),
    )
    good = F.try_parse_json(schema).isNotNull() & (parsed["type"] == "record") & parsed["name"].isNotNull() & complete
    return F.coalesce(good, F.lit(False))


def previous_versions(contracts: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """``subject, version, previous``: the version registered just before in the same subject."""
    numbers = contracts.select("subject", "version", F.col("version").alias("_v"))
    return running_before(numbers, ["subject"], "version", "_v", "previous", parts=parts).drop("_v")


def paired_versions(contracts: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """Every version beside the one before it: ``subject, version, mine, before`` (null for the first).

    Each schema is parsed once and sent to two places, its own version and its successor's; one grouping
    brings the pairs together. Which version comes next is found on the numbers alone.
    """
    numbers = contracts.select("subject", "version", (-F.col("version")).alias("_back"))
    later = running_before(numbers.withColumn("_v", F.col("_back")), ["subject"], "_back", "_v", "_next", parts=parts)
    nexts = later.select("subject", "version", (-F.col("_next")).alias("next"))
    own = F.struct(
        "version", "schema_id", schema_doc(F.col("schema")).alias("doc"), parsed_fields(F.col("schema")).alias("fields")
    )
    parsed = contracts.join(nexts, ["subject", "version"]).select("subject", "version", "next", own.alias("own"))
    places = F.array(
        F.struct(F.col("version").alias("at"), F.lit(True).alias("mine"), F.col("own").alias("c")),
        F.struct(F.col("next").alias("at"), F.lit(False).alias("mine"), F.col("own").alias("c")),
    )
    sent = parsed.select("subject", F.inline(places)).where(F.col("at").isNotNull())
    return sent.groupBy("subject", F.col("at").alias("version")).agg(
        F.max(F.when(F.col("mine"), F.col("c"))).alias("mine"),
        F.max(F.when(~F.col("mine"), F.col("c"))).alias("before"),
    )


def _named(fields: Column, name: Column) -> Column:
    """The field of that name, or null; of repeated names the last counts."""
    return F.get(F.reverse(F.filter(fields, lambda o: o["name"] == name)), F.lit(0))


def _shown(canonical: Column) -> Column:
    return F.when(_is_json(canonical), canonical).otherwise(F.concat(F.lit("'"), canonical, F.lit("'")))


def issue_list(new: Column, old: Column) -> Column:
    """``name, issue`` for fields of ``new`` that a reader could not fill from data written with ``old``."""

    def beside(f: Column) -> Column:
        return F.struct(
            f["name"].alias("name"), f["canonical"].alias("now"), f["has_default"].alias("has_default"),
            _named(old, f["name"])["canonical"].alias("was"),
        )

    def judged(x: Column) -> Column:
        no_default = F.concat(F.lit("new field '"), x["name"], F.lit("' has no default"))
        retyped = F.concat(
            F.lit("field '"), x["name"], F.lit("' changed type "), _shown(x["was"]), F.lit(" -> "), _shown(x["now"])
        )
        missing = x["was"].isNull()
        issue = F.when(missing, F.when(~x["has_default"], no_default)).when(x["was"] != x["now"], retyped)
        return F.struct(x["name"].alias("name"), issue.alias("issue"))

    return F.filter(F.transform(F.transform(new, beside), judged), lambda x: x["issue"].isNotNull())


def issues_at(level: Column, new: Column, old: Column) -> Column:
    """Issues that ``level`` asks about: ``BACKWARD`` reads old data with the new schema, ``FORWARD`` new data with the
    old one, ``FULL`` both, ``NONE`` neither. All compare with the newest version."""
    back, ahead = issue_list(new, old), issue_list(old, new)
    nothing = F.filter(back, lambda x: F.lit(False))
    return (
        F.when(level.startswith("BACKWARD"), back).when(level.startswith("FORWARD"), ahead)
        .when(level.startswith("FULL"), F.concat(back, ahead)).otherwise(nothing)
    )


def _with_level(rows: DataFrame, subjects: DataFrame, levels: DataFrame | None) -> DataFrame:
    if levels is None:
        return rows.withColumn("_level", F.lit(DEFAULT_LEVEL))
    return rows.join(compat_levels(subjects, levels).withColumnRenamed("level", "_level"), "subject", "left")


def compat_issues(contracts: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """Issues between each version and the one before it, one row each; removed fields are allowed."""
    pairs = paired_versions(contracts, parts).where(F.col("before").isNotNull())
    found = F.explode(issue_list(F.col("mine.fields"), F.col("before.fields")))
    return pairs.select("subject", F.col("before.version").alias("previous"), "version", found.alias("x")).select(
        "subject", "previous", "version", "x.name", "x.issue"
    )


def compat_gate(contracts: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """Per subject: versions, unparsable schemas, issues, and whether the subject passes."""
    valid = is_valid_schema(F.col("schema"))
    checked = contracts.groupBy("subject").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if(~valid).alias("unparsable")
    )
    issues = compat_issues(contracts, parts).groupBy("subject").agg(F.count(F.lit(1)).alias("issues"))
    counts = checked.join(issues, "subject", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return counts.withColumn("passed", (F.col("issues") == 0) & (F.col("unparsable") == 0))


def newest_contracts(contracts: DataFrame) -> DataFrame:
    """The latest version of each subject, the reader schema of its events."""
    newest = F.max_by(F.struct("version", "schema_id", "schema"), "version")
    return contracts.groupBy("subject").agg(newest.alias("c")).select("subject", "c.*")


def _newest_fields(contracts: DataFrame) -> DataFrame:
    return newest_contracts(contracts).select("subject", parsed_fields(F.col("schema")).alias("start_fields"))


def candidate_issues(contracts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Issues of candidate schemas (``subject, schema``) against the newest registered version."""
    both = candidates.join(_newest_fields(contracts), "subject")
    found = F.explode(issue_list(parsed_fields(F.col("schema")), F.col("start_fields")))
    return both.select("subject", found.alias("x")).select("subject", "x.name", "x.issue")


def is_compatible(contracts: DataFrame, candidates: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """``subject, compatible, messages`` per candidate; a subject nobody registered accepts anything.

    ``levels`` (``subject, level``; the row without a subject is the global one) are obeyed; without them every
    subject has the default level.
    """
    both = _with_level(candidates, candidates, levels).join(_newest_fields(contracts), "subject", "left")
    found = issues_at(F.col("_level"), parsed_fields(F.col("schema")), F.col("start_fields"))
    known = F.col("start_fields").isNotNull()
    issues = F.when(known, F.transform(found, lambda x: x["issue"])).otherwise(F.array().cast("array<string>"))
    return both.select("subject", F.array_sort(issues).alias("messages")).select(
        "subject", (F.size("messages") == 0).alias("compatible"), "messages"
    )


def register(
    contracts: DataFrame, candidates: DataFrame, parts: int | None = PARTS, levels: DataFrame | None = None
) -> DataFrame:
    """Decide candidates (``subject, seq, schema``) taken in order of ``seq`` within each subject, at the level set
    for it (see :func:`is_compatible`).

    ``status``: ``registered`` (with a new version and id), ``unchanged`` (this schema is registered
    already; its version and id are returned), ``refused`` (the first that is incompatible or no valid
    schema) or ``not_reached`` (after a refusal). Every candidate is compared with the newest version at its turn: the last new
    candidate before it, or what was registered at the start.
    """
    canon = F.coalesce(F.to_json(F.try_parse_json("schema")), F.col("schema"))
    known = (
        contracts.withColumn("canon", canon)
        .groupBy("subject", "canon")
        .agg(F.min(F.struct("version", "schema_id")).alias("known"))
    )
    named = computed_once(candidates, canon, "canon")
    first = named.groupBy("subject", "canon").agg(F.min("seq").alias("first_seq"))
    turn = (
        named.join(first, ["subject", "canon"])
        .join(known, ["subject", "canon"], "left")
        .withColumn("is_new", F.col("known").isNull() & (F.col("seq") == F.col("first_seq")))
        .withColumn("new_seq", F.when(F.col("is_new"), F.col("seq")))
    )
    turn = running_before(turn, ["subject"], "seq", "new_seq", "base_seq", parts=parts)

    bases = candidates.select("subject", F.col("seq").alias("base_seq"), parsed_fields(F.col("schema")).alias("base_fields"))
    compared = turn.join(bases, ["subject", "base_seq"], "left").join(_newest_fields(contracts), "subject", "left")
    compared = _with_level(compared, candidates, levels)
    old = F.coalesce("base_fields", "start_fields")
    found = issues_at(F.col("_level"), parsed_fields(F.col("schema")), old)
    breaking = F.when(old.isNotNull(), F.size(found) > 0).otherwise(False)
    broken = breaking | ~is_valid_schema(F.col("schema"))
    # everything below looks at these rows several times: compute them once, into the shared folder
    judged = written_once(compared.select(*turn.columns, broken.alias("broken")), "register")
    stop = judged.where("broken").groupBy("subject").agg(F.min("seq").alias("stop"))

    decided = judged.join(stop, "subject", "left").withColumn(
        "status",
        F.when(F.col("seq") > F.col("stop"), "not_reached")
        .when(F.col("seq") == F.col("stop"), "refused")
        .when(F.col("is_new"), "registered")
        .otherwise("unchanged"),
    )
    return _with_ids(decided, contracts, parts)


def _with_ids(decided: DataFrame, contracts: DataFrame, parts: int | None) -> DataFrame:
    """Versions count up per subject; ids are unique over all subjects and above every id in use.

    New rows are spread over a fixed number of buckets by hash and numbered inside each, so neither a
    large subject nor the whole set is numbered in one task.
    """
    new = F.col("status") == "registered"
    latest = contracts.groupBy("subject").agg(F.max("version").alias("latest"))
    counted = running_before(
        decided.withColumn("_one", new.cast("bigint")), ["subject"], "seq", "_one", "_before", "sum", parts
    )
    versioned = counted.join(latest, "subject", "left").withColumn(
        "new_version", F.coalesce("latest", F.lit(0)) + F.coalesce("_before", F.lit(0)) + 1
    )
    fresh = versioned.where(new).withColumn("bucket", F.pmod(F.xxhash64("subject", "seq"), F.lit(_ID_BUCKETS)))
    used = contracts.agg(F.coalesce(F.max("schema_id"), F.lit(0)).alias("size")).withColumn("bucket", F.lit(-1))
    sizes = fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).unionByName(used)
    past = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # _ID_BUCKETS + 1 rows
    bases = sizes.select("bucket", F.sum("size").over(past).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("subject", "seq")
    numbered = fresh.withColumn("rank", F.row_number().over(inside)).join(bases, "bucket")
    # repeats of a schema registered in this run find it under the turn that registered it
    given = numbered.select(
        "subject", "first_seq", F.struct(F.col("new_version").alias("version"), (F.col("base") + F.col("rank")).alias("schema_id")).alias("given")
    )
    out = decided.join(given, ["subject", "first_seq"], "left")
    settled = F.col("status").isin("registered", "unchanged")
    pick = lambda name: F.coalesce(F.col(f"known.{name}"), F.col(f"given.{name}"))
    return out.select(
        "subject",
        "seq",
        "schema",
        "status",
        F.when(settled, pick("version")).cast("int").alias("version"),
        F.when(settled, pick("schema_id")).cast("int").alias("schema_id"),
    )


def compat_levels(subjects: DataFrame, levels: DataFrame, default: str = DEFAULT_LEVEL) -> DataFrame:
    """The level set for each subject, else the global one (the row whose subject is null), else the default."""
    shared = F.max_by("level", F.when(F.col("subject").isNull(), 1))
    fallback = levels.agg(F.coalesce(shared, F.lit(default)).alias("level"))
    own = levels.where(F.col("subject").isNotNull())
    named = subjects.select("subject").distinct()
    return named.join(own, "subject", "left").select(
        "subject", F.coalesce(F.col("level"), fallback.scalar()).alias("level")
    )


def _changes(mine: Column, before: Column) -> tuple[Column, Column]:
    """Fields of a version with an ``added`` flag, and the fields of the version before that are gone.

    Nothing counts as added in a first version or after a version without fields.
    """
    comparable = F.coalesce(F.size(before) > 0, F.lit(False))
    listed = F.transform(
        mine,
        lambda f, i: F.struct(
            i.alias("pos"), f["name"].alias("name"), f["type"].alias("type"),
            (comparable & _named(before, f["name"]).isNull()).alias("added"),
        ),
    )
    placed = F.transform(before, lambda f, i: F.struct(i.alias("pos"), f["name"].alias("name"), f["type"].alias("type")))
    gone = F.filter(placed, lambda f: _named(mine, f["name"]).isNull())
    return listed, F.coalesce(gone, F.array().cast("array<struct<pos:int,name:string,type:string>>"))


def contract_changes(contracts: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """Every field of every version with ``change``: ``added``, ``kept`` or ``removed``.

    A removed field is listed under the version that dropped it, with its place in the version before.
    """
    listed, gone = _changes(F.col("mine.fields"), F.col("before.fields"))
    present = F.transform(
        listed, lambda f: F.struct(f["pos"], f["name"], f["type"], F.when(f["added"], "added").otherwise("kept").alias("change"))
    )
    removed = F.transform(gone, lambda f: F.struct(f["pos"], f["name"], f["type"], F.lit("removed").alias("change")))
    rows = paired_versions(contracts, parts).select("subject", "version", F.explode(F.concat(present, removed)).alias("f"))
    return rows.select("subject", "version", "f.*")


def contract_diff(contracts: DataFrame, parts: int | None = PARTS) -> DataFrame:
    """One row per version: id, doc, its fields in order with an ``added`` flag, and the removed names."""
    listed, gone = _changes(F.col("mine.fields"), F.col("before.fields"))
    shown = F.transform(listed, lambda f: F.struct(f["name"], f["type"], f["added"]))
    return paired_versions(contracts, parts).select(
        "subject", "version", "mine.schema_id", "mine.doc",
        shown.alias("fields"), F.transform(gone, lambda f: f["name"]).alias("removed"),
    )
