"""Contract listing, comparison, gates and registration over a registry of many subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contracts as ops
from tidemark.plans import sql
from tidemark.plans.derived import contracts, table
from tidemark.sources.storefront import padded_id


LEVELS = ["FULL", "FORWARD", "NONE"]


def _halves(spark, sf):
    """Orders that are urgent or not open form the registry; the others arrive later as candidates."""
    c = contracts(spark, sf)
    waiting = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").cast("int").alias("version")
    )
    start = c.join(waiting, "version", "left_anti").select(*c.columns)
    candidates = c.join(waiting, "version", "left_semi").select(
        "subject", F.col("version").cast("bigint").alias("seq"), "schema"
    )
    return start, candidates


def _first_candidates(spark, sf):
    start, candidates = _halves(spark, sf)
    return start, candidates.groupBy("subject").agg(F.min_by("schema", "seq").alias("schema"))


def _compatible(spark, sf):
    checked = ops.is_compatible(*_first_candidates(spark, sf))
    return checked.select("subject", "compatible", F.array_join("messages", "; ").alias("messages"))


def _newest(spark, sf):
    return ops.newest_contracts(contracts(spark, sf)).select(
        "subject", "version", "schema_id", ops.schema_doc(F.col("schema")).alias("doc")
    )


def _levels(spark, sf):
    strict = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    own = strict.select(
        ops.subject_name(padded_id("c", F.col("c_custkey"), 6)).alias("subject"), F.lit("FULL").alias("level")
    )
    shared = spark.range(1).select(F.lit(None).cast("string").alias("subject"), F.lit("BACKWARD").alias("level"))
    return ops.compat_levels(contracts(spark, sf), own.unionByName(shared))


def _registered(spark, sf):
    """Decisions and versions; ids are checked to be new and unique by their counts."""
    start, candidates = _halves(spark, sf)
    return ops.register(start, candidates).select("subject", "seq", "status", "version")


def _registered_at_levels(spark, sf):
    """Every fourth customer's subject at another level, the rest at the global one."""
    start, candidates = _halves(spark, sf)
    kind = F.col("c_custkey") % 4
    own = table(spark, sf, "customer").where(kind < 3).select(
        ops.subject_name(padded_id("c", F.col("c_custkey"), 6)).alias("subject"),
        F.element_at(F.array(*map(F.lit, LEVELS)), (kind + 1).cast("int")).alias("level"),
    )
    shared = spark.range(1).select(F.lit(None).cast("string").alias("subject"), F.lit("BACKWARD").alias("level"))
    rows = ops.register(start, candidates, levels=own.unionByName(shared))
    return rows.select("subject", "seq", "status", "version")


def _registered_ids(spark, sf):
    start, candidates = _halves(spark, sf)
    rows = ops.register(start, candidates).where("status = 'registered'")
    used = start.agg(F.max("schema_id"))
    return rows.agg(
        F.count(F.lit(1)).alias("registered"), F.count_distinct("schema_id").alias("ids"),
        (F.min("schema_id") > used.scalar()).alias("above_used"),
    )


def _diff(spark, sf):
    fields = F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"], F.when(f["added"], "+").otherwise("")))
    return ops.contract_diff(contracts(spark, sf)).select(
        "subject", "version", "schema_id", "doc",
        F.array_join(fields, ",").alias("fields"), F.array_join("removed", ",").alias("removed"),
    )


def _valid(spark, sf):
    return contracts(spark, sf).select(ops.is_valid_schema(F.col("schema")).alias("valid")).groupBy("valid").agg(
        F.count(F.lit(1)).alias("schemas")
    )


QUERIES = {
    "contract_fields": lambda spark, sf: ops.contract_fields(contracts(spark, sf)),
    "contract_previous": lambda spark, sf: ops.previous_versions(contracts(spark, sf)),
    "contract_changes": lambda spark, sf: ops.contract_changes(contracts(spark, sf)),
    "contract_diff": _diff,
    "contract_validity": _valid,
    "compat_issues": lambda spark, sf: ops.compat_issues(contracts(spark, sf)),
    "compat_issue_counts": lambda spark, sf: ops.compat_issues(contracts(spark, sf)).groupBy(
        "name", F.substring("issue", 1, 9).alias("kind")
    ).agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("subject").alias("subjects")),
    "compat_gate": lambda spark, sf: ops.compat_gate(contracts(spark, sf)),
    "candidate_check": _compatible,
    "newest_contracts": _newest,
    "compat_levels": _levels,
    "register_contracts": _registered,
    "register_levels": _registered_at_levels,
    "register_ids": _registered_ids,
}

REGISTRY = """
ct as (
  select 'c' || lpad(cast(o_custkey as varchar), 6, '0') || '-value' as subject, cast(o_orderkey as integer) as version,
         cast(o_orderkey + 1 as integer) as schema_id, o_orderpriority as doc, o_totalprice < 5000 as broken,
         o_orderpriority[1] < '3' as urgent, o_orderstatus as status, o_totalprice > 250000 as dear,
         day(o_orderdate) > 15 as late,
         lag(cast(o_orderkey as integer)) over (partition by o_custkey order by o_orderkey) as previous
  from orders
),
loose as (
  select subject, version, schema_id, previous, 1 as ord, 'user_id' as name, 'string' as type, 'string' as canonical, false as has_default from ct where not broken
  union all
  select subject, version, schema_id, previous, 2, 'amount', t, t, false
  from (select *, case status when 'P' then 'string' else 'double' end as t from ct) where not broken
  union all
  select subject, version, schema_id, previous, 3, 'event_ts', 'timestamp-millis', '{"logicalType":"timestamp-millis","type":"long"}', false from ct where not broken
  union all
  select subject, version, schema_id, previous, 4, 'device', 'null | string', '["null","string"]', true from ct where not broken and urgent
  union all
  select subject, version, schema_id, previous, 5, 'voucher', 'string', 'string', false from ct where not broken and dear
  union all
  select subject, version, schema_id, previous, 6, 'currency', 'string', 'string', true from ct where not broken and late
),
fields as (
  select *, cast(row_number() over (partition by subject, version order by ord) - 1 as integer) as pos from loose
)"""

_ISSUES = REGISTRY + """,
issues as (
  select n.subject, n.previous, n.version, n.name,
         case when o.name is null then 'new field ''' || n.name || ''' has no default'
              else 'field ''' || n.name || ''' changed type ''' || o.canonical || ''' -> ''' || n.canonical || '''' end as issue
  from fields n left join fields o on o.subject = n.subject and o.version = n.previous and o.name = n.name
  where n.previous is not null and ((o.name is null and not n.has_default) or o.canonical <> n.canonical)
)"""

# Versions beside the one before them, as far as they can raise an issue: fields with a default never do.
_PAIRS = REGISTRY + """,
pairs as (
  select n.subject, n.previous, n.version, n.dear, case n.status when 'P' then 'string' else 'double' end as now,
         o.broken as was_broken, o.dear as was_dear, case o.status when 'P' then 'string' else 'double' end as was
  from ct n join ct o on o.subject = n.subject and o.version = n.previous where not n.broken
)"""

_CHANGES = REGISTRY + """,
changes as (
  select n.subject, n.version, n.pos, n.name, n.type,
         case when o.name is null and exists (
                select 1 from ct p where p.subject = n.subject and p.version = n.previous and not p.broken)
              then 'added' else 'kept' end as change
  from fields n left join fields o on o.subject = n.subject and o.version = n.previous and o.name = n.name
  union all
  select c.subject, c.version, o.pos, o.name, o.type, 'removed'
  from ct c join fields o on o.subject = c.subject and o.version = c.previous
  left join fields n on n.subject = c.subject and n.version = c.version and n.name = o.name
  where n.name is null
)"""

_CANDIDATES = REGISTRY + """,
latest as (select subject, max(version) as version from ct where status <> 'O' group by subject),
first_candidate as (select subject, min(version) as version from ct where status = 'O' group by subject),
candidate_issues as (
  select n.subject,
         case when o.name is null then 'new field ''' || n.name || ''' has no default'
              else 'field ''' || n.name || ''' changed type ''' || o.canonical || ''' -> ''' || n.canonical || '''' end as issue
  from first_candidate c join latest l using (subject)
  join fields n on n.subject = c.subject and n.version = c.version
  left join fields o on o.subject = l.subject and o.version = l.version and o.name = n.name
  where (o.name is null and not n.has_default) or o.canonical <> n.canonical
)"""

_REGISTER = REGISTRY + """,
signed as (
  select subject, version, status <> 'O' as at_start, broken,
         case when broken then 'broken' else concat_ws('|', doc, status = 'P', dear, late) end as signature
  from ct
),
at_start as (select subject, signature, min(version) as version from signed where at_start group by subject, signature),
newest_start as (select subject, max(version) as version from signed where at_start group by subject),
turns as (
  select c.*, k.version as known,
         k.version is null and c.version = min(c.version) over (partition by c.subject, c.signature) as is_new,
         min(c.version) over (partition by c.subject, c.signature) as first_turn
  from signed c left join at_start k using (subject, signature) where not c.at_start
),
based as (
  select t.*, coalesce(max(case when is_new then t.version end) over w, n.version) as base, n.version as start_version,
         count(*) filter (where is_new) over w as new_before
  from turns t left join newest_start n using (subject)
  window w as (partition by t.subject order by t.version rows between unbounded preceding and 1 preceding)
),
bad as (
  select subject, version from based where broken
  union
  select b.subject, b.version from based b join fields n on n.subject = b.subject and n.version = b.version
  left join fields o on o.subject = b.subject and o.version = b.base and o.name = n.name
  where b.base is not null and ((o.name is null and not n.has_default) or o.canonical <> n.canonical)
),
decided as (
  select b.*, coalesce(start_version, 0) + new_before + 1 as new_version,
         case when b.version > stop then 'not_reached' when b.version = stop then 'refused'
              when is_new then 'registered' else 'unchanged' end as decision
  from based b left join (select subject, min(version) as stop from bad group by subject) using (subject)
)"""

_DECIDED = """
select d.subject, cast(d.version as bigint) as seq, d.decision as status,
       cast(case d.decision when 'registered' then d.new_version
                            when 'unchanged' then coalesce(d.known, f.new_version) end as integer) as version
from decided d left join decided f on f.subject = d.subject and f.version = d.first_turn"""

# The level of a subject, the comparison with old data where it asks for it, and the one with old readers.
_AT_LEVELS = _REGISTER.replace(
    "bad as (", f"""
levelled as (
  select *, coalesce({LEVELS}[cast(substr(subject, 2, 6) as integer) % 4 + 1], 'BACKWARD') as level from based
),
bad as (
  select b.subject, b.version from levelled b join fields o on o.subject = b.subject and o.version = b.base
  left join fields n on n.subject = b.subject and n.version = b.version and n.name = o.name
  where b.level in ('FORWARD', 'FULL') and ((n.name is null and not o.has_default) or o.canonical <> n.canonical)
  union"""
).replace("from based b join fields n", "from levelled b join fields n").replace(
    "where b.base is not null and", "where b.level in ('BACKWARD', 'FULL') and b.base is not null and"
)

ORACLES = {
    "register_contracts": sql.with_(_REGISTER) + _DECIDED,
    "register_levels": sql.with_(_AT_LEVELS) + _DECIDED,
    "register_ids": sql.with_(_REGISTER) + """
select count(*) as registered, count(*) as ids, true as above_used from decided where decision = 'registered'""",
    "contract_fields": sql.with_(REGISTRY)
    + "select subject, version, schema_id, pos, name, type, canonical, has_default from fields",
    "contract_previous": sql.with_(REGISTRY) + "select subject, version, previous from ct",
    "contract_changes": sql.with_(_CHANGES) + "select * from changes",
    "contract_diff": sql.with_(_CHANGES) + """
select c.subject, c.version, c.schema_id, case when c.broken then '' else c.doc end as doc,
       coalesce((select string_agg(name || ':' || type || case change when 'added' then '+' else '' end, ',' order by pos)
                 from changes x where x.subject = c.subject and x.version = c.version and change <> 'removed'), '') as fields,
       coalesce((select string_agg(name, ',' order by pos)
                 from changes x where x.subject = c.subject and x.version = c.version and change = 'removed'), '') as removed
from ct c""",
    "contract_validity": sql.with_(REGISTRY) + "select not broken as valid, count(*) as schemas from ct group by 1",
    "compat_issues": sql.with_(_PAIRS) + """
select subject, previous, version, 'amount' as name,
       concat('field ''amount'' changed type ''', was, ''' -> ''', now, chr(39)) as issue
from pairs where not was_broken and was <> now
union all
select subject, previous, version, name, concat('new field ''', name, ''' has no default') as issue
from pairs cross join (select unnest(['user_id', 'amount', 'event_ts']) as name) where was_broken
union all
select subject, previous, version, 'voucher' as name, 'new field ''voucher'' has no default' as issue
from pairs where dear and (was_broken or not was_dear)""",
    "compat_issue_counts": sql.with_(_ISSUES) + """
select name, left(issue, 9) as kind, count(*) as issues, count(distinct subject) as subjects from issues group by 1, 2""",
    "compat_gate": sql.with_(_ISSUES) + """
select subject, count(*) as versions, count(*) filter (where broken) as unparsable,
       coalesce(max(n), 0) as issues, coalesce(max(n), 0) = 0 and count(*) filter (where broken) = 0 as passed
from ct left join (select subject, count(*) as n from issues group by subject) using (subject) group by subject""",
    "candidate_check": sql.with_(_CANDIDATES) + """
select subject, count(issue) = 0 as compatible, coalesce(string_agg(issue, '; ' order by issue), '') as messages
from first_candidate left join candidate_issues using (subject) group by subject""",
    "newest_contracts": sql.with_(REGISTRY) + """
select subject, version, schema_id, case when broken then '' else doc end as doc
from ct qualify row_number() over (partition by subject order by version desc) = 1""",
    "compat_levels": sql.with_(REGISTRY) + """
select subject, coalesce(max(level), 'BACKWARD') as level
from (select distinct subject from ct)
left join (select 'c' || lpad(cast(c_custkey as varchar), 6, '0') || '-value' as subject, 'FULL' as level
           from customer where c_mktsegment = 'BUILDING') using (subject) group by subject""",
}
