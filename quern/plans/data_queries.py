"""The queries of the core's own data problems (3 and 6), with SQL for a second engine where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import CURRENT_CLASSES, CURRENT_FUNCTIONS
from ..operators import hierarchy, incremental
from ..sources.tables import table


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.function_changes(spark, table(spark, d, "code_functions"), table(spark, d, "code_vectors"), table(spark, d, "sync_runs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_changes(spark, d).where("change = 'insert'").select("id")


def p3_processed(spark: SparkSession, d: str) -> DataFrame:
    return incremental.processed_functions(spark, table(spark, d, "code_functions"), table(spark, d, "code_vectors"), table(spark, d, "sync_runs"))


def p6_hierarchy(spark: SparkSession, d: str, task_nodes: int = hierarchy.TASK_NODES) -> DataFrame:
    out = hierarchy.class_hierarchy(table(spark, d, "code_classes"), task_nodes)
    return out.select(F.col("node").alias("seq"), F.col("parent").alias("parent_seq"), F.col("root").alias("root_seq"), "kind", "depth", "path")


def p6_fragments(spark: SparkSession, d: str) -> DataFrame:
    """As p6_hierarchy, with tasks so small that quotients are contracted again, level by level."""
    return p6_hierarchy(spark, d, max(20, table(spark, d, "code_classes").count() // 40))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.class_hierarchy(table(spark, d, "code_classes")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_hierarchy(spark, d).where("parent_seq is not null").select("seq", "root_seq")


QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p3_processed": p3_processed, "p6_found": p6_found, "p6_hierarchy": p6_hierarchy, "p6_fragments": p6_fragments, "p6_descendants": p6_descendants}

_TIDY = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_STATES = f"""
with ok as (
  select run_id from (select run_id, {_TIDY.format('status')} st, row_number() over (partition by run_id order by attempt desc nulls last, finished_at desc nulls last, {_TIDY.format('status')} desc nulls last) rn from sync_runs)
  where rn = 1 and st in ('ok', 'success')),
stored as (
  select id, hash from (select id, {_TIDY.format('content_hash')} hash, row_number() over (partition by id order by updated_at desc nulls last, vec_id desc) rn
  from code_vectors where run_id in (select run_id from ok) and id is not null) where rn = 1),
cur as (select repo || ':' || clean_path || ':' || coalesce(class_name || '.', '') || name as id, sha256(code) as hash from ({CURRENT_FUNCTIONS}))
"""

#: The state after a part of the functions: their current rows over what was there before.
_PART = CURRENT_FUNCTIONS.replace("from code_functions", "from (select * from code_functions where modified_at is null or epoch_us(modified_at) <= (select min(epoch_us(modified_at)) + (max(epoch_us(modified_at)) - min(epoch_us(modified_at))) // 3 from code_functions))")
_EARLY = f"""{_STATES.rstrip()},
early as (select repo || ':' || clean_path || ':' || coalesce(class_name || '.', '') || name as id, sha256(code) as hash from ({_PART})),
before as (select id, hash from early where id is not null union all select id, hash from stored where id not in (select id from early where id is not null))
"""

_PARENTS = f"""
with recursive cur as ({CURRENT_CLASSES}),
b as (select seq, repo, clean_path, unnest(bases) base, generate_subscripts(bases, 1) pos from cur),
w as (select seq, repo, clean_path, pos, trim(regexp_replace(string_split(regexp_replace(regexp_extract(base, '^([^\\[<]*)', 1), '^\\s+|\\s+$', '', 'g'), '.')[-1], '^\\s+|\\s+$', '', 'g')) nm
      from b where base is not null and not contains(base, '=')),
one as (select repo, name, min(seq) only_seq from cur group by repo, name having count(*) = 1),
f as (select w.seq, w.pos, coalesce(h.seq, o.only_seq) p from w
      left join cur h on h.repo is not distinct from w.repo and h.clean_path is not distinct from w.clean_path and h.name = w.nm
      left join one o on o.repo is not distinct from w.repo and o.name = w.nm),
par as (select seq, arg_min(p, pos) parent_seq from f where p is not null group by seq),
walk as (
  select seq, parent_seq at_seq, [seq, parent_seq] path, seq = parent_seq looped from par
  union all
  select walk.seq, par.parent_seq, list_append(walk.path, par.parent_seq), list_contains(walk.path, par.parent_seq)
  from walk join par on par.seq = walk.at_seq where not walk.looped),
fin as (select seq, arg_max(path, len(path)) path, bool_or(looped) looped from walk group by seq)
"""

ORACLES = {
    "p3_found": _STATES + "select cur.id from cur left join stored on stored.id = cur.id where stored.id is null or stored.hash is null or cur.hash is null or stored.hash <> cur.hash",
    "p3_changes": _STATES + """select cur.id, cur.hash, 'insert' as change from cur left join stored on stored.id = cur.id where stored.id is null or stored.hash is null or cur.hash is null or stored.hash <> cur.hash
union all select stored.id, stored.hash, 'delete' from stored join cur on stored.id = cur.id where stored.hash is null or cur.hash is null or stored.hash <> cur.hash""",
    "p3_processed": _EARLY + """select early.id, early.hash from early left join stored on stored.id = early.id where early.id is null or stored.hash is null or early.hash is null or stored.hash <> early.hash
union all select cur.id, cur.hash from cur left join before on before.id = cur.id where cur.id is null or before.hash is null or cur.hash is null or before.hash <> cur.hash""",
    "p6_hierarchy": _PARENTS + """, hier as (select c.seq, p.parent_seq, case when f.seq is null then c.seq when f.looped then list_min(f.path[list_position(f.path, f.path[-1]):]) else f.path[-1] end as root_seq,
  case when f.seq is null then 'root' when not f.looped then 'tree' when f.path[-1] = c.seq then 'cycle' else 'below' end as kind,
  case when f.seq is null or f.looped and f.path[-1] = c.seq then [c.seq] when f.looped then list_reverse(f.path[1:list_position(f.path, f.path[-1])]) else list_reverse(f.path) end as path
  from cur c left join fin f on f.seq = c.seq left join par p on p.seq = c.seq)
select seq, parent_seq, root_seq, kind, len(path) - 1 as depth, path from hier""",
    "p6_descendants": _PARENTS + """, hier as (select c.seq, case when f.seq is null or f.looped and f.path[-1] = c.seq then [c.seq] when f.looped then f.path[1:list_position(f.path, f.path[-1])] else f.path end as up from cur c left join fin f on f.seq = c.seq)
select ancestor, descendant, distance from (select seq as descendant, unnest(up[2:]) as ancestor, generate_subscripts(up[2:], 1) as distance from hier where len(up) > 1)""",
    "p6_found": _PARENTS + """select seq, case when looped then list_min(path[list_position(path, path[-1]):]) else path[-1] end as root_seq from fin""",
}
ORACLES["p6_fragments"] = ORACLES["p6_hierarchy"]
