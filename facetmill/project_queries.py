"""Queries that run the stages themselves, graph to reports, on a project made of star-schema tables.

Nations are classes, one file each; their customers are fields, methods and
constructors of that class and their suppliers its methods; orders are relations,
of which some fail in each way that a relation can. A nation's group is its key
modulo five, so relations inside a group stay inside a nation and the components
are known to SQL: a nation with all its members, and each customer whose key
ends in 0 alone. All pairs are merged (thresholds of 0), so a group is one cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill import shared
from facetmill.config import ENTITY_TYPES, RELATION_TYPES, RESOLUTION, STOP_WORDS, AggregationConfig
from facetmill.operators import profile
from facetmill.operators.facts import Facts
from facetmill.plans import reports
from facetmill.plans.pipeline import Analysis
from facetmill.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ALL = AggregationConfig(minimum_evidence_families=0, pairwise_merge_threshold=0.0, cluster_cohesion_threshold=0.0)
SIGNATURES = ["A", "A|B", "B", "A|B|C|D|E", "C|D"]
LINES, CODE = 400, 100

ENTITIES = f"""
select 'N' || n_nationkey as entity_id, 'CLASS' as entity_type, n_name as simple_name, 'w.N' || n_nationkey as qualified_name, n_nationkey as n, 1 as start_line, 900 as end_line, 'B' || n_nationkey || '-0' as block_id, array('A', 'E') as observed_products from nation
union all select 'C' || c_custkey, case c_custkey % 3 when 0 then 'FIELD' when 1 then 'METHOD' else 'CONSTRUCTOR' end, c_mktsegment, case when c_custkey % 10 <> 0 then 'w.N' || c_nationkey || '.C' || c_custkey end,
  c_nationkey, cast(1 + c_custkey % {LINES} as int), cast(6 + c_custkey % {LINES} as int), 'B' || c_nationkey || case when c_custkey % 100 = 1 then '-4' else '-' || cast((1 + c_custkey % {LINES}) div {CODE} as string) end, case when c_custkey % 2 = 0 then array('A', 'B') else array('A') end from customer
union all select 'S' || s_suppkey, 'METHOD', 'supplyOrder', 'w.N' || s_nationkey || '.S' || s_suppkey, s_nationkey, cast(300 + s_suppkey % 90 as int), cast(310 + s_suppkey % 90 as int), 'B' || s_nationkey || '-3', array('C') from supplier
"""
RELATIONS = f"""
select 'RC' || c_custkey as relation_id, 'C' || c_custkey as source_entity_id, 'N' || c_nationkey as target_entity_id, 'N' as target_text, 'FIELD_REFERENCE' as relation_type, c_nationkey as n, cast(1 + c_custkey % {LINES} as int) as source_line, array('A') as observed_products, 'RESOLVED_INTERNAL' as resolution_status from customer where c_custkey % 10 <> 0
union all select 'RS' || s_suppkey, 'N' || s_nationkey, 'S' || s_suppkey, 'x"y', 'METHOD_CALL', s_nationkey, cast(300 + s_suppkey % 90 as int), array('C'), 'RESOLVED_INTERNAL' from supplier
union all select 'RO' || o_orderkey, case o_orderkey % 7 when 1 then 'Z' || o_custkey when 2 then '' else 'C' || o_custkey end,
  case o_orderkey % 7 when 0 then null when 3 then 'X' || o_custkey else 'N' || cast((c_nationkey + 1 + o_orderkey % 4) % 25 as string) end, 'o' || o_custkey,
  case when o_orderkey % 7 = 0 then 'EXTENDS' when o_orderkey % 7 = 4 then 'CONSTRUCTOR_CALL' when o_orderkey % 7 = 6 then 'TYPE_REFERENCE' else 'METHOD_CALL' end, c_nationkey, cast(o_orderkey % 3 as int),
  case o_orderstatus when 'O' then array('A') when 'F' then array('B') else array('C') end,
  case when o_orderkey % 7 <> 0 then 'RESOLVED_INTERNAL' when o_orderpriority = '1-URGENT' then 'RESOLVED_EXTERNAL' when o_orderpriority = '2-HIGH' then 'AMBIGUOUS' when o_orderpriority = '3-MEDIUM' then 'RESOLVED_INTERNAL' else 'UNRESOLVED' end from orders join customer on o_custkey = c_custkey
"""


class Project(Analysis):
    """An analysis whose facts and blocks are given; every later stage is the library's own."""

    def __init__(self, spark: SparkSession, sf: str):
        super().__init__(spark.createDataFrame([], "path string, src string"), ALL)
        tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "customer", "supplier", "orders")}

        def made(sql: str, name: str) -> DataFrame:
            used = {t: df for t, df in tables.items() if f"from {t}" in sql or f"join {t}" in sql}
            for t in used:
                sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
            placed = spark.sql(sql, **used).withColumn("r", F.col("n") % 5)
            named = {"file": F.concat(F.lit("/n/"), F.col("n").cast("string")), "group_id": F.concat(F.lit("G"), (F.col("r") + 1).cast("string")), "signature": F.element_at(F.array(*map(F.lit, SIGNATURES)), F.col("r").cast("int") + 1)}
            return shared.stored(placed.withColumns(named), name)

        entities = made(ENTITIES, "entities").withColumn("resolution_status", F.when(F.col("qualified_name").isNull(), "UNRESOLVED").otherwise("RESOLVED_INTERNAL")).drop("n", "r")
        relations = made(RELATIONS, "relations").withColumn("block_id", F.concat(F.lit("B"), F.col("n").cast("string"), F.lit("-"), F.expr(f"cast(source_line div {CODE} as string)"))).drop("n", "r")
        blocks = made("select n_nationkey as n, 'B' || n_nationkey || '-' || k as block_id, case when k % 2 = 0 then 'IF' else 'ELIF' end as directive, cast(k * 100 as int) as start_line, cast(k * 100 + 99 as int) as end_line from nation lateral view explode(sequence(0, 5)) v as k", "blocks").drop("n", "r")
        groups = blocks.groupBy("group_id", "signature").agg(F.count("*").alias("block_count")).withColumn("ids", F.split("signature", r"\|"))
        failures = spark.createDataFrame([], "file string, product string, line int, message string, extraction_skipped boolean")
        stats = entities.agg(F.countDistinct("file").alias("parsed_files"), F.count("*").alias("attempts"), F.count_if(F.col("entity_type") == "CLASS").alias("successes"))
        self.__dict__ |= {"facts": Facts(entities, relations, failures, stats), "_grouped": (shared.stored(groups, "groups"), blocks)}


_MADE: dict[tuple, Analysis] = {}


def _kept(spark: SparkSession, sf: str, tables: tuple[str, ...], what: str, make: Callable[[], Analysis]) -> Analysis:
    """What was made of these very files in this application, or else made now; changed files make it anew."""
    files: list = []
    for t in tables:
        f = spark.read.parquet(f"{sf}/{t}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        files += sorted(map(tuple, f.distinct().collect()))
    key = (spark.sparkContext.applicationId, what, tuple(files))
    if (a := _MADE.get(key)) is not None:
        try:
            a.facts.entities.limit(1).count()
            return a
        except Exception:  # what was stored is gone
            pass
    _MADE[key] = make()
    return _MADE[key]


def project(spark: SparkSession, sf: str, config: AggregationConfig = ALL) -> Analysis:
    """The project of a folder of tables; its stages, once made, serve all queries of an application."""
    tables = ("nation", "customer", "supplier", "orders")
    base = _kept(spark, sf, tables, "project", lambda: Project(spark, sf))
    if config == ALL:
        return base
    return _kept(spark, sf, tables, repr(config), lambda: base.by(config))


_STEM = "CASE WHEN w LIKE '%ies' AND len(w) > 4 THEN left(w, len(w) - 3) || 'y' WHEN w LIKE '%ing' AND len(w) > 5 THEN left(w, len(w) - 3) WHEN w LIKE '%s' AND len(w) > 3 THEN left(w, len(w) - 1) ELSE w END"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(text: str) -> str:
    """The list of tokens of a text."""
    split = r"regexp_split_to_array(replace(regexp_replace(regexp_replace(fr, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '_', ' '), '\s+')"
    words = f"list_transform(list_filter(flatten(list_transform(list_filter(regexp_split_to_array({text}, '[^A-Za-z0-9]+'), lambda f: f <> ''), lambda fr: {split})), lambda w: trim(w) <> ''), lambda w: lower(w))"
    return f"list_filter(list_transform({words}, lambda w: {_STEM}), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({_STOP}))"


def _two(prefix: str, group: str, n: str) -> str:
    return f"'{prefix}' || {group} || '-' || CASE WHEN {n} < 10 THEN '0' ELSE '' END || {n}"


def _duck(sql: str) -> str:
    return sql.replace("array(", "list_value(").replace(" div ", " // ").replace("as string", "as varchar")


#: The project's facts and stages in SQL, each a table of its own.
STAGES = f"""WITH sig AS (SELECT unnest(range(5)) AS r, unnest({SIGNATURES!r}) AS signature),
e0 AS ({_duck(ENTITIES)}), r0 AS ({_duck(RELATIONS)}),
ent AS (SELECT e0.*, '/n/' || n AS file, 'G' || (n % 5 + 1) AS group_id, signature, CASE WHEN qualified_name IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED_INTERNAL' END AS resolution_status, CASE WHEN qualified_name IS NULL THEN entity_id ELSE 'N' || n END AS comp FROM e0 JOIN sig ON n % 5 = r),
rel AS (SELECT r0.*, '/n/' || n AS file, 'G' || (n % 5 + 1) AS group_id, signature, 'B' || n || '-' || (source_line // {CODE}) AS block_id FROM r0 JOIN sig ON n % 5 = r),
blk AS (SELECT 'B' || n_nationkey || '-' || k AS block_id, CASE WHEN k % 2 = 0 THEN 'IF' ELSE 'ELIF' END AS directive, k * 100 AS start_line, k * 100 + 99 AS end_line, '/n/' || n_nationkey AS file, 'G' || (n_nationkey % 5 + 1) AS group_id, signature FROM nation JOIN sig ON n_nationkey % 5 = r, (SELECT unnest(range(6)) AS k)),
why AS (SELECT rel.*, s.file AS s_file, s.group_id AS s_group, s.signature AS s_sig, t.file AS t_file, t.group_id AS t_group, t.signature AS t_sig,
  CASE WHEN trim(coalesce(source_entity_id, '')) = '' THEN 'missing source entity' WHEN s.entity_id IS NULL THEN 'source entity not found'
    WHEN trim(coalesce(target_entity_id, '')) = '' THEN CASE rel.resolution_status WHEN 'RESOLVED_EXTERNAL' THEN 'external target' WHEN 'AMBIGUOUS' THEN 'ambiguous target' WHEN 'UNRESOLVED' THEN 'unresolved target' ELSE 'missing internal target' END
    WHEN t.entity_id IS NULL THEN 'target entity not found' WHEN relation_type = 'CONSTRUCTOR_CALL' AND t.entity_type <> 'CONSTRUCTOR' THEN 'invalid constructor target type' END AS failure_reason
  FROM rel LEFT JOIN ent s ON source_entity_id = s.entity_id LEFT JOIN ent t ON target_entity_id = t.entity_id),
edge AS (SELECT 'D' || row_number() OVER (ORDER BY concat_ws('|', source_file, source_line, relation_type, source_entity_id, target_entity_id)) AS edge_id, *, source_file <> target_file AS cross_file
  FROM (SELECT source_entity_id, target_entity_id, relation_type, file AS source_file, source_line, t_file AS target_file, block_id AS source_block_id, s_group AS source_group_id, s_sig AS source_signature, t_group AS target_group_id, t_sig AS target_signature, list_sort(list_distinct(flatten(list(observed_products)))) AS observed_products
        FROM why WHERE failure_reason IS NULL GROUP BY ALL HAVING true)),
firsts AS (SELECT group_id, comp, file, start_line, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, comp ORDER BY file, start_line, entity_id) AS k FROM ent) WHERE k = 1),
fec AS (SELECT group_id, comp, n, {_two('FEC-', 'group_id', 'n')} AS candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY concat_ws('|', file, start_line, entity_id)) AS n FROM firsts)),
mem AS (SELECT ent.*, candidate_id FROM ent JOIN fec USING (group_id, comp)),
hit AS (SELECT edge.*, s.candidate_id AS s_cand, t.candidate_id AS t_cand FROM edge JOIN mem s ON source_entity_id = s.entity_id JOIN mem t ON target_entity_id = t.entity_id),
inn AS (SELECT *, s_cand AS candidate_id FROM hit WHERE s_cand = t_cand AND source_group_id = target_group_id), acr AS (SELECT * FROM hit WHERE s_cand <> t_cand),
cov AS (SELECT candidate_id, block_id FROM mem JOIN blk USING (group_id, block_id) UNION SELECT candidate_id, blk.block_id FROM mem JOIN blk ON mem.group_id = blk.group_id AND mem.file = blk.file AND mem.start_line BETWEEN blk.start_line AND blk.end_line
  UNION SELECT s_cand, source_block_id FROM hit JOIN blk ON source_group_id = blk.group_id AND source_block_id = blk.block_id WHERE source_group_id = target_group_id),
lone AS (SELECT blk.*, coalesce(base, 0) + row_number() OVER (PARTITION BY blk.group_id ORDER BY file, start_line, directive) AS n FROM blk LEFT JOIN (SELECT group_id, max(n) AS base FROM fec GROUP BY ALL) b ON b.group_id = blk.group_id WHERE block_id NOT IN (SELECT block_id FROM cov)),
cand0 AS (SELECT candidate_id, group_id, false AS block_only FROM fec UNION ALL SELECT {_two('FEC-', 'group_id', 'n')}, group_id, true FROM lone),
cblk AS (SELECT candidate_id, blk.* FROM cov JOIN blk USING (block_id) UNION ALL SELECT {_two('FEC-', 'group_id', 'n')}, * EXCLUDE (n) FROM lone),
cand AS (SELECT c.candidate_id, c.group_id, g.signature, coalesce(entity_count, 0) AS entity_count, coalesce(block_count, 0) AS block_count, coalesce(ie, 0) AS internal_edge_count, coalesce(xe, 0) AS cross_file_internal_edge_count, coalesce(ic, 0) AS incoming_edge_count, coalesce(oc, 0) AS outgoing_edge_count,
    coalesce(files, []) AS files, coalesce(products, list_sort(string_split(g.signature, '|'))) AS observed_products, min_file, min_line,
    CASE WHEN block_only THEN 'BLOCK_ONLY' WHEN entity_count = 1 AND coalesce(ie, 0) = 0 THEN 'ISOLATED_ENTITY' WHEN entity_count > 0 THEN 'STRUCTURALLY_CONNECTED' ELSE 'UNCLASSIFIED' END AS classification_status
  FROM cand0 c JOIN (SELECT DISTINCT group_id, signature FROM blk) g USING (group_id)
  LEFT JOIN (SELECT candidate_id, count(*) AS entity_count, min(file) AS min_file, min(start_line) AS min_line, list_sort(list_distinct(flatten(list(observed_products)))) AS products FROM mem GROUP BY ALL) USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, count(*) AS block_count FROM cblk GROUP BY ALL) USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, list_sort(list(DISTINCT file)) AS files FROM (SELECT candidate_id, file FROM mem UNION SELECT candidate_id, file FROM cblk) GROUP BY ALL) USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, count(*) AS ie, count(*) FILTER (cross_file) AS xe FROM inn GROUP BY ALL) USING (candidate_id)
  LEFT JOIN (SELECT t_cand AS candidate_id, count(*) AS ic FROM acr GROUP BY ALL) USING (candidate_id) LEFT JOIN (SELECT s_cand AS candidate_id, count(*) AS oc FROM acr GROUP BY ALL) USING (candidate_id)),
dep AS (SELECT source_candidate_id, target_candidate_id, relation_type, count(*) AS edge_count, count(*) FILTER (cross_file) AS cross_file_edge_count, CASE WHEN source_candidate_id = target_candidate_id THEN 'INTERNAL_CANDIDATE' WHEN s.group_id = t.group_id THEN 'INTRA_SIGNATURE_INTER_CANDIDATE' ELSE 'CROSS_SIGNATURE' END AS dependency_scope,
    s.group_id AS source_group_id, s.signature AS source_signature, t.group_id AS target_group_id, t.signature AS target_signature
  FROM (SELECT s_cand AS source_candidate_id, t_cand AS target_candidate_id, relation_type, cross_file FROM inn UNION ALL SELECT s_cand, t_cand, relation_type, cross_file FROM acr) JOIN cand s ON source_candidate_id = s.candidate_id JOIN cand t ON target_candidate_id = t.candidate_id GROUP BY ALL),
src AS (SELECT candidate_id, entity_id AS source_entity_id, 0 AS phase, file, start_line AS line, '' AS k1, entity_id AS k2, 0 AS k3, CASE WHEN entity_type IN ('CLASS', 'INTERFACE', 'CONSTRUCTOR') THEN 'TYPE_NAME' WHEN entity_type = 'METHOD' THEN 'METHOD_NAME' ELSE 'FIELD_NAME' END AS provenance, simple_name AS t FROM mem
  UNION ALL SELECT candidate_id, entity_id, 0, file, start_line, '', entity_id, 1, 'IDENTIFIER', qualified_name FROM mem
  UNION ALL SELECT candidate_id, source_entity_id, 1, source_file, source_line, relation_type, source_entity_id || '|' || target_entity_id, 0, 'IDENTIFIER', relation_type FROM inn),
ev AS (SELECT candidate_id, source_entity_id, token, provenance, row_number() OVER (PARTITION BY candidate_id ORDER BY phase, file, line, k1, k2, k3, tok_pos) AS pos FROM (SELECT *, unnest(toks) AS token, generate_subscripts(toks, 1) AS tok_pos FROM (SELECT *, {_tokens('t')} AS toks FROM src WHERE t IS NOT NULL))),
afec AS (SELECT candidate_id, group_id, {_two('AFEC-', 'group_id', '1')} AS cluster FROM cand),
freq AS (SELECT cluster, token, count(*) AS n FROM ev JOIN afec USING (candidate_id) GROUP BY ALL),
top8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, token) AS k FROM freq) WHERE k <= 8),
tops AS (SELECT cluster, list(token ORDER BY k) AS top, list(token || ':' || n ORDER BY k) AS counted FROM top8 GROUP BY cluster),
agg AS (SELECT cluster AS candidate_id, afec.group_id, first(signature) AS signature, count(*) AS component_count, sum(entity_count) AS entity_count, sum(internal_edge_count) AS internal_edge_count, sum(cross_file_internal_edge_count) AS cross_file_internal_edge_count, list_sort(list_distinct(flatten(list(files)))) AS files, list_sort(list(candidate_id)) AS component_ids FROM cand JOIN afec USING (candidate_id) GROUP BY ALL),
acand AS (SELECT a.*, coalesce(top, []) AS representative_tokens, coalesce(block_ids, []) AS block_ids, coalesce(ic, 0) AS incoming_edge_count, coalesce(oc, 0) AS outgoing_edge_count,
    CASE WHEN signature = (SELECT array_to_string(list_sort(list_distinct(flatten(list(string_split(signature, '|'))))), '|') FROM sig) THEN 'FULL_COMMONALITY' WHEN contains(signature, '|') THEN 'SUBGROUP_COMMONALITY' ELSE 'VARIABLE_SIGNATURE' END AS commonality,
    CASE len(coalesce(top, [])) WHEN 0 THEN '' WHEN 1 THEN upper(left(top[1], 1)) || substr(top[1], 2) || ' related code' ELSE upper(left(top[1], 1)) || substr(top[1], 2) || ' ' || top[2] || ' behavior' END AS suggested_label,
    CASE WHEN len(coalesce(top, [])) = 0 THEN 'UNLABELED' WHEN len(top) >= 3 AND component_count > 1 THEN 'HIGH' WHEN len(top) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS label_confidence
  FROM agg a LEFT JOIN tops ON a.candidate_id = cluster LEFT JOIN (SELECT cluster, list_sort(list(DISTINCT block_id)) AS block_ids FROM cblk JOIN afec USING (candidate_id) GROUP BY ALL) b ON b.cluster = a.candidate_id
  LEFT JOIN (SELECT t_group, count(*) AS ic FROM (SELECT target_group_id AS t_group FROM acr WHERE source_group_id <> target_group_id) GROUP BY ALL) ON t_group = a.group_id LEFT JOIN (SELECT s_group, count(*) AS oc FROM (SELECT source_group_id AS s_group FROM acr WHERE source_group_id <> target_group_id) GROUP BY ALL) ON s_group = a.group_id),
aggregated AS (SELECT *, CASE WHEN component_count > 1 AND label_confidence IN ('HIGH', 'MEDIUM') THEN 'HIGH' WHEN label_confidence = 'MEDIUM' THEN 'MEDIUM' WHEN label_confidence = 'LOW' THEN 'LOW' ELSE 'UNRESOLVED' END AS candidate_confidence FROM acand),
amem AS (SELECT cluster, mem.* FROM mem JOIN afec USING (candidate_id)), ainn AS (SELECT cluster, inn.* FROM inn JOIN afec USING (candidate_id)),
deg AS (SELECT cluster, node, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT cluster, source_entity_id AS node, 0 AS i, 1 AS o FROM ainn UNION ALL SELECT cluster, target_entity_id, 1, 0 FROM ainn
  UNION ALL SELECT 'AFEC-' || target_group_id || '-01', target_entity_id, 1, 0 FROM acr WHERE source_group_id <> target_group_id UNION ALL SELECT 'AFEC-' || source_group_id || '-01', source_entity_id, 0, 1 FROM acr WHERE source_group_id <> target_group_id) GROUP BY ALL),
imp AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score, degree DESC, file, start_line, entity_id) AS rank FROM (SELECT amem.*, coalesce(in_degree, 0) + coalesce(out_degree, 0) AS degree, 3 * (coalesce(in_degree, 0) + coalesce(out_degree, 0)) AS score, coalesce(qualified_name, simple_name) AS name FROM amem LEFT JOIN deg ON amem.cluster = deg.cluster AND entity_id = node)),
typed AS (SELECT *, row_number() OVER (PARTITION BY cluster, entity_type ORDER BY rank) AS t_rank FROM imp),
ends AS (SELECT cluster, side, string_agg(coalesce(name, '<external>') || ':' || n, '|' ORDER BY k) AS x, string_agg(CASE WHEN k <= 3 THEN coalesce(name, '<external>') || ':' || n END, '|' ORDER BY k) AS three, '[' || string_agg(coalesce(name, '<external>') || ':' || n, ', ' ORDER BY k) || ']' AS listed
  FROM (SELECT cluster, side, id, n, row_number() OVER (PARTITION BY cluster, side ORDER BY n DESC, id) AS k FROM (SELECT cluster, 't' AS side, target_entity_id AS id, count(*) AS n FROM ainn GROUP BY ALL UNION ALL SELECT cluster, 's', source_entity_id, count(*) FROM ainn GROUP BY ALL)) z LEFT JOIN (SELECT entity_id AS id, coalesce(qualified_name, simple_name) AS name FROM ent) USING (id) WHERE k <= 8 GROUP BY ALL)
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = STAGES + sql
        return f

    return add


_NUMBERS = set("start_line end_line source_line edge_count cross_file_edge_count cross_file entity_count block_count file_count internal_edge_count incoming_edge_count outgoing_edge_count cross_file_internal_edge_count component_count support_count".split())


def _csv(name: str, relation: str, **made: str) -> str:
    """Rows of a report in SQL; ``made`` has columns whose value isn't that of ``relation``."""
    cells = []
    for c, _, s in (x.partition("=") for x in sinks.CSV[name][0].split(",")):
        s = s or c
        if s in _NUMBERS:
            cells.append(f"coalesce(CAST({made.get(s, s)} AS VARCHAR), '')")
        else:
            cells.append(f"""coalesce('"' || replace(CAST({made.get(s, s)} AS VARCHAR), '"', '""') || '"', '')""")
    return f"SELECT '{name}' AS report, {' || chr(44) || '.join(cells)} AS value FROM {relation}"


def _rows(a: Project, *names: str) -> DataFrame:
    out = None
    for n in names:
        made = sinks.csv_rows(a.table(n), n)[1].select(F.lit(n).alias("report"), "value")
        out = made if out is None else out.union(made)
    return out


_P = "array_to_string(observed_products, '|')"


@query(" UNION ALL ".join([_csv("entities", "ent", observed_products=_P), _csv("relations", "rel", observed_products=_P)]))
def snk1_snk2_facts_csv(spark, sf):
    return _rows(project(spark, sf), "entities", "relations")


@query(" UNION ALL ".join([_csv("dependency-nodes", "ent", observed_products=_P), _csv("dependency-edges", "edge", observed_products=_P, resolution_status="'RESOLVED_INTERNAL'"), _csv("unresolved-relations", "why WHERE failure_reason IS NOT NULL", observed_products=_P),
    _csv("group-dependencies", "(SELECT source_group_id, target_group_id, relation_type, count(*) AS edge_count, count(*) FILTER (cross_file) AS cross_file_edge_count FROM edge GROUP BY ALL)")]))
def snk3_4_5_6_gra1_join3_join4_fil9_fil10_fil11_agg5_agg6_win4_graph_csv(spark, sf):
    return _rows(project(spark, sf), "dependency-nodes", "dependency-edges", "unresolved-relations", "group-dependencies")


_MEMBERS = """(SELECT candidate_id, 'ENTITY' AS member_type, entity_id AS member_id, entity_type, qualified_name, file, start_line, end_line, block_id, group_id, signature FROM mem
UNION ALL SELECT candidate_id, 'BLOCK', block_id, '', '', file, start_line, end_line, block_id, group_id, signature FROM cblk
UNION ALL SELECT candidate_id, 'INTERNAL_DEPENDENCY', edge_id, relation_type, source_entity_id || '->' || target_entity_id, source_file, source_line, source_line, source_block_id, source_group_id, source_signature FROM inn)"""


@query(" UNION ALL ".join([_csv("feature-effect-candidates", "cand", observed_products=_P, file_count="len(files)"), _csv("feature-effect-members", _MEMBERS), _csv("candidate-dependencies", "dep")]))
def snk7_8_9_10_gra2_3_4_join12_13_14_15_fil3_4_5_12_13_agg7_8_win5_set1_set5_components_csv(spark, sf):
    return _rows(project(spark, sf), "feature-effect-candidates", "feature-effect-members", "candidate-dependencies", "unassigned-blocks")


_A_MEMBERS = """(SELECT candidate_id, 'STRUCTURAL_COMPONENT' AS member_type, unnest(component_ids) AS member_id, NULL AS entity_type, NULL AS qualified_name, NULL AS file, NULL AS start_line, NULL AS end_line, '' AS block_id, group_id, signature FROM aggregated
UNION ALL SELECT cluster, 'ENTITY', entity_id, entity_type, qualified_name, file, start_line, end_line, block_id, group_id, signature FROM amem
UNION ALL SELECT candidate_id, 'BLOCK', block_id, NULL, NULL, NULL, NULL, NULL, block_id, group_id, signature FROM (SELECT candidate_id, group_id, signature, unnest(block_ids) AS block_id FROM aggregated))"""
_LABELS = """(SELECT a.candidate_id, suggested_label, label_confidence, representative_tokens, coalesce(said, '') AS representative_token_evidence, coalesce(first5, '') AS representative_entities FROM aggregated a
LEFT JOIN (SELECT cluster, string_agg(coalesce(qualified_name, simple_name), '|' ORDER BY k) AS first5 FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY file, start_line, entity_id) AS k FROM amem) WHERE k <= 5 GROUP BY ALL) m ON m.cluster = a.candidate_id
LEFT JOIN (SELECT cluster, string_agg(token || ':' || provenance || ':' || source_entity_id, '|' ORDER BY k) AS said FROM (SELECT cluster, token, provenance, source_entity_id, row_number() OVER (PARTITION BY cluster ORDER BY candidate_id, pos) AS k FROM ev JOIN afec USING (candidate_id) JOIN top8 USING (cluster, token)) WHERE k <= 12 GROUP BY ALL) e ON e.cluster = a.candidate_id)"""
_LIST = {"representative_tokens": "array_to_string(representative_tokens, '|')"}
_CONCERNS = "CASE WHEN candidate_confidence = 'UNRESOLVED' THEN 'insufficient evidence for semantic aggregation or descriptive label' ELSE '' END"


@query(" UNION ALL ".join([_csv("aggregated-feature-effect-candidates", "aggregated", block_count="len(block_ids)", file_count="len(files)", unresolved_concerns=_CONCERNS, **_LIST), _csv("aggregated-feature-effect-members", _A_MEMBERS),
    _csv("candidate-labels", _LABELS, representative_strings="''", explanation="'label derived from representative code identifier tokens'", **_LIST),
    _csv("unassigned-components", "(SELECT cand.* FROM cand JOIN afec USING (candidate_id) JOIN aggregated a ON a.candidate_id = cluster WHERE a.candidate_confidence = 'UNRESOLVED')", reason="'insufficient semantic aggregation evidence'")]))
def snk11_12_15_16_clu3_win6_fil6_fil8_agg12_map1_lab1_2_3_4_set2_aggregation_csv(spark, sf):
    return _rows(project(spark, sf), "aggregated-feature-effect-candidates", "aggregated-feature-effect-members", "candidate-labels", "unassigned-components")


#: Reports by the relation that _csv reads, and the order of their rows in SQL.
_FILES = {
    "entities": (_csv("entities", "ent", observed_products=_P), "file, start_line, entity_type, coalesce(qualified_name, '')"),
    "relations": (_csv("relations", "rel", observed_products=_P), "file, source_line, relation_type, coalesce(target_text, '')"),
    "dependency-nodes": (_csv("dependency-nodes", "ent", observed_products=_P), "file, start_line, entity_type, coalesce(qualified_name, '')"),
    "dependency-edges": (_csv("dependency-edges", "edge", observed_products=_P, resolution_status="'RESOLVED_INTERNAL'"), "source_file, source_line, relation_type, source_entity_id, target_entity_id"),
    "unresolved-relations": (_csv("unresolved-relations", "why WHERE failure_reason IS NOT NULL", observed_products=_P), "file, source_line, relation_type, coalesce(source_entity_id, ''), coalesce(target_text, '')"),
    "feature-effect-candidates": (_csv("feature-effect-candidates", "cand", observed_products=_P, file_count="len(files)"), "group_id, coalesce(min_file, ''), min_line NULLS FIRST, candidate_id"),
    "candidate-dependencies": (_csv("candidate-dependencies", "dep"), "source_candidate_id, target_candidate_id, dependency_scope, relation_type"),
    "aggregated-feature-effect-candidates": (_csv("aggregated-feature-effect-candidates", "aggregated", block_count="len(block_ids)", file_count="len(files)", unresolved_concerns=_CONCERNS, **_LIST), "group_id, coalesce(files[1], ''), component_ids[1], candidate_id"),
    "candidate-labels": (_csv("candidate-labels", _LABELS, representative_strings="''", explanation="'label derived from representative code identifier tokens'", **_LIST), "candidate_id"),
}


def _lines(name: str) -> str:
    sql, order = _FILES[name]
    head = ",".join(c.partition("=")[0] for c in sinks.CSV[name][0].split(","))
    select, relation = sql.split(" AS value FROM ", 1)
    value = select.split(" AS report, ", 1)[1]
    return f"SELECT '{name}' AS report, CAST(0 AS BIGINT) AS n, '{head}' AS value UNION ALL SELECT '{name}', row_number() OVER (ORDER BY {order}, {value}), {value} FROM {relation}"


@query(" UNION ALL ".join(map(_lines, _FILES)))
def ord1_to_ord5_snk_order_of_report_files(spark, sf):
    """Lines of report files, read back with their places: header, order and end are the sink's own."""
    a, at, out = project(spark, sf), f"{shared.shared_dir(spark)}/reports-{uuid.uuid4().hex}", None
    for name in _FILES:
        sinks.write_csv(a.table(name), name, at)
        made = sinks.read_lines(spark, f"{at}/{name}.csv").select(F.lit(name).alias("report"), "n", "value")
        out = made if out is None else out.union(made)
    return out


#: Thresholds that some pairs and members fail; isolated components don't merge in the second.
REAL = AggregationConfig(cluster_cohesion_threshold=0.5)
STRICT = AggregationConfig(cluster_cohesion_threshold=0.6, aggregate_isolated_entities=False, minimum_evidence_families=3)

_J = "max(CASE WHEN kind = '{0}' THEN j END) AS {0}"
_SIMILAR = f""",
cs AS (SELECT candidate_id AS id, group_id, signature, classification_status, coalesce(files[1], '') AS f, coalesce(min_line, 2147483647) AS l FROM cand),
pr AS (SELECT x.group_id, x.id AS a, y.id AS b, x.classification_status AS a_class, y.classification_status AS b_class FROM cs x JOIN cs y ON x.group_id = y.group_id AND (x.f < y.f OR x.f = y.f AND (x.l < y.l OR x.l = y.l AND x.id < y.id))),
tf AS (SELECT candidate_id AS id, token, count(*) AS n FROM ev GROUP BY ALL), tt AS (SELECT id, sum(n) AS n FROM tf GROUP BY id),
tw AS (SELECT a, b, sum(least(p.n, q.n)) AS w FROM pr JOIN tf p ON p.id = a JOIN tf q ON q.id = b AND q.token = p.token GROUP BY ALL),
qn AS (SELECT candidate_id AS id, qualified_name AS q, string_split(qualified_name, '.') AS parts FROM mem WHERE qualified_name IS NOT NULL),
el AS (SELECT id, 'packages' AS kind, CASE WHEN contains(q, '.') THEN regexp_extract(q, '^(.*)\\.[^.]*$', 1) ELSE '' END AS x FROM qn UNION SELECT id, 'classes', CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE q END FROM qn UNION SELECT candidate_id, 'files', unnest(files) FROM cand UNION SELECT candidate_id, 'block_ids', block_id FROM cblk
  UNION SELECT candidate_id, 'neighbors', target_entity_id FROM inn UNION SELECT t_cand, 'neighbors', source_entity_id FROM acr UNION SELECT s_cand, 'neighbors', target_entity_id FROM acr),
es AS (SELECT id, kind, count(*) AS n FROM el GROUP BY ALL), ec AS (SELECT a, b, p.kind, count(*) AS c FROM pr JOIN el p ON p.id = a JOIN el q ON q.id = b AND q.kind = p.kind AND q.x = p.x GROUP BY ALL),
ej AS (SELECT a, b, {', '.join(_J.format(k) for k in ('packages', 'classes', 'files', 'neighbors', 'block_ids'))} FROM (SELECT a, b, ec.kind, CAST(c AS DOUBLE) / (p.n + q.n - c) AS j FROM ec JOIN es p ON p.id = a AND p.kind = ec.kind JOIN es q ON q.id = b AND q.kind = ec.kind) GROUP BY a, b),
dc AS (SELECT DISTINCT least(s_cand, t_cand) AS lo, greatest(s_cand, t_cand) AS hi FROM acr),
sm0 AS (SELECT pr.*, CASE WHEN coalesce(ta.n, 0) + coalesce(tb.n, 0) - coalesce(w, 0) > 0 THEN CAST(coalesce(w, 0) AS DOUBLE) / (coalesce(ta.n, 0) + coalesce(tb.n, 0) - coalesce(w, 0)) ELSE 0.0::DOUBLE END AS lexical, (coalesce(packages, 0) + coalesce(classes, 0) + coalesce(files, 0)) / 3.0::DOUBLE AS context,
    coalesce(neighbors, 0.0::DOUBLE) AS neighborhood, CASE WHEN lo IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS direct, coalesce(block_ids, 0.0::DOUBLE) AS block
  FROM pr LEFT JOIN tw USING (a, b) LEFT JOIN tt ta ON ta.id = a LEFT JOIN tt tb ON tb.id = b LEFT JOIN ej USING (a, b) LEFT JOIN dc ON lo = least(a, b) AND hi = greatest(a, b)),
sm AS (SELECT *, 0.35 * lexical + 0.2 * context + 0.2 * neighborhood + 0.15 * direct + 0.1 * block AS combined, list_filter([CASE WHEN lexical >= 0.2 THEN 'lexical' END, CASE WHEN context >= 0.3 THEN 'contextual' END, CASE WHEN neighborhood >= 0.2 THEN 'neighborhood' END, CASE WHEN direct > 0 THEN 'dependency' END, CASE WHEN block >= 0.2 THEN 'block' END], lambda v: v IS NOT NULL) AS support FROM sm0)"""


def _decided(c: AggregationConfig) -> str:
    """Decisions in SQL."""
    isolated = "false" if c.aggregate_isolated_entities else "(a_class = 'ISOLATED_ENTITY' OR b_class = 'ISOLATED_ENTITY')"
    why = f"CASE WHEN {isolated} THEN 'isolated aggregation disabled' WHEN len(support) < {c.minimum_evidence_families} THEN 'insufficient independent evidence families' WHEN combined < {c.pairwise_merge_threshold} THEN 'combined score below threshold' ELSE 'threshold and evidence-family requirements satisfied' END"
    return f"{_SIMILAR}, dec AS (SELECT *, {why} AS reason FROM sm)"


def _clustered(c: AggregationConfig) -> str:
    """Clusters in SQL: components of merged pairs, then members one by one while alike to all accepted."""
    t = c.cluster_cohesion_threshold
    return f"""{_decided(c)}, merged AS (SELECT a, b FROM dec WHERE reason LIKE 'threshold%' UNION SELECT b, a FROM dec WHERE reason LIKE 'threshold%'),
reach AS (SELECT id AS a, id AS b FROM cs UNION SELECT r.a, m.b FROM reach r JOIN merged m ON r.b = m.a), part AS (SELECT a AS id, min(b) AS part FROM reach GROUP BY a),
alike AS (SELECT id, list(o) AS near FROM (SELECT greatest(a, b) AS id, least(a, b) AS o FROM sm WHERE combined >= {t}) GROUP BY id),
ordered AS (SELECT part, part.id, coalesce(near, []) AS near, row_number() OVER (PARTITION BY part ORDER BY part.id) AS k FROM part LEFT JOIN alike USING (id)),
taken AS (SELECT part, CAST(1 AS BIGINT) AS k, [id] AS acc FROM ordered WHERE k = 1 UNION ALL SELECT t.part, t.k + 1, CASE WHEN list_has_all(o.near, t.acc) THEN list_append(t.acc, o.id) ELSE t.acc END FROM taken t JOIN ordered o ON o.part = t.part AND o.k = t.k + 1),
last AS (SELECT part, acc FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k DESC) AS z FROM taken) WHERE z = 1),
placed AS (SELECT ordered.part, id, CASE WHEN list_contains(acc, id) THEN '' ELSE id END AS sub FROM ordered JOIN last USING (part)),
named AS (SELECT group_id, part, sub, n, {_two('AFEC-', 'group_id', 'n')} AS cluster FROM (SELECT group_id, part, sub, row_number() OVER (PARTITION BY group_id ORDER BY concat_ws('|', m.f, m.l, m.id)) AS n FROM (SELECT group_id, part, sub, min({{'f': f, 'l': l, 'id': cs.id}}) AS m FROM placed JOIN cs USING (id) GROUP BY ALL)))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_SIX = ["lexical", "context", "neighborhood", "direct", "block", "combined"]


def _similar(config: AggregationConfig, name: str):
    rounded = ", ".join(f"round({c}, 9) AS {c}" for c in _SIX)

    @query(f"{_decided(config)} SELECT group_id, a, b, {rounded}, {config.pairwise_merge_threshold}::DOUBLE AS threshold, CAST(len(support) AS INT) AS support_count, array_to_string(support, '|') AS support, CASE WHEN reason LIKE 'threshold%' THEN 'MERGED' ELSE 'NOT_MERGED' END AS decision, reason FROM dec")
    def run(spark, sf):
        a = project(spark, sf, config).compared
        return a.shown(*[F.round(c, 9).alias(c) for c in _SIX], "threshold", "support_count", F.array_join("support", "|").alias("support"), "decision", "reason")

    for q in (QUERIES, ORACLE):
        q[name] = q.pop("run")


_similar(REAL, "snk13_snk14_agg11_gra6_sim1_to_sim7_similarities_and_decisions")
_similar(STRICT, "snk13_snk14_sim7_decisions_by_strict_rules")


def _clusters(config: AggregationConfig, name: str):
    lost = "(SELECT cluster FROM named JOIN placed USING (part, sub) LEFT JOIN tt USING (id) GROUP BY cluster HAVING coalesce(sum(n), 0) = 0)".replace("sum(n)", "sum(tt.n)")

    @query(f"{_clustered(config)} SELECT cluster AS candidate_id, id AS component_id, count(*) OVER (PARTITION BY cluster) AS component_count, cluster IN {lost} AS unassigned FROM named JOIN placed USING (part, sub)")
    def run(spark, sf):
        a = project(spark, sf, config)
        lost_ = a.table("unassigned-components").select(F.col("candidate_id").alias("component_id"), F.lit(True).alias("unassigned"))
        return a.aggregation.members.select("candidate_id", "component_id", "component_count").join(lost_, "component_id", "left").withColumn("unassigned", F.coalesce("unassigned", F.lit(False)))

    QUERIES[name], ORACLE[name] = QUERIES.pop("run"), _recursive(ORACLE.pop("run"))


_clusters(REAL, "clu1_clu2_clu3_win6_fil7_fil8_snk16_clusters_by_real_thresholds")
_clusters(STRICT, "clu1_clu2_clu3_win6_fil7_fil8_snk16_clusters_by_strict_rules")


def _best(kind: str) -> str:
    return f"coalesce((SELECT string_agg(name || '[rank=' || rank || ',score=' || score || ']', '|' ORDER BY rank) FROM typed WHERE typed.cluster = aggregated.candidate_id AND {kind}), '')"


_PROFILE = {
    "file_count": "len(files)", "block_count": "len(block_ids)", "top_class": _best("entity_type = 'CLASS' AND t_rank <= 5"), "token_counts": "coalesce((SELECT array_to_string(counted, '|') FROM tops WHERE tops.cluster = aggregated.candidate_id), '')",
    "top_classes": _best("entity_type = 'CLASS' AND t_rank <= 5"), "top_methods": _best("entity_type = 'METHOD' AND t_rank <= 5"), "top_fields": _best("entity_type = 'FIELD' AND t_rank <= 5"), "representative_entities": _best("rank <= 5"),
    "top_targets": "coalesce((SELECT x FROM ends WHERE ends.cluster = aggregated.candidate_id AND side = 't'), '')", "top_sources": "coalesce((SELECT x FROM ends WHERE ends.cluster = aggregated.candidate_id AND side = 's'), '')",
    "packages": r"coalesce((SELECT string_agg(DISTINCT regexp_extract(qualified_name, '^(.*)\.[^.]*$', 1), '|' ORDER BY regexp_extract(qualified_name, '^(.*)\.[^.]*$', 1)) FROM amem WHERE amem.cluster = aggregated.candidate_id AND qualified_name IS NOT NULL), '')",
    "classes": "coalesce((SELECT string_agg(DISTINCT coalesce(qualified_name, simple_name), '|' ORDER BY coalesce(qualified_name, simple_name)) FROM amem WHERE amem.cluster = aggregated.candidate_id AND entity_type = 'CLASS'), '')",
}
_CONCEPT = """CASE len(representative_tokens) WHEN 0 THEN 'Unlabeled implementation cluster' WHEN 1 THEN upper(left(representative_tokens[1], 1)) || substr(representative_tokens[1], 2) || ' implementation cluster' ELSE upper(left(representative_tokens[1], 1)) || substr(representative_tokens[1], 2) || '-' || representative_tokens[2] || ' implementation cluster' END"""
_EVIDENCE = f"""list_filter(['tokens=' || nullif({_PROFILE['token_counts']}, ''), 'entities=' || (SELECT string_agg(name, '|' ORDER BY rank) FROM imp WHERE imp.cluster = aggregated.candidate_id AND rank <= 3), 'dependencyTargets=' || (SELECT three FROM ends WHERE ends.cluster = aggregated.candidate_id AND side = 't'), '{profile.NOTE}'], lambda x: x IS NOT NULL)"""


@query(_csv("feature-evidence-profile", "aggregated", **_PROFILE))
def snk17_agg14_agg15_win7_top2_top5_str13_profile_csv(spark, sf):
    return _rows(project(spark, sf), "feature-evidence-profile")


_RULE = "'================================================='"
_NL = " || chr(10) || "
_TYPES = "'{' || coalesce((SELECT string_agg(relation_type || '=' || n, ', ' ORDER BY relation_type) FROM (SELECT relation_type, count(*) AS n FROM ainn WHERE ainn.cluster = aggregated.candidate_id GROUP BY ALL)), '') || '}'"
_ORIGINS = "(SELECT string_agg('- ' || token || ' = ' || n || ' origins [' || origins || ']' || chr(10), '' ORDER BY k) FROM top8 JOIN (SELECT cluster AS c2, token, string_agg(DISTINCT provenance || ':' || coalesce(name, '<external>'), ', ' ORDER BY provenance || ':' || coalesce(name, '<external>')) AS origins FROM ev JOIN afec USING (candidate_id) LEFT JOIN (SELECT entity_id AS source_entity_id, coalesce(qualified_name, simple_name) AS name FROM ent) USING (source_entity_id) GROUP BY ALL) o USING (token) WHERE top8.cluster = aggregated.candidate_id AND c2 = aggregated.candidate_id)"
_ISOLATED = "(SELECT count(*) FROM imp WHERE imp.cluster = aggregated.candidate_id AND degree = 0)"
_REPORT = _NL.join([
    _RULE, "'Component ' || candidate_id", "''", "'Signature'", "signature", "''", "'Implementation concept'", _CONCEPT, "'NOTE: This is only a descriptive interpretation, not a recovered feature name.'", "''", "'Representative entities'",
    "coalesce((SELECT string_agg('- rank ' || rank || ' score ' || score || ' ' || entity_type || ' ' || name || ' ' || file || ':' || start_line || '-' || end_line || chr(10), '' ORDER BY rank) FROM imp WHERE imp.cluster = aggregated.candidate_id AND rank <= 5), '')",
    "'Representative tokens'", f"coalesce({_ORIGINS}, '')", "'Dependency summary'", f"'- internal types: ' || {_TYPES}", "'- top targets: ' || coalesce((SELECT listed FROM ends WHERE ends.cluster = aggregated.candidate_id AND side = 't'), '[]')", "'- top sources: ' || coalesce((SELECT listed FROM ends WHERE ends.cluster = aggregated.candidate_id AND side = 's'), '[]')", "''", "'Structural summary'",
    "'Entities : ' || entity_count", "'Files : ' || len(files)", "'Blocks : ' || len(block_ids)", "'Internal : ' || internal_edge_count", "'Incoming : ' || incoming_edge_count", "'Outgoing : ' || outgoing_edge_count", "'Cross-file internal : ' || cross_file_internal_edge_count", f"'Isolated entities : ' || {_ISOLATED}", "''", "'Concept evidence'",
    f"array_to_string(list_transform({_EVIDENCE}, lambda x: '- ' || x), chr(10))", _RULE, "''",
])


@query(f"SELECT candidate_id, {_REPORT} AS value FROM aggregated")
def snk18_lab5_lab6_lab7_agg9_agg13_agg16_join19_report_text(spark, sf):
    return sinks.profile_report(project(spark, sf).profiles)


def _zero(part: str, column: str, values, relation: str, by: str = "") -> str:
    """Lines of a zero-filled count; ``by`` is a relation of groups."""
    v = ", ".join(f"({i}, '{x}')" for i, x in enumerate(values))
    head, group = ("'group_id=' || g.group_id || ', ' || ", "AND r.group_id = g.group_id") if by else ("", "")
    return f"SELECT '{part}' AS part, {head}'{column}=' || x || ', ordinal=' || i || ', n=' || (SELECT count(*) FROM {relation} r WHERE r.{column} = x {group}) AS line FROM (VALUES {v}) v(i, x){', ' + by + ' g' if by else ''}"


def _line(part: str, relation: str, *columns: str) -> str:
    cells = " || ', ' || ".join(f"'{c.split(' AS ')[-1]}=' || coalesce(CAST({c.split(' AS ')[0]} AS VARCHAR), 'null')" for c in columns)
    return f"SELECT '{part}' AS part, {cells} AS line FROM {relation}"


_FIRST = {
    "first_method_calls": ("(SELECT * FROM rel WHERE relation_type = 'METHOD_CALL' ORDER BY file, source_line, target_text, length(relation_id), relation_id LIMIT 10)", ["source_entity_id", "target_text", "file", "source_line", "group_id", "resolution_status"]),
    "merged_entities": ("(SELECT * FROM ent WHERE len(observed_products) > 1 ORDER BY length(entity_id), entity_id LIMIT 5)", ["entity_id", "file", "entity_type", "start_line", "end_line", "signature", "group_id"]),
    "merged_relations": ("(SELECT * FROM rel WHERE len(observed_products) > 1 ORDER BY length(relation_id), relation_id LIMIT 5)", ["relation_id", "file", "source_line", "relation_type", "target_entity_id", "target_text", "signature", "group_id"]),
}


@query(" UNION ALL ".join([
    _line("extraction", "(SELECT count(DISTINCT file) AS parsed_files, count(*) AS attempts, count(*) FILTER (entity_type = 'CLASS') AS successes FROM ent)", "parsed_files", "attempts", "successes"),
    _zero("entities_by_type", "entity_type", ENTITY_TYPES, "ent"), _zero("relations_by_type", "relation_type", RELATION_TYPES, "rel"), _zero("entities_by_group", "entity_type", ENTITY_TYPES, "ent", "(SELECT DISTINCT group_id FROM blk)"), _zero("relations_by_status", "resolution_status", RESOLUTION, "rel"), *[_line(k, sql, *columns) for k, (sql, columns) in _FIRST.items()],
]))
def rpt2_agg17_agg23_entity_summary(spark, sf):
    parts = reports.entities(project(spark, sf))
    return reports.lines({k: parts[k].select(*_FIRST[k][1]) if k in _FIRST else parts[k] for k in parts})


@query(" UNION ALL ".join([
    _line("nodes", "(SELECT count(*) AS nodes FROM ent)", "nodes"), _line("edges", "(SELECT count(*) AS edges, count(*) FILTER (cross_file) AS cross_file, count(*) FILTER (NOT cross_file) AS same_file FROM edge)", "edges", "cross_file", "same_file"),
    _line("unresolved", "(SELECT count(*) AS unresolved, count(*) FILTER (failure_reason = 'external target') AS external, count(*) FILTER (failure_reason = 'ambiguous target') AS ambiguous, count(*) FILTER (failure_reason IN ('missing source entity', 'source entity not found')) AS missing_source FROM why WHERE failure_reason IS NOT NULL)", "unresolved", "external", "ambiguous", "missing_source"),
    _zero("external_by_type", "relation_type", RELATION_TYPES, "(SELECT * FROM why WHERE failure_reason = 'external target')"), "SELECT 'invalid_constructors', 'n=0'", _line("edges_by_group", "(SELECT source_group_id, count(*) AS n FROM edge GROUP BY ALL)", "source_group_id", "n"),
    _line("top_group_pairs", "(SELECT * FROM (SELECT source_group_id, target_group_id, count(*) AS n FROM edge GROUP BY ALL) ORDER BY n DESC, source_group_id || '->' || target_group_id LIMIT 10)", "source_group_id", "target_group_id", "n"),
    _line("group_pairs_by_type", "(SELECT source_group_id, target_group_id, relation_type, count(*) AS n FROM edge GROUP BY ALL)", "source_group_id", "target_group_id", "relation_type", "n"),
]))
def rpt3_agg18_agg19_join18_top4_dependency_summary(spark, sf):
    return reports.lines(reports.dependencies(project(spark, sf)))


_KEPT = ["candidate_id", "group_id", "signature", "entity_count", "block_count", "internal_edge_count", "cross_file_internal_edge_count", "incoming_edge_count", "outgoing_edge_count"]


@query(" UNION ALL ".join([
    _line("counters", "(SELECT count(*) AS candidates, count(*) FILTER (classification_status = 'ISOLATED_ENTITY') AS isolated, count(*) FILTER (classification_status = 'BLOCK_ONLY') AS block_only, count(*) FILTER (cross_file_internal_edge_count > 0) AS cross_file, 0 AS unassigned_entities FROM cand)", "candidates", "isolated", "block_only", "cross_file", "unassigned_entities"),
    _line("edges_between", "(SELECT coalesce(sum(edge_count) FILTER (dependency_scope <> 'INTERNAL_CANDIDATE'), 0) AS n FROM dep)", "n"), _line("by_group", "(SELECT group_id, count(*) AS n FROM cand GROUP BY ALL)", "group_id", "n"),
    _line("entity_counts", "(SELECT entity_count AS size, count(*) AS n FROM cand GROUP BY ALL)", "size", "n"), _line("block_counts", "(SELECT block_count AS size, count(*) AS n FROM cand GROUP BY ALL)", "size", "n"), _line("largest", "(SELECT * FROM cand ORDER BY entity_count DESC, candidate_id LIMIT 10)", *_KEPT),
]))
def rpt4_agg20_agg21_top4_candidate_summary(spark, sf):
    parts = reports.candidates(project(spark, sf))
    return reports.lines(parts | {"largest": parts["largest"].select(*_KEPT)})


_WIDE = ["candidate_id", "group_id", "commonality", "suggested_label", "label_confidence", "candidate_confidence", "component_count", "entity_count"]


@query(" UNION ALL ".join([
    _line("counters", "(SELECT count(*) AS candidates, coalesce(sum(component_count) FILTER (component_count > 1), 0) AS merged_components, count(*) FILTER (label_confidence = 'UNLABELED') AS unlabeled FROM aggregated)", "candidates", "merged_components", "unlabeled"),
    _zero("commonality", "commonality", ("FULL_COMMONALITY", "SUBGROUP_COMMONALITY", "VARIABLE_SIGNATURE"), "aggregated"), _zero("label_confidence", "label_confidence", ("HIGH", "MEDIUM", "LOW", "UNLABELED"), "aggregated"), _zero("candidate_confidence", "candidate_confidence", ("HIGH", "MEDIUM", "LOW", "UNRESOLVED"), "aggregated"),
    _line("largest", "(SELECT * FROM aggregated ORDER BY entity_count DESC, candidate_id LIMIT 10)", *_WIDE),
    _line("profiles", f"(SELECT candidate_id, {_CONCEPT} AS implementation_concept, entity_count, len(files) AS file_count, internal_edge_count, {_PROFILE['token_counts']} AS token_counts FROM aggregated ORDER BY entity_count DESC, candidate_id LIMIT 20)", "candidate_id", "implementation_concept", "entity_count", "file_count", "internal_edge_count", "token_counts"),
    _line("best_labels", "(SELECT * FROM aggregated WHERE suggested_label <> '' ORDER BY list_position(['HIGH', 'MEDIUM', 'LOW', 'UNLABELED'], label_confidence), candidate_id LIMIT 10)", *_WIDE),
]))
def rpt5_rpt6_agg22_top7_aggregation_summary(spark, sf):
    a = project(spark, sf)
    parts = reports.aggregation(a)
    return reports.lines({k: parts[k] for k in ("counters", "commonality", "label_confidence", "candidate_confidence")} | {"largest": parts["largest"].select(*_WIDE), "best_labels": parts["best_labels"].select(*_WIDE), "profiles": reports.profiles(a)})


def _detail(ident: str) -> str:
    return " UNION ALL ".join([_line("entities", f"mem WHERE candidate_id IN {ident}", "entity_id", "entity_type"), _line("blocks", f"cblk WHERE candidate_id IN {ident}", "block_id", "directive"), _line("internal", f"inn WHERE candidate_id IN {ident}", "edge_id", "relation_type")])


_ONE = "(SELECT min(candidate_id) FROM cand WHERE entity_count > 1)"


@query(" UNION ALL ".join([
    _line("FEC candidate", f"cand WHERE candidate_id IN {_ONE}", *_KEPT), *[x.replace("SELECT '", "SELECT 'FEC ") for x in _detail(_ONE).split(" UNION ALL ")],
    _line("FEC incoming", f"acr WHERE t_cand IN {_ONE}", "edge_id", "relation_type"), _line("FEC outgoing", f"acr WHERE s_cand IN {_ONE}", "edge_id", "relation_type"),
    _line("AFEC candidate", "aggregated WHERE candidate_id = 'AFEC-G2-01'", *_WIDE), *[x.replace("SELECT '", "SELECT 'AFEC ") for x in _detail("(SELECT candidate_id FROM afec WHERE cluster = 'AFEC-G2-01')").split(" UNION ALL ")],
    _line("AFEC incoming", "acr WHERE target_group_id = 'G2' AND source_group_id <> 'G2'", "edge_id", "relation_type"), _line("AFEC outgoing", "acr WHERE source_group_id = 'G2' AND target_group_id <> 'G2'", "edge_id", "relation_type"),
]))
def rpt7_fil15_details(spark, sf):
    a = project(spark, sf)
    one = a.candidates.candidates.where("entity_count > 1").agg(F.min("candidate_id")).first()[0]
    shown = {"candidate": _KEPT, "entities": ["entity_id", "entity_type"], "blocks": ["block_id", "directive"], "internal": ["edge_id", "relation_type"], "incoming": ["edge_id", "relation_type"], "outgoing": ["edge_id", "relation_type"]}
    parts = {f"FEC {k}": v.select(*shown[k]) for k, v in reports.details(a, one).items()}
    parts |= {f"AFEC {k}": v.select(*(_WIDE if k == "candidate" else shown[k])) for k, v in reports.details(a, "AFEC-G2-01").items() if k in shown}
    return reports.lines(parts)


_PLACE = "file || ':' || start_line || '-' || end_line"
_NAME = "coalesce(qualified_name, simple_name)"
_AT = "file, lpad(CAST(start_line AS VARCHAR), 10, '0')"


def _text(of: str, *sections: tuple[str, str, str]) -> str:
    """Numbered lines of sections (line, relation, three keys)."""
    each = [f"SELECT {i} AS section, {keys or chr(39) * 2 + ', ' + chr(39) * 2 + ', ' + chr(39) * 2}, {line} FROM {relation}" for i, (line, relation, keys) in enumerate(sections)]
    return f"SELECT '{of}' AS of, row_number() OVER (ORDER BY section, k0, k1, k2, line) AS n, line FROM ({' UNION ALL '.join(each)}) t(section, k0, k1, k2, line)"


def _fec_text() -> str:
    one, c = f"candidate_id = {_ONE}", f"(SELECT * FROM cand WHERE candidate_id = {_ONE})"
    heads = [(f"'{w}: ' || {x}", c, "") for w, x in (("Candidate details", "candidate_id"), ("Group", "group_id"), ("Signature", "signature"), ("Classification", "classification_status"))]
    return _text("FEC", *heads, ("'Entities:'", c, ""), (f"'- ' || entity_id || ' ' || {_NAME} || ' ' || {_PLACE} || ' block=' || block_id", f"mem WHERE {one}", f"{_AT}, entity_id"), ("'Blocks:'", c, ""), (f"'- ' || directive || ' ' || {_PLACE}", f"cblk WHERE {one}", f"{_AT}, directive"),
        ("'Internal dependencies:'", c, ""), ("'- ' || relation_type || ' ' || source_entity_id || ' -> ' || target_entity_id || ' line=' || source_line", f"inn WHERE {one}", "lpad(substr(edge_id, 2), 20, '0'), '', ''"),
        ("'Incoming dependencies: ' || count(*)", f"acr WHERE t_cand = {_ONE}", ""), ("'Outgoing dependencies: ' || count(*)", f"acr WHERE s_cand = {_ONE}", ""))


def _afec_text() -> str:
    it = "'AFEC-G2-01'"
    c = f"(SELECT * FROM aggregated WHERE candidate_id = {it})"
    listed = lambda x: f"'[' || array_to_string({x}, ', ') || ']'"
    heads = [(f"'{w}: ' || {x}", c, "") for w, x in (("Aggregated candidate details", "candidate_id"), ("Label", "CASE WHEN trim(suggested_label) = '' THEN '<unlabeled>' ELSE suggested_label END"), ("Label confidence", "label_confidence"), ("Candidate confidence", "candidate_confidence"), ("Components", listed("component_ids")), ("Representative tokens", listed("representative_tokens")))]
    return _text("AFEC", *heads, ("'Entities:'", c, ""), (f"'- ' || entity_id || ' ' || {_NAME} || ' ' || {_PLACE}", f"amem WHERE cluster = {it}", f"{_AT}, entity_id"), ("'Merge decisions:'", c, ""),
        (f"'- ' || a || ' + ' || b || ' score=' || CAST(CAST(round(CAST(combined AS DECIMAL(18, 12)), 3) AS DECIMAL(18, 3)) AS VARCHAR) || ' evidence=' || {listed('support')} || ' reason=threshold and evidence-family requirements satisfied'", "sm WHERE group_id = 'G2'", "a, b, ''"),
        ("'Incoming dependencies: ' || incoming_edge_count", c, ""), ("'Outgoing dependencies: ' || outgoing_edge_count", c, ""))


@query(f"{_SIMILAR} {_fec_text()} UNION ALL {_afec_text()}")
def rpt7_detail_view_as_text(spark, sf):
    a = project(spark, sf)
    one = a.candidates.candidates.where("entity_count > 1").agg(F.min("candidate_id")).first()[0]
    return reports.detail_text(a, one).select(F.lit("FEC").alias("of"), "n", "line").union(reports.detail_text(a, "AFEC-G2-01").select(F.lit("AFEC"), "n", "line"))


@query("SELECT s_group AS source_group_id, count(*) AS n FROM why WHERE relation_type = 'CONSTRUCTOR_CALL' AND s_group IS NOT NULL AND target_entity_id IN (SELECT entity_id FROM ent WHERE entity_type <> 'CONSTRUCTOR') GROUP BY ALL")
def join18_invalid_constructors_of_all_relations(spark, sf):
    """The check on relations before the graph rejects such calls; in the graph's own edges none is left."""
    f = project(spark, sf).facts
    of = f.entities.select(F.col("entity_id").alias("source_entity_id"), F.col("group_id").alias("source_group_id"))
    bad = reports.invalid_constructors(f.relations.drop("group_id").join(of, "source_entity_id"), f.entities)
    return bad.groupBy("source_group_id").agg(F.count("*").alias("n"))


# sources made from customers: each form of a declaration, by the customer's key

_FORMS = [
    """package p%n;
public interface T%k extends Base {
  void go(int a, String b);
}
""",
    """package p%n;
import java.util.List;
public class T%k<X extends Number> {
  private List<String> items, more;
  public T%k(Map<String, List<X>> m, int[] c) {
    this.items = null;
  }
  <Y> Y pick(Y y, int... z) {
    return y;
  }
  T%k() { } T%k(int a) { }
}
""",
    """package p%n;
class T%k {
  enum Color { RED, GREEN; void paint() { } }
  class Inner {
    int deep;
  }
  void make() {
    class Local { void hid() { } }
    Runnable r = new Runnable() { public void run() { go(); } };
    new Inner();
  }
}
""",
    """package p%n;
class T%k extends T3 implements Runnable {
  @Override
  public void run() {
    helper(1);
    this.count = count + 1;
  }
//#if A
  int count;
//#elif B
  int other, count;
//#endif
}
""",
    "package p%n;\nclass T%k {\n  void run( {\n}\n",
]
_SPECIAL = "CASE WHEN c_custkey % 11 = 5 THEN 4 ELSE c_custkey % 4 END"

#: form, entity type, simple name, qualified name, first and last line, products.
_DECLARED = """(0, 'INTERFACE', 'T%k', 'p%n.T%k', 2, 4, 'A|B'), (0, 'METHOD', 'go', 'p%n.T%k.go', 3, 3, 'A|B'),
(1, 'CLASS', 'T%k', 'p%n.T%k', 3, 12, 'A|B'), (1, 'FIELD', 'items', 'p%n.T%k.items', 4, 4, 'A|B'), (1, 'FIELD', 'more', 'p%n.T%k.more', 4, 4, 'A|B'), (1, 'CONSTRUCTOR', 'T%k', 'p%n.T%k.T%k', 5, 7, 'A|B'), (1, 'METHOD', 'pick', 'p%n.T%k.pick', 8, 10, 'A|B'), (1, 'CONSTRUCTOR', 'T%k', 'p%n.T%k.T%k', 11, 11, 'A|B'), (1, 'CONSTRUCTOR', 'T%k', 'p%n.T%k.T%k', 11, 11, 'A|B'),
(2, 'CLASS', 'T%k', 'p%n.T%k', 2, 12, 'A|B'), (2, 'CLASS', 'Inner', 'p%n.T%k.Inner', 4, 6, 'A|B'), (2, 'METHOD', 'paint', 'p%n.T%k.paint', 3, 3, 'A|B'), (2, 'METHOD', 'make', 'p%n.T%k.make', 7, 11, 'A|B'), (2, 'METHOD', 'hid', 'p%n.T%k.Local.hid.make', 8, 8, 'A|B'), (2, 'METHOD', 'run', 'p%n.T%k.run.make', 9, 9, 'A|B'), (2, 'FIELD', 'deep', 'p%n.T%k.Inner.deep', 5, 5, 'A|B'),
(3, 'CLASS', 'T%k', 'p%n.T%k', 2, 13, 'A|B'), (3, 'METHOD', 'run', 'p%n.T%k.run', 3, 7, 'A|B'), (3, 'FIELD', 'count', 'p%n.T%k.count', 9, 9, 'A'), (3, 'FIELD', 'other', 'p%n.T%k.other', 11, 11, 'B'), (3, 'FIELD', 'count', 'p%n.T%k.count', 11, 11, 'B')"""

#: form, relation type, target, line, qualified name of the source, products.
_SAID = """(0, 'EXTENDS', 'Base', 2, 'p%n.T%k', 'A|B'), (0, 'TYPE_REFERENCE', 'int', 3, 'p%n.T%k.go', 'A|B'), (0, 'TYPE_REFERENCE', 'String', 3, 'p%n.T%k.go', 'A|B'),
(1, 'TYPE_REFERENCE', 'X extends Number', 3, 'p%n.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'Number', 3, 'p%n.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'List<String>', 4, 'p%n.T%k.items', 'A|B'), (1, 'TYPE_REFERENCE', 'String', 4, 'p%n.T%k.items', 'A|B'), (1, 'TYPE_REFERENCE', 'List<String>', 4, 'p%n.T%k.more', 'A|B'), (1, 'TYPE_REFERENCE', 'String', 4, 'p%n.T%k.more', 'A|B'),
(1, 'TYPE_REFERENCE', 'Map<String, List<X>>', 5, 'p%n.T%k.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'String', 5, 'p%n.T%k.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'List<X>', 5, 'p%n.T%k.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'X', 5, 'p%n.T%k.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'int[]', 5, 'p%n.T%k.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'int', 5, 'p%n.T%k.T%k', 'A|B'),
(1, 'FIELD_REFERENCE', 'items', 6, 'p%n.T%k.T%k', 'A|B'), (1, 'TYPE_REFERENCE', 'Y', 8, 'p%n.T%k.pick', 'A|B'), (1, 'TYPE_REFERENCE', 'int', 8, 'p%n.T%k.pick', 'A|B'), (1, 'TYPE_REFERENCE', 'int', 11, 'p%n.T%k.T%k', 'A|B'),
(2, 'TYPE_REFERENCE', 'int', 5, 'p%n.T%k.Inner.deep', 'A|B'), (2, 'TYPE_REFERENCE', 'Runnable', 9, 'p%n.T%k.make', 'A|B'), (2, 'TYPE_REFERENCE', 'Inner', 10, 'p%n.T%k.make', 'A|B'), (2, 'CONSTRUCTOR_CALL', 'Runnable', 9, 'p%n.T%k.make', 'A|B'), (2, 'CONSTRUCTOR_CALL', 'Inner', 10, 'p%n.T%k.make', 'A|B'), (2, 'METHOD_CALL', 'go', 9, 'p%n.T%k.run.make', 'A|B'),
(3, 'EXTENDS', 'T3', 2, 'p%n.T%k', 'A|B'), (3, 'IMPLEMENTS', 'Runnable', 2, 'p%n.T%k', 'A|B'), (3, 'METHOD_CALL', 'helper', 5, 'p%n.T%k.run', 'A|B'), (3, 'FIELD_REFERENCE', 'count', 6, 'p%n.T%k.run', 'A|B'), (3, 'TYPE_REFERENCE', 'int', 9, 'p%n.T%k.count', 'A'), (3, 'TYPE_REFERENCE', 'int', 11, 'p%n.T%k.other', 'B'), (3, 'TYPE_REFERENCE', 'int', 11, 'p%n.T%k.count', 'B')"""


def _filled(column: str) -> str:
    return f"replace(replace({column}, '%k', CAST(c_custkey AS VARCHAR)), '%n', CAST(c_nationkey AS VARCHAR))"


def sources(spark: SparkSession, sf: str) -> Analysis:
    """The analysis of one source for each customer; its facts, once made, serve the queries of an application."""

    def made() -> Analysis:
        c = spark.read.parquet(f"{sf}/customer.parquet")
        form = F.element_at(F.array(*map(F.lit, _FORMS)), F.expr(_SPECIAL).cast("int") + 1)
        text = F.replace(F.replace(form, F.lit("%k"), F.col("c_custkey").cast("string")), F.lit("%n"), F.col("c_nationkey").cast("string"))
        return Analysis(c.select(F.concat(F.lit("/c/"), F.col("c_custkey").cast("string")).alias("path"), text.alias("src")))

    return _kept(spark, sf, ("customer",), "sources", made)


def _sources_query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@_sources_query(f"""SELECT '/c/' || c_custkey AS file, entity_type, {_filled('simple')} AS simple_name, {_filled('qualified')} AS qualified_name, s AS start_line, e AS end_line, products
FROM customer JOIN (VALUES {_DECLARED}) v(form, entity_type, simple, qualified, s, e, products) ON form = {_SPECIAL}""")
def par1_to_par5_par12_par13_par14_agg3_fil2_entities(spark, sf):
    e = sources(spark, sf).facts.entities
    return e.select("file", "entity_type", "simple_name", "qualified_name", "start_line", "end_line", F.array_join("observed_products", "|").alias("products"))


@_sources_query(f"""SELECT '/c/' || c_custkey AS file, relation_type, target AS target_text, line AS source_line, {_filled('source')} AS source_name, products
FROM customer JOIN (VALUES {_SAID}) v(form, relation_type, target, line, source, products) ON form = {_SPECIAL}""")
def par6_to_par11_agg4_join5_join6_relations(spark, sf):
    f = sources(spark, sf).facts
    names = f.entities.select(F.col("entity_id").alias("source_entity_id"), F.col("qualified_name").alias("source_name"))
    return f.relations.join(names, "source_entity_id", "left").select("file", "relation_type", "target_text", "source_line", "source_name", F.array_join("observed_products", "|").alias("products"))


@_sources_query(f"""SELECT 'failure' AS what, '/c/' || c_custkey AS file, product, 3 AS line FROM customer, (SELECT unnest(['A', 'B']) AS product) WHERE {_SPECIAL} = 4
UNION ALL SELECT 'parsed files', NULL, NULL, count(*) FROM customer WHERE {_SPECIAL} <> 4 UNION ALL SELECT 'attempts', NULL, NULL, 2 * count(*) FROM customer UNION ALL SELECT 'successes', NULL, NULL, 2 * count(*) FROM customer WHERE {_SPECIAL} <> 4""")
def par1_agg23_src6_failures_and_counts(spark, sf):
    f = sources(spark, sf).facts
    none = F.lit(None).cast("string")
    said = [f.stats.select(F.lit(name).alias("what"), none.alias("file"), none.alias("product"), F.col(c).cast("long").alias("line")) for name, c in (("parsed files", "parsed_files"), ("attempts", "attempts"), ("successes", "successes"))]
    out = f.failures.where("extraction_skipped").select(F.lit("failure").alias("what"), "file", "product", F.col("line").cast("long").alias("line"))
    for s in said:
        out = out.union(s)
    return out
