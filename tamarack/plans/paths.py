"""Queries of the path-fact operators over the driver's tables and small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import fixed
from tamarack.operators import facts, text
from tamarack.plans.containers import SOURCE
from tamarack.plans.relational import EDGES, NODES

PATHS = ((1, (0, 1, 2, 4, 9), ("a",)), (2, (0, 1, 3, 4, 9), ("b",)), (3, (0, 1, 3, 1), ("b", "loop")))


def _paths(spark):
    return spark.createDataFrame([(k, list(n), list(c)) for k, n, c in PATHS], "path_id long, nodes array<long>, conditions array<string>")


def _edges(spark):
    return spark.createDataFrame(list(EDGES), "src long, dst long, cond string, ord long")


def condition_prefixes(spark, sf_dir):
    """Conditions before each position of sample paths."""
    out = facts.conditions_before(_paths(spark), _edges(spark), [])
    return out.select("path_id", F.col("pos").cast("long").alias("pos"), F.array_join("conditions", "&").alias("conditions"), "ambiguous")


_STEPS = f"""
WITH e(src, dst, cond, ord) AS (VALUES {", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in EDGES)}),
p(path_id, nodes) AS (VALUES {", ".join(f"({k}, [{', '.join(map(str, n))}])" for k, n, _ in PATHS)}),
s AS (SELECT path_id, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS pos FROM p), t AS (SELECT *, lead(node) OVER (PARTITION BY path_id ORDER BY pos) AS nxt FROM s),
c AS (SELECT t.*, e.cond FROM t LEFT JOIN e ON e.src = t.node AND e.dst = t.nxt)
"""
_PREFIX = _STEPS + "SELECT path_id::BIGINT AS path_id, pos::BIGINT AS pos, coalesce(string_agg(cond, '&') OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS conditions, false AS ambiguous FROM c"


def access_predicates(spark, sf_dir):
    """Accesses at the second position of sample paths with the condition that the path takes there."""
    a = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 1, 12), (1, 2, 13)], "path_id long, pos int, access_id long")
    nodes = spark.createDataFrame(list(NODES), "node_id long, kind string, label string")
    return facts.access_predicates(a, _paths(spark), nodes, _edges(spark), []).select("path_id", "access_id", F.coalesce("cond", F.lit("")).alias("cond"), "state")


_PREDICATES = "SELECT path_id::BIGINT AS path_id, access_id::BIGINT AS access_id, cond, 'edge_condition' AS state FROM (VALUES (1, 10, 'a'), (2, 11, 'b'), (3, 12, 'b')) t(path_id, access_id, cond)"


def access_value_flows(spark, sf_dir):
    """Line items as accesses and assignments at the position of their order and line: reads into, writes from variables."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = li.where("l_discount > 0.05").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("access_id"), (F.col("l_returnflag") == "R").alias("is_write"))
    f = li.where("l_tax > 0.03").select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("flow_id"), F.col("l_returnflag").alias("target"), F.array("l_linestatus", F.concat("l_linestatus", F.lit("X"))).alias("inputs"))
    return facts.access_value_flows(a, f, []).groupBy("role", "variable").agg(F.count("*").alias("n_flows"))


_FLOWS = """
WITH j AS (SELECT a.l_orderkey AS p, a.l_partkey AS a, f.l_suppkey AS f, a.l_returnflag = 'R' AS w, lower(f.l_returnflag) AS t, lower(f.l_linestatus) AS s FROM lineitem a JOIN lineitem f USING (l_orderkey, l_linenumber) WHERE a.l_discount > 0.05 AND f.l_tax > 0.03),
x AS (SELECT DISTINCT p, a, f, 'excel_read_to_variable_candidate' AS role, t AS variable FROM j WHERE NOT w UNION SELECT p, a, f, 'variable_to_excel_write_candidate', s FROM j WHERE w UNION SELECT p, a, f, 'variable_to_excel_write_candidate', s || 'x' FROM j WHERE w)
SELECT role, variable, count(*)::BIGINT AS n_flows FROM x GROUP BY ALL"""


def path_final_state(spark, sf_dir):
    """Users' values by kind of event at the end: an error invalidates what came before, a click erases the views."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    event = F.when(F.col("event_type") == "error", "invalidate").when(F.col("event_type") == "click", "erase").otherwise("assign")
    name = F.when(F.col("event_type") == "click", "view").otherwise(F.col("event_type"))
    rows = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), event.alias("event"), name.alias("name"), "value")
    return facts.final_state(rows, ["user_id"])


_FINAL = """
WITH e AS (SELECT user_id, ts, event_type, value, CASE event_type WHEN 'click' THEN 'view' ELSE event_type END AS name FROM events), w AS (SELECT user_id, max(ts) AS t FROM e WHERE event_type = 'error' GROUP BY 1),
l AS (SELECT * FROM e WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY ts DESC, value DESC) = 1)
SELECT l.user_id, l.name, l.value FROM l LEFT JOIN w USING (user_id) WHERE event_type <> 'click' AND (w.t IS NULL OR l.ts > w.t)"""


def constant_sources(spark, sf_dir):
    """Each customer as a read of a name, a constant of its nation (a procedure) and one of its region (a module)."""
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    reads = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("read_id"), F.col("n_regionkey").alias("module"), F.col("c_nationkey").alias("proc"), F.concat("c_mktsegment", (F.col("c_custkey") % F.lit(1013)).cast("string")).alias("name"))
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    own = d.select(F.col("n_regionkey").alias("module"), F.col("c_nationkey").alias("proc"), F.concat("c_mktsegment", (F.col("c_custkey") % F.lit(997)).cast("string")).alias("name"), F.lit(False).alias("is_public"), F.col("c_custkey").alias("value"))
    shared = d.select(F.col("n_regionkey").alias("module"), F.lit(None).cast("int").alias("proc"), F.concat("c_mktsegment", (F.col("c_custkey") % F.lit(1009)).cast("string")).alias("name"), F.lit(True).alias("is_public"), F.col("c_custkey").alias("value"))
    out = facts.constant_of(reads, own.unionAll(shared))
    return out.select("read_id", F.coalesce("value", F.lit(-1)).alias("value"), "state")


_CONSTANTS = """
WITH d AS (SELECT c_custkey AS k, n_regionkey AS m, c_nationkey AS p, lower(c_mktsegment) AS s, s || (k % 1013) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
pr AS (SELECT m, p, s || (k % 997) AS name, count(*) AS n, min(k) AS v FROM d GROUP BY ALL), mo AS (SELECT m, s || (k % 1009) AS name, count(*) AS n, min(k) AS v FROM d GROUP BY ALL), gl AS (SELECT s || (k % 1009) AS name, count(*) AS n, min(k) AS v FROM d GROUP BY ALL),
j AS (SELECT d.k, pr.n AS pn, pr.v AS pv, mo.n AS mn, mo.v AS mv, gl.n AS gn, gl.v AS gv FROM d LEFT JOIN pr USING (m, p, name) LEFT JOIN mo USING (m, name) LEFT JOIN gl USING (name))
SELECT k AS read_id, coalesce(CASE WHEN pn IS NOT NULL THEN CASE WHEN pn = 1 THEN pv END WHEN mn IS NOT NULL THEN CASE WHEN mn = 1 THEN mv END WHEN gn = 1 THEN gv END, -1) AS value,
 CASE WHEN pn = 1 THEN 'procedure' WHEN pn IS NULL AND mn = 1 THEN 'module' WHEN pn IS NULL AND mn IS NULL AND gn = 1 THEN 'public' ELSE 'unresolved' END AS state FROM j"""


SAMPLE_CONDITIONS = ((-1, ["(1 > 2) = True"]), (-2, ["(x > 2) = True"]), (-3, ["(DEBUGGING And x) = True"]), (-4, ["(Not DEBUGGING) = True", "(2 * 3 = 6) = False"]), (-5, []), (-6, ['("a" & "b" = "ab") = True']))


def path_feasibility(spark, sf_dir):
    """Paths whose constant conditions fail: one with the size of each part, and samples."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    conditions = F.array(F.lit("(x > 2) = True"), F.format_string("(%d > 25) = %s", size, F.when(F.col("p_retailprice") > 1000, "True").otherwise("False")), F.format_string("(%d * 2 = %d And Not DEBUGGING) = True", size, size * 2))
    d = part.select(F.col("p_partkey").alias("path_id"), conditions.alias("conditions"))
    return facts.feasibility(d.unionAll(spark.createDataFrame(list(SAMPLE_CONDITIONS), "path_id long, conditions array<string>")), {"debugging": False})


_FEASIBLE = """
SELECT p_partkey AS path_id, CASE WHEN (p_size > 25) <> (p_retailprice > 1000) THEN 'infeasible_constant_condition' ELSE 'not_checked' END AS feasibility FROM part
UNION ALL SELECT -path_id::BIGINT, CASE WHEN path_id IN (1, 3, 4) THEN 'infeasible_constant_condition' ELSE 'not_checked' END FROM range(1, 7) t(path_id)"""


def unassociated_facts(spark, sf_dir):
    """Orders without line items of quantity 50: facts without a link."""
    return facts.unassociated(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")), spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity = 50").select(F.col("l_orderkey").alias("k")), ["k"])


_UNASSOCIATED = "SELECT count(*)::BIGINT AS n_unassociated FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)"


def shared_formulas(spark, sf_dir):
    """Line items as follower cells with the formula of the one part that is their master."""
    part, li = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    half = lambda c: F.floor(F.col(c) / 2).cast("long")
    m = part.select((F.col("p_size") % 2).alias("sheet"), half("p_partkey").alias("shared"), F.lit(1).alias("row1"), F.col("p_size").alias("row2"), F.lit(1).alias("col1"), F.lit(6).alias("col2"), F.concat(F.lit("A"), "p_partkey", F.lit("+1")).alias("formula"))
    f = li.select((F.col("l_linenumber") % 2).alias("sheet"), half("l_partkey").alias("shared"), F.col("l_quantity").cast("int").alias("row"), F.col("l_linenumber").alias("col"))
    return facts.shared_formulas(f, m).groupBy("shared", "state", F.coalesce("formula", F.lit("")).alias("formula")).agg(F.count("*").alias("n_cells"))


_SHARED = """
WITH m AS (SELECT p_size % 2 AS sheet, p_partkey // 2 AS shared, count(*) AS n, min(p_size) AS row2, min(p_partkey) AS k FROM part GROUP BY 1, 2),
f AS (SELECT DISTINCT l_linenumber % 2 AS sheet, l_partkey // 2 AS shared, l_quantity::INT AS row, l_linenumber AS col FROM lineitem),
j AS (SELECT f.shared, CASE WHEN n IS NULL THEN 'no_master' WHEN n > 1 THEN 'ambiguous_master' WHEN row BETWEEN 1 AND row2 AND col <= 6 THEN 'resolved' ELSE 'outside_master' END AS state, k FROM f LEFT JOIN m USING (sheet, shared))
SELECT shared, state, CASE WHEN state = 'resolved' THEN 'A' || k || '+1' ELSE '' END AS formula, count(*)::BIGINT AS n_cells FROM j GROUP BY ALL"""


def structured_references(spark, sf_dir):
    """Table references as bounds of cells."""
    t = spark.createDataFrame([("Sales", 1, 10, 2, 4, 1, 1), ("Plain", 20, 25, 1, 1, 0, 0)], "table_name string, row1 int, row2 int, col1 int, col2 int, header_rows int, total_rows int")
    c = spark.createDataFrame([("sales", "Qty", 0), ("sales", "Price", 1), ("plain", "X", 0)], "table_name string, column_name string, ordinal int")
    r = spark.createDataFrame([(1, "SALES", None, "price"), (2, "sales", "#All", None), (3, "sales", "#Totals", "Qty"), (4, "plain", "#Headers", None), (5, "none", None, None), (6, "sales", None, "zzz")], "ref_id int, table_name string, section string, column_name string")
    n = lambda x: F.coalesce(x, F.lit(-1)).alias(x)
    return facts.structured_bounds(r, t, c).select("ref_id", n("row_from"), n("row_to"), n("col_from"), n("col_to"), "state")


_STRUCTURED = "SELECT * FROM (VALUES (1, 2, 9, 3, 3, 'resolved'), (2, 1, 10, 2, 4, 'resolved'), (3, 10, 10, 2, 2, 'resolved'), (4, -1, -1, -1, -1, 'no_section'), (5, -1, -1, -1, -1, 'unknown_table'), (6, -1, -1, -1, -1, 'unknown_column')) t(ref_id, row_from, row_to, col_from, col_to, state)"

WORDS = ("Range", "Cells", "xlUp", "ListObject", "value2", "Save", "nothing", "WORKBOOK", "xlLeft")


def host_names(spark, sf_dir):
    """What names are to the spreadsheet host: the identifiers of conversations, counted, and samples."""
    toks = text.tokens(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id"]).where("kind = 'identifier'").select(F.col("token").alias("name"), F.lit(1).alias("n"))
    d = spark.createDataFrame([(w, 0) for w in WORDS], "name string, n int").unionAll(toks).groupBy("name").agg(F.sum("n").alias("n_tokens"))
    return d.select("name", facts.is_data_access(F.col("name")).alias("is_access"), F.coalesce(facts.host_word(F.col("name")), F.lit("")).alias("word"), "n_tokens")


def _in(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_HOST = f"""
WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|"[^"\\n]*"|#[^#\\n]*#|[^\\sA-Za-z0-9_]')) AS name, 1 AS n FROM conversations),
a AS (SELECT name, 0 AS n FROM (VALUES {', '.join(f'({w!r})' for w in WORDS)}) v(name) UNION ALL SELECT * FROM t WHERE regexp_matches(name, '^[A-Za-z_]'))
SELECT name, lower(name) IN {_in(fixed.DATA_ACCESS_NAMES)} AS is_access, CASE WHEN lower(name) IN {_in(fixed.HOST_TYPES)} THEN 'type' WHEN lower(name) IN {_in(fixed.HOST_CONSTANTS)} THEN 'constant' WHEN lower(name) IN {_in(fixed.HOST_MEMBERS)} THEN 'member' ELSE '' END AS word, sum(n)::BIGINT AS n_tokens
FROM a GROUP BY name"""


def node_predicates(spark, sf_dir):
    """Kinds of graph nodes by what they can carry."""
    kinds = sorted({*facts.NOT_TRANSFER, *facts.NOT_ACCESS, *facts.MAY_RAISE})
    d = spark.createDataFrame([(k,) for k in kinds], "kind string")
    return d.select("kind", facts.is_transfer_node(F.col("kind")).alias("transfer"), facts.is_access_node(F.col("kind")).alias("access"), facts.may_raise(F.col("kind")).alias("raises"))


_NODES = f"SELECT kind, kind NOT IN {_in(facts.NOT_TRANSFER)} AS transfer, kind NOT IN {_in(facts.NOT_ACCESS)} AS access, kind IN {_in(facts.MAY_RAISE)} AS raises FROM (VALUES {', '.join(f'({k!r})' for k in sorted({*facts.NOT_TRANSFER, *facts.NOT_ACCESS, *facts.MAY_RAISE}))}) t(kind)"

HANDLED = "Sub A()\nOn Error GoTo bad\nx = 1\nOn Error Resume Next\ny = 2\nOn Error GoTo 0\nz = 3\nExit Sub\nbad:\nResume Next\nEnd Sub\n"


def error_flow(spark, sf_dir):
    """Edges that errors take, by policy, in a handled procedure and in one without handlers."""
    s = spark.createDataFrame([("H", HANDLED), ("M", SOURCE)], "module string, source string")
    return facts.error_edges(s).where("module = 'H' or proc = 1").groupBy("module", "policy", "cond").agg(F.count("*").alias("n_edges"))


_ERRORS = "SELECT module, policy, cond, n::BIGINT AS n_edges FROM (VALUES ('H', 'bad', 'error handled', 1), ('H', 'bad', 'resume', 1), ('H', 'next', 'error ignored', 1), ('H', 'none', 'unhandled error', 1), ('M', 'none', 'unhandled error', 1)) t(module, policy, cond, n)"


def simple_variables(spark, sf_dir):
    """Parts' names that are exactly one identifier, and absolute addresses."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    ref = F.concat(F.lit("$A$"), "p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit(":$B$9")).otherwise(F.lit(":B9")))
    return p.select("p_partkey", F.coalesce(facts.simple_variable(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))), F.lit("")).alias("variable"), facts.is_absolute(ref).alias("absolute"))


_SIMPLE = "SELECT p_partkey, CASE WHEN p_size > 25 THEN CASE WHEN regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_]*') THEN p_brand ELSE '' END ELSE CASE WHEN regexp_full_match(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), '[A-Za-z_][A-Za-z0-9_]*') THEN regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') ELSE '' END END AS variable, p_size % 2 = 0 AS absolute FROM part"


def designer_mask(spark, sf_dir):
    """Form preambles masked up to the first attribute, offsets kept: documents taken as preambles, by name of file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = docs.select("doc_id", F.element_at(F.array(*[F.lit(n) for n in FILES]), (F.col("doc_id") % len(FILES) + 1).cast("int")).alias("name"), F.concat(F.coalesce("text", F.lit("")), F.lit('\r\nAttribute VB_Name = "F"\n'), F.coalesce("text", F.lit(""))).alias("source"))
    m = facts.designer_masked(F.col("name"), F.col("source"))
    return d.select("doc_id", "name", F.octet_length(m).cast("long").alias("n_bytes"), F.md5(m.cast("binary")).alias("masked_md5"))


FILES = ("a.frm", "b.bas", "c.CLS")
_BLANK = "array_to_string(list_transform(string_split(t, chr(10)), lambda x: array_to_string(list_transform(string_split(x, chr(13)), lambda y: repeat(' ', strlen(y))), chr(13))), chr(10))"
_MASK = f"""
WITH d AS (SELECT doc_id, (['a.frm', 'b.bas', 'c.CLS'])[doc_id % 3 + 1] AS name, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, name, CASE WHEN name = 'b.bas' THEN t ELSE {_BLANK} END || chr(13) || chr(10) || 'Attribute VB_Name = "F"' || chr(10) || t AS m FROM d)
SELECT doc_id, name, strlen(m)::BIGINT AS n_bytes, md5(m) AS masked_md5 FROM m"""

QUERIES = {
    f.__name__: f
    for f in (condition_prefixes, access_predicates, access_value_flows, path_final_state, constant_sources, path_feasibility, unassociated_facts, shared_formulas, structured_references, host_names, node_predicates, error_flow, simple_variables, designer_mask)
}
ORACLES = {
    "condition_prefixes": _PREFIX, "access_predicates": _PREDICATES, "access_value_flows": _FLOWS, "path_final_state": _FINAL, "constant_sources": _CONSTANTS, "path_feasibility": _FEASIBLE, "unassociated_facts": _UNASSOCIATED, "shared_formulas": _SHARED, "structured_references": _STRUCTURED, "host_names": _HOST, "node_predicates": _NODES, "error_flow": _ERRORS, "simple_variables": _SIMPLE, "designer_mask": _MASK,
}
