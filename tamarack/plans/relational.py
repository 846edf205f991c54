"""Queries of the join, window, graph and set operators over the driver's tables and small fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tamarack.operators import exports, graphs, joins


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def hidden_procedures_anti(spark, sf_dir):
    """Tokens of the benchmark that no document has: one list without another."""
    words = lambda t: _table(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return words("benchmark").distinct().join(words("documents").distinct(), "token", "left_anti")


_HIDDEN = "SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark) b WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) d WHERE d.token = b.token)"


def literal_missing_in_source(spark, sf_dir):
    """Benchmark texts with the number of documents that contain them, 0 included.

    A document that contains a text has its second and third words side by side: an equality to join on,
    before the containment is tested. Texts of under four words have none; they are compared with every document.
    """
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("lit"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("src"))
    inner = F.regexp_extract("lit", r"^\W*\w+\W+(\w+\W+\w+)\W", 1)
    keyed = items.withColumn("lead", F.regexp_replace(inner, r"\W+", " "))
    pairs = docs.select("doc_id", "src", F.explode(F.array_distinct(_pairs(F.col("src")))).alias("lead"))
    found = pairs.join(keyed.where("lead <> ''"), "lead").where(F.contains(F.col("src"), F.col("lit"))).select("item_id", "doc_id")
    short = keyed.where("lead = '' or lead is null")
    if not short.isEmpty():
        found = found.unionByName(docs.join(short, F.contains(F.col("src"), F.col("lit"))).select("item_id", "doc_id"))
    counts = found.distinct().groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"))


def _pairs(text):
    w = F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))
    return F.zip_with(w, F.slice(F.concat(w, F.array(F.lit(""))), 2, 1000000000), lambda a, b: F.concat(a, F.lit(" "), b))


_MISSING = "SELECT b.item_id, count(d.doc_id)::BIGINT AS n_documents FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id"


def line_count_divergence(spark, sf_dir):
    """Conversations whose assistant lines are over four times the user's, and over 20."""
    n = F.size(F.split("text", "\n", -1))
    g = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", n).otherwise(0)).alias("source_lines"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("compiled_lines"))
    return g.withColumn("diverges", (F.col("source_lines") > 0) & (F.col("compiled_lines") > F.col("source_lines") * 4) & (F.col("compiled_lines") > 20))


_DIVERGENCE = "SELECT *, source_lines > 0 AND compiled_lines > source_lines * 4 AND compiled_lines > 20 AS diverges FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS source_lines, sum(CASE WHEN role = 'assistant' THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS compiled_lines FROM conversations GROUP BY 1)"


def interval_containment_join(spark, sf_dir):
    """Each event in the one narrowest interval around it: between signups, or between purchases, of its user."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _micros("ts").alias("t"))
    w = Window.partitionBy("user_id", "event_type").orderBy("t")
    nodes = e.where("event_type in ('signup', 'purchase')").select("user_id", F.col("event_id").alias("node_id"), F.col("t").alias("n_start"), F.lead("t").over(w).alias("n_end")).where("n_end is not null")
    facts = e.select("user_id", F.col("event_id").alias("fact_id"), F.col("t").alias("f_start"), (F.col("t") + 1).alias("f_end"))
    return joins.containment(facts, nodes, ["user_id"])


_CONTAIN = """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
n AS (SELECT * FROM (SELECT user_id, event_id AS node_id, t AS s, lead(t) OVER (PARTITION BY user_id, event_type ORDER BY t) AS e FROM e WHERE event_type IN ('signup', 'purchase')) WHERE e IS NOT NULL),
j AS (SELECT e.user_id, e.event_id AS fact_id, n.node_id, rank() OVER (PARTITION BY e.event_id ORDER BY n.e - n.s) AS rk FROM e JOIN n ON e.user_id = n.user_id AND n.s <= e.t AND e.t + 1 <= n.e),
k AS (SELECT *, count(*) OVER (PARTITION BY fact_id) AS c FROM j WHERE rk = 1)
SELECT user_id, fact_id, node_id FROM k WHERE c = 1"""


def reaching_definitions(spark, sf_dir):
    """Views and clicks with the purchases and signups of the user's last earlier hour that has any."""
    e = _table(spark, sf_dir, "events").where("event_type <> 'error'")
    facts = e.select("user_id", F.col("event_id").alias("fact_id"), F.floor(_micros("ts") / F.lit(3600000000)).cast("long").alias("pos"), F.col("event_type").isin("purchase", "signup").alias("is_write"))
    return joins.reaching_definitions(facts, ["user_id"]).select("user_id", "read_id", F.coalesce("def_id", F.lit(-1)).alias("def_id"), "state")


_REACHING = """
WITH f AS (SELECT user_id, event_id AS id, floor(epoch_us(ts) / 3600000000)::BIGINT AS pos, event_type IN ('purchase', 'signup') AS w FROM events WHERE event_type <> 'error'),
g AS (SELECT *, max(CASE WHEN w THEN pos END) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dp FROM f)
SELECT r.user_id, r.id AS read_id, coalesce(d.id, -1) AS def_id, CASE WHEN d.id IS NULL THEN 'no_prior_local_definition_on_path' ELSE 'path_local_definition_candidate' END AS state
FROM g r LEFT JOIN f d ON d.user_id = r.user_id AND d.pos = r.dp AND d.w WHERE NOT r.w"""


def alias_dispatch(spark, sf_dir):
    """Each purchase with every earlier signup of its user."""
    e = _table(spark, sf_dir, "events")
    calls = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("call_id"), _micros("ts").alias("pos"))
    aliases = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("alias_id"), _micros("ts").alias("alias_pos"))
    return joins.earlier_aliases(calls, aliases, ["user_id"])


_ALIAS = """
WITH j AS (SELECT c.user_id, c.event_id AS call_id, a.event_id AS alias_id FROM events c JOIN events a ON a.user_id = c.user_id AND a.ts < c.ts WHERE c.event_type = 'purchase' AND a.event_type = 'signup')
SELECT *, CASE WHEN count(*) OVER (PARTITION BY call_id) = 1 THEN 'path_alias_typed_member_dispatch_candidate' ELSE 'ambiguous_path_alias_typed_member_dispatch' END AS state FROM j"""


def argument_snapshot(spark, sf_dir):
    """Each view with the value of its user's last purchase strictly before it."""
    e = _table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    out = joins.snapshot_before(e, ["user_id"], "ts", value, F.col("event_type") == "view")
    return out.select("event_id", F.coalesce("snapshot", F.lit(-1.0)).alias("snapshot"), F.when(F.col("snapshot").isNull(), "unresolved_caller_path_value").otherwise("caller_path_snapshot").alias("state"))


_SNAPSHOT = """
SELECT v.event_id, coalesce(p.value, -1.0) AS snapshot, CASE WHEN p.value IS NULL THEN 'unresolved_caller_path_value' ELSE 'caller_path_snapshot' END AS state
FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = v.user_id AND p.ts < v.ts"""


def consensus_values(spark, sf_dir):
    """The order status on which a customer's orders agree."""
    out = joins.consensus(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")
    return out.select("o_custkey", F.coalesce("value", F.lit("")).alias("value"), "n_values", "state")


_CONSENSUS = "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE '' END AS value, count(DISTINCT o_orderstatus)::BIGINT AS n_values, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'consensus' ELSE 'conflicting' END AS state FROM orders GROUP BY 1"


def unique_resolution(spark, sf_dir):
    """Names of customers, parts and neither, resolved to one key, several or none."""
    names = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("target")).unionAll(_table(spark, sf_dir, "part").select("p_name", "p_partkey"))
    asked = names.select("name").distinct().unionAll(spark.createDataFrame([("no such name",)], "name string"))
    return joins.resolve_unique(asked, names, "name", "target").select("name", F.coalesce("target", F.lit(-1)).alias("target"), "n_candidates", "state")


_UNIQUE = """
WITH n AS (SELECT c_name AS name, c_custkey AS target FROM customer UNION ALL SELECT p_name, p_partkey FROM part), a AS (SELECT DISTINCT name FROM n UNION ALL SELECT 'no such name')
SELECT a.name, CASE WHEN count(n.target) = 1 THEN min(n.target) ELSE -1 END AS target, count(n.target)::BIGINT AS n_candidates, CASE count(n.target) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM a LEFT JOIN n ON n.name = a.name GROUP BY 1"""


def name_scope_priority(spark, sf_dir):
    """Customers' segment names, defined for some nations and for all, resolved with the nation's first."""
    c = _table(spark, sf_dir, "customer")
    asked = c.select(F.col("c_custkey").alias("ref_id"), F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name"))
    own = c.where("c_nationkey < 8").groupBy(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("target"))
    common = c.where("c_mktsegment < 'F'").groupBy(F.col("c_mktsegment").alias("name")).agg(F.max("c_custkey").alias("target")).select(F.lit(None).cast("int").alias("scope"), "name", "target")
    return joins.scoped_name(asked, own.unionByName(common)).select("ref_id", F.coalesce("target", F.lit(-1)).alias("target"), "state")


_SCOPE = """
WITH o AS (SELECT c_nationkey AS scope, c_mktsegment AS name, min(c_custkey) AS target FROM customer WHERE c_nationkey < 8 GROUP BY 1, 2), g AS (SELECT c_mktsegment AS name, max(c_custkey) AS target FROM customer WHERE c_mktsegment < 'F' GROUP BY 1)
SELECT c.c_custkey AS ref_id, coalesce(o.target, g.target, -1) AS target, CASE WHEN o.target IS NOT NULL THEN 'local' WHEN g.target IS NOT NULL THEN 'common' ELSE 'unresolved' END AS state
FROM customer c LEFT JOIN o ON o.scope = c.c_nationkey AND o.name = c.c_mktsegment LEFT JOIN g ON g.name = c.c_mktsegment"""

RANGES = ((1, 1, 2, 1, 5), (2, 1, 7, 40, 50), (3, 3, 3, 1, 50), (4, 9, 9, 1, 50), (5, 2, 4, 10, 12))


def range2d_cells(spark, sf_dir):
    """Line items as cells (line number, quantity), counted in rectangles, with the first 50 kept of each."""
    cells = _table(spark, sf_dir, "lineitem").select(F.lit(1).alias("sheet"), F.col("l_linenumber").alias("row"), F.col("l_quantity").cast("int").alias("col"))
    ranges = spark.createDataFrame([(a, 1, b, c, d, e) for a, b, c, d, e in RANGES], "range_id int, sheet int, row1 int, row2 int, col1 int, col2 int")
    found = joins.range_cells(cells, ranges, tile=2)
    return found.groupBy("range_id", "row").agg(F.count("*").alias("n_cells"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


_RANGE = f"SELECT r.id AS range_id, l_linenumber AS row, count(*)::BIGINT AS n_cells, min(l_quantity)::INT AS first_col, max(l_quantity)::INT AS last_col FROM lineitem JOIN (VALUES {', '.join(map(str, RANGES))}) r(id, r1, r2, c1, c2) ON l_linenumber BETWEEN r1 AND r2 AND l_quantity::INT BETWEEN c1 AND c2 GROUP BY 1, 2"


def truncation_limits(spark, sf_dir):
    """The first three orders of each customer, with a mark where there are more."""
    out = joins.first_of_each(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3)
    return out.select("o_custkey", "o_orderkey", F.col("rank_in_group").cast("long").alias("rank_in_group"), "truncated")


_TRUNCATION = "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank_in_group, count(*) OVER (PARTITION BY o_custkey) > 3 AS truncated FROM orders) WHERE rank_in_group <= 3"


def interprocedural_arguments(spark, sf_dir):
    """Line items as arguments of calls to parts, parts as parameters, suppliers as reads of all their parts.

    A part is the callee, its size modulo 8 the parameter's position: each has one candidate, or none.
    """
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    args = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arg_id"), F.col("l_partkey").alias("callee"), F.col("l_linenumber").alias("ordinal"))
    params = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("param_id"), F.col("p_partkey").alias("callee"), (F.col("p_size") % 8).alias("ordinal"))
    reads = li.select((F.col("l_suppkey") * 1000000000 + F.col("l_partkey")).alias("read_id"), F.col("l_partkey").alias("param_id")).distinct()
    caller = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("arg_id"), (F.col("o_custkey") % 5).alias("caller_path"))
    callee = reads.select("read_id", (F.col("read_id") % 2).alias("callee_path"))
    return joins.argument_uses(args, params, reads, caller, callee).groupBy("read_id", "caller_path", "callee_path").agg(F.count("*").alias("n_arguments"))


_ARGUMENTS = """
WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS arg_id, l_partkey AS callee, l_linenumber AS ordinal, o_custkey % 5 AS caller_path FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT p_partkey AS param_id, p_partkey AS callee, p_size % 8 AS ordinal FROM part),
u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY callee, ordinal) AS n FROM p) WHERE n = 1),
r AS (SELECT DISTINCT l_suppkey * 1000000000 + l_partkey AS read_id, l_partkey AS param_id FROM lineitem),
x AS (SELECT DISTINCT a.arg_id, read_id, caller_path, read_id % 2 AS callee_path FROM a JOIN u USING (callee, ordinal) JOIN r ON r.param_id = u.param_id)
SELECT read_id, caller_path, callee_path, count(*)::BIGINT AS n_arguments FROM x GROUP BY ALL"""

EDGES = ((0, 1, None, 0), (1, 2, "a", 0), (1, 3, "b", 1), (2, 4, None, 0), (3, 4, None, 0), (3, 1, "loop", 1), (4, 9, None, 0), (2, 7, "odd", 1))
NODES = ((0, "entry", "entry"), (1, "decision", "If"), (2, "call", "DoA"), (3, "assignment", "x = 1"), (4, "call", "Done"), (9, "exit", "exit"), (7, "call", "Halt"))


def _order_graphs(spark, sf_dir):
    """Orders as procedures: (nodes, edges) with the order as g.

    A line leads to the next one; a returned line may also skip one, an open one go back to the first, and a line of
    49 pieces or more halts. Node 0 is the entry, 99 the exit.
    """
    li = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").cast("long").alias("node"))
    w = Window.partitionBy("g")
    n = li.agg(F.max(F.col("l_returnflag") == "R").alias("returned"), F.min(F.col("l_linestatus") == "O").alias("open"), F.max(F.col("l_quantity") >= 49).alias("halts"))
    after = lambda k: F.coalesce(F.lead("node", k).over(w.orderBy("node")), F.lit(99)).cast("long")
    n = n.withColumn("next", after(1)).withColumn("skip", after(2)).withColumn("first", F.min("node").over(w))
    edge = lambda src, dst, cond, ord: F.struct(src.cast("long").alias("src"), dst.cast("long").alias("dst"), cond.cast("string").alias("cond"), F.lit(ord).cast("long").alias("ord"))
    node, live = F.col("node"), ~F.col("halts")
    some = F.array(
        F.when(node == F.col("first"), edge(F.lit(0), node, F.lit(None), 0)),
        F.when(live, edge(node, F.col("next"), F.when(F.col("returned"), "kept"), 0)),
        F.when(live & F.col("returned"), edge(node, F.col("skip"), F.lit("returned"), 1)),
        F.when(live & F.col("open"), edge(node, F.col("first"), F.lit("again"), 2)),
    )
    edges = n.select("g", F.explode(F.filter(some, lambda x: x.isNotNull())).alias("e")).select("g", "e.*")
    label = F.when(F.col("halts"), F.concat(F.lit("Halt "), "node")).otherwise(F.concat(F.lit("Line "), "node"))
    ends = n.select("g").distinct().select("g", F.explode(F.array(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("node_id"))
    ends = ends.withColumn("kind", F.when(F.col("node_id") == 0, "entry").otherwise("exit")).withColumn("label", F.col("kind"))
    return n.select("g", node.alias("node_id"), F.when(F.col("returned"), "decision").otherwise("call").alias("kind"), label.alias("label")).unionAll(ends), edges


_ORDER_GRAPHS = """
l AS (SELECT l_orderkey AS g, l_linenumber::BIGINT AS node, bool_or(l_returnflag = 'R') AS returned, bool_and(l_linestatus = 'O') AS open, bool_or(l_quantity >= 49) AS halts FROM lineitem GROUP BY 1, 2),
v AS (SELECT *, coalesce(lead(node, 1) OVER w, 99) AS nx, coalesce(lead(node, 2) OVER w, 99) AS sk, min(node) OVER (PARTITION BY g) AS fi FROM l WINDOW w AS (PARTITION BY g ORDER BY node)),
e AS (SELECT g, 0::BIGINT AS src, node AS dst, NULL::VARCHAR AS cond, 0 AS ord FROM v WHERE node = fi UNION ALL SELECT g, node, nx, CASE WHEN returned THEN 'kept' END, 0 FROM v WHERE NOT halts
 UNION ALL SELECT g, node, sk, 'returned', 1 FROM v WHERE returned AND NOT halts UNION ALL SELECT g, node, fi, 'again', 2 FROM v WHERE open AND NOT halts),
n AS (SELECT g, node AS id, CASE WHEN returned THEN 'decision' ELSE 'call' END AS kind, CASE WHEN halts THEN 'Halt ' ELSE 'Line ' END || node AS label FROM l
 UNION ALL SELECT DISTINCT g, 0::BIGINT, 'entry', 'entry' FROM l UNION ALL SELECT DISTINCT g, 99::BIGINT, 'exit', 'exit' FROM l)"""

_PATHS = f"""
WITH RECURSIVE {_ORDER_GRAPHS},
o AS (SELECT g, src, count(*) AS outs FROM e GROUP BY 1, 2), x AS (SELECT e.*, o.outs FROM e LEFT JOIN o ON o.g = e.g AND o.src = e.dst),
p AS (SELECT DISTINCT g, 0::BIGINT AS cur, [0::BIGINT] AS nodes, []::VARCHAR[] AS conds, []::INT[] AS ords, NULL::VARCHAR AS stop FROM l
 UNION ALL SELECT p.g, x.dst, list_append(nodes, x.dst), CASE WHEN cond IS NULL THEN conds ELSE list_append(conds, cond) END, list_append(ords, x.ord),
  CASE WHEN list_contains(nodes, x.dst) THEN 'cycle_pruned' WHEN x.dst = 99 THEN 'exit' WHEN x.outs IS NULL THEN 'dead_end' END FROM p JOIN x ON x.g = p.g AND x.src = p.cur WHERE p.stop IS NULL),
r AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY ords) AS path_no, nodes, conds, stop, bool_or(stop = 'cycle_pruned') OVER (PARTITION BY g) AS truncated FROM p WHERE stop IS NOT NULL)
"""


def _order_paths(spark, sf_dir):
    nodes, edges = _order_graphs(spark, sf_dir)
    roots = nodes.select("g").distinct().select("g", F.lit(0).alias("entry"), F.lit(99).alias("exit"))
    return nodes, graphs.paths(edges, roots, ["g"])


def path_enumeration(spark, sf_dir):
    """Paths through every order's graph, with cycles and dead ends, in depth-first order."""
    _, out = _order_paths(spark, sf_dir)
    return out.select("g", "path_no", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), F.array_join("conditions", "&").alias("conditions"), "stop_reason", "truncated")


_ENUM = _PATHS + "SELECT g, path_no, array_to_string(nodes, '>') AS nodes, array_to_string(conds, '&') AS conditions, stop AS stop_reason, truncated FROM r"


def decision_table(spark, sf_dir):
    """The same paths as rows of conditions and actions."""
    nodes, found = _order_paths(spark, sf_dir)
    out = graphs.decision_rows(found, nodes, ["g"])
    return out.select("g", "path_no", F.array_join("conditions", "&").alias("conditions"), F.array_join("actions", ";").alias("actions"))


_DECISION = _PATHS + """, s AS (SELECT g, path_no, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS pos FROM r)
SELECT r.g, r.path_no, array_to_string(any_value(conds), '&') AS conditions, coalesce(string_agg(label, ';' ORDER BY pos), '') AS actions
FROM r LEFT JOIN (SELECT s.g, s.path_no, pos, label FROM s JOIN n USING (g, id) WHERE kind NOT IN ('entry', 'exit', 'decision')) a ON a.g = r.g AND a.path_no = r.path_no GROUP BY 1, 2"""


def _geo_edges(spark, sf_dir):
    """Regions to nations to suppliers: 1000 + region, 2000 + nation, 10000 + supplier."""
    n, s = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    a = n.select((F.col("n_regionkey") + 1000).cast("long").alias("src"), (F.col("n_nationkey") + 2000).cast("long").alias("dst"))
    return a.unionAll(s.select((F.col("s_nationkey") + 2000).cast("long"), (F.col("s_suppkey") + 10000).cast("long")))


_GEO = "e AS (SELECT n_regionkey + 1000 AS src, n_nationkey + 2000 AS dst FROM nation UNION ALL SELECT s_nationkey + 2000, s_suppkey + 10000 FROM supplier)"


def reachability(spark, sf_dir):
    """Nodes reachable from each region, counted."""
    e = _geo_edges(spark, sf_dir)
    roots = e.where("src < 2000").select(F.col("src").alias("root")).distinct()
    return graphs.reachable(e, roots).groupBy("root").agg(F.count("*").alias("n_nodes"), F.max("node").alias("last_node"))


_REACH = f"WITH RECURSIVE {_GEO}, c AS (SELECT DISTINCT src AS root, src AS node FROM e WHERE src < 2000 UNION SELECT root, dst FROM c JOIN e ON e.src = c.node) SELECT root::BIGINT AS root, count(*)::BIGINT AS n_nodes, max(node)::BIGINT AS last_node FROM c GROUP BY 1"


def return_chain(spark, sf_dir):
    """Chains of up to three edges, infeasible if an edge is."""
    e = _geo_edges(spark, sf_dir).withColumn("infeasible", F.col("dst") % 7 == 0)
    return graphs.chains(e, 3).groupBy("hops", "infeasible").agg(F.count("*").alias("n_chains"))


_CHAIN = f"WITH {_GEO}, x AS (SELECT DISTINCT src, dst, dst % 7 = 0 AS i FROM e), c AS (SELECT 1 AS hops, i FROM x UNION ALL SELECT 2, a.i OR b.i FROM x a JOIN x b ON a.dst = b.src) SELECT hops::BIGINT AS hops, i AS infeasible, count(*)::BIGINT AS n_chains FROM c GROUP BY ALL"


def dot_export(spark, sf_dir):
    """Graphviz text of every order's graph."""
    nodes, edges = _order_graphs(spark, sf_dir)
    return graphs.dot(nodes, edges, ["g"])


_DOT = f"""
WITH {_ORDER_GRAPHS},
t AS (SELECT g, 0 AS part, id AS o, '  n' || id || ' [label="' || label || '"];' AS line FROM n UNION ALL SELECT g, 1, ord, '  n' || src || ' -> n' || dst || CASE WHEN cond IS NULL THEN '' ELSE ' [label="' || cond || '"]' END || ';' FROM e)
SELECT g, 'digraph g {{' || chr(10) || string_agg(line, chr(10) ORDER BY part, o, line) || chr(10) || '}}' || chr(10) AS dot FROM t GROUP BY g"""


def redact_projection(spark, sf_dir):
    """Customers by label instead of name, conditions away."""
    c = _table(spark, sf_dir, "customer").select("c_nationkey", "c_name", F.col("c_mktsegment").alias("condition"))
    return exports.redact(c, ["c_nationkey"], "c_name", "module", ["condition"]).select("c_nationkey", "c_name", F.coalesce("condition", F.lit("")).alias("condition"))


_REDACT = "SELECT c_nationkey, 'module_' || dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS c_name, '' AS condition FROM customer"


def findings_markdown(spark, sf_dir):
    """The events of each user as a Markdown table."""
    e = _table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "High").otherwise("Low")
    rows = e.select("user_id", F.col("event_id").cast("string").alias("coordinate"), F.lit("DDE").alias("kind"), severity.alias("severity"), F.col("event_type").alias("description"))
    return exports.markdown(rows, ["user_id"])


_MARKDOWN = "SELECT user_id, '| Coordinate | Threat Kind | Severity | Description |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || event_id || ' | DDE | ' || CASE event_type WHEN 'error' THEN 'High' ELSE 'Low' END || ' | ' || event_type || ' |', chr(10) ORDER BY event_id::VARCHAR) || chr(10) AS markdown FROM events GROUP BY 1"


def sarif_json(spark, sf_dir):
    """Suspicious URLs of pages as SARIF, one run for each."""
    from tamarack.plans.detect import suspicious_literal_scan

    found = suspicious_literal_scan(spark, sf_dir).where("n_patterns > 0").select("page_id", F.lit("SuspiciousHyperlink").alias("kind"), "severity", F.col("patterns").alias("description"), F.concat(F.lit("page:"), "page_id").alias("coordinate"))
    return exports.sarif(found, ["page_id"])


QUERIES = {
    f.__name__: f
    for f in (
        hidden_procedures_anti, literal_missing_in_source, line_count_divergence, interval_containment_join, reaching_definitions, alias_dispatch, argument_snapshot, consensus_values, unique_resolution, name_scope_priority, range2d_cells, truncation_limits,
        interprocedural_arguments, path_enumeration, decision_table, reachability, return_chain, dot_export, redact_projection, findings_markdown, sarif_json,
    )
}
ORACLES = {
    "hidden_procedures_anti": _HIDDEN, "literal_missing_in_source": _MISSING, "line_count_divergence": _DIVERGENCE, "interval_containment_join": _CONTAIN, "reaching_definitions": _REACHING, "alias_dispatch": _ALIAS, "argument_snapshot": _SNAPSHOT, "consensus_values": _CONSENSUS,
    "unique_resolution": _UNIQUE, "name_scope_priority": _SCOPE, "range2d_cells": _RANGE, "truncation_limits": _TRUNCATION, "interprocedural_arguments": _ARGUMENTS, "path_enumeration": _ENUM, "decision_table": _DECISION, "reachability": _REACH, "return_chain": _CHAIN,
    "dot_export": _DOT, "redact_projection": _REDACT, "findings_markdown": _MARKDOWN,
}
