"""Control-flow graphs: paths, reachability, chains of edges, decision tables, DOT."""

from __future__ import annotations

import tempfile
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _walk(after: dict, entry: int, exit: int, max_depth: int):
    """(nodes, conditions, stop reason) of each path from entry, in depth-first order; after: edges (dst, cond) by node."""
    nodes, conds, todo = [], [], [(entry, None, 0)]
    while todo:
        node, cond, depth = todo.pop()
        del nodes[depth:], conds[depth:]
        again = node in nodes
        nodes.append(node)
        conds.append(cond)
        out = after.get(node)
        if again:
            stop = "cycle_pruned"
        elif node == exit:
            stop = "exit"
        elif len(nodes) >= max_depth:
            stop = "depth_limit"
        else:
            stop = None if out else "dead_end"
        if stop:
            yield list(nodes), [c for c in conds if c is not None], stop
        else:
            todo.extend((dst, c, len(nodes)) for dst, c in reversed(out))


def paths(edges: DataFrame, roots: DataFrame, graph: list[str], max_depth: int = 128, limit: int = 256) -> DataFrame:
    """Paths of each graph from its entry: (graph, path_no, nodes, conditions, stop_reason, truncated).

    edges: (graph, src, dst, cond or null, ord), parallel ones each for itself; roots: (graph, entry, exit), one
    row a graph. A path ends at a node that it has visited (cycle_pruned), at the exit, with max_depth nodes
    (depth_limit) or at a node without edges (dead_end), tested in that order; it is complete only where it ends at
    the exit. The first `limit` in depth-first order are given; truncated, of a whole graph, is whether there
    are more or a path was cut at a cycle or by its depth. No more than limit + 1 paths are ever made. The edges of
    one graph, a procedure, are one row; graphs spread over tasks. A graph of roots without edges has the path of
    its entry alone; edges of graphs that roots doesn't name are ignored, as are null ends.
    """
    ends = edges.where("src is not null and dst is not null")
    lists = ends.groupBy(*graph).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("src", "ord", "dst")], "cond"))).alias("edges")).select(*graph, F.col("edges.src").alias("src"), F.col("edges.dst").alias("dst"), F.col("edges.cond").alias("cond"))
    starts = roots.select(*graph, F.col("entry").cast("long").alias("entry"), F.col("exit").cast("long").alias("exit"))
    rows = starts.join(lists, graph, "left") if graph else starts.join(lists)
    found = [("path_no", T.LongType()), ("nodes", T.ArrayType(T.LongType())), ("conditions", T.ArrayType(T.StringType())), ("stop_reason", T.StringType()), ("truncated", T.BooleanType())]
    schema = T.StructType([rows.schema[k] for k in graph] + [T.StructField(n, t) for n, t in found])
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.bool_()]
    k = len(graph)

    def run(batches):
        for b in batches:
            at, out = [], []

            def flush():
                keys = [b.column(i).take(pa.array(at, pa.int64())) for i in range(k)]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                return pa.RecordBatch.from_arrays(keys + cols, names=[f.name for f in schema])

            for row, (entry, exit, src, dst, cond) in enumerate(zip(*[b.column(i).to_pylist() for i in range(k, k + 5)], strict=True)):
                after: dict = {}
                for s, d, c in zip(src or (), dst or (), cond or (), strict=True):
                    after.setdefault(s, []).append((d, c))
                every = list(islice(_walk(after, entry, exit, max_depth), limit + 1))
                cut = len(every) > limit or any(stop in ("cycle_pruned", "depth_limit") for _, _, stop in every)
                out += [(n, nodes, conds, stop, cut) for n, (nodes, conds, stop) in enumerate(every[:limit], 1)]
                at += [row] * min(len(every), limit)
                if len(out) >= 8192:
                    yield flush()
                    at, out = [], []
            if out:
                yield flush()

    return rows.mapInArrow(run, schema)


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(root, node) of the nodes reachable from roots (root), each root included: a semi-naive closure.

    Each round joins only the pairs that the last one added; rounds are cut from their lineage.
    """
    from_to = edges.select(F.col("src").alias("node"), "dst").distinct()
    seen = roots.select("root", F.col("root").alias("node")).distinct()
    new = seen
    for k in range(max_rounds):
        step = new.join(from_to, "node").select("root", F.col("dst").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
        step = cut(step)
        if step.isEmpty():
            return seen
        seen = seen.unionAll(step)
        if k % 8 == 7:
            seen = cut(seen)
        new = step
    raise RuntimeError("reachability did not settle")


def cut(df: DataFrame) -> DataFrame:
    """df from the shared checkpoint folder, without its lineage; a temporary folder where the session names none."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tamarack-"))
    return df.checkpoint()


def chains(edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """Chains of direct edges (src, dst, infeasible) of 1 to max_hops hops without a repeated node: (nodes, hops, infeasible)."""
    e = edges.select("src", "dst", "infeasible").distinct()
    cur = e.select(F.array("src", "dst").alias("nodes"), F.lit(1).cast("long").alias("hops"), "infeasible", F.col("dst").alias("last"))
    out = cur
    nxt = e.select(F.col("src").alias("last"), F.col("dst").alias("to"), F.col("infeasible").alias("more"))
    for _ in range(max_hops - 1):
        cur = cur.join(nxt, "last").where(~F.array_contains("nodes", F.col("to")))
        cur = cur.select(F.concat("nodes", F.array("to")).alias("nodes"), (F.col("hops") + 1).alias("hops"), (F.col("infeasible") | F.col("more")).alias("infeasible"), F.col("to").alias("last"))
        out = out.unionAll(cur)
    return out.drop("last")


#: Kinds of nodes that are structure, not actions.
STRUCTURAL = ("entry", "exit", "decision", "branch", "implicit_else", "select_expression", "case_test", "case", "no_case_match", "loop_test", "loop_body", "loop_exit")


def decision_rows(found: DataFrame, nodes: DataFrame, graph: list[str]) -> DataFrame:
    """(graph, path_no, conditions, actions): of each path the labels of its action nodes in order; nodes (graph, node_id, kind, label)."""
    path = [*graph, "path_no"]
    acting = nodes.where(~F.col("kind").isin(list(STRUCTURAL))).select(*graph, "node_id", "label")
    steps = found.select(*path, F.posexplode("nodes").alias("pos", "node_id")).join(acting, [*graph, "node_id"])
    acts = steps.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("x")).select(*path, F.col("x.label").alias("actions"))
    return found.join(acts, path, "left").select(*path, "conditions", F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))


def dot(nodes: DataFrame, edges: DataFrame, graph: list[str]) -> DataFrame:
    """(graph, dot): Graphviz text of each graph; nodes (graph, node_id, label), edges (graph, src, dst, cond, ord)."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(*graph, F.lit(0).alias("part"), F.col("node_id").cast("long").alias("o"), F.concat(F.lit("  n"), F.col("node_id").cast("string"), F.lit(" [label="), quote(F.col("label")), F.lit("];")).alias("line"))
    label = F.when(F.col("cond").isNull(), "").otherwise(F.concat(F.lit(" [label="), quote(F.col("cond")), F.lit("]")))
    e = edges.select(*graph, F.lit(1).alias("part"), F.col("ord").cast("long").alias("o"), F.concat(F.lit("  n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), label, F.lit(";")).alias("line"))
    g = n.unionAll(e).groupBy(*graph).agg(F.array_sort(F.collect_list(F.struct("part", "o", "line"))).alias("x"))
    return g.select(*graph, F.concat(F.lit("digraph g {\n"), F.array_join(F.col("x.line"), "\n"), F.lit("\n}\n")).alias("dot"))
