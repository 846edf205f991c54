"""Path facts: predicates on graph nodes and names, conditions before a position, value flows, feasibility, errors.

Tables: paths (path_id, nodes array<long>, conditions array<string>), edges (src, dst, cond, ord), facts with
their path_id and pos. More key columns may stand before, given as `scope`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import fixed
from tamarack.functions import vbalang as L

# Kinds of graph nodes that cannot carry a transfer, cannot carry a data access, and can raise an error.
NOT_TRANSFER = ("entry", "exit", "decision", "case_test", "select_expression", "branch", "implicit_else", "loop_test", "for_repeat_test", "loop_body", "loop_exit", "case", "no_case_match", "label", "with")
NOT_ACCESS = ("entry", "exit", "branch", "implicit_else", "loop_body", "loop_exit", "no_case_match", "label", "goto", "termination")
MAY_RAISE = ("assignment", "call", "call_or_expression", "raise_event", "redim", "erase", "declaration", "decision", "case_test", "select_expression", "loop_test", "with", "unknown", "gosub", "gosub_return", "on_goto", "on_gosub")
# Transfers that define a simple target, and triggers that a host invokes directly.
DEFINES = ("assignment", "object_assignment", "constant_initializer", "function_return_candidate", "file_read_candidate", "byref_argument_write", "event_handler_byref_write_candidate", "default_member_byref_write_candidate")
HOST_ENTRIES = ("legacy_excel_auto_macro_candidate", "workbook_event_candidate", "worksheet_event_candidate", "manual_macro_candidate", "excel_ontime_scheduled_macro_candidate", "excel_application_event_handler_candidate")


def is_transfer_node(kind: Column) -> Column:
    return ~kind.isin(list(NOT_TRANSFER))


def is_access_node(kind: Column) -> Column:
    return ~kind.isin(list(NOT_ACCESS))


def may_raise(kind: Column) -> Column:
    return kind.isin(list(MAY_RAISE))


def defines_target(transfer: Column) -> Column:
    return transfer.isin(list(DEFINES))


def is_host_entry(trigger: Column) -> Column:
    return trigger.isin(list(HOST_ENTRIES))


def is_data_access(name: Column) -> Column:
    return F.lower(name).isin(list(fixed.DATA_ACCESS_NAMES))


def host_word(name: Column) -> Column:
    """type, constant, member or null: what a name is to the spreadsheet host."""
    low = F.lower(name)
    return F.when(low.isin(list(fixed.HOST_TYPES)), "type").when(low.isin(list(fixed.HOST_CONSTANTS)), "constant").when(low.isin(list(fixed.HOST_MEMBERS)), "member")


def simple_variable(text: Column) -> Column:
    """The name, if a text is exactly one identifier."""
    return F.nullif(F.regexp_extract(text, r"^\s*([\p{L}_][\p{L}\p{N}_]*[%&^@!#$]?)\s*$", 1), F.lit(""))


def is_absolute(reference: Column) -> Column:
    """Whether an A1 address has both dollars everywhere."""
    return reference.rlike(r"^(?:[^!]+!)?\$[A-Za-z]{1,3}\$\d+(?::\$[A-Za-z]{1,3}\$\d+)?$")


def not_shadowed(uses: DataFrame, symbols: DataFrame, name: str = "name") -> DataFrame:
    """Uses of intrinsics whose name no symbol of the project has."""
    return uses.withColumn("__folded", F.lower(name)).join(symbols.select(F.lower(name).alias("__folded")).distinct(), "__folded", "left_anti").drop("__folded")


def steps(paths: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path_id, pos, node_id, next_node) of the paths' nodes."""
    s = paths.select(*scope, "path_id", F.posexplode("nodes").alias("pos", "node_id"))
    return s.withColumn("next_node", F.lead("node_id").over(Window.partitionBy(*scope, "path_id").orderBy("pos")))


def conditions_before(paths: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, path_id, pos, conditions): conditions of the edges taken before each position of a path.

    Where parallel edges between two nodes have different conditions, theirs are left out and ambiguous is set.
    """
    one = edges.groupBy(*scope, "src", "dst").agg(F.count_distinct(F.coalesce("cond", F.lit(""))).alias("n"), F.min("cond").alias("cond"))
    s = steps(paths, scope)
    j = s.join(one, [*[s[c] == one[c] for c in scope], s["node_id"] == one["src"], s["next_node"] == one["dst"]], "left").select(*[s[c] for c in scope], "path_id", "pos", "node_id", F.when(F.col("n") == 1, F.col("cond")).alias("cond"), (F.col("n") > 1).alias("many"))
    w = Window.partitionBy(*scope, "path_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return j.select(*scope, "path_id", "pos", "node_id", F.collect_list("cond").over(w).alias("conditions"), F.coalesce(F.bool_or("many").over(w), F.lit(False)).alias("ambiguous"))


def access_value_flows(accesses: DataFrame, assignments: DataFrame, scope: list[str]) -> DataFrame:
    """Accesses (scope, path_id, pos, access_id, is_write) with assignments (scope, path_id, pos, flow_id, target, inputs array) at their position.

    A read flows into the target; a write takes each simple input. Each combination once, names folded.
    """
    j = accesses.join(assignments, [*scope, "path_id", "pos"])
    read = j.where("not is_write").select(*scope, "path_id", "access_id", "flow_id", F.lit("excel_read_to_variable_candidate").alias("role"), F.lower("target").alias("variable"))
    write = j.where("is_write").select(*scope, "path_id", "access_id", "flow_id", F.lit("variable_to_excel_write_candidate").alias("role"), F.explode("inputs").alias("variable")).withColumn("variable", F.lower("variable"))
    return read.unionAll(write).where("variable is not null").distinct()


def access_predicates(accesses: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, scope: list[str]) -> DataFrame:
    """Accesses (scope, path_id, pos, access_id) in condition nodes with the condition of the edge that the path takes there."""
    kinds = nodes.where(F.col("kind").isin("decision", "case_test", "loop_test")).select(*scope, "node_id")
    s = steps(paths, scope).join(kinds, [*scope, "node_id"])
    one = edges.groupBy(*scope, F.col("src").alias("node_id"), F.col("dst").alias("next_node")).agg(F.count_distinct(F.coalesce("cond", F.lit(""))).alias("n"), F.min("cond").alias("cond"))
    j = accesses.join(s, [*scope, "path_id", "pos"]).join(one.where("n = 1"), [*scope, "node_id", "next_node"], "left")
    return j.select(*scope, "path_id", "access_id", "cond", F.when(F.col("cond").isNull(), "unassociated").otherwise("edge_condition").alias("state"))


def final_state(events: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, name, value): variables' values at the end of each path of events (scope, pos, event, name, value).

    assign sets a name; erase unsets it; invalidate unsets every name of the path. Of a name only the last
    event counts, and only if nothing was invalidated after it: no fold over the path is needed. Events of one
    position count in order of name and value.
    """
    order = [F.col("pos").desc(), F.col("name").desc(), F.col("value").desc()]
    wiped = events.where("event = 'invalidate'").groupBy(*scope).agg(F.max("pos").alias("wiped"))
    named = events.where("event <> 'invalidate'").withColumn("r", F.row_number().over(Window.partitionBy(*scope, "name").orderBy(*order))).where("r = 1")
    j = named.join(wiped, scope, "left")
    return j.where("event = 'assign' and (wiped is null or pos > wiped)").select(*scope, "name", "value")


def constant_of(reads: DataFrame, constants: DataFrame) -> DataFrame:
    """reads (read_id, module, proc, name) with the unique visible constant: of the procedure, the module, or public.

    constants (module, proc or null, name, is_public, value). The nearest scope that has the name decides; if
    it has several, the read stays unresolved.
    """
    c = constants.withColumn("name", F.lower("name"))
    agg = (F.count("*").alias("n"), F.min("value").alias("v"))
    in_proc = c.where("proc is not null").groupBy("module", "proc", "name").agg(*agg).withColumnsRenamed({"n": "pn", "v": "pv"})
    in_module = c.where("proc is null").groupBy("module", "name").agg(*agg).withColumnsRenamed({"n": "mn", "v": "mv"})
    public = c.where("proc is null and is_public").groupBy("name").agg(*agg).withColumnsRenamed({"n": "gn", "v": "gv"})
    j = reads.withColumn("name", F.lower("name")).join(in_proc, ["module", "proc", "name"], "left").join(in_module, ["module", "name"], "left").join(public, "name", "left")
    value = F.when(F.col("pn").isNotNull(), F.when(F.col("pn") == 1, F.col("pv"))).when(F.col("mn").isNotNull(), F.when(F.col("mn") == 1, F.col("mv"))).when(F.col("gn") == 1, F.col("gv"))
    state = F.when(F.col("pn") == 1, "procedure").when(F.col("pn").isNull() & (F.col("mn") == 1), "module").when(F.col("pn").isNull() & F.col("mn").isNull() & (F.col("gn") == 1), "public").otherwise("unresolved")
    return j.select("read_id", value.alias("value"), state.alias("state"))


def feasibility(paths: DataFrame, constants: dict | None = None) -> DataFrame:
    """(path_id, feasibility): infeasible_constant_condition if a condition of the form (x) = True or False is known to fail."""
    known = {k.lower(): v for k, v in (constants or {}).items()}

    def fails(cond: str) -> bool:
        body, eq, want = cond.rpartition(") = ")
        if not eq or want not in ("True", "False"):
            return False
        tree = L.parse_expression([t for t in L.lex(body.removeprefix("(")) if t.kind not in ("newline", "eof")])
        v = L.constant(tree, known)
        return v is not None and not isinstance(v, str) and bool(v) != (want == "True")

    def run(batches):
        for b in batches:
            out = ["infeasible_constant_condition" if any(map(fails, c or ())) else "not_checked" for c in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["path_id", "feasibility"])

    return paths.select(F.col("path_id").cast("long").alias("path_id"), "conditions").mapInArrow(run, "path_id long, feasibility string")


def unassociated(facts: DataFrame, linked: DataFrame, key: list[str]) -> DataFrame:
    """Number of facts without a link: one row, n_unassociated."""
    return facts.join(linked.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("n_unassociated"))


def shared_formulas(followers: DataFrame, masters: DataFrame) -> DataFrame:
    """followers (sheet, shared, row, col) with the formula of the one master (sheet, shared, row1, row2, col1, col2, formula) around them."""
    m = masters.withColumn("n", F.count("*").over(Window.partitionBy("sheet", "shared")))
    j = followers.join(m, ["sheet", "shared"], "left")
    inside = (F.col("n") == 1) & F.col("row").between(F.col("row1"), F.col("row2")) & F.col("col").between(F.col("col1"), F.col("col2"))
    state = F.when(F.col("n").isNull(), "no_master").when(F.col("n") > 1, "ambiguous_master").when(inside, "resolved").otherwise("outside_master")
    return j.select("sheet", "shared", "row", "col", F.when(inside, F.col("formula")).alias("formula"), state.alias("state")).distinct()


def structured_bounds(references: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """references (ref_id, table_name, section, column_name) as bounds in tables (table_name, row1, row2, col1, col2, header_rows, total_rows) with columns (table_name, column_name, ordinal)."""
    fold = lambda d, *cs: d.withColumns({c: F.lower(c) for c in cs})
    r = fold(references, "table_name", "column_name")
    j = r.join(fold(tables, "table_name"), "table_name", "left").join(fold(columns, "table_name", "column_name"), ["table_name", "column_name"], "left")
    first, last = F.col("row1") + F.col("header_rows"), F.col("row2") - F.col("total_rows")
    sec = F.coalesce(F.lower("section"), F.lit("#data"))
    top = F.when(sec == "#all", F.col("row1")).when(sec == "#headers", F.when(F.col("header_rows") > 0, F.col("row1"))).when(sec == "#totals", F.when(F.col("total_rows") > 0, last + 1)).otherwise(first)
    end = F.when(sec == "#all", F.col("row2")).when(sec == "#headers", F.when(F.col("header_rows") > 0, first - 1)).when(sec == "#totals", F.when(F.col("total_rows") > 0, F.col("row2"))).otherwise(last)
    at = F.col("col1") + F.col("ordinal")
    named = F.col("column_name").isNotNull()
    state = F.when(F.col("row1").isNull(), "unknown_table").when(named & F.col("ordinal").isNull(), "unknown_column").when(top.isNull(), "no_section").otherwise("resolved")
    ok = state == "resolved"
    return j.select("ref_id", F.when(ok, top).alias("row_from"), F.when(ok, end).alias("row_to"), F.when(ok, F.when(named, at).otherwise(F.col("col1"))).alias("col_from"), F.when(ok, F.when(named, at).otherwise(F.col("col2"))).alias("col_to"), state.alias("state"))


ERROR_EDGES = "module string, proc long, src long, dst long, cond string, policy string"


def error_edges(sources: DataFrame, max_states: int = 100_000) -> DataFrame:
    """Edges that errors take: a walk of each graph's (node, policy, fault) states.

    Policies are none (the error leaves the procedure), next (the statement is skipped) and a handler's
    label. A fault while a handler runs leaves the procedure; Resume ends it. A walk of over max_states
    states ends there, with a row that has the condition "truncated" and no nodes.
    """

    def walk(body):
        g = L.Graph().build(body)
        out = []
        after: dict[int, list[int]] = {}
        for a, b, _ in g.edges:
            after.setdefault(a, []).append(b)
        kind = {n: (k, t.lower()) for n, k, t, _ in g.nodes}
        seen, work = set(), [(g.entry, "none", None)]
        while work and len(seen) < max_states:
            state = work.pop()
            if state in seen:
                continue
            seen.add(state)
            n, policy, fault = state
            k, t = kind[n]
            if k == "on_error":
                policy = "next" if "resume next" in t else "none" if t.split()[-1] in ("0", "-1") else t.split()[-1]
            if k in MAY_RAISE:
                if fault is not None or policy == "none":
                    out.append((n, g.exit, "unhandled error", policy))
                elif policy == "next":
                    out += [(n, d, "error ignored", policy) for d in after.get(n, [])]
                elif policy in g.labels:
                    out.append((n, g.labels[policy], "error handled", policy))
                    work.append((g.labels[policy], policy, n))
            if k == "resume" and fault is not None:
                to = after.get(fault, []) if "next" in t else [fault] if t == "resume" else [g.labels[x] for x in t.split()[-1:] if x in g.labels]
                out += [(n, d, "resume", policy) for d in to]
                work += [(d, policy, None) for d in to]
                continue
            work += [(d, policy, fault) for d in after.get(n, [])]
        cut = [(None, None, "truncated", None)] if work else []
        return sorted(set(out)) + cut

    def run(batches):
        for b in batches:
            rows = []
            for module, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for p, proc in enumerate(L.parse(source or "")[0]):
                    rows += [(module, p, *e) for e in walk(proc["body"])]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["module", "proc", "src", "dst", "cond", "policy"])

    return sources.select("module", "source").mapInArrow(run, ERROR_EDGES)


def gosub_returns(edges: list[tuple], calls: dict[int, tuple[int, int]], returns: set[int], entry: int, max_depth: int = 64, max_states: int = 100_000) -> tuple[list[tuple], bool]:
    """Edges (src, dst, depth) of a graph whose subroutine calls {node: (target, node after)} return where they came from.

    A walk of (node, stack) states; whether a bound cut it is the second result.
    """
    after: dict[int, list[int]] = {}
    for a, b, *_ in edges:
        after.setdefault(a, []).append(b)
    out, seen, work, cut = set(), set(), [(entry, ())], False
    while work:
        if len(seen) >= max_states:
            return sorted(out), True
        n, stack = work.pop()
        if (n, stack) in seen:
            continue
        seen.add((n, stack))
        if n in calls:
            if len(stack) >= max_depth:
                cut = True
                continue
            nxt = [(calls[n][0], (*stack, calls[n][1]))]
        elif n in returns:
            nxt = [(stack[-1], stack[:-1])] if stack else []
        else:
            nxt = [(d, stack) for d in after.get(n, [])]
        for d, s in nxt:
            out.add((n, d, len(s)))
            work.append((d, s))
    return sorted(out), cut


def designer_masked(name: Column, source: Column) -> Column:
    """Source of a class or form module with what stands before its first Attribute VB_Name line masked by spaces, a byte each."""
    at = F.call_function("regexp_instr", source, F.lit(r"(?mi)^[ \t]*attribute vb_name"))
    head = F.left(source, at - 1)
    # A character of several bytes becomes as many spaces, so that byte offsets stay.
    wide = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"[\x{10000}-\x{10FFFF}]", "    "), r"[\x{800}-\x{FFFF}]", "   "), r"[\x{80}-\x{7FF}]", "  ")
    masked = F.concat(F.regexp_replace(wide, r"[^\r\n]", " "), F.substr(source, at))
    return F.when(F.lower(name).rlike(r"\.(cls|frm)$") & (at > 1), masked).otherwise(source)
