"""Tables of parsed VBA sources: tokens, procedures, statements, expressions, graphs, facts and types.

Sources are (module string, source string); parsing runs in Arrow batches, what follows is joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import vbalang as L
from tamarack.operators.graphs import cut

_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _rows(sources: DataFrame, make, schema: str) -> DataFrame:
    """Rows make(source) of each module; a source that can't be read is a row with its error in the last column."""
    fields = [f.split() for f in schema.split(", ")]
    names, kinds = [f[0] for f in fields], [_KINDS[f[1]] for f in fields]

    def run(batches):
        for b in batches:
            out = []
            for module, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(module, *r, None) for r in make(source or "")]
                except (ValueError, RecursionError, IndexError) as e:
                    out.append((module, *[None] * (len(names) - 2), str(e) or type(e).__name__))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return sources.select("module", "source").mapInArrow(run, schema)


def tokens(sources: DataFrame) -> DataFrame:
    """Exact tokens: (module, pos, kind, text, start, end, line, column, error)."""
    return _rows(sources, lambda s: [(k, t.kind, t.text, t.start, t.end, t.line, t.column) for k, t in enumerate(L.lex(s))], "module string, pos long, kind string, text string, start long, end long, line long, column long, error string")


def active_source(sources: DataFrame, constants: dict | None = None) -> DataFrame:
    """(module, source, problems, error) after conditional compilation with the caller's constants."""

    def make(s):
        text, problems = L.preprocess(s, constants)
        return [(text, "; ".join(f"{n}: {p}" for n, p in problems))]

    return _rows(sources, make, "module string, source string, problems string, error string")


def procedures(sources: DataFrame) -> DataFrame:
    """(module, proc, name, kind, params, line, end_line, error)."""
    return _rows(sources, lambda s: [(k, p["name"], p["kind"], p["params"], p["line"], p["end_line"]) for k, p in enumerate(L.parse(s)[0])], "module string, proc long, name string, kind string, params string, line long, end_line long, error string")


def statements(sources: DataFrame) -> DataFrame:
    """(module, proc, stmt, parent, ordinal, kind, text, start, end, line, error), parents before children."""

    def make(source):
        for k, p in enumerate(L.parse(source)[0]):
            out: list[tuple] = []

            def visit(s, parent, ordinal, out=out, k=k):
                me = len(out)
                out.append((k, me, parent, ordinal, s.kind, s.text, *s.span))
                for n, c in enumerate(s.children):
                    visit(c, me, n)

            for n, s in enumerate(p["body"]):
                visit(s, -1, n)
            yield from out

    return _rows(sources, lambda s: list(make(s)), "module string, proc long, stmt long, parent long, ordinal long, kind string, text string, start long, end long, line long, error string")


def graph_nodes(sources: DataFrame) -> DataFrame:
    """(module, proc, name, node_id, kind, label, line, complete, error)."""

    def make(s):
        for k, p in enumerate(L.parse(s)[0]):
            g = L.Graph().build(p["body"])
            for n in g.nodes:
                yield (k, p["name"], *n, g.complete)

    return _rows(sources, lambda s: list(make(s)), "module string, proc long, name string, node_id long, kind string, label string, line long, complete boolean, error string")


def graph_edges(sources: DataFrame) -> DataFrame:
    """(module, proc, src, dst, cond, ord, error)."""

    def make(s):
        for k, p in enumerate(L.parse(s)[0]):
            g = L.Graph().build(p["body"])
            for n, e in enumerate(g.edges):
                yield (k, *e, n)

    return _rows(sources, lambda s: list(make(s)), "module string, proc long, src long, dst long, cond string, ord long, error string")


def expressions(sources: DataFrame) -> DataFrame:
    """Expression nodes of assignments' right sides and of calls: (module, proc, line, target, node, parent, ordinal, kind, text, error)."""

    def make(source):
        def visit(body, k):
            for s in body:
                if s.kind in ("assignment", "object_assignment"):
                    at = next(j for j, t in enumerate(s.tokens) if t.text == "=" and j)
                    target = L.render([t for t in s.tokens[:at] if t.text.lower() not in ("let", "set")])
                    for n in L.walk(L.parse_expression(s.tokens[at + 1 :])):
                        yield (k, s.span[2], target, *n)
                yield from visit(s.children, k)

        for k, p in enumerate(L.parse(source)[0]):
            yield from visit(p["body"], k)

    return _rows(sources, lambda s: list(make(s)), "module string, proc long, line long, target string, node long, parent long, ordinal long, kind string, text string, error string")


def calls(sources: DataFrame) -> DataFrame:
    """(module, proc, line, callee) of statements that call: Call x, x args, and names that are indexed in assignments."""
    st = statements(sources)
    direct = st.where("kind in ('call', 'call_or_expression')").select("module", "proc", "line", F.regexp_extract("text", r"(?i)^(?:call\s+)?([A-Za-z_][\w.]*)", 1).alias("callee"))
    ex = expressions(sources)
    parent = ex.where("kind = 'index'").select("module", "proc", "line", "target", F.col("node").alias("parent"))
    inside = ex.where("kind = 'name' and ordinal = 0").join(parent, ["module", "proc", "line", "target", "parent"]).select("module", "proc", "line", F.col("text").alias("callee"))
    return direct.where("callee <> ''").unionByName(inside).distinct()


def call_edges(sources: DataFrame) -> DataFrame:
    """(module, proc, line, callee, target_module, target_proc, state): calls resolved to the project's procedures by folded name."""
    p = procedures(sources).where("error is null").select(F.col("module").alias("target_module"), F.col("proc").alias("target_proc"), F.lower("name").alias("folded"))
    c = calls(sources).withColumn("folded", F.lower(F.element_at(F.split("callee", r"\."), -1)))
    j = c.join(p, "folded", "left")
    w = Window.partitionBy("module", "proc", "line", "callee")
    n = F.count("target_proc").over(w)
    state = F.when(n == 0, "external").when(n == 1, "unique").otherwise("ambiguous")
    return j.select("module", "proc", "line", "callee", "target_module", "target_proc", state.alias("state"))


ENTRY_EVENTS = (("workbook_", "workbook_event_candidate"), ("worksheet_", "worksheet_event_candidate"), ("auto_", "legacy_excel_auto_macro_candidate"), ("app_", "excel_application_event_handler_candidate"), ("document_", "document_event_candidate"))


def entry_points(sources: DataFrame) -> DataFrame:
    """(module, name, trigger): procedures that a host or a user starts."""
    from tamarack.operators.stomping import is_auto_exec

    p = procedures(sources).where("error is null")
    low = F.lower("name")
    trigger = F.lit(None).cast("string")
    for prefix, t in reversed(ENTRY_EVENTS):
        trigger = F.when(low.startswith(prefix), t).otherwise(trigger)
    manual = (F.col("kind") == "sub") & F.col("params").rlike(r"^\(\s*\)|^$")
    out = p.withColumn("trigger", F.coalesce(trigger, F.when(is_auto_exec(F.col("name")), "auto_macro_candidate"), F.when(manual, "manual_macro_candidate")))
    return out.where("trigger is not null").select("module", "name", "trigger")


# Types

TYPES = ("Byte", "Boolean", "Integer", "Long", "LongLong", "Single", "Double", "Currency", "Date", "String", "Variant", "Object")
_WHOLE = ("Byte", "Boolean", "Integer", "Long", "LongLong")
_REAL = ("Single", "Double", "Currency")


def binary_type(op: str, a: str, b: str) -> str:
    """Static type of a binary operator's result."""
    op = op.lower()
    both = {a, b}
    if op == "is":
        return "Boolean"
    if "Variant" in both or "Object" in both:
        return "Variant"
    if op in ("=", "<>", "<", ">", "<=", ">=", "like"):
        return "Boolean"
    if op == "&":
        return "String"
    whole = None
    if both <= set(_WHOLE):
        whole = "Byte" if both == {"Byte"} else "LongLong" if "LongLong" in both else "Long" if "Long" in both else "Integer"
    if op in ("and", "or", "xor", "eqv", "imp"):
        if both == {"Boolean"}:
            return "Boolean"
        return whole or ("LongLong" if "LongLong" in both else "Long")
    if op in ("^", "/"):
        return "Double"
    if op in ("\\", "mod"):
        return whole or "Long"
    if op == "+" and both == {"String"}:
        return "String"
    if "Date" in both:
        return "Double" if op == "*" or op == "-" and both == {"Date"} else "Date"
    if "Currency" in both:
        return "Double" if op == "*" and both & {"Single", "Double", "String"} else "Currency"
    if both & {"Double", "String"}:
        return "Double"
    if "Single" in both:
        return "Double" if both & {"Long", "LongLong"} else "Single"
    return whole


OPERATORS = ("+", "-", "*", "/", "\\", "Mod", "^", "&", "=", "<", "Like", "Is", "And", "Or", "Xor", "Eqv", "Imp")


def type_table(spark) -> DataFrame:
    """(op, left_type, right_type, result_type): the lattice as a table to join with."""
    rows = [(op.lower(), a, b, binary_type(op, a, b)) for op in OPERATORS for a in TYPES for b in TYPES]
    return spark.createDataFrame(rows, "op string, left_type string, right_type string, result_type string")


_SUFFIX = {"%": "Integer", "&": "Long", "^": "LongLong", "@": "Currency", "!": "Single", "#": "Double", "$": "String"}


def literal_type(kind, text):
    """Type of a literal's text by its kind; null for other kinds."""
    last = F.right(text, F.lit(1))
    by_suffix = F.lit(None).cast("string")
    for s, t in _SUFFIX.items():
        by_suffix = F.when(last == s, t).otherwise(by_suffix)
    number = F.coalesce(by_suffix, F.when(~text.startswith("&") & text.rlike("[.eEdD]"), "Double"), F.when(text.try_cast("int").between(-32768, 32767), "Integer"), F.lit("Long"))
    low = F.lower(text)
    return F.when(kind == "number", number).when(kind == "string", "String").when(kind == "date", "Date").when((kind == "literal") & low.isin("true", "false"), "Boolean").when((kind == "literal") & (low == "nothing"), "Object").when(kind == "literal", "Variant")


def infer_types(nodes: DataFrame, declared: DataFrame, key: list[str], depth: int = 8) -> DataFrame:
    """nodes (key, node, parent, ordinal, kind, text) with type, level by level from the leaves up.

    declared (name folded, type). A round types the nodes whose operands have types; after `depth` rounds
    the rest are Variant. The number of rounds is a bound on the trees' height, not on the rows.
    """
    d = declared.select(F.col("name").alias("decl_name"), F.col("type").alias("decl_type"))
    cur = nodes.join(d, (F.lower("text") == F.col("decl_name")) & (F.col("kind") == "name"), "left")
    cur = cur.withColumn("type", F.coalesce(literal_type(F.col("kind"), F.col("text")), "decl_type", F.when(F.col("kind").isin("name", "index", "member", "dictionary", "with_target", "missing"), "Variant"))).drop("decl_name", "decl_type")
    table = type_table(nodes.sparkSession)
    for _ in range(depth):
        kids = cur.where("parent >= 0").groupBy(*key, F.col("parent").alias("node")).agg(F.max(F.when(F.col("ordinal") == 0, F.col("type"))).alias("left_type"), F.max(F.when(F.col("ordinal") == 1, F.col("type"))).alias("right_type"))
        j = cur.join(kids, [*key, "node"], "left").withColumn("op", F.lower("text")).join(F.broadcast(table), ["op", "left_type", "right_type"], "left")
        unary = F.when((F.col("kind") == "unary") & (F.col("op") == "not"), F.when(F.col("left_type").isin("Boolean", "Byte", "Integer", "LongLong", "Variant"), F.col("left_type")).when(F.col("left_type").isNotNull(), "Long")).when(F.col("kind") == "unary", F.when(F.col("left_type").isin("Byte", "Boolean"), "Integer").when(F.col("left_type") == "String", "Double").otherwise(F.col("left_type")))
        typed = F.coalesce("type", F.when(F.col("kind") == "group", F.col("left_type")), F.when(F.col("kind") == "binary", F.col("result_type")), unary)
        # Each round reads the last one twice: cut, so that it isn't computed over and over.
        cur = cut(j.select(*nodes.columns, typed.alias("type")))
    return cur.withColumn("type", F.coalesce("type", F.lit("Variant")))


def assignment_status(target, value):
    """How an assignment of a value's type to a target's type stands; the first state that holds."""
    ranks = F.create_map(*[x for k, t in enumerate(("Byte", "Integer", "Long", "LongLong", "Single", "Double")) for x in (F.lit(t), F.lit(k))])
    widen = ranks[target].isNotNull() & ranks[value].isNotNull() | F.lower(target).isin("currency", "date") & ranks[value].isNotNull()
    return (
        F.when(target.isNull(), "target_type_unresolved").when((value == "LongLong") & ~F.lower(target).isin("longlong", "longptr", "variant"), "invalid_longlong_implicit_coercion").when(value == "Variant", "variant_or_host_dependent").when(F.lower(target) == F.lower(value), "compatible")
        .when(widen, "numeric_conversion_possible").when(F.lower(target).isin("string", "variant", "object"), "implicit_or_host_conversion_possible").when(value == "Object", "host_conversion_unresolved").otherwise("possible_type_mismatch")
    )
