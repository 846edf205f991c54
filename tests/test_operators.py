import pytest
from pyspark.sql import functions as F

from tamarack.functions import excel, formula, vba
from tamarack.operators import exports, facts, graphs, joins, rules, stomping, text
from tamarack.operators import vba as parsed
from tamarack.sources import containers, formats, workbook
from tamarack.streaming import monitor


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_containment_ties_and_buckets(spark):
    nodes = spark.createDataFrame([("p", 1, 0, 10), ("p", 2, 2, 8), ("p", 3, 2, 8), ("p", 4, 20, 30), ("q", 5, 0, 9)], "s string, node_id long, n_start long, n_end long")
    told = spark.createDataFrame([("p", 1, 3, 4), ("p", 2, 9, 10), ("p", 3, 22, 22), ("p", 4, 21, 29), ("q", 5, 1, 2), ("q", 6, 8, 12)], "s string, fact_id long, f_start long, f_end long")
    want = [("p", 2, 1), ("p", 4, 4), ("q", 5, 5)]
    assert rows(joins.containment(told, nodes, ["s"])) == want
    assert rows(joins.containment(told, nodes, ["s"], bucket=10)) == want


def test_reaching_definitions_at_one_position(spark):
    f = spark.createDataFrame([("v", 1, 1, True), ("v", 2, 1, True), ("v", 3, 1, False), ("v", 4, 2, False), ("v", 5, 2, True), ("v", 6, 3, False)], "s string, fact_id long, pos long, is_write boolean")
    got = {(r.read_id, r.def_id) for r in joins.reaching_definitions(f, ["s"]).collect()}
    assert got == {(3, None), (4, 1), (4, 2), (6, 5)}


def test_range_cells_limit(spark):
    cells = spark.createDataFrame([(1, r, c) for r in range(1, 6) for c in range(1, 4)], "sheet int, row int, col int")
    ranges = spark.createDataFrame([(1, 1, 2, 3, 1, 2), (2, 1, 9, 9, 1, 1)], "range_id int, sheet int, row1 int, row2 int, col1 int, col2 int")
    assert rows(joins.range_cells(cells, ranges, limit=3)) == [(1, 1, 2, 1, True), (1, 1, 2, 2, True), (1, 1, 3, 1, True)]
    assert rows(joins.range_cells(cells, ranges)) == rows(joins.range_cells(cells, ranges, tile=2))


def test_error_byref_and_return_joins(spark):
    sites = spark.createDataFrame([(1, "f", None, True), (2, "f", "resume_next", False), (3, "f", None, False)], "site_id int, callee string, policy string, may_raise boolean")
    exits = spark.createDataFrame([(9, "f")], "exit_id int, procedure string")
    assert rows(joins.error_propagation(sites, exits)) == [(1, 9, "default_error_policy_may_propagate_to_caller"), (2, 9, "caller_resumes_next")]
    args = spark.createDataFrame([(1, "f", 0), (2, "f", 1)], "arg_id int, callee string, ordinal int")
    params = spark.createDataFrame([(7, "f", 0, True), (8, "f", 1, False)], "param_id int, callee string, ordinal int, by_ref boolean")
    assert rows(joins.byref_writes(args, params, spark.createDataFrame([(5, 7), (6, 8)], "write_id int, param_id int"))) == [(1, 7, 5)]
    uses = spark.createDataFrame([(1, "Total")], "use_id int, callee string")
    defs = spark.createDataFrame([(3, "total", "TOTAL"), (4, "total", "other")], "def_id int, procedure string, target string")
    assert rows(joins.return_uses(uses, defs)) == [(1, 3)]


def test_paths_by_graph(spark):
    rows_ = [(0, 1, None, 0), (1, 2, "a", 0), (1, 3, "b", 1), (2, 9, None, 0), (3, 9, None, 0)]
    rows_ = [("p", *r) for r in rows_] + [("q", 0, 1, None, 0), ("q", 1, 0, "x", 1), ("q", 1, 5, "y", 0), ("r", 0, 5, None, 0), ("stray", 0, 1, None, 0), ("p", None, 3, None, 0)]
    e = spark.createDataFrame(rows_, "g string, src long, dst long, cond string, ord long")
    roots = spark.createDataFrame([("p", 0, 9), ("q", 0, 9), ("r", 0, 9), ("s", 0, 9), ("t", 9, 9)], "g string, entry long, exit long")
    got = [(r.g, r.path_no, r.nodes, r.conditions, r.stop_reason, r.truncated) for r in graphs.paths(e, roots, ["g"]).orderBy("g", "path_no").collect()]
    assert got == [
        ("p", 1, [0, 1, 2, 9], ["a"], "exit", False), ("p", 2, [0, 1, 3, 9], ["b"], "exit", False), ("q", 1, [0, 1, 5], ["y"], "dead_end", True), ("q", 2, [0, 1, 0], ["x"], "cycle_pruned", True),
        ("r", 1, [0, 5], [], "dead_end", False), ("s", 1, [0], [], "dead_end", False), ("t", 1, [9], [], "exit", False),
    ]
    p = roots.where("g = 'p'")
    assert [r.stop_reason for r in graphs.paths(e, p, ["g"], max_depth=3).collect()] == ["depth_limit", "depth_limit"]
    assert [(r.nodes, r.truncated) for r in graphs.paths(e, p, ["g"], limit=1).collect()] == [([0, 1, 2, 9], True)]


def test_paths_stop_at_the_limit(spark):
    """Forty decisions in a row have 2 ** 40 paths; no more than the limit and one are made."""
    e = spark.createDataFrame([(k, k + 1, c, o) for k in range(40) for o, c in enumerate("ab")], "src long, dst long, cond string, ord long")
    got = graphs.paths(e, spark.createDataFrame([(0, 40)], "entry long, exit long"), [], limit=5).orderBy("path_no").collect()
    assert [r.conditions[-3:] for r in got] == [list(x) for x in ("aaa", "aab", "aba", "abb", "baa")] and all(r.truncated for r in got)


def test_stomping_weaponised(spark):
    m = spark.createDataFrame([("M", "Sub Nice()\nEnd Sub", None, 4, 4)], "module string, source string, source_error string, pcode_lines long, pcode_instructions long")
    n = spark.createDataFrame([("M", "procedure", "EvilPayload"), ("M", "literal", "powershell -nop"), ("M", "literal", "https://x/y"), ("M", "call", "URLDownloadToFileA")], "module string, kind string, name string")
    r = stomping.reports(m, n, ["module"]).first()
    assert (r.score, r.severity, r.is_stomped) == (100, "Critical", True)
    kinds = [f.kind for f in stomping.findings(m, n, ["module"]).collect()]
    assert sorted(kinds) == ["ProcedureHiddenInPCode", "ProcedureMissingInPCode", "SensitiveCallInPCode", "SuspiciousLiteralInPCode", "SuspiciousLiteralInPCode"]


def test_detectors_and_rules(spark):
    p = spark.createDataFrame([("ppt/viewProps.xml", 'x="\\\\host\\share\\y" a="ms-msdt:/id"'), ("xl/worksheets/sheet1.xml", "＝pythonw|'/c x'!A0"), ("word/numbering.xml", "powershell -enc"), ("word/document.xml", "nothing here")], "part string, content string")
    got = {(r.part, r.rule_id, r.detector) for r in rules.scan_parts(p, ["part"]).collect()}
    assert ("ppt/viewProps.xml", "VBA-CELL-092", "uncCoercion") in got and ("ppt/viewProps.xml", "VBA-CELL-092", "dangerousProtocol") in got
    assert ("xl/worksheets/sheet1.xml", "VBA-CELL-001", "cloakedDde") in got and ("word/numbering.xml", "VBA-CELL-093", "stagedCommand") in got
    assert not [g for g in got if g[0] == "word/document.xml"]


@pytest.mark.parametrize(("pattern", "yes", "no"), [("a*b", "a\nxb", "abc"), ("[!a-c]?", "dx", "ax"), ("#[]x", "1x", "x1"), ("a.b", "a.b", "axb"), ("[]", "", "a")])
def test_like(spark, pattern, yes, no):
    d = spark.createDataFrame([(yes, no)], "y string, n string")
    assert tuple(d.select(vba.like(F.col("y"), pattern), vba.like(F.col("n"), pattern)).first()) == (True, False)


def test_scalar_corners(spark):
    d = spark.createDataFrame([("a😀b", 3)], "s string, n long")
    r = d.select(vba.utf16_len(F.col("s")).alias("u"), vba.instrrev(F.lit("abcabc"), F.lit("bc"), F.lit(5)).alias("r"), vba.val(F.lit(" -12abc")).alias("v"), vba.chr_(F.lit(200)).alias("c"), excel.roman(F.lit(1994)).alias("m"), excel.column_label(F.lit(16384)).alias("x"), vba.cint(F.lit(2.5)).alias("h")).first()
    assert tuple(r) == (4, 2, -12, None, "MCMXCIV", "XFD", 2)
    fnv = spark.createDataFrame([(b"",), (b"a",), (b"foobar",)], "b binary").select(vba.fnv1a64(F.col("b"))).collect()
    assert [r[0] for r in fnv] == ["CBF29CE484222325", "AF63DC4C8601EC8C", "85944171F73967E8"]


def test_columns_beyond_a_sheet(spark):
    ns = [1, 26, 27, 702, 703, 16384, 16385, 18278, 18279, 475254, 475255, 2**53 + 1, 26**13, 2**63 - 1]
    d = spark.createDataFrame([(n, formula.column_label(n)) for n in ns], "n long, want string")
    label = excel.column_label(F.col("n"))
    got = d.select("n", "want", label.alias("label"), excel.column_number(label).alias("back")).collect()
    assert [(r.label, r.back) for r in got] == [(r.want, r.n) for r in got] and len(got) == len(ns)
    bad = d.limit(1).select(excel.column_label(F.lit(-(2**63))), excel.column_label(F.lit(0)), excel.column_label(F.lit(None).cast("long")), excel.column_number(F.lit("A1")), excel.column_number(F.lit("")), excel.column_number(F.lit("Z" * 40))).first()
    assert tuple(bad) == (None,) * 6


def test_decode_bytes(spark):
    d = spark.createDataFrame([(b"\xef\xbb\xbfhi", None), ("hé".encode("utf-16"), None), (b"\xff", None), (b"\xe9", 1252), ("é".encode(), 65001)], "b binary, cp int")
    assert [r[0] for r in d.select(text.decode_bytes(F.col("b"), F.col("cp"))).collect()] == ["hi", "hé", None, "é", "é"]


def test_bad_files_are_rows(spark):
    good = formats.zip_write([("a", b"x")])
    d = spark.createDataFrame([("g", good), ("b", b"PK\x03\x04broken"), ("n", None)], "path string, content binary")
    got = {r.path: (r.name, r.error) for r in containers.zip_entries(d).collect()}
    assert got["g"] == ("a", None) and got["b"][1] and got["n"] == (None, "no content")


def test_part_targets():
    assert workbook.part_target("xl/workbook.xml", "worksheets/s.xml") == "xl/worksheets/s.xml"
    assert workbook.part_target("xl/workbook.xml", "/docProps/a%2Ebc.xml") == "docProps/a.bc.xml"
    assert workbook.part_target("xl/w.xml", "a%00b") == "xl/a%00b"
    with pytest.raises(formats.FormatError):
        workbook.part_target("xl/workbook.xml", "../../etc")


def test_parsed_sources_errors(spark):
    s = spark.createDataFrame([("M", "Sub A()\nIf x Then\nEnd Sub"), ("N", None)], "module string, source string")
    assert [(r.name, r.end_line) for r in parsed.procedures(s).collect()] == [("A", 3)]
    assert {r.kind for r in parsed.statements(s).collect()} == {"if", "then_branch"}
    assert parsed.binary_type("+", "Integer", "Double") == "Double" and parsed.binary_type("-", "Date", "Date") == "Double" and parsed.binary_type("Mod", "Byte", "Byte") == "Byte"


def test_exports(spark):
    f = spark.createDataFrame([("k", "A1", "DDE", "Critical", "x|y\nz")], "key string, coordinate string, kind string, severity string, description string")
    assert "| A1 | DDE | Critical | x\\|y z |" in exports.markdown(f, ["key"]).first().markdown
    log = exports.sarif(f, ["key"]).first().sarif
    assert '"ruleId":"VBA-CELL-001","level":"error"' in log and '"version":"2.1.0"' in log


def test_streaming_scan(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("k", "2024-01-01 00:10:00", "High", 60), ("k", "2024-01-01 00:20:00", "Low", 30), ("j", "2024-01-01 05:00:00", "Low", 5)], "key string, ts string, severity string, weight int").select("key", F.to_timestamp("ts").alias("ts"), "severity", "weight").write.parquet(folder)
    stream = spark.readStream.schema("key string, ts timestamp, severity string, weight int").parquet(folder)
    q = monitor.windowed_scores(stream, "ts", ["key"]).writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.key, r.score, r.severity, r.is_stomped) for r in spark.table("scores").collect()) == [("j", 5, "Low", False), ("k", 90, "Critical", True)]


def test_every_rule_with_parts_has_a_scope_and_presence_counts(spark):
    known = {n for n, _, _ in rules.SCOPES} | {n for n, _ in rules.PRESENT}
    assert known == set(range(1, 95)) - {9}  # the ninth is that of formulas' values
    assert {d for _, _, ds in rules.SCOPES for d in ds} <= set(rules.PRIMITIVES)
    p = spark.createDataFrame([("xl/macrosheets/sheet1.xml", None), ("word/embeddings/ole.bin", ""), ("xl/dialogsheets/sheet1.xml", "<x:FmlaMacro>Run</x:FmlaMacro>"), (None, "cmd.exe")], "part string, content string")
    got = {(r.part, r.rule_id, r.detector) for r in rules.scan_parts(p, ["part"]).collect()}
    assert got == {("xl/macrosheets/sheet1.xml", "VBA-CELL-008", "present"), ("word/embeddings/ole.bin", "VBA-CELL-011", "present"), ("xl/dialogsheets/sheet1.xml", "VBA-CELL-027", "dialogMacro")}


def test_cut_cells_and_states_are_marked(spark):
    sheet = b'<worksheet xmlns="m"><sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'
    parts = spark.createDataFrame([("w", "xl/worksheets/sheet1.xml", sheet)], "path string, name string, content binary")
    assert [(r.cell, r.error) for r in workbook.raw_cells(parts, 2).collect()] == [("A1", None), ("B1", None), (None, "cells truncated")]
    assert [(r.cell, r.error) for r in workbook.raw_cells(parts, 3).collect()] == [("A1", None), ("B1", None), ("C1", None)]
    s = spark.createDataFrame([("M", "Sub A()\nx = 1\ny = 2\nEnd Sub\n")], "module string, source string")
    assert "truncated" in {r.cond for r in facts.error_edges(s, max_states=1).collect()}
    assert "truncated" not in {r.cond for r in facts.error_edges(s).collect()}


def test_identifier_names(spark):
    from tamarack.functions import pcode

    d = spark.createDataFrame([(c, v, w) for c, v, w in [(0x208, 7, False), (0x20E, 7, True), (0x200, 7, True), (0x200, 6, False), (0x202, 6, True), (0x204, 6, True), (2, 6, False), (0x186, 7, False), (0x186, 6, False)]], "c int, v int, w boolean")
    reserved = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.concat(F.lit("r"), k.cast("string")))
    name = pcode.identifier_name(F.col("c"), F.array(F.lit("a"), F.lit("b")), reserved, F.col("v"), F.col("w"))
    assert [r[0] for r in d.select(name).collect()] == ["a", "a", "a", "a", "b", "id_0204", "r1", "r194", "r195"]


def test_translate_opcode(spark):
    from tamarack.functions import pcode

    d = spark.createDataFrame([(67, 3, True), (68, 3, True), (239, 3, False), (69, 5, False), (171, 5, False), (173, 6, False), (174, 7, False), (200, 6, False), (200, 7, True), (None, 3, True), (5, None, True)], "o int, v int, w boolean")
    got = [r[0] for r in d.select(pcode.translate_opcode(F.col("o"), F.col("v"), F.col("w"))).collect()]
    assert got == [67, 70, 263, 70, 182, 173, 175, 203, 200, None, None]
