"""Queries of containers, parsed sources, compiled code and formulas.

The driver's tables hold no office files: these are made from its texts by the writers of sources.formats,
and unpacked again. Fixtures of source text stand for modules.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tamarack.functions import formula as X
from tamarack.functions import pcode
from tamarack.operators import exports, graphs, joins, stomping, vba
from tamarack.plans import detect
from tamarack.sources import containers, formats, workbook


def _pack(df, make):
    """(path, content) of rows (path, text), content made of the text."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([make(t or "") for t in b.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return df.mapInArrow(run, "path string, content binary")


def _texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("path"), "text")


def zip_entries(spark, sf_dir):
    """Archives of two entries made from benchmark texts, unpacked, with CRC-32 of what came out."""
    files = _pack(_texts(spark, sf_dir), lambda t: formats.zip_write([("a/text.txt", t.encode()), ("empty", b"")], deflate=True))
    out = containers.zip_entries(files)
    return out.select(F.col("path").cast("long").alias("item_id"), "name", "method", "size", F.col("content").cast("string").alias("text"), F.coalesce("error", F.lit("")).alias("error"))


_ZIP = "SELECT item_id, name, 8 AS method, strlen(t)::BIGINT AS size, t AS text, '' AS error FROM (SELECT item_id, 'a/text.txt' AS name, text AS t FROM benchmark UNION ALL SELECT item_id, 'empty', '' FROM benchmark)"


def _project(text: str) -> bytes:
    source = f"Attribute VB_Name = \"Main\"\r\nSub Main()\r\n' {text}\r\nEnd Sub\r\n".encode("cp1252", "replace")
    cache = formats.line_map_bytes([b"\x01\x00", b"", text.encode()[:8]])
    streams = {
        "VBA/dir": formats.ovba_compress(formats.ovba_directory_bytes("Project", [("Main", len(cache)), ("Ghost", 0)])),
        "VBA/Main": cache + formats.ovba_compress(source),
        "VBA/Ghost": b"\x00damaged",
        "PROJECT": b'Module=Main\r\nCMG="AA"\r\nName="Project"\r\n',
    }
    return formats.zip_write([("xl/vbaProject.bin", formats.cfb_write(streams)), ("xl/workbook.xml", b"<workbook/>")])


def vba_modules(spark, sf_dir):
    """Modules of macro containers made from benchmark texts: sources, manifest and errors."""
    m = containers.vba_modules(containers.vba_bytes(_pack(_texts(spark, sf_dir), _project)))
    lines = F.size(F.split(F.coalesce("source", F.lit("")), "\r\n"))
    return m.select(F.col("path").cast("long").alias("item_id"), "project", "module", "kind", "in_manifest", lines.cast("long").alias("n_lines"), F.coalesce("source_error", F.lit("")).alias("source_error"))


_MODULES = "SELECT item_id, 'Project' AS project, m.module, m.kind, m.in_manifest, m.n_lines, m.source_error FROM benchmark, (VALUES ('Main', 'module', true, 5::BIGINT, ''), ('Ghost', 'procedural', false, 1::BIGINT, 'no container signature')) m(module, kind, in_manifest, n_lines, source_error)"


def _identified(text: str) -> bytes:
    return formats.cfb_write({"VBA/_VBA_PROJECT": formats.project_identifiers_bytes([w for w in text.split(" ") if w])})


def vba_identifiers(spark, sf_dir):
    """Words of benchmark texts as the identifiers of macro projects, read back by the codes that compiled lines have for them."""
    found = containers.vba_identifiers(_pack(_texts(spark, sf_dir), _identified))
    projects = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("x")).select("path", F.col("x.name").alias("own"))
    # Codes one before the first identifier to one behind the last.
    codes = projects.select("path", "own", F.posexplode(F.sequence(F.lit(-1), F.size("own"))).alias("k", "at"))
    n = F.col("at") + 7 + F.when(F.col("at") >= 0xBF, 1).otherwise(0) + pcode.FIRST_OWN
    name = pcode.identifier_name(n * 2, F.col("own"), F.array().cast("array<string>"), F.lit(7), F.lit(True))
    return codes.select(F.col("path").cast("long").alias("item_id"), F.col("at").cast("long").alias("at"), name.alias("name"))


_IDENTIFIERS = """
WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS own FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT item_id, own, unnest(range(-1, len(own) + 1)) AS k FROM w WHERE len(own) > 0)
SELECT item_id, k AS "at", CASE WHEN k = len(own) THEN 'id_' || printf('%04X', 2 * (k + 7 + CASE WHEN k >= 191 THEN 1 ELSE 0 END + 256)) ELSE own[greatest(k, 0) + 1] END AS name FROM c"""


def opcode_translation(spark, sf_dir):
    """Opcodes of all versions, one for each line item, as those of version 7, counted."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    version = F.element_at(F.array(*[F.lit(v) for v in (3, 5, 6, 7)]), F.col("l_linenumber") % 4 + 1)
    d = li.select((F.col("l_partkey") % 264).alias("opcode"), version.alias("version"), (F.col("l_linestatus") == "O").alias("is_64bit"))
    return d.groupBy("opcode", "version", "is_64bit", pcode.translate_opcode(F.col("opcode"), F.col("version"), F.col("is_64bit")).alias("translated")).agg(F.count("*").alias("n"))


_OPCODES = f"""
WITH s(version, bound, shift) AS (VALUES {', '.join(f'({v}, {b or 1023}, {n})' for v, steps in pcode.OPCODE_SHIFTS.items() for b, n in steps)}),
d AS (SELECT l_partkey % 264 AS opcode, ([3, 5, 6, 7])[l_linenumber % 4 + 1] AS version, l_linestatus = 'O' AS is_64bit, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT opcode, version, is_64bit, CASE WHEN version >= 6 AND is_64bit THEN opcode ELSE opcode + (SELECT min(shift) FROM s WHERE s.version = least(d.version, 6) AND opcode <= bound) END AS translated, n FROM d"""


def container_stomping(spark, sf_dir):
    """Macro containers through unpacking, parsing and the stomping rules to one report each."""
    files = containers.vba_bytes(_pack(_texts(spark, sf_dir), _project))
    m = containers.vba_modules(files)
    lines = containers.pcode_lines(m.select(F.concat_ws("|", "path", "module").alias("path"), "cache")).where("line is not null").groupBy("path").agg(F.count("*").alias("pcode_lines"), F.sum((F.col("length") > 0).cast("long")).alias("pcode_instructions"))
    keyed = m.withColumn("k", F.concat_ws("|", "path", "module")).join(lines.withColumnRenamed("path", "k"), "k", "left")
    modules = keyed.select("path", "module", "source", "source_error", "pcode_lines", "pcode_instructions")
    names = spark.createDataFrame([], "path string, module string, kind string, name string")
    reports = stomping.reports(modules, names, ["path", "module"])
    extra = stomping.project_findings(m.select("path", "module"), m.where("in_manifest").select("path", "module"), containers.vba_attributes(files).select("path", "name"), ["path"])
    return stomping.project_report(reports, ["path"], extra).select(F.col("path").cast("long").alias("item_id"), "severity", "has_stomping", F.col("n_modules").cast("long").alias("n_modules"))


_CONTAINER = "SELECT item_id, 'High' AS severity, false AS has_stomping, 2::BIGINT AS n_modules FROM benchmark"

SOURCE = """Option Explicit
Private total As Long
Public Sub Main(ByVal x As Long)
  Dim a As Integer, s As String
  a = 1 + 2 * x
  If x > 3 Then
    s = "many " & a
  ElseIf x = 2 Then
    Call Helper(x)
  Else
    GoTo done
  End If
  Select Case x
    Case 1, 2 To 4: a = 2
    Case Is >= 9
      Exit Sub
    Case Else
      a = Twice(a) / 2
  End Select
  For i = 1 To 10 Step 2
    If i = 5 Then Exit For Else a = a + i
  Next i
  Do While a < 5
    a = a + 1
  Loop
done:
  MsgBox s
End Sub
Sub Helper(ByVal n As Long)
  total = total + n
End Sub
Function Twice(ByVal n As Long) As Double
  Twice = n * 2.5
End Function
Sub Workbook_Open()
  Main 4
End Sub
"""


def _sources(spark):
    return spark.createDataFrame([("M", SOURCE), ("Empty", "")], "module string, source string")


def vba_statements(spark, sf_dir):
    """Statements of a module, by procedure and kind."""
    return vba.statements(_sources(spark)).groupBy("proc", "kind").agg(F.count("*").alias("n_statements"))


_STATEMENTS = """SELECT proc::BIGINT AS proc, kind, n::BIGINT AS n_statements FROM (VALUES (0, 'declaration', 1), (0, 'assignment', 6), (0, 'if', 1), (0, 'then_branch', 2), (0, 'elseif_branch', 1), (0, 'else_branch', 2), (0, 'call', 1), (0, 'goto', 1),
 (0, 'select_case', 1), (0, 'case', 3), (0, 'exit', 2), (0, 'for', 1), (0, 'single_line_if', 1), (0, 'do', 1), (0, 'label', 1), (0, 'call_or_expression', 1), (1, 'assignment', 1), (2, 'assignment', 1), (3, 'call_or_expression', 1)) t(proc, kind, n)"""


def vba_graphs(spark, sf_dir):
    """Control-flow graph of the module's first procedure: nodes by kind."""
    return vba.graph_nodes(_sources(spark)).where("proc = 0").groupBy("kind", "complete").agg(F.count("*").alias("n_nodes"))


def vba_paths(spark, sf_dir):
    """Paths through the module's procedures by how they stop."""
    s = _sources(spark)
    key = ["module", "proc"]
    n = vba.graph_nodes(s)
    roots = n.groupBy(*key).agg(F.min(F.when(F.col("kind") == "entry", F.col("node_id"))).alias("entry"), F.max(F.when(F.col("kind") == "exit", F.col("node_id"))).alias("exit"))
    found = graphs.paths(vba.graph_edges(s).select(*key, "src", "dst", "cond", "ord"), roots, key)
    return found.groupBy("proc", "stop_reason").agg(F.count("*").alias("n_paths"), F.max(F.size("nodes")).cast("long").alias("longest"))


def vba_call_edges(spark, sf_dir):
    """Calls of the module resolved within it."""
    return vba.call_edges(_sources(spark)).select("proc", "callee", F.coalesce("target_proc", F.lit(-1)).alias("target_proc"), "state")


_CALLS = "SELECT proc::BIGINT AS proc, callee, target::BIGINT AS target_proc, state FROM (VALUES (0, 'Helper', 1, 'unique'), (0, 'Twice', 2, 'unique'), (0, 'MsgBox', -1, 'external'), (3, 'Main', 0, 'unique')) t(proc, callee, target, state)"


def vba_entry_points(spark, sf_dir):
    """Procedures that a host or a user starts."""
    return vba.entry_points(_sources(spark))


_ENTRIES = "SELECT 'M' AS module, 'Workbook_Open' AS name, 'workbook_event_candidate' AS trigger"


def vba_assignment_types(spark, sf_dir):
    """Static types of assigned expressions and how the assignments stand."""
    ex = vba.expressions(_sources(spark)).where("node is not null")
    declared = spark.createDataFrame([("a", "Integer"), ("x", "Long"), ("n", "Long"), ("s", "String"), ("total", "Long"), ("i", "Variant")], "name string, type string")
    typed = vba.infer_types(ex, declared, ["module", "proc", "line", "target"])
    targets = spark.createDataFrame([("a", "Integer"), ("s", "String"), ("total", "Long"), ("twice", "Double")], "name string, target_type string")
    out = typed.where("node = 0").join(targets, F.lower("target") == F.col("name"), "left")
    return out.select("proc", "line", "target", "type", vba.assignment_status(F.col("target_type"), F.col("type")).alias("status"))


_ASSIGNED = """SELECT proc::BIGINT AS proc, line::BIGINT AS line, target, type, status FROM (VALUES (0, 5, 'a', 'Long', 'numeric_conversion_possible'), (0, 7, 's', 'String', 'compatible'), (0, 14, 'a', 'Integer', 'compatible'), (0, 18, 'a', 'Variant', 'variant_or_host_dependent'),
 (0, 21, 'a', 'Variant', 'variant_or_host_dependent'), (0, 24, 'a', 'Integer', 'compatible'), (1, 30, 'total', 'Long', 'compatible'), (2, 33, 'Twice', 'Double', 'compatible')) t(proc, line, target, type, status)"""


def type_lattice(spark, sf_dir):
    """Result types of operators over pairs of types, counted."""
    return vba.type_table(spark).groupBy("op", "result_type").agg(F.count("*").alias("n_pairs"))


OPCODES = {1: ("LitDI2", ("word",), False), 2: ("Add", (), False), 3: ("St", ("name",), False), 4: ("LitStr", (), True), 5: ("ArgsCall", ("name", "word"), False), 6: ("FuncDefn", ("function",), False)}


def pcode_listing(spark, sf_dir):
    """Compiled lines of a caller's instruction set, disassembled, damage reported."""
    lines = spark.createDataFrame([("m", 0, bytes.fromhex("0100050001000700020003000100")), ("m", 1, bytes.fromhex("0400030041424300") + bytes.fromhex("0500020001 00".replace(" ", ""))), ("m", 2, bytes.fromhex("ff03")), ("m", 3, b"")], "path string, line long, code binary")
    out = containers.pcode_instructions(lines, OPCODES, {1: "x", 2: "MsgBox"})
    return out.select("line", F.coalesce("mnemonic", F.lit("")).alias("mnemonic"), F.array_join(F.coalesce("operands", F.array().cast("array<string>")), ",").alias("operands"), F.coalesce("error", F.lit("")).alias("error"))


_PCODE = "SELECT line::BIGINT AS line, mnemonic, operands, error FROM (VALUES (0, 'LitDI2', '5', ''), (0, 'LitDI2', '7', ''), (0, 'Add', '', ''), (0, 'St', 'x', ''), (1, 'LitStr', 'ABC', ''), (1, 'ArgsCall', 'MsgBox,1', ''), (2, '', '', 'unknown opcode 1023 at 0')) t(line, mnemonic, operands, error)"


def disassembly_markdown(spark, sf_dir):
    """The same listing as Markdown."""
    lines = spark.createDataFrame([("m", 0, bytes.fromhex("0100050001000700020003000100")), ("m", 1, bytes.fromhex("0400030041424300"))], "path string, line long, code binary")
    out = containers.pcode_instructions(lines, OPCODES, {1: "x", 2: "MsgBox"})
    return exports.disassembly_markdown(out.select("path", F.col("line").alias("line_no"), F.col("at").alias("instr_no"), "mnemonic", "operands"), ["path"])


_LISTING = "SELECT 'm' AS path, '```' || chr(10) || '    0  LitDI2 5' || chr(10) || '    0  LitDI2 7' || chr(10) || '    0  Add ' || chr(10) || '    0  St x' || chr(10) || '    1  LitStr ABC' || chr(10) || '```' || chr(10) AS markdown"


def stomping_json(spark, sf_dir):
    """Reports of documents taken as modules, and of samples, with their findings as JSON, read back field by field."""
    m, n = detect._stomp_tables(spark, sf_dir)
    out = exports.report_json(stomping.reports(m, n, ["module"]), stomping.findings(m, n, ["module"]), ["module"])
    field = lambda p: F.get_json_object("json", p)
    return out.select("module", field("$.severity").alias("severity"), field("$.score").cast("long").alias("score"), F.coalesce(field("$.findings[0].kind"), F.lit("")).alias("first_kind"))


_JSON = detect._STOMP_REPORTS.replace("SELECT module, score,", "SELECT module, (SELECT coalesce(min(kind), '') FROM found WHERE found.module = s.module) AS first_kind, score,", 1)
_JSON = f"SELECT module, severity, score, first_kind FROM ({_JSON})"


def formula_evaluation(spark, sf_dir):
    """A formula for each part, evaluated over the sheets of its brand's cells."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    # A million parts a sheet, which has rows for no more.
    base = part.select(F.col("p_brand").alias("path"), F.floor(F.col("p_partkey") / 1000000).cast("string").alias("sheet"), (F.pmod("p_partkey", F.lit(1000000)) + 1).alias("row"), "p_partkey", "p_name", "p_size")
    a = base.select("path", "sheet", "row", F.lit(1).cast("long").alias("col"), F.concat(F.lit("A"), "row").alias("cell"), F.col("p_size").cast("string").alias("value"), F.lit(None).cast("string").alias("formula"))
    b = base.select("path", "sheet", "row", F.lit(2).cast("long"), F.concat(F.lit("B"), "row"), F.col("p_name"), F.lit(None).cast("string"))
    text = F.format_string('IF(A%d>25,"big","small")&"-"&LEN(B%d)&"-"&CHAR(65+MOD(A%d,26))&"-"&UPPER(LEFT(B%d,3))', "row", "row", "row", "row")
    c = base.where("p_partkey > 0").select("path", "sheet", "row", F.lit(3).cast("long"), F.concat(F.lit("C"), "row"), F.lit(None).cast("string"), text)
    out = workbook.evaluate(a.unionAll(b).unionAll(c))
    key = F.col("sheet").cast("long") * 1000000 + F.substring("cell", 2, 7).cast("long") - 1
    return out.select("path", F.concat(F.lit("C"), key).alias("cell"), F.coalesce("result", F.lit("")).alias("result"), F.coalesce("error", F.lit("")).alias("error"))


_FORMULA = "SELECT p_brand AS path, 'C' || p_partkey AS cell, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END || '-' || length(p_name) || '-' || chr(65 + p_size % 26) || '-' || upper(left(p_name, 3)) AS result, '' AS error FROM part WHERE p_partkey > 0"

HIDDEN = (
    ("A1", 1, 1, None, 'CHAR(99)&CHAR(109)&CHAR(100)&"|\'/c calc\'!A0"'), ("A2", 2, 1, None, 'CHAR(BITXOR(73,42))&"md.exe /c x"'), ("A3", 3, 1, None, 'CHAR(INT(FVSCHEDULE(99,0)))&"md.exe"'), ("A4", 4, 1, "pow", None), ("A5", 5, 1, None, 'INDIRECT(ADDRESS(4,1))&"ershell -enc"'), ("A6", 6, 1, None, "SUM(1,2)"), ("A7", 7, 1, None, 'TEXTJOIN("",TRUE,MAP({104,116,116,112},LAMBDA(c,CHAR(c))))&"://h/x.exe"'),
)


def deobfuscated_formulas(spark, sf_dir):
    """Formulas whose value is a threat that their text hides."""
    grid = spark.createDataFrame([("w", "S", r, c, cell, v, f) for cell, r, c, v, f in HIDDEN], "path string, sheet string, row long, col long, cell string, value string, formula string")
    out = workbook.evaluate(grid).where(stomping.is_suspicious(F.col("result")) | F.col("result").rlike(r"^[\w.]+\|'"))
    kind = F.when(F.col("result").rlike(r"^[\w.]+\|'"), "DDE").otherwise("DeobfuscatedThreat")
    return out.select("cell", kind.alias("kind"), "result")


_DEOBFUSCATED = "SELECT * FROM (VALUES ('A1', 'DDE', 'cmd|''/c calc''!A0'), ('A2', 'DeobfuscatedThreat', 'cmd.exe /c x'), ('A3', 'DeobfuscatedThreat', 'cmd.exe'), ('A5', 'DeobfuscatedThreat', 'powershell -enc'), ('A7', 'DeobfuscatedThreat', 'http://h/x.exe')) t(cell, kind, result)"


def formula_reference_cells(spark, sf_dir):
    """A formula for each part, its references joined to the populated cells they cover."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    # A million parts a sheet, which has rows for no more.
    sheet, row = F.concat(F.lit("S"), F.floor(F.col("p_partkey") / 1000000)), F.col("p_partkey") % 1000000 + 1
    cells = part.select(sheet.alias("sheet"), row.alias("row"), (F.col("p_size") % 5 + 1).cast("long").alias("col"))
    f = part.select(F.lit("w").alias("path"), sheet.alias("sheet"), F.concat(F.lit("Z"), "p_partkey").alias("cell"), F.format_string('SUM(A%d:C%d)+$E$5&"A1"', row, row + 19).alias("formula"))
    bounds = ["sheet", "row1", "row2", "col1", "col2"]
    refs = workbook.formula_references(f).select(F.concat_ws("#", "cell", "ordinal").alias("range_id"), F.col("ref_sheet").alias("sheet"), *bounds[1:], "absolute")
    # Equal ranges meet the cells once, however many formulas have them.
    ranges = refs.select(*bounds).distinct().withColumn("range_id", F.struct(*bounds))
    counts = joins.range_cells(cells, ranges, tile=64).groupBy("range_id").agg(F.count("*").alias("n")).select("range_id.*", "n")
    return refs.join(counts, bounds, "left").select("range_id", "absolute", F.coalesce("n", F.lit(0)).alias("n_cells"))


_REFERENCES = """
WITH c AS (SELECT p_partkey AS k, p_partkey // 1000000 AS s, p_partkey % 1000000 + 1 AS r, p_size % 5 + 1 AS col FROM part)
SELECT 'Z' || k || '#0' AS range_id, false AS absolute, coalesce(n, 0)::BIGINT AS n_cells FROM c LEFT JOIN (SELECT f.k, count(*) AS n FROM c JOIN c AS f ON c.r >= f.r AND c.r <= f.r + 19 AND c.s = f.s WHERE c.col <= 3 GROUP BY f.k) USING (k)
UNION ALL SELECT 'Z' || k || '#1', true, coalesce(n, 0)::BIGINT FROM c LEFT JOIN (SELECT s, count(*) AS n FROM c WHERE r = 5 AND col = 5 GROUP BY s) USING (s)"""

WORKBOOK = (
    ("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" state="veryHidden" r:id="rId2"/></sheets><definedNames><definedName name="Auto_Open" hidden="1">One!$A$1</definedName></definedNames></workbook>'),
    ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Type="http://x/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://x/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>'),
    ("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>'),
    ("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1"><v>5</v></c><c r="C1"><f>A1&amp;B1</f></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'),
    ("xl/worksheets/sheet2.xml", '<!DOCTYPE x [<!ENTITY e "y">]><worksheet/>'),
)


def _workbook(spark):
    file = formats.zip_write([(n, t.encode()) for n, t in WORKBOOK])
    return containers.zip_entries(spark.createDataFrame([("w.xlsx", file)], "path string, content binary"))


def workbook_cells(spark, sf_dir):
    """Cells of a sample workbook with shared strings; a part that declares a document type is an error."""
    out = workbook.cells(_workbook(spark))
    return out.select("part", F.coalesce("cell", F.lit("")).alias("cell"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("formula", F.lit("")).alias("formula"), F.coalesce("error", F.lit("")).alias("error"))


_CELLS = "SELECT * FROM (VALUES ('xl/worksheets/sheet1.xml', 'A1', 'rich', '', ''), ('xl/worksheets/sheet1.xml', 'B1', '5', '', ''), ('xl/worksheets/sheet1.xml', 'C1', '', 'A1&B1', ''), ('xl/worksheets/sheet1.xml', 'D1', 'in', '', ''), ('xl/worksheets/sheet2.xml', '', '', '', 'document type declared')) t(part, cell, value, formula, error)"


def workbook_sheets(spark, sf_dir):
    """Sheets of the sample workbook with their parts and states."""
    return workbook.sheet_parts(_workbook(spark)).select("ordinal", "sheet", "state", "part")


_SHEETS = "SELECT * FROM (VALUES (0::BIGINT, 'One', 'visible', 'xl/worksheets/sheet1.xml'), (1::BIGINT, 'Two', 'veryHidden', 'xl/worksheets/sheet2.xml')) t(ordinal, sheet, state, part)"


def special_functions(spark, sf_dir):
    """Bessel, gamma, beta, t, F and chi-square functions over a range of arguments."""
    calls = ("BESSELJ(x,1)", "BESSELI(x,0)", "ERF(x)", "GAMMALN(x)", "GAMMA.DIST(x,2,1,TRUE)", "BETA.DIST(x/10,2,3,TRUE)", "T.DIST(x,5,TRUE)", "F.DIST(x,3,7,TRUE)", "CHISQ.DIST(x,4,TRUE)", "NORM.S.DIST(x,TRUE)")
    rows = spark.range(1, 9).select(F.explode(F.array(*[F.lit(c) for c in calls])).alias("call"), F.col("id"))

    def run(batches):
        for b in batches:
            out = [X.Evaluator({}).evaluate(c.replace("(x", f"({x}")) for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array([v if isinstance(v, float) else None for v in out], pa.float64())], ["call", "x", "value"])

    return rows.withColumnRenamed("id", "x").mapInArrow(run, "call string, x long, value double")


QUERIES = {
    f.__name__: f
    for f in (zip_entries, vba_modules, vba_identifiers, opcode_translation, container_stomping, vba_statements, vba_graphs, vba_paths, vba_call_edges, vba_entry_points, vba_assignment_types, type_lattice, pcode_listing, disassembly_markdown, stomping_json, formula_evaluation, deobfuscated_formulas, formula_reference_cells, workbook_cells, workbook_sheets, special_functions)
}
ORACLES = {
    "zip_entries": _ZIP, "vba_modules": _MODULES, "vba_identifiers": _IDENTIFIERS, "opcode_translation": _OPCODES, "container_stomping": _CONTAINER, "vba_statements": _STATEMENTS, "vba_call_edges": _CALLS, "vba_entry_points": _ENTRIES, "vba_assignment_types": _ASSIGNED, "pcode_listing": _PCODE, "disassembly_markdown": _LISTING, "stomping_json": _JSON, "formula_evaluation": _FORMULA, "deobfuscated_formulas": _DEOBFUSCATED,
    "formula_reference_cells": _REFERENCES, "workbook_cells": _CELLS, "workbook_sheets": _SHEETS,
}
