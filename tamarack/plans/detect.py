"""Queries of the detection operators: literals, calls, lines, compiled-code mismatch, scores, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import fixed
from tamarack.operators import rules, stomping, text


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(names) -> str:
    return ", ".join("('" + n.replace("'", "''") + "')" for n in names)


def suspicious_literal_scan(spark, sf_dir):
    """Every page's URL against the suspicious patterns, scored and banded."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    low = stomping.ascii_lower(F.col("url"))
    hits = F.filter(F.array(*[F.when(low.contains(p), F.lit(p)) for p in fixed.SUSPICIOUS_PATTERNS]), lambda x: x.isNotNull())
    n = F.size(hits)
    score = F.least(F.lit(100), n * 50)
    band = F.when(score >= 80, "Critical").when(score >= 50, "High").when(score >= 25, "Medium").when(score > 0, "Low").otherwise("Clean")
    return pages.select("page_id", n.cast("long").alias("n_patterns"), F.array_join(F.array_sort(hits), "|").alias("patterns"), score.cast("long").alias("score"), band.alias("severity"))


_SUSPICIOUS = f"""
SELECT p.page_id, count(v.pat)::BIGINT AS n_patterns, coalesce(string_agg(v.pat, '|' ORDER BY v.pat), '') AS patterns,
       least(100, count(v.pat) * 50)::BIGINT AS score,
       CASE WHEN count(v.pat) * 50 >= 80 THEN 'Critical' WHEN count(v.pat) * 50 >= 50 THEN 'High' ELSE 'Clean' END AS severity
FROM pages p LEFT JOIN (VALUES {_values(fixed.SUSPICIOUS_PATTERNS)}) v(pat) ON contains(lower(p.url), v.pat) GROUP BY p.page_id"""


def sensitive_call_semijoin(spark, sf_dir):
    """Tokens of pages that are on the list of sensitive calls, counted for each name, zeros included."""
    toks = text.tokens(_table(spark, sf_dir, "pages"), ["page_id"], "html").where("kind = 'identifier'")
    counts = toks.groupBy(stomping.ascii_lower(F.col("token")).alias("folded")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("p"))
    names = spark.createDataFrame([(n,) for n in fixed.SENSITIVE_CALLS], "name string").withColumn("folded", stomping.ascii_lower(F.col("name")))
    return names.join(counts, "folded", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_tokens"), F.coalesce("p", F.lit(0)).alias("n_pages"))


_SENSITIVE = f"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|"[^"\\n]*"|#[^#\\n]*#|[^\\sA-Za-z0-9_]')) AS token FROM pages),
c AS (SELECT lower(token) AS folded, count(*) AS n, count(DISTINCT page_id) AS p FROM t WHERE regexp_matches(token, '^[A-Za-z_]') GROUP BY 1)
SELECT v.name, coalesce(c.n, 0)::BIGINT AS n_tokens, coalesce(c.p, 0)::BIGINT AS n_pages FROM (VALUES {_values(fixed.SENSITIVE_CALLS)}) v(name) LEFT JOIN c ON c.folded = lower(v.name)"""


def auto_exec_hooks(spark, sf_dir):
    """Which names run by themselves: the fixed ones and all different identifiers of pages, counted."""
    toks = text.tokens(_table(spark, sf_dir, "pages"), ["page_id"], "html").where("kind = 'identifier'").select(F.col("token").alias("name"), F.lit(1).alias("n"))
    names = spark.createDataFrame([(n, 0) for n in (*fixed.AUTO_EXEC_HOOKS, "Workbook_Open", "AUTOOPEN", "Main", "")], "name string, n int")
    return names.unionAll(toks).groupBy("name").agg(F.sum("n").alias("n_tokens")).select("name", stomping.is_auto_exec(F.col("name")).alias("is_hook"), "n_tokens")


_HOOKS = f"""
WITH t AS (SELECT unnest(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|"[^"\\n]*"|#[^#\\n]*#|[^\\sA-Za-z0-9_]')) AS name, 1 AS n FROM pages),
a AS (SELECT name, 0 AS n FROM (VALUES {_values((*fixed.AUTO_EXEC_HOOKS, 'Workbook_Open', 'AUTOOPEN', 'Main', ''))}) v(name) UNION ALL SELECT * FROM t WHERE regexp_matches(name, '^[A-Za-z_]'))
SELECT name, lower(name) IN (SELECT h FROM (VALUES {_values(fixed.AUTO_EXEC_HOOKS)}) t(h)) AS is_hook, sum(n)::BIGINT AS n_tokens FROM a GROUP BY name"""


def effective_lines(spark, sf_dir):
    """Lines of documents that count as code, by document."""
    out = text.effective_lines(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.groupBy("doc_id").agg(F.count("*").alias("n_effective"), F.max("line_no").alias("last_line"), F.sum(F.length("code")).cast("long").alias("n_chars"))


_LINES = r"""
WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', '') AS t FROM documents WHERE text <> ''),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM n),
c AS (SELECT doc_id, line_no, regexp_replace(split_part(line, '''', 1), '^\s+|\s+$', '', 'g') AS code FROM l)
"""
_EFFECTIVE = "code <> '' AND NOT (upper(code) LIKE 'REM %' OR upper(code) LIKE 'ATTRIBUTE %' OR upper(code) = 'REM')"
_EFFECTIVE_LINES = _LINES + f"SELECT doc_id, count(*)::BIGINT AS n_effective, max(line_no)::BIGINT AS last_line, sum(length(code))::BIGINT AS n_chars FROM c WHERE {_EFFECTIVE} GROUP BY doc_id"

SOURCES = (
    (1, "Option Explicit\nPublic Sub Main()\n  MsgBox \"Hello\" ' greet\nEnd Sub\nPrivate Static Function Total(x)\nEnd Function"),
    (2, "Attribute VB_Name = \"M\"\r\nREM nothing\r\n' only remarks\r\n"),
    (3, "Property Get Price()\nEnd Property\nProperty Let Price(v)\nEnd Property\nfriend sub auto_open()\nEnd Sub\nsub Main()\nEnd Sub\nSub Main()\nEnd Sub"),
    (4, "Call Sub foo\nExit Sub\nEnd Function\nx = \"Sub Y()\"\nDefault Public Sub Z_1() : End Sub"),
    (5, ""),
)
_SOURCE_VALUES = ", ".join(f"({k}, '{t.replace(chr(39), chr(39) * 2)}')" for k, t in SOURCES)


#: The text of a document as source: a line that begins with one of these letters declares a procedure.
_SOURCE_LINE = r"(^|\n)([A-M])"
_AS_SOURCE = "regexp_replace(text, '(^|\\n)([A-M])', '\\1Sub \\2', 'g')"


def _sources(spark, sf_dir):
    """(module, source) of all documents, taken as sources, and of the samples."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("module"), F.regexp_replace("text", _SOURCE_LINE, "$1Sub $2").alias("source"))
    return docs.unionAll(spark.createDataFrame([(f"s{k}", t) for k, t in SOURCES], "module string, source string"))


def procedure_extract(spark, sf_dir):
    """Procedures that source texts declare: documents taken as sources, and samples."""
    return text.procedures(_sources(spark, sf_dir), ["module"], "source")


_HEADER = r"(?i)^(?:(?:PUBLIC|PRIVATE|FRIEND|STATIC|DEFAULT)\s+)*(?:PUBLIC|PRIVATE|FRIEND|STATIC|DEFAULT)?\s*(?:SUB|FUNCTION|PROPERTY GET|PROPERTY LET|PROPERTY SET)\s+([\p{L}\p{N}_]+)"
_PROCEDURES = rf"""
WITH s AS (SELECT 'd' || doc_id AS module, {_AS_SOURCE} AS source FROM documents UNION ALL SELECT 's' || k, t FROM (VALUES {_SOURCE_VALUES}) v(k, t)),
n AS (SELECT module, regexp_replace(regexp_replace(source, '\r\n?', chr(10), 'g'), '\n$', '') AS t FROM s WHERE source <> ''),
l AS (SELECT module, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM n),
c AS (SELECT module, line_no, regexp_replace(split_part(line, '''', 1), '^\s+|\s+$', '', 'g') AS code FROM l)
SELECT module, name, min(line_no)::BIGINT AS line_no FROM (SELECT module, line_no, regexp_extract(code, '{_HEADER}', 1) AS name FROM c WHERE {_EFFECTIVE})
WHERE name <> '' GROUP BY module, name"""


def classify_statements(spark, sf_dir):
    """Lines of documents and of sample sources by kind of statement."""
    docs = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text")
    samples = spark.createDataFrame([(t,) for _, t in SOURCES], "text string").select(F.lit("samples").alias("origin"), "text")
    lines = docs.unionByName(samples).select("origin", F.explode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1)).alias("line"))
    return lines.groupBy("origin", text.classify(F.col("line")).alias("kind")).agg(F.count("*").alias("n_lines"))


_CASES = " ".join("WHEN regexp_matches(low, '" + p.replace("'", "''") + f"') THEN '{k}'" for k, p in text.STATEMENTS)
_CLASSIFY = rf"""
WITH s(module, source) AS (VALUES {_SOURCE_VALUES}),
t AS (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'samples', source FROM s),
l AS (SELECT origin, lower(regexp_replace(unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))), '^\s+|\s+$', '', 'g')) AS low FROM t)
SELECT origin, CASE {_CASES} ELSE 'expression' END AS kind, count(*)::BIGINT AS n_lines FROM l GROUP BY ALL"""


def lex_tokens(spark, sf_dir):
    """Tokens of conversations by kind, and the number of different ones."""
    toks = text.tokens(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return toks.groupBy("conv_id", "kind").agg(F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_different"), F.max("pos").alias("last_pos"))


_LEX = r"""
WITH x AS (SELECT conv_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|"[^"\n]*"|#[^#\n]*#|[^\sA-Za-z0-9_]') AS ts FROM conversations),
t AS (SELECT conv_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM x)
SELECT conv_id, CASE WHEN regexp_matches(token, '^[A-Za-z_]') THEN 'identifier' WHEN regexp_matches(token, '^[0-9]') THEN 'number'
  WHEN token[1] = '"' AND length(token) > 1 THEN 'string' WHEN token[1] = '#' AND length(token) > 1 THEN 'date' ELSE 'operator' END AS kind,
  count(*)::BIGINT AS n_tokens, count(DISTINCT token)::BIGINT AS n_different, max(pos)::BIGINT AS last_pos FROM t GROUP BY ALL"""

CONDITIONAL = ((1, "#Const A = 1\n#If A Then\nx\n#If B Then\ny\n#Else\nz\n#End If\n#ElseIf C Then\nw\n#End If\nlast"), (2, "plain\ntext"))


#: Directives that take the place of a line's first letter, by letter, where a document is taken as a source.
DIRECTIVES = (("A-D", "#If "), ("E-H", "#End If "), ("I-L", "#Else "), ("M-N", "#ElseIf "), ("O-P", "#Const "))


def conditional_depth(spark, sf_dir):
    """Depth of conditional compilation by line: of documents whose lines become directives by their first letter, and of samples."""
    body = F.col("text")
    for letters, directive in DIRECTIVES:
        body = F.regexp_replace(body, rf"(^|\n)[{letters}]", "$1" + directive)
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("module"), body.alias("text"))
    samples = spark.createDataFrame([(f"s{k}", t) for k, t in CONDITIONAL], "module string, text string")
    return text.conditional_depth(docs.unionAll(samples), ["module"]).select("module", "line_no", F.coalesce("directive", F.lit("")).alias("directive"), "depth")


def _directed(sql: str) -> str:
    for letters, directive in DIRECTIVES:
        sql = f"regexp_replace({sql}, '(^|\\n)[{letters}]', '\\1{directive}', 'g')"
    return sql


_CONDITIONAL = rf"""
WITH s AS (SELECT 'd' || doc_id AS module, {_directed("text")} AS text FROM documents UNION ALL SELECT 's' || k, t FROM (VALUES {", ".join(f"({k}, '{t}')" for k, t in CONDITIONAL)}) v(k, t)),
n AS (SELECT module, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', '') AS t FROM s WHERE text <> ''),
l AS (SELECT module, lower(trim(unnest(string_split(t, chr(10))))) AS low, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM n),
d AS (SELECT *, CASE WHEN low LIKE '#if %' THEN 'if' WHEN low LIKE '#elseif %' THEN 'elseif' WHEN regexp_matches(low, '^#else\b') THEN 'else' WHEN regexp_matches(low, '^#end ?if\b') THEN 'endif' WHEN low LIKE '#const %' THEN 'const' ELSE '' END AS directive FROM l)
SELECT module, line_no::BIGINT AS line_no, directive, sum(CASE directive WHEN 'if' THEN 1 WHEN 'endif' THEN -1 ELSE 0 END) OVER (PARTITION BY module ORDER BY line_no)::BIGINT AS depth FROM d"""

MODULES = (
    ("clean", "Sub Main()\nMsgBox \"Hello\"\nEnd Sub", None, 4, 3),
    ("hidden", "Sub Other()\nEnd Sub", None, 30, 12),
    ("purged", "' nothing", None, 5, 5),
    ("cache", "Sub Main()\nx = 1\nEnd Sub", None, None, None),
    ("broken", None, "bad container", 6, 6),
    ("empty", "", None, 0, 0),
)
NAMES = (
    ("clean", "procedure", "main"), ("clean", "literal", "Hello"), ("clean", "call", "MsgBox"),
    ("hidden", "procedure", "Auto_Open"), ("hidden", "procedure", "EvilPayload"), ("hidden", "literal", "powershell -enc AAAA"), ("hidden", "literal", "a harmless long text"), ("hidden", "literal", "short"), ("hidden", "call", "URLDownloadToFileA"), ("hidden", "call", "MsgBox"),
    ("broken", "procedure", "Run"), ("broken", "literal", "https://example.com/x.exe"),
)


def _stomp_tables(spark, sf_dir):
    """(modules, names): documents taken as modules, and the samples.

    The first word of a document's line is the name of a compiled procedure (in capitals in lines of even number, with
    an X in front in others), of a call, or the line is a literal (with a mark behind in lines of odd number), by
    number of the line. A page's address is a literal of the document of its number; each document has a sensitive call.
    """
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    module, k = F.concat(F.lit("d"), "doc_id").alias("module"), F.col("doc_id")
    broken, bare = k % 11 == 0, k % 5 == 0
    m = docs.select(
        module, F.when(~broken, F.regexp_replace("text", _SOURCE_LINE, "$1Sub $2")).alias("source"), F.when(broken, "bad container").alias("source_error"),
        F.when(~bare, F.floor(F.length("text") / 20)).cast("long").alias("pcode_lines"), F.when(~bare, k % 7).cast("long").alias("pcode_instructions"),
    )
    lines = docs.select(module, F.posexplode(text.source_lines(F.col("text"))).alias("at", "line")).withColumn("word", F.regexp_extract("line", r"^[A-Za-z]+", 0)).where("word <> ''")
    at, even = F.col("at"), F.col("at") % 2 == 0
    kind = F.when(at % 3 == 0, "procedure").when(at % 3 == 1, "call").otherwise("literal")
    name = F.when(kind == "procedure", F.when(even, F.upper("word")).otherwise(F.concat(F.lit("X"), "word"))).when(kind == "call", F.col("word")).otherwise(F.when(even, F.col("line")).otherwise(F.concat("line", F.lit("!"))))
    n = lines.select("module", kind.alias("kind"), name.alias("name")).unionAll(pages.select(F.concat(F.lit("d"), "page_id"), F.lit("literal"), "url"))
    calls = F.array(*[F.lit(c) for c in fixed.SENSITIVE_CALLS])
    n = n.unionAll(docs.select(module, F.lit("call"), F.element_at(calls, (k % len(fixed.SENSITIVE_CALLS) + 1).cast("int")))).distinct()
    m = m.unionAll(spark.createDataFrame(list(MODULES), "module string, source string, source_error string, pcode_lines long, pcode_instructions long"))
    return m, n.unionAll(spark.createDataFrame(list(NAMES), "module string, kind string, name string"))


def stomping_findings(spark, sf_dir):
    """All ten kinds' table-driven findings over documents taken as modules, and samples."""
    m, n = _stomp_tables(spark, sf_dir)
    return stomping.findings(m, n, ["module"]).select("module", "kind", "severity", F.col("weight").cast("long").alias("weight"), F.coalesce("detail", F.lit("")).alias("detail"))


def stomping_reports(spark, sf_dir):
    """Scores and severities of the same modules."""
    m, n = _stomp_tables(spark, sf_dir)
    return stomping.reports(m, n, ["module"]).select("module", "score", "severity", "is_stomped", F.col("n_findings").cast("long").alias("n_findings"))


def _sql(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _low(sql: str) -> str:
    return f"translate({sql}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_SENSITIVE_LIST = "[" + ", ".join("'" + c + "'" for c in fixed.SENSITIVE_CALLS) + "]"
_STOMP = rf"""
WITH m(module, source, source_error, pcode_lines, pcode_instructions) AS (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in MODULES)}
 UNION ALL SELECT 'd' || doc_id, CASE WHEN doc_id % 11 <> 0 THEN {_AS_SOURCE} END, CASE WHEN doc_id % 11 = 0 THEN 'bad container' END, CASE WHEN doc_id % 5 <> 0 THEN length(text) // 20 END, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END FROM documents),
dn AS (SELECT 'd' || doc_id AS module, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', '') AS t FROM documents WHERE text <> ''),
dl AS (SELECT module, line, k, regexp_extract(line, '^[A-Za-z]+') AS word FROM (SELECT module, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS k FROM dn)),
n(module, kind, name) AS (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in NAMES)}
 UNION ALL (SELECT module, 'procedure', CASE WHEN k % 2 = 0 THEN upper(word) ELSE 'X' || word END FROM dl WHERE word <> '' AND k % 3 = 0 UNION SELECT module, 'call', word FROM dl WHERE word <> '' AND k % 3 = 1
  UNION SELECT module, 'literal', CASE WHEN k % 2 = 0 THEN line ELSE line || '!' END FROM dl WHERE word <> '' AND k % 3 = 2 UNION SELECT 'd' || page_id, 'literal', url FROM pages
  UNION SELECT 'd' || doc_id, 'call', ({_SENSITIVE_LIST})[doc_id % {len(fixed.SENSITIVE_CALLS)} + 1] FROM documents)),
x AS (SELECT module, regexp_replace(regexp_replace(source, '\r\n?', chr(10), 'g'), '\n$', '') AS t FROM m WHERE source <> ''),
l AS (SELECT module, unnest(string_split(t, chr(10))) AS line FROM x),
c AS (SELECT module, regexp_replace(split_part(line, '''', 1), '^\s+|\s+$', '', 'g') AS code FROM l),
e AS (SELECT module, code FROM c WHERE {_EFFECTIVE}),
p AS (SELECT DISTINCT module, regexp_extract(code, '{_HEADER}', 1) AS name FROM e),
procs AS (SELECT module, name, {_low("name")} AS low FROM p WHERE name <> ''),
f AS (SELECT m.*, (SELECT count(*) FROM l WHERE l.module = m.module) AS nl, (SELECT count(*) FROM e WHERE e.module = m.module) AS ne, (SELECT count(*) FROM procs WHERE procs.module = m.module) AS np FROM m),
sus(pat) AS (VALUES {_values(fixed.SUSPICIOUS_PATTERNS)}), sen(call) AS (VALUES {_values(fixed.SENSITIVE_CALLS)}), hooks(h) AS (VALUES {_values(fixed.AUTO_EXEC_HOOKS)}),
nn AS (SELECT n.*, {_low("n.name")} AS low, source FROM n JOIN m USING (module) WHERE pcode_lines IS NOT NULL), np AS (SELECT DISTINCT module, low FROM nn WHERE kind = 'procedure'),
un AS (SELECT *, EXISTS (SELECT 1 FROM sus WHERE contains(nn.low, pat)) AS bad FROM nn WHERE NOT contains({_low("coalesce(source, '')")}, low)),
found AS (
 SELECT module, 'PerformanceCachePurged' AS kind, 'Medium' AS severity, 35 AS weight, '' AS detail FROM f WHERE np > 0 AND ne > 0 AND coalesce(pcode_instructions, 0) = 0
 UNION ALL SELECT module, 'SourceCorruptedWithValidPCode', 'Critical', 95, source_error FROM f WHERE pcode_instructions > 0 AND source_error IS NOT NULL
 UNION ALL SELECT module, 'SourcePurged', 'Critical', 95, '' FROM f WHERE pcode_instructions > 0 AND source_error IS NULL AND (nl = 0 OR ne = 0)
 UNION ALL SELECT module, 'LineCountDiscrepancy', 'Medium', 25, '' FROM f WHERE nl > 0 AND pcode_lines > nl * 4 AND pcode_lines > 20
 UNION ALL SELECT module, 'ProcedureHiddenInPCode', CASE WHEN low IN (SELECT h FROM hooks) THEN 'Critical' ELSE 'High' END, CASE WHEN low IN (SELECT h FROM hooks) THEN 60 ELSE 40 END, name
   FROM nn WHERE kind = 'procedure' AND NOT EXISTS (SELECT 1 FROM procs q WHERE q.module = nn.module AND q.low = nn.low)
 UNION ALL SELECT q.module, 'ProcedureMissingInPCode', 'Medium', 20, q.name FROM procs q WHERE q.module IN (SELECT module FROM np) AND NOT EXISTS (SELECT 1 FROM np WHERE np.module = q.module AND np.low = q.low)
 UNION ALL SELECT module, 'SuspiciousLiteralInPCode', CASE WHEN bad THEN 'Critical' ELSE 'Low' END, CASE WHEN bad THEN 50 ELSE 5 END, name FROM un WHERE kind = 'literal' AND (strlen(name) > 10 OR bad)
 UNION ALL SELECT module, 'SensitiveCallInPCode', 'High', 45, name FROM un WHERE kind = 'call' AND low IN (SELECT lower(call) FROM sen))
"""
_STOMP_FINDINGS = _STOMP + "SELECT module, kind, severity, weight::BIGINT AS weight, detail FROM found"
_STOMP_REPORTS = _STOMP + """, s AS (SELECT m.module, least(100, coalesce(sum(weight), 0))::BIGINT AS score, max(list_position(['Clean', 'Low', 'Medium', 'High', 'Critical'], severity)) AS top, count(severity)::BIGINT AS n_findings, max(pcode_lines) AS pl FROM m LEFT JOIN found USING (module) GROUP BY 1)
SELECT module, score, ['Clean', 'Low', 'Medium', 'High', 'Critical'][greatest(coalesce(top, 1), CASE WHEN score >= 80 THEN 5 WHEN score >= 50 THEN 4 WHEN score >= 25 THEN 3 WHEN score > 0 THEN 2 ELSE 1 END)] AS severity,
       score >= 50 AND pl IS NOT NULL AS is_stomped, n_findings FROM s"""


def project_hidden_modules(spark, sf_dir):
    """Parts as modules of their brands' projects, those of returned line items in the manifest, attributes by size."""
    part = _table(spark, sf_dir, "part")
    d = part.select(F.col("p_brand").alias("project"), F.concat(F.lit("Mod"), "p_partkey").alias("module"), "p_partkey")
    returned = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    listed = d.join(returned, "p_partkey", "left_semi").select("project", F.lower("module").alias("module"))
    name = F.when(F.col("p_size") == 1, "CMG").when(F.col("p_size") == 2, "dpb").otherwise("Name")
    a = part.select(F.col("p_brand").alias("project"), F.when(F.col("p_retailprice") > 1000, name).otherwise("Name").alias("name"))
    return stomping.project_findings(d.drop("p_partkey"), listed, a, ["project"]).select("project", "kind", "severity", F.coalesce("detail", F.lit("")).alias("detail"))


_HIDDEN = """
SELECT p_brand AS project, 'HiddenGuiModule' AS kind, 'High' AS severity, 'Mod' || p_partkey AS detail FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09)
UNION ALL SELECT DISTINCT p_brand, 'ProjectLockedOrUnviewable', 'Low', '' FROM part WHERE p_size IN (1, 2) AND p_retailprice > 1000"""


def finding_score_rollup(spark, sf_dir):
    """Weighted events as findings: score, severity and verdict by user."""
    severity = F.when(F.col("event_type") == "error", "High").when(F.col("event_type") == "purchase", "Medium").when(F.col("event_type") == "signup", "Low").otherwise("Clean")
    weight = F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "purchase", 2).otherwise(0)
    rows = _table(spark, sf_dir, "events").select("user_id", severity.alias("severity"), weight.alias("weight"))
    return stomping.score_reports(rows, ["user_id"]).withColumn("n_findings", F.col("n_findings").cast("long"))


_ROLLUP = """
WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS r, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 2 ELSE 0 END AS w FROM events),
g AS (SELECT user_id, least(100, sum(w))::BIGINT AS score, max(r) AS top, count(*)::BIGINT AS n_findings FROM e GROUP BY 1)
SELECT user_id, score, ['Clean', 'Low', 'Medium', 'High', 'Critical'][greatest(top, CASE WHEN score >= 80 THEN 5 WHEN score >= 50 THEN 4 WHEN score >= 25 THEN 3 WHEN score > 0 THEN 2 ELSE 1 END)] AS severity, score >= 50 AS is_stomped, n_findings FROM g"""


def severity_max_rollup(spark, sf_dir):
    """The worst severity of a user's days, and of all users: two levels of a rollup."""
    rank = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    g = _table(spark, sf_dir, "events").rollup("user_id", F.to_date("ts").alias("day")).agg(F.max(rank).alias("r"), F.count("*").alias("n"))
    return g.select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("all")).alias("day"), stomping.severity_name(F.col("r")).alias("severity"), "n")


_MAX = """
SELECT coalesce(user_id, -1)::BIGINT AS user_id, coalesce(strftime(day, '%Y-%m-%d'), 'all') AS day, ['Low', 'Medium', 'High', 'Critical'][max(r)] AS severity, count(*)::BIGINT AS n
FROM (SELECT user_id, ts::DATE AS day, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS r FROM events) GROUP BY ROLLUP (user_id, day)"""


def rule_catalogue_join(spark, sf_dir):
    """Every kind, alias and an unknown kind, under each severity, with rule and level."""
    kinds = [k for k in fixed.CELL_KINDS] + [a for names in fixed.CELL_ALIASES.values() for a in names] + ["NoSuchKind"]
    found = spark.createDataFrame([(k,) for k in kinds], "kind string").withColumn("severity", F.explode(F.array(*[F.lit(s) for s in (*fixed.SEVERITIES, "Other")])))
    return rules.with_rules(found).select("kind", "severity", "rule_id", "level")


def _rule_rows():
    for n, k in enumerate(fixed.CELL_KINDS, 1):
        for name in (k, *fixed.CELL_ALIASES.get(n, ())):
            yield name, f"VBA-CELL-{n:03d}", fixed.CELL_LEVELS.get(n, "error")
    yield "NoSuchKind", "VBA-CELL-001", "warning"


_RULES = f"""
WITH r(kind, rule_id, lv) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _rule_rows())}), s(severity) AS (VALUES ('Clean'), ('Low'), ('Medium'), ('High'), ('Critical'), ('Other'))
SELECT kind, severity, rule_id, CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' WHEN severity = 'Low' THEN 'note' ELSE lv END AS level FROM r, s"""


def stomp_rules(spark, sf_dir):
    """Kinds of compiled-code findings with rule and level."""
    kinds = spark.createDataFrame([(k,) for k, _ in fixed.STOMP_KINDS], "kind string").withColumn("severity", F.explode(F.array(*[F.lit(s) for s in fixed.SEVERITIES])))
    return rules.with_stomp_rules(kinds).select("kind", "severity", "rule_id", "level")


_STOMP_RULES = f"""
WITH r(kind, rule_id, lv) AS (VALUES {", ".join(f"('{k}', 'VBA-STOMP-{n:03d}', '{lv}')" for n, (k, lv) in enumerate(fixed.STOMP_KINDS, 1))}), s(severity) AS (VALUES ('Clean'), ('Low'), ('Medium'), ('High'), ('Critical'))
SELECT kind, severity, rule_id, CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' WHEN severity = 'Low' THEN 'note' ELSE lv END AS level FROM r, s"""


def primitive_scan(spark, sf_dir):
    """Which primitive detectors fire on pages' URLs and HTML, counted."""
    pages = _table(spark, sf_dir, "pages")
    both = pages.select("page_id", F.lit("url").alias("part"), F.col("url").alias("content")).unionAll(pages.select("page_id", F.lit("html"), "html"))
    return rules.detect(both, ["page_id", "part"], "content").groupBy("part", "detector").agg(F.count("*").alias("n_parts"))


_PRIMITIVE = "WITH p AS (SELECT 'url' AS part, url AS c FROM pages UNION ALL SELECT 'html', html FROM pages) " + " UNION ALL ".join(
    f"SELECT part, '{name}' AS detector, count(*)::BIGINT AS n_parts FROM p WHERE regexp_matches(c, '{pattern.replace(chr(39), chr(39) * 2)}') GROUP BY part" for name, pattern in rules.PRIMITIVES.items()
)

#: Names of parts in an order; a page is taken as the part that its number chooses.
PARTS = (
    "xl/theme/theme1.xml", "xl/connections.xml", "docProps/custom.xml", "word/settings.xml", "xl/worksheets/sheet1.xml", "xl/media/image1.svg", "ppt/viewProps.xml", "xl/customXml/item1.xml", "word/document.xml", "xl/macrosheets/sheet1.xml", "word/_rels/document.xml.rels", "ppt/slides/slide1.xml",
    "xl/embeddings/ole1.bin", "word/glossary/settings.xml", "xl/pivotCache/pivotCacheDefinition1.xml", "[Content_Types].xml", "xl/workbook.xml", "word/fonts/font1.odttf", "ppt/media/run.hta",
)


def part_rules(spark, sf_dir):
    """Findings by rule of pages taken as parts: detectors in the scope of each rule's parts, over address and markup."""
    names = F.array(*[F.lit(p) for p in PARTS])
    parts = _table(spark, sf_dir, "pages").select("page_id", F.element_at(names, (F.col("page_id") % len(PARTS) + 1).cast("int")).alias("part"), F.concat_ws("\n", "url", "html").alias("content"))
    return rules.scan_parts(parts, ["page_id", "part"])


def _quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


_PART_RULES = f"""
WITH p AS (SELECT page_id, ([{', '.join(map(_quoted, PARTS))}])[page_id % {len(PARTS)} + 1] AS part, concat_ws(chr(10), url, html) AS content FROM pages),
d(detector, pattern) AS (VALUES {', '.join(f'({_quoted(n)}, {_quoted(x)})' for n, x in rules.PRIMITIVES.items())}),
s(rule_no, path, detector) AS (VALUES {', '.join(f'({n}, {_quoted(x)}, {_quoted(k)})' for n, x, ks in rules.SCOPES for k in ks)}),
h AS (SELECT page_id, part, rule_no, detector FROM p JOIN s ON regexp_matches(part, path) JOIN d USING (detector) WHERE regexp_matches(content, pattern)
 UNION ALL SELECT page_id, part, rule_no, 'present' FROM p JOIN (VALUES {', '.join(f'({n}, {_quoted(x)})' for n, x in rules.PRESENT)}) t(rule_no, path) ON regexp_matches(part, path))
SELECT DISTINCT page_id, part, 'VBA-CELL-' || lpad(rule_no::VARCHAR, 3, '0') AS rule_id, ([{', '.join(map(_quoted, fixed.CELL_KINDS))}])[rule_no] AS kind, detector FROM h"""


QUERIES = {f.__name__: f for f in (suspicious_literal_scan, sensitive_call_semijoin, auto_exec_hooks, effective_lines, procedure_extract, classify_statements, lex_tokens, conditional_depth, stomping_findings, stomping_reports, project_hidden_modules, finding_score_rollup, severity_max_rollup, rule_catalogue_join, stomp_rules, primitive_scan, part_rules)}
ORACLES = {
    "suspicious_literal_scan": _SUSPICIOUS, "sensitive_call_semijoin": _SENSITIVE, "auto_exec_hooks": _HOOKS, "effective_lines": _EFFECTIVE_LINES, "procedure_extract": _PROCEDURES, "classify_statements": _CLASSIFY, "lex_tokens": _LEX, "conditional_depth": _CONDITIONAL,
    "stomping_findings": _STOMP_FINDINGS, "stomping_reports": _STOMP_REPORTS, "project_hidden_modules": _HIDDEN, "finding_score_rollup": _ROLLUP, "severity_max_rollup": _MAX, "rule_catalogue_join": _RULES, "stomp_rules": _STOMP_RULES, "primitive_scan": _PRIMITIVE, "part_rules": _PART_RULES,
}
