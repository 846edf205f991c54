"""Line-level operators over source text: logical lines, code parts, procedure headers, statement kinds, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words before a procedure keyword that leave it a header, and the keywords.
_BEFORE = "PUBLIC|PRIVATE|FRIEND|STATIC|DEFAULT"
HEADER = rf"^(?:(?:{_BEFORE})\s+)*(?:{_BEFORE})?\s*(?:SUB|FUNCTION|PROPERTY GET|PROPERTY LET|PROPERTY SET)\s+([\p{{L}}\p{{N}}_]+)"
#: Identifiers, numbers, quoted texts, dates and single marks, in that order of preference.
TOKEN = r'[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|"[^"\n]*"|#[^#\n]*#|[^\sA-Za-z0-9_]'


def source_lines(text: Column) -> Column:
    """Lines of a text with CRLF and CR taken as LF; what follows the last line end is a line only if it isn't empty."""
    norm = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(norm, r"\n\z", ""), "\n", -1))


def code_part(line: Column) -> Column:
    """What stands before the first apostrophe, quoted or not, without white space around it."""
    return F.regexp_replace(F.split_part(line, F.lit("'"), F.lit(1)), r"^\s+|\s+$", "")


def is_effective(code: Column) -> Column:
    """Whether a code part counts: neither blank nor a remark or an attribute."""
    up = F.upper(code)
    return (code != "") & ~(up.startswith("REM ") | up.startswith("ATTRIBUTE ") | (up == "REM"))


def effective_lines(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, line_no, code) of the lines that count."""
    lines = texts.select(*key, F.posexplode(source_lines(F.col(text))).alias("pos", "line"))
    code = lines.select(*key, (F.col("pos") + 1).cast("long").alias("line_no"), code_part(F.col("line")).alias("code"))
    return code.where(is_effective(F.col("code")))


def procedures(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, name, line_no) of declared procedures, the first of each exact name."""
    code = effective_lines(texts, key, text)
    name = F.regexp_extract(F.col("code"), "(?i)" + HEADER, 1)
    found = code.select(*key, name.alias("name"), "line_no").where("name <> ''")
    return found.groupBy(*key, "name").agg(F.min("line_no").alias("line_no"))


def mask_line(line: Column) -> Column:
    """The line with a space in place of each character but line ends, so that offsets stay."""
    return F.regexp_replace(line, r"[^\r\n]", " ")


def tokens(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, pos, token, kind) of the tokens of a text without line continuation; white space is dropped."""
    found = texts.select(*key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    first = F.substring("token", 1, 1)
    kind = (
        F.when(first.rlike("[A-Za-z_]"), "identifier").when(first.rlike("[0-9]"), "number").when((first == '"') & (F.length("token") > 1), "string").when((first == "#") & (F.length("token") > 1), "date").otherwise("operator")
    )
    return found.select(*key, F.col("pos").cast("long").alias("pos"), "token", kind.alias("kind"))


#: Kinds of statements and the patterns, over a trimmed lower-cased line, that make them; the first match counts.
STATEMENTS = (
    ("blank", r"^$"),
    ("comment", r"^('|rem( |$))"),
    ("attribute", r"^attribute "),
    ("option", r"^option "),
    ("label", r"^[a-z_][a-z0-9_]*:$"),
    ("procedure", r"^((public|private|friend|static|default) +)*(sub|function|property (get|let|set)) "),
    ("procedure_end", r"^end (sub|function|property)$"),
    ("declaration", r"^(dim|const|static|public|private|global|declare|type|enum|event) "),
    ("redim", r"^redim "),
    ("erase", r"^erase "),
    ("on_error", r"^on error "),
    ("on_branch", r"^on .* (goto|gosub) "),
    ("goto", r"^goto "),
    ("gosub", r"^gosub "),
    ("return", r"^return$"),
    ("resume", r"^resume( |$)"),
    ("exit", r"^exit (sub|function|property|do|for)$"),
    ("end", r"^end$"),
    ("stop", r"^stop$"),
    ("if", r"^(if |elseif |else$|end if$)"),
    ("select", r"^(select case |case |end select$)"),
    ("loop", r"^(for |next( |$)|do( |$)|loop( |$)|while |wend$)"),
    ("with", r"^(with |end with$)"),
    ("raise_event", r"^raiseevent "),
    ("call", r"^call "),
    ("object_assignment", r"^set [^=]+="),
    ("assignment", r"^(let )?[a-z_][a-z0-9_.()\", ]* *="),
)


def classify(line: Column) -> Column:
    """Kind of a statement line; `expression` if no pattern matches."""
    low = F.lower(F.regexp_replace(line, r"^\s+|\s+$", ""))
    out = F.when(low.rlike(STATEMENTS[0][1]), STATEMENTS[0][0])
    for kind, pattern in STATEMENTS[1:]:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("expression")


def conditional_depth(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, line_no, directive, depth): conditional-compilation depth of each line, by a running sum."""
    lines = texts.select(*key, F.posexplode(source_lines(F.col(text))).alias("pos", "line"))
    low = F.lower(F.trim(F.col("line")))
    kind = F.when(low.rlike(r"^#if "), "if").when(low.rlike(r"^#elseif "), "elseif").when(low.rlike(r"^#else\b"), "else").when(low.rlike(r"^#end ?if\b"), "endif").when(low.rlike(r"^#const "), "const")
    step = F.when(F.col("directive") == "if", 1).when(F.col("directive") == "endif", -1).otherwise(0)
    w = Window.partitionBy(*key).orderBy("line_no")
    marked = lines.select(*key, (F.col("pos") + 1).cast("long").alias("line_no"), kind.alias("directive"))
    return marked.withColumn("depth", F.sum(step).over(w).cast("long"))


def explicit_call_without_parentheses(line: Column) -> Column:
    """Whether a Call statement has arguments without parentheses."""
    low = F.lower(F.trim(line))
    return low.rlike(r"^call +[a-z_][a-z0-9_.]* +[^( =:']")


def decode_bytes(content: Column, code_page: Column | None = None) -> Column:
    """Text of bytes: by byte-order mark, else by code page (65001, 1252, 20127), else UTF-8; null where that fails."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    body3, body2 = F.substring(content, 4, 2147483647), F.substring(content, 3, 2147483647)
    marked = F.when(head.startswith("EFBBBF"), F.when(F.is_valid_utf8(body3.cast("string")), body3.cast("string"))).when(head.startswith("FFFE"), F.decode(body2, "UTF-16LE")).when(head.startswith("FEFF"), F.decode(body2, "UTF-16BE"))
    if code_page is None:
        return F.when(head.rlike("^(EFBBBF|FFFE|FEFF)"), marked).otherwise(utf8)
    latin = F.when(code_page == 20127, F.decode(content, "US-ASCII")).when(code_page == 1252, F.decode(content, "ISO-8859-1"))
    return F.when(head.rlike("^(EFBBBF|FFFE|FEFF)"), marked).when((code_page == 65001) | code_page.isNull(), utf8).otherwise(latin)
