"""Workbook parts of unpacked OOXML packages: relationships, sheets, names, shared strings, cells, tables.

parts is (path, name, content binary), as containers.zip_entries gives it. XML is read by a streaming
parser that refuses document types, so entities are never expanded.
"""

from __future__ import annotations

import posixpath
import re
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions import formula as X
from tamarack.sources.containers import _run
from tamarack.sources.formats import FormatError

MAX_CELLS = 100_000


def elements(content: bytes):
    """(depth, name without prefix, attributes, text) of the elements, children before parents; attributes without prefixes."""
    out, stack = [], []
    parser = expat.ParserCreate(namespace_separator="}")

    def refuse(*_):
        raise FormatError("document type declared")

    parser.StartDoctypeDeclHandler = refuse
    local = lambda n: n.rpartition("}")[2]

    def start(name, attrs):
        stack.append((local(name), {local(k): v for k, v in attrs.items()}, []))

    def end(_):
        name, attrs, text = stack.pop()
        out.append((len(stack), name, attrs, "".join(text)))

    def chars(data):
        if stack:
            stack[-1][2].append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise FormatError(f"bad XML: {e}") from None
    return out


def part_target(source: str, target: str) -> str:
    """Name of the part that a relationship's target means, relative to its source part; FormatError if outside."""
    t = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)) if re.match(r"[A-Za-z0-9._~-]", chr(int(m[1], 16))) else m[0], target.replace("\\", "/"))
    joined = posixpath.normpath(t.lstrip("/") if t.startswith("/") else posixpath.join(posixpath.dirname(source), t))
    if joined.startswith("..") or joined == ".":
        raise FormatError("target is outside the package")
    return joined


def _each(parts: DataFrame, like: str, make, schema: str) -> DataFrame:
    """Rows of make(part name, content) over the parts whose name matches."""
    files = parts.where(F.col("name").rlike(like) & F.col("content").isNotNull())
    keyed = files.select(F.concat_ws("\0", "path", "name").alias("path"), "content")
    out = _run(keyed, make, schema)
    at = F.split("path", "\0")
    rest = [c for c in out.columns if c != "path"]
    return out.select(at[0].alias("path"), at[1].alias("part"), *rest)


def relationships(parts: DataFrame) -> DataFrame:
    """(path, part, id, type, target, mode, error): part is the .rels part."""

    def make(content):
        for _, name, a, _ in elements(content):
            if name == "Relationship":
                yield a.get("Id", ""), a.get("Type", "").rpartition("/")[2], a.get("Target", ""), a.get("TargetMode", "Internal")

    return _each(parts, r"\.rels$", lambda c: list(make(c)), "path string, id string, type string, target string, mode string, error string")


def sheets(parts: DataFrame) -> DataFrame:
    """(path, part, ordinal, sheet, state, rel_id, error) of workbook.xml."""

    def make(content):
        k = 0
        for _, name, a, _ in elements(content):
            if name == "sheet":
                yield k, a.get("name", ""), a.get("state", "visible"), a.get("id", "")
                k += 1

    return _each(parts, r"(^|/)workbook\.xml$", lambda c: list(make(c)), "path string, ordinal long, sheet string, state string, rel_id string, error string")


def defined_names(parts: DataFrame) -> DataFrame:
    """(path, part, name, sheet_ordinal or null, hidden, refers_to, error)."""

    def make(content):
        for _, name, a, text in elements(content):
            if name == "definedName":
                yield a.get("name", ""), int(a["localSheetId"]) if a.get("localSheetId", "").isdigit() else None, a.get("hidden") in ("1", "true"), text

    return _each(parts, r"(^|/)workbook\.xml$", lambda c: list(make(c)), "path string, name string, sheet_ordinal long, hidden boolean, refers_to string, error string")


def shared_strings(parts: DataFrame) -> DataFrame:
    """(path, part, ordinal, text, error): plain and rich runs, without phonetic ones."""

    def make(content):
        k, held = 0, []
        for depth, name, _, text in elements(content):
            if name == "t" and depth in (2, 3):
                held.append(text)
            elif name == "rPh":
                held.pop()
            elif name == "si":
                yield k, "".join(held)
                k, held = k + 1, []

    return _each(parts, r"(^|/)sharedStrings\.xml$", lambda c: list(make(c)), "path string, ordinal long, text string, error string")


def raw_cells(parts: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(path, part, cell, row, col, type, value, formula, shared, error) of worksheets.

    A part with over max_cells cells gives the first of them and a row with the error "cells truncated".
    """

    def make(content):
        value = formula = shared = None
        n = 0
        for _, name, a, text in elements(content):
            if name in ("v", "t"):
                value = (value or "") + text if name == "t" else text
            elif name == "f":
                formula, shared = text, a.get("si") if a.get("t") == "shared" else None
            elif name == "c":
                ref = X.parse_reference(a.get("r", ""))
                if ref:
                    if n == max_cells:
                        raise FormatError("cells truncated")
                    n += 1
                    yield a["r"], ref[1], ref[2], a.get("t", "n"), value, formula, shared
                value = formula = shared = None

    return _each(parts, r"worksheets/[^/]+\.xml$|macrosheets/[^/]+\.xml$", make, "path string, cell string, row long, col long, type string, value string, formula string, shared string, error string")


def cells(parts: DataFrame) -> DataFrame:
    """raw_cells with shared strings resolved in value, by their number."""
    sst = shared_strings(parts).where("error is null").select(F.col("path").alias("sp"), F.col("ordinal").alias("so"), "text")
    c = raw_cells(parts)
    at = F.when(c["type"] == "s", c["value"].try_cast("long"))
    return c.join(sst, (c["path"] == F.col("sp")) & (at == F.col("so")), "left").select(*[c[k] for k in c.columns if k != "value"], F.coalesce(F.when(c["type"] == "s", F.col("text")), F.when(c["type"] != "s", c["value"])).alias("value"))


def tables(parts: DataFrame) -> DataFrame:
    """(path, part, name, ref, header_rows, total_rows, columns, error)."""

    def make(content):
        columns = []
        for _, name, a, _ in elements(content):
            if name == "tableColumn":
                columns.append(a.get("name", ""))
            elif name == "table":
                yield a.get("displayName", ""), a.get("ref", ""), int(a.get("headerRowCount", 1)), int(a.get("totalsRowCount", 0)), columns

    return _each(parts, r"tables/[^/]+\.xml$", lambda c: list(make(c)), "path string, name string, ref string, header_rows long, total_rows long, columns array<string>, error string")


def sheet_parts(parts: DataFrame) -> DataFrame:
    """(path, ordinal, sheet, state, part): sheets with the parts that their relationships mean."""
    r = relationships(parts).where("error is null and mode <> 'External'").where(F.col("part").rlike(r"(^|/)_rels/workbook\.xml\.rels$"))
    base = F.regexp_replace("part", r"_rels/workbook\.xml\.rels$", "")
    target = F.when(F.col("target").startswith("/"), F.substr("target", F.lit(2))).otherwise(F.concat(base, F.col("target")))
    r = r.select(F.col("path").alias("rp"), "id", target.alias("target_part"))
    s = sheets(parts).where("error is null")
    return s.join(r, (s["path"] == F.col("rp")) & (s["rel_id"] == F.col("id")), "left").select("path", "ordinal", "sheet", "state", F.col("target_part").alias("part"))


def formula_references(formulas: DataFrame) -> DataFrame:
    """(path, sheet, cell, ordinal, start, end, reference, ref_sheet, row1, col1, row2, col2, absolute) of formulas (path, sheet, cell, formula)."""
    names = ["path", "sheet", "cell", "ordinal", "start", "end", "reference", "ref_sheet", "row1", "col1", "row2", "col2", "absolute"]

    def run(batches):
        for b in batches:
            out = []
            for path, sheet, cell, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for k, (lo, hi, ref) in enumerate(X.references(text or "")):
                    p = X.parse_reference(ref)
                    if p:
                        out.append((path, sheet, cell, k, lo, hi, ref, p[0] or sheet, *p[1:5], p[5]))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 4 + [pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "path string, sheet string, cell string, ordinal long, start long, end long, reference string, ref_sheet string, row1 long, col1 long, row2 long, col2 long, absolute boolean"
    return formulas.select("path", "sheet", "cell", "formula").mapInArrow(run, schema)


def evaluate(grid: DataFrame) -> DataFrame:
    """(path, sheet, cell, formula, result, error): formulas evaluated within their own workbook.

    grid is (path, sheet, row, col, cell, value, formula). A workbook's cells, bounded by MAX_CELLS a part,
    are evaluated together; workbooks are spread over the tasks.
    """

    def run(key, t):
        rows = t.to_pylist()
        cells_ = {}
        for r in rows:
            v = r["value"]
            if r["formula"]:
                v = "=" + r["formula"].lstrip("=")
            elif v is not None and re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", v):
                v = float(v)
            cells_[r["sheet"], r["row"], r["col"]] = v
        out = {k: [] for k in ("path", "sheet", "cell", "formula", "result", "error")}
        for r in rows:
            if r["formula"]:
                v = X.Evaluator(cells_, r["sheet"]).evaluate(r["formula"])
                for k, x in zip(out, (r["path"], r["sheet"], r["cell"], r["formula"], None if isinstance(v, X.Err) else X.text(v), v.code if isinstance(v, X.Err) else None), strict=True):
                    out[k].append(x)
        return pa.table({k: pa.array(v, pa.string()) for k, v in out.items()})

    return grid.select("path", "sheet", "row", "col", "cell", "value", "formula").groupBy("path").applyInArrow(run, "path string, sheet string, cell string, formula string, result string, error string")
