"""Sources that unpack containers: tables of entries, streams, modules, lines and package parts.

Each takes files (path string, content binary), as spark.read.format("binaryFile") gives them, and runs in
Arrow batches. A file that can't be read is one row with its error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.sources import formats as fmt

#: Bytes of a file, and of what it unpacks to.
MAX_INPUT, MAX_OUTPUT = 128 << 20, 64 << 20


def _run(files: DataFrame, unpack, schema: str, rows: int = 16) -> DataFrame:
    """Rows of unpack(path, content), which yields tuples; errors become a row with the last column set, after the rows that came before."""
    names = [f.split()[0] for f in schema.split(", ")]
    width = len(names)
    arrow = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = [arrow[f.split(" ", 1)[1]] for f in schema.split(", ")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                out = []
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    try:
                        if content is None or len(content) > MAX_INPUT:
                            raise fmt.FormatError("no content" if content is None else "file is over the limit")
                        for r in unpack(content):
                            out.append((path, *r, None))
                    except (fmt.FormatError, IndexError, ValueError, KeyError) as e:
                        out.append((path, *[None] * (width - 2), str(e) or type(e).__name__))
                cols = list(zip(*out, strict=True)) or [()] * width
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def container_kind(content: Column) -> Column:
    """zip, cfb, or text of anything else, by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("504B0304"), "zip").when(head == "D0CF11E0A1B11AE1", "cfb").otherwise("text")


def host_profile(path: Column) -> Column:
    """Host that a file's extension stands for."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.rlike("^do[ct]"), "Word").when(ext.rlike("^(pp|po)[ts]"), "PowerPoint").when(ext.rlike("^(mdb|accdb|accde)$"), "Access").when(ext.rlike("^xl"), "Excel").otherwise("Unknown")


def zip_entries(files: DataFrame) -> DataFrame:
    """(path, name, method, size, content, error) of the archives' entries."""

    def unpack(content):
        left = MAX_OUTPUT
        for e in fmt.zip_directory(content):
            data = fmt.zip_read(content, e, left)
            left -= len(data)
            yield e["name"], e["method"], e["size"], data

    return _run(files, unpack, "path string, name string, method int, size long, content binary, error string")


def cfb_streams(files: DataFrame) -> DataFrame:
    """(path, name, content, error) of the compound files' streams."""
    return _run(files, lambda c: list(fmt.cfb_streams(c).items()), "path string, name string, content binary, error string")


def vba_bytes(files: DataFrame) -> DataFrame:
    """(path, content) of the compound files: the files themselves or their vbaProject parts."""
    kind = container_kind(F.col("content"))
    direct = files.where(kind == "cfb").select("path", "content")
    inside = zip_entries(files.where(kind == "zip")).where("error is null and lower(name) like '%vbaproject.bin'").select("path", "content")
    return direct.unionByName(inside)


def _project(content):
    streams = fmt.cfb_streams(content)
    root = next((p[: -len("dir")] for p in streams if p == "dir" or p.lower().endswith("vba/dir")), None)
    if root is None:
        raise fmt.FormatError("no VBA project")
    d = fmt.ovba_directory(fmt.ovba_decompress(streams[root + "dir"]))
    text = next((fmt.decode_page(v, d["code_page"]) for p, v in streams.items() if p.rsplit("/", 1)[-1].upper() == "PROJECT"), "")
    return streams, root, d, fmt.manifest(text)


def vba_modules(files: DataFrame) -> DataFrame:
    """(path, project, module, kind, in_manifest, source, source_error, cache, error) of compound files' VBA modules.

    cache: the compiled part of the module's stream; source_error: why the source can't be read, if it can't.
    """

    def unpack(content):
        streams, root, d, listed = _project(content)
        known = {n.lower(): k for n, k in listed["modules"]}
        for m in d["modules"]:
            raw = streams.get(root + m["stream"])
            source = problem = None
            if raw is None:
                problem = "no stream"
            else:
                try:
                    source = fmt.decode_page(fmt.ovba_decompress(raw[m["offset"] :]), d["code_page"])
                except fmt.FormatError as e:
                    problem = str(e)
            yield d["name"], m["name"], known.get(m["name"].lower(), m["kind"]), m["name"].lower() in known, source, problem, (raw or b"")[: m["offset"]]

    return _run(files, unpack, "path string, project string, module string, kind string, in_manifest boolean, source string, source_error string, cache binary, error string")


def vba_attributes(files: DataFrame) -> DataFrame:
    """(path, name, value, error) of the attributes in the projects' manifests."""
    return _run(files, lambda c: list(_project(c)[3]["attributes"].items()), "path string, name string, value string, error string")


def vba_references(files: DataFrame) -> DataFrame:
    """(path, name, kind, libid, error) of the projects' references."""
    return _run(files, lambda c: [(r["name"], r["kind"], r["libid"]) for r in _project(c)[2]["references"]], "path string, name string, kind string, libid string, error string")


def vba_identifiers(files: DataFrame) -> DataFrame:
    """(path, at, name, error) of the identifiers of compound files' VBA projects, numbered from 0."""

    def unpack(content):
        streams = fmt.cfb_streams(content)
        found = [v for p, v in streams.items() if p.rsplit("/", 1)[-1].upper() == "_VBA_PROJECT"]
        if not found:
            raise fmt.FormatError("no identifier table")
        yield from enumerate(fmt.project_identifiers(found[0]))

    return _run(files, unpack, "path string, at long, name string, error string")


def split_libid(libid: Column) -> list[Column]:
    """guid, version, lcid, target and description of *\\G{guid}#version#lcid#path#description."""
    part = lambda n: F.split_part(libid, F.lit("#"), F.lit(n))
    return [F.regexp_extract(part(1), r"\{([^}]*)\}", 1).alias("guid"), part(2).alias("version"), part(3).alias("lcid"), part(4).alias("target"), part(5).alias("description")]


def pcode_lines(modules: DataFrame) -> DataFrame:
    """(path, line, length, code, error) of the line maps in caches (path, cache): a row without a line if there is none."""
    files = modules.select("path", F.col("cache").alias("content"))
    return _run(files, lambda c: [(r["line"], r["length"], r["code"]) for r in fmt.line_map(c) or []], "path string, line long, length long, code binary, error string")


def pcode_instructions(lines: DataFrame, opcodes: dict, identifiers: dict[int, str] | None = None) -> DataFrame:
    """(path, line, at, opcode, mnemonic, operands, error) of compiled lines (path, line, code).

    opcodes is the caller's table (see formats.disassemble): the instruction set is a parameter here.
    """
    known = identifiers or {}

    def names(value):
        return known.get(value, f"id_{value:04X}")

    keyed = lines.select(F.concat_ws("\0", "path", F.col("line").cast("string")).alias("path"), F.col("code").alias("content"))

    def unpack(code):
        out, issue = fmt.disassemble(code, opcodes, names)
        for i in out:
            yield i["at"], i["opcode"], i["mnemonic"], i["operands"]
        if issue:
            raise fmt.FormatError(issue)

    out = _run(keyed, lambda c: unpack(c), "path string, at long, opcode long, mnemonic string, operands array<string>, error string")
    at = F.split("path", "\0")
    return out.select(at[0].alias("path"), at[1].cast("long").alias("line"), "at", "opcode", "mnemonic", "operands", "error")
