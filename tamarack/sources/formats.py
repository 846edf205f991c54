"""Binary formats on one file's bytes: ZIP, compound files, MS-OVBA compression and project streams.

Pure functions with bounded output. They raise FormatError on damage; the DataFrame sources turn that into
an error column, so that one bad file never fails a job. The writers make the smallest valid files, for
tests and for synthetic inputs.
"""

from __future__ import annotations

import struct
import zlib

CFB_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, END, FAT, DIFAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC


class FormatError(ValueError):
    """The bytes aren't what the format says."""


# ZIP


def inflate(data: bytes, most: int) -> bytes:
    """Raw DEFLATE, of at most `most` bytes."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, most + 1)
    except zlib.error as e:
        raise FormatError(f"bad deflate data: {e}") from None
    if len(out) > most or d.unconsumed_tail:
        raise FormatError("inflated data is over the limit")
    if not d.eof:
        raise FormatError("deflate data ends early")
    return out


def zip_directory(data: bytes, most_entries: int = 16384) -> list[dict]:
    """Central directory entries: name, flags, method, crc, packed, size, at."""
    lo = max(0, len(data) - 65557)
    at = data.rfind(b"PK\x05\x06", lo)
    while at >= 0:
        if at + 22 <= len(data) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] == len(data):
            break
        at = data.rfind(b"PK\x05\x06", lo, at)
    if at < 0:
        raise FormatError("no end of central directory")
    disk, start_disk, here, total, size, offset = struct.unpack_from("<4H2I", data, at + 4)
    if disk or start_disk or here != total:
        raise FormatError("multi-disk archive")
    if total == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        raise FormatError("ZIP64 archive")
    if total > most_entries:
        raise FormatError("too many entries")
    if offset + size > at:
        raise FormatError("directory outside the file")
    out, p = [], offset
    for _ in range(total):
        if p + 46 > offset + size or data[p : p + 4] != b"PK\x01\x02":
            raise FormatError("bad directory entry")
        flags, method = struct.unpack_from("<2H", data, p + 8)
        crc, packed, full, n, extra, comment = struct.unpack_from("<3I3H", data, p + 16)
        local = struct.unpack_from("<I", data, p + 42)[0]
        raw = data[p + 46 : p + 46 + n]
        out.append({"name": raw.decode("utf-8" if flags & 0x800 else "cp437"), "flags": flags, "method": method, "crc": crc, "packed": packed, "size": full, "at": local})
        p += 46 + n + extra + comment
    return out


def zip_read(data: bytes, entry: dict, most: int = 64 << 20) -> bytes:
    """Content of an entry: not encrypted, stored or deflated, with the sizes and CRC-32 that it says."""
    at = entry["at"]
    if data[at : at + 4] != b"PK\x03\x04" or at + 30 > len(data):
        raise FormatError("no local header")
    flags, method = struct.unpack_from("<2H", data, at + 6)
    n, extra = struct.unpack_from("<2H", data, at + 26)
    name = data[at + 30 : at + 30 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
    if flags & 1 or entry["flags"] & 1:
        raise FormatError("encrypted entry")
    if method != entry["method"] or name != entry["name"]:
        raise FormatError("local and central headers disagree")
    begin = at + 30 + n + extra
    raw = data[begin : begin + entry["packed"]]
    if len(raw) != entry["packed"]:
        raise FormatError("entry ends early")
    if entry["size"] > most:
        raise FormatError("entry is over the limit")
    if method == 0:
        out = raw
    elif method == 8:
        out = inflate(raw, most)
    else:
        raise FormatError(f"method {method}")
    if len(out) != entry["size"]:
        raise FormatError("size differs")
    if zlib.crc32(out) != entry["crc"]:
        raise FormatError("CRC differs")
    return out


def zip_write(entries: list[tuple[str, bytes]], deflate: bool = False) -> bytes:
    """An archive of stored or deflated entries."""
    body, directory = b"", b""
    for name, content in entries:
        raw = name.encode()
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(content) + c.flush() if deflate else content
        common = struct.pack("<5H3I2H", 20, 0x800, 8 if deflate else 0, 0, 33, zlib.crc32(content), len(packed), len(content), len(raw), 0)
        directory += b"PK\x01\x02" + struct.pack("<H", 20) + common + struct.pack("<3H2I", 0, 0, 0, 0, len(body)) + raw
        body += b"PK\x03\x04" + common + raw + packed
    return body + directory + b"PK\x05\x06" + struct.pack("<4H2IH", 0, 0, len(entries), len(entries), len(directory), len(body), 0)


# Compound files


def cfb_streams(data: bytes, most_sectors: int = 262144) -> dict[str, bytes]:
    """Content of each stream by path (folders joined by /), from the FAT or, below 4096 bytes, the mini stream."""
    if data[:8] != CFB_MAGIC or len(data) < 512:
        raise FormatError("not a compound file")
    major, order, shift, mini_shift = struct.unpack_from("<4H", data, 26)
    if order != 0xFFFE or (major, shift) not in ((3, 9), (4, 12)) or mini_shift != 6:
        raise FormatError("unknown geometry")
    n_fat, first_dir, cutoff, first_mini, _, first_difat, n_difat = (struct.unpack_from("<I", data, p)[0] for p in (44, 48, 56, 60, 64, 68, 72))
    size = 1 << shift
    total = (len(data) - size) // size + 1
    if total > most_sectors:
        raise FormatError("too many sectors")

    def sector(n: int) -> bytes:
        at = (n + 1) * size
        if n >= FAT - 1 or at >= len(data):
            raise FormatError(f"sector {n} is outside the file")
        return data[at : at + size].ljust(size, b"\0")

    fat_at = [x for x in struct.unpack_from("<109I", data, 76) if x < FAT]
    seen, nxt = set(), first_difat
    while nxt < FAT - 1 and nxt not in (END, FREE) and len(seen) <= n_difat:
        if nxt in seen:
            raise FormatError("DIFAT cycle")
        seen.add(nxt)
        *more, nxt = struct.unpack(f"<{size // 4}I", sector(nxt))
        fat_at += [x for x in more if x < FAT]
    fat: list[int] = []
    for s in fat_at[:n_fat]:
        fat += struct.unpack(f"<{size // 4}I", sector(s))

    def chain(start: int, table: list[int], read) -> bytes:
        out, been, s = [], set(), start
        while s != END:
            if s in been or s >= len(table):
                raise FormatError("broken or cyclic chain")
            been.add(s)
            out.append(read(s))
            s = table[s]
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    entries = []
    for p in range(0, len(directory), 128):
        n, kind = struct.unpack_from("<HB", directory, p + 64)
        left, right, child = struct.unpack_from("<3I", directory, p + 68)
        start, low, high = struct.unpack_from("<3I", directory, p + 116)
        entries.append((directory[p : p + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, low | (high << 32 if major == 4 else 0)))
    if not entries or entries[0][1] != 5:
        raise FormatError("no root entry")
    mini_fat: list[int] = []
    if first_mini < FAT - 1:
        raw = chain(first_mini, fat, sector)
        mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    root = chain(entries[0][5], fat, sector) if entries[0][6] else b""
    out: dict[str, bytes] = {}
    been: set[int] = set()
    todo = [(entries[0][4], "")]
    while todo:
        k, path = todo.pop()
        if k == FREE:
            continue
        if k in been or k >= len(entries):
            raise FormatError("cyclic or missing directory entry")
        been.add(k)
        name, kind, left, right, child, start, length = entries[k]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            if length > len(data):
                raise FormatError("stream is longer than the file")
            if length == 0:
                content = b""
            elif length < cutoff:
                content = chain(start, mini_fat, lambda s: root[s * 64 : s * 64 + 64])
            else:
                content = chain(start, fat, sector)
            if len(content) < length:
                raise FormatError("stream ends early")
            out[path + name] = content[:length]
    return out


def cfb_write(streams: dict[str, bytes]) -> bytes:
    """A version 3 compound file of the streams by path; each is padded to the size that keeps it off the mini stream."""
    names = sorted({p.rsplit("/", k)[0] for p in streams for k in range(1, p.count("/") + 1)})
    nodes = [("Root Entry", 5, "")] + [(n.rsplit("/", 1)[-1], 1, n) for n in names] + [(p.rsplit("/", 1)[-1], 2, p) for p in streams]
    index = {path: k for k, (_, kind, path) in enumerate(nodes) if kind != 5}
    kids: dict[int, list[int]] = {}
    for path, k in index.items():
        kids.setdefault(index.get(path.rpartition("/")[0], 0), []).append(k)
    first = {k: v[0] for k, v in kids.items()}
    right = {a: b for v in kids.values() for a, b in zip(v, v[1:], strict=False)}
    n_dir = -(-len(nodes) * 128 // 512)
    body, place, at = b"", {}, n_dir
    for path, content in streams.items():
        padded = content.ljust(-(-max(len(content), 1) // 512) * 512, b"\0")
        place[path] = (at, len(padded) // 512)
        body += padded
        at += len(padded) // 512
    n_fat = 1
    while (at + n_fat) > n_fat * 128:
        n_fat += 1
    fat = [FREE] * (n_fat * 128)
    for begin, n in [(0, n_dir), *place.values()]:
        for k in range(n):
            fat[begin + k] = begin + k + 1 if k + 1 < n else END
    for k in range(n_fat):
        fat[at + k] = FAT
    entries = b""
    for k in range(n_dir * 4):
        if k >= len(nodes):
            entries += b"\0" * 68 + struct.pack("<3I", FREE, FREE, FREE) + b"\0" * 48
            continue
        name, kind, path = nodes[k]
        raw = name.encode("utf-16-le")
        start, size = (place[path][0], len(streams[path])) if kind == 2 else (END, 0)
        entries += raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw) + 2, kind, 1, FREE, right.get(k, FREE), first.get(k, FREE)) + b"\0" * 36 + struct.pack("<IQ", start, size)
    # A cutoff of 0 keeps every stream in regular sectors.
    head = CFB_MAGIC + b"\0" * 16 + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, n_fat, 0, 0, 0, END, 0, END, 0)
    head += struct.pack("<109I", *[at + k for k in range(n_fat)], *[FREE] * (109 - n_fat))
    return head + entries + body + struct.pack(f"<{len(fat)}I", *fat)


# MS-OVBA


def ovba_decompress(data: bytes, most: int = 64 << 20) -> bytes:
    """Content of a compressed container: chunks of literals and of copies with a split of offset and length that moves."""
    if not data or data[0] != 1:
        raise FormatError("no container signature")
    out = bytearray()
    p = 1
    while p < len(data):
        if p + 2 > len(data):
            raise FormatError("chunk header ends early")
        head = struct.unpack_from("<H", data, p)[0]
        if head >> 12 & 7 != 3:
            raise FormatError("bad chunk signature")
        end = p + (head & 0xFFF) + 3
        if end > len(data):
            raise FormatError("chunk ends early")
        p += 2
        begin = len(out)
        if not head & 0x8000:
            out += data[p:end]
            p = end
        while p < end:
            flags = data[p]
            p += 1
            for bit in range(8):
                if p >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[p])
                    p += 1
                    continue
                if p + 2 > end:
                    raise FormatError("copy token ends early")
                token = struct.unpack_from("<H", data, p)[0]
                p += 2
                bits = max(4, (len(out) - begin - 1).bit_length()) if len(out) > begin else 4
                offset, length = (token >> (16 - bits)) + 1, (token & (0xFFFF >> bits)) + 3
                if offset > len(out) - begin:
                    raise FormatError("copy from before the chunk")
                for _ in range(length):
                    out.append(out[-offset])
            if len(out) - begin > 4096:
                raise FormatError("chunk is over 4096 bytes")
        if len(out) > most:
            raise FormatError("decompressed data is over the limit")
    return bytes(out)


def ovba_compress(data: bytes) -> bytes:
    """A container of chunks of literals."""
    out = b"\x01"
    for at in range(0, len(data), 3600):
        part = data[at : at + 3600]
        body = b"".join(b"\0" + part[k : k + 8] for k in range(0, len(part), 8))
        out += struct.pack("<H", 0xB000 | (len(body) + 2 - 3)) + body
    return out


#: Charset names of code pages that Python doesn't know by number alone.
_PAGES = {65001: "utf-8", 10000: "mac_roman", 20127: "ascii"}


def decode_page(raw: bytes, page: int) -> str:
    try:
        return raw.decode(_PAGES.get(page, f"cp{page}"))
    except LookupError:
        raise FormatError(f"unknown code page {page}") from None
    except UnicodeDecodeError as e:
        raise FormatError(f"text isn't in code page {page}: {e.reason}") from None


def ovba_directory(data: bytes) -> dict:
    """A decompressed dir stream: code page, system kind, project name, references and modules."""
    out: dict = {"code_page": 1252, "system": None, "name": "", "references": [], "modules": []}
    module: dict | None = None
    reference = None
    p = 0
    while p + 6 <= len(data):
        kind, n = struct.unpack_from("<HI", data, p)
        if kind == 9:  # the version record's size doesn't count its last two bytes
            n = 6
        body = data[p + 6 : p + 6 + n]
        if len(body) < n:
            raise FormatError("dir record ends early")
        p += 6 + n
        text = lambda: decode_page(body, out["code_page"])  # noqa: B023, E731
        if kind == 1:
            out["system"] = struct.unpack("<I", body)[0]
        elif kind == 3:
            out["code_page"] = struct.unpack("<H", body)[0]
        elif kind == 4:
            out["name"] = text()
        elif kind == 0x16:
            reference = text()
        elif kind in (0x0D, 0x33):
            size = struct.unpack_from("<I", body)[0] if len(body) >= 4 else 0
            out["references"].append({"name": reference or "", "kind": "registered" if kind == 0x0D else "original", "libid": decode_page(body[4 : 4 + size] if kind == 0x0D else body, out["code_page"])})
        elif kind == 0x0E:
            size = struct.unpack_from("<I", body)[0]
            out["references"].append({"name": reference or "", "kind": "project", "libid": decode_page(body[4 : 4 + size], out["code_page"])})
        elif kind == 0x19:
            module = {"name": text(), "stream": "", "offset": 0, "kind": "unknown", "private": False, "read_only": False}
            out["modules"].append(module)
        elif module is not None:
            if kind == 0x47:
                module["name"] = body.decode("utf-16-le", "replace")
            elif kind == 0x1A:
                module["stream"] = text()
            elif kind == 0x32:
                module["stream"] = body.decode("utf-16-le", "replace") or module["stream"]
            elif kind == 0x31:
                module["offset"] = struct.unpack("<I", body)[0]
            elif kind == 0x21:
                module["kind"] = "procedural"
            elif kind == 0x22:
                module["kind"] = "document_or_class"
            elif kind == 0x25:
                module["read_only"] = True
            elif kind == 0x28:
                module["private"] = True
    return out


def ovba_directory_bytes(name: str, modules: list[tuple[str, int]], page: int = 1252) -> bytes:
    """A dir stream of procedural modules (name, text offset)."""
    rec = lambda k, b: struct.pack("<HI", k, len(b)) + b
    out = rec(1, struct.pack("<I", 1)) + rec(3, struct.pack("<H", page)) + rec(4, name.encode()) + struct.pack("<HIIH", 9, 4, 1, 1) + rec(0x0F, struct.pack("<H", len(modules)))
    for m, offset in modules:
        out += rec(0x19, m.encode()) + rec(0x1A, m.encode()) + rec(0x32, m.encode("utf-16-le")) + rec(0x31, struct.pack("<I", offset)) + rec(0x21, b"") + rec(0x2B, b"")
    return out + rec(0x10, b"")


def manifest(text: str) -> dict:
    """A PROJECT stream: modules by kind, and attributes."""
    out: dict = {"modules": [], "attributes": {}}
    for line in text.splitlines():
        key, eq, value = line.partition("=")
        if eq:
            key = key.strip()
            if key in ("Module", "Class", "BaseClass", "Document"):
                out["modules"].append((value.partition("/")[0].strip(), key.lower()))
            out["attributes"][key] = value.strip().strip('"')
        elif line.startswith("["):
            break
    return out


# Compiled code


def line_map(cache: bytes, most_lines: int = 65535) -> list[dict] | None:
    """Lines of compiled code (line, length, offset or None, code) from the one plausible line map; None without any."""
    found = None
    at = cache.find(b"\xfe\xca")
    while at >= 0:
        one = _line_map_at(cache, at, most_lines)
        if one is not None:
            if found is not None:
                raise FormatError("several plausible line maps")
            found = one
        at = cache.find(b"\xfe\xca", at + 2)
    return found


def _line_map_at(cache: bytes, at: int, most_lines: int) -> list[dict] | None:
    if at + 6 > len(cache):
        return None
    n = struct.unpack_from("<H", cache, at + 4)[0]
    table = at + 6 + n * 12 + 10
    if not 0 < n <= most_lines or table > len(cache):
        return None
    out, last = [], 0
    for k in range(n):
        length, _, offset = struct.unpack_from("<HHI", cache, at + 6 + k * 12 + 4)
        if offset == 0xFFFFFFFF or length == 0:
            out.append({"line": k, "length": length, "offset": None, "code": b""})
            continue
        if offset < last or table + offset + length > len(cache):
            return None
        last = offset + length
        out.append({"line": k, "length": length, "offset": table + offset, "code": cache[table + offset : table + last]})
    return out


def line_map_bytes(lines: list[bytes]) -> bytes:
    out, offset = b"\xfe\xca\0\0" + struct.pack("<H", len(lines)), 0
    for code in lines:
        out += b"\0" * 4 + struct.pack("<HHI", len(code), 0, offset)
        offset += len(code)
    return out + b"\0" * 10 + b"".join(lines)


class _Reader:
    """Little-endian numbers and sized blocks one after the other; FormatError at the end of the data."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self, n: int) -> bytes:
        begin, self.at = self.at, self.at + n
        if self.at > len(self.data):
            raise FormatError(f"data ends early at {begin}")
        return self.data[begin : self.at]

    def number(self, size: int = 2) -> int:
        return int.from_bytes(self.skip(size), "little")

    def block(self, unit: int = 1, size: int = 2, optional: bool = False) -> None:
        """Pass a count and so many units; all ones mean that an optional block isn't there."""
        n = self.number(size)
        if not (optional and n in (0xFFFF, (1 << 8 * size) - 1)):
            self.skip(n * unit)


def project_identifiers(stream: bytes) -> list[str]:
    """Identifiers of a _VBA_PROJECT stream, in order: what identifiers' codes in compiled lines count.

    The stream is references, tables by count and module descriptors, whose fields depend on the version; the
    identifiers stand at its end. A list that the stream's end cuts is given as far as it goes.
    """
    r = _Reader(stream)
    if len(stream) < 30 or r.number() != 0x61CC:
        raise FormatError("no identifier table")
    version = r.number()
    odd = version in (0x60, 0x62, 0x63)
    wide_references = version == 0x4E or version >= 0x5B and not odd
    wide_names = version == 0x4E or version >= 0x59 and not odd
    narrow_names = version <= 0x59 and version != 0x4E or 0x5F < version < 0x6B
    r.at = 30
    n_references = r.number()
    if n_references > 1024:
        raise FormatError("too many references")
    r.skip(2)
    mark = 4 if wide_references else 2
    for _ in range(n_references):
        n = r.number()
        if r.skip(n or 6)[mark : mark + 1] in (b"C", b"D") and n:
            r.block()
        r.skip(10)
        if r.number():
            r.block()
            n = r.number()
            r.skip((n + 2 if n else 0) + 30)
    r.block(2)
    r.block(4)
    r.skip(2)
    for _ in range(3):
        r.block(optional=True)
    r.skip(100)
    n_modules = r.number()
    if n_modules > 4096:
        raise FormatError("too many module descriptors")
    for _ in range(n_modules):
        n = r.number()
        r.skip(n if wide_names else 0)
        if narrow_names and n:
            r.block()
        r.block()
        r.block(optional=True)
        r.skip(2)
        for _ in range(2 if version >= 0x6B else 1):
            r.block(optional=True)
        r.skip(2 if version == 0x51 else 6)
        r.block(8)
        r.skip(11)
    r.skip(6)
    r.block(size=4)
    r.skip(6)
    last, every, first = r.number(), r.number(), r.number()
    r.skip(4)
    unused, wanted = every + first - last, last - first
    if unused < 0 or wanted < 0:
        raise FormatError("identifier counts don't fit")
    for _ in range(unused):
        kind, n = r.skip(6)[4:]
        r.skip((6 if kind & 0x80 else 0) + n)
    out: list[str] = []
    try:
        for _ in range(wanted):
            kind, n = r.skip(2)
            own = bool(kind or n)
            if not own:
                kind, n = r.skip(4)[2:]
            r.skip(6 if kind & 0x80 else 0)
            name = r.skip(n)
            try:
                out.append(name.decode())
            except UnicodeDecodeError:
                out.append(name.decode("latin-1"))
            r.skip(4 if own else 0)
    except FormatError:
        pass
    return out


def project_identifiers_bytes(names: list[str], version: int = 0x97) -> bytes:
    """A stream without references and modules that has these identifiers, of at most 255 bytes each."""
    word = struct.Struct("<H").pack
    out = (word(0x61CC) + word(version)).ljust(30, b"\0") + bytes(4 + 2 + 2 + 2 + 3 * 2 + 100 + 2 + 6 + 4 + 6)
    raw = [n.encode() for n in names]
    return out + word(len(raw)) * 2 + bytes(6) + b"".join(bytes((0, len(n))) + n + bytes(4) for n in raw)


def disassemble(code: bytes, opcodes: dict[int, tuple[str, tuple[str, ...], bool]], names) -> tuple[list[dict], str]:
    """Instructions of a line by a table opcode: (mnemonic, operand kinds, payload follows), and an issue or ''.

    A word has the opcode in its low ten bits, the type above. Operand kinds: name (an identifier's
    number, by names), word, dword, and payload (a length and that many bytes, padded to a word).
    """
    out, p = [], 0
    while p + 2 <= len(code):
        head = struct.unpack_from("<H", code, p)[0]
        known = opcodes.get(head & 0x3FF)
        if known is None:
            return out, f"unknown opcode {head & 0x3FF} at {p}"
        begin, (mnemonic, kinds, payload) = p, known
        p += 2
        operands = []
        for kind in kinds:
            size = 4 if kind in ("dword", "function") else 2
            if p + size > len(code):
                return out, f"operand ends early at {p}"
            value = int.from_bytes(code[p : p + size], "little")
            p += size
            operands.append(names(value) if kind in ("name", "function") else str(value))
        if payload:
            if p + 2 > len(code):
                return out, f"payload ends early at {p}"
            n = struct.unpack_from("<H", code, p)[0]
            raw = code[p + 2 : p + 2 + n]
            if len(raw) < n:
                return out, f"payload ends early at {p}"
            p += 2 + n + n % 2
            operands.append(raw.decode("latin-1"))
        out.append({"at": begin, "opcode": head & 0x3FF, "type": head >> 10, "mnemonic": mnemonic, "operands": operands})
    return out, "" if p == len(code) else "odd byte at the end"
