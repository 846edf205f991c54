import io
import random
import struct
import zipfile

import pytest

from tamarack.sources import formats as f


def test_zip_round_trip_and_foreign_archive():
    entries = [("a/b.txt", b"hello" * 50), ("empty", b""), ("é.bin", bytes(range(256)))]
    for deflate in (False, True):
        data = f.zip_write(entries, deflate)
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
        assert [(e["name"], f.zip_read(data, e)) for e in f.zip_directory(data)] == entries
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 1000)
    data = out.getvalue()
    assert f.zip_read(data, f.zip_directory(data)[0]) == b"y" * 1000


@pytest.mark.parametrize("damage", ["crc", "short", "none", "bomb", "encrypted", "name"])
def test_zip_damage(damage):
    data = bytearray(f.zip_write([("a", b"x" * 100)], damage == "bomb"))
    if damage == "none":
        data = b"not a zip"
    elif damage == "crc":
        data[data.find(b"xxx")] ^= 1
    elif damage == "short":
        data = data[:60]
    elif damage == "encrypted":
        data[6] |= 1
    elif damage == "name":
        data[30] = ord("b")
    with pytest.raises(f.FormatError):
        e = f.zip_directory(bytes(data))
        f.zip_read(bytes(data), e[0], 10 if damage == "bomb" else 1000)


def test_compound_file():
    streams = {"VBA/dir": b"x" * 5000, "VBA/M": b"q", "PROJECT": b"Module=A\r\n" * 9, "big": random.Random(1).randbytes(200_000), "none": b""}
    assert f.cfb_streams(f.cfb_write(streams)) == streams
    data = bytearray(f.cfb_write({"a": b"z" * 2000}))
    fat = data.rfind(struct.pack("<I", f.FAT)) // 512 * 512
    struct.pack_into("<I", data, fat + 4, 1)
    with pytest.raises(f.FormatError):
        f.cfb_streams(bytes(data))
    with pytest.raises(f.FormatError):
        f.cfb_streams(b"MZ" + b"\0" * 600)


def test_ovba_published_sample_and_round_trip():
    packed = bytes.fromhex("012FB0002361616162636465826600706167" "68696A013808616B6C00306D6E6F7006710270041072737475761077787" "97A003C")
    assert f.ovba_decompress(packed) == b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"
    data = random.Random(2).randbytes(10_000)
    assert f.ovba_decompress(f.ovba_compress(data)) == data
    for bad in (b"", b"\x02", b"\x01\x10", b"\x01\x00\x00", f.ovba_compress(b"abc")[:-1]):
        with pytest.raises(f.FormatError):
            f.ovba_decompress(bad)


def test_project_streams():
    d = f.ovba_directory(f.ovba_directory_bytes("P", [("M", 7), ("N", 0)]))
    assert d["name"] == "P" and [(m["name"], m["offset"], m["kind"]) for m in d["modules"]] == [("M", 7, "procedural"), ("N", 0, "procedural")]
    m = f.manifest('Module=A\r\nDocument=ThisWorkbook/&H0\r\nCMG="1"\r\n[Host]\r\nx=1')
    assert m["modules"] == [("A", "module"), ("ThisWorkbook", "document")] and m["attributes"]["CMG"] == "1" and "x" not in m["attributes"]


def test_line_map():
    lines = [b"ab", b"", b"cdef"]
    assert [x["code"] for x in f.line_map(b"junk" + f.line_map_bytes(lines))] == lines
    assert f.line_map(b"nothing") is None
    with pytest.raises(f.FormatError):
        f.line_map(f.line_map_bytes(lines) + f.line_map_bytes(lines))


def test_project_identifiers():
    names = ["Main", "x", "Größe", "", "n" * 255]
    data = f.project_identifiers_bytes(names[:3])
    assert f.project_identifiers(data) == names[:3]
    assert f.project_identifiers(f.project_identifiers_bytes([])) == []
    # The first of two identifiers is unused, the second a reserved word, whose number stands in place of a trailer; a third has bytes ahead.
    word = struct.Struct("<H").pack
    head = f.project_identifiers_bytes([])[:-10]
    entries = bytes(4) + b"\0\x01j" + b"\0\0\x07\0\0\x02If" + b"\x80\x01" + bytes(6) + b"z" + bytes(4)
    data = head + word(3) + word(2) + word(1) + bytes(4) + b"\0\x01j" + bytes(4) + entries[7:]
    assert f.project_identifiers(data) == ["j", "If"]
    data = head + word(2) + word(3) + word(0) + bytes(4) + entries
    assert f.project_identifiers(data) == ["If", "z"]
    # Cut in the last name.
    assert f.project_identifiers(data[:-5]) == ["If"]


def test_project_identifiers_with_references_and_modules():
    word = struct.Struct("<H").pack
    plain = f.project_identifiers_bytes(["a", "b"])
    body = "*\\Cxx".encode("utf-16-le")
    one = word(len(body)) + body + word(3) + b"ccc" + bytes(10) + word(0)
    two = word(0) + bytes(6) + bytes(10) + word(1) + word(2) + b"qq" + word(4) + bytes(4 + 2 + 30)
    module = word(4) + b"M\0N\0" + word(2) + b"tt" + word(0xFFFF) + word(0) + word(0xFFFF) + word(1) + b"x" + word(0) + bytes(4) + word(1) + bytes(8) + bytes(11)
    at = 34 + 2 + 2 + 2 + 6 + 100
    data = plain[:30] + word(2) + bytes(2) + one + two + plain[34:at] + word(1) + module + plain[at + 2 :]
    assert f.project_identifiers(data) == ["a", "b"]


@pytest.mark.parametrize("data", [b"", bytes(40), f.project_identifiers_bytes(["a"])[:60], f.project_identifiers_bytes(["a"])[:30] + b"\xff\xff" + bytes(200)])
def test_project_identifiers_damage(data):
    with pytest.raises(f.FormatError):
        f.project_identifiers(data)
