"""Compound files (the binary office format), read by their published layout; no wheel is needed.

Like functions.formats, all of this is plain Python on one file's bytes, for use inside Arrow workers.
"""

from __future__ import annotations

import re
import struct
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from siftwood.functions.content import CRITICAL_EXTENSIONS, HIGH_EXTENSIONS
from siftwood.functions.formats import EXPLOITED_CLASSES, File, Outcome

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF

# Known class ids besides the exploited ones, what tells a document's type, names that tell something.
KNOWN_CLASSES = {
    "00020906-0000-0000-c000-000000000046": "Microsoft Word Document",
    "00020900-0000-0000-c000-000000000046": "Microsoft Word 6.0-7.0 Document",
    "00020820-0000-0000-c000-000000000046": "Microsoft Excel Worksheet",
    "00020810-0000-0000-c000-000000000046": "Microsoft Excel 5.0/95 Worksheet",
    "64818d10-4f9b-11cf-86ea-00aa00b929e8": "Microsoft PowerPoint Presentation",
    "d5cdd505-2e9c-101b-9397-08002b2cf9ae": "DocumentSummaryInformation",
    "0003000c-0000-0000-c000-000000000046": "OLE Package object",
    "f20da720-c02f-11ce-927b-0800095ae340": "OLE Package (alternate)",
    "ecabafc6-7f19-11d2-978e-0000f8757e2a": "New Moniker",
    "0002e005-0000-0000-c000-000000000046": "Outlook DataObject",
}
TYPE_OF_CLASS = {
    "00020906-0000-0000-c000-000000000046": "Word",
    "00020900-0000-0000-c000-000000000046": "Word",
    "00020820-0000-0000-c000-000000000046": "Excel",
    "00020810-0000-0000-c000-000000000046": "Excel",
    "64818d10-4f9b-11cf-86ea-00aa00b929e8": "PowerPoint",
}
TYPE_OF_STREAM = {"worddocument": "Word", "1table": "Word", "0table": "Word", "workbook": "Excel", "book": "Excel", "powerpointdocument": "PowerPoint"}
MACRO_NAMES = ("vba", "macros", "_vba_project", "_vba_project_cur", "vbaproject.otm")
FILEPASS = 0x002F
SUMMARY_FIELDS = {2: "title", 3: "subject", 4: "author", 6: "comments", 7: "template", 8: "last_saved_by", 9: "revision", 12: "create_time", 13: "last_saved_time", 18: "application"}
DOCUMENT_FIELDS = {2: "category", 14: "manager", 15: "company"}
# Parts of stream names, in lower case, with what they tell and how grave it is.
TELLING_STREAMS = {
    "\x01ole": ("OLE native data stream", 4),
    "\x01compobj": ("Compound object identification", 4),
    "\x03objinfo": ("Object information stream", 4),
    "equationnative": ("Equation Editor native data — possible exploit vector", 1),
    "powerpointdocument": ("PowerPoint document stream", 4),
    "worddocument": ("Word document stream", 4),
    "workbook": ("Excel workbook stream", 4),
    "book": ("Excel 5.0/95 workbook stream", 4),
}


@dataclass(frozen=True)
class Entry:
    path: tuple[str, ...]
    kind: str  # root, storage or stream
    class_id: str
    content: bytes


def entries(raw: bytes) -> list[Entry]:
    """All storages and streams, the root first.  Chains that run in circles or out of the file end there."""
    if raw[:8] != MAGIC or len(raw) < 512:
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    size, mini_size = 1 << shift, 1 << mini_shift
    first_dir, cutoff, first_mini, _, first_more, more = struct.unpack_from("<I4xIIIII", raw, 48)
    sector = lambda n: raw[(n + 1) * size : (n + 2) * size]
    numbers = lambda b: struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])

    def chain(start: int, table: tuple[int, ...]) -> list[int]:
        out, seen = [], set()
        while start < len(table) and start not in seen:
            seen.add(start)
            out.append(start)
            start = table[start]
        return out

    places = list(numbers(raw[76:512]))
    for _ in range(more):
        if first_more >= FREE - 1 or not (found := numbers(sector(first_more))):
            break
        places += found[:-1]
        first_more = found[-1]
    fat = tuple(x for p in places if p < FREE - 1 for x in numbers(sector(p)))
    directory = b"".join(sector(n) for n in chain(first_dir, fat))
    mini_fat = tuple(x for n in chain(first_mini, fat) for x in numbers(sector(n)))
    rows = [directory[k : k + 128] for k in range(0, len(directory) - 127, 128)]
    if not rows:
        raise ValueError("no directory")
    root_start, root_size = struct.unpack_from("<IQ", rows[0], 116)
    mini = b"".join(sector(n) for n in chain(root_start, fat))[:root_size]

    def body(row: bytes) -> bytes:
        start, length = struct.unpack_from("<IQ", row, 116)
        length &= 0xFFFFFFFF if shift == 9 else 0xFFFFFFFFFFFFFFFF
        if length >= cutoff:
            return b"".join(sector(n) for n in chain(start, fat))[:length]
        return b"".join(mini[n * mini_size : (n + 1) * mini_size] for n in chain(start, mini_fat))[:length]

    out: list[Entry] = []
    todo, seen = [(0, ())], set()
    while todo:
        k, parent = todo.pop()
        if k >= len(rows) or k in seen:
            continue
        seen.add(k)
        row = rows[k]
        length, kind = struct.unpack_from("<HB", row, 64)
        left, right, child = struct.unpack_from("<III", row, 68)
        name = row[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        path = parent if kind == 5 else (*parent, name)
        if kind in (1, 2, 5):
            out.append(Entry(path, {1: "storage", 2: "stream", 5: "root"}[kind], str(uuid.UUID(bytes_le=row[80:96])), body(row) if kind == 2 else b""))
        todo += [(right, parent), (child, path), (left, parent)]
    return out


def package(raw: bytes) -> tuple[str, str, bytes] | None:
    """(filename, source path, payload) of a native package stream, or None."""
    m = re.match(rb".{4}.{2}([^\0]{0,4096})\0([^\0]{0,4096})\0.{8}([^\0]{0,4096})\0(.{4})", raw, re.S)
    if not m:
        return None
    length = struct.unpack("<I", m[4])[0]
    payload = raw[m.end() : m.end() + length] if 0 < length <= len(raw) - m.end() else raw[m.end() :]
    name, source = (x.decode("latin-1") for x in (m[1], m[2]))
    return (name, source, payload) if name or payload else None


def object_package(raw: bytes) -> tuple[str, str, bytes] | None:
    """(class name, topic, payload) of an embedded object of the first version."""
    at, texts = 8, []
    if len(raw) < 24 or struct.unpack_from("<I", raw, 4)[0] != 2:
        return None
    for _ in range(3):
        if at + 4 > len(raw):
            return None
        n = struct.unpack_from("<I", raw, at)[0]
        texts.append(raw[at + 4 : at + 3 + n].decode("latin-1") if n else "")
        at += 4 + n
    if at + 4 > len(raw):
        return None
    n = struct.unpack_from("<I", raw, at)[0]
    return texts[0], texts[1], raw[at + 4 : at + 4 + n]


def has_filepass(workbook: bytes) -> bool:
    """Whether the records of a workbook, walked from the start, hold the mark of a password."""
    at = 0
    while at + 4 <= len(workbook):
        kind, length = struct.unpack_from("<HH", workbook, at)
        if kind == FILEPASS:
            return True
        if kind == 0 and length == 0:
            return False
        at += 4 + length
    return False


def summary(raw: bytes, names: dict[int, str] = SUMMARY_FIELDS) -> dict[str, str]:
    """Texts and times of a summary stream's first property set."""
    out: dict[str, str] = {}
    if len(raw) < 48:
        return out
    base = struct.unpack_from("<I", raw, 44)[0]
    if base + 8 > len(raw):
        return out
    for k in range(min(struct.unpack_from("<I", raw, base + 4)[0], 256)):
        if base + 16 + 8 * k > len(raw):
            break
        number, offset = struct.unpack_from("<II", raw, base + 8 + 8 * k)
        at = base + offset
        if number not in names or at + 8 > len(raw):
            continue
        kind, n = struct.unpack_from("<II", raw, at)
        text = ""
        if kind == 30:
            text = raw[at + 8 : at + 8 + n].split(b"\0")[0].decode("cp1252", "replace").strip()
        elif kind == 31:
            text = raw[at + 8 : at + 8 + 2 * n].decode("utf-16-le", "replace").split("\0")[0].strip()
        elif kind == 64 and at + 12 <= len(raw):
            ticks = struct.unpack_from("<Q", raw, at + 4)[0]
            if 0 < ticks < 1 << 62:
                text = (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).isoformat(" ")
        if text:
            out[names[number]] = text
    return out


def compound_document(file: File) -> Outcome:
    out = Outcome()
    try:
        found = entries(file.content)
    except (ValueError, struct.error) as error:
        out.tell("error", f"OLE2: {error}", label="error")
        return out
    root, streams = found[0], [e for e in found if e.kind == "stream"]
    names = {e.path[-1].lower().replace(" ", "") for e in streams}
    kind = TYPE_OF_CLASS.get(root.class_id) or next((t for n, t in TYPE_OF_STREAM.items() if n in names), None)
    out.info = f"{kind or 'OLE2'} document with {len(streams)} stream(s)"
    if kind:
        out.tell("doc_type", kind, label="doc_type")
    out.tell("streams", "\n".join(f"{'/'.join(e.path)} [{len(e.content)}]" for e in streams), short=f"{len(streams)} stream(s)", label="streams", verbosity=3)
    for e in found:
        words = EXPLOITED_CLASSES.get(e.class_id) or KNOWN_CLASSES.get(e.class_id)
        if not words:
            continue
        grave = e.class_id in EXPLOITED_CLASSES
        if e.kind == "root":
            out.tell("dangerous_root_clsid" if grave else "root_clsid", f"{words} ({e.class_id})", 0 if grave else 4, label="clsid")
        else:
            out.tell(f"clsid_{'/'.join(e.path)}", f"{words} ({e.class_id})", 0 if grave else 4 if e.class_id in TYPE_OF_CLASS else 2, label="clsid")
    for e in streams:
        name, path = e.path[-1].lower().replace(" ", ""), "/".join(e.path)
        for part, (words, level) in TELLING_STREAMS.items():
            if part in name:
                out.tell(f"stream_{path}", f"{words}: {path}", level, label=f"stream:{path}", verbosity=0 if level < 4 else 2)
                break
    if any(part.lower() in MACRO_NAMES for e in found for part in e.path):
        from siftwood.functions import vba

        out.tell("has_vba", "VBA macros present", 0, label="has_vba")
        vba.document_macros(out, found)
    fields = {k: v for e in streams if e.path[-1] == "\x05SummaryInformation" for k, v in summary(e.content).items()}
    fields |= {k: v for e in streams if e.path[-1] == "\x05DocumentSummaryInformation" for k, v in summary(e.content, DOCUMENT_FIELDS).items()}
    if fields:
        out.tell("metadata", "\n".join(f"{k}: {v}" for k, v in fields.items()), label="metadata", verbosity=1, data=fields)
    template = fields.get("template", "")
    if template.startswith(("http", "\\\\", "//")):
        out.tell("remote_template", f"Remote template: {template}", 0, label="remote_template")
    elif template:
        out.tell("template", template, label="template", verbosity=1)
    if "encryptedpackage" in names:
        out.tell("encrypted", "Document is encrypted", 2, label="encryption")
    if any(e.path[-1].lower() in ("workbook", "book") and has_filepass(e.content) for e in streams):
        out.tell("excel_password", "Workbook is protected by a password", 2, label="encryption")
    embedded = [e for e in streams if e.path[-1] in ("\x01Ole10Native", "Package", "CONTENTS") or "ObjectPool" in e.path[:-1] and e.path[-1].lower() == "package"]
    if embedded or any("ObjectPool" in e.path for e in found):
        out.tell("embedded_objects", "\n".join("/".join(e.path) for e in embedded) or "object pool", 1, short=f"{len(embedded)} embedded object(s)", label="embedded")
    for k, e in enumerate(embedded):
        held = package(e.content) if e.path[-1] == "\x01Ole10Native" else None
        name, payload = (held[0], held[2]) if held else (None, e.content)
        ending = (name or "").rpartition(".")[2].lower()
        if ending in CRITICAL_EXTENSIONS + HIGH_EXTENSIONS:
            out.tell(f"dangerous_embed_{k}", f"Embedded file with dangerous type: {name}", 0, label="dangerous_embed")
        if payload:
            out.hold(name or f"embedded_{k}.bin", payload, archive_type="ole", archive_filename="/".join(e.path))
    return out
