"""Bytes: hashes, sizes, names, entropy, kinds of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions by severity, other known extensions, entropy limits, the glyphs of an entropy map.
CRITICAL_EXTENSIONS = ("exe", "dll", "com", "scr", "msi")
HIGH_EXTENSIONS = ("js", "hta", "vbs", "ps1", "bat", "cmd", "wsf", "lnk", "jar", "pif")
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "zip", "rar", "7z", "jpg", "png", "gif")
LEAST_BLOCK = 1024
MOST_BLOCKS = 64
GLYPHS = " ░▒▓█"

#: (first bytes in hex, offset, MIME type, description), the most telling first.
MAGIC = (
    ("D0CF11E0A1B11AE1", 0, "application/vnd.ms-office", "OLE2 compound document"),
    ("504B0304", 0, "application/zip", "Zip archive"),
    ("504B0506", 0, "application/zip", "Zip archive, empty"),
    ("526172211A07", 0, "application/vnd.rar", "RAR archive"),
    ("377ABCAF271C", 0, "application/x-7z-compressed", "7-zip archive"),
    ("25504446", 0, "application/pdf", "PDF document"),
    ("7B5C727466", 0, "text/rtf", "Rich Text Format"),
    ("89504E470D0A1A0A", 0, "image/png", "PNG image"),
    ("FFD8FF", 0, "image/jpeg", "JPEG image"),
    ("474946383", 0, "image/gif", "GIF image"),
    ("424D", 0, "image/bmp", "BMP image"),
    ("49492A00", 0, "image/tiff", "TIFF image"),
    ("4D4D002A", 0, "image/tiff", "TIFF image"),
    ("4D5A", 0, "application/x-dosexec", "DOS or Windows executable"),
    ("7F454C46", 0, "application/x-executable", "ELF executable"),
    ("1F8B", 0, "application/gzip", "gzip data"),
    ("425A68", 0, "application/x-bzip2", "bzip2 data"),
    ("FD377A585A00", 0, "application/x-xz", "xz data"),
)
TEXT_KINDS = (
    (r"(?i)^\s*BEGIN:VCALENDAR", "text/calendar", "iCalendar"),
    (r"(?i)^\s*(<!doctype\s+html|<html[\s>])", "text/html", "HTML document"),
    (r"^From \S+[^\n]*\n[\w-]+:", "application/mbox", "mailbox"),
    (r"(?i)^\s*<\?xml", "text/xml", "XML document"),
)
EXTENSION_TYPES = {
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "zip": "application/zip",
    "eml": "message/rfc822", "mbox": "application/mbox", "msg": "application/vnd.ms-outlook", "rtf": "text/rtf",
    "ics": "text/calendar", "js": "text/javascript", "xml": "text/xml", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "rar": "application/vnd.rar",
    "7z": "application/x-7z-compressed", "exe": "application/x-dosexec", "doc": "application/msword",
    "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def hashes(content: Column) -> dict[str, Column]:
    return {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256)}


@F.pandas_udf(T.StringType())
def _hashed(content: pd.Series, algorithm: pd.Series) -> pd.Series:
    import hashlib

    def one(raw, name):
        if raw is None or name not in hashlib.algorithms_available:
            return None
        made = hashlib.new(name, raw)
        return made.hexdigest(32) if made.digest_size == 0 else made.hexdigest()

    return pd.Series([one(r, a) for r, a in zip(content, algorithm)])


def hash_by(content: Column, algorithm: str) -> Column:
    """Any algorithm of the Python library; the common ones stay in the JVM."""
    native = {"md5": F.md5, "sha1": F.sha1, "crc32": lambda c: F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")}
    native |= {f"sha{n}": (lambda c, n=n: F.sha2(c, n)) for n in (224, 256, 384, 512)}
    return native[algorithm](content) if algorithm in native else _hashed(content, F.lit(algorithm))


def extension(filename: Column) -> Column:
    """What follows the last point, in lower case; empty if there is none, or nothing stands before it."""
    return F.lower(F.regexp_extract(filename, r"[^.]\.([^./\\]*)$", 1))


def extension_of_type(mime: Column) -> Column:
    firsts: dict[str, str] = {}
    for ext, kind in EXTENSION_TYPES.items():
        firsts.setdefault(kind, f".{ext}")
    known = F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair])
    return F.coalesce(known[mime], F.lit(".bin"))


def effective_filename(filename: Column, md5: Column, mime: Column) -> Column:
    """The name given, or one made of the hash and the type."""
    return F.coalesce(filename, F.concat(F.left(md5, F.lit(8)), extension_of_type(mime)))


def generated_filename(md5: Column, mime: Column) -> Column:
    return F.concat(md5, extension_of_type(mime))


def sanitized_filename(filename: Column) -> Column:
    """Characters that shells and file systems treat apart become one underscore."""
    return F.regexp_replace(F.regexp_replace(filename, r"[ <>|:!&*?/]", "_"), "_+", "_")


def dangerous_extension(filename: Column) -> Column:
    """Severity of the last extension: 0, 1, or null."""
    ext = extension(filename)
    return F.when(ext.isin(*CRITICAL_EXTENSIONS), 0).when(ext.isin(*HIGH_EXTENSIONS), 1)


def double_extension(filename: Column) -> Column:
    """Whether the last two suffixes are both known extensions."""
    known = (*CRITICAL_EXTENSIONS, *HIGH_EXTENSIONS, *DOCUMENT_EXTENSIONS)
    last = F.lower(F.regexp_extract(filename, r"\.([^.]*)\.([^.]*)$", 2))
    before = F.lower(F.regexp_extract(filename, r"\.([^.]*)\.([^.]*)$", 1))
    return F.coalesce(last.isin(*known) & before.isin(*known), F.lit(False))


def entropy_of(raw: bytes) -> float:
    """Bits a byte; 0 for nothing."""
    if not raw:
        return 0.0
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum()) + 0.0


@F.pandas_udf(T.DoubleType())
def entropy(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in content:
        yield part.map(lambda raw: None if raw is None else entropy_of(raw))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def block_entropy(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Entropy of up to 64 equal blocks of 1 KiB at least; what is left over does not count."""

    def blocks(raw):
        if raw is None:
            return None
        n = min(MOST_BLOCKS, len(raw) // LEAST_BLOCK)
        size = len(raw) // n if n else 0
        return [entropy_of(raw[k * size : (k + 1) * size]) for k in range(n)]

    for part in content:
        yield part.map(blocks)


def entropy_severity(value: Column, size: Column) -> Column:
    return F.when((size >= 256) & (value >= 7.6), 2).when((size >= 128) & (value >= 7.2), 3).otherwise(4)


def entropy_summary(value: Column, size: Column) -> Column:
    level = entropy_severity(value, size)
    words = F.when(level == 2, "High entropy: %.2f").when(level == 3, "Elevated entropy: %.2f").otherwise("Entropy: %.2f")
    return F.concat(F.regexp_replace(words, "%.*", ""), F.format_string("%.2f", value))


def entropy_map(values: Column) -> Column:
    """One glyph for each block, from blank to full."""
    glyph = lambda v: F.substring(F.lit(GLYPHS), F.least((v / 8 * 4).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.array_join(F.transform(values, glyph), "")


def sniffed(content: Column) -> Column:
    """(mime, description) by first bytes, else by how a text begins, else null."""
    head = F.hex(F.substring(content, 1, 16))
    found = F.lit(None).cast("struct<mime:string,description:string>")
    told = lambda mime, words: F.struct(F.lit(mime).alias("mime"), F.lit(words).alias("description"))
    text = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")  # one character a byte: a cut cannot fall within one
    cases = [(F.substring(head, 2 * at + 1, len(first)) == first, mime, words) for first, at, mime, words in MAGIC]
    cases += [(text.rlike(pattern), mime, words) for pattern, mime, words in TEXT_KINDS]
    for holds, mime, words in reversed(cases):
        found = F.when(holds, told(mime, words)).otherwise(found)
    return found


def looks_like_text(content: Column) -> Column:
    """No byte below a tab, and valid UTF-8 (as far as the first 4096 bytes, less a cut character, show)."""
    head = F.substring(content, 1, 4096)
    hexes = F.hex(head)
    return (F.length(hexes) > 0) & ~hexes.rlike("^(..)*0[0-8]")


def _by_extension(content: Column, filename: Column) -> Column:
    mime = F.create_map(*[F.lit(x) for pair in EXTENSION_TYPES.items() for x in pair])[extension(filename)]
    return F.when(mime.isNotNull(), F.struct(mime.alias("mime"), F.lit("by extension").alias("description")))


def _by_program(name: str) -> Callable[[Column, Column], Column]:
    """A provider that asks a program or a wheel on the workers; no answer where it is not installed there."""

    def ask(content: Column, filename: Column) -> Column:
        import pandas as pd

        def run(contents: pd.Series) -> pd.DataFrame:
            from siftwood.functions.tools import TYPE_PROGRAMS

            answers = [TYPE_PROGRAMS[name](bytes(c)) if c is not None else None for c in contents]
            return pd.DataFrame([a or (None, None) for a in answers], columns=["mime", "description"])

        run.__annotations__ = {"contents": pd.Series, "return": pd.DataFrame}
        found = F.pandas_udf(run, "mime string, description string")(content)
        return F.when(found["mime"].isNotNull(), found)

    return ask


#: Who tells a type, by name: a function of content and filename that gives (mime, description), or null.
PROVIDERS: dict[str, Callable[[Column, Column], Column]] = {
    "native": lambda content, filename: sniffed(content),
    "extension": _by_extension,
    **{name: _by_program(name) for name in ("libmagic", "file", "magika")},
}


def register_provider(name: str, provider: Callable[[Column, Column], Column]) -> None:
    """Adds a provider; it is asked where a run's order names it."""
    PROVIDERS[name] = provider


def detected(content: Column, filename: Column, order: tuple[str, ...] = ("native", "extension")) -> Column:
    """(mime, description, provider): the first provider with an answer, else what a text is, else octet-stream."""
    made = lambda mime, words, provider: F.struct(mime.alias("mime"), words.alias("description"), F.lit(provider).alias("provider"))
    answers = {}
    for p in order:
        if p in PROVIDERS:
            answer = PROVIDERS[p](content, filename)
            answers[p] = F.when(answer.isNotNull(), made(answer["mime"], answer["description"], p))
    rest = F.when(looks_like_text(content), made(F.lit("text/plain"), F.lit("text"), "fallback")).otherwise(
        made(F.lit("application/octet-stream"), F.lit("data"), "fallback")
    )
    return F.coalesce(*answers.values(), rest)


def detected_by_all(content: Column, filename: Column, order: tuple[str, ...] = ("native", "extension")) -> Column:
    """What each provider says, for display."""
    return F.filter(
        F.array(*[F.struct(F.lit(p).alias("provider"), detected(content, filename, (p,))["mime"].alias("mime"), detected(content, filename, (p,))["provider"].alias("by")) for p in order]),
        lambda x: x["by"] == x["provider"],
    )


def type_mismatch(declared: Column, magic: Column) -> Column:
    return declared.isNotNull() & (declared != magic)


def printable_strings(content: Column, least: int = 6) -> Column:
    """Runs of printable ASCII, then those of UTF-16LE that are not among them."""
    single = F.decode(content, "ISO-8859-1")
    ascii_ = F.regexp_extract_all(single, F.lit(rf"[\x20-\x7E]{{{least},}}"), F.lit(0))
    wide = F.transform(
        F.regexp_extract_all(single, F.lit(rf"(?:[\x20-\x7E]\x00){{{least},}}"), F.lit(0)), lambda s: F.replace(s, F.lit("\x00"), F.lit(""))
    )
    return F.concat(ascii_, F.array_except(wide, ascii_))


def guid_bytes(guid: Column) -> Column:
    """A class id's text as its 16 little-endian bytes."""
    h = F.upper(F.regexp_replace(guid, "[^0-9A-Fa-f]", ""))
    at = lambda *places: [F.substring(h, 2 * p + 1, 2) for p in places]
    return F.unhex(F.concat(*at(3, 2, 1, 0, 5, 4, 7, 6, 8, 9, 10, 11, 12, 13, 14, 15)))
