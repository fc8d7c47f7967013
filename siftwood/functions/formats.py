"""What each kind of file tells and holds: functions from one file's bytes to findings and nested files.

They run inside Arrow workers, a batch of files at a time; nothing here touches Spark.  A finding is a dict with key,
text, severity and so on; a nested file a dict with filename, content, mime, metadata.
"""

from __future__ import annotations

import io
import mailbox
import posixpath
import re
import tempfile
import zipfile
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

from siftwood.functions import mail, scripts
from siftwood.functions.text import PASSWORD_LINE, SHORTENERS, decode_bytes

# Passwords that archives of samples commonly have.
ARCHIVE_PASSWORDS = ("infected", "Infected", "iNFECTED", "INFECTED")
COMMON_PASSWORDS = (*ARCHIVE_PASSWORDS, "password", "123456", "virus", "malware", "clean", "test")


@dataclass
class Outcome:
    """What came of one file."""

    info: str = ""
    reports: list[dict] = field(default_factory=list)
    children: list[dict] = field(default_factory=list)
    hops: list[dict] = field(default_factory=list)
    gateways: list[dict] = field(default_factory=list)

    def tell(self, key: str, text: str, severity: int = 4, **more) -> None:
        self.reports.append({"key": key, "text": text, "severity": severity, **more})

    def hold(self, filename: str | None, content: bytes, mime: str | None = None, **metadata) -> None:
        self.children.append({"filename": filename, "content": content, "mime": mime, "metadata": {k: str(v) for k, v in metadata.items()}})


@dataclass(frozen=True)
class File:
    content: bytes
    filename: str | None
    mime: str
    max_ratio: int = 100
    max_size: int = 1 << 30
    passwords: tuple[str, ...] = ()


# --- text, mail, mailboxes ----------------------------------------------------------------------------------------


def plain_text(file: File) -> Outcome:
    """Indicators and language are native passes over all texts; here is only how the bytes decode."""
    out = Outcome()
    text, encoding = decode_bytes(file.content)
    out.tell("encoding", encoding, label="encoding", verbosity=1)
    out.tell("summary", text, short=text[:200], verbosity=1, order=60)
    found = []
    for m in re.finditer(PASSWORD_LINE, text):
        found += [w for w in (x.strip().strip("\"'") for x in m[1].split()) if len(w) > 3]
    if found:
        out.tell("possible_passwords", "\n".join(dict.fromkeys(found)), 1, label="passwords")
    return out


def message(file: File) -> Outcome:
    out = Outcome()
    headers, parts, status = mail.parse_message(file.content)
    if status != "done":
        out.tell("error", status, label="error")
        return out
    raw = lambda name: [v for k, v in headers if k.lower() == name.lower()]
    decoded = lambda name: [c for v in raw(name) for c in mail.decode_chunks(v)]
    senders = decoded("From")
    out.info = "; ".join(decoded("Subject"))
    lines = [f"{name}: {'; '.join(decoded(name))}" for name in ("From", "To", "CC", "Subject", "Date") if raw(name)]
    out.tell("summary", "\n".join(lines), order=1)
    for date in decoded("Date")[:1]:
        when = mail.parse_date(date)
        if when:
            out.tell("email_date", date, label="date", order=2, data={"timestamp": when.isoformat()})
    sender = mail.domain_of(senders)
    for key, name, level in (("reply_to_mismatch", "Reply-To", 1), ("return_path_mismatch", "Return-Path", 2)):
        other = next((v for v in decoded(name) if "@" in v and mail.domain_of([v]) not in ("", sender)), None)
        if sender and other:
            out.tell(key, f"{name} ({other}) domain differs from From domain ({sender})", level, label=key)
    for k, line in enumerate(raw("Received")):
        hop = mail.parse_received(line)
        if hop:
            out.hops.append(hop | {"pos": k})
    out.gateways = mail.gateway_findings(raw)
    if out.gateways:
        out.tell("gateway_headers", "\n".join(g["label"] for g in out.gateways), short=f"{len(out.gateways)} gateway header(s)", label="gateway", verbosity=2)
    out.reports += mail.auth_reports(raw("Authentication-Results"), raw("ARC-Authentication-Results"), senders)
    for part in parts:
        if part["content"]:
            out.hold(part["filename"], part["content"], part["content_type"])
    return out


def mailbox_file(file: File) -> Outcome:
    out = Outcome()
    with tempfile.NamedTemporaryFile() as temporary:
        temporary.write(file.content)
        temporary.flush()
        for k, item in enumerate(mailbox.mbox(temporary.name, create=False)):
            out.hold(f"mbox-message-{k + 1}.eml", item.as_bytes(), "message/rfc822")
    out.info = f"{len(out.children)} message(s)"
    return out


# --- archives -----------------------------------------------------------------------------------------------------


def opens(archive: zipfile.ZipFile, password: str | None) -> bool:
    """Whether every encrypted member can be read with the password."""
    try:
        archive.setpassword(password.encode() if password else None)
        return archive.testzip() is None
    except (RuntimeError, zipfile.BadZipFile, NotImplementedError):
        return False


def zip_archive(file: File) -> Outcome:
    out = Outcome()
    try:
        archive = zipfile.ZipFile(io.BytesIO(file.content))
    except zipfile.BadZipFile:
        out.tell("error", "Bad ZIP file.", label="error")
        return out
    members = archive.infolist()
    out.info = f"{len(members)} compressed file(s)"
    out.tell("summary", "\n".join(f"{m.filename} {'<encrypted>' if m.flag_bits & 1 else ''} [{m.file_size}]" for m in members))
    size = sum(m.file_size for m in members)
    bomb = "compression ratio too high" if file.content and size / len(file.content) > file.max_ratio else "total uncompressed size is too large" if size > file.max_size else None
    if bomb:
        out.tell("error", f"Zip bomb detected: {bomb}.", label="error")
        return out
    slashed = [(m.filename, m.filename.replace("\\", "/")) for m in members]
    up = [name for name, path in slashed if ".." in path.split("/")]
    if up:
        out.tell("path_traversal", f"ZIP path traversal (Zip Slip) detected: {', '.join(up[:10])}", 0)
        return out
    rooted = [name for name, path in slashed if path.startswith("/")]
    if rooted:
        out.tell("absolute_path", f"ZIP contains absolute paths: {', '.join(rooted[:10])}", 1)
    if any(m.flag_bits & 1 for m in members):
        out.tell("encrypted", "ZIP File is Password protected", label="encryption")
        known = next((p for p in ARCHIVE_PASSWORDS if opens(archive, p)), None)
        later = None if known else next((p for p in file.passwords if opens(archive, p)), None)
        if known:
            out.tell("password", known)
        elif later:
            out.tell("password_discovered", "ZIP unlocked with discovered password", 1, label="password_discovered")
            out.tell("decrypted", "Encrypted ZIP decrypted after password discovery", 1, label="decrypted")
        else:
            out.tell("pending_password", "Encrypted ZIP queued for retry when passwords are discovered", 1, label="pending_password")
            return out
    seen = set()
    for m in members:
        if m.is_dir() or (m.filename, m.CRC, m.file_size) in seen:
            continue
        seen.add((m.filename, m.CRC, m.file_size))
        try:
            content = archive.read(m)
        except (RuntimeError, zipfile.BadZipFile, NotImplementedError, EOFError):
            continue
        out.hold(
            m.filename, content, archive_type="zip", archive_filename=m.filename, archive_modified="%04d-%02d-%02d %02d:%02d:%02d" % m.date_time,
            archive_compress_method={0: "stored", 8: "deflated", 12: "bzip2", 14: "lzma"}.get(m.compress_type, m.compress_type),
            archive_create_system={0: "FAT", 3: "Unix", 10: "NTFS"}.get(m.create_system, m.create_system),
        )
    return out


# --- pages --------------------------------------------------------------------------------------------------------


class _Page(HTMLParser):
    HIDDEN = ("script", "style", "noscript", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.images, self.forms, self.scripts = [], [], [], [], []
        self.hidden, self.link = 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.HIDDEN:
            self.hidden += 1
            if tag == "script":
                self.scripts.append("")
        elif tag == "a" and a.get("href"):
            self.link = [a["href"], ""]
        elif tag == "img" and a.get("src"):
            self.images.append(a["src"])
        elif tag == "form":
            self.forms.append(a.get("action") or "")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.link:
            self.links.append(self.link)
            self.link = None

    def handle_data(self, data):
        if self.hidden:
            if self.scripts:
                self.scripts[-1] += data
        else:
            self.text.append(data)
            if self.link:
                self.link[1] += data


def page(file: File) -> Outcome:
    out, parser = Outcome(), _Page()
    parser.feed(scripts.decode_text(file.content)[0])
    parser.close()
    blank = lambda s: " ".join(s.split())
    if parser.links:
        out.tell("links", "\n".join(f"{blank(t)} -> {h}" if blank(t) else h for h, t in parser.links), short=f"{len(parser.links)} link(s)", label="links", verbosity=1)
    if parser.images:
        out.tell("images", "\n".join(parser.images), short=f"{len(parser.images)} image(s)", label="images", verbosity=1)
    if parser.forms:
        out.tell("forms", "\n".join(parser.forms), 2, short=f"{len(parser.forms)} form(s)", label="forms")
    text = blank(" ".join(parser.text))
    if text:
        out.hold(None, text.encode(), "text/plain")
    return out


# --- scripts ------------------------------------------------------------------------------------------------------

# Signs of JavaScript in a text.
SCRIPT_SIGNS = (r"\bfunction\s", r"\bvar\s", r"\blet\s", r"\bconst\s", r"\bWScript\.", r"\bActiveXObject\b", r"(?m)^#!/usr/bin/env\s+node", r"\brequire\s*\(", r"\bmodule\.exports\b", r"=>")
_THREATS = [(level, re.compile(p), name, words) for level, p, name, words in scripts.THREATS]


def threats(source: str) -> list[dict]:
    out: dict[str, dict] = {}
    for level, form, name, words in _THREATS:
        m = None if name in out else form.search(source)
        if m:
            context = source[max(0, m.start() - 30) : m.end() + 30].replace("\n", " ").strip()
            out[name] = {"pattern": name, "severity": level, "description": words, "context": context}
    return list(out.values())


def fold(source: str, passes: int = 10) -> str:
    for _ in range(passes):
        folded = re.sub(scripts.CONCATENATION, r"\1\2\4\1", source)
        if folded == source:
            break
        source = folded
    return source


def script(file: File) -> Outcome:
    out = Outcome()
    source, _ = scripts.decode_text(file.content)
    lib = next((name for p, name in scripts.LIBRARIES if re.search(p, source[:2000])), None)
    coded = scripts.decode_encoded_script(file.content)
    kind = scripts.kind_of(file.filename, coded is not None, lib)
    out.info = kind
    out.tell("script_type", kind, label="script_type")
    m = scripts.measure(source)
    points, signs = scripts.score(m, source, lib)
    level = next(s for s, least in enumerate((81, 61, 41, 21, 0)) if points >= least)
    names = ("critical", "high", "medium", "low", "info")
    out.tell("obfuscation", f"Obfuscation score: {points}/100 ({names[level]})" + "".join(f"\n  {s}" for s in signs), level, short=f"Obfuscation score {points}", label="obfuscation", data=m)
    folded = fold(source)
    codes = scripts.char_codes(source)
    found = threats("\n".join([folded, *(t for _, t in codes)]))
    for k, t in enumerate(found):
        out.tell(f"threat_{k}", f"{t['description']}: {t['context']}", t["severity"], short=t["pattern"], label="threat")
    names_ = {t["pattern"] for t in found}
    if names_ & set(scripts.DOWNLOAD) and names_ & set(scripts.WRITE) and names_ & set(scripts.EXECUTE):
        out.tell("kill_chain", "Download, write and execute parts occur together", 0, label="kill_chain")
    hidden = [a for a in scripts.FRAGMENTED if a.lower() in folded.lower() and a.lower() not in source.lower()]
    if hidden:
        out.tell("fragmented_api", ", ".join(hidden), 1, label="fragmentation")
    literals = scripts.scan(source)[2]
    plain = set(literals)
    strings = [t for _, t in codes] + [u for x in literals if (u := scripts.unescape(x)) != x] + [x for x in scripts.scan(folded)[2] if len(x) > 10 and x not in plain]
    if strings:
        out.tell("decoded_strings", "\n".join(strings), short=f"{len(strings)} decoded string(s)", label="decoded", verbosity=1)
        out.hold("decoded_strings.txt", "\n".join(strings).encode(), "text/plain")
    for k, (_, raw) in enumerate(scripts.base64_blobs(literals)):
        level = 0 if raw[:2] == b"MZ" or raw[:4] == b"\x7fELF" else 1 if raw[:2] == b"PK" else 2
        out.tell(f"base64_payload_{k}", f"{len(raw)} bytes in base64", level, label="base64")
        out.hold(f"base64_payload_{k}.bin", raw)
    if coded is not None:
        out.tell("jse_encoded", "Encoded script decoded", 1, label="encoded")
        out.hold("decoded.js", coded, "text/javascript")
    from siftwood.functions import tools

    laid_out = tools.beautified(source)
    if tools.much_changed(source, laid_out):
        out.tell("beautified", f"Source laid out anew in {laid_out.count(chr(10)) + 1} lines", short="Source laid out anew", label="beautified", verbosity=2, order=70)
        out.hold("beautified.js", laid_out.encode(), "text/plain")
    plain_source = tools.deobfuscated(source)
    if plain_source:
        rescan(out, plain_source[1], f"Deobfuscated by {plain_source[0]} ({len(plain_source[1])} chars)", found)
    run = tools.run_sandbox(file.content)
    if run:
        tools.tell_sandbox(out, run)
    return out


def rescan(out: Outcome, source: str, words: str, known: list[dict]) -> None:
    """Threats of a deobfuscated source that its first form did not show, and the chain of both together."""
    out.tell("deobfuscated", words, label="deobfuscated", verbosity=1, order=71)
    names = {t["pattern"] for t in known}
    new = [t for t in threats(source) if t["pattern"] not in names]
    for k, t in enumerate(new, len(known)):
        out.tell(f"threat_{k}", f"[post-deobfuscation] {t['description']}: {t['context']}", t["severity"], short=f"[deobf] {t['pattern']}", label="threat")
    names |= {t["pattern"] for t in new}
    if not any(r["key"] == "kill_chain" for r in out.reports) and names & set(scripts.DOWNLOAD) and names & set(scripts.WRITE) and names & set(scripts.EXECUTE):
        out.tell("kill_chain", "Download, write and execute parts occur together after deobfuscation", 0, label="kill_chain")
    out.hold("deobfuscated.js", source.encode(), "text/plain")


# --- rich text and calendars --------------------------------------------------------------------------------------

# Control words, signs of obfuscation, class ids by their first four bytes.
RTF_WORDS = {
    r"\objdata": "OLE object data — may contain embedded executable or exploit payload",
    r"\objautlink": "OLE auto-link — can trigger automatic execution of linked object",
    r"\objupdate": "OLE auto-update — triggers automatic update of embedded object",
    r"\objocx": "OLE ActiveX control — may execute code via embedded ActiveX",
    r"\objhtml": "OLE HTML object — can load remote content",
    r"\object": "Embedded OLE object",
    r"\equation": "Equation Editor object — associated with CVE-2017-11882 exploit",
    r"\ddeauto": "DDE auto-execute — Dynamic Data Exchange automatic link",
    r"\dde": "DDE field — Dynamic Data Exchange link",
    r"\package": "OLE Package — can wrap arbitrary files including executables",
}
RTF_GRAVE = (r"\objdata", r"\ddeauto", r"\equation", r"\objautlink")
RTF_OBFUSCATION = (
    (r"(?i)\\bin\s*\d+", "Binary data blob (\\bin)"),
    (r"\\objdata\s+[0-9a-fA-F]{200,}", "Large hex-encoded OLE object data"),
    (r"(?:\\[a-z]+\s*){50,}", "Excessive control word sequence (possible obfuscation)"),
)
RTF_CLASSES = {
    "0002ce02": "Equation Editor 3.0 (CVE-2017-11882)",
    "00021401": "Windows Shell Link (.lnk)",
    "f20da720": "OLE Package object",
    "00020906": "Microsoft Word Document (embedded)",
    "3050f4d8": "MSHTML (CVE-2021-40444)",
    "d27cdb6e": "Shockwave Flash Object",
    "00000309": "Composite Moniker (CVE-2017-8570)",
    "06290bd3": "Script Moniker (CVE-2017-8570)",
    "d5de8d20": "Shell.Explorer / WebBrowser control",
}


def brace_depth(text: str) -> int:
    depth = deepest = 0
    for brace in re.findall("[{}]", text):
        depth += 1 if brace == "{" else -1
        deepest = max(deepest, depth)
    return deepest


def rich_text(file: File) -> Outcome:
    out, text = Outcome(), file.content.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        out.tell("format", "File does not start with RTF header", 3)
        return out
    depth = brace_depth(text)
    out.info = f"RTF document, nesting depth {depth}"
    out.tell("nesting_depth", str(depth), label="Nesting depth")
    if depth > 100:
        out.tell("deep_nesting", f"Unusually deep nesting ({depth} levels) — possible obfuscation", 2)
    lower = text.lower()
    words = [f"{w}: {d}" for w, d in RTF_WORDS.items() if w in lower]
    if words:
        out.tell("suspicious_control_words", "\n".join(words), 1 if any(w in lower for w in RTF_GRAVE) else 2, short=f"{len(words)} suspicious control word(s) detected", label="Suspicious RTF control words")
    objects = [re.sub(r"\s+", "", h) for h in re.findall(r"\\objdata\s+([0-9a-fA-F\s]+)", text)]
    if objects:
        out.tell("ole_count", f"{len(objects)} embedded OLE object(s)", 2, label="OLE objects")
    for k, digits in enumerate(objects):
        known = RTF_CLASSES.get(digits[:8].lower()) if len(digits) >= 16 else None
        if known:
            out.tell(f"ole_clsid_{k}", f"OLE object #{k + 1} contains dangerous CLSID: {known}", 0)
        if len(digits) > 32 and len(digits) % 2 == 0:
            out.hold(f"ole_object_{k}.bin", bytes.fromhex(digits))
    signs = [words for form, words in RTF_OBFUSCATION if re.search(form, text)]
    runs = len(re.findall(r"(?:\\'[0-9a-fA-F]{2}){10,}", text))
    if runs:
        signs.append(f"{runs} hex-escaped string(s) detected (possible obfuscated content)")
    if signs:
        out.tell("obfuscation", "\n".join(signs), 2, short=f"{len(signs)} obfuscation indicator(s)", label="Obfuscation indicators")
    for m in re.finditer(r"(?is)\{\s*\\\*\s*\\template\s+([^}]+)\}", text):
        out.tell("rtf_template_injection", f"RTF template injection: {{\\*\\template}} points to external resource: {m[1].strip()[:200]}", 0)
    fonts = re.search(r"\{\\fonttbl", text)
    if fonts:
        level = end = 0
        for m in re.finditer("[{}]", text[fonts.start() :]):
            level += 1 if m[0] == "{" else -1
            end = m.end()
            if not level:
                break
        nested = brace_depth(text[fonts.start() : fonts.start() + end])
        if nested > 10:
            out.tell("fonttbl_nesting", f"Font table nested {nested} levels deep", 0 if nested > 50 else 1)
    plain = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    plain = re.sub(r"\s+", " ", re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]", "", plain))).strip()
    if len(plain) > 10 and sum(c.isprintable() for c in plain) > 0.7 * len(plain):
        out.hold("rtf_text.txt", plain.encode(), "text/plain")
    return out


# Fields and phrases of invitations.
ICS_FIELDS = {"SUMMARY": "Summary", "ORGANIZER": "Organizer", "DTSTART": "Start time", "DTEND": "End time", "LOCATION": "Location"}
PHISHING = (
    r"verify\s+your\s+account",
    r"click\s+here\s+(?:to|immediately|now|urgently)",
    r"urgent\s+(?:action|update|notice|meeting)",
    r"password\s+(?:reset|expire|update|change)",
    r"suspended\s+account",
    r"security\s+alert",
    r"unusual\s+(?:sign.in|activity|login)",
    r"confirm\s+(?:your\s+)?identity",
)


def calendar(file: File) -> Outcome:
    out, text = Outcome(), file.content.decode("utf-8", "replace")
    if "BEGIN:VCALENDAR" not in text:
        out.tell("format", "File does not contain BEGIN:VCALENDAR header", 3)
        return out
    out.info = f"iCalendar with {text.count('BEGIN:VEVENT')} event(s)"
    fields = defaultdict(list)
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():  # long lines go on after a blank
        m = re.match(r"([A-Z-]+)(?:;[^:]*)?:(.+)", line)
        if m:
            fields[m[1]].append(m[2].strip())
    for name, label in ICS_FIELDS.items():
        if fields[name]:
            out.tell(name.lower(), "\n".join(fields[name]), label=label)
    if fields["ATTENDEE"]:
        n = len(fields["ATTENDEE"])
        out.tell("attendees", f"{n} attendee(s):\n" + "\n".join(fields["ATTENDEE"]), short=f"{n} attendee(s)", label="Attendees")
    for words in fields["DESCRIPTION"][:1]:
        words = words.replace("\\n", "\n").replace("\\,", ",")
        out.tell("description", words, short=words[:100] + "..." if len(words) > 100 else words, label="Description")
        out.hold("calendar_description.txt", words.encode(), "text/plain")
    for method in fields["METHOD"][:1]:
        out.tell("method", method, label="Method")
        if method.upper() == "REQUEST":
            out.tell("auto_add", "METHOD:REQUEST — this invite may be automatically added to the recipient's calendar by some clients", 3, label="Auto-add risk")
    if "BEGIN:VALARM" in text:
        out.tell("alarms", f"{text.count('BEGIN:VALARM')} alarm(s) defined", 3, label="Alarms")
    urls = sorted(set(re.findall(r"(?i)https?://[^\s;\"'<>\\]+", text)))
    if urls:
        out.tell("urls", "\n".join(urls), 3, short=f"{len(urls)} URL(s)", label="URLs")
    short = [u for u in urls if any(d in u.lower() for d in SHORTENERS)]
    if short:
        out.tell("shortened_urls", "\n".join(short), 2, label="Shortened URLs")
    phrases = [m[0] for p in PHISHING if (m := re.search(f"(?i){p}", text))]
    if phrases:
        out.tell("phishing_indicators", "\n".join(phrases), 1, short=f"{len(phrases)} phishing indicator(s)", label="Phishing indicators")
    return out


# --- office packages ----------------------------------------------------------------------------------------------

# Prefixes of types, class ids that are exploited, protocols, parts that are structure only.
TYPE_PREFIXES = ("application/vnd.openxmlformats-", "application/vnd.ms-", "application/xml", "application/zip", "application/octet-stream", "image/", "audio/", "video/", "text/")
RELATION_PREFIXES = ("http://schemas.openxmlformats.org/", "http://schemas.microsoft.com/", "http://purl.oclc.org/")
NO_MACROS = (".docx", ".xlsx", ".pptx", ".dotx", ".xltx", ".potx", ".ppsx")
EXPLOITED_CLASSES = {
    "0002ce02-0000-0000-c000-000000000046": "Equation Editor 3.0 (CVE-2017-11882)",
    "f4754c9b-64f5-4b40-8af4-679732ac0607": "Equation Editor (alternate CLSID)",
    "00021401-0000-0000-c000-000000000046": "Windows Shell Link (.lnk)",
    "3050f4d8-98b5-11cf-bb82-00aa00bdce0b": "MSHTML (CVE-2021-40444 related)",
    "25336920-03f9-11cf-8fd0-00aa00686f13": "MSHTML (HTMLDocument)",
    "d5de8d20-5bb8-11d1-a1e3-00a0c90f2731": "Shell.Explorer / WebBrowser control",
    "00000309-0000-0000-c000-000000000046": "Composite Moniker (CVE-2017-8570)",
    "06290bd3-48aa-11d2-8432-006008c3fbfc": "Script Moniker (CVE-2017-8570)",
    "d27cdb6e-ae6d-11cf-96b8-444553540000": "Shockwave Flash Object",
}
PROTOCOLS = {
    "ms-msdt:": "Follina exploit (CVE-2022-30190)",
    "ms-excel:": "Excel protocol handler abuse",
    "ms-word:": "Word protocol handler abuse",
    "mhtml:": "MHTML handler (CVE-2021-40444)",
    "cid:": "Content-ID reference",
}
SECURITY_FOLDERS = ("activeX/", "embeddings/", "externalLinks/")
NOISE = (
    "word/theme/", "word/styles.xml", "word/settings.xml", "word/fontTable.xml", "word/webSettings.xml", "word/numbering.xml", "word/footnotes.xml",
    "word/endnotes.xml", "word/comments.xml", "word/commentsExtended.xml", "word/people.xml", "word/media/",
    "xl/theme/", "xl/styles.xml", "xl/sharedStrings.xml", "xl/calcChain.xml", "xl/printerSettings/",
    "ppt/theme/", "ppt/slideLayouts/", "ppt/slideMasters/", "ppt/presProps.xml", "ppt/viewProps.xml", "ppt/tableStyles.xml", "ppt/media/",
    "docProps/core.xml", "docProps/app.xml", "docProps/thumbnail", "[Content_Types].xml", "customXml/",
)
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
COMPATIBILITY = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"


def class_bytes(text: str) -> bytes:
    import uuid

    return uuid.UUID(text).bytes_le


def external(kind: str, target: str) -> tuple[str, int]:
    """What a relationship to the outside means, and how bad it is."""
    lower, last = target.lower(), kind.rpartition("/")[2]
    cases = (
        ("attachedTemplate" in kind, f"A template is loaded from outside: {target}", 0),
        (lower.startswith("mhtml:"), f"Outside reference by mhtml:, as used for CVE-2021-40444: {target}", 0),
        (lower.startswith("ms-msdt:"), f"Outside reference by ms-msdt:, as used for CVE-2022-30190 (Follina): {target}", 0),
        (target.startswith(("file://", "\\\\")), f"Outside reference to a file share, which may give away NTLM hashes: {target}", 0),
        ("altChunk" in kind, f"A chunk of another document is imported from outside: {target}", 1),
        ("oleObject" in kind, f"An OLE object is linked from outside, as used for CVE-2017-0199: {target}", 0),
        (last in ("frame", "subDocument"), f"A {last} is loaded from outside: {target}", 1),
    )
    return next(((words, level) for holds, words, level in cases if holds), (f"Link of kind {last} to the outside: {target}", 1))


def xml_depth(root) -> int:
    deepest, todo = 0, [(root, 1)]
    while todo:
        node, depth = todo.pop()
        deepest = max(deepest, depth)
        todo += [(child, depth + 1) for child in node]
    return deepest


def parsed(raw: bytes):
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None


def office_package(file: File) -> Outcome:
    out = Outcome()
    try:
        archive = zipfile.ZipFile(io.BytesIO(file.content))
    except zipfile.BadZipFile:
        out.tell("error", "Bad ZIP file.", 1, label="error")
        return out
    members = archive.infolist()
    size = sum(m.file_size for m in members)
    bomb = "total uncompressed size is too large" if size > file.max_size else "compression ratio too high" if size > max(file.max_ratio * len(file.content), 1 << 20) else None
    if bomb:
        out.tell("error", f"Zip bomb detected: {bomb}.", 1, label="error")
        return out
    parts = {m.filename: archive.read(m) for m in members}
    names = list(parts)
    out.info = f"Office package with {len(names)} part(s)"
    up = [n for n in names if ".." in n.replace("\\", "/").split("/")]
    if up:
        out.tell("zip_path_traversal", f"Path traversal in package: {', '.join(up[:10])}", 0)
    _types(out, parts, (file.filename or "").lower())
    for key, mark, words, level in (("activeX", "/activeX/", "ActiveX controls found", 2), ("ole_objects", "/embeddings/", "Embedded OLE objects", 1), ("embedded_fonts", "/fonts/", "Embedded fonts", 2)):
        found = [posixpath.basename(n) for n in names if mark in n and not n.endswith("/") and (key != "activeX" or n.endswith(".xml"))]
        if found:
            out.tell(key, f"{words}: {', '.join(found)}", level)
    targets = _relations(out, parts)
    for name, raw in parts.items():
        if name.endswith(".xml") and name != "[Content_Types].xml":
            _content(out, name, raw)
        if name.lower().endswith(".svg"):
            text = raw.decode("utf-8", "ignore")
            if re.search(r"(?i)<script[\s>]", text):
                out.tell(f"svg_script_{name}", f"A script stands in the SVG part {name}", 0)
            if re.search(r"(?i)\bon\w+\s*=", text):
                out.tell(f"svg_event_{name}", f"Event handlers stand in the SVG part {name}", 1)
        binary = ("/embeddings/" in name or "/activeX/" in name) and not name.endswith((".xml", ".rels", "/"))
        if binary:
            hit = next(((c, d) for c, d in EXPLOITED_CLASSES.items() if class_bytes(c) in raw), None)
            if hit:
                out.tell(f"embedded_clsid_{name}", f"{name} holds the class id of {hit[1]}: {hit[0]}", 0)
        infrastructure = name.endswith((".rels", "/")) or "/_rels/" in name or name.startswith(("_rels/", "docProps/")) or name == "[Content_Types].xml"
        orphan = not infrastructure and name.replace("\\", "/").lstrip("/") not in targets
        if orphan:
            out.tell(f"orphan_{name}", f"No relationship names the part {name}", 2)
        if "vbaProject.bin" in name:
            out.tell("vba_macros", f"VBA project: {name}", 0, label="vba_macros")
            _macros(out, name, raw)
        if binary or orphan or "vbaProject.bin" in name or security_relevant(name) and not noise(name):
            out.hold(posixpath.basename(name) or None, raw, archive_type="ooxml", archive_filename=name)
    runs = []
    for name, raw in parts.items():
        if re.match(r"(word/document|ppt/slides/slide\d+|xl/sharedStrings)\.xml$", name) and (root := parsed(raw)) is not None:
            runs += [e.text for e in root.iter() if e.tag.rpartition("}")[2] == "t" and e.text]
    if runs:
        out.hold("document_text.txt", " ".join(runs).encode(), "text/plain")
    values = {}
    for name in ("docProps/core.xml", "docProps/app.xml"):
        root = parsed(parts[name]) if name in parts else None
        values |= {e.tag.rpartition("}")[2]: e.text.strip() for e in (root if root is not None else ()) if e.text and e.text.strip()}
    if values:
        out.tell("metadata", "\n".join(f"{k}: {v}" for k, v in values.items()), label="metadata", verbosity=1, data=values)
    template = values.get("Template", "")
    if template.lower().startswith(("http", "\\\\", "//")):
        out.tell("remote_template_meta", f"The document's properties name a remote template: {template}", 0, label="remote_template")
    return out


def _macros(out: Outcome, name: str, raw: bytes) -> None:
    import struct

    from siftwood.functions import compound, vba

    try:
        found = compound.entries(raw)
    except (ValueError, struct.error):
        return
    vba.document_macros(out, found, f"{name}_")


def security_relevant(name: str) -> bool:
    """Parts that can hold links, code or objects."""
    return name.endswith((".rels", "vbaProject.bin", ".xml")) or any(d in name for d in SECURITY_FOLDERS)


def noise(name: str) -> bool:
    """Parts that are structure, looks or media only; folders too."""
    return name.endswith("/") or name.startswith(NOISE)


def relationships_part(file: File) -> Outcome:
    """A relationship part by itself: its links to the outside."""
    out = Outcome()
    root = parsed(file.content)
    if root is None:
        out.tell("parse_error", "The relationships could not be read as XML", 1, label="error")
        return out
    n = 0
    for k, rel in enumerate(root):
        if rel.get("TargetMode") == "External":
            n += 1
            kind = rel.get("Type", "")
            words, level = external(kind, rel.get("Target", ""))
            out.tell(f"external_link_{k}", words, level, label="remote_template" if "attachedTemplate" in kind else "external_link")
    out.info = f"{n} external relationship(s)" if n else "No external relationships"
    return out


def document_part(file: File) -> Outcome:
    """An XML part of an office package by itself."""
    out = Outcome("XML part of an office package")
    _content(out, file.filename or "part.xml", file.content)
    return out


def _types(out: Outcome, parts: dict[str, bytes], filename: str) -> None:
    raw = parts.get("[Content_Types].xml")
    root = parsed(raw) if raw else None
    if raw and (b"<!DOCTYPE" in raw or b"<!ENTITY" in raw):
        out.tell("content_types_xxe", "[Content_Types].xml declares a document type or entities, which may be XXE or an XML bomb", 0)
    if root is None:
        return
    told, extensions = defaultdict(list), set()
    for e in root:
        if e.tag.endswith("Override"):
            told[e.get("PartName", "")].append(e.get("ContentType", ""))
        elif e.tag.endswith("Default"):
            extensions.add(e.get("Extension", "").lower())
    every = [e.get("ContentType", "") for e in root]
    if any("vbaProject" in t or "macroenabled" in t.lower() for t in every) and filename.endswith(NO_MACROS):
        out.tell("content_type_mismatch", f"Parts with macros in a file whose name says that it has none ({filename}); it may have been renamed", 0)
    phantom = [p for p in told if p.lstrip("/") not in parts]
    if phantom:
        out.tell("phantom_content_parts", f"Types are declared for parts that are not there: {', '.join(phantom[:10])}", 2)
    stated = {p.lstrip("/") for p in told}
    silent = [n for n in parts if not n.endswith(("/", ".rels")) and n != "[Content_Types].xml" and n not in stated and n.rpartition(".")[2].lower() not in extensions]
    if silent:
        out.tell("undeclared_parts", f"Parts without a declared type: {', '.join(silent[:10])}", 2)
    torn = {p: t for p, t in told.items() if len(set(t)) > 1}
    if torn:
        out.tell("content_type_conflict", "Parts with several types: " + "; ".join(f"{p}: {', '.join(t)}" for p, t in torn.items()), 1)
    odd = [f"{p}: {t}" for p, ts in told.items() for t in ts if not t.startswith(TYPE_PREFIXES)]
    if odd:
        out.tell("unusual_content_type", f"Types that are not usual here: {'; '.join(odd[:10])}", 3)


def _relations(out: Outcome, parts: dict[str, bytes]) -> set[str]:
    """All parts that relationships name."""
    targets, kinds = set(), set()
    for path, raw in parts.items():
        root = parsed(raw) if path.endswith(".rels") else None
        for rel in root if root is not None else ():
            target, kind = rel.get("Target", ""), rel.get("Type", "")
            kinds.add(kind)
            if rel.get("TargetMode") == "External":
                words, level = external(kind, target)
                out.tell(f"ext_rel_{path}_{rel.get('Id', '')}", words, level, label="remote_template" if "attachedTemplate" in kind else "")
            elif target:
                folder = posixpath.dirname(posixpath.dirname(path))
                targets.add(target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
    missing = sorted(t for t in targets if t not in parts)
    if missing:
        out.tell("dangling_references", f"Relationships name parts that are not there: {', '.join(missing[:10])}", 2)
    odd = sorted(k for k in kinds if k and not k.startswith(RELATION_PREFIXES))
    if odd:
        out.tell("nonstandard_rel_type", f"Relationships of unusual kinds: {'; '.join(odd[:10])}", 3)
    return targets


def _content(out: Outcome, name: str, raw: bytes) -> None:
    text = raw.decode("utf-8", "ignore")
    entities = 0
    for k, line in enumerate(text.splitlines(), 1):
        shown = line.strip()[:120]
        if "<!ENTITY" in line:
            entities += 1
            out.tell(f"xxe_{name}_{k}", f"An entity is declared in {name}, line {k}: {shown}", 0)
        if "<!DOCTYPE" in line:
            out.tell(f"doctype_{name}_{k}", f"{name} declares a document type, which these packages do not need", 1)
        field_ = re.search(r"(?i)\b(DDEAUTO|DDE)\b", line)
        if field_:
            out.tell(f"dde_{name}_{k}", f"{'A DDE field that runs by itself' if len(field_[1]) > 3 else 'A DDE field'} in {name}, line {k}: {shown}", 0)
    if entities > 3:
        out.tell(f"xml_bomb_{name}", f"{name} defines {entities} entities, which may be an XML bomb", 0)
    root = None if entities else parsed(raw)
    if root is not None:
        for tag, words in (("subDoc", "Sub-document inclusion"), ("control", "ActiveX Control")):
            if root.find(f".//{WORD}{tag}") is not None:
                out.tell(f"tag_{name}_w:{tag}", f"Suspicious tag 'w:{tag}' ({words}) found in {name}.", 1)
        depth = xml_depth(root)
        if depth > 50:
            out.tell(f"deep_nesting_{name}", f"Elements in {name} are nested {depth} deep", 2)
        alternatives = len(root.findall(f".//{COMPATIBILITY}AlternateContent"))
        if alternatives > 10:
            out.tell(f"mc_heavy_{name}", f"{name} has {alternatives} alternatives of content, which may hide some", 2)
    custom = "customXml" in name
    blob = re.search(r"[A-Za-z0-9+/=]{%d,}" % (50 if custom else 500), text)
    if blob and custom:
        out.tell(f"customxml_payload_{name}", f"{name} holds what may be an encoded payload: {blob[0][:75]}...", 1)
    elif blob:
        out.tell(f"large_blob_{name}", f"{name} holds {len(blob[0])} characters that look like base64: {blob[0][:75]}...", 2)
    for url in re.findall(r'(?:href|Target)\s*=\s*"([^"]+)"', text):
        proto = next((p for p in PROTOCOLS if url.lower().startswith(p)), None)
        if proto:
            out.tell(f"hyperlink_abuse_{name}_{proto}", f"A link by {proto} ({PROTOCOLS[proto]}): {url[:200]}", 0)
        if url.lower().startswith("file://") and "!" in url:
            out.tell(f"monikerlink_{name}", f"A file link with an exclamation mark, as used for CVE-2024-21413: {url[:200]}", 0)
