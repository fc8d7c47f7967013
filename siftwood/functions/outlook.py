"""Outlook messages: a compound file whose streams are properties, by the published layout.

Plain Python on one file's bytes, for use inside Arrow workers.
"""

from __future__ import annotations

import email
import email.policy
import re
import struct
from datetime import datetime, timedelta, timezone

from siftwood.functions import mail
from siftwood.functions.compound import Entry, entries
from siftwood.functions.formats import File, Outcome

# Property numbers.
SUBJECT, SENDER_NAME, SENDER_ADDRESS, SENDER_SMTP = 0x0037, 0x0C1A, 0x0C1F, 0x5D01
HEADERS, MESSAGE_ID, BODY, HTML = 0x007D, 0x1035, 0x1000, 0x1013
SENT_AT, DELIVERED_AT, CODE_PAGE = 0x0039, 0x0E06, 0x3FFD
SHOWN_TO, SHOWN_CC = 0x0E04, 0x0E03
ATTACHED, LONG_NAME, SHORT_NAME, ATTACHED_MIME, RECIPIENT_NAME, RECIPIENT_ADDRESS, RECIPIENT_SMTP, RECIPIENT_KIND = 0x3701, 0x3707, 0x3704, 0x370E, 0x3001, 0x3003, 0x39FE, 0x0C15

STREAM = re.compile(r"__substg1\.0_([0-9A-F]{4})([0-9A-F]{4})$", re.I)


class Properties:
    """The properties of one storage: those in streams of their own, and the short ones in the common stream."""

    def __init__(self, found: list[Entry], path: tuple[str, ...], head: int):
        self.streams: dict[int, tuple[int, bytes]] = {}
        self.short: dict[int, tuple[int, bytes]] = {}
        for e in found:
            if e.kind != "stream" or e.path[:-1] != path:
                continue
            m = STREAM.match(e.path[-1])
            if m:
                self.streams[int(m[1], 16)] = (int(m[2], 16), e.content)
            elif e.path[-1] == "__properties_version1.0":
                for at in range(head, len(e.content) - 15, 16):
                    kind, number = struct.unpack_from("<HH", e.content, at)
                    self.short[number] = (kind, e.content[at + 8 : at + 16])
        self.page = "cp1252"
        number = self.integer(CODE_PAGE)
        if number:
            page = {65001: "utf-8", 20127: "ascii", 28591: "latin-1"}.get(number, f"cp{number}")
            try:
                "".encode(page)
                self.page = page
            except LookupError:
                pass

    def text(self, number: int) -> str:
        kind, raw = self.streams.get(number, (0, b""))
        if kind == 0x001F:
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        return raw.decode(self.page, "replace").rstrip("\0") if kind == 0x001E else ""

    def binary(self, number: int) -> bytes:
        kind, raw = self.streams.get(number, (0, b""))
        return raw if kind == 0x0102 else self.text(number).encode() if kind else b""

    def integer(self, number: int) -> int | None:
        kind, raw = self.short.get(number, (0, b""))
        return struct.unpack_from("<i", raw)[0] if kind == 0x0003 else None

    def moment(self, number: int) -> datetime | None:
        kind, raw = self.short.get(number, (0, b""))
        ticks = struct.unpack("<Q", raw)[0] if kind == 0x0040 else 0
        return datetime(1601, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=ticks // 10) if 0 < ticks < 1 << 62 else None


def _people(found: list[Entry], path: tuple[str, ...], kind: int) -> list[str]:
    out = []
    for storage in sorted({e.path for e in found if e.kind == "storage" and e.path[:-1] == path and e.path[-1].startswith("__recip_version1.0_")}):
        p = Properties(found, storage, 8)
        if (p.integer(RECIPIENT_KIND) or 1) == kind:
            name, address = p.text(RECIPIENT_NAME), p.text(RECIPIENT_SMTP) or p.text(RECIPIENT_ADDRESS)
            out.append(f"{name} <{address}>" if name and address and name != address else address or name)
    return [x for x in out if x]


def _sender(p: Properties) -> str:
    name, address = p.text(SENDER_NAME), p.text(SENDER_SMTP) or p.text(SENDER_ADDRESS)
    return f"{name} <{address}>" if name and address and name != address else address or name


def _as_mail(found: list[Entry], path: tuple[str, ...]) -> bytes:
    """An attached message as a message file: its headers, or what stands for them, and its bodies and attachments."""
    p = Properties(found, path, 24)
    message = email.message.EmailMessage(policy=email.policy.SMTP.clone(raise_on_defect=False))
    sent = p.moment(SENT_AT) or p.moment(DELIVERED_AT)
    for name, value in (("From", _sender(p)), ("To", "; ".join(_people(found, path, 1)) or p.text(SHOWN_TO)), ("Subject", p.text(SUBJECT)), ("Date", email.utils.format_datetime(sent) if sent else ""), ("Message-ID", p.text(MESSAGE_ID))):
        if value:
            message[name] = re.sub(r"[\r\n]+", " ", value)
    message.set_content(p.text(BODY))
    if p.binary(HTML):
        message.add_alternative(p.binary(HTML).decode("utf-8", "replace"), subtype="html")
    for name, raw, mime in _attachments(found, path):
        main, _, sub = (mime or "application/octet-stream").partition("/")
        message.add_attachment(raw, maintype=main or "application", subtype=sub or "octet-stream", filename=name or "attachment")
    return message.as_bytes()


def _attachments(found: list[Entry], path: tuple[str, ...]) -> list[tuple[str | None, bytes, str | None]]:
    out = []
    for storage in sorted({e.path for e in found if e.kind == "storage" and e.path[:-1] == path and e.path[-1].startswith("__attach_version1.0_")}):
        p = Properties(found, storage, 8)
        name = p.text(LONG_NAME) or p.text(SHORT_NAME) or None
        inner = (*storage, f"__substg1.0_{ATTACHED:04X}000D")
        if any(e.path == inner and e.kind == "storage" for e in found):
            out.append((name or "message.eml", _as_mail(found, inner), "message/rfc822"))
        else:
            out.append((name, p.binary(ATTACHED), p.text(ATTACHED_MIME) or None))
    return out


def outlook_message(file: File) -> Outcome:
    """Summary, the way and the authentication that its transport headers tell, bodies and attachments."""
    out = Outcome()
    try:
        found = entries(file.content)
    except (ValueError, struct.error) as error:
        out.tell("error", f"MSG: {error}", label="error")
        return out
    p = Properties(found, (), 32)
    if not p.streams:
        out.tell("error", "MSG: a compound file without message properties", label="error")
        return out
    headers = email.message_from_string(p.text(HEADERS)) if p.text(HEADERS) else None
    raw = lambda name: [str(v) for v in headers.get_all(name) or []] if headers else []
    sender = _sender(p) or next(iter(raw("From")), "")
    to = "; ".join(_people(found, (), 1)) or p.text(SHOWN_TO)
    sent = p.moment(SENT_AT) or p.moment(DELIVERED_AT)
    date = raw("Date")[0] if raw("Date") else sent.isoformat() if sent else ""
    out.info = p.text(SUBJECT)
    lines = [("From", sender), ("To", to), ("CC", "; ".join(_people(found, (), 2)) or p.text(SHOWN_CC)), ("Date", date), ("Subject", p.text(SUBJECT)), ("Msg-ID", p.text(MESSAGE_ID))]
    out.tell("summary", "\n".join(f"{k}: {v}" for k, v in lines if v), label="summary", order=1)
    when = sent or (mail.parse_date(raw("Date")[0]) if raw("Date") else None)
    if when:
        out.tell("email_date", date, label="date", order=2, data={"timestamp": when.isoformat()})
    for k, line in enumerate(raw("Received")):
        hop = mail.parse_received(line)
        if hop:
            out.hops.append(hop | {"pos": k})
    out.gateways = mail.gateway_findings(raw)
    if out.gateways:
        out.tell("gateway_headers", "\n".join(g["label"] for g in out.gateways), short=f"{len(out.gateways)} gateway header(s)", label="gateway", verbosity=2)
    out.reports += mail.auth_reports(raw("Authentication-Results"), raw("ARC-Authentication-Results"), [sender])
    if p.text(BODY):
        out.hold("email_body.txt", p.text(BODY).encode(), "text/plain")
    if p.binary(HTML):
        out.hold("email_body.html", p.binary(HTML), "text/html")
    for name, content, mime in _attachments(found, ()):
        if content:
            out.hold(name, content, mime)
    return out
