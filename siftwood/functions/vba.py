"""Macro projects: modules out of their compressed streams, and a scan of their source by words.

Plain Python on one file's bytes, by the published layout of macro projects; for use inside Arrow workers.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from siftwood.functions.compound import Entry, entries
from siftwood.functions.formats import File, Outcome

# Procedures that run by themselves, words that tell what a macro reaches for, names of dropped files.
AUTO_RUN = (
    "AutoExec", "AutoOpen", "Auto_Open", "AutoClose", "Auto_Close", "AutoExit", "AutoNew", "DocumentOpen", "Document_Open",
    "Document_Close", "Document_BeforeClose", "DocumentBeforeClose", "DocumentChange", "Document_New", "NewDocument",
    "Workbook_Open", "WorkbookOpen", "Workbook_Activate", "Workbook_Close", "Workbook_BeforeClose", "Worksheet_Change",
    "Presentation_Open", "UserForm_Initialize",
)
SUSPICIOUS = {
    "Shell": "May run an executable file or a system command",
    "WScript.Shell": "May run an executable file or a system command",
    "Shell.Application": "May run an application",
    "ShellExecute": "May run an executable file or a system command",
    "vbHide": "May run something in a hidden window",
    "PowerShell": "May run PowerShell commands",
    "CreateObject": "May create an OLE object",
    "GetObject": "May get an OLE object with a running instance",
    "CallByName": "May call a procedure by a name made at run time",
    "Environ": "May read system environment variables",
    "Open": "May open a file",
    "Binary": "May read or write a binary file",
    "Kill": "May delete a file",
    "FileCopy": "May copy a file",
    "CreateTextFile": "May create a text file",
    "ADODB.Stream": "May create a binary file",
    "SaveToFile": "May write a file",
    "Scripting.FileSystemObject": "May read or write files",
    "URLDownloadToFileA": "May download files from the Internet",
    "URLDownloadToFile": "May download files from the Internet",
    "Microsoft.XMLHTTP": "May download files from the Internet",
    "MSXML2.XMLHTTP": "May download files from the Internet",
    "WinHttp.WinHttpRequest": "May download files from the Internet",
    "RegRead": "May read registry keys",
    "RegWrite": "May write registry keys",
    "Lib": "May run code from a DLL",
    "VirtualAlloc": "May inject code into memory",
    "RtlMoveMemory": "May inject code into memory",
    "CreateThread": "May inject code into another process",
    "Chr": "May attempt to obfuscate strings",
    "ChrW": "May attempt to obfuscate strings",
    "StrReverse": "May attempt to obfuscate strings",
    "Xor": "May attempt to obfuscate strings",
    "SendKeys": "May control another application by simulating keys",
    "AppActivate": "May control another application",
    "VBProject": "May modify macro code",
    "DisableUnsafeFactorySettings": "May weaken security settings",
}
DROPPED = r"\b[\w.-]{1,64}\.(?:exe|dll|scr|bat|cmd|ps1|vbs|js|jse|hta|pif|msi|jar)\b"
SEVERITIES = {"AutoExec": 1, "Suspicious": 0, "IOC": 1, "Hex String": 1, "Base64 String": 1}

_CODE_PAGES = {65001: "utf-8", 10000: "mac_roman", 932: "cp932", 936: "gbk", 949: "cp949", 950: "big5"}


@dataclass(frozen=True)
class Module:
    name: str
    code: str


def decompress(raw: bytes, most: int = 1 << 26) -> bytes:
    """A compressed container: chunks of literals and back references within the chunk; ends at damage or at most bytes."""
    if raw[:1] != b"\x01":
        raise ValueError("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(raw) and len(out) < most:
        header = struct.unpack_from("<H", raw, at)[0]
        end, at, begin = min(len(raw), at + (header & 0xFFF) + 3), at + 2, len(out)
        if not header >> 15:
            out += raw[at:end]
        while header >> 15 and at < end:
            flags, at = raw[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(raw[at])
                    at += 1
                    continue
                if at + 2 > end:
                    return bytes(out)
                token, at = struct.unpack_from("<H", raw, at)[0], at + 2
                width = max(4, (len(out) - begin - 1).bit_length())
                back = (token >> (16 - width)) + 1
                if back > len(out) - begin:
                    return bytes(out)
                for _ in range((token & (0xFFFF >> width)) + 3):
                    out.append(out[-back])
        at = end
    return bytes(out)


def modules(found: list[Entry]) -> list[Module]:
    """Every module of every macro project in a compound file, with its source."""
    by_path = {e.path: e.content for e in found if e.kind == "stream"}
    out = []
    for path, raw in by_path.items():
        if path[-1].lower() != "dir" or len(path) < 2 or path[-2].lower() != "vba":
            continue
        try:
            records = decompress(raw)
        except ValueError:
            continue
        page, name, stream, offset, at = "cp1252", "", "", None, 0
        while at + 6 <= len(records):
            kind, size = struct.unpack_from("<HI", records, at)
            size += 2 * (kind == 0x0009)  # the version's stated size leaves out its minor part
            data, at = records[at + 6 : at + 6 + size], at + 6 + size
            if kind == 0x0003 and len(data) == 2:
                number = struct.unpack("<H", data)[0]
                page = _CODE_PAGES.get(number, f"cp{number}")
            elif kind == 0x0019:
                name = data.decode(page, "replace")
            elif kind == 0x001A:
                stream = data.decode(page, "replace")
            elif kind == 0x0031 and len(data) == 4:
                offset = struct.unpack("<I", data)[0]
            elif kind == 0x002B and offset is not None:
                body = next((c for p, c in by_path.items() if p[:-1] == path[:-1] and p[-1].lower() == (stream or name).lower()), b"")
                try:
                    code = decompress(body[offset:]).decode(page, "replace").strip()
                except ValueError:
                    code = ""
                if code:
                    out.append(Module(name or stream, code))
                name, stream, offset = "", "", None
    return out


def _known_page(found: list[Entry]) -> list[Module]:
    try:
        return modules(found)
    except LookupError:  # a code page that Python does not have
        return []


def scan(source: str) -> list[tuple[str, str, int]]:
    """(what was found, category, severity) of all modules' source together; each finding once."""
    found: dict[tuple[str, str], int] = {}

    def note(kind: str, words: str, what: str) -> None:
        found.setdefault((what, f"{kind}: {words}"), SEVERITIES[kind])

    for word in AUTO_RUN:
        if re.search(rf"(?i)\b{word}\b", source):
            note("AutoExec", "Runs by itself", word)
    for word, words in SUSPICIOUS.items():
        if re.search(rf"(?i)(?<!\w){re.escape(word)}(?!\w)", source):
            note("Suspicious", words, word)
    for m in re.finditer(r"(?i)\b(?:https?|ftp)://[^\s\"'<>)]+", source):
        note("IOC", "URL", m[0])
    for m in re.finditer(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", source):
        note("IOC", "IPv4 address", m[0])
    for m in re.finditer(f"(?i){DROPPED}", source):
        note("IOC", "Executable file name", m[0])
    for text in re.findall(r'"([^"\n]*)"', source):
        if re.fullmatch(r"(?:[0-9A-Fa-f]{2}){5,}", text) and bytes.fromhex(text).isascii():
            note("Hex String", bytes.fromhex(text).decode(), text)
        elif re.fullmatch(r"(?:[A-Za-z0-9+/]{4}){5,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?", text) and re.search("[a-z]", text) and re.search("[A-Z0-9+/=]", text):
            import base64

            raw = base64.b64decode(text)
            if raw.isascii():
                note("Base64 String", raw.decode(), text)
    return [(what, category, level) for (what, category), level in found.items()]


def tell_modules(out: Outcome, found: list[Module], prefix: str = "") -> None:
    """Reports the source of each module, and what the scan of all of them finds, under the first one's name; the source
    is held as nested text, so that indicators in it are found."""
    for m in found:
        shown = m.code[:2000] + "..." if len(m.code) > 2000 else m.code
        out.tell(f"vba_source_{prefix}{m.name}", shown, short=f"VBA module: {m.name} ({len(m.code)} chars)", label=f"VBA:{m.name}")
    if found:
        for what, category, level in scan("\n".join(m.code for m in found)):
            out.tell(f"vba_suspicious_{found[0].name}_{category}_{what}", f"VBA module '{found[0].name}': {category} — {what}", level)
    for m in found:
        out.hold(f"vba_source_{m.name}.vba", m.code.encode(), "text/plain")


def macro_project(file: File) -> Outcome:
    """A file called vbaProject.bin."""
    out = Outcome("Contains VBA Macros")
    out.tell("macros_found", "VBA macros are present (vbaProject.bin)", 0, label="macros_found")
    try:
        tell_modules(out, _known_page(entries(file.content)))
    except (ValueError, struct.error):
        pass  # the finding above stands even where the project cannot be read
    return out


def document_macros(out: Outcome, found: list[Entry], prefix: str = "") -> None:
    """The modules of a compound file, reported by the document that holds it."""
    try:
        tell_modules(out, _known_page(found), prefix)
    except struct.error:
        pass
