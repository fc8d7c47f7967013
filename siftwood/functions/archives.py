"""7z and RAR archives, read by their published layouts; no wheel and no program is needed.

7z members are unpacked where their coders are in the standard library (copy, LZMA, LZMA2, delta, branch filters,
deflate, bzip2).  RAR members are listed, and those stored without compression are unpacked; the others need unrar,
which the outcome tells.  Encrypted members of either are listed as such.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from dataclasses import dataclass

from siftwood.functions.formats import File, Outcome


@dataclass(frozen=True)
class Member:
    name: str
    size: int
    encrypted: bool
    folder: bool
    content: bytes | None  # None: not unpacked


class Unreadable(ValueError):
    pass


# --- 7z -----------------------------------------------------------------------------------------------------------

SEVEN_ZIP = b"7z\xbc\xaf\x27\x1c"
RAR_4, RAR_5 = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"

# Coder ids.
COPY, LZMA, LZMA2, DELTA = b"\x00", b"\x03\x01\x01", b"\x21", b"\x03"
DEFLATE, BZIP2, AES = b"\x04\x01\x08", b"\x04\x02\x02", b"\x06\xf1\x07\x01"
BRANCHES = {
    b"\x03\x03\x01\x03": lzma.FILTER_X86,
    b"\x04": lzma.FILTER_X86,
    b"\x03\x03\x02\x05": lzma.FILTER_POWERPC,
    b"\x03\x03\x04\x01": lzma.FILTER_IA64,
    b"\x03\x03\x05\x01": lzma.FILTER_ARM,
    b"\x03\x03\x07\x01": lzma.FILTER_ARMTHUMB,
    b"\x03\x03\x08\x05": lzma.FILTER_SPARC,
}


class _Reader:
    """Numbers and fields of a header, in order."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise Unreadable("header ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The count of leading ones tells how many bytes follow, lowest first; the rest of the first byte is the top."""
        first, value = self.byte(), 0
        for k in range(8):
            if not first & (0x80 >> k):
                return value | (first & ((0x80 >> k) - 1)) << (8 * k)
            value |= self.byte() << (8 * k)
        return value

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[k // 8] & (0x80 >> k % 8)) for k in range(n)]

    def some(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


@dataclass
class _Folder:
    coders: list[tuple[bytes, bytes]]  # (id, properties), the first is the last to be applied when packing
    sizes: list[int]
    packed: int
    simple: bool

    @property
    def encrypted(self) -> bool:
        return any(kind == AES for kind, _ in self.coders)


def _filter_of(kind: bytes, properties: bytes) -> dict | None:
    if kind == LZMA and len(properties) >= 5:
        rest, lc = divmod(properties[0], 9)
        pb, lp = divmod(rest, 5)
        return {"id": lzma.FILTER_LZMA1, "dict_size": struct.unpack_from("<I", properties, 1)[0], "lc": lc, "lp": lp, "pb": pb}
    if kind == LZMA2 and properties:
        bits = properties[0] & 0x3F
        return {"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if bits >= 40 else (2 | bits & 1) << (bits // 2 + 11)}
    if kind == DELTA and properties:
        return {"id": lzma.FILTER_DELTA, "dist": properties[0] + 1}
    if kind in BRANCHES:
        return {"id": BRANCHES[kind]}
    return None


def _unpack(folder: _Folder, raw: bytes) -> bytes:
    """A folder's bytes; its size is known, so nothing larger is ever made."""
    if not folder.simple:
        raise Unreadable("several packed streams in one folder")
    for (kind, properties), size in reversed(list(zip(folder.coders, folder.sizes))):
        if kind == COPY:
            out = raw
        elif kind == DEFLATE:
            out = zlib.decompressobj(-15).decompress(raw, size or 1)
        elif kind == BZIP2:
            out = bz2.BZ2Decompressor().decompress(raw, size or 1)
        else:
            form = _filter_of(kind, properties)
            if form is None:
                raise Unreadable("an unknown coder")
            if form["id"] in (lzma.FILTER_LZMA1, lzma.FILTER_LZMA2):
                out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[form]).decompress(raw, size or 1)
            else:  # filters alone are no stream of their own: their input goes in as LZMA2 chunks that are not compressed
                wrapped = b"".join(bytes([1 if not k else 2]) + struct.pack(">H", len(raw[k : k + 65536]) - 1) + raw[k : k + 65536] for k in range(0, len(raw), 65536)) + b"\0"
                out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[form, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16}]).decompress(wrapped, size or 1)
        raw = out[:size]
    return raw


def _streams(r: _Reader) -> tuple[int, list[int], list[_Folder], list[int], list[list[int]]]:
    """(position, packed sizes, folders, files in each, their sizes) of a streams block."""
    position, packed, folders, counts, sizes = 0, [], [], None, None
    while True:
        kind = r.byte()
        if kind == 0x00:
            break
        if kind == 0x06:
            position, n = r.number(), r.number()
            while (inner := r.byte()) != 0x00:
                if inner == 0x09:
                    packed = [r.number() for _ in range(n)]
                elif inner == 0x0A:
                    r.take(4 * sum(r.some(n)))
                else:
                    raise Unreadable("packed streams")
        elif kind == 0x07:
            if r.byte() != 0x0B:
                raise Unreadable("folders")
            n = r.number()
            if r.byte() or n > len(r.raw):
                raise Unreadable("folders elsewhere")
            folders = [_folder(r) for _ in range(n)]
            while (inner := r.byte()) != 0x00:
                if inner == 0x0C:
                    for f in folders:
                        f.sizes = [r.number() for _ in f.coders]
                elif inner == 0x0A:
                    r.take(4 * sum(r.some(n)))
                else:
                    raise Unreadable("folders")
        elif kind == 0x08:
            counts = [1] * len(folders)
            inner = r.byte()
            if inner == 0x0D:
                counts, inner = [r.number() for _ in folders], r.byte()
            sizes = []
            for f, n in zip(folders, counts):
                own = [r.number() for _ in range(n - 1)] if inner == 0x09 and n else []
                sizes.append([*own, _whole(f) - sum(own)] if n else [])
            inner = r.byte() if inner == 0x09 else inner
            while inner != 0x00:  # checksums, which are not needed here
                if inner != 0x0A:
                    raise Unreadable("files of a folder")
                unknown = sum(counts)
                r.take(4 * sum(r.some(unknown)))
                inner = r.byte()
        else:
            raise Unreadable("streams")
    counts = counts or [1] * len(folders)
    return position, packed, folders, counts, sizes or [[_whole(f)] for f in folders]


def _whole(f: _Folder) -> int:
    return f.sizes[0] if f.sizes else 0


def _folder(r: _Reader) -> _Folder:
    coders, ins, outs = [], 0, 0
    for _ in range(r.number()):
        flags = r.byte()
        kind = r.take(flags & 0x0F)
        n_in, n_out = (r.number(), r.number()) if flags & 0x10 else (1, 1)
        coders.append((kind, r.take(r.number()) if flags & 0x20 else b""))
        ins, outs = ins + n_in, outs + n_out
    bonds = [(r.number(), r.number()) for _ in range(outs - 1)]
    packed = ins - len(bonds)
    if packed > 1:
        for _ in range(packed):
            r.number()
    chained = bonds == [(k, k + 1) for k in range(len(bonds))]
    return _Folder(coders, [], packed, packed == 1 and ins == outs == len(coders) and chained)


def seven_zip_members(raw: bytes, max_ratio: int, max_size: int) -> list[Member]:
    """All members; raises Unreadable for damaged files and OverflowError for bombs, before anything is unpacked."""
    if raw[:6] != SEVEN_ZIP or len(raw) < 32:
        raise Unreadable("no 7z archive")
    offset, size = struct.unpack_from("<QQ", raw, 12)
    r = _Reader(raw[32 + offset : 32 + offset + size])
    if not size:
        return []
    kind = r.byte()
    while kind == 0x17:  # the header itself is packed
        position, packed, folders, _, _ = _streams(r)
        if len(folders) != 1 or folders[0].encrypted:
            raise PermissionError("encrypted header")
        if _whole(folders[0]) > max(max_ratio * len(raw), 1 << 20):
            raise OverflowError("header")
        at = 32 + position
        r = _Reader(_unpack(folders[0], raw[at : at + packed[0]]))
        kind = r.byte()
    if kind != 0x01:
        raise Unreadable("no header")
    position, packed, folders, counts, sizes = 0, [], [], [], []
    names, empty, folder_marks, n = [], [], [], 0
    while (kind := r.byte()) != 0x00:
        if kind == 0x04:
            position, packed, folders, counts, sizes = _streams(r)
        elif kind == 0x05:
            n = r.number()
            while (inner := r.byte()) != 0x00:
                body = _Reader(r.take(r.number()))
                if inner == 0x0E:
                    empty = body.bits(n)
                elif inner == 0x0F:
                    folder_marks = body.bits(sum(empty))
                elif inner == 0x11:
                    if body.byte():
                        raise Unreadable("names elsewhere")
                    names = body.raw[1:].decode("utf-16-le", "replace").split("\0")[:n]
        elif kind == 0x02:
            while r.byte() != 0x00:
                r.take(r.number())
        else:
            raise Unreadable("header")
    total = sum(map(sum, sizes))
    if raw and total / len(raw) > max_ratio:
        raise OverflowError("compression ratio too high")
    if total > max_size:
        raise OverflowError("total uncompressed size is too large")
    at, units = 32 + position, []
    packs = iter(packed)
    for f, own in zip(folders, sizes):
        mine = [next(packs, 0) for _ in range(f.packed)]
        try:
            body = None if f.encrypted else _unpack(f, raw[at : at + mine[0]])
        except (Unreadable, lzma.LZMAError, zlib.error, OSError, EOFError):
            body = None
        at += sum(mine)
        begin = 0
        for size in own:
            units.append((size, f.encrypted, body[begin : begin + size] if body is not None and len(body) >= begin + size else None))
            begin += size
    empty = empty or [False] * n
    folder_marks, units = iter(folder_marks), iter(units)
    out = []
    for name, nothing in zip([*names, *[""] * (n - len(names))], empty):
        if nothing:
            # an entry without a stream is a folder unless it is marked as an empty file
            out.append(Member(name, 0, False, not next(folder_marks, False), b""))
        else:
            size, locked, content = next(units, (0, False, None))
            out.append(Member(name, size, locked, False, content))
    return out


def seven_zip(file: File) -> Outcome:
    out = Outcome()
    try:
        members = seven_zip_members(file.content, file.max_ratio, file.max_size)
    except OverflowError as error:
        out.tell("error", f"7z bomb detected: {error}.", label="error")
        return out
    except PermissionError:
        out.tell("encrypted", "7z archive is password protected, with its list of files", 3, label="encryption")
        return out
    except Unreadable as error:
        out.tell("error", f"Bad 7z file: {error}.", label="error")
        return out
    out.info = f"{len(members)} compressed file(s)"
    out.tell("summary", "\n".join(f"{m.name}{' <encrypted>' if m.encrypted else ''} [{m.size}]" for m in members))
    _hold(out, members, "7z")
    return out


def _hold(out: Outcome, members: list[Member], kind: str) -> None:
    if any(m.encrypted for m in members):
        out.tell("encrypted", f"{kind} archive is password protected", 3, label="encryption")
    left = [m.name for m in members if m.content is None and not m.encrypted and not m.folder]
    if left:
        out.tell("not_unpacked", "\n".join(left), 3, short=f"{len(left)} member(s) listed but not unpacked here", label="not_unpacked")
    seen = set()
    for m in members:
        if not m.folder and m.content is not None and (m.name, m.size) not in seen:
            seen.add((m.name, m.size))
            out.hold(m.name, m.content, archive_type=kind.lower(), archive_filename=m.name)


# --- RAR ----------------------------------------------------------------------------------------------------------


def _vint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(raw) and shift < 70:
        value |= (raw[at] & 0x7F) << shift
        shift += 7
        at += 1
        if not raw[at - 1] & 0x80:
            return value, at
    raise Unreadable("header ends early")


def _rar_5(raw: bytes) -> list[Member]:
    out, at = [], 8
    while at + 7 <= len(raw):
        size, begin = _vint(raw, at + 4)
        end = begin + size
        kind, p = _vint(raw, begin)
        flags, p = _vint(raw, p)
        extra, p = _vint(raw, p) if flags & 1 else (0, p)
        data, p = _vint(raw, p) if flags & 2 else (0, p)
        if kind == 4:
            raise PermissionError("encrypted headers")
        if kind == 5:
            break
        if kind == 2:
            own, p = _vint(raw, p)
            unpacked, p = _vint(raw, p)
            _, p = _vint(raw, p)  # attributes
            p += 4 * bool(own & 2) + 4 * bool(own & 4)
            method, p = _vint(raw, p)
            _, p = _vint(raw, p)  # system
            length, p = _vint(raw, p)
            name = raw[p : p + length].decode("utf-8", "replace")
            locked, q = False, end - extra
            while q < end:
                n, q = _vint(raw, q)
                mark, _ = _vint(raw, q)
                locked |= mark == 1
                q += n
            stored = not method >> 7 & 7 and not locked and not flags & 0x18
            out.append(Member(name, unpacked, locked, bool(own & 1), raw[end : end + data] if stored and data == unpacked else None))
        at = end + data
    return out


def _rar_4(raw: bytes) -> list[Member]:
    out, at = [], 7
    while at + 7 <= len(raw):
        _, kind, flags, size = struct.unpack_from("<HBHH", raw, at)
        data = struct.unpack_from("<I", raw, at + 7)[0] if flags & 0x8000 and at + 11 <= len(raw) else 0
        if kind == 0x73 and flags & 0x80:
            raise PermissionError("encrypted headers")
        if kind == 0x7B or size < 7:
            break
        if kind == 0x74:
            if at + 32 > len(raw):
                raise Unreadable("header ends early")
            unpacked, _, _, _, _, method, length, attributes = struct.unpack_from("<IBIIBBHI", raw, at + 11)
            p = at + 32
            if flags & 0x100:
                high_packed, high = struct.unpack_from("<II", raw, p)
                data, unpacked, p = data | high_packed << 32, unpacked | high << 32, p + 8
            name = raw[p : p + length].split(b"\0")[0].decode("utf-8" if flags & 0x200 else "cp437", "replace")
            folder = flags & 0xE0 == 0xE0
            locked = bool(flags & 4)
            body = raw[at + size : at + size + data]
            out.append(Member(name, unpacked, locked, folder, body if method == 0x30 and not locked and data == unpacked and not flags & 3 else None))
        at += size + data
    return out


def rar_members(raw: bytes) -> list[Member]:
    if raw[:8] == RAR_5:
        return _rar_5(raw)
    if raw[:7] == RAR_4:
        return _rar_4(raw)
    raise Unreadable("not a RAR file")


def rar(file: File) -> Outcome:
    out = Outcome()
    try:
        members = rar_members(file.content)
    except PermissionError:
        out.tell("encrypted", "RAR archive is password protected, with its list of files", 3, label="encryption")
        return out
    except (Unreadable, struct.error) as error:
        out.tell("error", f"Bad RAR file: {error}.", label="error")
        return out
    out.info = f"{len(members)} compressed file(s)"
    out.tell("summary", "\n".join(f"{m.name}{' <encrypted>' if m.encrypted else ''} [{m.size}]" for m in members))
    total = sum(m.size for m in members)
    bomb = "compression ratio too high" if file.content and total / len(file.content) > file.max_ratio else "total uncompressed size is too large" if total > file.max_size else None
    if bomb:
        out.tell("error", f"RAR bomb detected: {bomb}.", 1, label="error")
        return out
    _hold(out, members, "RAR")
    return out
