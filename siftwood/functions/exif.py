"""Images by their published layouts: format, size, colour mode, EXIF fields and GPS; no wheel is needed."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

from siftwood.functions.formats import File, Outcome

# Names of fields by their numbers.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation",
    0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation",
    0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution",
    0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer",
    0x0213: "YCbCrPositioning", 0x4746: "Rating", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram",
    0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength",
    0x927C: "MakerNote", 0x9286: "UserComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject",
    0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA405: "FocalLengthIn35mmFilm",
    0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude",
    7: "GPSTimeStamp", 8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP", 12: "GPSSpeedRef", 13: "GPSSpeed", 14: "GPSTrackRef",
    15: "GPSTrack", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 27: "GPSProcessingMethod", 28: "GPSAreaInformation", 29: "GPSDateStamp",
}
EXIF_PLACE, GPS_PLACE = 0x8769, 0x8825
HIGHLIGHTS = {"Software": "Software", "Make": "Camera make", "Model": "Camera model", "DateTime": "DateTime", "DateTimeOriginal": "DateTimeOriginal", "DateTimeDigitized": "DateTimeDigitized"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


@dataclass
class Picture:
    format: str
    width: int
    height: int
    mode: str
    fields: dict[str, object] = field(default_factory=dict)
    gps: dict[str, object] = field(default_factory=dict)


def _directory(raw: bytes, at: int, order: str) -> dict[int, object]:
    """The entries of a directory: numbers alone or in lists, texts, bytes; damaged ones are left out."""
    out: dict[int, object] = {}
    if not 0 < at <= len(raw) - 2:
        return out
    for k in range(min(struct.unpack_from(order + "H", raw, at)[0], 1024)):
        here = at + 2 + 12 * k
        if here + 12 > len(raw):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", raw, here)
        size = SIZES.get(kind, 0) * n
        place = here + 8 if size <= 4 else struct.unpack_from(order + "I", raw, here + 8)[0]
        body = raw[place : place + size]
        if not size or len(body) < size:
            continue
        if kind == 2:
            out[tag] = body.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind == 7:
            out[tag] = body
        elif kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", body)
            numbers = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
            out[tag] = numbers[0] if n == 1 else numbers
        else:
            numbers = struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 6: 'b', 8: 'h', 9: 'i', 11: 'f', 12: 'd'}[kind]}", body)
            out[tag] = numbers[0] if n == 1 else list(numbers)
    return out


def tiff_fields(raw: bytes) -> tuple[dict[int, object], dict[int, object]]:
    """(fields of the first directory and its EXIF part, fields of its GPS part)."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None or len(raw) < 8:
        return {}, {}
    own = _directory(raw, struct.unpack_from(order + "I", raw, 4)[0], order)
    more, gps = own.pop(EXIF_PLACE, None), own.pop(GPS_PLACE, None)
    if isinstance(more, int):
        own |= {k: v for k, v in _directory(raw, more, order).items() if k not in own}
    return own, _directory(raw, gps, order) if isinstance(gps, int) else {}


def _named(found: dict[int, object], names: dict[int, str]) -> dict[str, object]:
    out = {}
    for tag, value in found.items():
        if isinstance(value, bytes) and 0x9C9B <= tag <= 0x9C9F:
            value = value.decode("utf-16-le", "replace").rstrip("\0")
        out[names.get(tag, f"Unknown({tag})")] = value
    return out


def _jpeg(raw: bytes) -> tuple[int, int, str, bytes] | None:
    at, size, tiff = 2, None, b""
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        kind = raw[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xDA:
            break
        length = struct.unpack_from(">H", raw, at + 2)[0]
        if kind == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            tiff = tiff or raw[at + 10 : at + 2 + length]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(raw):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            size = (width, height, {b"\x01": "L", b"\x04": "CMYK"}.get(raw[at + 9 : at + 10], "RGB"))
        at += 2 + length
    return (*size, tiff) if size else None


def _png(raw: bytes) -> tuple[int, int, str, bytes]:
    width, height = struct.unpack_from(">II", raw, 16)
    bits, colour = raw[24:26] if len(raw) >= 26 else (0, 0xFF)
    mode = {0: "1" if bits == 1 else "I;16" if bits == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(colour, "?")
    at, tiff = 8, b""
    while at + 8 <= len(raw):
        length, kind = struct.unpack_from(">I4s", raw, at)
        if kind == b"eXIf":
            tiff = raw[at + 8 : at + 8 + length]
        at += 12 + length
    return width, height, mode, tiff


def _webp(raw: bytes) -> tuple[int, int, str, bytes] | None:
    at, size, tiff = 12, None, b""
    while at + 8 <= len(raw):
        kind, length = struct.unpack_from("<4sI", raw, at)
        body = raw[at + 8 : at + 8 + length]
        if kind == b"VP8X" and len(body) >= 10:
            size = (1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"), "RGBA" if body[0] & 0x10 else "RGB")
        elif kind == b"VP8 " and len(body) >= 10 and not size:
            width, height = struct.unpack_from("<HH", body, 6)
            size = (width & 0x3FFF, height & 0x3FFF, "RGB")
        elif kind == b"VP8L" and len(body) >= 5 and not size:
            bits = int.from_bytes(body[1:5], "little")
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB")
        elif kind == b"EXIF":
            tiff = body.removeprefix(b"Exif\0\0")
        at += 8 + length + length % 2
    return (*size, tiff) if size else None


def picture(raw: bytes) -> Picture | None:
    """What an image's layout tells; None for what is none of PNG, JPEG, GIF, BMP, TIFF and WebP, or damaged."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            kind, found = "PNG", _png(raw)
        elif raw[:2] == b"\xff\xd8":
            kind, found = "JPEG", _jpeg(raw)
        elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            kind, found = "WEBP", _webp(raw)
        elif raw[:4] == b"GIF8":
            kind, found = "GIF", (*struct.unpack_from("<HH", raw, 6), "P", b"")
        elif raw[:2] == b"BM":
            width, height, _, bits = struct.unpack_from("<iiHH", raw, 18)
            kind, found = "BMP", (abs(width), abs(height), {1: "1", 4: "P", 8: "P", 32: "RGBA"}.get(bits, "RGB"), b"")
        elif raw[:4] in (b"II*\0", b"MM\0*"):
            own, _ = tiff_fields(raw)
            samples, bits = own.get(0x0115, 1), own.get(0x0102, 1)
            bits = bits[0] if isinstance(bits, list) else bits
            mode = {3: "RGB", 4: "CMYK" if own.get(0x0106) == 5 else "RGBA"}.get(samples, "P" if own.get(0x0106) == 3 else "1" if bits == 1 else "L")
            found = (own[0x0100], own[0x0101], mode, raw) if 0x0100 in own and 0x0101 in own else None
            kind = "TIFF"
        else:
            return None
        if not found:
            return None
        width, height, mode, tiff = found
        own, gps = tiff_fields(tiff)
    except (struct.error, zlib.error):
        return None
    return Picture(kind, width, height, mode, _named(own, TAGS), _named(gps, GPS_TAGS))


def _shown(value: object) -> str:
    text = str(value)
    return text[:200] + "..." if len(text) > 200 else text


def image(file: File) -> Outcome:
    out, found = Outcome(), picture(file.content)
    if not found:
        out.tell("error", "image could not be read", label="error")
        return out
    out.info = f"{found.format} {found.width}x{found.height} {found.mode}"
    out.tell("dimensions", f"{found.width}x{found.height}", label="Dimensions")
    out.tell("format", found.format, label="Format")
    out.tell("mode", found.mode, label="Color mode")
    if found.fields:
        out.tell("exif", "\n".join(f"{k}: {_shown(v)}" for k, v in found.fields.items()), short=f"{len(found.fields)} EXIF tag(s)", label="EXIF metadata")
    if found.gps:
        out.tell("gps", "\n".join(f"{k}: {v}" for k, v in found.gps.items()), 2, short="GPS coordinates found in image", label="GPS data")
    best = [f"{words}: {found.fields[k]}" for k, words in HIGHLIGHTS.items() if k in found.fields]
    if best:
        out.tell("exif_highlights", "\n".join(best), label="EXIF highlights")
    if found.width <= 3 and found.height <= 3:
        out.tell("tracking_pixel", f"Image of {found.width}x{found.height} pixels — possible tracking pixel", 2, label="tracking_pixel")
    return out
