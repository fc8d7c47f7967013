import struct

import pytest

from siftwood.functions import compound, exif
from siftwood.functions.formats import EXPLOITED_CLASSES, File, class_bytes


def build(streams, root_class=None, storages=()):
    """A compound file of version 3: streams by path (one storage level), all in whole sectors or in the mini stream."""
    rows = [("Root Entry", 5, root_class, b"")]
    for s in storages:
        rows.append((s, 1, None, b""))
    for path, data in streams.items():
        rows.append((path.rpartition("/")[2], 2, None, data))
    parents = [None] + [0] * len(storages) + [1 + storages.index(p.rpartition("/")[0]) if "/" in p else 0 for p in streams]
    sectors, fat, mini, mini_fat = [], [], b"", []

    def put(data):
        start = len(sectors)
        parts = [data[k : k + 512].ljust(512, b"\0") for k in range(0, len(data), 512)]
        sectors.extend(parts)
        fat.extend([*range(start + 1, start + len(parts)), compound.END] if parts else [])
        return start if parts else compound.END

    places = {}
    for k, (_, kind, _, data) in enumerate(rows):
        if kind == 2 and len(data) >= 4096:
            places[k] = put(data)
        elif kind == 2 and data:
            n = -(-len(data) // 64)
            places[k] = len(mini_fat)
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), compound.END]
            mini += data.ljust(n * 64, b"\0")
    places[0] = put(mini)
    first_mini = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(512, b"\xff")) if mini_fat else compound.END
    directory = b""
    for k, (name, kind, cls, data) in enumerate(rows):
        mine = [i for i, p in enumerate(parents) if p == k]
        brothers = [i for i, p in enumerate(parents) if p == parents[k] and i > k] if k else []
        coded = name.encode("utf-16-le") + b"\0\0"
        directory += coded.ljust(64, b"\0") + struct.pack("<HBBIII", len(coded), kind, 1, compound.FREE, brothers[0] if brothers else compound.FREE, mine[0] if mine else compound.FREE)
        directory += (class_bytes(cls) if cls else b"\0" * 16) + b"\0" * 20 + struct.pack("<IQ", places.get(k, compound.END), len(mini) if not k else len(data))
    first_dir = put(directory.ljust(-(-len(directory) // 512) * 512, b"\0"))
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = compound.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<III", 0, 1, first_dir) + b"\0" * 4
    head += struct.pack("<IIIII", 4096, first_mini, 1, compound.END, 0) + struct.pack("<I", len(sectors) - 1)
    return head.ljust(512, b"\xff") + b"".join(sectors)


def run(raw):
    out = compound.compound_document(File(raw, "a.doc", ""))
    return {r["key"]: r["severity"] for r in out.reports}, out


def native(name, payload):
    return b"\0" * 4 + b"\2\0" + name + b"\0C:\\" + name + b"\0" + b"\0" * 8 + b"C:\\T\0" + struct.pack("<I", len(payload)) + payload


def test_streams_small_and_large():
    streams = {"WordDocument": b"w" * 5000, "1Table": b"t" * 100, "Box/inner": b"i" * 70}
    found = {e.path: e for e in compound.entries(build(streams, storages=("Box",)))}
    assert {p: e.content for p, e in found.items() if e.kind == "stream"} == {("WordDocument",): b"w" * 5000, ("1Table",): b"t" * 100, ("Box", "inner"): b"i" * 70}
    assert found[("Box",)].kind == "storage" and found[()].kind == "root"


def test_findings():
    exploited = next(iter(EXPLOITED_CLASSES))
    got, out = run(build({"Workbook": struct.pack("<HHH", 0x809, 2, 0) + struct.pack("<HHH", 0x2F, 2, 0), "\x01Ole10Native": native(b"run.exe", b"MZ payload"), "Macros/x": b"v"}, exploited, ("Macros",)))
    assert got["doc_type"] == 4 and got["dangerous_root_clsid"] == 0 and got["excel_password"] == 2 and got["has_vba"] == 0
    assert got["embedded_objects"] == 1 and got["dangerous_embed_0"] == 0
    assert out.children[0]["filename"] == "run.exe" and out.children[0]["content"] == b"MZ payload"
    got, _ = run(build({"EncryptedPackage": b"x" * 10, "Equation Native": b"y"}))
    assert got["encrypted"] == 2 and got["stream_Equation Native"] == 1


def test_summary_and_remote_template():
    text = b"http://evil.test/t.dot\0"
    props = struct.pack("<IIII", 0, 1, 7, 16) + struct.pack("<II", 30, len(text)) + text
    raw = b"\0" * 44 + struct.pack("<I", 48) + props
    assert compound.summary(raw) == {"template": "http://evil.test/t.dot"}
    got, _ = run(build({"\x05SummaryInformation": raw}))
    assert got["remote_template"] == 0


@pytest.mark.parametrize("raw", [b"", b"x" * 600, compound.MAGIC + b"\xff" * 600, compound.MAGIC + b"\0" * 600])
def test_damage_is_told(raw):
    assert "error" in run(raw)[0] or run(raw)[1].info


def test_circles_end():
    raw = bytearray(build({"WordDocument": b"w" * 5000}))
    at = len(raw) - 512
    struct.pack_into("<I", raw, at, 0)  # the first sector names itself as the next
    assert compound.entries(bytes(raw))


def test_objects_of_the_first_version():
    raw = struct.pack("<II", 0x501, 2) + struct.pack("<I", 8) + b"Package\0" + struct.pack("<II", 0, 0) + struct.pack("<I", 3) + b"abc"
    assert compound.object_package(raw) == ("Package", "", b"abc") and compound.object_package(b"x") is None
    assert compound.package(b"short") is None


@pytest.mark.parametrize("raw, expected", [(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 1, 1), ("PNG", 1, 1)), (b"GIF89a" + struct.pack("<HH", 640, 480), ("GIF", 640, 480)), (b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30), ("JPEG", 30, 20)), (b"nothing", None)])
def test_dimensions(raw, expected):
    found = exif.picture(raw)
    assert (found and (found.format, found.width, found.height)) == expected
    out = exif.image(File(raw, None, "image/png"))
    assert ("tracking_pixel" in {r["key"] for r in out.reports}) == (expected == ("PNG", 1, 1))
