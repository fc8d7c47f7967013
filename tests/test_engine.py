import base64
import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwood import cli
from siftwood.config import Flags
from siftwood.functions import formats
from siftwood.plans import analyzers, engine, render
from siftwood.sources import sinks
from siftwood.sources.files import read_files, read_mail


def archive(members, mode="w"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, mode) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def locked(members, password):
    """A zip with the old stream cipher, which the standard library reads but doesn't write."""
    import struct
    import zlib

    table = [0] * 256
    for n in range(256):
        c = n
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table[n] = c
    step = lambda crc, b: crc >> 8 ^ table[(crc ^ b) & 255]
    body, directory = b"", b""
    for name, data in members.items():
        keys = [0x12345678, 0x23456789, 0x34567890]

        def turn(b):
            keys[0] = step(keys[0], b)
            keys[1] = ((keys[1] + (keys[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
            keys[2] = step(keys[2], keys[1] >> 24)

        for b in password.encode():
            turn(b)
        crc = zlib.crc32(data)
        coded = bytearray()
        for b in b"\0" * 11 + bytes([crc >> 24]) + data:
            t = keys[2] | 2
            coded.append(b ^ (t * (t ^ 1) >> 8 & 255))
            turn(b)
        head = struct.pack("<HHHHHIIIHH", 20, 1, 0, 0, 33, crc, len(coded), len(data), len(name), 0)
        directory += b"PK\x01\x02" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + name.encode()
        body += b"PK\x03\x04" + head + name.encode() + bytes(coded)
    return body + directory + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(directory), len(body), 0)


def mail_with(*parts):
    out = "From: Boss <boss@corp.example>\nReply-To: x@evil.example\nTo: a@corp.example\nSubject: Test\nDate: Mon, 1 Jan 2024 10:00:00 +0100\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=BB\n\n"
    out = "Received: from m.example (m.example [93.184.216.34]) by mx.corp.example (Postfix) with ESMTP id AB1; Mon, 1 Jan 2024 09:50:00 +0000\n" + out
    for name, kind, data in parts:
        out += f"--BB\nContent-Type: {kind}; name={name}\nContent-Disposition: attachment; filename={name}\nContent-Transfer-Encoding: base64\n\n{base64.encodebytes(data).decode()}\n"
    return (out + "--BB--\n").encode()


def triage(spark, files, flags=Flags()):
    rows = [(p, bytearray(c)) for p, c in files.items()]
    return engine.analyze(spark, spark.createDataFrame(rows, "path string, content binary"), flags)


def keys(result, node=None):
    rows = result.reports.where(F.col("node_id") == node) if node else result.reports
    return {r.report_key: r.severity for r in rows.collect()}


@pytest.fixture(scope="module")
def result(spark):
    inner = archive({"deep.txt": "see http://evil.test/payload and 8.8.8.8", "run.pdf.exe": b"MZ" + b"\0" * 50})
    text = b"the password: opensesame is in this text for you"
    return triage(spark, {"/in/a.eml": mail_with(("note.txt", "text/plain", text), ("locked.zip", "application/zip", locked({"secret.txt": b"call joe@corp.test"}, "opensesame")), ("plain.zip", "application/zip", inner), ("copy.zip", "application/zip", inner)), "/in/b.txt": b"nothing at all in here"})


def test_tree_and_dedupe(result):
    nodes = {r.node_id: r for r in result.nodes.drop("content").collect()}
    assert {n.filename for n in nodes.values()} == {"a.eml", "b.txt", "note.txt", "locked.zip", "plain.zip", "deep.txt", "run.pdf.exe", "secret.txt"}  # the copy's content was there before
    assert nodes["/in/a.eml/#2/#1"].filename == "run.pdf.exe" and nodes["/in/a.eml/#2/#1"].level == 2
    assert nodes["/in/a.eml"].analyzer == "EmailAnalyzer" and nodes["/in/a.eml/#1"].analyzer == "ZipAnalyzer"


def test_password_found_in_a_sibling_opens(result):
    got = keys(result, "/in/a.eml/#1")
    assert got["password_discovered"] == 1 and "decrypted" in got and "pending_password" not in got
    assert {r.value for r in result.iocs.collect()} >= {"joe@corp.test", "http://evil.test/payload", "8.8.8.8"}


def test_findings(result):
    got = keys(result)
    assert got["reply_to_mismatch"] == 1 and got["dangerous_extension"] == 0 and got["double_extension"] == 1 and got["mail_origin"] == 4
    assert keys(result, "/in/a.eml/#2/#0")["iocs"] == 2
    roots = {r.root_id: r for r in engine.identity(result).collect()}
    assert roots["/in/a.eml"].worst == "CRITICAL" and roots["/in/b.txt"].nodes == 1 and roots["/in/b.txt"].worst == "INFO"
    events = [r.event for r in result.timeline.where("root_id = '/in/a.eml' and event not like 'Archive%'").orderBy("ts").collect()]
    assert events == ["Email date", "Mail relay hop"]


@pytest.mark.parametrize("name", [f for f in render.available_formats() if f != "timeline"])
def test_renderers(result, name):
    told = {r.root_id: r.rendered for r in render.render(result, name, defang=True).collect()}
    assert set(told) == {"/in/a.eml", "/in/b.txt"} and "deep.txt" in told["/in/a.eml"].replace("\\", "")
    assert "8[.]8[.]8[.]8" in told["/in/a.eml"].replace("\\", "")
    if name == "json":
        tree = json.loads(told["/in/a.eml"])
        assert tree["info"]["filename"] == "a.eml" and len(tree["children"]) == 3 and tree["reports"][0]["severity"] == "HIGH"


def test_timeline_and_unknown_format(result):
    told = {r.root_id: r.rendered for r in render.render(result, "timeline").collect()}
    assert "2024-01-01T09:00:00Z  Email date                a.eml" in told["/in/a.eml"].splitlines() and told["/in/b.txt"] == "No timeline events found."
    with pytest.raises(ValueError, match="html, json, legacy, markdown"):
        render.render(result, "pdf")


def test_extraction(result, tmp_path):
    done = sinks.extract(result.nodes, str(tmp_path / "out"), names=True).collect()
    assert all(r.written for r in done) and (tmp_path / "out/children/children/deep.txt").read_bytes().startswith(b"see http")
    hashed = {r.target for r in sinks.extraction_plan(result.nodes).collect()}
    assert all(len(t.rpartition("/")[2].partition(".")[0]) == 32 for t in hashed)


def test_depth_limit(spark):
    data = b"bottom"
    for k in range(6):
        data = archive({f"level{k}.zip" if k else "x.txt": data})
    result = triage(spark, {"/z.zip": data}, Flags(max_analysis_depth=3))
    assert result.nodes.agg(F.max("level")).first()[0] == 4
    assert [r.node_id for r in result.reports.where("report_key = 'depth_limit'").collect()] == ["/z.zip/#0/#0/#0/#0"]


def test_files_and_folders(spark, tmp_path, capsys):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/m.eml").write_bytes(mail_with())
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    assert read_files(spark, str(tmp_path), Flags(max_file_size=99), "*.txt").count() == 0
    mail = read_mail(spark, str(tmp_path / "sub"))
    assert mail.first().status == "done"
    from siftwood.functions.mail import mail_headers, summary_rows

    line = sinks.mail_csv(summary_rows(mail)).first().value
    assert line.endswith('m.eml","Test","2024-01-01 09:00:00","Boss <boss@corp.example>","a@corp.example"')
    every, spoofed = sinks.senders(mail_headers(mail))
    assert [r.sender for r in every.collect()] == ["boss@corp.example"] and spoofed.count() == 0
    assert cli.main([str(tmp_path / "sub"), "--format", "json"]) == 0 and '"m.eml"' in capsys.readouterr().out
    assert cli.main(["--check"]) == 0 and "EmailAnalyzer" in capsys.readouterr().out


def test_empty_input_and_damage(spark):
    empty = engine.analyze(spark, spark.createDataFrame([], "path string, content binary"))
    assert empty.nodes.count() == empty.reports.count() == empty.iocs.count() == empty.timeline.count() == 0
    bad = triage(spark, {"/x.zip": b"PK\x03\x04 nonsense", "/y": b"", "/z.eml": b"\xff\xfe\0\0"})
    assert keys(bad, "/x.zip")["error"] == 4 and bad.nodes.count() == 3


def test_dispatch(spark):
    rows = [(1, "text/plain", "a.txt", b"From: a\nSubject: b\n\nx"), (2, "text/plain", "a.js", b"var x = 1"), (3, "text/plain", "a.txt", b"const a = require('x')"), (4, "application/mbox", "m", b"From x\nFrom: a\nSubject: b"), (5, "application/zip", "d.docx", archive({"[Content_Types].xml": "<x/>"})), (6, "application/x-7z-compressed", "x", b"7z")]
    df = spark.createDataFrame([(i, m, n, bytearray(c)) for i, m, n, c in rows], "node_id long, mime_type string, filename string, content binary")
    got = {r.node_id: r.candidates for r in analyzers.dispatched(df).select("node_id", "candidates").collect()}
    assert got == {1: ["PlainTextAnalyzer", "EmailAnalyzer"], 2: ["PlainTextAnalyzer", "ScriptAnalyzer"], 3: ["PlainTextAnalyzer", "ScriptAnalyzer"], 4: ["EmailAnalyzer", "MboxAnalyzer"], 5: ["ZipAnalyzer", "OfficeDocumentAnalyzer"], 6: []}
    told = {r.analyzer: r for r in analyzers.capabilities(spark).collect()}
    assert told["ZipAnalyzer"].available and not told["SevenZipAnalyzer"].available and told["SevenZipAnalyzer"].missing == ["py7zr"]


# --- formats -------------------------------------------------------------------------------------------------------


def run(analyse, raw, name=None, **more):
    out = analyse(formats.File(raw if isinstance(raw, bytes) else raw.encode(), name, "", **more))
    return {r["key"]: r["severity"] for r in out.reports}, out


@pytest.mark.parametrize("members, expected", [({"../../x": "a"}, ("path_traversal", 0)), ({"a\\..\\..\\x": "a"}, ("path_traversal", 0)), ({"/etc/x": "a"}, ("absolute_path", 1)), ({"ok.txt": "a"}, ("summary", 4))])
def test_zip_paths(members, expected):
    got, out = run(formats.zip_archive, archive(members))
    assert got[expected[0]] == expected[1] and bool(out.children) == (expected[0] != "path_traversal")


def test_zip_bombs_and_passwords():
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("zeros", b"\0" * 2_000_000)
    got, out = run(formats.zip_archive, bomb.getvalue())
    assert "error" in got and not out.children
    assert "error" in run(formats.zip_archive, archive({"a": "abc"}), max_size=2)[0]
    assert run(formats.zip_archive, locked({"a.txt": b"hi"}, "infected"))[0]["password"] == 4
    assert run(formats.zip_archive, locked({"a.txt": b"hi"}, "other"))[0]["pending_password"] == 1
    got, out = run(formats.zip_archive, locked({"a.txt": b"hi"}, "other"), passwords=("wrong", "other"))
    assert got["decrypted"] == 1 and out.children[0]["content"] == b"hi"


def test_rtf():
    raw = r"{\rtf1{\fonttbl" + "{" * 12 + "}" * 12 + r"}{\object\objdata 02CE0200000000000000C000000000000046AABB}{\*\template http://evil.test/t.dot} Some \'e4 plain words here}"
    got, out = run(formats.rich_text, raw)
    assert got["ole_count"] == 2 and got["suspicious_control_words"] == 1 and got["rtf_template_injection"] == 0 and got["fonttbl_nesting"] == 1
    assert [c["filename"] for c in out.children] == ["ole_object_0.bin", "rtf_text.txt"] and "Some ä plain words here".encode() in out.children[1]["content"]
    raw = r"{\rtf1\objdata 0002ce0200000000c000000000000046 " + "{" * 101 + "}" * 101 + "}"
    got, _ = run(formats.rich_text, raw)
    assert got["ole_clsid_0"] == 0 and got["deep_nesting"] == 2
    assert run(formats.rich_text, "plain")[0] == {"format": 3}


def test_ics():
    raw = "BEGIN:VCALENDAR\r\nMETHOD:REQUEST\r\nBEGIN:VEVENT\r\nSUMMARY:Urgent me\r\n eting\r\nORGANIZER;CN=X:mailto:x@y.z\r\nATTENDEE:mailto:a@b.c\r\nATTENDEE:mailto:d@e.f\r\nDESCRIPTION:please verify your account\\, at http://bit.ly/x\r\nBEGIN:VALARM\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got, out = run(formats.calendar, raw)
    assert got == {"summary": 4, "organizer": 4, "attendees": 4, "description": 4, "method": 4, "auto_add": 3, "alarms": 3, "urls": 3, "shortened_urls": 2, "phishing_indicators": 1}
    assert out.info == "iCalendar with 1 event(s)" and out.children[0]["content"] == b"please verify your account, at http://bit.ly/x"
    assert next(r for r in out.reports if r["key"] == "summary")["text"] == "Urgent meeting"


def docx(**changes):
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>',
    } | {k.replace("__", "/"): v for k, v in changes.pop("parts", {}).items()}
    for name, edit in changes.pop("edits", {}).items():
        parts[name] = edit(parts[name])
    return archive(parts)


def rels(*targets):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="x{k}" Type="{t}" Target="{g}" {m}/>' for k, (t, g, m) in enumerate(targets)) + "</Relationships>"


R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
OUT = 'TargetMode="External"'
CASES = {
    "clean": (docx(), {}),
    "traversal": (docx(parts={"../x.xml": "<a/>"}), {"zip_path_traversal": 0, "orphan_../x.xml": 2}),
    "phantom": (docx(edits={"[Content_Types].xml": lambda x: x.replace("</Types>", '<Override PartName="/word/ghost.xml" ContentType="application/xml"/></Types>')}), {"phantom_content_parts": 2}),
    "undeclared": (docx(parts={"word/blob.xyz": "a"}), {"undeclared_parts": 2, "orphan_word/blob.xyz": 2}),
    "conflict": (docx(edits={"[Content_Types].xml": lambda x: x.replace("</Types>", '<Override PartName="/word/document.xml" ContentType="application/xml"/></Types>')}), {"content_type_conflict": 1}),
    "unusual": (docx(edits={"[Content_Types].xml": lambda x: x.replace("application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", "model/strange")}), {"unusual_content_type": 3}),
    "dangling": (docx(parts={"word/_rels/document.xml.rels": rels((R + "image", "media/gone.png", ""))}), {"dangling_references": 2}),
    "odd relation": (docx(parts={"word/_rels/document.xml.rels": rels(("urn:odd", "document.xml", ""))}), {"nonstandard_rel_type": 3}),
    "template": (docx(parts={"word/_rels/settings.xml.rels": rels((R + "attachedTemplate", "http://e.test/t.dotm", OUT))}), {"ext_rel_word/_rels/settings.xml.rels_x0": 0}),
    "follina": (docx(parts={"word/_rels/a.rels": rels((R + "x", "ms-msdt:/id", OUT), (R + "frame", "http://e.test", OUT))}), {"ext_rel_word/_rels/a.rels_x0": 0, "ext_rel_word/_rels/a.rels_x1": 1}),
    "deep": (docx(edits={"word/document.xml": lambda x: x.replace("<w:p>", "<w:x>" * 60 + "<w:p>").replace("</w:p>", "</w:p>" + "</w:x>" * 60)}), {"deep_nesting_word/document.xml": 2}),
    "blob": (docx(edits={"word/document.xml": lambda x: x.replace("Hello", "A" * 600)}), {"large_blob_word/document.xml": 2}),
    "dde": (docx(edits={"word/document.xml": lambda x: x.replace("Hello", "DDEAUTO c:\\x")}), {"dde_word/document.xml_1": 0}),
    "alternate": (docx(edits={"word/document.xml": lambda x: x.replace("<w:p>", '<mc:AlternateContent xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"/>' * 15 + "<w:p>")}), {"mc_heavy_word/document.xml": 2}),
    "custom": (docx(parts={"customXml/item1.xml": "<a>" + "B" * 60 + "</a>"}), {"customxml_payload_customXml/item1.xml": 1, "orphan_customXml/item1.xml": 2}),
    "class": (docx(parts={"word/embeddings/o.bin": b"\1" * 9 + formats.class_bytes("0002ce02-0000-0000-c000-000000000046")}), {"embedded_clsid_word/embeddings/o.bin": 0, "ole_objects": 1, "undeclared_parts": 2, "orphan_word/embeddings/o.bin": 2}),
    "svg": (docx(parts={"word/media/a.svg": "<svg onload=x><script>1</script></svg>"}), {"svg_script_word/media/a.svg": 0, "svg_event_word/media/a.svg": 1, "undeclared_parts": 2, "orphan_word/media/a.svg": 2}),
    "moniker": (docx(edits={"word/document.xml": lambda x: x.replace("<w:p>", '<w:p href="file://h/x!y">')}), {"monikerlink_word/document.xml": 0}),
}


@pytest.mark.parametrize("case", CASES)
def test_office_packages(case):
    raw, expected = CASES[case]
    got, out = run(formats.office_package, raw, "a.docx")
    assert got == expected
    assert any(c["filename"] == "document_text.txt" for c in out.children)


def test_macros_in_a_plain_extension():
    raw = docx(edits={"[Content_Types].xml": lambda x: x.replace("</Types>", '<Default Extension="bin" ContentType="application/vnd.ms-office.vbaProject"/></Types>')}, parts={"word/vbaProject.bin": b"x"})
    assert {"content_type_mismatch", "vba_macros"} <= set(run(formats.office_package, raw, "a.docx")[0])
    assert "content_type_mismatch" not in run(formats.office_package, raw, "a.docm")[0]


def test_mailbox():
    raw = b"From a@b Mon Jan  1 00:00:00 2024\nSubject: one\n\nx\n\nFrom c@d Mon Jan  1 00:00:00 2024\nSubject: two\n\ny\n"
    out = formats.mailbox_file(formats.File(raw, "m.mbox", ""))
    assert [c["filename"] for c in out.children] == ["mbox-message-1.eml", "mbox-message-2.eml"] and b"two" in out.children[1]["content"]


# --- stores and streams --------------------------------------------------------------------------------------------


def test_key_value_store(spark, tmp_path):
    store = sinks.KeyValueStore(spark, str(tmp_path / "kv"))
    rows = lambda *r: spark.createDataFrame([(n, k, v, datetime(2024, 1, d)) for n, k, v, d in r], store.SCHEMA)
    assert store.get("a", "x", "none") == "none"
    store.set(rows(("a", "x", "1", 1), ("a", "y", "2", 1), ("b", "x", "3", 1)))
    store.set(rows(("a", "x", "9", 2)))
    assert store.get("a", "x") == "9" and store.has("b", "x") and store.size("a") == 2
    assert store.delete(spark.createDataFrame([("a", "y")], "namespace string, key string")) == 1 and not store.has("a", "y")
    for _ in range(3):
        store.increment("c", "n", "hits", 2)
    store.touch("c", "n")
    value = json.loads(store.get("c", "n"))
    assert value["hits"] == 6 and "last_seen" in value
    store.clear("a")
    assert store.size("a") == 0 and store.size("b") == 1


def test_windows_and_counters(spark, tmp_path):
    from siftwood.streaming import events as streams

    source = tmp_path / "events"
    schema = "ts timestamp, event_type string, user_id long"
    rows = [(datetime(2024, 1, 1, h, m), t, 1) for h, m, t in ((10, 5, "a"), (10, 50, "a"), (11, 1, "b"), (23, 0, "z"))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = streams.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.n) for r in spark.table("w").collect()} == {("a", 2), ("b", 1)}
    store = sinks.KeyValueStore(spark, str(tmp_path / "kv"))
    keyed = stream.select(F.col("event_type").alias("key"), F.col("ts").alias("updated_at"))
    streams.count_into(keyed, store, "types", str(tmp_path / "c2")).awaitTermination(120)
    assert {(r.key, r.n) for r in streams.counters(store, "types").collect()} == {("a", 2), ("b", 1), ("z", 1)}


def test_passwords_and_archives_in_any_order(spark, tmp_path):
    from siftwood.streaming.passwords import unlocked

    schema = "root_id string, node_id string, password string, content binary"
    one, two = locked({"a": b"x"}, "first"), locked({"a": b"x"}, "second")
    batches = [[("r", "z1", None, one), ("r", "p1", "second", None), ("s", "p9", "first", None)], [("r", "z2", None, two), ("r", "p2", "first", None)]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = []
        for k, rows in enumerate(batches):
            spark.createDataFrame([(*r[:3], bytearray(r[3]) if r[3] else None) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            q = unlocked(stream, ttl_ms=None).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert q.awaitTermination(60)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {(r.root_id, r.node_id, r.password, r.source_node_id) for r in found} == {("r", "z2", "second", "p1"), ("r", "z1", "first", "p2")}


# --- whatever a file is -------------------------------------------------------------------------------------------


def test_new_kinds_through_the_engine(spark, tmp_path):
    """PDF, 7z, RAR, Outlook, macros, relationships, rules and verdicts, as one run sees them."""
    from siftwood.functions import reputation
    from tests import test_readers as made

    rules = tmp_path / "rules"
    rules.mkdir()
    (rules / "a.yar").write_text('rule Found : tag { strings: $a = "deep text" condition: $a }')
    files = {
        "/in/a.7z": made.seven_zip({"doc.pdf": made.pdf_file(), "inner.txt": b"some deep text in here"}),
        "/in/b.rar": made.rar_5([("vbaProject.bin", made.macro_file({"M": made.CODE}), 0, False)]),
        "/in/c.msg": made.build(made.message_streams(), storages=("__recip_version1.0_#00000000", "__attach_version1.0_#00000000")),
        "/in/d.rels": b'<?xml version="1.0"?><Relationships><Relationship Type="x/attachedTemplate" Target="http://evil.test" TargetMode="External"/></Relationships>',
        "/in/e.docx": docx(parts={"word/comments/extra.xml": "<a>DDEAUTO x</a>"}),
    }
    import hashlib

    digest = hashlib.sha256(files["/in/b.rar"]).hexdigest()
    answer = json.dumps({"data": {"attributes": {"last_analysis_stats": {"malicious": 3, "harmless": 1}, "reputation": -5}}})
    verdicts = spark.createDataFrame([{**reputation.verdict("file", digest, answer)}], reputation.VERDICT)
    rows = [(p, bytearray(c)) for p, c in files.items()]
    out = engine.analyze(spark, spark.createDataFrame(rows, "path string, content binary"), Flags(yara_rules_dir=str(rules)), verdicts)
    kinds = {r.filename: r.analyzer for r in out.nodes.select("filename", "analyzer").collect()}
    assert {kinds[k] for k in ("a.7z", "b.rar", "c.msg", "d.rels", "doc.pdf", "vbaProject.bin")} == {"SevenZipAnalyzer", "RARAnalyzer", "MsgAnalyzer", "OfficeRelationshipAnalyzer", "PDFAnalyzer", "VBAProjectAnalyzer"}
    assert kinds["extra.xml"] == "OfficeXMLAnalyzer" and kinds["email_body.html"] == "HTMLAnalyzer"
    told = {(r.node_id, r.report_key): r for r in out.reports.collect()}
    assert told["/in/b.rar", "virustotal"].severity == 1 and told["/in/b.rar", "virustotal"].short == "VT 3 hit(s)"
    assert told["/in/a.7z/#1", "yara"].text == "Found tags=tag" and told["/in/a.7z/#1", "fuzzy_hash"].text.startswith("ssdeep: 3:")
    assert told["/in/d.rels", "external_link_0"].severity == 0 and ("/in/c.msg", "mail_route") in told
    assert json.loads(told["/in/c.msg", "mail_route"].data)["hops"][0]["from_ip"] == "93.184.216.34"
    page = next(r.rendered for r in render.render(out, "html", 1).collect() if r.root_id == "/in/c.msg")
    marked = next(r.rendered for r in render.render(out, "markdown", 1).collect() if r.root_id == "/in/c.msg")
    assert "<table><tr><th>#</th>" in page and "93.184.216.34" in page and "| \\# | Server |" in marked
    out.drop()


def test_verdicts_are_asked_only_where_allowed(spark):
    from siftwood.functions import reputation

    values = spark.createDataFrame([("file", "ab"), ("domain", "evil.test"), ("ip", "8.8.8.8"), ("file", "none"), ("file", "ab")], "kind string, value string")

    def ask(url, key):
        assert key == "key" and url.startswith("https://")
        return None if url.endswith("none") else json.dumps({"data": {"attributes": {"last_analysis_stats": {"malicious": 1}, "country": "DE"}}}).encode()

    assert reputation.lookups(values, Flags(), ask).count() == 0
    found = {(r.kind, r.value): (r.malicious, r.country, r.permalink) for r in reputation.lookups(values, Flags(network_policy="online", vt_api_key="key"), ask).collect()}
    assert set(found) == {("file", "ab"), ("domain", "evil.test"), ("ip", "8.8.8.8")}
    assert found["ip", "8.8.8.8"] == (1, "DE", "https://www.virustotal.com/gui/ip-address/8.8.8.8") and reputation.verdict("file", "x", b"no json") is None


def test_providers_and_late_registrations(spark):
    from siftwood.functions import content

    content.register_provider("mine", lambda raw, name: F.when(F.contains(name, F.lit("odd")), F.struct(F.lit("odd/kind").alias("mime"), F.lit("odd").alias("description"))))
    rows = spark.createDataFrame([("odd.txt", bytearray(b"x y z")), ("a.txt", bytearray(b"x y z"))], "name string, raw binary")
    seen = {r.name: (r.d.mime, r.d.provider) for r in rows.select("name", content.detected(F.col("raw"), F.col("name"), ("mine", "file", "extension")).alias("d")).collect()}
    assert seen["odd.txt"] == ("odd/kind", "mine") and seen["a.txt"][0] == "text/plain"

    def count(file, out):
        out.tell("size", str(len(file.content)))

    def fail(file, out):
        raise ValueError("no luck")

    analyzers.register_analyzer(analyzers.Analyzer("OddAnalyzer", 99, ("odd/kind",), analyzers.steps(count=count, fail=fail)))
    try:
        files = spark.createDataFrame([("/x", bytearray(b"12345"), "odd/kind")], "path string, content binary, declared_mime string")
        got = {r.report_key: r.text for r in engine.analyze(spark, files).reports.collect()}
        assert got["size"] == "5" and got["error_fail"] == "fail: no luck"
    finally:
        analyzers.REGISTRY.pop()


def test_folders_of_images_archives_and_mail(spark, tmp_path):
    from siftwood.sources import files as sources
    from tests import test_readers as made

    (tmp_path / "a.tif").write_bytes(made.tiff(made.FIELDS, made.GPS))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.zip").write_bytes(archive({"x.txt": b"abc"}))
    (tmp_path / "d.7z").write_bytes(made.seven_zip({"y.txt": b"abc"}))
    (tmp_path / "e.eml").write_bytes(mail_with(("note.txt", "text/plain", b"some text")))
    found = {r.path.rpartition("/")[2]: r for r in sources.read_exif(spark, str(tmp_path)).collect()}
    assert found["a.tif"].exif["Make"] == "Maker" and found["a.tif"].gps["GPSLatitudeRef"] == "N" and found["b.png"].format is None and len(found) == 2
    hashes = {(r.path.rpartition("/")[2], r.member): r.digest for r in sources.archive_hashes(spark, str(tmp_path), "md5").collect()}
    assert hashes == {("c.zip", "x.txt"): "900150983cd24fb0d6963f7d28e17f72", ("d.7z", "y.txt"): "900150983cd24fb0d6963f7d28e17f72"}
    dump = next(r.dump for r in sinks.mail_dump(read_files(spark, str(tmp_path), glob="*.eml")).collect())
    assert "From   : Boss <boss@corp.example>" in dump and "Subject: Test" in dump and "note.txt" in dump and dump.startswith("File   : ")


def test_store_of_changes(spark, tmp_path):
    """Changes of two writers, folds that later readers and writers agree on, and a table that cannot be read."""
    path = tmp_path / "kv"
    one, two = (sinks.KeyValueStore(spark, str(path)) for _ in range(2))
    rows = lambda *r: spark.createDataFrame([("a", k, v, datetime(2024, 1, d)) for k, v, d in r], one.SCHEMA)
    one.set(rows(("x", "1", 1), ("x", "2", 2)))
    two.set(rows(("y", "3", 1)))
    two.set(rows(("x", "late but older", 1)))
    wanted = {("x", "2"), ("y", "3")}
    read = lambda s: {(r.key, r.value) for r in s.read().collect()}
    assert read(one) == read(two) == wanted and len(one._names("changes")) == 3
    one.compact()
    assert read(two) == wanted and len(one._live()[0]) == 1 and len(one._names("changes")) == 3  # readers may still be at them
    two.set(rows(("z", "4", 1)))
    two.compact()
    assert read(one) == wanted | {("z", "4")} and len(one._names("changes")) == 1
    one.compact()
    assert read(two) == wanted | {("z", "4")} and not one._names("changes") and len(one._names("folds")) <= 2
    one.set(rows(("w", "5", 1)))
    broken = next((path / "changes").glob("*/*.parquet"))
    broken.write_bytes(b"no table")
    for crc in broken.parent.glob(".*.crc"):
        crc.unlink()
    assert read(sinks.KeyValueStore(spark, str(path), lenient=True)) == wanted | {("z", "4")}
    with pytest.raises(Exception):
        read(one)


def test_logging(spark, tmp_path):
    from siftwood.runtime import setup_logging

    path = tmp_path / "log"
    log = setup_logging(spark, debug=True, path=str(path))
    log.debug("a line")
    setup_logging(spark).debug("not told")
    spark.sparkContext.setLogLevel("ERROR")
    assert "a line" in path.read_text() and "not told" not in path.read_text()
