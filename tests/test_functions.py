import pytest
from pyspark.sql import functions as F

from siftwood.config import Flags
from siftwood.functions import content, formats, iocs, scripts, text
from siftwood.operators import reports, rules
from siftwood.operators.timeline import parsed_time


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in values.values())], schema or "x string").select(column.alias("r")).first()["r"]


def found(spark, s, **settings):
    return one(spark, iocs.indicators(F.col("t"), **settings), t=s).asDict()


def test_indicators(spark):
    h = "ab" * 32
    got = found(spark, f"x 8.8.8.8, 8.8.8.8 192.168.1.1 1.2.0.0 http://evil.test/a?b). HTTP://EVIL.TEST/A?B Joe@Corp.Example joe@corp.example mail.corp.example evil.test ab.io w3.org sub.host.net {h} {h.upper()} {'cd' * 20} {'ef' * 16} Passwort: geheim12 pw: the")
    assert got["ipv4"] == ["8.8.8.8"] and got["urls"] == ["http://evil.test/a?b"] and got["emails"] == ["Joe@Corp.Example"]
    assert got["domains"] == ["mail.corp.example", "sub.host.net"]
    assert got["sha256"] == [h] and got["sha1"] == ["cd" * 20] and got["md5"] == ["ef" * 16] and got["passwords"] == ["geheim12"]
    assert found(spark, "192.168.1.1", include_private=True)["ipv4"] == ["192.168.1.1"]
    assert found(spark, "a sub.host.net b", skip_domains=["sub.host.net"])["domains"] == []
    assert found(spark, "hxxp[:]//evil[.]test/abc joe[at]x.org", refang=True)["urls"] == ["http://evil.test/abc"]
    assert found(spark, "a fe80::1 b ::1", strict=False)["ipv6"] == ["fe80::1", "::1"]
    assert all(v == [] for v in found(spark, None).values())


def test_indicator_helpers(spark):
    assert one(spark, iocs.distinct_folded(F.col("a")), a=["B", "b", "a", "A", "c"]) == ["B", "a", "c"]
    assert one(spark, iocs.defanged(F.lit("urls"), F.col("t")), t="https://a.b/") == "hxxps://a.b/"
    for ip, private in (("10.0.0.1", True), ("172.32.0.1", False), ("172.16.0.1", True), ("169.254.9.9", True), ("8.8.8.8", False), ("x", False)):
        assert one(spark, iocs.is_private(F.col("t")), t=ip) is private


@pytest.mark.parametrize("raw, low, high", [(b"", 0, 0), (b"\0" * 100, 0, 0), (b"\0" * 512 + b"\xff" * 512, 1, 1), (bytes(range(256)) * 4, 7.9, 8), (b"the quick brown fox jumps over the lazy dog again", 3, 5)])
def test_entropy(raw, low, high):
    assert low <= content.entropy_of(raw) <= high


def test_entropy_columns(spark):
    raw = bytes(range(256)) * 16
    assert one(spark, content.block_entropy(F.col("c")), c=raw) == [8.0] * 4
    assert one(spark, content.entropy_severity(content.entropy(F.col("c")), F.octet_length("c")), c=raw) == 2
    assert one(spark, content.entropy_map(F.array(F.lit(0.0), F.lit(4.0), F.lit(8.0))), x="") == " ▒█"


def test_names_and_types(spark):
    assert one(spark, content.sanitized_filename(F.col("t")), t="a b<c>::d?.txt") == "a_b_c_d_.txt"
    for name, level, double in (("x.pdf.exe", 0, True), ("x.JS", 1, False), ("x.txt", None, False), (".exe", None, False), (None, None, False)):
        assert one(spark, content.dangerous_extension(F.col("t")), t=name) == level
        assert one(spark, content.double_extension(F.col("t")), t=name) is double
    for raw, mime in ((b"PK\x03\x04..", "application/zip"), (b"%PDF-1.7", "application/pdf"), (b"{\\rtf1", "text/rtf"), (b"<html><p>", "text/html"), (b"hello", "text/plain"), (b"\0\1\2", "application/octet-stream"), (b"MZ..", "application/x-dosexec")):
        assert one(spark, content.detected(F.col("c"), F.lit(None).cast("string"))["mime"], c=raw) == mime
    assert one(spark, content.detected(F.col("c"), F.lit("a.docx"), ("extension", "native"))["provider"], c=b"PK\x03\x04") == "extension"
    assert one(spark, content.hash_by(F.col("c"), "sha3_256"), c=b"x") == __import__("hashlib").sha3_256(b"x").hexdigest()
    assert one(spark, content.printable_strings(F.col("c")), c=b"\0abcdef\xff\xffh\0i\0d\0d\0e\0n\0\xff") == ["abcdef", "hidden"]
    assert bytes(one(spark, content.guid_bytes(F.col("t")), t="0002ce02-0000-0000-c000-000000000046")) == formats.class_bytes("0002ce02-0000-0000-c000-000000000046")


def test_scanner():
    plain, comments, literals = scripts.scan("a = 'it // is'; // one\nb = \"x\\\"y\" /* two */ + `q` + 'open")
    assert literals == ["it // is", 'x\\"y', "q"] and comments == ["one", "two"] and "one" not in plain and "it // is" in plain
    assert scripts.unescape(r"\x41B\u{43}\u{ffffff}") == r"ABC\u{ffffff}"
    assert scripts.char_codes("String.fromCharCode(72, 0x65,108,108,111) String.fromCharCode(a)") == [("String.fromCharCode(72, 0x65,108,108,111)", "Hello")]
    assert scripts.base64_blobs(["QUJD" * 12, "short"])[0][1] == b"ABC" * 12
    assert formats.fold('"a"+"b" + "c"') == '"abc"'
    assert scripts.decode_text(b"\xff\xfeh\0i\0") == ("hi", "utf-16-le") and scripts.decode_text(b"\xff")[1] == "latin-1"
    assert scripts.decode_encoded_script(b"#@~^AA==Ab@!==^#~@") == b"dh!" and scripts.decode_encoded_script(b"x") is None


@pytest.mark.parametrize("source, least, most", [("function add(a, b) { // sum\n return a + b; }", 0, 20), ("[" + "]()!+" * 30, 40, 100), (r"var x='" + r"\x41" * 30 + "';", 20, 100)])
def test_obfuscation(spark, source, least, most):
    points = one(spark, scripts.obfuscation(scripts.metrics(F.col("t")), F.col("t"))["score"], t=source)
    assert least <= points <= most
    assert points == scripts.score(scripts.measure(source), source, None)[0]


DROPPER = "var a = new ActiveXObject('MSXML2.XMLHTTP'); var s = new ActiveXObject('ADODB.Stream'); new ActiveXObject('WScript.Shell').Run('x')"


def test_threats(spark):
    df = spark.createDataFrame([(1, DROPPER), (2, "var calm = 1;"), (3, None)], "id long, t string")
    rows = scripts.threats(df, F.col("t"), "id").collect()
    assert {r.pattern for r in rows} == {t["pattern"] for t in formats.threats(DROPPER)} >= {"download_cradle", "file_write", "WScript.Shell", "execute", "activex"}
    assert {(r.pattern, r.context) for r in rows} == {(t["pattern"], t["context"]) for t in formats.threats(DROPPER)}
    assert [r.kill_chain for r in scripts.kill_chains(scripts.threats(df, F.col("t"), "id"), "id").collect()] == [True]
    assert one(spark, scripts.fragmented_apis(F.col("t")), t="x('WScr' + 'ipt.Sh' + 'ell')") == ["WScript.Shell"]
    assert one(spark, scripts.library(F.col("t")), t="/*! jQuery v3.6.0 | x */") == "jQuery"


def test_html_and_text(spark):
    page = "<html><script>var x='<a href=no>';</script><a href='http://a.b/'>A <b>link</b></a><form action=/go><img src=p.png><!-- <a href=c>c</a> --><p>Text &amp; more"
    out = formats.page(formats.File(page.encode(), None, "text/html"))
    assert {r["key"] for r in out.reports} == {"links", "images", "forms"} and out.children[0]["content"] == b"A link Text & more"
    assert one(spark, text.html_text(F.col("t")), t=page) == "A link Text & more"
    assert one(spark, text.language(F.col("t")), t="der Hund und die Katze sind nicht zu Hause") == "de"
    assert one(spark, text.language(F.col("t")), t="short") is None
    assert one(spark, text.possible_passwords(F.col("t")), t="Kennwort: \"geheim1\" oder abc\npw: x") == ["geheim1", "oder"]
    assert one(spark, text.shortened_urls(F.col("a")), a=["http://bit.ly/x", "http://ok.example"]) == ["http://bit.ly/x"]


@pytest.mark.parametrize("value, expected", [("Mon, 01 Jan 2024 10:00:00 +0100 (CET)", "2024-01-01 09:00:00"), ("1704103200", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("2024-01-01 10:00:00", "2024-01-01 10:00:00"), ("1 Jan 2024 10:00:00 GMT", "2024-01-01 10:00:00"), ("soon", None), (None, None)])
def test_times(spark, value, expected):
    got = one(spark, parsed_time(F.col("t")), t=value)
    assert (str(got) if got else None) == expected


def test_report_views(spark):
    rows = [("n", 1, "a", 4, 0, 50, "x" * 3000, None), ("n", 2, "b", 0, 0, 50, "y", "a"), ("n", 3, "c", 2, 99, 50, "z", None), ("n", 4, "d", 0, 0, 10, "w", None)]
    df = spark.createDataFrame(rows, "node_id string, seq int, label string, severity int, verbosity int, ord int, text string, replaces string")
    assert [r.label for r in reports.in_order(reports.shown(df, 0, "node_id"), "node_id").orderBy("place").collect()] == ["d", "b"]
    alone = reports.shown(df.where("label = 'a'"), 0, "node_id").first()
    assert len(alone.text) == 2049 and len(reports.shown(df.where("label = 'a'"), 2, "node_id").first().text) == 3000
    tree = spark.createDataFrame([("r", ["r"]), ("c", ["r", "c"]), ("g", ["r", "c", "g"])], "node_id string, ancestors array<string>")
    own = reports.worst_own(tree, df.select(F.lit("g").alias("node_id"), F.lit(1).alias("severity")), "node_id")
    assert {r.node_id: r.severity for r in reports.worst_of_subtree(tree, own).collect()} == {"r": 1, "c": 1, "g": 1}


def test_rules(spark):
    for name, up, rooted in (("../x", True, False), ("a\\..\\b", True, False), ("/etc/x", False, True), ("a..b/c", False, False)):
        assert one(spark, rules.traverses(F.col("t")), t=name) is up and one(spark, rules.absolute(F.col("t")), t=name) is rooted
    ids = rules.techniques(F.lit("x.js"), F.lit("ScriptAnalyzer"), F.array(F.lit("encryption")), F.lit("registry rundll32"), F.lit("JavaScript"))
    assert one(spark, ids, x="") == ["T1027.013", "T1059.007", "T1547.001", "T1218.011"]
    keyed = lambda strict: rules.techniques(F.lit(None).cast("string"), F.lit("X"), F.array().cast("array<string>"), F.lit(""), F.lit(""), strict, F.array(F.lit("vba_macros")))
    assert one(spark, keyed(False), x="") == ["T1204.002"] and one(spark, keyed(True), x="") == []


def test_flags(spark):
    assert Flags.from_dict({"debug": True, "nonsense": 1}) == Flags(debug=True) and Flags().to_dict()["max_analysis_depth"] == 10
    spark.conf.set("triage.max_analysis_depth", "3")
    assert Flags.from_session(spark).max_analysis_depth == 3
    spark.conf.unset("triage.max_analysis_depth")


@pytest.mark.parametrize("blocks", [{}, {"most": 4000}])
def test_contained_keeps_every_signature(spark, blocks):
    words = {n: f"signature number {n:05d} of a long list of them" for n in range(10_500)} | {10_500: "tiny", 10_501: "ünï", 10_502: "of eight", 10_503: None}
    texts = {1: f"x {words[10_499]} y", 2: f"{words[300]} {words[7]}", 3: "signature number", 4: None, 5: "a tiny one", 6: "two ünï", 7: "of eight of nine", 8: "tin", 9: ""}
    signatures = spark.createDataFrame(list(words.items()), "ord long, signature string")
    found = rules.contained(spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id long, text string"), F.col("text"), signatures, "signature", "doc_id", **blocks)
    brute = {d: min((n for n, w in words.items() if w and t and w in t), default=None) for d, t in texts.items()}
    assert found.columns == ["doc_id", "ord", "signature"]
    told = [(r.doc_id, r.ord) for r in found.collect()]
    assert sorted(told) == sorted([(d, n) for d, n in brute.items() if n is not None] + [(5, 10_500)])


def test_scores_and_texts_by_column_and_by_value(spark):
    """What columns tell and what workers tell are one definition."""
    from siftwood.functions import text

    sources = ["eval(a);eval(b);eval(c)", "x" * 6000, "var a='" + "y" * 900 + "';", r"\x41" * 30 + " String.fromCharCode(1)" * 5, "[]()!+" * 20, "/*! jQuery v3.1.0 */ f(1)", "a=1;b=2;c=3;" * 60, ""]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(sources)], "k int, s string").withColumn("m", scripts.metrics(F.col("s")))
    told = {r.k: r for r in rows.select("k", scripts.obfuscation(F.col("m"), F.col("s")).alias("o"), scripts.script_type(F.lit("A.WSF"), F.col("s")).alias("t")).collect()}
    for k, s in enumerate(sources):
        lib = next((name for p, name in scripts.LIBRARIES if __import__("re").search(p, s[:2000])), None)
        assert (told[k].o.score, list(told[k].o.indicators)) == scripts.score(scripts.measure(s), s, lib)
        assert told[k].t == scripts.kind_of("A.WSF", False, lib) == "Windows Script File"
    raws = [b"", b"plain", "grün".encode(), "grün".encode("cp1252"), b"\x80\x81\x9f", b"\xef\xbb\xbfmarked", b"\xff\xfeh\0i\0", b"\xfe\xff\0h\0i", b"\xff\xfeodd", b"\xff\xfe\x00\xd8", b"\xef\xbb\xbf\xff"]
    frame = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(raws)], "k int, raw binary").select("k", text.decoded(F.col("raw")).alias("d"))
    assert {r.k: (r.d.text, r.d.encoding) for r in frame.collect()} == {k: text.decode_bytes(r) for k, r in enumerate(raws)}
