"""The registry of analysers, and their run over a table of nodes."""

from __future__ import annotations

import importlib.util
import json
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.config import Flags
from siftwood.functions import archives, compound, content, exif, formats, fuzzy, mail, outlook, pdf, tools, vba, yara
from siftwood.runtime import ship


def _head(n: int) -> Column:
    return F.decode(F.substring("content", 1, n), "ISO-8859-1")


def _script_probe() -> Column:
    signs = F.lit(0)
    for p in formats.SCRIPT_SIGNS:
        signs = signs + _head(4096).rlike(p).cast("int")
    named = F.coalesce(content.extension(F.col("filename")).isin("js", "jse", "mjs", "cjs"), F.lit(False))
    typed = F.col("mime_type").isin("application/octet-stream", "text/plain")
    return typed & ((named & (signs >= 1)) | (signs >= 2) | F.contains(_head(1024), F.lit("#@~^")))


def _package_probe() -> Column:
    return (F.hex(F.substring("content", 1, 4)) == "504B0304") & F.contains(F.decode("content", "ISO-8859-1"), F.lit("[Content_Types].xml"))


@dataclass(frozen=True)
class Analyzer:
    """specificity: of all that fit a node, the highest is its primary, of equals the one registered last; the others
    contribute reports under keys that it leaves free.  probe: fits nodes of other types too; only: has to hold as well.
    needs: Python modules, programs: commands that must be there."""

    name: str
    specificity: int
    mimes: tuple[str, ...] = ()
    run: Callable[[formats.File], formats.Outcome] | None = None
    probe: Callable[[], Column] | None = None
    needs: tuple[str, ...] = ()
    programs: tuple[str, ...] = ()
    only: Callable[[], Column] | None = None

    def missing(self) -> list[str]:
        return [m for m in self.needs if importlib.util.find_spec(m) is None] + [p for p in self.programs if not shutil.which(p)]

    @property
    def available(self) -> bool:
        return self.run is not None and not self.missing()


def steps(**named: Callable[[formats.File, formats.Outcome], None]) -> Callable[[formats.File], formats.Outcome]:
    """An analyser's run made of named steps, in order; one that fails tells so and the others go on."""

    def run(file: formats.File) -> formats.Outcome:
        out = formats.Outcome()
        for name, step in named.items():
            try:
                step(file, out)
            except Exception as error:  # the other steps' findings stand
                out.tell(f"error_{name}", f"{name}: {error}", label="error")
        return out

    return run


def _named(pattern: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col("filename").rlike(pattern), F.lit(False))


def _outlook_probe() -> Column:
    text = F.decode("content", "ISO-8859-1")
    mark = "\0".join("__properties_version1.0")
    return (F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1") & F.contains(text, F.lit(mark))


def _package_part() -> Column:
    return F.coalesce(F.col("metadata")["archive_type"] == "ooxml", F.lit(False))


_OFFICE = tuple(f"application/vnd.openxmlformats-officedocument.{k}" for k in ("wordprocessingml.document", "wordprocessingml.template", "spreadsheetml.sheet", "spreadsheetml.template", "presentationml.presentation", "presentationml.template", "presentationml.slideshow"))
_MACRO = tuple(f"application/vnd.ms-{k}.macroEnabled.12" for k in ("word.document", "word.template", "excel.sheet", "excel.template", "excel.addin", "powerpoint.presentation", "powerpoint.slideshow", "powerpoint.template", "powerpoint.addin"))

REGISTRY: list[Analyzer] = [
    Analyzer("EmailAnalyzer", 20, ("message/rfc822",), formats.message, lambda: mail.looks_like_message(F.col("content"))),
    Analyzer("PlainTextAnalyzer", 5, ("text/plain",), formats.plain_text),
    Analyzer("ZipAnalyzer", 10, ("application/zip", "application/x-zip-compressed"), formats.zip_archive),
    Analyzer("SevenZipAnalyzer", 10, ("application/x-7z-compressed",), archives.seven_zip),
    Analyzer("HTMLAnalyzer", 15, ("text/html",), formats.page),
    Analyzer("PDFAnalyzer", 20, ("application/pdf",), pdf.portable_document),
    Analyzer("MsgAnalyzer", 20, ("application/vnd.ms-outlook",), outlook.outlook_message, _outlook_probe),
    Analyzer("MboxAnalyzer", 20, ("application/mbox",), formats.mailbox_file),
    Analyzer("OfficeDocumentAnalyzer", 20, _OFFICE + _MACRO, formats.office_package, _package_probe),
    Analyzer("OLEOfficeAnalyzer", 10, ("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/vnd.ms-office"), compound.compound_document, lambda: F.hex(F.substring("content", 1, 8)) == "D0CF11E0A1B11AE1"),
    Analyzer("RTFAnalyzer", 20, ("application/rtf", "text/rtf"), formats.rich_text),
    Analyzer("ImageAnalyzer", 20, ("image/png", "image/jpeg", "image/gif", "image/bmp", "image/tiff", "image/webp"), exif.image),
    Analyzer("ICSAnalyzer", 20, ("text/calendar", "application/ics"), formats.calendar),
    Analyzer("RARAnalyzer", 10, ("application/vnd.rar", "application/x-rar", "application/x-rar-compressed"), archives.rar),
    Analyzer("OfficeRelationshipAnalyzer", 25, ("application/vnd.openxmlformats-package.relationships+xml", "application/xml", "text/xml"), formats.relationships_part, only=_named(r"\.rels$")),
    Analyzer("OfficeXMLAnalyzer", 25, ("application/xml", "text/xml"), formats.document_part, only=lambda: _package_part() & ~_named(r"\.rels$")()),
    Analyzer("VBAProjectAnalyzer", 25, ("application/vnd.ms-office.vbaProject",), vba.macro_project, _named(r"vbaProject\.bin"), only=_named(r"vbaProject\.bin")),
    Analyzer("ScriptAnalyzer", 20, ("text/javascript", "application/javascript", "application/x-javascript", "application/ecmascript", "text/ecmascript", "text/jscript", "application/hta"), formats.script, _script_probe),
]


def register_analyzer(analyzer: Analyzer) -> Analyzer:
    """Adds an analyser; of equally specific ones the latest wins."""
    REGISTRY.append(analyzer)
    return analyzer


def capabilities(spark: SparkSession) -> DataFrame:
    """(analyzer, specificity, available, missing): what can run here."""
    rows = [(a.name, a.specificity, a.available, a.missing()) for a in REGISTRY]
    return spark.createDataFrame(rows, "analyzer string, specificity int, available boolean, missing array<string>")


def dispatched(nodes: DataFrame) -> DataFrame:
    """nodes with candidates, an array of analyser names, the primary last.  Analysers that cannot run here are left out."""
    if "metadata" not in nodes.columns:
        nodes = nodes.withColumn("metadata", F.create_map().cast("map<string,string>"))
    cases = [
        F.when((F.col("mime_type").isin(*a.mimes) | (a.probe() if a.probe else F.lit(False))) & (a.only() if a.only else F.lit(True)), F.struct(F.lit(a.specificity).alias("s"), F.lit(k).alias("k"), F.lit(a.name).alias("name")))
        for k, a in enumerate(REGISTRY)
        if a.available
    ]
    ordered = F.array_sort(F.array_compact(F.array(*cases)))
    return nodes.withColumn("candidates", F.transform(ordered, lambda x: x["name"]))


_REPORT = pa.struct([("report_key", pa.string()), ("label", pa.string()), ("severity", pa.int32()), ("verbosity", pa.int32()), ("ord", pa.int32()), ("seq", pa.int32()), ("text", pa.string()), ("short", pa.string()), ("content_type", pa.string()), ("data", pa.string()), ("replaces", pa.string()), ("analyzer", pa.string())])
_CHILD = pa.struct([("idx", pa.int32()), ("filename", pa.string()), ("declared_mime", pa.string()), ("content", pa.binary()), ("metadata", pa.map_(pa.string(), pa.string()))])
_GATEWAY = pa.struct([("type", pa.string()), ("label", pa.string()), ("data", pa.map_(pa.string(), pa.string()))])
_HOP = pa.struct([("pos", pa.int32()), *[(f.name, f.type) for f in mail._HOP_ARROW]])
OUTCOME = (
    "node_id string, analyzer string, info string, "
    "reports array<struct<report_key:string,label:string,severity:int,verbosity:int,ord:int,seq:int,text:string,short:string,content_type:string,data:string,replaces:string,analyzer:string>>, "
    "children array<struct<idx:int,filename:string,declared_mime:string,content:binary,metadata:map<string,string>>>, "
    "hops array<struct<pos:int," + ",".join(f"{f}:string" for f in mail.HOP_FIELDS) + ",ts:timestamp,tz_offset:string,raw_header:string,match_quality:int>>, "
    "gateways array<struct<type:string,label:string,data:map<string,string>>>"
)


Runs = dict[str, Callable[[formats.File], formats.Outcome]]


def outcome_of(file: formats.File, candidates: list[str], runs: Runs | None = None) -> tuple[str, formats.Outcome]:
    """The primary's outcome with the contributors' reports under free keys; an analyser that fails tells so."""
    runs = runs or {a.name: a.run for a in REGISTRY}
    primary, out = candidates[-1] if candidates else "Analyzer", formats.Outcome()
    for name in reversed(candidates):
        try:
            found = runs[name](file)
        except Exception as error:  # one damaged file must not end the others' job
            found = formats.Outcome()
            found.tell("error", f"{name}: {error}", label="error")
        if name == primary:
            out = found
        else:
            taken = {r["key"] for r in out.reports}
            out.reports += [r for r in found.reports if r["key"] not in taken and r.get("label") != "error"]
    return primary, out


def tell_of_any(file: formats.File, out: formats.Outcome, rules: list[yara.Rule]) -> None:
    """What any file tells, whatever it is: similarity hash, matching rules, and a metadata program's fields."""
    if file.content:
        out.tell("fuzzy_hash", f"ssdeep: {fuzzy.piecewise_hash(file.content)}", short="ssdeep", label="fuzzy_hash", verbosity=2, order=17)
    matches = yara.match(rules, file.content) if rules else []
    if matches:
        more = f" (+{len(matches) - 3} more)" if len(matches) > 3 else ""
        lines = [m["rule"] + (f" tags={','.join(m['tags'])}" if m["tags"] else "") for m in matches]
        out.tell("yara", "\n".join(lines), 1, short=", ".join(m["rule"] for m in matches[:3]) + more, label="yara", order=26, data={"matches": matches})
    tools.tell_metadata(out, tools.file_metadata(file.content))


def _reports(out: formats.Outcome, primary: str) -> list[dict]:
    return [
        {"report_key": r["key"], "label": r.get("label", ""), "severity": r["severity"], "verbosity": r.get("verbosity", 0), "ord": r.get("order", 50), "seq": i, "text": r["text"],
         "short": r.get("short", r["text"]), "content_type": r.get("content_type", "text/plain"), "data": json.dumps(r["data"]) if "data" in r else None, "replaces": r.get("replaces"), "analyzer": primary}
        for i, r in enumerate(out.reports)
    ]


#: Bytes of nested files that a worker gathers before it hands a batch on.
HANDED = 16 << 20


def _analysed(flags: Flags, runs: Runs, sources: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = yara.compile_rules(sources)[0]
        names = ["node_id", "analyzer", "info", "reports", "children", "hops", "gateways"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(_REPORT), pa.list_(_CHILD), pa.list_(_HOP), pa.list_(_GATEWAY)]
        done: list[tuple] = []
        size = 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                file = formats.File(row["content"] or b"", row["filename"], row["mime_type"], flags.max_compression_ratio, flags.max_file_size, tuple(row["passwords"] or ()))
                primary, out = outcome_of(file, row["candidates"] or [], runs)
                tell_of_any(file, out, rules)
                children = [{"idx": i, "filename": c["filename"], "declared_mime": c["mime"], "content": c["content"], "metadata": list(c["metadata"].items())} for i, c in enumerate(out.children) if len(c["content"]) <= flags.max_file_size]
                gateways = [{"type": g["type"], "label": g["label"], "data": [("cip", g.get("cip"))]} for g in out.gateways]
                done.append((row["node_id"], primary, out.info, _reports(out, primary), children, out.hops, gateways))
                size += sum(len(c["content"]) for c in children)
                if size > HANDED:
                    yield handed()
                    done, size = [], 0
            if done:
                yield handed()
                done, size = [], 0

    return run


def rule_sources(spark: SparkSession, flags: Flags) -> dict[str, str]:
    """Rule files by path: those of the user's own folder, if there is one, and of the folder that the flags name.

    Rules are written by hand, so the driver can hold them; they go to the workers with the plan.
    """
    import os

    own = os.path.expanduser("~/.siftwood/yara")
    folders = ([f"file://{own}"] if os.path.isdir(own) else []) + ([flags.yara_rules_dir] if flags.yara_rules_dir else [])
    out: dict[str, str] = {}
    for folder in folders:
        reader = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yar,yara}")
        out |= {r["path"]: r["value"] for r in reader.load(folder).select(F.col("_metadata.file_path").alias("path"), "value").orderBy("path").collect()}
    return out


def unread_rules(spark: SparkSession, flags: Flags) -> DataFrame:
    """(namespace, rule, why) of the rules that the reader does not cover."""
    return spark.createDataFrame(yara.compile_rules(rule_sources(spark, flags))[1], "namespace string, rule string, why string")


def analysed(nodes: DataFrame, flags: Flags) -> DataFrame:
    """(node_id, analyzer, info, reports, children, hops, gateways) of each node; nodes may have passwords to try."""
    ship(nodes.sparkSession)
    if "passwords" not in nodes.columns:
        nodes = nodes.withColumn("passwords", F.array().cast("array<string>"))
    needed = dispatched(nodes).select("node_id", "filename", "mime_type", "content", "candidates", "passwords")
    runs = {a.name: a.run for a in REGISTRY if a.available}  # goes with the plan, so that late registrations reach the workers
    return needed.mapInArrow(_analysed(flags, runs, rule_sources(nodes.sparkSession, flags)), OUTCOME)
