"""Reports as text, JSON, Markdown, HTML and timelines; and what else a run writes.

A renderer is a function from one root's view (a nested dict) to a string; a root's findings fit in one worker, since
its file and depth are bounded, and roots are rendered apart from each other.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwood.functions import content, iocs
from siftwood.operators import reports as report_ops
from siftwood.operators import timeline as timeline_ops
from siftwood.plans.engine import TriageResult
from siftwood.runtime import ship
from siftwood.schema import Severity

RENDERERS: dict[str, Callable[[dict], str]] = {}


def renderer(name: str):
    """Registers a format."""

    def add(f):
        RENDERERS[name] = f
        return f

    return add


def get_renderer(name: str) -> Callable[[dict], str]:
    if name not in RENDERERS:
        raise ValueError(f"unknown format {name!r}; there are {', '.join(available_formats())}")
    return RENDERERS[name]


def available_formats() -> list[str]:
    return sorted(RENDERERS)


# --- views --------------------------------------------------------------------------------------------------------


def view(result: TriageResult, verbosity: int = 0) -> DataFrame:
    """(root_id, node_id, path, info, reports): what is shown of each node, reports in order."""
    shown = report_ops.in_order(report_ops.shown(result.reports, verbosity, "node_id"), "node_id")
    listed = shown.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("place", "report_key", "label", "severity", "text", "short", "content_type", "data"))).alias("reports"))
    n = result.nodes
    name = content.effective_filename(F.col("filename"), F.col("md5"), F.col("magic_mime"))
    info = F.struct(name.alias("filename"), "mime_type", "magic_mime", "magic_description", "type_mismatch", "size", "md5", "sha1", "sha256", "level", F.col("idx").alias("index"), "analyzer", "analyzer_info")
    return n.select("root_id", "node_id", "path", info.alias("info")).join(listed, "node_id", "left")


def ioc_summary(result: TriageResult, defang: bool = False) -> DataFrame:
    """(root_id, kind, values): indicators of each root, each in its first spelling; passwords are not told."""
    found = iocs.merged(result.iocs.where("kind <> 'passwords'"), "root_id", order=["path", "pos"])
    value = iocs.defanged(F.col("kind"), F.col("value")) if defang else F.col("value")
    ordered = F.array_sort(F.collect_list(F.struct("first", value.alias("value"))))
    return found.groupBy("root_id", "kind").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def _tree(rows: list[dict]) -> dict:
    """Nested nodes of one root."""
    by_path = {tuple(r["path"]): {"info": r["info"], "reports": r["reports"], "children": []} for r in sorted(rows, key=lambda r: list(r["path"]))}
    for path, node in by_path.items():
        if path[:-1] in by_path:
            by_path[path[:-1]]["children"].append(node)
    return next(iter(by_path.values()))


def render(result: TriageResult, format: str = "text", verbosity: int = 0, defang: bool = False) -> DataFrame:
    """(root_id, rendered): each root in a format."""
    if format == "timeline":
        return timeline_text(result)
    get_renderer(format)
    ship(result.nodes.sparkSession)
    rows = view(result, verbosity).select("root_id", F.to_json(F.struct("path", "info", F.coalesce("reports", F.array()).alias("reports"))).alias("node"))
    summary = ioc_summary(result, defang).groupBy("root_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "values"))).alias("m"))
    said = summary.select(F.col("root_id").alias("root_id"), F.to_json("m").alias("iocs"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes = [json.loads(x) for x in left["node"]]
        tree = _tree(nodes) | {"iocs": json.loads(right["iocs"].iloc[0]) if len(right) else {}}
        return pd.DataFrame({"root_id": [key[0]], "rendered": [get_renderer(format)(tree)]})

    return rows.groupBy("root_id").cogroup(said.groupBy("root_id")).applyInPandas(run, "root_id string, rendered string")


def timeline_text(result: TriageResult) -> DataFrame:
    """(root_id, rendered): a line for each event, by time."""
    lines = timeline_ops.lines(result.timeline)
    told = lines.groupBy("root_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "line"))), lambda x: x["line"]), "\n").alias("t"))
    roots = result.nodes.select("root_id").distinct()
    return roots.join(told, "root_id", "left").select("root_id", F.coalesce("t", F.lit("No timeline events found.")).alias("rendered"))


def _name(severity: int) -> str:
    return Severity(severity).name


def _hops(report: dict) -> list[dict]:
    """The hops of a route's report, oldest first."""
    if report["content_type"] != "application/x-hops" or not report.get("data"):
        return []
    return json.loads(report["data"]).get("hops") or []


HOP_HEADS = ("#", "Server", "From", "Proto", "TLS", "Timestamp", "Delta")


def _hop_cells(hop: dict) -> tuple[str, ...]:
    """The cells of one hop, as plain text."""
    place = lambda name, ip: f"{name} [{ip}]" if ip and ip != name else name
    notes = f" ({', '.join(hop['annotations'])})" if hop.get("annotations") else ""
    zone = f" ({hop['prev_tz']} -> {hop['tz_offset']})" if hop.get("tz_changed") else ""
    delta = hop.get("delta_display") or ""
    late = delta if not delta or (hop.get("delta_seconds") or 0) < 0 else f"+{delta}"
    return (
        str(hop["hop"]), place(hop.get("by_hostname") or "", hop.get("by_ip")), place(hop.get("from_name") or "?", hop.get("from_ip")) + notes,
        hop.get("protocol") or "", hop.get("tls") or hop.get("cipher") or ("NONE" if hop.get("no_tls") else ""), (hop.get("timestamp") or "") + zone, late,
    )


def _is_image(report: dict) -> bool:
    return report["content_type"].startswith("image/") and bool(report.get("data"))


def _ioc_lines(tree: dict) -> list[str]:
    found = tree.get("iocs") or {}
    sections = {"IPs": found.get("ipv4", []) + found.get("ipv6", []), "Domains": found.get("domains", []), "URLs": found.get("urls", []), "Emails": found.get("emails", []), "MD5": found.get("md5", []), "SHA1": found.get("sha1", []), "SHA256": found.get("sha256", [])}
    return [f"{k}: {', '.join(v)}" for k, v in sections.items() if v]


@renderer("text")
def as_text(tree: dict) -> str:
    import textwrap

    out: list[str] = []

    def walk(node: dict, lead: str, mark: str) -> None:
        i = node["info"]
        out.append(f"{lead}{mark}{i['filename']}  {i['mime_type']}  {i['size']} bytes  [{i['analyzer']}]")
        inner = lead + {"├─ ": "│  ", "└─ ": "   "}.get(mark, "")
        for r in node["reports"]:
            for k, line in enumerate(r["text"].splitlines() or [""]):
                head = f"{_name(r['severity'])}: " + (f"{r['label']}: " if r["label"] else "") if not k else "    "
                out.extend(textwrap.wrap(head + line, 100, initial_indent=f"{inner}│ ", subsequent_indent=f"{inner}│     ", drop_whitespace=False) or [f"{inner}│ {head}"])
        for k, child in enumerate(node["children"]):
            walk(child, inner, "└─ " if k == len(node["children"]) - 1 else "├─ ")

    walk(tree, "", "")
    told = _ioc_lines(tree)
    return "\n".join([*out, *(["", "Indicators"] if told else []), *told])


@renderer("rich")
def as_rich(tree: dict) -> str:
    """The text form under panels with the identity, the detections by severity, and authentication, for terminals."""
    i = tree["info"]
    every = list(_all_reports(tree))
    worst = min([r["severity"] for r in every], default=4)
    panels = []
    for level in (0, 1, 2):
        found = [r for r in every if r["severity"] == level]
        if found:
            panels.append((f"{_name(level)} ({len(found)})", [r["short"].splitlines()[0] if r["short"] else r["report_key"] for r in found]))
    signed = [r["text"] for r in every if r["label"] in ("auth", "dmarc_align")]
    panels += [("Authentication", signed)] if signed else []
    properties = [line for r in every if r["label"] in ("metadata", "EXIF metadata", "exiftool") for line in r["text"].splitlines()]
    panels += [("Metadata", properties)] if properties else []
    told = _ioc_lines(tree)
    panels += [("Indicators", told)] if told else []
    lines = [f"{k:<8}{i[k]}" for k in ("filename", "mime_type", "size", "md5", "sha1", "sha256")] + [f"{'worst':<8}{_name(worst)}"]
    wide = max(map(len, lines))
    head = [f"╭{'─' * (wide + 2)}╮", *(f"│ {x:<{wide}} │" for x in lines), f"╰{'─' * (wide + 2)}╯"]
    return "\n".join([*head, *(line for title, body in panels for line in _panel(title, body)), as_text(tree)])


def _panel(title: str, body: list[str], most: int = 96) -> list[str]:
    cut = [x if len(x) <= most else x[: most - 1] + "…" for x in body]
    wide = max(len(title) + 1, *map(len, cut))
    return [f"╭─ {title} {'─' * (wide - len(title) - 1)}╮", *(f"│ {x:<{wide}} │" for x in cut), f"╰{'─' * (wide + 2)}╯"]


@renderer("legacy")
def as_legacy(tree: dict) -> str:
    """The older text form: type, size and all three hashes of each node, texts wrapped at 100, branches drawn."""
    import textwrap

    out: list[str] = []

    def walk(node: dict, lead: str, mark: str, inner: str) -> None:
        i = node["info"]
        out.append(f"{lead}{mark}{i['index']} >> {i['mime_type']} {i['size']}")
        rows = [("info", i["analyzer_info"]), ("filename", i["filename"]), ("md5", i["md5"]), ("sha1", i["sha1"]), ("sha256", i["sha256"])]
        out.extend(f"{inner}{k:<9}: {v or ''}" for k, v in rows if k != "filename" or v)
        for r in node["reports"]:
            body = f"[Image: {r['text'] or 'in the HTML report'}]" if _is_image(r) else r["text"]
            lines = textwrap.wrap(body, 100, subsequent_indent="  ") or [""]
            out.extend([f"{inner}{r['label']} : {lines[0]}", *(f"{inner}  {x}" for x in lines[1:])])
        for k, child in enumerate(node["children"]):
            last = k == len(node["children"]) - 1
            walk(child, inner, "└── " if last else "├── ", inner + ("    " if last else "│   "))

    walk(tree, "", "", "")
    return "\n".join([*out, *_ioc_lines(tree)])


def _all_reports(node: dict):
    yield from node["reports"]
    for child in node["children"]:
        yield from _all_reports(child)


@renderer("json")
def as_json(tree: dict) -> str:
    def plain(node: dict) -> dict:
        told = [{**{k: v for k, v in r.items() if k not in ("place", "severity", "data")}, "severity": _name(r["severity"]), "data": json.loads(r["data"]) if r.get("data") else None} for r in node["reports"]]
        return {"info": node["info"], "reports": told, "children": [plain(c) for c in node["children"]]}

    return json.dumps(plain(tree) | ({"iocs": tree["iocs"]} if tree.get("iocs") else {}), indent=2, ensure_ascii=False)


def escape_markdown(text: str) -> str:
    return "".join("\\" + c if c in "\\`*_{}[]()#+-!|<>" else c for c in text)


@renderer("markdown")
def as_markdown(tree: dict) -> str:
    out: list[str] = []

    def walk(node: dict, depth: int) -> None:
        i = node["info"]
        out.extend([f"{'#' * min(depth, 6)} {escape_markdown(i['filename'])}", "", f"- type: {i['mime_type']}", f"- size: {i['size']}", f"- sha256: `{i['sha256']}`", ""])
        for r in node["reports"]:
            head = f"**{_name(r['severity'])}** {escape_markdown(r['label'] or r['report_key'])}"
            hops = _hops(r)
            if hops:
                row = lambda cells: f"| {' | '.join(escape_markdown(c) for c in cells)} |"
                out.extend([head, "", row(HOP_HEADS), "|" + "---|" * len(HOP_HEADS)])
                for hop in hops:
                    out.append(row(_hop_cells(hop)))
                    out.extend(f"| ~ | *inferred: {escape_markdown(x['label'])}* |" + " |" * (len(HOP_HEADS) - 2) for x in hop.get("inferred_after") or [])
                out.extend(["", *(escape_markdown(x["label"]) for x in hops[-1].get("footer") or []), ""])
                continue
            if _is_image(r):
                out.extend([f"{head}: [image: {escape_markdown(r['text'])}]", ""])
                continue
            out.extend([head, "", "```", r["text"], "```", ""] if "\n" in r["text"] else [f"{head}: {escape_markdown(r['text'])}", ""])
        for child in node["children"]:
            walk(child, depth + 1)

    walk(tree, 1)
    told = _ioc_lines(tree)
    return "\n".join(out + (["## Indicators", "", *(f"- {escape_markdown(x)}" for x in told)] if told else []))


COLOURS = {"CRITICAL": "#b00020", "HIGH": "#e65100", "MEDIUM": "#f9a825", "LOW": "#1565c0", "INFO": "#616161"}


def _html_body(report: dict) -> str:
    """A report's text, or its hops as a table, or its picture."""
    hops = _hops(report)
    if _is_image(report):
        data = html.escape(json.loads(report["data"]) if report["data"].startswith('"') else report["data"])
        return f'<br><img src="data:{html.escape(report["content_type"])};base64,{data}" alt="{html.escape(report["text"])}">'
    if not hops:
        return f"<pre>{html.escape(report['text'])}</pre>"
    cell = lambda c: f"<td>{html.escape(c)}</td>"
    lines = []
    for hop in hops:
        lines.append(f"<tr>{''.join(map(cell, _hop_cells(hop)))}</tr>")
        lines += [f'<tr><td>~</td><td colspan="{len(HOP_HEADS) - 1}"><i>inferred: {html.escape(x["label"])}</i></td></tr>' for x in hop.get("inferred_after") or []]
    feet = "".join(f"<p>{html.escape(x['label'])}</p>" for x in hops[-1].get("footer") or [])
    return f"<table><tr>{''.join(f'<th>{h}</th>' for h in HOP_HEADS)}</tr>{''.join(lines)}</table>{feet}"


@renderer("html")
def as_html(tree: dict) -> str:
    def walk(node: dict) -> str:
        i = node["info"]
        rows = "".join(f'<li style="color:{COLOURS[_name(r["severity"])]}"><b>{_name(r["severity"])}</b> {html.escape(r["label"] or r["report_key"])}{_html_body(r)}</li>' for r in node["reports"])
        return f"<details open><summary>{html.escape(i['filename'])} <code>{html.escape(i['mime_type'])}</code> {i['size']}</summary><ul>{rows}</ul>{''.join(map(walk, node['children']))}</details>"

    told = "".join(f"<li>{html.escape(x)}</li>" for x in _ioc_lines(tree))
    title = html.escape(tree["info"]["filename"])
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body>{walk(tree)}{'<h2>Indicators</h2><ul>' + told + '</ul>' if told else ''}</body></html>"


@renderer("timeline")
def _timeline_only(tree: dict) -> str:
    raise ValueError("timelines are rendered from the events table")
