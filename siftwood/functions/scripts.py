"""Static analysis of scripts: native expressions where patterns do, Arrow UDFs where a scanner has to keep state."""

from __future__ import annotations

import base64
import binascii
import math
import re
import string
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Threat patterns as (severity, pattern, name, description), kill-chain parts, library banners,
# names that fragmentation hides, key words, signs of encoders.
THREATS = (
    (0, r"(?i)WScript\s*\.\s*Shell", "WScript.Shell", "WScript.Shell COM automation — classic JS dropper execution"),
    (0, r"(?i)(?:MSXML2\.XMLHTTP|WinHttp\.WinHttpRequest|Microsoft\.XMLHTTP)", "download_cradle", "HTTP download cradle via COM object"),
    (0, r"(?i)(?:powershell(?:\.exe)?)\b", "powershell", "PowerShell invocation"),
    (0, r"(?i)-(?:enc|encodedcommand)\b", "powershell_encoded", "PowerShell encoded command"),
    (0, r"(?i)-(?:exec(?:utionpolicy)?)\s+bypass", "powershell_bypass", "PowerShell execution policy bypass"),
    (0, r"(?i)Shell\s*\.\s*Application", "shell_execute", "Shell.Application COM automation — alt execution"),
    (0, r"(?i)ADODB\s*\.\s*Stream", "file_write", "ADODB.Stream — file drop capability"),
    (0, r"(?i)\.SaveToFile\s*\(", "file_write", "SaveToFile — writing payload to disk"),
    (0, r"(?i)Scripting\s*\.\s*FileSystemObject", "file_write", "Scripting.FileSystemObject — filesystem access"),
    (1, r"(?i)(?:new\s+)?ActiveXObject\s*\(", "activex", "ActiveXObject instantiation — Windows COM automation"),
    (1, r"(?i)\beval\s*\(\s*(?:[a-zA-Z_$]|String\.fromCharCode|unescape|atob)", "eval_dynamic", "eval() with dynamic/constructed argument"),
    (1, r"(?i)String\s*\.\s*fromCharCode\s*\([^)]{30,}\)", "fromcharcode_long", "String.fromCharCode with many arguments"),
    (1, r"(?i)winmgmts:", "wmi", "WMI access via winmgmts: moniker"),
    (1, r"(?i)Win32_Process\s*\.\s*Create", "wmi_exec", "WMI process creation"),
    (1, r"(?i)\.RegWrite\s*\(", "registry", "Registry write operation"),
    (1, r"(?i)HKCU\\\\.*\\\\Run\b|HKLM\\\\.*\\\\Run\b", "registry_run", "Registry Run key manipulation — persistence"),
    (1, r"(?i)Schedule\s*\.\s*Service", "schtask", "Task Scheduler COM object"),
    (1, r"(?i)\bschtasks\b", "schtask", "schtasks command — scheduled task creation"),
    (1, r"(?i)cmd\s*(?:\.exe)?\s*/c\b", "cmd_exec", "cmd.exe /c execution"),
    (1, r"(?i)\bmshta\b", "mshta", "mshta execution — script proxy"),
    (1, r"(?i)\brundll32\b", "rundll32", "rundll32 execution — DLL proxy"),
    (1, r"(?i)\bcertutil\b.*-urlcache", "certutil_download", "certutil -urlcache — download via LOLBin"),
    (1, r"(?i)\bbitsadmin\b.*/transfer", "bitsadmin", "bitsadmin /transfer — download via LOLBin"),
    (1, r"(?i)WScript\s*\.\s*Network", "env_harvest", "WScript.Network — environment harvesting"),
    (1, r"(?i)%(?:APPDATA|TEMP|USERPROFILE|LOCALAPPDATA)%", "env_vars", "Environment variable expansion — payload staging path"),
    (1, r"(?i)WScript\s*\.\s*Sleep\s*\(\s*(\d+)", "anti_sandbox", "WScript.Sleep — potential anti-sandbox delay"),
    (1, r"(?i)\.\s*(?:Run|Exec)\s*\(", "execute", "Shell .Run()/.Exec() call — command execution"),
    (2, r"(?i)\batob\s*\(", "atob", "atob() — Base64 decoding"),
    (2, r"(?i)new\s+Function\s*\(", "new_function", "new Function() — dynamic code construction"),
    (2, r"(?i)setTimeout\s*\(\s*[\"']", "settimeout_eval", "setTimeout with string argument — indirect eval"),
    (2, r"(?:\\u[0-9a-fA-F]{4}){3,}", "unicode_hiding", "Unicode escape sequences — possible API name hiding"),
    (2, r"(?m)^.{5000,}$", "long_line", "Very long single line (>5000 chars)"),
    (2, r"(?i)\.ResponseBody\b", "download_cradle", "HTTP response body access — download chain"),
    (2, r"(?i)\.\s*Open\s*\(\s*[\"'](?:GET|POST)", "http_open", "HTTP request .Open() — network access"),
)
DOWNLOAD = ("download_cradle", "http_open", "certutil_download", "bitsadmin")
WRITE = ("file_write",)
EXECUTE = ("WScript.Shell", "execute", "shell_execute", "powershell", "cmd_exec", "mshta", "rundll32", "wmi_exec")
LIBRARIES = (
    (r"/\*!?\s*jQuery\s+v[\d.]+", "jQuery"),
    (r"/\*!?\s*React\s+v[\d.]+", "React"),
    (r"/\*!?\s*Bootstrap\s+v[\d.]+", "Bootstrap"),
    (r"/\*!?\s*Lodash\s+[\d.]+", "Lodash"),
    (r"/\*!?\s*Vue\.js\s+v[\d.]+", "Vue.js"),
    (r"/\*!?\s*Angular\s+v[\d.]+", "Angular"),
    (r"//# sourceMappingURL=", "source-mapped"),
    (r"/\*!?\s*D3\.js", "D3.js"),
    (r"/\*!?\s*moment\.js", "Moment.js"),
    (r"/\*!?\s*underscore\.js", "Underscore.js"),
)
FRAGMENTED = (
    "WScript.Shell", "WScript.Network", "Scripting.FileSystemObject", "MSXML2.XMLHTTP", "ADODB.Stream",
    "Shell.Application", "Schedule.Service", "ActiveXObject",
)
KEYWORDS = (
    "var", "let", "const", "function", "return", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "new", "this", "typeof",
    "instanceof", "in", "of", "try", "catch", "finally", "throw", "delete", "void", "true", "false", "null", "undefined", "class", "extends", "super",
    "import", "export", "default", "from", "async", "await", "yield", "with", "debugger",
)
HEX_ESCAPE = r"\\x([0-9a-fA-F]{2})"
UNICODE_ESCAPE = r"\\u([0-9a-fA-F]{4})"
UNICODE_BRACE = r"\\u\{([0-9a-fA-F]{1,6})\}"
CHAR_CODE = r"(?i)String\s*\.\s*fromCharCode\s*\(([^)]+)\)"
BASE64_BLOB = r"[A-Za-z0-9+/]{40,}={0,2}"
IDENTIFIER = r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\b"
JSFUCK = r"[\[\]()!+]{50,}"
JJENCODE = r"\$=~\[\];"
AAENCODE = "[\u0ff9\u0e4f\u2299]"
CONCATENATION = r"""(["'])((?:\\.|(?!\1)[^\\])*)\1\s*\+\s*(["'])((?:\\.|(?!\3)[^\\])*)\3"""


# --- threats, native ----------------------------------------------------------------------------------------------


def threats(nodes: DataFrame, source: Column, *keys: str) -> DataFrame:
    """(keys, pattern, description, severity, context): the first match of each named pattern, in table order.

    Every pattern becomes an expression of one projection, so a text is read once and nothing is joined.
    """
    source = F.coalesce(source, F.lit(""))

    def one(k: int) -> Column:
        severity, pattern, name, words = THREATS[k]
        hit = F.regexp_substr(source, F.lit(pattern))
        return F.when(
            hit.isNotNull(),
            F.struct(F.lit(k).alias("ord"), F.lit(name).alias("pattern"), F.lit(words).alias("description"), F.lit(severity).alias("severity"), hit.alias("hit")),
        )

    found = nodes.select(*keys, source.alias("__source"), F.array_compact(F.array(*[one(k) for k in range(len(THREATS))])).alias("__found"))
    first = F.filter("__found", lambda x, i: F.array_position(F.transform("__found", lambda y: y["pattern"]), x["pattern"]) == i + 1)
    at = F.instr(F.col("__source"), F.col("t.hit"))
    begin = F.greatest(at - 31, F.lit(0))
    context = F.substring(F.col("__source"), begin + 1, at - 1 + F.length("t.hit") + 30 - begin)
    return found.select(*keys, "__source", F.explode(first).alias("t")).select(
        *keys, "t.ord", "t.pattern", "t.description", "t.severity", F.trim(F.replace(context, F.lit("\n"), F.lit(" "))).alias("context")
    )


def kill_chains(found: DataFrame, *keys: str) -> DataFrame:
    """Whether download, write and execute parts all occur, for each key with a threat."""
    part = lambda names: F.bool_or(F.col("pattern").isin(*names))
    return found.groupBy(*keys).agg((part(DOWNLOAD) & part(WRITE) & part(EXECUTE)).alias("kill_chain"), F.min("severity").alias("severity"))


def library(source: Column) -> Column:
    """The first banner found in the first 2000 characters, or null."""
    head = F.substring(source, 1, 2000)
    return F.coalesce(*[F.when(head.rlike(p), F.lit(name)) for p, name in LIBRARIES])


def folded_strings(source: Column, passes: int = 10) -> Column:
    """Adjacent literals joined, so often as needed up to passes."""
    for _ in range(passes):
        source = F.regexp_replace(source, CONCATENATION, "$1$2$4$1")
    return source


def fragmented_apis(source: Column) -> Column:
    """Names that appear only once literals are joined."""
    folded = F.lower(folded_strings(source))
    hidden = lambda a: F.contains(folded, F.lit(a.lower())) & ~F.contains(F.lower(source), F.lit(a.lower()))
    return F.array_compact(F.array(*[F.when(hidden(a), F.lit(a)) for a in FRAGMENTED]))


#: Kinds of scripts by what their names end in.
NAMED_KINDS = ((".jse", "JScript Encoded"), (".hta", "HTML Application"), (".wsf", "Windows Script File"))
LIBRARY_KIND, PLAIN_KIND = "JavaScript library: {}", "JavaScript"


def script_type(filename: Column, source: Column) -> Column:
    lower, lib = F.lower(F.coalesce(filename, F.lit(""))), library(source)
    kind = F.when(F.contains(source, F.lit("#@~^")), F.lit(NAMED_KINDS[0][1]))
    for ending, name in NAMED_KINDS:
        kind = kind.when(lower.endswith(ending), F.lit(name))
    return kind.when(lib.isNotNull(), F.replace(F.lit(LIBRARY_KIND), F.lit("{}"), lib)).otherwise(F.lit(PLAIN_KIND))


def kind_of(filename: str | None, encoded: bool, lib: str | None) -> str:
    """The same for one script."""
    by_name = next((name for ending, name in NAMED_KINDS if (filename or "").lower().endswith(ending)), None)
    return NAMED_KINDS[0][1] if encoded else by_name or (LIBRARY_KIND.format(lib) if lib else PLAIN_KIND)


def base64_severity(raw: Column) -> Column:
    """By what a payload begins with: an executable, an archive, anything else."""
    first = F.hex(F.substring(raw, 1, 4))
    return F.when(first.startswith("4D5A") | (first == "7F454C46"), 0).when(first.startswith("504B"), 1).otherwise(2)


# --- scanners -----------------------------------------------------------------------------------------------------

#: Literals and comments in one pass: a literal hides comment marks, a comment hides quotes.
TOKEN = re.compile(
    r"""(?P<quote>["'`])(?P<body>(?:\\.|(?!(?P=quote))[^\\])*+)(?P<close>(?P=quote)|\\?\Z)|//(?P<line>[^\n]*)|/\*(?P<block>.*?)(?P<end>\*/|\Z)""",
    re.S,
)


def scan(source: str) -> tuple[str, list[str], list[str]]:
    """(source without comments, comments, literals).  Escapes in literals stay as they are; open literals are left out."""
    plain, comments, literals, at = [], [], [], 0
    for m in TOKEN.finditer(source):
        plain.append(source[at : m.start()])
        at = m.end()
        if m["quote"]:
            plain.append(m[0])
            if m["close"] == m["quote"]:
                literals.append(m["body"])
        elif m["line"] is not None:
            comments.append(m["line"].strip())
        else:
            comments.append(m["block"].strip())
            plain.append(" ")
    plain.append(source[at:])
    return "".join(plain), comments, literals


def unescape(text: str) -> str:
    """\\xNN, \\uNNNN and \\u{N} as characters; numbers beyond Unicode stay as they are."""

    def char(m: re.Match) -> str:
        code = int(m[1] or m[2] or m[3], 16)
        return chr(code) if code < 0x110000 else m[0]

    return re.sub(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", char, text)


def char_codes(source: str) -> list[tuple[str, str]]:
    """(call, text) of fromCharCode calls with decimal or hexadecimal numbers; calls with others are passed over."""
    out = []
    for m in re.finditer(CHAR_CODE, source):
        try:
            out.append((m[0], "".join(chr(int(a, 16 if a.lower().startswith("0x") else 10)) for a in map(str.strip, m[1].split(",")) if a)))
        except (ValueError, OverflowError):
            pass
    return out


def base64_blobs(literals: list[str]) -> list[tuple[str, bytes]]:
    out = []
    for m in (m for lit in literals for m in re.finditer(BASE64_BLOB, lit)):
        try:
            raw = base64.b64decode(m[0], validate=True)
        except binascii.Error:
            continue
        if raw:
            out.append((m[0], raw))
    return out


# Types are objects, not text: workers import this module, and only a driver can parse types.
_RATIOS = ("avg_line_length", "string_literal_ratio", "comment_ratio", "single_char_identifier_ratio")
_MEASURES = (
    "total_length", "line_count", "max_line_length", "avg_line_length", "string_literal_ratio", "comment_ratio",
    "hex_escape_count", "unicode_escape_count", "from_char_code_count", "eval_count", "base64_blob_count",
    "single_char_identifier_ratio",
)
METRICS = T.StructType([T.StructField(n, T.DoubleType() if n in _RATIOS else T.IntegerType()) for n in _MEASURES])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def measure(source: str) -> dict:
    lines = source.splitlines()
    _, comments, literals = scan(source)
    names = [x for x in re.findall(IDENTIFIER, source) if x not in KEYWORDS]
    n = max(len(source), 1)
    return {
        "total_length": len(source),
        "line_count": len(lines),
        "max_line_length": max(map(len, lines), default=0),
        "avg_line_length": sum(map(len, lines)) / max(len(lines), 1),
        "string_literal_ratio": sum(map(len, literals)) / n,
        "comment_ratio": sum(map(len, comments)) / n,
        "hex_escape_count": len(re.findall(HEX_ESCAPE, source)),
        "unicode_escape_count": len(re.findall(UNICODE_ESCAPE, source)) + len(re.findall(UNICODE_BRACE, source)),
        "from_char_code_count": len(re.findall(CHAR_CODE, source)),
        "eval_count": len(re.findall(r"\beval\s*\(", source)),
        "base64_blob_count": len(base64_blobs(literals)),
        "single_char_identifier_ratio": sum(len(x) == 1 for x in names) / max(len(names), 1),
    }


@F.pandas_udf(METRICS)
def metrics(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(s or "") for s in source])


@F.pandas_udf(T.ArrayType(T.StringType()))
def string_literals(source: pd.Series) -> pd.Series:
    return source.map(lambda s: scan(s or "")[2])


@F.pandas_udf(_struct(plain=T.StringType(), comments=T.ArrayType(T.StringType())))
def without_comments(source: pd.Series) -> pd.DataFrame:
    found = [scan(s or "") for s in source]
    return pd.DataFrame({"plain": [p for p, _, _ in found], "comments": [c for _, c, _ in found]})


@F.pandas_udf(T.StringType())
def unescaped(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else unescape(s))


@F.pandas_udf(T.ArrayType(_struct(call=T.StringType(), text=T.StringType())))
def decoded_char_codes(source: pd.Series) -> pd.Series:
    return source.map(lambda s: [{"call": c, "text": t} for c, t in char_codes(s or "")])


@F.pandas_udf(T.ArrayType(_struct(blob=T.StringType(), raw=T.BinaryType())))
def decoded_base64(source: pd.Series) -> pd.Series:
    return source.map(lambda s: [{"blob": b, "raw": r} for b, r in base64_blobs(scan(s or "")[2])])


@dataclass(frozen=True)
class Sign:
    """A sign of obfuscation: a metric above or below a bound, where the other least values hold too; its points and
    what is told of it, with the metric's value."""

    metric: str
    points: int
    words: str
    above: float | None = None
    below: float | None = None
    least: tuple[tuple[str, int], ...] = ()
    share: bool = False


# Bounds and points.
SIGNS = (
    Sign("max_line_length", 15, "The longest line has {} characters", above=5000),
    Sign("comment_ratio", 10, "Long lines and hardly a comment", below=0.01, least=(("max_line_length", 500), ("total_length", 500))),
    Sign("string_literal_ratio", 15, "String literals make up {} of the source", above=0.60, share=True),
    Sign("hex_escape_count", 15, "{} hexadecimal escapes", above=20),
    Sign("from_char_code_count", 15, "fromCharCode is called {} times", above=3),
    Sign("eval_count", 10, "eval is called {} times", above=2),
    Sign("single_char_identifier_ratio", 10, "Single letters make up {} of the identifiers", above=0.50, least=(("total_length", 500),), share=True),
)
ENCODINGS = ((JSFUCK, "JSFuck"), (JJENCODE, "JJEncode"), (AAENCODE, "AAEncode"))
ENCODING_POINTS, LIBRARY_POINTS = 40, -15
ENCODED, KNOWN = "Written in {}", "Part of a known library: {}"


def obfuscation(m: Column, source: Column) -> Column:
    """(score, indicators) from metrics and source; the score is 0 to 100."""
    rules = []
    for sign in SIGNS:
        value = m[sign.metric]
        holds = value > sign.above if sign.above is not None else value < sign.below
        for metric, least in sign.least:
            holds = holds & (m[metric] > least)
        shown = F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%")) if sign.share else value.cast("string")
        rules.append((holds, sign.points, F.replace(F.lit(sign.words), F.lit("{}"), shown)))
    rules += [(source.rlike(form), ENCODING_POINTS, F.lit(ENCODED.format(name))) for form, name in ENCODINGS]
    points = F.lit(0)
    for holds, n, _ in rules:
        points = points + F.when(holds, n).otherwise(0)
    known = library(source)
    points = F.when(known.isNotNull(), F.greatest(points + LIBRARY_POINTS, F.lit(0))).otherwise(points)
    words = F.array_compact(F.array(*[F.when(h, w) for h, _, w in rules], F.replace(F.lit(KNOWN), F.lit("{}"), known)))
    return F.struct(F.least(points, F.lit(100)).alias("score"), words.alias("indicators"))


def score(m: dict, source: str, lib: str | None) -> tuple[int, list[str]]:
    """The same for one source."""
    found = []
    for sign in SIGNS:
        value = m[sign.metric]
        if (value > sign.above if sign.above is not None else value < sign.below) and all(m[k] > least for k, least in sign.least):
            found.append((sign.points, sign.words.format(f"{math.floor(value * 100 + 0.5)}%" if sign.share else value)))
    found += [(ENCODING_POINTS, ENCODED.format(name)) for form, name in ENCODINGS if re.search(form, source)]
    points, signs = sum(n for n, _ in found), [words for _, words in found]
    if lib:
        points, signs = max(0, points + LIBRARY_POINTS), [*signs, KNOWN.format(lib)]
    return min(points, 100), signs


def score_severity(score: Column) -> Column:
    return F.when(score >= 81, 0).when(score >= 61, 1).when(score >= 41, 2).when(score >= 21, 3).otherwise(4)


# --- encoded scripts ----------------------------------------------------------------------------------------------

# What the capitals, small letters and digits of an encoded script stand for.
JSE_CAPITALS = (
    0x64, 0x37, 0x69, 0x50, 0x7E, 0x2C, 0x22, 0x5A, 0x65, 0x4A, 0x45, 0x72, 0x61, 0x28, 0x5B, 0x5C, 0x3D, 0x48, 0x66,
    0x75, 0x55, 0x63, 0x44, 0x74, 0x6A, 0x59,
)
JSE_SMALL = (
    0x35, 0x68, 0x39, 0x76, 0x42, 0x73, 0x24, 0x4C, 0x23, 0x5F, 0x49, 0x52, 0x4B, 0x54, 0x43, 0x67, 0x38, 0x71, 0x6E,
    0x6D, 0x34, 0x4F, 0x57, 0x53, 0x7D, 0x46,
)
JSE_DIGITS = (0x2A, 0x7C, 0x21, 0x25, 0x7B, 0x30, 0x29, 0x36, 0x6C, 0x6F)
_JSE_TABLE = bytes.maketrans(
    (string.ascii_uppercase + string.ascii_lowercase + string.digits).encode(), bytes(JSE_CAPITALS + JSE_SMALL + JSE_DIGITS)
)


def decode_encoded_script(raw: bytes) -> bytes | None:
    """The body between the marks of an encoded script, its letters exchanged, or null if there is none.

    A sign after @ stands for itself.
    """
    m = re.search(rb"#@~\^.*?==(.*?)==\^#~@", raw, re.S)
    if not m:
        return None
    return b"".join(part[1:] if part[:1] == b"@" else part.translate(_JSE_TABLE) for part in re.findall(rb"@.?|[^@]+", m[1], re.S))


@F.pandas_udf(T.BinaryType())
def decoded_script(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: None if raw is None else decode_encoded_script(raw))


def decode_text(raw: bytes) -> tuple[str, str]:
    """(text, encoding) by byte-order mark, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name.removesuffix("-sig"), "replace"), name
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("latin-1"), "latin-1"


@F.pandas_udf(_struct(text=T.StringType(), encoding=T.StringType()))
def decoded_text(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_text(raw or b"") for raw in content], columns=["text", "encoding"])


def first_threats_ranked(found: DataFrame, *keys: str, n: int) -> DataFrame:
    """The n worst threats of each key."""
    order = Window.partitionBy(*keys).orderBy("severity", "ord")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
