"""Plain text: decoding, language, passwords; and HTML read by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions.iocs import let

# Frequent function words by language; words that announce a password.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "sich", "auf", "den", "von", "zu", "im", "dem", "des", "auch", "für", "werden"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "was", "with", "as", "are", "on", "be", "this", "by", "from", "or", "an"),
    "es": ("el", "los", "las", "que", "y", "del", "se", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "más", "pero", "sus", "esta"),
    "it": ("il", "lo", "gli", "della", "di", "che", "non", "per", "sono", "con", "una", "del", "nel", "anche", "come", "più", "alla", "dei", "è", "questo"),
    "nl": ("het", "een", "van", "en", "niet", "zijn", "dat", "met", "voor", "op", "ook", "maar", "naar", "bij", "wordt", "deze", "door", "aan", "uit", "nog"),
    "pl": ("i", "w", "na", "nie", "się", "do", "jest", "że", "z", "to", "jak", "ale", "po", "co", "tak", "przez", "od", "dla", "czy", "tym"),
    "pt": ("os", "as", "não", "uma", "dos", "das", "com", "em", "para", "mais", "foi", "como", "mas", "ao", "ele", "seu", "sua", "são", "também", "pelo"),
    "sv": ("och", "att", "det", "som", "en", "på", "är", "av", "för", "med", "till", "den", "inte", "har", "jag", "ett", "var", "från", "om", "sig"),
    "fr": ("le", "les", "et", "des", "que", "est", "du", "dans", "qui", "pour", "pas", "sur", "au", "avec", "ce", "une", "sont", "aux", "ou", "plus"),
}
PASSWORD_LINE = r"(?i)(?:pw|kennwort|passwor[dt]|password|passcode)\s*[:\-=\s]\s*(\S.*)"
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly")
#: Least characters of a text whose language is told.
LEAST_TEXT = 10


#: Byte-order marks and what they say.
MARKS = (("EFBBBF", "UTF-8", "utf-8"), ("FFFE", "UTF-16LE", "utf-16-le"), ("FEFF", "UTF-16BE", "utf-16-be"))
#: What Windows-1252 has in place of control characters; its five gaps stay as they are.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def decoded(content: Column) -> Column:
    """(text, encoding): by a byte-order mark, else UTF-8 where valid, else Windows-1252."""
    head, said = F.hex(F.substring(content, 1, 3)), None
    made = lambda text, name: F.struct(text.alias("text"), F.lit(name).alias("encoding"))
    utf8 = F.try_validate_utf8(content.cast("string"))
    for mark, charset, name in MARKS:
        n = len(mark) // 2
        rest = F.substring(content, n + 1, 1 << 30)
        if n == 3:
            holds, text = head.startswith(mark) & F.try_validate_utf8(rest.cast("string")).isNotNull(), rest.cast("string")
        else:  # whole pairs of bytes only
            holds, text = head.startswith(mark) & (F.octet_length(content) % 2 == 0) & ~F.hex(rest).rlike("^(....)*D[89A-F]" if charset == "UTF-16BE" else "^(....)*..D[89A-F]"), F.decode(rest, charset)
        said = F.when(holds, made(text, name)) if said is None else said.when(holds, made(text, name))
    single = F.translate(F.decode(content, "ISO-8859-1"), _CONTROLS, _WINDOWS)
    return said.when(utf8.isNotNull(), made(utf8, "utf-8")).otherwise(made(single, "windows-1252"))


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """The same for one text."""
    for mark, _, name in MARKS:
        head = bytes.fromhex(mark)
        if raw.startswith(head):
            try:
                text = raw[len(head) :].decode(name)
                if name == "utf-8" or all(ord(c) < 0x10000 for c in text):
                    return text, name
            except UnicodeDecodeError:
                pass
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("latin-1").translate(dict(zip(map(ord, _CONTROLS), _WINDOWS))), "windows-1252"


def language(text: Column) -> Column:
    """The language with the most frequent function words in the text; ties go by name; null where there is none, or
    the text is short."""

    def best(words: Column) -> Column:
        def hits(stops: tuple[str, ...]) -> Column:
            return F.size(F.filter(words, lambda w: w.isin(*stops)))

        scores = [F.struct(hits(stops).alias("n"), F.lit(-k).alias("rank"), F.lit(lang).alias("lang")) for k, (lang, stops) in enumerate(sorted(STOP_WORDS.items()))]
        return F.array_max(F.array(*scores))

    told = let(let(F.split(F.lower(text), r"[^\p{L}]+"), best), lambda x: F.when(x["n"] > 0, x["lang"]))
    return F.when(F.length(F.trim(text)) >= LEAST_TEXT, told)


def normalized_password(word: Column) -> Column:
    return F.trim(F.btrim(F.trim(word), F.lit("\"'")))


def possible_passwords(text: Column) -> Column:
    """Words of more than three characters after a word that announces a password, on its line; without repeats."""
    rest = F.regexp_extract_all(text, F.lit(PASSWORD_LINE), F.lit(1))
    words = F.flatten(F.transform(rest, lambda r: F.split(r, r"\s+")))
    return F.array_distinct(F.filter(F.transform(words, normalized_password), lambda w: F.length(w) > 3))


def shortened_urls(urls: Column) -> Column:
    """URLs of link shorteners."""
    return F.filter(urls, lambda u: F.lower(u).rlike("|".join(d.replace(".", r"\.") for d in SHORTENERS)))


# --- HTML ---------------------------------------------------------------------------------------------------------

LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)["']?[^>]*>(.*?)</a>"""
IMAGE = r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']?([^"'\s>]+)"""
FORM = r"(?is)<form\b[^>]*>"
ACTION = r"""(?is)\baction\s*=\s*["']?([^"'\s>]+)"""
HIDDEN = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"
TAG = r"(?s)<[^>]*>"
# Named characters that texts commonly hold.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """What a page shows: no scripts, styles, comments or tags, blanks in one."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " ")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_links(html: Column) -> Column:
    """(href, text) of each link, in order."""
    hrefs = F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(LINK), F.lit(2))
    shown = F.transform(texts, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, TAG, " "), r"\s+", " ")))
    return F.arrays_zip(hrefs.alias("href"), shown.alias("text"))


def html_images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(IMAGE), F.lit(1))


def html_forms(html: Column) -> Column:
    """The action of each form; empty where it names none."""
    return F.transform(F.regexp_extract_all(html, F.lit(FORM), F.lit(0)), lambda f: F.regexp_extract(f, ACTION, 1))


def html_scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))


def exploded_links(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """(keys, pos, href, text)."""
    return pages.select(*keys, F.posexplode(html_links(F.col(html))).alias("pos", "link")).select(*keys, "pos", "link.href", "link.text")
