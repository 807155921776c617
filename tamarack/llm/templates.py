"""Main text of web pages by template deduction over equivalence classes (operator 3).

A token of a page is a block element in its place: its name, class and the places above
it.  Tokens of one host which occur equally often on each of its pages share an occurrence
vector and form an equivalence class.  Vectors are never laid out: every page adds (by
exclusive or) a hash of itself and the token's count, so equal vectors have equal sums, and
sums from all tasks meet in one small row for a host and token.  Pages count by their
content, each once: copies would cancel out, and would make an article look like a template.
Classes found on enough pages are valid.  A class is nested into the template if all places
above its tokens are the template's as well; a token's own text is template text if it
never changes.  What remains between them are the slots, and the article is read from those
which no menu, header, footer, sidebar, notice, advert, form or comment section holds.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import durable, map_arrow, pieces, read

#: A class is valid if it has so many tokens, or is equally often on every page, and if it stands on this share of a host's different pages, and so many at least.
LEAST_TOKENS, LEAST_SHARE, LEAST_PAGES = 2, 0.5, 4
#: Up to so many template places of all hosts they are sent to the workers, 8 bytes each;
#: beyond that, hosts are joined, and the pages of a host are dealt into so many pieces.
SENT_PLACES, SALTS = 2_000_000, 16

#: Element names by what they mean for the text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog head fieldset figcaption".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of class names, ids and roles which mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer footnav form gdpr header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices overlay pagination pager popup promo promoted promotion related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget complementary contentinfo".split()
)
MAIN_MARKS = frozenset(("main", "article"))
#: Elements whose own marks tell of the page's parts or layout; an article's do so if no other article holds it.
HOLDERS = frozenset("html body main".split())
#: How a block stands: in the text, under a mark outside any article, in boilerplate.
IN, MARKED, OUT = 0, 1, 2

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>|[!?/][^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _mix(a: int, b: int) -> int:
    x = (a * 0x9E3779B97F4A7C15 + b + 0x632BE59BD9B4E019) & tv._MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & tv._MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & tv._MASK
    return x ^ x >> 31


def _stable(text: str) -> int:
    import zlib

    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


_names: dict[str, int] = {}


def _attributes(raw: str) -> tuple[str, bool, bool, bool]:
    """The class and id as part of the place, whether they hide, mark boilerplate, or the article."""
    key, hidden, out, main = "", False, False, False
    for name, *values in _ATTRIBUTE.findall(raw):
        value, name = "".join(values), name.lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
            continue
        if name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value.lower() == "true"
            continue
        words = set(_WORD.findall(_SPLIT_CASE.sub(" ", value).lower()))
        out |= bool(words & MARKS)
        main |= name == "role" and bool(words & MAIN_MARKS)
        if name != "role":
            key += "." + value
    return key, hidden, out, main


def blocks(page: str, valid: frozenset[int] = frozenset()) -> tuple[list[tuple[int, str, int, bool, bool]], Counter]:
    """Blocks (place, text, standing, article, nested) in page order, and how often each place occurs.

    A place is a hash of the block elements around a text.  A block is nested in the template if
    its place and all places above it are ``valid``.  Comments, markup, scripts and
    the like are no text; character references are decoded.
    """
    found: list[tuple[int, str, int, bool, bool]] = []
    counts: Counter = Counter()
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, IN, False, True)]
    opened: Counter = Counter()
    held: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                _, place, out, main, nested = stack[-1]
                found.append((place, text, out, main, nested))

    def close(name: str) -> None:
        if opened[name]:
            while True:
                top = stack.pop()[0]
                opened[top] -= 1
                if top == name:
                    return

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            held.append(page[at:])
            break
        if begin > at:
            held.append(page[at:begin])
        m = _TAG.match(page, begin)
        if not m:
            # A tag cut off by the page's end is no text; a lone "<" is.
            if begin + 1 < size and (page[begin + 1].isalpha() or page[begin + 1] in "/!?") and page.find(">", begin) < 0:
                break
            held.append("<")
            at = begin + 1
            continue
        at = m.end()
        end, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not end:
            flush() if name not in ("button", "select") else held.append(" ")
            over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at) if not raw.endswith("/") else None
            at = over.end() if over else at if raw.endswith("/") else size
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        if end:
            close(name)
            continue
        if name in ENDS_PARAGRAPH and opened["p"]:
            close("p")
        elif name in CLOSES:
            for other in CLOSES[name]:
                if opened[other] and stack[-1][0] == other:
                    close(other)
        key, hidden, marked, main = _attributes(raw) if raw else ("", False, False, False)
        _, above, was_out, was_main, was_nested = stack[-1]
        number = _names.get(name + key)
        if number is None:
            number = _stable(name + key)
            if len(_names) < 100_000:
                _names[name + key] = number
        place = _mix(above, number)
        counts[place] += 1
        if name not in VOID and not raw.endswith("/"):
            holds = name in HOLDERS or ((name == "article" or main) and not opened["article"])
            out = OUT if hidden or name in BOILERPLATE else IN if holds or not marked else OUT if was_main else MARKED
            stack.append((name, place, max(was_out, out), was_main or main or name in MAIN_MARKS, was_nested and place in valid))
            opened[name] += 1
    flush()
    return found, counts


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def contents(pages: DataFrame) -> DataFrame:
    """host, number, html of each content which a host has, once; only copies' html is shuffled."""
    rows = pages.select("host", "html", F.xxhash64("html").alias("number"), F.length("html").alias("size"))
    key = ["host", "number", "size"]
    copied = durable(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    once = rows.join(copied, key, "left_anti")
    copies = rows.join(copied, key, "left_semi").groupBy(key).agg(F.min("html").alias("html"))
    return once.select("host", "number", "html").unionByName(copies.select("host", "number", "html"))


def deduce(pages: DataFrame) -> DataFrame:
    """host, valid, fixed: the places of each host's valid classes, and those of them whose text never changes.

    ``pages`` has host and html; a host needs ``LEAST_PAGES`` different pages at least.
    """

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[str, int], list] = {}

        def rows():
            keys = list(held)
            columns = [[k[0] for k in keys], [_signed(k[1]) for k in keys], *[[_signed(held[k][i]) for k in keys] for i in range(6)]]
            out = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["host", "place", "vector", "pages", "least", "most", "few", "many"])
            held.clear()
            return out

        for batch in batches:
            for name, number, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found, counts = blocks(page)
                texts: dict[int, list[str]] = {}
                for place, text, *_ in found:
                    texts.setdefault(place, []).append(text)
                whole = _stable("\n".join(t for _, t, *_ in found)) >> 1
                counts[0] = 1  # the page itself
                for place, n in counts.items():
                    text = whole if place == 0 else _stable("\n".join(texts.get(place, ()))) >> 1
                    row = held.setdefault((name, place), [0, 0, text, text, n, n])
                    row[0] ^= _mix(number & tv._MASK, n)
                    row[1] += 1
                    row[2], row[3] = min(row[2], text), max(row[3], text)
                    row[4], row[5] = min(row[4], n), max(row[5], n)
                if len(held) > 200_000:
                    yield rows()
        if held:
            yield rows()

    sums = map_arrow(contents(pages), run, "host string, place bigint, vector bigint, pages bigint, least bigint, most bigint, few bigint, many bigint")
    sums = sums.groupBy("host", "place").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("few").alias("few"), F.max("many").alias("many"))
    sums = durable(sums)
    whole = sums.filter("place = 0 AND least < most").select("host", F.col("pages").alias("all"))
    tokens = sums.filter("place <> 0")
    even = F.min(F.col("few") == F.col("many")).alias("even")
    classes = tokens.groupBy("host", "vector", "pages").agg(F.count("*").alias("tokens"), even)
    good = classes.join(whole, "host").filter(((F.col("tokens") >= LEAST_TOKENS) | (F.col("even") & (F.col("pages") == F.col("all")))) & (F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("all") * LEAST_SHARE)))
    places = tokens.join(good.select("host", "vector", "pages"), ["host", "vector", "pages"], "left_semi")
    # A host's template is as long as its pages have different places on half of them.
    return places.groupBy("host").agg(F.collect_list("place").alias("valid"), F.collect_list(F.when(F.col("least") == F.col("most"), F.col("place"))).alias("fixed"))


Template = tuple[frozenset[int], frozenset[int]]
NO_TEMPLATE: Template = (frozenset(), frozenset())


def main_text(page: str, template: Template = NO_TEMPLATE) -> str:
    """Blocks of the article which the template doesn't hold, one a line.

    A page without an article element is read from all slots that aren't boilerplate.  An
    article below marked elements is read if nothing else of the page is as long.
    """
    valid, fixed = template
    found, _ = blocks(page, valid)
    slots = [(text, out, main) for place, text, out, main, nested in found if out != OUT and not (nested and place in fixed)]
    kept = [text for text, out, main in slots if out == IN and main]
    if not kept:
        kept = [text for text, out, _ in slots if out == IN]
        held = [text for text, out, main in slots if out == MARKED and main]
        if sum(map(len, held)) > sum(map(len, kept)):
            kept = held
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article's text of each page: id, url and text.

    One row per input row.  A null page is empty and has an empty text; pages without a url
    or with one that names no host share the empty host; a host with few different
    pages has no template, and is read by its elements alone; repeated
    rows give repeated results and count once for the template; very long pages are read whole; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("link"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host(F.col("link")))
    kind = dict(rows.dtypes)["key"]
    templates = durable(deduce(rows))
    sent = None
    if (templates.agg(F.sum(F.size("valid") + F.size("fixed") + 10)).head()[0] or 0) <= SENT_PLACES:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (_places(r["valid"]), _places(r["fixed"])) for r in templates.collect()})
        rows = rows.select("key", "link", "html", "host")
    else:
        templates = templates.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", "link", "html"), F.lit(SALTS)).cast("int"))
        rows = rows.join(templates, ["host", "salt"], "left").select("key", "link", "html", F.struct("valid", "fixed").alias("template"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in pieces(batch):
                part, texts = batch.slice(a, b - a), []
                for page, where in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    template = sent.value.get(where, NO_TEMPLATE) if sent is not None else (_places(where["valid"]), _places(where["fixed"]))
                    texts.append(main_text(page, template))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], names=["key", "link", "text"])

    done = map_arrow(rows, run, f"key {kind}, link string, text string")
    return done.select(F.col("key").alias(id_col), F.col("link").alias(url_col), "text")


def _places(places: list[int] | None) -> frozenset[int]:
    return frozenset(p & tv._MASK for p in places or ())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
