"""HTML main text by equivalence-class template deduction.

Tokens of a page are its element paths and its text blocks.  Within a host, tokens with
the same occurrence vector (so many times on this page, so many on that) form an
equivalence class; classes that are large and frequent enough are made by the template
and not by chance.  The class that occurs once on every page is the template's skeleton,
the others are nested under the nearest enclosing element.  What lies between template
tokens are slots.  A slot is main text when it lies in an article or, where the template
has no article, in no boilerplate element; outside articles, blocks that belong to the
template themselves are constant text and dropped.

Vectors are never gathered: per (host, token) an exclusive or of hashes of (page, count)
is combined before the shuffle, so a host with a third of the pages is no larger group
than another.

Defined results: null and empty html has empty text; a null or odd url is a host of its
own kind (the empty name); a page whose host has no template, or whose template slots
hold nothing on it, is judged by its own elements; truncated markup is read as far as it
goes; repeated rows each have their own result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from coursemine.llm.common import cut
from coursemine.operators.ranking import is_small

MIN_PAGES = 3
MIN_CLASS = 2
# Text on more than this share of a host's pages is constant.
CONSTANT_SHARE = 0.5
BROADCAST_HOSTS = 100_000
# Elements by what they mean for the main text.
RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset("""
math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover
mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml
""".split())
ARTICLE = frozenset("article main".split())
BOILERPLATE = frozenset("nav header footer aside form button menu dialog fieldset head".split())
BOILERPLATE_NAMES = frozenset("""
ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies copyright
disqus footer header login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup
promo promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget
""".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<svg(?=[\s/])(?:[^\"'>]|\"[^\"]*\"|'[^']*')*/>"
    rf"|<(?P<raw>{RAW})(?=[\s/>]|\Z).*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^"'>]|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.I | re.S,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def _element(tag: str, rest: str) -> str:
    """Element as it stands in a path: its name, and the names that its class, id and role are made of."""
    names = [w for _, value in NAMES.findall(rest) for w in re.split(r"[^a-z]+", value.strip("\"'").lower()) if w]
    return ".".join([tag, *dict.fromkeys(names)])


def blocks(page: str) -> Iterator[tuple[str, str | None]]:
    """(path, text) of every text block and (path, None) of every opened block element, in page order.

    Inline elements are not part of a path and do not end a block.
    """
    stack: list[tuple[str, str]] = []
    held: list[str] = []

    def path() -> str:
        return ">".join(e for _, e in stack)

    def flush() -> Iterator[tuple[str, str | None]]:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            yield path(), text

    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            held.append(html.unescape(m["text"]))
        elif m["tag"] is None:
            continue
        elif (tag := m["tag"].lower()) in INLINE:
            held.append(" " if tag == "br" else "")
        elif tag in VOID:
            yield from flush()
        elif m["end"]:
            yield from flush()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
        else:
            yield from flush()
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY_SIBLING.get(tag, ())):
                stack.pop()
            stack.append((tag, _element(tag, m["rest"])))
            yield path(), None
    yield from flush()


def role(path: str) -> str:
    """'drop', 'article' or 'other' by what the elements of a path mean."""
    found = "other"
    for element in path.split(">"):
        tag, *names = element.split(".")
        if tag in BOILERPLATE or BOILERPLATE_NAMES.intersection(names):
            return "drop"
        found = "article" if tag in ARTICLE else found
    return found


def _long(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


PAGE = "#page"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, token, path (null for text), page, times: the distinct tokens of each page."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for host, page, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            seen = Counter((path if text is None else None, path if text is None else f"{path}={text}") for path, text in blocks(source.as_py() or ""))
            seen[(PAGE, PAGE)] = 1
            for (path, token), n in seen.items():
                for column, value in zip(out, (host, _long(token), path, page, n)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["host", "token", "path", "page", "times"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, slots (paths of the template), constants (hashes of its texts) from rows of host, page, html."""
    rows = pages.select("host", "page", "html").mapInArrow(_tokens, "host string, token long, path string, page long, times long")
    tokens = cut(rows.groupBy("host", "token").agg(
        F.first("path").alias("path"), F.count(F.lit(1)).alias("support"),
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.max("times").alias("most")))
    n_pages = tokens.filter(F.col("path") == PAGE).select("host", F.col("support").alias("pages"))
    classes = tokens.filter(F.col("support") >= MIN_PAGES).groupBy("host", "support", "vector").agg(F.count(F.lit(1)).alias("size"))
    valid = classes.filter(F.col("size") >= MIN_CLASS)
    members = tokens.join(valid, ["host", "support", "vector"]).join(n_pages, "host")
    everywhere = F.col("support") > CONSTANT_SHARE * F.col("pages")
    return members.groupBy("host").agg(
        F.collect_set(F.when(F.col("path") != PAGE, F.col("path"))).alias("slots"),
        F.collect_set(F.when(F.col("path").isNull() & everywhere, F.col("token"))).alias("constants"),
    )


def main_blocks(page: str, slots: list[str] | None, constants: list[int] | None) -> list[str]:
    """Texts of the main slots of a page."""
    found = [(path, text) for path, text in blocks(page) if text is not None]
    if slots:
        roles = {s: role(s) for s in slots}
        wanted = "article" if "article" in roles.values() else "other"
        fixed = set(constants or ())
        out = []
        for path, text in found:
            slot = path
            while slot and slot not in roles:
                slot = slot.rpartition(">")[0]
            # Below its slot the path may still enter an element that is no main text.
            if roles.get(slot, "other") == wanted and role(path) != "drop":
                if wanted == "article" or _long(f"{path}={text}") not in fixed:
                    out.append(text)
        if out:
            return out
    roles = [role(path) for path, _ in found]
    wanted = "article" if "article" in roles else "other"
    return [text for (_, text), r in zip(found, roles) if r == wanted]


def extract(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``pages`` with ``main_text`` (blocks joined by an empty line); templates of a few hosts go to every task."""
    rows = pages.select("*", host_of(F.col(url)).alias("__host"))
    numbered = rows.select(F.col("__host").alias("host"), F.monotonically_increasing_id().alias("page"), F.col(source).alias("html"))
    found = cut(templates(numbered)).withColumnRenamed("host", "__of")
    found = F.broadcast(found) if is_small(found, BROADCAST_HOSTS) else found
    rows = rows.join(found.select("__of", F.col("slots").alias("__slots"), F.col("constants").alias("__constants")), F.col("__host") == F.col("__of"), "left")

    @F.arrow_udf("string")
    def run(sources: pa.Array, slots: pa.Array, constants: pa.Array) -> pa.Array:
        return pa.array([
            "\n\n".join(main_blocks(s.as_py() or "", t.as_py(), c.as_py())) for s, t, c in zip(sources, slots, constants)
        ], pa.string())

    return rows.select(*pages.columns, run(F.col(source), F.col("__slots"), F.col("__constants")).alias("main_text"))
