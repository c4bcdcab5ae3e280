"""Main text of web pages by wrappers: union-free expressions inferred from the token streams of a host's pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .urls import parts

#: Elements whose content is never text of the page.
RAW = frozenset("noscript template iframe object svg canvas textarea select button".split())
#: A second one inside the first closes it.
FLAT = frozenset("textarea select button".split())
#: Where a RAW element without a close tag ends, if not at the close of an element around it.
BLOCKS = frozenset(
    "address article aside blockquote body details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section table ul".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)(?![^\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd mark q s samp small span strong sub sup time u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Regions that are not main text wherever they stand.
ASIDE = frozenset("nav footer aside form head dialog menu".split())
#: Elements that are the page, its main text, or a piece of text; no class, id or role makes them such a region.
TEXTUAL = frozenset("html body main article p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th".split()) | INLINE
#: Words of class, id or role that mark such a region, where one of these consists of them.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies "
    "consent disqus footer form header login menu nav navbar navigation newsletter notice notices notification popup "
    "promo promoted related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget complementary".split()
)
#: What a wrapper's main element is, best first.
MAIN = ("<article", "<main", "role=main", "content", "body")


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, value): open and close tags with their class, id and role, and decoded texts."""
    out = []
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            out.append(("text", "", html.unescape(m["text"])))
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                out.append(("close", name, ""))
            else:
                marks = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in _NAMED.findall(m["rest"]))
                out.append(("open", name, marks.lower()))
                if m["rest"].endswith("/") and name not in VOID and name not in INLINE:
                    out.append(("close", name, ""))
    return without_raw(out)


def without_raw(own: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """``own`` without RAW elements. One without its own close tag inside the element around it ends at the next block."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}

    def pop(name: str) -> int:
        while True:
            last, at = stack.pop()
            count[last] -= 1
            if last == name:
                return at

    for at, (kind, name, _) in enumerate(own):
        if kind == "open" and name not in VOID:
            if name in FLAT and count.get(name):
                pop(name)
            stack.append((name, at))
            count[name] = count.get(name, 0) + 1
        elif kind == "close" and count.get(name):
            ends[pop(name)] = at
    starts = {end: at for at, end in ends.items()}
    out, at = [], 0
    while at < len(own):
        kind, name, _ = own[at]
        if kind == "text" or name not in RAW:
            out.append(own[at])
            at += 1
        elif kind == "close":
            at += 1
        elif at in ends:
            at = ends[at] + 1
        else:
            first, at = at, at + 1
            while at < len(own) and own[at][1] not in BLOCKS and own[at][1] not in RAW and starts.get(at, first) >= first:
                at += 1
    return out


def stream(page: str) -> list[str]:
    """The page as wrapper tokens: block tags with their marks, and ``#`` for a text slot (inline tags belong to texts)."""
    out: list[str] = []
    for kind, name, value in tokens(page):
        if kind == "text":
            if value.strip() and (not out or out[-1] != "#"):
                out.append("#")
        elif name not in INLINE:
            out.append(f"</{name}>" if kind == "close" else f"<{name}{' ' + value if value else ''}>")
    return fold(out)


def fold(items: list[str], widest: int = 12) -> list[str]:
    """Squares become repeated groups: equal neighbours of up to ``widest`` items turn into one ``(…)+``."""
    changed = True
    while changed:
        changed = False
        for width in range(1, widest + 1):
            out: list[str] = []
            at = 0
            while at < len(items):
                group = items[at : at + width]
                times = 1
                while len(group) == width and items[at + times * width : at + (times + 1) * width] == group:
                    times += 1
                if times > 1:
                    out.append("(" + " ".join(group) + ")+")
                    at += times * width
                    changed = True
                elif out and out[-1] == "(" + " ".join(group) + ")+" and len(group) == width:
                    at += width
                    changed = True
                else:
                    out.append(items[at])
                    at += 1
            items = out
    return items


def align(wrapper: list[str], other: list[str]) -> list[str]:
    """The least general union-free expression found that takes in both: what one side lacks becomes optional."""
    plain = [x.removesuffix("?") for x in wrapper]
    bare = [x.removesuffix("?") for x in other]
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, plain, bare, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [p + "?" * (w.endswith("?") or o.endswith("?")) for p, w, o in zip(plain[a:b], wrapper[a:b], other[c:d])]
        else:
            out += [p + "?" for p in plain[a:b]] + [p + "?" for p in bare[c:d]]
    return out


def main_element(wrapper: list[str]) -> str:
    """The wrapper's tag that holds the main text: the best kind of element that it has, required ones first."""
    tags = [t for item in wrapper for t in re.findall(r"<[a-z][^>]*>", item)]
    for kind in MAIN[:3]:
        for tag in tags:
            if tag.startswith(kind) or (kind == "role=main" and kind in tag):
                return tag
    for tag in tags:
        if {"content", "post", "entry", "article", "story"} & set(re.split(r"[^a-z]+", tag.partition(" ")[2])):
            return tag
    return "<body>"


def aside(name: str, marks: str) -> bool:
    """Whether an element is no main text: by its name, or where a whole class, id or role says so, word for word."""
    if name in ASIDE:
        return True
    if not marks or name in TEXTUAL:
        return False
    whole = [re.findall(r"[a-z]+", mark.removeprefix("class=").removeprefix("id=").removeprefix("role=")) for mark in marks.split()]
    return any(words and ASIDE_WORDS.issuperset(words) for words in whole)


def tag(name: str, marks: str) -> str:
    return f"<{name}{' ' + marks if marks else ''}>"


def regions(own: list[tuple[str, str, str]], main: str, held: bool = False) -> Iterator[tuple[str, str, str]]:
    """``own`` with every region that is no main text as one ("aside", name, marks).

    The main element is none, and with ``held`` nothing before it is, as it may be around it.
    """
    skipped, depth = "", 0
    for kind, name, value in own:
        if skipped:
            if name == skipped:
                depth += (kind == "open") - (kind == "close")
            if depth == 0 or (name in ("body", "html", "article", "main") and kind == "close" and skipped not in ("article", "main")):
                skipped = ""
                if depth:
                    depth = 0
                else:
                    continue
            else:
                continue
        if kind == "open" and tag(name, value) == main:
            held = False
        elif kind == "open" and not held and name not in VOID and aside(name, value):
            yield "aside", name, value
            skipped, depth = name, 1
            continue
        yield kind, name, value


def extract(page: str, main: str) -> str:
    """Blocks of the host's main element, or of the best element that this page has instead, joined by line ends."""
    own = tokens(page)
    opens = {tag(name, value) for kind, name, value in own if kind == "open"}
    if main not in opens:
        main = main_element([t for t in stream(page)])
    blocks: list[str] = []
    text: list[str] = []

    def end() -> None:
        block = " ".join("".join(text).split())
        if block:
            blocks.append(block)
        text.clear()

    # without any main element everything outside the other regions is main text
    inside = 0 if main in opens else 1
    everywhere = bool(inside)
    wanted = main[1:-1].split(" ")[0]
    # an element around every main element of the page is no region to leave out
    held = main in opens and not any(kind == "open" and tag(name, value) == main for kind, name, value in regions(own, main))
    for kind, name, value in regions(own, main, held):
        if kind == "open" and not inside and tag(name, value) == main:
            inside = 1
            continue
        if kind == "aside":
            end()
            continue
        if not inside:
            continue
        if kind == "text":
            text.append(value)
        elif name in INLINE:
            if name == "br":
                text.append(" ")
        else:
            end()
            if name == wanted and not everywhere:
                inside += 1 if kind == "open" else -1
    end()
    return "\n".join(blocks)


def wrappers(pages: DataFrame, slices: int = 16) -> DataFrame:
    """``(host, wrapper)``: the expression of each host's pages (html, host).

    Pages with equal folded streams are one row before anything meets, so a host of any size sends only its
    different structures on; these are aligned in slices, and the slices' wrappers with each other.
    """

    @F.pandas_udf("string")
    def structure(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "\n".join(stream(t)))

    def merged(key, rows: pd.DataFrame) -> pd.DataFrame:
        both = sorted(rows["wrapper"])
        out = both[0].split("\n")
        for other in both[1:]:
            out = align(out, other.split("\n"))
        return pd.DataFrame({"host": [key[0]], "wrapper": ["\n".join(out)]})

    kinds = pages.select("host", structure("html").alias("wrapper")).distinct()
    kinds = kinds.withColumn("__slice", F.pmod(F.xxhash64("wrapper"), F.lit(slices)))
    some = kinds.groupBy("host", "__slice").applyInPandas(merged, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(merged, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``text``, the main text of the whole page.

    NULL html is empty and gives an empty text. A page without a host, or unlike its host's wrapper, is read by its own
    structure. Repeated rows give equal rows; an empty table gives none. A column ``text`` of the input gives way.
    """
    small_batches(pages.sparkSession, rows=512)
    host, _ = parts(F.col("url"))
    own = pages.withColumn("__html", F.coalesce("html", F.lit(""))).withColumn("__h", host)

    @F.pandas_udf("string")
    def chosen(wrapper: pd.Series) -> pd.Series:
        return wrapper.map(lambda w: main_element(w.split("\n")))

    @F.pandas_udf("string")
    def extracted(texts: pd.Series, main: pd.Series) -> pd.Series:
        return pd.Series([extract(t, m or "<body>") for t, m in zip(texts, main)])

    # one short tag per host; the join is left to the planner and its run-time sizes, which also split a hot host
    mains = wrappers(own.select(F.col("__h").alias("host"), F.col("__html").alias("html"))).select(F.col("host").alias("__host"), chosen("wrapper").alias("__main"))
    out = own.join(mains, own["__h"] == mains["__host"], "left")
    return out.select(*[c for c in pages.columns if c != "text"], extracted("__html", "__main").alias("text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
