"""Main text of web pages by template deduction from token occurrence vectors.

A page is a sequence of tokens: tags with the path of tags around them, and texts with their
path. Tokens of a host that occur equally often on every page share an occurrence vector and
form an equivalence class. Classes on at least half of a host's pages and of several tokens, in
one order and well nested, make up the host's template: its texts are boilerplate, its tags and
texts part every page into slots. What fills a slot on all pages of the host tells whether it is a
menu or a notice. The main text is the other slots of the article region, without adverts, forms
or comments.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabellion.llm.common import written

#: a template needs so many pages of its host, and a class so many tokens
LEAST_PAGES, LEAST_TOKENS = 8, 3
#: a class is on this share of its host's pages that are not empty
SUPPORT = 0.5
#: a block, or all that fills a slot, is a menu if this share of it is in links
MENU_LINKS = 0.6
#: outside of marked regions a slot is a notice if it has at most so many fillings a page
FEW_FILLINGS = 0.1
#: if so much of a region is template, its pages are copies of one article
COPIES = 0.9
#: stands for a page itself among its tokens, which are not negative
PAGE = -1
#: up to so many template texts are broadcast; beyond that they are joined by host
BROADCAST_TEXTS = 50_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|select|textarea|title|head)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
    r"(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_HEAD = re.compile(r"<body\b|</head\s*>", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_PART = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
#: tags and words of class, id or role that mark what is not the article
OUTSIDE_TAGS = set("nav footer aside form button dialog menu fieldset".split())
OUTSIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner "
    "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments commentlist reply replies disqus discussion respond social share sharing related recommended "
    "recommendations widget widgets pagination pager skip paywall complementary contentinfo disclaimer copyright".split()
)
INSIDE_WORDS = set("article post entry story content main".split())
_LAYOUT = {"with", "has", "no", "without", "layout", "page", "wrapper"}
_ARTICLE, _MAIN, _CONTENT = 3, 2, 1


def tokens(page: str) -> Iterator[tuple]:
    """("open", tag, words, hidden), ("close", tag) and ("text", text) in page order."""
    first = _HEAD.search(page)
    at = first.start() if first else 0
    for match in _TOKEN.finditer(page, at):
        raw, tag = match.group(), match.group(3)
        if raw[0] != "<" or raw == "<":
            yield ("text", raw)
        elif tag:
            tag = tag.lower()
            if match.group(2):
                yield ("close", tag)
            else:
                words, hidden = (), False
                if match.group(4):
                    for name, a, b, c, bare in _ATTRIBUTE.findall(match.group(4)):
                        value, name = a or b or c, name.lower()
                        if name in ("class", "id", "role"):
                            words += tuple(w.lower() for w in _PART.findall(_CAMEL.sub(r"\1 \2", value)))
                        elif bare or (name == "style" and re.search(r"display\s*:\s*none", value)):
                            hidden = True
                        elif name == "aria-hidden" and value == "true":
                            hidden = True
                yield ("open", tag, words, hidden)


_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HEADINGS = {f"h{i}" for i in range(1, 7)}


def blocks(page: str) -> list[tuple[str, int, bool, int, float, int]]:
    """The texts of a page: (text, path, outside, region, share of text in links, block number).

    ``path`` is a digest of the tags around the text, ``outside`` whether one of them marks
    what is no article, ``region`` the best region (article, main, content) it lies in.
    """
    out: list[tuple[str, int, bool, int, float, int]] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, name with words, outside, region
    pieces: list[str] = []
    linked = [0, 0]
    state: list = [None]

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                path, outside, region = state[0]
                out.append((text, path, outside, region, linked[0] / max(1, linked[1]), len(out)))
            pieces.clear()
            linked[:] = [0, 0]

    for token in tokens(page):
        kind = token[0]
        if kind == "text":
            text = token[1]
            if not pieces:
                if text.isspace():
                    continue
                shape = [s for s in stack if s[0] not in INLINE]
                path = xxhash.xxh64_intdigest("/".join(s[1] for s in shape)) >> 1
                state[0] = (path, any(s[2] for s in stack), max((s[3] for s in stack), default=0))
            pieces.append(text)
            size = len(text)
            linked[1] += size
            if any(s[0] == "a" for s in stack):
                linked[0] += size
            continue
        tag = token[1]
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
        if kind == "close":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag not in INLINE:
            closes = _CLOSES.get(tag, set())
            while stack and (stack[-1][0] == "p" or stack[-1][0] in closes or stack[-1][0] in INLINE):
                stack.pop()
        words = token[2]
        inside = any(s[3] == _ARTICLE for s in stack)
        outside = token[3] or tag in OUTSIDE_TAGS or (tag == "header" and not inside)
        if words and tag not in ("html", "body", "main"):
            # "with-sidebar" names a page's layout, not a sidebar
            outside = outside or (not OUTSIDE_WORDS.isdisjoint(words) and _LAYOUT.isdisjoint(words))
        region = _ARTICLE if tag == "article" else _MAIN if tag == "main" or "main" in words else 0
        if not region and words and not INSIDE_WORDS.isdisjoint(words):
            region = _CONTENT
        if tag == "header" and inside:
            region = 0
        stack.append((tag, tag + "." + ".".join(words) if words else tag, outside, region))
    flush()
    return out


def _digest(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, seed=path & 0x7FFFFFFF) >> 1


def page_tokens(page: str) -> list[tuple[int, bool, int, int]]:
    """(token, is a text, times, first place) for the distinct tokens of a page: texts and the paths that hold them."""
    times: Counter[int] = Counter()
    first: dict[int, int] = {}
    texts = set()
    for text, path, _, _, _, place in blocks(page):
        for token, is_text in ((path, False), (_digest(path, text), True)):
            times[token] += 1
            first.setdefault(token, place)
            if is_text:
                texts.add(token)
    return [(token, token in texts, n, first[token]) for token, n in times.items()]


def _slots(found: list[tuple], texts: set[int], tags: set[int]) -> list[int | None]:
    """The slot of each block: that of its own template tag, else the gap behind the last template token; None for template texts."""
    out: list[int | None] = []
    gap = 0
    for block in found:
        token = _digest(block[1], block[0])
        if token in texts:
            gap = token
            out.append(None)
        elif block[1] in tags:
            gap = block[1]
            out.append(gap)
        else:
            out.append(xxhash.xxh64_intdigest(f"after {gap}") >> 1)
    return out


def main_text(page: str | None, texts: set[int], tags: set[int] | None = None, refused: set[int] | None = None) -> str:
    """The blocks of the best region that are slots, one per line.

    ``texts`` and ``tags`` are the template of the page's host, ``refused`` its slots that are menus or
    notices. Without a template, links that make up most of a block outside an article are a menu. If
    hardly anything but template would be left of the region, the pages are copies of one article and it stays.
    """
    every = blocks(page) if page else []
    templated = bool(texts or tags)
    slots = _slots(every, texts, tags or set()) if templated else [0] * len(every)
    found = [(b, slot) for b, slot in zip(every, slots, strict=True) if not b[2]]
    if not found:
        return ""
    best = max(b[3] for b, _ in found)
    region = [(b, slot) for b, slot in found if b[3] == best]
    if not templated:
        return "\n".join(b[0] for b, _ in region if best == _ARTICLE or b[4] < MENU_LINKS)
    region = [(b, slot) for b, slot in region if slot is None or slot not in (refused or ())]
    fixed = sum(len(b[0]) for b, slot in region if slot is None)
    copies = fixed >= COPIES * sum(len(b[0]) for b, _ in region)
    return "\n".join(b[0] for b, slot in region if copies or slot is not None)


def _nest(rows: pd.DataFrame) -> pd.DataFrame:
    """Keeps the classes of a host that nest: the template's texts and tags.

    A class spans from its first to its last token. It is valid if it lies inside or outside
    every larger class's gaps, that is, if its span does not cross another's without being
    contained in one gap of it. Classes on more pages come first, so partial ones nest in them.
    """
    classes = rows.groupby(["pages", "vector1", "vector2"])
    groups = [g.sort_values(["place", "token"]) for _, g in classes if len(g) >= LEAST_TOKENS]
    groups.sort(key=lambda g: (-g["pages"].iloc[0], -len(g), g["token"].iloc[0]))
    kept: list[np.ndarray] = []
    out = []
    for group in groups:
        places = group["place"].to_numpy()
        nested = True
        for outer in kept:
            crosses = places[0] < outer[-1] and outer[0] < places[-1]
            gaps = np.searchsorted(outer, places)
            nested = nested and (not crosses or len(set(gaps.tolist())) <= 2)
        if nested or (group["times"].iloc[0] == 1 and group["full"].iloc[0]):
            kept.append(places)
            out.append(group)
    return pd.concat(out)[["host", "token", "is_text"]] if out else rows.iloc[:0][["host", "token", "is_text"]]


def template_tokens(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, token, is_text): the texts and the tags of each host's template.

    Occurrence vectors are compared by two commutative sums over pages of hashes of (page,
    count), so a host's pages are counted in parallel and never gathered. All vectors that are on
    at least ``SUPPORT`` of the host's pages make classes; pages without a token do not count. Hosts
    with fewer than LEAST_PAGES pages have no template.
    """
    rows = _of_hosts(pages, url, html)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for host, page in zip(batch["host"], batch["html"], strict=True):
                own = xxhash.xxh64_intdigest(page)
                listed = page_tokens(page)
                if listed:
                    found.append((host, PAGE, False, 1, 0, 0, 0))
                for token, is_text, times, place in listed:
                    vector = xxhash.xxh64_intdigest(f"{own} {times}")
                    found.append((host, token, is_text, times, place, vector & 0x7FFFFFFF, vector >> 33))
            yield pd.DataFrame(found, columns=["host", "token", "is_text", "times", "place", "vector1", "vector2"])

    seen = rows.mapInPandas(
        emit, "host string, token long, is_text boolean, times long, place long, vector1 long, vector2 long"
    )
    sums = seen.groupBy("host", "token", "is_text").agg(
        F.count("*").alias("pages"),
        F.sum("times").alias("times"),
        F.avg("place").alias("place"),
        F.sum("vector1").alias("vector1"),
        F.sum("vector2").alias("vector2"),
    )
    # of a host's tokens those on many pages are kept: at most the tokens of one page over the share
    sums = written(sums.where(F.col("pages") >= LEAST_PAGES), "token-sums")
    counts = sums.where(F.col("token") == PAGE).select("host", F.col("pages").alias("all_pages"))
    often = sums.where(F.col("token") != PAGE).join(counts, "host").where(F.col("pages") >= SUPPORT * F.col("all_pages"))
    often = often.withColumns({"times": F.col("times") / F.col("pages"), "full": F.col("pages") == F.col("all_pages")})
    return often.groupBy("host").applyInPandas(_nest, "host string, token long, is_text boolean")


def template_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, token): the texts of each host's template."""
    return template_tokens(pages, url, html).where("is_text").select("host", "token")


def _listed(tokens: DataFrame) -> DataFrame:
    """(_known, _texts, _tags): one row per host that has a template."""
    return tokens.groupBy(F.col("host").alias("_known")).agg(
        F.collect_set(F.when(F.col("is_text"), F.col("token"))).alias("_texts"),
        F.collect_set(F.when(~F.col("is_text"), F.col("token"))).alias("_tags"),
    )


def refused_slots(pages: DataFrame, hosts: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, slot): the slots of each host that are menus or notices by what fills them on all its pages.

    ``hosts``: _known, _texts and _tags. A menu is filled with links, and in no article; a notice lies in no marked
    region and has few different fillings (counted by a sketch, to about 5%).
    """
    rows = _of_hosts(pages, url, html).join(hosts, F.col("host") == F.col("_known")).select("host", "html", "_texts", "_tags")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for host, page, texts, tags in zip(batch["host"], batch["html"], batch["_texts"], batch["_tags"], strict=True):
                every = blocks(page)
                fillings: dict[int, list] = {}
                for block, slot in zip(every, _slots(every, set(texts), set(tags)), strict=True):
                    if slot is not None and not block[2]:
                        fillings.setdefault(slot, []).append(block)
                for slot, filled in fillings.items():
                    size = sum(len(b[0]) for b in filled)
                    linked = sum(len(b[0]) * b[4] for b in filled)
                    text = xxhash.xxh64_intdigest("\n".join(b[0] for b in filled)) >> 1
                    found.append((host, slot, max(b[3] for b in filled), size, linked, text))
            yield pd.DataFrame(found, columns=["host", "slot", "region", "size", "linked", "text"])

    filled = rows.mapInPandas(emit, "host string, slot long, region long, size long, linked double, text long")
    judged = filled.groupBy("host", "slot").agg(
        F.count("*").alias("pages"), F.max("region").alias("region"), F.sum("size").alias("size"),
        F.sum("linked").alias("linked"), F.approx_count_distinct("text").alias("fillings"),
    )
    menu = (F.col("region") < _ARTICLE) & (F.col("linked") >= MENU_LINKS * F.col("size"))
    few = (F.col("pages") >= LEAST_PAGES) & (F.col("fillings") <= FEW_FILLINGS * F.col("pages"))
    return judged.where(menu | ((F.col("region") == 0) & few)).select("host", "slot")


def _of_hosts(pages: DataFrame, url: str, html: str) -> DataFrame:
    return pages.select(_host(url).alias("host"), F.col(html).alias("html")).where("host is not null and html is not null")


def _host(url: str):
    return F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame, url: str = "url", html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with ``name`` (replaced if there): the main text of each whole page, empty if there is none.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by a line end in page order. A null page gives an empty text; without a url or
    with an unusual one the page is read without a template.
    """
    tokens = written(template_tokens(pages, url, html), "template")
    small = tokens.count() <= BROADCAST_TEXTS
    hosts = _listed(tokens)
    refused = written(refused_slots(pages, F.broadcast(hosts) if small else hosts, url, html), "slots")
    refused = refused.groupBy(F.col("host").alias("_known")).agg(F.collect_set("slot").alias("_refused"))
    hosts = hosts.join(refused, "_known", "left")
    if small:
        hosts = F.broadcast(hosts)
    joined = pages.withColumn("_host", _host(url)).join(hosts, F.col("_host") == F.col("_known"), "left")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html_pages, *templates in batches:
            known = (tuple(set(part) if part is not None else set() for part in parts) for parts in zip(*templates, strict=True))
            yield pd.Series([main_text(p, *parts) for p, parts in zip(html_pages, known, strict=True)], dtype=object)

    return joined.withColumn(name, read(F.col(html), F.col("_texts"), F.col("_tags"), F.col("_refused"))).drop(
        "_host", "_known", "_texts", "_tags", "_refused"
    )
