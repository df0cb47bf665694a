"""Main text of web pages by inferred wrappers (operator 2).

A page's token stream is read as nested elements and written as a union-free
regular expression: neighbouring equal elements, or equal rows of up to three
elements, become a repeated group, and text becomes a slot. The expressions of a
host are aligned one after another: what matches is merged, what one of them lacks
becomes optional, what one repeats becomes repeated. The result is the host's
wrapper. Every page is then matched against its host's wrapper.

What an element is decides first: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments and lists of links are no content, told by tags, roles and
whole class names or ids, and never for headings. A form around a page's parts, an article
or several paragraphs is only a frame: its controls go and the rest stays. Weak names
(share, social, related, widget) count only for elements without paragraphs. Text is taken
block by block; if elements matched in the page are articles, only what they hold is, and
all of it. In pages without an article a whole block is template too if ``SHARE`` of the
host's different pages, and no fewer than ``SURE`` of them, have a block at its place and
all of these the same text; headings are not. Words inside a block never go.

Pages of a host share few expressions: only distinct ones are shuffled. A host with
more than ``FOLDED`` of them is folded in parts, then the parts' results again: the
parts follow from the host's own expressions alone, so that no host changes another.
Blocks are compared by the least and greatest hash at a place, an aggregate that tasks
begin before anything is shuffled. Wrappers meet the pages in a join that Spark
broadcasts if the written wrappers are small enough and else splits where a host is hot.

Null html is empty and gives empty text; a null url or one without a host belongs
to the host ''. White space is Unicode's. Repeated rows come out once each; no text
is cut. Unclosed elements end with what holds them. Elements nested deeper than
``DEEPEST`` follow the one at that depth with all their text, still as menus and the like
if they lie in one.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import count, repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|</?[a-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Kinds of elements, and names that mark elements which are not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CONTROLS = frozenset("label legend datalist output progress meter".split())  # of a form, beside those that are never content
FOREIGN = frozenset("svg math".split())  # what may close itself
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_CONTENT = frozenset("head nav footer aside form button dialog menu noscript template select svg math object canvas".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NOT_CONTENT_NAMES = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside notice notices cookie cookies consent gdpr banner advert adverts advertisement ad ads adsense sponsor sponsored promo "
    "comment comments respond disqus breadcrumb breadcrumbs newsletter subscribe popup modal overlay login signup pagination pager".split()
)
WEAK_NAMES = frozenset("share sharing social related widget widgets".split())
PLACES = frozenset("area articles bar bars block box button buttons container content form group holder icons inner item items left link links list outer panel posts right section slot stories thread top wrap wrapper".split())
LAYOUTS = frozenset("has hide no with without".split())
MASTHEADS = frozenset("header masthead topbar".split())
DEEPEST = 1000
FOLDED = 500  # expressions of a host that one task folds
SURE = 20  # different pages that must agree on a block before it is template
SHARE = 0.9  # of the host's different pages that must have it


def deep() -> None:
    """Room for functions that call themselves once for each level of a page."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))


class Element:
    __slots__ = ("children", "label", "tag")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []


def label_of(token: str, tag: str) -> str:
    """The tag with what tells its part in a page: classes, id and role, without numbers."""
    if len(token) <= len(tag) + 2:
        return tag
    parts = []
    for m in ATTRIBUTE.finditer(token, len(tag) + 1):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            own = (re.sub("[^a-z]+", "-", x).strip("-") for x in value.split())
            parts += [x if name == "class" else f"#{x}" for x in own if x]
        elif name == "role":
            parts.append("@" + value.strip())
        elif (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value == "true") or (name == "hidden" and value not in ("false", "until-found")):
            parts.append("@hidden")
    return ".".join([tag, *sorted(set(parts))])


def parse(page: str | None) -> Element:
    """The nested elements of a page; texts are strings among the children."""
    root = Element("", "")
    stack, gone, opened = [root], [False], Counter()  # gone: below DEEPEST, whether an element lies in one that is no content

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:], gone[k:]

    for m in TOKEN.finditer(page or ""):
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            stack[-1].children.append(entities.unescape(token))
            continue
        if m[1] or token[1] in "!?":
            continue
        t = TAG.match(token)
        tag = t[2].lower()
        if t[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "body", "td", "table") and tag in ("p", "li", "b", "i", "a", "span"):
                    break
            continue
        if tag in BLOCKS and stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag in BLOCKS:  # a block ends an open paragraph, with what is still open in it
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in CLOSED_BY and stack[-1].tag in CLOSED_BY[tag]:
            close(len(stack) - 1)
            if tag == "tr" and stack[-1].tag == "tr":
                close(len(stack) - 1)
        e = Element(tag, label_of(token, tag))
        low = len(stack) >= DEEPEST
        hidden = gone[-1] or (low and not_content(e.label, True))
        if not hidden:
            stack[DEEPEST - 1 if low else -1].children.append(e)
        if tag not in VOID and not (token.endswith("/>") and (tag in FOREIGN or any(opened[x] > 0 for x in FOREIGN))):
            stack.append(e)
            gone.append(hidden)
            opened[tag] += 1
    return root


# An expression is [label, quantifier, parts]; a slot has the label "#", a group of several parts "()".
SLOT = ["#", "", []]


def expression(e: Element) -> list:
    """The union-free expression of an element."""
    parts: list = []
    for c in e.children:
        if isinstance(c, str):
            if not c.isspace() and not (parts and parts[-1][0] == "#"):
                parts.append(SLOT)
        else:
            parts.append(expression(c))
    return [e.label, "", fold(parts)]


def name(part: list) -> str:
    return "(" + " ".join(map(name, part[2])) + ")" if part[0] == "()" else part[0]


def fold(parts: list) -> list:
    """Rows of equal parts become one repeated part or group."""
    for period in (1, 2, 3):
        names, out, k = [name(p) for p in parts], [], 0
        while k < len(parts):
            n = 1
            while names[k : k + period] == names[k + n * period : k + (n + 1) * period] and len(names[k : k + period]) == period:
                n += 1
            if n == 1:
                out.append(parts[k])
                k += 1
                continue
            own = [merge(*(parts[k + j * period + i] for j in range(n))) for i in range(period)]
            one = own[0] if period == 1 else ["()", "", own]
            out.append([one[0], "+" if "?" not in one[1] and "*" not in one[1] else "*", one[2]])
            k += n * period
        parts = out
    return parts


QUANTIFIER = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}


def quantified(part: list, optional: bool = False, repeated: bool = False) -> list:
    q = part[1]
    return [part[0], QUANTIFIER[optional or q in ("?", "*"), repeated or q in ("+", "*")], part[2]]


def merge(first: list, *others: list) -> list:
    """One expression for parts of equal name."""
    for other in others:
        if other is first or other == first:
            continue
        first = quantified([first[0], first[1], align(first[2], other[2])], other[1] in ("?", "*"), other[1] in ("+", "*"))
    return first


def align(a: list, b: list) -> list:
    """Merge what has equal names in both, in order; the rest becomes optional."""
    if a == b:
        return a
    x, y = [name(p) for p in a], [name(p) for p in b]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append(quantified(a[i], optional=True))
            i += 1
        else:
            out.append(quantified(b[j], optional=True))
            j += 1
    return fold(out)


def named(label: str, names: frozenset[str]) -> bool:
    """Whether a class or the id says so: as a whole, by its last word, or by its first before a word for a place."""
    for n in label.split(".")[1:]:
        words = n.lstrip("#").split("-")
        if words[0] not in LAYOUTS and (words[-1] in names or (words[0] in names and words[-1] in PLACES)):
            return True
    return False


def not_content(label: str, inside: bool) -> bool:
    """Whether an element of this label is none of a page's content; inside: of an article."""
    tag, *names = label.split(".")
    if tag in NOT_CONTENT or "@hidden" in names or any(n[0] == "@" and n[1:] in NOT_CONTENT_ROLES for n in names):
        return True
    if not inside and (tag == "header" or named(label, MASTHEADS)) and tag not in HEADINGS:
        return True
    return tag not in HEADINGS and tag not in ("html", "body", "article", "main") and named(label, NOT_CONTENT_NAMES)


def is_article(label: str) -> bool:
    return label.split(".")[0] in ("article", "main") or "@main" in label or "@article" in label


FRAMED = frozenset("article main header nav footer".split())
INPUTS = frozenset("input select textarea button label".split())


class Seen:
    """What lies below each part of a wrapper, found once from the leaves up."""

    def __init__(self, part: list):
        self.of: dict[int, tuple[bool, int, bool, bool]] = {}
        self.look(part)

    def look(self, part: list) -> tuple[bool, int, bool, bool]:
        """Slots outside links?, slots in links (2 for more), paragraphs?, a frame's parts: articles, page areas or several paragraphs?"""
        bare, linked, paragraphs, frame = part[0] == "#", 0, False, False
        tag, many = part[0].split(".")[0], part[1] in ("+", "*")
        for c in part[2]:
            b, n, p, f = self.look(c)
            bare, linked, paragraphs, frame = bare or b, min(2, linked + n), paragraphs or p, frame or f
        if tag == "a":
            bare, linked = False, min(2, linked + bare)
        if many:
            linked *= 2
        paragraphs = paragraphs or tag == "p"
        frame = frame or tag in FRAMED or is_article(part[0]) or (many and tag == "p") or (many and tag == "()" and paragraphs)
        self.of[id(part)] = bare, linked, paragraphs, frame
        return self.of[id(part)]

    def only_links(self, part: list) -> bool:
        """Whether all slots below are in links, and there is more than one link."""
        bare, linked, _, _ = self.of[id(part)]
        return not bare and linked > 1

    def paragraphs(self, part: list) -> bool:
        return self.of[id(part)][2]

    def frame(self, part: list) -> bool:
        return self.of[id(part)][3]


def mark(wrapper: list, inside: bool = False, form: bool = False, place: int | None = None) -> list:
    """[label, content?, parts, in an article?, place, in a form?] of a wrapper, groups dissolved: what a page is matched against.

    With a ``place`` all parts have that one.
    """
    places, seen = count() if place is None else repeat(place), Seen(wrapper)

    def dissolved(parts: list) -> list:
        return [d for c in parts for d in (dissolved(c[2]) if c[0] == "()" else [c])]

    def walk(p: list, inside: bool, form: bool) -> list:
        inside, own = inside or is_article(p[0]), next(places)
        tag = p[0].split(".")[0]
        framing = tag == "form" and seen.frame(p) and not not_content(".".join(["div", *p[0].split(".")[1:]]), inside)
        if p[0] not in ("", "#", "()") and not framing and (
            not_content(p[0], inside)
            or (form and tag in CONTROLS)
            or (tag not in HEADINGS and tag not in ("html", "body", "article", "main") and named(p[0], WEAK_NAMES) and not seen.paragraphs(p))
            or (not inside and tag in ("ul", "ol", "div", "table", "p", "section") and seen.only_links(p))
        ):
            return [p[0], False, [], inside, own, form]
        form = form or tag == "form"
        return [p[0], True, [walk(c, inside, form) for c in dissolved(p[2]) if c[0] != "#"], inside, own, form]

    return walk(wrapper, inside, form)


def frames(form: Element) -> bool:
    """Whether a form holds an article, areas of a page, or several paragraphs without controls."""
    below, paragraphs = [form], 0
    while below:
        e = below.pop()
        if e is not form and (e.tag in FRAMED or is_article(e.label)):
            return True
        own = [c for c in e.children if not isinstance(c, str)]
        paragraphs += e.tag == "p" and not any(c.tag in INPUTS for c in own)
        below += own
    return paragraphs > 1


def matched(page: str | None, marked: list) -> tuple[list[int], list[str]]:
    """The blocks of a page's texts at its wrapper's content places, in order: their places and texts.

    A place is negative for blocks that are never template: with headings, or in a page
    that has an article. Of such a page, only texts in articles.
    """
    said: dict[int, list[tuple[bool, bool, int, str]]] = {}
    block, articles = 0, False

    def walk(e: Element, own: list, heading: bool) -> None:
        nonlocal articles, block
        at, parts = 0, own[2]
        articles = articles or own[3]
        heading = heading or e.tag in HEADINGS
        for c in e.children:
            if isinstance(c, str):
                said.setdefault(block, []).append((own[3], heading, own[4], c))
                continue
            if c.tag == "br" or c.tag in ("td", "th"):
                said.setdefault(block, []).append((own[3], heading, own[4], " "))
            if c.tag == "form" and not frames(c):
                continue
            found = next((k for k in (*range(at, len(parts)), *range(at)) if parts[k][0] == c.label), None)
            at = at if found is None else found
            # what the wrapper has elsewhere only is judged by itself
            part = parts[found] if found is not None else mark(expression(c), own[3], own[5], own[4])
            if part[1]:
                block += c.tag in BLOCKS
                walk(c, part, heading)
                block += c.tag in BLOCKS

    walk(parse(page), marked, False)
    places, texts = [], []
    for strings in said.values():
        kept = [x for x in strings if x[0] or not articles]
        if text := " ".join("".join(x[3] for x in kept).split()):
            place = next(x[2] for x in kept if not x[3].isspace())
            places.append(~place if articles or any(x[1] for x in kept) else place)
            texts.append(text)
    return places, texts


def extract(page: str | None, marked: list) -> str:
    """The text of a page at the content places of its wrapper."""
    return "\n".join(matched(page, marked)[1])


def _expressions(pages: pd.Series) -> pd.Series:
    deep()
    return pd.Series([json.dumps(expression(parse(p)), separators=(",", ":"), ensure_ascii=False) for p in pages])


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """One expression for those of a host, or of a part of them."""
    deep()
    whole = merge(*(json.loads(w) for w in sorted(set(rows["wrapper"]))))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(whole, separators=(",", ":"), ensure_ascii=False)]})


PARTS = "places array<int>, texts array<string>"


def _matched(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    deep()
    known: dict[str, list] = {}
    for pages, wrappers in batches:
        out = []
        for page, wrapper in zip(pages, wrappers, strict=True):
            if wrapper not in known:
                if len(known) >= 5000:
                    known.clear()
                known[wrapper] = mark(json.loads(wrapper))
            out.append(matched(page, known[wrapper]))
        yield pd.DataFrame(out, columns=["places", "texts"])


def host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and host."""
    found = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html").cast("string").alias("html"), found.alias("host"))


def infer(pages: DataFrame, folded: int = FOLDED) -> DataFrame:
    """host and wrapper, from all pages with a host column."""
    rows = written(pages.select("host", F.pandas_udf(_expressions, "string")("html").alias("wrapper")).distinct())
    while True:
        sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / folded).alias("parts"))
        salted = rows.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")).cast("int"))
        rows = written(salted.groupBy("host", "part").applyInPandas(_folded, "host string, wrapper string"))
        if rows.groupBy("host").count().where("count > 1").isEmpty():
            return rows


def templates(found: DataFrame, sure: int = SURE, share: float = SHARE) -> DataFrame:
    """host and template: the places where nearly all of its different pages have a block, all the same.

    found: host, page (a hash of the html), places and texts.
    """
    pages = found.groupBy("host").agg(F.approx_count_distinct("page", 0.01).alias("all"))
    said = F.explode(F.filter(F.arrays_zip("places", "texts"), lambda x: x["places"] >= 0)).alias("x")
    rows = found.select("host", "page", said).select("host", "page", F.col("x.places").alias("place"), F.xxhash64("x.texts").alias("h"))
    places = rows.groupBy("host", "place").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.approx_count_distinct("page", 0.01).alias("pages")).where("low = high")
    shared = places.join(pages, "host").where((F.col("pages") >= sure) & (F.col("pages") >= share * F.col("all")))
    return shared.groupBy("host").agg(F.collect_list("place").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = host(pages)
    wrappers = infer(rows)
    found = rows.join(wrappers, "host").select("page_id", "url", "host", F.xxhash64("html").alias("page"), F.pandas_udf(_matched, PARTS)("html", "wrapper").alias("p"))
    found = written(found.select("page_id", "url", "host", "page", "p.*"))
    out = found.join(written(templates(found)), "host", "left")
    kept = F.filter(F.arrays_zip("places", "texts"), lambda x: ~F.array_contains(F.coalesce("template", F.array().cast("array<int>")), x["places"]))
    return out.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["texts"]), "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
