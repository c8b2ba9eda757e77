"""Main text of web pages from flat text blocks (operator 1).

A page is read as a flat row of text blocks.  A block is described by its number of words, the share of them inside
links, the same of the blocks before and after it, by what its open elements say about their role, and by whether the
page says anywhere where its content is.  A decision tree tells text from boilerplate.  It is trained by Spark on a
small labelled table: the blocks of template pages whose elements carry their label.  Some of these pages name their
content, some only their boilerplate, some nothing at all: there length and link density decide.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harmonium.llm.common import read

FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "aside", "inside", "heading", "marked"]
MAX_DEPTH = 9

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""", re.S)
_SKIPPED = frozenset("script style noscript template head title textarea select svg math iframe object canvas audio video datalist".split())
#: Elements whose content is no markup: only their own end tag ends them.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("style", "title", "textarea", "iframe")}
_RAW["script"] = re.compile(r"<!--(?:-?>)?|-->|<script(?=[\s/>])|</script(?=[\s/>])[^>]*(?:>|\Z)", re.I)
#: What can stand in a head; any other element, and text, end a head that has no end tag.
_HEAD = frozenset("head title meta link base basefont bgsound script style noscript template noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol optgroup option p pre section summary table caption tbody tfoot thead tr ul".split())
_SPACES = frozenset(["br", "td", "th", "wbr", "img", "input"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose role is known by their name.
_ASIDE = frozenset("nav aside footer header form menu dialog button label fieldset".split())
_INSIDE = frozenset(["article", "main"])
#: Words in class, id, role and label attributes.
_ASIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert author banner bio breadcrumb breadcrumbs byline category comment comments commentlist consent contentinfo "
    "cookie cookies copyright dialog discussion disqus donate feedback footer foot form gdpr header head hidden login masthead menu menubar meta modal nav navbar navigation newsletter "
    "notice notification overlay pager pagination paywall popup prefooter promo promoted promotion rail recommended recommendations related replies reply respond responses search share "
    "sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar warning widget widgets".split())
_INSIDE_WORDS = frozenset("article articlebody body content entry main post postbody story text".split())
#: First words of a class that says something about the page or the kind of the text, not about the element's role.
_ABOUT = frozenset("category format has is no not page single status tag tagged type with without".split())
#: Texts of blocks that only announce an advert.
_ANNOUNCED = frozenset(["ad", "ads", "advert", "advertisement", "advertisements", "advertising", "promoted", "sponsored", "sponsored content"])
_SEPARATORS = frozenset("| / - – — · • > » › & , ::".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|data-label|data-testid)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)

_roles: dict[tuple[str, str], tuple[int, int, str]] = {}


def _role(name: str, attributes: str) -> tuple[int, int, str]:
    """(boilerplate, content, label of the training table) as an element's name and attributes say."""
    known = _roles.get((name, attributes))
    if known is not None:
        return known
    aside, inside, label = int(name in _ASIDE), int(name in _INSIDE), ""
    if attributes:
        aside |= int(bool(_HIDDEN.search(attributes)))
        for key, value in _ATTRIBUTE.findall(attributes):
            if key.lower() == "data-label":
                label = value.strip("\"'")
                continue
            # a name that holds words of both kinds (post-comments) is boilerplate; an element with names of both is not
            names = [[w.lower() for w in _WORD.findall(x)] for x in value.strip("\"'").split()]
            names = [x for x in names if x and not (len(x) > 1 and x[0] in _ABOUT)]
            says_aside = [not _ASIDE_WORDS.isdisjoint(x) for x in names]
            says_inside = any(not a and not _INSIDE_WORDS.isdisjoint(x) for a, x in zip(says_aside, names, strict=True))
            inside |= int(says_inside)
            aside |= int(any(says_aside) and not says_inside and name not in ("body", "html", "article", "main"))
    if len(_roles) > 20_000:
        _roles.clear()
    _roles[name, attributes] = (aside, inside, label)
    return aside, inside, label


def _raw_end(html: str, name: str, at: int, missing: set[str]) -> int:
    """Behind the end tag of an element without markup whose content starts at ``at``; -1 if there is none."""
    if name in missing:
        return -1
    commented = nested = False  # a script inside a comment of a script has an end tag of its own
    for found in _RAW[name].finditer(html, at):
        token = found.group().lower()
        if token.startswith("</"):
            if not nested:
                return found.end()
            nested = False
        elif token == "<!--":
            commented = True
        elif token == "-->":
            commented = nested = False
        elif token == "<script":
            nested = commented
    if not commented:
        missing.add(name)
    return -1


def _skipped_end(html: str, name: str, at: int, missing: set[str]) -> int:
    """Behind a skipped element whose content starts at ``at``: the end of the page, if nothing ends it.

    ``missing`` collects the names that have no end tag in the rest of the page.
    """
    if name in _RAW:
        end = _raw_end(html, name, at, missing)
        return len(html) if end < 0 else end
    strict = name == "head"  # text ends a head, unless it may belong to an element without an end tag
    while found := _TAG.search(html, at):
        start, end = found.span()
        if strict and html[at:start].strip():
            return at
        at = end
        ends, inner, attributes = found.groups()
        inner = (inner or "").lower()
        if ends:
            if inner == name:
                return end
            if name == "head" and inner in ("body", "html"):
                return start
        elif inner and name == "head" and inner not in _HEAD:
            return start
        elif attributes and attributes.endswith("/"):
            continue
        elif inner in _RAW:
            behind = _raw_end(html, inner, end, missing)
            at, strict = max(end, behind), strict and behind > 0
        elif name == "head" and inner in ("noscript", "template"):
            at = _skipped_end(html, inner, end, missing)
    return at if strict else len(html)


def blocks(html: str | None) -> list[tuple[str, int, int, int, int, int, str]]:
    """The text blocks of a page: (text, words, words in links, boilerplate, content, heading, label).

    Character references are decoded after the markup is taken away; white space becomes one space.  Unclosed elements
    end with their parent, an end tag without its start is ignored, a tag cut off at the end of the page is dropped.
    """
    out: list = []
    if not html:
        return out
    stack: list[tuple[str, int, int, str]] = [("", 0, 0, "")]
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = 0
    missing: set[str] = set()
    at = 0

    def close():
        nonlocal parts, linked
        if parts:
            text = unescape("".join(parts)).split()
            if text:
                _, aside, inside, label = stack[-1]
                aside = int(aside & 1 or aside & 2 and not heading or len(text) < 3 and " ".join(text).strip(" :.-[]()").lower() in _ANNOUNCED)
                in_links = unescape("".join(linked)).split()
                # signs between links are no words
                n = len(text) - sum(w in _SEPARATORS for w in text) if in_links else len(text)
                out.append((" ".join(text), n, min(n, len(in_links)), aside, inside, heading, label))
            parts, linked = [], []

    while found := _TAG.search(html, at):
        start, end = found.span()
        ends, name, attributes = found.groups()
        if start > at:
            parts.append(html[at:start])
            if in_link:
                linked.append(html[at:start])
        at = end
        if not name:
            if html.startswith("<![CDATA[", start):
                parts.append(html[start + 9 : end - 3].replace("&", "&amp;"))
            continue
        name = name.lower()
        if name in _SKIPPED:
            if not ends and not attributes.endswith("/"):
                parts.append(" ")
                at = _skipped_end(html, name, end, missing)
            continue
        if name == "a":
            in_link = 0 if ends else 1
            linked.append(" ")
            continue
        if name in _SPACES:
            parts.append(" ")
            if in_link:
                linked.append(" ")
            if name in _VOID:
                continue
        elif name in _BLOCKS:
            close()
            in_link = 0
            if name in _HEADINGS:
                heading = int(not ends)
        if name in _BLOCKS or name in _ASIDE or (attributes and not ends and name not in _VOID and any(_role(name, attributes)[:2])):
            if not ends:
                if name in ("hr",):
                    continue
                if name in ("p", "li", "dt", "dd", "tr", "option") or name in _HEADINGS:
                    _end(stack, name, implied=True)
                aside, inside, label = _role(name, attributes)
                _, aside0, inside0, label0 = stack[-1]
                if name == "header" and inside0 and not _role("div", attributes)[0]:
                    aside = 2  # the header of an article: its headings belong to the text
                if inside and name in _INSIDE:
                    aside0 = 0 if stack[-1][0] in ("body", "html", "") else aside0
                stack.append((name, aside | aside0, inside | inside0, label or label0))
            else:
                _end(stack, name)
        elif ends and name not in _VOID:
            _end(stack, name, inline=True)
    if at < len(html):
        parts.append(html[at:])
    close()
    return out


#: An element that opens again ends the one before it, unless one of these stands between.
_BARRIERS = frozenset("table td th div section article aside main nav ul ol dl blockquote body header footer form details figure".split())


def _end(stack: list, name: str, implied: bool = False, inline: bool = False) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if (implied or inline) and stack[i][0] in _BARRIERS or not implied and not inline and name == "p" and stack[i][0] in _BARRIERS:
            return


def features(found: list) -> list[list[float]]:
    """The values of ``FEATURES`` for each block; beyond the ends of the page stand blocks without words."""
    density = [b[2] / max(b[1], 1) for b in found]
    size = [float(b[1]) for b in found]
    marked = float(any(b[4] and not b[3] for b in found))
    out = []
    for i, b in enumerate(found):
        before = (size[i - 1], density[i - 1]) if i else (0.0, 0.0)
        after = (size[i + 1], density[i + 1]) if i + 1 < len(found) else (0.0, 0.0)
        out.append([size[i], density[i], *before, *after, float(b[3]), float(b[4]), float(b[5]), marked])
    return out


def labelled_pages() -> list[str]:
    """Template pages whose elements carry ``data-label`` keep or drop.  Lengths are varied by rule.

    Every page has an article between boilerplate.  The article stands in an element that names it, or in one that does
    not, or in none; its blocks are paragraphs, lines of ``div`` or a mixture.  The boilerplate names itself or not.
    """
    text = lambda n, k=0: " ".join(f"w{(i * 7 + k) % 23}" for i in range(n))
    links = lambda n, k=2: "".join(f"<li><a href='/x'>{text(k, i)}</a></li>" for i in range(n))
    keep = [
        lambda n: f"<p>{text(n)}</p>", lambda n: f"<h2>{text(1 + n % 9)}</h2><p>{text(n + 6)}</p>", lambda n: f"<p>{text(n)} <a href='/y'>{text(1 + n // 12)}</a> {text(n // 2)}</p>",
        lambda n: f"<ul><li>{text(1 + n % 13)}</li><li>{text(2 + n % 7)}</li></ul>", lambda n: f"<blockquote>{text(n)}</blockquote>", lambda n: f"<p>{text(1 + n % 3)}</p>",
        lambda n: f"<table><tr><td>{text(2)}</td><td>{text(3)}</td></tr></table>", lambda n: f"<p><a href='/r'>{text(1 + n % 6)}</a></p><p>{text(n + 10)}</p>",
        lambda n: f"<p>{text(2 + n % 9)} <a href='/s'>{text(1 + n % 3)}</a> {text(1 + n % 5)}</p>", lambda n: f"<ul><li>{text(2 + n % 5)} <a href='/t'>{text(1 + n % 2)}</a></li><li><a href='/u'>{text(2)}</a> {text(2 + n % 8)}</li></ul>",
    ]
    named = [
        lambda n: f"<nav><ul>{links(2 + n % 6)}</ul></nav>", lambda n: f"<div class='ad'>{text(2 + n % 30)}</div>", lambda n: f"<footer>{text(3 + n % 20)} <a href='/z'>{text(2)}</a></footer>",
        lambda n: f"<aside><h3>{text(2)}</h3><p>{text(n % 60 + 1)}</p></aside>", lambda n: f"<div class='cookie-notice'><p>{text(5 + n % 40)}</p></div>", lambda n: f"<form><label>{text(2)}</label><p>{text(n % 12 + 1)}</p></form>",
        lambda n: f"<div id='comments'><p>{text(n % 80 + 1)}</p><p>{text(n % 9 + 1)}</p></div>", lambda n: f"<header><div>{text(1 + n % 8)}</div></header>", lambda n: f"<div class='sidebar'><p>{text(1 + n % 50)}</p></div>",
    ]
    unnamed = [
        lambda n: f"<ul>{links(3 + n % 5)}</ul>", lambda n: f"<div><a href='/p'>{text(1 + n % 3)}</a> | <a href='/q'>{text(2)}</a></div><div><a href='/s'>{text(1 + n % 4)}</a></div>",
        lambda n: f"<ul>{links(2 + n % 4, 3 + n % 9)}</ul>", lambda n: f"<div><a href='/p'>{text(4)}</a> {text(1 + n % 3)} <a href='/q'>{text(3)}</a></div><ul>{links(3)}</ul>",
        lambda n: f"<div><a href='/p'>{text(1 + n % 3)}</a></div><h3>{text(1 + n % 3)}</h3><ul>{links(3 + n % 6, 1 + n % 7)}</ul>",
    ]
    wrap = lambda x: f"<div data-label='drop'>{x}</div>" if x else ""
    naming = ["<article{}>|</article>", "<main{}>|</main>", "<div id='content'{}>|</div>", "<div class='post type-post category-news'{}>|</div>", "<div class='entry-content has-sidebar'{}>|</div>"]
    silent = ["<div{}>|</div>", "<div class='row wide'{}>|</div>", "<section{}>|</section>"]
    pages = []
    for k in range(480):
        size = [3 + (k * 11 + j * 17) % 90 for j in range(12)]
        marks = k % 2 == 0
        opening, closing = (naming[k // 2 % len(naming)] if marks else silent[k // 2 % len(silent)]).format(" data-label='keep'").split("|")
        title = f"<h1>{text(2 + k % 10)}</h1>" if k // 2 % 3 else ""
        if marks:  # blocks of any kind and length
            body = "".join(keep[(k // 2 + j * 3) % len(keep)](size[j]) for j in range(1 + k % 6))
            # inside the text stand blocks that say what they are, and rows of links
            inner = [named[6], named[1], named[8], unnamed[0], unnamed[2], lambda n: ""][k // 2 % 6](size[7])
            beside = [lambda n: f"<div>{text(n)}</div>", lambda n: f"<p>{text(1 + n % 40)}</p>", lambda n: f"<div><p>{text(n)}</p><p>{text(3 + n % 25)}</p></div>"]
            outer = [(beside if (k // 2 + j) % 2 else named + unnamed)[(k // 2 + 4 * j) % (3 if (k // 2 + j) % 2 else 14)](size[6 + j]) for j in range(5)]
        else:
            line = ["<p>{}</p>", "<div>{}</div>", "{}<hr>"][k // 6 % 3]
            body = "".join(line.format(text([9 + size[j], 4 + size[j] % 14][k // 2 % 2])) for j in range(2 + k % 5))
            if k % 8 == 7:
                body += f"<p>{text(10 + k % 30)} <a href='/y'>{text(2 + k % 4)}</a></p><p>{text(1 + k % 3)}</p><p>{text(12 + k % 50)}</p>"
            inner = ""
            outer = [([*unnamed, named[0], named[2]] if k % 4 == 1 else [*unnamed, *named])[(k // 2 + 3 * j) % (7 if k % 4 == 1 else 14)](size[6 + j]) for j in range(5)]
        if k // 2 % 4 == 3:  # nothing before the text, or nothing around it
            outer = ["", "", *([""] * 3 if k // 8 % 2 else outer[2:])]
            if k // 8 % 4 == 1:  # a single block
                title, body, inner = "", f"<p>{text(size[3])}</p>", ""
        pages.append(f"<html><body>{wrap(outer[0])}{wrap(outer[1])}{opening}{title}{body}{wrap(inner)}{closing}{wrap(outer[2])}{wrap(outer[3])}{wrap(outer[4])}</body></html>")
    return pages


def train(spark: SparkSession, pages: list[str] | None = None) -> tuple:
    """The tree as nested tuples (feature, threshold, left, right) with 0.0 or 1.0 at the leaves."""
    rows = []
    for page in labelled_pages() if pages is None else pages:
        found = blocks(page)
        rows += [(x, float(b[6] == "keep")) for x, b in zip(features(found), found, strict=True) if b[6]]
    table = spark.createDataFrame(rows, "x array<double>, label double").coalesce(1)
    fitted = DecisionTreeClassifier(maxDepth=MAX_DEPTH, minInstancesPerNode=2).fit(table.select(array_to_vector("x").alias("features"), "label"))

    def node(java) -> tuple | float:
        if java.subtreeDepth() == 0:
            return float(java.prediction())
        return (java.split().featureIndex(), java.split().threshold(), node(java.leftChild()), node(java.rightChild()))

    return node(fitted._call_java("rootNode"))


def main_text(html: str | None, tree: tuple | float) -> str:
    """The blocks that the tree keeps, in page order, with an empty line between; empty if there are none."""
    found = blocks(html)
    kept = []
    for b, x in zip(found, features(found), strict=True):
        at = tree
        while isinstance(at, tuple):
            at = at[2] if x[at[0]] <= at[1] else at[3]
        if at:
            kept.append(b[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame, html: str = "html", tree: tuple | None = None) -> DataFrame:
    """``pages`` with ``text`` (main text) and ``n_chars`` (its code points); columns of these names are replaced.

    Null and empty pages, and pages without text, have an empty text.  Whole pages are read, whatever their length.
    Repeated rows are treated alike; an empty table gives an empty table.
    """
    tree = train(pages.sparkSession) if tree is None else tree

    def run(column):
        import pandas as pd

        return pd.Series([main_text(x, tree) for x in column], index=column.index, dtype=object)

    out = pages.withColumn("text", F.pandas_udf(run, "string")(F.col(html)))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars; see ``extract`` for odd rows."""
    return extract(read(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
