"""Main text of web pages by the maximum-scoring subsequence of a page's words and tags.

Elements that are no text by what they are (menus, footers, forms, scripts and the like) or by what their containers are
named are taken out first. What is left is a sequence of words, which score above zero, and tags, which score below; the
contiguous stretch with the highest sum is the article. One scan finds it. The scores are log odds learned from pages whose
article is marked: of a word by the kind and length of its block, of a tag by its kind.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.llm.common import quoted, slices

# Fixed values of the HTML vocabulary.
_RAW = ("script", "style")
_FOREIGN = ("svg", "math")
_NOT_TEXT = frozenset("head nav footer aside form button select dialog menu audio video canvas map script style template noscript svg math iframe object textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PARAGRAPHS = frozenset("p blockquote pre figcaption dd dt hr figure details summary".split())
_LISTS = frozenset("ul ol li dl".split())
_KEEP = frozenset(["html", "body", "article", "main"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
_NAMES = (
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget footer header masthead topbar toolbar comments comment commentlist "
    "respond disqus share sharing social newsletter subscribe subscription signup login search related recommended skip legal"
).split()
_BOILER = re.compile(rf"(?:^|[-_])(?:{'|'.join(sorted(_NAMES, key=len, reverse=True))})(?:[-_]?\d*$|[-_](?:box|block|area|section|wrap|wrapper|container|list|item|bar|inner|content|links?|unit|slot|form|top|bottom|left|right|main|thread|body|text)\d*$)", re.I)
#: A tag without anything odd: nothing in it can be read in two ways, so a failed match costs no more than its length.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"'=]*)((?:\s+[^\s/<>\"'=]+(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"'=`/]+))?)*)\s*(/?)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>=]")
_GAP = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)(?:\s?=\s?(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Place of the ``>`` that ends the tag whose name ends at ``at``, or -1. Quotes count behind ``=`` only; one that never
    closes is an ordinary character. What was sought and not found is remembered in ``missing``."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        if m[0] == ">":
            return m.start()
        at = _GAP.match(page, m.end()).end()
        quote = page[at : at + 1]
        if quote and quote in "\"'":
            end = -1 if quote in missing else page.find(quote, at + 1)
            if end < 0:
                missing.add(quote)
            at = max(at, end) + 1


def _tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, value, attributes): kind is text, open, close, or gone for what is no text. Reads the page once from left to
    right; a ``<`` that begins nothing is text."""
    out: list[tuple[str, str, str]] = []
    missing: set[str] = set()
    last, at, size = page.rfind(">"), 0, len(page)

    def find(what: str, start: int) -> int:
        found = -1 if what in missing else page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    def text(start: int, end: int) -> None:
        if start < end:
            out.append(("text", html.unescape(page[start:end]), ""))

    begun = 0  # of the text that is being read
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            text(begun, size)
            return out
        m = _PLAIN_TAG.match(page, at)
        if m:
            end, close, name, attributes, own_end = m.end(), m[1], m[2].lower(), m[3], m[4]
        elif m := _TAG_NAME.match(page, at):
            stop = _tag_end(page, m.end(), missing)
            if stop < 0:
                at += 1
                continue
            end, close, name, attributes, own_end = stop + 1, m[1], m[2].lower(), page[m.end() : stop], page[stop - 1] == "/"
        elif page.startswith("<!--", at):
            text(begun, at)
            stop = find("-->", at + 2)
            begun = at = stop + 3 if stop >= 0 else page.index(">", at) + 1  # one that never closes is its first tag
            continue
        elif page.startswith("<![CDATA[", at):
            text(begun, at)
            stop = find("]]>", at)
            out.append(("text", page[at + 9 : stop], "")) if stop >= 0 else None
            begun = at = stop + 3 if stop >= 0 else at + 9
            continue
        elif page[at + 1 : at + 2] in ("!", "?") or page.startswith("</", at):
            text(begun, at)
            begun = at = page.index(">", at) + 1
            continue
        else:
            at += 1
            continue
        text(begun, at)
        begun = at = end
        if close:
            out.append(("close", name, ""))
        elif name in _RAW:
            stop = None if name in missing else _ENDS[name].search(page, end)
            if stop is None:  # code up to the next tag
                missing.add(name)
                more = page.find("<", end)
                begun = at = more if more >= 0 else size
            else:
                begun = at = stop.end()
            out.append(("gone", name, ""))
        elif own_end and name in _FOREIGN:
            out.append(("gone", name, ""))
        else:
            out.append(("open", name, attributes))


def _is_boilerplate(name: str, attributes: str, in_article: bool, names: bool) -> bool:
    if name in _KEEP:
        return False
    if name in _NOT_TEXT or (name == "header" and not in_article):
        return True
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values).strip().lower(), key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _ROLES):
            return True
        # Names tell of containers; a heading, paragraph or phrase is text, however it is styled.
        if names and key in ("class", "id") and name not in _INLINE and name not in _HEADINGS and name not in _PARAGRAPHS and name != "li":
            if any(_BOILER.search(part) for part in value.split()):
                return True
    return False


def _closings(tokens: list[tuple[str, str, str]]) -> list[int]:
    """For each opening tag the place of its own closing tag, or -1."""
    ends, stacks = [-1] * len(tokens), {}
    for i, (kind, name, _) in enumerate(tokens):
        if kind == "open" and name not in _VOID:
            stacks.setdefault(name, []).append(i)
        elif kind == "close" and stacks.get(name):
            ends[stacks[name].pop()] = i
    return ends


def visible(page: str, names: bool = True) -> list[tuple[str, str, str]]:
    """Tokens outside boilerplate elements; each such element leaves one token ``gone``. One that never closes takes nothing
    out. Without ``names`` what containers are named does not count."""
    tokens = _tokens(page)
    ends = _closings(tokens)
    out, i, article = [], 0, 0
    while i < len(tokens):
        kind, name, attributes = tokens[i]
        if kind == "open" and name not in _VOID and ends[i] >= 0 and _is_boilerplate(name, attributes, article > 0, names):
            out.append(("gone", name, ""))
            i = ends[i] + 1
            continue
        if name in ("article", "main") and kind != "text":
            article = max(0, article + (1 if kind == "open" else -1))
        out.append(tokens[i])
        i += 1
    return out


_GROUPS = ("paragraph", "heading", "list", "other", "link")
_LENGTHS = ("short", "middle", "long")
_TAGS = ("inline", "link tag", "text tag", "list tag", "layout", "article", "gone")


def _group(name: str) -> str:
    # A header that is left is an article's.
    return "paragraph" if name in _PARAGRAPHS else "heading" if name in _HEADINGS or name == "header" else "list" if name in _LISTS else "other"


def _scored(tokens: list[tuple[str, str, str]]) -> list[tuple[int, str, int]]:
    """(place, feature, how many) of each token that counts."""
    out: list[tuple[int, str, int]] = []
    waiting: list[tuple[int, bool, int]] = []  # texts of the block being read: place, in a link, words
    block, links = "other", 0

    def close() -> None:
        words = sum(n for _, _, n in waiting)
        linked = sum(n for _, link, n in waiting if link)
        length = "short" if words < 5 else "middle" if words < 16 else "long"
        # A block that is mostly links is a menu's; a link in a sentence is the sentence's.
        own = "link" if 2 * linked > words else block
        out.extend((place, f"{own} {length}", n) for place, _, n in waiting)
        waiting.clear()

    for i, (kind, value, _) in enumerate(tokens):
        if kind == "text":
            if n := len(value.split()):
                waiting.append((i, links > 0, n))
        elif kind == "gone":
            if value not in _RAW:
                close()
            out.append((i, "gone", 1))
        elif value in _INLINE:
            if value == "a":
                links = int(kind == "open")
            out.append((i, "link tag" if value == "a" else "inline", 1))
        else:
            close()
            block = _group(value) if kind == "open" else "other"
            out.append((i, "article" if value in _KEEP else "text tag" if _group(value) in ("paragraph", "heading") else "list tag" if value in _LISTS else "layout", 1))
    close()
    out.sort()
    return out


MARKS = ("<!--article-->", "<!--/article-->")
#: Least score of a word, and greatest of a tag.
LEAST_WORD, MOST_TAG = 0.05, -0.002


def marked(page: str, names: bool) -> tuple[list, range]:
    """Scored tokens of a page with ``MARKS``, and those of its article."""
    before, own, after = page.replace(MARKS[1], MARKS[0]).split(MARKS[0])
    cut = "<i data-mark>"
    tokens = visible(f"{before}{cut}{own}{cut}{after}", names)
    ends = [i for i, (_, name, attributes) in enumerate(tokens) if name == "i" and "data-mark" in attributes]
    if len(ends) != 2:
        return [], range(0)
    found = [x for x in _scored(tokens) if x[0] not in ends]
    inside = [k for k, (i, _, _) in enumerate(found) if ends[0] < i < ends[1]]
    return found, range(inside[0], inside[-1] + 1) if inside else range(0)


def _words_in(found: list, scores: dict[str, float]) -> set[int]:
    stretch = best_stretch([(k, scores[f] * n) for k, (_, f, n) in enumerate(found)])
    return {k for k in range(stretch[0], stretch[1] + 1) if " " in found[k][1] and found[k][1] not in _TAGS} if stretch else set()


def learn_scores(pages: Iterable[str]) -> dict[str, float]:
    """Log odds of each feature between inside and outside of the marked article, from pages with both ``MARKS``.

    Words are kept above zero and tags below, whatever the sample says, so that a stretch of words never loses to nothing.
    What tags weigh against words is the factor that gets most of the pages right.
    """
    read = [marked(page, names) for page in pages for names in (True, False)]
    inside, outside = Counter(), Counter()
    for found, own in read:
        for k, (_, feature, n) in enumerate(found):
            (inside if k in own else outside)[feature] += n
    features = [*(f"{g} {n}" for g in _GROUPS for n in _LENGTHS), *_TAGS]
    words = [f for f in features if f not in _TAGS]

    def odds(of: list[str]) -> dict[str, float]:
        n_in, n_out = (sum(c[f] for f in of) + len(of) for c in (inside, outside))
        return {f: log((inside[f] + 1) / n_in) - log((outside[f] + 1) / n_out) for f in of}

    of_words, of_tags = odds(words), odds(list(_TAGS))
    best: tuple[float, dict[str, float]] = (-1.0, {})
    for lift in (0.5, 1.0, 1.5, 2.0, 3.0):
        for weight in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
            scores = {f: max(LEAST_WORD, v + lift) for f, v in of_words.items()} | {f: min(MOST_TAG, v * weight) for f, v in of_tags.items()}
            right = 0
            for found, own in read:
                want = {k for k in own if found[k][1] not in _TAGS}
                right += _words_in(found, scores) == want
            if right > best[0]:
                best = (right, scores)
    return best[1]


def labelled_pages(n: int = 240, seed: int = 1) -> list[str]:
    """Pages with a marked article, put together at random from layouts, kinds of paragraphs and the litter around them."""
    rng = random.Random(seed)
    syllables = "ka lo mi tun res po vel an zu gra eth ish om bri dof ner sa el".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 8, high: int = 60) -> str:
        out = words(low, high)
        for tag in ("b", "em", "a href='/x'", "span class=x"):
            if rng.random() < 0.2:
                out += f" <{tag}>{words(1, 3)}</{tag.split()[0]}> {words(2, 9)}"
        return out + (f"<br>{words(4, 12)}" if rng.random() < 0.1 else "")

    def links(tag: str, low: int = 3, high: int = 8) -> str:
        item = {"ul": "li", "div": "span", "table": "td"}[tag]
        return f"<{tag}>" + "".join(f"<{item}><a href='/{k}'>{words(1, 3)}</a></{item}>" for k in range(rng.randint(low, high))) + f"</{tag}>"

    def article() -> str:
        in_div = rng.random() < 0.15
        out = [f"<h1>{words(2, 20)}</h1>"]
        for _ in range(rng.randint(2, 9)):
            kind = rng.random()
            out.append(
                f"<div>{sentence(16)}</div>" if in_div and kind < 0.8 else f"<ul><li>{words(2, 24)}</li><li>{words(2, 24)}</li></ul>" if kind < 0.07
                else f"<h2>{words(1, 6)}</h2><p>{sentence()}</p>" if kind < 0.2 else f"<blockquote><p>{sentence()}</p></blockquote>" if kind < 0.25
                else f"<p>{sentence()}" if kind < 0.35 else f"<p>{words(1, 7)}</p>" if kind < 0.42 else f"<p>{sentence()}</p>"
            )
        if rng.random() < 0.3:
            out.insert(rng.randint(1, len(out)), rng.choice([f"<aside>{words(5, 30)}</aside>", "<figure><img src=a></figure>", "<script>var a = 1</script>"]))
        return "".join(out)

    def litter(end: bool) -> str:
        kind = rng.choice(["menu", "ad", "notice", "side", "brand", "crumbs", "foot", "scripts", "card"])
        return {
            "menu": links(rng.choice(["ul", "div", "table"])), "ad": f"<div class=ad>{words(4, 18)}</div>",
            "notice": f"<div id=cookie-box><span>{words(5, 14)}</span><button>{words(1, 2)}</button></div>",
            "side": f"<div class=sidebar><div><h3>{words(1, 3)}</h3>{links('ul')}</div></div>", "brand": f"<div class=top><div><a href='/'>{words(1, 2)}</a></div><div>{words(2, 6)}</div></div>",
            "crumbs": f"<div><a href='/'>{words(1, 1)}</a> / <a href='/a'>{words(1, 2)}</a> / <span>{words(1, 3)}</span></div>",
            "foot": f"<div><div>{words(3, 10)}</div>{links('ul', 2, 5)}</div>", "scripts": "<script>if (a < b) {}</script><style>p{}</style>",
            "card": f"<div><div><h3><a href='/c'>{words(2, 6)}</a></h3><div>{words(2, 9)}</div></div></div>",
        }[kind]

    pages = []
    for _ in range(n):
        opened, closed = rng.choice([("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<div id=content><div>", "</div></div>"), ("<div><section>", "</section></div>"), ("<table><tr><td>", "</td></tr></table>")])
        lead = "".join(litter(False) for _ in range(rng.randint(0, 4)))
        tail = "".join(litter(True) for _ in range(rng.randint(0, 4)))
        head = f"<html><head><title>{words(2, 6)}</title></head><body>" + (f"<header><div>{words(1, 4)}</div></header><nav>{links('ul')}</nav>" if rng.random() < 0.5 else "")
        pages.append(f"{head}{lead}{opened}{MARKS[0]}{article()}{MARKS[1]}{closed}{tail}" + (f"<footer>{words(3, 12)}</footer>" if rng.random() < 0.5 else "") + "</body></html>")
    return pages


@lru_cache(maxsize=1)
def learned_scores() -> tuple[tuple[str, float], ...]:
    return tuple(learn_scores(labelled_pages()).items())


def best_stretch(scores: list[tuple[int, float]]) -> tuple[int, int] | None:
    """First and last place of the contiguous stretch with the highest sum above zero; the earliest, then longest, of equals."""
    best, found, total, start = 0.0, None, 0.0, None
    for place, score in scores:
        if total <= 0:
            total, start = 0.0, place
        total += score
        if total > best or (found and total == best and start == found[0]):
            best, found = total, (start, place)
    return found


def main_text(page: str, scores: dict[str, float], names: bool = True) -> str:
    """The article of a page: blocks in page order, one a line, white space in a block made one space."""
    tokens = visible(page, names)
    found = best_stretch([(i, scores[f] * n) for i, f, n in _scored(tokens)])
    if found is None:
        return ""
    blocks: list[list[str]] = [[]]
    for kind, value, _ in tokens[found[0] : found[1] + 1]:
        if kind == "text":
            blocks[-1].append(value)
        elif kind == "gone":
            blocks[-1].append(" ") if value in _RAW else blocks.append([])
        elif value in ("br", "wbr"):
            blocks[-1].append(" " if value == "br" else "")
        elif value not in _INLINE:
            blocks.append([])
    return "\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def extract_text(df: DataFrame, *, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", scores: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``df``.

    A null or empty page, or one without words outside boilerplate, has the empty text. A tag that never closes takes
    nothing out, and reading takes time in proportion to the page whatever its quotes and brackets. Rows that repeat are
    read each for itself; further columns are ignored; no rows give none.
    """
    weights = dict(learned_scores()) if scores is None else scores

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page.as_py() or "", weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), F.col(quoted(html_col)).cast("string").alias("html"))
    return rows.mapInArrow(over, "page_id long, url string, text string, n_chars long")
