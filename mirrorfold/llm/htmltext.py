"""Main text of web pages by two passes of rules over blocks.

A page is read once into blocks, runs of text between tags that break a line, each with its place and the
share of its text in links. What stands in navigation, forms, asides and the like is out. In the first
pass stop words, length and link share decide a block, or leave it open when it is short; in the second an
open block takes the label of the nearest decided ones around it. An article or main element is evidence,
no verdict: fewer stop words do there, and a block that has none is open, not lost; its open blocks look to
each other, and stand for the page where no block of the page is decided to be text.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.llm.common import need, table
from mirrorfold.llm.tokens import arrow, rows

SHORT, LONG = 70, 200  # characters
LINKS = 0.4  # share of a block's characters in links from which it is no text
FEW, MANY = 0.12, 0.25  # stop words among the words of a block

# Frequent function words of the languages that pages come in
STOP = frozenset(
    "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its just like more my no not of on one only or other our out over she so some than that the their them then there these they this those to under up was we were what when where which who will with would you your "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ou où par pas plus pour que qui sa se ses son sont sur un une vous y "
    "al como con cuando de del desde el ella en entre era es esta este fue ha hasta la las lo los más me mi muy no o para pero por que se ser si sin sobre son su sus también un una y ya".split()
)

#: Their whole content is out, raw or not.
OUT = frozenset("script style noscript template iframe object svg math canvas audio video map head title nav header footer aside form button select textarea option dialog menu figure".split())
RAW = frozenset("script style noscript template iframe svg math textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img input br".split())
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that name furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|sign-up|login|paywall|nav(?:bar|igation)?|menu|breadcrumbs?|pagination|pager|sidebar|side|aside|widget|related|recommended|trending|share|sharing|social|comments?|comment-list|disqus|replies|reply|respond|footer|foot|header|masthead|copyright|legal|disclaimer|toolbar|search|form|tags|tagcloud|complementary|contentinfo|toc)(?:$|[\s_-]|\d)",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Whole words of class, id and role that make an article element furniture.
BESIDE = re.compile(r"(?:^|\s)(?:comments?|reply|replies|related|recommended|teasers?|promo|ads?|adverts?|advertisements?|sponsored|widgets?)(?:$|\s|[_-]+(?:item|body|card|box|list|entry)(?:$|\s))", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    out: bool  # in furniture
    main: bool  # in an article or the main part
    heading: bool


def furniture(tag: str, attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role", "itemprop") and tag not in ("body", "html") and (BESIDE if tag in MAIN else FURNITURE).search(value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Open and stray tags are put up with."""
    made: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements that matter: name, whether they begin furniture
    linked = out = main = link = 0
    heading = False
    at, end = 0, len(page)

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if link:
            linked += len(SPACE.sub("", text))

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            made.append(Block(text, linked, out > 0, main > 0, heading))
        parts.clear()
        linked = 0

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:].removesuffix("]]>"))
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if closing:
            if any(name == tag for name, _ in stack):
                while True:
                    name, began = stack.pop()
                    out -= began
                    main -= name in MAIN
                    link -= name == "a"
                    if name == tag:
                        break
            heading = heading and not re.fullmatch("h[1-6]", tag)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if attributes.rstrip().endswith("/") and tag not in INLINE:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # close an open one of their kind
            if stack and stack[-1][0] == tag:
                _, began = stack.pop()
                out -= began
        if tag == "a" and link:
            continue
        inside = main > 0
        began = (tag in OUT and not (inside and tag in ("header", "figure"))) or furniture(tag, attributes)
        stack.append((tag, began))
        out += began
        main += tag in MAIN
        link += tag == "a"
        if re.fullmatch("h[1-6]", tag):
            heading = True
    flush()
    return made


def first_pass(b: Block) -> bool | None:
    """Kept, dropped, or open."""
    if b.out:
        return False
    if b.linked > LINKS * max(1, len(b.text.replace(" ", ""))) and (b.linked > 20 or not b.main):
        return False
    words = WORDS.findall(b.text.lower())
    density = sum(w in STOP for w in words) / max(1, len(words))
    if len(b.text) < SHORT:
        return False if not b.main and re.match(r"\s*(?:©|\(c\)\s|copyright\b)", b.text, re.I) else None
    if density >= MANY:
        return True
    if density >= FEW:
        return True if b.main or len(b.text) >= LONG else None
    return None if b.main or len(words) >= 5 and len(b.text) >= LONG else False


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """The open blocks' labels, from the nearest decided blocks before and after; furniture says nothing.

    Blocks of an article or main element look to others of such. A heading goes with what follows.
    """
    kept = [bool(x) for x in labels]
    for main in (False, True):
        places = [k for k, b in enumerate(found) if not b.out and (b.main or not main)]
        before, last = {}, None
        for k in places:
            last = last if labels[k] is None else labels[k]
            before[k] = last
        ahead = None
        for k in reversed(places):
            ahead = ahead if labels[k] is None else labels[k]
            if labels[k] is None and found[k].main == main:
                near = [x for x in (before[k], ahead) if x is not None]
                kept[k] = any(near) if main else bool(ahead) if found[k].heading else bool(near) and all(near)
    if not any(kept):
        kept = [b.main and x is None for b, x in zip(found, labels, strict=True)]
    return kept


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by an empty line; empty for none."""
    if not page:
        return ""
    found = blocks(page)
    kept = second_pass(found, [first_pass(b) for b in found])
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty pages, and pages without text, give the empty text. Null ids and urls stay as they are,
    repeated rows give a row each. No rows: no result rows.
    """
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make(batches):
        yield from arrow(((p, u, t, len(t)) for p, u, h in rows(batches, "page_id", "url", "html") for t in (main_text(h),)), schema, 512)

    return need(pages, "page_id", "url", "html").mapInArrow(make, "page_id long, url string, text string, n_chars long")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
