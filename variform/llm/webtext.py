"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text with the elements they stand in. A linear classifier of documented weights gives each
block a cost for being content or boilerplate; these are the terminal capacities. Blocks that follow each other and
blocks that are near in the element tree are tied by smoothness edges. The minimum cut separates the article from
menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Pages are independent, so one pass of tasks over the table does it and any lost task is repeated alone.

Defined cases: null and empty html give empty text; broken markup (unclosed, stray or cut tags) is read as far as it
goes; repeated rows give repeated results; very long pages are whole; an empty table gives no rows; extra columns are
left alone, ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variform.llm.mincut import label

# fixed values: elements by their part in a page
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody tfoot thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template svg math iframe object canvas head title select textarea button datalist audio video map".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
CELLS = frozenset("td th br".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs captcha comment comments commentlist "
    "consent cookie cookies copyright dialog disqus donate footer footnav form gdpr header legal links login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promos promoted recommended "
    "register related remark replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe tagcloud "
    "tags teaser toc toolbar topbar widget widgets".split()
)
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset("article body content entry main post story text".split())

#: Weights of the classifier: log odds of content.
WEIGHTS = {
    "bias": -1.0,
    "content_tag": 4.0,
    "content_name": 2.0,
    "boilerplate": -9.0,
    "heading": 1.0,
    "paragraph": 1.5,
    "list": -0.5,
    "link_share": -3.0,
    "log_words": 0.5,
    "sentence": 0.5,
}
#: Smoothness: blocks in a row, and blocks under one parent element.
NEXT_WEIGHT, SIBLING_WEIGHT = 0.4, 0.8

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Element:
    tag: str
    number: int
    content: int  # 1 by tag, 2 by name, 0
    boilerplate: bool
    skipped: bool


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    parent: int
    content: int
    boilerplate: bool


ROOT = Element("", 0, 0, False, False)


def _element(tag: str, attributes: str, number: int, parent: Element, in_article: bool) -> Element:
    """An element with what it takes over from those around it."""
    names: set[str] = set()
    role = hidden = ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'")
            name = name.lower()
            if name in ("class", "id"):
                names.update(n.lower() for n in _NAMES.findall(entities.unescape(value)))
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = "hidden"
    own_content = 1 if tag in CONTENT_TAGS or role in ("main", "article") else 2 if names & CONTENT_NAMES else 0
    # the head of an article holds its title; that of a page does not
    off = (
        tag in BOILERPLATE_TAGS
        or (tag == "header" and not in_article)
        or role in BOILERPLATE_ROLES
        or (bool(names & BOILERPLATE_NAMES) and tag not in ("html", "body", "main") and not (tag in ("header", "h1", "h2") and in_article))
    )
    content = min(x for x in (own_content, parent.content) if x) if own_content or parent.content else 0
    return Element(tag, number, content, parent.boilerplate or off, parent.skipped or tag in SKIPPED_TAGS or bool(hidden))


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order. Inline elements do not part a block; character references are decoded."""
    out: list[Block] = []
    stack = [ROOT]
    pieces: list[str] = []
    linked = links = number = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                inner = next((e for e in reversed(stack) if e.tag in BLOCK_TAGS), ROOT)
                outer = next((e for e in reversed(stack) if e.tag in BLOCK_TAGS and e is not inner), ROOT)
                out.append(Block(text, linked, inner.tag, outer.number, stack[-1].content, stack[-1].boilerplate))
            pieces.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        data = page[at : found.start() if found else end]
        if data and not stack[-1].skipped:
            pieces.append(data)
            linked += len(data) if links else 0
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in BLOCK_TAGS:
                flush()
            if any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
            links = sum(e.tag == "a" for e in stack)
            continue
        if tag in BLOCK_TAGS:
            flush()
            # elements that a new one of the kind closes
            if tag in ("li", "dd", "dt", "tr", "option"):
                _close(stack, (tag, "dd", "dt") if tag in ("dd", "dt") else (tag,), ("ul", "ol", "dl", "table", "select", "menu"))
            if tag not in ("html", "body"):
                _close(stack, ("p",), BLOCK_TAGS - {"p"})
        elif tag in CELLS:
            pieces.append(" ")
        if tag in VOID_TAGS or found[3].endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        number += 1
        in_article = any(e.tag in CONTENT_TAGS for e in stack)
        stack.append(_element(tag, found[3], number, stack[-1], in_article))
        links += tag == "a"
        if tag in RAW_TAGS:  # their inside is no markup
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = close.start() if close else end
    flush()
    return out


def _close(stack: list[Element], tags: tuple[str, ...], fence: frozenset | tuple) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in fence:
            return


def cost(block: Block) -> float:
    """Log odds that a block is content."""
    words = block.text.count(" ") + 1
    w = WEIGHTS
    return (
        w["bias"]
        + (w["content_tag"] if block.content == 1 else w["content_name"] if block.content == 2 else 0.0)
        + (w["boilerplate"] if block.boilerplate else 0.0)
        + (w["heading"] if block.tag in ("h1", "h2", "h3") else w["paragraph"] if block.tag in ("p", "pre", "blockquote") else w["list"] if block.tag == "li" else 0.0)
        + w["link_share"] * min(1.0, block.linked / len(block.text))
        + w["log_words"] * min(5, words.bit_length() - 1)
        + (w["sentence"] if block.text[-1] in ".!?…。" else 0.0)
    )


def extract(page: str | None) -> str:
    parts = blocks(page) if page else []
    if not parts:
        return ""
    edges = [(k, k + 1, NEXT_WEIGHT) for k in range(len(parts) - 1)]
    last: dict[int, int] = {}
    for k, part in enumerate(parts):
        if part.parent in last:
            edges.append((last[part.parent], k, SIBLING_WEIGHT))
        last[part.parent] = k
    return "\n".join(part.text for part, content in zip(parts, label([cost(p) for p in parts], edges)) if content)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""

    @F.pandas_udf("string")
    def article(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(page) for page in batch], dtype=object)

    others = [c for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*others, article("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def report(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", "n_chars")
