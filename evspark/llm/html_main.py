"""Main text of web pages by two passes over blocks.

The first pass gives each block a label from its container, link density, length and stop-word
density: good, bad, or ambiguous. The second lets ambiguous blocks inherit the label of the nearest
decided neighbours within their part of the page. Where no block comes out good, the two passes are made
again without the tests that a page may fail as a whole: stop words (of four languages), and wrappers such
as forms or classes if they hold most of the page's text outside links.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import to_id

#: Fixed lists: elements never shown or never part of an article, block elements, articles' containers.
SILENT = "script style noscript template svg iframe select datalist".split()
BOILERPLATE = "nav header footer aside form menu dialog button textarea label fieldset input".split()
CONTAINERS = "html body main article section div header footer nav aside form menu dialog figure table ul ol dl fieldset td th tr blockquote details hgroup address center".split()
BREAKS = set(CONTAINERS) | set("p h1 h2 h3 h4 h5 h6 li dt dd pre hr figcaption caption tbody thead tfoot summary title option legend".split())
MAIN = ("article", "main")
#: Fixed pattern over class, id and role of what surrounds an article.
AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|"
    r"header|footer|masthead|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|disqus|respond|reply|replies|"
    r"pagination|pager|login|signup|toolbar|search|copyright|legal|contentinfo|navigation|complementary)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Fixed patterns of names that decide alone inside an article: whole names, and first parts of compound ones.
AROUND_WHOLE = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|nav\w*|menu|breadcrumbs?|footer|sidebar|"
    r"widget|related|recommend\w*|share|sharing|social|comments?|disqus|respond|replies|pagination|pager|login|signup|toolbar|copyright)",
    re.IGNORECASE,
)
AROUND_FIRST = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|popup|modal|newsletter|breadcrumbs?|sidebar|comments?|disqus|pagination)[_-]", re.IGNORECASE)
#: What ends a sentence.
_SENTENCE = re.compile(r"[.!?…:;。！？](?:[\s\"'”’»)\]]|$)")
#: Fixed lists of frequent function words in four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there "
    "le la les de des du et un une en que qui dans pour pas sur au aux est par il elle ce se sont avec plus ne leur mais ou "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
    "el los las del y en un una que por con para no es se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.DOTALL)
_LOOSE = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.DOTALL)  # where quotes are never closed
_MODIFIER = re.compile(r"(?:has|with|without|no|is|not)[-_]", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN_NAME = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.IGNORECASE)
_HIDDEN = re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)


@dataclass
class Block:
    text: str
    links: int  # code points inside links
    around: int  # 2 inside boilerplate, 1 inside what may be boilerplate or a wrapper, else 0
    part: int  # number of the article it stands in, 0 outside
    heading: bool
    named: bool = False  # inside an article, in what a name calls its surroundings: bad if links say so too
    label: str = ""


def _tags(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """(text, tag after it); each part of the page is scanned a bounded number of times."""
    at, last, strict = 0, page.rfind(">"), True
    begin = 0
    while (start := page.find("<", at)) >= 0:
        m = _TOKEN.match(page, start) if strict or page.startswith("<!", start) or page.startswith("<?", start) else _LOOSE.match(page, start)
        if m is None and start < last and page[start + 1 : start + 2].isalpha() | page.startswith("</", start):
            strict = False
            m = _LOOSE.match(page, start)
        if m is None:
            if start > last and not page.startswith("<!--", start):
                break  # no tag can end any more
            at = start + 1
            continue
        yield page[begin:start], m
        begin = at = m.end()
        if m[1] and m[1].lower() in SILENT and page[start + 1] != "/" and not m[2].endswith("/"):
            shut = re.compile(rf"</{m[1]}\b[^>]*>", re.IGNORECASE).search(page, at)
            begin = at = shut.end() if shut else len(page)
    yield page[begin:], None


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles and comments are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # (element, around, part, named) of open containers
    open_: Counter = Counter()
    text: list[str] = []
    links, link, around_block, named_block, heading, head, parts = 0, False, 0, False, False, False, 0

    def close() -> None:
        nonlocal links, around_block, named_block, heading
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            around, part, named = stack[-1][1:] if stack else (0, 0, False)
            out.append(Block(whole, links, max(around, around_block), part, heading, named or named_block))
        text.clear()
        links, around_block, named_block, heading = 0, 0, False, False

    for piece, m in _tags(page):
        if piece and not head:
            text.append(piece)
            links += len(piece.strip()) if link else 0
        if m is None or m[1] is None:
            continue
        name, closing, attributes = m[1].lower(), m[0][1] == "/", m[2]
        if name == "head":
            head = not closing
            continue
        if head and (name in CONTAINERS or name in ("p", "h1", "h2")):
            head = False  # never closed
        if head or name in SILENT:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            link = not closing
            continue
        if name in BREAKS:
            close()
        if name in CONTAINERS or name in BOILERPLATE:
            if name == "input":
                continue
            if closing:
                if open_[name]:
                    close()
                    while stack:
                        inner = stack.pop()[0]
                        open_[inner] -= 1
                        if inner == name:
                            break
            elif not attributes.endswith("/"):
                close()
                around, part, named = stack[-1][1:] if stack else (0, 0, False)
                level, also = _around(name, attributes, bool(part))
                if name in MAIN and not part:
                    parts += 1
                    part = parts
                own = 1 if name == "form" else 2 * (name in BOILERPLATE and not (part and name == "header"))  # an article's own header
                stack.append((name, max(around, own, level), part, named or also))
                open_[name] += 1
        elif name in BREAKS and not closing:
            heading = len(name) == 2 and name[0] == "h" and name != "hr"
            around_block, named_block = _around(name, attributes, bool(stack and stack[-1][2]), heading)
    close()
    return out


def _around(name: str, attributes: str, inside: bool = False, heading: bool = False) -> tuple[int, bool]:
    """(2 for hidden elements, 1 for those whose class, id or role names what surrounds an article; whether a name merely hints at it).

    Inside an article, and for headings, only whole names and a few first parts decide; others are hints.
    """
    if not attributes or name in ("body", "html", *MAIN):
        return 0, False
    if _HIDDEN.search(attributes) or _HIDDEN_NAME.search(_QUOTED.sub('""', attributes)):
        return 2, False
    names = [word for found in _ATTRIBUTE.findall(attributes) for value in found for word in value.split() if AROUND.search(word) and not _MODIFIER.match(word)]
    if not (inside or heading):
        return int(bool(names)), False
    return int(any(AROUND_WHOLE.fullmatch(word) or AROUND_FIRST.match(word) for word in names)), bool(names)


def _linked(b: Block, share: float) -> str:
    """The label of a block whose links are more than a share of it: bad, or ambiguous where an article has it.

    In an article links alone don't decide: a heading or a sentence is as good as others, a bare link as its neighbours,
    unless a name hints that it belongs to the surroundings.
    """
    if b.links <= share * len(b.text):
        return ""
    if not b.part or b.named:
        return "bad"
    return "near" if b.heading or _SENTENCE.search(b.text) else "short"


def classify(
    blocks: list[Block], *, low: int = 70, high: int = 200, few: float = 0.30, many: float = 0.32, link_share: float = 0.33
) -> list[Block]:
    """Label every block good or bad."""
    for b in blocks:
        words = b.text.lower().split()
        density = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        linked = _linked(b, link_share)
        if b.around or linked:
            b.label = "bad" if b.around else linked
        elif len(b.text) < low:
            b.label = "short"
        elif density >= many and len(b.text) >= high:
            b.label = "good"
        elif density >= few or b.part:
            b.label = "near"
        else:
            b.label = "bad"
    _inherit(blocks)
    if blocks and not any(b.label == "good" for b in blocks):
        plain = [max(0, len(b.text) - b.links) * (b.around < 2) for b in blocks]
        wrapped = 2 * sum(n for b, n in zip(blocks, plain, strict=True) if b.around == 1) > sum(plain)
        for b in blocks:
            bad = b.around > wrapped or _linked(b, link_share) == "bad"
            b.label = "bad" if bad else "near" if len(b.text) >= low else "short"
        if not any(b.label == "near" for b in blocks):  # a page of short paragraphs alone
            for b in blocks:
                b.label = "near" if b.label == "short" else b.label
        _inherit(blocks)
    return blocks


def _inherit(blocks: list[Block]) -> None:
    """Short and near blocks take the label of the nearest decided ones of their part of the page.

    What an article marks as its own is undecided at worst; it is good where no neighbour says otherwise.
    """
    by_part: dict[int, list[Block]] = {}
    for b in blocks:
        if not b.around or b.label in ("near", "short"):
            by_part.setdefault(b.part, []).append(b)
    for part, own in by_part.items():
        labels = [b.label for b in own]
        some = "near" in labels or "good" in labels
        sides: list[list] = [[None] * len(own), [None] * len(own)]
        for side, order in enumerate((range(len(own)), range(len(own) - 1, -1, -1))):
            seen = None
            for i in order:
                sides[side][i] = seen
                if labels[i] in ("good", "bad"):
                    seen = i
        for i, b in enumerate(own):
            if labels[i] in ("good", "bad"):
                continue
            near = [k for k in (sides[0][i], sides[1][i]) if k is not None]
            found = {labels[k] for k in near}
            if part:
                b.label = "bad" if found == {"bad"} and labels[i] == "short" and not b.heading and not some else "good"
            elif len(found) == 1:
                b.label = found.pop()
            elif found and b.heading:
                b.label = labels[near[-1]]  # what follows it
            elif found:
                b.label = "good" if labels[i] == "near" else labels[min(near, key=lambda k: abs(k - i))]
            else:
                follows = b.heading and labels[i + 1 : i + 2] == ["near"]
                b.label = "good" if labels[i] == "near" or follows else "bad"


def main_text(page: str | None, **options) -> str:
    if not page:
        return ""
    return "\n".join(b.text for b in classify(blocks_of(page), **options) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole source.

    A null or empty page has the empty text; markup without an end is read as text or to the page's end; pages
    of any length are read whole; repeated rows and null ids or urls are kept row by row; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h, **options) for h in pdf["html"]]
            yield pd.DataFrame(
                {"page_id": pd.array([to_id(i) for i in pdf["page_id"]], "Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]}
            )

    rows = pages.select(
        F.col(id_col).cast("long").cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
