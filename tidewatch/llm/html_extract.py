"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the element they stand
in, mostly positive in running text, negative in links, menus and the like;
tags cost something. One linear scan finds the contiguous region of the highest
total. The weights are log-odds of lying inside or outside the article, counted
on labelled pages. Elements that never hold article text (scripts, menus,
forms, adverts, comments) are left out of the region's text wherever they are.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns, texts

LABELLED_PAGES = 2_000  # bound of the sample that the weights are fitted on
FEATURES = 5_000  # most features with a weight of their own

# The void, raw-text and block elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CLOSED_BY_NEXT = {"p": frozenset({"p"}), "li": frozenset({"li"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"tr", "td", "th"}), "option": frozenset({"option"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}

# Elements, and words of class, id and role, that mark what is no article text.
ASIDE = frozenset("nav aside footer form script style noscript iframe button select textarea template svg canvas object menu dialog title head".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal "
    "sidebar aside complementary menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo comment comments disqus reply "
    "replies respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager "
    "toolbar widget".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
# In compound names: what denies or only mentions the last part, and what goes with a first part.
WITHOUT = frozenset("has have with without no not non is hide show toggle".split())
PARTS = frozenset("bar block box button buttons form inner item items link links list posts slot unit".split())
ARTICLE = frozenset({"article", "main"})

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAMING = ("class", "id", "role")


def attributes_of(text: str) -> dict[str, str]:
    """Attributes of a tag by their names in lower case, in order; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ('"', "'") else value)
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    style = re.sub(r"\s", "", attributes.get("style", "")).lower()
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style


def pieces(page: str) -> Iterator[tuple[str, str, str, str]]:
    """``(kind, name, attributes, text)`` of a page in order; kind is open, close or text.

    Comments, declarations and an unfinished tag at the end give nothing; the
    text of raw elements comes as it is, up to their end tag.
    """
    at = 0
    while True:
        found = TAG.search(page, at)
        if found is None:
            if at < len(page):
                yield "text", "", "", page[at:]
            return
        if found.start() > at:
            yield "text", "", "", page[at : found.start()]
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            yield "close", name, "", ""
            continue
        yield "open", name, found[3], ""
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            yield "text", "", "", page[at:stop]
            at = stop


def marks(name: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is no article text, whether only outside an article, and its feature."""
    words: list[str] = []
    named: set[str] = set()
    given = attributes_of(attributes) if attributes else {}
    for kind, value in given.items():
        if kind in NAMING:
            for token in value.lower().split():
                parts = re.findall(r"[a-z0-9]+", token)
                words += parts
                if parts and WITHOUT.isdisjoint(parts[:-1]):
                    named.add(parts[0] if len(parts) > 1 and PARTS.issuperset(parts[1:]) else parts[-1])
                    named.add(parts[-1])
    aside = name in ASIDE or not ASIDE_WORDS.isdisjoint(named) or is_hidden(given)
    header = name == "header" or not HEADER_WORDS.isdisjoint(named)
    return aside, header, f"{name}.{words[0]}" if words else name


@functools.lru_cache(maxsize=4096)
def _marks(name: str, attributes: str) -> tuple[bool, bool, str]:
    return marks(name, attributes)


def _spared(elements: list[tuple[str, bool, bool, str, int]]) -> set[int]:
    """Elements whose own mark does not count, as they are or hold the article.

    The body, articles and mains themselves, and what holds a main. Where every
    article and main of the page stands in a marked element, all that hold one.
    """
    spared = {i for i, (name, *_) in enumerate(elements) if name in ("html", "body")}
    chains = []
    for i, (name, *_) in enumerate(elements):
        if name in ARTICLE:
            chain = [i]
            while elements[chain[-1]][4] >= 0:
                chain.append(elements[chain[-1]][4])
            chains.append(chain)
            spared.add(i)
            if name == "main":
                spared.update(j for j in chain if elements[j][0] not in ASIDE or elements[j][0] == "form")
    if not any(all(j in spared or not (elements[j][1] or elements[j][2]) for j in chain) for chain in chains):
        spared.update(j for chain in chains for j in chain)
    return spared


def scan(page: str) -> Iterator[tuple[str, str, bool, bool, bool, str, int]]:
    """``(feature, text, breaks, aside, inside, tag, article)`` for every tag and text of a page.

    ``breaks`` tells a block bound, ``aside`` that no article text is here,
    ``inside`` that an article or main element is open; ``tag`` is empty for a
    text; ``article`` is the number of the outermost open article element, -1
    without one.
    """
    # Name, whether aside, whether a header, feature and parent of each element; then tags and texts by their element.
    elements: list[tuple[str, bool, bool, str, int]] = []
    events: list[tuple[int, str, str]] = []
    stack: list[int] = []
    for kind, name, attributes, text in pieces(page):
        if kind == "text":
            events.append((stack[-1] if stack else -1, text, ""))
            continue
        if kind == "open":
            ends = CLOSED_BY_NEXT.get(name)
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if elements[stack[i]][0] in ends:
                        del stack[i:]
                        break
                    if elements[stack[i]][0] in BLOCK:
                        break
            elements.append((name, *_marks(name, attributes), stack[-1] if stack else -1))
            events.append((len(elements) - 1, "", name))
            if name not in VOID and not attributes.endswith("/"):
                stack.append(len(elements) - 1)
        else:
            for i in range(len(stack) - 1, -1, -1):
                if elements[stack[i]][0] == name:
                    del stack[i:]
                    break
            events.append((stack[-1] if stack else -1, "", "/" + name))
    spared = _spared(elements)
    states: list[tuple[bool, bool, str, int]] = []
    for i, (name, own_aside, header, feature, parent) in enumerate(elements):
        aside, inside, shown, article = states[parent] if parent >= 0 else (False, False, "", -1)
        article = i if article < 0 and name == "article" else article
        aside = aside or (i not in spared and (own_aside or (header and not inside)))
        # Inline elements but links say nothing about the kind of text.
        states.append((aside, inside or name in ARTICLE, feature if name in BLOCK or name == "a" or name in ASIDE else shown, article))
    states.append((False, False, "", -1))  # outside of all elements: -1
    for at, text, tag in events:
        aside, inside, shown, article = states[at]
        if not tag:
            yield shown, text, False, aside, inside, "", article
        else:
            name = tag.lstrip("/")
            yield name if tag[0] == "/" else elements[at][3], "", name in BLOCK, aside, inside, tag, article


def feature_counts(page: str) -> Counter:
    """How often each feature comes inside and outside the article of a labelled page.

    Words that extraction leaves out by itself tell nothing about the others.
    """
    out: Counter = Counter()
    for feature, text, _, aside, inside, tag, _ in scan(page):
        if aside and not tag:
            continue
        good = inside and not aside
        out[("tag:" + tag if tag else "word:" + feature, good)] += 1 if tag else len(text.split())
    return out


def weights_of(rows: list) -> dict[str, float]:
    """Smoothed log-odds per feature, between bounds; tags always cost."""
    out = {}
    for row in rows:
        odds = math.log((row["good"] + 1) / (row["bad"] + 1))
        out[row["feature"]] = min(-0.05, odds / 4) if row["feature"].startswith("tag:") else max(-4.0, min(4.0, odds))
    return out


def fit_weights(pages: DataFrame, html: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from pages whose article is marked up by exactly one ``article`` element.

    At most ``most`` such pages are used, different ones of the smallest
    hashes, so copies of a page count once; the result has at most
    ``FEATURES`` entries.
    """
    marked = pages.select(F.col(html).alias("html"), F.xxhash64(html).alias("h")).where(
        F.regexp_count("html", F.lit("(?i)<article[\\s>]")) == 1
    )
    # Only hashes are put in order; pages beyond the last one stay where they are.
    last = marked.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    some = marked.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in texts(batch.column(0)):
                total.update(feature_counts(page))
            names = sorted({f for f, _ in total})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([total[f, g] for f in names], pa.int64()) for g in (True, False))],
                names=["feature", "good", "bad"],
            )

    counted = some.mapInArrow(run, "feature string, good bigint, bad bigint")
    summed = counted.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return weights_of(summed.orderBy(F.desc(F.col("good") + F.col("bad")), "feature").limit(FEATURES).collect())


# Scores where no label tells: running text is content, other words hardly.
PRIOR = {"word:p": 1.0, "word:pre": 1.0, "word:blockquote": 1.0, "word:article": 1.0, "word:main": 1.0, "word:h1": 0.5, "word:h2": 0.5, "word:h3": 0.5, "word:a": -0.5}
DEFAULT_WORD, DEFAULT_TAG = 0.2, -0.3
ASIDE_WORD = -0.1  # left out anyway, so it may stand between two parts of an article


def _whole(items: list[tuple], start: int, stop: int) -> tuple[int, int]:
    """The region widened to the bounds of the blocks and articles in which it begins and ends."""
    worded = [i for i in range(start, stop) if not items[i][5] and not items[i][3] and items[i][1].strip()]
    if not worded:
        return start, stop
    first, last = worded[0], worded[-1]
    one, other = items[first][6], items[last][6]
    while first > 0 and (items[first - 1][6] == one if one >= 0 else not items[first - 1][2]):
        first -= 1
    while last + 1 < len(items) and (items[last + 1][6] == other if other >= 0 else not items[last + 1][2]):
        last += 1
    return min(start, first), max(stop, last + 1)


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of the best region: its blocks in order, each with single spaces."""
    items = list(scan(page))
    best, best_from, best_to = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, (feature, text, _, aside, _, tag, _) in enumerate(items):
        if tag:
            score = min(-0.05, weights.get("tag:" + tag, DEFAULT_TAG))
        else:
            n = len(text.split())
            if not n:
                continue
            name = "word:" + feature
            score = ASIDE_WORD if aside else weights.get(name)
            if score is None:
                score = PRIOR.get(name.split(".")[0], DEFAULT_WORD)
            score *= n
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, best_from, best_to = total, begin, i + 1
    blocks: list[str] = []
    parts: list[str] = []
    if best > 0:
        best_from, best_to = _whole(items, best_from, best_to)
    for _, text, breaks, aside, _, _, _ in items[best_from:best_to]:
        if breaks and parts:
            blocks.append("".join(parts))
            parts = []
        if text and not aside:
            parts.append(entities.unescape(text) if "&" in text else text)
    blocks.append("".join(parts))
    return " ".join(word for block in blocks for word in block.split())


def main_text(pages: DataFrame, weights: dict[str, float], html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every whole page; empty if there is none.

    A missing page counts as empty. Character references are decoded, white
    space in a block becomes one space, blocks are joined by one space. Broken
    or cut-off markup is read as far as it goes. Other columns pass through, a
    column with the result's name is replaced, repeated rows give the same
    text, an empty table stays empty.
    """

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([extract(page, weights) for page in texts(column)], pa.string())]

    return add_columns(pages, [html], f"`{text}` string", run)
