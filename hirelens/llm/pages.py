"""Main text of web pages by two-pass block rules.

A page is split into blocks at block-level tags. Each block has its text, the share of it
inside links, its density of stop words and the elements it stands in.

Pass 1 decides what it can: blocks in navigation, headers, footers, sidebars, forms, notices,
adverts, scripts, styles or reader comments (by element, or by class, id or role) are
boilerplate, as are blocks with many links; where a page marks its article, blocks outside
are boilerplate too. A class, id or role names boilerplate if one of its tokens consists of such
words and of words of place or layout alone ("site-footer", not "has-sidebar" or
"search-results"). An article or main element is never boilerplate by its own name, and a form,
a header or a named element around one only if the page has prose in an article elsewhere. A
header inside an article belongs to it. Long blocks and blocks of prose (by stop words) are content. Headings and
short blocks without such a sign stay open.

Pass 2 looks from each open block to the nearest block on either side, within the same
article or outside it, whose text (not its element) has decided it. The open block inherits
their label; if they differ, or if there is none, it is content.

Stop words are not a fixed list: they are the commonest words of the whole table, per language
of the page as its html tag states it, so the rules work for any language. The ``LANGUAGES``
languages with the most words have lists of their own, all others share one, so that the lists
have a bound however many languages a crawl makes up. Character references are
decoded, white space in a block becomes one space, blocks are joined by a line feed; nothing
else is dropped and nothing is cut short.

Pages are read in time proportional to their length, whatever their markup (``Tags``).

Edge cases: a null or empty page has an empty text; a page of boilerplate alone too; unclosed or
crossing elements are read as far as they go, a tag whose quote is never closed ends at the next
">", one without that is text; repeated pages and pages with
null ids are read alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelens.llm.common import map_text, materialize

STOP_WORDS = 50  # per language
LANGUAGES = 1000  # with stop words of their own
OTHERS = "*"  # stands for all others: no page states it, as a stated language has letters only
LINK_DENSITY, STOP_DENSITY, LONG = 0.5, 0.2, 200

# Element names of HTML.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
select summary table tbody td tfoot th thead title tr ul""".split())
HIDDEN = frozenset("""script style noscript template svg canvas iframe object textarea select button head title
math audio video""".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
AROUND = frozenset("form header".split())  # boilerplate, unless the article is inside
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
#: Words of class, id or role that name boilerplate.
NAMES = re.compile(
    r"(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice|alert|popups?|"
    r"modal|overlay|newsletter|subscribe|signup|sidebars?|side|widgets?|menus?|nav|navbar|navigation|breadcrumb\w*|footer|"
    r"header|masthead|comment|comments|disqus|respond|share|sharing|social|related|recommend\w*|pagination|pager|"
    r"toolbar|search|login|complementary|contentinfo|dialog)", re.I)
#: Words that may stand beside them in a token: they say where or in which form, not what.
PLACES = re.compile(
    r"[0-9x]*|[a-z]|js|site|page|main|global|top|bottom|left|right|upper|lower|primary|secondary|first|last|"
    r"mobile|desktop|sticky|fixed|inner|outer|lists?|items?|links?|buttons?|btn|icons?|bar|box|boxes|blocks?|"
    r"container|wrapper|wrap|area|zone|section|group|row|col|column|panel|slot|unit|form|field|input|body|"
    r"posts|articles|stories|reply|thread", re.I)
#: A comment, a declaration or a tag; quoted values may hold ">". Nothing is tried twice.
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: The same where a quote is never closed: the next ">" ends the tag.
_PLAIN_TAG = re.compile(r"<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_BEGIN = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]+)", re.I)
_SPACE = re.compile(r"\s+")


def names_boilerplate(named: str) -> bool:
    """Whether one of the tokens of class, id or role values names boilerplate."""
    for token in named.split():
        parts = re.split("[_-]+", token)
        bad = [NAMES.fullmatch(p) for p in parts]
        if any(bad) and all(b or PLACES.fullmatch(p) for b, p in zip(bad, parts)):
            return True
    return False


class Tags:
    """The tags, comments and declarations of a page, in time proportional to its length. A
    quote that is never closed makes a match run to the end of the page in vain; after a few of
    those quotes are not heeded any more."""

    def __init__(self, page: str):
        self.page, self.last, self.vain = page, page.rfind(">"), 0

    def after(self, at: int) -> re.Match | None:
        """The first one that begins at ``at`` or later."""
        page, n = self.page, len(self.page)
        at = page.find("<", at)
        while at >= 0:
            m = None
            if _BEGIN.match(page, at):
                if self.vain <= 8 * n:
                    m = _TAG.match(page, at)
                    self.vain += 0 if m else n - at
                m = m or (_PLAIN_TAG.match(page, at) if at < self.last else None)
            if m:
                return m
            if at > self.last and not page.startswith("<!--", at):
                return None  # nothing can end any more
            at = page.find("<", at + 1)
        return None


class Block:
    """Text of one block, the number of its characters in links, and where it stands;
    ``around``: in an element whose name is boilerplate, but which has an article in it."""

    __slots__ = ("text", "linked", "hidden", "bad", "article", "heading", "around")

    def __init__(self, text: str, linked: int, hidden: bool, bad: bool, article: int, heading: bool):
        self.text, self.linked, self.hidden, self.bad = text, linked, hidden, bad
        self.article, self.heading, self.around = article, heading, False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, hidden, boilerplate, article, named
    names: list[list[bool]] = []  # of the open elements named boilerplate: whether an article is inside
    within: list[list[bool] | None] = []  # the innermost of those, for each block
    parts: list[str] = []
    links = 0
    linked = 0
    depth = {"hidden": 0, "bad": 0, "article": 0}
    articles = 0
    open_: Counter = Counter()  # open elements by name

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            heading = any(re.fullmatch("h[1-6]", s[0]) for s in stack[-3:])
            out.append(Block(text, linked, depth["hidden"] > 0, depth["bad"] > 0,
                             articles if depth["article"] else 0, heading))
            within.append(names[-1] if names else None)
        parts.clear()
        linked = 0

    def leave(upto: int) -> None:
        while len(stack) > upto:
            name, hidden, bad, article, named = stack.pop()
            open_[name] -= 1
            if named:
                names.pop()
            depth["hidden"] -= hidden
            depth["bad"] -= bad
            depth["article"] -= article

    def read(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len((html.unescape(text) if "&" in text else text).strip())

    at, n, scan = 0, len(page), Tags(page)
    while at < n:
        tag = scan.after(at)
        text = page[at:tag.start() if tag else n]
        if text:
            parts.append(text)
            linked += len((html.unescape(text) if "&" in text else text).strip()) if links else 0
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        if name == "a":
            links = 0 if tag[1] else 1
        if name in BLOCK or name in HIDDEN:
            close()
            links = 0
        if tag[1]:
            if open_[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                leave(i)
            continue
        if name in VOID or name not in BLOCK and name not in HIDDEN:
            continue
        if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            leave(len(stack) - 1)  # these end the one before
        if tag[3].rstrip().endswith("/") and name in HIDDEN:
            continue
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(tag[3]))
        # the headline of an article stands in a header of its own
        bad = name in BOILERPLATE and not (name == "header" and depth["article"])
        spared = bad and name in AROUND
        entry = (name, name in HIDDEN, bad and not spared, name in ARTICLE, spared or
                 bool(named) and name not in ("html", "body") and name not in ARTICLE and names_boilerplate(named))
        if name in RAW:  # no markup inside: skip to its own end
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else n
            stop = page.find(">", at)
            at = n if stop < 0 else stop + 1
            continue
        if entry[3] and not depth["article"]:
            articles += 1
        if entry[3]:
            for around in reversed(names):
                if around[0]:
                    break  # and so are those around it
                around[0] = True
        if entry[4]:
            names.append([False])
        stack.append(entry)
        open_[name] += 1
        depth["hidden"] += entry[1]
        depth["bad"] += entry[2]
        depth["article"] += entry[3]
    close()
    for b, name in zip(out, within):
        if name:
            b.around = name[0]
            b.bad = b.bad or not name[0]
    return out


def label(found: list[Block], stop: frozenset[str]) -> list[bool]:
    """Whether each block is content."""
    state: list[bool | None] = []  # by its text; None: open
    for b in found:
        words = b.text.lower().split()
        dense = sum(w.strip(".,;:!?()\"'") in stop for w in words) / len(words)
        if b.linked > LINK_DENSITY * len(b.text):
            state.append(False)
        elif not b.heading and (len(b.text) >= LONG or dense >= STOP_DENSITY and len(words) >= 10):
            state.append(True)
        else:
            state.append(None)
    shown = [not (b.hidden or b.bad) for b in found]
    # names around articles count where the page has prose in another article
    elsewhere = any(ok and s and b.article and not b.around for ok, s, b in zip(shown, state, found))
    shown = [ok and not (elsewhere and b.around) for ok, b in zip(shown, found)]
    has_article = any(ok and b.article for ok, b in zip(shown, found))
    placed = [ok and (not has_article or b.article > 0) for ok, b in zip(shown, found)]
    near = [_nearest(found, state, placed, step) for step in (1, -1)]
    return [ok and (s if s is not None else True in around or False not in around)
            for ok, s, *around in zip(placed, state, *near)]


def _nearest(found: list[Block], state: list, placed: list[bool], step: int) -> list[bool | None]:
    """For each block the label of the last block decided by its text, coming from one side."""
    out: list[bool | None] = [None] * len(found)
    last: dict[int, bool] = {}
    for i in range(len(found))[::step]:
        out[i] = last.get(found[i].article)
        if placed[i] and state[i] is not None:
            last[found[i].article] = state[i]
    return out


def page_lang(page: str | None) -> str:
    """The language that the page's html tag states, wherever it stands outside comments."""
    if page and _HTML.search(page):
        scan = Tags(page)
        tag = scan.after(0)
        while tag:
            if not tag[1] and (tag[2] or "").lower() == "html":
                m = _LANG.search(tag[3])
                return m[1].lower() if m else ""
            tag = scan.after(tag.end())
    return ""


def stop_words(pages: DataFrame, top: int = STOP_WORDS, languages: int = LANGUAGES) -> dict[str, frozenset[str]]:
    """The ``top`` commonest words over all pages of each of the ``languages`` languages with
    the most words, and of all others together: each partition counts, the counts are added
    up, and at most ``top`` words of these reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for p in b["html"]:
                lang = page_lang(p)
                for block in blocks(p or ""):
                    if not block.hidden and not block.bad:
                        seen.update((lang, w.strip(".,;:!?()\"'")) for w in block.text.lower().split())
            rows = [(lang, w, n) for (lang, w), n in seen.items() if w]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"])

    counts = materialize(pages.select(pages["html"]).mapInPandas(count, "lang string, word string, n long")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    out: dict[str, set] = {r["lang"]: set()
                           for r in sizes.orderBy(F.col("n").desc(), "lang").limit(languages).collect()}
    if len(out) == languages and sizes.count() > languages:
        counts = (counts.withColumn("lang", F.when(F.col("lang").isin(list(out)), F.col("lang")).otherwise(OTHERS))
                  .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    for r in counts.withColumn("r", rank).where(F.col("r") <= top).select("lang", "word").collect():
        out.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in out.items()}


def _stop(page: str | None, stop: dict[str, frozenset[str]]) -> frozenset[str]:
    return stop.get(page_lang(page), stop.get(OTHERS, frozenset()))


def main_text(page: str | None, stop: dict[str, frozenset[str]]) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, label(found, _stop(page, stop))) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    stop = pages.sparkSession.sparkContext.broadcast(stop_words(pages))  # at most STOP_WORDS * (LANGUAGES + 1) words

    def run(found: list) -> list:
        texts = [main_text(p, stop.value) for p in found]
        return [texts, [len(t) for t in texts]]
    return map_text(pages, ["page_id", "url"], "text string, n_chars long", run, "html")
