"""Main text of web pages: the best contiguous run of words against tags.

The run's own bounds are the article's, with the headlines right before it. Page
furniture counts as one bad token as a whole and is left out where the run goes
over it; an element that has most words of the page is none, whatever its name.
A null or empty page has an empty text. Rows with the same id are separate rows.
Without a labelled page fixed weights are used. An empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import arrow_map, shipped, short_batches, slices, texts

#: Elements whose content is no text at all.
RAW = "script style noscript template iframe svg object canvas title textarea select annotation-xml annotation".split()
#: Elements that are never part of an article, and words that say the same as a whole class, id or role.
APART = set("nav aside form footer menu dialog button head".split())
#: An element with more than this share of a page's words is no furniture; some kinds are nothing else.
MOST, ALWAYS = 0.8, set("button head".split())
APART_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar"
    " navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices alert popup modal"
    " newsletter subscribe signup login share sharing social related recommended trending comment comments respond"
    " responses replies discussion disqus search pagination pager widget widgets rail toolbar topbar copyright contentinfo"
    " complementary dialog adsbygoogle gdpr ccpa outbrain taboola".split()
)
#: Words that beside one of those leave a name what it says; beside any other, as in related-work, it names something else.
BESIDE = set(
    "area articles bar body block blocks box button buttons column container content cta end form global group icon icons inline item"
    " items left link links list main message page panel post posts primary reader right row section secondary site slot"
    " sticky stories this thread top unit user wrap wrapper".split()
)
#: Words that are also topics: an id is often the slug of a heading.
TOPICS = set(
    "search share sharing social related trending comment discussion responses replies respond notice notices alert ad ads"
    " advertising copyright consent promotion sponsor login signup navigation".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6 p blockquote pre figure dl dt dd li".split())
HEADLINES = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Numbers beside a name, as in ad-300x250.
_SIZE = re.compile(r"\d+(?:x\d+)?")
#: Names of page headers; others, as entry-header, belong to an article.
HEADER_NAMES = {"header", "site-header", "top-header", "global-header"}
#: Beside such a word a name tells what the page has or lacks, as in no-sidebar.
NEGATIONS = {"no", "without", "has", "with"}
#: Elements that mark the content of a page; pages with exactly one are the labelled ones.
CONTENT = {"article", "main"}
#: Elements that do not end a block.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span"
    " strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics".split()
)
#: Elements that never have content.
VOID = set("area base br col embed hr img input link meta param source track wbr basefont frame keygen".split())
#: Elements that end an open element of these kinds by beginning, up to one of the kinds that hold them.
ENDS = {x: {"li"} for x in ("li",)} | {x: {"dt", "dd"} for x in ("dt", "dd")} | {x: {"option"} for x in ("option", "optgroup")}
ENDS |= {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS |= {x: {"thead", "tbody", "tfoot", "tr", "td", "th"} for x in ("thead", "tbody", "tfoot")}
ENDS |= {
    x: {"p"}
    for x in "p address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol pre section table ul".split()
}
HOLDS = set("ul ol menu dl table select datalist body article main section div aside nav footer header form button".split())
#: Elements that text is written in.
WRITING = set(
    "p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption table caption colgroup thead tbody tfoot tr td th".split()
)
#: Weights without labelled pages: the classic balance of words and tags, and one for the tags of written text.
WORD, TAG, WRITING_TAG = 1.0, -3.25, -0.3
#: Learned weights stay this far from zero, words above and tags below.
LEAST = 0.05

#: The names that are a kind of tag of their own, and the kind of all others.
KNOWN = VOID | INLINE | WRITING | CONTENT | APART | HOLDS | set(RAW) | set(ENDS)
KNOWN |= set(
    "html body address applet area audio caption center colgroup datalist dir fieldset frameset hgroup legend map meter"
    " noframes optgroup option output picture progress rp rt slot summary tbody td tfoot th thead video".split()
)
OTHER = "<other>"

_TAG = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<svg(?=[\s/>]){_TAG}(?<=/)>|<(?:{'|'.join(RAW)})(?=[\s/>]){_TAG}(?<=[\"'\s]/)>"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_TAG}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/<>]*)(?P<rest>{_TAG})>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z/][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def set_apart(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is page furniture; a header is unless it belongs to an article."""
    if name in APART or (name == "header" and not inside):
        return True
    if not rest or name in CONTENT and not inside or name in ("body", "html"):
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or _UNSEEN.search(found.get("style", "")):
        return True
    # the id of a block of text is the place of a link, and so may be one that is also a topic
    by_id = [] if name in HEADINGS else [x for x in found.get("id", "").split() if x not in TOPICS]
    for named in [*found.get("class", "").split(), *found.get("role", "").split(), *by_id]:
        if named in HEADER_NAMES and not inside:
            return True
        parts = {x for x in _PARTS.split(named) if x and not _SIZE.fullmatch(x)}
        if not APART_NAMES.isdisjoint(parts) and parts <= APART_NAMES | BESIDE and NEGATIONS.isdisjoint(parts):
            return True
    return False


def tag_kind(name: str) -> str:
    """The kind of a tag; all names that are not HTML's or MathML's are one kind, so that kinds do not grow with pages."""
    return f"<{name}>" if name in KNOWN else OTHER


class Page:
    """A page as a sequence of words and tags: ``kinds[i]`` with ``sizes[i]`` words, 1 for a tag; and its blocks.

    Kinds are ``w`` for words of plain text, ``link`` for those of links,
    ``<name>`` for tags, and ``apart`` for a piece of page furniture as a whole.
    """

    def __init__(self, source: str):
        spared: set[int] = set()
        while True:
            self._read(source, spared)
            whole = sum(n for k, n in zip(self.kinds, self.sizes, strict=True) if k in ("w", "link"))
            whole += sum(self.left_out.values())
            much = {at for at, n in self.left_out.items() if n > MOST * whole}
            if not much:
                break
            spared |= much

    def _read(self, source: str, spared: set[int]) -> None:
        """Cut the page into tokens; elements that begin at the places ``spared`` are no furniture."""
        self.kinds: list[str] = []
        self.sizes: list[int] = []
        self.spans: list[tuple[int, int]] = []  # tokens of content elements that lie in no other
        self.headlines: set[int] = set()  # tokens of words in headlines
        self.left_out: dict[int, int] = {}  # words of a furniture element, by its place
        self.pieces: list[tuple[int, int, str]] = []  # token, block, text of pieces that may be content
        block = at = link = 0
        apart, depth, place = "", 0, -1  # the furniture element that is open, how many elements hold it, where it begins
        held: list[str] = []  # the open elements
        number: Counter = Counter()  # how many of each name they are

        def end(size: int) -> None:
            while len(held) > size:
                number[held.pop()] -= 1

        content: list[tuple[str, int]] = []

        def text(until: int) -> None:
            if until > at:
                if apart and place < 0:
                    return
                piece = html.unescape(source[at:until])
                n = len(piece.split())
                if apart:
                    self.left_out[place] = self.left_out.get(place, 0) + n
                    return
                if n:
                    if not HEADLINES.isdisjoint(held):
                        self.headlines.add(len(self.kinds))
                    self.kinds.append("link" if link else "w")
                    self.sizes.append(n)
                self.pieces.append((len(self.kinds) - bool(n), block, piece))

        for m in TOKEN.finditer(source):
            text(m.start())
            at = m.end()
            name = (m["name"] or m["raw"] or "").lower()
            if not m["name"]:
                if name and not apart:
                    self.kinds.append(tag_kind(name))
                    self.sizes.append(1)
                continue
            closing, rest, was_apart = bool(m["close"]), m["rest"], apart
            empty = name in VOID or rest.endswith("/")
            if closing:
                if number[name]:
                    i = len(held) - 1 - held[::-1].index(name)
                    if name not in INLINE or all(x in INLINE for x in held[i + 1 :]):
                        end(i)  # a misplaced </b> ends no block
            elif name in ENDS and any(number[x] for x in ENDS[name]):
                for i in range(len(held) - 1, -1, -1):
                    if held[i] in ENDS[name]:
                        end(i)
                        if name != "tr" and name not in ("thead", "tbody", "tfoot"):
                            break
                    elif held[i] in HOLDS:
                        break
            if apart and (len(held) <= depth or not closing and name in CONTENT and not content):
                apart = ""  # furniture that was never closed ends with its parent, or where the content begins
                was_apart = "" if not closing else was_apart
            said = not (name == "button" and number["p"])  # a button in a paragraph is a word of it
            if not apart and not closing and not empty and m.start() not in spared and said and set_apart(name, rest, bool(content)):
                apart, depth, place = name, len(held), -1 if name in ALWAYS else m.start()
                self.kinds.append("apart")
                self.sizes.append(1)
            if not closing and not empty:
                held.append(name)
                number[name] += 1
            if name in CONTENT and not apart:
                if closing:
                    if content and content[-1][0] == name:
                        first = content.pop()[1]
                        if not content:
                            self.spans.append((first, len(self.kinds)))
                else:
                    content.append((name, len(self.kinds)))
            if name == "a":
                link = 0 if closing else 1
            if name == "br":
                self.pieces.append((len(self.kinds), block, " "))
            elif name not in INLINE and (said or apart):
                block += 1
                link = 0
            if not apart and not was_apart:
                self.kinds.append(tag_kind(name))
                self.sizes.append(1)
        text(len(source))
        if content:
            self.spans.append((content[0][1], len(self.kinds)))

    def best_run(self, weight) -> tuple[int, int]:
        """The run of tokens with the largest sum, by one scan; of equal ones the first."""
        best, run, begin, found = 0.0, 0.0, 0, (0, 0)
        for i, (kind, n) in enumerate(zip(self.kinds, self.sizes, strict=True)):
            if run <= 0:
                run, begin = 0.0, i
            run += weight(kind) * n
            if run > best + 1e-12:
                best, found = run, (begin, i + 1)
        return found

    def with_headlines(self, low: int) -> int:
        """Where the headlines begin that only tags part from what begins at ``low``."""
        for i in range(low - 1, -1, -1):
            if i in self.headlines:
                low = i
            elif self.kinds[i][0] != "<":
                break
        return low

    def main_text(self, weight) -> str:
        """Text of the best run and its headlines, without furniture inside it."""
        low, high = self.best_run(weight)
        low = self.with_headlines(low) if high > low else low
        blocks: dict[int, list[str]] = {}
        for token, block, piece in self.pieces:
            if low <= token < high:
                blocks.setdefault(block, []).append(piece)
        found = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(b for b in found if b)


class Weights:
    """Scores of words and tags: how much oftener they are inside than outside of labelled content."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        inside, outside = Counter(), Counter()
        for (kind, within), n in counts.items():
            (inside if within else outside)[kind] += n
        self.known = {}
        if sum(inside.values()) and sum(outside.values()):
            spread = (sum(inside.values()) + 1) / (sum(outside.values()) + 1)
            for kind in inside | outside:
                odds = float(np.log((inside[kind] + 1) / (outside[kind] + 1) / spread))
                self.known[kind] = min(odds, -LEAST) if kind[0] == "<" or kind == "apart" else max(odds, LEAST)
        self.known.setdefault("w", WORD)
        self.known.setdefault("link", LEAST)
        self.known.setdefault("apart", -WORD)
        self.tag = TAG if len(self.known) == 3 else min(self.known[k] for k in self.known if k[0] == "<")

    def __call__(self, kind: str) -> float:
        name = kind[1:-1]
        return self.known.get(kind, -LEAST if name in INLINE or name in ("br", "button") else WRITING_TAG if name in WRITING else self.tag)


def fit(pages: DataFrame) -> Weights:
    """Weights from all pages with exactly one content element; a few numbers for each kind of tag reach the driver."""
    schema = pa.schema([("kind", pa.string()), ("within", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()
        for part in slices(batches, text=0):
            for source in texts(part.column(0)):
                page = Page(source)
                if len(page.spans) != 1:
                    continue
                low, high = page.spans[0]
                for i, (kind, n) in enumerate(zip(page.kinds, page.sizes, strict=True)):
                    counts[kind, low <= i < high] += n
            if len(counts) > 100_000:
                yield from out(counts)
        yield from out(counts)

    def out(counts):
        columns = [[k for k, _ in counts], [w for _, w in counts], list(counts.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        counts.clear()

    short_batches(pages.sparkSession)
    counted = pages.select("html").mapInArrow(run, "kind string, within boolean, n long")
    counted = counted.groupBy("kind", "within").agg(F.sum("n").alias("n"))
    return Weights({(r.kind, r.within): r.n for r in counted.collect()})


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id, url, text, n_chars``: each page's main text, empty if there is none."""
    made = shipped(pages.sparkSession, weights)

    def rows(part):
        found = [Page(s).main_text(made()) for s in texts(part.column(1))]
        return {"page_id": part.column(0), "url": part.column(2), "text": found, "n_chars": [len(t) for t in found]}

    rows_in = pages.select(F.col("page_id").cast("long"), "html", "url")
    return arrow_map(rows_in, rows, "page_id long, url string, text string, n_chars long")
