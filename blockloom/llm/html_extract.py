"""Main text of HTML pages by tag-path ratios.

Every text node (the text of a block between two block boundaries) has a root-to-leaf tag path (tags
with their class and id, without inline tags). For each path the text length and the punctuation per
node are aggregated; the series of both over the page's nodes is smoothed, so that short headings and
one-word paragraphs beside long ones gain from them, and the two are fused. Every node whose path
reaches a threshold is main text, wherever it stands, and so is a heading over such nodes; no other
node is. A class or id that sounds like
something else (AWAY_WORDS), or a form, lowers the fused ratio of what is in it, unless it holds most
of the page's text. Only hidden elements and those whose tag or role says that they are no text of the
page (AWAY_TAGS, AWAY_ROLES) are left out before.

Defined results: null or empty html, or html without text, gives an empty text; broken markup is read
as browsers do (unclosed elements end where their parent does, a stray `<` is text); an empty table
gives an empty table; columns other than page_id, url and html don't count.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import bounded_batches, pick

#: Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea iframe xmp noembed noframes".split())
SECTIONS = frozenset("html body main article section div center table tbody tr td dl ul ol".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body table td th article section div ul ol dl main aside nav header footer form".split())
#: Elements that hold no main text by tag or role; words of a class or id that only speak against it.
AWAY_TAGS = frozenset("head script style noscript template textarea iframe object svg canvas nav footer aside button select option dialog menu".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
AWAY_WORDS = re.compile(r"^(ad|ads|adv|advert\w*|banner\w*|breadcrumb\w*|comment|comments|commentlist|consent|cookie\w*|copyright|disclaimer|disqus\w*|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|outbrain|pagination|popup|promo\w*|recommend\w*|related\w*|replies|respond|search|share|sharing|sidebar|sidebars|signup|social|sponsor\w*|subscribe|subscription|taboola|tags|toolbar|widget|widgets)$")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes up to the first `>` outside quotes.
QUOTED = re.compile(r"[^\"'>]*+(?:(?:\"[^\"]*\"|'[^']*')[^\"'>]*+)*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Za-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？؟،।]")
#: A path is content from this share of the page's mean fused ratio; a name that speaks against an
#: element lowers its ratio to this share. An element with MOST of the page's text and its article, main
#: or h1 element isn't lowered, nor is one with NEARLY_ALL of the text.
THRESHOLD, LOWERED, MOST, NEARLY_ALL = 0.3, 0.01, 0.5, 0.8
LANDMARKS = frozenset("article main h1".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Element:
    """What a page's elements are known by. Everything that depends on the elements around is passed down when an
    element is opened, so that no deep page makes it be looked up again."""

    __slots__ = ("away", "heading", "name", "named", "number", "parent", "path", "sectioned", "tag")

    def __init__(self, tag: str, name: str, parent: Element | None, away: bool, named: bool, number: int, paths: dict[tuple[int, str], int]):
        self.tag, self.name, self.parent, self.number = tag, name, parent, number
        self.away = away or (parent is not None and parent.away)
        self.named = named
        inline = parent is not None and tag in INLINE
        self.sectioned = tag in ("article", "main", "section") or (parent is not None and parent.sectioned)
        self.heading = tag if tag in HEADINGS else parent.heading if inline else None
        # A path is a number: that of the parent's path and the own name. Inline elements share the path of their
        # block, unless their name speaks against them.
        self.path = parent.path if inline and not named else paths.setdefault((parent.path if parent else -1, name), len(paths))


def described(tag: str, attributes: str, parent: Element) -> tuple[str, bool, bool]:
    """Name, whether tag or role speak for no text of the page, and whether class or id speak against it."""
    # A header outside of articles and sections is the page's own.
    name, away, named = tag, tag in AWAY_TAGS or (tag == "header" and not parent.sectioned), tag == "form"
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if kind == "hidden" or kind == "aria-hidden":
                away = away or (kind == "hidden" and attributes[m.start() - 1 : m.start()] != "-") or value == "true"
            elif kind == "role":
                away = away or value.lower() in AWAY_ROLES
            else:
                name += "." + value
                if tag not in ("html", "body", "article", "main"):
                    named = named or any(AWAY_WORDS.match(w.lower()) for part in value.split() for w in (part, *WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", part))))
    return name, away, named


def tokens(page: str) -> Generator[tuple[str, str, str, int], int | None, None]:
    """(kind, tag, attributes, end): "text" (in the place of a tag), "open" and "close"; what is sent back is where to go on.
    Linear: a page has one place beyond which nothing is a tag, and after a tag whose quotes don't end, quotes are no
    longer heeded."""
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    begin = 0  # of the text not yet given
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            kind, tag, attributes = "", "", ""
        elif at > last:
            break
        else:
            slash = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + slash)
            if name is None:
                if page[at + 1 : at + 2] not in ("!", "?", "/"):
                    at += 1
                    continue
                kind, tag, attributes, end = "", "", "", page.index(">", at) + 1
            else:
                kind, tag, whole = "close" if slash else "open", name[0].lower(), QUOTED.match(page, name.end()) if quotes else None
                if whole is None:
                    quotes = False
                    end = page.find(">", name.end()) + 1
                    if not end:
                        break
                else:
                    end = whole.end()
                attributes = page[name.end() : end - 1]
        if at > begin:
            yield "text", page[begin:at], "", at
        if kind:
            skip = yield kind, tag, attributes, end
            end = skip or end
        begin = at = end
    if begin < size:
        yield "text", page[begin:], "", size


def nodes(page: str) -> tuple[list[tuple[str, Element, bool]], list[Element]]:
    """The page's text nodes in order: decoded text, innermost element, and whether a block boundary
    (or line break) stands before it; and all elements, each after its parent."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("#", "", None, False, False, 0, paths)
    stack, every, out, boundary = [root], [root], [], True
    opened: dict[str, int] = defaultdict(int)

    def close(until: int) -> None:
        nonlocal boundary
        for x in stack[until:]:
            boundary = boundary or x.tag not in INLINE
            opened[x.tag] -= 1
        del stack[until:]

    read, skip = tokens(page), None
    while True:
        try:
            kind, tag, attributes, at = read.send(skip)
        except StopIteration:
            return out, every
        skip = None
        if kind == "text":
            out.append((entities.unescape(tag), stack[-1], boundary))
            boundary = False
            continue
        if kind == "close":
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag in SCOPE:
                        break
            boundary = boundary or tag not in INLINE
            continue
        boundary = boundary or tag not in INLINE
        ends = CLOSES_SAME.get(tag) or (tag in CLOSES_P and {"p"}) or ()
        if any(opened[x] for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    if tag not in ("tr", "tbody", "thead"):
                        break
                elif stack[k].tag in SCOPE and not (tag in ("tr", "tbody", "thead") and stack[k].tag in ("td", "th")):
                    break
        if tag in VOID or (attributes.endswith("/") and tag in ("svg", "path", "use")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            skip = end.end() if end else len(page)
            continue
        name, away, named = described(tag, attributes, stack[-1])
        stack.append(Element(tag, name, stack[-1], away, named, len(every), paths))
        every.append(stack[-1])
        opened[tag] += 1


def smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian over two neighbours on each side."""
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / 2.0)
    ones = np.convolve(np.ones(len(values)), kernel, "full")[2 : 2 + len(values)]
    return np.convolve(values, kernel, "full")[2 : 2 + len(values)] / ones


def lowered(found: list[tuple[str, Element, int]], every: list[Element]) -> set[int]:
    """The paths inside an element that a name speaks against and that doesn't hold most of the text. every: the page's
    elements, each after its parent."""
    inside, mark = [0] * len(every), [False] * len(every)
    for _, e, n in found:
        inside[e.number] += n
    total = sum(inside)
    for e in reversed(every):  # up: an element's text, and whether it has a landmark with text
        k = e.number
        mark[k] = inside[k] > 0 and (mark[k] or e.tag in LANDMARKS)
        if e.parent is not None:
            inside[e.parent.number] += inside[k]
            mark[e.parent.number] = mark[e.parent.number] or mark[k]
    low = [False] * len(every)
    for e in every:  # down
        k = e.number
        low[k] = (e.parent is not None and low[e.parent.number]) or (e.named and inside[k] <= (MOST if mark[k] else NEARLY_ALL) * total)
    return {e.path for _, e, _ in found if low[e.number]}


def content(found: list[tuple[str, Element, int]], every: list[Element]) -> list[bool]:
    """Which nodes are main text: those on content paths, and headings with such a node before the next
    run of headings. A heading that a name speaks against must be the page's h1 for that."""
    low = lowered(found, every)
    chosen = content_paths(found, low)
    out = [e.path in chosen for _, e, _ in found]
    text_below, before = False, False  # going up: whether what the headings head is main text
    for k in range(len(found) - 1, -1, -1):
        e = found[k][1]
        tag = e.heading
        if tag is None:
            text_below = out[k] or (text_below and not before)
        elif text_below and (e.path not in low or tag == "h1"):
            out[k] = True
        before = tag is not None
    return out


def content_paths(found: list[tuple[str, Element, int]], low: set[int]) -> set[int]:
    """The paths whose smoothed and fused length and punctuation ratios reach the threshold."""
    paths = [e.path for _, e, _ in found]
    ids = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    index = np.array([ids[p] for p in paths])
    per_path = lambda x: np.bincount(index, x) / np.bincount(index)
    length = np.array([float(n) for _, _, n in found])
    marks = np.array([float(len(PUNCTUATION.findall(t))) for t, _, _ in found])
    fused = per_path(smooth(per_path(length)[index])) * (1 + per_path(smooth(per_path(marks)[index])))
    fused *= np.array([LOWERED if p in low else 1.0 for p in ids])
    weight = np.bincount(index, length) * np.array([p not in low for p in ids])
    if not weight.sum():
        return set()
    limit = THRESHOLD * (fused * weight).sum() / weight.sum()
    return {p for p, i in ids.items() if fused[i] >= limit}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    parts, every = nodes(page)
    found: list[tuple[list[str], Element, bool]] = []  # text nodes of blocks: inline parts are joined
    broken = True
    for t, e, boundary in parts:
        broken = broken or boundary
        if e.away:
            continue
        if found and not broken and found[-1][1].path == e.path:
            found[-1][0].append(t)
        else:
            found.append(([t], e, broken))
        broken = False
    blocks = [("".join(t), e, boundary) for t, e, boundary in found]
    real = [(t, e, n) for t, e, _ in blocks if (n := len("".join(t.split())))]
    if not real:
        return ""
    chosen = iter(content(real, every))
    return " ".join("".join([(" " if boundary else "") + (t if not t.strip() or next(chosen) else "") for t, _, boundary in blocks]).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    bounded_batches(pages.sparkSession, "4m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
