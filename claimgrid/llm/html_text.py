"""Main text of web pages by line-block distribution.

*Lines.* Markup is stripped in one pass. Every block-level tag ends a line, so a
line is the text of one block: references decoded, white space turned into one
space, trimmed. Scripts, styles and other raw elements have no lines, nor have drawings,
formulas, objects, selections and templates from their start tag to its end tag; one
of these that closes itself or has no end tag is empty.

*Furniture.* A line is furniture if it stands in a menu, page header, footer, sidebar,
notice, advert, form, comment section or hidden element, told by tag, role, or class
and id. A class or id counts if all its parts speak of furniture (``sidebar``,
``comments-list``, ``ad-box``); one part among others (``social-history``) or a word
about what is beside (``with-sidebar``) doesn't. Wrappers are no furniture whatever
their name: a visible element around frames with most of all frames' text, or on a page
without frames around nearly all its text.

*Distribution.* Furniture is taken out first, so it breaks no text. A frame is an
``<article>`` or ``<main>`` that isn't furniture itself. On a page with frames a line
inside weighs its number of characters and a line outside nothing, and the frame
stands for the surge. On a page without one a line weighs its characters outside
links; a line with links and no letter outside of them is a link line and weighs
nothing. A line block is the sum of ``WINDOW`` neighbouring lines. Text surges where
blocks rise from zero, and dives where they are zero again. Every stretch from the first
whose largest block reaches ``SURGE`` characters to the last such is kept whole,
however sparse; if none reaches it, the largest is kept. A stretch after the last
dive, behind ``WINDOW`` link lines, can't be told from the end of the page and is
left out, as is one before the first surge.

Unclosed and crossed tags are taken as they come. A null or empty page has the
empty text. Nothing is cut off at any length. Repeated pages each get their row. Other
columns aren't read, so their names can't clash, and an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import slices

WINDOW = 3
SURGE = 120

_RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
# A raw element that closes itself is empty; one without an end tag runs to the end, as in a browser.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?!/>)(?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?<![\s\"']/)>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<close>/?+)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
# Elements without lines that hold markup, left out from their start tag to its end tag.
EMBEDDED = frozenset("svg math object select noscript template".split())
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
SPACED = frozenset(("br", "wbr", "img", "input"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags whose end may be left out: a tag of the second set ends an open one.
_ENDS = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
         "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
FURNITURE = frozenset("nav footer aside form menu button dialog fieldset label".split())
FRAMES = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets comment comments disqus replies respond reply cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended toolbar masthead pagination pager skip".split()
)
# Parts that may stand beside such a word in a class or id, and those that say it is about something else.
PLACES = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content div element entry fixed form global group "
    "header heading holder icon inner item items left link links list lower main mobile module outer page panel placeholder posts primary "
    "region right row secondary section site slot social stories strip sub tab text thread title tool tools top unit upper wrap wrapper zone".split()
)
BESIDE = frozenset("with without has have no not is show hide after before".split())
# Shares of text from which an element is a wrapper: of the frames' text, or of all text on a page without frames.
MOST_FRAMED, MOST = 0.5, 0.9
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def names_furniture(value: str) -> bool:
    """Whether a class or id says that its element is furniture."""
    for token in value.split():
        parts = _WORD.findall(token)
        if parts and parts[0] not in BESIDE and not WORDS.isdisjoint(parts) and all(len(p) == 1 or p in WORDS or p in PLACES for p in parts):
            return True
    return False


def is_hidden(rest: str) -> bool:
    return bool(_HIDDEN.search(rest)) or any(
        key.lower() == "aria-hidden" and "".join(values).lower() == "true" for key, *values in _ATTRIBUTE.findall(rest)
    )


def is_furniture(name: str, rest: str, framed: bool) -> bool:
    """Whether an element is furniture by its tag and attributes; ``framed`` if it stands in the article."""
    if name in FURNITURE or (name == "header" and not framed):
        return True
    if not rest or name in ("html", "body"):
        return False
    if is_hidden(rest):
        return True
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and names_furniture(value):
            return True
    return False


def embedded(tags: list[re.Match]) -> dict[int, int]:
    """Place of the end tag of each embedded element that has one, by the place of its start tag."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    amount = Counter()
    for k, tag in enumerate(tags):
        name = (tag["name"] or "").lower()
        if name not in EMBEDDED and name not in FRAMES:
            continue
        if not tag["close"]:
            if name in FRAMES or not _CLOSED.search(tag["rest"]):
                opened.append((name, k))
                amount[name] += 1
        elif amount[name]:
            while True:
                last, start = opened.pop()
                amount[last] -= 1
                if last == name:
                    break
            if name in EMBEDDED:
                ends[start] = k
    return ends


class Furniture:
    """Furniture elements of a page as a tree; 0 is the page itself."""

    def __init__(self):
        self.parent, self.hidden = [0], [False]

    def add(self, parent: int, hidden: bool) -> int:
        self.parent.append(parent)
        self.hidden.append(hidden)
        return len(self.parent) - 1

    def taken(self, inner: np.ndarray, holder: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which lines are furniture, from each line's innermost element, size, and element around its frame (-1 without one)."""
        count = len(self.parent)
        framed = holder >= 0
        by_frames = bool(framed.any())
        held = np.bincount(holder[framed], weights=sizes[framed], minlength=count) if by_frames else np.bincount(inner, weights=sizes, minlength=count)
        total, most = held.sum(), MOST_FRAMED if by_frames else MOST
        for k in range(count - 1, 0, -1):  # an element comes after the one it stands in
            held[self.parent[k]] += held[k]
        taken = np.zeros(count, dtype=bool)
        for k in range(1, count):
            wrapper = held[k] > most * total and not self.hidden[k]
            taken[k] = taken[self.parent[k]] or not wrapper
        return taken[inner]


def lines(page: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a page, and for each: furniture, inside a frame, characters of links (all of them in a link line)."""
    texts: list[str] = []
    inner: list[int] = []  # innermost furniture element of each line
    holders: list[int] = []  # innermost furniture element around the outermost frame of each line, -1 without a frame
    linked: list[int] = []
    own: list[str] = []
    link_text = 0
    spoken = False  # the line has a letter outside links
    # Open elements that matter, with their place in the furniture tree (0 if none) and whether they are frames.
    stack: list[tuple[str, int, bool]] = []
    tree = Furniture()
    names = Counter()  # of the elements on the stack
    nested = [0]  # furniture that is open, innermost last
    frames = links = holder = 0

    def end_line() -> None:
        nonlocal own, link_text, spoken
        if own:
            text = " ".join(html.unescape("".join(own)).split())
            if text:
                texts.append(text)
                inner.append(nested[-1])
                holders.append(holder if frames else -1)
                linked.append(min(link_text, len(text) - 1) if spoken or not link_text else len(text))
        own, link_text, spoken = [], 0, False

    def pop_to(depth: int) -> None:
        nonlocal frames
        while len(stack) > depth:
            name, furniture, frame = stack.pop()
            names[name] -= 1
            frames -= frame
            if furniture:
                nested.pop()

    at = 0
    tags = list(_MARKUP.finditer(page))
    ends = embedded(tags)
    past = -1  # place of the end tag of the embedded element being left out
    for k, tag in enumerate(tags):
        if k <= past:
            at = tag.end()
            continue
        if tag.start() > at:
            piece = page[at : tag.start()]
            own.append(piece)
            if links:
                link_text += len(piece)
            elif not spoken:
                spoken = any(map(str.isalpha, html.unescape(piece)))
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name in EMBEDDED:
            past = ends.get(k, -1)
            continue
        if name in SPACED:
            own.append(" ")
        if name == "a":
            links = 0 if tag["close"] else 1
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS:
            end_line()
        if tag["close"]:
            if names[name]:
                depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name)
                # An end tag does not reach out of an article or furniture it did not open in.
                if name in FRAMES or not any(x in FRAMES or x in FURNITURE for x, _, _ in stack[depth + 1 :]):
                    pop_to(depth)
            continue
        if name == "hr":
            continue
        if stack and stack[-1][0] in _ENDS and name in _ENDS[stack[-1][0]]:
            pop_to(len(stack) - 1)
        rest = tag["rest"] or ""
        found = is_furniture(name, rest, frames > 0)
        if found or name in FRAMES or (stack and name in BLOCKS):
            frame = name in FRAMES and not found
            if frame and not frames:
                holder = nested[-1]
            place = tree.add(nested[-1], is_hidden(rest)) if found else 0
            stack.append((name, place, frame))
            names[name] += 1
            frames += frame
            if place:
                nested.append(place)
    if at < len(page):
        own.append(page[at:])
        spoken = spoken or not links
    end_line()
    around = np.array(holders, dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    taken = tree.taken(np.array(inner, dtype=np.int64), around, sizes) if texts else np.zeros(0, dtype=bool)
    return texts, taken, around >= 0, np.array(linked, dtype=np.int64)


def stretches(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, largest block) of each stretch of text; a dive is past its last line."""
    if not weights.any():
        return []
    blocks = np.convolve(weights, np.ones(window, dtype=np.int64), "full")  # block k: lines k - window + 1 .. k
    alive = np.concatenate(([False], blocks > 0, [False]))
    rises, falls = np.flatnonzero(~alive[:-1] & alive[1:]), np.flatnonzero(alive[:-1] & ~alive[1:])
    return [(int(a), int(b) - window + 1, int(blocks[a:b].max())) for a, b in zip(rises, falls, strict=True)]


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """Blocks of the main text."""
    texts, furniture, framed, linked = lines(page)
    if not texts:
        return []
    body = np.flatnonzero(~furniture)
    sizes = np.array([len(texts[i]) for i in body], dtype=np.int64)
    inside = framed[body]
    if inside.any():
        weights, surge = np.where(inside, sizes, 0), 1
    else:
        weights = sizes - linked[body]
    found = stretches(weights, window)
    most = max((b for *_, b in found), default=0)
    dense = [k for k, (*_, b) in enumerate(found) if b >= min(surge, most)]
    kept = found[dense[0] : dense[-1] + 1] if dense else []
    # Lines between two stretches that a window joined belong to the text only where there is no frame.
    return [texts[body[k]] for a, b, _ in kept for k in range(a, b) if inside[k] or not inside.any()]


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    narrow = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = T.StructType([narrow.schema["page_id"], narrow.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "html"):
                found = ["\n\n".join(main_text(texts.text(i).decode("utf-8", "replace"))) for i in range(texts.count)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=schema.names
                )

    return narrow.mapInArrow(apply, schema)
