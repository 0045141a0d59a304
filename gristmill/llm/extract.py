"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Batches, batch_of, map_arrow

#: Fixed lists of common function words, by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out so said what up its about into than them can only other",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais comme ou si leur y dont aux avec cette ces ses tout nous sa elle son être fait ont été même aussi d l qu on lui avait sans entre",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat daß dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede",
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

#: Fixed sets of elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ROOTS = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside form head menu dialog fieldset".split())
VOID = frozenset("hr br img meta link input".split())
#: Words in class, id or role that name boilerplate.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies discussion disqus respond share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar copyright legal disclaimer complementary contentinfo".split()
)
#: These name boilerplate outside an article only.
PAGE_HINTS = frozenset("header masthead".split())

LINKS_MOST = 0.4
SHORT_WORDS = 10
STOPS_GOOD = 0.2
STOPS_LEAST = 0.1

#: Comments, the start of a tag, and other markup; where a tag ends is told by Tags.
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-z][a-z0-9:-]*)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
EVENT = re.compile("[>\"']")
UNQUOTED = re.compile(r"[^<>]*(?:>|\Z)")


class Tags:
    """The marks of a page in order, in time that grows with the page alone, however odd its quotes are.

    A tag ends at the first > outside quotes. Where there is none, its quotes count for
    nothing, and it ends at the next > or the end of the page before another <. What follows an opening
    quote is found out once, so tags that never end are not each tried to the end of the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.places = [m.start() for m in EVENT.finditer(page)]
        self.closing: list[int] = []  # per event: the next event of the same kind, -1 if none
        self.end: dict[int, int] = {}  # event, outside quotes -> where a tag that meets it ends

    def _close(self) -> None:
        last = {">": -1, '"': -1, "'": -1}
        self.closing = [0] * len(self.places)
        for k in range(len(self.places) - 1, -1, -1):
            kind = self.page[self.places[k]]
            self.closing[k] = last[kind]
            last[kind] = k

    def tag_end(self, at: int) -> int:
        """Place behind the > that ends a tag whose name ends here; -1 if no > is outside quotes."""
        k, met, page = bisect_left(self.places, at), [], self.page
        while True:
            if k >= len(self.places):
                end = -1
                break
            if page[self.places[k]] == ">":
                end = self.places[k] + 1
                break
            if k in self.end:
                end = self.end[k]
                break
            if not self.closing:
                self._close()
            met.append(k)
            if self.closing[k] < 0:
                end = -1
                break
            k = self.closing[k] + 1
        for k in met:
            self.end[k] = end
        return end

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next mark; no name if it is no tag."""
        while m := MARK.search(self.page, at):
            if not m[2]:
                return m.start(), m.end(), False, "", ""
            end = self.tag_end(m.end())
            if end < 0:
                rest = UNQUOTED.match(self.page, m.end())
                if not rest:  # another < comes first: plain text
                    at = m.end()
                    continue
                return m.start(), rest.end(), bool(m[1]), m[2].lower(), rest[0].removesuffix(">")
            return m.start(), end, bool(m[1]), m[2].lower(), self.page[m.end() : end - 1]
        return None


#: Elements whose text is left out. Browsers read the first up to their end tag, or the end of the page, as plain characters.
RAW = frozenset("script style noscript textarea title iframe".split())
SKIPPED = frozenset("template svg math select button object canvas".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
SPACED = frozenset("button select textarea iframe title".split())
#: Start tags of HTML that end svg and math, but inside an element that may hold HTML.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset("a b code em font i ins label p s small span strong sub sup u".split())
TABLE = frozenset("caption table tbody tfoot thead tr td th".split())
NO_CONTENT = frozenset("area base br col embed hr img input link meta source track wbr".split())
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

GOOD, BAD, OPEN = "good", "bad", "open"


class Block:
    """Text between two block borders, with what the rules ask about it."""

    __slots__ = ("texts", "linked", "boilerplate", "hints", "root", "parent", "heading", "text", "label")

    def __init__(self, boilerplate: bool, hints: int, root: int, parent: int, heading: bool):
        self.texts: list[str] = []
        self.linked: list[str] = []
        self.boilerplate, self.hints, self.root, self.parent, self.heading = boilerplate, hints, root, parent, heading


class Skipped:
    """An element whose text is left out, until it ends where browsers end it."""

    def __init__(self, name: str):
        self.name, self.inside = name, Counter()

    def foreign(self) -> bool:
        return self.name in ("svg", "math") and not any(self.inside[n] for n in HOLDS_HTML)

    def ends(self, name: str, closing: bool, attributes: str, enclosing: Counter, in_p: bool) -> tuple[bool, bool]:
        """Whether the element ends at this tag, and whether the tag still counts for what encloses it."""
        own = self.name
        if closing:
            if self.inside[name]:
                self.inside[name] -= 1
                return False, False
            if name == own:
                return True, False
            if own in ("svg", "math", "canvas"):
                over = enclosing[name] > 0 or name in INLINE or name == "br"
            elif own == "select":
                over = name in TABLE and enclosing["table"] > 0
            else:
                over = own == "button" and enclosing[name] > 0
            return over, over
        if own == "select" and (name in ("select", "input", "textarea") or name in TABLE and enclosing["table"] > 0):
            return True, name != "select"
        if own == "canvas" and in_p and name in BLOCKS and not self.inside["p"]:
            return True, True
        if self.foreign() and name in BREAKS:
            return True, True
        if own == "button" and name == own:
            self.inside.clear()
        elif name not in NO_CONTENT and not (self.foreign() and attributes.endswith("/")):
            self.inside[name] += 1
        return False, False


def hidden(attributes: str) -> bool:
    return bool(attributes) and bool(HIDDEN.search(attributes))


def hinted(attributes: str, in_root: bool) -> bool:
    if not attributes:
        return False
    names = {p.lower() for m in NAMES.finditer(attributes) for p in _PART.findall(next(filter(None, m.groups()), ""))}
    return bool(names & HINTS) or not in_root and bool(names & PAGE_HINTS)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, empty ones left out."""
    out: list[Block] = []
    # element, boilerplate, number of the nearest hint above, number of its article, own number
    stack: list[tuple[str, bool, int, int, int]] = [("", False, 0, 0, 0)]
    enclosing: Counter = Counter()  # the elements in the stack
    above_hint = [0]  # of each hint: the nearest one above
    count = links = 0
    heading = in_p = False
    skipped: Skipped | None = None
    last_object = max((m.start() for m in re.finditer("</object", page, re.I)), default=-1)
    now = Block(False, 0, 0, 0, False)
    tags = Tags(page)

    def border() -> None:
        nonlocal now, links
        if any(t.strip() for t in now.texts):
            out.append(now)
        _, boilerplate, above, root, own = stack[-1]
        now = Block(boilerplate, above, root, own, heading)
        links = 0

    def add(text: str) -> None:
        if skipped:
            return
        now.texts.append(text)
        if links:
            now.linked.append(text)

    at = 0
    while mark := tags.next(at):
        start, end, closing, name, attributes = mark
        if start > at and not skipped:
            add(html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        foreign = bool(skipped) and skipped.foreign()
        if skipped:
            over, counts = skipped.ends(name, closing, attributes, enclosing, in_p)
            if over:
                skipped = None
        else:
            counts = True
        if name in RAW and not closing and not foreign:
            if skipped and not counts:
                skipped.inside[name] -= 1  # its end tag is read here
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            if name in SPACED:
                add(" ")
            continue
        if not counts:
            continue
        if name in SKIPPED:
            # what an object without end tag encloses is shown where it can't be loaded
            if not closing and not (name in ("svg", "math") and attributes.endswith("/")) and not (name == "object" and last_object < at):
                if name in SPACED:
                    add(" ")
                skipped = Skipped(name)
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            in_p = name == "p" and not closing
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = not closing
            elif not closing:
                heading = False
            if closing:
                while enclosing[name]:
                    last = stack.pop()[0]
                    enclosing[last] -= 1
                    if last == name:
                        break
            elif name not in VOID and name != "p":
                _, boilerplate, above, root, _ = stack[-1]
                count += 1
                if name in ("html", "body"):
                    boilerplate, above = False, 0
                    if name == "body":
                        del stack[1:]
                        enclosing.clear()
                elif name in ROOTS:
                    boilerplate, above, root = False, 0, root or count
                else:
                    boilerplate = boilerplate or name in BOILERPLATE or name == "header" and not root or hidden(attributes)
                    if hinted(attributes, bool(root)):
                        above_hint.append(above)
                        above = len(above_hint) - 1
                stack.append((name, boilerplate, above, root, count))
                enclosing[name] += 1
            border()
        if not closing and attributes and (name == "p" or name in ("span", "b", "i", "em", "strong", "small", "ins", "font", "label") and not now.texts):
            now.boilerplate = now.boilerplate or hidden(attributes)
            if hinted(attributes, bool(stack[-1][3])):
                above_hint.append(now.hints)
                now.hints = len(above_hint) - 1
    if at < len(page):
        add(html.unescape(page[at:]))
    border()
    for b in out:
        b.text = " ".join("".join(b.texts).split())
    out = [b for b in out if b.text]
    weigh_hints(out, above_hint)
    return out


def weigh_hints(found: list[Block], above: list[int]) -> None:
    """Hints make their blocks boilerplate, but for one whose text, good by the other rules, is most of the page's not bad by them.

    A single block beside an article with text, such as a notice longer than the article, stays boilerplate.
    """
    if not any(b.hints for b in found):
        return
    held, number, total, article = [0] * len(above), [0] * len(above), 0, False
    for b in found:
        label = first_pass(b)
        total += len(b.text) * (label != BAD)
        article |= b.root > 0 and label != BAD and not b.hints
        if label == GOOD and b.hints:
            held[b.hints] += len(b.text)
            number[b.hints] += 1
    for h in range(len(above) - 1, 0, -1):  # a hint stands above later ones only
        held[above[h]] += held[h]
        number[above[h]] += number[h]
    light, lone = [False] * len(above), [False] * len(above)  # is it, or one above it
    for h in range(1, len(above)):
        light[h] = light[above[h]] or 2 * held[h] <= total
        lone[h] = lone[above[h]] or number[h] == 1
    for b in found:
        b.boilerplate = b.boilerplate or light[b.hints] or article and not b.root and lone[b.hints]


def first_pass(b: Block) -> str:
    """Rules on one block alone: named boilerplate, link density, length, stop-word density."""
    if b.boilerplate:
        return BAD
    linked = len(" ".join("".join(b.linked).split()))
    if linked > LINKS_MOST * len(b.text):
        return BAD
    words = b.text.lower().split()
    if b.heading or len(words) < SHORT_WORDS:
        return OPEN
    density = sum(w.strip(".,;:!?\"'()«»¿¡") in STOPS for w in words) / len(words)
    if density >= STOPS_GOOD:
        return GOOD
    return OPEN if density >= STOPS_LEAST or b.root else BAD


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided one.

    Blocks of the same article are asked first; an article without a decided block is
    kept. At equal distance the neighbour in the same element counts, then the one below.
    """
    decided = [i for i, b in enumerate(found) if b.label != OPEN]
    inside = defaultdict(list)  # decided blocks of each article
    for i in decided:
        if not found[i].boilerplate:
            inside[found[i].root].append(i)
    for i, b in enumerate(found):
        if b.label != OPEN:
            continue
        near = inside[b.root] if b.root else decided
        if not near:
            b.label = GOOD if b.root or not decided else BAD
            continue
        k = bisect_left(near, i)
        j = min(near[max(0, k - 1) : k + 1], key=lambda j: (abs(i - j), found[j].parent != b.parent, j < i))
        b.texts = [found[j].label]
    for b in found:
        if b.label == OPEN:
            b.label = b.texts[0]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    for b in found:
        b.label = first_pass(b)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the article of every page.

    Null, empty or textless html: empty text. Repeated rows and null ids or urls keep a
    row each. Text is never cut. Other columns are not read. An empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def task(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield batch_of(schema, batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts])

    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_arrow(asked, task, "page_id long, url string, text string, n_chars long")
