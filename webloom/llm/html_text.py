"""Main text of web pages by two passes of block rules.

A page becomes blocks of text. The first pass labels each by its length, its share of function words, its share of link text and the
container it stands in; the second gives blocks that this leaves open the label of the nearest block that it does not."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import releasing

#: Element names by their part in a page.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
CODE_TAGS = frozenset(("script", "style"))
OUTSIDE_TAGS = frozenset("head nav footer aside menu dialog button noscript template svg math object canvas audio video select datalist".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ITEM_TAGS = frozenset("p li dt dd tr td th option optgroup".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

#: Words of class and id names that mark what is not the article.
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner billboard breadcrumb breadcrumbs byline comment comments commentlist consent "
    "cookie cookies copyright disclaimer disqus footer footnav form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)

#: Those of them that inside an article name its own parts.
OUTSIDE_IN_ARTICLE = OUTSIDE_NAMES - frozenset("byline header tags teaser".split())

#: Those that, as a name of their own, may as well be the subject of an article's part, which is kept if it is long prose.
SUBJECTS = frozenset("search share sharing social subscription".split())

#: Those that hold articles of their own (comments, other pages, advertising); an article inside such an element stays outside.
OTHER_ARTICLES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot comment comments commentlist disqus hidden promo promoted promotion recommended related replies reply respond sponsor sponsored teaser".split()
)
NOT_AN_ARTICLE = frozenset("comment comments related teaser promo sponsored ad advert".split())

#: Words that say nothing of a part's subject. A name of several words marks what is not the article only if all of them are among these and OUTSIDE_NAMES
#: ("site-header", "main_nav", "comment-list"; not "market-share", "has-sidebar", "search-engine-history").
PLAIN_WORDS = frozenset(
    "area article b bar blog hero body bottom box btn button buttons card col column container content cta desktop el first form fixed global grid group head icon icons id inner item items js last layout left level line link links list main "
    "mini mobile module o outer page panel post posts primary row right rail secondary section site slot small static sticky story tertiary text the thread top ui ul unit view web wrap wrapper zone".split()
)

#: Those that inside an article may hold its title.
BANNERS = frozenset("banner masthead".split())

#: How an element stands outside: not, by a form or a name alone but with an article since, by a name that may be a subject's, by another name or a form, by the name of what holds
#: other articles, in any other way.
NOT_OUTSIDE, CLEARED, SUBJECT, NAMED, LISTED, FIRM = range(6)

#: Frequent function words of the languages read.
STOP_WORDS = frozenset(
    "the of and to a in is it that was for on are as with be at by this from or an have not but had which they you were their we his has he she her its if will would can all been one there what so more when who no out up into than them then some do could about my me your our "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich wir ihr uns kann unter was "
    "le la les de des du et à un une en est que qui dans pour pas au sur se ce il elle sont plus par avec ne son sa ses on ou mais nous vous ils leur été être avoir cette ces comme tout aux y si même lui très "
    "el los las y una por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos era es del no se "
    "il che di per non sono con della nel una gli ha più alla da dei delle".split()
)

#: Lengths in characters, and shares of function words and of link text, that decide a block.
SHORT, LONG, FEW_STOPS, SOME_STOPS, MANY_LINKS, ALL_LINKS = 70, 200, 0.04, 0.10, 0.35, 0.8

#: A comment, a declaration, or a tag with its name and attributes; a quoted value may hold anything. The end of the page ends each.
TOKEN = re.compile(r"<(?:!--(?:.*?--!?>|.*)|[!?][^>]*+>?|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>?)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
READ = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden"))
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+|:")
MARKS = re.compile(r"[.,;:!?()\d]")
LETTERS = re.compile(r"[^\W\d_]+")
OTHER_SCRIPTS = re.compile(r"[^\W\d_\u0000-\u024f]")


@dataclass(slots=True)
class Block:
    """Text between two block borders: how much of it is linked, and the container it stands in."""

    text: str
    linked: int = 0
    mark: int = NOT_OUTSIDE
    inside: bool = False
    heading: bool = False
    title: bool = False
    technical: bool = False


def _attributes(rest: str) -> dict[str, str]:
    """Those attributes of a tag that are read, each as it comes first. A quoted value is passed over as a whole."""
    found: dict[str, str] = {}
    if rest and not rest.isspace():
        for m in ATTRIBUTE.finditer(rest):
            name = m[1].lower()
            if name in READ:
                found.setdefault(name, (m[2] or "").strip("\"'"))
    return found


@lru_cache(maxsize=4096)
def _named(names: str, outside: frozenset[str]) -> frozenset[str]:
    """The words of ``outside`` by which class names or an id mark what is not the article: names that are such a word, or are put together from such and from words that say
    nothing. "hidden" counts as a name of its own alone, as utility classes have it for one size of screen or for what runs over."""
    found: set[str] = set()
    for token in names.split():
        parts = [w.lower() for w in NAME_PARTS.findall(token)]
        hits = outside.intersection(parts)
        if hits and (len(parts) == 1 or ("hidden" not in hits and all(w in outside or w in PLAIN_WORDS for w in parts))):
            found |= hits
    return frozenset(found)


def _outside(tag: str, found: dict[str, str], inside: bool) -> int:
    """How an element stands outside by itself."""
    if tag in OUTSIDE_TAGS or (tag == "header" and not inside) or (tag == "form" and inside):
        return FIRM
    own = NAMED if tag == "form" else NOT_OUTSIDE
    if not found or tag in ("html", "body"):
        return own
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return FIRM
    if found.get("role", "").lower() in OUTSIDE_ROLES:
        return FIRM
    given = f"{found.get('class', '')} {found.get('id', '')}"
    names = _named(given, OUTSIDE_NAMES)
    if tag in MAIN_TAGS and not inside:  # a page's own article may be called anything
        return LISTED if names & NOT_AN_ARTICLE else own
    if inside:
        names &= OUTSIDE_IN_ARTICLE
        return max(own, SUBJECT if names <= SUBJECTS.intersection(given.lower().split()) else NAMED if names <= BANNERS else LISTED) if names else own
    return max(own, LISTED if names & OTHER_ARTICLES else NAMED) if names else own


class Page:
    """The blocks of a page, found in one go over its tags."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.blocks: list[Block] = []
        #: Open elements: name, mark, inside an article, in a table or preformatted. Inline elements are here only where they could matter.
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.open: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        self.low: str | None = None
        self.parts: list[str] = []
        self.linked = 0
        self.heading = self.title = self.link = False
        self.breaks = 0
        self.read()

    def border(self) -> None:
        """End of a block, before anything changes about where it stands."""
        self.breaks = 0
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                _, mark, inside, technical = self.stack[-1] if self.stack else ("", NOT_OUTSIDE, False, False)
                self.blocks.append(Block(text, min(self.linked, len(text)), mark, inside, self.heading, self.title, technical))
            self.linked = 0

    def words(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.breaks and not text.isspace():
            self.breaks = 0
        if self.link:
            self.linked += len(" ".join(text.split()))

    def pop(self) -> None:
        name = self.stack.pop()[0]
        self.open[name] -= 1

    def ends_after(self, name: str, at: int) -> bool:
        """Whether an end tag of that name comes later; what is never closed must not hide the rest of the page."""
        if name not in self.ends:
            if self.low is None:
                self.low = self.page.lower()
            self.ends[name] = self.low.rfind(f"</{name}")
        return self.ends[name] >= at

    def read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        search = TOKEN.search
        while at < n:
            m = search(page, at)
            if m is None:
                self.words(page[at:])
                break
            if m.start() > at:
                self.words(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
            elif name in RAW_TAGS:
                if not m[3].endswith("/"):
                    at = self.after(name, at)
            else:
                self.start(name, m[3], at)
        self.border()

    def after(self, name: str, at: int) -> int:
        """Where the page goes on after an element whose content is no markup."""
        if not self.ends_after(name, at):
            return len(self.page) if name in CODE_TAGS else at
        close = self.low.find(f"</{name}", at)
        gap = self.page.find(">", close)
        return len(self.page) if gap < 0 else gap + 1

    def end(self, name: str) -> None:
        if name == "a":
            self.link = False
        block = name in BLOCK_TAGS
        if block or self.open.get(name):
            self.border()
        if self.open.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()
        if block:
            self.link = False
            if name in HEADINGS:
                self.heading = self.title = False

    def start(self, name: str, rest: str, at: int) -> None:
        if name == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks > 1:
                self.border()
            return
        if name in VOID_TAGS:
            if name == "hr":
                self.border()
            return
        if name == "a":
            self.link = True
        block = name in BLOCK_TAGS
        found = _attributes(rest)
        main = name in MAIN_TAGS or found.get("role") == "main"
        if block or main:
            self.border()
            if main:  # an unclosed menu does not swallow the article
                while self.stack and self.stack[-1][0] in ("nav", "header", "ul", "li", "head"):
                    self.pop()
            if name == "body":
                while self.stack and self.stack[-1][0] != "html":
                    self.pop()
            while self.stack and (self.stack[-1][0] == "p" or (name in ITEM_TAGS and self.stack[-1][0] == name)):
                self.pop()
        _, mark, inside, technical = self.stack[-1] if self.stack else ("", NOT_OUTSIDE, False, False)
        own = _outside(name, found, inside)
        if own and name not in ITEM_TAGS and name not in ("head", "html", "body") and not self.ends_after(name, at):
            own = NOT_OUTSIDE
        if own == NOT_OUTSIDE and mark in (CLEARED, SUBJECT, NAMED) and main:
            mark = CLEARED if name == "article" else NOT_OUTSIDE
        elif own == NOT_OUTSIDE and mark == NAMED and inside and name == "h1":  # an article's title may stand in a banner
            mark = NOT_OUTSIDE
        else:
            mark = max(mark, own)
        if block or own or self.open.get(name):
            if not block:
                self.border()
            self.stack.append((name, mark, inside or main, technical or name in ("pre", "table")))
            self.open[name] = self.open.get(name, 0) + 1
            if block:
                self.heading, self.title = name in HEADINGS, name == "h1"


def blocks(page: str) -> list[Block]:
    """Visible text of a page in blocks, with what is known of where each stands."""
    return Page(page).blocks


def _stops(text: str) -> float:
    found = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / max(1, len(found))


def _unlisted(text: str) -> bool:
    """Whether most letters are of a script that none of the listed function words has."""
    return 2 * len(OTHER_SCRIPTS.findall(text)) > sum(map(len, LETTERS.findall(text)))


def decide(block: Block, known: bool = True) -> bool | None:
    """First pass: True for text, False for what is not, None where a block alone cannot tell. Of a page whose language is not
    ``known``, or a block in another script, function words tell nothing."""
    n = len(block.text)
    linked = block.linked > MANY_LINKS * n
    if block.mark > CLEARED:  # such a name alone does not take long prose out of an article
        return block.mark == SUBJECT and block.inside and n >= LONG and not linked and _stops(block.text) >= SOME_STOPS
    if linked:
        if not block.inside:
            return False
        # inside an article a link may be an item or a source; a long one without a mark or a number, and with few function words, is a menu's
        menu = n >= SHORT and block.linked > ALL_LINKS * n and known and not MARKS.search(block.text) and not _unlisted(block.text) and _stops(block.text) < SOME_STOPS
        return False if menu else None
    if n < SHORT:
        return None
    if not known or _unlisted(block.text):
        return True
    stops = _stops(block.text)
    if stops >= SOME_STOPS:
        return True
    if n >= LONG:  # code and tables have few function words, and go with what is around them
        return True if stops >= FEW_STOPS or block.inside else None if block.technical or MARKS.search(block.text) else False
    return None


def inherit(labels: list[bool | None], headings: list[bool]) -> list[bool]:
    """Second pass: an open label becomes that of the nearest decided neighbour, of two as near the better one; a heading goes with what
    follows. Where nothing is text by itself, what is open is."""
    if True not in labels:
        return [x is None for x in labels]
    n = len(labels)
    before, after, last = [-1] * n, [-1] * n, -1
    for k, x in enumerate(labels):
        last = k if x is not None else last
        before[k] = last
    last = -1
    for k in range(n - 1, -1, -1):
        last = k if labels[k] is not None else last
        after[k] = last
    out = []
    for k, x in enumerate(labels):
        if x is None:
            a, b = before[k], after[k]
            if a < 0 or b < 0:
                x = labels[max(a, b)]
            elif headings[k]:
                x = labels[b]
            else:
                x = labels[a] if k - a < b - k else labels[b] if b - k < k - a else labels[a] or labels[b]
        out.append(bool(x))
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: the blocks that both passes keep, in order, one a line.

    Where a page has an article, its blocks are looked at by themselves, with a main heading just before it; where it has none, all blocks are. Names that would leave nothing of a
    page are not believed: first those of forms and parts, then those of what holds other articles. Elements, attributes and roles that mark the outside always do."""
    if not page:
        return ""
    found = blocks(page)
    for ignored in ((), (SUBJECT, NAMED), (LISTED,)):
        for b in found:
            if b.mark in ignored:
                b.mark = NOT_OUTSIDE
        for own in _candidates(found, bool(ignored)):
            text = _kept(own)
            if text:
                return text
    return ""


def _candidates(found: list[Block], again: bool) -> Iterator[list[Block]]:
    """What a page's text is looked for in: its article, an article in a wrapper that is called something else, the whole page."""
    own = [b for b in found if b.inside and b.mark in (NOT_OUTSIDE, SUBJECT)]
    if any(b.mark == NOT_OUTSIDE for b in own):
        first = next(k for k, b in enumerate(found) if b.inside)
        before = found[first - 1] if first else None
        if before and before.title and before.mark <= CLEARED and not any(b.title for b in own):
            own = [before, *own]
        yield own
    yield [b for b in found if b.inside and b.mark == CLEARED]
    if again or not any(b.inside and b.mark <= CLEARED for b in found):
        yield found


def _kept(own: list[Block]) -> str:
    """The blocks of ``own`` that both passes keep."""
    known = any(b.mark <= CLEARED and len(b.text) >= SHORT and b.linked <= MANY_LINKS * len(b.text) and _stops(b.text) >= SOME_STOPS for b in own)
    keep = inherit([decide(b, known) for b in own], [b.heading for b in own])
    return "\n".join(b.text for b, k in zip(own, keep, strict=True) if k)


def extract(pages: DataFrame, columns: list[str], column: str = "html") -> DataFrame:
    """``columns`` and the main text of every page, with its length in code points.

    A null, empty or text-free page has an empty text; repeated rows and null columns are passed on; an empty table gives no rows."""
    fields = ", ".join(f"`{pages.schema[c].name}` {pages.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(v.as_py()) for v in part.column("_html")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*columns, "text", "n_chars"])

    return pages.select(*columns, F.col(column).alias("_html")).mapInArrow(releasing(run), f"{fields}, text string, n_chars bigint")
