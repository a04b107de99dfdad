"""Main text of HTML pages by the line-block distribution.

Markup is stripped to lines, one for each block of text, and each line weighs its
length times what its place is worth: MARK times as much in a mark (article,
main), a MARK-th in an element whose class or id has a word that may name what
stands around, and next to nothing (AROUND_WEIGHT) where menus, headers, footers,
sidebars, notices, adverts, forms and reader comments stand, or in lines of links
outside a mark. The sums over sliding windows of lines are the distribution.
Lines that follow each other and are worth the same form a stretch: it dives where
that ends, and where its windows reach a threshold that the page's own line of
middle length sets is its surge point. What lies between is kept; in a mark, where
headings and short lines come first, the surge counts from the stretch's start.
Where a page has a mark, the threshold for lines outside it is MARK times higher.
No line is kept or dropped but by its stretch's windows.

A class or id names what stands around for sure if all its words do ("comments",
"related-posts"); if only some do ("popular-science") it is the weak sign above.
Elements of such a name, and forms, are not around if they hold a mark with half
of the page's text; nor are forms that hold half of it themselves. Work is linear
in the page, also with unclosed tags.

Cases: null and empty pages and pages without text give an empty text; pages of
any length are read whole; unclosed and stray tags are tolerated; repeated rows
give repeated rows; an empty table gives an empty result; further input columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assaya.llm.common import read_table

#: Lines of a window; a surge's least window, as a share of the page's line of middle length and in characters.
WINDOW, SHARE, LEAST = 3, 0.2, 40
#: What a mark weighs; what a line around the article does; least characters of a form that may hold the page.
MARK, AROUND_WEIGHT, FORM = 4, 1e-6, 200
#: Share of a line's characters that stand in links from which it counts as navigation.
LINKS = 0.6

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)", re.S)

#: Fixed values of HTML: elements whose content is no text, that have no end tag, that make a block.
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video head title textarea select option datalist".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag of a kind ends.
ENDS = {**{t: frozenset({"p"}) for t in BLOCK - {"html", "body"}}, "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What stands around an article, by element, role, and words of a class or id.
AROUND = frozenset("nav aside footer form button dialog menu input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promotion
nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets related recommended trending popular
footer masthead topbar toolbar cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe
subscription signup login share sharing social comment comments commentlist reply replies disqus discussion respond
pagination pager skip toc tags copyright""".split())
#: Words that say no more of a name than its place or form.
FORMS = frozenset("""area bar block body bottom box btn button buttons card cards center col column container content group head header
holder icon icons image inner item items label left link links list lists main module mobile desktop outer page panel post posts
article articles right row section site slot space story stories text title top unit wrap wrapper zone first last global primary secondary
fixed sticky inline user reader new more latest""".split())
#: Words before a name that only say what a page has.
MODIFIERS = frozenset("has with no without".split())
ARTICLE_NAMES = frozenset("article main-content article-body articlebody article-content post-content entry-content story-body post-body".split())


class Line:
    """Text of one block: its parts, how many characters stand in links, whether it stands around or inside the article, or in an element with a weak name."""

    __slots__ = ("parts", "linked", "around", "article", "weak", "held", "mark")

    def __init__(self, around: bool, article: bool, weak: bool, held: int, mark: int):
        self.parts, self.linked = [], 0
        self.set(around, article, weak, held, mark)

    def set(self, around: bool, article: bool, weak: bool, held: int, mark: int) -> None:
        """``held`` and ``mark`` number the innermost wrapper and mark, -1 if none."""
        self.around, self.article, self.weak, self.held, self.mark = around, article, weak, held, mark

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names(attributes: str) -> tuple[bool, bool, set[str], str, bool]:
    """Whether class or id name what stands around, or only may; whole class names and ids, role, whether hidden."""
    strong, weak, whole, role, hidden = False, False, set(), "", False
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5] or "").lower()
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            whole.update(value.split())
            for name in value.split():
                parts = [x for x in re.split(r"[^a-z]+", name) if x]
                said = [x in NAMES and (not k or parts[k - 1] not in MODIFIERS) for k, x in enumerate(parts)]
                if any(said):
                    sure = all(yes or len(x) == 1 or x in FORMS for x, yes in zip(parts, said, strict=True))
                    strong, weak = strong or sure, weak or not sure
        elif name == "role":
            role = value.strip()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return strong, weak, whole, role, hidden


def lines(page: str) -> list[Line]:
    """Blocks of a page, in order."""
    out: list[Line] = []
    # (element, stands around, in the article, in a weak name, wrapper, mark, in a link) of each open element
    open_: list[tuple[str, bool, bool, bool, int, int, bool]] = [("", False, False, False, -1, -1, False)]
    count: dict[str, int] = {}  # open elements by name
    firm = [0]  # for each open element the place of the nearest that isn't inline, itself included
    wrappers: list[tuple[int, bool]] = []  # the wrapper outside, whether a form
    marks: list[int] = []  # the wrapper outside
    line = Line(*open_[-1][1:6])
    silent, at, size = 0, 0, len(page)

    def end_line() -> None:
        nonlocal line
        if line.parts:
            out.append(line)
        line = Line(*open_[-1][1:6])

    def say(text: str) -> None:
        nonlocal line
        if text and not silent:
            if not line.parts:
                line.set(*open_[-1][1:6])
            line.parts.append(text)
            if open_[-1][6]:
                line.linked += len(text.strip())

    def pop() -> str:
        nonlocal silent
        firm.pop()
        gone = open_.pop()[0]
        count[gone] -= 1
        silent -= gone in SILENT
        return gone

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            say(html.unescape(page[at:]))
            break
        say(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            say(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if count.get(tag):
                if tag in BLOCK:
                    end_line()
                while len(open_) > 1:
                    gone = pop()
                    if gone in BLOCK and gone != tag:
                        end_line()
                    if gone == tag:
                        break
                if tag in BLOCK:
                    line = Line(*open_[-1][1:6])
            elif tag == "p":
                end_line()
            continue
        if tag == "br" or tag == "wbr":
            say(" " if tag == "br" else "")
            continue
        closing = ENDS.get(tag)
        if closing:
            first, depth = 0, firm[-1]
            while open_[depth][0] in closing:
                first, depth = depth, firm[depth - 1]
            while first and len(open_) > first:
                pop()
        if tag in BLOCK:
            end_line()
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCK and tag not in INLINE:
            continue
        strong, maybe, whole, role, hidden = _names(m[4]) if m[4] else (False, False, set(), "", False)
        _, around, article, weak, held, mark, link = open_[-1]
        mine = tag in ("article", "main") or role in ("main", "article") or bool(whole & ARTICLE_NAMES)
        around = around or hidden or tag in AROUND and tag != "form" or role in ROLES or (tag == "header" and not article)
        root = tag in ("html", "body")
        if tag == "form" or strong and not mine and not root:
            wrappers.append((held, tag == "form"))
            held = len(wrappers) - 1
        if mine and not around:
            article, weak = True, False
            marks.append(held)
            mark = len(marks) - 1
        open_.append((tag, around, article, weak or maybe and not mine and not root, held, mark, link or tag == "a"))
        count[tag] = count.get(tag, 0) + 1
        firm.append(firm[-1] if tag in INLINE else len(open_) - 1)
        silent += tag in SILENT
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else size
        if tag in BLOCK:
            line = Line(*open_[-1][1:6])
    end_line()
    settle(out, wrappers, marks)
    return out


def settle(found: list[Line], wrappers: list[tuple[int, bool]], marks: list[int]) -> None:
    """Makes the lines of wrappers stand around, but for wrappers that hold the page's text."""
    if not wrappers:
        return
    total, inside, alone = 0, [0] * len(wrappers), [0] * len(marks)
    for x in found:
        if not x.around:
            size = max(0, len(x.text()) - x.linked)
            total += size
            if x.held >= 0:
                inside[x.held] += size
            if x.mark >= 0 and x.held == marks[x.mark]:
                alone[x.mark] += size
    for k in range(len(wrappers) - 1, -1, -1):  # a wrapper comes after those outside it
        if wrappers[k][0] >= 0:
            inside[wrappers[k][0]] += inside[k]
    free = {k for k, (_, form) in enumerate(wrappers) if form and inside[k] >= FORM and 2 * inside[k] > total}
    holds: set[int] = set()
    for k, size in enumerate(alone):
        held = marks[k] if size and 2 * size >= total else -1
        while held >= 0 and held not in holds:
            holds.add(held)
            held = wrappers[held][0]
    free |= holds
    shut: list[bool] = []
    for k, (outer, _) in enumerate(wrappers):
        shut.append(k not in free or outer >= 0 and shut[outer])
    for x in found:
        x.around = x.around or x.held >= 0 and shut[x.held]


def worth(x: Line, text: str) -> tuple[float, int]:
    """What a line's place is worth, and the characters that count."""
    links = x.linked >= LINKS * len(text)
    if x.around or links and (x.weak or not x.article):
        return AROUND_WEIGHT, len(text)
    place = (MARK if x.article else 1) / (MARK if x.weak else 1)
    return place, max(1, len(text) - x.linked) if links else len(text)


def kept_lines(found: list[Line], share: float = SHARE, least: int = LEAST) -> list[str]:
    """Texts of the lines between surge and dive points."""
    stretches: list[tuple[bool, float, list[str], list[int]]] = []  # in a mark, worth, texts, characters that count
    for x in found:
        text = x.text()
        if not text:
            continue
        place, size = worth(x, text)
        if not stretches or stretches[-1][:2] != (x.article, place):
            stretches.append((x.article, place, [], []))
        stretches[-1][2].append(text)
        stretches[-1][3].append(size)
    sizes = sorted(n for _, place, _, own in stretches if place > AROUND_WEIGHT for n in own)
    if not sizes:
        return []
    windows = [[place * sum(own[k : k + WINDOW]) for k in range(len(own))] for _, place, _, own in stretches]
    need, marked = share * sizes[len(sizes) // 2], any(article and place > AROUND_WEIGHT for article, place, _, _ in stretches)
    # A page without a mark keeps its highest windows, however short its lines are.
    outside = max(least, need * MARK) if marked else min(max(map(max, windows)), max(least, need))
    out = []
    for (article, _, texts, _), heights in zip(stretches, windows, strict=True):
        surge = next((k for k, x in enumerate(heights) if x >= (need if article else outside)), None)
        if surge is not None:
            out += texts[0 if article else surge :]
    return out


def main_text(page: str | None) -> str:
    return "\n".join(kept_lines(lines(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
