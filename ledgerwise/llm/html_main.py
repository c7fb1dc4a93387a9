"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf path of block tags (inline
tags are transparent). Elements that say they are boilerplate (menus, headers and footers of the
page, sidebars, forms, adverts, notices, comments: by tag, by role, or by a class or id made of
such words and of words of layout only) weigh nothing, inline ones too. A name that holds such a
word among others, as forms-of-government, is a hint: outside article and main it leaves a path a
``HINTED`` of its score. For every path the length of its text and its punctuation are divided by
its number of blocks, links counting against it. Both ratios are spread over the blocks in page order and smoothed with a Gaussian,
so a heading or a short paragraph gains from its neighbours; their geometric fusion is averaged
for each path. Paths that reach ``LEAST`` of the page's best are content. Where article or main
elements hold most of that text, all paths in them are content, and paths outside count a
``OUTSIDE`` of it. Elsewhere lists and tables go with the paragraphs that they stand among, however
short their items are, unless they consist of links.

Defined cases: null and empty html give empty text; unclosed and stray tags are read as browsers
do in the main cases (a block ends an open paragraph; an end tag closes up to its start tag or is
ignored); a cut-off tag or comment at the end is dropped; very long and deeply nested pages are
read whole, paths being numbers; ties of scores stay together; repeated rows are extracted each;
an empty table gives none. Columns but page_id, url and html aren't read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, SIGMA, OUTSIDE, HINTED = 0.08, 1.0, 0.1, 0.3

_TAG = re.compile(r"<(?:!--(?:.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_BLOCKS = frozenset("html head body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table caption thead tbody tfoot tr td th form fieldset legend details summary address hr dialog center menu search hgroup title option select button label textarea noscript iframe template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg math template select".split())
#: What ends an open paragraph.
_ENDS_P = _BLOCKS - frozenset("title option select button label textarea noscript iframe template html head body tr td th thead tbody tfoot caption legend".split())
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_LISTS = frozenset("ul ol dl table".split())
_SCOPE = frozenset("ul ol menu dl table body article section div".split())
#: Tags whose text is never content, wherever they stand.
_NEVER = frozenset("head title script style nav aside footer form fieldset legend button select option label textarea noscript iframe template svg math dialog menu search xmp noembed noframes object audio video canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of names of boilerplate, and words of layout that may stand beside them.
_BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense banner banners sponsor sponsored sponsors promo promos promotion promotions menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars masthead topbar footer "
    "cookie cookies consent gdpr notice notices notification notifications announcement announcements alert alerts feedback popup popups modal modals overlay newsletter newsletters subscribe subscription signup login comment comments commentlist disqus respond response responses reply replies discussion "
    "related recommend recommended recommendation recommendations readmore share sharing social widget widgets toolbar pagination pager tags copyright legal disclaimer form forms search skiplink skiplinks hidden teaser teasers".split()
)
_LAYOUT = frozenset(
    "a and the site page main top bottom left right center middle upper lower inner outer primary secondary box block container wrapper wrap content contents area section region panel group list lists item items link links button buttons bar row col column columns grid flex widget widgets slot unit zone module component card cards "
    "header head body title text small large big mini full mobile desktop sticky fixed floating inline js sr only skip read more post posts article articles entry news blog user users reader readers global local social media email mail contact privacy policy terms thread form forms field input old new first last leader leaderboard google dfp id".split()
)
_HEADER = frozenset("header".split())
#: Words of a container about what stands beside or in it, not about itself.
_ABOUT = re.compile(r"(?:^|(?<=[^a-z]))(?:has|with|no|without|show|hide)-[a-z-]+")
_SIDE_BAR = re.compile(r"(?<![a-z])side-bar")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_INLINE = frozenset("span a b i em strong small sup sub u s ins mark font abbr cite q time label".split())


def _plain(name: str) -> str:
    """Lower case with camel humps as dashes."""
    return _SIDE_BAR.sub("sidebar", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-"))


def _named(value: str, inside: bool) -> int:
    """2 if a class or id is that of boilerplate, 1 if it holds a word of it among others, else 0."""
    found = 0
    for one in _ABOUT.sub("", _plain(value)).split():
        words = re.findall("[a-z]+", one)
        bad = [w for w in words if w in _BOILERPLATE or w in _HEADER and not inside]
        if bad:
            found = max(found, 2 if all(w in _BOILERPLATE or w in _LAYOUT or w in _HEADER for w in words) else 1)
    return found


def _judged(tag: str, attributes: str, inside: bool) -> tuple[int, str]:
    """2 for boilerplate, 1 for a hint of it, else 0; and the element's name in paths. inside: article or main is open."""
    if tag in _NEVER or tag == "header" and not inside:
        return 2, tag
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0, tag
    name, found = "", 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ROLES:
            return 2, tag
        if key in ("class", "id"):
            found = max(found, _named(value, inside))
            if key == "class":
                name = "." + " ".join(sorted(value.lower().split()))
    return found, tag + name.rstrip(".")


class Paths:
    """Root-to-leaf paths as numbers: 0 is the root; of each the parent, whether article or main is in it, whether a name hints at boilerplate, and the path of what holds its outermost list or table, -1 without one."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.inside, self.hinted, self.around = [-1], [False], [False], [-1]

    def below(self, parent: int, tag: str, name: str, hint: bool) -> int:
        if (i := self.known.get((parent, name))) is None:
            i = self.known[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.inside.append(self.inside[parent] or tag in ("article", "main"))
            self.hinted.append(self.hinted[parent] or hint)
            self.around.append(self.around[parent] if self.around[parent] >= 0 else parent if tag in _LISTS else -1)
        return i


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """(path, text, characters of it in links) of each block of text that isn't boilerplate, in page order."""
    out: list[tuple[int, str, int]] = []
    paths, opened = Paths(), Counter()
    stack: list[tuple[str, int, bool]] = []  # tag, path, boilerplate
    text: list[str] = []
    link, linked, at = 0, 0, 0
    mute, nested = "", 0  # an inline element of boilerplate, and how many of its tag are open

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((stack[-1][1] if stack else 0, whole, linked))
            text.clear()
        linked = 0

    def cut(i: int) -> None:
        nonlocal mute
        flush()
        opened.subtract(s[0] for s in stack[i:])
        del stack[i:]
        mute = ""

    def close(tags: set[str], stop: frozenset[str] | set[str] = frozenset()) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                cut(i)
                return
            if stack[i][0] in stop:
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not mute and not (stack and stack[-1][2]):
            text.append(piece)
            if link:
                linked += len(piece)

    for m in iter(lambda: _TAG.search(page, at), None):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == mute:
                nested -= 1
                mute = mute if nested else ""
            if tag == "a":
                link = 0
            elif tag == "p" and not opened["p"]:
                flush()
            elif tag in _BLOCKS:
                close({tag})
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            add(" ")
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            at = end.start() if end else len(page)
            if tag in _BLOCKS:
                flush()
            if end:
                at = page.find(">", end.end() - 0)
                at = at + 1 if at >= 0 else len(page)
            continue
        inside = paths.inside[stack[-1][1]] if stack else False
        if tag not in _BLOCKS:
            if tag == mute:
                nested += 1
            elif not mute and tag in _INLINE and m[3] and _judged(tag, m[3], inside)[0] == 2:
                mute, nested = tag, 1
            continue
        if tag in _ENDS_P:
            close({"p"}, {"td", "th", "button", "table"})
        if tag in _SAME:
            close(set(_SAME[tag].split()), _SCOPE)
        if tag[0] == "h" and tag[1:].isdigit() and stack and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
            cut(len(stack) - 1)
        flush()
        if tag in _VOID:
            continue
        _, above, bad = stack[-1] if stack else ("", 0, False)
        found, name = _judged(tag, m[3], paths.inside[above])
        stack.append((tag, paths.below(above, tag, name, found == 1), bad or found == 2))
        opened[tag] += 1
        mute = ""
    add(page[at:])
    flush()
    return paths, out


def content_paths(paths: Paths, found: list[tuple[int, str, int]]) -> set[int]:
    """The paths whose fused and smoothed ratios reach LEAST of the best, and those that belong to them."""
    place: dict[int, int] = {}
    of = np.array([place.setdefault(p, len(place)) for p, _, _ in found])
    n = np.bincount(of)
    long = np.bincount(of, [max(0, len(t) - k) for _, t, k in found])
    marks = np.bincount(of, [len(_PUNCTUATION.findall(t)) for _, t, _ in found])
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    spread = lambda ratio: np.convolve(np.pad(ratio[of], reach, mode="edge"), kernel / kernel.sum(), "valid")
    fused = np.sqrt(spread(long / n) * spread(0.1 + marks / n))
    score = np.bincount(of, fused) / n
    links = np.bincount(of, [k for *_, k in found]) / np.maximum(1, np.bincount(of, [len(t) for _, t, _ in found]))
    score = np.where(links > 0.6, 0, score)
    inside, hinted = (np.array([x[p] for p in place]) for x in (paths.inside, paths.hinted))
    score = np.where(hinted & ~inside, HINTED * score, score)
    carries = 2 * long[inside].sum() > long.sum()
    if carries:
        score = np.where(inside, score, OUTSIDE * score)
    keep = {p for p, i in place.items() if carries and inside[i] or score[i] > 0 and score[i] >= LEAST * score.max()}
    around = {paths.parent[p] for p in keep}
    return keep | {p for p, i in place.items() if links[i] <= 0.6 and paths.around[p] in around and paths.around[p] >= 0}


def main_text(page: str | None) -> str:
    paths, found = blocks(page or "")
    if not found:
        return ""
    keep = content_paths(paths, found)
    return "\n".join(t for p, t, _ in found if p in keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
