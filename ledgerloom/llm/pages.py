"""Main text of web pages by tree scoring.

A page is read once into a tree of elements and, in page order, its text blocks. Elements that are never
part of an article (menus, forms, scripts, ...) are left out with all they hold, and so are those whose class, id or role
names what surrounds one (adverts, sidebars, reader comments, ...), unless a class of their own names an article. Classes that
tell the layout (``no-sidebar``, ``ad-free``) say nothing.
Each block earns points for its length and its commas, discounted by the share of its text that is links, and
passes them on to its ancestors, half as many to each next one. All of it takes one pass over the elements up and one down. The best container is kept, widened to the
article or main element around it, and so are those siblings that score well against it. The blocks of
what is kept are joined in page order.

Inside a block, character references are decoded and each run of white space becomes one space; line breaks
count as white space. Blocks are joined by two newlines; nothing else is dropped or cut.

Defined results: a null or empty page has an empty text; a page without any text blocks too; pages cut off
in a tag, a comment or a script end there; null ids and repeated rows are kept; other columns are ignored.
Each page is on its own, so no shuffle is needed and a task holds a small batch of pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element names of the HTML standard by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select option optgroup textarea input iframe object embed applet canvas svg math audio video dialog menu datalist noembed noframes map".split())
CLOSED_BY = {  # an open element, and those whose start ends it
    "p": BLOCK - {"body", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: For each element the open ones that its start may end.
CLOSES = {}
for _open, _starts in CLOSED_BY.items():
    for _start in _starts:
        CLOSES.setdefault(_start, set()).add(_open)
#: What ends the search for an open element that a start ends.
SCOPE = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
#: Words in class, id and role that mark what surrounds an article.
AROUND = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising adbox adslot adbanner banner sponsor sponsored sponsors promo promos promotion outbrain taboola"
    " menu menus menubar navbar nav navigation navigational breadcrumb breadcrumbs pagination pager paginator sidebar sidebars sidenav toolbar footer footnav masthead topbar header"
    " comment comments commentlist commentary respond replies reply disqus responses discussion"
    " cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay lightbox"
    " newsletter subscribe subscription signup login register search searchbox searchform form"
    " social share sharing shares sharebar related recommended recommendations recirculation trending popular widget widgets tags"
    " copyright legal disclaimer contentinfo complementary skip skiplink hidden offscreen print noprint".split()
)
#: Words that mark an article and, as a class of their own, outweigh the former; readers' words outweigh both.
WITHIN = frozenset("article articlebody entry post story content main body text hentry maincontent".split())
READERS = frozenset("comment comments commentlist respond replies reply disqus".split())
#: Those of the former that leave out even an article element.
NO_ARTICLE = READERS | frozenset("sidebar ad advertisement related share newsletter footer nav menu cookie".split())
#: First and last words of a class that tell how an element is laid out (no-sidebar, ad-free), not what it is.
LAYOUT_FIRST = frozenset("no not has have with without hide".split())
LAYOUT_LAST = frozenset("off on free open opened closed enabled disabled none less".split())
MAIN = frozenset({"article", "main"})
PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
LEAST_CHARS, LEAST_SCORE, SIBLING_SHARE = 25, 10.0, 0.2
#: Why an element is left out: it never is part of an article, its names say so, they say it is the readers'.
NEVER_PART, BY_NAME, BY_READERS = 1, 2, 3


def _marks(attributes: str, tag: str) -> tuple[int, bool]:
    """Why an element is left out by its attributes (0: it is not), and whether they name an article."""
    around, within = set(), False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return NEVER_PART, False
        if name in ("class", "id", "role", "itemprop"):
            for one in value.split():
                words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", one)]
                if len(words) > 1 and (words[0] in LAYOUT_FIRST or words[-1] in LAYOUT_LAST):
                    continue
                hits = AROUND.intersection(words)
                around |= hits
                within |= not hits and not WITHIN.isdisjoint(words)
    if tag in ("html", "body", "main") or not around:
        return 0, within
    if not READERS.isdisjoint(around):
        return BY_READERS, False
    if within or tag == "article" and NO_ARTICLE.isdisjoint(around):
        return 0, within
    return BY_NAME, False


class Page:
    """The elements and the text blocks of one page."""

    def __init__(self, source: str):
        self.tag, self.parent, self.out, self.within = ["#"], [-1], [0], [False]
        self.never = [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._runs: list[str] = []
        self._links = 0
        self._where = 0
        self._read(source)

    def _flush(self) -> None:
        if self._runs:
            text = " ".join("".join(self._runs).split())
            if text:
                self.blocks.append((self._where, text, min(self._links, len(text))))
            self._runs, self._links = [], 0

    def _text(self, raw: str, stack: list[int], links: int) -> None:
        top = stack[-1]
        if self.never[top] or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not self._runs:
            if not text.strip():
                return
            self._where = next(i for i in reversed(stack) if self.tag[i] in BLOCK or i == 0)
        self._runs.append(text)
        if links:
            self._links += len(text.strip())

    def _read(self, source: str) -> None:
        stack, links, at, length = [0], 0, 0, len(source)
        tags, opened = self.tag, Counter()  # how many elements of each name are open

        def cut(depth: int) -> int:
            """Close the elements from ``depth`` on; the number of links among them."""
            gone = 0
            for i in stack[depth:]:
                opened[tags[i]] -= 1
                gone += tags[i] == "a"
            del stack[depth:]
            return gone

        while at < length:
            found = TOKEN.search(source, at)
            if not found:
                self._text(source[at:], stack, links)
                break
            if found.start() > at:
                self._text(source[at : found.start()], stack, links)
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, closing = name.lower(), found[1] or found[4]
            if closing:
                if name in BLOCK and not self.never[stack[-1]]:
                    self._flush()
                if not opened[name]:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == name:
                        links -= cut(depth)
                        break
                    if name not in BLOCK and tags[stack[depth]] in SCOPE:
                        break  # an inline end does not close what holds it
                continue
            attributes = found[3] if found[2] else found[6]
            if name == "br":
                self._text("\n", stack, links)
                continue
            if name in BLOCK:
                if any(opened[x] for x in CLOSES.get(name, ())):
                    for depth in range(len(stack) - 1, 0, -1):
                        inner = tags[stack[depth]]
                        if name in CLOSED_BY.get(inner, ()):
                            if not self.never[stack[-1]]:
                                self._flush()
                            links -= cut(depth)
                            break
                        if inner in SCOPE and not (inner in ("td", "th") and name in ("td", "th", "tr")):
                            break
                if not self.never[stack[-1]]:
                    self._flush()
            if name in VOID:
                continue
            top = stack[-1]
            out, within = _marks(attributes, name) if attributes.strip(" \t\r\n/") else (0, False)
            if name in NEVER or name == "header" and not any(opened[x] for x in MAIN):
                out = NEVER_PART  # a page's header goes; an article's own header may hold its title
            tags.append(name)
            self.parent.append(top)
            self.out.append(out)
            self.never.append(self.never[top] or out == NEVER_PART)
            self.within.append(within or name in MAIN)
            node = len(tags) - 1
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(source, at)
                if not self.never[node]:
                    stack.append(node)
                    self._text(source[at : end.start() if end else length], stack, links)
                    stack.pop()
                at = end.end() if end else length
                continue
            if attributes.endswith("/") and name not in BLOCK and name != "a":
                continue
            stack.append(node)
            opened[name] += 1
            links += name == "a"
        self._flush()

    def main_text(self) -> str:
        """The blocks of the best container and its kept siblings.

        Elements that their names leave out count only where without them the page would have no text in an article and none of a
        paragraph's length; the readers' words never count. Every step is one pass over the elements, up or down.
        """
        inside = self.within[:]
        for n in range(1, len(inside)):
            inside[n] = inside[n] or inside[self.parent[n]]
        for left_out in ((BY_NAME, BY_READERS), (BY_READERS,)):
            gone = [False] * len(self.tag)
            for n in range(1, len(self.tag)):  # parents come before their children
                gone[n] = gone[self.parent[n]] or self.out[n] in left_out
            blocks = [b for b in self.blocks if not gone[b[0]]]
            if any(inside[n] or len(text) >= LEAST_CHARS for n, text, _ in blocks) or BY_NAME not in self.out:
                break
        return "\n\n".join(self._kept(blocks)) if blocks else ""

    def _kept(self, blocks: list[tuple[int, str, int]]) -> list[str]:
        count = len(self.tag)
        score, chars, linked, scored = [0.0] * count, [0] * count, [0] * count, [False] * count
        for node, text, links in blocks:
            chars[node] += len(text)
            linked[node] += links
            if len(text) >= LEAST_CHARS:
                points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)) * (1 - links / len(text))
                holder = max(0, self.parent[node]) if self.tag[node] in PARAGRAPHS else node
                score[holder] += points
                scored[holder] = True
        for n in range(count - 1, 0, -1):  # half of the points of each element go to the one around it
            up = self.parent[n]
            chars[up] += chars[n]
            linked[up] += linked[n]
            score[up] += score[n] / 2
            scored[up] = scored[up] or scored[n]
        density = [b / a if a else 0.0 for a, b in zip(chars, linked, strict=True)]
        final = {n: (score[n] + 25 * self.within[n]) * (1 - density[n]) for n in range(count) if scored[n]}
        if not final:  # short blocks only: an article if there is one, else the page
            named = [n for n in range(count) if self.within[n] and chars[n]]
            best = max(named, key=lambda n: chars[n]) if named else 0
        else:
            best = max(final, key=lambda n: (final[n], -n))
            up = best
            while up > 0 and self.tag[up] not in MAIN:
                up = self.parent[up]
            best = up or best
        keep = [False] * count
        keep[best] = True
        if best and self.tag[best] not in ("body", "html"):
            least = max(LEAST_SCORE, SIBLING_SHARE * final.get(best, 0.0))
            for n in range(1, count):
                if n != best and chars[n] and self.parent[n] == self.parent[best]:
                    if final.get(n, 0.0) >= least and (self.tag[best] not in MAIN or self.tag[n] in MAIN):
                        keep[n] = True
                    elif self.tag[best] not in MAIN and self.tag[n] in ("p", "h1", "h2", "h3", "pre", "blockquote", "ul", "ol") and density[n] < 0.25 and chars[n] >= 3 * LEAST_CHARS:
                        keep[n] = True
        for n in range(1, count):
            keep[n] = keep[n] or keep[self.parent[n]]
        return [text for node, text, _ in blocks if keep[node]]


def main_text(source: str | None) -> str:
    """The main text of one page."""
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(x) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, {url_col} string, text string, n_chars long")
