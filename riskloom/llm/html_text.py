"""HTML extraction: flat text blocks, judged by a decision tree on words and link density of a block and its neighbours.

The tree is fitted here to a small labelled table. Besides density it sees where a block stands: in the page's article,
outside of it, or inside a part such as a menu, footer, advert, form or comment list.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea".split())
#: Elements whose content is no text of the page, if they end; without an end only their tag is skipped.
CLOSED = set("noscript template iframe noembed noframes object svg math select".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead tr ul""".split())
#: Elements that surround a text.
ASIDE = set("aside button dialog footer form header menu nav search head".split())
# A class names a surrounding part if it is made of these words only, joined by hyphens or underscores, and one of them is
# no filler. Inside an article, words that an article's own parts may bear do not count.
_PARTS = set("""ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent
cookie cookies disqus footer login menu nav navbar navigation newsletter notice notices pager pagination popup promo
recommended related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar""".split())
_OUTER_PARTS = _PARTS | set("alert header masthead modal overlay search skip widget".split())
_FILLERS = set("""area articles bar block bottom box buttons container content form inner left links list main page panel
posts right section site slot thread top unit widget wrap wrapper""".split())
_ROLES = set("alertdialog banner complementary contentinfo dialog navigation search".split())
#: Elements whose id is read like a class; the ids of others, such as headings, are targets of links.
_WITH_ID = set("div form ol table ul".split())
#: Elements within a line; if one of them surrounds, its text is left out and its line goes on.
PHRASE = set("a abbr b bdi bdo button cite code em font i kbd label mark s samp small span strong sub sup u var".split())
_COMMENT_IDS = {"comments", "disqus_thread", "respond"}
_MARK = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z)))""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "aside")
# The labelled table: features as above (links: share of the words inside <a>; place: 1 in the article, -1 outside it on
# a page that has one, 0 on a page without; aside: 1 in surrounding parts), then 1 for text and 0 for the rest.
LABELLED = np.array([
    # in the article: headings, long and short paragraphs, linked words
    (6, 0, 0, 0, 60, 0, 1, 0, 1), (12, 0, 5, 1, 80, 0, 1, 0, 1), (80, 0, 6, 0, 45, 0, 1, 0, 1),
    (1, 0, 70, 0, 90, 0, 1, 0, 1), (2, 0, 3, 0, 2, 0, 1, 0, 1), (45, 0.1, 80, 0, 8, 0, 1, 0, 1),
    (3, 1, 60, 0, 60, 0, 1, 0, 1), (9, 0.6, 20, 0, 10, 0, 1, 0, 1), (150, 0.02, 1, 0, 5, 0, 1, 0, 1),
    (4, 0, 120, 0, 0, 0, 1, 0, 1), (1, 0, 1, 0, 0, 0, 1, 0, 1), (30, 0, 30, 0, 30, 0, 1, 0, 1),
    (1, 1, 50, 0, 2, 1, 1, 0, 1), (1, 1, 0, 0, 0, 0, 1, 0, 1), (2, 1, 1, 1, 1, 1, 1, 0, 1), (8, 1, 9, 1, 9, 1, 1, 0, 1),
    # menus, headers, footers, adverts, forms, comments, wherever they stand
    (1, 1, 0, 0, 1, 1, -1, 1, 0), (2, 1, 1, 1, 1, 1, -1, 1, 0), (8, 0, 2, 1, 7, 0, -1, 1, 0),
    (40, 0, 1, 1, 9, 0, -1, 1, 0), (5, 0, 60, 0, 0, 0, -1, 1, 0), (25, 0.1, 60, 0, 30, 0, 1, 1, 0),
    (60, 0, 80, 0, 40, 0, 1, 1, 0), (3, 0, 40, 0, 50, 0, 1, 1, 0), (1, 1, 50, 0, 2, 1, 1, 1, 0),
    (2, 1, 0, 0, 2, 1, 0, 1, 0), (30, 0, 2, 1, 50, 0, 0, 1, 0), (9, 0.2, 90, 0, 0, 0, 0, 1, 0),
    (70, 0, 60, 0, 10, 0, 0, 1, 0), (4, 0, 30, 0, 5, 0, 0, 1, 0),
    # outside the article of a page that has one
    (6, 0, 0, 0, 60, 0, -1, 0, 0), (30, 0, 40, 0, 2, 0, -1, 0, 0), (90, 0, 70, 0, 5, 0, -1, 0, 0),
    (2, 1, 1, 0, 9, 0, -1, 0, 0), (1, 0, 80, 0, 80, 0, -1, 0, 0),
    # pages without an article: density decides
    (60, 0, 5, 0, 70, 0, 0, 0, 1), (25, 0.1, 60, 0, 40, 0, 0, 0, 1), (40, 0.05, 2, 1, 30, 0, 0, 0, 1),
    (18, 0, 6, 0, 20, 0, 0, 0, 1), (120, 0.2, 90, 0, 60, 0, 0, 0, 1), (14, 0, 30, 0, 1, 1, 0, 0, 1),
    (6, 0, 2, 1, 60, 0, 0, 0, 1), (8, 0, 40, 0, 55, 0, 0, 0, 1), (4, 0, 70, 0, 30, 0, 0, 0, 1),
    (3, 0, 1, 1, 25, 0, 0, 0, 1), (11, 0.1, 60, 0, 12, 0.1, 0, 0, 1), (30, 0, 1, 0, 2, 1, 0, 0, 1),
    (90, 0.1, 0, 0, 0, 0, 0, 0, 1), (25, 0, 2, 1, 2, 1, 0, 0, 1), (50, 0.3, 1, 0, 3, 1, 0, 0, 1),
    (22, 0, 0, 0, 4, 1, 0, 0, 1), (35, 0.2, 4, 1, 6, 0.5, 0, 0, 1), (4, 0, 0, 0, 0, 0, 0, 0, 1),
    (1, 0, 0, 0, 0, 0, 0, 0, 1), (16, 0, 3, 1, 5, 1, 0, 0, 1), (70, 0.25, 60, 0, 2, 1, 0, 0, 1),
    (1, 1, 0, 0, 1, 1, 0, 0, 0), (2, 1, 2, 1, 60, 0, 0, 0, 0), (12, 0.9, 3, 1, 4, 1, 0, 0, 0),
    (30, 0.8, 50, 0, 40, 0, 0, 0, 0), (16, 0.5, 40, 0, 3, 1, 0, 0, 0), (6, 0.5, 60, 0, 70, 0, 0, 0, 0),
    (4, 0, 2, 1, 3, 1, 0, 0, 0), (3, 0, 1, 1, 2, 1, 0, 0, 0), (5, 0, 4, 1, 0, 0, 0, 0, 0),
    (20, 0.7, 60, 0, 60, 0, 0, 0, 0), (9, 0.4, 10, 0.5, 12, 0.6, 0, 0, 0), (2, 1, 30, 0, 30, 0, 0, 0, 0),
    (45, 0.9, 3, 0, 60, 0, 0, 0, 0), (5, 1, 0, 0, 0, 0, 0, 0, 0), (3, 0.5, 0, 0, 90, 0, 0, 0, 0),
    (26, 0.6, 2, 1, 20, 0, 0, 0, 0), (80, 0.6, 40, 0, 40, 0, 0, 0, 0),
], float)


def fit_tree(rows: np.ndarray = LABELLED) -> tuple:
    """A tree of (feature, cut, below, above) with labels at its leaves, grown by Gini impurity to pure leaves."""
    x, y = rows[:, :-1], rows[:, -1]
    if len(set(y)) == 1:
        return (int(y[0]),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = y[x[:, f] < cut]
            high = y[x[:, f] >= cut]
            best = min(best, (sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high)), f, float(cut)))
    if best[0] == np.inf:
        return (int(y.mean() >= 0.5),)
    _, f, cut = best
    return f, cut, fit_tree(rows[x[:, f] < cut]), fit_tree(rows[x[:, f] >= cut])


@cache
def default_tree() -> tuple:
    return fit_tree()


def is_text(tree: tuple, features: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] < tree[1] else tree[3]
    return bool(tree[0])


def _names_part(token: str, known: set[str]) -> bool:
    words = re.split(r"[-_]+", token.lower().strip("-_"))
    return all(w in known or w in _FILLERS for w in words) and any(w in known for w in words)


def _surrounds(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element surrounds a text: by its kind or as it is hidden, and by its class, role or id only."""
    if name in ASIDE:
        return True, False
    if not attributes or name in ("html", "body", "article", "main"):
        return False, False
    has = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(has.get("style", "")):
        return True, False
    known = _PARTS if in_article else _OUTER_PARTS
    tokens = has.get("class", "").split() + ([has.get("id", "")] if name in _WITH_ID or not in_article else [])
    by_name = any(_names_part(t, known) for t in tokens if t) or has.get("id", "").lower() in _COMMENT_IDS
    return False, by_name or has.get("role", "").lower() in _ROLES


def text_blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, linked words, in an article, in a surrounding part) of each block with text, in page order.

    Open and unclosed elements are borne with: a block element ends an open paragraph, an end tag closes what is open
    inside its element, and one without a start is skipped. Text in script-like elements is not text. A class word such as
    sidebar does not make an element a surrounding part if the page's article stands in it: a main element, or else the
    longest article if the element has half of the page's words.
    """
    out, parts, linked = [], [], 0
    open_names: list[tuple[str, bool, bool, bool, bool]] = []
    named: list[int] = []  # open elements that surround by name, by where they start
    inside: list[int] = []  # open articles
    around: dict[int, tuple[bool, list[int]]] = {}  # of each article in a named element: is it main, and what is open
    endless: set[str] = set()  # elements that no end tag follows any more
    articles = asides = links = mutes = at = 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            n = text.count(" ") + 1
            out.append((text, n, min(linked, n), int(articles > 0), int(asides > 0), tuple(named), tuple(inside)))
        parts.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal articles, asides, links, mutes
        while len(open_names) > depth:
            name, article, aside, by_name, mute = open_names.pop()
            mutes -= mute
            if by_name:
                named.pop()
            if article:
                inside.pop()
            articles, asides, links = articles - article, asides - aside, links - (name == "a")

    while at < len(page):
        m = _MARK.search(page, at)
        text = html.unescape(page[at: m.start() if m else len(page)])
        if text and not mutes:
            parts.append(text)
            if links:
                linked += len(text.split())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            close_block()
        if m[1]:
            depth = next((i for i in range(len(open_names) - 1, -1, -1) if open_names[i][0] == name), None)
            if depth is not None:
                pop(depth)
            continue
        closed = m[3].rstrip(">").endswith("/")
        if name in RAW or name in CLOSED and not closed and name not in endless:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if end or name in RAW:
                at = end.end() if end else len(page)
                continue
            endless.add(name)
        if name in VOID or name in CLOSED or closed:
            continue
        if name in BLOCK:
            depth = next((i for i in range(len(open_names) - 1, -1, -1) if open_names[i][0] in BLOCK), None)
            if depth is not None and open_names[depth][0] == "p":
                pop(depth)
        article = name in ("article", "main") or 'role="main"' in m[3]
        aside, by_name = _surrounds(name, m[3], articles > 0)
        mute = name in PHRASE and (aside or by_name)
        aside, by_name, mutes = aside and not mute, by_name and not mute, mutes + mute
        open_names.append((name, article, aside, by_name, mute))
        if by_name:
            named.append(at)
        if article:
            if named:
                around[at] = (name == "main" or 'role="main"' in m[3], list(named))
            inside.append(at)
        articles, asides, links = articles + article, asides + aside, links + (name == "a")
    close_block()
    wraps: set[int] = set()
    if around:
        size = {x: 0 for b in out for x in b[5] + b[6]}
        for b in out:
            for x in {*b[5], *b[6]}:
                size[x] += b[1]
        wraps = {x for main, outer in around.values() if main for x in outer}
        longest = max((x for b in out for x in b[6]), key=lambda x: size[x], default=None)
        if not wraps and longest in around:
            total = sum(b[1] for b in out)
            wraps = {x for x in around[longest][1] if 2 * size.get(x, 0) >= total}
    return [(*b[:4], int(b[4] or not wraps.issuperset(b[5]))) for b in out]


def main_text(page: str | None, tree: tuple) -> str:
    blocks = text_blocks(page or "")
    whole = any(b[3] and not b[4] for b in blocks)
    dense = [(0, 0.0), *((b[1], b[2] / b[1]) for b in blocks), (0, 0.0)]
    keep = [b[0] for i, b in enumerate(blocks) if is_text(tree, (
        *dense[i + 1], *dense[i], *dense[i + 2], (1 if b[3] else -1) if whole else 0, b[4]))]
    return "\n\n".join(keep)


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html); other columns are ignored.

    A null, empty or textless page has the empty text. Every page is taken whole, on its own, so repeated rows give
    repeated results and no size is too large but for one page in memory.
    """
    tree = tree or default_tree()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
