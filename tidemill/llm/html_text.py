"""Main text of web pages by tag-path ratios.

A page is read once into runs of text, each with the path of open tags from the root. Per path,
the length of its text, its punctuation, the part of it inside links and its number of runs are
summed. Two ratios (text and punctuation per run) are smoothed along the page's blocks, fused,
and a threshold from the page's own spread selects paths; a block is content if its path is.
Marks of an article (its tags, words of a class) raise a path's score and decide nothing alone.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import mapped

#: Tags without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is read to their end tag, or else to the end of the page, and is no text.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: What lies between their tags is no text; where the end tag is missing, what follows is text like any other.
HIDDEN = frozenset("noscript template svg math object canvas".split())
#: Tags inside svg and math whose content is HTML again, so that a block there doesn't end the drawing.
EMBEDS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Their text is never the article's.
APART = frozenset("nav header footer aside form button select option dialog menu label fieldset legend head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words in a class, id or role that mark what surrounds an article.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adv|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|foot|copyright|sidebar\w*|side|widget\w*|related|recommend\w*|"
    r"share|sharing|social|comment\w*|reply|replies|disqus|discussion|respond|pagination|pager|toolbar|contentinfo|navigation|complementary|search|"
    r"tags?|trending|toc|skip)(?=$|[\s_-])",
    re.I,
)
#: Tokens that say what a page has or lacks, not what the element is.
_STATE = re.compile(r"(?<!\S)(?:has|no|non|not|with|without|is|hide|hides|show|shows|enable|disable)[-_]\S*", re.I)
ARTICLE_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.I)
#: How much a path's score rises where all of its text is marked as an article's.
MARKED = 2.0
#: Open tags that a new tag of the same group ends.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_LIST = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PUNCT = re.compile(r"[.,;:!?。，؟،।]")
_SPACE = re.compile(r"\s+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Run:
    """One block of text: its path, its text, how much of it is in links, and how it is marked."""

    __slots__ = ("article", "aside", "heading", "linked", "path", "text")

    def __init__(self, path: int, text: str, linked: int, aside: bool, article: bool, heading: bool):
        self.path, self.text, self.linked, self.aside, self.article, self.heading = path, text, linked, aside, article, heading


def runs(page: str) -> list[Run]:
    """The blocks of a page in order, references decoded and white space made single spaces."""
    out: list[Run] = []
    stack: list[tuple] = [("", False, False, 0, False, "")]  # tag, aside, article, path, in a link, last block tag
    paths: dict[tuple[int, str], int] = {}  # a path is its parent and a tag, so that deep pages take no more room than their tags
    parts: list[str] = []
    linked = 0
    hidden_at: dict[int, tuple] = {}  # place in the stack of an open hidden element: what had been read before it

    def flush():
        nonlocal linked, parts
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                _, aside, article, path, _, block = stack[-1]
                out.append(Run(path, text, linked, aside, article, block in HEADINGS))
            parts = []  # the old list may be wanted at a hidden element's end tag
        linked = 0

    def add(raw: str):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1][4]:
            linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if tag in HIDDEN and m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:  # forget what was read since its start tag
                    n_out, parts, n_parts, linked = hidden_at[k]
                    del out[n_out:], parts[n_parts:], stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body"):
                    break
            continue
        if tag in BLOCK and not m[1]:  # a block ends a drawing that was left open
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in EMBEDS or stack[k][0] in BLOCK:
                    break
                if stack[k][0] in ("svg", "math"):
                    del stack[k:]
                    break
        if tag in BLOCK or tag in APART:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "table", "section", "div", "main", "body") and tag not in BLOCK:
                    break  # an inline end tag doesn't end the blocks around it
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if m[3].rstrip().endswith("/"):
            continue
        if tag in BLOCK:
            ends = CLOSES.get(tag) or ({"p"} if tag not in ("body", "html") else set())
            stop = _LIST.get(tag, set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK or stack[k][0] in HIDDEN:
                    break
        if tag in HIDDEN:
            hidden_at[len(stack)] = len(out), parts, len(parts), linked
            stack.append((tag, *stack[-1][1:]))
            continue
        marks, hidden = "", False
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                key, value = a[1].lower(), (a[2] or "").strip("\"'")
                if key in ("class", "id", "role"):
                    marks += " " + value
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
        marks = _STATE.sub(" ", marks)
        inside = stack[-1][2]
        # a header inside the article is its heading; a word of its class can still set it apart
        apart = tag in APART and not (tag == "header" and inside)
        marked = bool(marks and ASIDE_WORDS.search(marks)) and tag not in ("article", "main", "body", "html")
        article = inside or tag in ("article", "main") or bool(marks and not marked and ARTICLE_WORDS.search(marks))
        _, aside, _, path, link, block = stack[-1]
        if tag in BLOCK:
            path, block = paths.setdefault((path, tag), len(paths) + 1), tag
        stack.append((tag, aside or apart or marked or hidden, article, path, link or tag == "a", block))
    flush()
    return out


def select(blocks: list[Run]) -> list[Run]:
    """The content blocks of a page."""
    open_blocks = [b for b in blocks if not b.aside]
    if not open_blocks:
        return []
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0, 0.0])
    for b in open_blocks:
        s = sums[b.path]
        s[0] += len(b.text)
        s[1] += len(_PUNCT.findall(b.text))
        s[2] += 1
        s[3] += b.linked
        s[4] += len(b.text) * b.article
    length = np.array([sums[b.path][0] / sums[b.path][2] for b in open_blocks])
    marks = np.array([sums[b.path][1] / sums[b.path][2] for b in open_blocks])
    links = np.array([sums[b.path][3] / max(1.0, sums[b.path][0]) for b in open_blocks])
    inside = np.array([sums[b.path][4] / max(1.0, sums[b.path][0]) for b in open_blocks])
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid")
    fused = np.log1p(smooth(length)) * (1 + np.log1p(smooth(marks))) * (1 - links)
    # a path is content unless it lies clearly below the page: half a spread under the mean, and mostly links or bare of marks
    limit = min(fused.mean() - 0.5 * fused.std(), 0.5 * fused.max())
    by_path: dict[int, list[float]] = defaultdict(list)
    for b, f in zip(open_blocks, fused * (1 + MARKED * inside), strict=True):
        by_path[b.path].append(f)
    good = {p for p, f in by_path.items() if np.mean(f) >= limit}
    return [
        b for b in open_blocks
        if b.linked < 0.6 * len(b.text) and (b.path in good or b.heading)
    ]


def main_text(page: str) -> str:
    return " ".join(b.text for b in select(runs(page)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; null or empty html gives empty text.

    Whole pages are read. Unclosed and stray tags are taken as browsers take them, but that a missing
    end tag of ``HIDDEN`` hides nothing; rows that repeat an id stay; other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.transform(mapped, run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page; one row per page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
