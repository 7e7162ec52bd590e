"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks of text, each with the path of block elements from the root down to it. Paths, and not
single blocks, are judged: for each path, the text outside links and the punctuation of all its blocks are added up and
divided by the number of blocks, and the two ratios are multiplied. The scores are smoothed along the page,
since content lies together, and the paths above a share of the best score are content. A content path then takes in
the rest of its container (headings, short paragraphs).

What can never be content is left out before: elements such as nav or footer, and those of such roles. Forms, and elements whose
class or id says that they are adverts, notices, sidebars or reader comments, are left out unless the page's text lies in them.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_of
from quarry.llm.memory import release_worker_state

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>?",
    re.S,
)
# Without regard to quotes. A tag whose quotes do not close is looked for up to the end of the page, so only so often.
_LOOSE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|(?!)(?P<close>)(?P<name>)(?P<rest>)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>?",
    re.S,
)
UNCLOSED = 64
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ARTICLE = re.compile(r"<article(?=[\s/>])", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟،।]")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
    summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS_AND_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dd dt td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_ONLY = HEADINGS_AND_TEXT | frozenset("caption dl figure header hgroup ol table tbody tfoot thead tr ul".split())
# A start tag on the left ends an open element on the right.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "body": {"head"},
}
NEVER_CONTENT = frozenset(
    """aside audio button canvas datalist dialog footer head header input label map menu nav object optgroup option
    search select svg video""".split()
) | RAW
SAYS_BOILERPLATE = frozenset(
    """ad ads adsense advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs byline
    comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead
    menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted
    promotion reactions recommended related replies reply respond share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription teaser toolbar topbar widget widgets""".split()
)
ROLES = frozenset(
    """alert alertdialog banner complementary contentinfo dialog menu menubar navigation search status toolbar""".split()
)
ONLY_SAYS_LAYOUT = frozenset("has with without no".split())
# Share of the best score that makes a path content, and what lying in article or main adds to a score: it decides only between
# texts of a few words. It is divided by the number of articles, since many of them are teasers.
THRESHOLD, LANDMARK = 0.35, 200.0
# Share of the text of a page that an element in doubt has to hold to stay.
MOST = 0.5
KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int
    # Elements around it that are boilerplate by their words, and whether it lies in a heading of the page, an article or main.
    doubts: tuple[str, ...] = ()
    has_h1: bool = False
    has_landmark: bool = False


def _is_boilerplate(name: str, rest: str, inside_article: bool) -> bool:
    if name in NEVER_CONTENT:
        return not (name == "header" and inside_article)
    if not rest or name in ("html", "body", "main"):
        return False
    attributes = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in _ATTRIBUTE.findall(rest)}
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if attributes.get("role") in ROLES:
        return True
    return False


def _in_doubt(name: str, rest: str) -> bool:
    """Whether an element says that it is boilerplate, which its text may disprove."""
    if name == "form":
        return True
    if not rest or name in ("html", "body", "main"):
        return False
    attributes = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in _ATTRIBUTE.findall(rest)}
    if attributes.get("role") == "form":
        return True
    words = set(re.split(r"[^a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}"))
    return bool(words & SAYS_BOILERPLATE) and not words & ONLY_SAYS_LAYOUT


def _label(name: str, rest: str) -> str:
    found = re.search(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", rest) if rest else None
    classes = (found[1] or found[2] or found[3] or "").split() if found else []
    return ".".join([name, *sorted(classes)])


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that may be content, in order, those in doubt included. White space is one space, references are decoded."""
    found: list[Block] = []
    # Open elements: name, label of the path or None, whether it and all in it are left out, whether it is in an
    # article, its label if it is in doubt.
    stack: list[tuple[str, str | None, bool, bool, str | None]] = []
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple(label for _, label, *_ in stack if label)
                names = {name for name, *_ in stack}
                doubts = tuple(entry[4] for entry in stack if entry[4])
                found.append(Block(path, text, links, doubts, "h1" in names, bool(names & {"article", "main"})))
            parts.clear()
        links = 0

    def close_to(depth: int) -> None:
        if any(name in BLOCK for name, *_ in stack[depth:]):
            flush()
        del stack[depth:]

    def put(text: str) -> None:
        nonlocal links
        if text and not (stack and stack[-1][2]):
            parts.append(text)
            if any(name == "a" for name, *_ in stack):
                links += len(text.strip())

    at, unclosed = 0, 0
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            put(page[at:])
            break
        put(page[at:mark])
        tag = (_MARKUP if unclosed < UNCLOSED else _LOOSE).match(page, mark)
        if tag is None:
            put("<")
            at = mark + 1
            continue
        at = tag.end()
        unclosed += tag["name2"] is not None
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        rest = tag["rest"] or tag["rest2"] or ""
        if tag["close"] or tag["close2"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close_to(depth)
                    break
                # An inline end tag does not reach out of its block.
                if name not in BLOCK and stack[depth][0] in BLOCK:
                    break
            else:
                if name in BLOCK:
                    flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                put(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            flush()
            open_names = [entry[0] for entry in stack]
            if "p" in open_names:
                close_to(len(open_names) - 1 - open_names[::-1].index("p"))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ENDS.get(name, ()):
                    close_to(depth)
                elif stack[depth][0] in ("ul", "ol", "dl", "table", "select", "html"):
                    break
        above = stack[-1] if stack else ("", None, False, False, None)
        left_out = above[2] or _is_boilerplate(name, rest, above[3])
        label = _label(name, rest) if name in BLOCK else None
        doubt = _label(name, rest) if not left_out and _in_doubt(name, rest) else None
        if left_out and not above[2] or doubt:
            flush()
        if not rest.endswith("/") or name in BLOCK:
            stack.append((name, label, left_out, above[3] or name == "article", doubt))
    flush()
    return found


def _tag(label: str) -> str:
    return label.split(".", 1)[0]


def without_boilerplate(blocks: list[Block]) -> list[Block]:
    """Leaves out the elements in doubt, but for those that hold the page's heading, its only article or most of its text.

    Elements with the same tag and classes are judged together.
    """
    def size(of: list[Block]) -> int:
        return sum(max(0, len(block.text) - block.link_chars) for block in of)

    anchored = any((block.has_h1 or block.has_landmark) and not block.doubts for block in blocks)
    dropped = set()
    for label in {label for block in blocks for label in block.doubts}:
        inside = [block for block in blocks if label in block.doubts]
        if any(block.has_h1 for block in inside):
            continue
        if anchored or not any(b.has_landmark for b in inside) and size(inside) < MOST * size(blocks):
            dropped.add(label)
    return [block for block in blocks if not dropped.intersection(block.doubts)]


def path_scores(blocks: list[Block], articles: int = 1) -> dict[tuple[str, ...], float]:
    """Text ratio times punctuation ratio of each path, smoothed along the page."""
    length: dict[tuple, int] = defaultdict(int)
    marks: dict[tuple, int] = defaultdict(int)
    count: dict[tuple, int] = defaultdict(int)
    for block in blocks:
        length[block.path] += max(0, len(block.text) - block.link_chars)
        marks[block.path] += len(_PUNCTUATION.findall(block.text))
        count[block.path] += 1
    fused = {}
    for path, n in count.items():
        fused[path] = (length[path] / n) * (1.0 + marks[path] / n)
    along = np.array([fused[block.path] for block in blocks])
    smooth = np.convolve(along, KERNEL)[2:-2] / np.convolve(np.ones(len(along)), KERNEL)[2:-2]
    scores: dict[tuple, float] = defaultdict(float)
    for block, near in zip(blocks, smooth):
        scores[block.path] += (fused[block.path] + near) / 2 / count[block.path]
    for path in scores:
        if any(_tag(label) in ("article", "main") for label in path):
            scores[path] += LANDMARK / max(1, articles)
    return dict(scores)


def main_blocks(page: str) -> list[str]:
    blocks = without_boilerplate(blocks_of(page))
    if not blocks:
        return []
    scores = path_scores(blocks, len(_ARTICLE.findall(page)))
    best = max(scores.values())
    chosen = {path for path, score in scores.items() if score >= THRESHOLD * best}

    def around(path: tuple[str, ...]) -> set[tuple[str, ...]]:
        """The element that holds the path, and the innermost article or main."""
        found = [depth for depth, label in enumerate(path) if _tag(label) in ("article", "main")]
        return {path[:-1], *(path[: depth + 1] for depth in found[-1:])}

    containers = {c for path in chosen for c in around(path)}

    def taken_in(block: Block) -> bool:
        if block.path in chosen:
            return True
        if block.link_chars > len(block.text) / 2:
            return False
        for c in containers:
            if block.path[: len(c)] == c:
                kind = _tag(c[-1]) if c else "body"
                if kind not in ("html", "body", "article", "main"):
                    return True
                # In an article or main, what lies in a further container has to reach the threshold itself.
                below = {_tag(label) for label in block.path[len(c) :]}
                if kind in ("article", "main") and (below <= TEXT_ONLY or kind == "article" and below & HEADINGS):
                    return True
                if block.path == c or len(block.path) == len(c) + 1 and _tag(block.path[-1]) in HEADINGS_AND_TEXT:
                    return True
        return False

    return [block.text for block in blocks if taken_in(block)]


def main_text(page: str) -> str:
    return "\n\n".join(main_blocks(page))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    ``text`` is the blocks of content in page order, two line feeds between. Null, empty and textless pages give an empty
    text. Nothing of a content block is cut off. Repeated rows are extracted each for itself; nothing is shuffled.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_state()
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        text_of(content).alias("html"),
    )
    found = rows.mapInArrow(extract, "page_id long, url string, text string")
    return found.select(
        F.col("page_id").alias(page_id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars")
    )
