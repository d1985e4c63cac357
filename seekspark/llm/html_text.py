"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element. Lines of page furniture (menus,
headers, footers, sidebars, notices, adverts, forms, comments) count as empty and leave a
gap. The text lengths of a sliding window of lines form a curve: it surges from zero where
a run of text begins and dives to zero where it ends. The text between the surge and the
dive of the heaviest run, and of comparable runs, is kept. An article or main element ends
the runs around it; those inside it count together and with more weight.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seekspark.llm import arrays

WINDOW = 3
# Runs are kept that have this share of the heaviest run's weight.
COMPARABLE = 0.25
# Weight of a character in an article or main element.
ARTICLE_WEIGHT = 4
# Lines whose text is mostly inside links are menus, not prose.
LINK_SHARE = 0.6

# Element names of the markup language by role.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select option title".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu head fieldset figcaption".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
PARAGRAPHS = ("p", "blockquote", "pre", "dd")
# Elements that the start of another one closes.
CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
FURNITURE_NAME = regex.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|side-?bar|footer|header|masthead|"
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|comments?|disqus|replies|related|share|social|widget)(?:$|[\s_-])",
    regex.IGNORECASE,
)
FURNITURE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())

TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    regex.DOTALL,
)
ATTRIBUTE = regex.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", regex.IGNORECASE)
SENTENCE_END = regex.compile(r"[.!?…][\"'\p{Pf}\p{Pe}]*(?:\s|\Z)|[。！？؟।]")
SPACES = regex.compile(r"[\s ]+")


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE:
        return not (in_article and name in ("figcaption", "fieldset"))
    if name in ARTICLE or name in ("body", "html") or not attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in FURNITURE_ROLE:
            return True
        if key in ("class", "id") and FURNITURE_NAME.search(value):
            return True
    return False


class _Lines:
    """Lines of one page: text, length inside links, number of the article element around
    the line or 0, and whether the line is a paragraph or holds the end of a sentence."""

    def __init__(self):
        self.text: list[str] = []
        self.linked: list[int] = []
        self.article: list[int] = []
        self.prose: list[bool] = []
        self.parts: list[str] = []
        self.in_links = 0

    def gap(self) -> None:
        """A run of empty lines as wide as the window, so the curve falls to zero."""
        for _ in range(WINDOW):
            self.text.append("")
            self.linked.append(0)
            self.article.append(0)
            self.prose.append(False)

    def end(self, article: int, paragraph: bool) -> None:
        line = SPACES.sub(" ", html.unescape("".join(self.parts))).strip()
        if line:
            self.text.append(line)
            self.linked.append(self.in_links)
            self.article.append(article)
            self.prose.append(paragraph or SENTENCE_END.search(line) is not None)
        self.parts, self.in_links = [], 0


def page_lines(page: str) -> _Lines:
    """Strip the markup of a page; unclosed and misnested elements are closed as browsers do."""
    out, stack, place, size = _Lines(), [], 0, len(page)
    # Depths in the stack where furniture, an article, a link and preformatted text began.
    hidden = article = link = None
    articles = 0
    opened: Counter[str] = Counter()

    def end_line() -> None:
        out.end(0 if article is None else articles, any(opened[x] > 0 for x in PARAGRAPHS))

    def pop_to(depth: int) -> None:
        nonlocal hidden, article, link
        opened.subtract(stack[depth:])
        del stack[depth:]
        if hidden is not None and hidden >= depth:
            hidden = None
            out.gap()
        if article is not None and article >= depth:
            article = None
            out.gap()
        if link is not None and link >= depth:
            link = None

    def text(a: int, b: int) -> None:
        if hidden is None and b > a:
            piece = page[a:b]
            out.parts.append(piece)
            if link is not None:
                out.in_links += len(piece.strip())

    while place < size:
        found = TOKEN.search(page, place)
        if not found:
            text(place, size)
            break
        text(place, found.start())
        place = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if opened[name] <= 0:
                if name in BLOCKS:
                    end_line()
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == name), None)
            # An end tag of an inline element doesn't close the blocks around it.
            if depth is not None and (name in BLOCKS or not any(x in BLOCKS for x in stack[depth + 1 :])):
                if name in BLOCKS:
                    end_line()
                pop_to(depth)
            continue
        if name in RAW:
            end = regex.compile(rf"</{regex.escape(name)}\s*>", regex.IGNORECASE).search(page, place)
            if not found[3].endswith("/"):
                place = end.end() if end else (size if name in ("script", "style") else place)
            continue
        if name == "br":
            if hidden is None:
                out.parts.append(" ")
            continue
        if name in BLOCKS:
            end_line()
            for i in range(len(stack) - 1, -1, -1):
                if name in CLOSED_BY.get(stack[i], ()):
                    pop_to(i)
                    break
                if stack[i] in BLOCKS and stack[i] not in CLOSED_BY:
                    break
        if name in VOID:
            continue
        stack.append(name)
        opened[name] += 1
        depth = len(stack) - 1
        if hidden is None and _is_furniture(name, found[3], article is not None):
            end_line()
            hidden = depth
            out.gap()
        if name in ARTICLE and article is None and hidden is None:
            article, articles = depth, articles + 1
            out.gap()
        if name == "a" and link is None:
            link = depth
    end_line()
    return out


def main_text(page: str | None) -> str:
    """Text between the surge and dive points of the page's line blocks."""
    if not page:
        return ""
    lines = page_lines(page)
    length = np.array([len(t) for t in lines.text], np.int64)
    if not length.sum():
        return ""
    article, prose = np.array(lines.article), np.array(lines.prose)
    linked = np.array(lines.linked)
    menu = (linked >= LINK_SHARE * np.maximum(length, 1)) & (article == 0)
    if (length * ~menu).sum():
        length = length * ~menu
    # Beside an article element, labels outside it neither begin a text nor outweigh it.
    factor = np.where(article > 0, ARTICLE_WEIGHT, prose if (length * (article > 0)).sum() else 1)
    # Blocks of WINDOW lines, padded so that the curve starts and ends at zero.
    total = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(WINDOW, int), length, np.zeros(WINDOW, int)]))])
    block = total[WINDOW:] - total[:-WINDOW]
    surge = np.flatnonzero((block[1:] > 0) & (block[:-1] == 0)) + 1
    dive = np.flatnonzero((block[1:] == 0) & (block[:-1] > 0)) + 1
    runs = [(max(a - 1, 0), min(b - 1, len(length))) for a, b in zip(surge, dive)]
    # Runs of one article element weigh together; each other run is alone.
    part = [int(article[a:b].max()) or -1 - i for i, (a, b) in enumerate(runs)]
    weight: Counter[int] = Counter()
    heavy = length * factor
    for k, (a, b) in zip(part, runs):
        weight[k] += int(heavy[a:b].sum())
    least = max(1, COMPARABLE * max(weight.values()))
    return "\n".join(
        lines.text[i] for k, (a, b) in zip(part, runs) if weight[k] >= least for i in range(a, b) if length[i]
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Null or empty html and pages without text give an empty text with n_chars 0. Broken
    markup never fails: unclosed tags end with the page. Pages of any length are read
    whole; repeated rows are extracted each; equally heavy runs are all kept, in page
    order. Null page_id or url pass through, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "html"):
            texts = [main_text(page) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
