"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words.  A word scores a little above zero and a tag below it; the weights are
log-odds of standing inside the content, counted over labelled pages: pages whose content is marked by an
``article`` or ``main`` element or role.  One linear scan finds the contiguous region with the highest sum.
Elements that are never content (navigation, forms, scripts, comment sections and the like) score low and are
left out of the region's text.

A quote opens a value after an equals sign only; a value that isn't closed in the page ends with its tag.

Defined results: a null page is an empty one; a page without a word of content has the text ""; pages that end
early are read as far as they go; pages are read whole, however long; of equally good regions the first counts; repeated
rows are pages of their own; an empty table gives no rows; other columns, whatever their names, are neither read nor
returned; without a page with marked content the weights are those of WORD_WEIGHT and TAG_MOST.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

# Element names of HTML by role, and words that mark elements which aren't the article.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button title".split())
RAW = frozenset(("script", "style"))
NEVER = frozenset("nav footer aside form menu dialog head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
MARKED = re.compile(r"(?:^|\s)(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?=$|\s)", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Labelled pages that weights are fitted on, at most.
SAMPLE_PAGES = 400
#: Weights before any page has been seen; those of tags are bounded by these as well.
WORD_WEIGHT, TAG_MOST, TAG_LEAST, BARRED = 0.25, -0.05, -12.0, -1e4


def tokens(page: str):
    """(kind, value, attributes): kind is 'text', 'open' or 'close'; hidden elements are skipped whole."""
    at, n = 0, len(page)
    unclosed: set[str] = set()  # a name without an end from here on has none later
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if not found[1] and name in HIDDEN:
            # self-closed or without an end in the page, it is empty; a script goes on to the end of the page
            if name in RAW or not (found[3] or "").endswith("/") and name not in unclosed:
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                if end or name in RAW:
                    at = end.end() if end else n
                else:
                    unclosed.add(name)
            continue
        yield ("close" if found[1] else "open"), name, found[3] or ""


def _barred(name: str, attributes: str) -> bool:
    if name in NEVER:
        return True
    if name in ("html", "body") or _main(name, attributes):
        return False
    return any(MARKED.search(v) or m[1].lower() == "role" and v.lower() in ("navigation", "banner", "complementary", "contentinfo", "search", "form") for m in ATTRIBUTE.finditer(attributes) for v in [m[2] or m[3] or m[4] or ""])


def _main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in ("main", "article") for m in ATTRIBUTE.finditer(attributes))


def _holding(items: list[tuple[str, str, str]]) -> set[int]:
    """Places of the open tags around marked content, and of its own."""
    stack: list[tuple[str, int]] = []
    found: set[int] = set()
    for i, (kind, value, attributes) in enumerate(items):
        if kind == "open" and value not in VOID:
            stack.append((value, i))
            # what stands in an element that is never content by its name isn't the content
            if _main(value, attributes) and not any(name in NEVER for name, _ in stack):
                found.update(k for _, k in stack)
        elif kind == "close":
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == value), None)
            if depth is not None:
                del stack[depth:]
    return found


def walk(page: str):
    """(kind, value, barred, content) in page order.

    barred: inside an element that is never content; one that holds marked content isn't barred.  A header is one only outside of the content.
    """
    stack: list[tuple[str, bool, bool]] = []
    items = list(tokens(page))
    holding = _holding(items)
    for i, (kind, value, attributes) in enumerate(items):
        barred, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if kind == "text":
            yield kind, value, barred, content
        elif kind == "open":
            inside = content or _main(value, attributes)
            out = barred or i not in holding and (_barred(value, attributes) or value == "header" and not content)
            yield kind, value, out, content
            if value not in VOID:
                stack.append((value, out, inside))
        else:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == value), None)
            if depth is not None:
                outer = stack[depth]
                del stack[depth:]
                barred = outer[1]
                content = stack[-1][2] if stack else False
            yield kind, value, barred, content


def count_labels(page: str) -> Counter:
    """(feature, inside) counts of a page with marked content; nothing for other pages."""
    found: Counter = Counter()
    marked = False
    for kind, value, barred, content in walk(page):
        marked |= content
        if kind == "text":
            found["#word", content and not barred] += len(entities.unescape(value).split())
        elif not barred:
            found[f"{'/' if kind == 'close' else ''}{value}", content] += 1
    return found if marked else Counter()


def weights_of(counts: Counter) -> dict[str, float]:
    """Log-odds of standing inside; words above zero, tags below."""
    odds = lambda f: math.log((counts[f, True] + 0.5) / (counts[f, False] + 0.5))
    out = {f: min(TAG_MOST, max(TAG_LEAST, odds(f))) for f in {f for f, _ in counts} if f != "#word"}
    out["#word"] = min(1.0, max(WORD_WEIGHT, odds("#word"))) if counts else WORD_WEIGHT
    return out


def scores(items: list[tuple[str, str, bool, bool]], weights: dict[str, float]) -> list[float]:
    """Of each item; what is barred is left out of the text, so it neither makes nor breaks a region."""
    word = weights["#word"]
    return [0.0 if barred else word * len(entities.unescape(value).split()) if kind == "text" else weights.get(f"{'/' if kind == 'close' else ''}{value}", TAG_MOST) for kind, value, barred, _ in items]


def best_region(values: list[float]) -> tuple[int, int]:
    """The bounds of the contiguous region with the highest positive sum, by one scan; (0, 0) without one."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region: one line a block."""
    items = list(walk(page or ""))
    best_span = best_region(scores(items, weights))
    lines: list[str] = []
    current: list[str] = []
    joined = True  # whether the next text goes on in the word that the last one ended in
    for i in range(*best_span):
        kind, value, barred, _ = items[i]
        if barred:
            continue
        if kind == "text":
            current.append(entities.unescape(value))
        elif value in BLOCKS:
            lines.append(" ".join("".join(current).split()))
            current = []
    lines.append(" ".join("".join(current).split()))
    return "\n".join(line for line in lines if line)


def fit_weights(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` pages, chosen by a hash of their ids; only pages with marked content count."""
    sample = pages.select(F.xxhash64(key).alias("k"), F.col(html).alias("html")).filter("html IS NOT NULL").orderBy("k", "html").limit(most)

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(1).to_pylist():
                counts.update(count_labels(page))
            rows = [(f, inside, n) for (f, inside), n in counts.items()]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64()))], ["feature", "inside", "n"])

    counted = in_arrow(sample, run, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return weights_of(Counter({(r.feature, r.inside): r.n for r in counted.collect()}))  # a few rows a tag name


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_arrow(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
