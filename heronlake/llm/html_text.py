"""Main text of web pages by line-block distribution.

A page's markup is stripped to lines, one for each block of it. Lines get a length; those of parts that hold no
article (menus, site headers, footers, sidebars, notices, adverts, forms, comments, hidden parts, told by element,
class, id or role) are taken out, and what stands before and behind them is neighbouring text. Lengths are summed over
windows of ``WINDOW`` lines. Text starts where the sum first surges to ``SURGE``, with the short lines right before it, and
ends where it dives to nothing for the last time behind a surge; all lines between stay, short and linked ones
included. Words of links don't count for the sums, unless they stand in the part that a page marks as its article or main
part; on such a page only words of that part count, and lines of other parts are not kept. A page on which nothing
surges is kept whole, as far as its lines count. Tags are read in one pass, in time in proportion to the page.

Defined cases: null or empty html, and pages without text, give an empty text; unclosed, crossed and unknown tags
are put up with, as are texts of any length; repeated rows are extracted one by one; null ids and urls are carried;
extra columns don't take part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
SURGE = 80

#: Elements without a closing tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that stand inside a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that hold no article.
DROPPED = frozenset("head nav footer aside form button select option menu dialog svg math object audio video canvas map fieldset datalist".split())
#: Words of a class, id or role that mark such parts, anywhere.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|comments?|commentlist|disqus|reply|replies|respond|share|sharing|social"
    r"|related|recommended|recommendations|widget|pagination|pager|complementary|contentinfo|hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
#: Those that do so outside an article only: an article may have notices and be about a search.
_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:banner|notices?|alerts?|search|rail|skip)(?:$|[\s_-])", re.I)
#: What a layout has or lacks, rather than what the part is.
_LAYOUT = re.compile(r"\b(?:has|with|no|without|full|is)[-_][\w-]+", re.I)
_NO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|replies|related|recommended|teaser)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:$|[\s_-])", re.I)
_ATTRS = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A tag ends at a ">" outside quotes, or, where quotes don't match, at the first one; none reaches past a "<" outside
#: quotes, and nothing is tried twice.
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""", re.S
)
_CLOSERS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _drops(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header":
        return not in_article
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, value in _ATTRS.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            value = _LAYOUT.sub(" ", value)
            marks = _NO_ARTICLE if name == "article" else _MARKS
            if marks.search(value) or (not in_article and (_HEADER.search(value) or _OUTSIDE.search(value))):
                return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters of links, dropped, marked as article) for each line of a page; lines of dropped parts are empty."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, in article
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close_line(dropped: bool, marked: bool) -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, linked, dropped, marked))
            parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        dropped, _ = state()
        if not dropped:
            parts.append(text)
            if any(s[0] == "a" for s in stack[-4:]):
                linked += len(text)

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        dropped, marked = state()
        if name not in INLINE:
            close_line(dropped, marked)
        elif name == "br":
            parts.append(" ")
        if closing:
            if opened[name]:
                was = dropped
                while (last := stack.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
                if was and not state()[0]:
                    out.append(("", 0, True, False))
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = _CLOSERS[name].search(html, at)
            at = end.end() if end else size
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and any(s[0] == name for s in stack[-3:]):
            while stack[-1][0] in INLINE:
                opened[stack.pop()[0]] -= 1
            if stack and stack[-1][0] == name:
                opened[stack.pop()[0]] -= 1
            dropped, marked = state()
        if attrs.rstrip().endswith("/") and name not in ("p", "div", "article", "section", "main"):
            continue
        here = marked or name in ("article", "main")
        stack.append((name, dropped or _drops(name, attrs, here), here))
        opened[name] += 1
    close_line(*state())
    return out


def span(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """Half-open range of lines from the first surge of the window sums to the last dive; all lines if nothing surges."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    surges = [i for i in range(n) if sums[i] >= surge and lengths[i]]
    if not surges:
        return 0, n
    start, end = surges[0], surges[-1]
    while start and lengths[start - 1]:
        start -= 1  # a surge seen late: the short lines right before it belong to it
    while end < n and sums[end]:
        end += 1
    return start, end


def main_text(html: str | None) -> str:
    lines = [x for x in lines_of(html or "") if x[0] and not x[2]]
    has_article = any(marked for *_, marked in lines)
    lengths = [len(text) * marked if has_article else max(0, len(text) - linked) for text, linked, _, marked in lines]
    start, end = span(lengths)
    return "\n".join(text for text, _, _, marked in lines[start:end] if marked or not has_article)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars (code points)."""
    d = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([d.schema["page_id"], d.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names
                )

    return d.mapInArrow(run, schema)
