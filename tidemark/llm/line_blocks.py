"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines: one for each block-level element's run of text, in page order, character references decoded and white space
made one space (a line break inside a block is white space). Scripts, styles, forms, menus, headers, footers, asides, and elements whose
class, id or role name adverts, notices, side bars or reader comments become lines of length zero, as do lines that are mostly links.
The lengths are summed over windows of `WINDOW` lines. Lines of menus, headers, footers, side bars and comment sections, and `WINDOW` or more
lines of links on end, are boundaries and cut the page into sections. A surge is a window of at least `SURGE` characters (one character
where the page marks an article or main element, and never more than the page's fullest window). All lines that count between the first
and the last section with a surge are kept, however short, and joined by line ends: also titles and bylines before the surge, and what
follows adverts after it.

What only its class, id or role name or its being a form or header makes noise stays noise while the page has a text without it. If no window
of the rest reaches a surge, such an element (no comment section) with the fullest window of at least `HELD` characters is read as well; so is
a form with the fullest window of the page. Parts of names that tell of the layout (with-, has-, no-) do not count, and an article's first
h1 ends the skipping around it.

Null or empty html has an empty text. Unclosed elements end where the element around them ends; an article that opens inside a skipped
element that is no comment section ends the skipping. A head needs no end: only its title, scripts and styles are passed over, as such elements are
anywhere, without parting words. Fallback text of objects and the text of formulas stay. Repeated rows are extracted as often as they stand. Columns of any name are kept,
except that a `text` or `n_chars` of the table itself gives way to the result's.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, own_names

WINDOW, SURGE = 3, 80
#: Characters of a window from which a named element may hold the text of a page that has none elsewhere.
HELD = 240
#: Share of a line's characters inside links from which it counts as a menu, outside articles.
LINKS = 0.6
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-z!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements of the HTML standard by their role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Elements without text of their own that part no words.
INLINE = frozenset("script style noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HINT = re.compile(
    r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))",
    re.I,
)
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adbox|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|sidebar|side-bar|widget"
    r"|nav|navigation|navbar|menu|breadcrumbs?|pagination|pager|share|sharing|social|related|recommend(?:ed|ations?)?|comments?|respond|disqus|replies|footer|masthead|copyright|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
#: Names of elements that end a text, unlike adverts and notices, which may stand within it.
EDGES = re.compile(
    r"(?:^|[\s_-])(?:sidebar|side-bar|nav|navigation|navbar|menu|breadcrumbs?|pagination|pager|comments?|respond|disqus|replies|footer|masthead|copyright|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
EDGE_TAGS = frozenset("nav header footer menu".split())
TALK = re.compile(r"comment|respond|disqus|repl|review|related|recommend", re.I)
#: Never read, whatever they hold: elements by tag, and comment sections by name.
HARD_TAGS = frozenset("nav footer aside menu dialog button".split())
HARD = re.compile(r"comment|respond|disqus|replies", re.I)
#: Elements that end where the next block begins (p) or the next of their kind.
IMPLIED = frozenset("p li dt dd tr td th option".split())
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:with|has|no)-\S+", re.I)


def _hints(attrs: str) -> str:
    return LAYOUT.sub("", " ".join(a or b or c for a, b, c in HINT.findall(attrs))) if "=" in attrs else ""


#: States of a line: it counts, it is noise, it is mostly links, it is a boundary.
COUNTS, NOISE, LINKED, EDGE = 1, 0, -1, -2


def lines(page: str, read: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int]], list[int | None], bool]:
    """The lines (text, state) in page order, for each line the place of the skipped element that might be read, and whether the page marks its article.

    read: places of elements that are not skipped.
    """
    out: list[tuple[str, int]] = []
    inside: list[int | None] = []
    text: list[str] = []
    linked = total = 0
    stack: list[str] = []  # open blocks; while skipping, the skipped element is at `skip`
    skip, talk, edge, soft = -1, False, False, None
    scope, marked, in_link, titled = 0, False, 0, False

    def end_line() -> None:
        nonlocal text, linked, total
        line = " ".join("".join(text).split())
        if line:
            if skip >= 0:
                state = EDGE if edge else NOISE
            elif marked:
                state = COUNTS if scope else NOISE
            else:
                state = COUNTS if scope or linked < LINKS * total else LINKED
            out.append((line, state))
            inside.append(soft if skip >= 0 else None)
        elif text:
            out.append(("", NOISE))
            inside.append(None)
        text, linked, total = [], 0, 0

    def put(raw: str) -> None:
        nonlocal linked, total
        if raw:
            piece = entities.unescape(raw)
            text.append(piece)
            n = len(piece.strip())
            total += n
            linked += n if in_link else 0

    def close(at: int) -> None:
        nonlocal skip
        del stack[at:]
        if at <= skip:
            skip = -1

    at = 0
    for m in TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                if m["raw"].lower() not in INLINE:
                    end_line()
            continue
        closing = bool(m["close"])
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
        block = tag in BLOCKS
        if block:
            end_line()
        opens = not closing and tag not in VOID and not m["attrs"].rstrip().endswith("/")
        if closing:
            if tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
        elif block and stack and (stack[-1] == "p" or stack[-1] == tag in IMPLIED):
            close(len(stack) - 1)
        if skip >= 0:
            if opens and ((tag in ("article", "main") and not talk) or (tag == "h1" and scope and soft is not None and not talk and not titled)):
                skip = -1
        elif opens and m.start() not in read:
            hints = _hints(m["attrs"])
            named = bool(hints) and tag not in ("html", "body", "article", "main") and bool(NAMES.search(hints))
            talking = bool(hints) and tag == "article" and bool(TALK.search(hints))
            if (tag in SKIPPED and not (scope and tag == "header" and not named)) or named or talking:
                if not block:
                    text.append(" ")
                skip, talk, edge = len(stack), bool(TALK.search(hints)), tag in EDGE_TAGS or bool(EDGES.search(hints))
                soft = None if tag in HARD_TAGS or talking or HARD.search(hints) else m.start()
        if opens and (block or skip == len(stack) or (skip >= 0 and tag == stack[skip])):
            stack.append(tag)
        if tag == "h1" and scope and skip < 0:
            titled = True
        if skip < 0 and tag in ("article", "main"):
            if not closing and not marked:
                out[:] = [(t, NOISE) for t, _ in out]  # what stands before the article is not part of it
                marked = True
            scope = max(0, scope + (-1 if closing else 1))
    put(page[at:])
    end_line()
    return out, inside, marked


def fullest_window(lengths: list[int], window: int = WINDOW) -> int:
    return max((sum(lengths[i : i + window]) for i in range(len(lengths))), default=0)


def to_read(found: list[tuple[str, int]], inside: list[int | None], page: str, marked: bool, surge: int) -> int | None:
    """The place of a skipped element that should be read all the same, if any."""
    fullest = fullest_window([len(t) if state == COUNTS else 0 for t, state in found])
    held: dict[int, list[int]] = {}
    for (t, _), k in zip(found, inside):
        if k is not None:
            held.setdefault(k, []).append(len(t))
    if not held or (marked and fullest):
        return None
    most, where = max((fullest_window(n), -k) for k, n in held.items())
    form = page[-where : 5 - where].lower() == "<form"
    return -where if (form and most >= max(fullest, surge)) or (fullest < surge and most >= HELD) else None


def sections(found: list[tuple[str, int]], window: int = WINDOW) -> list[list[tuple[str, int]]]:
    """Runs of lines between boundaries; lines of links are one where `window` or more follow each other."""
    out: list[list[tuple[str, int]]] = [[]]
    i = 0
    while i < len(found):
        j = i
        while j < len(found) and found[j][1] == LINKED:
            j += 1
        if found[i][1] == EDGE or j - i >= window:
            out.append([])
            i = max(j, i + 1)
        else:
            out[-1].append(found[i])
            i += 1
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    page, read = page or "", frozenset()
    found, inside, marked = lines(page)
    while (k := to_read(found, inside, page, marked, surge)) is not None:
        read |= {k}
        found, inside, marked = lines(page, read)
    parts = found and ([found] if marked else sections(found, window))
    fullest = [fullest_window([len(t) if state == COUNTS else 0 for t, state in part], window) for part in parts]
    least = min(max(fullest, default=0), 1 if marked else surge)
    surges = [k for k, n in enumerate(fullest) if least and n >= least]
    if not surges:
        return ""
    return "\n".join(t for part in parts[surges[0] : surges[-1] + 1] for t, state in part if state == COUNTS)


@own_names
def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows of pages (without the html) with text and n_chars, its code points."""
    kept = [f for f in pages.schema.fields if f.name.lower() not in (html_col.lower(), "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("__html").to_pylist()]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return map_batches(pages.select(*[f.name for f in kept], F.col(html_col).alias("__html")), run, schema)
