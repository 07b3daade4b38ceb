"""Main text of web pages: roles of elements, then differencing with the nearest URL's page.

A page's html gives its lines: the text of its block elements, in order. Elements that
never hold the main text (menus, asides, footers, forms, scripts, ...) are left out, by
element, by role, and by words of their class or id. If a page has article elements, the
lines in them are its lines; else those of its main element; else all.

What a site repeats without marking it is found by differencing: the pages of a host are
sorted by the path of their URL, a page is paired with the page before or after it,
whichever shares the longer beginning of the path (the one before, if equal), the lines
of both are aligned by longest common subsequence, and shared lines are deleted. Lines in
an article element stay, as two articles of a site may well have a line in common; so do
the lines of pages that share most of their text, which are copies of one article
rather than two articles in one frame.

Pages are range-partitioned by (host, path), in ranges of about ``PAGES_PER_RANGE`` pages,
so a host with a third of all pages is many tasks, html is shuffled once, and a task walks
through its range with three pages at a time. The first and the last page of a range are
compared with their neighbour inside it.

A null or empty html gives an empty text. A null url has an empty host and path; pages of
the empty host are not paired. Rows that repeat a page_id are pages of their own. An
empty table gives an empty result. In very long pages common beginnings and ends are taken
off first, and only lines that both pages have are aligned.
"""

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Elements without main text, elements that begin a new line, elements without an end tag.
SKIPPED = frozenset("script style noscript template head title nav header footer aside form button select option "
                    "textarea iframe object svg canvas dialog menu audio video".split())
BLOCKS = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 "
                   "h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title noscript template iframe".split())
#: Words of a class, id or role that mark what is not the main text.
MARKS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent "
                  "footer login masthead menu modal nav navbar navigation newsletter notice pagination popup promo "
                  "promoted replies share sharing sidebar signup sponsor sponsored subscribe toolbar widget "
                  "contentinfo search complementary alert disqus".split())
#: Whole names of page headers; a section-header inside an article is none.
HEADERS = frozenset("header site-header page-header top-header global-header main-header".split())
#: An element of these names is never left out for its class.
OWN_PARTS = frozenset({"article", "main"})

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
                 re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[a-z0-9]+")
SPACE = re.compile(r"\s+")
URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")

COPY_SHARE = 0.5
TABLE_CELLS = 4_000_000
PAGES_PER_RANGE = 2000
TEXTS = "page_id bigint, url string, text string, n_chars bigint"


def host_and_path(url):
    """Lower-cased host and path of a URL; empty if it has none."""
    found = URL.match(url or "")
    return (found[1].lower(), found[2] or "/") if found else ("", "")


def _unwanted(name, attributes):
    if name in SKIPPED:
        return True
    for key, *values in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and "true" in values:
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", *OWN_PARTS):
            for value in values:
                words = WORDS.findall(value.lower())
                if not MARKS.isdisjoint(words) or not HEADERS.isdisjoint(value.lower().replace("_", "-").split()):
                    return True
        if key == "style" and "display:none" in "".join(values).replace(" ", "").lower():
            return True
    return False


def page_lines(source):
    """The lines of a page's main part, and whether they lie in article elements.

    White space is one space, character references are decoded. A left-out element that
    is never closed ends where an article or main element begins.
    """
    lines, current = [], []
    inside = {"article": 0, "main": 0}
    stack, skipping = [], 0
    last_ends = {}

    def is_open(name, place):
        """No end tag of the name comes after the place."""
        if name not in last_ends:
            last_ends[name] = max((m.start() for m in re.finditer(f"</{re.escape(name)}\\b", source, re.I)), default=-1)
        return last_ends[name] < place

    def end_line():
        if current:
            text = SPACE.sub(" ", entities.unescape("".join(current))).strip()
            if text:
                lines.append((text, inside["article"] > 0, inside["main"] > 0))
            current.clear()

    place, size = 0, len(source)
    while place < size:
        tag = TAG.search(source, place)
        if tag is None:
            if not skipping:
                current.append(source[place:])
            break
        if not skipping and tag.start() > place:
            current.append(source[place:tag.start()])
        place = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in SKIPPED:
            end_line()
        if tag[1]:
            if any(open_ == name for open_, _, _ in stack):
                while stack:
                    open_, skipped, own = stack.pop()
                    skipping -= skipped
                    if own:
                        inside[open_] -= 1
                    if open_ == name:
                        break
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        unwanted = _unwanted(name, tag[3])
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(source, place)
            if not unwanted:
                current.append(source[place:end.start() if end else size])
            place = end.end() if end else size
            continue
        own = name in inside
        if own:
            if skipping:
                for i, (open_, skipped, kind) in enumerate(stack):
                    if skipped and is_open(open_, place):
                        skipping -= 1
                        stack[i] = (open_, False, kind)
            inside[name] += 1
        stack.append((name, unwanted, own))
        skipping += unwanted
    end_line()
    for part in (1, 2):
        if any(line[part] for line in lines):
            return [line[0] for line in lines if line[part]], part == 1
    return [line[0] for line in lines], False


def shared_lines(a, b):
    """Numbers of the lines of ``a`` in a longest common subsequence with ``b``."""
    numbers = {}
    x = [numbers.setdefault(line, len(numbers)) for line in a]
    y = [numbers.get(line, -1) for line in b]
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    high = 0
    while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
        high += 1
    found = [*range(low), *range(len(x) - high, len(x))]
    # only lines that the other page has as well can be matched
    there = set(y[low:len(y) - high])
    rows = [i for i in range(low, len(x) - high) if x[i] in there]
    known = set(x[i] for i in rows)
    columns = np.array([v for v in y[low:len(y) - high] if v in known], np.int64)
    found += [rows[i] for i in _common_rows(np.array([x[i] for i in rows], np.int64), columns)]
    return sorted(found)


def _lengths(x, y):
    """Lengths of the longest common subsequences of x with the first 0, 1, ... of y."""
    lengths = np.zeros(len(y) + 1, np.int32)
    for value in x:
        lengths[1:] = np.maximum.accumulate(np.maximum(lengths[1:], lengths[:-1] + (y == value)))
    return lengths


def _common_rows(x, y, cells=TABLE_CELLS):
    """Positions in x of a longest common subsequence with y, in a table of at most ``cells`` numbers.

    A larger table is halved: the lengths from both ends say where in y the halves of x meet.
    """
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and (len(x) + 1) * (len(y) + 1) > cells:
        middle = len(x) // 2
        ahead, behind = _lengths(x[:middle], y), _lengths(x[:middle - 1:-1], y[::-1])
        cut = int(np.argmax(ahead + behind[::-1]))
        return _common_rows(x[:middle], y[:cut], cells) + [
            middle + i for i in _common_rows(x[middle:], y[cut:], cells)]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, value in enumerate(x, 1):
        table[i, 1:] = np.maximum.accumulate(np.maximum(table[i - 1, 1:], table[i - 1, :-1] + (y == value)))
    found, i, j = [], len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            found.append(i - 1)
            i, j = i - 1, j - 1
    return found[::-1]


def without_shared(lines, other, copy_share=COPY_SHARE):
    """The lines of a page without those that it shares with another page of its site."""
    if not lines or not other:
        return lines
    shared = set(shared_lines(lines, other))
    if sum(len(lines[i]) for i in shared) > copy_share * sum(map(len, lines)):
        return lines
    return [line for i, line in enumerate(lines) if i not in shared]


def _common(a, b):
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nearest(page, before, after):
    """The lines of the page whose path shares more with that of ``page``; pages are (host, path, lines)."""
    near = [(_common(page[1], other[1]), -turn, other[2]) for turn, other in enumerate((before, after))
            if other is not None and other[0] == page[0] and page[0]]
    return max(near, key=lambda x: x[:2])[2] if near else None


def main_texts(pages, copy_share=COPY_SHARE, pages_per_range=PAGES_PER_RANGE):
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    ranges = max(1, -(-pages.count() // pages_per_range))
    host = F.lower(F.coalesce(F.regexp_extract("url", URL.pattern, 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", URL.pattern, 2), F.lit(""))
    ordered = (
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host"),
                     path.alias("path"))
        .repartitionByRange(ranges, "host", "path", "page_id", "url")
        .sortWithinPartitions("host", "path", "page_id", "url", "html").select("page_id", "url", "html")
    )

    def difference(batches):
        previous = current = None
        out = []

        def settle(following):
            page_id, url, host, path, lines, marked = current
            if not marked:
                lines = without_shared(lines, nearest((host, path, lines), previous, following), copy_share)
            text = "\n".join(lines)
            out.append((page_id, url, text, len(text)))

        def emitted():
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))],
                ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for page_id, url, html in zip(*batch.columns):
                url = url.as_py()
                page = (page_id.as_py(), url, *host_and_path(url), *page_lines(html.as_py() or ""))
                if current is not None:
                    settle(page[2:5])
                    previous = current[2:5]
                current = page
                if len(out) >= 500:
                    yield emitted()
        if current is not None:
            settle(None)
        yield emitted()

    return ordered.mapInArrow(difference, TEXTS)
