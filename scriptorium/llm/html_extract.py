"""Main text of HTML pages by differencing with the page of the nearest URL.

A page is cut into lines, one for each block of text, by a tolerant tag
scanner.  Pages are paired with the nearest other URL path of their host: the
neighbour in path order with the longer common prefix.  The lines of a pair
are aligned by their longest common subsequence.  What both pages have belongs
to the site and is deleted, wherever it stands; but two pages may carry the
same article or the same passage, so a line that a page itself declares as its
article goes only if most paths of the host have it, three at least, and the
pair's articles are not the same in half of their lines.

What differs on each page no comparison finds: lines in menus, headers,
footers, sidebars, forms, adverts, notices or comments, told by their elements
and names, go in any case.

Only hashes of lines travel for the pairing; a page's text is read where it
lies, and joins the list of its deleted lines.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, sized
from .url_filter import host_and_path

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")

RAW = frozenset("script style template noscript iframe svg object textarea select title".split())
CHROME = frozenset("nav header footer aside form menu dialog button head".split())
CONTENT = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed list: words that name what is no part of an article, in class, id or role.
CHROME_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside complementary contentinfo advert adverts advertisement advertisements ad ads adsense sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies reply search toolbar widget pagination pager skip".split())
#: Fixed list: words that say nothing more in such a name.
NEUTRAL_WORDS = frozenset("area bar block box btn button buttons col column container content element global group holder inner item items left link links list main module page panel right row section site slot top bottom unit wrap wrapper outer primary secondary the".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A line of a declared article is the site's if so many paths of the host, and most of them, have it.
HOST_PATHS = 3


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of an article: by its tag, or by a name all of whose words say so."""
    if name in CHROME:
        return not (in_article and name == "header")
    if "=" not in attributes or name in ("body", "html") or name in CONTENT:
        return False
    for m in ATTRIBUTES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in NAME_PARTS.findall(token)]
            if any(x in CHROME_WORDS for x in parts) and all(x in CHROME_WORDS or x in NEUTRAL_WORDS for x in parts):
                return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of each block: 0 loose, 1 in an article, 2 in what is no part of one.

    Unclosed tags are tolerated: an end tag closes the nearest open element of
    its name that it can reach, and a stray one closes nothing.
    """
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, no part of the article, article
    parts: list[str] = []
    chrome = article = 0
    at, size = 0, len(page)

    def end_line():
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append((text, 2 if chrome else 1 if article else 0))
            parts.clear()

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not m[1]:
            if m[3].rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name in BLOCKS and name != "br":
            end_line()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for _, c, a in stack[i:]:
                        chrome -= c
                        article -= a
                    del stack[i:]
                    break
                if stack[i][1] and stack[i][0] in BLOCKS and name not in ("body", "html"):
                    break  # an end tag does not reach out of a menu or advert
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            if name == "body":
                while stack and stack[-1][0] == "head":
                    chrome -= stack.pop()[1]
            c, a = _is_chrome(name, m[3], article > 0), name in CONTENT
            stack.append((name, c, a))
            chrome += c
            article += a
    end_line()
    return lines


def _line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lcs_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of ``x`` with each beginning of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.where(y == v, row[:-1] + 1, row[1:]))
    return row


def lcs_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` are in a longest common subsequence with ``b``.

    Common heads and tails and elements that the other side lacks are put
    aside first; the rest is divided in halves, so space is linear.
    """
    out = np.zeros(len(a), bool)
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
        out[ha] = True
    ia = lo + np.flatnonzero(np.isin(a[lo:ha], b[lo:hb]))
    work = [(ia, b[lo:hb][np.isin(b[lo:hb], a[lo:ha])])]
    while work:
        at, y = work.pop()
        if len(at) == 1:
            out[at] = (y == a[at[0]]).any()
        elif len(at) and len(y):
            mid = len(at) // 2
            k = int(np.argmax(_lcs_lengths(a[at[:mid]], y) + _lcs_lengths(a[at[mid:]][::-1], y[::-1])[::-1]))
            work += [(at[:mid], y[:k]), (at[mid:], y[k:])]
    return out


def _hashes(batches):
    for batch in batches:
        found = [page_lines(p.as_py()) for p in batch.column(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([[_line_hash(t) for t, _ in x] for x in found], pa.list_(pa.int64())), pa.array([[kind for _, kind in x] for x in found], pa.list_(pa.int8()))],
            names=["page_hash", "host", "path", "lines", "kinds"],
        )


def _shared(batches):
    """Rows (page_hash, host, at, line, article) of the lines that a page shares with its neighbour.

    ``article`` tells the lines of a declared article; they are left out where
    half of its lines are shared, for then both pages carry the same one.
    """
    for batch in batches:
        out = []
        for page, host, lines, kinds, theirs in zip(*(batch.column(i).to_pylist() for i in range(5))):
            kinds = np.array(kinds, np.int8)
            shared = lcs_shared(np.array(lines, np.int64), np.array(theirs, np.int64))
            if shared[kinds != 2].all():
                continue  # pages of the same lines tell nothing
            same_article = 2 * (shared & (kinds == 1)).sum() >= max(1, (kinds == 1).sum())
            out += [(page, host, int(i), lines[i], bool(kinds[i] == 1)) for i in np.flatnonzero(shared) if kinds[i] == 0 or kinds[i] == 1 and not same_article]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_()])], names=["page_hash", "host", "at", "line", "article"])


def _texts(batches):
    for batch in batches:
        texts = []
        for page, deleted in zip(batch.column(2), batch.column(3).to_pylist()):
            gone = set(deleted or ())
            texts.append("\n".join(t for i, (t, kind) in enumerate(page_lines(page.as_py())) if kind != 2 and i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _neighbours(batches):
    """(host, path, before, after, edge) of sorted rows; ``edge`` marks the first and the last row of a task."""
    held, first = None, True
    names = ["host", "path", "before", "after", "edge"]
    fields = [pa.string()] * 4 + [pa.bool_()]
    for batch in batches:
        out = []
        for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held:
                out.append((*held[:3], path if held[0] == host else None, held[3]))
            held = (host, path, held[1] if held and held[0] == host else None, first)
            first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*held[:3], None, True), fields)], names=names)


def nearest_paths(pages: DataFrame) -> DataFrame:
    """(host, path, near_path) for pages (host, path): the nearest other path of the host.

    Paths are told apart first, so repeated URLs are one row, and sorted by
    ranges of (host, path), so a large host is dealt over many tasks.  Two rows
    of each task find their neighbours in another one.
    """
    paths = pages.select("host", "path").distinct().repartitionByRange("host", "path").sortWithinPartitions("host", "path")
    p = cut(paths.mapInArrow(_neighbours, "host string, path string, before string, after string, edge boolean"))
    # two rows a task, in order
    order = Window.orderBy("host", "path")
    same_before, same_after = F.lag("host").over(order) == F.col("host"), F.lead("host").over(order) == F.col("host")
    edges = p.filter("edge").select("host", "path", F.coalesce("before", F.when(same_before, F.lag("path").over(order))).alias("before"), F.coalesce("after", F.when(same_after, F.lead("path").over(order))).alias("after"))
    p = p.filter("not edge").drop("edge").unionByName(edges)
    before, after = F.col("before"), F.col("after")

    def common(x):
        """Length of the common prefix: the place of the first character that differs."""
        same = F.zip_with(F.split("path", ""), F.split(x, ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.array_position(same, False)

    near = F.when(before.isNull(), after).when(after.isNull(), before).when(common(after) > common(before), after).otherwise(before)
    return p.select("host", "path", near.alias("near_path")).filter("near_path is not null")


def shared_lines(lines: DataFrame) -> DataFrame:
    """(page_hash, deleted): the places of the lines of each page that its comparison deletes.

    ``lines`` are (page_hash, host, path, lines, kinds).
    """
    near = nearest_paths(lines)
    near = near.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "near_path")
    asked = lines.dropDuplicates(["page_hash"]).join(near, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))).select("page_hash", "lines", "kinds", "host", "near_path")
    stand_in = lines.groupBy("host", "path").agg(F.max(F.struct(F.size("lines"), "page_hash", "lines"))["lines"].alias("theirs"))
    stand_in = stand_in.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "theirs")
    pairs = asked.join(stand_in, (F.col("host") == F.col("_host")) & (F.col("near_path") == F.col("_path"))).select("page_hash", "host", "lines", "kinds", "theirs")
    shared = cut(pairs.mapInArrow(_shared, "page_hash long, host string, at int, line long, article boolean"))
    # the lines of articles in question, counted over the paths of their host
    asked, n = sized(shared.filter("article").select(F.col("host").alias("_host"), F.col("line").alias("_line")).distinct())
    site = asked
    if n:
        places = lines.select("host", "path", F.explode("lines").alias("line")).join(asked, (F.col("host") == F.col("_host")) & (F.col("line") == F.col("_line")), "left_semi")
        paths = lines.select("host", "path").distinct().groupBy(F.col("host").alias("_h")).agg(F.count("*").alias("_paths"))
        site = places.distinct().groupBy(F.col("host").alias("_host"), F.col("line").alias("_line")).count()
        site = site.join(paths, F.col("_host") == F.col("_h")).filter((F.col("count") >= HOST_PATHS) & (2 * F.col("count") > F.col("_paths")))
        site, _ = sized(site.select("_host", "_line"))
    gone = shared.filter("not article").select("page_hash", "at").unionByName(shared.filter("article").join(site, (F.col("host") == F.col("_host")) & (F.col("line") == F.col("_line")), "left_semi").select("page_hash", "at"))
    return gone.groupBy("page_hash").agg(F.collect_set("at").alias("deleted"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    Null or empty html gives an empty text.  A null url has empty host and
    path and is paired like any other.  A page that is alone on its host keeps
    all lines but those that their elements tell to be no part of an article.
    Repeated rows get the same text; of several pages of one URL the one with
    most lines stands for the URL in pairs.  Empty table, empty
    result.  Only the three columns are read.
    """
    content = F.coalesce(F.col(html_col), F.lit(""))
    host, path = host_and_path(F.col(url_col))
    page_hash = F.xxhash64(F.coalesce(F.col(url_col), F.lit("")), content).alias("page_hash")
    lines = cut(pages.select(page_hash, host.alias("host"), path.alias("path"), content.alias("html")).mapInArrow(_hashes, "page_hash long, host string, path string, lines array<long>, kinds array<tinyint>"))
    deleted = cut(shared_lines(lines).withColumnRenamed("page_hash", "_hash"))
    n, places = deleted.agg(F.count("*"), F.sum(F.size("deleted"))).first()
    if n + (places or 0) <= BROADCAST_ROWS:
        deleted = F.broadcast(deleted)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), content.alias("html"), page_hash)
    rows = rows.join(deleted, F.col("page_hash") == F.col("_hash"), "left").select("page_id", "url", "html", "deleted")
    return rows.mapInArrow(_texts, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
