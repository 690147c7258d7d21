"""How far the sources of a language differ in their words, by inclusion-exclusion over supports.

Each group, a source in a language, gives every kept term of the language a
smoothed probability.  The distance of two groups is the sum of absolute
differences over all kept terms, most of which neither group has.  So no table
of groups by terms is made: with s the price that a group gives a term it lacks,

    distance(g, h) = sum over g's terms of |p_g - s_h|
                   + sum over h's terms of |p_h - s_g|
                   + (V - terms of g - terms of h) * |s_g - s_h|
                   + sum over common terms of (|p_g - p_h| - |p_g - s_h| - |p_h - s_g| + |s_g - s_h|)

The first two sums come from a histogram of each group's counts, the third is
a constant, and the last joins the postings of a term with each other.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized

#: Terms that a task counts before it hands them on.
HELD = 1 << 19
#: Bytes of a text that are split into terms at once.
CHUNK = 1 << 20
ROWS = 512

#: ASCII letters in lower case and all that is not ASCII stay; anything else ends a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NAMES = ["lang", "source", "term", "n", "docs"]
KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of a chunk; a chunk ends where a term does."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        to = len(text) if end < 0 else end
        yield text[at:to].split()
        at = to


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents with it.

    Tasks count what they read and hand on sums, so a frequent term or a large
    group crosses the shuffle as a few rows from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs_with = defaultdict(Counter), defaultdict(Counter)

        def counted() -> Iterator[pa.RecordBatch]:
            rows = ((lang, source, t.decode("utf-8", "replace"), k, docs_with[lang, source][t]) for (lang, source), found in n.items() for t, k in found.items())
            while some := list(itertools.islice(rows, 1 << 16)):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some), KINDS)], NAMES)
            n.clear()
            docs_with.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                few = batch.slice(i, ROWS)
                for lang, source, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), few.column(2)):
                    if not text.is_valid:
                        continue
                    mine, here = n[lang, source], set()
                    for terms in _terms(text.as_buffer().to_pybytes()):
                        mine.update(terms)
                        here.update(terms)
                    docs_with[lang, source].update(here)
                if sum(map(len, n.values())) > HELD:
                    yield from counted()
        yield from counted()

    parts = docs.select(_named("lang"), _named("source"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, COUNTS)
    # one exchange serves the sums of a group and those of its language
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def price(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), exact for any counts."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(19,0))) div cast({total} + 5 * {kept} as decimal(19,0))").cast("long")


def kept_counts(docs: DataFrame, text_col: str = "text", min_docs: int = 30) -> DataFrame:
    """:func:`term_counts` of the terms that at least ``min_docs`` documents of a language have."""
    with_it = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return term_counts(docs, text_col).withColumn("_docs", with_it).filter(F.col("_docs") >= min_docs).select("lang", "term", "source", "n")


def group_facts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each group: gid, lang, source, terms and total of its own, kept and lang_total of its language, and ``absent``, its price of a term that it lacks.

    Without kept terms there is no price: absent is null.
    """
    own = kept.groupBy("lang", "source").agg(F.count("*").alias("terms"), F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.countDistinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    groups = docs.select(_named("lang"), _named("source")).distinct()
    out = groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["terms", "total", "kept", "lang_total"])
    return out.withColumn("absent", F.when(F.col("kept") > 0, price("0", "total", "kept"))).withColumn("gid", F.monotonically_increasing_id())


def pair_distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each group to each other source of its language.

    ``postings`` have gid, lang, term, p and absent, the price of their group.
    """
    near = groups.select("gid", "lang", "source", "terms", "kept", "absent")
    far = near.select(F.col("gid").alias("other"), "lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("absent").alias("item_absent"))
    # every ordered pair of a language is a row of the result
    pairs = near.join(far, "lang").filter("gid <> other")
    # what a group's own terms cost at another's price of an absent term: of a running sum over its histogram
    histogram = postings.groupBy("gid", F.col("p").alias("v")).agg(F.count("*").alias("n"))
    asked = pairs.filter("absent is not null").select("gid", "other", F.col("item_absent").alias("v"))
    points = histogram.select("gid", F.lit(None).cast("long").alias("other"), "v", "n").unionByName(asked.select("gid", "other", "v", F.lit(0).cast("long").alias("n")))
    upto, every = Window.partitionBy("gid").orderBy("v"), Window.partitionBy("gid")
    money = F.col("n") * F.col("v")
    points = points.withColumn("n_below", F.sum("n").over(upto)).withColumn("below", F.sum(money).over(upto)).withColumn("n_all", F.sum("n").over(every)).withColumn("all", F.sum(money).over(every))
    # terms above the price cost p - v each, those below v - p
    one_sided = points.filter("other is not null").select("gid", "other", (F.col("all") - 2 * F.col("below") + F.col("v") * (2 * F.col("n_below") - F.col("n_all"))).alias("cost"))
    a, b = postings.alias("a"), postings.alias("b")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    common = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.gid") < F.col("b.gid")))
    overlap = common.groupBy(F.col("a.gid").alias("gid"), F.col("b.gid").alias("other")).agg(
        F.sum(gap("a.p", "b.p") - gap("a.p", "b.absent") - gap("b.p", "a.absent") + gap("a.absent", "b.absent")).alias("cost")
    )
    costs = [one_sided, one_sided.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "cost"), overlap, overlap.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "cost")]
    both_zero = pairs.select("gid", "other", F.coalesce((F.col("kept") - F.col("terms") - F.col("item_terms")) * gap("absent", "item_absent"), F.lit(0)).alias("cost"))
    sums = both_zero.unionByName(costs[0]).unionByName(costs[1]).unionByName(costs[2]).unionByName(costs[3]).groupBy("gid", "other").agg(F.sum("cost").alias("value"))
    return pairs.select("gid", "other", "lang", "source", "item").join(sums, ["gid", "other"]).select("lang", "source", "item", "value")


def source_divergence(docs: DataFrame, text_col: str = "text", min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of a table with lang, source and texts.

    Part ``pair`` ranks for each group the other sources of its language by
    their distance; part ``term`` ranks the terms that it has more often than
    its language, the first ``top_terms`` of them.  Ties go by item in code
    points.  Null texts, languages and sources are empty; a group without terms
    is a group; a language without kept terms has distances of 0 and no terms.
    Repeated rows count as often as they stand.  Other columns are not read.
    An empty table gives no row.
    """
    kept = cut(kept_counts(docs, text_col, min_docs))
    groups, _ = sized(group_facts(docs, kept))
    facts = groups.select("gid", "lang", "source", "total", "kept", "lang_total", "absent")
    lang_n = F.sum("n").over(Window.partitionBy("lang", "term"))
    rows = kept.withColumn("_lang_n", lang_n).join(facts, ["lang", "source"])
    postings = cut(rows.select("gid", "lang", "source", "term", price("n", "total", "kept").alias("p"), price("_lang_n", "lang_total", "kept").alias("q"), "absent"))
    pairs = pair_distances(groups, postings.select("gid", "lang", "term", "p", "absent"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    terms = postings.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
