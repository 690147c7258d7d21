"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words inside a
sentence, but not words all in capitals) and units after a number turn into
typed placeholders, all else is lower-cased.  Two kinds of windows of the
benchmark are hash-joined with those of the documents, in one pass:

* windows of lower-cased words, 13 or a whole shorter item: a copy, whatever
  its words are;
* windows of template tokens, of which at least half are words.  Hits are
  gathered by item and offset, and the values that fill the placeholders are
  checked: along one offset each value of the item must stand for one value of
  the document.  These are re-parameterised questions.  Items that differ only
  in their values are one template here, under the smallest identifier.

The benchmark's hashes are sent to the executors as a bitmap of a bounded size;
what passes it is joined with the benchmark's windows, so a larger benchmark
takes no further pass and no more memory there.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, sized, slices, text_or_empty

WINDOW = 8
#: Words in a row, or the whole item, that make a document contaminated.
MIN_WORDS = 13
#: A copy of a whole item of fewer words is of the kind ``short``: reported, but no reason to reject a document.
MIN_ITEM_WORDS = 5
#: Bits of the hash that name a bit of the bitmap: 128 KB at least and 16 MB at most.
MIN_GATE_BITS, MAX_GATE_BITS = 20, 27

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\w+|[.!?\n]")
#: Fixed list: common units of measure.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees watt watts volt volts meter meters metre metres kilometer kilometers kilometre kilometres mph kmh".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

_MARK, _NUMBER, _CAPITAL, _UNIT = 1, 2, 4, 8
_SLOTS = {_NUMBER: "<number>", _CAPITAL: "<name>", _UNIT: "<unit>"}
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


#: Texts are read together until they have so many characters.
TEXT_BLOCK = 1 << 19


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Characters:
    """What a code point is, learned by blocks of 256 as they are met: its kind and a number for its lower case.

    The two small sigmas have one number, so equal lower-cased words have equal numbers.
    """

    def __init__(self):
        self.known = np.zeros(0x1100, bool)
        self.kind = np.zeros(0x110000, np.uint8)
        self.fold = np.zeros(0x110000, np.uint64)

    def learn(self, points: np.ndarray) -> None:
        for block in np.flatnonzero(np.bincount(points >> 8, minlength=len(self.known)) * ~self.known).tolist():
            for i in range(block << 8, block + 1 << 8):
                c = chr(i)
                self.kind[i] = _IN_WORD * (c.isalnum() or c == "_") | _DECIMAL * c.isdecimal() | _DIGIT * c.isdigit() | _UPPER * c.isupper() | _SMALL * (c.islower() or unicodedata.category(c) == "Lt") | _STOP * (c in ".!?\n") | _POINT * (c in ".,")
                low = c.lower()
                self.fold[i] = i if len(low) > 1 else 0x3C3 if low == "\u03c2" else ord(low)
            at = slice(block << 8, block + 1 << 8)
            self.fold[at] = _mixed(self.fold[at] + np.uint64(0x9E3779B97F4A7C15))
            self.known[block] = True


_IN_WORD, _DECIMAL, _DIGIT, _UPPER, _SMALL, _STOP, _POINT = (1 << i for i in range(7))
_characters = _Characters()


def _starts(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the matches of ``TOKEN`` in characters of these kinds."""
    word = (kind & _IN_WORD).astype(bool)
    before = np.concatenate([[False], word[:-1]])
    start = word & ~before
    inside = word.copy()
    first = np.flatnonzero(start & (kind & _DECIMAL).astype(bool))
    if len(first):  # a number ends where its digits do, and goes on over a point or comma between digits
        decimal = np.concatenate([kind & _DECIMAL, [0, 0]]).astype(bool)
        no_digit = np.flatnonzero(~decimal)
        end = no_digit[np.searchsorted(no_digit, first)]
        joined = end[(end < len(kind)) & decimal[np.minimum(end + 1, len(kind))]]
        joined = joined[(kind[joined] & _POINT).astype(bool)]
        inside[joined], start[joined + 1] = True, False
        cut = end[end < len(kind)]
        start[cut[word[cut]]] = True
    stop = (kind & _STOP).astype(bool) & ~inside
    at = np.flatnonzero(start | stop)
    ends = np.flatnonzero(np.concatenate([inside[:-1] & ~inside[1:], inside[-1:]])) + 1
    last = np.append(ends, len(kind))[np.searchsorted(ends, at + 1)]
    last = np.minimum(last, np.append(at[1:], len(kind)))
    return at, np.where(stop[at], at + 1, last)


def _words(text: str) -> Iterator[str]:
    """The text's words, without the marks that end sentences."""
    yield from (w for w in TOKEN.findall(text) if w not in _MARKS)


_MARKS = frozenset(".!?\n")


class Canonicaliser:
    """Template tokens of texts; many texts are read at once, in arrays over their characters."""

    def __init__(self):
        self.slot_hash = {k: np.uint64(xxhash.xxh64_intdigest(v)) for k, v in _SLOTS.items()}
        self.sets = []
        for words, kind in ((UNITS, _UNIT), (NUMBER_WORDS, _NUMBER)):
            h = np.unique([self._tokens(w)[1][0] for w in words])
            gate = np.zeros(1 << 16, bool)
            gate[h & np.uint64(0xFFFF)] = True
            self.sets.append((h, gate, kind))

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash, kind of the first character, whether a later one is in small letters) of each token."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        _characters.learn(points)
        kind = _characters.kind[points]
        start, end = _starts(kind)
        if not len(start):
            return start, *[np.zeros(0, t) for t in (np.uint64, np.uint8, bool)]
        size = end - start
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(start, size) + place
        first = np.cumsum(size) - size
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _FACTOR)]))
        return start, _mixed(np.add.reduceat(_characters.fold[points[at]] * power[place], first)), kind[start], np.bitwise_or.reduceat(kind[at], first) & _SMALL > 0

    def template(self, text: str) -> tuple[Iterator[str], np.ndarray, np.ndarray, np.ndarray]:
        """(words, which few texts are asked for, hash of each lower-cased word, hash of each template token, kind of its slot or 0)."""
        return self.readings(text)[:4]

    def readings(self, text: str) -> tuple[Iterator[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:func:`template`, and the hashes and kinds where words with a capital at a sentence's beginning are names.

        Whether such a word is a name cannot be told, so both readings count.
        """
        return _words(text), *self.read([text])[1:]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What :func:`readings` gives, of texts in a row, and the number of its text before the others for each word.

        Between two texts stands the end of a line, which ends a sentence and no word goes over.
        """
        start, plain, head, small = self._tokens("\n".join(texts))
        kind = np.where(head & _UPPER > 0, small * np.uint8(_CAPITAL), np.uint8(0))
        for words, gate, value in self.sets:
            maybe = np.flatnonzero(gate[plain & np.uint64(0xFFFF)])
            found = maybe[np.isin(plain[maybe], words)]
            kind[found] = np.where((value == _UNIT) & (kind[found] == _CAPITAL), kind[found], np.uint8(value))
        kind[head & _DIGIT > 0] = _NUMBER
        kind[head & _STOP > 0] = _MARK
        mark, capital = kind == _MARK, kind == _CAPITAL
        begins = np.concatenate([[True], mark[:-1]])[: len(mark)]
        counted = np.concatenate([[False], kind[:-1] == _NUMBER])[: len(mark)]
        first = capital & begins
        slot = np.where(capital & ~begins | (kind == _NUMBER) | (kind == _UNIT) & counted, kind, np.uint8(0))
        h = plain.copy()
        for k, value in self.slot_hash.items():
            h[slot == k] = value
        keep = ~mark
        named, as_name = np.where(first, self.slot_hash[_CAPITAL], h), np.where(first, np.uint8(_CAPITAL), slot)
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start[keep], "right")
        return of, plain[keep], h[keep], slot[keep], named[keep], as_name[keep]


def rolling(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of every n tokens in a row, made of those of powers of two."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, power, factor = np.full(m, np.uint64(seed)), 0, 1, h, int(_FACTOR)
    while True:
        if n & size:
            out = out * np.uint64(factor) + power[at : at + m]
            at += size
        if 2 * size > n:
            return out
        power = power[:-size] * np.uint64(factor) + power[size:]
        factor, size = factor * factor & (1 << 64) - 1, 2 * size


def template_windows(h: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of n template tokens of which at least half are words.

    What is mostly placeholders says nothing about its question; copies of it
    are found by their words.
    """
    out = rolling(h, n, 2 * n)
    filled = np.concatenate([[0], np.cumsum(slot != 0)])
    start = np.flatnonzero(filled[n:] - filled[:-n] <= n // 2) if len(out) else np.zeros(0, np.int64)
    return start, out[start]


def both_windows(h: np.ndarray, slot: np.ndarray, named: np.ndarray, as_name: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, hash, slots) of the template windows of both readings, of the second those alone that differ from the first."""
    first = slot != as_name
    if not first.any() or len(h) < n:
        return [(*template_windows(h, slot, n), slot)]
    one, two = rolling(h, n, 2 * n), rolling(named, n, 2 * n)
    filled, more = (np.concatenate([[0], np.cumsum(x)]) for x in (slot != 0, first))
    filled, more = filled[n:] - filled[:-n], more[n:] - more[:-n]
    at, other = np.flatnonzero(filled <= n // 2), np.flatnonzero((more > 0) & (filled + more <= n // 2))
    return [(at, one[at], slot), (other, two[other], as_name)]


def plain_windows(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = rolling(h, n, 2 * n + 1)
    return np.arange(len(out)), out


_WINDOW_FIELDS = "copied boolean, pos int, n int, h long, template string, slots array<string>"
_WINDOW_TYPES = [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())]
_WINDOW_NAMES = ["copied", "pos", "n", "h", "template", "slots"]


def _window(copied: bool, words, slot, at: int, n: int, h) -> tuple:
    low = [w.lower() for w in words[at : at + n]]
    canon = low if copied else [_SLOTS[int(k)] if k else w for w, k in zip(low, slot[at : at + n])]
    return copied, at, n, int(np.uint64(h).astype(np.int64)), " ".join(canon), [] if copied else [w for w, k in zip(low, slot[at : at + n]) if k]


def _form(words, slot) -> str:
    """The item's template with placeholders numbered by their values: what items have in common that differ in values alone."""
    seen: dict[tuple, int] = {}
    return " ".join(f"{_SLOTS[int(k)]}{seen.setdefault((int(k), w.lower()), len(seen))}" if k else w.lower() for w, k in zip(words, slot))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, form, item_words, windows, copied, pos, n, h, template, slots) of each benchmark item."""

    def run(batches):
        canon = Canonicaliser()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, plain, h, slot, named, as_name = canon.readings(text)
                words = list(words)
                if not words:
                    continue
                form = xxhash.xxh3_64_intdigest(_form(words, slot).encode("utf-8", "surrogatepass")) - (1 << 63)
                n = min(min_words, len(words))
                rows += [(item, form, len(words), 1, *_window(True, words, slot, int(a), n, x)) for a, x in zip(*plain_windows(plain, n))]
                if len(words) >= MIN_ITEM_WORDS:
                    n = min(window, len(words))
                    both = both_windows(h, slot, named, as_name, n)
                    places = len(set().union(*(at.tolist() for at, _, _ in both)))
                    rows += [(item, form, len(words), places, *_window(False, words, kinds, int(a), n, x)) for at, hs, kinds in both for a, x in zip(at, hs)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *_WINDOW_TYPES])], names=["item_id", "form", "item_words", "windows", *_WINDOW_NAMES])

    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(benchmark, text_col).alias("text")).distinct()
    return items.mapInArrow(run, f"item_id long, form long, item_words int, windows int, {_WINDOW_FIELDS}")


def _gate(items: DataFrame, n_windows: int) -> np.ndarray:
    """A bitmap of the leading bits of the windows' hashes, as bytes; gathered in pieces of 8 KB."""
    bits = min(MAX_GATE_BITS, max(MIN_GATE_BITS, math.ceil(math.log2(64 * max(n_windows, 1)))))

    def run(batches):
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).to_numpy()
            for piece in np.unique(at >> 16).tolist():
                mine = pieces.setdefault(piece, np.zeros(1 << 16, bool))
                mine[at[at >> 16 == piece] & 0xFFFF] = True
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), pa.array([np.packbits(p).tobytes() for p in pieces.values()], pa.binary())], names=["piece", "bits"])

    at = F.shiftrightunsigned("h", 64 - bits)
    out = np.zeros((1 << bits - 16, 1 << 13), np.uint8)
    for r in items.select(F.shiftrightunsigned("h", 80 - bits).alias("piece"), at.alias("at")).distinct().repartition("piece").mapInArrow(run, "piece long, bits binary").collect():
        out[r.piece] |= np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _hits(docs: DataFrame, gate: np.ndarray, lengths: list[tuple[bool, int]]) -> DataFrame:
    """(id, text_hash, copied, pos, n, h, template, slots) of the windows of ``docs`` that pass the gate."""
    shared = docs.sparkSession.sparkContext.broadcast(gate)
    shift = np.uint64(64 - (8 * len(gate)).bit_length() + 1)

    def run(batches):
        gate = shared.value
        canon = Canonicaliser()
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            blocks = np.flatnonzero(np.diff(ends // TEXT_BLOCK, append=-1)) + 1 if texts else []
            rows, lo = [], 0
            for hi in map(int, blocks):
                rows += [(lo + i, *w) for i, w in hits(canon, gate, texts[lo:hi])]
                lo = hi
            if rows:
                which, *cols = zip(*rows)
                take = pa.array(which, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c, t) for c, t in zip(cols, _WINDOW_TYPES)]], names=["id", "text_hash", *_WINDOW_NAMES])

    def hits(canon, gate, texts):
        of, plain, h, slot, named, as_name = canon.read(texts)
        begin = np.searchsorted(of, np.arange(len(texts)))
        words: dict[int, list[str]] = {}
        for copied, n in lengths:
            for at, hs, kinds in [(*plain_windows(plain, n), slot)] if copied else both_windows(h, slot, named, as_name, n):
                bit = hs >> shift
                maybe = np.flatnonzero((gate[(bit >> np.uint64(3)).astype(np.int64)] << (bit & np.uint64(7)).astype(np.uint8)) & 128)
                maybe = maybe[of[at[maybe]] == of[at[maybe] + n - 1]]  # no window goes over the end of its text
                if copied and n < MIN_ITEM_WORDS and len(maybe):  # short items may stand in a text at every other word
                    maybe = maybe[np.sort(np.unique(np.stack([of[at[maybe]].astype(np.uint64), hs[maybe]]), axis=1, return_index=True)[1])]
                for j in maybe.tolist():
                    i = int(of[at[j]])
                    if i not in words:
                        words[i] = list(_words(texts[i]))
                    lo = int(begin[i])
                    here = int(at[j]) - lo
                    yield i, _window(copied, words[i], kinds[lo : lo + len(words[i])], here, n, hs[j])

    return docs.mapInArrow(run, f"id long, text_hash long, {_WINDOW_FIELDS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, item_id, kind, n_windows, first_word, last_word): one row for each document and item it holds.

    ``kind`` is ``verbatim`` (``min_words`` words in a row, or all of a shorter
    item), ``short`` (all of an item of fewer than ``MIN_ITEM_WORDS`` words) or
    ``reparameterised``; where an item is there in two ways, the first of these.
    Words are template tokens, counted from 0, both ends included; of several
    places the one with most windows, then the first, is given.  Null texts are
    empty and match nothing; null identifiers and repeated rows are matched by
    identifier and text, once.  If either table is empty, so is the result.
    Only the named columns are read.
    """
    items = cut(item_windows(benchmark, item_id_col, item_text_col, window, min_words))
    # one template for items that differ in their values alone
    named = items.filter("not copied").groupBy("form").agg(F.min("item_id").alias("_item")).withColumnRenamed("form", "_form")
    items = cut(items.join(named, (F.col("form") == F.col("_form")) & (F.col("item_id") == F.col("_item")), "left").filter("copied or _item is not null").drop("form", "_form", "_item"))
    n_windows = items.count()
    if not n_windows:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, kind string, n_windows int, first_word int, last_word int")
    # at most a few dozen: a window's length is bounded
    lengths = sorted((r.copied, r.n) for r in items.select("copied", "n").distinct().collect())
    text = text_or_empty(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    hits = _hits(rows, _gate(items, n_windows), lengths)
    side = items.select("item_id", "item_words", "windows", F.col("pos").alias("ipos"), F.col("h").alias("_h"), F.col("copied").alias("_copied"), F.col("template").alias("_template"), F.col("slots").alias("islots"))
    side = F.broadcast(side) if n_windows <= BROADCAST_ROWS else side
    joined = hits.join(side, (F.col("h") == F.col("_h")) & (F.col("template") == F.col("_template")) & (F.col("copied") == F.col("_copied")))
    joined = joined.select("id", "text_hash", "item_id", "item_words", "copied", "windows", "n", "pos", (F.col("pos") - F.col("ipos")).alias("offset"), F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d")).alias("filled"))
    along = joined.groupBy("id", "text_hash", "item_id", "item_words", "copied", "windows", "n", "offset").agg(F.collect_set("pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"))
    at = F.col("at")
    along = along.withColumn("n_windows", F.size("at"))
    consistent = F.size(F.array_distinct(F.transform("filled", lambda x: x["i"]))) == F.size("filled")
    enough = F.col("n_windows") >= F.least(F.col("windows"), F.greatest(F.lit(1), F.least(F.lit(min_words), F.col("item_words")) - F.col("n") + 1))
    kind = F.when(~F.col("copied"), "reparameterised").when(F.col("item_words") < MIN_ITEM_WORDS, "short").otherwise("verbatim")
    found = along.filter(F.col("copied") | enough & consistent).select(
        "id", "text_hash", "item_id",
        F.struct("copied", "n_windows", (-F.array_min(at)).alias("start"), kind.alias("kind"), (F.array_max(at) + F.col("n") - 1).alias("last")).alias("best"),
    )
    best = found.groupBy("id", "text_hash", "item_id").agg(F.max("best").alias("best"))
    return best.select(F.col("id").alias("doc_id"), "text_hash", "item_id", F.col("best.kind").alias("kind"), F.col("best.n_windows").alias("n_windows"), (-F.col("best.start")).alias("first_word"), F.col("best.last").alias("last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark`` but short ones."""
    bad, _ = sized(contaminated(docs, benchmark, id_col, text_col, **options).filter("kind <> 'short'").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct())
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(F.col("__bad_id")) & (F.xxhash64(text_or_empty(docs, text_col)) == F.col("__bad_hash")), "left_anti")
