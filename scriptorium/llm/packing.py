"""Packing documents into sequences of a fixed number of tokens by best-two-fit.

Documents are tokenised and cut where they stand, and each task numbers its
pieces of each length.  What decides the packing is how many pieces there are
of each length, at most ``size`` numbers: the plan is made from those.  It
fills one sequence greedily with the longest pieces that fit, then replaces
its smallest piece with two others that fill the gap more tightly, and repeats
that sequence as often as the lengths suffice, which is what filling them one
by one would give.  So a plan has some thousands of patterns, however many
documents there are.  The k-th piece of a length then finds its place in the
plan by its number, without a sort or a shuffle of the pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, sized

#: Tokens of a sequence.
SEQUENCE = 4096
#: The token that ends each document.
END = 1
#: Words, and pieces of words, whose tokens a worker remembers.
MEMO = 1 << 18
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20
#: Rows of a batch that is read or returned.
ROWS = 512

#: White space that ends a word, and digits, which are tokens of their own: no token stands on both sides.
_BREAK = re.compile(rb"[\x20\x09-\x0D0-9]")
#: Words that lower-casing and composition leave to the pattern below.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
#: Fixed value: the vocabulary's own pattern of pieces, for the letters of such words.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Memo(dict):
    """Results of a function by its argument, which a missing key is given to.

    What was used since half of the room was filled stays when it is full, and
    long keys are not kept at all, so memory is bounded.
    """

    def __init__(self, make: Callable, room: int = MEMO, longest: int = 64):
        self.make, self.room, self.longest, self.before = make, room, longest, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.room:
                self.before = dict(self)
                self.clear()
            self[key] = out
        return out


class WordEncoder:
    """Token ids of words as little-endian bytes.

    The vocabulary drops white space and no token, composition or case rule
    reaches across it, so the ids of a text are those of its words in a row.
    Words of ASCII and Latin letters are their own composed form, and the
    pattern that splits them is stated here; what it gives goes to the
    vocabulary's merges.  All other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.byte_level = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces, self.words = Memo(self._piece), Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else self.byte_level.pre_tokenize_str(piece)[0][0]
        return np.asarray([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __call__(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each worker, which keeps it between tasks."""
    return WordEncoder(path)


def token_pieces(text: bytes, encode: WordEncoder, size: int = SEQUENCE, end: int = END) -> Iterator[bytes]:
    """The ids of a document and its end, cut into pieces of ``size`` ids; the last may be shorter.

    A text is read in chunks that end where a word does, so what is held is a
    chunk and its ids, or the longest word.
    """
    held, at, full = b"", 0, 4 * size
    while at < len(text):
        stop = _BREAK.search(text, at + CHUNK) if len(text) - at > CHUNK else None
        to = stop.start() if stop else len(text)
        held += encode(text[at:to].split())
        at, whole = to, len(held) // full * full
        for i in range(0, whole, full):
            yield held[i : i + full]
        held = held[whole:]
    yield held + np.asarray([end], "<u4").tobytes()


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, size: int, end: int) -> DataFrame:
    """A row for each piece: identifier, piece, start, length, ids_crc32, and ``part`` and ``at``, its number among those of its length in the task."""
    kind = docs.schema[id_col]
    fields = ["piece", "start", "length", "ids_crc32", "part", "at"]
    schema = StructType([StructField(id_col, kind.dataType), *[StructField(f, LongType()) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                few = batch.slice(i, ROWS)
                ids, rows, of = few.column(0), [], []
                for k, text in enumerate(few.column(1)):
                    start = 0
                    for piece, held in enumerate(token_pieces(text.as_buffer().to_pybytes() if text.is_valid else b"", encode, size, end)):
                        n = len(held) // 4
                        rows.append((piece, start, n, zlib.crc32(held), part, seen[n]))
                        of.append(k)
                        seen[n] += 1
                        start += n
                columns = np.asarray(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *map(pa.array, columns)], [id_col, *fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def _fill(left: np.ndarray, size: int) -> Counter:
    """Lengths of one sequence out of ``left``, the pieces of each length that are not packed."""
    left, chosen, gap = left.copy(), Counter(), size
    while (fits := np.flatnonzero(left[: gap + 1])).size:
        n = int(fits[-1])
        k = min(int(left[n]), gap // n)
        chosen[n] += k
        left[n] -= k
        gap -= k * n
    while gap:
        least = min(chosen)
        room = gap + least
        left[least] += 1
        have = np.flatnonzero(left[:room])
        # for each length the longest that goes with it, itself only where there are two
        upto = np.zeros(room + 1, np.int64)
        upto[have] = have
        upto = np.maximum.accumulate(upto)
        other = upto[np.minimum(room - have, have)]
        other = np.where((other == have) & (left[have] < 2), upto[have - 1], other)
        sums = np.where(other > 0, have + other, 0)
        best = int(sums.argmax()) if have.size else 0
        if not have.size or sums[best] <= least:
            break
        chosen[least] -= 1
        chosen += Counter()  # drops what is used up
        for n in (int(have[best]), int(other[best])):
            chosen[n] += 1
            left[n] -= 1
        gap = room - int(sums[best])
    return chosen


def packing_plan(counts: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first, uses, sequence, offset), sorted: where pieces of a length go, by number.

    From its ``first`` number on, ``uses`` pieces of a length stand side by
    side at ``offset`` in ``sequence`` and in each that follows it, up to the
    next row's first.  Every piece has a place, and no sequence is over ``size``.
    """
    left = np.zeros(size + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    done, rows, sequence = np.zeros(size + 1, np.int64), [], 0
    while left.any():
        chosen = _fill(left, size)
        times, offset = min(int(left[n]) // u for n, u in chosen.items()), 0
        for n, u in sorted(chosen.items(), reverse=True):
            rows.append((n, int(done[n]), u, sequence, offset))
            done[n] += u * times
            left[n] -= u * times
            offset += u * n
        sequence += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 5)


def _placed(pieces: DataFrame, plan: np.ndarray, columns: list[str]) -> DataFrame:
    """``pieces`` with sequence_id and offset instead of ``rank``; the plan travels with the task."""
    schema = StructType([*[pieces.schema[c] for c in columns], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    keys = (plan[:, 0] << 48) + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            _, first, uses, sequence, offset = plan[np.searchsorted(keys, (length << 48) + rank, "right") - 1].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(sequence + nth // uses), pa.array(offset + nth % uses * length)], [*columns, "sequence_id", "offset"])

    return pieces.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end: int = END) -> DataFrame:
    """A row for each piece: identifier, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary that drops white space.  A null
    text is empty: such a document is its end token alone.  Null identifiers and
    repeated rows are documents like any other; an empty table gives no row.
    Of other columns only these two are read.  Which of the documents of equal
    length stands where is not fixed; the number of sequences is.
    """
    pieces = cut(tokenised(docs, tokenizer, id_col, text_col, size, end))
    parts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = sized(parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("_before") + F.col("at"))
    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    return _placed(ranked.select(*columns, "rank"), packing_plan(counts, size), columns)
