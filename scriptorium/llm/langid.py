"""Language identification with error-correcting output codes.

Each language gets a codeword, a row of a Hadamard matrix without its constant
column, so two codewords differ in half their bits.  For each bit a binary
classifier over hashed character trigrams predicts which half a text belongs
to; decoding takes the language whose codeword has the smallest loss over all
bits, each bit weighed by how well it did on the training rows.  A text is
ambiguous when the two best losses are close.

The classifiers are learned from a bounded sample: of each language, rows whose
hashed identifier falls under ``sample_rows`` over the number of its labelled
rows, so a rare language is learned from all its rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Bound on the labelled rows of one language that are learned from, in expectation.
SAMPLE_ROWS = 1000
#: Languages beyond this many are refused, as the model is broadcast.
MAX_LANGUAGES = 128
SMOOTHING = 0.5
#: Trigrams that the documents of a language count as, however many they are.
PSEUDO_TRIGRAMS = 300_000
MARGIN_SCALE = 8.0
AMBIGUOUS = 0.6
#: Share of a text's trigrams that some bit classifier has learned; below it the text is in no learned
#: language.  A text in two of them is known though its bits contradict each other, so their loss does not decide.
MIN_KNOWN = 0.5

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed trigrams of the lower-cased letters, runs of all else as one space; None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 whose pairs differ in half the columns."""
    size = 4
    while size < n:
        size *= 2
    h = np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:]


class Model:
    """Weights of the bit classifiers, their reliability and the codewords."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        self.codes = codewords(len(languages))
        self.known = (counts > 0).any(0)
        # each language weighs the same, however many rows it has
        p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
        bits = self.codes.shape[1]
        self.weights = np.zeros((BUCKETS, bits), np.float32)
        for b in range(bits):
            ones, zeros = self.codes[:, b] > 0, self.codes[:, b] < 0
            if ones.any() and zeros.any():
                self.weights[:, b] = np.log(p[ones].mean(0)) - np.log(p[zeros].mean(0))
        # reliability: how far the languages' own mean margins are on the right side
        margins = (p.astype(np.float32) @ self.weights) * self.codes
        self.reliability = np.clip(margins.min(0), 0.05, None)
        self.reliability /= self.reliability.sum()

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each language for rows of counts."""
        margin = counts @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1)
        out = np.empty((len(counts), len(self.languages)))
        for k, code in enumerate(self.codes):
            out[:, k] = (np.logaddexp(0, -MARGIN_SCALE * margin * code) * self.reliability).sum(1)
        return out

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, share of known trigrams) of each row; the score is the softmax of the negated losses."""
        z = -self.losses(counts) * MARGIN_SCALE
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        best = e.argmax(1)
        return best, (e / e.sum(1, keepdims=True))[np.arange(len(best)), best], counts[:, self.known].sum(1) / counts.sum(1)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from rows with a language; None if there are no labelled rows with a letter."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text_or_empty(labelled, text_col).alias("text"))
    # one row a language; the number of languages is bounded below
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = labelled.sparkSession.createDataFrame([(r.lang, max(1, round(1_000_000 * min(1.0, sample_rows / r.n)))) for r in sizes], "lang_ string, share int")
    rows = rows.join(F.broadcast(shares), F.col("lang") == F.col("lang_")).filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share")).select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = trigram_counts(t.as_py())
                if counts is not None:
                    # documents weigh the same, however long
                    sums[lang] = sums.get(lang, 0) + counts / counts.sum()
                    docs[lang] = docs.get(lang, 0) + 1
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([docs[x] for x in sums]), pa.array([zlib.compress(x.astype("<f8").tobytes(), 1) for x in sums.values()])], names=["lang", "docs", "counts"])

    # each task sums its rows by language; what is exchanged are sums of a fixed size, none of them the rows of a language
    partial = rows.mapInArrow(run, "lang string, docs long, counts binary")

    def total(batches):
        sums: dict[str, tuple] = {}
        for batch in batches:
            for lang, docs, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, c = sums.get(lang, (0, 0))
                sums[lang] = n + docs, c + np.frombuffer(zlib.decompress(counts), "<f8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([n for n, _ in sums.values()]), pa.array([c.astype("<f8").tobytes() for _, c in sums.values()])], names=["lang", "docs", "counts"])

    got = partial.repartition("lang").sortWithinPartitions("lang", "docs", "counts").mapInArrow(total, "lang string, docs long, counts binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: r.lang)
    counts = np.stack([np.frombuffer(r.counts, "<f8") for r in got])
    docs = np.array([r.docs for r in got])
    # the same weight against the smoothing for each language: what none of them has seen speaks for none
    return Model([r.lang for r in got], counts / docs[:, None] * PSEUDO_TRIGRAMS, docs)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if none are named) of each row with lang_pred, score, ambiguous and known.

    Columns of ``docs`` with those four names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            langs, scores, known = ["und"] * n, np.zeros(n), np.zeros(n)
            at, held = [], []

            def flush():
                for i, b, s, x in zip(at, *m.predict(np.stack(held))):
                    langs[i], scores[i], known[i] = m.languages[b], s, x
                at.clear()
                held.clear()

            if m is not None:
                for i, t in enumerate(batch.column(at_text)):
                    counts = trigram_counts(t.as_py() or "")
                    if counts is not None:
                        at.append(i)
                        held.append(counts)
                        if len(held) == 16:
                            flush()
                if held:
                    flush()
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(langs), pa.array(scores), pa.array(scores < AMBIGUOUS), pa.array(known)], names=names)

    added = ("lang_pred", "score", "ambiguous", "known")
    columns = [c for c in (keep or docs.columns) if c not in added]
    rows = docs.select(*dict.fromkeys([*columns, text_col]))
    at_text, kept, names = rows.columns.index(text_col), [rows.columns.index(c) for c in columns], [*columns, *added]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in columns] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("known", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(id_col, modulus: int, remainder: int):
    """Whether crc32 of the identifier as text leaves the remainder; a null counts as empty."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row for each row of ``docs``.

    Learned from rows that are not held out and have a language.  A text that
    is null, empty or without a letter is ``und`` with score 0, as is every
    text if nothing could be learned.  With one learned language all letters
    are that language.  Repeated rows and null identifiers are judged like any
    other (a null identifier is never held out).  Empty table, empty result.
    """
    held = held_out(F.col(id_col), modulus, remainder)
    model = train(docs.select(id_col, text_col, lang_col).filter(~held), id_col, text_col, lang_col, sample_rows)
    out = identify(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, min_known: float = MIN_KNOWN) -> DataFrame:
    """The rows of ``docs`` in a learned language.

    Rejected are texts without a letter (null and empty ones too) and those of
    whose trigrams the classifiers know less than ``min_known``, for they are
    in no learned language.  An ambiguous text stays: a text in two languages
    is not junk.  Where fewer than two languages can be learned, nothing tells
    them from others, and texts with a letter stay.
    """
    model = train(docs, id_col, text_col, lang_col, sample_rows)
    if model is None or len(model.languages) < 2:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    ours = {"lang_pred", "score", "ambiguous", "known"}
    # columns of the same names travel under others
    held = docs.withColumnsRenamed({c: f"__held_{c}" for c in docs.columns if c in ours})
    kept = identify(held, model, text_col).filter((F.col("lang_pred") != "und") & (F.col("known") >= min_known)).select(held.columns)
    return kept.toDF(*docs.columns)
