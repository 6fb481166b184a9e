"""Language identification by averaged subword embeddings (operator 4).

A text's features are its hashed byte n-grams within words, word ends included.
The mean of their embeddings goes through a linear softmax; both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.  For
prediction embeddings and weights fold into one score for each bucket and
language, so a whole text is scored by one table look-up a gram.  Scores are
calibrated by a temperature, and a threshold for rejection set, on rows held
back from training.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, wordhash

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIM = 16
#: Labelled rows of each language in the training sample, about so many at most.
PER_LANGUAGE = 600
#: Bytes of text whose scores are held at a time.
PIECE_BYTES = 1 << 20
#: Share of the held-back rows that rejection may cost.
REJECT = 0.001
UNKNOWN = "und"

_FOLD = np.array([(b + 32 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint64)
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def grams(raw: np.ndarray) -> list[np.ndarray]:
    """Buckets of the grams of each size that begin at each byte of one buffer; BUCKETS where there is none.

    White space and all other ASCII but letters is a space, which ends a gram.
    """
    x = _FOLD[raw]
    space = x == 0x20
    out = []
    code, inner = x + np.uint64(1), np.zeros(len(x), bool)
    for n in range(2, max(SIZES) + 1):
        m = len(x) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        # a space inside the gram, or two at its ends with nothing between
        inner = inner[:m] | (space[n - 2 : n - 2 + m] if n > 2 else False)
        code = code[:m] * np.uint64(0x100000001B3) + x[n - 1 : n - 1 + m] + np.uint64(1)
        bad = inner | (space[:m] & space[n - 1 : n - 1 + m] if n == 2 else False)
        bucket = (wordhash.mix64(code + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)
        out.append(np.where(bad, BUCKETS, bucket))
    return out


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a space before, between and after them, and each text's offset among them."""
    raw, offsets = wordhash.buffers(texts)
    n = len(offsets) - 1
    out = np.full(len(raw) + n + 1, 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    return out, offsets + np.arange(n + 1)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS + 1 rows of a score for each language, the last 0
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array, piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Mean scores of each text and its number of grams; a long text is summed up piece by piece."""
        raw, at = padded(texts)
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for a in range(0, len(raw), piece):
            b = min(len(raw), a + piece)
            first, last = np.searchsorted(at[:-1], a, "right") - 1, np.searchsorted(at[:-1], b)
            for found in grams(raw[a : b + max(SIZES) - 1]):
                found = found[: b - a]  # those that begin in the piece
                starts = np.maximum(at[first:last] - a, 0)
                starts = starts[starts < len(found)]
                if len(starts):
                    rows = slice(first, first + len(starts))
                    total[rows] += np.add.reduceat(self.table[found], starts, axis=0)
                    count[rows] += np.add.reduceat((found < BUCKETS).astype(np.int64), starts)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its calibrated probability, by text."""
        z = self.logits(texts)[0] / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], *, epochs: int = 12, rate: float = 0.5, seed: int = 3) -> Model:
    """Fit embeddings and softmax on (language, gram buckets, their counts) by SGD, then calibrate on a fifth held back.

    Each step draws 8 to 512 grams of a row, so that the model knows short texts and long ones.
    """
    languages = sorted({r[0] for r in rows})
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    y = np.array([languages.index(r[0]) for r in rows])
    upto = [np.cumsum(r[2]) for r in rows]
    e = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    w, b = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            g = rows[i][1]
            if not len(g):
                continue
            g = g[np.searchsorted(upto[i], rng.integers(0, upto[i][-1], int(2 ** rng.uniform(3, 9))), "right")]
            x = e[g].mean(axis=0)
            d = _softmax(x @ w + b)
            d[y[i]] -= 1
            back = w @ d
            w -= step * np.outer(x, d)
            b -= step * d
            np.add.at(e, g, -step * back * (8 / len(g)))  # of 1 / len(g), rare grams would hardly move
    table = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    table[:BUCKETS] = e @ w
    model = Model(languages, table, b)
    z = np.array([rows[i][2] @ table[rows[i][1]] / upto[i][-1] + b for i in held if len(rows[i][1])])
    t = y[[i for i in held if len(rows[i][1])]]
    if len(z):
        loss = lambda k: -np.log(_softmax(z / k)[np.arange(len(t)), t] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
        model.threshold = min(0.5, float(np.quantile(_softmax(z / model.temperature).max(axis=1), REJECT)))
    return model


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 by 4; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _sample(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, and the distinct gram buckets of the whole text with their counts, BUCKETS of them at most."""
    buckets, counts = [], []
    for text in batch.column("text"):
        raw, _ = padded(pa.array([text.as_py()], pa.string()))
        n = np.zeros(BUCKETS + 1, np.int64)
        for a in range(0, len(raw), PIECE_BYTES):
            b = min(len(raw), a + PIECE_BYTES)
            for found in grams(raw[a : b + max(SIZES) - 1]):
                n += np.bincount(found[: b - a], minlength=BUCKETS + 1)
        buckets.append(np.flatnonzero(n[:BUCKETS]).astype(np.int32))
        counts.append(n[buckets[-1]])
    return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["lang", "grams", "counts"])


def learn(docs: DataFrame, *, per_language: int = PER_LANGUAGE, **options) -> Model | None:
    """A model from the labelled rows of docs that are not held out.

    The sample takes about per_language rows of each language at most, chosen by
    a hash of doc_id.  None if no row is labelled.
    """
    labelled = docs.where("lang is not null and doc_id is not null").where(~held_out()).select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    got = common.arrow_map(chosen.select("lang", "text"), _sample, "lang string, grams array<int>, counts array<long>").orderBy("lang", "grams", "counts").toLocalIterator()
    rows = [(r.lang, np.array(r.grams, np.int64), np.array(r.counts, np.int64)) for r in got]
    return train(rows, **options) if rows else None


_OUTCOME = "lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id), lang_pred, score and rejected of each row of docs.

    A text that is null or has no letter, and every text without a model, is
    "und", scores 0 and is rejected; so is, with its best language and score, a
    text that scores below the model's threshold.  Only text is looked at.
    """
    keep = ["doc_id"] if keep is None else keep
    return _identified(docs, model, keep).select(*common.named(keep), "lang_pred", "score", "rejected")


def known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that identify() doesn't reject, all columns, whatever their names."""
    return _identified(docs, model, docs.columns).where("not rejected").select(*common.named(docs.columns))


def _identified(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """c0, c1, ... for the columns in keep, lang_pred, score and rejected."""
    names = keep if "text" in keep else [*keep, "text"]
    at, rows = names.index("text"), common.plain(docs, names)
    out = common.kinds(rows.select(*rows.columns[: len(keep)]), _OUTCOME)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        m = shared.value
        for batch in batches:
            for a, b in wordhash.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                letters = [has_letter(t.as_py()) for t in part.column(at)]
                best, score = m.predict(part.column(at)) if m else (np.zeros(b - a, int), np.zeros(b - a))
                fine = np.array(letters, bool) & (m is not None)
                score = np.where(fine, score, 0.0)
                lang = [m.languages[i] if f else UNKNOWN for i, f in zip(best, fine, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(~fine | (score < (m.threshold if m else 0)))], names=out.names)

    return rows.mapInArrow(each, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
