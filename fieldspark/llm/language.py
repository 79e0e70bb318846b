"""Language identification with a string kernel.

Two texts are as alike as the sets of byte n-grams (lengths 1 to ``SPECTRUM``, of lower-cased text
with everything but letters as one space) that they have in common: the blended-spectrum presence
kernel, scaled by the sizes of the sets. N-grams are hashed into ``BUCKETS``. Landmark texts span a
Nyström approximation: with K the kernel between landmarks, a text with kernel values k to them has
the features k K^(-1/2). Kernel ridge regression on these, one language against the rest, is a matrix
from landmarks to languages; texts are scored by two matrix products per batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, sample_of_each
from .scratch import received, shipped, stored
from .words import slices, text_buffer

SPECTRUM, BUCKETS = 4, 1 << 14
#: Training texts per language; landmarks per language, and of all languages together.
TRAIN, LANDMARKS, ALL_LANDMARKS = 1_000, 40, 2_000
#: Chosen ids that are broadcast; more of them meet the documents in an ordinary join.
BROADCAST = 1_000_000
RIDGE = 1e-2
#: Rows scored by one product.
ROWS = 128
UNKNOWN = "und"

_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[:0x61] = _LETTER[0x7B:0x80] = 0x20


def presence(column: pa.Array) -> np.ndarray:
    """One row per text: 1 for each bucket with an n-gram of the text."""
    data, offsets = text_buffer(pc.utf8_lower(column.fill_null("")))
    data = _LETTER[data].astype(np.uint64)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    space = data == 0x20
    repeated = np.zeros(len(data), bool)
    repeated[1:] = space[1:] & space[:-1] & (row[1:] == row[:-1])
    data, row = data[~repeated], row[~repeated]
    out = np.zeros((len(column), BUCKETS), np.float32)
    gram = np.zeros(len(data), np.uint64)
    for n in range(1, SPECTRUM + 1):
        if len(data) < n:
            break
        gram = gram[: len(data) - n + 1] * np.uint64(256) + data[n - 1 :]
        inside = row[: len(gram)] == row[n - 1 :]
        slot = ((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        out[row[: len(gram)][inside], slot[inside].astype(np.int64)] = 1
    return out


def kernel(texts: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Common n-grams over the geometric mean of the sizes; texts and landmarks as presence rows."""
    sizes = np.sqrt(np.maximum(texts.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))
    return (texts @ landmarks.T) / sizes


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language and a share in (0, 1) of each text."""
        low = pc.fill_null(column, "")
        letters = pc.match_substring_regex(low, r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        value = kernel(presence(column), self.landmarks) @ self.weights
        value = np.exp(4 * (value - value.max(1, keepdims=True)))
        best = value.argmax(1)
        share = value[np.arange(len(best)), best] / value.sum(1)
        names = [self.languages[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters, strict=True)]
        return names, np.where(letters, share, 0.0)


def whitening(landmarks: np.ndarray) -> np.ndarray:
    """K^(-1/2) of the kernel between landmarks."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    values = np.maximum(values, 1e-6 * values.max())
    return (vectors / np.sqrt(values)) @ vectors.T


def fit(landmarks: np.ndarray, root: np.ndarray, sums: np.ndarray, languages: list[str], rows: int) -> Model:
    """``sums``: z'z and behind it z'y over the ``rows`` training texts, each weighted by its language."""
    m = len(landmarks)
    gram = sums[:, :m] + RIDGE * np.eye(m) * max(1, rows) / 100
    return Model(languages, landmarks, (root @ np.linalg.solve(gram, sums[:, m:])).astype(np.float32))


def _pieces(batch: pa.RecordBatch, text: str):
    for part in slices(batch, text):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def _packed(batches):
    for batch in batches:
        for part in _pieces(batch, "text"):
            bits = np.packbits(presence(part["text"]).astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_pydict(
                {"lang": part["lang"], "bits": pa.array([x.tobytes() for x in bits], pa.binary())}
            )


def _sums(shipped_base):
    """The rows of z'z and z'y over the texts of a task."""

    def run(batches):
        bits, root, languages, weights = received(shipped_base)
        base = np.unpackbits(bits, axis=1).astype(np.float32)
        at = {name: k for k, name in enumerate(languages)}
        m, total = len(base), None
        for batch in batches:
            for part in _pieces(batch, "text"):
                own = np.array([at[x] for x in part["lang"].to_pylist()], np.int64)
                z = kernel(presence(part["text"]), base).astype(np.float64) @ root
                target = np.full((len(own), len(languages)), -1.0)
                target[np.arange(len(own)), own] = 1.0
                weighted = z.T * weights[own]
                if total is None:
                    total = np.zeros((m, m + len(languages)))
                total[:, :m] += weighted @ z
                total[:, m:] += weighted @ target
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array([x.tobytes() for x in total], pa.binary())], ["i", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in sorted(table["sums"].to_pylist()))
    return pa.table({"i": table["i"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fits on at most ``TRAIN`` documents of every language, of those that have text and language and are
    not held out. Of rows with the same doc_id one counts, that with the least language and text. Each language has ``LANDMARKS``
    landmarks, fewer (but one) where there would be more than ``ALL_LANDMARKS``. What the driver gets grows with the
    number of languages, not of texts."""
    spark = docs.sparkSession
    known = docs.where(~held_out(4, 2) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    known = known.groupBy("doc_id").agg(F.min(lang).alias("lang"))
    chosen = sample_of_each(known, "lang", TRAIN, known.groupBy("lang").count())
    chosen = stored(chosen.select(F.col("doc_id").alias("id")))
    ids = F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("id"))).select(
        "doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    rows = rows.where("text is not null and lang is not null")
    least = F.min(F.struct("lang", "text")).alias("least")
    rows = stored(rows.groupBy("doc_id").agg(least).select("doc_id", "least.*"))  # read three times below
    counts = rows.groupBy("lang").count()
    share = {r.lang: r["count"] for r in counts.collect()}
    languages = sorted(share)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0), np.float32))
    each = max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))
    base = sample_of_each(rows, "lang", each, counts)
    base = base.select("text", "lang").mapInArrow(_packed, "lang string, bits binary").orderBy("lang", "bits").collect()
    bits = np.stack([np.frombuffer(r.bits, np.uint8) for r in base])
    landmarks = np.unpackbits(bits, axis=1).astype(np.float32)
    root, total = whitening(landmarks), sum(share.values())
    weights = np.array([total / (len(languages) * share[x]) for x in languages])
    task = shipped(spark, (bits, root, languages, weights))
    sums = rows.select("text", "lang").mapInArrow(_sums(task), "i long, sums binary")
    sums = sums.groupBy("i").applyInArrow(_added, "i long, sums binary").collect()
    by_row = {r.i: np.frombuffer(r["sums"], np.float64) for r in sums}
    return fit(landmarks, root, np.stack([by_row[i] for i in range(len(bits))]), languages, total)


def _identified(model, text: str):
    def run(batches):
        fitted = received(model)
        for batch in batches:
            for part in _pieces(batch, text):
                names, share = fitted.score(part[text])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part["doc_id"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(share, pa.float64())}
                )

    return run


def languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred and score (0 to 1).

    A null text, or one without a letter, is ``und`` with score 0, as is every text if there is
    nothing to learn from. Repeated documents give repeated rows, other columns are ignored, an empty
    table gives no rows.
    """
    model = shipped(docs.sparkSession, train(docs, text, lang))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    out = docs.select("doc_id", text).mapInArrow(_identified(model, text), schema)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
