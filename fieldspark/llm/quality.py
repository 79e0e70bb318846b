"""Quality by hierarchical empirical Bayes.

A logistic classifier gives each document evidence from its text (shares of letters, capitals,
digits and signs, word and line lengths, repetition, function words). Labels are counted per host and
per path of a host. The share of good documents of a host is drawn to the global share, that of a path
to its host's, each by a Beta prior whose strength is estimated from the spread between the sites:
a site with few labels hardly moves from its prior. In log odds a document's score is its own evidence
plus what its path says beyond the global share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import bounded_sample, held_out
from .scratch import stored
from .words import SPACED, slices, text_buffer, word_bounds, word_codes

#: Labelled documents that the classifier is fitted on.
SAMPLE = 20_000
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that it for on was with as be by at this are or from "
    "der die das und in zu den mit von ist auf für ein eine nicht sich des dem "
    "le la les de des et en un une du que qui dans pour est sur par au pas "
    "el los las y del se por con para una su al lo como más"
).split()
FEATURES = (
    "log_words word_length letters capitals digits white signs high line_length "
    "distinct_words distinct_lines function_words pipes stops"
).split()

_CLASS = np.zeros((256, 8), np.float32)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)], 0] = 1
_CLASS[0x80:, 0] = 1
_CLASS[0x41:0x5B, 1] = 1
_CLASS[0x30:0x3A, 2] = 1
_CLASS[[0x20, *range(0x09, 0x0E)], 3] = 1
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()], 4] = 1
_CLASS[0x80:, 5] = 1
_CLASS[ord("|"), 6] = 1
_CLASS[[ord(c) for c in ".!?"], 7] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(codes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], float)


def features(column: pa.Array) -> np.ndarray:
    """One row per text, in the order of FEATURES; all zero without words."""
    data, offsets = text_buffer(column)
    size = np.maximum(np.diff(offsets), 1)
    share = [_sums(_CLASS[data, k], offsets) / size for k in range(8)]
    starts, ends, first = word_bounds(data, offsets, SPACED)
    codes = word_codes(data, starts, ends)
    n = np.diff(first)
    words = np.maximum(n, 1)
    lines = np.ones(256, bool)
    lines[0x0A] = False
    ls, le, lfirst = word_bounds(data, offsets, lines)
    n_lines = np.maximum(np.diff(lfirst), 1)
    listed, at = text_buffer(pa.array(FUNCTION_WORDS))
    common = np.isin(codes, word_codes(listed, at[:-1], at[1:]))
    out = np.stack(
        [
            np.log1p(n),
            _sums(ends - starts, first) / words / 10,
            *share[:6],
            np.log1p(size / n_lines),
            _distinct(codes, first) / words,
            _distinct(word_codes(data, ls, le), lfirst) / n_lines,
            _sums(common, first) / words,
            share[6],
            share[7],
        ],
        1,
    )
    return np.where(n[:, None] > 0, out, 0.0)


def _described(text: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                rows = features(part[text])
                yield part.drop_columns([text]).append_column(
                    "x", pa.array(list(rows), pa.list_(pa.float64()))
                )

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights for raw features, the last one constant; fitted on standardised ones."""
    if not len(x) or y.min() == y.max():
        return np.zeros(x.shape[1] + 1 if x.ndim == 2 else len(FEATURES) + 1)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    scale[x.std(0) < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    z = np.clip(z, -20, 20)
    hold = ridge * np.eye(z.shape[1])
    hold[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + hold, z.T @ (p - y) + hold @ w)
        w -= move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-7:
            break
    out = w.copy()
    out[:-1] = w[:-1] / scale
    out[-1] = w[-1] - (w[:-1] * mean / scale).sum()
    return out


def _strength(groups: DataFrame, prior: Column) -> float:
    """Strength of the Beta prior by moments: what the spread of shares between groups exceeds that
    of coin tosses by is the spread of the groups' own shares."""
    share = F.col("good") / F.col("n")
    rows = groups.where("n > 1").agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (share - prior) ** 2).alias("spread"),
        F.sum(prior * (1 - prior)).alias("toss"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("unit"),
    )
    r = rows.first()
    if not r.groups or not r.unit:
        return STRONGEST
    between = max(0.0, r.spread - r.toss) / r.n
    average = r.unit / r.n
    return float(min(STRONGEST, max(WEAKEST, average / between - 1))) if between > 0 else STRONGEST


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, doc_score (from the text), site_score (share of
    good documents expected of its path), score (both, 0 to 1) and predicted (1 from a score of a
    half).

    Learns from labels 0 and 1 of documents whose crc32(doc_id as text) mod 4 is not 2; of a document
    with several labels the largest counts. Null hosts and paths are sites like others; a site without
    labels has its prior. A null or empty text has the features of no words. Without labels scores are
    a half. Repeated documents give repeated rows, other columns are ignored, an empty table gives no
    rows.
    """
    rows = docs.select("doc_id", host.alias("host"), path.alias("path"), F.col(text).alias("text"))
    schema = T.StructType([*rows.drop("text").schema, T.StructField("x", T.ArrayType(T.DoubleType()))])
    described = stored(rows.mapInArrow(_described("text"), schema))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    labelled = stored(described.join(known.where(~held_out(4, 2)), "doc_id"))
    sample = bounded_sample(labelled.select("doc_id", "x", "good"), SAMPLE).collect()
    w = fit_logistic(np.array([r.x for r in sample], float), np.array([r.good for r in sample], float))
    evidence = sum((F.col("x")[k] * float(w[k]) for k in range(len(FEATURES))), F.lit(float(w[-1])))

    paths = stored(labelled.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    overall = (total.good + 1) / (total.n + 2) if total.n else 0.5
    at_host = _strength(hosts, F.lit(overall))
    hosts = hosts.select(
        "host", ((F.col("good") + at_host * overall) / (F.col("n") + at_host)).alias("host_share")
    )
    a, b = paths.alias("a"), hosts.alias("b")
    joined = a.join(b, F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.*", "host_share")
    at_path = _strength(joined, F.col("host_share"))
    sites = joined.select(
        F.col("host").alias("h"),
        F.col("path").alias("p"),
        ((F.col("good") + at_path * F.col("host_share")) / (F.col("n") + at_path)).alias("path_share"),
    )
    hosts = hosts.withColumnRenamed("host", "g")
    placed = described.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    placed = placed.join(hosts, F.col("host").eqNullSafe(F.col("g")), "left")
    site = F.coalesce("path_share", "host_share", F.lit(overall))
    logit = evidence + _logit(site) - _logit(F.lit(overall))
    scored = placed.select(
        "doc_id",
        held_out(4, 2).alias("held_out"),
        (1 / (1 + F.exp(-evidence))).alias("doc_score"),
        site.alias("site_score"),
        (1 / (1 + F.exp(-logit))).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
