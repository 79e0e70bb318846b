"""Language-model scores of whole documents.

Token counts are gathered over all training documents. The most frequent words are symbols of a gated
recurrent network (gru.py); other words belong to classes by their last bytes, whose probability the
network gives, and within their class are as likely as their counts say, a class's unknown words being
one word. The network learns from all training documents: in each round tasks go on from the same
parameters, each with its own documents of the round, and the means of what they come to, weighted by
their tokens, are the parameters of the next round. A document's score is the log probability of its words and its end, the network's state going
through the whole text.

Executors get the counts of a bounded number of words. The counts of rarer ones are joined: each
document keeps its rare words, which meet their counts in a shuffle by word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gru import LANES, RATE, STEPS, Network
from .samples import fraction, held_out
from .scratch import received, shipped, stored
from .words import LOWER, SPACED, U64, mix, slices, text_buffer, word_bounds, word_codes

#: Words that the network knows, classes of other words, and words whose counts are broadcast.
WORDS, OTHERS, COUNTED = 2_047, 32, 1 << 20
#: Tokens from which one pass over all training documents is enough, passes over fewer, and rounds.
ENOUGH, PASSES, ROUNDS = 2_000_000, 5, 8
#: Tokens of a task in a round (at least, where there are so many), most lanes, parameters in a row of a task.
TASK, MOST_LANES, ROW = 500_000, 256, 4_096
#: Tokens counted at once in a task.
AT_ONCE = 2_000_000
#: Code of the end of a text; no word has its own end's class.
END = 0


def tokens(column: pa.Array):
    """Codes and classes of the words of all texts, each text followed by the end; first tokens."""
    data, offsets = text_buffer(column)
    starts, ends, first = word_bounds(data, offsets, SPACED)
    codes = np.maximum(word_codes(data, starts, ends), U64(1))
    last = LOWER[data[ends - 1]].astype(np.uint64)
    other = np.where(ends - starts > 1, LOWER[data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
    classes = (mix(last * U64(256) + other) % U64(OTHERS)).astype(np.int64)
    at = first[1:]
    return np.insert(codes, at, U64(END)), np.insert(classes, at, 0), first + np.arange(len(first))


def _counted(batches):
    def out(codes, classes):
        code, at, n = np.unique(np.concatenate(codes), return_index=True, return_counts=True)
        return pa.RecordBatch.from_pydict(
            {"code": code.view(np.int64), "class": np.concatenate(classes)[at], "c": n.astype(np.int64)}
        )

    codes, classes, held = [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            c, k, _ = tokens(part["text"])
            codes.append(c)
            classes.append(k)
            held += len(c)
            if held >= AT_ONCE:
                yield out(codes, classes)
                codes, classes, held = [], [], 0
    if held:
        yield out(codes, classes)


class Counts:
    """Counts of words by code, found through the first bits of the code."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, symbols: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts, self.symbols = codes[order], counts[order], symbols[order]
        self.bits = max(4, int(len(codes)).bit_length() + 1)
        edge = np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)
        self.start = np.searchsorted(self.codes, edge[:-1].astype(np.uint64)).astype(np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes, -1 for those without."""
        out = np.full(len(codes), -1, np.int64)
        if not len(self.codes):
            return out
        at = self.start[(codes >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        left = np.arange(len(codes))
        while len(left):
            inside = at < len(self.codes)
            left, at = left[inside], at[inside]
            here, wanted = self.codes[at], codes[left]
            same = here == wanted
            out[left[same]] = at[same]
            later = here < wanted
            left, at = left[later], at[later] + 1
        return out


class Model:
    """Counts, totals of the classes, and the network."""

    def __init__(self, counts: Counts, class_total: np.ndarray, total: int, kinds: int, network: Network):
        self.counts, self.class_total, self.total, self.kinds, self.network = counts, class_total, total, kinds, network
        self.learned = 0  # tokens that the network has learned from, those of each pass

    def symbols(self, place: np.ndarray, classes: np.ndarray) -> np.ndarray:
        known = np.where(place >= 0, self.counts.symbols[np.maximum(place, 0)] if len(self.counts.codes) else -1, -1)
        return np.where(known >= 0, known, self.network.words + classes)

    def score(self, column: pa.Array) -> dict:
        """Per text: numbers of tokens and known ones, and sums that lack the words not counted here."""
        codes, classes, first = tokens(column)
        place = self.counts.find(codes)
        here = place >= 0
        weight = np.zeros(len(codes))
        if here.any():
            weight[here] = np.log10(self.counts.counts[place[here]] + 0.1)
        symbols = self.symbols(place, classes)
        by_class = symbols >= self.network.words
        within = np.where(by_class, weight - np.log10(self.class_total[classes]), 0.0)
        owner = np.repeat(np.arange(len(column)), np.diff(first))
        sums = lambda x: np.bincount(owner, x, minlength=len(column))
        rest, rest_n = [], []
        missing = np.flatnonzero(~here)
        edge = np.searchsorted(missing, first)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            code, n = np.unique(codes[missing[a:b]], return_counts=True)
            rest.append(code.view(np.int64))
            rest_n.append(n)
        n_tokens = np.diff(first)
        base = sums(weight) - n_tokens * math.log10(self.total + 0.1 * (self.kinds + 1))
        score = self.network.score(symbols, first) / math.log(10) + sums(within)
        return {
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(sums(here.astype(float)).astype(np.int64), pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()),
            "rest": pa.array(rest, pa.list_(pa.int64())),
            "rest_n": pa.array(rest_n, pa.list_(pa.int64())),
        }


def _most_frequent(counts: DataFrame) -> DataFrame:
    """The words that occur at least as often as a bound set such that COUNTED of them at most do, and
    the end. The bound comes from the numbers of words by (rounded) frequency."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    bound, held = None, 1
    for r in levels:
        held += r["count"]
        if held > COUNTED:
            break
        bound = r["level"]
    kept = F.col("code") == END
    return counts.where(kept if bound is None else kept | (level >= bound))


def _taught(model, state, lanes: int, rate: float):
    """Rows of the parameters that a task comes to, with its tokens and steps."""

    def run(batches):
        fitted, (values, turn) = received(model), received(state)
        network = fitted.network
        network.set_flat(values, turn)

        def blocks():
            for batch in batches:
                for part in slices(batch, "text"):
                    codes, classes, first = tokens(part["text"])
                    yield fitted.symbols(fitted.counts.find(codes), classes), first

        if seen := network.train(blocks(), lanes, rate):
            values = network.flat()
            for k, a in enumerate(range(0, len(values), ROW)):
                row = {"part": [k], "seen": [seen], "turn": [network.turn], "x": [values[a : a + ROW]]}
                types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(row.items(), types, strict=True)})

    return run


def _summed(batches):
    """The sums of the rows of each part, weighted by their tokens."""
    sums: dict[int, list] = {}
    for batch in batches:
        for part, seen, turn, x in zip(*(batch[c] for c in ("part", "seen", "turn", "x")), strict=True):
            held = sums.setdefault(part.as_py(), [0, 0, 0.0])
            n = seen.as_py()
            held[0] += n
            held[1] += n * turn.as_py()
            held[2] = held[2] + n * x.values.to_numpy().astype(np.float64)
    for part, (seen, turn, x) in sums.items():
        row = {"part": pa.array([part], pa.int32()), "seen": pa.array([seen], pa.int64())}
        row |= {"turn": pa.array([turn / seen], pa.float64()), "x": pa.array([x], pa.list_(pa.float64()))}
        yield pa.RecordBatch.from_pydict(row)


def teach(docs: DataFrame, model: Model, total: int) -> int:
    """Trains the network on all texts of ``docs``, which have ``total`` tokens; tokens learned from.

    Up to ENOUGH tokens are gone through several times. Each pass is cut by hash into rounds, so that the
    tasks' parameters meet often, and every document is in one round of each pass."""
    passes = min(PASSES, max(1, -(-ENOUGH // max(1, total))))
    parts = -(-ROUNDS // passes)
    tasks = max(1, total // parts // TASK)
    lanes = min(MOST_LANES, max(LANES, total // parts // tasks // (STEPS * 128)))
    spark, network, learned = docs.sparkSession, model.network, 0
    sent = shipped(spark, model)
    for k in range(passes * parts):
        state = shipped(spark, (network.flat(), network.turn))
        rows = docs.where(F.floor(fraction("doc_id", "text") * parts) == k % parts).select("text").coalesce(tasks)
        taught = _taught(sent, state, lanes, RATE * (1 - k / (passes * parts)))
        met = rows.mapInArrow(taught, "part int, seen long, turn long, x array<float>")
        met = met.withColumn("task", F.spark_partition_id()).repartition("part").sortWithinPartitions("part", "task")
        sums = met.drop("task").mapInArrow(_summed, "part int, seen long, turn double, x array<double>").toArrow()
        sums = sums.sort_by("part")
        if sums.num_rows:
            seen = sums["seen"][0].as_py()
            values = sums["x"].combine_chunks().values.to_numpy()
            network.set_flat(values / seen, round(sums["turn"][0].as_py()))
            learned += seen
        state.destroy()
    sent.destroy()
    return learned


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts (code, class, c) of all words of the training documents ``docs``
    (doc_id, text)."""
    found = docs.select("text").mapInArrow(_counted, "code long, class long, c long")
    counts = stored(found.groupBy("code", "class").agg(F.sum("c").alias("c")))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _most_frequent(counts).toArrow().to_pandas()
    top = top.assign(first=top["code"] != END).sort_values(["first", "c", "code"], ascending=[True, False, True])
    words = min(len(top), WORDS + 1)
    codes = top["code"].to_numpy(np.int64).view(np.uint64)
    symbols = np.where(np.arange(len(top)) < words, np.arange(len(top)), -1)
    table = Counts(codes, top["c"].to_numpy(np.int64), symbols)
    sums = np.zeros((OTHERS, 2))
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        sums[r["class"]] = r.c, r.n
    head = top.iloc[:words]
    np.subtract.at(sums, head["class"].to_numpy(np.int64), np.stack([head["c"], np.ones(words)], 1))
    class_total = sums[:, 0] + 0.1 * (sums[:, 1] + 1)
    words = max(words, 1)  # the end is a symbol even if there is nothing to learn from
    frequency = np.zeros(words + OTHERS)
    frequency[: len(head)] = head["c"]
    frequency[words:] = sums[:, 0]
    model = Model(table, class_total, total, kinds, Network(words, OTHERS, 0, frequency))
    known = Counts(codes[:words], head["c"].to_numpy(np.int64), symbols[:words])
    if total:
        model.learned = teach(docs, Model(known, class_total, total, kinds, model.network), total)
    model.network.forget()
    return model, counts


def _scored(model):
    def run(batches):
        fitted = received(model)
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"]} | fitted.score(part["text"]))

    return run


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10 probabilities of the text with its end, under word frequencies and under the model).

    Learns from documents whose crc32(doc_id as text) mod 10 is not 0. A null text is an empty one: its
    only token is the end. Repeated documents give repeated rows and are counted as often. Other columns
    are ignored, an empty table gives no rows; with nothing to learn from every token is unknown.
    """
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    model, counts = fit(docs.where(~held_out(10, 0)))
    sent = shipped(docs.sparkSession, model)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, "
        "score double, rest array<long>, rest_n array<long>"
    )
    rows = stored(docs.mapInArrow(_scored(sent), schema).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x"))
    rare = rare.select("row", F.col("x.rest").alias("code"), F.col("x.rest_n").alias("n"))
    met = rare.join(counts.select("code", "c"), "code", "left")
    c = F.coalesce("c", F.lit(0))
    more = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(c + F.lit(0.1))).alias("weight"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
    )
    weight = F.coalesce("weight", F.lit(0.0))
    return rows.join(more, "row", "left").select(
        "doc_id",
        held_out(10, 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + weight).alias("base_score"),
        (F.col("score") + weight).alias("score"),
    )
