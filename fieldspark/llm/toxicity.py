"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult and threat terms with a weight, targets (second persons), negations,
reporting verbs, ends of clauses. Small transducers read the symbols of a clause: one pays an insult
or threat its weight, the others keep a state that multiplies it (a target in the clause raises it; a
negation shortly before, or reported speech, lowers it). Their composition is one transducer whose
states are tuples of states; it runs over the clauses that hold a term. A text's evidence is the sum
over its clauses of the strongest payment, mapped to a probability by a logistic curve.

The terms are whole words or beginnings of words. Besides a short list of known ones they are learned
from labelled texts: candidates are terms with high log odds, of which those are taken that cover
toxic texts not covered by better ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import bounded_sample, fraction, held_out
from .scratch import received, shipped, stored
from .words import ALNUM, U64, slices, text_buffer, word_bounds, word_codes

#: Labelled texts learned from, and toxic ones among them that choose the terms.
SAMPLE, TOXIC_SAMPLE = 20_000, 4_000
#: Candidate terms, and terms in the grammar.
CANDIDATES, TERMS = 5_000, 1_000
#: Least log odds of a term, and letters of beginnings of words.
LEAST_ODDS, STEMS = 2.5, (3, 4, 5, 6)
THRESHOLD = 0.3

INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting dumpfbacke abschaum crétin ordure escoria imbécil".split()
THREATS = "kill murder strangle stab umbringen erwürgen tuer égorger matar estrangular".split()
TARGETS = "you your you're u du dich dir ihr euch sie tu te toi vous vos usted tú ti ustedes".split()
NEGATIONS = "not never no nobody isn't don't doesn't nicht nie kein keine pas jamais nunca jamás".split()
REPORTS = "said says wrote quoted reported claimed sagte schrieb berichtete dit écrit rapporte dijo escribió".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Weight of a known term, of one symbol each.
KNOWN = 4.0


@dataclass(frozen=True)
class Transducer:
    """States 0, 1, ...; ``step[state][symbol]`` is the next one (no entry: it stays), ``factor[state]``
    multiplies what is paid in it. State 0 is the start, and END leads back to it."""

    step: tuple[dict[int, int], ...]
    factor: tuple[float, ...]

    def compose(self, other: Transducer) -> Transducer:
        """Reads the same symbols with both; factors multiply."""
        n = len(other.factor)
        step = tuple(
            {
                symbol: mine.get(symbol, a) * n + theirs.get(symbol, b)
                for symbol in range(7)
                if mine.get(symbol, a) != a or theirs.get(symbol, b) != b
            }
            for a, mine in enumerate(self.step)
            for b, theirs in enumerate(other.step)
        )
        return Transducer(step, tuple(x * y for x in self.factor for y in other.factor))


AIMED = Transducer(({TARGET: 1}, {END: 0}), (1.0, 1.5))
REPORTED = Transducer(({REPORT: 1}, {END: 0}), (1.0, 0.7))
_tick = {s: 2 for s in (OTHER, INSULT, THREAT, TARGET, REPORT)}
NEGATED = Transducer(  # for the three words behind a negation
    (
        {NEGATION: 1},
        {s: 2 for s in _tick} | {NEGATION: 1, END: 0},
        {s: 3 for s in _tick} | {NEGATION: 1, END: 0},
        {s: 0 for s in _tick} | {NEGATION: 1, END: 0},
    ),
    (1.0, 0.5, 0.5, 0.5),
)
CLAUSE = AIMED.compose(REPORTED).compose(NEGATED)


def clause_evidence(symbols: list[tuple[int, int, float]], machine: Transducer = CLAUSE) -> float:
    """Sum over clauses of the strongest payment. ``symbols``: (place, symbol, weight) of all that is
    not OTHER; the words between count as OTHER. A target, or a report, anywhere in a clause holds for
    all of it, so each clause is read for them first."""
    total, i = 0.0, 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[j][1] != END:
            j += 1
        state = 0
        for _, symbol, _ in symbols[i:j]:
            if symbol in (TARGET, REPORT):
                state = machine.step[state].get(symbol, state)
        best, place = 0.0, None
        for at, symbol, weight in symbols[i:j]:
            for _ in range(min(3, at - place - 1) if place is not None else 0):
                state = machine.step[state].get(OTHER, state)
            if symbol in (INSULT, THREAT):
                best = max(best, weight * machine.factor[state])
            state, place = machine.step[state].get(symbol, state), at
        total, i = total + best, j + 1
    return total


class Grammar:
    """The lexicon as word codes, for texts in numpy arrays, and the logistic curve."""

    def __init__(self, terms: dict[tuple[str, bool], tuple[int, float]], curve: tuple[float, float]):
        """terms: (text, whether a beginning only) -> (symbol, weight)."""
        self.curve, self.tables = curve, {}
        by_size: dict[int, list] = {}
        for (text, beginning), (symbol, weight) in terms.items():
            by_size.setdefault(len(text.encode()) if beginning else 0, []).append((text, symbol, weight))
        for size, entries in sorted(by_size.items(), reverse=True):
            codes = self._codes([t for t, _, _ in entries])
            order = np.argsort(codes)
            self.tables[size] = (
                codes[order],
                np.array([s for _, s, _ in entries])[order],
                np.array([w for _, _, w in entries])[order],
            )

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        return word_codes(data, offsets[:-1], offsets[1:])

    def evidence(self, column: pa.Array) -> np.ndarray:
        data, offsets, starts, ends, first = lowered_words(column)
        out = np.zeros(len(column))
        if not len(starts):
            return out
        symbol, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
        for size, (codes, symbols, weights) in self.tables.items():
            at = np.flatnonzero(ends - starts >= size) if size else np.arange(len(starts))
            found = word_codes(data, starts[at], starts[at] + size if size else ends[at])
            place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            hit = codes[place] == found
            symbol[at[hit]], weight[at[hit]] = symbols[place[hit]], weights[place[hit]]
        paying = (symbol == INSULT) | (symbol == THREAT)
        rows = np.unique(np.searchsorted(first, np.flatnonzero(paying), "right") - 1)
        for row in rows.tolist():
            a, b = first[row], first[row + 1]
            at = a + np.flatnonzero(symbol[a:b])
            events = [(int(i), int(symbol[i]), float(weight[i])) for i in at]
            begin, end = offsets[row], offsets[row + 1]
            stops = begin + np.flatnonzero(np.isin(data[begin:end], _STOPS))
            behind = np.unique(np.searchsorted(starts[a:b], stops) + a)  # the word behind a stop
            events += [(int(i), -1, 0.0) for i in behind]
            events.sort(key=lambda e: e[:2])
            out[row] = clause_evidence([(i, END if s < 0 else s, w) for i, s, w in events])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        low, slope = self.curve
        return 1 / (1 + np.exp(-(low + slope * np.log1p(self.evidence(column)))))


_STOPS = np.frombuffer(b".!?;:\n", np.uint8)


def lowered_words(column: pa.Array):
    """Words of the lower-cased text: runs of letters and digits; signs of the Latin-1 and general
    punctuation ranges are no letters."""
    data, offsets = text_buffer(pc.utf8_lower(column.fill_null("")))
    masked = data.copy()
    for lead, length in ((0xC2, 2), (0xE2, 3)):
        for k in range(length):
            masked[np.minimum(np.flatnonzero(data == lead) + k, len(data) - 1)] = 0x20
    return (data, offsets, *word_bounds(masked, offsets, ALNUM))


def _terms_of(text: str) -> set[str]:
    """Whole words, and beginnings (marked by a dash at the end)."""
    words = set(re.findall(r"[^\W_]+", text.lower()))
    return words | {f"{w[:n]}-" for w in words for n in STEMS if len(w) > n}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        terms = list(of[0].keys() | of[1].keys())
        return pa.RecordBatch.from_pydict(
            {"term": terms, "toxic": [of[1][t] for t in terms], "clean": [of[0][t] for t in terms]},
            pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]),
        )

    of = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            of[label.as_py()].update(_terms_of(text.as_py() or ""))
            if len(of[0]) + len(of[1]) > 500_000:
                yield out()
                of = (Counter(), Counter())
    yield out()


def _covers(terms: set[str]):
    def run(batches):
        for batch in batches:
            found = [sorted(_terms_of(x.as_py() or "") & terms) for x in batch["text"]]
            yield pa.RecordBatch.from_pydict({"terms": pa.array(found, pa.list_(pa.string()))})

    return run


def _evidence(grammar):
    def run(batches):
        table = received(grammar)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"x": pa.array(table.evidence(part["text"])), "y": part["label"]})

    return run


def logistic_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, held near (-3, 2) where labels are few."""
    prior, strength = np.array([-3.0, 2.0]), 0.5
    design, beta = np.stack([np.ones_like(x), x], 1), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (p - y) + strength * (beta - prior)
        curve = (design * (p * (1 - p))[:, None]).T @ design + strength * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta = beta - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.1))


def learn(docs: DataFrame, labels: DataFrame, left_out: Column, text: str = "text") -> Grammar:
    """Learns a grammar from labelled documents that are not held out: from ``SAMPLE`` of them at
    most, those with the smallest hash of doc_id. Of rows with the same doc_id the least text counts.
    Without labels the known terms and a standing curve remain."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = bounded_sample(known.where(~left_out), SAMPLE)
    # the broadcast is bounded by SAMPLE
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    train = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").cast("int").alias("label"))
    train = stored(train)  # SAMPLE rows at most, read four times below
    n_toxic, n_clean = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    counted = train.mapInArrow(_counts, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    candidates = (
        counted.where("toxic >= 3")
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "term")
        .limit(CANDIDATES)
        .collect()
    )
    weights = {r["term"]: r["odds"] for r in candidates}
    toxic = train.where("label = 1").orderBy(fraction("doc_id"), "doc_id").limit(TOXIC_SAMPLE)
    toxic = toxic.mapInArrow(_covers(set(weights)), "terms array<string>")
    texts = sorted(tuple(r.terms) for r in toxic.collect())
    taken = _cover(texts, weights)
    terms = {(t.rstrip("-"), t.endswith("-")): (INSULT, w) for t, w in taken.items()}
    counts = {r["term"]: (r["toxic"], r["clean"]) for r in counted.where(F.col("term").isin(INSULTS + THREATS)).collect()}
    for symbol, listed in ((INSULT, INSULTS), (THREAT, THREATS)):
        for t in listed:
            a, b = counts.get(t, (0, 0))
            weight = KNOWN + math.log((a + 1) / (n_toxic + 2)) - math.log((b + 1) / (n_clean + 2)) if a + b else KNOWN
            if weight > 1 and (t, False) not in terms:
                terms[t, False] = (symbol, weight)
    for symbol, listed in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        for t in listed:
            terms.setdefault((t, False), (symbol, 0.0))
    draft = shipped(docs.sparkSession, Grammar(terms, (0.0, 1.0)))
    rows = train.mapInArrow(_evidence(draft), "x double, y int").collect()  # SAMPLE numbers
    x, y = np.log1p([r.x for r in rows]), np.array([r.y for r in rows], float)
    return Grammar(terms, logistic_curve(x, y) if len(rows) else (-3.0, 2.0))


def _cover(texts: list[tuple[str, ...]], weights: dict[str, float]) -> dict[str, float]:
    """Terms that cover the texts: the one that covers most weight of uncovered texts next, until it
    would cover less than three texts or a five-hundredth of them."""
    least = max(3, len(texts) / 500)
    distinct = Counter(texts)
    where: dict[str, list[int]] = {}
    of = list(distinct)
    for i, terms in enumerate(of):
        for t in terms:
            where.setdefault(t, []).append(i)
    gain = {t: len(rows) for t, rows in where.items()}
    covered, taken = [False] * len(of), {}
    while gain and len(taken) < TERMS:
        best = max(gain, key=lambda t: (gain[t] * weights[t], -len(t), t))
        if gain[best] < least:
            break
        taken[best] = weights[best]
        for i in where[best]:
            if not covered[i]:
                covered[i] = True
                for t in of[i]:
                    if t in gain:
                        gain[t] -= 1
        del gain[best]
    return taken


def _scored(grammar, text: str, mode: str):
    def run(batches):
        table = received(grammar)
        for batch in batches:
            for part in slices(batch, text):
                score = table.scores(part[text])
                if mode == "clean":
                    yield part.filter(pa.array(score < THRESHOLD))
                else:
                    yield part.drop_columns([text]).append_column("score", pa.array(score))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from a score
    of 0.3).

    A null or empty text has the score of a text without evidence. Labels other than 0 and 1, or
    without doc_id, are ignored; a document labelled both is toxic. Repeated documents give repeated
    rows, other columns are ignored, an empty table gives no rows.
    """
    grammar = shipped(docs.sparkSession, learn(docs, labels, held_out(4, 2), text))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    rows = docs.select("doc_id", text).mapInArrow(_scored(grammar, text, "score"), schema)
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return rows.select("doc_id", held_out(4, 2).alias("held_out"), "score", predicted.alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    grammar = shipped(docs.sparkSession, learn(docs, labels, held_out(4, 2), text))
    return docs.mapInArrow(_scored(grammar, text, "clean"), docs.schema)
