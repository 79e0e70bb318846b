"""N-gram Jaccard join with parity sketches.

A document's set of word shingles is XOR-hashed into bit sketches: each shingle flips one bit, so
the Hamming distance of two sketches is at most the symmetric difference of the sets. Two sets of
sizes a and b reach the similarity s = num/den only if they differ in no more than
d = (a + b)(den - num)/(den + num) shingles.

1. *Size bands.* Sizes are cut into bands; for a pair the band of the larger set decides. A set also
   takes part in a higher band whose sizes are within the ratio s.
2. *Pigeonhole.* In a band with bound d the hash space is cut into d + 1 + spare segments. One sketch
   word per segment (the XOR of the codes of the shingles that fall into it) agrees for at least
   1 + spare segments of a similar pair. Sets meet on equal words.
3. *Frequent words* (empty segments, shared passages) would bring together sets that have little in
   common. A word is frequent for all sets or for none; a set skips its frequent words if they are
   no more than the spare ones, as another agreeing word is left then. A set with more of them (one
   of a large group of near copies) keeps them all, so no pair is lost.
4. *Verification.* Candidates pass the Hamming bound of a bit sketch as long as the set, then the
   sets themselves are intersected.
5. *No pairs within groups.* Of the sets that share a word, each is first compared with one hub, the
   set that agrees most with others. Linked sets are merged into components. The last round takes
   sets of different components that share a word; the join's own condition holds the size ratio
   and the Hamming bound of a 1024-bit sketch, so it gives out near pairs only.

Sets are known by a 64-bit hash; equal sets are one set from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .scratch import stored, whole_row
from .words import SPACED, U64, mix, slices, words

#: Ratio of the sizes at the ends of a size band.
BAND_RATIO = 1.4
#: A sketch word shared by more sets is frequent.
FREQUENT = 64
#: Words are counted in 2^SLOT_BITS slots. The words of a slot with more than CROWDED rows and twice
#: the mean of the slots are brought together by another plan, of the same result, that splits them.
SLOT_BITS, CROWDED = 16, 100_000
#: Longs of the short bit sketch.
FOLDED = 16
#: Rounds with hubs before all remaining pairs are compared.
HUB_ROUNDS = 2
#: A task forgets which sets it has seen beyond so many.
SEEN = 1 << 20


class Bands:
    """The size bands for a similarity, their bounds and segments."""

    def __init__(self, num: int, den: int, largest: int):
        self.low, self.num, self.den = [1], num, den
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, int(np.ceil(self.low[-1] * BAND_RATIO))))
        top = np.array(self.low[1:]) - 1
        self.bound = 2 * top * (den - num) // (den + num)
        self.spare = 2 + self.bound // 5
        self._cuts: dict[int, np.ndarray] = {}

    def of(self, size: int) -> list[int]:
        """The band of a size, and higher ones with larger partners; none where only equal sets
        reach the similarity."""
        band = int(np.searchsorted(self.low, size, "right")) - 1
        found = [band]
        while band + 1 < len(self.bound) and self.den * size >= self.num * self.low[band + 1]:
            band += 1
            found.append(band)
        return [b for b in found if self.bound[b] > 0]

    def segments(self, band: int) -> np.ndarray:
        if band not in self._cuts:
            n = int(self.bound[band] + 1 + self.spare[band])
            self._cuts[band] = np.array([k * (1 << 64) // n for k in range(1, n)], U64)
        return self._cuts[band]

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Sketch words of a sorted set in all its bands. The lowest byte is the band."""
        running = np.zeros(len(codes) + 1, U64)
        np.bitwise_xor.accumulate(mix(codes), out=running[1:])
        out = []
        for band in self.of(len(codes)):
            cuts = self.segments(band)
            at = np.concatenate(([0], np.searchsorted(codes, cuts), [len(codes)]))
            word = running[at[1:]] ^ running[at[:-1]]
            place = mix(np.arange(len(word), dtype=U64) + U64(band << 40))
            out.append(mix(word + place) & ~U64(255) | U64(band))
        return np.concatenate(out) if out else np.zeros(0, U64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted codes of its distinct shingles."""
    codes, first = words(column, SPACED)
    step = U64(0x9E3779B97F4A7C15)
    rolled = codes.copy()
    for k in range(1, width):
        rolled[:-k] = rolled[:-k] * step + codes[k:] if len(codes) > k else rolled[:-k]
    rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = U64(b - a)
            for code in codes[a:b]:
                short = mix(np.array([short]) * step + code)[0]
            yield np.array([short], U64)
        else:
            yield np.zeros(0, U64)


def set_code(codes: np.ndarray) -> int:
    n = np.array([len(codes)], U64)
    return int(mix(mix(codes).sum(dtype=U64) + mix(n))[0].view(np.int64))


def bit_sketch(codes: np.ndarray) -> bytes:
    """One bit per shingle, flipped; as many bits as the next power of two, 64 at least."""
    bits = max(6, int(len(codes)).bit_length())
    flips = np.bincount((codes >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def folded_sketch(codes: np.ndarray) -> np.ndarray:
    flips = np.bincount((codes >> U64(54)).astype(np.int64), minlength=64 * FOLDED)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer sketch is folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(v, np.uint8) for v in (a, b)), key=len)
    y = np.unpackbits(y)
    while len(y) > 8 * len(x):
        y = y[0::2] ^ y[1::2]
    return int((np.unpackbits(x) ^ y).sum())


def _sets(width: int, text: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = list(shingle_sets(part[text], width))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part["doc_id"],
                        "n": pa.array([len(x) for x in found], pa.int64()),
                        "id": pa.array([set_code(x) for x in found], pa.int64()),
                        "sketch": pa.array([bit_sketch(x) for x in found], pa.binary()),
                        "folded": pa.array([folded_sketch(x) for x in found], pa.list_(pa.int64())),
                    }
                )

    return run


def _keys(width: int, text: str, bands: Bands):
    def run(batches):
        seen: set[int] = set()  # copies within a task give no further rows
        for batch in batches:
            for part in slices(batch, text):
                ids, keys = [], []
                for codes in shingle_sets(part[text], width):
                    if len(codes) and (code := set_code(codes)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(code)
                        keys.append(bands.keys(codes))
                        ids.append(np.full(len(keys[-1]), code, np.int64))
                if ids:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": np.concatenate(keys).view(np.int64),
                            "id": np.concatenate(ids),
                        }
                    )

    return run


def _members(width: int, text: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = list(shingle_sets(part[text], width))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([set_code(x) for x in found], pa.int64()),
                        "codes": pa.array([x.tobytes() for x in found], pa.binary()),
                    }
                )

    return run


def _within_bound(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = [
                sketch_distance(x, y) * (den + num) <= (n + m) * (den - num)
                for x, y, n, m in zip(
                    batch["sa"].to_pylist(), batch["sb"].to_pylist(), batch["na"].to_pylist(), batch["nb"].to_pylist(), strict=True
                )
            ]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _linked(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["ca"], batch["cb"], strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


class _Verifier:
    """Verifies candidate pairs (a, b) of set ids against the texts."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, num: int, den: int, text: str):
        self.docs, self.sets, self.width, self.num, self.den, self.text = docs, sets, width, num, den, text

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs within the Hamming bound."""
        of = self.sets.groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("s"))
        a, b = (of.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
        joined = pairs.join(a, "a").join(b, "b")
        joined = joined.where(F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num)
        return stored(joined.mapInArrow(_within_bound(self.num, self.den), "a long, b long"))

    def members(self, pairs: DataFrame) -> DataFrame:
        """(id, codes) of the sets in the pairs; one document of each is read."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = stored(
            self.sets.join(ids, "id", "left_semi").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
        )
        docs = self.docs.select("doc_id", F.col(self.text).alias("text"))
        found = docs.join(wanted.where("id is not null").select("doc_id"), "doc_id", "left_semi").unionByName(
            docs.where("doc_id is null")
        )
        found = found.mapInArrow(_members(self.width, "text"), "id long, codes binary")
        return found.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.first("codes").alias("codes"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        near = self.near(pairs)
        members = stored(self.members(near))
        a, b = (members.select(F.col("id").alias(x), F.col("codes").alias(f"c{x}")) for x in "ab")
        joined = near.join(a, "a").join(b, "b").select("a", "b", "ca", "cb")
        return stored(joined.mapInArrow(_linked(self.num, self.den), "a long, b long"))


def _of_ordinary_words(rows: DataFrame) -> DataFrame:
    """(key, id, shared) of the words that several sets have: one exchange by the word."""
    of_word = Window.partitionBy("key")
    met = (
        rows.withColumn("least", F.min("id").over(of_word))
        .withColumn("most", F.max("id").over(of_word))
        .withColumn("shared", F.count("*").over(of_word))
        .where("least != most")
    )
    return stored(met.groupBy("key", "id").agg(F.first("shared").alias("shared")))


def _of_hot_words(rows: DataFrame) -> DataFrame:
    """The same where a word may have any number of sets: spread by word and set, counted in part
    before each exchange, and joined below a write, where Spark can split a word's rows."""
    cells = stored(rows.groupBy("key", "id").agg(F.count("*").alias("n")))
    counts = cells.groupBy("key").agg(F.sum("n").alias("shared"), F.count("*").alias("sets")).where("sets > 1")
    return stored(cells.join(counts, "key").select("key", "id", "shared"))


def _meetings(docs: DataFrame, bands: Bands, width: int, text: str) -> DataFrame:
    """(key, id, shared): the sketch words that a set shares with others and has to be compared on."""
    rows = stored(docs.select(F.col(text).alias("text")).mapInArrow(_keys(width, "text", bands), "key long, id long"))
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    counts = stored(rows.groupBy(slot.alias("slot")).count())
    mean = (counts.agg(F.sum("count")).first()[0] or 0) / (1 << SLOT_BITS)
    # fewer than half of the slots have twice the mean: a bounded list
    hot = stored(counts.where(F.col("count") > max(CROWDED, 2 * mean)).select("slot"))
    met = _of_ordinary_words(rows.withColumn("slot", slot).join(F.broadcast(hot), "slot", "left_anti"))
    if not hot.isEmpty():
        met = met.unionByName(_of_hot_words(rows.withColumn("slot", slot).join(F.broadcast(hot), "slot", "left_semi")))
    spare = F.array(*[F.lit(int(x)) for x in bands.spare])
    frequent = F.col("shared") > FREQUENT
    band = F.col("key").bitwiseAND(F.lit(255))
    keeps = (
        met.groupBy("id", band.alias("band"))
        .agg(F.count_if(frequent).alias("n"))
        .where(F.col("n") > F.element_at(spare, F.col("band").cast("int") + 1))
        .select("id", "band")
    )
    kept = met.where(frequent).withColumn("band", band).join(keeps, ["id", "band"], "left_semi")
    return stored(met.where(~frequent).unionByName(kept.select("key", "id", "shared")))


def _near_pairs(at: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of sets of different components with a common word, within the bounds of size
    and of the short sketch."""
    short = sets.groupBy("id").agg(F.first("n").alias("n"), F.first("folded").alias("f"))
    short = short.select("id", "n", *[F.col("f")[k].alias(f"f{k}") for k in range(FOLDED)])
    rows = stored(at.select("key", "id", "component").join(short, "id"))
    a, b = (rows.select(*[F.col(c).alias(f"{x}_{c}") for c in rows.columns]) for x in "ab")
    differ = sum(
        (F.bit_count(F.col(f"a_f{k}").bitwiseXOR(F.col(f"b_f{k}"))) for k in range(1, FOLDED)),
        F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))),
    )
    size, larger, smaller = F.col("a_n") + F.col("b_n"), F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
    near = (smaller * den >= larger * num) & (differ * (den + num) <= size * (den - num))
    apart = (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component"))
    return a.join(b, (F.col("a_key") == F.col("b_key")) & apart & near).select(
        F.col("a_id").alias("x"), F.col("b_id").alias("y")
    )


def jaccard_components(
    docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, text: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles (size of its set of distinct
    ``width``-word shingles) and component_id (smallest doc_id among the documents reachable over
    links; two documents link when den * intersection >= num * union).

    A text of fewer words is one shingle; a null text or one without words has none, and the
    document is linked with nothing: its component is itself. Repeated rows are rows of one set. A
    null doc_id takes part, but is no component's name unless the component has no other.
    """
    of = _of_components(docs, width, num, den, text)
    return of.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _of_components(docs: DataFrame, width: int, num: int, den: int, text: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, id of its set, component (a set's id) and component_id."""
    if not 2 * num > den > num > 0:
        raise ValueError("the similarity has to be between a half and one")
    docs = docs.select("doc_id", F.col(text).alias("text"))
    sets = stored(docs.mapInArrow(_sets(width, "text"), "doc_id long, n long, id long, sketch binary, folded array<long>"))
    largest = sets.agg(F.max("n")).first()[0] or 0
    filled = sets.where("n > 0")
    met = _meetings(docs, Bands(num, den, largest), width, "text")
    verifier = _Verifier(docs, filled, width, num, den, "text")
    links = None
    for step in range(HUB_ROUNDS + 1):
        if links is not None:
            of = components(links).select(F.col("node").alias("id"), "component")
            at = met.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
            several = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
            at = stored(at.join(several, "key", "left_semi"))
        else:
            at = met.withColumn("component", F.col("id"))
        if step < HUB_ROUNDS:
            weight = at.groupBy("id").agg(F.sum("shared").alias("weight"))
            hubs = at.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id", "component")).alias("hub"))
            pairs = at.join(hubs, "key").where("hub.component != component").select(F.col("hub.id").alias("x"), F.col("id").alias("y"))
        else:
            pairs = _near_pairs(at, filled, num, den)
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = verifier.linked(pairs)
        links = found if links is None else links.unionByName(found)
    of = components(links).select(F.col("node").alias("id"), "component")
    named = sets.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "component", "left")
    name = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n", "id", "component", name.alias("component_id"))


def _with_set(width: int, text: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                codes = [set_code(x) for x in shingle_sets(part[text], width)]
                yield part.append_column("set", pa.array(codes, pa.int64()))

    return run


def one_of_each(docs: DataFrame, text: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest doc_id; all columns stay. Of rows
    of one component that share this doc_id one is kept, that with the least text; texts without words
    are one row for each doc_id and text. Documents without doc_id are kept. Columns of any further name stay
    as they are."""
    of = stored(_of_components(docs, width, num, den, text))
    dropped = of.where("doc_id != component_id").select("doc_id").distinct()
    repeated = of.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rows = docs.select("doc_id", F.col(text).alias("text"), whole_row(docs).alias("row"))
    if repeated.isEmpty():
        return rows.join(dropped, "doc_id", "left_anti").select("row.*")
    repeated = stored(repeated)
    single = rows.join(dropped.unionByName(repeated), "doc_id", "left_anti").select("row")
    # a doc_id does not tell its rows apart: they are known by their sets too
    several = rows.join(repeated, "doc_id", "left_semi")
    several = several.mapInArrow(_with_set(width, "text"), StructType([*several.schema, StructField("set", LongType())]))
    own = of.join(repeated, "doc_id", "left_semi").distinct().withColumnRenamed("id", "set")
    several = several.join(own, ["doc_id", "set"])
    empty = several.where("n = 0").dropDuplicates(["doc_id", "text"])
    order = Window.partitionBy("component").orderBy("text")
    first = several.where("n > 0 and doc_id = component_id").withColumn("k", F.row_number().over(order)).where("k = 1")
    return single.unionByName(empty.select("row")).unionByName(first.select("row")).select("row.*")


#: The query over ``documents`` as SQL, by counting the common shingles of all pairs that have any.
JOINED_SQL = """
with recursive texts as (
  select row_number() over () as row_id, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+'), []) as w
  from documents
), sets as (
  select row_id, doc_id, list_sort(list_distinct(case when len(w) = 0 then []
    when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda j: array_to_string(w[j:j + 3], ' ')) end)) as s
  from texts
), kinds as (
  select s, min(row_id) as id, min(doc_id) as least, len(s) as n from sets where len(s) > 0 group by s
), members as (
  select id, n, unnest(s) as shingle from kinds
), links as (
  select a.id as x, b.id as y
  from members a join members b on a.shingle = b.shingle and a.id != b.id
  group by a.id, b.id, a.n, b.n
  having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(id, other) as (
  select id, id from kinds
  union
  select r.id, l.y from reached r join links l on l.x = r.other
), named as (
  select r.id, min(k.least) as component_id from reached r join kinds k on k.id = r.other group by r.id
)
select doc_id, len(sets.s)::bigint as n_shingles,
  case when len(sets.s) > 0 then component_id else doc_id end as component_id
from sets left join kinds on kinds.s = sets.s left join named on named.id = kinds.id
"""
