"""Vectors as a few bytes: product codes whose codebooks are fitted by ball k-means.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of
its own. A round assigns every part to its nearest entry and moves each entry to the mean of its parts.
After the first round, which compares all entries, a part starts from the entry it had:

- the parts of an entry form a ball; only entries at most two radii away are neighbours of the ball;
- a part nearer to its entry than half the way to the next entry lies in the stable core and stays;
- the others lie in annular rings: a part at distance d has as candidates those entries that are at most
  2 d away from its own. Beyond them nothing can be nearer, or as near, by the triangle inequality;
- a part whose entry did not move has only moved entries as candidates.

All of this compares squared integers, so the result is exactly that of a comparison with all entries.

Rows stay where they are. A round reads the last round's table, writes the next one with the new codes, and
in the last row of each task what the sums of the entries gain and lose; only those are summed over all
tasks, and come to the driver as one row a component of the codebooks. Earlier tables are deleted.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import deleted, received, shared_folder, shipped

_LIMB = 32
_CHANGE = "array<struct<part:int,entry:int,sums:array<long>>>"


@dataclass
class Codebooks:
    """The entries of each part, (entries, components) integers, for vectors of one length."""

    dims: int
    parts: list[np.ndarray]

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for part in self.parts for x in part.ravel()).encode()).hexdigest()

    def vectors(self, codes: np.ndarray, scale: int = 1024) -> np.ndarray:
        """The vectors that stand for ``codes`` (n, parts): the middles of the entries' integer cells."""
        return np.hstack([(b[codes[:, k]] + 0.5) / scale for k, b in enumerate(self.parts)]).astype(float)


@dataclass
class Compressed:
    """``codes``: (id, label, dims, code, error) per vector kept; the codebooks by vector length."""

    codes: DataFrame
    codebooks: dict[int, Codebooks]


class Balls:
    """One part's entries and how far they are from each other, nearest first."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        self.entries, self.moved = entries, moved
        self.square = (entries * entries).sum(1)
        apart = self.square[:, None] - 2 * (entries @ entries.T) + self.square
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.near = np.take_along_axis(apart, self.order, axis=1)

    def _nearest(self, x: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nearest of the entries ``among`` (ascending, so ties go to the lower index)."""
        gap = self.square[among] - 2 * (x @ self.entries[among].T)
        return among[np.argmin(gap, axis=1)]

    def distance(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        gap = x - self.entries[code]
        return (gap * gap).sum(1)

    def assigned(self, x: np.ndarray, code: np.ndarray | None) -> np.ndarray:
        """The nearest entry of each row of x; ``code``: what it was before, None at first."""
        everything = np.arange(len(self.entries))
        if code is None or len(everything) == 1:
            return self._nearest(x, everything)
        own = self.distance(x, code)
        code, by = code.copy(), np.argsort(code, kind="stable")
        first = np.searchsorted(code[by], np.arange(len(everything) + 1))
        for entry in np.flatnonzero(np.diff(first)):
            rows = by[first[entry] : first[entry + 1]]
            reach = 4 * own[rows]  # entries at squared distances up to this one may be as near
            ball = int(np.searchsorted(self.near[entry], reach.max(), "right"))
            if ball == 1:
                continue  # no neighbours
            ring = np.searchsorted(self.near[entry][:ball], reach, "right")
            low = 1  # the stable core: no other entry within reach
            while low < ball:
                high = min(ball, max(low * 4, 8))
                inside = rows[(ring > low) & (ring <= high)]
                among = self.order[entry][:high]
                if not self.moved[entry]:
                    among = among[self.moved[among] | (among == entry)]
                if len(inside) and len(among) > 1:
                    code[inside] = self._nearest(x[inside], np.sort(among))
                low = high
        return code


class _Round:
    """Assigns the vectors of a task to the entries of a round."""

    def __init__(self, books: Codebooks, moved: list[np.ndarray], scale: int, limbs: int, last: bool):
        self.books, self.moved, self.scale, self.limbs, self.last = books, moved, scale, limbs, last

    def integers(self, column: pa.Array, n: int) -> np.ndarray:
        flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, self.books.dims)
        if self.limbs == 1:
            return np.floor(flat * self.scale)
        whole = 1 << 53  # beyond it doubles are integers already
        exact = np.empty(flat.shape, object)
        exact.ravel()[:] = [math.floor(v * self.scale) if abs(v) < whole else int(v) * self.scale for v in flat.ravel().tolist()]
        return exact

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float64 if self.limbs == 1 else object
        balls = [Balls(b.astype(kind), m) for b, m in zip(self.books.parts, self.moved, strict=True)]
        cuts = np.cumsum([0, *(b.shape[1] for b in self.books.parts)])
        change = [np.zeros((b.shape[0], 1 + b.shape[1]), np.int64 if self.limbs == 1 else object) for b in self.books.parts]
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = self.integers(batch["x"], n)
            old = None
            if batch["code"].null_count == 0:
                old = np.asarray(batch["code"].flatten()).astype(np.int64).reshape(n, len(balls))
            new = np.empty((n, len(balls)), np.int64)
            error = np.zeros(n, kind)
            for k, ball in enumerate(balls):
                part = x[:, cuts[k] : cuts[k + 1]]
                was = None if old is None else old[:, k]
                new[:, k] = ball.assigned(part, was)
                if self.last:
                    error += ball.distance(part, new[:, k])
                    continue
                differ = slice(None) if was is None else np.flatnonzero(was != new[:, k])
                self._add(change[k], part[differ], new[differ, k], 1)
                if was is not None:
                    self._add(change[k], part[differ], was[differ], -1)
            if held is not None:
                yield self._out(*held, None)
            held = batch, new, error
        if held is not None:
            yield self._out(*held, None if self.last else change)

    @staticmethod
    def _add(change: np.ndarray, part: np.ndarray, code: np.ndarray, sign: int) -> None:
        if not len(code):
            return
        by = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[by], prepend=-1))
        entries = code[by][starts]
        change[entries, 0] += sign * np.diff(starts, append=len(code))
        if part.shape[1]:
            sums = np.add.reduceat(part[by], starts, axis=0)
            change[entries, 1:] += sign * (sums if sums.dtype == object else sums.astype(np.int64))

    def _limbs(self, values: list) -> list[int]:
        """Each value as ``limbs`` numbers of 32 bits, lowest first, the last one signed."""
        if self.limbs == 1:
            return [int(v) for v in values]
        mask, top = (1 << _LIMB) - 1, self.limbs - 1
        return [int(v) >> (_LIMB * i) if i == top else (int(v) >> (_LIMB * i)) & mask for v in values for i in range(self.limbs)]

    def _out(self, batch: pa.RecordBatch, code: np.ndarray, error: np.ndarray, change) -> pa.RecordBatch:
        n, parts = code.shape
        codes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(code.ravel().astype(np.int16)))
        most = (1 << 63) - 1
        errors = [int(e) if e <= most else None for e in error.tolist()] if self.last else [None] * n
        changes = [None] * n
        if change is not None:
            changes[-1] = [
                {"part": k, "entry": int(e), "sums": self._limbs(sums[e].tolist())}
                for k, sums in enumerate(change)
                for e in np.flatnonzero((sums != 0).any(axis=1))
            ]
        kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays(
            [batch["id"], batch["label"], batch["x"], codes, pa.array(errors, pa.int64()), pa.array(changes, kind)],
            ["id", "label", "x", "code", "error", "change"],
        )


def _written(rows: DataFrame) -> tuple[DataFrame, str]:
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def _fitted(rows: DataFrame, dims: int, largest: float, parts: int, entries: int, rounds: int, scale: int):
    """Codes and codebooks of the vectors (id, label, x) of one length."""
    spark: SparkSession = rows.sparkSession
    cuts = [dims * k // parts for k in range(parts + 1)]
    most = math.floor(largest * scale) + 1 if largest * scale < 1e300 else int(largest) * scale + 1
    width = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
    # squared distances are exact in doubles below 2 ** 53; beyond them Python's integers are used
    limbs = 1 if 4 * width * most * most < 1 << 53 and most < 1 << 31 else most.bit_length() // _LIMB + 3
    empty = T.StructType([f for f in rows.schema.fields if f.name in ("id", "label", "x")])
    schema = T.StructType([*empty.fields, *T.StructType.fromDDL(f"code array<short>, error long, change {_CHANGE}").fields])

    smallest = rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()
    start = _Round(Codebooks(dims, []), [], scale, limbs, False)
    first = start.integers(pa.array([r.x for r in smallest], pa.list_(pa.float64())), len(smallest))
    whole = np.int64 if limbs == 1 else object
    books = Codebooks(dims, [first[:, a:b].astype(whole) for a, b in zip(cuts, cuts[1:], strict=False)])
    sums = [np.zeros((b.shape[0], 1 + b.shape[1]), object) for b in books.parts]
    moved = [np.ones(len(b), bool) for b in books.parts]
    table = rows.select("id", "label", "x", F.lit(None).cast("array<short>").alias("code"))
    path = None
    for turn in range(rounds + 1):
        work = shipped(spark, _Round(books, moved, scale, limbs, turn == rounds))
        table, new = _written(table.mapInArrow(lambda batches, work=work: received(work)(batches), schema))
        if path:
            deleted(spark, path)
        path = new
        if turn == rounds:
            return table.select("id", "label", "code", "error"), books
        change = table.where("change is not null").select(F.explode("change").alias("c")).select("c.part", "c.entry", F.posexplode("c.sums"))
        for r in change.groupBy("part", "entry", "pos").agg(F.sum("col").alias("sum")).collect():
            sums[r.part][r.entry, r.pos // limbs] += int(r["sum"]) << (_LIMB * (r.pos % limbs))
        nextly = [b.copy() for b in books.parts]
        for part, total in zip(nextly, sums, strict=True):
            used = np.flatnonzero(total[:, 0] > 0)
            part[used] = (total[used, 1:] // total[used, :1]).astype(whole)
        moved = [(a != b).any(axis=1) for a, b in zip(nextly, books.parts, strict=True)]
        books = Codebooks(dims, nextly)


def compressed(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> Compressed:
    """Codes of all vectors that are not null and hold no null or non-finite component.

    A component x becomes floor(scale * x), exactly, however large. Codebooks start as the parts of the vectors with the
    ``entries`` smallest ids (null ids last, equal ids by their components; fewer vectors make fewer
    entries), and are fitted in ``rounds`` rounds; squared Euclidean distance, ties to the lower index; a mean
    is rounded down, an entry without parts stays. ``error``: squared distances of a vector's parts to
    their entries, summed; null beyond the range of long. Repeated rows all count. Vectors of different lengths have codebooks
    of their own; a length that ``parts`` does not divide is cut as evenly as possible. An empty
    table gives an empty one. Other columns are ignored.
    """
    x = F.col("x")
    rows = vectors.select(
        F.col(id).alias("id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).alias("x")
    )
    element = rows.schema["x"].dataType.elementType
    if not isinstance(element, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("x", x.cast("array<double>"))
    rows = rows.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    largest = F.max(F.array_max(F.transform(x, lambda c: F.abs(c.cast("double")))))
    lengths = rows.groupBy(F.size(x).alias("dims")).agg(largest.alias("largest")).orderBy("dims").collect()
    found, books = [], {}
    for r in lengths:
        of = rows.where(F.size(x) == r.dims)
        codes, books[r.dims] = _fitted(of, r.dims, r.largest or 0.0, parts, entries, rounds, scale)
        found.append(codes.withColumn("dims", F.lit(r.dims)))
    if not found:
        none = rows.select("id", "label", F.lit(None).cast("array<short>").alias("code"), F.lit(0).cast("long").alias("error"))
        found = [none.withColumn("dims", F.lit(0)).where("false")]
    out = reduce(DataFrame.unionByName, found)
    return Compressed(out.select(F.col("id").alias(id), F.col("label").alias(label or "label"), "dims", "code", "error"), books)


def codes_digest(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label) by
    ``compressed``, whose rules for nulls, repeats, lengths and empty tables hold. ``label_error`` sums the errors of a label
    (null labels together), and is null if one of them is, or the sum beyond the range of long."""
    done = compressed(vectors)
    codes = done.codes
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.count("error") == F.count("*")
    labels = codes.groupBy(F.col("label").alias("of")).agg(
        F.when(whole, total.try_cast("long")).alias("label_error")
    )
    digest = F.lit(None).cast("string")
    for dims, books in done.codebooks.items():
        digest = F.when(F.col("dims") == dims, F.lit(books.sha256())).otherwise(digest)
    byte = lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id",
        F.array_join(F.transform("code", byte), "").alias("code"),
        "error",
        "label_error",
        digest.alias("codebooks_sha256"),
    )


def _digest_sql(rounds: int = 4) -> str:
    """Round by round, each part against all entries; all vectors are taken to have one length."""
    steps = [
        """kept as materialized (
  select vec_id, label, row_number() over (order by vec_id, embedding) as r,
    list_transform(embedding, lambda c: floor(1024 * c::double)) as v
  from embeddings
  where embedding is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda c: c is not null and coalesce(isfinite(c), false))), true)
), cut as materialized (
  select vec_id, label, r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] as x from kept, range(4) p(part)
), book0 as materialized (
  select part, (r - 1)::bigint as entry, x as c from cut where r <= 256
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} as materialized (
  select vec_id, label, r, part, x,
    min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::bigint * 256 + entry) as best
  from cut join book{k} using (part) group by all
)""")
        if k < rounds:
            steps.append(f"""sums{k} as (
  select part, best % 256 as entry, pos, floor(sum(x[pos]) / count(*)) as m
  from near{k}, unnest(range(1, len(x) + 1)) u(pos) group by all
), book{k + 1} as materialized (
  select b.part, b.entry, coalesce(n.c, b.c) as c
  from book{k} b left join (select part, entry, list(m order by pos) as c from sums{k} group by all) n using (part, entry)
)""")
    return f"""with {", ".join(steps)}, coded as (
  select vec_id, label, r, string_agg(printf('%02x', best % 256), '' order by part) as code, sum(best // 256)::bigint as error
  from near{rounds} group by all
), digest as (
  select sha256(string_agg(i::bigint::varchar, ',' order by part, entry, pos)) as codebooks_sha256
  from (select part, entry, unnest(c) as i, unnest(range(1, len(c) + 1)) as pos from book{rounds})
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded, digest"""


CODES_SQL = _digest_sql()
