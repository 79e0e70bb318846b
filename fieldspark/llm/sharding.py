"""Shards of near equal size by best-fit-decreasing bin packing.

Documents with equal texts are a group that stays together. Groups enter bins by falling size, each
into the bin with the least room that still holds it, found in a balanced tree of the rooms; the
least capacity at which the wanted number of bins is enough is found by search.

Groups of one size are interchangeable, so the driver packs sizes with their numbers of groups, which gives
the same bins as packing group by group: after one group of a size, the tightest bin for the next is the same
one until it is full. Which of its size's groups goes where follows from a group's rank within its size;
ranks are counted in buckets, and only for sizes that are spread over several bins. Of b bytes in all
there are at most sqrt(2 b) distinct sizes.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Buckets in which the documents of a shard, and the groups of a size, are numbered.
BUCKETS = 1024


class Rooms:
    """Bins ordered by the room they have: an AVL tree of (room, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _node(key, left, right):
        height = 1 + max(left[3] if left else 0, right[3] if right else 0)
        return (key, left, right, height)

    def _balanced(self, key, left, right):
        lean = (left[3] if left else 0) - (right[3] if right else 0)
        if lean > 1:
            k, a, b, _ = left
            if (a[3] if a else 0) < (b[3] if b else 0):
                return self._node(b[0], self._node(k, a, b[1]), self._node(key, b[2], right))
            return self._node(k, a, self._node(key, b, right))
        if lean < -1:
            k, a, b, _ = right
            if (b[3] if b else 0) < (a[3] if a else 0):
                return self._node(a[0], self._node(key, left, a[1]), self._node(k, a[2], b))
            return self._node(k, self._node(key, left, a), b)
        return self._node(key, left, right)

    def add(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return self._node(key, None, None)
            k, a, b, _ = node
            return self._balanced(k, put(a), b) if key < k else self._balanced(k, a, put(b))

        self.root = put(self.root)

    def _take_first(self, node):
        k, a, b, _ = node
        if a is None:
            return k, b
        first, rest = self._take_first(a)
        return first, self._balanced(k, rest, b)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(node):
            k, a, b, _ = node
            if key < k:
                return self._balanced(k, cut(a), b)
            if key > k:
                return self._balanced(k, a, cut(b))
            if a is None or b is None:
                return a or b
            least, rest = self._take_first(b)
            return self._balanced(least, a, rest)

        self.root = cut(self.root)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``size``."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        return found


Runs = list[tuple[int, int]]  # bins, and how many groups of a size go into each


def best_fit_runs(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[Runs] | None:
    """The bins of the groups of each size (size and number of groups, sizes falling), opening bins as needed;
    None if more than ``most`` are. A size above the capacity has bins of its own."""
    rooms, bins, out = Rooms(), 0, []
    for size, count in classes:
        runs: Runs = []
        while count:
            found = rooms.tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            else:
                rooms.remove(found)
            n = min(count, found[0] // size)
            rooms.add((found[0] - n * size, found[1]))
            runs.append((found[1], n))
            count -= n
        out.append(runs)
    return out


def best_fit(sizes: Iterable[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size (falling), opening bins as needed; None if more than ``most`` are."""
    runs = best_fit_runs(((size, 1) for size in sizes), capacity, most)
    return None if runs is None else [r[0][0] for r in runs]


def pack(classes: list[tuple[int, int]], bins: int) -> list[Runs]:
    """Puts groups of falling sizes (size, number of groups) into ``bins`` bins of near equal load. A group of
    at least an equal share of what is left has a bin for itself.

    The rest fits at the latest at twice the share: no group is larger than it, so a group that found no
    room would leave more than a share in every bin.
    """
    alone, left, rest = 0, sum(size * n for size, n in classes), []
    own: list[Runs] = []
    for size, n in classes:
        runs: Runs = []
        while n and not rest and alone < bins - 1 and size * (bins - alone) >= left:
            runs.append((alone, 1))
            alone, left, n = alone + 1, left - size, n - 1
        own.append(runs)
        if n:
            rest.append((size, n))
    n = bins - alone
    share = -(-left // n)
    step = max(1, share // 20_000)
    high = 0  # steps above the share that are enough; one of nearly equal load is found near none
    while (found := best_fit_runs(rest, share + high * step, n)) is None:
        high = 2 * high + 1
    low = high // 2  # not enough, unless both are 0
    while high - low > 1:
        middle = (low + high) // 2
        tried = best_fit_runs(rest, share + middle * step, n)
        low, high, found = (middle, high, found) if tried is None else (low, middle, tried)
    packed = iter(found)
    return [
        r if sum(k for _, k in r) == count else [*r, *((alone + b, k) for b, k in next(packed))]
        for r, (_, count) in zip(own, classes, strict=True)
    ]


def sharded(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes and 16), text_crc32,
    law ("bytes"), shard (0 to ``shards`` - 1), slot (0, 1, ... within the shard) and grown_shard
    (null under this law).

    Equal texts share a shard, so a text with more than a shard's share of all bytes makes its shard
    larger than the others. A null text has size 16 and no checksum; such documents are apart from
    each other unless their doc_id is equal too. Repeated rows have slots of their own. Other columns
    are ignored, an empty table gives no rows.
    """
    bytes_of = F.octet_length(F.col(text)).cast("long")
    narrow = stored(
        docs.select(
            "doc_id",
            (F.coalesce(bytes_of, F.lit(0)) + 16).alias("size"),
            F.crc32(F.col(text)).alias("text_crc32"),
            F.when(F.col(text).isNull(), F.xxhash64(F.lit("null"), "doc_id"))
            .otherwise(F.xxhash64(F.col(text), F.crc32(F.col(text)), bytes_of))
            .alias("group"),
        )
    )
    groups = stored(narrow.groupBy("group").agg(F.sum("size").alias("bytes")))
    classes = [(r.bytes, r["count"]) for r in groups.groupBy("bytes").count().collect()]
    classes.sort(reverse=True)
    plan = [
        (size, [b for b, _ in runs], list(accumulate(n for _, n in runs)))
        for (size, _), runs in zip(classes, pack(classes, shards), strict=True)
    ]
    spark = docs.sparkSession
    plan = stored(spark.createDataFrame(plan, "bytes long, bins array<int>, ends array<long>"))
    spread = F.size("bins") > 1
    whole = groups.join(plan.where(~spread), "bytes").select("group", F.element_at("bins", 1).alias("shard"))
    of_spread = groups.join(plan.where(spread), "bytes").withColumn("bucket", F.pmod("group", F.lit(BUCKETS)))
    before = Window.partitionBy("bytes").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = of_spread.groupBy("bytes", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("bytes", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy("bytes", "bucket").orderBy("group")) - 1
    ranked = of_spread.withColumn("at", at).join(offsets, ["bytes", "bucket"]).withColumn("rank", F.col("offset") + F.col("at"))
    full = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    of_group = whole.unionByName(ranked.select("group", F.get("bins", full).alias("shard")))
    out = stored(
        narrow.join(of_group, "group").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)))
    )
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    numbered = out.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
