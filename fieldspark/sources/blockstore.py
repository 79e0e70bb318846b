"""A store whose tables are bucketed and sorted by block, so that reports of blocks move no rows.

A bucket is read by one task. A block with so many rows that its bucket would be far larger than the others
is kept apart, in plain tables whose joins and groupings Spark exchanges and splits as usual. Which
blocks those are is one decision for all tables, so each block is wholly in one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.sources.schemas import SCHEMAS
from fieldspark.sources.tables import Tables

# The column that holds the block; tables without one are kept as they are.
BLOCK_KEYS = {
    "aplicaciones": "bloque",
    "aplicaciones_pendientes": "bloque",
    "calidad_aplicaciones": "bloque",
    "blocks_desarrollo": "bloque",
    "historia_bloques": "bloque",
    "pesoplanta": "llave",
}

#: A block is kept apart when it has more rows than this many average buckets of a table.
HEAVY = 2.0
#: Rows of a bucket, which one task sorts when it is written and groups when it is read.
BUCKET_ROWS = 500_000


def buckets_for(tables: Tables, names: Iterable[str] = tuple(BLOCK_KEYS), least: int = 1) -> int:
    """As many buckets as keep those of the largest table at `BUCKET_ROWS` rows, `least` at least."""
    return max(least, -(-max(getattr(tables, name).count() for name in names) // BUCKET_ROWS))


def heavy_blocks(tables: Tables, names: Iterable[str], buckets: int, heavy: float = HEAVY) -> DataFrame:
    """(bloque) of the blocks that are kept apart: at most buckets / heavy for each table."""
    found = []
    for name in names:
        rows = getattr(tables, name).groupBy(F.col(BLOCK_KEYS[name]).alias("bloque")).count()
        most = heavy / buckets * getattr(tables, name).count()
        found.append(rows.where(F.col("bloque").isNotNull() & (F.col("count") > most)).select("bloque"))
    return reduce(DataFrame.unionByName, found).distinct()


def write_block_store(tables: Tables, root: str, buckets: int, names: Iterable[str] = tuple(BLOCK_KEYS), heavy: float = HEAVY) -> None:
    """Writes tables with blocks below `root`, each as `<name>` in buckets and `<name>_apart`. `buckets`: as
    many as give files of some 128 MB; all tables that are to be joined have the same number."""
    names = list(names)
    spark = getattr(tables, names[0]).sparkSession
    heavy_blocks(tables, names, buckets, heavy).write.parquet(f"{root}/_apart")
    apart = spark.read.schema("bloque string").parquet(f"{root}/_apart").withColumnRenamed("bloque", "_apart")
    for name in names:
        rows, key = getattr(tables, name), BLOCK_KEYS[name]
        # which blocks: a short list, bounded by tables times buckets / heavy
        marked = rows.join(F.broadcast(apart), F.col(key) == F.col("_apart"), "left")
        rest = marked.where("_apart is null").drop("_apart").repartition(buckets, key)
        table = f"_writing_{abs(hash((root, name))):x}"
        rest.write.bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}").saveAsTable(table)
        spark.sql(f"drop table {table}")  # of an external table only the name goes
        marked.where("_apart is not null").drop("_apart").write.parquet(f"{root}/{name}_apart")


class BlockStore:
    """The tables written by `write_block_store`, under names of this session's catalog."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, names: Iterable[str] = tuple(BLOCK_KEYS)):
        self._spark, self._root, self._names = spark, root, list(names)
        self._table = {}
        for name in self._names:
            self._table[name] = f"bloques_{abs(hash((root, name))):x}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[name].fields)
            spark.sql(
                f"create table if not exists {self._table[name]} ({columns}) using parquet "
                f"clustered by ({BLOCK_KEYS[name]}) sorted by ({BLOCK_KEYS[name]}) into {buckets} buckets location '{root}/{name}'"
            )

    def parts(self, others: Tables | None = None) -> tuple[Tables, Tables]:
        """The tables of the bucketed blocks, and those of the blocks kept apart; tables without blocks come from `others`."""

        def read(suffix: str) -> Callable[[str], DataFrame]:
            def table(name: str) -> DataFrame:
                if name not in self._table:
                    return getattr(others, name)
                if suffix:
                    return self._spark.read.schema(SCHEMAS[name]).parquet(f"{self._root}/{name}{suffix}")
                return self._spark.table(self._table[name])

            return table

        return Tables(read(""), co_located=True), Tables(read("_apart"))

    def by_block(self, plan: Callable[[Tables], DataFrame], others: Tables | None = None) -> DataFrame:
        """`plan` over all blocks. It must treat each block by itself: join and group by block, with
        or without further columns."""
        rest, apart = self.parts(others)
        return plan(rest).unionByName(plan(apart))

    def close(self) -> None:
        """Takes the names out of the catalog; files stay."""
        for table in self._table.values():
            self._spark.sql(f"drop table if exists {table}")
