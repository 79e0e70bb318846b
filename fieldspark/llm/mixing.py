"""Mixing sources to target weights by Pareto order sampling.

A source that is to give t words and holds s of them gives floor(t / s) certain copies of every
document; what is left, a fraction f of the source, is a sample without replacement. Each document
draws a random odds value and is ranked by it, divided by its inclusion odds (f / (1 - f), times the
document's own weight if there is one); the sample is the head of that order, as far as its words
fit into what is left. The gap that remains is closed with the one further document whose size is
nearest to it, if that brings the source nearer to its target.

Ranks are never computed over a whole source: words are counted per source and rank bucket, the
bucket in which the sample ends is found from these counts, and only its documents are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored, whole_row

#: Rank buckets of a source.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: int) -> Column:
    """Odds of a uniform number in (0, 1) that follows from the document alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    return uniform / (1 - uniform)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): all words shared over the sources by weight, no target above
    ``most`` times its source; what is above is shared again among the others.

    Sources in code point order, null last, have the weights in turn. With sources ordered by the
    level at which they reach their limit, those below the common level are full.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    of = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumn(
        "weight", F.element_at(of, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.col("source_size") * most)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up_to = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("others", F.sum("weight").over(every) - F.sum("weight").over(up_to) + F.col("weight"))
        .withColumn("room", F.col("total") - F.sum("limit").over(up_to) + F.col("limit"))
        .withColumn("full", F.col("limit") * F.col("others") <= F.col("weight") * F.col("room"))
    )
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0))
    weight_left = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return level.select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("limit").cast("double"))
        .otherwise(left.cast("double") * F.col("weight") / weight_left)
        .alias("target"),
    )


def _ranked(docs: DataFrame, plan: DataFrame, seed: int, weight: str | None) -> DataFrame:
    """Documents with their source's plan, their rank value and its bucket (columns of __m)."""
    odds = _draw(seed)
    if weight:
        odds = odds / F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-300))
    plan = plan.select(F.struct(*[c for c in plan.columns if c != "source"]).alias("__m"), F.col("source").alias("__source"))
    joined = docs.join(plan, docs["source"].eqNullSafe(plan["__source"]), "left").drop("__source")
    # a constant within a source; the odds of a whole or an empty rest do not matter
    share = F.col("__m.rest") / F.col("__m.source_size")
    inclusion = F.when((share > 0) & (share < 1), share / (1 - share)).otherwise(F.lit(1.0))
    joined = joined.withColumn("__q", odds / inclusion)
    return joined.withColumn("__bucket", F.floor(F.col("__q") / (1 + F.col("__q")) * BUCKETS).cast("int"))


def mixing_plan(docs: DataFrame, seed: int = 7, weight: str | None = None, **options) -> DataFrame:
    """One row per source: source_size, target, certain copies and the end of its sample.

    ``docs`` has doc_id, source, size and, if named, a weight column.
    """
    targets = source_targets(docs, **options)
    filled = F.col("source_size") > 0
    copies = F.when(filled, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(
        targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    )
    ranked = _ranked(docs, plan, seed, weight)
    counts = ranked.groupBy("source", "__bucket").agg(F.sum("size").alias("words"), F.first("__m.rest").alias("rest"))
    up_to = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("before", F.sum("words").over(up_to) - F.col("words"))
    ends = (
        counts.where(F.col("before") + F.col("words") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("__bucket", "before")).alias("end"))
        .select(F.col("source").alias("__s"), "end.__bucket", "end.before")
        .withColumnRenamed("__bucket", "end_bucket")
    )
    inside = ranked.join(ends, ranked["source"].eqNullSafe(ends["__s"]) & (F.col("__bucket") == F.col("end_bucket")))
    rows = inside.groupBy("source", "__q", "doc_id").agg(
        F.sum("size").alias("words"), F.first("before").alias("before"), F.first("__m.rest").alias("rest")
    )
    order = Window.partitionBy("source").orderBy("__q", F.col("doc_id").asc_nulls_first())
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        rows.withColumn("through", F.col("before") + F.sum("words").over(up_to))
        .where(F.col("through") <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("__q", "doc_id")).alias("last"), F.max("through").alias("through"))
        .select(F.col("source").alias("__l"), "last", "through")
    )
    ends = ends.join(last, ends["__s"].eqNullSafe(last["__l"]), "left").select(
        "__s", "end_bucket", "last", F.coalesce("through", "before").alias("head")
    )
    plan = plan.join(ends, plan["source"].eqNullSafe(ends["__s"]), "left").drop("__s")
    plan = stored(plan.withColumn("gap", F.col("rest") - F.col("head")))
    further = _ranked(docs, plan, seed, weight).where((F.col("__m.gap") > 0) & ~_in_head() & (F.col("size") > 0))
    miss = F.abs(F.col("size") - F.col("__m.gap"))
    closing = (
        further.where(miss < F.col("__m.gap"))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), F.col("__q"), F.col("doc_id"))).alias("closing"))
        .select(F.col("source").alias("__c"), F.struct("closing.__q", "closing.doc_id").alias("closing"))
    )
    return plan.join(closing, plan["source"].eqNullSafe(closing["__c"]), "left").drop("__c")


def _in_head() -> Column:
    at, end = F.col("__bucket"), F.col("__m.end_bucket")
    q, last = F.struct("__q", "doc_id"), F.col("__m.last")
    return end.isNull() | (at < end) | ((at == end) & F.coalesce(q <= last, F.lit(False)))


def _copies() -> Column:
    closes = F.coalesce(F.struct("__q", "doc_id") == F.col("__m.closing"), F.lit(False))
    return F.col("__m.copies") + F.when((F.col("__m.rest") > 0) & (_in_head() | closes), 1).otherwise(0)


def mixed(docs: DataFrame, seed: int = 7, text: str = "text", weight: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size (words), source_size, target
    (words, of its source) and taken (words that the mix takes, repeats counted).

    A null text has no words; a null source is a source. A null doc_id is a value like others; rows
    with the same doc_id and source draw the same number and are taken together. A source without
    words has target 0. Columns other than those named are ignored; an empty table gives no rows.
    """
    weighed = [F.col(weight).alias("weight")] if weight else []
    sized = stored(docs.select("doc_id", "source", size_of(text).alias("size"), *weighed))
    own = "weight" if weight else None
    plan = stored(mixing_plan(sized, seed, own))
    return _ranked(sized, plan, seed, own).select(
        "doc_id",
        "size",
        F.col("__m.source_size").alias("source_size"),
        F.col("__m.target").alias("target"),
        (F.col("size") * _copies()).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, seed: int = 7, text: str = "text", weight: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with its columns. Columns of any
    further name stay as they are; nulls, repeats and empty tables as in ``mixed``."""
    weighed = [F.col(weight).alias("weight")] if weight else []
    sized = docs.select("doc_id", "source", size_of(text).alias("size"), *weighed)
    own = "weight" if weight else None
    plan = stored(mixing_plan(stored(sized), seed, own))
    ranked = _ranked(docs.select("doc_id", "source", *weighed, whole_row(docs).alias("row")), plan, seed, own)
    again = F.array_repeat(F.lit(1), _copies().cast("int"))
    return ranked.select("row", F.explode(again)).select("row.*")


#: The query over ``documents`` as SQL.
MIXED_SQL = """
with sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint + 0.5::double)
      / 281474976710656::double as u
  from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select *, 3 * source_size as most,
    (row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as weight
  from totals
), filling as (
  select *, sum(source_size) over () as total,
    sum(weight) over () - sum(weight) over w + weight as others,
    sum(source_size) over () - sum(most) over w + most as room
  from weighted
  window w as (order by most / weight, encode(source) nulls last rows between unbounded preceding and current row)
), levels as (
  select *, most * others <= weight * room as is_full from filling
), targets as (
  select source, source_size,
    case when is_full then most::double
      else (total - coalesce(sum(case when is_full then most end) over (), 0))::double * weight
        / sum(case when not is_full then weight end) over () end as target
  from levels
), plan as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as copies
  from targets
), ranked as (
  select s.doc_id, s.source, s.size, s.u, p.source_size, p.target, p.copies,
    target - copies * p.source_size as rest,
    sum(s.size) over (partition by s.source order by u, s.doc_id) as through
  from sized s join plan p on s.source is not distinct from p.source
), heads as (
  select *, coalesce(max(case when through <= rest then through end) over (partition by source), 0) as head
  from ranked
), gaps as (
  select *, rest - head as gap, abs(size - (rest - head)) as miss from heads
), closings as (
  select source, min({'miss': miss, 'u': u, 'doc_id': doc_id}) as closing
  from gaps where gap > 0 and through > rest and size > 0 and miss < gap group by source
)
select g.doc_id, size, source_size, target,
  (size * (copies + case when rest > 0 and (through <= rest
    or coalesce(g.u = c.closing.u and g.doc_id is not distinct from c.closing.doc_id, false))
    then 1 else 0 end))::bigint as taken
from gaps g left join closings c on g.source is not distinct from c.source
"""
