"""Spelling variants of a vocabulary: words one edit apart, found by asymmetric q-chunks.

Of two near words the shorter one (of two equally long ones, the smaller) contributes two disjoint
chunks, the halves of ``q`` code points at 0 and ``q``; the other one contributes positional grams of
the same ``q``. One edit touches one chunk at most, so the other is a gram of the longer word, at its
own place or shifted by one. The shift is part of the production of grams: of all positional grams only
those within shift one of a chunk's place are made, since the others could join nothing.

Halves are as selective as two chunks can be, yet a chunk may be shared by very many words. A key
with more than ``PAIRS`` candidate pairs is not joined: both words lose the chunk they have in common,
what remains of them is one edit apart as well, and its chunks narrow the key, until keys are small
or one code point remains. Candidates are verified on whole words, so the result is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Candidate pairs of a key beyond which its words are cut once more.
PAIRS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, shortest: int = 6, fewest: int = 5, typo_every: int = 199) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) with ``shortest`` code points and ``fewest``
    occurrences at least.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case. Where ``typo_every`` divides
    the crc32 of ``<doc_id>:<run>``, the run loses its code point crc32 % length (a null doc_id counts
    as empty text there). Null and empty texts hold no word; other columns are ignored.
    """
    run = F.col("run")
    code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    # shorter runs cannot become words; a greedy match of the others is the whole run
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    at = (F.col("code") % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return (
        docs.select("doc_id", F.explode(runs).alias("run"))
        .select(run, code.alias("code"))
        .select(F.when(F.col("code") % typo_every == 0, cut).otherwise(run).alias("word"))
        .where(F.length("word") >= shortest)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= fewest)
    )


def _without(rest: Column, at: Column, size: Column) -> Column:
    return F.concat(F.substring(rest, F.lit(1), at), F.substring(rest, at + size + 1, F.length(rest)))


def _cut(rows: DataFrame) -> DataFrame:
    """Narrows the key of each row (key, longer, gram, rest, word, n) by a chunk or gram of ``rest``, which
    loses it. ``longer``: by how many code points the gram word is longer (0 or 1); ``gram``: whether
    the row is of the word that contributes grams."""
    rest, longer = F.col("rest"), F.col("longer")
    short = F.length(rest) - F.when(F.col("gram"), longer).otherwise(0)  # what the chunk word has left
    size = F.floor(short / 2).cast("int")
    shifts = F.when(F.col("gram") & (longer == 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    places = rows.withColumns({"size": size, "short": short}).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    places = places.withColumn("at", F.explode(F.transform(shifts, lambda s: F.col("half") * F.col("size") + s)))
    at, size = F.col("at"), F.col("size")
    key = F.xxhash64("key", "short", "half", F.substring(rest, at + 1, size))
    return places.select(key.alias("key"), "longer", "gram", _without(rest, at, size).alias("rest"), "word", "n")


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b) of the words (word, n; distinct) that differ by exactly one inserted, deleted or
    replaced code point; each pair once."""
    roles = F.explode(
        F.array(*(F.struct(F.lit(d).alias("longer"), F.lit(g).alias("gram")) for d in (0, 1) for g in (False, True)))
    )
    rows = words.where(F.length("word") > 0).select("word", "n", roles.alias("role")).select("word", "n", "role.*")
    start = F.xxhash64("longer", F.length("word") - F.when(F.col("gram"), F.col("longer")).otherwise(0))
    level = rows.select(start.alias("key"), "longer", "gram", F.col("word").alias("rest"), "word", "n")
    level = level.where("length(rest) > longer or not gram")
    found = []
    while True:
        level = stored(_cut(level))
        sizes = level.groupBy("key").agg(
            F.sum(F.col("gram").cast("long")).alias("grams"),
            F.sum((~F.col("gram")).cast("long")).alias("chunks"),
            F.max(F.length("rest")).alias("left"),
        )
        # one code point left: what meets differs by it alone
        crowded = stored(sizes.where((F.col("grams") * F.col("chunks") > pairs) & (F.col("left") > 2)).select("key"))
        more = not crowded.isEmpty()
        join = level.join(crowded, "key", "left_anti") if more else level
        chunk = join.where("not gram").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("longer"))
        gram = join.where("gram").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        meet = chunk.join(gram, "key").where("(longer = 1 or a < b) and levenshtein(a, b, 1) = 1")
        found.append(stored(meet.select("a", "n_a", "b", "n_b")))
        if not more:
            return reduce(DataFrame.unionByName, found).distinct()
        level = level.join(crowded, "key", "left_semi")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): each step doubles the distance followed. An
    occurrence count grows by a factor along each form, so chains are short and have an end."""
    up = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = stored(up.join(beyond, "root", "left"))
        if further.where("beyond is not null").isEmpty():
            return up
        up = further.select("word", F.coalesce("beyond", "root").alias("root"))


def spelling_variants(words: DataFrame, times: int = 5, pairs: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    ``n_near`` counts the words one edit away. ``form`` is the near word with the largest n (ties: the
    smallest by code points) if its n, ``form_n``, is ``times`` the word's or more, else null; ``root`` is
    where the forms lead to, the word itself if it has none. Null and empty words are near nothing;
    repeated words count as one, their n added up; an empty table gives an empty one. Words may be of
    any length. Other columns are ignored. ``times`` is more than 1, else forms could lead in a circle.
    """
    if times <= 1:
        raise ValueError("times must be more than 1")
    words = stored(words.groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = stored(near_pairs(words, pairs))
    both = near.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near_word")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_near_word"))
    )
    best = F.min(F.struct((-F.col("n_near_word")).alias("n"), F.col("near").alias("word")))
    of = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    good = -F.col("best.n") >= times * F.col("n")
    named = stored(
        words.join(of, "word", "left").select(
            "word",
            F.when(good, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, -F.col("best.n")).alias("form_n"),
        )
    )
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: Near words by the texts that remain when one code point is deleted; crc32 byte by byte.
VARIANTS_SQL = """
with recursive crc_table as (
  select list(list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as t
  from range(256) r(i)
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-zÀ-ÿ]+')) as run
  from documents
), each_run as (
  select run, coalesce(doc_id::varchar, '') || ':' || run as said, count(*) as times
  from runs where length(run) >= 6 group by all
), coded as (
  select run, times,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(0, octet_length(encode(said))::bigint),
        lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::bigint)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) as code
  from each_run, crc_table
), words as (
  select case when code % 199 = 0
      then substr(run, 1, (code % length(run))::bigint) || substr(run, (code % length(run))::bigint + 2)
      else run end as word,
    sum(times)::bigint as n
  from coded group by 1 having length(word) >= 6 and n >= 5
), cut as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as left_over
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
), near as (
  select a.word, b.word as near, b.n from cut a join cut b on a.i = b.i and a.left_over = b.left_over and a.word <> b.word
  union select cut.word, words.word, words.n from cut join words on cut.left_over = words.word
  union select words.word, cut.word, cut.n from cut join words on cut.left_over = words.word
), best as (
  select word, count(*) as n_near, first(near order by n desc, near) as near, max(n) as near_n from near group by word
), named as (
  select w.word, case when b.near_n >= 5 * w.n then b.near end as form, w.n, coalesce(b.n_near, 0)::bigint as n_near,
    case when b.near_n >= 5 * w.n then b.near_n end as form_n
  from words w left join best b on w.word = b.word
), followed as (
  select word, word as root from named where form is null
  union all select named.word, followed.root from named join followed on named.form = followed.word
)
select named.word, form, root, n, n_near, form_n from named join followed on named.word = followed.word
"""
