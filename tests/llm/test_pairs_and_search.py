"""Jaccard join, decontamination and nearest neighbours against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import decontaminate, jaccard, neighbours
from fieldspark.llm.jaccard import Bands, bit_sketch, jaccard_components, one_of_each, sketch_distance

WORDS = [f"w{i}" for i in range(400)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            of[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(
        ((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str
    )


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def corpus():
    rng = random.Random(4)
    rows = []
    passage = rng.choices(WORDS, k=40)
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.choice([3, 8, 30, 90, 300]))
        for _ in range(rng.choice([1, 2, 9])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 5]))))
    rows += [" ".join(rng.choices(WORDS, k=25) + passage) for _ in range(90)]  # a passage of many
    base = rng.choices(WORDS, k=120)
    rows += [" ".join(edited(rng, base, 1)) for _ in range(80)]  # a large group of near copies
    rows += ["", None, " \t ", "one", "ONE", "one two three", "a b c d", "a b c d", "x " * 9000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(docs, clashing, width, num):
    rows = [*corpus(), (3, "one"), (None, "a b c d"), (None, None)]
    got = jaccard_components(clashing(docs(rows)), width, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, width, num, 100)


def test_hot_words_take_another_plan_to_the_same_result(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWDED", 20)
    hot = []
    split = jaccard._of_hot_words
    monkeypatch.setattr(jaccard, "_of_hot_words", lambda rows: hot.append(rows.count()) or split(rows))
    got = jaccard_components(docs(corpus())).collect()
    assert hot and hot[0] > 20
    assert sorted((tuple(r) for r in got), key=str) == brute_components(corpus(), 4, 85, 100)


def test_one_of_each(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "other words in here now"), (4, None), (None, "a b")]
    kept = one_of_each(docs(rows), width=5, num=80)
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4]


def test_one_of_each_tells_rows_of_a_doc_id_apart(docs, clashing):
    a, b, near = "a b c d e f", "other words in here now", "one two three four five six seven eight nine ten "
    rows = [(3, a), (5, a), (5, b), (7, near + "end"), (7, near + "END "), (7, near * 9), (7, near * 9 + "x"), (8, near * 9)]
    rows += [(9, None), (9, ""), (9, ""), (None, a), (4, near + "end")]
    df = clashing(docs(rows))
    kept = one_of_each(df, width=5, num=80)
    assert kept.columns == df.columns
    want = [(3, a), (4, near + "end"), (5, b), (7, near * 9), (9, None), (9, ""), (None, a)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_one_of_each_keeps_columns_of_any_name(docs):
    a, b = "a b c d e f", "other words in here now"
    names = "__id __doc __set __of __k row set k n count component_id a.b".split()
    for rows in ([(3, a), (5, a), (5, b)], [(3, a), (5, a), (6, b)]):
        df = docs(rows).withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in names})
        kept = one_of_each(df, width=5, num=80)
        assert kept.columns == df.columns
        kept = kept.collect()
        assert sorted(r.text for r in kept) == [a, b]
        assert all(r[n] == f"{n} {r.doc_id}" for r in kept for n in names)


def test_empty_tables(spark, docs):
    none = docs([])
    assert jaccard_components(none).count() == 0
    assert decontaminate.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, F.col("vec_id") % 50 == 0).count() == 0


def test_bands_cover_all_pairs():
    """A pair at the similarity has a band in common, and its bound holds the difference."""
    bands = Bands(85, 100, 4000)
    for b in range(1, 4000, 7):
        for a in {b, -(-85 * b // 100)}:
            most = (a + b) * 15 // 185
            common = set(bands.of(a)) & set(bands.of(b))
            assert not most or any(bands.bound[i] >= most for i in common)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n, m in ((10, 10), (100, 130), (500, 90)):
        both = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a = np.union1d(both, rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.union1d(both, rng.integers(0, 1 << 63, m, dtype=np.uint64))
        assert sketch_distance(bit_sketch(a), bit_sketch(b)) <= n + m


def brute_contamination(rows, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall(lowered(text))
        k = min(width, len(w))
        for j in range(len(w) - k + 1) if w and item is not None else []:
            windows.setdefault(tuple(w[j : j + k]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = word.findall(lowered(text)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if at := windows.get(tuple(w[j : j + k])):
                    hit.update(range(j, j + k))
                    found |= at
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination(spark, docs, clashing, block):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS[:60], k=rng.choice([1, 2, 5, 13, 40])))) for i in range(12)]
    items += [(3, "Élan vital-words, again"), (90, None), (91, "..."), (None, "w1 w2"), (92, items[2][1])]
    rows = []
    for d in range(60):
        w = rng.choices(WORDS[:60], k=rng.choice([0, 4, 60, 500]))
        if d % 3 == 0:
            w += [*rng.choice(items[:12])[1].upper().split(), *rng.choices(WORDS, k=20)]
        rows.append((d, ", ".join(w)))
    rows += [(60, None), (61, "ÉLAN"), (61, "élan vital WORDS again"), (None, items[4][1])]
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = decontaminate.contamination(clashing(docs(rows)), bench, block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(rows, items, 13)
    clean = decontaminate.without_contaminated(clashing(docs(rows)), bench, block_bytes=block)
    assert clean.columns == clashing(docs(rows)).columns
    assert clean.count() == got.where("not contaminated").count()


def test_nearest_recall_and_scores(spark, clashing):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    x = np.repeat(centres, 75, axis=0) + 0.6 * rng.standard_normal((3000, 24))
    x[100:400] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    odd = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0, None] * 12), (5200, [1.0]), (None, [1.0] * 24), (7, rows[7][1])]
    df = clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 60 * 5
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -2
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        assert mine == sorted(mine, key=lambda r: (-r[2], r[1])) and all(abs(r[2] - score[r[1]]) < 1e-12 for r in mine)
        hits += sum(r[2] >= np.sort(score)[-5] - 1e-12 for r in mine)
    assert hits >= 0.9 * 300
    copies = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 150)
    assert [v for _, v in copies] == [100, 101, 102, 103, 104]


def test_blocks_of_a_list_do_not_change_what_is_found(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = neighbours.nearest(df, F.col("vec_id") % 5 == 0).collect()
    monkeypatch.setattr(neighbours, "PART", 40)
    monkeypatch.setattr(neighbours, "TURN", 7)
    split = neighbours.nearest(df, F.col("vec_id") % 5 == 0).collect()
    # blocks are summed in another order, scores are not
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole)) and len(whole) == 120 * 5


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_each_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    rows += [(1000 + i, rng.standard_normal(4).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found.keys() == {0, 50, 100, 1000, 1050} and all(len(v) == 5 for v in found.values())
    assert all((v >= 1000) == (q >= 1000) for q, vs in found.items() for v in vs)


def test_search_is_widened_until_true_neighbours_are_found(spark, monkeypatch):
    """Vectors without clusters, whose neighbours lie in many lists."""
    monkeypatch.setattr(neighbours, "LIST", 10)
    rng = np.random.default_rng(8)
    x = np.sign(rng.standard_normal((3000, 48)))
    x[::50] += 2  # queries are unlike the others
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 50):
        score = neighbours.cosine(np.repeat(x[q : q + 1], len(x), 0), x)
        score[q] = -2
        hits += len(found[q] & set(np.lexsort((np.arange(len(x)), -score))[:5].tolist()))
    assert hits >= 0.9 * 300
