"""Vector codes, spelling variants and token files against brute force."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fieldspark.llm import spelling, token_files, vector_codes
from fieldspark.llm.queries import TOKENIZER
from fieldspark.llm.spelling import counted_words, near_pairs, spelling_variants
from fieldspark.llm.vector_codes import Balls, codes_digest, compressed

# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Lists of Python integers, every part against every entry. Vectors of one length."""
    kept = [(i, [math.floor(c * 1024) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, next(x[1] for x in rows if x[0] == r[0])))
    dims = len(kept[0][1])
    cuts = [dims * k // parts for k in range(parts + 1)]
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for a, b in zip(cuts, cuts[1:]):
        book = [r[1][a:b] for r in order[:entries]]

        def nearest(x):
            return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            groups = defaultdict(list)
            for r in kept:
                groups[nearest(r[1][a:b])[1]].append(r[1][a:b])
            for k, group in groups.items():
                book[k] = [sum(c) // len(group) for c in zip(*group)]
        for j, r in enumerate(kept):
            d, k = nearest(r[1][a:b])
            codes[j] += f"{k:02x}"
            errors[j] += d
        books += [str(c) for e in book for c in e]
    sums = defaultdict(int)
    for r, e in zip(kept, errors):
        sums[r[2]] += e
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    fits = lambda e: e if e < 1 << 63 else None
    broken = {r[2] for r, e in zip(kept, errors) if fits(e) is None}
    return sorted(((r[0], codes[j], fits(errors[j]), None if r[2] in broken else fits(sums[r[2]]), sha) for j, r in enumerate(kept)), key=str)


def vectors(rng, n, dims, scale=1.0, offset=0):
    centres = rng.standard_normal((9, dims)) * scale
    x = centres[rng.integers(0, 9, n)] + 0.3 * scale * rng.standard_normal((n, dims))
    return [(offset + i, v.tolist(), int(i % 3) if i % 5 else None) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "dims", "scale"), [(700, 16, 1.0), (300, 6, 1.0), (90, 8, 1.0), (280, 4, 1e7), (40, 4, 1e25)])
def test_codes_are_those_of_brute_force(spark, clashing, n, dims, scale):
    rows = vectors(np.random.default_rng(n), n, dims, scale)
    copy = rows[5][1]
    rows += [(1000 + i, copy, 1) for i in range(60)] + [(7, rows[7][1], None), (None, rows[9][1], 2)]
    odd = [(-3, None, 1), (-2, [math.nan] + [0.0] * (dims - 1), 1), (-1, [math.inf] * dims, 1), (-4, [None] + [1.0] * (dims - 1), 1)]
    df = clashing(spark.createDataFrame(rows + odd, VECTORS).repartition(5))
    got = sorted((tuple(r) for r in codes_digest(df).collect()), key=str)
    assert got == brute_codes(rows + odd)


def test_each_length_has_codebooks_of_its_own(spark):
    rng = np.random.default_rng(1)
    a, b = vectors(rng, 50, 8), vectors(rng, 40, 5, offset=100)
    got = codes_digest(spark.createDataFrame([*a, *b, (999, [], 1)], VECTORS).drop("label").selectExpr("*", "vec_id as label"))
    shas = {len(v): brute_codes([(i, v, i) for i, v, _ in rows])[0][4] for rows in (a, b) for _, v, _ in rows[:1]}
    found = {r.vec_id: r for r in got.collect()}
    assert len(found) == 91 and found[999].error == 0
    assert all(found[i].codebooks_sha256 == shas[len(v)] for i, v, _ in a + b)


def test_codes_of_empty_tables_and_their_vectors(spark):
    assert codes_digest(spark.createDataFrame([], VECTORS)).count() == 0
    rows = vectors(np.random.default_rng(3), 500, 16)
    done = compressed(spark.createDataFrame(rows, VECTORS), entries=64)
    got = {r.vec_id: r for r in done.codes.collect()}
    again = done.codebooks[16].vectors(np.array([got[i].code for i, _, _ in rows]))
    x = np.array([v for _, v, _ in rows])
    assert np.mean((again - x) ** 2) < 0.2 * np.var(x)


def test_balls_change_no_assignment():
    """Started from any earlier assignment, the rings hold what a search of all entries finds."""
    rng = np.random.default_rng(5)
    entries = rng.integers(-9, 9, (60, 3)).astype(float)
    entries[7] = entries[3]
    x = rng.integers(-9, 9, (4000, 3)).astype(float)
    before = rng.integers(0, 60, 4000)
    want = np.argmin(((x[:, None] - entries) ** 2).sum(2), axis=1)
    assert (Balls(entries, np.ones(60, bool)).assigned(x, before) == want).all()
    moved = rng.random(60) < 0.3
    old = np.where(moved[:, None], entries + rng.integers(-2, 2, (60, 3)), entries)
    before = np.argmin(((x[:, None] - old) ** 2).sum(2), axis=1)
    assert (Balls(entries, moved).assigned(x, before) == want).all()
    assert (Balls(entries, np.zeros(60, bool)).assigned(x, want) == want).all()


def test_seen_vector_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_codes, "shared_folder", lambda spark: f"file://{tmp_path}")
    codes_digest(spark.createDataFrame(vectors(np.random.default_rng(2), 30, 4), VECTORS)).collect()
    assert len(list(tmp_path.iterdir())) == 1


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, times=5):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] < times * n:
            best = None
        out[w] = [best, n, len(near), None if best is None else counts[best]]
    rows = []
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, near, form_n))
    return sorted(rows)


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def vocabulary(rng):
    words = set()
    for _ in range(60):  # chains of edits, some over words of the same letters
        w = "".join(rng.choices("abcdeé", k=rng.choice([1, 2, 5, 6, 7, 11, 12])))
        for _ in range(8):
            words.add(w)
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i:], w[:i] + rng.choice("abÿ") + w[i + 1 :]]) or "a"
    words |= {"prefix" + "".join(rng.choices("abcd", k=6)) for _ in range(250)}  # one half for many
    words |= {"".join(rng.choices("abcd", k=6)) + "suffix" for _ in range(250)}
    words |= {"a" * k for k in range(1, 30)} | {"ab" * 900, "ab" * 900 + "c", "ab" * 899 + "cb"}
    return {w: rng.choice([1, 2, 5, 30, 200, 7000]) for w in sorted(words)}


@pytest.mark.parametrize("pairs", [20_000, 30])
def test_variants_are_those_of_brute_force(spark, clashing, pairs):
    counts = vocabulary(random.Random(9))
    df = clashing(spark.createDataFrame(list(counts.items()), "word string, n long"))
    got = sorted(tuple(r) for r in spelling_variants(df, pairs=pairs).collect())
    assert got == brute_variants(counts)


def test_crowded_keys_are_narrowed(spark, monkeypatch):
    """Words that share a half are not compared with each other."""
    rng = random.Random(3)
    words = sorted({"internat" + "".join(rng.choices("abcdefghij", k=8)) for _ in range(1500)})
    levels = []
    cut = spelling._cut
    monkeypatch.setattr(spelling, "_cut", lambda rows: levels.append(1) or cut(rows))
    pairs = near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 1000)
    found = pairs.count()
    assert len(levels) >= 2 and found == sum(one_edit(a, b) for i, a in enumerate(words) for b in words[:i])


def test_variants_of_odd_words(spark):
    rows = [(None, 3), ("", 9), ("a", 5), ("b", 30), ("a", 1), ("bc", 4)]
    got = {r.word: tuple(r)[1:] for r in spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[None][3] == 0 and got[""] == (None, "", 9, 0, None)
    assert got["a"] == ("b", "b", 6, 1, 30) and got["bc"] == ("b", "b", 4, 1, 30)
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame(rows, "word string, n long"), times=1)


def test_words_are_counted_over_whole_texts(docs, clashing):
    rng = random.Random(2)
    words = ["Straße", "ÉCOLES", "écoles", "letters", "Letter", "short", "xabcdefg×abcdefg", "÷signs", "won't-forget"]
    rows = [(i, " ".join(rng.choices(words, k=300))) for i in range(30)]
    rows += [(30, None), (31, ""), (None, "letters " * 7), (3, "letters"), (32, "long" * 50_000 + " " + "letters," * 20_000), (33, "mixedİcase " * 9)]
    got = {r.word: r.n for r in counted_words(clashing(docs(rows))).collect()}
    assert got == brute_counts(rows)
    assert counted_words(docs([])).count() == 0


# ---------------------------------------------------------------- token files

PATH = public_tokenizers.path(TOKENIZER)
ODD = ["", None, " \t\n ", "It's O'Neil's <|endoftext|> <|ENDOFTEXT|>x<|startoftext|>", "é é ≠ a b 12٣ ¿qué? 世界🙂", 'a " quote', "x" * 40_000, "w\x1cq\x00z 'll 'LL ''s"]


def brute_tokens(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_the_tokens_in_order(spark, docs, clashing, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "AT_ONCE", 5000)
    rng = random.Random(6)
    pool = ["the", "Quick", "brown,", "fox's", "1984", "ärger", "—", "antidisestablishmentarianism", "\n"]
    rows = [(i * 3 - 50, " ".join(rng.choices(pool, k=rng.choice([0, 1, 9, 800])))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(1 << 40, "last of the long")]
    shuffled = rng.sample(rows, len(rows)) + [(None, "no id")]
    folder = token_files.written(clashing(docs(shuffled).repartition(7)), PATH, f"file://{tmp_path}/tokens")
    want = brute_tokens([*rows, (None, "no id")])
    assert sorted((tuple(r) for r in folder.digest(spark).collect()), key=lambda r: r[1]) == want
    back = {r.start: r for r in folder.ids(spark).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert all(back[s].ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for (_, t), (_, s, _, _) in zip(rows, want))


def test_token_files_with_repeated_ids_are_the_same_each_time(spark, docs):
    rows = [(i % 3, f"text number {i % 7}") for i in range(60)] + [(None, None)] * 3
    runs = [sorted(map(tuple, token_files.written(docs(rows).repartition(k), PATH).digest(spark).collect()), key=lambda r: r[1]) for k in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 63 and [r[0] for r in runs[0]] == [0] * 20 + [1] * 20 + [2] * 20 + [None] * 3
    assert token_files.written(docs([]), PATH).digest(spark).count() == 0


def test_units_are_encoded_as_whole_texts_are():
    rng = random.Random(1)
    letters = [*"aAbsStTdDlLvVeErmM''''!.,-–12٣<|>Éé̸́ \t 　 ßİΣσς世🙂\x1c\x00‍", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'re"]
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 3, 8, 30]))) for _ in range(8000)] + ODD
    units = token_files.UnitTokenizer(PATH)
    for _ in range(2):  # the second time all units are known
        ids, lengths = units(pa.array(texts, pa.string()))
        ends = np.cumsum(lengths)
        for text, n, end in zip(texts, lengths, ends):
            assert units.tokenizer.encode(text or "", add_special_tokens=False).ids == ids[end - n : end].tolist(), text
    whole = token_files.UnitTokenizer(PATH, units=False)(pa.array(texts, pa.string()))
    assert (whole[0] == ids).all() and (whole[1] == lengths).all()


def test_remembered_units_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    units = token_files.UnitTokenizer(PATH)
    for k in range(0, 900, 30):
        ids, _ = units(pa.array([" ".join(f"word{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(k, k + 30))]))
        assert len(units.known) <= 50 + 31 and len(ids)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    rng = np.random.default_rng(n)
    numbers = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    control, data = token_files.encode(numbers)
    assert (token_files.decode(control, data, n) == numbers).all()
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in numbers)
    if n:
        with pytest.raises(ValueError):
            token_files.decode(control, data[:-1], n)


def test_frames_join_documents_that_end_within_a_control_byte():
    rng = np.random.default_rng(8)
    each = [rng.integers(0, 1 << 20, n).astype(np.uint32) for n in (1, 0, 6, 4, 3)]
    blobs = [b"".join(x.tobytes() for x in token_files.encode(e)) for e in each]
    frame = token_files._frame(pa.array([5, None, 7, 8, 9]), np.array(list(map(len, each))), blobs)
    ((docs, lengths, ranks),) = token_files.frames(io.BytesIO(frame))
    assert docs.to_pylist() == [5, None, 7, 8, 9] and lengths.tolist() == [1, 0, 6, 4, 3]
    assert (ranks == np.concatenate(each)).all()
    with pytest.raises(ValueError):
        list(token_files.frames(io.BytesIO(b"nope" + frame)))


def test_frequent_ids_take_one_byte(spark, docs, tmp_path):
    folder = token_files.written(docs([(i, "the the the the the the rare" + str(i)) for i in range(50)]), PATH, f"file://{tmp_path}/t")
    files = [p.stat().st_size for p in tmp_path.glob("t/*.ids")]
    n = sum(r.n_tokens for r in folder.digest(spark).collect())
    assert sum(files) <= 1.25 * n + 17 * 50 + 30 * len(files)  # 13 ids: one byte each, a quarter for its length
