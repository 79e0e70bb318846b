"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words, the patterns are windows of consecutive benchmark words. For windows of one
length the block shift table says, for the last few words before a position, how far the search may
jump without missing a window; blocks of no window allow the longest jump. Where the shift is zero,
the bucket of the block's hash lists the windows that end with it; their first block, all word codes
and at last the letters themselves are compared. Many stretches of a batch are searched side by
side, a numpy step moves all of them.

Benchmarks go to the executors in blocks of bounded size; one with more than a block is searched for
block by block, each adding to the hits found before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from .scratch import received, shipped, stored
from .words import ALNUM, LOWER, U64, mix, slices, text_buffer, word_bounds, word_codes

#: Bytes of benchmark text that are sent to the executors at once.
BLOCK_BYTES = 8 << 20
#: Blocks searched in one pass over the documents.
BLOCKS_PER_PASS = 4
#: Words in a block of the shift table.
SHIFT_WORDS = 3
#: Stretches searched side by side.
LANES = 4096
DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _block(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0]
    for c in columns[1:]:
        h = h * U64(0xD6E8FEB86659FD93) + c
    return mix(h)


class Windows:
    """All windows of one length: shift table, buckets and the items of each window."""

    def __init__(self, rows: np.ndarray, items: np.ndarray):
        self.length = rows.shape[1]
        self.block = min(SHIFT_WORDS, self.length)
        flat = np.ascontiguousarray(rows).view(f"V{8 * self.length}").ravel()
        _, at, of = np.unique(flat, return_index=True, return_inverse=True)
        rows = rows[at]
        self.bits = max(14, int(len(rows) * self.length * 8).bit_length())
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.uint8 if self.length < 256 else np.int64)
        for end in range(self.block - 1, self.length):
            slot = self._slot(_block(list(rows[:, end - self.block + 1 : end + 1].T)))
            np.minimum.at(self.shift, slot, self.length - 1 - end)
        suffix = _block(list(rows[:, -self.block :].T))
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.rows = suffix[order], rows[order]
        self.prefix = _block(list(self.rows[:, : self.block].T))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[of], items], 1), axis=0)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def _ending(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _block([codes[at - k] for k in range(self.block - 1, -1, -1)])

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Last positions of stretches whose last block ends some window."""
        first, n = self.length - 1, len(codes)
        if n <= first:
            return np.zeros(0, np.int64)
        lanes = min(LANES, (n - first) // 64 + 1)
        edge = np.linspace(first, n, lanes + 1).astype(np.int64)
        at, end, out = edge[:-1], edge[1:], []
        while len(at):
            jump = self.shift[self._slot(self._ending(codes, at))]
            out.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < end
            at, end = at[live], end[live]
        return np.concatenate(out)

    def matches(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of occurrences within one row, by word codes."""
        at = self.candidates(codes)
        begin = at - self.length + 1
        row = np.searchsorted(first, at, "right") - 1
        inside = first[row] <= begin
        at, begin = at[inside], begin[inside]
        h = self._ending(codes, at)
        lo, hi = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        head = _block([codes[begin + k] for k in range(self.block)])
        starts, found = [], []
        for k in range(int((hi - lo).max(initial=0))):  # the k-th window of every bucket
            live = lo + k < hi
            lo, hi, begin, head = (x[live] for x in (lo, hi, begin, head))
            same = np.flatnonzero(self.prefix[lo + k] == head)
            for j in range(self.length):
                same = same[codes[begin[same] + j] == self.rows[lo[same] + k, j]]
            starts.append(begin[same])
            found.append(lo[same] + k)
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


class Benchmark:
    """The windows of a block of benchmark items, by length, and the letters of their words."""

    def __init__(self, items: list, texts: list[str], width: int):
        column = pa.array(texts, pa.string())
        data, offsets = text_buffer(column)
        starts, ends, first = word_bounds(data, offsets, ALNUM)
        codes = word_codes(data, starts, ends)
        self.ids = items
        by_length: dict[int, list] = {}
        for item, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if b > a:
                length = int(min(width, b - a))
                rows = np.lib.stride_tricks.sliding_window_view(codes[a:b], length)
                by_length.setdefault(length, []).append((rows, np.full(len(rows), item)))
        self.windows = [
            Windows(np.concatenate([r for r, _ in parts]), np.concatenate([i for _, i in parts]))
            for _, parts in sorted(by_length.items())
        ]
        self.codes, at = np.unique(codes, return_index=True)
        self.data, self.starts, self.ends = LOWER[data], starts[at], ends[at]

    def _same_letters(self, data, starts, ends, codes) -> np.ndarray:
        """Whether words are those of the benchmark that have their code."""
        of = np.searchsorted(self.codes, codes)
        size = ends - starts
        same = size == self.ends[of] - self.starts[of]
        starts, of, size = starts[same], of[same], size[same]
        if len(size):
            begin = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(begin, size)
            equal = LOWER[data[np.repeat(starts, size) + step]] == self.data[np.repeat(self.starts[of], size) + step]
            same[same] = np.logical_and.reduceat(equal, begin)
        return same

    def search(self, data, starts, ends, codes, first):
        """Hit words, and the (row, item) pairs of all occurrences."""
        change = np.zeros(len(codes) + 1, np.int64)
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w in self.windows:
            begin, found = w.matches(codes, first)
            if not len(begin):
                continue
            used = np.unique((begin[:, None] + np.arange(w.length)).ravel())
            wrong = used[~self._same_letters(data, starts[used], ends[used], codes[used])]
            if len(wrong):
                right = np.searchsorted(wrong, begin) == np.searchsorted(wrong, begin + w.length)
                begin, found = begin[right], found[right]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + w.length, -1)
            many = w.items_from[found + 1] - w.items_from[found]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            rows.append(np.repeat(np.searchsorted(first, begin, "right") - 1, many))
            items.append(w.items[np.repeat(w.items_from[found], many) + step])
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], 1), axis=0)
        return np.cumsum(change[:-1]) > 0, pairs


def _digest(n_words: int, hit: np.ndarray, items: list) -> dict:
    n_hit = int(hit.sum())
    listed = ",".join(sorted(map(str, items)))
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "contaminated": n_hit > 0 and 20 * n_hit >= n_words,
    }


def _scan(benchmarks: list, text: str, state: str, carried: bool, last: str | None):
    """A pass over documents. ``state`` is the column that carries hits of earlier passes on; the
    last pass gives the digest ("digest") or the clean rows ("clean")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [received(x) for x in benchmarks]
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_buffer(part[text])
                starts, ends, first = word_bounds(data, offsets, ALNUM)
                codes = word_codes(data, starts, ends)
                hit = np.zeros(len(codes), bool)
                items: list[set] = [set() for _ in range(part.num_rows)]
                if carried:
                    before = part[state].to_pylist()
                    for row, x in enumerate(before):
                        a, b = first[row], first[row + 1]
                        hit[a:b] = np.unpackbits(np.frombuffer(x["hit"], np.uint8), count=b - a)
                        items[row].update(x["items"])
                for table in tables:
                    more, pairs = table.search(data, starts, ends, codes, first)
                    hit |= more
                    for row, item in pairs.tolist():
                        items[row].add(table.ids[item])
                spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                rest = part.drop_columns([state]) if carried else part
                if last is None:
                    kept = pa.array(
                        [{"hit": np.packbits(hit[a:b]).tobytes(), "items": sorted(i)} for (a, b), i in zip(spans, items, strict=True)],
                        pa.struct([("hit", pa.binary()), ("items", pa.list_(pa.int64()))]),
                    )
                    yield rest.append_column(state, kept)
                    continue
                found = [_digest(b - a, hit[a:b], i) for (a, b), i in zip(spans, items, strict=True)]
                if last == "clean":
                    yield rest.filter(pa.array([not x["contaminated"] for x in found], pa.bool_()))
                else:
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": rest["doc_id"]} | {k: pa.array([x[k] for x in found]) for k in found[0]}
                    )

    return run


def _blocks(benchmark: DataFrame, text: str, limit: int) -> Iterator[list[Row]]:
    """Items in blocks; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select("item_id", text).where(f"item_id is not null and `{text}` is not null")
    for row in rows.toLocalIterator(prefetchPartitions=False):
        block.append(row)
        size += len(row[1].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(docs: DataFrame, benchmark: DataFrame, last: str, width: int, text: str, limit: int) -> DataFrame:
    state = "__hits"
    while state in docs.columns:
        state += "_"
    schema = docs.schema
    spark, carried = docs.sparkSession, False
    waiting: list = []

    def through(last: str | None) -> DataFrame:
        if last == "digest":
            out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGEST}"
        elif last == "clean":
            out = schema
        else:
            out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            out += f", `{state}` struct<hit: binary, items: array<bigint>>"
        return docs.mapInArrow(_scan(waiting, text, state, carried, last), out)

    for block in _blocks(benchmark, text, limit):
        if len(waiting) == BLOCKS_PER_PASS:
            docs, carried, waiting = stored(through(None)), True, []
        items, texts = zip(*block, strict=True)
        waiting = [*waiting, shipped(spark, Benchmark(list(items), list(texts), width))]
    return through(last)


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window of
    ``width`` benchmark words, or of a whole shorter item), n_items (items with such windows),
    items_sha256 (of their ids, sorted as strings, comma-joined) and contaminated (n_hit > 0 and at
    least a twentieth of the words).

    A null or empty text has no words and is clean. Items without id or words take no part; rows of
    the benchmark with the same id are one item. Repeated documents give repeated rows, other columns
    are ignored, an empty table gives an empty result.
    """
    docs = docs.select("doc_id", text)
    return _search(docs, benchmark, "digest", width, text, block_bytes)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``contamination`` finds clean."""
    return _search(docs, benchmark, "clean", width, text, block_bytes)


#: The query over ``documents`` and ``benchmark`` as SQL, by a join of all windows.
CONTAMINATION_SQL = """
with texts as (
  select row_number() over () as row_id, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
  from documents
), items as (
  select item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark where item_id is not null and text is not null
), sized as (
  select *, least(13, len(w)) as k from items where len(w) > 0
), windows as (
  select distinct item_id, k, array_to_string(w[j:j + k - 1], ' ') as said
  from (select *, unnest(range(1, len(w) - k + 2)) as j from sized)
), spans as (
  select row_id, k, j, array_to_string(w[j:j + k - 1], ' ') as said
  from (select *, unnest(range(1, len(w) - k + 2)) as j
    from texts, (select distinct k from sized) where len(w) >= k)
), found as (
  select row_id, j, k, item_id from spans join windows using (k, said)
), hits as (
  select row_id, count(distinct place) as n_hit
  from (select row_id, unnest(range(j, j + k)) as place from found) group by row_id
), of_items as (
  select row_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct row_id, item_id::varchar as item from found) group by row_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from texts left join hits using (row_id) left join of_items using (row_id)
"""
