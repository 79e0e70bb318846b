"""Token ids of documents as compact binary files, in ascending document order.

Ids are replaced by their rank by frequency, so the most frequent ones are the smallest numbers, and
written in a byte-aligned variable length of one to four bytes. The lengths stand apart from the data: a
control byte holds the lengths of four numbers, two bits each, lowest bits first. Decoding looks lengths
up in a table by control byte and gathers all numbers of a frame at once.

A folder holds ``ranks.bin`` (the id of each rank, little-endian unsigned 32-bit), the files, and
``files``, a Parquet table with one row a file (place in document order, name, documents, ids). A file is a
row of frames:

    4 bytes   "FTK1"
    3 x 8     little-endian unsigned: documents d, ids n, data bytes
    d x 1     1 if the document has an id, else 0
    d x 8     the documents' ids, little-endian signed
    d x 8     how many token ids each document has, the end id included, little-endian unsigned
    (n+3)//4  control bytes; missing numbers of the last one count as zero bits
    ...       data bytes, lowest first

Texts are tokenised where they are, once. What Spark sorts by document id are the coded documents, after
a range partition that also splits one id's rows by their ranks. A task writes one file under a name of
its own; only names that a successful task returned get into ``files``, so repeated attempts leave
nothing that is read.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import received, shared_folder, shipped, stored
from .words import LOWER, SPACED, slices, text_buffer

MAGIC = b"FTK1"
#: Bytes of text that are tokenised, and of coded documents that are written, at once.
AT_ONCE = 2 << 20
#: Units of text whose ids a Python worker remembers, some 200 bytes each; beyond them it forgets all.
REMEMBERED = 1_200_000

_SMALL = re.compile("[a-zß-öø-ÿ]+")

_SPACE, _JOINED, _LETTER, _DIGIT, _OTHER = range(5)

# Control byte -> the lengths of its four numbers.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def _controls(extra: np.ndarray) -> np.ndarray:
    """Control bytes of four two-bit lengths each."""
    return (extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)


def encode(numbers: np.ndarray, place: np.ndarray | None = None, places: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers. ``place``: where among ``places`` (a
    multiple of four) each number's length stands, one after another unless given."""
    numbers = numbers.astype("<u4")
    extra = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    lengths = np.zeros(-(-len(numbers) // 4) * 4 if place is None else places, np.uint8)
    lengths[slice(len(numbers)) if place is None else place] = extra
    data = numbers.view(np.uint8).reshape(-1, 4)
    return _controls(lengths), data[np.arange(4) <= extra[:, None]]


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of control and data bytes."""
    lengths = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    if n and ends[-1] != len(data):
        raise ValueError(f"{len(data)} data bytes where control bytes announce {ends[-1]}")
    starts = ends - lengths
    numbers = np.zeros(n, np.uint32)
    for k in range(4):
        more = lengths > k if k else slice(None)
        numbers[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return numbers


class UnitTokenizer:
    """Ids of texts by a tokenizer that works on each unit of a text by itself, so that a unit is encoded
    once and remembered.

    ``units=True`` is for byte-level tokenizers that lower-case, drop white space, and split letters, single
    digits and other characters, contractions (``'s``) apart. A unit then ends at ASCII white space and between two ASCII characters
    of different kinds, but not within a contraction, next to a non-ASCII character (it may combine with its
    neighbour) or next to a character that stands in a special token. ``units=False`` encodes each text as a whole.
    """

    def __init__(self, path: str, units: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units = units
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode()
        self.kind = np.full(256, _OTHER, np.uint8)
        self.kind[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
        self.kind[list(b"0123456789")] = _DIGIT
        self.special = np.zeros(256, bool)
        self.special[[b for b in special if self.kind[b] == _OTHER]] = True
        self.kind[self.special] = _JOINED
        self.kind[128:] = _JOINED
        self.kind[~SPACED] = _SPACE
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _encoded(self, texts: list[str]) -> Iterator[list[int]]:
        for k in range(0, len(texts), 10_000):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + 10_000], add_special_tokens=False):
                yield e.ids

    def _encoded_units(self, units: list[str]) -> Iterator[list[int]]:
        """Units of small letters alone need neither normalising nor splitting, only the tokenizer's
        model, and before it the bytes' letters where some are not ASCII."""
        plain = [_SMALL.fullmatch(u) is not None for u in units]
        others = self._encoded([u for u, p in zip(units, plain, strict=True) if not p])
        tokenize = self.tokenizer.model.tokenize
        for u, p in zip(units, plain, strict=True):
            if p and not u.isascii():
                u = self.letters.pre_tokenize_str(u)[0][0]
            yield [t.id for t in tokenize(u)] if p else next(others)

    def bounds(self, data: np.ndarray, offsets: np.ndarray):
        """Starts and ends of all units, and for each row the index of its first unit (n + 1)."""
        kind = self.kind[data]
        apart = np.ones(len(data) + 1, bool)  # before this byte a unit may begin or end
        a, b = kind[:-1], kind[1:]
        apart[1:-1] = (a == _SPACE) | (b == _SPACE)
        apart[1:-1] |= (np.minimum(a, b) > _JOINED) & ((a != b) | (a == _DIGIT)) & ~((data[:-1] == ord("'")) & (b == _LETTER))
        apart[offsets] = True
        starts = np.flatnonzero(apart[:-1] & (kind != _SPACE))
        ends = np.flatnonzero(apart[1:] & (kind != _SPACE)) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def _lowered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A-Z in lower case, but for units that may hold a special token."""
        lowered = LOWER[data]
        for k in np.unique(np.searchsorted(starts, np.flatnonzero(self.special[data]), "right") - 1):
            lowered[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        return lowered

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; null counts as empty."""
        if not self.units:
            each = list(self._encoded([x or "" for x in column.to_pylist()]))
            lengths = np.array([len(x) for x in each], np.int64)
            return np.fromiter((i for x in each for i in x), np.uint32, int(lengths.sum())), lengths
        data, offsets = text_buffer(column)
        starts, ends, first = self.bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        turns = np.empty(len(starts) * 2 + 1, np.int64)  # units and what is between them
        turns[0:-1:2], turns[1::2], turns[-1] = starts, ends, len(data)
        runs = pa.LargeStringArray.from_buffers(len(turns) - 1, pa.py_buffer(turns), pa.py_buffer(self._lowered(data, starts, ends)))
        units = runs.take(pa.array(np.arange(0, len(turns) - 1, 2))).dictionary_encode()
        if len(self.known) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self._forget()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [u for u in distinct if u not in self.known]
        for u, ids in zip(new, self._encoded_units(new), strict=True):
            self.known[u] = len(self.known)
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
        of = np.fromiter((self.known[u] for u in distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        every, until = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        begin, counts = until[of], until[of + 1] - until[of]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = every[np.arange(total[-1]) + np.repeat(begin - total[:-1], counts)]
        del every, until  # the arrays grow again
        return ids, total[first[1:]] - total[first[:-1]]


def _of_this_worker(path: str, units: bool) -> UnitTokenizer:
    """The tokenizer of this Python process. Functions travel with each task by value, so a global of
    this module would not outlive it; a module that only this process has does."""
    kept = sys.modules.setdefault("fieldspark_worker", ModuleType("fieldspark_worker")).__dict__
    return kept.get((path, units)) or kept.setdefault((path, units), UnitTokenizer(path, units))


def _tokenized(path: str, units: bool, end: int | None, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _of_this_worker(path, units)
        for whole in batches:
            for batch in slices(whole, "text", AT_ONCE):
                ids, lengths = tokenizer(batch["text"])
                if end is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end)
                    lengths = lengths + 1
                bounds = np.concatenate([[0], np.cumsum(lengths)]) * kind.itemsize
                yield pa.RecordBatch.from_arrays([batch["doc"], _binary(ids.astype(kind), bounds)], ["doc", "ids"])

    return run


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the bytes between the bounds."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).cast(pa.binary())


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and the n + 1 bounds of its rows."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rows_of(batch: pa.RecordBatch, name: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes in a binary column."""
    bounds = _bytes_of(batch[name])[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _counted(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for whole in batches:
            for batch in _rows_of(whole, "ids", AT_ONCE):
                seen = np.bincount(_bytes_of(batch["ids"])[0].view(kind), minlength=len(total))
                seen[: len(total)] += total
                total = seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return run


def _coded(ranks_of, kind: np.dtype):
    """Each document's ids as ranks in their coding: its control bytes, then its data bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = received(ranks_of)
        for whole in batches:
            for batch in _rows_of(whole, "ids", AT_ONCE):
                raw, bounds = _bytes_of(batch["ids"])
                bounds = bounds // kind.itemsize
                lengths = np.diff(bounds)
                whole4 = -(-lengths // 4) * 4  # each document begins with a control byte of its own
                at = np.cumsum(whole4) - whole4
                place = np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], lengths)
                control, data = encode(rank[raw.view(kind)], place, int(whole4.sum()))
                sizes = np.zeros(int(whole4.sum()), np.int64)
                sizes[place] = LENGTHS[control].ravel()[place]
                data_to = np.concatenate([[0], np.cumsum(sizes)])[np.append(at, whole4.sum())].tolist()
                control_to = (np.append(at, whole4.sum()) // 4).tolist()
                c, d = control.tobytes(), data.tobytes()
                blobs = [c[control_to[k] : control_to[k + 1]] + d[data_to[k] : data_to[k + 1]] for k in range(len(lengths))]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"], pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())], ["doc", "n", "coded"]
                )

    return run


def _frame(docs: pa.Array, lengths: np.ndarray, blobs: list[bytes]) -> bytes:
    """Documents that were coded one by one as a frame. Where one does not end on a whole control
    byte, the controls are joined number by number; data bytes stay as they are."""
    sizes = [-(-n // 4) for n in lengths.tolist()]
    control = np.frombuffer(b"".join(b[:s] for b, s in zip(blobs, sizes, strict=True)), np.uint8)
    data = b"".join(b[s:] for b, s in zip(blobs, sizes, strict=True))
    used = np.zeros(len(control) * 4, bool)
    at = np.cumsum(sizes) - sizes
    for a, n in zip((at * 4).tolist(), lengths.tolist(), strict=True):
        used[a : a + n] = True
    extra = (LENGTHS[control].ravel() - 1)[used]
    joined = np.zeros(-(-len(extra) // 4) * 4, np.uint8)
    joined[: len(extra)] = extra
    has = np.asarray(pc.is_valid(docs)).astype(np.uint8)
    return b"".join(
        [
            MAGIC,
            np.array([len(lengths), lengths.sum(), len(data)], "<u8").tobytes(),
            has.tobytes(),
            np.asarray(docs.fill_null(0)).astype("<i8").tobytes(),
            lengths.astype("<u8").tobytes(),
            _controls(joined).tobytes(),
            data,
        ]
    )


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A folder that pyarrow can reach: a path, or a URI of a store it knows (file, hdfs, s3, gs, …)."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def _filed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        place, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids"
        out, docs, ids = None, 0, 0
        for whole in batches:
            for batch in _rows_of(whole, "coded", AT_ONCE):
                out = out or store.open_output_stream(f"{path}/{name}")
                lengths = batch["n"].to_numpy()
                out.write(_frame(batch["doc"], lengths, batch["coded"].to_pylist()))
                docs, ids = docs + batch.num_rows, ids + int(lengths.sum())
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"place": place, "file": name, "docs": docs, "ids": ids}])

    return run


def frames(stream) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, ids per document, ranks) of each frame of a file."""
    while head := stream.read(4):
        if head != MAGIC:
            raise ValueError("not a frame of token ids")
        d, n, size = np.frombuffer(stream.read(24), "<u8").tolist()
        has = np.frombuffer(stream.read(d), np.uint8)
        docs = pa.array(np.frombuffer(stream.read(8 * d), "<i8"), pa.int64(), mask=has == 0)
        lengths = np.frombuffer(stream.read(8 * d), "<u8").astype(np.int64)
        control = np.frombuffer(stream.read(-(-n // 4)), np.uint8)
        yield docs, lengths, decode(control, np.frombuffer(stream.read(size), np.uint8), n)


def _read(folder: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        ids_of = None
        for batch in batches:
            for r in batch.to_pylist():
                if ids_of is None:
                    with store.open_input_stream(f"{path}/ranks.bin") as f:
                        ids_of = np.frombuffer(f.read(), "<u4")
                start = r["start"]
                with store.open_input_stream(f"{path}/{r['file']}") as f:
                    for docs, lengths, ranks in frames(f):
                        ids = ids_of[ranks]
                        bounds = np.concatenate([[0], np.cumsum(lengths)])
                        columns = [docs, pa.array(start + bounds[:-1]), pa.array(lengths)]
                        if digest:
                            raw = ids.tobytes()
                            own = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                            columns.append(pa.array(own, pa.int64()))
                        else:
                            columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "n", "ids"])
                        start += int(bounds[-1])

    return run


@dataclass
class TokenFolder:
    """A written folder; ``id`` names the documents' id column."""

    path: str
    id: str = "doc_id"

    def _files(self, spark: SparkSession) -> DataFrame:
        """(file, start): one row a file, each read by a task of its own."""
        files = spark.read.parquet(f"{self.path}/files").orderBy("place").collect()
        starts = np.cumsum([0, *(r["ids"] for r in files)]).tolist()
        rows = [(r["file"], s) for r, s in zip(files, starts, strict=False)]
        return spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)), "file")

    def ids(self, spark: SparkSession) -> DataFrame:
        """(id, start, n_tokens, ids array<long>) per document, read from the files."""
        rows = self._files(spark).mapInArrow(_read(self.path, False), "doc long, start long, n long, ids array<long>")
        return rows.select(F.col("doc").alias(self.id), "start", F.col("n").alias("n_tokens"), "ids")

    def digest(self, spark: SparkSession) -> DataFrame:
        """(id, start, n_tokens, ids_crc32) per document, read from the files."""
        rows = self._files(spark).mapInArrow(_read(self.path, True), "doc long, start long, n long, ids long")
        return rows.select(F.col("doc").alias(self.id), "start", F.col("n").alias("n_tokens"), F.col("ids").alias("ids_crc32"))


def written(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    id: str = "doc_id",
    text: str = "text",
    end: int | None = 1,
    units: bool = True,
) -> TokenFolder:
    """Writes the token ids of all whole texts, each followed by ``end``, in ascending order of ``id``.

    ``tokenizer``: a file of the tokenizers library, at that path on every machine; special tokens are
    not added. ``units``: see ``UnitTokenizer``. A null text counts as empty and has the end id alone; documents without
    id come last; equal ids are ordered by what their texts encode to, so reruns agree. An empty
    table gives a folder without files. Other columns are ignored. ``path`` is new and reachable from
    all machines (default: a folder in the shared one). The driver gets one row a file, and one a token id that occurs.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    largest = max([*UnitTokenizer(tokenizer).tokenizer.get_vocab().values(), end or 0])
    kind = np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")
    ids = stored(rows.mapInArrow(_tokenized(tokenizer, units, end, kind), "doc long, ids binary"))

    counts = ids.select("ids").mapInArrow(_counted(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()], "<u4")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, "<u4")
    rank[by_rank] = np.arange(len(by_rank))

    coded = ids.mapInArrow(_coded(shipped(spark, rank), kind), "doc long, n long, coded binary")
    order = [F.asc_nulls_last("doc"), F.xxhash64("coded")]
    files = coded.repartitionByRange(*order).sortWithinPartitions(*order, "coded")
    files.mapInArrow(_filed(_made(spark, path, by_rank)), "place long, file string, docs long, ids long").write.parquet(f"{path}/files")
    return TokenFolder(path, id)


def _made(spark: SparkSession, path: str, by_rank: np.ndarray) -> str:
    """Creates the folder with its ranks, small and written once by the driver."""
    store, folder = _place(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/ranks.bin") as f:
        f.write(by_rank.tobytes())
    return path
