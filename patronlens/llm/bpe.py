"""Byte-level BPE: encoding in padded numpy matrices, and decoding.

Texts are cut by the public pattern. Pieces not seen before are sorted into buckets of like length;
a bucket is a matrix of token ids with one row per piece, padded at the end, beside a matrix of the
ranks of neighbouring pairs. In each round every row merges its leftmost pair of least rank, closes
the gap, and looks up the two pairs that changed in a hash table; rows without a pair are done.

Pieces over ``LONG`` bytes would need that many rounds of that width; they are merged one by one
with a heap, in the same order. Nulls: a null text is empty, has no ids and decodes to nothing. Rows with equal
ids are separate rows; columns that are not asked for are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = 512
CACHED_PIECES = 200_000
# Characters or ids that a worker takes at a time: their pieces, and the matrices they are merged in, are all held at once.
CHUNK = 250_000
NONE = np.int32(2**31 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Rank of two neighbouring tokens; open addressing in arrays of a power of two."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[slots] == keys
            self.ranks[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], self._next(slots[~placed])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MULTIPLIER >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & ((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids in arrays of one shape; negative ids pair with nothing."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        open_ = np.nonzero((left.ravel() >= 0) & (right.ravel() >= 0))[0]
        slots = self._slots(keys[open_])
        while len(open_):
            there = self.keys[slots]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slots[hit]]
            going = ~hit & (there != -1)
            open_, slots = open_[going], self._next(slots[going])
        return out.reshape(left.shape)


class Codec:
    """Encodes and decodes by ranks; the same ids as the public library."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = vocabulary(ranks)
        self._forget()

    def _forget(self) -> None:
        #: Place of a piece in ``sizes`` and ``starts``; its ids stand in ``flat``.
        self.known: dict[str, int] = {}
        self.sizes = self.starts = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def _merge_matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids in order."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        columns = np.arange(lengths.max())
        inside = columns < lengths[:, None]
        ids = np.full(inside.shape, -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        ranks = np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE)
        done = np.full((len(pieces), ids.shape[1]), -1, np.int32)
        rows, columns = np.arange(len(pieces)), np.arange(ids.shape[1])
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[np.arange(len(rows)), at]
            live = best != NONE
            done[rows[~live], : ids.shape[1]] = ids[~live]
            rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
            each = np.arange(len(rows))
            behind = columns > at[:, None]
            ids = np.where(behind, np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1), ids)
            ranks = np.where(behind, np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), ranks)
            ids[each, at] = best
            ranks[each, at] = self.pairs.find(best, ids[each, np.minimum(at + 1, columns[-1])])
            before = np.maximum(at - 1, 0)
            left = np.where(at > 0, self.pairs.find(ids[each, before], best), ranks[each, before])
            ranks[each, before] = left
            width = int((ids >= 0).sum(axis=1).max()) + 1
            ids, ranks, columns = ids[:, :width], ranks[:, :width], columns[:width]
        return (done >= 0).sum(axis=1), done[done >= 0]

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j == len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids):
                    r = self.ranks.get(self.tokens[ids[a]] + self.tokens[ids[b]])
                    if r is not None:
                        heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def _add(self, pieces: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.sizes), len(self.sizes) + len(pieces))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def _learn(self, pieces: list[str]) -> None:
        data = [p.encode() for p in pieces]
        whole = np.fromiter((self.ranks.get(d, -1) for d in data), np.int64, len(data))
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        at = np.nonzero(whole >= 0)[0]
        self._add([pieces[i] for i in at], np.ones(len(at), np.int64), whole[at])
        for i in np.nonzero((whole < 0) & (lengths > LONG))[0]:
            ids = np.array(self._merge_long(data[i]))
            self._add([pieces[i]], np.array([len(ids)]), ids)
        width = 1
        while width < LONG:
            bucket = np.nonzero((whole < 0) & (lengths > width) & (lengths <= 2 * width))[0]
            width *= 2
            rows = max(1, (1 << 18) // width)
            for start in range(0, len(bucket), rows):
                some = bucket[start : start + rows].tolist()
                self._add([pieces[i] for i in some], *self._merge_matrix([data[i] for i in some]))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, without special tokens, and where each text ends in them.

        Pieces that are new in any of the texts are merged together.
        """
        cut = [self.cut(text) for text in texts]
        used = set().union(*cut)
        if len(self.known) > CACHED_PIECES:
            self._forget()
        self._learn(list(used.difference(self.known)))
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(ends[-1]) if len(ends) else 0)
        sizes = self.sizes[places]
        after = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.starts[places] - after[:-1], sizes)
        return self.flat[shift + np.arange(after[-1])], after[ends]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def vocabulary(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks.items()}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of about ``CHUNK`` characters or ids of the first column."""
    first = batch.column(0)
    length = pc.list_value_length if pa.types.is_list(first.type) else pc.utf8_length
    sizes = np.cumsum(pc.fill_null(length(first), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = int(np.searchsorted(sizes, before + CHUNK)) + 1
        yield batch.slice(start, stop - start)
        start = stop


def _mapped(df: DataFrame, column: str, out: list[T.StructField], path: str, make, work) -> DataFrame:
    """``df`` without ``column`` and with the columns ``out``, made by ``work(tool, values)``.

    The tool, ``make(ranks)``, is made once per worker process and kept beside the shared ranks.
    """
    shared = df.sparkSession.sparkContext.broadcast({"ranks": load_ranks(path)})
    rest = [f for f in df.schema.fields if f.name != column]
    source = df.select(F.col(column).alias("_value"), *[F.col(f.name).alias(f"_{i}") for i, f in enumerate(rest)])
    fields = [T.StructField(f"_{i}", f.dataType) for i, f in enumerate(rest)]
    made = [T.StructField(f"_made{i}", f.dataType) for i, f in enumerate(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "tool" not in held:
            held["tool"] = make(held.pop("ranks"))
        for batch in batches:
            for part in _parts(batch):
                arrays = [*part.columns[1:], *work(held["tool"], part.column(0))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in (*fields, *made)])

    mapped = source.mapInArrow(run, T.StructType([*fields, *made]))
    names = [f.name for f in (*rest, *out)]
    return mapped.toDF(*names)


def _ids(codec: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, ends = codec.encode_all([t or "" for t in texts.to_pylist()])
    return flat, np.concatenate([[0], ends])


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _bytes(tokens: dict[int, bytes], flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """``df`` with ``ids_column``, the token ids of ``text_column`` by the rank file at ``path``, in place of the text."""
    field = T.StructField(ids_column, T.ArrayType(T.IntegerType()))
    return _mapped(
        df, text_column, [field], path, lambda ranks: Codec(ranks, pattern), lambda codec, texts: [_lists(*_ids(codec, texts))]
    )


def decode(df: DataFrame, path: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_column``, the bytes that ``ids_column`` stands for, in place of the ids; null ids are none."""

    def work(tokens: dict[int, bytes], rows: pa.Array) -> list[pa.Array]:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))])
        return [_bytes(tokens, rows.flatten().to_numpy(zero_copy_only=False), ends.astype(np.int64))]

    return _mapped(df, ids_column, [T.StructField(bytes_column, T.BinaryType())], path, vocabulary, work)


def round_trip(df: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, the bytes those ids stand for, in place of the text, in one pass."""

    def work(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        flat, ends = _ids(codec, texts)
        return [_lists(flat, ends), _bytes(codec.tokens, flat, ends)]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return _mapped(df, text_column, fields, path, lambda ranks: Codec(ranks, pattern), work)
