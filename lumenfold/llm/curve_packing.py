"""Packing along a space-filling curve.

Each document becomes the sum of fixed pseudo-random sign vectors of its token
ids (feature hashing and projection in one), a point in few dimensions; its
Hilbert index is the sort key. Range-sorted by (key, doc_id), the documents form
one stream of ids that is cut every ``length`` ids, so neighbours on the curve
share a sequence and only the stream's last sequence is not full. That rest is
split into powers of two, which need no padding.

Only one total a partition reaches the driver. Ties of the key go by doc_id, so a
large group of copies is spread over partitions.

Defined cases: a null text is empty and yields its end id alone; a null doc_id is
kept; repeated rows are packed each; a document longer than a sequence runs over
several; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fan_out, release, stage, text_of
from .tokens import encoder

DIMS, BITS = 4, 12


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of rows of unsigned coordinates below 2**bits, by Skilling's transposition (2004)."""
    x = points.T.astype(np.int64).copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions(ids: int, dims: int, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (ids, dims))


def curve_keys(encoded: list[bytes], signs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents given as 16-bit ids; none of them may be empty."""
    flat = np.frombuffer(b"".join(encoded), "<u2")
    sizes = np.array([len(x) // 2 for x in encoded], np.int64)
    sums = np.add.reduceat(signs[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
    unit = sums / sizes[:, None]  # mean direction: copies of a text with other lengths stay near
    cells = (np.tanh(4 * unit) + 1) / 2 * (2**bits - 1)
    return hilbert(np.rint(cells).astype(np.int64), bits)


def cut_points(begin: int, end: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """Pieces (begin, end, sequence, offset) of the stream's ids from begin to end, of total in the stream."""
    full, out = total - total % length, []
    while begin < end:
        if begin < full:
            seq, at = divmod(begin, length)
            stop = min(end, (seq + 1) * length)
            out.append((begin, stop, seq, at))
        else:
            seq, floor, rest = full // length, full, total - full
            while True:
                size = 1 << (rest.bit_length() - 1)
                if begin < floor + size:
                    break
                floor, rest, seq = floor + size, rest - size, seq + 1
            stop = min(end, floor + size)
            out.append((begin, stop, seq, begin - floor))
        begin = stop
    return out


def placed_at(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition of the stream with the number of its ids before each; the encoder's table is not needed any more."""
    release()
    at = 0
    for b in batches:
        ends = at + np.cumsum(b["n"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int64)), pa.array(ends - b["n"].to_numpy()), b["doc_id"], b["n"], b["ids"]], names=["part", "at", "doc_id", "n", "ids"])
        at = int(ends[-1]) if len(ends) else at


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 16-bit little-endian)."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = encoder(vocabulary), np.array([end_id], "<u2").tobytes()
        signs = directions(tok.library.get_vocab_size(), DIMS)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [x + end for x in map(tok.encode, part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(curve_keys(ids, signs)), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "key", "n", "ids"])
        pa.default_memory_pool().release_unused()  # the table stays for the worker's next task

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return placed_at(batches, TaskContext.get().partitionId())

    encoded, first = stage(text_of(docs).mapInArrow(encode, "doc_id long, key long, n long, ids binary"), "packing-ids")
    ordered = encoded.repartitionByRange(fan_out(docs), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    placed, _ = stage(ordered.mapInArrow(place, "part long, at long, doc_id long, n long, ids binary"), "packing-order")
    drop(spark, first)
    before, total = {}, 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        before[r.part], total = total, total + r.n

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                cols = [[] for _ in range(8)]
                for part, at, doc, n, ids in zip(*(b.slice(k, 2048)[c].to_pylist() for c in ("part", "at", "doc_id", "n", "ids"))):
                    begin, wide = before[part] + at, np.frombuffer(ids, "<u2").astype("<u4")
                    for lo, hi, seq, offset in cut_points(begin, begin + n, total, length):
                        row = (doc, lo - begin, hi - lo, zlib.crc32(wide[lo - begin : hi - begin].tobytes()), n, seq, offset, ids[2 * (lo - begin) : 2 * (hi - begin)] if with_ids else None)
                        for c, v in zip(cols, row):
                            c.append(v)
                arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[7], pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return placed.mapInArrow(cut, ", ".join(f"{c} long" for c in names) + ", ids binary" * with_ids)
