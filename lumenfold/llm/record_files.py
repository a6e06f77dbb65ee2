"""Token-id output: length-delimited binary records with an offset index beside them.

A shard ``<name>.rec`` holds one record a document, in ascending doc_id order::

    u64 length of the payload | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload

all little-endian; the payload is ``i64 doc_id | u8 flags (1: doc_id is null) | ids``
with 16-bit ids. ``<name>.idx`` holds, for each record, ``i64 doc_id | u64 offset |
u64 ids`` and ends with a masked CRC-32, so a reader can shuffle records and fetch
each by one seek. A checksum c is masked as rotate-right(c, 15) + 0xA282EAD8, so
that a checksum over bytes that hold checksums stays sound.

Shards are written under attempt-unique names; the manifest, a Parquet table
committed by Spark, names those of the attempts that count, so a lost executor's
or a speculative task's files are never read.

Defined cases: a null text is empty and yields the end id alone; a null doc_id is
kept and comes first; repeated rows are separate records; an empty table gives no
shard and no row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fan_out, scratch, text_of
from .tokens import encoder

MANIFEST = "shard long, name string, first_id long, docs long, tokens long, bytes long"
DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
HEAD, TAIL, LEAD, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<qB"), struct.Struct("<qQQ")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at this offset and the offset of the next; ValueError if a checksum differs."""
    size, check = HEAD.unpack_from(data, at)
    if check != masked(bytes(data[at : at + 8])):
        raise ValueError(f"length damaged at offset {at}")
    begin, end = at + HEAD.size, at + HEAD.size + size
    if TAIL.unpack_from(data, end)[0] != masked(bytes(data[begin:end])):
        raise ValueError(f"record damaged at offset {at}")
    return data[begin:end], end + TAIL.size


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_shards(batches: Iterator[pa.RecordBatch], path: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, tok, end = TaskContext.get().partitionId(), encoder(vocabulary), np.array([end_id], "<u2").tobytes()
    name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
    out, index, at, tokens, first = None, [], 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            fs, root = _filesystem(path)
            fs.create_dir(root, recursive=True)
            out, first = fs.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20), batch["doc_id"][0].as_py()
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            for doc, ids in zip(part["doc_id"].to_pylist(), map(tok.encode, part["text"].to_pylist())):
                record = frame(LEAD.pack(doc or 0, doc is None) + ids + end)
                out.write(record)
                index.append(ENTRY.pack(doc or 0, at, len(ids) // 2 + 1))
                at, tokens = at + len(record), tokens + len(ids) // 2 + 1
    if out is not None:
        out.close()
        entries = b"".join(index)
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(entries + TAIL.pack(masked(entries)))
        kinds = pa.schema([("shard", pa.int64()), ("name", pa.string()), *((c, pa.int64()) for c in ("first_id", "docs", "tokens", "bytes"))])
        yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "first_id": first, "docs": len(index), "tokens": tokens, "bytes": at}], schema=kinds)


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Writes shards and the manifest below path (a URI all executors see); returns the manifest, one row a shard."""
    ordered = text_of(docs).repartitionByRange(fan_out(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_write_shards, path=path, vocabulary=vocabulary, end_id=end_id), MANIFEST).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _read_shards(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fs, root = _filesystem(path)
    for batch in batches:
        for row in batch.to_pylist():
            with fs.open_input_stream(f"{root}/{row['name']}.idx") as f:
                entries = f.read()
            if TAIL.unpack(entries[-4:])[0] != masked(entries[:-4]):
                raise ValueError(f"index of {row['name']} is damaged")
            start, at, cols = row["before"], 0, ([], [], [], [])
            with fs.open_input_stream(f"{root}/{row['name']}.rec", buffer_size=1 << 20) as f:
                for k, (_, offset, n) in enumerate(ENTRY.iter_unpack(entries[:-4])):
                    head = f.read(HEAD.size)
                    payload, _ = unframe(memoryview(head + f.read(HEAD.unpack(head)[0] + TAIL.size)), 0)
                    if offset != at or len(payload) != LEAD.size + 2 * n:
                        raise ValueError(f"index of {row['name']} disagrees at record {k}")
                    doc, null = LEAD.unpack_from(payload)
                    ids = np.frombuffer(payload, "<u2", offset=LEAD.size)
                    for c, v in zip(cols, (None if null else doc, start, n, zlib.crc32(ids.astype("<u4").tobytes()))):
                        c.append(v)
                    start, at = start + n, at + HEAD.size + len(payload) + TAIL.size
                    if len(cols[0]) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=DOC)
                        cols = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=DOC)


def read_records(path: str, manifest: DataFrame) -> DataFrame:
    """Reads every shard back, checking each checksum: doc_id, start, n_tokens, ids_crc32.

    The manifest has a row a shard, and shards hold at least a partition each, so
    their running totals are small enough for the driver.
    """
    rows, before = [], 0
    for r in manifest.select("shard", "name", "tokens").orderBy("shard").collect():
        rows.append((r.shard, r.name, before))
        before += r.tokens
    todo = manifest.sparkSession.createDataFrame(rows, "shard long, name string, before long")
    return todo.repartition(max(1, len(rows)), "shard").mapInArrow(partial(_read_shards, path=path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(path: str, name: str, positions: list[int]) -> list[tuple[int | None, list[int]]]:
    """Records of one shard by their positions in the index, in the order asked for (a shuffled read)."""
    fs, root = _filesystem(path)
    with fs.open_input_stream(f"{root}/{name}.idx") as f:
        entries = list(ENTRY.iter_unpack(f.read()[:-4]))
    out = []
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        for p in positions:
            _, offset, n = entries[p]
            payload, _ = unframe(memoryview(f.read_at(HEAD.size + LEAD.size + 2 * n + TAIL.size, offset)), 0)
            doc, null = LEAD.unpack_from(payload)
            out.append((None if null else doc, np.frombuffer(payload, "<u2", offset=LEAD.size).tolist()))
    return out


def encode_and_reread(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    path = scratch(docs.sparkSession, "records")
    return read_records(path, write_records(docs, path, vocabulary, end_id))
