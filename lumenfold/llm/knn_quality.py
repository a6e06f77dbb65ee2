"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's features are hashed counts of its words, their shapes and endings, and a
few bucketed shares (size, distinct words, capitals, symbols, repeated lines).
Their weighted, unit-length vectors are projected on the first directions of a
singular value decomposition of the labelled sample. The sample's latent vectors
are broadcast; every document's cosine with each of them is computed, block by
block, and the labels of the ``NEIGHBOURS`` nearest vote with a power of their
cosine as weight.

Labels come from at most ``SAMPLE`` labelled rows (those with the least hashes of
their doc_id, fold 0 of 5 left out), a fixed bound on what is broadcast; every
document is scored whole.

Defined cases: a null text counts as empty and is scored; a null doc_id is scored
with held_out null; a null label is no label, and of several labels of one id the
largest counts; repeated rows are scored each; without labels every score is 0.5;
an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_of, worker_table

SAMPLE, DIMS, NEIGHBOURS, POWER = 6000, 48, 15, 8
WORDS, SHARES = 4096, 5 * 16
ACCEPT = 0.3

_SHAPE = bytes(65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else 97 if 97 <= c <= 122 or c >= 128 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()")


class _Features(dict):
    """Word to the buckets of its shape, its ending and itself; frequent words are kept."""

    def __missing__(self, word: bytes) -> bytes:
        shape, low = _RUN.sub(rb"\1", word.translate(_SHAPE)), word.lower()
        found = np.array([zlib.crc32(shape) % 512, 512 + zlib.crc32(low[-3:]) % 512, 1024 + zlib.crc32(low) % (WORDS - 1024)], np.uint16).tobytes()
        if len(self) < 400_000:
            self[word] = found
        return found


def features(text: str) -> np.ndarray:
    known = worker_table("quality features", _Features)
    raw, out = text.encode(), np.zeros(WORDS + SHARES, np.float32)
    words = raw.split()
    if words:
        at = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint16)
        out[:WORDS] = np.log1p(np.bincount(at, minlength=WORDS))
    size, n = max(len(raw), 1), max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = (
        np.log2(len(words) + 1) / 16,
        len(set(words)) / n,
        (len(raw) - len(raw.translate(None, _CAPITALS))) / size,
        np.sqrt((len(raw) - len(raw.translate(None, _SYMBOLS))) / size),
        1 - len(set(lines)) / max(len(lines), 1),
    )
    for k, share in enumerate(shares):
        out[WORDS + 16 * k + min(15, int(16 * share))] = 1
    return out


def weighted(x: np.ndarray, rarity: np.ndarray, in_place: bool = False) -> np.ndarray:
    """The two parts at unit length each, words by their rarity."""
    out = x if in_place else x.astype(np.float32)
    for k in range(0, len(out), 512):  # a few rows at a time, so temporaries stay small
        rows = out[k : k + 512]
        for part in (slice(0, 1024), slice(1024, WORDS), slice(WORDS, None)):
            block = rows[:, part] * rarity[part]
            rows[:, part] = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-6)
    return out


def latent(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = x @ basis
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)


def fit(x: np.ndarray, y: np.ndarray, in_place: bool = False) -> dict:
    """Rarity weights, the first singular directions (randomized, Halko et al., 2011) and the labelled vectors.

    in_place: x, of 32-bit floats, may be changed.
    """
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x = weighted(x, rarity, in_place)
    probe = np.linalg.qr(x.T @ np.random.default_rng(1).standard_normal((len(x), min(DIMS + 16, len(x))), np.float32))[0]
    for _ in range(3):
        probe = np.linalg.qr(x.T @ (x @ probe))[0]
    _, _, right = np.linalg.svd(x @ probe, full_matrices=False)
    basis = (probe @ right.T)[:, :DIMS].astype(np.float32)
    return {"rarity": rarity, "basis": basis, "vectors": latent(x, basis), "labels": y.astype(np.float32)}


def vote(model: dict, x: np.ndarray, block: int = 256) -> np.ndarray:
    """Scores of feature rows: exact cosines with all labelled vectors, a block of rows at a time."""
    z, y, k = latent(weighted(x, model["rarity"]), model["basis"]), model["labels"], min(NEIGHBOURS, len(model["labels"]))
    out = np.empty(len(z))
    for i in range(0, len(z), block):
        cosine = z[i : i + block] @ model["vectors"].T
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3) ** POWER
        out[i : i + block] = (weight * y[near]).sum(axis=1) / weight.sum(axis=1)
    return out


def scores(texts: list[str], model: dict | None) -> np.ndarray:
    return np.clip(vote(model, np.stack([features(t) for t in texts])), 0, 1) if model and texts else np.full(len(texts), 0.5)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t).astype(np.float16).tobytes() for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", mod: int = 5):
    """The model as a broadcast variable, from learning rows of both tables."""
    spark = docs.sparkSession
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(F.col("y").isNotNull() & (remainder(mod) != 0))
    given = given.groupBy("doc_id").agg(F.max("y").alias("y")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = text_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    # repeated rows of an id would pass the bound: one text each
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).mapInArrow(_featurize, "doc_id long, y int, x binary")
    found = sample.orderBy("doc_id").toArrow()
    x, y = np.empty((found.num_rows, WORDS + SHARES), np.float32), found["y"].to_numpy()
    for k, row in enumerate(found["x"]):
        x[k] = np.frombuffer(row.as_buffer(), np.float16)
    del found
    model = fit(x, y, in_place=True) if len(x) else None
    del x
    return spark.sparkContext.broadcast(model)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            s = scores(part["text"].to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_documents(docs: DataFrame, labels: DataFrame, mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = train(docs, labels, mod=mod)
    return text_of(docs, (remainder(mod) == 0).alias("held_out")).mapInArrow(lambda b: _score(b, shared), "doc_id long, held_out boolean, score double, predicted int")


def _accept(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            yield part.filter(pa.array(scores([t or "" for t in part["text"].to_pylist()], shared.value) >= ACCEPT))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns whatever their names, that the classifier accepts.

    Every row is judged by its own text, a null one as empty, so repeated rows stay or go together and
    doc_id may be null; without labels of both tables' ids all score 0.5 and stay; without documents none come back.
    """
    shared = train(docs, labels)
    return docs.mapInArrow(lambda b: _accept(b, shared), docs.schema)
