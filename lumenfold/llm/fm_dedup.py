"""Substring de-duplication by FM-indexes over shards of repeated passages.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window
over it also starts in a document with a smaller doc_id.

1. Documents are staged in blocks (word codes and a block's own vocabulary).
2. A window's anchor is the least hash among its five-word grams; equal windows
   have equal anchors. Each block sends its distinct anchors, hashed over buckets,
   and learns which of them another document has, too. Only windows under such
   anchors can repeat (a twentieth to a fifth of running text).
3. Runs of such windows under one anchor are segments. A block sends each distinct
   segment once, to the shard of its anchor, with its smallest doc_id. All places
   of a window, in any document, meet in one shard. Windows of an anchor that more
   than ``HOT`` blocks have are segments of their own and go by a hash of their words,
   so a very common passage is spread over the shards.
4. A shard indexes its distinct segments (suffix order, Burrows-Wheeler transform,
   wavelet tree) and streams them against the index: backward search gives each
   window's matching statistic and interval; the interval's least doc_id goes back.
5. Blocks cover the words of windows whose least doc_id is below the document's.

Traffic is by block, bucket and distinct item, so a passage in a third of all
documents is one item a block, and no key gathers its documents in one task. Words
are compared by 64-bit hashes of each of their 13 places.

Defined cases: a null or blank text has no words; a null doc_id counts as larger
than any other and is returned as null; repeated rows with one doc_id are one
document to each other; a document shorter than a window loses nothing; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, stage, stage_alone, text_of
from .fm_index import FMIndex, interval_minima

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 2_500_000
HOT = 256  # blocks that have an anchor from which its windows are dealt by their own words
SEARCHES = 20_000  # windows searched at once, as many as a processor's cache holds
_WORD = re.compile(r"[^ \t-\r]+")
NO_ID = np.iinfo(np.int64).max
ODD = np.uint64(0x9E3779B97F4A7C15)


def _groups(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each distinct key with its positions in order, by one sort however many keys there are."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
    return list(zip(keys[order][first].tolist(), np.split(order, first[1:])))


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Documents of a block: ids, word counts, and words as codes into the block's vocabulary."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, words: list[bytes], keys: np.ndarray | None = None):
        from xxhash import xxh64_intdigest

        self.ids, self.sizes, self.codes, self.words = ids, sizes, codes, words
        self.keys = np.zeros((0, 2), np.int64) if keys is None else keys
        self.doc = np.repeat(np.arange(len(ids)), sizes)
        hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        self.hashes = hashes[codes] if len(words) else np.zeros(0, np.uint64)

    def pack(self) -> bytes:
        """The block in zstd: words renumbered by frequency, then alphabet, and their codes by bytes of equal weight, which compresses best."""
        alphabetic = np.array(sorted(range(len(self.words)), key=self.words.__getitem__), np.int64)
        count = np.bincount(self.codes, minlength=len(self.words))
        order = alphabetic[np.argsort(-count[alphabetic], kind="stable")]
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        width = max(1, (len(self.words).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(number[self.codes].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T)
        parts = [self.ids.astype(np.int64).tobytes(), self.sizes.astype(np.int64).tobytes(), self.keys.astype(np.int64).tobytes(), planes.tobytes(), b" ".join([self.words[k] for k in order])]
        raw = np.array([width, *map(len, parts)], np.int64).tobytes() + b"".join(parts)
        return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)

    @classmethod
    def unpack(cls, body: bytes) -> Block:
        raw = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
        width, *lengths = np.frombuffer(raw, np.int64, 6).tolist()
        ends = 48 + np.r_[0, np.cumsum(lengths)]
        ids, sizes, keys, planes, words = (raw[a:b] for a, b in zip(ends, ends[1:]))
        planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
        codes = sum(planes[k].astype(np.int64) << (8 * k) for k in range(width))
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), codes, words.split(), np.frombuffer(keys, np.int64).reshape(-1, 2))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows and their anchors."""
        h, n = self.hashes, len(self.hashes) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gram = h[: len(h) - GRAM + 1].copy()
        for k in range(1, GRAM):
            gram = (gram ^ (gram >> np.uint64(29))) * ODD + h[k : len(h) - GRAM + 1 + k]
        gram ^= gram >> np.uint64(32)
        gram *= ODD
        gram ^= gram >> np.uint64(29)
        span, least = 1, gram  # least[i]: over gram[i : i + span]
        while span < (wide := WINDOW - GRAM + 1):
            move = min(span, wide - span)
            least = np.minimum(least[:-move], least[move:])
            span += move
        starts = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])
        return starts, least[starts]

    def distinct_anchors(self, starts: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and whether two documents of this block have them."""
        if not len(anchors):
            return anchors, np.zeros(0, bool)
        ids = self.ids[self.doc[starts]]
        new = np.r_[True, (anchors[1:] != anchors[:-1]) | (ids[1:] != ids[:-1])]
        anchors, ids = anchors[new], ids[new]
        order = np.argsort(anchors, kind="stable")
        anchors, ids = anchors[order], ids[order]
        first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        return anchors[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)

    def content(self, starts: np.ndarray) -> np.ndarray:
        """A hash of all words of the windows that start there."""
        out = np.full(len(starts), WINDOW, np.uint64)
        for k in range(WINDOW):
            out = (out ^ self.hashes[starts + k]) * ODD
            out ^= out >> np.uint64(29)
        return out

    def segments(self, starts: np.ndarray, anchors: np.ndarray, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows under one shared anchor: first window, number of windows, and what a run is dealt by, its anchor.

        hot: for each shared anchor whether very many blocks have it; its windows are runs of one each and dealt by their words.
        """
        if not len(shared) or not len(anchors):
            return (np.zeros(0, np.int64),) * 2 + (anchors[:0],)
        at = np.minimum(np.searchsorted(shared, anchors), len(shared) - 1)
        hit = shared[at] == anchors
        starts, anchors, alone = starts[hit], anchors[hit], hot[at[hit]]
        if not len(starts):
            return (np.zeros(0, np.int64),) * 2 + (anchors,)
        new = np.flatnonzero(np.r_[True, alone[1:] | (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1) | (self.doc[starts[1:]] != self.doc[starts[:-1]])])
        route, single = anchors[new], alone[new]
        route[single] = self.content(starts[new][single])
        return starts[new], np.diff(np.r_[new, len(starts)]), route

    def requests(self, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, shards: int) -> Iterator[tuple[int, dict[bytes, int], np.ndarray, np.ndarray]]:
        """For each shard its distinct segments by content, the runs that go to it, and the number of each run's segment."""
        raw, begin, end = self.hashes.tobytes(), (8 * first).tolist(), (8 * (first + count + WINDOW - 1)).tolist()
        for q, runs in _groups((anchor % np.uint64(shards)).astype(np.int64)):
            table = _Codes()
            number = np.array([table[raw[begin[k] : end[k]]] for k in runs.tolist()], np.int64)
            yield q, table, runs, number


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    ids, sizes, codes, keys, table, held = [], [], [], [], _Codes(), 0

    def row() -> pa.RecordBatch:
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        body = Block(np.array(ids, np.int64), np.array(sizes, np.int64), flat, list(table), np.array(keys, np.int64).reshape(-1, 2)).pack()
        return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + made]), "words": pa.array([len(flat)], pa.int64()), "body": pa.array([body], pa.binary())})

    for batch in batches:
        for doc, text, *key in zip(batch["doc_id"].to_pylist(), batch["text"], *(batch[c].to_pylist() for c in batch.schema.names[2:])):
            words = text.as_py().encode().split()
            ids.append(NO_ID if doc is None else doc)
            keys.extend(key)
            sizes.append(len(words))
            codes.append(np.array(list(map(table.__getitem__, words)), np.int64))
            held += 7 * len(words) + 64
            if held >= BLOCK_BYTES:
                yield row()
                made, held = made + 1, 0
                ids, sizes, codes, keys, table = [], [], [], [], _Codes()
    if ids:
        yield row()


def _ask_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, body in zip(batch["block"].to_pylist(), batch["body"].to_pylist()):
            block = Block.unpack(body)
            anchors, several = block.distinct_anchors(*block.anchors())
            bucket = (anchors % np.uint64(buckets)).astype(np.int64)
            rows = [(k, anchors[own].tobytes(), np.packbits(several[own]).tobytes()) for k, own in _groups(bucket)]
            if rows:
                b, a, s = zip(*rows)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int64()), "block": pa.array([number] * len(rows), pa.int64()), "anchors": pa.array(a, pa.binary()), "several": pa.array(s, pa.binary())})


def _answer_anchors(frame: pd.DataFrame) -> pd.DataFrame:
    """For each block's anchors of this bucket two bits: another document has it, too; more than HOT blocks have it."""
    sets = [np.frombuffer(a, np.uint64) for a in frame["anchors"]]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(a)).astype(bool) for s, a in zip(frame["several"], sets)]
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.bincount(back, weights=np.concatenate(several)) + (count > 1) > 0
    both = np.stack([shared, count > HOT], axis=1)[back]
    parts = np.split(both, np.cumsum([len(a) for a in sets])[:-1])
    return pd.DataFrame({"block": frame["block"], "kind": 0, "number": frame["bucket"], "data": [np.packbits(x).tobytes() for x in parts]})


def _shared_segments(block: Block, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, anchors = block.anchors()
    distinct, _ = block.distinct_anchors(starts, anchors)
    both, given = np.zeros((len(distinct), 2), bool), dict(zip(answers["number"], answers["data"]))
    for k, own in _groups((distinct % np.uint64(buckets)).astype(np.int64)):
        both[own] = np.unpackbits(np.frombuffer(given[k], np.uint8), count=2 * len(own)).reshape(-1, 2).astype(bool)
    return block.segments(starts, anchors, distinct[both[:, 0]], both[both[:, 0], 1])


def _ask_segments(staged: pd.DataFrame, answers: pd.DataFrame, buckets: int, shards: int) -> pd.DataFrame:
    rows = []
    for number, body in zip(staged["block"], staged["body"]):
        block = Block.unpack(body)
        first, count, anchor = _shared_segments(block, answers[answers["kind"] == 0], buckets)
        ids = block.ids[block.doc[first]] if len(first) else np.zeros(0, np.int64)
        for q, table, runs, segment in block.requests(first, count, anchor, shards):
            least = np.full(len(table), NO_ID)
            np.minimum.at(least, segment, ids[runs])
            sizes = np.array([len(s) // 8 for s in table], np.int64)
            rows.append((q, number, sizes.tobytes(), least.tobytes(), b"".join(table)))
    return pd.DataFrame(rows, columns=["shard", "block", "sizes", "least", "words"])


def window_minima(segments: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each distinct segment (64-bit words), for each of its windows, the least id among all segments that hold it."""
    sizes = np.array([len(s) // 8 for s in segments], np.int64)
    words = np.frombuffer(b"".join(segments), np.uint64)
    alphabet, codes = np.unique(words, return_inverse=True)
    place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)  # a 0 stands after each segment
    text = np.zeros(len(words) + len(sizes), np.int64)
    text[place] = codes + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    index = FMIndex(text, len(alphabet))
    counts = sizes - WINDOW + 1
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    windows = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out, at_least = np.empty(len(windows), np.int64), least[owner[index.order]]
    for k in range(0, len(windows), SEARCHES):
        part = windows[k : k + SEARCHES]
        matched, low, high = index.matching(text[part[:, None] + np.arange(WINDOW)])
        assert (matched == WINDOW).all()  # each window is in the index itself
        out[k : k + SEARCHES] = interval_minima(at_least, low, high)
    return np.split(out, np.cumsum(counts)[:-1])


def _answer_segments(frame: pd.DataFrame) -> pd.DataFrame:
    table, least, asked = _Codes(), [], []
    for sizes, ids, words in zip(frame["sizes"], frame["least"], frame["words"]):
        ends, numbers = 8 * np.cumsum(np.frombuffer(sizes, np.int64)), []
        for a, b, i in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), np.frombuffer(ids, np.int64).tolist()):
            numbers.append(n := table[words[a:b]])
            if n == len(least):
                least.append(i)
            elif i < least[n]:
                least[n] = i
        asked.append(numbers)
    minima = window_minima(list(table), np.array(least, np.int64))
    return pd.DataFrame({"block": frame["block"], "kind": 1, "number": frame["shard"], "data": [np.concatenate([minima[n] for n in numbers]).tobytes() for numbers in asked]})


def _cover(staged: pd.DataFrame, answers: pd.DataFrame, buckets: int, shards: int) -> pd.DataFrame:
    rows = []
    for body in staged["body"]:
        block = Block.unpack(body)
        first, count, anchor = _shared_segments(block, answers[answers["kind"] == 0], buckets)
        change = np.zeros(len(block.codes) + 1, np.int64)
        given = {q: np.frombuffer(d, np.int64) for k, q, d in zip(answers["kind"], answers["number"], answers["data"]) if k == 1}
        for q, table, runs, segment in block.requests(first, count, anchor, shards):
            sizes = np.array([len(s) // 8 - WINDOW + 1 for s in table], np.int64)
            origin, n = (np.cumsum(sizes) - sizes)[segment], count[runs]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(first[runs], n) + within
            start = start[given[q][np.repeat(origin, n) + within] < block.ids[block.doc[start]]]
            np.add.at(change, start, 1)
            np.add.at(change, start + WINDOW, -1)
        gone = np.cumsum(change)[:-1] > 0
        ends = np.cumsum(block.sizes)
        words = np.array(block.words, object)[block.codes] if len(block.words) else np.zeros(0, object)
        keys = block.keys.tolist() or [(None, None)] * len(ends)
        for doc, key, a, b in zip(block.ids.tolist(), keys, (ends - block.sizes).tolist(), ends.tolist()):
            out = gone[a:b]
            removed, spans, kept = int(out.sum()), [], words[a:b]
            if removed:
                kept = kept[~out]
                spans = np.flatnonzero(np.diff(np.r_[0, out.view(np.int8), 0])).tolist()
            rows.append((None if doc == NO_ID else doc, b - a, removed, hashlib.sha256(b" ".join(kept.tolist())).hexdigest(), spans, *key))
    out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "k1", "k2"])
    return out.astype({"doc_id": "Int64", "k1": "Int64", "k2": "Int64"})


def repeated_spans(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (flat pairs: first word removed, first word kept again); if keyed, each row's key, else null."""
    spark = docs.sparkSession
    key = [k.alias(c) for k, c in zip(row_key(), ("k1", "k2"))] if keyed else []
    staged, _ = stage(text_of(docs, *key).mapInArrow(_blocks, "block long, words long, body binary"), "blocks")
    words = staged.agg(F.sum("words")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // 4_000_000))
    asked = staged.mapInArrow(partial(_ask_anchors, buckets=parts), "bucket long, block long, anchors binary, several binary")
    reply = "block long, kind long, number long, data binary"
    marks, _ = stage(asked.groupBy("bucket").applyInPandas(_answer_anchors, reply), "anchors")

    def with_blocks(answers: DataFrame, of, schema: str) -> DataFrame:
        return staged.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(of, schema)

    ask = lambda a, b: _ask_segments(a, b, parts, parts)
    cover = lambda a, b: _cover(a, b, parts, parts)
    segments = with_blocks(marks, ask, "shard long, block long, sizes binary, least binary, words binary")
    minima, _ = stage(segments.groupBy("shard").applyInPandas(_answer_segments, reply), "minima")
    return with_blocks(marks.unionByName(minima), cover, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>, k1 long, k2 long")


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the words of the spans (flat pairs); what stands between kept words stays as it is."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, end in zip(spans[::2], spans[1::2]):
        out.append(text[at : places[first][0]])
        at = places[end][0] if end < len(places) else len(text)
    out.append(text[at:])
    return "".join(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (spans to cut, the given row as a struct) to given rows; those that were nothing but what is cut go."""
    for batch in batches:
        names = [f.name for f in batch.schema.field(1).type]
        columns, at = batch.column(1).flatten(), names.index("text")
        texts, keep = [], []
        for text, spans in zip(columns[at].to_pylist(), batch.column(0).to_pylist()):
            texts.append(cut_words(text, spans) if spans else text)
            keep.append(not spans or bool(texts[-1].strip(" \t\n\x0b\x0c\r")))
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns whatever their names, without repeated passages; documents that were nothing else go.

    What is cut belongs to a row's doc_id and text: of several texts under one doc_id each loses its own
    passages, and repeated rows lose the same. A null doc_id counts as larger than any other. Documents
    without a text are kept as they are; without documents none come back.
    """
    given = docs.select(*(k.alias(c) for k, c in zip(row_key(), ("k1", "k2"))), F.struct(*docs.columns).alias("row"))
    spans = lambda: repeated_spans(docs, keyed=True).where("n_removed > 0").select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    found, _ = stage_alone(docs.sparkSession, spans, "spans")
    return given.join(found, ["k1", "k2"], "left").select("spans", "row").mapInArrow(_cut, docs.schema)
