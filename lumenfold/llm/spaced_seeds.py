"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a span of words that ignores some places, so words
substituted there do not hide a match. Hashes of every document position under
every mask are looked up among those of the benchmark; each hit fixes an item and
a diagonal, along which the document and the item are compared word by word. The
best-scoring segment there (a match counts 1, a mismatch -``MISMATCH``) tolerates
further substitutions; it is reported if at least ``LEAST`` of its words match (or,
for an item of fewer words, all its words).

The benchmark is a stated query set: its items are dealt by hash to blocks of about
``BLOCK_BYTES`` of text, and every document, scanned once, is held against each
broadcast block in turn, whatever the benchmark's size.

Words are as in the license scan: runs of letters, digits and non-ASCII characters,
lower-cased, so punctuation and white space do not matter.

Defined cases: a null or blank text or item matches nothing; a null doc_id or
item_id is kept; repeated rows are judged each; either table may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, worker_table
from .license_scan import normalized

#: Masks by the places they look at: 8 of 12 words, so that any two substitutions 6 words apart leave one whole.
MASKS = ("111010010111", "110110101101", "101111001011", "111100110011")
SPAN = 12
LEAST, MISMATCH, IDENTITY = 12, 3, 0.8
BLOCK_BYTES = 4_000_000
HITS, CELLS, TEXTS = 1 << 21, 1 << 20, 4096  # hits, compared words and texts held at once
MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


class _Hashes(dict):
    """Word to hash, for a worker's frequent words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def seed_hashes(h: np.ndarray, places: list[int], salt: int) -> np.ndarray:
    """The hash of the masked words at each position from which the mask fits."""
    n = len(h) - places[-1]
    out = np.full(max(n, 0), salt, np.uint64)
    for p in places:
        out = (out ^ h[p : p + len(out)]) * MIX
        out ^= out >> np.uint64(32)
    return out


class SeedTable:
    """A block of benchmark items: their words' hashes, and all seed hashes in order with item and position."""

    def __init__(self, items: list[list[bytes]]):
        self.items = [word_hashes(w) for w in items]
        sizes = [len(x) for x in self.items]
        masks = [[k for k, c in enumerate(m) if c == "1"] for m in MASKS] if max(sizes, default=0) >= SPAN else []
        self.masks = masks + [list(range(n)) for n in sorted({n for n in sizes if 0 < n < SPAN})]
        none = np.zeros(0, np.uint64)
        hashes, before, item, at = [none], [none], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for salt, places in enumerate(self.masks):
            whole = len(places) == places[-1] + 1  # a short item's own mask: no shorter than the item
            for k, h in enumerate(self.items):
                if (len(h) == len(places)) if whole else len(h) >= SPAN:
                    hashes.append(seeds := seed_hashes(h, places, salt))
                    before.append(np.roll(seeds, 1))
                    item.append(np.full(len(seeds), k))
                    at.append(np.arange(len(seeds)))
        at = np.concatenate(at)
        self.seeds, seed = np.unique(np.concatenate(hashes), return_inverse=True)
        self.before, last = np.unique(np.concatenate(before), return_inverse=True)
        last[at == 0] = len(self.before)  # no seed stands before an item's first
        self.wide = len(self.before) + 1
        key = seed * self.wide + last
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], np.concatenate(item)[order], at[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def diagonals(self, h: np.ndarray) -> np.ndarray:
        """Distinct (item, position in the text less position in the item) of all hits, as rows.

        A hit whose two preceding seeds are equal as well lies on the diagonal of those, which is a hit, too.
        So rows are ordered by seed and preceding seed, and those preceded as the text is are left out:
        repetitive texts and items cost about the sum of their lengths, not the product.
        """
        found = [np.zeros(0, np.int64)]
        for salt, places in enumerate(self.masks):
            seeds = seed_hashes(h, places, salt)
            maybe = np.flatnonzero(self.bits[(seeds >> np.uint64(42)).astype(np.int64)])
            number = np.searchsorted(self.seeds, seeds[maybe])
            hit = self.seeds[np.minimum(number, len(self.seeds) - 1)] == seeds[maybe]
            maybe, first = maybe[hit], number[hit] * self.wide
            if not len(maybe):
                continue
            last = seeds[maybe - 1]  # of the text's first position: any, and not looked at
            place = np.minimum(np.searchsorted(self.before, last), len(self.before) - 1)
            alike = (self.before[place] == last) & (maybe > 0)
            edges = np.stack([first, first + place, first + place + 1, first + self.wide])
            edges = np.searchsorted(self.key, edges)
            edges[1:3, ~alike] = edges[0, ~alike]
            for low, high in (edges[0:2], edges[2:4]):
                count = high - low
                own, low, count = maybe[count > 0], low[count > 0], count[count > 0]
                upto = np.cumsum(count)
                cuts = np.searchsorted(upto, np.arange(HITS, upto[-1], HITS)).tolist() if len(upto) else []
                for a, b in zip([0, *cuts], [*cuts, len(count)]):
                    n = count[a:b]
                    rows = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    found.append(np.unique((self.item[rows] << 40) + (np.repeat(own[a:b], n) - self.at[rows] + (1 << 39))))
        found = np.unique(np.concatenate(found))
        return np.stack([found >> 40, (found & ((1 << 40) - 1)) - (1 << 39)], axis=1)


def best_segments(same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row begin, end and matches of the segment with the most matches less MISMATCH times its mismatches."""
    n, every = len(same), np.arange(len(same))
    total = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(np.where(same, 1, -MISMATCH), axis=1)], axis=1)
    lowest = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total[:, 1:] - lowest[:, :-1], axis=1) + 1
    begin = np.argmax(total == lowest[every, end - 1][:, None], axis=1)
    hits = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    return begin, end, hits[every, end] - hits[every, begin]


def overlaps(table: SeedTable, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """For each item that the text with these word hashes overlaps: item, begin and end in the text, begin in the item, matches."""
    if not table.masks or not len(h):
        return []
    out = []
    found = table.diagonals(h)
    for rows in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else []:
        item, other, best = int(rows[0, 0]), table.items[rows[0, 0]], None
        width, step = len(other), max(1, CELLS // len(other))
        text = np.concatenate([np.zeros(width, np.uint64), h, np.zeros(width, np.uint64)])  # a hash of 0 stands for no word
        for k in range(0, len(rows), step):
            shift = rows[k : k + step, 1]
            begin, end, matches = best_segments(text[(shift + width)[:, None] + np.arange(width)] == other)
            good = np.flatnonzero((matches >= min(LEAST, width)) & (matches >= IDENTITY * (end - begin)))
            if len(good):
                top = good[np.argmax(matches[good])]
                if best is None or matches[top] > best[4]:
                    best = (item, int(shift[top] + begin[top]), int(shift[top] + end[top]), int(begin[top]), int(matches[top]))
                if best[4] == width:
                    break
        if best:
            out.append(best)
    return out


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Lists of (item_id, words), dealt by hash: each of about BLOCK_BYTES of text, at most twice that, or of items that are each longer."""
    ids = benchmark.schema["item_id"].dataType
    rows = benchmark.select(F.col("item_id").cast(ids).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size, most = F.sum(F.octet_length("text")), F.max(F.octet_length("text"))
    total, longest = rows.agg(size, most).first()
    blocks = max(1, -(-(total or 0) // BLOCK_BYTES))
    block = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    while blocks > 1 and (rows.groupBy(block(blocks)).agg(size.alias("size")).agg(F.max("size")).first()[0] > 2 * max(BLOCK_BYTES, longest)):
        blocks *= 2
    held, last = [], None
    for r in rows.withColumn("block", block(blocks)).orderBy("block").toLocalIterator():
        if held and r.block != last:
            yield held
            held = []
        last = r.block
        held.append((r.item_id, normalized(r.text)))
    yield held


def seed_tables(spark, benchmark: DataFrame) -> list:
    """Broadcasts of the blocks' tables, each with its items' ids."""
    return [spark.sparkContext.broadcast((SeedTable([w for _, w in block]), [i for i, _ in block])) for block in benchmark_blocks(benchmark)]


def _matched(batch: pa.RecordBatch, tables: list) -> Iterator[tuple[int, SeedTable, list, list]]:
    """Row of the batch, table, its ids and overlaps; texts are hashed once and held against one block after the other."""
    known = worker_table("word hashes", _Hashes)
    for begin in range(0, batch.num_rows, TEXTS):
        texts = [normalized(t.as_py() or "") for t in batch["text"][begin : begin + TEXTS]]
        hashed = [np.array(list(map(known.__getitem__, w)), np.uint64) for w in texts]
        for shared in tables:
            table, ids = shared.value
            for k, h in enumerate(hashed, begin):
                if found := overlaps(table, h):
                    yield k, table, ids, found
            if len(tables) > 1 and hasattr(shared, "_value"):
                del shared._value  # a worker holds one block at a time


def _found(batches: Iterator[pa.RecordBatch], tables: list) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "item_id", "doc_begin", "doc_end", "item_begin", "matched", "item_words")
    for batch in batches:
        cols = [[] for _ in names]
        for k, table, ids, found in _matched(batch, tables):
            for item, begin, end, at, matches in found:
                for c, v in zip(cols, (batch["doc_id"][k].as_py(), ids[item], begin, end, at, matches, len(table.items[item]))):
                    c.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(names))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, the words from doc_begin to doc_end, item_begin, matched, item_words.

    Documents are scanned once, whatever the number of blocks. Null or blank texts and items match nothing,
    null ids are kept, repeated rows of either table are judged each, and either may be empty.
    """
    tables = seed_tables(docs.sparkSession, benchmark)
    schema = "doc_id long, item_id long, doc_begin long, doc_end long, item_begin long, matched long, item_words long"
    return text_of(docs).mapInArrow(lambda b: _found(b, tables), schema)


def _clean(batches: Iterator[pa.RecordBatch], tables: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        keep[[k for k, *_ in _matched(batch, tables)]] = False
        yield batch.filter(pa.array(keep))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns whatever their names, that overlap no benchmark item.

    Documents without a text are kept, each of several rows with one doc_id is judged by its own text,
    and without documents or items all that is given comes back.
    """
    text_of(docs)  # ships the package
    tables = seed_tables(docs.sparkSession, benchmark)
    return docs.mapInArrow(lambda b: _clean(b, tables), docs.schema)
