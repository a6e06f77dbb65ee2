"""SimHash near-duplicates, found by pivot distance tables.

A fingerprint's row in the table holds its Hamming distances to fixed reference
fingerprints. By the triangle inequality two fingerprints within r bits differ by
at most r in every column, so a pair with a larger difference anywhere is
discarded unseen, and only survivors are compared bit by bit.

A distance table alone would still hold every row against every other, so its
coordinates are also what rows meet by. The reference fingerprints are zero, some with
bits in one block only, and random ones. A reference within a block tells, by the
difference of its coordinate from that of zero, how many of its bits a fingerprint has;
that difference is equal for two fingerprints that differ outside the block. The 64
bits are cut into radius + 2 blocks, of which a pair within radius bits has two whole:
rows meet where all coordinates of two blocks agree. How many coordinates a block
has follows from the number of distinct fingerprints, so that few strangers meet at any
size; results do not depend on it. Those that meet are held against each other by all
columns, and what is left bit by bit.

A large group meets in parts, every pair of parts once, so no task holds more than
two. Equal fingerprints are one row from the start, and a meeting reports links that
span it, not all its pairs; so hot groups cost what their distinct fingerprints cost.

Defined cases: a null or blank text has fingerprint zero and links like any
other; a null doc_id is kept, never becomes a component's id while another member
has one; repeated rows share a fingerprint; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, stage, stage_alone, text_of
from .components import components

PIVOTS = 48  # random reference fingerprints, besides those of the blocks
COORDINATES = 16  # references within a block, at most
STRANGERS = 0.5  # expected members of a meeting that a fingerprint shares by chance
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # ASCII only on bytes: A-Z, and the white space \t-\r and blank
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    return [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(width)))]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: a bit is set where over half of its run have it; empty runs give zero.

    Eight counters share a word (bits k, k + 8, ... of a hash), for at most 255 hashes at a time.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = np.r_[0, np.cumsum(sizes)[:-1]][full]
    parts = -(-sizes[full] // 255)
    first = np.r_[0, np.cumsum(parts)[:-1]]
    chunk = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.empty((len(full), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, chunk)
        counts[:, k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    bits = (2 * counts > sizes[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            runs = [shingle_hashes(t, width) for t in part["text"].to_pylist()]
            sizes = np.array([len(r) for r in runs], np.int64)
            flat = np.fromiter((h for r in runs for h in r), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(majority_bits(flat, sizes).view(np.int64))], names=["doc_id", "bits"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and bits, the 64-bit fingerprint as a signed long."""
    return text_of(docs).mapInArrow(partial(_fingerprints, width=width), "doc_id long, bits long")


def block_references(radius: int) -> list[list[int]]:
    """For each block fixed references with half of its bits set and no others."""
    rng, size = np.random.default_rng(16), 64 // (radius + 2)
    return [[sum(1 << (b * size + int(k)) for k in rng.permutation(size)[: size // 2]) for _ in range(COORDINATES)] for b in range(radius + 2)]


def references(radius: int) -> np.ndarray:
    """All reference fingerprints: random ones, zero, and those of the blocks."""
    own = [r for block in block_references(radius) for r in block]
    return np.r_[np.random.default_rng(64).integers(0, 2**64, PIVOTS, np.uint64), np.array([0, *own], np.uint64)]


def coordinates_for(rows: int, radius: int) -> int:
    """How many coordinates of a block to meet by: the fewest at which ``STRANGERS`` others or fewer agree by chance."""
    size = 64 // (radius + 2)
    values = np.arange(1 << size, dtype=np.uint64)
    code = np.zeros(len(values), np.int64)
    for k, r in enumerate(block_references(radius)[0], 1):
        _, code = np.unique(code * (size + 1) + np.bitwise_count(values & np.uint64(r)), return_inverse=True)
        share = ((np.bincount(code) / len(values)) ** 2).sum()
        if rows * share**2 <= STRANGERS:
            break
    return k


def pivot_links(bits: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (position, position) that span the graph of fingerprints within radius; bits: (rows, words of 64).

    A breadth-first search: each reached row is held, by the table, against the
    rows not reached yet, so a dense set costs about its size, not its square.
    """
    table = np.stack([np.bitwise_count(bits ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
    waiting, left, right = np.arange(len(bits)), [], []
    while len(waiting) > 1:
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            near = np.arange(len(waiting))
            for c in range(0, len(pivots), 8):
                near = near[np.abs(table[waiting[near], c : c + 8] - table[i, c : c + 8]).max(axis=1, initial=0) <= radius]
                if not len(near):
                    break
            near = near[np.bitwise_count(bits[waiting[near]] ^ bits[i]).sum(axis=1) <= radius]
            if len(near):
                found = waiting[near]
                left.append(np.full(len(found), i))
                right.append(found)
                queue.extend(found.tolist())
                waiting = np.delete(waiting, near)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def pair_links(a: np.ndarray, b: np.ndarray, radius: int, pivots: np.ndarray) -> np.ndarray:
    """Positions of pairs within radius: those that no coordinate discards, compared."""
    left = np.arange(len(a))
    for p in pivots:
        apart = np.bitwise_count(a[left] ^ p).astype(np.int16) - np.bitwise_count(b[left] ^ p)
        left = left[np.abs(apart) <= radius]
    return left[np.bitwise_count(a[left] ^ b[left]) <= radius]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    pivots = references(radius)
    for batch in batches:
        lists = batch["members"]
        sizes = np.diff(lists.offsets.to_numpy())
        flat, start = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(sizes)]
        two = start[:-1][sizes == 2]
        found = pair_links(flat[two], flat[two + 1], radius, pivots)
        left, right = [flat[two][found]], [flat[two + 1][found]]
        for k in np.flatnonzero(sizes > 2).tolist():
            bits = np.sort(flat[start[k] : start[k + 1]])
            i, j = pivot_links(bits[:, None], radius, pivots[:, None])
            left.append(bits[i])
            right.append(bits[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])


def meetings(distinct: DataFrame, radius: int, coordinates: int) -> DataFrame:
    """(meeting, members) of distinct fingerprints (column bits): every pair within radius bits is in one, no list is longer than about two parts."""
    signed = lambda x: F.lit(x - 2**64 if x >= 2**63 else x)
    away = lambda r: F.bit_count(F.col("bits").bitwiseXOR(signed(r)))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = [F.xxhash64(*(away(r) - away(0) for r in block[:coordinates])).alias(f"v{b}") for b, block in enumerate(block_references(radius))]
    coded = distinct.repartition(parts, "bits").select("bits", *blocks)
    pairs = combinations(range(len(blocks)), 2)
    keyed = coded.select("bits", F.explode(F.array(*(F.xxhash64(F.lit(k), f"v{a}", f"v{b}") for k, (a, b) in enumerate(pairs)))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / MEET).alias("parts"))
    dealt = keyed.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("bits"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    meeting = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return dealt.groupBy(meeting.alias("meeting")).agg(F.collect_list("bits").alias("members"))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column bits) that span each set within radius bits."""
    met = meetings(distinct, radius, coordinates_for(distinct.count(), radius))
    return met.where(F.size("members") > 1).select("members").mapInArrow(partial(_links, radius=radius), "a long, b long").distinct()


def cluster(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, bits, component_id: documents joined by chains of fingerprints within radius bits."""
    marked, _ = stage(fingerprints(docs, width), "fingerprints")
    classes, _ = stage(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "classes")
    found, _ = stage(links(classes.select("bits"), radius), "near")
    roots = components(found, "a", "b")  # over fingerprints; its smallest document names a component
    rooted = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
    rooted = rooted.select("bits", "least", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select("doc_id", "bits", "component_id")


# Copies at a similarity: sets of five-word shingles.
#
# At a Jaccard similarity of 0.8 fingerprints differ by about 0.15 of their bits, strangers'
# by half. So fingerprints are wider here, and the radius lies where neither errs. No blocks
# are whole for certain at such a radius; rows meet where drawn coordinates of the distance
# table agree, in so many draws that a pair is lost with a probability below LOST. Those that
# meet are held against each other by the columns of their own references, then bit by bit.
# Chains of fingerprints within the radius only propose: the sets of each such group are all
# held against the similarity itself.

WORDS = 4  # of 64 bits in a wide fingerprint
WIDE_RADIUS = 72  # of 256 bits: pairs at 0.8 differ by 39 (sd 6; sets of four shingles by 48), random ones by 128 (sd 8)
WHOLE = 0.8125  # of a pair at 0.8 the share of equal bits, at least: that of sets of four and five shingles
CROWD, LOST = 2048, 1e-4  # strangers in a meeting at most, and chance of a pair to agree in no draw
REFERENCES = 8  # rows of a meeting whose distances are its table
FILTER_BITS = 25  # places of the fixed filter that spares most documents a shuffle; a full filter lets all through
MEET, MEET_SHINGLES = 4096, 1 << 20  # rows and shingles that meet at once; a larger meeting is split, and its parts meet in pairs
_SALTS = np.random.default_rng(5).integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * salt
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingles in order; a blank text has one of its own."""
    return np.unique(np.array(shingle_hashes(text, width) or [0], np.uint64))


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash fingerprints (rows, WORDS) of sets of shingles; repeats in a text count once."""
    sizes, flat = np.array([len(s) for s in sets], np.int64), np.concatenate(sets)
    return np.stack([majority_bits(_mixed(flat, s), sizes) for s in _SALTS], axis=1)


def _marked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of each document a key of its set of shingles, the set's size and its wide fingerprint."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            sets = [shingle_set(t, width) for t in part["text"].to_pylist()]
            keys = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            words = [pa.array(w.view(np.int64)) for w in np.ascontiguousarray(wide_fingerprints(sets).T)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["k1"], part["k2"], keys, pa.array([len(s) for s in sets], pa.int64()), *words], names=["doc_id", "k1", "k2", "key", "n", *WIDE])


WIDE = [f"w{k}" for k in range(WORDS)]


def draws_for(rows: int) -> np.ndarray:
    """(draws, coordinates): the bits whose references rows meet by, so that at most ``CROWD`` of them agree in a draw by chance.

    A reference of one bit tells by its coordinate, less that of zero, whether a fingerprint has that bit.
    """
    size = max(0, int(np.ceil(np.log2(max(rows, 1) / CROWD))))
    count = int(np.ceil(np.log(LOST) / np.log1p(-(WHOLE**size)))) if size else 1
    rng = np.random.default_rng(256)
    return np.stack([rng.permutation(64 * WORDS)[:size] for _ in range(count)])


def _coordinates(batches: Iterator[pa.RecordBatch], draws: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each fingerprint a row for every draw, with the meeting that its coordinates name."""
    count, size = draws.shape
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            bits = np.unpackbits(np.stack([part[w].to_numpy() for w in WIDE], axis=1).view(np.uint8), axis=1, bitorder="little")
            meeting = np.tile(np.arange(count, dtype=np.int64), (part.num_rows, 1))
            for c in range(size):
                meeting = meeting << 1 | bits[:, draws[:, c]]
            again = pa.array(np.repeat(np.arange(part.num_rows), count))
            yield pa.RecordBatch.from_arrays([pa.array(meeting.ravel()), *(part[c].take(again) for c in ("id", *WIDE))], names=["meeting", "id", *WIDE])


def table_links(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (position, position) that span the graph of fingerprints within radius; bits: (rows, words of 64).

    The first rows not linked yet are the references of a distance table. A column links its
    reference to the rows within radius; by the triangle inequality it discards for a block of
    rows all that are further than radius from the block's range in any column. The others are
    compared bit by bit, unless they are linked already.
    """
    given, n = np.arange(len(bits)), len(bits)
    left, right, table, root = [], [], [], np.arange(n)
    for _ in range(REFERENCES):
        alone = np.flatnonzero((root == given) & (np.bincount(root, minlength=n)[given] == 1))
        alone = alone[~np.isin(alone, left)]
        if not len(alone):
            break
        i = int(alone[0])
        column = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int16)
        table.append(column)
        near = np.flatnonzero(column <= radius)
        left.append(i)
        right.append(near)
        root[np.isin(root, root[near])] = root[near].min()
    left = [np.full(len(r), i) for i, r in zip(left, right)]
    if table and (root != root[0]).any():
        table = np.stack(table, axis=1)
        order = np.lexsort(table.T[::-1])
        words, table, names = np.ascontiguousarray(bits[order].T), table[order], root[order]
        for k in range(0, n, 256):
            own = table[k : k + 256]
            seen = k + np.flatnonzero(((table[k:] >= own.min(axis=0) - radius) & (table[k:] <= own.max(axis=0) + radius)).all(axis=1))
            apart = np.zeros((len(own), len(seen)), np.uint16)
            for w in words:
                apart += np.bitwise_count(w[k : k + 256, None] ^ w[None, seen])
            i, j = np.nonzero(apart <= radius)
            i, j = k + i, seen[j]
            i, j = (x[names[i] != names[j]] for x in (i, j))
            _, first = np.unique(np.minimum(names[i], names[j]) * n + np.maximum(names[i], names[j]), return_index=True)
            for a, b in zip(i[first].tolist(), j[first].tolist()):
                if names[a] != names[b]:
                    names[names == max(names[a], names[b])] = min(names[a], names[b])
                    left.append(order[[a]])
                    right.append(order[[b]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _near(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return table_links(np.stack([np.concatenate([b[w].to_numpy() for b in held]).view(np.uint64) for w in WIDE], axis=1), WIDE_RADIUS)


def _alike(held: list[pa.RecordBatch], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    return set_links([np.frombuffer(x.as_buffer(), np.uint64) for b in held for x in b["shingles"]], similarity)


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (position, position) that span the graph of sets with this Jaccard similarity: a breadth-first search over all pairs.

    Two bounds spare exact counts and lose nothing: sizes differ by no more than the similarity,
    and the bits in which the parities of hashed shingles differ are at most the shingles in which the sets do.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    words = 8
    while 64 * words < min(2 * len(flat) // len(sets), 1 << 15):
        words *= 2
    bits = np.zeros(len(sets) * words, np.uint64)
    np.bitwise_xor.at(bits, owner * words + ((flat >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (flat & np.uint64(63)))
    bits = bits.reshape(len(sets), words)
    values, at = np.unique(flat, return_inverse=True)
    at, marked = np.split(at, np.cumsum(sizes)[:-1]), np.zeros(len(values), bool)
    differ = (1 - similarity) / (1 + similarity)  # share of both sizes in which similar sets differ at most
    waiting, left, right = np.argsort(sizes, kind="stable"), [], []
    while len(waiting) > 1:
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            i = queue.pop()
            low, high = np.searchsorted(sizes[waiting], [similarity * sizes[i] - 1e-6, sizes[i] / similarity + 1e-6])
            near = np.arange(low, high)
            apart = np.bitwise_count(bits[waiting[near]] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = near[apart <= differ * (sizes[waiting[near]] + sizes[i]) + 1e-6]
            if not len(near):
                continue
            rows = waiting[near]
            marked[at[i]] = True
            both = np.add.reduceat(marked[np.concatenate([at[j] for j in rows])], np.r_[0, np.cumsum(sizes[rows])[:-1]], dtype=np.int64)
            marked[at[i]] = False
            alike = both >= similarity * (sizes[rows] + sizes[i] - both) - 1e-9
            found = rows[alike]
            left.append(np.full(len(found), i))
            right.append(found)
            queue.extend(found.tolist())
            waiting = np.delete(waiting, near[alike])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _meet(batches: Iterator[pa.RecordBatch], links) -> Iterator[pa.RecordBatch]:
    """Links of each group (those of its positions from ``links``); rows (meeting, id, ...) come in order of their meeting, one group is held at a time."""

    def linked(held):
        if sum(b.num_rows for b in held) < 2:
            return [np.zeros(0, np.int64)] * 2
        ids = np.concatenate([b["id"].to_numpy() for b in held])
        i, j = links(held)
        return ids[i], ids[j]

    held, last = [], None
    for batch in batches:
        keys, out = batch["meeting"].to_numpy(), []
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)] if len(keys) else np.zeros(1, np.int64)
        for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if held and keys[start] != last:
                out.append(linked(held))
                held = []
            last = keys[start]
            held.append(batch.slice(start, stop - start))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "b"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in linked(held)], names=["a", "b"])


def spanned(met: DataFrame, large: DataFrame, links, more: DataFrame | None = None) -> DataFrame:
    """Components (node, root) of the ids in met (meeting, id, ...), linked by ``links`` within each meeting.

    A meeting in large (meeting, parts) first meets in parts, dealt anew in each meeting; if that leaves
    its ids in several components, all pairs of its parts meet. more: columns by id that ``links`` reads.
    """

    def linked(dealt: DataFrame) -> DataFrame:
        dealt = dealt if more is None else dealt.join(more, "id")
        sorted_ = dealt.repartition("meeting").sortWithinPartitions("meeting")
        return stage(sorted_.mapInArrow(partial(_meet, links=links), "a long, b long"), "near")[0].where("a <> b").distinct()

    payload = [c for c in met.columns if c != "meeting"]
    large, _ = stage(large, "large")
    if large.isEmpty():
        return components(linked(met), "a", "b")
    met = met.join(F.broadcast(large), "meeting", "left")
    split = met.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("id", "meeting"), "parts"))
    meeting = F.when(F.col("parts").isNull(), F.col("meeting")).otherwise(F.xxhash64("meeting", F.pmod(F.xxhash64("id", "meeting"), "parts")))
    sure = linked(met.select(meeting.alias("meeting"), *payload))
    roots = components(sure, "a", "b")
    rooted = split.select("meeting", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = rooted.groupBy("meeting").agg((F.min("root") < F.max("root")).alias("apart")).where("apart")
    others = split.join(apart, "meeting", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> other")
    others, _ = stage(others.select(F.xxhash64("meeting", F.least("part", "other"), F.greatest("part", "other")).alias("meeting"), *payload), "parts")
    return roots if others.isEmpty() else components(sure.unionByName(linked(others)), "a", "b")


def key_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS places, whatever the number of rows, with the places of their keys k1 set."""
    place = F.pmod(F.col("k1"), F.lit(2**FILTER_BITS))
    words = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(2 ** (FILTER_BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def _shingle_sets(batches: Iterator[pa.RecordBatch], width: int, shared) -> Iterator[pa.RecordBatch]:
    """Sets of the documents that the filter lets through: all that are needed and few others."""
    for b in batches:
        place = b["place"].to_numpy()
        b = b.filter(pa.array((shared.value[place >> 6] >> (place & 63) & 1).astype(bool)))
        sets = [shingle_set(t, width).tobytes() for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["k1"], b["k2"], pa.array(sets, pa.binary())], names=["k1", "k2", "shingles"])


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of every row doc_id, its key (k1, k2), component_id (the doc_id of its group's row that stays) and stays.

    Equal sets of shingles are one class; others are linked if they have this Jaccard similarity.
    Classes meet by coordinates of their SimHash fingerprints, and chains of fingerprints within
    ``WIDE_RADIUS`` are groups, in which all pairs are held against the similarity by their sets.
    A pair at 0.8 meets and is within the radius with a probability over 0.9999 (over 0.998 for the
    shortest texts, of eight and nine words); a table of up to ``CROWD`` classes is one meeting.

    The row with the least doc_id stays, any doc_id before a null one; of several texts under that
    doc_id the one with the least key; rows repeated whole share a key, so all or none of them stay.
    A null or blank text is a copy of other blank texts. Without documents there are no rows.
    """
    texts = text_of(docs, *(k.alias(c) for k, c in zip(row_key(), ("k1", "k2"))))
    words = ", ".join(f"{w} long" for w in WIDE)
    marked, _ = stage(texts.mapInArrow(partial(_marked, width=width), f"doc_id long, k1 long, k2 long, key binary, n long, {words}"), "marked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    classes = marked.groupBy("key").agg(F.min(first).alias("f"), *(F.first(c).alias(c) for c in ("n", *WIDE)))
    classes, _ = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = classes.select("id", *WIDE).repartition(parts, "id").mapInArrow(partial(_coordinates, draws=draws_for(classes.count())), f"meeting long, id long, {words}")
    large = met.groupBy("meeting").agg(F.ceil(F.count("*") / MEET).alias("parts")).where("parts > 1")
    roots = spanned(met, large, _near)  # chains of fingerprints
    met = roots.select(F.col("root").alias("meeting"), F.col("node").alias("id")).unionByName(roots.select(F.col("root").alias("meeting"), F.col("root").alias("id")).distinct())
    met, _ = stage(met.join(classes.select("id", "n"), "id").select("meeting", "id", "n"), "met")
    needed, _ = stage(met.select("id").join(classes.select("id", "f.k1", "f.k2"), "id"), "needed")
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(needed))
    placed = texts.withColumn("place", F.pmod(F.col("k1"), F.lit(2**FILTER_BITS)))
    sets = placed.mapInArrow(partial(_shingle_sets, width=width, shared=shared), "k1 long, k2 long, shingles binary")
    sets = sets.join(needed, ["k1", "k2"]).groupBy("id").agg(F.min("shingles").alias("shingles"))
    sets, _ = stage(sets, "shingles")

    large = met.groupBy("meeting").agg(F.ceil(F.greatest(F.count("*") / MEET, F.sum("n") / MEET_SHINGLES)).alias("parts")).where("parts > 1")
    roots = spanned(met.select("meeting", "id"), large, partial(_alike, similarity=similarity), sets)
    rooted = classes.select("key", "id", "f").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    stays = rooted.groupBy("root").agg(F.min("f").alias("s"))
    named, _ = stage(rooted.join(stays, "root").select("key", "s"), "groups")
    own = (F.col("k1") == F.col("s.k1")) & (F.col("k2") == F.col("s.k2"))
    return marked.select("doc_id", "k1", "k2", "key").join(named, "key").select("doc_id", "k1", "k2", F.col("s.doc_id").alias("component_id"), own.alias("stays"))


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of every row but those that stay for their group (``near_groups``)."""
    return near_groups(docs, width, similarity).where("not stays").select("doc_id", "component_id")


def without_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies (``near_groups``), with all its columns whatever their names.

    Rows are told by doc_id and text together, so another text under the doc_id of a copy is judged
    by itself; of rows repeated whole one stays, whichever.
    """
    kept_keys = lambda: near_groups(docs, width, similarity).where("stays").groupBy("k1", "k2").agg((F.count("*") > 1).alias("several"))
    found, _ = stage_alone(docs.sparkSession, kept_keys, "kept")
    given = docs.select(*(k.alias(c) for k, c in zip(row_key(), ("k1", "k2"))), F.struct(*docs.columns).alias("row"))
    kept = given.join(found, ["k1", "k2"])
    return kept.where("not several").select("row.*").unionByName(kept.where("several").dropDuplicates(["k1", "k2"]).select("row.*"))
