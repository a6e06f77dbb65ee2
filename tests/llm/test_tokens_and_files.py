import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lumenfold.llm import curve_packing as cp  # noqa: E402
from lumenfold.llm import record_files as rf  # noqa: E402
from lumenfold.llm.common import scratch  # noqa: E402
from lumenfold.llm.tokens import encoder  # noqa: E402

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_give_the_ids_of_whole_texts(path):
    rng, e = random.Random(3), encoder(path)
    texts = ["", " ", " a", "a ", "x \ny", "x\n \ny", "a\n\n b\n", "don't WE'LL 12", "<|endoftext|>x", "İ ΣΑΣ é ̈x", "\x00 z", "a\x01 b"]
    texts += ["".join(rng.choice(" \n\ta b'sé1.,\xa0\x1c<|") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u2").tolist() == e.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_records_round_trip(docs, texts, empty):
    rows = sorted(rf.encode_and_reread(docs, BYTE).collect(), key=lambda r: r.start)
    want = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    lib, at = encoder(BYTE).library, 0
    by_id = {}
    for d, t in want:
        by_id.setdefault(d, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 0])
    for r in rows:
        assert r.start == at and any((r.n_tokens, r.ids_crc32) == (len(x), crc(x)) for x in by_id[r.doc_id])
        at += r.n_tokens
    assert rf.encode_and_reread(empty, BYTE).collect() == []


def test_shuffled_reads_and_damage(docs, spark):
    path = scratch(spark, "t")
    shard = max(rf.write_records(docs, path, BYTE).collect(), key=lambda r: r.docs)
    last, first = rf.fetch(path, shard.name, [shard.docs - 1, 0])
    assert first[0] == shard.first_id and last[1][-1] == 0
    whole = rf.frame(b"payload")
    assert bytes(rf.unframe(memoryview(whole), 0)[0]) == b"payload"
    for k in range(len(whole)):
        broken = bytearray(whole)
        broken[k] ^= 1
        with pytest.raises(Exception):
            rf.unframe(memoryview(bytes(broken)), 0)


def test_hilbert_neighbours_are_adjacent():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = cp.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    line = points[np.argsort(keys)]
    assert (np.abs(np.diff(line, axis=0)).sum(axis=1) == 1).all()


def test_packing_holds_each_id_once(docs, texts, empty):
    rows = cp.pack(docs, WORD, length=64, with_ids=True).collect()
    lib, seqs, by_doc = encoder(WORD).library, {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        ids = np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert (len(ids), crc(ids)) == (r.length, r.ids_crc32)
    sizes = []
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(s == 64 or s & (s - 1) == 0 for s in sizes) and sum(s != 64 for s in sizes) <= 6
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    for d, copies in want.items():
        assert sum(r.length for r in by_doc[d]) == sum(map(len, copies))
        if len(copies) == 1:
            joined = b"".join(bytes(r.ids) for r in sorted(by_doc[d], key=lambda r: r.start))
            assert np.frombuffer(joined, "<u2").tolist() == copies[0] and by_doc[d][0].doc_tokens == len(copies[0])
    assert cp.pack(empty, WORD).collect() == []


def test_cut_points_cover_any_stream():
    for total in range(1, 200):
        ends = cp.cut_points(0, total, total, 16)
        assert [e for _, e, _, _ in ends][:-1] == [b for b, _, _, _ in ends][1:] and ends[-1][1] == total
        rest = [b - a for a, b, _, _ in ends if b - a != 16]
        assert all(x & (x - 1) == 0 for x in rest)


def test_ordering_the_stream_holds_no_encoder():
    import pyarrow as pa
    from lumenfold.llm import common

    encoder(WORD).encode("some units")
    assert common._TABLE
    batch = pa.RecordBatch.from_pydict({"doc_id": [4, 5], "n": [3, 2], "ids": [b"abcdef", b"abcd"]})
    rows = [r for b in cp.placed_at(iter([batch, batch.slice(0, 0), batch]), 7) for r in b.to_pylist()]
    assert [(r["part"], r["at"], r["doc_id"], r["n"]) for r in rows] == [(7, 0, 4, 3), (7, 3, 5, 2), (7, 5, 4, 3), (7, 8, 5, 2)]
    assert not common._TABLE
