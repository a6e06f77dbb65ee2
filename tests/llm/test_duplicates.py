import hashlib
import random
import re

import numpy as np
import xxhash
from lumenfold.llm import fm_dedup as fm
from lumenfold.llm import pivot_simhash as ps
from lumenfold.llm.components import components
from lumenfold.llm.fm_index import FMIndex, suffix_order

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def fingerprint(text, width=3):
    w = WORDS.findall(lower(text))
    runs = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        new = [min(root[j] for j in range(n) if linked[i][j]) for i in range(n)]
        changed, root = new != root, new
    return root


def test_simhash_matches_brute_force(docs, texts, empty):
    got = sorted(((r.doc_id, r.bits % 2**64, r.component_id) for r in ps.cluster(docs).collect()), key=str)
    bits = [fingerprint(t) for _, t in texts]
    linked = [[bin(a ^ b).count("1") <= 2 for b in bits] for a in bits]
    groups = roots(len(bits), linked)
    least = {g: min((d for (d, _), x in zip(texts, groups) if x == g and d is not None), default=None) for g in groups}
    assert got == sorted(((d, b, least[g]) for (d, _), b, g in zip(texts, bits, groups)), key=str)
    assert ps.cluster(empty).collect() == []


def test_pivot_links_span_the_graph():
    rng = np.random.default_rng(0)
    pivots = rng.integers(0, 2**64, (48, 1), np.uint64)
    for _ in range(20):
        base = rng.integers(0, 2**64, 4, np.uint64)
        flips = [int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(40)]
        bits = np.unique(np.array([int(base[k % 4]) ^ f for k, f in enumerate(flips)], np.uint64))
        linked = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2
        i, j = ps.pivot_links(bits[:, None], 2, pivots)
        assert linked[i, j].all()
        spanned = np.eye(len(bits), dtype=bool)
        spanned[i, j] = spanned[j, i] = True
        assert roots(len(bits), linked) == roots(len(bits), spanned)


def test_fingerprints_meet_by_coordinates(monkeypatch, spark):
    """Whatever the number of coordinates and of parts, links span what brute force links, and the table discards most that meet by chance."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, np.uint64)
    flip = [int(base[k % 300]) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for k in range(1500)]
    close = [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]  # one large group
    bits = np.unique(np.array(flip + close, np.uint64))
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2
    want, place = roots(len(bits), near), {int(b): k for k, b in enumerate(bits.view(np.int64).tolist())}
    rows = spark.createDataFrame([(b,) for b in bits.view(np.int64).tolist()], "bits long").cache()
    for coordinates, meet in ((1, 4096), (3, 4096), (3, 16), (16, 4096)):
        monkeypatch.setattr(ps, "MEET", meet)
        monkeypatch.setattr(ps, "coordinates_for", lambda *_, c=coordinates: c)
        spanned = np.eye(len(bits), dtype=bool)
        for r in ps.links(rows, 2).collect():
            i, j = place[r.a], place[r.b]
            assert near[i, j]
            spanned[i, j] = spanned[j, i] = True
        assert roots(len(bits), spanned) == want
        longest = max(len(r.members) for r in ps.meetings(rows, 2, coordinates).collect())
        assert meet > 16 or longest < 6 * meet
    monkeypatch.undo()
    a, b = (rng.integers(0, 2**64, 10_000, np.uint64) for _ in range(2))
    assert len(ps.pair_links(a, b, 2, ps.references(2))) == 0
    kept = np.arange(10_000)
    for p in ps.references(2):
        kept = kept[np.abs(np.bitwise_count(a[kept] ^ p).astype(int) - np.bitwise_count(b[kept] ^ p)) <= 2]
    assert len(kept) < 10  # discarded by coordinates alone
    assert ps.coordinates_for(10**4, 2) < ps.coordinates_for(10**7, 2) <= ps.COORDINATES


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 501)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in root if find(x) != x}


def test_near_copies_at_a_similarity(spark, docs, empty):
    rng, rows = random.Random(5), []
    for g in range(12):
        base = [f"g{g}x{rng.randint(0, 10**6)}" for _ in range(120)]
        rows.append((g * 10, " ".join(base)))
        for c in range(1, 5):  # c words changed: similarity falls from 0.92 on
            copy = list(base)
            for k in range(c):
                copy[10 + 25 * k] = f"new{g}{c}{k}"
            rows.append((g * 10 + c, " ".join(copy)))
    sets = {d: set(ps.shingle_hashes(t, 5)) for d, t in rows}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = [d for d, _ in rows]
    groups = roots(len(ids), [[sim(a, b) >= 0.8 for b in ids] for a in ids])
    want = {d: ids[g] for d, g in zip(ids, groups) if ids[g] != d}
    got = {r.doc_id: r.component_id for r in ps.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert {2: 1, 3: 1}.items() <= {r.doc_id: r.component_id for r in ps.near_copies(docs).collect()}.items()
    assert ps.near_copies(empty).collect() == []


def test_large_bands_are_split(monkeypatch, spark):
    base = [f"b{k}" for k in range(100)]
    rows = [(d, " ".join([*base[:99], f"end{d}"])) for d in range(60)]
    monkeypatch.setattr(ps, "MEET", 8)
    got = {r.doc_id: r.component_id for r in ps.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 0 for d in range(1, 60)}


def test_suffix_order_and_backward_search():
    rng = np.random.default_rng(1)
    for sigma in (2, 3, 40):
        text = np.r_[rng.integers(1, sigma + 1, 400), 0]
        order = suffix_order(text)
        head = lambda p: text[p : p + 16].tolist()
        assert all(head(a) <= head(b) for a, b in zip(order, order[1:]))
        index = FMIndex(text, sigma)
        patterns = np.concatenate([rng.integers(1, sigma + 1, (60, 5)), text[np.arange(50)[:, None] + np.arange(5)]])
        matched, low, high = index.matching(patterns)
        for row, m, a, b in zip(patterns, matched, low, high):
            found = sorted(k for k in range(len(text) - 5) if (text[k : k + 5] == row).all())
            assert sorted(order[a:b].tolist()) == found and (m == 5) == bool(found)


def brute_dedup(texts):
    words, first = [WORDS.findall(t or "") for _, t in texts], {}
    num = lambda d: float("inf") if d is None else d
    for (d, _), w in zip(texts, words):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, float("inf")), num(d))
    out = []
    for (d, _), w in zip(texts, words):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < num(d):
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_passages_match_brute_force(docs, texts, empty):
    got = sorted((tuple(r)[:4] for r in fm.repeated_spans(docs).collect()), key=str)
    assert got == brute_dedup(texts)
    assert fm.repeated_spans(empty).collect() == []


def test_passages_of_repetitive_texts(monkeypatch, spark):
    monkeypatch.setattr(fm, "BLOCK_BYTES", 2000)
    rng = random.Random(9)
    texts = [(k, " ".join(rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randint(0, 150)))) for k in range(60)]
    got = sorted((tuple(r)[:4] for r in fm.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()), key=str)
    assert got == brute_dedup(texts)


def test_windows_of_common_anchors_are_dealt_by_their_words(monkeypatch, spark):
    monkeypatch.setattr(fm, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(fm, "HOT", 2)
    rng = random.Random(10)
    common = [f"c{k}" for k in range(40)]
    texts = []
    for k in range(40):  # a passage that all share, some with a word of their own in it
        words = list(common)
        if k % 3 == 0:
            words[rng.randint(0, 39)] = f"own{k}"
        texts.append((k, " ".join([f"a{k}x{i}" for i in range(rng.randint(0, 20))] + words + [rng.choice("pq") for _ in range(rng.randint(0, 30))])))
    got = sorted((tuple(r)[:4] for r in fm.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect()), key=str)
    assert got == brute_dedup(texts)


def test_cut_keeps_the_rest_as_it_was():
    assert fm.cut_words(" a  b\nc d\te ", [1, 3]) == " a  d\te "
    assert fm.cut_words("a b", [0, 2]) == ""


def test_without_repeats_keeps_columns(docs, texts):
    out = fm.without_repeats(docs)
    assert out.columns == docs.columns
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, dict(texts)[1]) in rows and not any(d == 2 for d, _ in rows)
    assert (6, None) in rows and (7, "") in rows


def revised(rng, copies, words, least, most):
    """Copies of a text of distinct words, each with some of them changed."""
    base, rows = [f"b{k}" for k in range(words)], []
    for d in range(copies):
        copy = list(base)
        for k in rng.sample(range(words), rng.randint(least, most)):
            copy[k] = f"e{rng.randint(0, 10**9)}"
        rows.append((d, " ".join(copy)))
    return rows


def brute_copies(rows):
    sets = [set(ps.shingle_hashes(t, 5)) for _, t in rows]
    linked = [[a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets]
    return {d: rows[g][0] for (d, _), g in zip(rows, roots(len(rows), linked)) if rows[g][0] != d}


def copies(spark, rows):
    return {r.doc_id: r.component_id for r in ps.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_near_copies_of_revised_texts(spark):
    rows = revised(random.Random(1), 120, 300, 4, 7)
    assert copies(spark, rows) == brute_copies(rows)


def test_near_copies_of_repeated_lines_and_short_texts(spark):
    base, line = " ".join(f"b{k}" for k in range(300)), " ".join(f"l{k}" for k in range(15))
    rows = [(k, base + f"\n{line}" * n) for k, n in enumerate((1, 5, 10, 40))]
    for g in range(40):  # 8 and 9 words: the similarity is exactly 0.8
        rows += [(10 + 2 * g + k, " ".join(f"s{g}x{i}" for i in range(8 + k))) for k in (0, 1)]
    assert copies(spark, rows) == {1: 0, 2: 0, 3: 0} | {11 + 2 * g: 10 + 2 * g for g in range(40)}


def test_boilerplate_alone_makes_no_copy(spark):
    rows = [(k, line * n + " ".join(f"p{k}x{i}" for i in range(150))) for k, (line, n) in enumerate([("click here now ", 300)] * 2 + [("- ", 400)] * 2)]
    assert copies(spark, [*rows, (4, rows[0][1])]) == {4: 0}


def test_parts_of_large_bands_meet_in_pairs(monkeypatch, spark):
    rows = revised(random.Random(4), 40, 120, 1, 3)
    monkeypatch.setattr(ps, "MEET", 8)
    assert copies(spark, rows) == brute_copies(rows)


def test_set_links_span_the_graph():
    rng = np.random.default_rng(3)
    for size, most in ((4, 3), (30, 8), (700, 250)):
        bases = [rng.integers(0, 2**64, size, np.uint64) for _ in range(3)]
        sets = [np.unique(np.r_[bases[k % 3][rng.integers(0, most) :], rng.integers(0, 2**64, rng.integers(0, most), np.uint64)]) for k in range(60)]
        both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        n = np.array([len(s) for s in sets])
        linked = both >= 0.8 * (n[:, None] + n - both) - 1e-9
        i, j = ps.set_links(sets, 0.8)
        assert linked[i, j].all()
        spanned = np.eye(len(sets), dtype=bool)
        spanned[i, j] = spanned[j, i] = True
        assert roots(len(sets), linked) == roots(len(sets), spanned)


CLASHING = "doc_id long, text string, k1 long, k2 string, key string, row long, spans string, stays string, bands string, doc_id__cut long"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, k, "a", "b", -k, "c", "d", "e", k) for k, (d, t) in enumerate(rows)], CLASHING)


def test_each_text_of_a_doc_id_loses_its_own_passages(spark):
    word = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    p, a, b = word("p", 20), word("a", 20), word("b", 20)
    rows = [(1, p), (2, f"{p} {a}"), (2, f"{b}\n{p}"), (2, f"{b}\n{p}"), (None, f"{a} tail"), (3, None), (None, ""), (4, p)]
    docs = clashing(spark, rows)
    got = fm.without_repeats(docs)
    assert got.schema == docs.schema
    kept = sorted(((r.k1, r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(0, 1, p), (1, 2, a), (2, 2, f"{b}\n"), (3, 2, f"{b}\n"), (4, None, "tail"), (5, 3, None), (6, None, "")], key=str)


def test_one_row_of_each_group_stays(spark):
    word = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    rows = [(5, word("t")), (3, word("t") + " more"), (3, word("u")), (None, word("t")), (None, word("v")), (None, word("v")), (9, word("w")), (9, word("w")), (None, word("x")), (8, None), (7, " "), (6, word("y"))]
    docs = clashing(spark, rows)
    got = ps.without_copies(docs)
    assert got.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, word("t") + " more"), (3, word("u")), (None, word("v")), (9, word("w")), (None, word("x")), (7, " "), (6, word("y"))], key=str)
    groups = {(r.doc_id, r.component_id, r.stays) for r in ps.near_groups(docs).collect()}
    assert {(5, 3, False), (None, 3, False), (None, None, True), (8, 7, False)} <= groups


def test_near_copies_of_the_corpus_match_brute_force(spark):
    """All pairs at the similarity, counted by shingle, over the whole of a corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").sort("doc_id").collect()
    holders, sets = {}, []
    for k, r in enumerate(docs):
        sets.append(set(ps.shingle_set(r.text, 5).tolist()))
        for h in sets[-1]:
            holders.setdefault(h, []).append(k)
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, own in enumerate(sets):
        common = {}
        for h in own:
            for j in holders[h]:
                if j < k:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(j), find(k)))
                root[b] = a
    want = {docs[k].doc_id: docs[find(k)].doc_id for k in range(len(docs)) if find(k) != k}
    got = {r.doc_id: r.component_id for r in ps.near_copies(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    assert len(want) > 500 and len(want.items() & got.items()) >= 0.999 * len(want) and got.items() <= want.items()


def test_table_links_span_the_graph_of_wide_fingerprints():
    rng = np.random.default_rng(8)
    for families, rows, most in ((3, 60, 90), (1, 700, 30), (40, 700, 60), (300, 300, 0)):
        base = rng.integers(0, 2, (families, 256), np.uint8)
        bits = base[rng.integers(0, families, rows)]
        for r in bits:
            r[rng.permutation(256)[: rng.integers(0, most + 1)]] ^= 1
        words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        near = np.bitwise_count(words[:, None] ^ words[None, :]).sum(axis=2) <= ps.WIDE_RADIUS
        i, j = ps.table_links(words, ps.WIDE_RADIUS)
        assert near[i, j].all()
        spanned = np.eye(rows, dtype=bool)
        spanned[i, j] = spanned[j, i] = True
        assert roots(rows, near.tolist()) == roots(rows, spanned.tolist())


def test_near_copies_are_proposed_by_fingerprints(monkeypatch, spark):
    rows = [*revised(random.Random(6), 60, 200, 1, 3), (100, "another text of its own")]
    assert len(copies(spark, rows)) > 50
    monkeypatch.setattr(ps, "_meet", lambda batches, links: iter(()))  # no fingerprints meet: nothing but equal sets is linked
    assert copies(spark, [*rows, (101, rows[-1][1])]) == {101: 100}


def test_rows_meet_in_draws_of_coordinates(monkeypatch, spark):
    monkeypatch.setattr(ps, "CROWD", 4)
    assert ps.draws_for(120).shape[1] == 5 and len(ps.draws_for(120)) > 20
    rows = revised(random.Random(7), 120, 300, 4, 7)
    assert copies(spark, rows) == brute_copies(rows)
    monkeypatch.setattr(ps, "MEET", 8)
    assert copies(spark, rows[:40]) == brute_copies(rows[:40])
