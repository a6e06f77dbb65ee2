import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from lumenfold.llm import class_lm, knn_quality, lang_id, license_scan, quality_rules, spaced_seeds, svm
from lumenfold.llm.common import documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def part(d, mod):
    return None if d is None else zlib.crc32(str(d).encode()) % mod


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_votes_on_held_out_rows(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = knn_quality.score_documents(documents(spark, sf), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.88  # 320 labelled rows; 0.9999 at sf0.1
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    few = spark.createDataFrame([(d, d % 2, "x") for d in range(20, 60)] + [(None, 1, "x"), (21, None, "x")], "doc_id long, quality int, text string")
    rows = knn_quality.score_documents(docs, few).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {None}
    assert {r.score for r in knn_quality.score_documents(docs, few.limit(0)).collect()} == {0.5}
    assert knn_quality.score_documents(empty, few).collect() == []
    assert knn_quality.accepted(docs, few.limit(0)).columns == docs.columns


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(0)
    x, y = np.abs(rng.normal(size=(200, knn_quality.WORDS + knn_quality.SHARES))).astype(np.float32), rng.integers(0, 2, 200)
    model = knn_quality.fit(x, y)
    z = knn_quality.latent(knn_quality.weighted(x, model["rarity"]), model["basis"])
    cosine = z @ model["vectors"].T
    for i, s in enumerate(knn_quality.vote(model, x, block=7)):
        near = np.argsort(-cosine[i])[: knn_quality.NEIGHBOURS]
        w = np.maximum(cosine[i][near], 1e-3) ** knn_quality.POWER
        assert s == pytest.approx((w * y[near]).sum() / w.sum(), rel=1e-3)


BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def test_license_places(docs, texts, empty):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(docs).collect()), key=str)
    want = []
    for d, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        found = sorted((i, label) for i in range(len(w)) for p, label in BASE.items() if tuple(w[i : i + len(p)]) == p)
        want.append((d, len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))))
    assert got == sorted(want, key=str)
    assert license_scan.scan(empty).collect() == []


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("under the GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
        ("see https://www.apache.org/licenses/LICENSE-2.0", {"apache-2.0"}),
        ("mit der Lizenz", set()),
        ("The Unlicense", {"unlicense"}),
    ],
)
def test_license_signatures(text, labels):
    _, kept = license_scan.scan_words(license_scan.normalized(text))
    assert {d[3] for d in kept} == labels


def test_containment_suppression():
    a, inside, around, beside = (0, 10, 60, "a", 0.8), (2, 8, 50, "b", 0.6), (0, 20, 10, "c", 0.3), (12, 18, 50, "d", 0.6)
    assert license_scan.suppress([inside, a, around, beside]) == [a, beside]


def test_seeds_tolerate_substitutions(spark, docs, empty):
    rng = random.Random(4)
    items = [(k, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(n))) for k, n in enumerate([6, 15, 30, 40, 59])] + [(90, None), (91, ""), (None, "nothing like it at all in here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for k, text in items[:5]:
        w = text.split()
        rows.append((100 + k, "before these words " + text.upper().replace(" ", ", ") + " after"))
        if len(w) > 20:
            w[len(w) // 2] = "substituted"
            rows.append((200 + k, "lead in " + " ".join(w)))
        rows.append((300 + k, " ".join(reversed(w))))
    rows += [(400, None), (401, "clean words only"), (None, items[2][1])]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in spaced_seeds.contaminated(given, bench).collect()}
    assert set(got) == {(100 + k, k) for k in range(5)} | {(200 + k, k) for k in (2, 3, 4)} | {(None, 2)}
    assert got[202, 2].matched == 29 and got[202, 2].doc_begin == 2
    kept = {r.doc_id for r in spaced_seeds.clean_documents(given, bench).collect()}
    assert kept == {300, 301, 302, 303, 304, 400, 401}
    assert spaced_seeds.contaminated(empty, bench).collect() == [] and spaced_seeds.contaminated(docs, bench.limit(0)).collect() == []
    assert spaced_seeds.clean_documents(docs, bench).columns == docs.columns


def test_benchmark_blocks(monkeypatch, spark):
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k}") for k in range(40)], "item_id long, text string")
    monkeypatch.setattr(spaced_seeds, "BLOCK_BYTES", 60)
    blocks = list(spaced_seeds.benchmark_blocks(bench))
    assert len(blocks) > 5 and sorted(i for b in blocks for i, _ in b) == list(range(40))
    docs = spark.createDataFrame([(k, f"x a{k} b{k} c{k} d{k} y") for k in range(40)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in spaced_seeds.contaminated(docs, bench).collect()} == {(k, k) for k in range(40)}
    assert spaced_seeds.clean_documents(docs, bench).count() == 0


def slow_overlaps(items, text):
    """Every diagonal with a seed hit, each word by word."""
    masks, out = [[k for k, c in enumerate(m) if c == "1"] for m in spaced_seeds.MASKS], []
    for number, item in enumerate(items):
        best = None
        for shift in range(-len(item), len(text)):
            same = {k: text[k + shift] == item[k] for k in range(len(item)) if 0 <= k + shift < len(text)}
            hit = len(item) < 12 and len(same) == len(item) and all(same.values())
            hit |= len(item) >= 12 and any(all(same.get(j + p, False) for p in m) for m in masks for j in range(len(item) - 11) if 0 <= j + shift <= len(text) - 12)
            if not hit:
                continue
            total, low, at, top = 0, 0, min(same), (0, 0, 0)
            for k in sorted(same):
                total += 1 if same[k] else -spaced_seeds.MISMATCH
                if total - low > top[0]:
                    top = (total - low, at, k + 1)
                if total < low:
                    low, at = total, k + 1
            matches = sum(same[k] for k in range(top[1], top[2]))
            if matches >= min(12, len(item)) and matches >= 0.8 * (top[2] - top[1]) and (best is None or matches > best[4]):
                best = (number, top[1] + shift, top[2] + shift, top[1], matches)
        if best:
            out.append(best)
    return out


def test_overlaps_of_repetitive_texts():
    rng = random.Random(8)
    for _ in range(60):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        items = [[rng.choice(letters).encode() for _ in range(rng.choice([4, 12, 20, 30]))] for _ in range(3)] + [[b"a"] * 25, [b"a", b"b"] * 12]
        text = [rng.choice(letters).encode() for _ in range(40)] + [b"a"] * rng.randint(0, 40) + [b"a", b"b"] * rng.randint(0, 20)
        text += items[1][: rng.randint(0, 30)]
        got = spaced_seeds.overlaps(spaced_seeds.SeedTable(items), spaced_seeds.word_hashes(text))
        assert got == slow_overlaps(items, text)


def test_long_repetitive_texts():
    for item, text in ((["x"] * 500, ["x"] * 100_000), (["x"] * 400 + [f"q{k}" for k in range(100)], ["x"] * 100_000), (["a", "b"] * 250, ["a", "b"] * 50_000)):
        table, h = spaced_seeds.SeedTable([[w.encode() for w in item]]), spaced_seeds.word_hashes([w.encode() for w in text])
        began = time.time()
        assert len(spaced_seeds.overlaps(table, h)) == 1 and time.time() - began < 10  # a second or two; the product of equal seeds takes minutes


def test_language_model_base_and_gain(spark, docs, texts, empty):
    got = class_lm.score(docs).collect()
    seqs = [(d, [*WORDS.findall(lower(t)), ""]) for d, t in texts]
    c = collections.Counter(w for d, ws in seqs if part(d, 7) not in (2, None) for w in ws)
    n, v = c.total(), len(c)
    want = sorted(((d, None if d is None else part(d, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in seqs), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == want
    assert class_lm.score(empty).collect() == []
    rows = class_lm.score(documents(spark, "/root/testdata/sf0.01")).where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum() * 0.97


def test_score_is_transitions_and_emissions(monkeypatch, spark):
    """Given the classes, every text's score from counts over all training tokens, word by word; head words, rarer and unseen ones."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    rows = [(d, " ".join(rng.choice(words[: rng.choice([20, 400])]) for _ in range(rng.randint(0, 60)))) for d in range(300)]
    monkeypatch.setattr(class_lm, "HEAD", 120)  # so that other words' counts are joined and their classes are their spellings'
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [[*t.encode().split(), b""] for d, t in rows if part(d, 7) != 2]
    model, _, _ = class_lm.fit(spark.createDataFrame([(d, t, part(d, 7) == 2) for d, t in rows], "doc_id long, text string, held_out boolean"))
    of = lambda w: class_lm.CLASSES if w == b"" else int(class_lm._classes([w], model)[1][0])
    assert 100 <= len(model["head_of"]) <= 140
    c = collections.Counter(w for ws in train for w in ws)
    tokens, kinds, pairs = collections.Counter(), collections.Counter(), collections.Counter()
    for w, n in c.items():
        tokens[of(w)] += n
        kinds[of(w)] += 1
    for ws in train:
        for a, b in zip([b"", *ws], ws):
            pairs[of(a), of(b)] += 1
    size = class_lm.CLASSES + 1
    into = [sum(pairs[a, b] for a in range(size)) for b in range(size)]

    def transition(a, b):
        row = [pairs[a, k] for k in range(size)]
        left = sum(row) - sum(max(n - class_lm.DISCOUNT, 0) for n in row) if sum(row) else 1.0
        return (max(row[b] - class_lm.DISCOUNT, 0) + left * (into[b] + 0.5) / (sum(into) + 0.5 * size)) / max(sum(row), 1)

    got = {r.doc_id: r.score for r in class_lm.score(docs).collect()}
    for d, t in rows:
        line = [b"", *t.encode().split(), b""]
        want = sum(math.log10(transition(of(a), of(b))) for a, b in zip(line, line[1:]))  # the end is alone in its class
        want += sum(math.log10((c[b] + class_lm.ADDED) / (tokens[of(b)] + class_lm.ADDED * (kinds[of(b)] + 1))) for b in line[1:-1])
        assert got[d] == pytest.approx(want, abs=1e-6)


def test_rare_words_are_joined(monkeypatch, docs):
    whole = sorted(((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in class_lm.score(docs).collect()), key=str)
    monkeypatch.setattr(class_lm, "HEAD", 50)
    monkeypatch.setattr(class_lm, "CLUSTERED", 2000)
    few = sorted(((r.doc_id, r.n_known, round(r.base_score, 6)) for r in class_lm.score(docs).collect()), key=str)
    assert few == [w[:3] for w in whole]


def test_passes_over_ranks_hold_no_table_of_words():
    from types import SimpleNamespace as Shared

    import pyarrow as pa

    from lumenfold.llm import common

    few = {"by_rank": np.arange(4) % class_lm.CLASSES, "grown": 0, "symbols": np.arange(4), "matrix": np.zeros((65, 65)), "head_of": np.zeros(4, np.int64)}
    ranks, words = pa.RecordBatch.from_pydict({"ranks": [np.array([0, 3, 1], "<i4").tobytes()]}), pa.RecordBatch.from_pydict({"word": ["some", ""], "c": [2, 1]})
    passes = [(class_lm._count_pairs, ranks, 1), (class_lm._count_contexts, ranks, 1), (class_lm._count_classes, ranks, 1), (class_lm._exchange_words, ranks.slice(0, 0), 1), (class_lm._count_spellings, words, 0), (class_lm._score, ranks.slice(0, 0), 1)]
    for of, batch, shares in passes:
        common.worker_table("words", lambda: {b"some": 0})
        shared = Shared(value={**few, "base": np.zeros(5)})
        list(of(iter([batch][: batch.num_rows]), *[shared] * shares))
        assert not common._TABLE, of


def test_contexts_are_a_row_a_word():
    """Texts' contexts come a row for each word, not for each context, and add up to counts over all bigrams, however batches cut a word's rows."""
    from types import SimpleNamespace as Shared

    import pyarrow as pa

    rng, least = np.random.default_rng(4), class_lm.CLUSTERED
    by_rank = np.arange(least + 40) % class_lm.CLASSES
    texts = [rng.integers(least - 5, least + 30, rng.integers(0, 50)).astype("<i4") for _ in range(300)]
    shared, rows, want = Shared(value={"by_rank": by_rank, "grown": least + 25}), [], collections.Counter()
    for k in range(0, 300, 100):
        out = list(class_lm._count_contexts(iter([pa.RecordBatch.from_pydict({"ranks": [t.tobytes() for t in texts[k : k + 100]]})]), shared))
        words = [w for b in out for w in b["word"].to_pylist()]
        assert len(words) == len(set(words)) == 25
        rows += [r for b in out for r in b.to_pylist()]
    end = class_lm.CLASSES
    for t in texts:
        of = [end, *by_rank[t].tolist(), end]
        for k, w in enumerate(t.tolist()):
            if least <= w < least + 25:
                want.update([(w, of[k]), (w, end + 1 + of[k + 2])] + [(w, class_lm.WIDTH - 1)] * int(k + 1 < len(t) and t[k + 1] == w))
    table = pa.Table.from_pylist(sorted(rows, key=lambda r: r["word"]))
    got = list(class_lm._summed(table.slice(k, 4).combine_chunks().to_batches()[0] for k in range(0, len(rows), 4)))
    assert {(int(w), int(c)): int(line[c]) for ws, lines in got for w, line in zip(ws, lines) for c in np.flatnonzero(line)} == want
    assert sum(len(ws) for ws, _ in got) == 25


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    kinds = np.arange(31) % 3
    pairs = np.zeros((31, 31))
    for _ in range(6000):
        a = rng.integers(0, 30)
        b = rng.choice(np.flatnonzero(kinds[:30] == (kinds[a] + 1) % 3))
        pairs[a, b] += 1
    of = class_lm.exchange(pairs, classes=3, rounds=10)
    assert len({(int(k), int(o)) for k, o in zip(kinds[:30], of[:30])}) == 3  # classes are the kinds
    t = class_lm.transitions(pairs, of)
    assert np.allclose((10**t).sum(axis=1), 1)


def test_languages(spark, docs, texts, empty):
    full = documents(spark, "/root/testdata/sf0.01")
    got = lang_id.identify(full).toPandas().merge(full.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    rows = lang_id.identify(docs).collect()
    assert len(rows) == len(texts)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {d for d, t in texts if not any(ch.isalpha() for ch in t or "")}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert lang_id.identify(empty).collect() == []


def test_numerals_are_no_letters(spark, docs):
    rows = [(k, t, "en") for k, t in enumerate(["²½", "Ⅷ", "①②", "42 !", "ªb", "日", "learned text"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {d for d, v in got.items() if v == ("und", 0.0)} == {0, 1, 2, 3} and all(got[d][0] == "en" for d in (4, 5, 6))


def test_svm_separates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = np.where(x[:, 0] - x[:, 1] > 0.2, 1.0, -1.0)
    w = svm.fit(x, y)
    assert ((np.c_[x, np.ones(300)] @ w > 0) == (y > 0)).mean() > 0.95


def test_quality_counts_and_rejection(spark, docs, texts, empty):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect()), key=str)
    want = []
    for d, t in texts:
        t = t or ""
        w = WORDS.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert got == sorted(want, key=str)
    assert quality_rules.judge(empty).collect() == []
    rng = random.Random(6)
    clean = [(k, " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(80, 300))), "en", "web") for k in range(200)]
    junk = [(1000 + k, " ".join(f"w{rng.randint(0, 999)}***###" for _ in range(100)), "en", "web") for k in range(10)]
    words = lambda n: [f"w{rng.randint(0, 9999)}" for _ in range(n)]
    junk += [(2000 + k, " ".join(words(120)) + "\nok" * 30, "en", "web") for k in range(5)]  # nearly all lines are duplicates
    junk += [(3000 + k, " ".join(half + words(53) + half), "en", "web") for k in range(5) for half in [words(24)]]  # nearly half of the words repeat
    for k in range(5):  # harmless: the first line again at the end
        first = " ".join(words(10))
        clean.append((200 + k, "\n".join([first, *(" ".join(words(20)) for _ in range(5)), first]), "en", "web"))
    clean += [(300, " ".join(words(100)), "en", "rare"), (301, " ".join(words(150)), "xx", "rare")]  # groups of one row lean on the others
    junk += [(4000, " ".join(f"{w}***###" for w in words(100)), "en", "rare two"), (4001, " ".join(f"{w}***###" for w in words(100)), "yy", "web")]
    rows = quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in rows if r.kept} == {d for d, *_ in clean} and not {r.doc_id for r in rows if r.base_failed}


def concentrated(x, m, p, steps=100):
    """Concentration steps to the end, by the module's bins: covariance and its determinant."""
    floors = np.diag(np.square(quality_rules.FLOOR))
    stretch = 1 + math.log(1 / (1 - quality_rules.CORE)) / x.shape[1]
    for _ in range(steps):
        bins = np.floor(np.log1p(np.einsum("ij,jk,ik->i", x - m, p, x - m)) * 64)
        cut = np.sort(bins)[math.ceil(quality_rules.CORE * len(x)) - 1]
        core = x[bins <= cut]
        m, c = core.mean(axis=0), np.cov(core.T, bias=True) * stretch
        p = np.linalg.inv(c + floors)
    return m, c, len(core), np.linalg.slogdet(c + floors)[1]


def test_least_determinant_of_several_starts(spark):
    rng = np.random.default_rng(7)
    frames, best = [], {}
    for g in range(4):  # the larger g, the more rows of a second cloud
        x = rng.normal(0, 0.2, (300, 5)) + 2
        x[: 40 * g] = rng.normal(0, 0.05 * (g + 1), (40 * g, 5)) + [3, 2.5, 2, 2.6, 2.4]
        frames += [("en", f"s{g}", *map(float, r)) for r in x]
        middle = np.median(x, axis=0)
        mads = 1.4826 * np.median(np.abs(x - middle), axis=0) + quality_rules.FLOOR
        begin = [(middle, np.diag(1 / mads**2)), (x.mean(axis=0), np.linalg.inv(np.cov(x.T, bias=True) + np.diag(np.square(quality_rules.FLOOR)))), (middle, np.diag(1 / np.square(quality_rules.FLOOR)))]
        best[f"s{g}"] = min((concentrated(x, *b) for b in begin), key=lambda e: round(e[3], 6))
    rows = spark.createDataFrame(frames, "lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got, x = {r.source: r for r in quality_rules.estimates(rows).collect()}, {s: np.array([f[2:] for f in frames if f[1] == s]) for s in best}

    def shrunk(moments):  # every group has one language, so its target is that of all rows
        raw = {s: (n, m, c + np.outer(m, m)) for s, (m, c, n) in moments.items()}
        total = sum(n for n, *_ in raw.values())
        every = [sum(r[0] * r[k] for r in raw.values()) / total for k in (1, 2)]
        out = {}
        for s, (n, m, q) in raw.items():
            m, q = ((n * v + quality_rules.PRIOR * t) / (n + quality_rules.PRIOR) for v, t in zip((m, q), every))
            out[s] = m, q - np.outer(m, m)
        return out

    near, final = shrunk({s: b[:3] for s, b in best.items()}), {}
    for s, (m, c) in near.items():
        p = np.linalg.inv(c + np.diag(np.square(quality_rules.FLOOR)))
        core = x[s][np.einsum("ij,jk,ik->i", x[s] - m, p, x[s] - m) <= quality_rules.chi_square(5, 0.975)]
        final[s] = core.mean(axis=0), np.cov(core.T, bias=True), len(core)
    for s, (m, c) in shrunk(final).items():
        assert np.allclose([got[s][f"m{i}"] for i in range(5)], m, atol=1e-3), s
        assert np.allclose([[got[s][f"c{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)], c, atol=1e-3), s


def test_quality_rules_run_no_python(spark, docs):
    plans, stage = [], quality_rules.stage

    def watched(df, label):
        plans.append(df)
        return stage(df, label)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "stage", watched)
        plans.append(quality_rules.judge(docs))
    assert len(plans) > quality_rules.STEPS
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_chi_square():
    assert quality_rules.chi_square(5, 0.975) == pytest.approx(12.83, abs=0.05)


def test_words_beyond_the_first_clustering_are_exchanged(spark):
    """Two kinds of words take turns; all end alike, so only contexts tell the kinds apart."""
    rng = random.Random(6)
    kinds = [["".join(rng.choices("abcdefgh", k=8)) + "zz" for _ in range(1500)] for _ in range(2)]
    rows = [(d, " ".join(rng.choice(kinds[k % 2]) for k in range(200))) for d in range(600)]
    got = class_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert got.score.sum() / got.n_tokens.sum() > -3.3  # a word of a known kind: -3.18; of either: -3.48


def test_languages_of_few_texts_are_learned(monkeypatch, spark):
    monkeypatch.setattr(lang_id, "SAMPLE", 100)
    rows = [(d, f"copied text number {d % 2}", "xx") for d in range(3000)] + [(d, f"another text {d}", "yy") for d in range(3000, 6000)]
    sample = lang_id.learning_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sample.lang.value_counts().to_dict() == {"xx": 2, "yy": 50}
