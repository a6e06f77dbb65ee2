"""Brown class-based bigram language model.

Words are grouped by exchange clustering (Martin, Liermann and Ney, 1998), which
moves one word at a time to the class that most raises the training likelihood of
class bigrams. A text's probability is the product of class transitions
(absolute discounting over the class unigram) and word emissions (additive, with
one place a class for unseen words).

The most frequent words are clustered one by one, together with symbols for the
spellings that other words end in. Then every other word of the head that occurs
``LEAST`` times or more is exchanged by its own counts of the classes before and
after it, which Spark sums, against the class bigrams of that first clustering; how
many these are grows with the training rows up to the head. Rarer words keep their
spelling's class, so every word, seen or not, has a class that a worker knows
without a lookup. Texts are read twice: to count words, and to write them as ranks
in the head, which all further passes take without any table of words. Counts cover all training rows.
The driver and the workers hold only what a parameter bounds: ``CLUSTERED`` words, symbol bigrams (at most the
square of the symbols) and the ``HEAD`` most frequent words' counts and classes;
counts of rarer words are joined to the documents that use them.

Defined cases: a null or blank text is the end token alone; a null doc_id belongs
to neither part (held_out null) and is not learned from; repeated rows are scored
each and count each; without training rows every base probability is 1; an empty
table gives no row.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, remainder, stage, text_of, worker_table

CLUSTERED, SPELLINGS, CLASSES, HEAD = 2000, 192, 64, 300_000
SYMBOLS = CLUSTERED + SPELLINGS + 1  # the last is the end token
END = SYMBOLS - 1
ADDED, DISCOUNT, ROUNDS = 0.5, 0.75, 4
LEAST = 10  # occurrences from which a word's own contexts choose its class


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def spelling(word: bytes) -> int:
    """The symbol of a word that is not clustered by itself: its last two bytes, and whether all are letters."""
    plain = word.isalpha() or (word[0] >= 128 and word[-1] >= 97)
    return CLUSTERED + (word[-1] * 31 + (word[-2] if len(word) > 1 else 0) * 7 + (0 if plain else 101)) % SPELLINGS


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, ends = Counter(), 0

    def rows(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "c": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for text in batch["text"]:
            counts.update(words_of(text.as_py()))
            ends += 1
            if len(counts) > 600_000:
                yield rows(counts)
                counts.clear()
    counts[b""] = ends  # no word is empty: the end token
    yield rows(counts)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(matrix: np.ndarray, totals: np.ndarray, out: np.ndarray, into: np.ndarray, own: float, weight: float) -> np.ndarray:
    """What each class gains in log-likelihood by a word that is in none, from the word's bigrams by class: followers, predecessors, itself."""
    now = xlogx(matrix)
    rows, cols = xlogx(matrix + out) - now, xlogx(matrix + into[:, None]) - now
    both = np.diag(matrix)
    gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + xlogx(both + out + into + own) - xlogx(both)
    return gain - 2 * (xlogx(totals + weight) - xlogx(totals))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of symbols from their bigram counts; the last symbol (the end) keeps a class of its own, the last."""
    size = len(pairs) - 1
    counts = pairs
    weight = counts.sum(axis=0)
    of = np.empty(size + 1, np.int64)
    of[np.argsort(-weight[:-1], kind="stable")] = np.arange(size) % classes
    of[size] = classes
    member = np.eye(classes + 1)[of]
    after, ahead = counts @ member, counts.T @ member  # of each symbol: followers and predecessors by class
    matrix, totals = member.T @ after, member.T @ weight
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-weight[:-1], kind="stable"):
            if not weight[w]:
                continue
            a, own = of[w], counts[w, w]
            matrix[a] -= after[w]
            matrix[:, a] -= ahead[w]
            matrix[a, a] += own
            totals[a] -= weight[w]
            out, into = after[w].copy(), ahead[w].copy()
            out[a] -= own
            into[a] -= own
            gain = gains(matrix, totals, out, into, own, weight[w])
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            matrix[b] += out
            matrix[:, b] += into
            matrix[b, b] += own
            totals[b] += weight[w]
            if b != a:
                of[w] = b
                for table, line in ((after, counts[:, w]), (ahead, counts[w])):
                    table[:, a] -= line
                    table[:, b] += line
                moved += 1
        if not moved:
            break
    return of


def transitions(pairs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log10 of the probability of a class after a class."""
    member = np.eye(of.max() + 1)[of]
    counts = member.T @ pairs @ member
    alone = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * len(counts))
    total = counts.sum(axis=1, keepdims=True)
    kept = np.maximum(counts - DISCOUNT, 0)
    left = np.where(total > 0, total - kept.sum(axis=1, keepdims=True), 1.0)
    return np.log10((kept + left * alone) / np.maximum(total, 1.0))


WIDTH = 2 * (CLASSES + 1) + 1  # a word's contexts: the class before, the class after, the word itself after


CONTEXT = np.dtype([("context", "u1"), ("c", "<u4")])  # as a word's contexts travel


def _lookup(m: dict) -> dict[bytes, int]:
    """The head's words by rank; a worker keeps them from task to task and the next pass over ranks lets them go."""
    return worker_table(m["key"], lambda: {w: k for k, w in enumerate(m["head"].split(b" "))} if m["head"] else {})


def _classes(words: list[bytes], m: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (outside the head the number of its words) and classes of words."""
    head, none = _lookup(m), len(m["head_of"])
    at = np.array([head.get(w, none) for w in words], np.int64)
    of, inside = np.empty(len(words), np.int64), at < none
    of[inside] = m["head_of"][at[inside]]
    of[~inside] = m["of"][np.array([spelling(words[k]) for k in np.flatnonzero(~inside).tolist()], np.int64)]
    return at, of


def _rank(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Of each text its words' ranks (a word outside the head: the number of the head's words and its symbol) and, of words outside, each with its symbol and times."""
    m = shared.value
    head, none = _lookup(m), len(m["symbols"])
    for batch in batches:
        for begin in range(0, batch.num_rows, 2048):
            part = batch.slice(begin, 2048)
            cols = {k: [] for k in ("ranks", "word", "times", "symbol")}
            for text in part["text"]:
                words = words_of(text.as_py())
                at = np.array([head.get(w, -1) for w in words], np.int32)
                outside = np.flatnonzero(at < 0).tolist()
                tail = Counter(words[k] for k in outside)
                symbols = {w: spelling(w) for w in tail}
                at[outside] = [none + symbols[words[k]] for k in outside]
                cols["ranks"].append(at.astype("<i4").tobytes())
                cols["word"].append([w.decode() for w in tail])
                cols["times"].append(list(tail.values()))
                cols["symbol"].append(list(symbols.values()))
            kinds = (pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], *(pa.array(v, t) for v, t in zip(cols.values(), kinds))], names=["doc_id", "held_out", *cols])


def _lines(batches: Iterator[pa.RecordBatch], of: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranks and what they stand for (of, by rank) of many texts in a row, with an end token (rank -1) before each and after the last."""
    release()
    stop, held, size = np.array([-1], np.int32), [], 0

    def line():
        at = np.concatenate([*held, stop]).astype(np.int64)
        return at, np.where(at < 0, end, of[at])

    for batch in batches:
        for ranks in batch["ranks"]:
            held += [stop, np.frombuffer(ranks.as_buffer(), "<i4")]
            size += len(held[-1])
            if size > 1_000_000:
                yield line()
                held, size = [], 0
    if held:
        yield line()


def _by_rank(of: np.ndarray, head_of: np.ndarray) -> np.ndarray:
    """Values by rank: those of the head's words, then those of the symbols of words outside."""
    return np.r_[head_of, of[:END]]


def _count_pairs(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    total, of = np.zeros(SYMBOLS**2, np.int64), np.r_[shared.value["symbols"], np.arange(END)]
    for _, line in _lines(batches, of, END):
        total += np.bincount(line[:-1] * SYMBOLS + line[1:], minlength=SYMBOLS**2)
    at = np.flatnonzero(total)
    for k in range(0, len(at), 500_000):
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at[k : k + 500_000]), "c": pa.array(total[at[k : k + 500_000]])})


def _count_contexts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Of many texts in a row each word that may move, with all its contexts in one value."""
    m = shared.value
    for at, of in _lines(batches, m["by_rank"], CLASSES):
        k = np.flatnonzero((at >= CLUSTERED) & (at < m["grown"]))
        word = at[k] * WIDTH
        found, c = np.unique(np.concatenate([word + of[k - 1], word + CLASSES + 1 + of[k + 1], (word + WIDTH - 1)[at[k] == at[k + 1]]]), return_counts=True)
        body = np.empty(len(found), CONTEXT)
        body["context"], body["c"] = found % WIDTH, c
        words, first = np.unique(found // WIDTH, return_index=True)
        ends = np.r_[first, len(found)]
        for i in range(0, len(words), 50_000):
            cut = ends[i : i + 50_001]
            offsets = ((cut - cut[0]) * CONTEXT.itemsize).astype(np.int32)
            values = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body[cut[0] : cut[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000]), values], names=["word", "contexts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and their counts by context (a row of WIDTH each); a word's rows stand together, the last one of a batch may go on in the next."""
    last, rest = np.zeros(0, np.int64), np.zeros((0, WIDTH))
    for batch in batches:
        if not batch.num_rows:
            continue
        words, at = np.unique(batch["word"].to_numpy(), return_inverse=True)
        bodies = batch["contexts"].to_pylist()
        body = np.frombuffer(b"".join(bodies), CONTEXT)
        at = np.repeat(at, [len(b) // CONTEXT.itemsize for b in bodies])
        lines = np.bincount(at * WIDTH + body["context"], body["c"], len(words) * WIDTH).reshape(-1, WIDTH)
        if len(last) and last[0] == words[0]:
            lines[0] += rest[0]
        elif len(last):
            yield last, rest
        yield words[:-1], lines[:-1]
        last, rest = words[-1:], lines[-1:]
    yield last, rest


def _exchange_words(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The best class of each word by its contexts, all else as in the first clustering; rows come in order of their words."""
    release()
    m = shared.value
    for words, lines in _summed(batches):
        best = []
        for word, line in zip(words.tolist(), lines):
            into, out, own, a = line[: CLASSES + 1].copy(), line[CLASSES + 1 : -1].copy(), line[-1], m["head_of"][word]
            weight, matrix, totals = into.sum(), m["matrix"].copy(), m["matrix"].sum(axis=0)
            matrix[a] -= out
            matrix[:, a] -= into
            matrix[a, a] += own
            totals[a] -= weight
            out[a] -= own
            into[a] -= own
            gain = gains(np.maximum(matrix, 0), np.maximum(totals, 0), out, into, own, weight)
            b = int(np.argmax(gain[:CLASSES]))
            best.append(b if gain[b] > gain[a] + 1e-9 else int(a))
        yield pa.RecordBatch.from_pydict({"word": pa.array(words), "class": pa.array(best, pa.int64())})


def _count_classes(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    total = np.zeros((CLASSES + 1) ** 2, np.int64)
    for _, of in _lines(batches, shared.value["by_rank"], CLASSES):
        total += np.bincount(of[:-1] * (CLASSES + 1) + of[1:], minlength=len(total))
    yield pa.RecordBatch.from_pydict({"pair": pa.array(np.arange(len(total))), "c": pa.array(total)})


def _count_spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By spelling (and for the end token) the words and their occurrences."""
    release()
    kinds, tokens = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for b in batches:
        at = np.array([spelling(w.encode()) if w else END for w in b["word"].to_pylist()], np.int64)
        kinds += np.bincount(at, minlength=SYMBOLS)
        np.add.at(tokens, at, b["c"].to_numpy())
    at = np.flatnonzero(kinds)
    yield pa.RecordBatch.from_pydict({"symbol": pa.array(at), "kinds": pa.array(kinds[at]), "tokens": pa.array(tokens[at])})


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    release()
    m = shared.value
    none = len(m["base"]) - 1  # the row of the head's table for words outside
    for batch in batches:
        cols = {k: [] for k in ("n_tokens", "known", "base", "model", "rare")}
        for ranks, symbols in zip(batch["ranks"], batch["symbol"]):
            at = np.frombuffer(ranks.as_buffer(), "<i4")
            line, own = np.r_[CLASSES, m["by_rank"][at], CLASSES], np.minimum(at, none)
            cols["n_tokens"].append(len(at) + 1)
            cols["known"].append(int((own != none).sum()) + m["ends_known"])
            cols["base"].append(m["base"][own].sum() + m["base_end"])
            cols["model"].append(m["emit"][own].sum() + m["trans"][line[:-1], line[1:]].sum())
            cols["rare"].append(m["rare"][m["of"][symbols.values.to_numpy()]])
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        done = [pa.array(v, t) for v, t in zip(cols.values(), kinds)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *done[:4], batch["word"], batch["times"], done[4]], names=["doc_id", "held_out", "n_tokens", "known", "base", "model", "word", "times", "rare"])


def fit(rows: DataFrame) -> tuple[dict, DataFrame, DataFrame]:
    """The model that workers score by, the table of all words' counts, and the texts as ranks; rows: doc_id, text, held_out."""
    spark = rows.sparkSession
    train = rows.where("not held_out").select("text")
    counts, _ = stage(train.mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "words")
    total, types = counts.agg(F.sum("c"), F.count("*")).first()
    total, types = total or 0, types or 0

    # the head: the most frequent words; of the count at which it is full, a share chosen by hash
    levels = counts.where("word <> ''").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(HEAD).collect()  # a level has a word at least
    whole, part, share, room = 2**62, -1, 0, HEAD
    for r in levels:
        if r.n > room:
            part, share = r.c, room * 2**30 // r.n
            break
        whole, room = r.c, room - r.n
    chosen = (F.col("c") >= whole) | ((F.col("c") == part) & (F.pmod(F.xxhash64("word"), F.lit(2**30)) < share))
    frequent = counts.where("word <> ''").where(chosen).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    head, head_counts = [w.as_py().encode() for w in frequent["word"]], frequent["c"].to_numpy().astype(np.float64)
    clustered = head[:CLUSTERED]

    spelled = np.array([spelling(w) for w in head], np.int64)
    model = {"key": uuid.uuid4().hex, "head": b" ".join(head), "symbols": np.r_[np.arange(len(clustered)), spelled[len(clustered) :]]}
    looked = spark.sparkContext.broadcast(model)
    ranked, _ = stage(rows.mapInArrow(lambda b: _rank(b, looked), "doc_id long, held_out boolean, ranks binary, word array<string>, times array<long>, symbol array<long>"), "ranks")
    train = ranked.where("not held_out").select("ranks")  # from here on no text is read

    found = train.mapInArrow(lambda b: _count_pairs(b, looked), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros(SYMBOLS**2)
    pairs[found["pair"].to_numpy()] = found["c"].to_numpy()
    del found
    pairs = pairs.reshape(SYMBOLS, SYMBOLS)
    of = exchange(pairs)
    head_of = of[model["symbols"]]
    member = np.eye(CLASSES + 1)[of]
    grown = int((head_counts >= LEAST).sum())
    plain = {"of": of, "matrix": member.T @ pairs @ member, "grown": grown}
    del pairs
    first = spark.sparkContext.broadcast({**plain, "head_of": head_of, "by_rank": _by_rank(of, head_of)})
    if grown > CLUSTERED:
        contexts = train.mapInArrow(lambda b: _count_contexts(b, first), "word long, contexts binary")
        moved = contexts.repartition("word").sortWithinPartitions("word").mapInArrow(lambda b: _exchange_words(b, first), "word long, class long").toArrow()
        head_of = head_of.copy()
        head_of[moved["word"].to_numpy()] = moved["class"].to_numpy()
    model = {**model, "of": of, "head_of": head_of, "by_rank": _by_rank(of, head_of)}
    second = spark.sparkContext.broadcast({"by_rank": model["by_rank"]})
    found = train.mapInArrow(lambda b: _count_classes(b, second), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    pairs = np.zeros((CLASSES + 1) ** 2)
    pairs[found["pair"].to_numpy()] = found["c"].to_numpy()
    pairs = pairs.reshape(CLASSES + 1, CLASSES + 1)

    sizes = counts.mapInArrow(_count_spellings, "symbol long, kinds long, tokens long").groupBy("symbol").agg(F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).toArrow()
    sums = []
    for c, own in (("kinds", np.ones(len(head))), ("tokens", head_counts)):
        others = -np.bincount(spelled, own, SYMBOLS)  # the head's words have classes of their own
        others[sizes["symbol"].to_numpy()] += sizes[c].to_numpy()
        sums.append(np.bincount(np.r_[head_of, of], np.r_[own, others], CLASSES + 1))
    kinds, tokens = sums
    rare = np.log10(tokens + ADDED * (kinds + 1))  # what a class's emissions are divided by
    under = math.log10(total + types + 1)
    ends = float(tokens[CLASSES])
    return {
        **model, "total": total, "under": under, "trans": transitions(pairs, np.arange(CLASSES + 1)), "rare": rare,
        "base": np.r_[np.log10(head_counts + 1) - under, 0.0], "emit": np.r_[np.log10(head_counts + ADDED) - rare[head_of], 0.0], "base_end": math.log10(ends + 1) - under, "ends_known": int(ends > 0),
    }, counts, ranked


def score(docs: DataFrame, mod: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = text_of(docs, (remainder(mod) == held).alias("held_out"))
    model, counts, ranked = fit(rows)
    scoring = {k: v for k, v in model.items() if k not in ("head", "symbols")}
    shared, under = docs.sparkSession.sparkContext.broadcast(scoring), model["under"]
    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, model double, word array<string>, times array<long>, rare array<double>"
    scored, _ = stage(ranked.mapInArrow(lambda b: _score(b, shared), schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = scored.select("row", F.explode(F.arrays_zip("word", "times", "rare")).alias("t")).select("row", "t.*")
    tail = tail.join(counts, "word", "left").select("row", "times", "rare", F.coalesce("c", F.lit(0)).alias("c"))
    extra = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - F.lit(under))).alias("more_base"),
        F.sum(F.col("times") * (F.log10(F.col("c") + F.lit(ADDED)) - F.col("rare"))).alias("more_model"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("word", "times", "rare").join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(model["total"]).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("model") + zero("more_model")).alias("score"),
    )
