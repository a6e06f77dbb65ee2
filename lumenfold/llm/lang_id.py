"""Language identification in two steps: the family, then the language within it.

Texts are vectors of hashed counts of their byte pairs and triples (letters folded
by the code points' own bytes, all else one blank), damped by square roots and of
unit length. One-versus-rest linear support vector machines choose among
families; within a family one-versus-one machines vote, so closely related
languages are told apart by what differs between the two.

The machines are fitted on the driver on ``SAMPLE`` learning rows at most, shared
evenly by the languages (the rows with the least hashes of their text); that bound
does not depend on the corpus, and every row is predicted.

Defined cases: a text that is null or has no letter (Unicode categories L; numerals
such as a superscript two or a Roman one are none) is ``und`` with score 0;
without any learning row every text is ``und``; with one language in the learning
rows it is the answer for all; a null doc_id belongs to no part (held_out null)
and is not learned from; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, remainder, stage
from .svm import fit

SAMPLE, BUCKETS = 5000, 4096

#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "indo-aryan": "hi ur bn mr gu pa ne",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "celtic": "ga cy br gd",
    "sinitic": "zh",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def vectors(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, text in enumerate(texts):
        c = _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        pair = c[:-1] * np.uint32(257) + c[1:]
        both = np.concatenate([pair * np.uint32(2654435761), (pair[:-1] * np.uint32(263) + c[2:]) * np.uint32(2246822519)]) >> np.uint32(20)
        counts = np.bincount(both, minlength=BUCKETS)
        row = np.sqrt(counts)
        out[k] = row / max(np.sqrt((row * row).sum()), 1e-9)
    return out


def train(x: np.ndarray, langs: list[str]) -> dict:
    """Families and languages in order, and the weights of all machines."""
    langs = np.array(langs)
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        groups.setdefault(family_of(lang), []).append(lang)
    names = sorted(groups)
    families = np.array([family_of(v) for v in langs])
    sign = lambda mask: np.where(mask, 1.0, -1.0)
    first = np.stack([fit(x, sign(families == f)) for f in names]) if len(names) > 1 else None
    pairs = {}
    for f in names:
        for i, a in enumerate(groups[f]):
            for b in groups[f][i + 1 :]:
                of = (langs == a) | (langs == b)
                pairs[a, b] = fit(x[of], sign(langs[of] == a))
    return {"families": names, "groups": groups, "first": first, "pairs": pairs}


def predict(model: dict, texts: list[str]) -> tuple[list[str], list[float]]:
    squash = lambda v: 1 / (1 + np.exp(-4 * v))
    x = np.c_[vectors(texts), np.ones(len(texts), np.float32)]
    langs, scores = np.empty(len(texts), object), np.zeros(len(texts))
    if model["first"] is None:
        family, sure = np.zeros(len(texts), np.int64), np.ones(len(texts))
    else:
        margins = x @ model["first"].T
        family = margins.argmax(axis=1)
        sure = squash(margins.max(axis=1))
    for k, name in enumerate(model["families"]):
        own = np.flatnonzero(family == k)
        members = model["groups"][name]
        won = np.zeros((len(own), len(members)))
        for i, a in enumerate(members):
            for j in range(i + 1, len(members)):
                p = squash(x[own] @ model["pairs"][a, members[j]])
                won[:, i] += p
                won[:, j] += 1 - p
        best = won.argmax(axis=1) if len(members) > 1 else np.zeros(len(own), np.int64)
        langs[own] = np.array(members, object)[best]
        scores[own] = sure[own] * (won.max(axis=1) / (len(members) - 1) if len(members) > 1 else 1.0)
    return langs.tolist(), scores.tolist()


def _identify(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts = [t or "" for t in part["text"].to_pylist()]
            lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if model else []
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if lettered:
                for i, lang, score in zip(lettered, *predict(model, [texts[i] for i in lettered])):
                    langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def _vectorize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = vectors(batch["text"].to_pylist()).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch["lang"], batch["h"], pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "h", "x"])


def learning_sample(docs: DataFrame, mod: int = 4, held: int = 2) -> pd.DataFrame:
    """lang and vector of the sample: for each language the rows with the least text hashes, SAMPLE in all, one a language at least.

    Rows are thinned by the hash first, so a language's window holds few rows however many it has.
    """
    rows = docs.where((remainder(mod) != held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    sizes, _ = stage(rows.groupBy("lang").agg(F.count_distinct("h").alias("n")), "languages")
    langs = sizes.count()
    limit = max(1, SAMPLE // max(1, langs))
    sizes = F.broadcast(sizes) if langs <= 10_000 else sizes  # else a join by language
    # of a language's n different texts about 3 limits stay, or all of fewer
    near = rows.select("lang", "h").join(sizes, "lang").where(F.pmod("h", F.greatest(F.lit(1), F.floor(F.col("n") / (3 * limit)))) == 0).select("lang", "h").distinct()
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= limit).select("lang", "h")
    ranked = F.broadcast(ranked) if langs <= SAMPLE else ranked  # SAMPLE rows at most
    chosen = rows.join(ranked, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return chosen.mapInArrow(_vectorize, "lang string, h long, x binary").orderBy("lang", "h").toArrow().to_pandas()


def identify(docs: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    prepare(spark)
    sample = learning_sample(docs, mod, held)
    shared = spark.sparkContext.broadcast(train(np.stack([np.frombuffer(x, np.float16) for x in sample.x]).astype(np.float32), sample.lang.tolist()) if len(sample) else None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(mod) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _identify(b, shared), "doc_id long, held_out boolean, lang_pred string, score double")
