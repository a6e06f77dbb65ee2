"""Quality rules with robust outlier rejection, in DataFrame operations only.

Each text yields a few counts; a vector of transformed shares of them is compared
with the minimum-covariance-determinant estimate of its language and source
(Rousseeuw and Van Driessen, 1999). From several fixed starts of every group
(medians with median absolute deviations, means with covariances, medians with unit
scales) concentration steps take mean and covariance of the ``CORE`` share of nearest
rows, again and again; the start that ends with the least determinant stands, and
one reweighting follows. Every quantile comes from a histogram of fixed bins, so a
group of any size is summed before it is shuffled, and results do not depend on the
order of rows.

A group's estimate is that of its rows and ``PRIOR`` more of its language's moments,
which in turn hold ``PRIOR`` more of all rows' moments: few rows lean on their
language, many decide for themselves, and no size is a switch. A floor on each
variance keeps features that hardly vary from rejecting harmless texts, such as one
with its first line again at the end; yet each floor lets its feature alone exceed
the cut within its range.

Defined cases: a null or blank text has zero counts and fails the base rule; null
language or source are a group like any other; repeated rows count each; an empty
table gives no row.
"""

from __future__ import annotations

from math import log, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stage

SPACE = " \t\n\x0b\x0c\r"
FEATURES = ("size", "word_length", "symbols", "dup_lines", "repeats")
#: Least standard deviation of each feature.
FLOOR = (0.6, 0.3, 0.06, 0.17, 0.13)
CORE, STEPS, PRIOR, QUANTILE = 0.75, 4, 50.0, 0.9999
SALTS = 64
P = range(len(FEATURES))
PAIRS = [(i, j) for i in P for j in P if j <= i]
KEYS = ["lang", "source"]


def chi_square(p: int, q: float) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty, 1931)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * sqrt(2 / (9 * p))) ** 3


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    t = F.coalesce(F.col("text"), F.lit(""))
    core = F.btrim(t, F.lit(SPACE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).alias(c) for c in ("lang", "source")), t.alias("t"), F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, "[ \t-\r]+")).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    grams = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice("words", 1, F.size("words") - 2), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))))
    rows = rows.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), grams.alias("grams"))
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    ranked = F.when(again, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    rows = rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), ranked.alias("ranked"))
    same = lambda s, i: F.coalesce(s["g"] == F.get("ranked", i)["g"], F.lit(False))
    twice = F.filter("ranked", lambda s, i: same(s, i - 1) | same(s, i + 1))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2))))
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("ranked").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"))


def features(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    values = (F.log1p("n_words"), F.coalesce(F.try_divide(F.col("word_chars"), F.col("n_words")), F.lit(0.0)), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return stats.withColumns({f"x{i}": F.least(v, F.lit(50.0)) for i, v in enumerate(values)})


def _joined(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their group's lines of a table of a few lines a group, which is repeated so that a large group's rows spread over partitions."""
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(spread, [*KEYS, "salt"], how).drop("salt")


def _binned_quantile(rows: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys and the least bin at which the share q of the key's rows is reached; rows: keys, bin."""
    w = Window.partitionBy(*keys)
    counted = rows.groupBy(*keys, "bin").count()
    counted = counted.withColumns({"upto": F.sum("count").over(w.orderBy("bin")), "all": F.sum("count").over(w)})
    return counted.where(F.col("upto") >= F.lit(q) * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _medians(rows: DataFrame, value) -> DataFrame:
    """lang, source and one median a feature (m0, m1, ...), to a hundredth; value(i) is the feature's column."""
    long = rows.select("lang", "source", F.posexplode(F.array(*(F.floor(value(i) * 200).cast("long") for i in P))).alias("f", "bin"))
    medians = _binned_quantile(long, ["lang", "source", "f"], 0.5)
    return medians.groupBy("lang", "source").agg(*(F.max(F.when(F.col("f") == i, F.col("bin") / 200.0 + 0.0025)).alias(f"m{i}") for i in P))


def _distance_bin(d2: Column) -> Column:
    return F.floor(F.log1p(d2) * 64).cast("long")


SUMS = ["n", *(f"s{i}" for i in P), *(f"q{i}{j}" for i, j in PAIRS)]
PRODUCTS = ["1D", *(f"x{i}" for i in P), *(f"x{i} * x{j}" for i, j in PAIRS)]


def _concentrated(rows: DataFrame, found: DataFrame, keys: list[str], stretch: float) -> DataFrame:
    """Moments of each key's CORE share of rows nearest by found, to a whole bin of distances: sums by bin first, so rows are read once."""
    binned = _joined(rows, found).groupBy(*keys, _distance_bin(_mahalanobis()).alias("bin")).agg(*(F.expr(f"sum({x}) AS {c}") for c, x in zip(SUMS, PRODUCTS)))
    w = Window.partitionBy(*keys)
    core = binned.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)}).where(F.expr(f"upto - n < {CORE!r}D * all"))
    sums = core.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))
    means = sums.selectExpr(*keys, "n", *(f"s{i} / n AS m{i}" for i in P), *(f"q{i}{j} / n AS q{i}{j}" for i, j in PAIRS))
    return means.selectExpr(*keys, "n", *(f"m{i}" for i in P), *(f"(q{i}{j} - m{i} * m{j}) * {stretch!r}D AS c{i}{j}" for i, j in PAIRS))


def _moments(core: DataFrame, keys: list[str], stretch: float) -> DataFrame:
    """n, means m.. and covariances c.. of each key's rows; the covariances times stretch."""
    return core.groupBy(*keys).agg(F.expr("sum(1D) AS n"), *(F.expr(f"avg(x{i}) AS m{i}") for i in P), *(F.expr(f"covar_pop(x{i}, x{j}) * {stretch!r}D AS c{i}{j}") for i, j in PAIRS))


def _inverted(e: DataFrame, keys: list[str]) -> DataFrame:
    """m.., inverse covariances p.. and the logarithm of the determinant, floors added, by a Cholesky factor written out in columns; n and c.. stay.

    One statement of nested selections, as each depends on those before it.
    """
    rest = lambda i, j: f"c{i}{j}" + (f" + {FLOOR[i] ** 2!r}D" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
    steps = []
    for j in P:  # L, a column at a time
        steps.append([f"sqrt(greatest({rest(j, j)}, 1e-12D)) AS l{j}{j}"])
        steps.append([f"({rest(i, j)}) / l{j}{j} AS l{i}{j}" for i in P if i > j])
    steps.append([f"1 / l{j}{j} AS v{j}{j}" for j in P])  # the inverse of L, a diagonal at a time
    for gap in P[1:]:
        steps.append([f"-({' + '.join(f'l{j + gap}{k} * v{k}{j}' for k in range(j, j + gap))}) / l{j + gap}{j + gap} AS v{j + gap}{j}" for j in P if j + gap < len(P)])
    text = "SELECT * FROM {e}"
    for step in filter(None, steps):
        text = f"SELECT *, {', '.join(step)} FROM ({text})"
    inverse = [" + ".join(f"v{k}{i} * v{k}{j}" for k in range(i, len(P))) + f" AS p{i}{j}" for i, j in PAIRS]
    columns = [*keys, "n", *(f"m{i}" for i in P), *(f"c{i}{j}" for i, j in PAIRS), *inverse, " + ".join(f"2 * ln(l{i}{i})" for i in P) + " AS logdet"]
    return e.sparkSession.sql(f"SELECT {', '.join(columns)} FROM ({text})", e=e)


def shrunk(found: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimate of every group: its own moments (if found has any), PRIOR rows of its language's, and in those PRIOR of all rows'."""
    sums = found.selectExpr(*KEYS, "n", *(f"n * m{i} AS s{i}" for i in P), *(f"n * (c{i}{j} + m{i} * m{j}) AS q{i}{j}" for i, j in PAIRS))
    langs = sums.groupBy("lang").agg(*(F.sum(c).alias(f"{c}_lang") for c in SUMS))
    every = langs.agg(*(F.sum(f"{c}_lang").alias(c) for c in SUMS)).first()  # one row
    mean = {c: every[c] / every["n"] if every["n"] else 0.0 for c in SUMS[1:]}
    out = groups.join(sums, KEYS, "left").join(langs, "lang", "left").na.fill(0.0)
    out = out.selectExpr(*KEYS, "n", *(f"({c} + {PRIOR!r}D * ({c}_lang + {PRIOR!r}D * {mean[c]!r}D) / (n_lang + {PRIOR!r}D)) / (n + {PRIOR!r}D) AS {c}" for c in SUMS[1:]))
    out = out.selectExpr(*KEYS, "n", *(f"s{i} AS m{i}" for i in P), *(f"q{i}{j} - s{i} * s{j} AS c{i}{j}" for i, j in PAIRS))
    out, _ = stage(out, "moments")  # else moments that turn out empty would be folded into every factor below
    return _inverted(out, KEYS)


def _mahalanobis() -> Column:
    return F.expr(" + ".join(f"p{i}{j} * (x{i} - m{i}) * (x{j} - m{j}) * {1 if i == j else 2}" for i, j in PAIRS))


def starts(rows: DataFrame) -> DataFrame:
    """Three lines a group (start 0, 1, 2), each with means m.. and inverse covariances p.. to begin from."""
    middle, _ = stage(_medians(rows, lambda i: F.col(f"x{i}")), "medians")
    spread = _medians(_joined(rows, middle), lambda i: F.abs(F.col(f"x{i}") - F.col(f"m{i}")))
    spread = spread.select(*KEYS, *(F.col(f"m{i}").alias(f"s{i}") for i in P))
    scale, _ = stage(middle.join(spread, KEYS), "scales")

    def diagonal(number: int, width) -> DataFrame:
        p = ((1 / width(i) ** 2 if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in PAIRS)
        return scale.select(*KEYS, F.lit(number).alias("start"), *(f"m{i}" for i in P), *p)

    plain = _inverted(_moments(rows, KEYS, 1.0), KEYS).select(*KEYS, F.lit(1).alias("start"), *(f"m{i}" for i in P), *(f"p{i}{j}" for i, j in PAIRS))
    return stage(diagonal(0, lambda i: 1.4826 * F.col(f"s{i}") + FLOOR[i]).unionByName(plain).unionByName(diagonal(2, lambda i: F.lit(FLOOR[i]))), "starts")[0]


def estimates(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant estimate of every language and source."""
    xs, keys = [f"x{i}" for i in P], [*KEYS, "start"]
    rows = rows.select(*KEYS, *xs)
    groups, _ = stage(rows.select(*KEYS).distinct(), "groups")
    found = starts(rows)
    # over the nearest CORE share of a normal sample variances shrink by this factor
    narrowed = 1 / (1 + log(1 / (1 - CORE)) / len(P)) if CORE < 1 else 1.0
    for _ in range(STEPS):
        found, _ = stage(_inverted(_concentrated(rows, found, keys, 1 / narrowed), keys), "estimates")
    best = found.groupBy(*KEYS).agg(F.min_by(F.struct("n", *(f"m{i}" for i in P), *(f"c{i}{j}" for i, j in PAIRS)), F.struct(F.round("logdet", 6), "start")).alias("e")).select(*KEYS, "e.*")
    near, _ = stage(shrunk(best, groups), "estimates")
    core = _joined(rows, near).where(_mahalanobis() <= chi_square(len(P), 0.975)).select(*KEYS, *xs)
    return stage(shrunk(stage(_moments(core, KEYS, 1.0), "moments")[0], groups), "models")[0]


def judge(docs: DataFrame) -> DataFrame:
    """The counts of each document, base_failed, distance2 and kept."""
    stats, _ = stage(features(statistics(docs)), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = _joined(stats, estimates(stats).select(*KEYS, *(f"m{i}" for i in P), *(f"p{i}{j}" for i, j in PAIRS)), how="left").withColumn("distance2", _mahalanobis())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.coalesce("distance2", F.lit(0.0)) <= chi_square(len(P), QUANTILE))).alias("kept"), "distance2")
