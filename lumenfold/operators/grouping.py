"""Duplicates and canonical rows, votes, modes, profiles, samples and ranks within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import coverage_confidence


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, with their count and least id."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def canonical(rows: DataFrame, keys: list[str], penalty: Column) -> DataFrame:
    """Rows of groups of several with `canonical_id` (lowest penalty, then lowest id) and `is_canonical`.

    The choice is an aggregate joined back, not a window, so a hot key is summed before the shuffle.
    """
    best = rows.withColumn("pen_", penalty).groupBy(*keys).agg(F.count("*").alias("n_"), F.min(F.struct("pen_", "id")).alias("b_")).where("n_ > 1")
    return rows.join(best, keys).withColumn("canonical_id", F.col("b_.id")).withColumn("is_canonical", F.col("id") == F.col("b_.id")).drop("n_", "b_")


def mode_first(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one met first in order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_"), F.min(F.struct(*order)).alias("first_"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n_")).alias("n"), "first_")).alias(value))


def album_votes(rows: DataFrame, album: str = "album_id", order: str = "id") -> DataFrame:
    """Albums of which at least half the rows have a place: share, medians, first named country and city, confidence."""
    placed = F.col("lat").isNotNull()
    named = lambda c: F.min_by(c, F.when(placed & F.col(c).isNotNull() & (F.col(c) != ""), F.col(order)))
    votes = rows.where(F.col(album).isNotNull()).groupBy(album).agg(
        F.count("*").alias("n"), F.count("lat").alias("n_placed"), F.median("lat").alias("lat"), F.median(F.when(placed, F.col("lon"))).alias("lon"), named("country").alias("country"), named("city").alias("city"),
    )
    share = F.try_divide(F.col("n_placed"), F.col("n"))
    return votes.withColumn("confidence", coverage_confidence(share)).where(F.col("confidence").isNotNull())


def profile(rows: DataFrame, keys: list[str], ts: str, order: list[str]) -> DataFrame:
    """Counts, dates, days, countries and the prevailing country and city of each group."""
    from ..functions.dates import floor_days

    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.array_sort(F.collect_set(F.nullif(F.col("country"), F.lit("")))).alias("countries"), F.count_distinct(F.nullif(F.col("city"), F.lit(""))).alias("n_cities"),
    ).withColumn("days", floor_days(F.col("last_ts"), F.col("first_ts")))
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("what_"), F.nullif(F.col(c), F.lit("")).alias("value_")) for c in ("country", "city"))))
    modes = mode_first(rows.select(*keys, *order, pairs), [*keys, "what_"], "value_", order)
    modes = modes.groupBy(*keys).agg(*(F.max(F.when(F.col("what_") == c, F.col("value_"))).alias(c) for c in ("country", "city")))
    return base.join(modes, keys, "left")


def album_name(home: str = "United Kingdom", code: str | None = None) -> Column:
    """The name of a profiled cluster: where, when, and how long."""
    away = ~F.coalesce(F.col("country") == home, F.lit(False))
    several = F.size("countries").between(2, 3)
    place = (
        F.when(several, F.array_join("countries", " & "))
        .when(F.col("country").isNotNull() & away, F.when(F.col("city").isNotNull() & (F.col("n_cities") <= 3), F.col("city")).otherwise(F.col("country")))
        .otherwise(F.coalesce("city", F.date_format("first_ts", "MMMM")))
    )
    days = F.when((F.col("days") > 7) & away, F.concat(F.lit(" ("), F.col("days").cast("bigint").cast("string"), F.lit(" days)"))).otherwise("")
    return F.concat(place, F.lit(" "), F.date_format("first_ts", "yyyy"), days)


def top_terms(rows: DataFrame, keys: list[str], term: str, k: int = 5) -> DataFrame:
    """The k most frequent terms of each group as one list; ties alphabetical."""
    counts = rows.groupBy(*keys, term).agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n_"), term)
    ranked = counts.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", term))), lambda x: x[term]).alias("top"))


def _numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return rows.withColumns({"r_": F.row_number().over(w.orderBy(*order)) - 1, "n_": F.count("*").over(w)})


def segment_best(rows: DataFrame, keys: list[str], order: list[Column], score: str, segments: int = 9, least: int = 3) -> DataFrame:
    """Each group's ordered rows cut into equal segments; the best of each, with `rank` in order."""
    r, n = F.col("r_"), F.col("n_")
    m = F.least(n, F.lit(segments))
    cut = _numbered(rows, keys, order).where(n >= least).withColumn("seg_", F.floor(((r + 1) * m + n - 1) / n) - 1)
    best = cut.withColumn("k_", F.row_number().over(Window.partitionBy(*keys, "seg_").orderBy(F.desc(score), "r_"))).where("k_ = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("r_")).cast("bigint")).drop("r_", "n_", "seg_", "k_")


def systematic_sample(rows: DataFrame, keys: list[str], order: list[Column], size: int = 150) -> DataFrame:
    """At most size rows a group, evenly spaced: those at int(i * n / size)."""
    r, n, step = F.col("r_"), F.col("n_"), F.col("n_") / F.lit(float(size))
    i = F.ceil(r / step)
    taken = lambda k: (k < size) & (F.floor(k * step) == r)
    return _numbered(rows, keys, order).where((n <= size) | taken(i) | taken(i - 1) | taken(i + 1)).drop("r_", "n_")


def top_fraction(rows: DataFrame, keys: list[str], order: list[Column], share: float = 0.3, least: int = 18) -> DataFrame:
    return _numbered(rows, keys, order).where(F.col("r_") < F.greatest(F.lit(least), F.floor(F.col("n_") * share))).drop("r_", "n_")


def chunks(rows: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Rows with `chunk`, a number from 0 for every size rows of a group."""
    return _numbered(rows, keys, order).withColumn("chunk", F.floor(F.col("r_") / size)).drop("r_", "n_")


def unique_names(rows: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """`unique_name`: the k-th row of equal names within keys gets `_k` before its extension.

    A suffixed name that another row has by nature is passed over for the next free number.
    """
    w = Window.partitionBy(*keys, name).orderBy(*order)
    rows = rows.withColumn("k_", F.row_number().over(w) - 1)
    base, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    # names of the shape x_n take the number n from the suffixes of x
    natural = rows.select(*keys, F.concat(F.regexp_replace(base, r"_\d+$", ""), ext).alias("of_"), F.regexp_extract(base, r"_(\d+)$", 1).try_cast("bigint").alias("no_")).where("no_ > 0")
    natural = natural.groupBy(*keys, "of_").agg(F.array_sort(F.collect_set("no_")).alias("taken_"))
    out = rows.join(natural.withColumnRenamed("of_", name), [*keys, name], "left")
    free = F.aggregate(F.coalesce("taken_", F.array().cast("array<bigint>")), F.col("k_").cast("bigint"), lambda k, t: k + F.when(t <= k, 1).otherwise(0))
    return out.withColumn("unique_name", F.when(F.col("k_") == 0, F.col(name)).otherwise(F.concat(base, F.lit("_"), free.cast("string"), ext))).drop("k_", "taken_")


def dated_names(rows: DataFrame, name: str, ts: str, order: list[str]) -> DataFrame:
    """`unique_name`: of clusters with one name all but the first get their date; still equal ones stay together."""
    first = F.row_number().over(Window.partitionBy(name).orderBy(*order)) == 1
    return rows.withColumn("unique_name", F.when(first, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.date_format(ts, "yyyy-MM-dd"), F.lit(")"))))


def renamed(rows: DataFrame, name: str, year: str, order: list[str]) -> DataFrame:
    """`unique_name`: the second row of a name gets ` (year)`, further rows of that year ` (year-2)`, ` (year-3)`, ..."""
    rows = rows.withColumn("k_", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
    again = F.sum(F.when(F.col("k_") > 1, 1).otherwise(0)).over(Window.partitionBy(name, year).orderBy(*order))
    tag = F.when(again == 1, F.col(year).cast("string")).otherwise(F.concat(F.col(year).cast("string"), F.lit("-"), again.cast("string")))
    return rows.withColumn("unique_name", F.when(F.col("k_") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), tag, F.lit(")")))).drop("k_")


def album_context(rows: DataFrame, keys: list[str], ts: str, order: list[str], home: str = "United Kingdom") -> DataFrame:
    """What a name for an album is made from: profile, month, year, the five commonest tags, the three commonest scenes, and whether it was abroad.

    rows: tags (array), scene and activity beside the profile's columns; scenes and activities other than `none` count together.
    """
    from ..functions.fixed import HOLIDAY_COUNTRIES

    base = profile(rows, keys, ts, order)
    tags = top_terms(rows.select(*keys, F.explode("tags").alias("tag")).where("tag <> ''"), keys, "tag", 5)
    seen = rows.select(*keys, F.explode(F.array("scene", "activity")).alias("seen")).where("seen IS NOT NULL AND seen NOT IN ('', 'none')")
    out = base.join(tags.withColumnRenamed("top", "tags"), keys, "left").join(top_terms(seen, keys, "seen", 3).withColumnRenamed("top", "scenes"), keys, "left")
    kind = F.when(F.col("country").isin(HOLIDAY_COUNTRIES), "abroad").when(F.coalesce(F.col("country") == home, F.lit(False)) & (F.col("days") >= 2), "domestic").otherwise("local")
    return out.withColumns({"year": F.year("first_ts"), "month": F.date_format("first_ts", "MMMM"), "kind": kind})


def album_type(home: str = "United Kingdom") -> Column:
    """`holiday` or `event`, over a group's rows (an aggregate)."""
    from ..functions.fixed import HOLIDAY_SCENES

    scenic = F.coalesce(F.bool_or(F.col("scene").isin(HOLIDAY_SCENES)), F.lit(False))
    return F.when(scenic | F.coalesce(F.first(F.col("primary_country"), ignorenulls=True) != home, F.lit(False)), "holiday").otherwise("event")


def collage_rows(rows: DataFrame, keys: list[str], score: str, order: str, least: int = 6, cells: int = 6) -> DataFrame:
    """The best rows of groups that have enough of them, with `cell`, their place from 0."""
    ranked = _numbered(rows, keys, [F.desc(score), F.col(order)])
    return ranked.where((F.col("n_") >= least) & (F.col("r_") < cells)).withColumnRenamed("r_", "cell").drop("n_")


def eta(counters: DataFrame, order: str, seconds_each: float, last: int = 20) -> DataFrame:
    """done, total, rows a line and seconds left, from the last lines of a progress log (a log's tail, at most `last` rows)."""
    tail = counters.orderBy(F.desc(order)).limit(last)
    ends = tail.agg(F.max_by("done", order).alias("done"), F.max_by("total", order).alias("total"), F.min_by("done", order).alias("begin"), F.count("*").alias("lines"))
    rate = F.try_divide(F.col("done") - F.col("begin"), F.col("lines") - 1)
    return ends.select("done", "total", rate.alias("rows_a_line"), ((F.col("total") - F.col("done")) * seconds_each).alias("seconds_left"))
