"""Operators over time-ordered rows: sessions, nearest in time, sequence fill, consensus.

A timeline without a natural key would be one window in one task. Here windows run
per day, or per span of the tolerance, and only a table with a row a day carries
what one day needs of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import floor_days, is_default, low_confidence, to_ts
from ..functions.geo import haversine_km


def _stays(p: Column, home_code: str, day_limits: tuple[int, int], km: float) -> Column:
    """Whether a row belongs with the one before it, a struct p of ts, country, lat and lon."""
    near, far = day_limits
    g = F.abs(floor_days(F.col("ts_"), p["ts_"]))
    named = lambda c: c.isNotNull() & (c != "")
    countries = named(F.col("country")) & named(p["country"])
    same_country = F.col("country") == p["country"]
    placed = lambda lat: lat.isNotNull() & (lat != 0)
    close = F.coalesce(haversine_km(p["lat"], p["lon"], F.col("lat"), F.col("lon")) < km, F.lit(False))
    abroad = countries & same_country & F.coalesce(F.col("cc") != home_code, F.lit(False))
    same = F.when(g <= near, F.when(countries, same_country).when(placed(F.col("lat")) & placed(p["lat"]), close).otherwise(g <= 1)).when(g <= far, abroad).otherwise(False)
    return F.coalesce(same, F.lit(False))


def sessionize(rows: DataFrame, keys: list[str] = (), ts: str = "ts", order: str = "id", home_code: str = "GB", least: int = 3, day_limits: tuple[int, int] = (2, 5), km: float = 150.0) -> DataFrame:
    """Event clusters of a timeline: rows with `cluster`, a number within keys, and `members`.

    A row stays with the one before it if, with g whole days between them: g <= 2
    and the countries agree, or without two countries the places are within km, or
    without two places g <= 1; or 2 < g <= 5 and both are in one country abroad.
    Clusters of fewer than ``least`` rows go.

    Rows are compared within their day; a day's first row is compared with the last
    row of the day before it, and a day's clusters are numbered after those of the
    days before, both from a table of days.
    """
    keys = list(keys)
    rows = rows.where(F.col(ts).isNotNull()).withColumns({"ts_": F.col(ts), "day_": F.to_date(ts)})
    state = F.struct("ts_", "country", "lat", "lon")
    in_day = Window.partitionBy(*keys, "day_").orderBy(ts, order)
    over_days = Window.partitionBy(*keys).orderBy("day_")
    last = rows.groupBy(*keys, "day_").agg(F.max_by(state, F.struct(ts, order)).alias("last_"))
    last = last.select(*keys, "day_", F.lag("last_").over(over_days).alias("carried_"))
    met = rows.withColumn("before_", F.lag(state).over(in_day)).join(last, [*keys, "day_"]).withColumn("p_", F.coalesce("before_", "carried_"))
    met = met.withColumn("starts_", F.when(_stays(F.col("p_"), home_code, day_limits, km), 0).otherwise(1))
    upto = over_days.rowsBetween(Window.unboundedPreceding, -1)
    numbers = met.groupBy(*keys, "day_").agg(F.sum("starts_").alias("n_")).select(*keys, "day_", F.coalesce(F.sum("n_").over(upto), F.lit(0)).alias("earlier_"))
    counted = met.withColumn("within_", F.sum("starts_").over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
    out = counted.join(numbers, [*keys, "day_"]).withColumn("cluster", F.col("earlier_") + F.col("within_"))
    out = out.withColumn("members", F.count("*").over(Window.partitionBy(*keys, "cluster"))).where(F.col("members") >= least)
    return out.drop("ts_", "day_", "before_", "carried_", "p_", "starts_", "earlier_", "within_")


def nearest_in_time(queries: DataFrame, refs: DataFrame, ts: str, order: str, carry: list[str], max_hours: int = 24) -> DataFrame:
    """Each query with the nearest reference within max_hours before it or at or after it; a tie goes to the earlier.

    Distinct times are met, not rows: a time of references has its first and its last
    by order, references at a query's own time come after it. Windows run per cell of
    time, a 1440th of max_hours, and only look back, as a frame up to the end would be
    summed anew for every row. What a cell needs of those beside it comes from a table
    with a row a cell, in spans of max_hours; a cell with references stands in its own
    span and the two beside it. Columns: the query's, `ref_<c>` for c in carry, `seconds`.
    """
    reach, cells = max_hours * 3_600_000_000, 1440
    t = F.unix_micros(F.col(ts).cast("timestamp")).alias("t_")
    r = refs.select(t, F.struct(order).alias("o_"), F.struct(*carry).alias("ref_")).where("t_ IS NOT NULL")
    r = r.groupBy("t_").agg(F.min_by("ref_", "o_").alias("lo_"), F.max_by("ref_", "o_").alias("hi_"))
    asked = queries.select(t).where("t_ IS NOT NULL").distinct()
    times = asked.withColumn("side_", F.lit(0)).unionByName(r.withColumn("side_", F.lit(1)), allowMissingColumns=True).withColumn("cell_", F.floor(F.col("t_") / (reach // cells)))
    is_ref = F.col("side_") == 1
    before = lambda x, *by: F.last(x, ignorenulls=True).over(by[0].orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1))
    lo, hi = (F.struct("t_", F.col(c).alias("ref")) for c in ("lo_", "hi_"))
    own = Window.partitionBy("cell_")
    near = times.withColumns({"b_": before(F.when(is_ref, hi), own, "t_", "side_"), "a_": before(F.when(is_ref, lo), own, F.desc("t_"), F.desc("side_"))}).where(~is_ref)
    # the last reference of the cells before a cell, the first of those after it
    table = times.groupBy("cell_").agg(F.min_by(lo, F.when(is_ref, F.col("t_"))).alias("first_"), F.max_by(hi, F.when(is_ref, F.col("t_"))).alias("last_")).withColumn("span_", F.floor(F.col("cell_") / cells))
    beside = table.where("last_ IS NOT NULL").withColumn("span_", F.explode(F.array(F.col("span_") - 1, F.col("span_") + 1)))
    span = Window.partitionBy("span_")
    table = table.withColumn("own_", F.lit(True)).unionByName(beside.withColumn("own_", F.lit(False)))
    table = table.withColumns({"back_": before(F.col("last_"), span, "cell_"), "ahead_": before(F.col("first_"), span, F.desc("cell_"))}).where("own_").select("cell_", "back_", "ahead_")
    near = near.join(table, "cell_").select("t_", F.coalesce("b_", "back_").alias("b_"), F.coalesce("a_", "ahead_").alias("a_"))
    back, ahead = F.col("t_") - F.col("b_.t_"), F.col("a_.t_") - F.col("t_")
    pick = F.when(F.col("b_").isNull(), F.col("a_")).when(F.col("a_").isNull() | (back <= ahead), F.col("b_")).otherwise(F.col("a_"))
    near = near.withColumn("pick_", pick).select("t_", "pick_.ref", (F.abs(F.col("pick_.t_") - F.col("t_")) / 1e6).alias("seconds_")).where(F.col("seconds_") <= max_hours * 3600)
    # a query without a time has no nearest
    out = queries.select(t, F.struct(*queries.columns).alias("row")).join(near, "t_", "left")
    return out.select("row.*", *(F.col(f"ref.{c}").alias(f"ref_{c}") for c in carry), F.col("seconds_").alias("seconds"))


def fill_from_sequence(rows: DataFrame, keys: list[str], number: str, name: str, date: str, most: int = 50, days: int = 7) -> DataFrame:
    """Dates for rows of a numbered sequence from their neighbours with trustworthy dates: `filled` where one is found.

    With neighbours on both sides the nearer must be within ``most`` numbers and the
    two dates within ``days``; the earlier neighbour's date is taken. With one, it
    must be within ``most``. A key needs two rows and two trustworthy ones.
    """
    n = F.col(number)
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(number, name)
    rows = rows.where(n.isNotNull()).withColumn("ts_", to_ts(F.col(date))).withColumn("good_", ~low_confidence(F.col("ts_")))
    ref = F.when(F.col("good_"), F.struct(n.alias("n"), F.col(date).alias("d"), F.col("ts_").alias("t")))
    earlier = lambda over: F.last(ref, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"at_": F.row_number().over(w), "b_": earlier(w)})
    # looked for in descending order: a frame up to the end would be summed anew for every row
    rows = rows.withColumns({"rows_": F.count("*").over(whole), "goods_": F.sum(F.col("good_").cast("int")).over(whole), "a_": earlier(whole.orderBy(F.desc("at_")))})
    back, ahead = n - F.col("b_.n"), F.col("a_.n") - n
    agree = F.abs(floor_days(F.col("a_.t"), F.col("b_.t"))) <= days
    both = F.col("b_").isNotNull() & F.col("a_").isNotNull()
    filled = F.when(both, F.when((F.least(back, ahead) <= most) & agree, F.col("b_.d"))).when(F.col("b_").isNotNull(), F.when(back <= most, F.col("b_.d"))).otherwise(F.when(ahead <= most, F.col("a_.d")))
    usable = ~F.col("good_") & (F.col("rows_") >= 2) & (F.col("goods_") >= 2)
    return rows.withColumn("filled", F.when(usable, filled)).drop("ts_", "good_", "at_", "rows_", "goods_", "b_", "a_")


def consensus_month(rows: DataFrame, keys: list[str], date: str, share: float = 0.7, least: int = 3) -> DataFrame:
    """Dates for rows with bad ones in directories of which one month holds ``share`` of the trustworthy: `filled`.

    The old day of month is kept where it parses and is 2 to 28, else 15; the time is noon.
    """
    rows = rows.withColumn("ts_", to_ts(F.col(date))).withColumn("good_", ~low_confidence(F.col("ts_")))
    months = rows.groupBy(*keys, F.when(F.col("good_"), F.substring(date, 1, 7)).alias("month_")).agg(F.count("*").alias("n_"))
    whole = Window.partitionBy(*keys)
    goods = F.sum(F.when(F.col("month_").isNotNull(), F.col("n_"))).over(whole)
    top = months.withColumns({"all_": F.sum("n_").over(whole), "goods_": goods}).where(F.col("month_").isNotNull() & (F.col("all_") >= least) & (F.col("n_") / F.col("goods_") >= share))
    out = rows.join(top.select(*keys, "month_"), keys, "left")
    day = F.dayofmonth("ts_")
    filled = F.concat(F.col("month_"), F.lit("-"), F.lpad(F.when(day.between(2, 28), day).otherwise(15).cast("string"), 2, "0"), F.lit("T12:00:00"))
    return out.withColumn("filled", F.when(~F.col("good_") & F.col("month_").isNotNull(), filled)).drop("ts_", "good_", "month_")


def neighbour_median(rows: DataFrame, keys: list[str], number: str, date: str, k: int = 20, order: str = "id") -> DataFrame:
    """For rows with bad dates, the upper median of the dates of the k nearest good ones by number in their directory.

    A self-join within a directory would hold all pairs of a large one. Good rows are
    ranked instead: the k nearest by number are among the k ranked before a bad row
    and the k after it, which lie in its cell of k ranks and the two beside it. A cell is
    one row, an array of its good rows, with the bad ones in parts, so each row is dealt
    once, by directory, and a bad row's candidates are written nowhere.
    """
    most = 1024
    good = ~is_default(F.col(date))
    w = Window.partitionBy(*keys).orderBy(number, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    marked = rows.withColumn("good_", good).withColumn("rank_", F.count(F.when(F.col("good_"), 1)).over(w)).withColumn("nth_", F.row_number().over(w) - F.col("rank_"))
    ref = F.struct(F.col("rank_").alias("r"), F.col(number).alias("n"), F.col(order).alias("o"), F.col(date).alias("d"))
    bad = F.struct(F.col("rank_").alias("r"), F.struct(*(F.col(c) for c in rows.columns if c not in keys)).alias("row"))
    part = F.when(F.col("good_"), 0).otherwise(F.floor(F.col("nth_") / most))
    cells = marked.withColumns({"cell_": F.floor(F.col("rank_") / k), "part_": part}).groupBy(*keys, "cell_", "part_")
    cells = cells.agg(F.collect_list(F.when(F.col("good_"), ref)).alias("refs_"), F.collect_list(F.when(~F.col("good_"), bad)).alias("bads_"))
    beside = Window.partitionBy(*keys).orderBy("cell_").rangeBetween(-1, 1)
    cells = cells.withColumn("refs_", F.sort_array(F.flatten(F.collect_list("refs_").over(beside)))).where("size(bads_) > 0 AND size(refs_) > 0")
    out = cells.select(*keys, "refs_", F.explode("bads_").alias("b_"))
    # candidates of a bad row are the good ones ranked rank - k + 1 .. rank + k, of which there is one where any row is good
    first, r = F.get("refs_", 0)["r"], F.col("b_.r")
    start = F.greatest(r - k + 1, first)
    met = F.slice("refs_", (start - first + 1).cast("int"), (r + k - start + 1).cast("int"))
    gaps = F.transform(met, lambda g: F.struct(F.abs(g["n"] - F.col(f"b_.row.{number}")).alias("gap"), g["o"].alias("o"), g["d"].alias("d")))
    dates = F.sort_array(F.transform(F.slice(F.sort_array(gaps), 1, k), lambda x: x["d"]))
    out = out.select(*(F.col(c) if c in keys else F.col(f"b_.row.{c}").alias(c) for c in rows.columns), dates.alias("dates_"))
    return out.select(*rows.columns, F.get("dates_", F.floor(F.size("dates_") / 2).cast("int")).alias("filled"))


def control_break(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows with `starts`: the value differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("starts", ~F.coalesce(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), F.lit(False)))
