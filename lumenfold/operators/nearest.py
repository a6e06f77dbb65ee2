"""Similarity and distance joins by cells and runs of characters; of bit words all pairs, a pair of parts a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.geo import haversine_km, planar_degrees
from ..shipping import ship

KM_PER_DEGREE = 111.0
PARTS = 8


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def reverse_geocode(points: DataFrame, places: DataFrame, radius_km: float = 50.0, close_km: float = 1.0, cell: float = 0.5) -> DataFrame:
    """Each distinct (lat, lon) of points with its place (all columns of places but its coordinates), or nulls.

    The most populous place under close_km, else the nearest under radius_km; ties
    by `ord`, the places' rank by population. Places are spread to every cell a
    point near them may be in; the span in longitude widens with latitude and wraps
    at 180 degrees. Distinct coordinates are looked up once.
    """
    rows = int(360 / cell)
    reach = int(-(-radius_km / KM_PER_DEGREE // cell))
    spread = F.least(F.ceil(radius_km / KM_PER_DEGREE / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("lat")) + reach * cell, F.lit(89.9)))), F.lit(1e-3)) / cell), F.lit(rows // 2)).cast("int")
    around = places.withColumn("y_", F.explode(F.sequence(_cell(F.col("lat"), cell) - reach, _cell(F.col("lat"), cell) + reach)))
    around = around.withColumn("x_", F.explode(F.array_distinct(F.transform(F.sequence(_cell(F.col("lon"), cell) - spread, _cell(F.col("lon"), cell) + spread), lambda x: F.pmod(x, F.lit(rows))))))
    carry = [c for c in places.columns if c not in ("lat", "lon")]
    p = points.select("lat", "lon").distinct()
    cells = p.select("lat", "lon", _cell(F.col("lat"), cell).alias("y_"), F.pmod(_cell(F.col("lon"), cell), F.lit(rows)).alias("x_"))
    met = cells.join(around.select("y_", "x_", F.col("lat").alias("plat_"), F.col("lon").alias("plon_"), F.struct(*carry).alias("place_"), "ord"), ["y_", "x_"])
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("plat_"), F.col("plon_"))
    met = met.withColumn("km", km).where(F.col("km") < radius_km)
    rank = F.struct((F.col("km") >= close_km).alias("far"), F.when(F.col("km") >= close_km, F.col("km")).otherwise(0.0).alias("km"), F.col("ord").alias("ord"))
    best = met.groupBy("lat", "lon").agg(F.min_by(F.struct("place_", "km"), rank).alias("b_"))
    return p.join(best, ["lat", "lon"], "left").select("lat", "lon", *(F.col(f"b_.place_.{c}").alias(c) for c in carry), F.col("b_.km").alias("km"))


def nearest_within(points: DataFrame, refs: DataFrame, degrees: float = 0.05, order: str = "id", carry: str = "date") -> DataFrame:
    """Each point with the carried value of the nearest reference under so many degrees (planar); ties by (lat, lon, order) of the reference."""
    step = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    r = refs.select(F.col("lat").alias("rlat_"), F.col("lon").alias("rlon_"), F.col(order).alias("rorder_"), F.col(carry).alias("ref"))
    # equal places are one candidate
    r = r.groupBy("rlat_", "rlon_").agg(F.min_by(F.struct("rorder_", "ref"), "rorder_").alias("r_")).select("rlat_", "rlon_", "r_.*")
    r = r.withColumns({"y_": _cell(F.col("rlat_"), degrees), "x_": _cell(F.col("rlon_"), degrees)})
    q = points.withColumn("y_", F.explode(F.transform(step, lambda k: _cell(F.col("lat"), degrees) + k)))
    q = q.withColumn("x_", F.explode(F.transform(step, lambda k: _cell(F.col("lon"), degrees) + k)))
    met = q.join(r, ["y_", "x_"]).withColumn("far", planar_degrees(F.col("lat"), F.col("lon"), F.col("rlat_"), F.col("rlon_"))).where(F.col("far") < degrees)
    best = met.groupBy(*points.columns).agg(F.min_by(F.struct("ref", "far"), F.struct("far", "rlat_", "rlon_", "rorder_")).alias("b_"))
    return best.select(*points.columns, "b_.ref", "b_.far")


def hamming_nearest(queries: DataFrame, refs: DataFrame, word: str, most: int = 12, bits: int = 64, order: str = "id") -> DataFrame:
    """Each query with its nearest reference within ``most`` of the words' bits: `ref_id`, `distance`; ties by order.

    At such radii words agree by chance in some of any bands, so bands meet more pairs than there are;
    each pair of distinct words is compared once instead, by whole arrays. Both sides are dealt by hash to
    PARTS parts; a task holds a pair of parts, of which the queries' are read in batches, and
    gives the nearest reference of a part. Equal words are one candidate.
    """
    ship(queries.sparkSession)
    r = refs.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word_")).agg(F.min(order).alias("rid_"))
    words = queries.where(F.col(word).isNotNull()).select(F.col(word).alias("word_")).distinct().withColumn("rid_", F.lit(None).cast(r.schema["rid_"].dataType))
    part = F.pmod(F.xxhash64("word_"), F.lit(PARTS))
    dealt = lambda df, side, cell: df.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), cell)).alias("cell_"), F.lit(side).alias("side_"), "word_", "rid_")
    both = dealt(r, 0, lambda k: part * PARTS + k).unionByName(dealt(words, 1, lambda k: part + k * PARTS))
    both = both.repartition(PARTS * PARTS, "cell_").sortWithinPartitions("cell_", "side_")
    kind = StructType([StructField("qword_", both.schema["word_"].dataType), StructField("rid_", both.schema["rid_"].dataType), StructField("d_", IntegerType())])
    best = both.mapInArrow(lambda batches: _nearest_words(batches, most, bits), kind)
    best = best.groupBy("qword_").agg(F.min_by(F.struct(F.col("rid_").alias("ref_id"), F.col("d_").alias("distance")), F.struct("d_", "rid_")).alias("b_"))
    return queries.join(best, queries[word] == best["qword_"], "left").select(*queries.columns, "b_.ref_id", "b_.distance")


def _nearest_words(batches: Iterator[pa.RecordBatch], most: int, bits: int, chunk: int = 8192) -> Iterator[pa.RecordBatch]:
    """Of rows by cell, references (side 0) first: each query's first of the nearest references of its cell within most bits."""
    cell, held, words, rids = None, [], None, None
    for batch in batches:
        cells = batch.column("cell_").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if cells[a] != cell:
                cell, held, words = cells[a], [], None
            rows = batch.slice(a, b - a)
            n = int(np.searchsorted(rows.column("side_").to_numpy(), 1))
            if n:
                held.append(rows.slice(0, n))
            if n == b - a or not held:
                continue
            if words is None:
                refs = pa.Table.from_batches(held)
                refs = refs.take(pc.sort_indices(refs, sort_keys=[("rid_", "ascending")], null_placement="at_start"))
                words, rids = refs.column("word_").to_numpy().astype(np.int64), refs.column("rid_").combine_chunks()
            asked = rows.column("word_").slice(n)
            q = asked.to_numpy().astype(np.int64)
            at, far = np.zeros(len(q), np.int64), np.full(len(q), bits + 1, np.int64)
            for i in range(0, len(q), 16):
                w = q[i : i + 16, None]
                for j in range(0, len(words), chunk):
                    d = np.bitwise_count((w ^ words[None, j : j + chunk]).view(np.uint64))
                    k = d.argmin(axis=1)
                    least = d[np.arange(len(k)), k]
                    nearer = least < far[i : i + 16]
                    at[i : i + 16][nearer], far[i : i + 16][nearer] = k[nearer] + j, least[nearer]
            hit = np.flatnonzero(far <= most)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(hit)), rids.take(pa.array(at[hit])), pa.array(far[hit].astype(np.int32))], names=["qword_", "rid_", "d_"])


def _runs(text: Column, lengths: Column) -> Column:
    """All distinct runs of text of so many characters."""
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(text)), lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, n)))))


def contained_name(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Each distinct `name` (and `cc`) of queries with a place: equal names first, else the first by `ord` of which one name contains the other.

    If queries and places have a country code `cc`, a query with one takes places of that country only; of
    equal names only the most populous place counts. Either side's runs of characters that are as long as some
    name of the other meet the other's whole names, so only names that fit are met. An empty name has no place.
    """
    keys = ["name", "cc"] if "cc" in queries.columns and "cc" in places.columns else ["name"]
    q = queries.select(*keys).distinct().withColumn("low_", F.lower(F.trim("name"))).withColumn("q_", F.struct(*keys))
    p = places.select("ord", F.lower("name").alias("plow_"), F.col("name").alias("place"), *([F.col("cc").alias("pcc_")] if "cc" in keys else []))
    fits = F.col("cc").isNull() | F.coalesce(F.upper("cc") == F.upper("pcc_"), F.lit(False)) if "cc" in keys else F.lit(True)
    largest = p.groupBy("plow_").agg(F.min_by(F.struct(*[c for c in p.columns if c != "plow_"]), "ord").alias("p_")).select("plow_", "p_.*")
    exact = q.join(largest, q["low_"] == largest["plow_"]).where(fits).select("q_", F.col("place").alias("exact_"))
    # of equal names (of a country) only the first can be the first that fits
    country = ["pcc_"] if "cc" in keys else []
    first = p.groupBy("plow_", *country).agg(F.min("ord").alias("ord"))
    lengths = lambda df, c: F.broadcast(df.select(F.length(c).alias("n_")).where("n_ > 0").agg(F.array_sort(F.collect_set("n_")).alias("lengths_")))
    run = lambda df, c, by: df.repartition(PARTS * PARTS, c).crossJoin(by).withColumn("run_", F.explode(_runs(F.col(c), F.col("lengths_")))).drop("lengths_")
    lows = q.select("low_").distinct()
    parts = run(first, "plow_", lengths(lows, "low_")).groupBy("run_", *country).agg(F.min("ord").alias("ord"))
    inside = q.join(parts, q["low_"] == parts["run_"]).where(fits).select("q_", "ord")
    around = run(lows, "low_", lengths(first, "plow_")).join(first, F.col("run_") == F.col("plow_")).select("low_", "ord", *country)
    around = q.join(around.groupBy("low_", *country).agg(F.min("ord").alias("ord")), "low_").where(fits).select("q_", "ord")
    loose = inside.unionByName(around).groupBy("q_").agg(F.min("ord").alias("ord"))
    loose = loose.join(p.groupBy("ord").agg(F.min("place").alias("loose_")), "ord").select("q_", "loose_")
    return q.select("q_").join(exact, "q_", "left").join(loose, "q_", "left").select("q_.*", F.coalesce("exact_", "loose_").alias("place"))
