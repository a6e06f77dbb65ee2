"""Calls to vision and text models: a client is given, rows carry a status, and replies are parsed relationally."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shipping import ship

# Status of a row: to do (again), done, or without its file.
TODO, DONE, MISSING = 0, 1, -1


def ask(rows: DataFrame, prompt: Column, client: Callable[[str, bytes | None], str], image: Column | None = None, workers: int = 4) -> DataFrame:
    """Rows with `reply` and `status`. An error that may pass leaves a row to do; FileNotFoundError marks it missing; an empty reply is done.

    A partition's calls run in a few threads; the rate is partitions times workers.
    """
    ship(rows.sparkSession)
    given = rows.withColumns({"prompt_": prompt, "image_": image if image is not None else F.lit(None).cast("binary")})
    fields = rows.limit(0).selectExpr("*", "cast(null as string) reply", "cast(null as int) status").schema

    def one(x: tuple) -> tuple[str | None, int]:
        try:
            return client(*x), DONE
        except FileNotFoundError:
            return None, MISSING
        except Exception:  # noqa: BLE001  whatever the client's transport raises
            return None, TODO

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                replies = list(pool.map(one, zip(b.prompt_, b.image_)))
                out = b.drop(columns=["prompt_", "image_"])
                out["reply"], out["status"] = [r for r, _ in replies], [s for _, s in replies]
                yield out

    return given.mapInPandas(call, fields)


def pending(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.where(F.coalesce("status", F.lit(TODO)) == TODO)
    return out.orderBy("id").limit(limit) if limit else out


def prompt_context(*parts: tuple[str, str]) -> Column:
    """`label: value` of the parts that are there, one a line."""
    return F.concat_ws("\n", *(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for label, c in parts))


CLASSES = "scene string, type string, activity string, indoor_outdoor string, tags array<string>, is_holiday boolean, holiday_type string"
DATES = "year int, confidence string, reason string"
LOCATIONS = "country string, city string, confidence string, clues string"
LOOKS = "instagram_score double, composition string, lighting string, mood string, best_feature string, is_holiday boolean"
CAPTIONS = "caption string, hashtags array<string>, alt_text string"


def classified(replies: DataFrame) -> DataFrame:
    return replies.withColumn("ai", F.from_json(tx.json_balanced(F.col("reply")), CLASSES))


def dated(replies: DataFrame) -> DataFrame:
    """A model's year, as its middle, if it is sure enough."""
    j = F.from_json(tx.json_lazy(F.col("reply")), DATES)
    return replies.withColumn("ai_date", F.when(j["confidence"].isin("high", "medium") & j["year"].between(1990, 2026), F.concat(j["year"].cast("string"), F.lit("-06-15T00:00:00"))))


def located(replies: DataFrame, places: DataFrame) -> DataFrame:
    """A model's city with coordinates from the gazetteer; without them the confidence is low."""
    from .nearest import contained_name

    j = F.from_json(tx.json_greedy(F.col("reply")), LOCATIONS)
    out = replies.withColumns({"country": j["country"], "name": j["city"], "said": j["confidence"]})
    found = contained_name(out.where("name IS NOT NULL"), places).join(places.select(F.col("name").alias("place"), "lat", "lon", "ord"), "place").groupBy("name").agg(F.min_by(F.struct("lat", "lon"), "ord").alias("p"))
    out = out.join(found, "name", "left").withColumns({"lat": F.col("p.lat"), "lon": F.col("p.lon")})
    return out.withColumn("confidence", F.when(F.col("lat").isNull(), "low").otherwise(F.col("said"))).withColumnRenamed("name", "city").drop("p", "said")


def scored(replies: DataFrame) -> DataFrame:
    """Aesthetic score and mood; 5 and flat where the reply cannot be read."""
    j = F.from_json(tx.json_greedy(F.col("reply")), LOOKS)
    return replies.withColumns({"ai_score": F.coalesce(j["instagram_score"], F.lit(5.0)), "ai_mood": F.coalesce(j["mood"], F.lit("flat"))})


def captioned(vision: DataFrame, written: DataFrame) -> DataFrame:
    """The caption seen in the picture, else the one written from the facts."""
    cap = lambda df: F.from_json(tx.json_greedy(df["reply"]), CAPTIONS)
    v, w = vision.select("album_name", cap(vision).alias("v")), written.select("album_name", cap(written).alias("w"))
    return w.join(v, "album_name", "full").select("album_name", *(F.coalesce(f"v.{c}", f"w.{c}").alias(c) for c in ("caption", "hashtags", "alt_text")))


def named(replies: DataFrame) -> DataFrame:
    return replies.withColumn("new_name", tx.album_name_reply(F.col("reply")))
