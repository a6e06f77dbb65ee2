"""Places for files without one: nearest in time, the album's majority, similar pictures, then a model; each later guess replaces a low one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc
from .grouping import album_votes
from .nearest import hamming_nearest
from .tables import insert_replace
from .timeline import nearest_in_time

GUESS = ["id", "strategy", "confidence", "lat", "lon", "country", "city"]


def open_questions(photos: DataFrame, guesses: DataFrame) -> DataFrame:
    """Photos without a place and without a guess better than low."""
    firm = guesses.where("confidence <> 'low'").select("id")
    return photos.where("lat IS NULL AND is_duplicate = 0").join(firm, "id", "left_anti")


def by_time(asked: DataFrame, placed: DataFrame) -> DataFrame:
    near = nearest_in_time(asked.select("id", "ts", "album_id"), placed, "ts", "id", ["album_id", "lat", "lon", "country", "city"])
    same = F.coalesce(F.col("album_id") == F.col("ref_album_id"), F.lit(False))
    out = near.select("id", F.lit("temporal").alias("strategy"), sc.temporal_confidence(F.col("seconds") / 3600, same).alias("confidence"), *(F.col(f"ref_{c}").alias(c) for c in ("lat", "lon", "country", "city")))
    return out.where("confidence IS NOT NULL")


def by_album(asked: DataFrame, photos: DataFrame) -> DataFrame:
    votes = album_votes(photos.where("is_duplicate = 0")).select("album_id", "confidence", "lat", "lon", "country", "city")
    return asked.select("id", "album_id").join(votes, "album_id").select("id", F.lit("album").alias("strategy"), "confidence", "lat", "lon", "country", "city")


def by_similarity(asked: DataFrame, placed: DataFrame, word: str = "phash") -> DataFrame:
    near = hamming_nearest(asked.where(F.col(word).isNotNull()).select("id", word), placed.where(F.col(word).isNotNull()), word).where("ref_id IS NOT NULL")
    refs = placed.select(F.col("id").alias("ref_id"), "lat", "lon", "country", "city")
    return near.join(refs, "ref_id").select("id", F.lit("similar").alias("strategy"), sc.similarity_confidence(F.col("distance")).alias("confidence"), "lat", "lon", "country", "city")


def infer(photos: DataFrame, guesses: DataFrame, steps: tuple[str, ...] = ("temporal", "album", "similar")) -> DataFrame:
    """The table of guesses after these strategies, one guess a photo."""
    placed = photos.where("lat IS NOT NULL AND is_duplicate = 0")
    for step in steps:
        asked = open_questions(photos, guesses)
        new = {"temporal": lambda a: by_time(a, placed), "album": lambda a: by_album(a, photos), "similar": lambda a: by_similarity(a, placed)}[step](asked)
        guesses = insert_replace(guesses.select(*GUESS), new.select(*GUESS), ["id"], ["id"])
    return guesses


def coverage(photos: DataFrame, guesses: DataFrame) -> DataFrame:
    """Guesses by strategy and confidence, and how many photos still have none."""
    counts = guesses.groupBy("strategy", "confidence").agg(F.count("*").alias("n"))
    left = photos.where("lat IS NULL AND is_duplicate = 0").join(guesses, "id", "left_anti").agg(F.count("*").alias("n"))
    return counts.unionByName(left.select(F.lit("none").alias("strategy"), F.lit("-").alias("confidence"), "n"))
