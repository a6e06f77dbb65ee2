"""Changes to keyed tables as functions of immutable DataFrames, and set operations with a priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows whose key is not there; of new rows with one key the first in order."""
    return old.unionByName(_first(new, keys, order).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace old ones of their key; of new rows with one key the last in order stands."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("r_")).select("r_.*")
    return old.join(last.select(*keys), keys, "left_anti").select(*old.columns).unionByName(last.select(*old.columns))


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r_")).select("r_.*")


def update(old: DataFrame, changes: DataFrame, keys: list[str], guard: Column | None = None) -> DataFrame:
    """Columns that changes has and gives a value for, where guard (over old columns) holds."""
    columns = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"{c}__new") for c in columns))
    allowed = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    out = old.join(new, keys, "left")
    return out.select(*(F.when(allowed, F.coalesce(f"{c}__new", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def update_ignore(rows: DataFrame, key: str, changed: Column, order: str = "id") -> DataFrame:
    """The key becomes changed, unless another row has that key or an earlier row takes it."""
    rows = rows.withColumn("to_", F.coalesce(changed, F.col(key)))
    held = rows.select(F.col(key).alias("to_")).distinct().withColumn("held_", F.lit(True))
    first = rows.where(F.col("to_") != F.col(key)).groupBy("to_").agg(F.min(order).alias("first_"))
    out = rows.join(held, "to_", "left").join(first, "to_", "left")
    free = F.col("held_").isNull() & (F.col("first_") == F.col(order))
    return out.withColumn(key, F.when(free, F.col("to_")).otherwise(F.col(key))).select(*[c for c in rows.columns if c != "to_"])


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def keep(old: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(valid.select(*keys), keys, "left_semi")


def priority_union(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of several listings; a key that several have comes from the first of them."""
    both = None
    for k, s in enumerate(sources):
        s = s.withColumn("priority_", F.lit(k))
        both = s if both is None else both.unionByName(s)
    return _first(both, keys, ["priority_"]).drop("priority_")


def rewrite_prefix(rows: DataFrame, columns: list[str], old: Column, new: Column) -> DataFrame:
    """Paths after a directory was renamed (every occurrence, as a text replacement)."""
    return rows.withColumns({c: F.replace(F.col(c), old, new) for c in columns})


def apply_guesses(photos: DataFrame, guesses: DataFrame, levels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Photos without a place take guesses of these confidences, and the guesses with `applied` set, matched or not."""
    ready = guesses.where(F.col("confidence").isin(levels) & (F.col("applied") == 0))
    given = ready.select("file_path", "lat", "lon", "country", "city")
    done = guesses.withColumn("applied", F.when(F.col("confidence").isin(levels), 1).otherwise(F.col("applied")))
    return update(photos, given, ["file_path"], F.col("lat").isNull()), done
