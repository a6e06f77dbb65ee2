"""Scores, ranks and confidence ladders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def copy_penalty(parent_dir: Column, has_sidecar: Column, is_primary: Column, lat: Column) -> Column:
    """Of equal files the one with the lowest sum is canonical."""
    d = parent_dir
    colon = F.coalesce(F.contains(d, F.lit(":")), F.lit(False))
    named = F.coalesce((d != "") & ~d.rlike(r"^\d"), F.lit(False)) & ~colon
    place = F.when(named, -20).when(F.coalesce(F.startswith(d, F.lit("Photos from")), F.lit(False)), -10).when(colon, 50).otherwise(0)
    points = lambda c, n: F.when(c, n).otherwise(0)
    return place + points(has_sidecar, -100) + points(is_primary, -50) + points(F.coalesce(lat != 0, F.lit(False)), -5)


def technical(blur: Column, exposure: Column, resolution_ok: Column) -> Column:
    return F.round(F.least(F.lit(100.0), 0.6 * blur + 0.3 * exposure + 20 * resolution_ok), 1)


def final(technical_: Column, aesthetic: Column) -> Column:
    return F.round(0.3 * technical_ + 0.7 * aesthetic * 10, 1)


def album_potential(n: Column, average: Column, travel: Column, scored: Column, curated: Column) -> Column:
    flag = lambda c: c.cast("int")
    return F.least(n / 8, F.lit(4.0)) + average / 20 + 2.5 * flag(travel) + flag(scored) + 0.5 * flag(curated)


def temporal_confidence(hours: Column, same_album: Column) -> Column:
    return F.when(hours <= 0.5, "high").when((hours <= 6) & same_album, "high").when((hours <= 24) & same_album, "medium").when(hours <= 6, "medium")


def coverage_confidence(share: Column) -> Column:
    return F.when(share >= 0.7, "high").when(share >= 0.5, "medium")


def similarity_confidence(bits: Column, high: int = 4, medium: int = 10, most: int = 12) -> Column:
    return F.when(bits <= high, "high").when(bits <= medium, "medium").when(bits <= most, "low")


def phase(*ladder: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for condition, label in ladder:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def partial_md5(size: Column, content: Column, chunk: int = 65536) -> Column:
    """MD5 of the size, the first chunk and, for more than two chunks, the last."""
    last = F.when(size > 2 * chunk, F.substring(content, -chunk, chunk)).otherwise(F.lit(b""))
    return F.md5(F.concat(F.encode(size.cast("string"), "utf-8"), F.substring(content, 1, chunk), last))
