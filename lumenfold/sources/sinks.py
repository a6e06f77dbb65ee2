"""Plans of what to write (links, renames, tags, uploads) and their execution; reports and snapshots."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dates import repaired_directory, year_or_undated
from ..functions.geo import dms
from ..operators.grouping import chunks, unique_names


def snapshot(df: DataFrame, path: str, by: list[str] = ()) -> DataFrame:
    """Writes a stage's table and reads it back."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def tag_actions(rows: DataFrame) -> DataFrame:
    """file_path, tag, value: dates and places to write into files, places as degrees, minutes and 1/10000 seconds."""
    rational = lambda c: F.concat_ws(" ", *(dms(F.col(c))[k].cast("string") for k in ("deg", "min", "sec_e4")))
    tags = {
        "DateTimeOriginal": F.date_format(F.to_timestamp(F.substring("best_date", 1, 19)), "yyyy:MM:dd HH:mm:ss"),
        "GPSLatitude": rational("latitude"), "GPSLatitudeRef": F.when(F.col("latitude") >= 0, "N").when(F.col("latitude") < 0, "S"),
        "GPSLongitude": rational("longitude"), "GPSLongitudeRef": F.when(F.col("longitude") >= 0, "E").when(F.col("longitude") < 0, "W"),
    }
    placed = lambda t, v: F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), v) if t.startswith("GPS") else v
    pairs = F.array(*(F.struct(F.lit(t).alias("tag"), placed(t, v).alias("value")) for t, v in tags.items()))
    return rows.select("file_path", F.inline(pairs)).where("value IS NOT NULL")


def export_plan(rows: DataFrame, root: str) -> DataFrame:
    """src and dst of every file: its album's folder or `Unsorted <year>`, with a suffix where names clash."""
    folder = F.when(F.col("album_name").isNotNull(), tx.safe_name(F.col("album_name"))).otherwise(F.concat(F.lit("Unsorted "), year_or_undated(F.col("best_date"))))
    named = unique_names(rows.withColumn("folder", folder), ["folder"], "filename", ["best_date", "id"])
    return named.select(F.col("file_path").alias("src"), F.concat_ws("/", F.lit(root), "folder", "unique_name").alias("dst"))


def _link(rows: Iterable[Row]) -> None:
    for r in rows:
        os.makedirs(os.path.dirname(r.dst), exist_ok=True)
        if os.path.lexists(r.dst):
            continue  # a retried task
        for make in (os.link, os.symlink, shutil.copy2):
            try:
                make(r.src, r.dst)
                break
            except OSError:
                continue


def link_files(plan: DataFrame) -> None:
    """Hard links, else symbolic links, else copies, on the executors; done again it changes nothing."""
    plan.foreachPartition(_link)


def clear_links(root: str) -> None:
    """Removes links and then empty folders below root."""
    for folder, _, names in os.walk(root, topdown=False):
        for n in names:
            p = os.path.join(folder, n)
            if os.path.islink(p) or os.stat(p).st_nlink > 1:
                os.unlink(p)
        if folder != root and not os.listdir(folder):
            os.rmdir(folder)


def rename_plan(dirs: DataFrame) -> DataFrame:
    """old and new name of broken directories."""
    return dirs.select(F.col("parent_dir").alias("old"), repaired_directory(F.col("parent_dir")).alias("new"))


def merge_plan(files: DataFrame, renames: DataFrame) -> DataFrame:
    """src and dst (directory and name) of every file of renamed directories, merged into what the new directory holds.

    A name that is there, or that another directory's file takes first, becomes `<stem>_m1<ext>`, `_m2`, ...: the
    first numbers that no file there or coming has.
    """
    moving = files.join(renames, files["parent_dir"] == renames["old"]).select("old", F.col("new").alias("dir"), "filename")
    there = files.join(renames.select(F.col("new").alias("parent_dir")).distinct(), "parent_dir").select(F.col("parent_dir").alias("dir"), "filename")
    numbered = r"^(.+)_m(\d{1,9})(\.[^.]*)?$"
    part = lambda k: F.regexp_extract("filename", numbered, k)
    taken = there.unionByName(moving.drop("old")).where(F.col("filename").rlike(numbered)).groupBy("dir", F.concat(part(1), part(3)).alias("filename")).agg(F.collect_set(part(2).cast("int")).alias("taken"))
    held = there.distinct().withColumn("held", F.lit(1))
    w = Window.partitionBy("dir", "filename").orderBy("old")
    rows = moving.withColumn("r", F.row_number().over(w)).join(held, ["dir", "filename"], "left").join(taken, ["dir", "filename"], "left")
    k = F.col("r") - 1 + F.coalesce("held", F.lit(0))  # 0: the name is free
    used = F.coalesce("taken", F.array().cast("array<int>"))
    number = F.get(F.array_except(F.sequence(F.lit(1), F.greatest(k, F.lit(1)) + F.size(used)), used), F.greatest(k, F.lit(1)) - 1)
    stem, ext = tx.stem(F.col("filename")), F.regexp_extract("filename", r"(?<=.)(\.[^.]*)$", 1)
    name = F.when(k == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("_m"), number.cast("string"), ext))
    return rows.select("old", "filename", F.col("dir").alias("new"), name.alias("new_name"))


def with_unsorted(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest with a row for each folder `Unsorted <year>` of exported files (parent_dir below the export)."""
    own = files.where(F.startswith("parent_dir", F.lit("Unsorted "))).groupBy(F.col("parent_dir").alias("folder")).agg(F.count("*").alias("file_count"))
    rows = own.select("folder", F.col("folder").alias("name"), "file_count", F.lit(True).alias("exists"), F.lit(1).cast("long").alias("parts"))
    return manifest.unionByName(rows.select(*manifest.columns))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: albums, those whose folder exists, and files."""
    return manifest.agg(F.count("*").alias("albums"), F.count_if("exists").alias("existing"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"))


def upload_manifest(albums: DataFrame, photos: DataFrame, folders: DataFrame, part: int = 20_000) -> DataFrame:
    """One row an album: file count (0 for empty ones), folder, whether it exists, and parts of so many files."""
    live = photos.where("is_duplicate = 0 AND album_id IS NOT NULL").groupBy("album_id").agg(F.count("*").alias("n"))
    out = albums.join(live, albums["id"] == live["album_id"], "left").select("name", F.coalesce("n", F.lit(0)).alias("file_count"), tx.safe_name(F.col("name")).alias("folder"))
    there = folders.select(F.col("album_name").alias("folder"), F.lit(True).alias("exists"))
    return out.join(there, "folder", "left").withColumn("exists", F.coalesce("exists", F.lit(False))).withColumn("parts", F.floor(F.col("file_count") / part) + 1)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """One row of JSON lines, sorted by key (a manifest of albums, not of files)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(F.struct(*rows.columns)).alias("j")))), lambda x: x["j"])
    return rows.agg(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")).alias("manifest"))


def upload_commands(manifest: DataFrame, remote: str) -> DataFrame:
    """One shell command for each album and part; names are quoted for the shell whatever they hold."""
    quoted = lambda *parts: F.concat(F.lit("'"), F.replace(F.concat(*parts), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    parts = manifest.where("exists").withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts").cast("int"))))
    return parts.select("folder", "part", F.concat_ws(" ", F.lit("rclone copy"), quoted(F.col("folder")), quoted(F.lit(f"{remote}:"), F.col("folder")), F.lit("--part"), F.col("part").cast("string")).alias("command"))


def year_report(albums: DataFrame) -> DataFrame:
    """Lines of a Markdown report, a heading before the first album of each year: year, position, line."""
    item = F.format_string("- %s (%d)", "name", F.col("file_count").cast("bigint"))
    heads = albums.select("year").distinct().select("year", F.lit("").alias("name"), F.concat(F.lit("## "), F.col("year").cast("string")).alias("line"))
    return heads.unionByName(albums.select("year", "name", item.alias("line"))).orderBy("year", "name")


def album_requests(files: DataFrame, size: int = 1000) -> DataFrame:
    """Bodies of requests that add files to albums, so many ids each."""
    cut = chunks(files, ["album_id"], [F.col("asset_id")], size)
    return cut.groupBy("album_id", "chunk").agg(F.to_json(F.struct(F.array_sort(F.collect_list("asset_id")).alias("ids"))).alias("body"))


def caption_text(caption: Column, tags: Column, alt: Column) -> Column:
    return F.concat_ws("\n\n", caption, F.nullif(tx.hashtags(tags), F.lit("")), alt)


def package_plan(curated: DataFrame, captions: DataFrame, root: str) -> DataFrame:
    """Numbered carousel files and a caption text for each album: album_name, dst, src or content."""
    folder = tx.safe_name(F.col("album_name"))
    photos = curated.select("album_name", F.concat_ws("/", F.lit(root), folder, F.concat(F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit(".jpg"))).alias("dst"), F.col("file_path").alias("src"), F.lit(None).cast("string").alias("content"))
    texts = captions.select("album_name", F.concat_ws("/", F.lit(root), folder, F.lit("caption.txt")).alias("dst"), F.lit(None).cast("string").alias("src"), caption_text(F.col("caption"), F.col("hashtags"), F.col("alt_text")).alias("content"))
    return photos.unionByName(texts)


def upsert_progress(old: DataFrame, phase: str, status: str, at: str) -> DataFrame:
    new = old.sparkSession.createDataFrame([(phase, status, at)], "phase string, status string, at string")
    return old.where(F.col("phase") != phase).unionByName(new)
