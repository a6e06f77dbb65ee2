"""Listings, JSON documents, gazetteers, logs, catalogue tables and paged services as DataFrames."""

from __future__ import annotations

import json
import os
import subprocess
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as tx
from ..functions.dates import from_epoch
from ..functions.geo import pair_off_null_island
from ..operators.tables import priority_union

SIDECAR = "photoTakenTime struct<timestamp:string>, creationTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double,altitude:double>, description string, people array<struct<name:string>>, url string"


def listing(spark: SparkSession, root: str, source: str, pruned: list[str] = (), media_only: bool = True) -> DataFrame:
    """file_path, filename, parent_dir (below root, `.` for root), size, modified, media_type; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/")
    below = F.substring(path, len(base) + 2, 100_000)
    out = files.select(
        path.alias("file_path"), tx.basename(path).alias("filename"), F.when(tx.dirname(below) == "", ".").otherwise(tx.dirname(below)).alias("parent_dir"),
        F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), tx.media_type(path).alias("media_type"), F.lit(source).alias("source"),
    )
    if pruned:
        out = out.where(~F.arrays_overlap(F.split("parent_dir", "/"), F.array(*map(F.lit, pruned))))
    return out.where("media_type <> 'other'") if media_only else out


def not_yet_catalogued(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    return files.join(catalogue.select("file_path"), "file_path", "left_anti")


def catalogue(images: DataFrame, albums: DataFrame, information: DataFrame, positions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Visible images of an external catalogue with their album and what is known of each."""
    i = images.where("status = 1").join(albums.select(F.col("id").alias("album"), "relativePath"), "album")
    side = lambda t: t.withColumnRenamed("imageid", "id")
    return i.join(side(information), "id", "left").join(side(positions), "id", "left").join(side(metadata), "id", "left")


def resolve(wanted: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Relative paths with the file that exists, in the first of two listings that has it; others go."""
    return wanted.join(priority_union([primary, secondary], ["relative"]), "relative")


def sidecars(files: DataFrame) -> DataFrame:
    """JSON files that describe a file beside them: json_path and file_path."""
    name = F.col("filename")
    excluded = (name == "metadata.json") | name.rlike("print-subscriptions|shared_album_comments|user-generated-memory")
    found = files.where(F.endswith(name, F.lit(".json")) & ~excluded)
    return found.select(F.col("file_path").alias("json_path"), F.concat(tx.dirname(F.col("file_path")), F.lit("/"), tx.sidecar_target(name)).alias("file_path"))


def documents_at(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """path and whole content of the files that match."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("wholetext", "true").text(root)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), "value")


def sidecar_fields(documents: DataFrame, content: str = "value") -> DataFrame:
    """Date, place, description, people and address from sidecar JSON; malformed documents give nulls."""
    d = documents.withColumn("j", F.from_json(content, SIDECAR, {"mode": "PERMISSIVE"}))
    taken = F.coalesce(*(F.when(F.substring(t, 1, 4).between("1990", "2026"), t) for t in (from_epoch(F.col("j.photoTakenTime.timestamp")), from_epoch(F.col("j.creationTime.timestamp")))))
    lat, lon = F.col("j.geoData.latitude"), F.col("j.geoData.longitude")
    ok = F.coalesce(pair_off_null_island(lat, lon), F.lit(False))
    people = F.filter(F.transform("j.people", lambda p: p["name"]), lambda n: n != "")
    return d.select(*documents.columns, taken.alias("google_date"), F.when(ok, lat).alias("latitude"), F.when(ok, lon).alias("longitude"), F.when(ok, F.col("j.geoData.altitude")).alias("altitude"), F.nullif(F.col("j.description"), F.lit("")).alias("google_description"), people.alias("google_people"), F.col("j.url").alias("google_url"))


def album_titles(documents: DataFrame) -> DataFrame:
    """Directory and title of `metadata.json` documents: the directory's name without a title, none for an empty one."""
    folder = tx.dirname(F.col("path"))
    title = F.from_json("value", "title string")["title"]
    return documents.select(folder.alias("dir"), F.coalesce(title, tx.basename(folder)).alias("title")).where("title <> ''")


def gazetteer(spark: SparkSession, path: str, least: int = 500) -> DataFrame:
    """Places of a tab-separated gazetteer, with `ord`, their rank by population (file order among equals).

    The rank is global, so it is taken from a sort by range and its partitions' sizes, not from a window over all rows.
    """
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).withColumn("c", F.split("value", "\t"))
    at = lambda k: F.get("c", k)
    rows = raw.where((F.size("c") >= 15) & at(6).isin("P", "A")).select(at(1).alias("name"), at(4).try_cast("double").alias("lat"), at(5).try_cast("double").alias("lon"), at(8).alias("cc"), F.coalesce(at(14).try_cast("bigint"), F.lit(0)).alias("pop"), "line")
    return ranked(rows.where((F.col("pop") >= least) & F.col("lat").isNotNull() & F.col("lon").isNotNull()), [F.desc("pop"), F.asc("line")]).drop("line")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Rows with `ord`, their rank from 0 in a global order, without one task for all."""
    cut = rows.orderBy(*order).withColumn("id_", F.monotonically_increasing_id())
    cut = cut.withColumns({"part_": F.shiftright("id_", 33), "in_": F.col("id_").bitwiseAND(F.lit(2**33 - 1))})
    sizes = cut.groupBy("part_").agg(F.count("*").alias("n")).collect()  # a row a partition
    before, table = 0, []
    for r in sorted(sizes):
        table.append((r.part_, before))
        before += r.n
    starts = F.broadcast(rows.sparkSession.createDataFrame(table or [(0, 0)], "part_ bigint, start_ bigint"))
    return cut.join(starts, "part_").withColumn("ord", F.col("start_") + F.col("in_")).drop("id_", "part_", "in_", "start_")


def largest_by_name(places: DataFrame) -> DataFrame:
    """The most populous place of each lower-case name."""
    return places.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct(*places.columns), "ord").alias("p")).select("key", "p.*")


def exif_tags(files: DataFrame, read: Callable[[str], dict[str, str]] | None = None) -> DataFrame:
    """file_path and `tags`, by a function of a path (by default the `exiftool` program; no tags where it fails)."""

    def tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_path": b.file_path, "tags": [(read or _exiftool)(p) for p in b.file_path]})

    return files.select("file_path").mapInPandas(tags, "file_path string, tags map<string,string>")


def _exiftool(path: str) -> dict[str, str]:
    tags = ["DateTimeOriginal", "CreateDate", "ModifyDate", "MediaCreateDate"]
    try:
        done = subprocess.run(["exiftool", "-json", *(f"-{t}" for t in tags), path], capture_output=True, text=True, timeout=15, check=True)
        return {k: str(v) for k, v in json.loads(done.stdout)[0].items() if k in tags}
    except (OSError, subprocess.SubprocessError, ValueError):
        return {}


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pixels: file_path, width, height, channels and interleaved bytes (blue, green, red)."""
    return spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root).select(F.col("image.origin").alias("file_path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def event_folders(files: DataFrame, skipped_prefix: str = "Unsorted", least: int = 1) -> DataFrame:
    """First-level folders with at least so many files: name and count."""
    folder = F.substring_index("parent_dir", "/", 1)
    out = files.where((folder != ".") & ~F.startswith(folder, F.lit(".")) & ~F.startswith(folder, F.lit(skipped_prefix)))
    return out.groupBy(folder.alias("album_name")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def log_counters(spark: SparkSession, path: str, pattern: str = r"(\d+)/(\d+)") -> DataFrame:
    """done and total of the log lines that have them, with the line's number."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    part = lambda k: F.regexp_extract("value", pattern, k).try_cast("bigint")
    return lines.select("line", part(1).alias("done"), part(2).alias("total")).where("done IS NOT NULL")


def upload_states(documents: DataFrame) -> DataFrame:
    """How many files of upload-state documents have each state."""
    states = F.map_values(F.from_json("value", "map<string,string>"))
    return documents.select(F.explode(states).alias("state")).groupBy("state").count()


def broken_directories(files: DataFrame) -> DataFrame:
    return files.select("parent_dir").distinct().where(F.col("parent_dir").rlike(r"^\d{4}:"))


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _get(self, page: int) -> dict:
        request = urllib.request.Request(self.options["url"].replace("{page}", str(page)))
        if env := self.options.get("key_env"):  # the key itself never stands in a plan
            request.add_header(self.options.get("key_header", "x-api-key"), os.environ[env])
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 30))) as reply:
            return json.loads(reply.read())

    def partitions(self) -> list[InputPartition]:
        if "next" in self.options:
            return [_Page(0)]
        return [_Page(k) for k in range(1, int(self.options.get("pages", 1)) + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = partition.page or 1
        while page:
            body = self._get(page)
            for row in self._at(body, "items"):
                yield tuple(None if (v := row.get(f)) is None else str(v) for f in self.options["fields"].split(","))
            page = None if partition.page else self._at(body, "next")

    def _at(self, body, path: str):
        """What a reply has at the dotted path of an option, or null."""
        for step in filter(None, self.options.get(path, "").split(".")):
            body = body.get(step) if isinstance(body, dict) else body[step]
        return body


class PagedService(DataSource):
    """A service that returns pages of JSON rows: options url (with {page}), items (a path), fields, key_env.

    With the option pages, one partition a page; with next (the path of the next page's number), one
    partition follows the pages until a reply has none.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return ", ".join(f"`{f}` string" for f in self.options["fields"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))
