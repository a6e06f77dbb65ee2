"""Stages over named tables: each reads snapshots and writes new ones; runs can begin at any stage."""

from __future__ import annotations

import argparse
import importlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    number: float
    name: str
    inputs: tuple[str, ...]
    run: Callable[[Tables], Tables]
    aliases: tuple[str, ...] = ()
    ready: Callable[[], str | None] = field(default=lambda: None)  # what is missing, if anything


class Runner:
    """Runs stages in order of their numbers over a warehouse of Parquet snapshots, `<warehouse>/<table>/<stage>`."""

    def __init__(self, spark: SparkSession, warehouse: str, stages: list[Stage]):
        self.spark, self.warehouse, self.stages = spark, warehouse.rstrip("/"), sorted(stages, key=lambda s: s.number)
        self.latest: dict[str, str] = {}

    def table(self, name: str, before: float) -> DataFrame:
        """The snapshot of a table by the last stage below this number that wrote one, else its source."""
        for s in reversed([s for s in self.stages if s.number < before]):
            path = f"{self.warehouse}/{name}/{s.name}"
            if self.exists(path):
                return self.spark.read.parquet(path)
        return self.spark.read.parquet(f"{self.warehouse}/{name}/source")

    def exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def select(self, step: str = "all", from_number: float = 0.0) -> list[Stage]:
        chosen = [s for s in self.stages if s.number >= from_number and (step == "all" or step in (s.name, f"{s.number:g}", *s.aliases))]
        if not chosen:
            raise ValueError(f"no stage is called {step}")
        return chosen

    def status(self) -> list[dict]:
        """For each stage the tables it has written and what it lacks to run."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.warehouse)
        fs = root.getFileSystem(conf)
        tables = sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []
        return [{"stage": s.name, "written": [t for t in tables if self.exists(f"{self.warehouse}/{t}/{s.name}")], "lacks": s.ready()} for s in self.stages]

    def run(self, step: str = "all", from_number: float = 0.0, dry_run: bool = False) -> list[dict]:
        """Runs stages; a dry run plans and counts but writes nothing. Reports name, rows by table and seconds."""
        report = []
        for s in self.select(step, from_number):
            if missing := s.ready():
                raise RuntimeError(f"{s.name}: {missing}")
            began, rows = time.time(), {}
            for name, df in s.run({t: self.table(t, s.number) for t in s.inputs}).items():
                if dry_run:
                    rows[name] = df.count()
                    continue
                path = f"{self.warehouse}/{name}/{s.name}"
                df.write.mode("overwrite").parquet(path)
                rows[name] = self.spark.read.parquet(path).count()
            report.append({"stage": s.name, "rows": rows, "seconds": round(time.time() - began, 2)})
        return report


def catalogue_stages() -> list[Stage]:
    """The curation of a catalogue as stages over the tables photos, places, guesses and albums."""
    from pyspark.sql import functions as F

    from ..functions import dates, scores, text
    from ..operators import grouping, inference, nearest, tables, timeline

    def deduplicate(t: Tables) -> Tables:
        p = t["photos"]
        pen = scores.copy_penalty(F.col("parent_dir"), F.col("has_json_sidecar") == 1, F.col("source") == "primary", F.col("lat"))
        hashed = grouping.canonical(p.where("file_hash <> ''"), ["file_hash"], pen).where("not is_canonical").select("id", "canonical_id", F.lit("hash").alias("match_type"), F.lit(1.0).alias("similarity"))
        rest = p.where("(file_hash IS NULL OR file_hash = '') AND file_size > 0")
        named = grouping.canonical(rest, ["filename", "file_size"], pen).where("not is_canonical").select("id", "canonical_id", F.lit("name_size").alias("match_type"), F.lit(0.95).alias("similarity"))
        found = hashed.unionByName(named)
        marks = found.select("id", F.lit(1).alias("is_duplicate"), F.col("canonical_id").alias("duplicate_of"))
        return {"photos": tables.update(p, marks, ["id"]), "duplicates": found}

    def fix_dates(t: Tables) -> Tables:
        p = t["photos"]
        given = lambda c, kind="string": F.col(c) if c in p.columns else F.lit(None).cast(kind)
        numbered = p.withColumn("number", text.sequence_number(F.col("filename"))).where("number IS NOT NULL")
        near = timeline.neighbour_median(numbered.select("id", "parent_dir", "number", "best_date"), ["parent_dir"], "number", "best_date").select("id", F.col("filled").alias("near_"))
        p = p.join(near, "id", "left")
        # in order of trust; sidecar, tags, modification time and a model's date are used where the table has them
        picked = dates.cascade(
            ("best", F.col("best_date")), ("sidecar", given("google_date")), ("filename", dates.from_filename(F.col("filename"))), ("exif", dates.from_exif(given("exif_date"))),
            ("directory", dates.from_directory(F.col("parent_dir"))), ("neighbour", F.col("near_")), ("modified", dates.from_modified(given("modified", "timestamp"))), ("model", given("ai_date")),
        )
        p = p.withColumn("picked_", picked).withColumn("best_date", F.coalesce("picked_.taken", "best_date")).withColumn("date_method", F.col("picked_.method")).drop("picked_", "near_")
        p = timeline.consensus_month(p, ["parent_dir"], "best_date").withColumn("best_date", F.coalesce("filled", "best_date")).drop("filled")
        numbered = p.withColumn("number", text.sequence_number(F.col("filename")))
        filled = timeline.fill_from_sequence(numbered, ["parent_dir"], "number", "filename", "best_date").where("filled IS NOT NULL").select("id", F.col("filled").alias("best_date"))
        return {"photos": tables.update(p, filled, ["id"]).withColumn("ts", dates.to_ts(F.col("best_date")))}

    def geocode(t: Tables) -> Tables:
        p = t["photos"]
        todo = p.where("is_duplicate = 0 AND lat IS NOT NULL AND (country IS NULL OR country = '')")
        found = nearest.reverse_geocode(todo, t["places"]).select("lat", "lon", F.col("cc").alias("country_code"), text.country_name(F.col("cc")).alias("country"), F.col("name").alias("city"))
        return {"photos": tables.update(p, todo.select("id", "lat", "lon").join(found, ["lat", "lon"]).select("id", "country_code", "country", "city"), ["id"])}

    def guess(t: Tables) -> Tables:
        p = t["photos"]
        empty = p.select("id", F.lit("").alias("strategy"), F.lit("").alias("confidence"), "lat", "lon", "country", "city").limit(0)
        guesses = inference.infer(p, empty, ("temporal", "album", "similar") if "phash" in p.columns else ("temporal", "album"))
        given = guesses.where("confidence = 'high'").select("id", "lat", "lon", "country", "city")
        return {"photos": tables.update(p, given, ["id"], F.col("lat").isNull()), "guesses": guesses}

    def group(t: Tables) -> Tables:
        p = t["photos"].withColumn("cc", F.col("country_code"))
        events = timeline.sessionize(p.where("album_id IS NULL AND is_duplicate = 0"))
        keys = ["cluster"]
        named = grouping.profile(events, keys, "ts", ["ts", "id"]).withColumn("name", grouping.album_name())
        named = grouping.dated_names(named, "name", "first_ts", ["first_ts", *keys]).withColumn("album", F.xxhash64("unique_name"))
        member = events.join(named.select(*keys, "album", "unique_name"), keys).select("id", F.col("album").alias("album_id"), F.col("unique_name").alias("album_name"))
        return {"photos": tables.update(t["photos"], member, ["id"]), "albums": named.select("album", F.col("unique_name").alias("name"), "n", "first_ts", "last_ts", "country", "city")}

    return [
        Stage(3, "deduplicate", ("photos",), deduplicate, ("dedup",)),
        Stage(3.5, "fix-dates", ("photos",), fix_dates, ("dates",)),
        Stage(4, "geocode", ("photos", "places"), geocode),
        Stage(4.5, "guess-locations", ("photos",), guess, ("guess",)),
        Stage(7, "group-albums", ("photos",), group, ("group",)),
    ]


def client_of(path: str | None):
    """A model client named `module:function`."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run stages over a warehouse of Parquet tables.")
    parser.add_argument("warehouse")
    parser.add_argument("--stages", choices=("catalogue", "workflow", "curation"), default="catalogue")
    parser.add_argument("--root", action="append", default=[], metavar="LABEL=FOLDER", help="a folder of files; the first is the primary source")
    parser.add_argument("--export-root", default="/export")
    parser.add_argument("--remote", default="remote")
    parser.add_argument("--album", default="", help="curate only albums with this in their name")
    parser.add_argument("--max-items", type=int, help="rows that a stage may send to a model")
    parser.add_argument("--vision", metavar="MODULE:FUNCTION", help="client for pictures")
    parser.add_argument("--writer", metavar="MODULE:FUNCTION", help="client for texts")
    parser.add_argument("--status", action="store_true", help="list the stages, whether each has run and what it lacks")
    parser.add_argument("--step", default="all")
    parser.add_argument("--from", dest="from_number", type=float, default=0.0)
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    stages = catalogue_stages()
    if args.stages != "catalogue":
        from .stages import Settings, curation, workflow

        roots = dict(r.split("=", 1) for r in args.root)
        settings = Settings(spark, roots, export_root=args.export_root, remote=args.remote, vision=client_of(args.vision), writer=client_of(args.writer), album=args.album, max_items=args.max_items)
        stages = (workflow if args.stages == "workflow" else curation)(settings)
    runner = Runner(spark, args.warehouse, stages)
    for line in runner.status() if args.status else runner.run(args.step, args.from_number, args.dry_run):
        print(line)


if __name__ == "__main__":
    main()
