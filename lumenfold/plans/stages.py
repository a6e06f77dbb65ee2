"""The whole workflow as stages: from listings to albums, exports and curated selections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.fixed import TONE_CURVES
from ..operators import grouping, models, tables
from ..sources import readers, sinks
from .runner import Stage, Tables, catalogue_stages


@dataclass(frozen=True)
class Settings:
    """Where files are, where results go, and the model clients; keys and paths come from the caller."""

    spark: SparkSession
    roots: dict[str, str] = field(default_factory=dict)  # label to folder; the first is the primary source
    pruned: tuple[str, ...] = (".thumbs", "@eaDir", ".git", "__pycache__", "node_modules")
    export_root: str = "/export"
    remote: str = "remote"
    vision: Callable[[str, bytes | None], str] | None = None
    writer: Callable[[str, bytes | None], str] | None = None
    least_album: int = 5
    album: str = ""  # curation of albums with this in their name only
    max_items: int | None = None  # rows that a stage may send to a model in one run


def _pictures(s: Settings, rows: DataFrame, path: str) -> DataFrame:
    """Rows with `picture`, the bytes of the file at the path column (null where it is not there), for a client that sees.

    Only files of rows that ask are read; what the client does to them (turning, making smaller, encoding) is `operators.image`'s or its own.
    """
    if not s.roots:
        return rows.withColumn("picture", F.lit(None).cast("binary"))
    files = None
    for root in s.roots.values():
        f = s.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path_"), F.col("content").alias("picture"))
        files = f if files is None else files.unionByName(f)
    return rows.join(files, rows[path] == files["path_"], "left").drop("path_")


def _bounded(s: Settings, rows: DataFrame, order: str) -> DataFrame:
    return rows.orderBy(order).limit(s.max_items) if s.max_items else rows


def _needs(what, name: str) -> Callable[[], str | None]:
    return lambda: None if what else f"{name} is not set"


def workflow(s: Settings) -> list[Stage]:
    """Stages 1 to 9 over files and photos; those in between are the catalogue's own."""

    def scan(_: Tables) -> Tables:
        lists = [readers.listing(s.spark, root, label, list(s.pruned), media_only=False) for label, root in s.roots.items()]
        files = tables.priority_union(lists, ["file_path"])
        media = files.where("media_type <> 'other'")
        beside = readers.sidecars(files).join(files.select(F.col("file_path").alias("json_path")), "json_path").groupBy("file_path").agg(F.min("json_path").alias("json_sidecar_path"))
        return {"files": files, "photos": media.join(beside, "file_path", "left").withColumns({"id": F.xxhash64("file_path"), "has_json_sidecar": F.col("json_sidecar_path").isNotNull().cast("int"), "is_duplicate": F.lit(0)})}

    def merge(t: Tables) -> Tables:
        found = None
        for root in s.roots.values():
            fields = readers.sidecar_fields(readers.documents_at(s.spark, root)).drop("value").withColumnRenamed("path", "json_sidecar_path")
            found = fields if found is None else found.unionByName(fields)
        return {"photos": t["photos"].join(found, "json_sidecar_path", "left").withColumn("best_date", F.col("google_date")).withColumn("json_merged", F.col("google_url").isNotNull().cast("int"))}

    def classify(t: Tables) -> Tables:
        todo = t["photos"].where("is_duplicate = 0 AND media_type = 'image'")
        todo = _pictures(s, _bounded(s, todo.select("id", "file_path", "filename", "country", "city"), "id"), "file_path")
        asked = models.ask(todo, models.prompt_context(("File", "filename"), ("City", "city"), ("Country", "country")), s.vision, F.col("picture"))
        got = models.classified(asked).select("id", F.col("status").alias("ai_processed"), F.col("ai.scene").alias("ai_description"), F.col("ai.type").alias("ai_scene_type"), F.col("ai.tags").alias("ai_tags"))
        return {"classes": got}

    def name(t: Tables) -> Tables:
        asked = models.ask(t["albums"].select("album", "name", "country", "city", "n"), models.prompt_context(("Album", "name"), ("City", "city"), ("Country", "country"), ("Photos", "n")), s.writer)
        new = models.named(asked).where("new_name IS NOT NULL").select("album", F.col("new_name").alias("name"))
        changed = tables.update(t["albums"], new, ["album"]).withColumn("year", F.year("first_ts"))
        return {"albums": grouping.renamed(changed, "name", "year", ["first_ts", "album"]).withColumn("name", F.col("unique_name")).drop("unique_name", "year")}

    def export(t: Tables) -> Tables:
        return {"export": sinks.export_plan(t["photos"].where("is_duplicate = 0"), s.export_root)}

    def upload(t: Tables) -> Tables:
        folders = t["export"].groupBy(F.element_at(F.split("dst", "/"), -2).alias("album_name")).agg(F.count("*").alias("n"))
        m = sinks.upload_manifest(t["albums"].select(F.col("album").alias("id"), "name"), t["photos"].select("album_id", "is_duplicate"), folders)
        return {"upload": m, "commands": sinks.upload_commands(m, s.remote)}

    return [
        Stage(1, "scan", (), scan, ready=_needs(s.roots, "roots")),
        Stage(2, "merge-sidecars", ("photos",), merge, ("sidecars",), ready=_needs(s.roots, "roots")),
        *catalogue_stages(),
        Stage(6, "classify", ("photos",), classify, ready=_needs(s.vision, "vision")),
        Stage(7.5, "name-events", ("albums",), name, ("name",), ready=_needs(s.writer, "writer")),
        Stage(8, "export", ("photos",), export),
        Stage(9, "prep-upload", ("photos", "albums", "export"), upload, ("upload",)),
    ]


def curation(s: Settings) -> list[Stage]:
    """Purge, score, curate, caption and report over album files (album_name, file_path) and their pixels' metrics."""

    def albums(t: Tables) -> DataFrame:
        return t["album_files"].groupBy("album_name").agg(F.count("*").alias("n")).where(F.col("n") >= s.least_album)

    def purge(t: Tables) -> Tables:
        valid = albums(t)
        return {k: tables.keep(t[k], valid, ["album_name"]) for k in ("scores", "curated", "captions")}

    def score(t: Tables) -> Tables:
        todo = tables.keep(t["album_files"], albums(t), ["album_name"]).join(t["scores"], "file_path", "left_anti")
        taken = grouping.systematic_sample(todo, ["album_name"], [F.col("file_path")]).join(t["metrics"], "file_path")
        asked = models.scored(models.ask(_pictures(s, _bounded(s, taken, "file_path"), "file_path"), F.col("file_path"), s.vision, F.col("picture")))
        technical = scores.technical(F.col("sharpness"), F.col("exposure"), (F.least("width", "height") >= 800).cast("double"))
        new = asked.withColumn("technical_score", technical).withColumn("final_score", scores.final(F.col("technical_score"), F.col("ai_score")))
        new = new.select("file_path", "album_name", "technical_score", "ai_score", "ai_mood", "final_score", "exposure_ok", (F.least("width", "height") >= 800).alias("resolution_ok"))
        return {"scores": tables.insert_replace(t["scores"], new, ["file_path"], ["final_score"])}

    def usable(t: Tables) -> DataFrame:
        return t["scores"].where("exposure_ok AND resolution_ok")

    def named(t: Tables) -> Tables:
        """Only albums whose name holds the text that was asked for, if any."""
        return {k: v.where(F.contains(F.lower("album_name"), F.lit(s.album.lower()))) if s.album and "album_name" in v.columns else v for k, v in t.items()}

    def curate(t: Tables) -> Tables:
        best = grouping.segment_best(usable(t), ["album_name"], [F.col("file_path")], "final_score").select("album_name", "file_path", "rank")
        return {"curated": best}

    def edit(t: Tables) -> Tables:
        large = t["scores"].where("resolution_ok")
        ranked = grouping.top_fraction(large, ["album_name"], [F.desc("final_score"), F.col("file_path")])
        mood = grouping.mode_first(t["scores"], ["album_name"], "ai_mood", ["ai_mood"]).withColumn("ai_mood", F.when(F.col("ai_mood").isin(*TONE_CURVES), F.col("ai_mood")).otherwise("flat"))
        return {"edits": ranked.drop("ai_mood").join(mood, "album_name", "left"), "collages": grouping.collage_rows(ranked, ["album_name"], "final_score", "file_path")}

    def caption(t: Tables) -> Tables:
        hero = t["curated"].groupBy("album_name").agg(F.min_by("file_path", "rank").alias("hero")).join(t["captions"], "album_name", "left_anti")
        seen = models.ask(_pictures(s, hero, "hero"), F.col("hero"), s.vision, F.col("picture"))
        written = models.ask(hero, models.prompt_context(("Album", "album_name")), s.writer)
        return {"captions": t["captions"].unionByName(models.captioned(seen, written), allowMissingColumns=True)}

    def package(t: Tables) -> Tables:
        return {"package": sinks.package_plan(t["curated"], t["captions"], s.export_root)}

    def discover(t: Tables) -> Tables:
        return {"potential": potential(albums(t), t["scores"], t["curated"])}

    def summary(t: Tables) -> Tables:
        count = lambda k, c: t[k].groupBy("album_name").agg(F.count("*").alias(c))
        out = albums(t).join(count("scores", "scored"), "album_name", "left").join(count("curated", "chosen"), "album_name", "left").join(count("captions", "captioned"), "album_name", "left").na.fill(0)
        return {"summary": out.withColumn("phase", scores.phase((F.col("captioned") > 0, "ready"), (F.col("chosen") > 0, "curated"), (F.col("scored") > 0, "scored"), otherwise="new"))}

    every = ("album_files", "scores", "curated", "captions")
    within = lambda number, name, inputs, run, *more, **kw: Stage(number, name, inputs, lambda t: run(named(t)), *more, **kw)
    return [
        Stage(0, "discover", every, discover),
        Stage(1, "purge", every, purge),
        within(2, "score", ("album_files", "scores", "metrics"), score, ready=_needs(s.vision, "vision")),
        within(3, "edit", ("scores",), edit),
        within(4, "curate", ("scores",), curate),
        within(6, "caption", ("curated", "captions"), caption, ready=_needs(s.vision and s.writer, "vision or writer")),
        within(7, "package", ("curated", "captions"), package, ("export",)),
        Stage(8, "summary", every, summary),
    ]


def potential(albums: DataFrame, scored: DataFrame, curated: DataFrame) -> DataFrame:
    """Albums by how promising they are: files, mean score, travel words, and what is done already."""
    means = scored.groupBy("album_name").agg(F.avg("final_score").alias("mean"), F.count("*").alias("scored"))
    chosen = curated.groupBy("album_name").agg(F.count("*").alias("chosen"))
    out = albums.join(means, "album_name", "left").join(chosen, "album_name", "left").na.fill(0)
    value = scores.album_potential(F.col("n"), F.col("mean"), text.is_travel(F.col("album_name")), F.col("scored") > 0, F.col("chosen") > 0)
    return out.withColumn("potential", F.round(value, 4)).orderBy(F.desc("potential"), F.desc("album_name"))
