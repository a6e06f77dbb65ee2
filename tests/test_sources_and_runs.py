import json
import os
import shlex
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from lumenfold.plans import runner
from lumenfold.shipping import ship
from lumenfold.sources import readers, sinks
from lumenfold.streaming import workers
from pyspark.sql import functions as F


@pytest.fixture
def tree(tmp_path):
    for path, content in {
        "Trip/IMG_0001.jpg": "a", "Trip/IMG_0001.jpg.json": json.dumps({"photoTakenTime": {"timestamp": "1560593700"}, "geoData": {"latitude": 1.5, "longitude": 2.5, "altitude": 3}, "people": [{"name": "A"}, {"name": ""}], "url": "u"}),
        "Trip/b.MOV": "b", "Trip/b.MOV.supplemental-metadata.json": "{broken", "Trip/metadata.json": json.dumps({"title": "My trip"}), "2019:01:02/c.png": "c", "2019:01:02/metadata.json": "{}", ".thumbs/d.jpg": "d", "Unsorted 2019/e.jpg": "e", "notes.txt": "n", "top.jpg": "t",
    }.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(content)
    return tmp_path


def test_listing_and_sidecars(spark, tree):
    files = readers.listing(spark, str(tree), "primary", [".thumbs"])
    assert {(r.filename, r.parent_dir, r.media_type) for r in files.collect()} == {("IMG_0001.jpg", "Trip", "image"), ("b.MOV", "Trip", "video"), ("c.png", "2019:01:02", "image"), ("e.jpg", "Unsorted 2019", "image"), ("top.jpg", ".", "image")}
    assert readers.not_yet_catalogued(files, files.where("filename = 'top.jpg'")).count() == 4
    assert {(r.album_name, r.n) for r in readers.event_folders(files, least=2).collect()} == {("Trip", 2)}
    assert [r.parent_dir for r in readers.broken_directories(files).collect()] == ["2019:01:02"]
    every = readers.listing(spark, str(tree), "primary", media_only=False)
    pairs = {(os.path.basename(r.json_path), os.path.basename(r.file_path)) for r in readers.sidecars(every).collect()}
    assert pairs == {("IMG_0001.jpg.json", "IMG_0001.jpg"), ("b.MOV.supplemental-metadata.json", "b.MOV")}
    docs = readers.documents_at(spark, str(tree))
    fields = {os.path.basename(r.path): r for r in readers.sidecar_fields(docs).collect()}
    good = fields["IMG_0001.jpg.json"]
    assert (good.google_date, good.latitude, good.google_people) == ("2019-06-15T10:15:00+00:00", 1.5, ["A"])
    assert fields["b.MOV.supplemental-metadata.json"].google_date is None
    titles = readers.album_titles(docs.where(F.endswith("path", F.lit("/metadata.json"))))
    assert {r.title for r in titles.collect()} == {"My trip", "2019:01:02"}
    assert {r.file_path[-5:]: r.tags for r in readers.exif_tags(files, lambda p: {"DateTimeOriginal": p[-3:]}).collect()}["p.jpg"] == {"DateTimeOriginal": "jpg"}


def test_gazetteer(spark, tmp_path):
    line = lambda n, kind, pop, lat="1": "\t".join(["0", n, "", "", lat, "2", kind, "", "FR", "", "", "", "", "", pop])
    (tmp_path / "g.tsv").write_text("\n".join([line("small", "P", "499"), line("b", "P", "700"), line("a", "A", "900"), line("c", "P", "700"), line("lake", "H", "9000"), "short\tline", line("x", "P", ""), line("bad", "P", "900", "?"), line("B", "P", "600")]))
    places = readers.gazetteer(spark, str(tmp_path / "g.tsv"))
    assert [r.name for r in places.orderBy("ord").collect()] == ["a", "b", "c", "B"]
    assert {r.key: r.pop for r in readers.largest_by_name(places).collect()}["b"] == 700


def test_catalogue_and_resolution(spark):
    f = spark.createDataFrame
    out = readers.catalogue(f([(1, 5, "x", 1), (2, 5, "y", 3)], "id long, album long, name string, status int"), f([(5, "/")], "id long, relativePath string"), f([(1, "2019")], "imageid long, creationDate string"), f([], "imageid long, latitudeNumber double"), f([(1, "m")], "imageid long, make string"))
    assert [(r.name, r.relativePath, r.creationDate, r.latitudeNumber, r.make) for r in out.collect()] == [("x", "/", "2019", None, "m")]
    there = lambda *rows: f(list(rows), "relative string, file_path string")
    got = readers.resolve(f([("a",), ("b",), ("c",)], "relative string"), there(("a", "/1/a")), there(("a", "/2/a"), ("b", "/2/b")))
    assert {r.file_path for r in got.collect()} == {"/1/a", "/2/b"}


def test_logs_and_states(spark, tmp_path):
    (tmp_path / "run.log").write_text("start\ndone 10/200 x\ndone 20/200\n")
    assert [(r.done, r.total) for r in readers.log_counters(spark, str(tmp_path / "run.log")).orderBy("line").collect()] == [(10, 200), (20, 200)]
    states = spark.createDataFrame([('{"a": "completed", "b": "failed", "c": "completed"}',)], "value string")
    assert {r.state: r["count"] for r in readers.upload_states(states).collect()} == {"completed": 2, "failed": 1}


def test_paged_service(spark, monkeypatch):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("=")[1])
            body = json.dumps({"assets": {"nextPage": page + 1 if page < 4 else None, "items": [{"id": f"{page}-{k}", "path": self.headers["x-api-key"]} for k in range(2)]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ship(spark)
    monkeypatch.setenv("SERVICE_KEY", "secret")
    reader = readers.PagedService({"url": f"http://127.0.0.1:{server.server_port}/?page={{page}}", "pages": "3", "items": "assets.items", "fields": "id,path", "key_env": "SERVICE_KEY"}).reader(None)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 6 and rows[0] == ("1-0", "secret")
    reader = readers.PagedService({"url": f"http://127.0.0.1:{server.server_port}/?page={{page}}", "next": "assets.nextPage", "items": "assets.items", "fields": "id"}).reader(None)
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(f"{p}-{k}",) for p in range(1, 5) for k in range(2)]
    spark.dataSource.register(readers.PagedService)
    schema = spark.read.format("paged_service").options(url="http://x/{page}", fields="id,path").load().schema
    assert schema.names == ["id", "path"]
    server.shutdown()


def test_export(spark, tree, tmp_path):
    rows = [(1, str(tree / "Trip/IMG_0001.jpg"), "x.jpg", "A:B", "2019-01-01T00:00:00"), (2, str(tree / "Trip/b.MOV"), "x.jpg", "A:B", "2019-01-02T00:00:00"), (3, str(tree / "top.jpg"), "t.jpg", None, "2018-01-02T00:00:00"), (4, str(tree / "missing.jpg"), "m.jpg", None, None)]
    photos = spark.createDataFrame(rows, "id long, file_path string, filename string, album_name string, best_date string")
    out = str(tmp_path / "out")
    plan = sinks.export_plan(photos, out)
    assert {os.path.relpath(r.dst, out) for r in plan.collect()} == {"A_B/x.jpg", "A_B/x_1.jpg", "Unsorted 2018/t.jpg", "Unsorted Undated/m.jpg"}
    sinks.link_files(plan)
    sinks.link_files(plan)  # again changes nothing
    assert sorted(os.listdir(f"{out}/A_B")) == ["x.jpg", "x_1.jpg"]
    sinks.clear_links(out)
    assert os.listdir(out) == []


def test_reports(spark):
    f = spark.createDataFrame
    albums, photos = f([(1, "One"), (2, "Two:x")], "id long, name string"), f([(1, 0), (1, 0), (1, 1)], "album_id long, is_duplicate int")
    m = sinks.upload_manifest(albums, photos, f([("One", 2)], "album_name string, n long"), part=2)
    assert {(r.name, r.folder, r.file_count, r.exists, r.parts) for r in m.collect()} == {("One", "One", 2, True, 2), ("Two:x", "Two_x", 0, False, 1)}
    assert [r.command for r in sinks.upload_commands(m, "cloud").orderBy("part").collect()] == ["rclone copy 'One' 'cloud:One' --part 1", "rclone copy 'One' 'cloud:One' --part 2"]
    odd = f([("Anna's `trip`", True, 1)], "folder string, exists boolean, parts long")
    assert shlex.split(sinks.upload_commands(odd, "cloud").first().command) == ["rclone", "copy", "Anna's `trip`", "cloud:Anna's `trip`", "--part", "1"]
    more = sinks.with_unsorted(m, f([("Unsorted 2018",), ("Unsorted 2018",), ("One",)], "parent_dir string"))
    assert sinks.manifest_totals(more).first().asDict() == {"albums": 3, "existing": 2, "files": 4}
    assert json.loads(sinks.as_json(m.select("name", "file_count"), "name").first().manifest) == [{"name": "One", "file_count": 2}, {"name": "Two:x", "file_count": 0}]
    tags = sinks.tag_actions(f([("p", "2019-06-15T10:00:00", -1.5, 2.25), ("q", None, None, 1.0)], "file_path string, best_date string, latitude double, longitude double"))
    assert {(r.tag, r.value) for r in tags.collect()} == {("DateTimeOriginal", "2019:06:15 10:00:00"), ("GPSLatitude", "1 30 0"), ("GPSLatitudeRef", "S"), ("GPSLongitude", "2 15 0"), ("GPSLongitudeRef", "E")}
    pack = sinks.package_plan(f([("A", "/p", 3)], "album_name string, file_path string, rank int"), f([("A", "Hi", ["#x", "y"], "alt")], "album_name string, caption string, hashtags array<string>, alt_text string"), "/out")
    assert {(r.dst, r.content) for r in pack.collect()} == {("/out/A/03.jpg", None), ("/out/A/caption.txt", "Hi\n\n#x #y\n\nalt")}
    done = sinks.upsert_progress(f([("1", "old", "t")], "phase string, status string, at string"), "1", "done", "u")
    assert [tuple(r) for r in done.collect()] == [("1", "done", "u")]


def test_merge_of_directories(spark):
    f = spark.createDataFrame
    files = f([("2019:06:15", "a.jpg"), ("2019:06:15", "b.jpg"), ("2019:06:15", "c"), ("2019:6:15", "b.jpg"), ("15 Jun 2019", "a.jpg"), ("15 Jun 2019", "a_m1.jpg"), ("15 Jun 2019", "c"), ("x", "a.jpg")], "parent_dir string, filename string")
    renames = f([("2019:06:15", "15 Jun 2019"), ("2019:6:15", "15 Jun 2019")], "old string, new string")
    got = {(r.old, r.filename): (r.new, r.new_name) for r in sinks.merge_plan(files, renames).collect()}
    to = "15 Jun 2019"
    assert got == {("2019:06:15", "a.jpg"): (to, "a_m2.jpg"), ("2019:06:15", "b.jpg"): (to, "b.jpg"), ("2019:06:15", "c"): (to, "c_m1"), ("2019:6:15", "b.jpg"): (to, "b_m1.jpg")}


def test_pictures_reach_the_client(spark, tree):
    from lumenfold.plans.stages import Settings, _pictures

    path = str(tree / "Trip/IMG_0001.jpg")
    rows = spark.createDataFrame([(path,), (str(tree / "none.jpg"),)], "file_path string")
    got = {r.file_path: r.picture for r in _pictures(Settings(spark, {"primary": str(tree)}), rows, "file_path").collect()}
    assert bytes(got[path]) == (tree / "Trip/IMG_0001.jpg").read_bytes() and got[str(tree / "none.jpg")] is None


def test_runner_over_a_catalogue(spark, tmp_path):
    t0 = datetime(2019, 5, 1, 10)
    rows = [(k, f"/m/IMG_{k:04d}.jpg", "primary", f"IMG_{k:04d}.jpg", "Trip", 10 + k, f"h{k % 9}", (t0 + timedelta(minutes=30 * k)).isoformat(), 48.85 if k % 3 else None, 2.35 if k % 3 else None, None, None, None, None, None, 0, 0, None) for k in range(12)]
    schema = "id long, file_path string, source string, filename string, parent_dir string, file_size long, file_hash string, best_date string, lat double, lon double, country string, country_code string, city string, album_id long, album_name string, has_json_sidecar int, is_duplicate int, duplicate_of long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/photos/source")
    spark.createDataFrame([(0, "Paris", 48.85, 2.35, "FR")], "ord long, name string, lat double, lon double, cc string").write.parquet(f"{tmp_path}/places/source")
    run = runner.Runner(spark, str(tmp_path), runner.catalogue_stages())
    report = run.run()
    assert [r["stage"] for r in report] == ["deduplicate", "fix-dates", "geocode", "guess-locations", "group-albums"]
    photos = spark.read.parquet(f"{tmp_path}/photos/group-albums").collect()
    assert sum(r.is_duplicate for r in photos) == 3
    kept = [r for r in photos if not r.is_duplicate]
    assert {r.country for r in kept} == {"France"} and {r.album_name for r in kept} == {"Paris 2019"} and all(r.lat for r in kept)
    assert [r["stage"] for r in run.run(from_number=4.5, dry_run=True)] == ["guess-locations", "group-albums"]
    assert [r["stage"] for r in run.run("dedup", dry_run=True)] == ["deduplicate"]
    with pytest.raises(ValueError):
        run.run("nothing")
    broken = runner.Stage(1, "x", (), lambda t: {}, ready=lambda: "no mount")
    with pytest.raises(RuntimeError, match="no mount"):
        runner.Runner(spark, str(tmp_path), [broken]).run()


def test_incremental_worker_resumes(spark, tmp_path):
    schema, src, out = "id long, status int", str(tmp_path / "in"), str(tmp_path / "out")
    go = lambda: workers.incremental(spark, src, schema, lambda d: d.withColumn("status", F.lit(1)), out, str(tmp_path / "ck"), 1).awaitTermination()
    spark.createDataFrame([(1, 0), (2, 0)], schema).write.parquet(src)
    go()
    spark.createDataFrame([(3, 0)], schema).write.mode("append").parquet(src)
    go()
    go()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_watcher():
    left, done = [3], []
    assert workers.until_done(lambda: left.append(left.pop() - 1), lambda: left[0], lambda: done.append(1), pause=0) == 3 and done == [1]
    with pytest.raises(RuntimeError):
        workers.until_done(lambda: None, lambda: 2, lambda: None, pause=0)


def test_streamed_place_sessions(spark, tmp_path):
    t = lambda h: datetime(2020, 1, 1) + timedelta(hours=h)
    schema = "user long, ts timestamp, country string"
    parts = [[(1, t(0), "F"), (1, t(1), "F"), (1, t(2), "D"), (2, t(0), "F")], [(1, t(30), "D"), (2, t(31), "F")], [(9, t(500), "x")], [(9, t(501), "x")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = workers.place_sessions(stream, "user", "ts", 10).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = {(r.user, r.start.hour, r.country, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, 0, "F", 2), (1, 2, "D", 1), (2, 0, "F", 1), (1, 6, "D", 1), (2, 7, "F", 1)} <= got


def test_windows_stream_like_batches(spark, tmp_path):
    rows = [(datetime(2020, 1, 1) + timedelta(minutes=7 * k), "ab"[k % 2], float(k)) for k in range(50)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value double").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, workers.windowed(batch, "ts", ["kind"], "1 hour", "30 minutes").collect()))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = workers.windowed(stream, "ts", ["kind"], "1 hour", "30 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == want


def test_whole_workflow(spark, tree, tmp_path):
    from lumenfold.plans.stages import Settings, workflow

    (tree / "places").mkdir()
    house = str(tmp_path / "house")
    spark.createDataFrame([(0, "Paris", 48.85, 2.35, "FR")], "ord long, name string, lat double, lon double, cc string").write.parquet(f"{house}/places/source")
    s = Settings(spark, {"primary": str(tree)}, (".thumbs",), export_root=str(tmp_path / "out"))
    stages = {x.name: x for x in workflow(s)}
    run = runner.Runner(spark, house, list(stages.values()))
    assert run.run("scan")[0]["rows"]["photos"] == 5
    assert run.run("2")[0]["rows"]["photos"] == 5
    merged = spark.read.parquet(f"{house}/photos/merge-sidecars")
    assert {r.filename: (r.best_date, r.json_merged) for r in merged.where("has_json_sidecar = 1").collect()}["IMG_0001.jpg"] == ("2019-06-15T10:15:00+00:00", 1)
    with pytest.raises(RuntimeError, match="vision"):
        run.run("classify")


def test_curation_stages(spark, tmp_path):
    from lumenfold.plans.stages import Settings, curation

    house, f = str(tmp_path), spark.createDataFrame
    files = [("Japan trip", f"/j/{k:02d}.jpg") for k in range(20)] + [("small", "/s/1.jpg")]
    f(files, "album_name string, file_path string").write.parquet(f"{house}/album_files/source")
    f([(p, 10.0 + k, 50.0, True, 1000, 900 if k else 700) for k, (_, p) in enumerate(files)], "file_path string, sharpness double, exposure double, exposure_ok boolean, width int, height int").write.parquet(f"{house}/metrics/source")
    f([], "file_path string, album_name string, technical_score double, ai_score double, ai_mood string, final_score double, exposure_ok boolean, resolution_ok boolean").write.parquet(f"{house}/scores/source")
    f([("gone", "/x", 1)], "album_name string, file_path string, rank long").write.parquet(f"{house}/curated/source")
    f([], "album_name string, caption string, hashtags array<string>, alt_text string").write.parquet(f"{house}/captions/source")

    def client(prompt, picture):
        return '{"instagram_score": 7, "mood": "soft", "caption": "c", "hashtags": ["#a"], "alt_text": "t"}'

    run = runner.Runner(spark, house, curation(Settings(spark, vision=client, writer=client, export_root="/out")))
    report = {r["stage"]: r["rows"] for r in run.run()}
    assert report["purge"] == {"scores": 0, "curated": 0, "captions": 0}
    assert report["score"] == {"scores": 20} and report["curate"] == {"curated": 9} and report["caption"] == {"captions": 1}
    assert report["edit"] == {"edits": 18, "collages": 6} and report["package"] == {"package": 10}
    status = {s["stage"]: s for s in run.status()}
    assert status["curate"] == {"stage": "curate", "written": ["curated"], "lacks": None}
    other = runner.Runner(spark, house, curation(Settings(spark, album="nothing so called", export_root="/out")))
    assert other.run("curate", dry_run=True)[0]["rows"] == {"curated": 0} and other.status()[2]["lacks"] == "vision is not set"
    assert spark.read.parquet(f"{house}/summary/summary").first().phase == "ready"
    assert spark.read.parquet(f"{house}/potential/discover").first().potential > 2.5
