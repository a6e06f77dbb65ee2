"""Further registered queries with their SQL: documents beside files, folders, manifests, replies of models, plans and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text as tx
from ..functions.fixed import COUNTRY_ALIASES, COUNTRY_NAMES
from ..operators import grouping as gr, models, tables as tb
from ..sources import readers, sinks
from .adapters import MEDIA, SCORES, media, scores, table
from .queries import query

# Sources


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS google_date, CASE WHEN event_id % 5 <> 0 THEN (event_id % 90) / 1e2 + 1 END AS latitude, CASE WHEN event_id % 5 <> 0 THEN (event_id % 180) / 1e2 + 1 END AS longitude, nullif(event_type, 'view') AS google_description, event_type AS person, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_people, 'u' || event_id AS google_url FROM events")
def sidecar_documents(spark, d):
    e = table(spark, d, "events")
    seconds = lambda ts: F.unix_seconds(ts.cast("timestamp")).cast("string")
    taken = F.when(F.col("event_id") % 3 == 0, "-5").when((F.col("event_id") % 3 == 1) & (F.col("event_id") % 2 == 0), seconds(F.col("ts"))).otherwise("0")
    created = F.when(F.col("event_id") % 3 == 0, "junk").otherwise(seconds(F.date_trunc("day", "ts")))
    lat, lon = F.expr("CASE WHEN event_id % 5 = 0 THEN 0D ELSE (event_id % 90) / 1e2 + 1 END"), F.expr("CASE WHEN event_id % 5 = 0 THEN 0D ELSE (event_id % 180) / 1e2 + 1 END")
    stamp = lambda c: F.struct(c.alias("timestamp"))
    people = F.when(F.col("event_id") % 7 == 0, F.array(F.struct(F.lit("").alias("name")))).otherwise(F.array(F.struct(F.lit("").alias("name")), F.struct(F.col("event_type").alias("name"))))
    value = F.to_json(F.struct(stamp(taken).alias("photoTakenTime"), stamp(created).alias("creationTime"), F.struct(lat.alias("latitude"), lon.alias("longitude"), F.lit(3.0).alias("altitude")).alias("geoData"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("description"), people.alias("people"), F.concat(F.lit("u"), "event_id").alias("url")))
    out = readers.sidecar_fields(e.select("event_id", "event_type", value.alias("value")))
    return out.select("event_id", "google_date", "latitude", "longitude", "google_description", F.col("event_type").alias("person"), F.size("google_people").cast("bigint").alias("n_people"), "google_url")


@query("SELECT CASE c_custkey % 4 WHEN 3 THEN 'lib/Trip ' || c_custkey WHEN 1 THEN 'lib/Trip ' || c_custkey ELSE 'lib/Trip ' || c_custkey END AS dir, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Trip ' || c_custkey ELSE c_mktsegment END AS title FROM customer WHERE c_custkey % 4 <> 3")
def album_titles(spark, d):
    c = table(spark, d, "customer")
    title = F.expr("CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN NULL WHEN 3 THEN '' ELSE c_mktsegment END")
    return readers.album_titles(c.select(F.concat(F.lit("lib/Trip "), "c_custkey", F.lit("/metadata.json")).alias("path"), F.to_json(F.struct(title.alias("title"))).alias("value")))


@query("SELECT 'a/f' || p_partkey || '.jpg.json' AS json_path, 'a/f' || p_partkey || '.jpg' AS file_path FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'a/f' || p_partkey || '.jpg.supplemental-metadata.json', 'a/f' || p_partkey || '.jpg' FROM part WHERE p_partkey % 4 = 1")
def sidecar_pairs(spark, d):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('f', p_partkey, '.jpg.json') WHEN 1 THEN concat('f', p_partkey, '.jpg.supplemental-metadata.json') WHEN 2 THEN 'metadata.json' ELSE concat('f', p_partkey, '.jpg') END")
    return readers.sidecars(table(spark, d, "part").select(name.alias("filename"), F.concat(F.lit("a/"), name).alias("file_path")))


@query("SELECT o_orderkey AS id, o_custkey AS album, o_totalprice AS price, c_name AS caption FROM orders LEFT JOIN customer ON o_orderkey = c_custkey WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0")
def external_catalogue(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    images = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("album"), (F.col("o_orderstatus") == "F").cast("int").alias("status"))
    albums = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("relativePath"))
    information, positions = o.select(F.col("o_orderkey").alias("imageid"), F.col("o_totalprice").alias("price")), c.select(F.col("c_custkey").alias("imageid"), F.col("c_name").alias("caption"))
    metadata = o.select(F.col("o_orderkey").alias("imageid"), F.col("o_orderdate").alias("taken"))
    return readers.catalogue(images, albums, information, positions, metadata).select("id", "album", "price", "caption")


@query("SELECT w.k AS relative, coalesce(a.v, b.v) AS found FROM (SELECT p_partkey AS k FROM part) w LEFT JOIN (SELECT s_suppkey * 3 AS k, 'p' || s_suppkey AS v FROM supplier) a ON w.k = a.k LEFT JOIN (SELECT c_custkey * 2 AS k, 's' || c_custkey AS v FROM customer) b ON w.k = b.k WHERE a.k IS NOT NULL OR b.k IS NOT NULL")
def resolved_paths(spark, d):
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("relative"))
    primary = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("relative"), F.concat(F.lit("p"), "s_suppkey").alias("found"))
    secondary = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("relative"), F.concat(F.lit("s"), "c_custkey").alias("found"))
    return readers.resolve(wanted, primary, secondary)


@query("SELECT o_orderkey AS file_path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def not_yet_catalogued(spark, d):
    known = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("file_path"))
    return readers.not_yet_catalogued(table(spark, d, "orders").select(F.col("o_orderkey").alias("file_path")), known)


@query(f"WITH {MEDIA}, f AS (SELECT string_split(path, '/')[1] AS folder FROM media) SELECT folder AS album_name, count(*) AS n FROM f WHERE folder <> '.' AND folder NOT LIKE 'lib1%' GROUP BY folder HAVING count(*) >= 3")
def event_folders(spark, d):
    return readers.event_folders(media(spark, d).select(tx.dirname(F.col("path")).alias("parent_dir")), "lib1", 3)


@query("SELECT CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE event_type END AS state, count(*) AS count FROM events GROUP BY 1")
def upload_states(spark, d):
    state = F.when(F.col("event_id") % 9 == 0, "failed").otherwise(F.col("event_type"))
    return readers.upload_states(table(spark, d, "events").select(F.to_json(F.create_map(F.col("event_id").cast("string"), state)).alias("value")))


@query(f"WITH {MEDIA} SELECT DISTINCT '2019:01:' || lpad(CAST(id % 31 + 1 AS VARCHAR), 2, '0') AS old, lpad(CAST(id % 31 + 1 AS VARCHAR), 2, '0') || ' Jan 2019' AS new FROM media WHERE id % 2 = 0")
def directory_renames(spark, d):
    name = F.expr("CASE WHEN id % 2 = 0 THEN concat('2019:01:', lpad(cast(id % 31 + 1 as string), 2, '0')) ELSE concat('Trip ', id % 50) END")
    return sinks.rename_plan(readers.broken_directories(media(spark, d).select(name.alias("parent_dir"))))


@query("SELECT lower(p_type) AS key, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS ord FROM part GROUP BY 1")
def largest_by_name(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_name").alias("of"), F.col("p_partkey").alias("ord"))
    return readers.largest_by_name(p).select("key", F.col("of").alias("name"), "ord")


# Functions


def _values(pairs: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in pairs.items()) + ")"


CODES = list(COUNTRY_NAMES) + ["XX"]
NAMES = [*list(COUNTRY_NAMES.values())[::2], *COUNTRY_ALIASES, "Nowhere"]


@query(f"WITH n AS (SELECT c_custkey AS id, list_value({', '.join(repr(c) for c in CODES)})[c_custkey % {len(CODES)} + 1] AS code, list_value({', '.join(repr(c) for c in NAMES)})[c_custkey % {len(NAMES)} + 1] AS name FROM customer), t AS (SELECT * FROM {_values(COUNTRY_NAMES)} t(c, v)), a AS (SELECT * FROM {_values(COUNTRY_ALIASES)} a(v, c)) SELECT n.id, coalesce(t.v, n.code) AS country, coalesce(a.c, u.c) AS code FROM n LEFT JOIN t ON n.code = t.c LEFT JOIN a ON upper(n.name) = a.v LEFT JOIN t u ON upper(n.name) = upper(u.v)")
def country_tables(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("id") % len(xs)).cast("int"))
    return c.select("id", tx.country_name(pick(CODES)).alias("country"), tx.country_code(pick(NAMES)).alias("code"))


@query("SELECT conv_id, turn, CASE WHEN length(t) BETWEEN 4 AND 79 THEN t END AS name, '#' || role || ' #x' AS tags, CAST(turn AS BIGINT) AS number, repeat('█', CAST(turn % 6 * 4 AS INTEGER)) || repeat('░', 20 - CAST(turn % 6 * 4 AS INTEGER)) AS bar FROM (SELECT *, trim(regexp_replace(replace(trim(text, ' ' || chr(10) || chr(9) || '\"'''), '*', ''), '\\s+', ' ', 'g')) AS t FROM conversations)")
def reply_texts(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.album_name_reply(F.col("text")).alias("name"), tx.hashtags(F.array(F.concat(F.lit("#"), "role"), F.lit("x"))).alias("tags"), tx.numeric_prefix(F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(" rows"))).alias("number"), tx.progress_bar(F.col("turn") % 6, F.lit(5)).alias("bar"))


@query(f"WITH {MEDIA} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT10:11:12') END AS exif, CASE id % 4 WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d 10:11:12') END AS lenient, CASE WHEN id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS mtime FROM media")
def date_texts(spark, d):
    m = media(spark, d)
    exif = F.when(F.col("id") % 3 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("ts", "yyyy:MM:dd 10:11:12"))
    lenient = F.when(F.col("id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'10:11:12.5")).when(F.col("id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd 10:11:12")).when(F.col("id") % 4 == 2, F.date_format("ts", "yyyy:MM:dd 10:11:12")).otherwise("yesterday")
    changed = F.when(F.col("id") % 5 == 0, F.to_timestamp(F.lit("1980-01-01 00:00:00"))).otherwise(F.col("ts").cast("timestamp"))
    return m.select("id", dates.from_exif(exif).alias("exif"), F.date_format(dates.lenient(lenient), "yyyy-MM-dd HH:mm:ss").alias("lenient"), dates.from_modified(changed).alias("mtime"))


# Replies of models


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 AND y BETWEEN 1990 AND 2026 THEN y || '-06-15T00:00:00' END AS ai_date FROM (SELECT o_orderkey, 1980 + o_orderkey % 60 AS y FROM orders)")
def dated_replies(spark, d):
    reply = F.concat(F.lit('Sure: {"year": '), (1980 + F.col("o_orderkey") % 60).cast("string"), F.lit(', "confidence": "'), F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("o_orderkey") % 3).cast("int")), F.lit('", "reason": "x"} {}'))
    return models.dated(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), reply.alias("reply"))).select("id", "ai_date")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 5.0 ELSE (o_orderkey % 100) / 1e1 END AS ai_score, CASE WHEN o_orderkey % 4 = 0 THEN 'flat' ELSE o_orderpriority END AS ai_mood FROM orders")
def scored_replies(spark, d):
    reply = F.when(F.col("o_orderkey") % 4 == 0, "no idea").otherwise(F.concat(F.lit('{"instagram_score": '), (F.col("o_orderkey") % 100 / F.lit(1e1)).cast("string"), F.lit(', "mood": "'), "o_orderpriority", F.lit('"}')))
    return models.scored(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), reply.alias("reply"))).select("id", "ai_score", "ai_mood")


@query("SELECT c_name AS album_name, CASE WHEN c_custkey % 3 = 0 THEN 'seen ' || c_custkey WHEN c_custkey % 3 = 1 THEN 'written ' || c_custkey END AS caption, CASE WHEN c_custkey % 3 = 0 THEN 's,t' WHEN c_custkey % 3 = 1 THEN 'w' END AS tags FROM customer WHERE c_custkey % 3 <> 2 OR c_custkey % 2 = 0")
def captions_of_albums(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_name", "album_name")
    said = lambda kind, tags: F.to_json(F.struct(F.concat(F.lit(f"{kind} "), "c_custkey").alias("caption"), F.array(*map(F.lit, tags)).alias("hashtags")))
    seen = c.where("c_custkey % 3 = 0").select("album_name", said("seen", "st").alias("reply"))
    written = c.where("c_custkey % 3 = 1 OR c_custkey % 2 = 0").select("album_name", F.when(F.col("c_custkey") % 3 == 2, "sorry").otherwise(said("written", "w")).alias("reply"))
    return models.captioned(seen, written).select("album_name", "caption", F.array_join("hashtags", ",").alias("tags"))


@query(f"WITH {MEDIA} SELECT id, concat_ws(chr(10), CASE WHEN city <> '' THEN 'City: ' || city END, CASE WHEN country IS NOT NULL THEN 'Country: ' || country END, 'File: ' || id) AS prompt FROM media")
def prompt_context(spark, d):
    return media(spark, d).select("id", models.prompt_context(("City", "city"), ("Country", "country"), ("File", "id")).alias("prompt"))


# Plans and reports

GUESSED = "guessed AS (SELECT id AS file_path, id % 10 + 0.5 AS lat, id % 7 + 0.5 AS lon, 'X' AS country, 'Y' AS city, CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS applied FROM media WHERE id % 2 = 0)"


@query(f"WITH {MEDIA}, {GUESSED} SELECT m.id AS file_path, CASE WHEN m.lat IS NULL THEN g.lat ELSE m.lat END AS lat, CASE WHEN m.lat IS NULL THEN coalesce(g.city, m.city) ELSE m.city END AS city, CASE WHEN a.confidence IN ('high', 'medium') THEN 1 ELSE a.applied END AS applied FROM media m LEFT JOIN guessed g ON m.id = g.file_path AND g.applied = 0 AND g.confidence IN ('high', 'medium') LEFT JOIN guessed a ON m.id = a.file_path")
def applied_guesses(spark, d):
    m = media(spark, d).withColumn("file_path", F.col("id"))
    g = m.where("id % 2 = 0").select("file_path", F.expr("id % 10 + 0.5D").alias("lat"), F.expr("id % 7 + 0.5D").alias("lon"), F.lit("X").alias("country"), F.lit("Y").alias("city"), F.expr("CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END").alias("confidence"), F.expr("CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END").alias("applied"))
    photos, done = tb.apply_guesses(m, g, ["high", "medium"])
    return photos.select("file_path", "lat", "city").join(done.select("file_path", "applied"), "file_path", "left")


RATIONAL = "CAST(floor(abs({x})) AS BIGINT) || ' ' || CAST(floor((abs({x}) - floor(abs({x}))) * 60) AS BIGINT) || ' ' || CAST(round(((abs({x}) - floor(abs({x}))) * 60 - floor((abs({x}) - floor(abs({x}))) * 60)) * 60 * 10000) AS BIGINT)"


@query(f"WITH {MEDIA} SELECT id AS file_path, 'DateTimeOriginal' AS tag, strftime(ts, '%Y:%m:%d %H:%M:%S') AS value FROM media UNION ALL SELECT id, 'GPSLatitude', {RATIONAL.format(x='lat')} FROM media WHERE lat IS NOT NULL UNION ALL SELECT id, 'GPSLatitudeRef', 'N' FROM media WHERE lat IS NOT NULL UNION ALL SELECT id, 'GPSLongitude', {RATIONAL.format(x='lon')} FROM media WHERE lat IS NOT NULL UNION ALL SELECT id, 'GPSLongitudeRef', CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END FROM media WHERE lat IS NOT NULL")
def tag_actions(spark, d):
    return sinks.tag_actions(media(spark, d).select(F.col("id").alias("file_path"), "best_date", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))


MANIFEST = "albums AS (SELECT c_custkey AS id, 'Trip: ' || c_custkey AS name FROM customer), live AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1), m AS (SELECT name, coalesce(n, 0) AS file_count, 'Trip_ ' || id AS folder, id % 3 = 0 AS exists_, coalesce(n, 0) // 5 + 1 AS parts FROM albums LEFT JOIN live ON id = o_custkey)"


def _manifest(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Trip: "), "c_custkey").alias("name"))
    photos = table(spark, d, "orders").select(F.col("o_custkey").alias("album_id"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("is_duplicate"))
    return sinks.upload_manifest(c, photos, c.where("id % 3 = 0").select(F.concat(F.lit("Trip_ "), "id").alias("album_name")), part=5)


@query(f"WITH {MANIFEST} SELECT name, file_count, folder, exists_, parts FROM m")
def upload_manifest(spark, d):
    return _manifest(spark, d).withColumnRenamed("exists", "exists_")


@query(f"WITH {MANIFEST} SELECT folder, CAST(part AS BIGINT) AS part, 'rclone copy ''' || folder || ''' ''remote:' || folder || ''' --part ' || part AS command FROM (SELECT *, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS part FROM m WHERE exists_)")
def upload_commands(spark, d):
    return sinks.upload_commands(_manifest(spark, d), "remote").withColumn("part", F.col("part").cast("bigint"))


@query("WITH t AS (SELECT event_id AS line, (event_id * 3) % 100000 AS done FROM events ORDER BY event_id DESC LIMIT 20) SELECT arg_max(done, line) AS done, 100000 AS total, round((arg_max(done, line) - arg_min(done, line)) / (count(*) - 1.0::DOUBLE), 6) AS rows_a_line, (100000 - arg_max(done, line)) * 0.5::DOUBLE AS seconds_left FROM t")
def eta(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("line"), (F.col("event_id") * 3 % 100000).alias("done"), F.lit(100000).cast("bigint").alias("total"))
    # the first of the tail by line, as counters may start again
    return gr.eta(e, "line", 0.5).withColumn("rows_a_line", F.round("rows_a_line", 6))


@query(f"WITH {SCORES}, f AS (SELECT album, concat_ws('/', o, l, p) AS f, score FROM scores WHERE usable), r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY score DESC, f) - 1 AS cell, count(*) OVER (PARTITION BY album) AS n FROM f) SELECT album, f, cell FROM r WHERE n >= 6 AND cell < 6")
def collage_rows(spark, d):
    rows = scores(spark, d).where("usable").select("album", F.concat_ws("/", "o", "l", "p").alias("f"), "score")
    return gr.collage_rows(rows, ["album"], "score", "f").select("album", "f", "cell")


@query("SELECT c_name AS album_name, '/out/' || c_name || '/' || lpad(CAST(c_custkey % 9 + 1 AS VARCHAR), 2, '0') || '.jpg' AS dst, 'f' || c_custkey AS src, NULL AS content FROM customer UNION ALL SELECT c_name, '/out/' || c_name || '/caption.txt', NULL, concat_ws(chr(10) || chr(10), 'about ' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '#a #b' END, 'alt') FROM customer WHERE c_custkey % 4 < 2")
def package_plan(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_name", "album_name")
    curated = c.select("album_name", (F.col("c_custkey") % 9 + 1).alias("rank"), F.concat(F.lit("f"), "c_custkey").alias("file_path"))
    captions = c.where("c_custkey % 4 < 2").select("album_name", F.concat(F.lit("about "), "c_custkey").alias("caption"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("#b"))).otherwise(F.array().cast("array<string>")).alias("hashtags"), F.lit("alt").alias("alt_text"))
    return sinks.package_plan(curated, captions, "/out")


POTENTIAL = "albums AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'Trip ' || s_suppkey ELSE s_name END AS album_name, s_suppkey % 50 AS n FROM supplier), m AS (SELECT l_suppkey AS k, avg(l_quantity) AS mean, count(*) AS scored FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1), c AS (SELECT l_suppkey AS k, count(*) AS chosen FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY 1)"


@query(f"WITH {POTENTIAL} SELECT album_name, n, coalesce(scored, 0) AS scored, coalesce(chosen, 0) AS chosen, round(least(n / 8.0::DOUBLE, 4.0) + coalesce(mean, 0) / 20 + CASE WHEN k % 3 = 0 THEN 2.5 ELSE 0 END + CASE WHEN coalesce(scored, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(chosen, 0) > 0 THEN 0.5 ELSE 0 END, 4) AS potential FROM albums LEFT JOIN m USING (k) LEFT JOIN c USING (k)")
def album_potential(spark, d):
    from .stages import potential

    s, li = table(spark, d, "supplier"), table(spark, d, "lineitem")
    named = s.select(F.col("s_suppkey").alias("k"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat('Trip ', s_suppkey) ELSE s_name END").alias("album_name"), (F.col("s_suppkey") % 50).alias("n"))
    rows = li.join(F.broadcast(named.select("k", "album_name")), F.col("l_suppkey") == F.col("k"))
    scored = rows.where("k % 4 <> 0").select("album_name", F.col("l_quantity").alias("final_score"))
    return potential(named.drop("k"), scored, rows.where("k % 5 = 0").select("album_name")).select("album_name", "n", "scored", "chosen", "potential")
