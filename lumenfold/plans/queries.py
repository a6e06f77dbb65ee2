"""Every registered query with its SQL; the names are those of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, scores as sc, text as tx
from ..operators import grouping as gr, nearest as nr, tables as tb, timeline as tl
from .adapters import FILES, HASHES, MEDIA, PLACES, SCORE_ORDER, SCORES, SEQUENCE, files, hashes, media, places, scores, sequence, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


HAVERSINE = "(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"

# Aggregates and reports


@query(f"WITH {MEDIA} SELECT count(*) AS total, count(*) FILTER (lat IS NOT NULL) AS placed, count(*) FILTER (country IS NULL) AS unnamed, CAST(sum(CASE WHEN is_duplicate = 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, min(best_date) AS first_date, max(best_date) AS last_date FROM media")
def catalog_stats(spark, d):
    return media(spark, d).agg(F.count("*").alias("total"), F.count("lat").alias("placed"), F.count_if(F.col("country").isNull()).alias("unnamed"), F.sum(F.when(F.col("is_duplicate") == 1, 1).otherwise(0)).cast("bigint").alias("duplicates"), F.min("best_date").alias("first_date"), F.max("best_date").alias("last_date"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS done, count(*) FILTER (value <= 50 AND value > 10) AS remaining, count(*) FILTER (value <= 10) AS failed, round(100.0 * count(*) FILTER (value > 50) / count(*), 4) AS percent FROM events GROUP BY event_type")
def status_rollup(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(v > 50).alias("done"), F.count_if((v <= 50) & (v > 10)).alias("remaining"), F.count_if(v <= 10).alias("failed"), F.round(F.try_divide(100.0 * F.count_if(v > 50), F.count("*")), 4).alias("percent"))


@query(f"WITH {MEDIA} SELECT library, count(DISTINCT album_id) AS albums, count(DISTINCT city) AS cities FROM media GROUP BY library")
def distinct_albums(spark, d):
    return media(spark, d).groupBy("library").agg(F.count_distinct("album_id").alias("albums"), F.count_distinct("city").alias("cities"))


@query(f"WITH {MEDIA} SELECT source, tag, count(*) AS n, CAST(sum(is_duplicate) AS BIGINT) AS applied FROM media GROUP BY source, tag")
def two_level_group(spark, d):
    return media(spark, d).groupBy("source", "tag").agg(F.count("*").alias("n"), F.sum("is_duplicate").cast("bigint").alias("applied"))


@query(f"WITH {MEDIA} SELECT substr(best_date, 1, 4) AS year, count(*) AS n FROM media WHERE substr(best_date, 1, 4) BETWEEN '1990' AND '2030' GROUP BY 1")
def year_hist(spark, d):
    year = F.substring("best_date", 1, 4)
    return media(spark, d).where(year.between("1990", "2030")).groupBy(year.alias("year")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORES} SELECT album, round(avg(score), 4) AS average, round(avg(q), 4) AS ai, count(*) AS n FROM scores GROUP BY album")
def score_averages(spark, d):
    return scores(spark, d).groupBy("album").agg(F.round(F.avg("score"), 4).alias("average"), F.round(F.avg("q"), 4).alias("ai"), F.count("*").alias("n"))


@query(f"WITH {SCORES}, s AS (SELECT album, count(*) AS scored FROM scores GROUP BY 1), c AS (SELECT album, count(*) AS curated FROM scores WHERE usable AND score > 50000 GROUP BY 1), t AS (SELECT album, count(*) AS captions FROM scores WHERE mood = 'OA' AND album % 2 = 0 GROUP BY 1) SELECT coalesce(s.album, c.album, t.album) AS album, coalesce(scored, 0) AS scored, coalesce(curated, 0) AS curated, coalesce(captions, 0) AS captions, CASE WHEN coalesce(captions, 0) > 0 THEN 'ready' WHEN coalesce(curated, 0) > 0 THEN 'curated' WHEN coalesce(scored, 0) > 0 THEN 'scored' ELSE 'new' END AS phase FROM s FULL JOIN c ON s.album = c.album FULL JOIN t ON coalesce(s.album, c.album) = t.album")
def readiness_matrix(spark, d):
    s = scores(spark, d)
    out = s.groupBy("album").agg(F.count("*").alias("scored"), F.count_if(F.col("usable") & (F.col("score") > 50000)).alias("curated"), F.count_if((F.col("mood") == "OA") & (F.col("album") % 2 == 0)).alias("captions"))
    return out.withColumn("phase", sc.phase((F.col("captions") > 0, "ready"), (F.col("curated") > 0, "curated"), (F.col("scored") > 0, "scored"), otherwise="new"))


@query(f"WITH {MEDIA}, f AS (SELECT CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN '1970-01-01T00:00:00' ELSE best_date END AS b FROM media) SELECT count(*) FILTER (b IS NULL OR substr(b, 1, 4) < '1990') AS bad, count(*) FILTER (b IS NOT NULL AND substr(b, 1, 4) >= '1990' AND substr(b, 12) = '00:00:00') AS low, count(*) FILTER (b IS NOT NULL AND substr(b, 1, 4) >= '1990' AND substr(b, 12) <> '00:00:00') AS good, CAST(100 * count(*) FILTER (b IS NOT NULL AND substr(b, 1, 4) >= '1990' AND substr(b, 12) <> '00:00:00') // count(*) AS BIGINT) AS percent FROM f")
def date_quality(spark, d):
    b = F.expr("CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN '1970-01-01T00:00:00' ELSE best_date END")
    rows = media(spark, d).select(b.alias("b"))
    bad, low = dates.is_bad(F.col("b")), dates.is_low_confidence(F.col("b"))
    good = F.count_if(~low)
    return rows.agg(F.count_if(bad).alias("bad"), F.count_if(low & ~bad).alias("low"), good.alias("good"), F.floor(F.try_divide(100 * good, F.count("*"))).cast("bigint").alias("percent"))


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS customers, (SELECT count(*) FROM lineitem) AS items")
def scalar_subqueries(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    counts = o.agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return counts.withColumn("items", li.agg(F.count("*")).scalar())


# Projections and predicates


@query(f"WITH {MEDIA}, e AS (SELECT id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM media) SELECT id, CASE WHEN ext IN ('jpg', 'png', 'heic') THEN 'image' WHEN ext = 'mp4' THEN 'video' ELSE 'other' END AS media_type FROM e")
def media_type_projection(spark, d):
    return media(spark, d).select("id", tx.media_type(F.col("path")).alias("media_type"))


@query("SELECT c_custkey AS id, CASE WHEN abs(x) > 0.001 THEN x END AS lat, CASE WHEN abs(y) > 0.001 THEN y END AS lon, abs(x) > 0.001 OR abs(y) > 0.001 AS pair_ok FROM (SELECT c_custkey, (c_custkey % 5) / 1e2 AS x, (c_custkey % 3) / 1e2 AS y FROM customer)")
def null_island(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("(c_custkey % 5) / 1e2").alias("x"), F.expr("(c_custkey % 3) / 1e2").alias("y"))
    return c.select("id", geo.off_null_island(F.col("x")).alias("lat"), geo.off_null_island(F.col("y")).alias("lon"), geo.pair_off_null_island(F.col("x"), F.col("y")).alias("pair_ok"))


@query(f"WITH {MEDIA} SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN best_date END, CASE WHEN id % 3 = 0 THEN '2001-01-01T00:00:00' END, '1999-09-09T09:09:09') AS best FROM media")
def best_date_coalesce(spark, d):
    return media(spark, d).select("id", F.coalesce(F.when(F.col("id") % 2 == 0, F.col("best_date")), F.when(F.col("id") % 3 == 0, "2001-01-01T00:00:00"), F.lit("1999-09-09T09:09:09")).alias("best"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(make_timestamp(CAST(json_extract(props, '$.k') AS BIGINT) * 1000000 * 86400), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS taken, list_filter([event_type, ''], lambda x: x <> '')[1] AS person FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 0")
def json_flatten(spark, d):
    e = table(spark, d, "events").withColumn("j", F.from_json("props", "k bigint"))
    people = F.filter(F.array("event_type", F.lit("")), lambda x: x != "")
    return e.where("j.k > 0").select("event_id", F.col("j.k").alias("k"), dates.from_epoch((F.col("j.k") * 86400).cast("string")).alias("taken"), F.get(people, 0).alias("person"))


@query(f"WITH {MEDIA}, f AS (SELECT id, CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '1904-01-01T00:00:00' WHEN 2 THEN substr(best_date, 1, 4) || '-01-01T00:00:00' WHEN 3 THEN replace(best_date, 'T00:00:00', ' 08:09:10') WHEN 4 THEN substr(best_date, 1, 4) ELSE best_date END AS b FROM media) SELECT id, id % 6 IN (0, 1, 4) AS bad, id % 6 IN (0, 1, 4) OR (substr(b, 6) = '01-01T00:00:00') AS default_date, id % 6 <> 3 AS low FROM f")
def bad_date_flags(spark, d):
    b = F.expr("CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN '1904-01-01T00:00:00' WHEN 2 THEN concat(substr(best_date, 1, 4), '-01-01T00:00:00') WHEN 3 THEN replace(best_date, 'T00:00:00', ' 08:09:10') WHEN 4 THEN substr(best_date, 1, 4) ELSE best_date END")
    return media(spark, d).select("id", b.alias("b")).select("id", dates.is_bad(F.col("b")).alias("bad"), dates.is_default(F.col("b")).alias("default_date"), dates.is_low_confidence(F.col("b")).alias("low"))


@query(f"WITH {MEDIA}, n AS (SELECT id, regexp_extract(path, '[^/]*$') AS f FROM media) SELECT id, CASE id % 4 WHEN 0 THEN '2019-06-15T00:00:00' WHEN 3 THEN '2021-01-01T00:00:00' WHEN 2 THEN NULL ELSE strftime(CASE WHEN CAST(substr(regexp_extract(f, '(\\d{{8}})', 1), 1, 4) AS VARCHAR) BETWEEN '1990' AND '2026' THEN try_strptime(regexp_extract(f, '(\\d{{8}})', 1), '%Y%m%d') END, '%Y-%m-%dT%H:%M:%S') END AS taken FROM n")
def filename_date(spark, d):
    return media(spark, d).select("id", dates.from_filename(tx.basename(F.col("path"))).alias("taken"))


@query(f"WITH {MEDIA} SELECT id, CASE id % 5 WHEN 0 THEN '2019-06-15T00:00:00' WHEN 2 THEN '2019-06-15T00:00:00' WHEN 1 THEN '2019-06-15T00:00:00' WHEN 3 THEN '2018-06-15T00:00:00' END AS taken FROM media")
def directory_date(spark, d):
    return media(spark, d).select("id", dates.from_directory(tx.dirname(F.col("path"))).alias("taken"))


CASCADE = "cascade AS (SELECT id, CASE id % 8 WHEN 0 THEN best_date WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00') WHEN 2 THEN strftime(ts, '%Y-%m-%dT10:11:12') WHEN 3 THEN CASE id % 5 WHEN 3 THEN '2018-06-15T00:00:00' WHEN 4 THEN NULL ELSE '2019-06-15T00:00:00' END WHEN 4 THEN best_date WHEN 5 THEN best_date || '+00:00' WHEN 6 THEN CASE WHEN id % 3 = 0 THEN year(ts) || '-06-15T00:00:00' END END AS taken, CASE id % 8 WHEN 0 THEN 'sidecar' WHEN 1 THEN 'filename' WHEN 2 THEN 'exif' WHEN 3 THEN CASE WHEN id % 5 <> 4 THEN 'directory' END WHEN 4 THEN 'neighbour' WHEN 5 THEN 'modified' WHEN 6 THEN CASE WHEN id % 3 = 0 THEN 'model' END END AS method FROM media)"


@query(f"WITH {MEDIA}, {CASCADE} SELECT id, taken, method FROM cascade")
def date_cascade(spark, d):
    m = media(spark, d)
    here = lambda k, c: F.when(F.col("id") % 8 == k, c)
    no = F.lit("1904-01-01T00:00:00")  # a date that no method may give
    picked = dates.cascade(
        ("sidecar", F.coalesce(here(0, F.col("best_date")), no)), ("filename", dates.from_filename(F.coalesce(here(1, F.concat(F.lit("IMG_"), F.date_format("ts", "yyyyMMdd"), F.lit("_101500.jpg"))), F.lit("x.jpg")))),
        ("exif", dates.from_exif(F.coalesce(here(2, F.date_format("ts", "yyyy:MM:dd 10:11:12")), F.lit("0000:00:00 00:00:00")))), ("directory", dates.from_directory(F.coalesce(here(3, tx.dirname(F.col("path"))), F.lit("x")))),
        ("neighbour", here(4, F.col("best_date"))), ("modified", dates.from_modified(here(5, F.col("ts").cast("timestamp")))), ("model", here(6, F.when(F.col("id") % 3 == 0, F.concat(F.year("ts").cast("string"), F.lit("-06-15T00:00:00"))))),
    )
    return m.select("id", picked.alias("picked")).select("id", "picked.taken", "picked.method")


@query(f"WITH {MEDIA}, {CASCADE} SELECT coalesce(method, 'none') AS method, count(*) AS n FROM cascade GROUP BY 1")
def method_histogram(spark, d):
    return date_cascade(spark, d).groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))


@query(f"WITH {MEDIA}, t AS (SELECT id, month(ts) AS m, id % 20 + 1 AS days FROM media) SELECT id, CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m IN (3, 4, 5) THEN 'spring' WHEN m IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, CASE WHEN days = 1 THEN '2-day trip' WHEN days < 7 THEN (days + 1) || '-day trip' WHEN days < 14 THEN ((days + 6) // 7) || '-week trip' ELSE days || ' days' END AS length FROM t")
def season_bucket(spark, d):
    return media(spark, d).select("id", dates.season(F.col("ts")).alias("season"), dates.trip_length(F.col("id") % 20 + 1).alias("length"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '. ') AS safe FROM pages""")
def sanitize_name(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("safe"))


@query(f"WITH {MEDIA}, n AS (SELECT id, upper(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')) AS s FROM media) SELECT id, CAST(coalesce(nullif(regexp_extract(s, '(?:IMG|DSC|DSCN|DSCF|P|PIC|PHOTO|MVI|VID|MOV)[-_]?(\\d{{4,8}})', 1), ''), nullif(regexp_extract(s, '^(\\d{{4,10}})$', 1), '')) AS BIGINT) AS number FROM n")
def img_number(spark, d):
    return media(spark, d).select("id", tx.sequence_number(tx.basename(F.col("path"))).alias("number"))


@query(r"SELECT c_custkey, regexp_matches(n, '(?i)\b(holiday|trip|japan|beach|ski|snow)\b') AS travel FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Japan 2019' WHEN 1 THEN 'skiing' WHEN 2 THEN 'My TRIP' WHEN 3 THEN 'Snow-day' ELSE c_name END AS n FROM customer)")
def travel_regex(spark, d):
    n = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'Japan 2019' WHEN 1 THEN 'skiing' WHEN 2 THEN 'My TRIP' WHEN 3 THEN 'Snow-day' ELSE c_name END")
    return table(spark, d, "customer").select("c_custkey", tx.is_travel(n).alias("travel"))


@query(f"WITH {MEDIA} SELECT id, CASE WHEN country IS NULL THEN city ELSE city || ', ' || country END AS label, coalesce(cc, '??') AS code FROM media WHERE is_duplicate = 0")
def location_labels(spark, d):
    return media(spark, d).where("is_duplicate = 0").select("id", tx.location_label(F.col("city"), F.col("country")).alias("label"), F.coalesce("cc", F.lit("??")).alias("code"))


@query(f"WITH {MEDIA} SELECT id, CASE WHEN album_id IS NULL THEN 'Unsorted ' || substr(best_date, 1, 4) ELSE 'Album_' || album_id END AS target FROM media WHERE is_duplicate = 0")
def export_routing(spark, d):
    album = tx.safe_name(F.concat(F.lit("Album:"), F.col("album_id").cast("string"), F.lit(" .")))
    return media(spark, d).where("is_duplicate = 0").select("id", F.when(F.col("album_id").isNotNull(), album).otherwise(F.concat(F.lit("Unsorted "), dates.year_or_undated(F.col("best_date")))).alias("target"))


@query(r"SELECT conv_id, turn, regexp_extract(t, '\{[\s\S]*\}') AS greedy, regexp_extract(t, '\{[\s\S]*?\}') AS lazy FROM (SELECT conv_id, turn, 'x {' || text || '} y {z} ' || role AS t FROM conversations)")
def json_extractors(spark, d):
    t = F.concat(F.lit("x {"), "text", F.lit("} y {z} "), "role")
    return table(spark, d, "conversations").select("conv_id", "turn", tx.json_greedy(t).alias("greedy"), tx.json_lazy(t).alias("lazy"))


@query("SELECT conv_id, turn, '{\"a\": {\"b\": ' || turn || '}}' AS found FROM conversations")
def json_balanced(spark, d):
    t = F.concat(F.lit('```json\nsee {"a": {"b": '), F.col("turn").cast("string"), F.lit("}} and {c} "), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", tx.json_balanced(t).alias("found"))


@query("SELECT s_suppkey, CAST(floor(a) AS BIGINT) AS deg, CAST(floor((a - floor(a)) * 60) AS BIGINT) AS min, CAST(round(((a - floor(a)) * 60 - floor((a - floor(a)) * 60)) * 60 * 10000) AS BIGINT) AS sec_e4 FROM (SELECT s_suppkey, abs(-3 + ((s_suppkey * 29) % 400) / 1e2) AS a FROM supplier)")
def dms(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", geo.dms(F.expr("-3 + ((s_suppkey * 29) % 400) / 1e2")).alias("x")).select("s_suppkey", "x.*")


@query(f"WITH {PLACES} SELECT a.ord, round({HAVERSINE.format(a='a.', b='b.')}, 4) AS km FROM places a JOIN places b ON b.ord = a.ord + 1")
def haversine(spark, d):
    p = places(spark, d)
    q = p.select((F.col("ord") - 1).alias("ord"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return p.join(q, "ord").select("ord", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


@query("SELECT p_partkey, round(CAST(least(100.0, 0.6 * p_size + 0.3 * (p_partkey % 100) + 20 * (p_partkey % 2)) AS DOUBLE), 1) AS technical, round(least(n / 8.0, 4.0) + p_retailprice / 20 + 2.5 * (p_partkey % 2) + (p_partkey % 3) // 2 + 0.5 * (p_partkey % 2), 4) AS potential FROM (SELECT *, p_partkey % 50 AS n FROM part)")
def potential_score(spark, d):
    k = F.col("p_partkey")
    odd = k % 2 == 1
    return table(spark, d, "part").select("p_partkey", sc.technical(F.col("p_size").cast("double"), (k % 100).cast("double"), (k % 2).cast("double")).alias("technical"), F.round(sc.album_potential(k % 50, F.col("p_retailprice"), odd, k % 3 == 2, odd), 4).alias("potential"))


@query("SELECT doc_id, md5(encode(CAST(n AS VARCHAR)) || array_slice(b, 1, 100) || CASE WHEN n > 200 THEN array_slice(b, n - 99, n) ELSE encode('') END) AS hash FROM (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)")
def content_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", sc.partial_md5(F.octet_length("text"), F.col("text").cast("binary"), chunk=100).alias("hash"))


# Joins


@query("SELECT o_orderkey AS id, o_totalprice AS size, c_name AS album, n_name AS make, r_name AS model FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 1 LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'")
def catalog_join4(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    out = o.where("o_orderstatus = 'F'").join(c, o.o_custkey == c.c_custkey).join(n.where("n_regionkey <> 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size"), F.col("c_name").alias("album"), F.col("n_name").alias("make"), F.col("r_name").alias("model"))


@query("SELECT c_custkey, count(o_orderkey) AS files FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def album_counts_left_residual(spark, d):
    live = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(live, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("files"))


GUESSES = "guesses AS (SELECT id, CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, 1.5 AS glat, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS applied FROM media WHERE lat IS NULL AND id % 2 = 0)"


def _guesses(m: DataFrame) -> DataFrame:
    return m.where("lat IS NULL AND id % 2 = 0").select("id", F.expr("CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END").alias("confidence"), F.lit(1.5).alias("glat"), F.expr("CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END").alias("applied"))


@query(f"WITH {MEDIA}, {GUESSES} SELECT m.id, g.confidence FROM media m LEFT JOIN guesses g ON m.id = g.id WHERE m.lat IS NULL AND (g.id IS NULL OR g.confidence = 'low')")
def needs_guess_or_predicate(spark, d):
    m = media(spark, d)
    return m.where("lat IS NULL").select("id").join(_guesses(m).select("id", "confidence"), "id", "left").where("confidence IS NULL OR confidence = 'low'")


@query(f"WITH {MEDIA}, {GUESSES} SELECT m.id, g.confidence, m.best_date FROM guesses g JOIN media m ON m.id = g.id WHERE g.applied = 0 AND g.confidence IN ('high', 'medium')")
def pending_apply(spark, d):
    m = media(spark, d)
    return _guesses(m).where(F.col("confidence").isin("high", "medium") & (F.col("applied") == 0)).join(m.select("id", "best_date"), "id").select("id", "confidence", "best_date")


@query(f"WITH {MEDIA}, {GUESSES} SELECT library, count(*) AS n FROM media m WHERE lat IS NULL AND NOT EXISTS (SELECT 1 FROM guesses g WHERE g.id = m.id) GROUP BY library")
def anti_unprocessed(spark, d):
    m = media(spark, d)
    return m.where("lat IS NULL").join(_guesses(m), "id", "left_anti").groupBy("library").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def semi_valid(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "supplier").where("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("WITH f AS (SELECT 'Customer#' || lpad(CAST(s_suppkey * 20 AS VARCHAR), 9, '0') AS name, count(*) AS n FROM supplier GROUP BY 1) SELECT name, n, CASE WHEN c_name IS NULL THEN 'create' ELSE 'update' END AS action FROM f LEFT JOIN customer ON name = c_name")
def sync_actions(spark, d):
    f = table(spark, d, "supplier").groupBy(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 20).cast("string"), 9, "0")).alias("name")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit(True).alias("there"))
    return f.join(c, "name", "left").select("name", "n", F.when(F.col("there").isNull(), "create").otherwise("update").alias("action"))


TIMELINE = "q AS (SELECT event_id AS id, ts, user_id % 5 AS album FROM events WHERE event_type = 'view'), r AS (SELECT event_id AS id, ts, user_id % 5 AS album FROM events WHERE event_type = 'purchase')"


@query(f"WITH {TIMELINE}, b AS (SELECT q.id, q.album, r.id AS rid, r.album AS ralbum, abs(epoch_us(r.ts) - epoch_us(q.ts)) AS gap, r.ts < q.ts AS earlier FROM q JOIN r ON abs(epoch_us(r.ts) - epoch_us(q.ts)) <= 24 * 3600000000), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, earlier DESC, CASE WHEN earlier THEN -rid ELSE rid END) AS k FROM b) SELECT q.id, n.rid AS ref_id, round(gap / 1e6, 3) AS seconds, CASE WHEN gap / 3.6e9 <= 0.5 THEN 'high' WHEN gap / 3.6e9 <= 6 AND n.album = ralbum THEN 'high' WHEN gap / 3.6e9 <= 24 AND n.album = ralbum THEN 'medium' WHEN gap / 3.6e9 <= 6 THEN 'medium' END AS confidence FROM q LEFT JOIN n ON q.id = n.id AND k = 1")
def asof_nearest(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", (F.col("user_id") % 5).alias("album"), "event_type", "value")
    q, r = (e.where(c).drop("event_type", "value") for c in ("event_type = 'view'", "event_type = 'purchase'"))
    near = tl.nearest_in_time(q, r, "ts", "id", ["id", "album"])
    same = F.coalesce(F.col("album") == F.col("ref_album"), F.lit(False))
    return near.select("id", "ref_id", F.round("seconds", 3).alias("seconds"), sc.temporal_confidence(F.col("seconds") / 3600, same).alias("confidence"))


@query(f"WITH {MEDIA}, {PLACES}, m AS (SELECT DISTINCT lat, lon FROM media WHERE lat IS NOT NULL), k AS (SELECT m.lat, m.lon, p.ord, p.name, {HAVERSINE.format(a='m.', b='p.')} AS km FROM m, places p), n AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY km >= 1, CASE WHEN km >= 1 THEN km ELSE 0 END, ord) AS r FROM k WHERE km < 50) SELECT m.lat, m.lon, n.ord, n.name, round(n.km, 4) AS km FROM m LEFT JOIN n ON m.lat = n.lat AND m.lon = n.lon AND r = 1")
def reverse_geocode_tiered(spark, d):
    return nr.reverse_geocode(media(spark, d).where("lat IS NOT NULL"), places(spark, d).drop("pop")).select("lat", "lon", "ord", "name", F.round("km", 4).alias("km"))


@query("WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN 'supplier#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') WHEN p_partkey % 10 = 1 THEN '#00000' || p_partkey ELSE p_name END AS name FROM part), e AS (SELECT name, arg_min(s_name, s_suppkey) AS x FROM q JOIN supplier ON lower(name) = lower(s_name) GROUP BY name), l AS (SELECT name, arg_min(s_name, s_suppkey) AS y FROM q JOIN supplier ON contains(lower(name), lower(s_name)) OR contains(lower(s_name), lower(name)) GROUP BY name) SELECT q.name, coalesce(x, y) AS place FROM q LEFT JOIN e ON q.name = e.name LEFT JOIN l ON q.name = l.name")
def fuzzy_place_lookup(spark, d):
    q = table(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 10 = 0 THEN concat('supplier#', lpad(cast(p_partkey as string), 9, '0')) WHEN p_partkey % 10 = 1 THEN concat('#00000', p_partkey) ELSE p_name END").alias("name"))
    return nr.contained_name(q, table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name")))


@query(f"WITH {MEDIA}, p AS (SELECT id, lat + 0.02 AS lat, lon FROM media WHERE lat IS NOT NULL AND id % 10 = 0), r AS (SELECT id, lat, lon, best_date FROM media WHERE lat IS NOT NULL AND id % 10 <> 0), m AS (SELECT p.id, r.best_date AS ref, sqrt((p.lat - r.lat) * (p.lat - r.lat) + (p.lon - r.lon) * (p.lon - r.lon)) AS far, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.lat - r.lat) * (p.lat - r.lat) + (p.lon - r.lon) * (p.lon - r.lon)), r.lat, r.lon, r.id) AS k FROM p, r WHERE sqrt((p.lat - r.lat) * (p.lat - r.lat) + (p.lon - r.lon) * (p.lon - r.lon)) < 0.05) SELECT id, ref, round(far, 6) AS far FROM m WHERE k = 1")
def gps_nearest_good(spark, d):
    m = media(spark, d).where("lat IS NOT NULL")
    p = m.where("id % 10 = 0").select("id", (F.col("lat") + 0.02).alias("lat"), "lon")
    return nr.nearest_within(p, m.where("id % 10 <> 0"), carry="best_date").select("id", "ref", F.round("far", 6).alias("far"))


@query(f"WITH {HASHES}, m AS (SELECT q.id, r.id AS rid, bit_count(xor(q.word, r.word)) AS d FROM hashes q, hashes r WHERE q.id % 2 = 0 AND r.id % 2 = 1), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS k FROM m WHERE d <= 16) SELECT h.id, n.rid AS ref_id, CAST(n.d AS INTEGER) AS distance, CASE WHEN n.d <= 12 THEN 'high' WHEN n.d <= 14 THEN 'medium' WHEN n.d <= 16 THEN 'low' END AS confidence FROM hashes h LEFT JOIN n ON h.id = n.id AND k = 1 WHERE h.id % 2 = 0")
def hamming_nearest(spark, d):
    h = hashes(spark, d)
    near = nr.hamming_nearest(h.where("id % 2 = 0"), h.where("id % 2 = 1"), "word", most=16, bits=60)
    return near.select("id", "ref_id", "distance", sc.similarity_confidence(F.col("distance"), 12, 14, 16).alias("confidence"))


@query(f"WITH {SEQUENCE}, s AS (SELECT * FROM sequence), b AS (SELECT * FROM s WHERE number % 4 = 0 OR date LIKE '%-01-01T00:00:00'), g AS (SELECT * FROM s WHERE number % 4 <> 0 AND date NOT LIKE '%-01-01T00:00:00'), m AS (SELECT b.dir, b.number, g.date, row_number() OVER (PARTITION BY b.dir, b.number ORDER BY abs(g.number - b.number), g.number) AS k FROM b JOIN g ON b.dir = g.dir), n AS (SELECT dir, number, date, row_number() OVER (PARTITION BY dir, number ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY dir, number) AS c FROM m WHERE k <= 20) SELECT dir, number, date AS filled FROM n WHERE i = c // 2")
def neighbor_topk_median(spark, d):
    s = sequence(spark, d)
    rows = s.withColumn("date", F.when(F.col("number") % 4 == 0, F.lit(None)).otherwise(F.col("date")))
    return tl.neighbour_median(rows.select("dir", "number", "id", "date"), ["dir"], "number", "date").select("dir", "number", "filled")


# Duplicates and grouping


@query(f"WITH {FILES} SELECT hash, count(*) AS n, min(id) AS first_id FROM files GROUP BY hash HAVING count(*) > 1")
def dup_groups(spark, d):
    return gr.duplicate_groups(files(spark, d), ["hash"])


@query(f"WITH {FILES} SELECT filename, size, count(*) AS n, min(id) AS first_id FROM files WHERE size > 0 GROUP BY filename, size HAVING count(*) > 1")
def dup_name_size(spark, d):
    return gr.duplicate_groups(files(spark, d).where("size > 0"), ["filename", "size"])


@query(f"WITH {FILES}, s AS (SELECT *, CASE WHEN parent_dir NOT LIKE '%:%' AND NOT regexp_matches(parent_dir, '^[0-9]') AND parent_dir <> '' THEN -20 WHEN parent_dir LIKE '%:%' THEN 50 ELSE 0 END + CASE WHEN sidecar THEN -100 ELSE 0 END + CASE WHEN is_primary THEN -50 ELSE 0 END + CASE WHEN lat <> 0 THEN -5 ELSE 0 END AS pen, count(*) OVER (PARTITION BY hash) AS n FROM files) SELECT id, hash, first_value(id) OVER (PARTITION BY hash ORDER BY pen, id) AS canonical_id, id = first_value(id) OVER (PARTITION BY hash ORDER BY pen, id) AS is_canonical FROM s WHERE n > 1")
def canonical_select(spark, d):
    pen = sc.copy_penalty(F.col("parent_dir"), F.col("sidecar"), F.col("is_primary"), F.col("lat"))
    return gr.canonical(files(spark, d), ["hash"], pen).select("id", "hash", "canonical_id", "is_canonical")


@query(f"WITH {MEDIA}, a AS (SELECT album_id, count(*) AS n, count(lat) AS n_placed, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon, arg_min(country, id) FILTER (lat IS NOT NULL AND country <> '') AS country, arg_min(city, id) FILTER (lat IS NOT NULL AND city <> '') AS city FROM media WHERE album_id IS NOT NULL AND is_duplicate = 0 GROUP BY album_id) SELECT *, CASE WHEN n_placed / n >= 0.7 THEN 'high' ELSE 'medium' END AS confidence FROM a WHERE n_placed / n >= 0.5")
def album_coverage_median(spark, d):
    return gr.album_votes(media(spark, d).where("is_duplicate = 0")).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query(f"WITH {MEDIA}, c AS (SELECT library, city, count(*) AS n, min(struct_pack(t := ts, i := id)) AS f FROM media GROUP BY library, city), r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY n DESC, f) AS k FROM c) SELECT library, city FROM r WHERE k = 1")
def mode_first_tie(spark, d):
    return gr.mode_first(media(spark, d), ["library"], "city", ["ts", "id"])


@query(f"WITH {SCORES}, c AS (SELECT album, mood, count(*) AS n FROM scores GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY n DESC, mood) AS k FROM c) SELECT album, CASE WHEN mood IN ('OA', 'FA', 'ON', 'FN') THEN mood ELSE 'flat' END AS mood FROM r WHERE k = 1")
def mood_mode(spark, d):
    m = gr.mode_first(scores(spark, d), ["album"], "mood", ["mood"])
    return m.select("album", F.when(F.col("mood").isin("OA", "FA", "ON", "FN"), F.col("mood")).otherwise("flat").alias("mood"))


@query(f"WITH {MEDIA} SELECT library, count(*) AS n, list_sort(list(DISTINCT country) FILTER (country IS NOT NULL))[1] AS first_country, len(list(DISTINCT country) FILTER (country IS NOT NULL)) AS n_countries, array_to_string(list_sort(list(DISTINCT country) FILTER (country IS NOT NULL)), ' & ') AS countries, CAST(floor(date_diff('second', min(ts), max(ts)) / 86400) AS BIGINT) AS days, bool_or(country IN ('BUILDING', 'MACHINERY')) AS holiday FROM media GROUP BY library")
def group_profile(spark, d):
    m = media(spark, d)
    out = gr.profile(m, ["library"], "ts", ["ts", "id"]).join(m.groupBy("library").agg(F.bool_or(F.col("country").isin("BUILDING", "MACHINERY")).alias("holiday")), "library")
    return out.select("library", "n", F.get("countries", 0).alias("first_country"), F.size("countries").cast("bigint").alias("n_countries"), F.array_join("countries", " & ").alias("countries"), "days", "holiday")


SESSIONS = f"""s AS (SELECT *, lag(ts) OVER w AS pts, lag(country) OVER w AS pc, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM media WHERE album_id IS NULL AND is_duplicate = 0 WINDOW w AS (PARTITION BY library ORDER BY ts, id)),
 g AS (SELECT *, abs(floor((epoch(ts) - epoch(pts)) / 86400)) AS g, {HAVERSINE.format(a='p', b='')} AS km FROM s),
 j AS (SELECT *, CASE WHEN g <= 2 THEN CASE WHEN country IS NOT NULL AND pc IS NOT NULL THEN country = pc WHEN lat <> 0 AND plat <> 0 THEN km < 150 ELSE g <= 1 END WHEN g <= 5 THEN country IS NOT NULL AND pc IS NOT NULL AND country = pc AND cc <> 'BU' ELSE false END AS same FROM g),
 c AS (SELECT *, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY library ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS cluster FROM j),
 k AS (SELECT *, count(*) OVER (PARTITION BY library, cluster) AS members, min(id) OVER (PARTITION BY library, cluster) AS event FROM c)"""


def _sessions(spark, d) -> DataFrame:
    rows = media(spark, d).where("album_id IS NULL AND is_duplicate = 0")
    out = tl.sessionize(rows, ["library"], home_code="BU")
    return out.withColumn("event", F.min("id").over(Window.partitionBy("library", "cluster")))


@query(f"WITH {MEDIA}, {SESSIONS} SELECT id, library, event, members FROM k WHERE members >= 3")
def sessionize(spark, d):
    return _sessions(spark, d).select("id", "library", "event", "members")


@query(f"""WITH {MEDIA}, {SESSIONS}, e AS (SELECT * FROM k WHERE members >= 3),
 cc AS (SELECT event, country, row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, min(struct_pack(t := ts, i := id))) AS r FROM e WHERE country IS NOT NULL GROUP BY event, country),
 ct AS (SELECT event, city, row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, min(struct_pack(t := ts, i := id))) AS r FROM e GROUP BY event, city),
 p AS (SELECT event, min(ts) AS first_ts, CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT) AS days, list_sort(list(DISTINCT country) FILTER (country IS NOT NULL)) AS cs, count(DISTINCT city) AS nc, count(*) AS n FROM e GROUP BY event),
 m AS (SELECT p.*, cc.country, ct.city FROM p LEFT JOIN cc ON p.event = cc.event AND cc.r = 1 LEFT JOIN ct ON p.event = ct.event AND ct.r = 1),
 a AS (SELECT event, n, first_ts, CASE WHEN len(cs) BETWEEN 2 AND 3 THEN array_to_string(cs, ' & ') WHEN country IS NOT NULL AND country <> 'BUILDING' THEN CASE WHEN city IS NOT NULL AND nc <= 3 THEN city ELSE country END ELSE coalesce(city, strftime(first_ts, '%B')) END || ' ' || year(first_ts) || CASE WHEN days > 7 AND coalesce(country, '') <> 'BUILDING' THEN ' (' || days || ' days)' ELSE '' END AS name FROM m)
 SELECT event, n, name, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY first_ts, event) = 1 THEN name ELSE name || ' (' || strftime(first_ts, '%Y-%m-%d') || ')' END AS unique_name FROM a""")
def album_names(spark, d):
    named = gr.profile(_sessions(spark, d), ["event"], "ts", ["ts", "id"]).withColumn("name", gr.album_name(home="BUILDING"))
    return gr.dated_names(named, "name", "first_ts", ["first_ts", "event"]).select("event", "n", "name", "unique_name")


@query(f"""WITH {SEQUENCE}, q AS (SELECT *, substr(date, 12) <> '00:00:00' AS good FROM sequence), z AS (SELECT *, count(*) OVER (PARTITION BY dir) AS c, sum(CAST(good AS INTEGER)) OVER (PARTITION BY dir) AS gc,
 last_value(CASE WHEN good THEN struct_pack(n := number, d := date) END IGNORE NULLS) OVER (PARTITION BY dir ORDER BY number, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(CASE WHEN good THEN struct_pack(n := number, d := date) END IGNORE NULLS) OVER (PARTITION BY dir ORDER BY number, name ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM q)
 SELECT dir, number, CASE WHEN good OR c < 2 OR gc < 2 THEN NULL WHEN b IS NOT NULL AND a IS NOT NULL THEN CASE WHEN least(number - b.n, a.n - number) <= 50 AND abs(floor((epoch(CAST(a.d AS TIMESTAMP)) - epoch(CAST(b.d AS TIMESTAMP))) / 86400)) <= 7 THEN b.d END WHEN b IS NOT NULL THEN CASE WHEN number - b.n <= 50 THEN b.d END WHEN a IS NOT NULL THEN CASE WHEN a.n - number <= 50 THEN a.d END END AS filled FROM z""")
def sequence_fill(spark, d):
    return tl.fill_from_sequence(sequence(spark, d), ["dir"], "number", "name", "date").select("dir", "number", "filled")


@query(f"""WITH {SEQUENCE}, q AS (SELECT dir % 5 AS lib, number // 400 AS dir, id, dir AS d0, CASE WHEN id % 7 < 4 THEN '2015-03-' || lpad(CAST(id % 27 + 1 AS VARCHAR), 2, '0') || 'T09:00:00' WHEN id % 7 = 4 THEN '2016-01-05T10:00:00' ELSE date END AS date FROM sequence), g AS (SELECT *, substr(date, 12) <> '00:00:00' AS good FROM q),
 c AS (SELECT lib, dir, substr(date, 1, 7) AS ym, count(*) AS n FROM g WHERE good GROUP BY 1, 2, 3), t AS (SELECT lib, dir, count(*) AS al, count(*) FILTER (good) AS gs FROM g GROUP BY 1, 2), w AS (SELECT c.lib, c.dir, ym FROM c JOIN t ON c.lib = t.lib AND c.dir = t.dir WHERE al >= 3 AND n / gs >= 0.6)
 SELECT g.lib, g.dir, id, d0, CASE WHEN NOT good AND ym IS NOT NULL THEN ym || '-' || CASE WHEN day(CAST(date AS TIMESTAMP)) BETWEEN 2 AND 28 THEN lpad(CAST(day(CAST(date AS TIMESTAMP)) AS VARCHAR), 2, '0') ELSE '15' END || 'T12:00:00' END AS filled FROM g LEFT JOIN w ON g.lib = w.lib AND g.dir = w.dir""")
def consensus_month(spark, d):
    date = F.expr("CASE WHEN id % 7 < 4 THEN concat('2015-03-', lpad(cast(id % 27 + 1 as string), 2, '0'), 'T09:00:00') WHEN id % 7 = 4 THEN '2016-01-05T10:00:00' ELSE date END")
    rows = sequence(spark, d).select((F.col("dir") % 5).alias("lib"), F.floor(F.col("number") / 400).alias("dir"), "id", F.col("dir").alias("d0"), date.alias("date"))
    return tl.consensus_month(rows, ["lib", "dir"], "date", share=0.6).drop("date")


# Ranks, samples, chunks, names


def _score_order():
    return [F.col(c) for c in SCORE_ORDER]


ORDERED = f"{SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY {', '.join(SCORE_ORDER)}) - 1 AS r, count(*) OVER (PARTITION BY album) AS n FROM scores WHERE usable)"


@query(f"WITH {ORDERED}, g AS (SELECT *, ((r + 1) * least(n, 9) + n - 1) // n - 1 AS seg FROM o WHERE n >= 3), b AS (SELECT *, row_number() OVER (PARTITION BY album, seg ORDER BY score DESC, r) AS k FROM g) SELECT album, o, l, p, score, CAST(row_number() OVER (PARTITION BY album ORDER BY r) AS BIGINT) AS rank FROM b WHERE k = 1")
def segment_argmax(spark, d):
    return gr.segment_best(scores(spark, d).where("usable"), ["album"], _score_order(), "score").select("album", "o", "l", "p", "score", "rank")


@query(f"WITH {ORDERED}, i AS (SELECT i.range AS i FROM range(150) i), a AS (SELECT DISTINCT album, n FROM o), t AS (SELECT album, CAST(floor(i * (n / 150.0::DOUBLE)) AS BIGINT) AS r FROM a, i WHERE n > 150) SELECT o.album, o, l, p FROM o LEFT JOIN (SELECT DISTINCT * FROM t) x ON o.album = x.album AND o.r = x.r WHERE n <= 150 OR x.r IS NOT NULL")
def systematic_sample(spark, d):
    return gr.systematic_sample(scores(spark, d).where("usable"), ["album"], _score_order()).select("album", "o", "l", "p")


@query(f"WITH {SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY score DESC, {', '.join(SCORE_ORDER)}) - 1 AS r, count(*) OVER (PARTITION BY album) AS n FROM scores) SELECT album, o, l, p, score FROM o WHERE r < greatest(18, floor(n * 0.3))")
def top_fraction(spark, d):
    return gr.top_fraction(scores(spark, d), ["album"], [F.desc("score"), *_score_order()]).select("album", "o", "l", "p", "score")


@query(f"WITH {MEDIA} SELECT id, library, year(ts) AS year, coalesce(lag(year(ts)) OVER w <> year(ts), true) AS starts FROM media WINDOW w AS (PARTITION BY library ORDER BY ts, id)")
def year_control_break(spark, d):
    rows = media(spark, d).withColumn("year", F.year("ts").cast("bigint"))
    return tl.control_break(rows, ["library"], [F.col("ts"), F.col("id")], "year").select("id", "library", "year", "starts")


@query("WITH n AS (SELECT l_suppkey AS dir, l_orderkey AS o, l_linenumber AS l, l_partkey AS p, 'f' || (l_orderkey % 50) || CASE WHEN l_orderkey % 100 = 7 THEN '_1' ELSE '' END || '.jpg' AS name, l_extendedprice AS e FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY o, l, p, e) - 1 AS k FROM n), t AS (SELECT DISTINCT dir, regexp_replace(name, '_1\\.jpg$', '.jpg') AS base FROM n WHERE name LIKE '%\\_1.jpg' ESCAPE '\\') SELECT r.dir, o, l, p, CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.jpg$', '') || '_' || (k + CASE WHEN t.base IS NOT NULL THEN 1 ELSE 0 END) || '.jpg' END AS unique_name FROM r LEFT JOIN t ON r.dir = t.dir AND r.name = t.base")
def collision_suffix(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("dir"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("e"), F.expr("concat('f', l_orderkey % 50, CASE WHEN l_orderkey % 100 = 7 THEN '_1' ELSE '' END, '.jpg')").alias("name"))
    return gr.unique_names(li, ["dir"], "name", ["o", "l", "p", "e"]).select("dir", "o", "l", "p", "unique_name")


@query("WITH r AS (SELECT c_custkey AS id, 'Trip ' || (c_custkey % 40) AS name, 2000 + c_custkey % 3 AS y, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) AS k FROM customer), a AS (SELECT *, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY name, y ORDER BY id) AS n FROM r) SELECT id, CASE WHEN k = 1 THEN name WHEN n = 1 THEN name || ' (' || y || ')' ELSE name || ' (' || y || '-' || n || ')' END AS unique_name FROM a")
def unique_rename(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Trip "), (F.col("c_custkey") % 40).cast("string")).alias("name"), (2000 + F.col("c_custkey") % 3).alias("y"))
    return gr.renamed(c, "name", "y", ["id"]).select("id", "unique_name")


@query(f"WITH {ORDERED} SELECT album, o, l, p, CAST(r // 100 AS BIGINT) AS chunk FROM o")
def chunking(spark, d):
    return gr.chunks(scores(spark, d).where("usable"), ["album"], _score_order(), 100).select("album", "o", "l", "p", "chunk")


@query(f"WITH {MEDIA}, c AS (SELECT library, city, count(*) AS n FROM media GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY n DESC, city) AS k FROM c) SELECT library, string_agg(city, ',' ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY library")
def top5_tags(spark, d):
    return gr.top_terms(media(spark, d), ["library"], "city").select("library", F.array_join("top", ",").alias("top"))


# Set operations and changes


@query("SELECT count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct().agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS v FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier) a FULL JOIN (SELECT c_custkey AS k, c_name AS v FROM customer) b ON a.k = b.k")
def source_priority_union(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return tb.priority_union([a, b], ["k"])


OLD_NEW = "old AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), new AS (SELECT s_suppkey * 20 AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1)"


def _old_new(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return old, table(spark, d, "supplier").groupBy((F.col("s_suppkey") * 20).alias("k")).agg(F.max("s_acctbal").alias("v"))


@query(f"WITH {OLD_NEW} SELECT k, v FROM old UNION ALL SELECT k, v FROM new WHERE k NOT IN (SELECT k FROM old)")
def upsert_ignore(spark, d):
    return tb.insert_ignore(*_old_new(spark, d), ["k"], ["v"])


@query(f"WITH {OLD_NEW} SELECT k, v FROM new UNION ALL SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new)")
def upsert_replace(spark, d):
    return tb.insert_replace(*_old_new(spark, d), ["k"], ["v"])


@query(f"WITH {OLD_NEW} SELECT o.k, CASE WHEN o.v < 0 THEN coalesce(n.v, o.v) ELSE o.v END AS v FROM old o LEFT JOIN new n ON o.k = n.k")
def guarded_update(spark, d):
    return tb.update(*_old_new(spark, d), ["k"], F.col("v") < 0)


@query(f"WITH {OLD_NEW} SELECT o.k, coalesce(n.v, o.v) AS v FROM old o LEFT JOIN new n ON o.k = n.k")
def keyed_update(spark, d):
    return tb.update(*_old_new(spark, d), ["k"])


@query(f"WITH {OLD_NEW} SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new)")
def delete_stale(spark, d):
    old, new = _old_new(spark, d)
    return tb.delete(old, new, ["k"])


@query("WITH t AS (SELECT c_custkey AS id, 'p' || c_custkey AS path, CASE WHEN c_custkey % 4 = 0 THEN 'p' || (c_custkey // 8) ELSE NULL END AS new_path FROM customer), f AS (SELECT new_path, min(id) AS first FROM t WHERE new_path <> path GROUP BY 1) SELECT t.id, CASE WHEN t.new_path IS NULL OR h.path IS NOT NULL OR f.first <> t.id THEN t.path ELSE t.new_path END AS path FROM t LEFT JOIN t h ON t.new_path = h.path LEFT JOIN f ON t.new_path = f.new_path")
def update_or_ignore(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("path"))
    to = F.when(F.col("id") % 4 == 0, F.concat(F.lit("p"), F.floor(F.col("id") / 8).cast("string")))
    return tb.update_ignore(t, "path", to)


@query(f"WITH {MEDIA} SELECT id, replace(path, '2019:01:02', '02 Jan 2019') AS path FROM media")
def path_rewrite(spark, d):
    m = media(spark, d).select("id", "path")
    return tb.rewrite_prefix(m, ["path"], F.lit("2019:01:02"), dates.repaired_directory(F.lit("2019:01:02")))


# Manifests


@query(f"WITH {MEDIA} SELECT album_id AS album, count(*) AS file_count, min(substr(best_date, 1, 4)) AS year FROM media WHERE album_id IS NOT NULL AND is_duplicate = 0 GROUP BY 1")
def manifest_counts(spark, d):
    return media(spark, d).where("album_id IS NOT NULL AND is_duplicate = 0").groupBy(F.col("album_id").alias("album")).agg(F.count("*").alias("file_count"), F.min(F.substring("best_date", 1, 4)).alias("year"))


@query(f"WITH {MEDIA}, m AS (SELECT album_id AS album, count(*) AS file_count FROM media WHERE album_id IS NOT NULL GROUP BY 1) SELECT '[' || string_agg('{{\"album\":' || album || ',\"file_count\":' || file_count || '}}', ',' ORDER BY album) || ']' AS manifest FROM m")
def manifest_json(spark, d):
    from ..sources.sinks import as_json

    m = media(spark, d).where("album_id IS NOT NULL").groupBy(F.col("album_id").alias("album")).agg(F.count("*").alias("file_count"))
    return as_json(m, "album")


@query(f"WITH {MEDIA}, a AS (SELECT year(min(ts)) AS year, 'album ' || album_id AS name, count(*) AS n FROM media WHERE album_id IS NOT NULL GROUP BY album_id) SELECT year, '' AS name, '## ' || year AS line FROM a GROUP BY year UNION ALL SELECT year, name, '- ' || name || ' (' || n || ')' FROM a")
def year_report(spark, d):
    from ..sources.sinks import year_report

    a = media(spark, d).where("album_id IS NOT NULL").groupBy("album_id").agg(F.year(F.min("ts")).cast("bigint").alias("year"), F.count("*").alias("file_count"))
    return year_report(a.select("year", F.concat(F.lit("album "), F.col("album_id").cast("string")).alias("name"), "file_count"))


@query(f"WITH {ORDERED} SELECT album AS album_id, r // 200 AS chunk, count(*) AS n FROM o GROUP BY 1, 2")
def album_requests(spark, d):
    from ..sources.sinks import album_requests

    rows = scores(spark, d).where("usable").select(F.col("album").alias("album_id"), F.concat_ws("/", *SCORE_ORDER).alias("asset_id"))
    ids = F.from_json("body", "ids array<string>")["ids"]
    return album_requests(rows, 200).select("album_id", "chunk", F.size(ids).cast("bigint").alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start_, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    from ..streaming.workers import windowed

    return windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_"), "event_type", "n", F.round("value", 4).alias("value"))


@query("WITH l AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 6 * 3600000000 THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_, count(*) AS n FROM s GROUP BY user_id, k")
def gap_sessions(spark, d):
    from ..streaming.workers import sessions

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", ["user_id"], "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_"), "n")


@query("SELECT a.id, a.p, CASE WHEN a.p < 64 THEN CAST(floor(15 + (68 - 15) * a.p / 64.0) AS BIGINT) WHEN a.p < 128 THEN CAST(floor(68 + (133 - 68) * (a.p - 64) / 64.0) AS BIGINT) WHEN a.p < 192 THEN CAST(floor(133 + (200 - 133) * (a.p - 128) / 64.0) AS BIGINT) ELSE CAST(floor(200 + 55 * (a.p - 192) / 63.0 + 1e-9) AS BIGINT) END AS graded FROM (SELECT p_partkey AS id, p_partkey % 256 AS p FROM part) a")
def lut_grade(spark, d):
    from ..operators.image import graded

    p = (F.col("p_partkey") % 256).cast("int")
    g = F.get(graded(F.array(p), F.lit(0), F.lit("unknown mood")), 0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 256).alias("p"), g.cast("bigint").alias("graded"))


@query("SELECT p_partkey AS id, CASE WHEN w * 5 > h * 4 THEN (w - h * 4 // 5) // 2 ELSE 0 END AS left_, CASE WHEN w * 5 > h * 4 THEN 0 ELSE CAST(floor((h - w * 5 // 4) * 0.38::DOUBLE) AS BIGINT) END AS top, CASE WHEN w * 5 > h * 4 THEN h * 4 // 5 ELSE w END AS width, CASE WHEN w * 5 > h * 4 THEN h ELSE w * 5 // 4 END AS height FROM (SELECT p_partkey, 600 + p_partkey % 700 AS w, 600 + p_partkey % 900 AS h FROM part)")
def crop_geometry(spark, d):
    from ..operators.image import crop_box

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (600 + F.col("p_partkey") % 700).alias("w"), (600 + F.col("p_partkey") % 900).alias("h"))
    b = crop_box(F.col("w"), F.col("h"), 1080, 1350)
    return p.select("id", *(b[c].cast("bigint").alias("left_" if c == "left" else c) for c in ("left", "top", "width", "height")))


@query()
def image_metrics(spark, d):
    """Sharpness, exposure and perceptual hash of synthetic 16 x 16 pictures; tests hold the kernels against plain loops."""
    from ..operators.image import technical_udf
    from ..shipping import ship

    ship(spark)
    # a small file is one task, whatever its pictures cost
    p = table(spark, d, "part").select("p_partkey").repartition(64, "p_partkey")
    p = p.select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (i * (F.col("p_partkey") + 1) % 256).cast("int")).alias("gray"))
    return p.select("p_partkey", technical_udf()("gray", F.lit(16)).alias("m")).select("p_partkey", "m.*")


def _stub(prompt: str, image: bytes | None) -> str:
    return '```json\n{"scene": "' + prompt.split("\n")[0][:20].replace('"', "") + '", "type": "beach", "tags": ["a", "b"], "is_holiday": true}\n```'


@query()
def llm_classify_stub(spark, d):
    """Classification with a client that answers from the prompt alone."""
    from ..operators import models

    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    out = models.classified(models.ask(c, models.prompt_context(("role", "role"), ("id", "conv_id")), _stub))
    return out.select("conv_id", "turn", "status", "ai.scene", "ai.type", F.array_join("ai.tags", ",").alias("tags"))


@query(f"""WITH {MEDIA}, live AS (SELECT * FROM media WHERE is_duplicate = 0), q AS (SELECT * FROM live WHERE lat IS NULL), r AS (SELECT * FROM live WHERE lat IS NOT NULL),
 b AS (SELECT q.id, q.album_id AS qa, r.id AS rid, r.album_id AS ra, r.lat, r.lon, r.country, r.city, epoch_us(r.ts) - epoch_us(q.ts) AS gap FROM q JOIN r ON r.ts BETWEEN q.ts - INTERVAL 24 HOUR AND q.ts + INTERVAL 24 HOUR),
 n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(gap), gap >= 0, CASE WHEN gap < 0 THEN -rid ELSE rid END) AS k, abs(gap) / 3.6e9 AS h, coalesce(qa = ra, false) AS same FROM b),
 t AS (SELECT id, 'temporal' AS strategy, CASE WHEN h <= 0.5 THEN 'high' WHEN h <= 6 AND same THEN 'high' WHEN same THEN 'medium' WHEN h <= 6 THEN 'medium' END AS confidence, lat, lon, country, city FROM n WHERE k = 1),
 v AS (SELECT album_id, count(lat) / count(*) AS share, median(lat) AS lat, median(lon) AS lon, arg_min(country, id) FILTER (lat IS NOT NULL AND country <> '') AS country, arg_min(city, id) FILTER (lat IS NOT NULL AND city <> '') AS city FROM live WHERE album_id IS NOT NULL GROUP BY album_id),
 a AS (SELECT q.id, 'album' AS strategy, CASE WHEN share >= 0.7 THEN 'high' ELSE 'medium' END AS confidence, v.lat, v.lon, v.country, v.city FROM q JOIN v ON q.album_id = v.album_id WHERE share >= 0.5 AND q.id NOT IN (SELECT id FROM t WHERE confidence IS NOT NULL))
 SELECT id, strategy, confidence, round(lat, 6) AS lat, round(lon, 6) AS lon, country, city FROM (SELECT * FROM t WHERE confidence IS NOT NULL UNION ALL SELECT * FROM a)""")
def location_inference(spark, d):
    """The chain of strategies over the catalogue: one guess a photo."""
    from ..operators.inference import GUESS, infer

    m = media(spark, d)
    empty = m.select("id", F.lit("").alias("strategy"), F.lit("").alias("confidence"), "lat", "lon", "country", "city").limit(0)
    return infer(m, empty, ("temporal", "album")).select(*GUESS).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


from . import reports  # noqa: E402, F401  registers the others
