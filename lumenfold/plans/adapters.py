"""Views of the driver's tables in the shapes the operators take, and the same views in SQL.

Only integer arithmetic, CASE and division by the double 1e2 are used, so that both
engines derive the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of dated, partly placed files: orders with their customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("int").alias("library"), F.col("o_orderdate").alias("ts"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("best_date"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 400 END").alias("album_id"),
        F.expr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END").alias("country"),
        F.expr("CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE substr(c_mktsegment, 1, 2) END").alias("cc"),
        F.concat(F.lit("C"), (k % 40).cast("string")).alias("city"),
        F.expr("CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 50 + ((o_custkey * 37) % 300) / 1e2 END").alias("lat"),
        F.expr("CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE -3 + ((o_custkey * 91) % 400) / 1e2 END").alias("lon"),
        F.col("o_totalprice").cast("bigint").alias("size"), F.col("o_orderpriority").alias("tag"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END").alias("is_duplicate"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'primary' ELSE 'secondary' END").alias("source"),
        F.expr("concat('lib', c_nationkey, '/', CASE o_orderkey % 5 WHEN 0 THEN '15 Jun 2019' WHEN 1 THEN '2019:01:02' WHEN 2 THEN 'Japan 2019' WHEN 3 THEN 'Photos from 2018' ELSE '.' END, '/', CASE o_orderkey % 4 WHEN 0 THEN 'IMG_20190615_1015' WHEN 1 THEN 'DSC0' WHEN 2 THEN '2019-02-31_x' ELSE 'PXL_20210101_' END, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.heic' WHEN 3 THEN '.txt' WHEN 4 THEN '.png' ELSE '' END)").alias("path"),
    )


MEDIA = """media AS (SELECT o_orderkey AS id, CAST(c_nationkey AS INTEGER) AS library, o_orderdate AS ts, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS best_date,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 400 END AS album_id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS country,
 CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE substr(c_mktsegment, 1, 2) END AS cc, 'C' || (o_custkey % 40) AS city,
 CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 50 + ((o_custkey * 37) % 300) / 1e2 END AS lat, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE -3 + ((o_custkey * 91) % 400) / 1e2 END AS lon,
 CAST(trunc(o_totalprice) AS BIGINT) AS size, o_orderpriority AS tag, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_duplicate, CASE WHEN o_orderkey % 4 = 0 THEN 'primary' ELSE 'secondary' END AS source,
 concat('lib', c_nationkey, '/', CASE o_orderkey % 5 WHEN 0 THEN '15 Jun 2019' WHEN 1 THEN '2019:01:02' WHEN 2 THEN 'Japan 2019' WHEN 3 THEN 'Photos from 2018' ELSE '.' END, '/', CASE o_orderkey % 4 WHEN 0 THEN 'IMG_20190615_1015' WHEN 1 THEN 'DSC0' WHEN 2 THEN '2019-02-31_x' ELSE 'PXL_20210101_' END, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.heic' WHEN 3 THEN '.txt' WHEN 4 THEN '.png' ELSE '' END) AS path
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer ranked by population: suppliers."""
    s = table(spark, sf_dir, "supplier")
    pop = F.expr("500 + (s_suppkey * 7919) % 100000")
    return s.select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), F.expr("50 + ((s_suppkey * 53) % 300) / 1e2").alias("lat"), F.expr("-3 + ((s_suppkey * 29) % 400) / 1e2").alias("lon"), pop.alias("pop"))


PLACES = "places AS (SELECT s_suppkey AS ord, s_name AS name, 50 + ((s_suppkey * 53) % 300) / 1e2 AS lat, -3 + ((s_suppkey * 29) % 400) / 1e2 AS lon, 500 + (s_suppkey * 7919) % 100000 AS pop FROM supplier)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with content hashes: documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"), F.expr("CASE WHEN doc_id % 5 = 0 THEN '2019:01:02' WHEN doc_id % 5 = 1 THEN 'Trip' WHEN doc_id % 5 = 2 THEN '2019' ELSE source END").alias("parent_dir"), (F.col("n_chars") % 2 == 1).alias("sidecar"), (F.col("lang") == "en").alias("is_primary"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 0.0D ELSE doc_id * 1.0D END").alias("lat"), F.col("n_chars").alias("size"), F.concat("source", F.lit("-"), "lang").alias("filename"))


FILES = "files AS (SELECT doc_id AS id, md5(text) AS hash, CASE WHEN doc_id % 5 = 0 THEN '2019:01:02' WHEN doc_id % 5 = 1 THEN 'Trip' WHEN doc_id % 5 = 2 THEN '2019' ELSE source END AS parent_dir, n_chars % 2 = 1 AS sidecar, lang = 'en' AS is_primary, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE doc_id * 1.0 END AS lat, n_chars AS size, source || '-' || lang AS filename FROM documents)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored files of albums: line items of suppliers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("album"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("l"), F.col("l_partkey").alias("p"), F.date_format("l_shipdate", "yyyyMMdd").alias("d"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") != "R").alias("usable"), F.concat("l_linestatus", "l_returnflag").alias("mood"), F.col("l_quantity").alias("q"))


SCORES = "scores AS (SELECT l_suppkey AS album, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_partkey AS p, strftime(l_shipdate, '%Y%m%d') AS d, l_extendedprice AS score, l_returnflag <> 'R' AS usable, l_linestatus || l_returnflag AS mood, l_quantity AS q FROM lineitem)"
SCORE_ORDER = ["d", "o", "l", "p", "score", "q"]


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered files in directories, some with a date to mend: line items of suppliers."""
    li = table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return li.groupBy(F.col("l_suppkey").alias("dir"), F.col("l_orderkey").alias("number")).agg(F.min(F.struct(F.col("l_linenumber").alias("l"), day.alias("day"))).alias("m")).select("dir", "number", F.concat(F.lit("f"), F.lpad(F.col("number").cast("string"), 9, "0")).alias("name"), F.col("number").alias("id"), F.when(F.col("m.l") % 3 == 0, F.concat("m.day", F.lit("T00:00:00"))).otherwise(F.concat("m.day", F.lit("T10:30:00"))).alias("date"))


SEQUENCE = """sequence AS (SELECT dir, number, 'f' || lpad(CAST(number AS VARCHAR), 9, '0') AS name, number AS id, CASE WHEN l % 3 = 0 THEN day || 'T00:00:00' ELSE day || 'T10:30:00' END AS date
 FROM (SELECT l_suppkey AS dir, l_orderkey AS number, l_linenumber AS l, strftime(l_shipdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, strftime(l_shipdate, '%Y-%m-%d')) AS r FROM lineitem) WHERE r = 1)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60-bit perceptual-hash stand-ins: signs of the first components of an embedding."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(59)), F.lit(0).cast("bigint"), lambda a, i: a * 2 + F.when(F.get("embedding", i) > 0, 1).otherwise(0))
    return e.select(F.col("vec_id").alias("id"), bits.alias("word"))


HASHES = "hashes AS (SELECT vec_id AS id, CAST(list_sum([CASE WHEN embedding[i] > 0 THEN CAST(pow(2, 60 - i) AS BIGINT) ELSE 0 END for i in range(1, 61)]) AS BIGINT) AS word FROM embeddings)"
