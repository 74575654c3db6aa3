"""Feeds and exports: delimited, JSON-lines and XML sources with their checks; snapshots and feeds written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import mercator_to_degrees


def json_lines(spark: SparkSession, path: str, schema: str, tolerated: float = 0.005) -> DataFrame:
    """Rows of a JSON-lines feed; an error where more than that share of its lines is malformed."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    raw = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    n = raw.agg(F.count("*").alias("all"), F.count("j._corrupt_record").alias("bad")).first()
    if n["all"] and n.bad > tolerated * n["all"]:
        raise ValueError(f"{n.bad} of {n['all']} lines are malformed")
    return raw.filter("j._corrupt_record is null").select("j.*").drop("_corrupt_record")


def registry(spark: SparkSession, path: str, schema: str, key: str, sep: str = ",") -> DataFrame:
    """A delimited registry with a header, its strings trimmed, one row a key."""
    df = spark.read.schema(schema).option("header", "true").option("sep", sep).csv(path)
    trimmed = [F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return df.select(*trimmed).filter(F.col(key).isNotNull()).dropDuplicates([key])


def dose_months(spark: SparkSession, path: str) -> DataFrame:
    """monitor, t, usv of CSV months with MM/DD/YYYY times and nanosievert doses; rows without a dose keep null."""
    df = spark.read.schema("monitor string, sampled string, nsv double").option("header", "true").csv(path)
    return df.select("monitor", F.unix_seconds(F.try_to_timestamp("sampled", F.lit("MM/dd/yyyy HH:mm:ss"))).alias("t"), (F.col("nsv") / 1000).alias("usv"))


def geojson_features(pages: DataFrame, body: str, properties: str) -> DataFrame:
    """lon, lat and properties of the point features in pages of GeoJSON text; fails where pages don't add up to numberMatched."""
    schema = f"numberMatched long, features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<{properties}>>>"
    read = pages.select(F.from_json(body, schema).alias("j"))
    total = read.agg(F.max("j.numberMatched").alias("want"), F.sum(F.size("j.features")).alias("got")).first()
    if total.want is not None and total.want != total.got:
        raise ValueError(f"{total.got} features of {total.want}")
    f = read.select(F.explode("j.features").alias("f"))
    return f.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


def rss_items(feeds: DataFrame, body: str) -> DataFrame:
    """title, link, published of the items in RSS text, each item's own: what an item lacks is null. Text that is no XML has none."""
    parsed = F.from_xml(F.col(body), "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>", {"mode": "PERMISSIVE"})
    items = feeds.select(parsed.alias("rss")).select(F.explode("rss.channel.item").alias("i"))
    return items.select("i.title", "i.link", F.col("i.pubDate").alias("published"))


def header_rows(json_table: Column) -> Column:
    """Maps of a JSON table whose first row names the columns."""
    rows = F.from_json(json_table, "array<array<string>>")
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_arrays(rows[0], r))


def ring_centroids(rings: DataFrame, key: str) -> DataFrame:
    """key, lat, lon, n of polygons' rings (array of x, y in EPSG:3857), merged by key."""
    p = rings.select(key, F.explode("ring").alias("p"))
    lat, lon = mercator_to_degrees(F.col("p.x"), F.col("p.y"))
    return p.select(key, lat.alias("lat"), lon.alias("lon")).groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def write_feed(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, replaced as a whole."""
    rows.write.mode("overwrite").json(path)


def replace_days(rows: DataFrame, path: str, day: str) -> None:
    """Only the partitions of days that rows have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def rss_text(rows: DataFrame, title: str, link: str, t: str) -> DataFrame:
    """item, in RSS, of rows with distinct links, the latest of each."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    one = rows.groupBy(link).agg(F.max_by(F.struct(title, t), t).alias("r"))
    return one.select(F.concat(F.lit("<item><title>"), esc(F.col(f"r.{title}")), F.lit("</title><link>"), esc(F.col(link)), F.lit("</link></item>")).alias("item"))
