"""Queries on texts: term buckets, cleaning, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.canonical import canonical_digest
from ..functions.text import clean_html, term_pattern, title_key
from ..plans import detectors
from . import query, r6

#: A generic test vocabulary.
TERMS = ("license", "token", "the", "und", "los", "les")


def sql_pattern(term: str) -> str:
    return term_pattern(term).replace("'", "''")


BUCKETS = "bk AS (" + " UNION ALL ".join(f"SELECT lang, source, '{t}' AS term, count(*) AS posts FROM documents WHERE regexp_matches(lower(text), '{sql_pattern(t)}') GROUP BY 1, 2" for t in TERMS) + ")"


@query("lexical_buckets", f"WITH {BUCKETS} SELECT * FROM bk")
def lexical_buckets(spark, sf_dir):
    return detectors.term_buckets(A.table(spark, sf_dir, "documents"), list(TERMS), "text", ["lang", "source"])


@query("lexical_zero_fill", f"WITH {BUCKETS}, ac AS (SELECT DISTINCT lang, source FROM documents) SELECT ac.lang, ac.source, t.term, coalesce(bk.posts, 0) AS posts FROM ac CROSS JOIN (SELECT unnest({list(TERMS)}) AS term) t LEFT JOIN bk ON bk.lang = ac.lang AND bk.source = ac.source AND bk.term = t.term")
def lexical_zero_fill(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return detectors.zero_filled(detectors.term_buckets(d, list(TERMS), "text", ["lang", "source"]), d.select("lang", "source").distinct(), terms, ["lang", "source"], "posts")


@query("lexical_bursts")
def lexical_bursts(spark, sf_dir):
    """Events as posts: hours with far more of a type than the same hours of the days before."""
    e = A.events(spark, sf_dir)
    h = e.groupBy(F.lit("events").alias("stream"), F.col("event_type").alias("place"), (F.col("t") - F.pmod("t", F.lit(3600))).alias("hour")).agg(F.count("*").alias("posts"))
    return detectors.bursts(h.withColumn("terms", F.col("posts")), floor_terms=4, floor_posts=3)


@query("html_clean", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_clean(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", clean_html("html").alias("text"))


@query("title_key_groups", r"""WITH k AS (SELECT doc_id, source, substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(update|updated|correction|corrected)\b', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'), ' +', ' ', 'g')), 1, 240) AS title FROM documents)
 SELECT sha256(title) AS title_digest, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM k GROUP BY 1""")
def title_key_groups(spark, sf_dir):
    k = A.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(title_key("text"), 256).alias("title_digest"))
    return k.groupBy("title_digest").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))


@query("length_stats", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, median(CAST(length(text) AS DOUBLE)) AS med, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY 1")
def length_stats(spark, sf_dir):
    n = F.length("text")
    return A.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg(n)).alias("mean"), F.percentile(n.cast("double"), 0.5).alias("med"), F.max(n).cast("long").alias("longest"))


#: Bodies whose keys stand in another order on each second event, with times of fetching outside and inside.
BODY = """SELECT event_id, event_type, user_id, json_extract_string(props, '$.k') AS k, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS v FROM events"""


@query("canonical_digests", f"""WITH b AS ({BODY}), d AS (SELECT *, sha256('{{"a":[{{"10":"' || k || '","b":' || v || '}}],"kind":"' || event_type || '","user":' || user_id || '}}') AS digest FROM b)
 SELECT digest, count(*) AS n, min(event_id) AS first_event FROM d GROUP BY 1""")
def canonical_digests(spark, sf_dir):
    """Events under the digest of what they say; when they were fetched and how their keys stand makes no difference."""
    e = A.table(spark, sf_dir, "events")
    b = e.select("event_id", F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("10"), F.col("value").alias("b"), F.col("ts").cast("string").alias("when"))
    b = b.withColumn("inner", F.struct("10", "b")).withColumn("outer", F.struct("b", F.col("when").alias("polled_at"), "10"))
    one = F.to_json(F.struct("user", F.col("when").alias("observedAt"), F.array("outer").alias("a"), "kind"))
    other = F.to_json(F.struct(F.array("inner").alias("a"), "kind", F.col("when").alias("fetched_at"), "user"))
    d = b.select("event_id", F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("body")).select("event_id", canonical_digest("body").alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
