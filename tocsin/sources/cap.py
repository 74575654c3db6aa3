"""Common Alerting Protocol messages as features of JSON: identity, timing, references and the states that their geocodes name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import latest_by

#: Postal codes of states and territories, and the numbers that the SAME code has for them.
STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY AS GU MP PR VI UM".split()
)
SAME = dict(
    x.split(":")
    for x in (
        "01:AL 02:AK 04:AZ 05:AR 06:CA 08:CO 09:CT 10:DE 11:DC 12:FL 13:GA 15:HI 16:ID 17:IL 18:IN 19:IA 20:KS 21:KY 22:LA 23:ME 24:MD 25:MA 26:MI 27:MN 28:MS 29:MO 30:MT 31:NE 32:NV 33:NH 34:NJ 35:NM 36:NY 37:NC "
        "38:ND 39:OH 40:OK 41:OR 42:PA 44:RI 45:SC 46:SD 47:TN 48:TX 49:UT 50:VT 51:VA 53:WA 54:WV 55:WI 56:WY 60:AS 66:GU 69:MP 72:PR 74:UM 78:VI"
    ).split()
)
#: Codes of one kind that are looked at; a message with more is said to be cut.
MOST_CODES = 1000
PROPERTIES = (
    "struct<id: string, sender: string, event: string, status: string, messageType: string, scope: string, sent: string, effective: string, expires: string, ends: string, areaDesc: string, headline: string, "
    "references: array<struct<sender: string, identifier: string, sent: string>>, geocode: struct<UGC: array<string>, SAME: array<string>>>"
)


def cap_time(text: Column) -> Column:
    """Seconds of a time whose offset is written out and whose day exists; else null."""
    pattern = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"
    return F.when(text.rlike(pattern), F.unix_seconds(F.try_to_timestamp(text)))


def cap_messages(features: DataFrame, feature: str = "feature", lane: str = "lane") -> DataFrame:
    """A row for each message id, the last sent of several: lanes (in which it came), message_id, sender, event, message_type, actual,
    sent, effective, expires, ends (seconds), references (sender, identifier, sent), state_codes (sorted), unresolved, cut and timing_valid.

    features: a GeoJSON feature as text and the lane of pages that it came by. A message without an id, sender, event or known types is
    left out. An absent effective time is that of sending. Cancellations are valid by time and references; others must expire after they
    begin and not end before. Geography is unresolved where a code is malformed or of no state, or where there is none.
    """
    p = F.from_json(F.get_json_object(feature, "$.properties"), PROPERTIES)
    m = features.select(F.col(lane).alias("lane"), p.alias("p")).select("lane", "p.*").filter("trim(id) <> '' AND trim(sender) <> '' AND event IS NOT NULL")
    m = m.filter(F.col("status").isin("Actual", "Exercise", "System", "Test", "Draft") & F.col("scope").isin("Public", "Restricted", "Private") & F.col("messageType").isin("Alert", "Update", "Cancel", "Ack", "Error"))
    times = {c: cap_time(F.col(c)) for c in ("sent", "expires", "ends")}
    begins = F.when(F.col("effective").isNull(), times["sent"]).otherwise(cap_time(F.col("effective")))
    refs = F.filter(F.transform(F.coalesce("references", F.array()), lambda r: F.struct(r.sender.alias("sender"), r.identifier.alias("identifier"), cap_time(r.sent).alias("sent"))), lambda r: (r.sender != "") & (r.identifier != "") & r.sent.isNotNull())
    whole = F.size(refs) == F.size(F.coalesce("references", F.array()))
    some = lambda c: F.slice(F.coalesce(f"geocode.{c}", F.array()), 1, MOST_CODES)
    place = F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair])
    known = F.array(*map(F.lit, STATES))
    of = F.concat(
        F.transform(some("UGC"), lambda c: F.when(c.rlike(r"^[A-Z]{2}[CZ]\d{3}$"), F.substring(c, 1, 2))), F.transform(some("SAME"), lambda c: F.when(c.rlike(r"^\d{6}$"), F.try_element_at(place, F.substring(c, 2, 2))))
    )
    m = m.withColumns({"_codes": F.transform(of, lambda s: F.when(F.array_contains(known, s), s)), "_ends_as": F.col("ends").isNotNull(), "_refs": refs, "_whole": whole, "_begins": begins})
    m = m.withColumns(times)
    cut = (F.size(F.coalesce("geocode.UGC", F.array())) > MOST_CODES) | (F.size(F.coalesce("geocode.SAME", F.array())) > MOST_CODES)
    codes = F.array_sort(F.array_distinct(F.array_compact("_codes")))
    unresolved = cut | (F.size(codes) == 0) | F.exists("_codes", lambda s: s.isNull())
    window = F.coalesce((F.col("expires") > F.col("_begins")) & (~F.col("_ends_as") | (F.col("ends") >= F.col("_begins"))), F.lit(False)) & F.col("sent").isNotNull()
    valid = F.when(F.col("messageType") == "Cancel", F.col("sent").isNotNull() & F.col("_whole") & (F.size("_refs") > 0)).otherwise(window)
    m = m.select(
        "lane", F.col("id").alias("message_id"), "sender", "event", F.col("messageType").alias("message_type"), ((F.col("status") == "Actual") & (F.col("scope") == "Public")).alias("actual"), "sent",
        F.col("_begins").alias("effective"), "expires", "ends", F.col("_refs").alias("references"), codes.alias("state_codes"), unresolved.alias("unresolved"), cut.alias("cut"), valid.alias("timing_valid"),
    )
    lanes = m.groupBy("message_id").agg(F.array_sort(F.collect_set("lane")).alias("lanes"))
    return latest_by(m.withColumn("_sent", F.coalesce("sent", F.lit(0))), ["message_id"], ["_sent", "lane"]).drop("_sent", "lane").join(lanes, "message_id")
