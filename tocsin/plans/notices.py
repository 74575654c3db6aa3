"""Notices and feeds: validity predicates, attribution, summaries and the rules that turn notices into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_term
from ..operators.joins import nearest_in_radius

#: Squawks and field values of an emergency, special aircraft types that are counted apart.
EMERGENCY_SQUAWKS = ("7500", "7600", "7700")


def valid_point(lat: str = "lat", lon: str = "lon") -> Column:
    return F.coalesce(F.abs(F.col(lat)).between(0, 90) & F.abs(F.col(lon)).between(0, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def usable_reading(payload: str, units: list[str], excluded: list[str]) -> Column:
    """A reading whose JSON payload has an accepted unit, no excluded status and isn't marked as not approved."""
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    return F.coalesce(get("unit").isin(units) & ~F.coalesce(F.lower(get("status")).isin(excluded), F.lit(False)) & (F.coalesce(get("approved"), F.lit("true")) != "false"), F.lit(False))


def valid_slot_counts(payload: str) -> Column:
    """JSON slot metadata with counts of zero or more and 1 to 60 sample minutes."""
    j = F.from_json(payload, "sample_minutes double, counts map<string,long>")
    return F.coalesce(j["sample_minutes"].between(1, 60) & F.forall(F.map_values(j["counts"]), lambda n: n >= 0), F.lit(False))


def eligible_incident(now: int, topics: list[str], fresh: int = 2 * 86400) -> Column:
    """kind, status, t and topics of a notice that may open an incident."""
    return F.col("kind").isin("notice", "official_alert", "report") & (F.col("status") != "cancelled") & F.col("t").between(now - fresh, now + 300) & F.arrays_overlap("topics", F.array(*map(F.lit, topics)))


def deliverable(now: int, lease: int = 600) -> Column:
    """Pending deliveries, and those whose sender's lease has run out, that still have attempts."""
    return ((F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("leased_at") < now - lease))) & (F.col("attempts") < 5)


def active_subscriber() -> Column:
    return F.col("unsubscribed_at").isNull() & (F.col("email_confirmed") | F.col("phone_confirmed") | F.col("push_endpoint").isNotNull())


def attributed(text: str, patterns: dict[str, str]) -> Column:
    """The names, in order, of the patterns that a text matches."""
    return F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))


def code_states(codes: str, states: dict[str, str]) -> Column:
    """The states of area codes (their first two characters, or digits two and three of six), distinct and in order."""
    table = F.create_map(*[F.lit(x) for kv in states.items() for x in kv])
    key = lambda c: F.when(c.rlike("^[0-9]{6}$"), F.substring(c, 2, 2)).otherwise(F.substring(c, 1, 2))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(codes, lambda c: F.try_element_at(table, key(c))))))


def normalized_registration(x: str) -> Column:
    return F.upper(F.regexp_replace(F.trim(x), r"[\s-]+", ""))


def odds_text(tail: str) -> Column:
    """'1 in n' of a probability, n to two significant figures."""
    n = 1 / F.col(tail)
    scale = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(n)) - 1, F.lit(0)))
    return F.concat(F.lit("1 in "), F.format_string("%,d", (F.floor(n / scale + 0.5) * scale).cast("long")))


def aircraft_summary(fixes: DataFrame, keys: list[str], special: list[str]) -> DataFrame:
    """keys, n, emergencies (once an aircraft), military, special (type to count) of fixes (hex, squawk, emergency, flags, type)."""
    urgent = F.coalesce(F.col("squawk").isin(*EMERGENCY_SQUAWKS), F.lit(False)) | F.coalesce(~F.col("emergency").isin("none", ""), F.lit(False))
    one = fixes.groupBy(*keys, "hex").agg(F.bool_or(urgent).alias("urgent"), F.bool_or(F.col("flags").bitwiseAND(1) == 1).alias("military"), F.max("type").alias("type"))
    by_type = one.filter(F.col("type").isin(special)).groupBy(*keys, "type").agg(F.count("*").alias("k"))
    maps = by_type.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "k")))).alias("special"))
    out = one.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("urgent").alias("emergencies"), F.count_if("military").alias("military"))
    return out.join(maps, keys, "left").withColumn("special", F.coalesce("special", F.create_map().cast("map<string,long>")))


def report_blocks(pages: DataFrame, body: str, marker: str, keys: list[str]) -> DataFrame:
    """number and fields of the blocks of a report that begin with marker and a number; a field is 'Key: value' up to the line's end."""
    parts = F.split(body, marker)
    blocks = pages.select(F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("b"))
    field = lambda k: F.nullif(F.trim(F.regexp_extract("b", rf"{k}:[ \t]*([^\n]*)", 1)), F.lit("")).alias(k.lower().replace(" ", "_"))
    return blocks.select(F.regexp_extract("b", r"^\s*(\d+)", 1).cast("long").alias("number"), *[field(k) for k in keys])


def reactor_drops(status: DataFrame, gap: int = 1800) -> DataFrame:
    """unit, t, before, power where a unit of (unit, t, power) that had 50 % or more (at least `gap` seconds before) has 5 % or less."""
    w = Window.partitionBy("unit").orderBy("t").rangeBetween(Window.unboundedPreceding, -gap)
    s = status.withColumn("before", F.max(F.struct("t", "power")).over(w)["power"])
    return s.filter("before >= 50 and power <= 5").select("unit", "t", "before", "power")


def many_trips(drops: DataFrame, site: str, least: int = 3, seconds: int = 3600) -> DataFrame:
    """site, t, units of sites where so many units drop within an hour."""
    w = Window.partitionBy(site).orderBy("t").rangeBetween(0, seconds)
    return drops.withColumn("units", F.size(F.collect_set("unit").over(w))).filter(F.col("units") >= least).select(site, "t", "units")


def first_restrictions(restrictions: DataFrame, regions: DataFrame, km: float = 80.0) -> DataFrame:
    """key, site_id, km of restrictions (key, lat, lon, t) near a region (site_id, site_lat, site_lon), at their first sighting."""
    first = restrictions.groupBy("key").agg(F.min_by(F.struct("lat", "lon", "t"), "t").alias("f")).select("key", "f.*")
    return first.join(nearest_in_radius(first, regions, "key", "site_id", km), "key").select("key", "t", "site_id", "km")


def outbreak_notices(notices: DataFrame, text: str, agents: list[str]) -> DataFrame:
    """notices with agents, those named as words; only such with any."""
    found = F.array_compact(F.array(*[F.when(has_term(text, a), F.lit(a)) for a in agents]))
    return notices.withColumn("agents", found).filter(F.size("agents") > 0)
