"""Detectors over counts, stations, regions and texts. Each is a function of its inputs, settings and (where needed) now."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip_cap, median, robust_by, robust_sigma, robust_z, surprise, upper_tail
from ..functions.text import has_term
from ..functions.timeutil import DAY, HALF_HOUR, day_of, slot_of_day, weekday
from ..operators.joins import band_join, nearest_in_radius
from ..operators.sequences import consecutive

#: Samples under which a baseline tier is passed over.
TIER = 6


def takeoff_slots(slots: DataFrame, takeoffs: DataFrame, time: str = "t") -> DataFrame:
    """slot, n, day_class, slot_of_day: takeoffs in each slot that was observed, 0 where there were none."""
    n = takeoffs.groupBy((F.col(time) - F.pmod(F.col(time), F.lit(HALF_HOUR))).alias("slot")).agg(F.count("*").alias("n"))
    out = slots.select("slot").join(n, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("day_class", F.when(weekday(day_of("slot")).isin(0, 6), "weekend").otherwise("weekday")).withColumn("slot_of_day", slot_of_day("slot"))


def clipped(counts: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """keys, n_<tag>, mean_<tag>: means of counts cut at their median and four roots, half a takeoff added once."""
    x = counts.withColumn("x", F.col("n").cast("double"))
    med = x.groupBy(*keys).agg(median("x").alias("med")) if keys else x.agg(median("x").alias("med"))
    j = x.join(med, keys) if keys else x.crossJoin(F.broadcast(med))
    c = F.least("x", clip_cap("med"))
    return (j.groupBy(*keys) if keys else j).agg(F.count("*").alias(f"n_{tag}"), ((F.sum(c) + 0.5) / F.count("*")).alias(f"mean_{tag}"))


def takeoff_baseline(counts: DataFrame) -> DataFrame:
    """day_class, slot_of_day, n, mean, tier: from the class and slot, else the slot of all days, else all, each with TIER samples."""
    keys = counts.select("day_class", "slot_of_day").distinct()
    a, b, c = clipped(counts, ["day_class", "slot_of_day"], "a"), clipped(counts, ["slot_of_day"], "b"), clipped(counts, [], "c")
    out = keys.join(a, ["day_class", "slot_of_day"]).join(b, "slot_of_day").crossJoin(F.broadcast(c))
    pick = lambda x: F.when(F.col("n_a") >= TIER, F.col(f"{x}_a")).when(F.col("n_b") >= TIER, F.col(f"{x}_b")).otherwise(F.col(f"{x}_c"))
    tier = F.when(F.col("n_a") >= TIER, "class").when(F.col("n_b") >= TIER, "slot").otherwise("global")
    return out.select("day_class", "slot_of_day", pick("n").alias("n"), pick("mean").alias("mean"), tier.alias("tier"))


def dispersion(counts: DataFrame) -> DataFrame:
    """dispersion: Pearson's over (class, slot) groups of three counts or more, pooled, never under 1."""
    g = counts.groupBy("day_class", "slot_of_day").agg(F.count("*").alias("k"), F.avg("n").alias("m"), F.var_pop("n").alias("v")).filter("k >= 3 and m > 0")
    return g.agg(F.greatest(F.lit(1.0), F.coalesce(F.sum(F.col("k") * F.col("v") / F.col("m")) / F.sum(F.col("k") - 1), F.lit(1.0))).alias("dispersion"))


def takeoff_surprise(counts: DataFrame) -> DataFrame:
    """slot, n, mean, dispersion, tail, surprise."""
    base = takeoff_baseline(counts).select("day_class", "slot_of_day", "mean")
    out = counts.join(base, ["day_class", "slot_of_day"]).crossJoin(F.broadcast(dispersion(counts)))
    out = out.withColumn("tail", upper_tail("n", F.col("mean"), F.col("dispersion")))
    return out.select("slot", "n", "mean", "dispersion", "tail", surprise("tail").alias("surprise"))


#: Alerts a year of each tier, slots a year, decades that the record may lift a threshold.
BUDGETS, PER_YEAR, LIFT = {"elevated": 12, "high": 4, "critical": 1}, 17520, 2.0
#: Scores from which a record can certify the first tier's rate.
RECORD = -(-PER_YEAR // BUDGETS["elevated"])


def surprise_ladder(scores: DataFrame, now: int, least: int = RECORD) -> DataFrame:
    """tier, model, record: of each tier the surprise that its budget stands for, and what the scores (slot, surprise) of the year before now
    say, the slot of now left out: the k-th largest, k being the budget's share of the samples, at most LIFT decades over the model's;
    null while there are fewer than `least`."""
    past = scores.filter((F.col("slot") >= now - 365 * DAY) & (F.col("slot") < now) & F.col("surprise").isNotNull())
    top = past.select("surprise").orderBy(F.desc("surprise")).limit(max(BUDGETS.values())).agg(F.sort_array(F.collect_list("surprise"), False).alias("top"))
    one = top.crossJoin(past.agg(F.count("*").alias("n")))
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(b).alias("budget"), F.lit(math.log10(PER_YEAR / b)).alias("model")) for t, b in BUDGETS.items()])).alias("t")
    k = F.greatest(F.floor(F.col("budget") * F.col("n") / PER_YEAR), F.lit(1)).cast("int")
    record = F.when(F.col("n") >= least, F.least(F.try_element_at("top", k), F.col("model") + LIFT))
    return one.select("*", tiers).select("top", "n", "t.*").select("tier", "model", record.alias("record"))


def station_scores(readings: DataFrame, order: list[str], days: int = 30, least: int = 48) -> DataFrame:
    """Of each station its latest reading: t, value, n, med, mad, z, departing. The baseline is what it had in the days before, at least
    so many readings; z has a floor of 0.02 or a twentieth of the median; departing is three times the median and half a unit
    over it, or five units."""
    w = Window.partitionBy("station_id").orderBy(*[F.desc(c) for c in order])
    ranked = readings.select("station_id", *order, "value").withColumn("_rank", F.row_number().over(w))
    last = ranked.filter("_rank = 1").select("station_id", F.col("t").alias("last_t"), F.col("value").alias("last_value"))
    past = ranked.filter("_rank > 1").join(last.select("station_id", "last_t"), "station_id").filter(F.col("t") >= F.col("last_t") - days * DAY)
    base = robust_by(past.select("station_id", F.col("value").alias("x")), ["station_id"], "x").filter(F.col("n") >= least)
    out = last.join(base, "station_id")
    z = robust_z("last_value", "med", "mad", F.greatest(F.lit(0.02), 0.05 * F.col("med")))
    return out.select("station_id", F.col("last_t").alias("t"), F.col("last_value").alias("value"), "n", "med", "mad", z.alias("z"), departing("last_value", "med").alias("departing"))


def departing(value: str, med: str):
    return ((F.col(value) >= 3 * F.col(med)) & (F.col(value) - F.col(med) >= 0.5)) | (F.col(value) >= 5 * F.col(med))


def departing_runs(readings: DataFrame, order: list[str], factor: float = 1.3) -> DataFrame:
    """station_id, runs, longest: runs of readings over factor times the station's median."""
    med = readings.groupBy("station_id").agg(median("value").alias("med"))
    r = consecutive(readings.join(med, "station_id"), "station_id", order, F.col("value") > factor * F.col("med"))
    return r.groupBy("station_id").agg(F.count_if(F.col("streak") == 1).alias("runs"), F.max("streak").alias("longest"))


def healthy_slots(counts: DataFrame, controls: list[str]) -> DataFrame:
    """slot, total of those slots in which all controls have rows."""
    c = counts.filter(F.col("series").isin(controls)).groupBy("slot").agg(F.count_distinct("series").alias("k")).filter(F.col("k") == len(controls))
    return counts.join(c.select("slot"), "slot", "left_semi").groupBy("slot").agg(F.sum("n").alias("total"))


def voids(counts: DataFrame, hours: DataFrame, days: int = 21, least: int = 10, typical: float = 5.0) -> DataFrame:
    """series, hour, n, med, z, void, streak: an hour's count against the same hour of the days before (zero where the hour was covered
    and the series had no row). A void is a quarter of the median or less, or five sigmas under it."""
    series = counts.select("series").distinct()
    full = hours.select("hour").crossJoin(F.broadcast(series)).join(counts, ["series", "hour"], "left").select("series", "hour", F.coalesce("n", F.lit(0)).alias("n"))
    of_day = F.pmod(F.floor(F.col("hour") / 3600), F.lit(24))
    left = full.withColumn("of_day", of_day)
    right = full.select("series", of_day.alias("of_day"), F.col("hour").alias("past"), F.col("n").cast("double").alias("x"))
    past = band_join(left, right, "hour", "past", days * DAY, -1, ["series", "of_day"])
    keys = ["series", "hour"]
    base = robust_by(past.select(*keys, "x"), keys, "x").filter((F.col("n") >= least) & (F.col("med") >= typical)).select(*keys, "med", "mad")
    out = full.join(base, keys)
    z = robust_z("n", "med", robust_sigma("mad", "med"), F.lit(2.0))
    out = out.withColumn("z", z).withColumn("void", (F.col("n") <= 0.25 * F.col("med")) | (F.col("z") <= -5))
    return consecutive(out, "series", "hour", F.col("void"))


def term_buckets(docs: DataFrame, terms: list[str], text: str, keys: list[str]) -> DataFrame:
    """keys, term, posts: texts with each term as a word."""
    found = F.array_compact(F.array(*[F.when(has_term(text, t), F.lit(t)) for t in terms]))
    return docs.select(*keys, F.explode(found).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("posts"))


def zero_filled(buckets: DataFrame, active: DataFrame, values: DataFrame, keys: list[str], n: str) -> DataFrame:
    """buckets with a 0 for every active key and value without one; both are small dimensions."""
    grid = active.crossJoin(F.broadcast(values))
    return grid.join(buckets, grid.columns, "left").select(*grid.columns, F.coalesce(n, F.lit(0)).alias(n))


def bursts(hourly: DataFrame, floor_terms: int = 8, floor_posts: int = 3, days: int = 14, least: int = 10) -> DataFrame:
    """stream, place, hour, level of bursts: z over 0 against the same hour of the days before, enough terms and posts, three times the median."""
    of_day = F.pmod(F.floor(F.col("hour") / 3600), F.lit(24))
    keys = ["stream", "place", "hour"]
    right = hourly.select("stream", "place", of_day.alias("of_day"), F.col("hour").alias("past"), F.col("terms").cast("double").alias("x"))
    past = band_join(hourly.withColumn("of_day", of_day), right, "hour", "past", days * DAY, -1, ["stream", "place", "of_day"])
    base = robust_by(past.select(*keys, "x"), keys, "x").filter(F.col("n") >= least)
    out = hourly.join(base.select(*keys, "med", "mad"), keys)
    z = robust_z("terms", "med", robust_sigma("mad", "med"), F.lit(1.0))
    hot = (z > 0) & (F.col("terms") >= floor_terms) & (F.col("posts") >= floor_posts) & (F.col("terms") >= 3 * F.col("med"))
    return out.filter(hot).select(*keys, F.when((F.col("terms") >= 25) & (F.col("posts") >= 8), 4).otherwise(3).alias("level"))


#: Least magnitudes near a site and of an explosion anywhere, shallow depth and the depth that stands for an unknown one, sources.
SITE_MAGNITUDE, BLAST_MAGNITUDE, SHALLOW, UNKNOWN_DEPTH = 3.5, 4.0, 5.0, 10.0
SEISMIC_SOURCES = ("earthquake", "explosion", "collapse", "other event")


def seismic_verdict(quakes: DataFrame, sites: DataFrame, farthest: float = 100.0) -> DataFrame:
    """quakes (quake_id, lat, lon, depth, magnitude, classification) that say something: site_id and km of the nearest site (site_id,
    site_lat, site_lon, radius_km, quiet) that has it in its radius, level (5, 4, 3 or 1), rule and constraint (of the depth)."""
    near = nearest_in_radius(quakes, sites, "quake_id", "site_id", farthest, "radius_km").join(F.broadcast(sites.select("site_id", "quiet")), "site_id")
    q = quakes.join(near, "quake_id", "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    kind, shallow = F.col("classification"), finite("depth") & (F.col("depth") <= SHALLOW)
    unknown = ~finite("depth") | (F.col("depth") == UNKNOWN_DEPTH)
    judged = finite("magnitude") & kind.isin(*SEISMIC_SOURCES)
    here = judged & F.col("site_id").isNotNull() & (F.col("magnitude") >= SITE_MAGNITUDE)
    blast = judged & (kind == "explosion") & (F.col("magnitude") >= BLAST_MAGNITUDE)
    at_site = F.when((kind == "explosion") | shallow, 4).when(unknown, F.when(F.col("quiet"), 4).otherwise(3)).otherwise(1)
    nuclear = kind == "nuclear explosion"
    level = F.when(nuclear, 5).when(here, at_site).when(blast, 3).cast("int")
    rule = F.when(nuclear, "agency_classified_nuclear").when(here, "test_site_geofence").when(blast, "agency_classified_explosion")
    constraint = F.when(nuclear | ~here, "as reported").when(shallow, "shallow").when(unknown, "unconstrained").otherwise("deep")
    named = F.when(nuclear | here, F.lit(True))
    out = q.withColumn("level", level).filter(F.col("level").isNotNull())
    return out.select(*quakes.columns, F.when(named, F.col("site_id")).alias("site_id"), F.when(named, F.col("km")).alias("km"), "level", rule.alias("rule"), constraint.alias("constraint"))


def data_quality(slots: DataFrame, days: int = 14, least: int = 8, ratio: float = 0.6) -> DataFrame:
    """slot, n, status of (slot, n, and live where not all are): stale_live where the slot isn't live, unknown with too few live same slots in
    the days before or no count, degraded under ratio of their median, else ok."""
    live = F.coalesce("live", F.lit(False)) if "live" in slots.columns else F.lit(True)
    s = slots.select("slot", "n", live.alias("live"))
    right = s.filter("live and n is not null").select(F.col("slot").alias("past"), F.col("n").cast("double").alias("x"), slot_of_day("slot").alias("of_day"))
    past = band_join(s.select("slot").withColumn("of_day", slot_of_day("slot")), right, "slot", "past", days * DAY, -1, ["of_day"]).groupBy("slot").agg(F.count("*").alias("k"), median("x").alias("med"))
    out = s.join(past, "slot", "left")
    status = F.when(~F.col("live"), "stale_live").when(F.col("n").isNull() | (F.coalesce("k", F.lit(0)) < least), "unknown").when(F.col("n") < ratio * F.col("med"), "degraded").otherwise("ok")
    return out.select("slot", "n", status.alias("status"))


def quiet_dates(residuals: DataFrame, target: DataFrame, apart: int = 21, n: int = 4, slots: int = 40) -> DataFrame:
    """target_day, day, score, rank: days of the same weekday, at least `apart` days away and nearly fully covered, with the least mean
    absolute residual first. residuals: day, residual a slot; target: target_day."""
    d = residuals.groupBy("day").agg(F.count("*").alias("k"), F.avg(F.abs("residual")).alias("score")).filter(F.col("k") >= slots)
    j = target.join(d, (F.pmod("target_day", F.lit(7)) == F.pmod("day", F.lit(7))) & (F.abs(F.col("day") - F.col("target_day")) >= apart))
    w = Window.partitionBy("target_day").orderBy("score", "day")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n).select("target_day", "day", "score", "rank")


def excess_origins(slots: DataFrame, least: int = 8) -> DataFrame:
    """slot, residual, z against the same week slot 10 to 182 days away, at least so many; scale not under 1."""
    of_week = F.pmod("slot", F.lit(7 * DAY))
    left = slots.select("slot", "n").withColumn("w", of_week)
    right = slots.select(F.col("slot").alias("other"), F.col("n").cast("double").alias("x"), of_week.alias("w"))
    j = band_join(left, right, "slot", "other", 182 * DAY, 182 * DAY, ["w"]).filter(F.abs(F.col("slot") - F.col("other")) >= 10 * DAY)
    base = robust_by(j.select("slot", "x"), ["slot"], "x").filter(F.col("n") >= least).select("slot", "med", "mad")
    out = slots.join(base, "slot").withColumn("residual", F.col("n") - F.col("med"))
    return out.select("slot", "residual", (F.col("residual") / F.greatest("mad", F.lit(1.0))).alias("z"))
