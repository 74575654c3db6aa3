"""All queries of the engine and their DuckDB counterparts."""

from .queries import ORACLE_SQL, QUERIES, assembly, behaviour, events, notices, official, places, radiation, records, streams, texts, weekly, windows

__all__ = ["ORACLE_SQL", "QUERIES", "assembly", "behaviour", "events", "notices", "official", "places", "radiation", "records", "streams", "texts", "weekly", "windows"]
