"""Text cleaning, keys, term matching, severities."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Severities from the least.
SEVERITIES = ("watch", "elevated", "high", "critical")
RANKS = {"watch": 1, "elevated": 3, "high": 4, "critical": 5}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility normal form; no built-in function has it."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def clean_html(x) -> Column:
    """Without scripts, styles and tags; the commonest entities decoded; white space collapsed."""
    out = F.regexp_replace(_c(x), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def title_key(x) -> Column:
    """Lower case, update words and punctuation gone, 240 characters at most."""
    out = F.regexp_replace(F.lower(_c(x)), r"\b(update|updated|correction|corrected)\b", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), r" +", " ")), 1, 240)


def term_pattern(term: str) -> str:
    """A term between characters that are no letters or digits; ideographs need no border. Both engines read the pattern."""
    t = re.escape(term)
    return t if re.search("[぀-ヿ㐀-鿿가-힯]", term) else rf"(^|[^\p{{L}}\p{{N}}])({t})([^\p{{L}}\p{{N}}]|$)"


def has_term(x, term: str) -> Column:
    return F.lower(_c(x)).rlike(term_pattern(term.lower()))


def severity_rank(x) -> Column:
    out = F.when(_c(x) == SEVERITIES[0], RANKS[SEVERITIES[0]])
    for s in SEVERITIES[1:]:
        out = out.when(_c(x) == s, RANKS[s])
    return out.otherwise(0)


def severity_for_level(level) -> Column:
    level = _c(level)
    return F.when(level >= 5, "critical").when(level == 4, "high").when(level == 3, "elevated").otherwise("watch")


def public_severity(x) -> Column:
    """Those severities that are published."""
    return _c(x).isin("high", "critical")


def group_key(values) -> Column:
    """A digest of a list's distinct values, in order."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(_c(values)))), 256)
