"""One text, and so one digest, for all spellings of a JSON value: keys sorted, volatile keys gone at any depth, numbers as browsers print them."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that say when something was fetched, not what it says.
VOLATILE = ("retrievedAt", "fetchedAt", "checkedAt", "polledAt", "observedAt", "retrieved_at", "fetched_at", "checked_at", "polled_at")
#: Integers that doubles hold exactly; keys that count as indexes come first, by number.
EXACT, INDEX = 1 << 53, re.compile(r"0|[1-9][0-9]{0,9}")


def number(x) -> str:
    """A double's shortest digits, plain from 1e-6 to under 1e21, else with an exponent."""
    if isinstance(x, int) and abs(x) <= EXACT:
        return str(x)
    try:
        x = float(x)
    except OverflowError:
        return "null"
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    d = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent
    if 0 < point <= 21:
        text = d.ljust(point, "0") if len(d) <= point else f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + d
    else:
        text = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + text


def key_order(key: str):
    if INDEX.fullmatch(key) and int(key) < (1 << 32) - 1:
        return (0, int(key), b"")
    return (1, 0, key.encode("utf-16-be", "surrogatepass"))


def quoted(text: str) -> str:
    """Lone surrogates stay escapes, as no UTF-8 text can hold them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def canonical(value, volatile=frozenset(VOLATILE)) -> str:
    """The text of a parsed value; nesting is held on a list, so that its depth has no bound of its own."""
    out, todo = [], [(False, value)]
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            todo.append((True, "}"))
            keys = sorted((k for k in v if k not in volatile), key=key_order)
            for i in reversed(range(len(keys))):
                todo += [(False, v[keys[i]]), (True, ("," if i else "") + quoted(keys[i]) + ":")]
            out.append("{")
        elif isinstance(v, list):
            todo.append((True, "]"))
            for i in reversed(range(len(v))):
                todo += [(False, v[i]), (True, "," if i else "")]
            out.append("[")
        elif isinstance(v, str):
            out.append(quoted(v))
        elif v is None or isinstance(v, bool):
            out.append({None: "null", True: "true", False: "false"}[v])
        else:
            out.append(number(v))
    return "".join(out)


def canonical_json(col, volatile: tuple[str, ...] = VOLATILE) -> Column:
    """The canonical text of a JSON column; null where it is null or no JSON (NaN and Infinity aren't), or nested deeper than the parser goes."""
    gone = frozenset(volatile)

    def refuse(name):
        raise ValueError(name)

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else canonical(json.loads(x, parse_constant=refuse), gone)
            except (ValueError, RecursionError):
                return None

        return values.map(one, na_action="ignore").astype(object)

    return text(F.col(col) if isinstance(col, str) else col)


def canonical_digest(col, volatile: tuple[str, ...] = VOLATILE) -> Column:
    return F.sha2(canonical_json(col, volatile), 256)
