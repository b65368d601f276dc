"""Text expressions: tokens, distinctive numbers, path patterns. All JVM built-ins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens import config

# A number stands alone: no word character or dot before it, no word character after it.
# Fixed pattern; "word" means any Unicode letter, digit or underscore.
_W = r"\p{L}\p{N}_"
NUMBER = rf"(?<![{_W}.])(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?(?![{_W}])"
TOKEN = "[a-z0-9]+"


def words(text: Column) -> Column:
    """Distinct lower-case tokens longer than two characters, without stop words."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    stop = F.array(*[F.lit(w) for w in sorted(set(config.STOP_WORDS))])
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)))


def numbers(text: Column) -> Column:
    """The numbers written in a text, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def distinctive(number: Column) -> Column:
    """Canonical text of a number, or NULL when it is too common to look for.

    Whole numbers count from 1000 on. Others count from 100 on and are compared to the cent, rounded
    half-even. All of it works on the digits as text, so no length is too long.
    """
    plain = F.regexp_replace(number, "[,$]", "")
    parts = F.struct(
        F.when(plain.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        F.regexp_replace(F.regexp_extract(plain, r"^-?0*(\d*)", 1), "^$", "0").alias("whole"),
        F.regexp_extract(plain, r"\.(\d+)$", 1).alias("fraction"),
    )
    return _with(parts, _canonical)


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _canonical(p: Column) -> Column:
    whole, fraction = p["whole"], p["fraction"]
    digits = F.concat(whole, F.rpad(F.substring(fraction, 1, 2), 2, "0"))
    rest = F.regexp_replace(F.substring(fraction, 3, 2**31 - 1), "0+$", "")
    cents = _with(F.struct(digits.alias("digits"), rest.alias("rest")), _rounded)
    written = _with(cents, lambda c: F.concat(F.substring(c, 1, F.length(c) - 2), F.lit("."), F.substring(c, -2, 2)))
    return F.when(
        F.regexp_replace(fraction, "0", "") == "",
        F.when(F.length(whole) >= len(str(config.MIN_INTEGER_GOLD)), F.concat(p["sign"], whole)),
    ).when(F.length(whole) >= len(str(int(config.MIN_MONEY_GOLD))), F.concat(p["sign"], written))


def _rounded(p: Column) -> Column:
    odd = F.substring(p["digits"], -1, 1).isin("1", "3", "5", "7", "9")
    return F.when((p["rest"] > "5") | ((p["rest"] == "5") & odd), _with(p["digits"], _next)).otherwise(p["digits"])


def _next(digits: Column) -> Column:
    """The next whole number after a string of digits."""
    head, nines = F.regexp_extract(digits, "^(.*?)9*$", 1), F.regexp_extract(digits, "(9*)$", 1)
    raised = _with(head, lambda h: F.when(h == "", F.lit("1")).otherwise(
        F.concat(F.substring(h, 1, F.length(h) - 1), (F.substring(h, -1, 1).cast("int") + 1).cast("string"))))
    return F.concat(raised, F.regexp_replace(nines, "9", "0"))


def distinctive_value(value: Column) -> Column:
    """The canonical text of a numeric column, as ``distinctive`` writes it."""
    exact = F.coalesce(value.try_cast("decimal(38,6)").cast("string"), value.try_cast("decimal(38,0)").cast("string"))
    return distinctive(exact)


def glob_pattern(glob: str) -> str:
    """``*`` matches any run of characters, slashes included; all else is literal."""
    return "^" + ".*".join(re.escape(part) for part in glob.split("*")) + "$"


def url_path(url: Column) -> Column:
    """The path of a URL without host, query, fragment and surrounding slashes."""
    return F.regexp_extract(url, r"^[a-z]+://[^/]+/([^?#]*?)/?(?:[?#].*)?$", 1)
