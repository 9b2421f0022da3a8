"""Salaries in free text: candidates by pattern, the most confident wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much of a text is read, how much around a match tells its period.
HEAD, REACH = 3000, 50
_CURRENCY, _AMOUNT, _TO = r"(?:USD\s*)?\$?", r"([\d,]+[Kk]?)", "\\s*(?:[-\u2013\u2014]|to)\\s*"
#: Kinds of mention in the order of their confidence, with their patterns.
PATTERNS = (
    ("range", 0.92, rf"(?i){_CURRENCY}{_AMOUNT}{_TO}{_CURRENCY}{_AMOUNT}(?:\s*(?:USD|dollars?|per\s+year|annually|yearly|/yr|/year))?"),
    ("by_period", 0.88, rf"(?i){_CURRENCY}{_AMOUNT}\s*(?:per|/)\s*(year|yr|hour|hr|month|mo)"),
    ("labelled", 0.87, rf"(?i)(?:base\s+)?(?:salary|compensation|pay|total\s+comp|total\s+compensation|tc|target\s+compensation|remuneration)[\s:of]+{_CURRENCY}{_AMOUNT}(?:\s*(?:/yr|/year|annually|yearly|per\s+year|/hr|hourly))?"),
    ("most", 0.75, rf"(?i)(?:up\s+to|as\s+much\s+as|maximum|max|not\s+to\s+exceed)\s+{_CURRENCY}{_AMOUNT}"),
)
#: Words that tell a period.
CLUES = (
    ("hourly", ("/hr", "per hr", "per hour", "hourly", "/hour")),
    ("monthly", ("/mo", "per mo", "per month", "monthly", "/month")),
    ("yearly", ("/yr", "per yr", "per year", "annually", "annual", "yearly", "/year", "a year")),
)


def amount(token: Column) -> Column:
    """The number of a token such as 155,000 or 150K; null if it has no digits."""
    plain = F.replace(token, F.lit(","), F.lit(""))
    kilo = F.lower(plain).endswith("k")
    return F.when(kilo, F.substring(plain, F.lit(1), F.length(plain) - 1).try_cast("double") * 1000).otherwise(plain.try_cast("double"))


def _period(value: Column, around: Column) -> Column:
    out = None
    for name, words in CLUES:
        said = around.rlike("|".join(words))
        out = F.when(said, name) if out is None else out.when(said, name)
    return out.when(value <= 300, "hourly").when(value.between(3000, 30_000), "monthly").otherwise("yearly")


def _plausible(low: Column, high: Column) -> Column:
    """Not tiny, not a span of calendar years, not turned round."""
    years = low.between(1990, 2035) & high.between(1990, 2035) & (F.abs(high - low) < 6)
    return low.isNotNull() & high.isNotNull() & (low >= 10) & (high >= 10) & ~years & ~((low > 0) & (high > 0) & (low > 3 * high))


def salary(text: Column) -> Column:
    """low, high, period, confidence and raw text of the best mention, or null.

    The first plausible mention of the most confident kind counts. A range without a
    currency needs no pattern of its own, as the currency of a range may be missing. Empty
    and null texts have none; of a long text the beginning is read, where salaries stand.
    """
    head = F.substring(text, 1, HEAD)
    return F.coalesce(*(_first(head, kind, confidence, pattern) for kind, confidence, pattern in PATTERNS))


def _first(head: Column, kind: str, confidence: float, pattern: str) -> Column:
    """The first plausible mention of a kind, or null."""

    def read(m: Column) -> Column:
        one = amount(F.regexp_extract(m, pattern, 1))
        low, high = one, one
        if kind == "range":
            high = amount(F.regexp_extract(m, pattern, 2))
        elif kind == "most":
            low = F.when(one.isNotNull(), 0.0)
        if kind == "by_period":
            unit = F.lower(F.regexp_extract(m, pattern, 2))
            period = F.when(unit.isin("year", "yr"), "yearly").when(unit.isin("month", "mo"), "monthly").otherwise("hourly")
        else:
            at = F.instr(head, m)
            period = _period(high, F.lower(F.substring(head, F.greatest(at - REACH, F.lit(1)), F.length(m) + F.least(at - 1, F.lit(REACH)) + REACH)))
        return F.struct(low.alias("low"), high.alias("high"), period.alias("period"), F.lit(confidence).alias("confidence"), F.trim(m).alias("raw"))

    def fits(s: Column) -> Column:
        return s["high"].isNotNull() if kind == "by_period" else _plausible(s["high"] if kind == "most" else s["low"], s["high"])

    return F.get(F.filter(F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), read), fits), F.lit(0))
