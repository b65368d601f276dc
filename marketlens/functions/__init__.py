"""Column helpers shared by every plan: money, dates, channels, labels."""

from marketlens.functions.columns import (
    MONEY,
    RATE,
    between_days,
    canonical_channel,
    count_when,
    day,
    labelled,
    literal_table,
    money,
    month_key,
    month_start,
    n,
    present,
    quarter_key,
    quarter_start,
    ratio,
    sum_when,
    usd,
)

__all__ = [
    "MONEY",
    "RATE",
    "between_days",
    "canonical_channel",
    "count_when",
    "day",
    "labelled",
    "literal_table",
    "money",
    "month_key",
    "month_start",
    "n",
    "present",
    "quarter_key",
    "quarter_start",
    "ratio",
    "sum_when",
    "usd",
]
