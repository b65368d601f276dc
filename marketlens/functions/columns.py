"""Column expressions. All of them are JVM built-ins, so they stay inside codegen.

Money is ``DECIMAL(18,2)`` while it is added up and a DOUBLE rounded once when it leaves a
metric. Ratios divide two exact sums as doubles: dividing decimals in Spark caps the
scale at six digits, which is too coarse for the nine-digit refund rate.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import config

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(5, 4)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- dates ----------------------------------------------------------------------------
def day(value: str | date | Column) -> Column:
    """A calendar date: literals become DATE literals, columns are cast."""
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(value if isinstance(value, date) else date.fromisoformat(value))


def between_days(c: Column | str, start: str, end: str) -> Column:
    """Inclusive calendar window on a DATE column (reaches the Parquet scan)."""
    return _col(c).between(day(start), day(end))


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c), "MM")


def quarter_start(c: Column | str) -> Column:
    return F.trunc(_col(c), "QUARTER")


def month_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def quarter_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy'Q'q")


# -- money, counts, ratios ------------------------------------------------------------
def money(c: Column | str) -> Column:
    return _col(c).cast(MONEY)


def usd(c: Column | str) -> Column:
    """Round once to cents, leave as DOUBLE. An empty sum stays NULL."""
    return F.round(_col(c), 2).cast("double")


def n(c: Column | str) -> Column:
    return _col(c).cast("long")


def ratio(num: Column | str, den: Column | str, scale: int = 4) -> Column:
    """``num / den`` rounded half-up; NULL when the denominator is zero or NULL."""
    return F.round(F.try_divide(_col(num).cast("double"), _col(den).cast("double")), scale)


def sum_when(cond: Column, c: Column | str) -> Column:
    """Sum over the rows where ``cond`` holds; zero when there are none."""
    return F.coalesce(F.sum(F.when(cond, _col(c))), F.lit(0).cast(MONEY))


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


# -- labels ---------------------------------------------------------------------------
def canonical_channel(c: Column | str) -> Column:
    """The label used before the rename is the same channel as ``d2c``."""
    return F.when(_col(c) == config.LEGACY_D2C_LABEL, F.lit("d2c")).otherwise(_col(c))


def labelled(c: Column | str, labels: Mapping[str, str]) -> Column:
    col = _col(c)
    out = F.when(F.lit(False), col)
    for key, text in labels.items():
        out = out.when(col == key, F.lit(text))
    return out.otherwise(col)


# -- tables ---------------------------------------------------------------------------
def literal_table(spark: SparkSession, ddl: str, rows: Iterable[Sequence]) -> DataFrame:
    """A table of fixed values as a local relation.

    Its exact size is known to the planner, so joins against it broadcast on their own and
    filters on it fold away at planning time.
    """
    fields = T.StructType.fromDDL(ddl).fields

    def text(value, kind: T.DataType) -> str:
        if value is None:
            return f"CAST(NULL AS {kind.simpleString()})"
        if isinstance(value, bool):
            return "true" if value else "false"
        quoted = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(kind, T.StringType):
            return quoted
        if isinstance(kind, T.DecimalType):
            quoted = "'" + str(Decimal(str(value))) + "'"
        return f"CAST({quoted} AS {kind.simpleString()})"

    body = ", ".join(
        "(" + ", ".join(text(v, f.dataType) for v, f in zip(row, fields, strict=True)) + ")"
        for row in rows
    )
    names = ", ".join(f.name for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def present(df: DataFrame) -> DataFrame:
    """Output form of a table: exact decimals become DOUBLE, integers BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)
