"""Exactly one copy of every message that was delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_id, is_blank

_FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.TimestampType, T.TimestampNTZType, T.DateType)


def _as_long(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    return c.cast("bigint")


def _first_delivery(df: DataFrame, row_key: str, delivered: str | None) -> Column:
    """Aggregate that picks the row key of the earliest delivery, ties by row key.

    The struct of delivery time and tie-break is packed into one decimal(38): a fixed-width buffer, so Spark keeps the hash
    aggregate with its map-side partial step (a struct buffer would force a sort aggregate). The low 64 bits hold the whole
    range of the row key, negative keys included, the digits above them the time; null deliveries come last. A time
    beyond 2 to the power of 62 (of timestamps, the year 148,000) is not packed but compared as a struct.
    """
    if delivered in (None, row_key):
        return F.min_by(F.col(row_key), F.col(row_key))
    kind, key = df.schema[delivered].dataType, df.schema[row_key].dataType
    struct = F.min_by(F.col(row_key), F.struct(F.col(delivered).isNull(), F.col(delivered), F.col(row_key)))
    if not (isinstance(kind, _FIXED) and isinstance(key, _FIXED)) or isinstance(kind, T.LongType):
        return struct
    at = F.coalesce(_as_long(F.col(delivered), kind), F.lit(2**62)).cast("decimal(19,0)")
    low = _as_long(F.col(row_key), key).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    packed = (at * F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)") + low.cast("decimal(38,0)")
    return F.min_by(F.col(row_key), packed.cast("decimal(38,0)"))


def kept_keys(df: DataFrame, ident: dict[str, Column], row_key: str, delivered: str | None = None) -> DataFrame:
    """Row key of every row that stays: one per identifier, and each row without an identifier."""
    extra = [F.col(delivered)] if delivered and delivered != row_key else []
    rows = df.select(F.col(row_key), *extra, *[c.alias(f"__{k}") for k, c in ident.items()])
    nameless = F.lit(False)
    for k in ident:
        nameless = nameless | F.col(f"__{k}").isNull()
    rows = rows.withColumn("__own", F.when(nameless, F.col(row_key)))
    best = _first_delivery(rows, row_key, delivered)
    return rows.groupBy(*[f"__{k}" for k in ident], "__own").agg(best.alias(row_key)).select(row_key)


def repeated_deliveries(df: DataFrame, ident: dict[str, Column], row_key: str, delivered: str | None = None) -> DataFrame:
    """Row keys of further deliveries.

    ``ident`` maps a name to the Column of one identifier part; a row with a null part belongs to no message and is
    never a case. ``row_key`` must be unique and not null. A hot identifier meets partial aggregation first and the
    anti-join runs on the unique row key, so no task ever holds a group. An empty table gives an empty result.
    """
    return df.select(row_key).join(kept_keys(df, ident, row_key, delivered), row_key, "left_anti")


def deduplicate(df: DataFrame, ident: dict[str, Column], row_key: str, delivered: str | None = None) -> DataFrame:
    """``df`` with every message exactly once; rows without an identifier all stay. Columns are unchanged."""
    return df.join(kept_keys(df, ident, row_key, delivered), row_key, "left_semi").select(*df.columns)


def message_ident(session: str = "sessionId", ident: str = "id") -> dict[str, Column]:
    """Identifier of a decision message: session and canonical id; blank parts are null."""
    return {"session": F.when(~is_blank(F.col(session)), F.col(session)), "id": canonical_id(F.col(ident))}
