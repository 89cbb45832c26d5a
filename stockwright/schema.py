"""Schemas of the tables that operators exchange, and boundary checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _F, _I, _L = T.StringType(), T.DateType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PANEL = _of(series_id=_S, date=_D, y=_F, price=_F)
FORECAST = _of(series_id=_S, date=_D, p10=_F, p50=_F, p90=_F)
CACHE = _of(fold=_I, model=_S, series_id=_S, date=_D, p10=_F, p50=_F, p90=_F, y=_F, zero_rate=_F)
FOLDS = _of(fold=_I, train_end=_D, test_start=_D, test_end=_D)
INVOICES = _of(invoice=_S, stock_code=_S, invoice_date=T.TimestampType(), quantity=_F, price_gbp=_F, customer=_S, country=_S, description=_S, sheet=_S)
LOG = _of(series_id=_S, date=_D, y=_F, forecast=_F)


class SchemaError(ValueError):
    pass


def require(df: DataFrame, schema: T.StructType, what: str = "table") -> DataFrame:
    """Fail early if a column is absent or of another type; extra columns pass."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema if f.name in have and have[f.name] != f.dataType]
    missing = [f.name for f in schema if f.name not in have]
    if missing or wrong:
        raise SchemaError(f"{what}: " + "; ".join([*(f"no column {c}" for c in missing), *wrong]))
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL inside the engine, never NaN."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])
