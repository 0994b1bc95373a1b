"""Flatten a result for comparison with the SQL oracle.

Nested documents cannot be hashed the same way by two engines, so results
are brought to a flat, typed form: struct fields become ``parent_child``
columns, arrays become sorted text joined by ``|``, dates become ISO text,
integers become bigint and decimals become double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(col: Column, dtype: T.DataType, name: str):
    if isinstance(dtype, T.StructType):
        out = []
        for field in dtype.fields:
            out.extend(_flat(col.getField(field.name), field.dataType, f"{name}_{field.name}"))
        return out
    if isinstance(dtype, T.ArrayType):
        elem = dtype.elementType
        if isinstance(elem, T.StructType):
            # One sorted text column per entry field, plus the entry count.
            out = [F.size(col).cast("bigint").alias(f"{name}_size")]
            for field in elem.fields:
                text = F.transform(col, _field_text(field))
                out.append(F.array_join(F.array_sort(text), "|").alias(f"{name}_{field.name}"))
            return out
        text = F.transform(col, lambda x: _scalar(x, elem).cast("string"))
        return [F.array_join(F.array_sort(text), "|").alias(name)]
    return [_scalar(col, dtype).alias(name)]


def _field_text(field: T.StructField):
    return lambda x: _scalar(x.getField(field.name), field.dataType).cast("string")


def _scalar(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col.cast("bigint")
    if isinstance(dtype, (T.DecimalType, T.FloatType, T.DoubleType)):
        return col.cast("double")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("string")
    return col


def flatten(df: DataFrame) -> DataFrame:
    cols = []
    for field in df.schema.fields:
        cols.extend(_flat(F.col(f"`{field.name}`"), field.dataType, field.name))
    return df.select(*cols)
