"""Document collections from JSON lines, whose money is a number in one document and a text in another.

Money fields are read as ``VARIANT``, so that no document is lost to the type of
another. :func:`plain_money` brings them to the text that all document queries take: a
number keeps its digits, a text stays as it is, true and false count 1 and 0, a
missing value or JSON null is NULL; objects and arrays stay JSON text, which
counts 0 (as text that is no number does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentwise.operators.documents import COLLECTIONS, DOC_SCHEMAS

# The money fields of the collections.
MONEY_FIELDS = ("costs_per_day", "costs", "total_costs")


def _loose(dtype: T.DataType) -> T.DataType:
    """The type with every money field as VARIANT."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_loose(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, T.VariantType() if f.name in MONEY_FIELDS else _loose(f.dataType)) for f in dtype.fields])
    return dtype


def read_json_docs(spark: SparkSession, base_dir: str) -> dict[str, DataFrame]:
    """The collections ``base_dir/<name>`` (JSON lines) with their declared schemas, money as VARIANT."""
    return {name: spark.read.schema(_loose(T.StructType.fromDDL(DOC_SCHEMAS[name]))).json(f"{base_dir}/{name}")
            for name in COLLECTIONS}


def variant_text(value: Column) -> Column:
    """A VARIANT as the text that money is kept in."""
    text = F.try_variant_get(value, "$", "string")
    whole = F.when(F.schema_of_variant(value) == "BOOLEAN", F.when(text == "true", "1").otherwise("0")).otherwise(text)
    return F.when(F.is_variant_null(value) | value.isNull(), F.lit(None).cast("string")).otherwise(whole)


def _plain(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.VariantType):
        return variant_text(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _plain(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_plain(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    return col


def _has_variant(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.VariantType) or (isinstance(dtype, T.ArrayType) and _has_variant(dtype.elementType)) or (
        isinstance(dtype, T.StructType) and any(_has_variant(f.dataType) for f in dtype.fields))


def plain_money(docs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The collections with VARIANT money as text, all other columns as they are."""
    return {name: df.select(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if _has_variant(f.dataType)
                              else F.col(f"`{f.name}`") for f in df.schema.fields]) for name, df in docs.items()}
