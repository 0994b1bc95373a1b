from decimal import Decimal
import datetime as dt

from pyspark.sql import types as T

from rentwise import schema


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]


def with_rows(spark, tables, name, extra):
    """Tables with extra rows appended to one of them (fault or edge-case injection)."""
    fixed = []
    for row in extra:
        vals = []
        for field, v in zip(schema.SCHEMAS[name].fields, row):
            if isinstance(v, str) and field.dataType.typeName() == "date":
                v = dt.date.fromisoformat(v)
            elif isinstance(v, str) and field.dataType.typeName().startswith("decimal"):
                v = Decimal(v)
            vals.append(v)
        fixed.append(tuple(vals))
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.SCHEMAS[name].fields])
    add = spark.createDataFrame(fixed, loose)
    return dict(tables, **{name: tables[name].unionByName(add)})
