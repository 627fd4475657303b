"""Result types of Arrow functions, as objects: a type's name could only be read with a session."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, BOOLEAN = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
