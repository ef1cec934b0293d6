"""Value formats of a topic: one text (or binary) column to columns and back.

AVRO needs Spark's external spark-avro module; without it Spark refuses the query
and names the module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.avro import functions as avro

FORMATS = ("JSON", "DELIMITED", "AVRO")

# Fixed values of DELIMITED records: a null, and the signs for characters that would end a
# line. A percent sign is itself replaced, so no text looks like another one's sign.
NULL_FIELD = "%N"
SIGNS = [("%", "%25"), ("\n", "%0A"), ("\r", "%0D")]


def _one_line(value: Column) -> Column:
    for plain, sign in SIGNS:
        value = F.replace(value, F.lit(plain), F.lit(sign))
    return value


def _all_lines(value: Column) -> Column:
    for plain, sign in reversed(SIGNS):
        value = F.replace(value, F.lit(sign), F.lit(plain))
    return value


#: Spark's own patterns end at milliseconds; what it reads without a pattern may have six digits.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
         "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _texts(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.StringType)]


def _upper(kind: T.DataType) -> T.DataType:
    """The type with the field names of all structs in it in upper case."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name.upper(), _upper(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_upper(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _upper(kind.valueType))
    return kind


def encode(columns: list[str], value_format: str = "JSON", delimiter: str = ",",
           schema: T.StructType | None = None) -> Column:
    """The named columns as one value column.

    In DELIMITED the text columns of ``schema`` (without one: none) have signs for line breaks,
    so that a record stays one line. Nulls and empty texts stay apart.
    """
    row = F.struct(*columns)
    if value_format == "JSON":
        return F.to_json(row, {"ignoreNullFields": "false", **TIMES})
    if value_format == "DELIMITED":
        texts = _texts(schema or T.StructType())
        row = F.struct(*[_one_line(F.col(c)).alias(c) if c in texts else F.col(c) for c in columns])
        return F.to_csv(row, {"sep": delimiter, "escape": '"', "nullValue": NULL_FIELD,
                              "ignoreLeadingWhiteSpace": "false",
                              "ignoreTrailingWhiteSpace": "false", **TIMES})
    if value_format == "AVRO":
        return avro.to_avro(row)
    raise ValueError(f"value format {value_format!r} is not one of {FORMATS}")


def decode(value: Column, schema: T.StructType, value_format: str = "JSON",
           delimiter: str = ",", avro_schema: str | None = None,
           json_case: str = "exact") -> Column:
    """A value column as a struct of ``schema``; a malformed value gives null fields.

    ``json_case='upper'`` reads producers that write all names in upper case.
    """
    if value_format == "JSON":
        if json_case == "exact":
            return F.from_json(value, schema)
        return F.from_json(value, _upper(schema)).cast(schema)  # by position
    if value_format == "DELIMITED":
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        row = F.from_csv(value, ddl, {"sep": delimiter, "escape": '"', "nullValue": NULL_FIELD})
        texts = _texts(schema)
        return F.struct(*[(_all_lines(row[f.name]) if f.name in texts else row[f.name])
                          .alias(f.name) for f in schema])
    if value_format == "AVRO":
        return avro.from_avro(value, avro_schema)
    raise ValueError(f"value format {value_format!r} is not one of {FORMATS}")


def decoded(df: DataFrame, schema: T.StructType, value: str = "value", **options) -> DataFrame:
    """Replace the value column by the columns of ``schema``."""
    others = [name for name in df.columns if name != value]
    return (df.select(*others, decode(F.col(value), schema, **options).alias("_row"))
              .select(*others, "_row.*"))
