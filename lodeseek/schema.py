"""The capsule row type and the order that breaks all ties."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: properties keep their order, so they are a list of pairs, not a map.
PROPERTIES = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))

CAPSULE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("calls", T.ArrayType(T.StringType())),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("properties", PROPERTIES),
        T.StructField("seq", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
FIELDS = [f.name for f in CAPSULE.fields]


def capsule_id(path: Column, line: Column, signature: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", path, line.cast("string"), signature), 256), 1, 32)


def ord_struct() -> Column:
    """Total order of capsules: file, line, place in the file."""
    return F.struct("file_path", "start_line", "seq")


def prop(name: str) -> Column:
    """A property's value, or null."""
    return F.try_element_at(F.transform(F.filter("properties", lambda p: p.k == name), lambda p: p.v), F.lit(1))
