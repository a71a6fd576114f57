"""JSON whose records differ: one type that holds them all, and columns of that type.

Each text becomes a variant, whose schema is merged with the others in the tasks and then over all: fields that only some
records have are kept, numbers widen, and a place that holds values that have no common type stays text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.operators.mapping import named

_SIMPLE = {
    "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "STRING": T.StringType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "BINARY": T.BinaryType(),
    # No value at all, and values of several kinds.
    "VOID": T.StringType(), "VARIANT": T.StringType(),
}


def _tokens(text: str) -> Iterator[str]:
    """Names in backticks, words with their bracketed numbers, and signs of a schema text."""
    i = 0
    while i < len(text):
        if text[i] == "`":
            end, name = i + 1, ""
            while True:
                stop = text.index("`", end)
                name += text[end:stop]
                if text[stop + 1 : stop + 2] != "`":
                    break
                name, end = name + "`", stop + 2
            yield "`" + name
            i = stop + 1
        elif text[i] in "<>,:":
            yield text[i]
            i += 1
        elif text[i] == " ":
            i += 1
        else:
            end = i
            while end < len(text) and text[end] not in "<>:" and (text[end] != "," or "(" in text[i:end] and ")" not in text[i:end]):
                end += 1
            yield text[i:end].strip()
            i = end


def type_of_schema(text: str) -> T.DataType:
    """Type of a merged schema as the aggregate writes it: ``OBJECT<a: ARRAY<BIGINT>>``."""
    tokens = list(_tokens(text))
    at = 0

    def read() -> T.DataType:
        nonlocal at
        word = tokens[at]
        at += 1
        if word in ("OBJECT", "ARRAY") and at < len(tokens) and tokens[at] == "<":
            at += 1
            if word == "ARRAY":
                out: T.DataType = T.ArrayType(read())
            else:
                fields = []
                while tokens[at] != ">":
                    name = tokens[at].removeprefix("`")
                    at += 2
                    fields.append(T.StructField(name, read()))
                    at += tokens[at] == ","
                out = T.StructType(fields)
            at += 1
            return out
        if word.startswith("DECIMAL"):
            inner = word[word.index("(") + 1 : word.index(")")].split(",")
            return T.DecimalType(int(inner[0]), int(inner[1]))
        return _SIMPLE[word] if word in _SIMPLE else T.StructType([])

    return read()


def _fits_json(kind: T.DataType) -> T.DataType:
    """The type as a reader of JSON takes it: an object without fields holds nothing that can be named, so it stays text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _fits_json(f.dataType)) for f in kind.fields]) if kind.fields else T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_fits_json(kind.elementType))
    return kind


def infer_json(df: DataFrame, column: str) -> T.DataType:
    """The one type that holds all JSON texts of a column; texts that are no JSON, and nulls, say nothing."""
    row = df.agg(F.schema_of_variant_agg(F.try_parse_json(named(column))).alias("s")).first()
    return _fits_json(type_of_schema(row["s"] or "VOID"))


def with_parsed(df: DataFrame, column: str, kind: T.DataType | None = None, name: str = "parsed") -> DataFrame:
    """Adds the column as values of the given type, or of the inferred one; null where a text is no JSON.

    Places with values of several kinds are text: strings as they are, all else as JSON.
    """
    kind = infer_json(df, column) if kind is None else kind
    if isinstance(kind, T.StructType | T.ArrayType):
        return df.withColumn(name, F.from_json(named(column), kind))
    return df.withColumn(name, F.try_variant_get(F.try_parse_json(named(column)), "$", kind.simpleString()))


def type_paths(kind: T.DataType, path: str = "") -> Iterator[tuple[str, str]]:
    """Path and type of each value that is no object or array: ``a.b``, ``c[]``."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from type_paths(f.dataType, f"{path}.{f.name}" if path else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from type_paths(kind.elementType, f"{path}[]")
    else:
        yield path, kind.simpleString()
