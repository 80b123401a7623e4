"""Canonical JSON of nested columns, and ids and digests made from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_RARE = tuple((chr(code), f"\\u{code:04x}") for code in range(32) if chr(code) not in dict(_SHORT))
_PLAIN = rf"\A[^{''.join(f'\\x{ord(raw):02x}' for raw, _ in _SHORT + _RARE)}]*+\z"


def _quoted(text: Column) -> Column:
    """Marks are replaced in a loop over few nodes: written out, they make a method that Java never compiles."""
    marks = F.array(*[F.struct(F.lit(raw).alias("raw"), F.lit(shown).alias("shown")) for raw, shown in _SHORT + _RARE])
    body = F.when(text.rlike(_PLAIN), text).otherwise(F.aggregate(marks, text, lambda so_far, m: F.replace(so_far, m["raw"], m["shown"])))
    return F.concat(F.lit('"'), body, F.lit('"'))


def _plain(kind: T.DataType) -> bool:
    """Whether Spark writes these values in canonical form, but for the order of keys and capital digits of codes."""
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.StructType):
        return len(kind.fields) > 0 and all(_plain(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _in_order(value: Column, kind: T.DataType) -> Column:
    """The value with the keys of its structs in order."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.AtomicType):
        return F.transform(value, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON with the keys of objects in order at every level, no blanks, characters as they are and nulls kept.

    Strings, whole numbers, booleans, arrays, structs and maps with string keys. Other numbers have no one spelling, so they are an
    error; `float_bits` gives those of vectors as strings.
    """
    if isinstance(kind, T.StructType) and _plain(kind):
        written = F.array(F.to_json(_in_order(value, kind), {"ignoreNullFields": "false"}))
        return F.coalesce(F.get(F.transform(written, lambda j: F.when(F.contains(j, F.lit("\\u00")), _joined(value, kind)).otherwise(j)), F.lit(0)), F.lit("null"))
    return _joined(value, kind)


def _joined(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        text = _quoted(value)
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _joined(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}":'), _joined(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        pairs = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _joined(e["value"], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.coalesce(text, F.lit("null"))


def nested_id(prefix: str, value: Column, kind: T.DataType) -> Column:
    """prefix and the SHA-256 of the canonical JSON."""
    return F.concat(F.lit(prefix), F.sha2(canonical_json(value, kind), 256))


def float_bits(vector: Column) -> Column:
    """The components of a vector as eight hex digits each: big-endian 32-bit floats, the identity of what an index stores."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            made = []
            for v in vectors:
                digits = None if v is None else np.asarray(v, ">f4").tobytes().hex()
                made.append(None if digits is None else [digits[i : i + 8] for i in range(0, len(digits), 8)])
            yield pd.Series(made, dtype=object)

    return run(vector)
