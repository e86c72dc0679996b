"""Merge patch: nested objects merge, null removes a key, all else replaces.

Where the target of a nested patch is not an object, the patch is stored as it is, nulls
included; keys that could reach a prototype are skipped.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.errors import EngineError
from foldlake.predicate import FORBIDDEN_KEYS, kind_of


def merge_patch(target: Any, patch: Any) -> Any:
    if not isinstance(patch, dict) or not isinstance(target, dict):
        return patch
    out = {k: v for k, v in target.items() if k not in FORBIDDEN_KEYS}
    for key, value in patch.items():
        if key in FORBIDDEN_KEYS:
            continue
        if value is None:
            out.pop(key, None)
        elif isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merge_patch(out[key], value)
        else:
            out[key] = value
    return out


def patch_json(body: Column, patch: dict) -> Column:
    """The patched JSON text of a JSON text, in Arrow batches: no built-in merges schemaless objects."""
    if not isinstance(patch, dict):
        raise EngineError("InvalidConfig", "a patch is an object")
    frozen = json.dumps(patch)

    def run(texts: pd.Series) -> pd.Series:
        p = json.loads(frozen)
        return texts.map(lambda t: None if t is None else json.dumps(merge_patch(json.loads(t), p), ensure_ascii=False, separators=(",", ":")))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(body)


def patch_variant(body: Column, patch: dict) -> Column:
    return F.parse_json(patch_json(F.to_json(body), patch))


def patch_typed(schema: T.StructType, patch: dict) -> dict[str, Column]:
    """For each top-level column that the patch names, the new column: built in, for patches that are constant.

    A key that the schema lacks, or a value of another kind, is an error, as a table has fixed columns.
    """
    out = {}
    for key, value in patch.items():
        if key in FORBIDDEN_KEYS:
            continue
        if key not in schema.names:
            raise EngineError("SchemaError", f"no column {key!r}")
        out[key] = _typed(F.col(f"`{key}`"), schema[key].dataType, value)
    return out


def _typed(col: Column, t: T.DataType, value: Any) -> Column:
    if value is None:
        return F.lit(None).cast(t)
    if isinstance(value, dict):
        if not isinstance(t, T.StructType):
            raise EngineError("SchemaError", "an object for a column that is none")
        for k, v in value.items():
            if k not in t.names:
                raise EngineError("SchemaError", f"no field {k!r}")
            col = col.withField(f"`{k}`", _typed(col.getField(k), t[k].dataType, v))
        return col
    if kind_of(value) == "array":
        return F.array(*map(F.lit, value)).cast(t)
    return F.lit(value).cast(t)
