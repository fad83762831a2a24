"""String leaves of JSON documents, in document order."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(document: str) -> list[str]:
    """All string values; keys, numbers, booleans and nulls are left out.

    Of a repeated key the last value counts, at the place of the first.  A
    document that isn't JSON raises.
    """
    out: list[str] = []
    todo = [json.loads(document)]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            todo.extend(reversed(v.values()))
        elif isinstance(v, list):
            todo.extend(reversed(v))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(document: pd.Series) -> pd.Series:
    return document.map(leaves, na_action="ignore")
