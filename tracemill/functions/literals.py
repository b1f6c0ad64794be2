"""Arrow helpers for values written as Python literals or JSON."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PROXY = re.compile(r"^\s*mappingproxy\((.*)\)\s*$", re.DOTALL)


def _plain(value: object) -> object:
    if isinstance(value, (set, frozenset)):
        return sorted(map(_plain, value), key=repr)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    found = _PROXY.match(text)
    body = found.group(1) if found else text
    for read in (json.loads, ast.literal_eval):
        try:
            return json.dumps(_plain(read(body.strip())), sort_keys=True)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return json.dumps(text)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys of JSON text, a Python literal or a mapping proxy; any other text as a JSON string."""
    return text.map(_canonical)
