"""JSON functions on text.

Paths are names joined by dots with ``[i]`` for array elements; ``[-1]`` is the tail of an array; a backslash
keeps ``. [ ] \\`` as part of a name; an empty name is a name.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TAIL = object()


def parse_path(path: str) -> list:
    """The steps of a path: names, indexes and TAIL."""
    steps: list = []
    name: list[str] | None = []  # None: right after an index, where no name is open
    i, n = 0, len(path)
    while i < n:
        c = path[i]
        if c == "\\":
            if i + 1 >= n or path[i + 1] not in ".[]\\":
                raise ValueError("a backslash escapes one of . [ ] \\ only")
            name = [*(name or []), path[i + 1]]
            i += 2
        elif c == ".":
            if name is not None:
                steps.append("".join(name))
            name = []
            i += 1
        elif c == "[":
            if name or (name is not None and i and path[i - 1] == "."):
                steps.append("".join(name))
            end = path.find("]", i)
            index = path[i + 1 : end] if end > 0 else ""
            if index == "-1":
                steps.append(TAIL)
            elif index.isdigit() and int(index) < 2**31:
                steps.append(int(index))
            else:
                raise ValueError("a bad array index in a JSON path")
            name = None
            i = end + 1
        else:
            name = [*(name or []), c]
            i += 1
    if name is not None:
        steps.append("".join(name))
    return steps


def _text(value: object) -> str | None:
    if value is None:
        return None
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def get_field(doc: str, path: str) -> str | None:
    value = json.loads(doc)
    for step in parse_path(path):
        if isinstance(step, str):
            if not isinstance(value, dict) or step not in value:
                return None
            value = value[step]
        else:
            if not isinstance(value, list) or not value or (step is not TAIL and step >= len(value)):
                return None
            value = value[-1 if step is TAIL else step]
    return _text(value)


def put_field(doc: str, path: str, new: str) -> str:
    """The document with a value set or created; [-1] appends; a clash of types changes nothing."""
    root, value, steps = json.loads(doc), json.loads(new), parse_path(path)
    holder: dict = {"": root}
    at, key = holder, ""
    for step in steps:
        have = at[key]
        if isinstance(step, str):
            if have is None:
                have = at[key] = {}
            if not isinstance(have, dict):
                return _text(root) if not isinstance(root, str) else json.dumps(root)
            have.setdefault(step, None)
            at, key = have, step
        else:
            if have is None:
                have = at[key] = []
            if not isinstance(have, list):
                return _text(root) if not isinstance(root, str) else json.dumps(root)
            if step is TAIL:
                step = len(have)
            have.extend([None] * (step + 1 - len(have)))
            at, key = have, step
    at[key] = value
    return json.dumps(holder[""], separators=(",", ":"), ensure_ascii=False)


def _strict(doc: Column, value: Column, kind: str = "string") -> Column:
    bad = doc.isNotNull() & F.call_function("try_parse_json", doc).isNull()
    return F.when(bad, F.raise_error(F.lit("invalid JSON")).cast(kind)).otherwise(value)


def field(doc: Column, path: str) -> Column:
    """Value at a path as text; NULL if absent; invalid JSON raises. Plain paths stay within the JVM."""
    steps = parse_path(path)
    if all(s is not TAIL and (not isinstance(s, str) or (s and "'" not in s)) for s in steps):
        return _strict(doc, F.get_json_object(doc, "$" + "".join(f"['{s}']" if isinstance(s, str) else f"[{s}]" for s in steps)))

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else get_field(d, path))

    return run(doc)


def array_element(doc: Column, index: Column) -> Column:
    """Element from 0; NULL if not an array or out of range."""
    is_array = F.json_array_length(doc).isNotNull()
    value = F.call_function("get_json_object", doc, F.concat(F.lit("$["), index.cast("string"), F.lit("]")))
    return _strict(doc, F.when(is_array & (index >= 0), value))


def array_length(doc: Column) -> Column:
    """NULL if not an array."""
    return _strict(doc, F.json_array_length(doc), "int")


def set_field(doc: Column, path: str, value: Column) -> Column:
    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or v is None else put_field(d, path, v) for d, v in zip(docs, values)], dtype=object)

    return run(doc, value)
