"""Updates of JSON texts along a path: what the path names is replaced, and made where it is absent.

Paths: ``$`` for the whole, ``.name`` and ``["name"]`` for fields, ``[3]`` for an element, ``[*]`` for all that there are. An
absent or null parent becomes an object or a list, as the next step needs; a list that is too short is filled up with empty
objects. A parent of another kind (a field of a number, an element of an object) is left as it is, and so is the text then.

Defined results: a null text stays null, one that is not JSON stays as it is; an update that fits nothing returns the text
in compact form. Field order stays; new fields come last.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = str | int | None  # a field, an element, all elements
_STEP = re.compile(r"""\.([A-Za-z_][\w-]*)|\["((?:[^"\\]|\\.)*)"\]|\['([^']*)'\]|\[(\d+)\]|\[(\*)\]""")


def steps_of(path: str) -> list[Step]:
    """The steps of a path; the leading ``$`` may be left out."""
    rest = path.removeprefix("$")
    rest = rest if rest.startswith((".", "[")) or not rest else f".{rest}"
    out: list[Step] = []
    at = 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m:
            raise ValueError(f"cannot read {rest[at:]!r} in the path {path!r}")
        name, quoted, single, index, _ = m.groups()
        out.append(name if name is not None else json.loads(f'"{quoted}"') if quoted is not None else single if single is not None else int(index) if index is not None else None)
        at = m.end()
    return out


def updated(value: Any, steps: list[Step], new: Any) -> Any:
    """value with new at the steps. Parents are changed in place."""
    if not steps:
        return new
    step, rest = steps[0], steps[1:]
    if isinstance(step, str):
        value = {} if value is None else value
        if isinstance(value, dict):
            value[step] = updated(value.get(step), rest, new)
    elif isinstance(step, int):
        value = [] if value is None else value
        if isinstance(value, list):
            value.extend({} for _ in range(step - len(value)))
            if len(value) == step:
                value.append(None)
            value[step] = updated(value[step], rest, new)
    elif isinstance(value, list):
        value[:] = [updated(x, rest, new) for x in value]
    return value


def set_path(text: Column, path: str, value: Column) -> Column:
    """The JSON text with a value - a JSON text too - put at the path. A null value is JSON's null."""
    steps = steps_of(path)

    @F.arrow_udf("string")
    def put(texts: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for t, v in zip(texts.to_pylist(), values.to_pylist(), strict=True):
            try:
                out.append(None if t is None else json.dumps(updated(json.loads(t), steps, None if v is None else json.loads(v)), separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(t)
        return pa.array(out, pa.string())

    return put(text, value)
