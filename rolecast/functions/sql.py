"""Building blocks for expressions written as SQL text.

Long fallback chains and text steps make large expressions; one parsed text is
far quicker to build than hundreds of column calls.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant(value: object, schema: str) -> str:
    """A nested constant. ``from_json`` of a literal is folded once by the optimizer."""
    return f"from_json({quoted(json.dumps(value, ensure_ascii=False))}, '{schema}')"


def _named(body: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"{name} -> {body(name)}"


def bind(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it in ``body`` under a fresh name."""
    return f"get(transform(array({value}), {_named(body)}), 0)"


def each(array: str, body: Callable[[str], str]) -> str:
    return f"transform({array}, {_named(body)})"


def those(array: str, test: Callable[[str], str]) -> str:
    return f"filter({array}, {_named(test)})"


def apply(col: Column, body: Callable[[str], str]) -> Column:
    """A Column handed to SQL text under a fresh name, evaluated once."""
    return F.get(F.call_function("transform", F.array(col), F.expr(_named(body))), F.lit(0))
