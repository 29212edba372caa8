"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOUR_TYPE = "struct<r:double,g:double,b:double,a:double>"


def one_row(df: DataFrame) -> Column:
    """The single row of ``df`` as a struct column usable in any other query.

    It is planned as an uncorrelated scalar subquery: evaluated once per query,
    no join.  An empty ``df`` gives NULL.
    """
    return df.select(F.struct(*df.columns)).scalar()


def record(**columns: Column) -> Column:
    """A struct with these field names."""
    parts = []
    for name, value in columns.items():
        parts += [F.lit(name), value]
    return F.named_struct(*parts)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, low), high)


def smoothstep(t: Column) -> Column:
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def rgba(values: Sequence[float]) -> Column:
    """A colour constant."""
    return record(**{k: F.lit(float(v)) for k, v in zip("rgba", values)})


def lerp_colour(first: Column, second: Column, t: Column) -> Column:
    """Mix two colours; ``t`` is clamped to 0..1."""
    u = clamp(t, F.lit(0.0), F.lit(1.0))
    return record(**{k: first[k] * (F.lit(1.0) - u) + second[k] * u for k in "rgba"})


def lookup(key: Column, table: Mapping[str, object], default: Column, make=F.lit) -> Column:
    """Constant lookup as one CASE, so it stays inside generated code."""
    case = None
    groups: dict[object, list[str]] = {}
    for name, value in table.items():
        groups.setdefault(value, []).append(name)
    for value, names in groups.items():
        case = (F if case is None else case).when(key.isin(names), make(value))
    return case.otherwise(default)


def label_of(value: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Label whose word list holds ``value``; NULL when none does."""
    case = None
    for label, words in vocabulary.items():
        case = (F if case is None else case).when(value.isin(list(words)), F.lit(label))
    return case
