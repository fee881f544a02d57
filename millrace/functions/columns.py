"""Column expressions shared by the operators. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null where den is null or not positive."""
    return F.when(den > 0, num.cast("double") / den)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(x: Column, steps: list[tuple[float, str]], other: str, strict: bool = False) -> Column:
    """The label of the first threshold that x reaches (exceeds, if strict); null has the last label."""
    out = F.lit(other)
    for limit, label in reversed(steps):
        out = F.when(x > limit if strict else x >= limit, label).otherwise(out)
    return out


def points(x: Column, steps: list[tuple[float, int]]) -> Column:
    out = F.lit(0)
    for limit, p in reversed(steps):
        out = F.when(x >= limit, p).otherwise(out)
    return out


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def json_field(doc: Column, path: str, kind: str = "string") -> Column:
    """A typed field of a JSON text; what can't be read as the type is null."""
    return F.get_json_object(doc, path).try_cast(kind)


def first_match(rules: list[tuple[str, Column]], other: str | None = None) -> Column:
    """The code of the first rule that holds. An unknown condition doesn't hold."""
    out = F.lit(other)
    for code, holds in reversed(rules):
        out = F.when(holds, code).otherwise(out)
    return out


def all_matches(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, code) for code, holds in rules]))


def predicate(spec: dict) -> Column:
    """A condition from {field: value} or {field: {"gte"|"gt"|"lte"|"lt"|"eq": x, "in": [...]}}, all of which must hold."""
    ops = {"gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v, "eq": lambda c, v: c == v, "in": lambda c, v: c.isin(list(v))}
    found = [ops[op](F.col(f), v) for f, want in spec.items() for op, v in (want.items() if isinstance(want, dict) else [("eq", want)])]
    return reduce(lambda a, b: a & b, found, F.lit(True))


def hash_id(*cols: Column, prefix: str = "", length: int = 64) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, length))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """RFC 4122 version-5 UUID of a name, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
