"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math


def plain(x):
    if x is None:
        return None
    if type(x).__name__ == "Decimal":
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}") + 0.0
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in t))


def same(a, b) -> bool:
    if len(a) != len(b):
        return False
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-6)) for r, s in zip(a, b) for x, y in zip(r, s))


def check(df, relation) -> None:
    found, wanted = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    assert len(found) == len(wanted)
    assert same(found, wanted)
