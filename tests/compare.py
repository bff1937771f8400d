"""Rows of both engines in one form."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def spark_rows(df) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()), key=str)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=str)
