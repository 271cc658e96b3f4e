"""Rows as comparable text, whatever engine they come from."""

from __future__ import annotations

import datetime
import decimal


def text(v) -> str:
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, list | tuple) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def spark_rows(df) -> list[str]:
    names = sorted(df.columns)
    return sorted("|".join(text(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str]]:
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(text(r[i]) for i in order) for r in rel.fetchall())
