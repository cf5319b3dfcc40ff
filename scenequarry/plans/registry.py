"""Named queries, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def iou_sql(a: str = "a", b: str = "b", pixel: int = 0, floor: str | None = None) -> str:
    """Overlap of two row aliases' boxes."""
    i = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + {pixel}, 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + {pixel}, 0))"
    u = f"({area_sql(a, pixel)} + {area_sql(b, pixel)} - {i})"
    return f"({i} / {f'greatest({u}, {floor})' if floor else u})"


def area_sql(a: str, pixel: int = 0) -> str:
    return f"(({a}.x2 - {a}.x1 + {pixel}) * ({a}.y2 - {a}.y1 + {pixel}))"


def fold_sql(ranked: str, by: str, conflict: str) -> str:
    """CTEs that leave `kept(by, rk)`: elements of `ranked` (by, rk, ...) that no earlier kept one conflicts with; the
    conflict is over aliases k and e."""
    on = " AND ".join(f"k.{c} = e.{c}" for c in by.split(", "))
    eq = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in by.split(", "))
    e_by, r_by = (", ".join(f"{t}.{c}" for c in by.split(", ")) for t in ("e", "r"))
    return f"""cl AS (SELECT {e_by}, e.rk, list(k.rk) AS l FROM {ranked} k JOIN {ranked} e ON {on} AND k.rk < e.rk AND {conflict} GROUP BY {e_by}, e.rk),
    rec AS (SELECT DISTINCT {by}, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS l FROM {ranked}
        UNION ALL SELECT {r_by}, r.rk, CASE WHEN cl.l IS NOT NULL AND list_has_any(rec.l, cl.l) THEN rec.l ELSE list_append(rec.l, r.rk) END
        FROM rec JOIN {ranked} r ON {eq('r', 'rec')} AND r.rk = rec.rk + 1 LEFT JOIN cl ON {eq('cl', 'r')} AND cl.rk = r.rk),
    lastrec AS (SELECT {by}, max_by(l, rk) AS l FROM rec GROUP BY {by}),
    kept AS (SELECT {by}, unnest(l) AS rk FROM lastrec)"""
