"""Named queries with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import MIX_MODULUS, mix_factor
from ..sources.readings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}  # the statements without the views in front

# The views of the test tables, as DuckDB common table expressions in dependency order.
VIEWS: dict[str, str] = {
    "readings": """
SELECT b.*, consommation_kw * 1000 / tension_v * (cast(90 + (event_id * 31) % 21 as double) / 100) AS courant_a
FROM (SELECT event_id, ts, concat('SM_', lpad(cast(user_id as varchar), 4, '0')) AS meter_id,
    concat('Zone ', substr('ABCD', cast(user_id % 4 as int) + 1, 1)) AS zone,
    CASE WHEN user_id % 20 < 11 THEN 'residentiel' WHEN user_id % 20 < 16 THEN 'commercial' ELSE 'industriel' END AS type,
    cast(user_id % 14 as int) + 1 AS bus_id,
    value / cast(10 as double) AS consommation_kw,
    cast(190 as double) + cast((event_id * 7919) % 8001 as double) / 100 AS tension_v,
    cast(593 as double) / 10 + cast((event_id * 10473) % 141 as double) / 100 AS frequency_hz,
    cast(70 + (event_id * 13) % 30 as double) / 100 AS power_factor,
    CASE WHEN event_type = 'error' THEN 'ALERTE' ELSE 'NORMAL' END AS statut,
    CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 5 = 0 THEN 'Surcharge' WHEN event_id % 5 = 1 THEN 'Tension hors norme'
         WHEN event_id % 5 = 2 THEN 'Pic soudain' WHEN event_id % 5 = 3 THEN 'Fraude' ELSE 'Consommation nulle suspecte' END AS anomalies,
    CASE WHEN event_type <> 'error' THEN 'normal' WHEN event_id % 2 = 0 THEN 'fdia' ELSE 'dos' END AS attack_type,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_alert, props FROM events) b""",
    "alerts": """
SELECT event_id AS id, bus_id, meter_id, attack_type, 'anomaly' AS alert_type,
  cast(50 + event_id % 51 as double) / 100 AS confidence,
  CASE WHEN event_id % 51 > 30 THEN 'critical' ELSE 'warning' END AS severity,
  event_id % 3 = 0 AS is_resolved, ts AS created_at FROM readings WHERE is_alert = 1""",
    "meters": """
SELECT bus_id, avg(tension_v) AS voltage, avg(courant_a) AS current_a, sum(consommation_kw) AS power,
  CASE WHEN bus_id % 7 = 0 THEN 'offline' ELSE 'online' END AS status FROM readings GROUP BY bus_id""",
    "attack_schedule": """
SELECT event_id AS attack_id, bus_id, ts AS start_ts, 3600 * (1 + event_id % 24) AS duration_s,
  cast(1 + event_id % 10 as double) / 10 AS magnitude, CASE WHEN event_id % 100 = 0 THEN 'fdia' ELSE 'dos' END AS attack_type FROM readings WHERE is_alert = 1 AND event_id % 50 = 0""",
    "incidents": """
SELECT * FROM (VALUES (1, 'Zone A', 8, 11), (2, 'Zone B', 13, 18), (3, 'Zone A', 10, 14), (4, 'Zone C', 22, 3))
  AS t(incident_id, zone, start_hour, end_hour)""",
    "consumer_days": """
SELECT user_id AS cons_no, CASE WHEN user_id % 12 = 0 THEN 1 ELSE 0 END AS flag, cast(ts as date) AS day, sum(value) AS kwh
FROM events GROUP BY user_id, cast(ts as date)""",
    "scored": """
SELECT event_id, meter_id, ts, zone, type, anomalies, is_alert AS label,
  cast((event_id * 37) % 1000 + is_alert * 300 as double) / 1300 AS score,
  cast((event_id * 53) % 1000 + is_alert * 450 as double) / 1450 AS score_b FROM readings""",
}


def view(name: str, sql: str) -> None:
    """Add a DuckDB view other oracle statements may build on (after the ones it uses)."""
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix the statement with the views it mentions, directly or through other views."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(body)
    ctes = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed]
    text = sql.strip()
    if not ctes:
        return text
    head = re.match(r"(?is)^with\s+(recursive\s+)?", text)
    if head:
        word = "WITH RECURSIVE " if head.group(1) else "WITH "
        return word + ", ".join(ctes) + ", " + text[head.end():]
    return "WITH " + ", ".join(ctes) + " " + text


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its DuckDB statement if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            BODIES[name], ORACLES[name] = sql, with_views(sql)
        return fn

    return register


def R(expr: str, digits: int = 6) -> str:
    """DuckDB twin of ``functions.expr.r``."""
    return f"(round(cast({expr} as double), {digits}) + 0)"


def mix(seed: int, ident: str = "event_id") -> str:
    """DuckDB twin of ``functions.expr.mix_uniform``."""
    return f"(cast((({ident}) % {MIX_MODULUS} * {mix_factor(seed)} + {104_729 * (seed + 1)}) % {MIX_MODULUS} as double) / {MIX_MODULUS})"
