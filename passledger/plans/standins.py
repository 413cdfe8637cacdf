"""Tracking-shaped views over the given tables.

The tables hold no tracking data, so these views give them the needed shape.
Every view keeps all rows of its table. The DuckDB text in ``CHECK_VIEWS`` says
the same thing and is used only by the checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
# 2024-01-01T00:00:00Z
ORIGIN_US = 1_704_067_200_000_000

_TELEMETRY = """
  event_id,
  {micros} AS ts_us,
  concat('C', user_id, '-', CAST(floor((day(ts) - 1) / 10) AS INT)) AS contact_id,
  concat('S', user_id % 4) AS spacecraft_id,
  concat('A', user_id % 7) AS system_id,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'Locked' ELSE 'Unlocked' END AS carrier_lock,
  CASE WHEN event_id % 53 = 0 THEN NULL
       ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 5 - 2 END AS ebn0,
  CAST(event_id * 37 % 900 AS DOUBLE) / 10 AS elevation_deg,
  CAST(event_id * 91 % 3600 AS DOUBLE) / 10 AS azimuth_deg,
  CASE WHEN event_id % 97 = 0 THEN NULL
       WHEN event_id % 101 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE value * 1000 - 50000 END AS doppler_hz
"""

_PASSES = """
  o_orderkey AS pass_no,
  concat('P', o_orderkey) AS contact_id,
  concat('V', o_custkey) AS spacecraft_id,
  concat('A', o_orderkey % 7) AS system_id,
  {micros} + (o_orderkey % 24) * 3600000000 AS start_us,
  {micros} + (o_orderkey % 24) * 3600000000 + (5 + o_orderkey % 11) * 60000000 AS stop_us,
  o_orderstatus AS status,
  o_orderpriority AS priority,
  CAST(o_totalprice AS DOUBLE) AS amount
"""

_BOOKINGS = """
  o_orderkey AS id, o_custkey AS antenna_id, o_orderstatus AS state,
  {micros} AS start_us,
  {micros} + (1 + o_orderkey % 3) * 2592000000000 AS end_us
"""

_STATE_ERRORS = """
  l_suppkey AS fit_id, l_linenumber % 2 AS segment,
  1704067200000000 + (l_orderkey % 48) * 600000000 AS t_us,
  CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'N' THEN 'prior' ELSE 'fitted' END AS solution,
  l_quantity - 25 AS dx_m, l_discount * 1000 - 50 AS dy_m, l_tax * 1000 - 40 AS dz_m,
  (l_quantity - 25) / 100 AS dvx_m_s, l_discount - 0.05 AS dvy_m_s, l_tax - 0.04 AS dvz_m_s
"""

_RESIDUALS = """
  l_suppkey AS fit_id,
  concat(l_suppkey, '-', l_linenumber) AS contact_id,
  l_linenumber AS pass_no,
  concat('A', l_suppkey % 7) AS system_id,
  1704067200000000 + (l_orderkey % 5000) * 1000000 AS t_us,
  l_extendedprice / 100 - 300 AS residual_hz,
  2.0 + l_linenumber AS sigma_hz,
  1.0 + l_discount * 10 AS j_time,
  l_quantity / 25 - 1 AS j_rate,
  1.0 AS j_bias,
  l_returnflag <> 'R' AS accepted
"""

_FIT_SCORES = """
  concat('V', CAST(floor(o_custkey / 8) AS INT)) AS spacecraft, o_orderstatus AS method,
  CAST(o_orderkey % 8 AS INT) + 1 AS prefix, o_orderkey AS fold_id,
  o_orderkey % 7 <> 0 AS success, o_orderkey % 5 <> 0 AS accepted,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice / 50000 END AS position_rmse_km,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice / 9000 END AS velocity_rmse_m_s,
  CAST(o_orderkey % 90 AS INT) AS sample_count,
  3.0 * (CAST(o_orderkey % 8 AS INT) + 1) AS elapsed_hours
"""

_STATES = """
  s_suppkey AS object_no, s_nationkey AS plane,
  7000000.0 + 100.0 * s_acctbal / 10 AS radius_m,
  CAST(s_suppkey % 360 AS DOUBLE) AS phase_deg,
  60.0 + s_nationkey AS inclination_deg
"""

_SQL_MICROS = "epoch_us({})"
_SPARK_MICROS = "unix_micros(CAST({} AS TIMESTAMP))"


def _select(columns: str, micros: str, column: str) -> str:
    return columns.replace("{micros}", micros.format(column))


def _check(columns: str, table: str, column: str = "") -> str:
    return f"SELECT {_select(columns, _SQL_MICROS, column)} FROM {table}"


CHECK_VIEWS = {
    "telemetry": _check(_TELEMETRY, "events", "ts"),
    "contacts": (
        "SELECT contact_id, min(spacecraft_id) AS spacecraft_id, min(system_id) AS system_id, "
        "min(ts_us) AS start_us, max(ts_us) AS stop_us FROM telemetry GROUP BY contact_id"
    ),
    "passes": _check(_PASSES, "orders", "o_orderdate"),
    "bookings": _check(_BOOKINGS, "orders", "o_orderdate"),
    "state_errors": _check(_STATE_ERRORS, "lineitem"),
    "residuals": _check(_RESIDUALS, "lineitem"),
    "fit_scores": _check(_FIT_SCORES, "orders"),
    "objects": _check(_STATES, "supplier"),
}


class Tables:
    """Lazily read tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, table: str, columns: str, column: str = "") -> DataFrame:
        parts = _select(columns, _SPARK_MICROS, column)
        return self.table(table).selectExpr(*_split(parts))

    @cached_property
    def telemetry(self) -> DataFrame:
        return self._view("events", _TELEMETRY, "ts")

    @cached_property
    def contacts(self) -> DataFrame:
        return self.telemetry.groupBy("contact_id").agg(
            F.min("spacecraft_id").alias("spacecraft_id"),
            F.min("system_id").alias("system_id"),
            F.min("ts_us").alias("start_us"),
            F.max("ts_us").alias("stop_us"),
        )

    @cached_property
    def passes(self) -> DataFrame:
        return self._view("orders", _PASSES, "o_orderdate")

    @cached_property
    def bookings(self) -> DataFrame:
        return self._view("orders", _BOOKINGS, "o_orderdate")

    @cached_property
    def state_errors(self) -> DataFrame:
        return self._view("lineitem", _STATE_ERRORS)

    @cached_property
    def residuals(self) -> DataFrame:
        return self._view("lineitem", _RESIDUALS)

    @cached_property
    def fit_scores(self) -> DataFrame:
        return self._view("orders", _FIT_SCORES)

    @cached_property
    def objects(self) -> DataFrame:
        return self._view("supplier", _STATES)


def _split(columns: str) -> list[str]:
    """Select items at bracket depth zero."""
    items, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(columns[start:i].strip())
            start = i + 1
    return [*items, columns[start:].strip()]
