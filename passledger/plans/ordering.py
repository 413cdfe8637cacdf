"""Queries for planning, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.operators import planning, sequences
from passledger.plans.registry import query
from passledger.plans.rounding import r, rd
from passledger.plans.standins import DAY_US, HOUR_US, MINUTE_US, ORIGIN_US, Tables

_ORDER = "row_number() OVER (PARTITION BY spacecraft_id ORDER BY stop_us, start_us, contact_id)"
YEARS_US = 900 * DAY_US


@query(
    "pass_labels",
    "W01",
    f"WITH @passes SELECT contact_id, printf('P%02d', {_ORDER}) AS label FROM passes",
)
def pass_labels(t: Tables) -> DataFrame:
    return planning.pass_labels(t.passes).select("contact_id", "label")


@query(
    "first_window",
    "W05",
    f"""WITH @passes, w AS (SELECT contact_id, stop_us, min(stop_us) OVER (PARTITION BY spacecraft_id) AS f FROM passes)
    SELECT contact_id FROM w WHERE stop_us <= f + {YEARS_US}""",
)
def first_window(t: Tables) -> DataFrame:
    return planning.first_window(t.passes, YEARS_US).select("contact_id")


_ORDERED = f"o AS (SELECT spacecraft_id, contact_id, start_us, stop_us, {_ORDER} AS ord FROM passes)"


@query(
    "group_expansion",
    "J08 T04 D03",
    f"""WITH @passes, {_ORDERED}, fam AS (SELECT * FROM (VALUES ('timing', 'single', 0), ('timing', 'cumulative', 1), ('sgp4_L+n', 'rolling', 2),
        ('sgp4_L+n', 'cumulative', 3), ('full_state', 'cumulative', 4)) v(method, strategy, family_rank)),
    g AS (SELECT spacecraft_id, method, strategy, family_rank,
       CASE strategy WHEN 'single' THEN ord WHEN 'rolling' THEN ord - 2 ELSE 1 END AS first_ordinal, ord AS last_ordinal, contact_id AS last_contact_id, stop_us AS checkpoint_us
       FROM o, fam WHERE strategy <> 'rolling' OR ord >= 3)
    SELECT spacecraft_id, method, strategy, family_rank, first_ordinal, last_ordinal, last_ordinal - first_ordinal + 1 AS pass_count, last_contact_id, checkpoint_us FROM g""",
)
def group_expansion(t: Tables) -> DataFrame:
    plan = planning.group_expansion(t.passes, t.passes)
    return plan.drop("last_start_us")


@query(
    "group_expansion_sql",
    "D03",
    f"""WITH @passes, {_ORDERED}, fam AS (SELECT * FROM (VALUES ('timing', 'single', 0), ('timing', 'cumulative', 1), ('sgp4_L+n', 'rolling', 2),
        ('sgp4_L+n', 'cumulative', 3), ('full_state', 'cumulative', 4)) v(method, strategy, family_rank)),
    g AS (SELECT spacecraft_id, method, strategy, family_rank,
       CASE strategy WHEN 'single' THEN ord WHEN 'rolling' THEN ord - 2 ELSE 1 END AS first_ordinal, ord AS last_ordinal, contact_id AS last_contact_id, stop_us AS checkpoint_us
       FROM o, fam WHERE strategy <> 'rolling' OR ord >= 3)
    SELECT spacecraft_id, method, strategy, family_rank, first_ordinal, last_ordinal, last_ordinal - first_ordinal + 1 AS pass_count, last_contact_id, checkpoint_us FROM g""",
)
def group_expansion_sql(t: Tables) -> DataFrame:
    """The same plan by the table function, from SQL."""
    planning.register_table_functions(t.spark)
    t.passes.select("spacecraft_id", "contact_id", "start_us", "stop_us").createOrReplaceTempView("passes_to_plan")
    return t.spark.sql("SELECT * FROM plan_groups(TABLE(passes_to_plan))")


@query(
    "group_members",
    "J08",
    f"""WITH @passes, {_ORDERED}, fam AS (SELECT * FROM (VALUES ('timing', 'single', 0), ('timing', 'cumulative', 1), ('sgp4_L+n', 'rolling', 2),
        ('sgp4_L+n', 'cumulative', 3), ('full_state', 'cumulative', 4)) v(method, strategy, family_rank)),
    g AS (SELECT o.*, method, strategy, CASE strategy WHEN 'single' THEN ord WHEN 'rolling' THEN ord - 2 ELSE 1 END AS low FROM o, fam WHERE strategy <> 'rolling' OR ord >= 3)
    SELECT g.method, g.strategy, g.contact_id AS last_contact_id, b.ord AS ordinal, b.contact_id FROM g JOIN o b ON g.spacecraft_id = b.spacecraft_id AND b.ord BETWEEN low AND g.ord""",
)
def group_members(t: Tables) -> DataFrame:
    passes = t.passes
    members = planning.group_members(planning.group_expansion(passes, passes), planning.pass_order(passes))
    return members.select("method", "strategy", "last_contact_id", "ordinal", "contact_id")


@query(
    "fold_expansion",
    "J07 A25",
    f"""WITH @passes, w AS (SELECT *, min(stop_us) OVER (PARTITION BY spacecraft_id) AS f FROM passes),
    o AS (SELECT spacecraft_id, contact_id, stop_us, {_ORDER} AS ord FROM w WHERE stop_us <= f + {YEARS_US}),
    g AS (SELECT p.spacecraft_id, p.ord AS prefix_count, h.ord AS held_ordinal, h.contact_id AS holdout_id, p.stop_us AS checkpoint_us FROM o p
       JOIN o h ON h.spacecraft_id = p.spacecraft_id AND h.ord <= p.ord WHERE p.ord > 1
       UNION ALL SELECT spacecraft_id, ord, 0, NULL, stop_us FROM o)
    SELECT spacecraft_id, method, prefix_count, held_ordinal, holdout_id, CAST(prefix_count - (held_ordinal > 0)::INT AS BIGINT) AS training_count, checkpoint_us,
      printf('%s/prefix-%02d/omit-%02d', method, prefix_count, held_ordinal) AS run_id,
      CASE WHEN held_ordinal = 0 THEN 'full-prefix forecast' WHEN held_ordinal = prefix_count THEN 'forward prediction'
        WHEN held_ordinal = 1 THEN 'reconstruction' ELSE 'interpolation' END AS validation_kind
    FROM g, (SELECT unnest(['sgp4_L+n', 'timing']) AS method)""",
)
def fold_expansion(t: Tables) -> DataFrame:
    ordered = planning.pass_order(planning.first_window(t.passes, YEARS_US))
    names = ("full-prefix forecast", "forward prediction", "reconstruction", "interpolation")
    return planning.fold_expansion(ordered).withColumn(
        "validation_kind", planning.validation_kind(names)
    )


@query(
    "omission_plan",
    "J07",
    """WITH @passes, n AS (SELECT spacecraft_id, count(*) AS passes FROM passes GROUP BY 1 HAVING count(*) >= 3),
    h AS (SELECT spacecraft_id, passes, NULL AS holdout_id FROM n UNION ALL SELECT n.spacecraft_id, passes, contact_id FROM n JOIN passes p ON p.spacecraft_id = n.spacecraft_id)
    SELECT spacecraft_id, passes, holdout_id, variant FROM h, (SELECT unnest(['sgp4_six', 'cartesian_no_drag']) AS variant)""",
)
def omission_plan(t: Tables) -> DataFrame:
    return planning.omission_plan(t.passes, ["sgp4_six", "cartesian_no_drag"])


@query(
    "causal_last_n",
    "W02",
    """WITH @passes, e AS (SELECT *, row_number() OVER (PARTITION BY spacecraft_id ORDER BY stop_us, contact_id) AS ord FROM passes WHERE status <> 'P'),
    s AS (SELECT unnest([1, 3, 5, 8]) AS size),
    m AS (SELECT a.contact_id AS anchor_id, size, a.ord, string_agg(b.contact_id, ',' ORDER BY b.ord) AS ids FROM e a, s JOIN e b ON b.spacecraft_id = a.spacecraft_id
       AND b.ord BETWEEN a.ord - size + 1 AND a.ord GROUP BY 1, 2, 3)
    SELECT p.contact_id AS anchor_id, s.size, coalesce(ids, '') AS contact_ids,
      CASE WHEN m.ord IS NULL THEN 'screening_failed' WHEN m.ord >= s.size THEN 'ready' ELSE 'warm_up' END AS status,
      CASE WHEN m.ord IS NULL THEN 'anchor_gated' ELSE '' END AS reason
    FROM passes p CROSS JOIN s LEFT JOIN m ON m.anchor_id = p.contact_id AND m.size = s.size""",
)
def causal_last_n(t: Tables) -> DataFrame:
    groups = planning.causal_groups(t.passes.where("status <> 'P'"), t.passes)
    return groups.drop("spacecraft_id").withColumn("contact_ids", F.array_join("contact_ids", ","))


@query(
    "top_fraction",
    "W10",
    """WITH @passes, c AS (SELECT contact_id, pass_no // 40 AS fit_id, stop_us, CASE WHEN pass_no % 19 = 0 THEN NULL WHEN pass_no % 7 = 0 THEN 5 ELSE 6 END AS rank,
       round(amount / 1000, 1) AS trace FROM passes),
    v AS (SELECT *, row_number() OVER (PARTITION BY fit_id ORDER BY trace, -stop_us, contact_id) AS place, count(*) OVER (PARTITION BY fit_id) AS n FROM c WHERE rank = 6)
    SELECT c.fit_id, c.contact_id, coalesce(place <= ceil(n * 0.4), false) AS selected, CASE WHEN c.rank IS NULL THEN 'pilot_failed' WHEN c.rank < 6 THEN 'rank_deficient'
      WHEN place <= ceil(n * 0.4) THEN 'selected' ELSE 'below_fraction' END AS reason FROM c LEFT JOIN v ON v.contact_id = c.contact_id""",
)
def top_fraction(t: Tables) -> DataFrame:
    candidates = t.passes.selectExpr(
        "contact_id",
        "pass_no div 40 AS fit_id",
        "stop_us",
        "CASE WHEN pass_no % 19 = 0 THEN NULL WHEN pass_no % 7 = 0 THEN 5 ELSE 6 END AS rank",
        "round(amount / 1000, 1) AS trace",
    )
    return planning.top_fraction(candidates, ["fit_id"], "trace", 0.4)


@query(
    "top_fraction_status",
    "W10",
    """WITH @passes, c AS (SELECT pass_no // 40 AS fit_id, CASE WHEN pass_no % 19 = 0 THEN NULL WHEN pass_no % 7 = 0 OR pass_no // 40 % 6 = 2 THEN 5 ELSE 6 END AS rank FROM passes)
    SELECT fit_id, count(*) AS candidates, CAST(ceil(count(*) FILTER (rank = 6) * 0.4) AS BIGINT) AS selected, count(*) FILTER (rank IS NULL) AS pilot_failed,
      count(*) FILTER (rank < 6) AS rank_deficient, CASE WHEN count(*) FILTER (rank = 6) > 0 THEN 'ready' ELSE 'selection_failed' END AS status FROM c GROUP BY 1""",
)
def top_fraction_status(t: Tables) -> DataFrame:
    candidates = t.passes.selectExpr(
        "contact_id", "pass_no div 40 AS fit_id", "stop_us",
        "CASE WHEN pass_no % 19 = 0 THEN NULL WHEN pass_no % 7 = 0 OR pass_no div 40 % 6 = 2 THEN 5 ELSE 6 END AS rank", "round(amount / 1000, 1) AS trace",
    )
    return planning.fraction_status(planning.top_fraction(candidates, ["fit_id"], "trace", 0.4), ["fit_id"])


@query(
    "best_duplicate",
    "W03",
    """WITH f AS (SELECT l_suppkey AS object_no, l_orderkey % 3000 AS epoch, l_tax AS sigma, l_orderkey * 10 + l_linenumber + l_partkey * 1000000 AS line FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY object_no, epoch ORDER BY sigma, line) AS n FROM f)
    SELECT object_no, epoch, line, CASE WHEN n = 1 THEN '' ELSE 'duplicate_epoch' END AS reason FROM b""",
)
def best_duplicate(t: Tables) -> DataFrame:
    fixes = t.table("lineitem").selectExpr(
        "l_suppkey AS object_no", "l_orderkey % 3000 AS epoch", "l_tax AS sigma",
        "l_orderkey * 10 + l_linenumber + l_partkey * 1000000 AS line",
    )
    return sequences.best_duplicate(fixes, ["object_no", "epoch"], "sigma", "line").drop("sigma")


@query(
    "conflicting_epochs",
    "W04",
    """WITH f AS (SELECT l_orderkey AS packet, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS line, 1000000 + (l_suppkey % 5) // 4 * 7 AS epoch_us FROM lineitem),
    g AS (SELECT *, lag(epoch_us) OVER (PARTITION BY packet ORDER BY line) AS prev FROM f)
    SELECT packet, arg_max(epoch_us, line) AS epoch_us, coalesce(bool_or(abs(epoch_us - prev) > 1), false) AS conflict FROM g GROUP BY packet""",
)
def conflicting_epochs(t: Tables) -> DataFrame:
    times = t.table("lineitem").selectExpr(
        "l_orderkey AS packet", "l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS line",
        "1000000 + (l_suppkey % 5) div 4 * 7 AS epoch_us",
    )
    return sequences.conflicting_epochs(times, "packet", "line", "epoch_us")


_W0, _W1 = ORIGIN_US + 100 * MINUTE_US, ORIGIN_US + 4000 * MINUTE_US


@query(
    "coverage_check",
    "W06",
    f"""WITH s AS (SELECT l_suppkey AS object_no, l_partkey * 10 + l_linenumber AS segment, {ORIGIN_US} + (l_orderkey % 5000) * {MINUTE_US} AS first_us,
       {ORIGIN_US} + (l_orderkey % 5000 + l_partkey % 70) * {MINUTE_US} AS last_us FROM lineitem),
    p AS (SELECT *, greatest(coalesce(max(last_us) OVER (PARTITION BY object_no ORDER BY first_us, last_us, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {_W0}), {_W0}) AS reached FROM s)
    SELECT object_no, count(*) AS segments, count(*) FILTER (first_us > reached AND reached < {_W1}) AS holes,
      NOT bool_or(first_us > reached AND reached < {_W1}) AND max(last_us) >= {_W1} AS covered FROM p GROUP BY 1""",
)
def coverage_check(t: Tables) -> DataFrame:
    segments = t.table("lineitem").selectExpr(
        "l_suppkey AS object_no", "l_partkey * 10 + l_linenumber AS segment",
        f"{ORIGIN_US} + (l_orderkey % 5000) * {MINUTE_US} AS first_us",
        f"{ORIGIN_US} + (l_orderkey % 5000 + l_partkey % 70) * {MINUTE_US} AS last_us",
    )
    return sequences.coverage_check(segments, ["object_no"], _W0, _W1, bucket_us=6 * HOUR_US)


@query(
    "emit_on_change",
    "W07",
    """WITH @telemetry, g AS (SELECT contact_id, ts_us, carrier_lock, row_number() OVER w AS n, lag(carrier_lock) OVER w AS prev FROM telemetry
      WINDOW w AS (PARTITION BY contact_id ORDER BY ts_us, event_id))
    SELECT contact_id, ts_us, carrier_lock FROM g WHERE n = 1 OR carrier_lock <> prev""",
)
def emit_on_change(t: Tables) -> DataFrame:
    rows = t.telemetry.select("contact_id", "ts_us", "event_id", "carrier_lock")
    return sequences.emit_on_change(
        rows, ["contact_id"], ["ts_us", "event_id"], F.expr("ts_us div 86400000000"), "carrier_lock"
    ).drop("event_id")


@query(
    "collapse_equal",
    "W08",
    """SELECT l_suppkey AS contact_no, l_orderkey % 4000 AS epoch, min(l_linenumber % 2) AS a, count(*) AS copies, count(DISTINCT l_linenumber % 2) > 1 AS conflict FROM lineitem GROUP BY 1, 2""",
)
def collapse_equal(t: Tables) -> DataFrame:
    rows = t.table("lineitem").selectExpr(
        "l_suppkey AS contact_no", "l_orderkey % 4000 AS epoch", "l_linenumber % 2 AS a"
    )
    return sequences.collapse_equal(rows, ["contact_no", "epoch"], ["a"])


@query(
    "lock_edges",
    "W11",
    f"""WITH p AS (SELECT o_orderkey // 12 AS sweep, o_orderkey % 12 AS i, (o_orderkey % 12) * 0.5 - 3 AS off,
       o_orderkey % 12 BETWEEN (o_orderkey // 12) % 9 AND (o_orderkey // 12) % 9 + (o_orderkey // 12) % 5 - 1 AS locked FROM orders),
    l AS (SELECT sweep, min(i) FILTER (locked) AS le FROM p GROUP BY 1),
    u AS (SELECT p.sweep, le, min(i) FILTER (NOT locked AND i > le) AS un FROM p JOIN l ON l.sweep = p.sweep GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN le IS NULL THEN 'no_lock_window' WHEN le = 0 THEN 'open_at_start' WHEN un IS NULL THEN 'open_at_end' ELSE 'lock_window_midpoint' END AS status FROM u)
    SELECT sweep, status, CASE WHEN status = 'lock_window_midpoint' THEN {rd('le * 0.5 - 3')} END AS left_edge_s,
      CASE WHEN status = 'lock_window_midpoint' THEN {rd('(un - 1) * 0.5 - 3')} END AS right_edge_s,
      CASE WHEN status = 'lock_window_midpoint' THEN {rd('(le + un - 1) * 0.25 - 3')} END AS midpoint_s FROM s""",
)
def lock_edges(t: Tables) -> DataFrame:
    probes = t.table("orders").selectExpr(
        "o_orderkey div 12 AS sweep", "o_orderkey % 12 AS probe_index", "(o_orderkey % 12) * 0.5D - 3 AS offset_s",
        "o_orderkey % 12 BETWEEN (o_orderkey div 12) % 9 AND (o_orderkey div 12) % 9 + (o_orderkey div 12) % 5 - 1 AS locked",
    )
    out = sequences.lock_edges(probes, ["sweep"])
    return out.select("sweep", "status", *[r(c).alias(c) for c in out.columns[2:]])


@query(
    "debounce",
    "W12",
    """WITH @telemetry, g AS (SELECT contact_id, ts_us, event_id, carrier_lock, row_number() OVER w AS n,
        CASE WHEN lag(carrier_lock) OVER w IS DISTINCT FROM carrier_lock THEN 1 ELSE 0 END AS c FROM telemetry WINDOW w AS (PARTITION BY contact_id ORDER BY ts_us, event_id)),
    i AS (SELECT *, sum(c) OVER (PARTITION BY contact_id ORDER BY n) AS isl FROM g),
    k AS (SELECT *, row_number() OVER (PARTITION BY contact_id, isl ORDER BY n) AS k FROM i)
    SELECT contact_id, ts_us, carrier_lock FROM k WHERE k % 3 = 0""",
)
def debounce(t: Tables) -> DataFrame:
    rows = t.telemetry.select("contact_id", "ts_us", "event_id", "carrier_lock")
    return sequences.debounce(
        rows, ["contact_id"], ["ts_us", "event_id"], F.expr("ts_us div 86400000000"), "carrier_lock", 3
    ).drop("event_id")


@query(
    "recent_rows",
    "T01",
    "WITH @passes SELECT contact_id, start_us, status FROM passes ORDER BY start_us DESC, pass_no DESC LIMIT 200",
)
def recent_rows(t: Tables) -> DataFrame:
    newest = t.passes.orderBy(F.desc("start_us"), F.desc("pass_no")).limit(200)
    return newest.select("contact_id", "start_us", "status")


@query(
    "recent_events",
    "T01",
    "SELECT event_id, event_type, epoch_us(ts) AS created_us FROM events ORDER BY created_us DESC, event_id DESC LIMIT 100",
)
def recent_events(t: Tables) -> DataFrame:
    rows = t.table("events").selectExpr(
        "event_id", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS created_us"
    )
    return rows.orderBy(F.desc("created_us"), F.desc("event_id")).limit(100)


_GRID = "SELECT l_suppkey AS fit_id, (l_linenumber - 4) * 10.0 AS offset_s, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS cost FROM lineitem GROUP BY 1, 2"


def _grid(t: Tables) -> DataFrame:
    return (
        t.table("lineitem")
        .groupBy(F.col("l_suppkey").alias("fit_id"), ((F.col("l_linenumber") - 4) * 10.0).alias("offset_s"))
        .agg(F.round(F.sum("l_extendedprice") * 100).cast("long").alias("cost"))
    )


@query(
    "grid_argmin",
    "T02",
    f"WITH g AS ({_GRID}) SELECT fit_id, CAST(arg_min(offset_s, (cost, offset_s)) AS DOUBLE) AS offset_s, min(cost) AS cost FROM g GROUP BY 1",
)
def grid_argmin(t: Tables) -> DataFrame:
    return _grid(t).groupBy("fit_id").agg(
        F.min_by("offset_s", F.struct("cost", "offset_s")).alias("offset_s"), F.min("cost").alias("cost")
    )


@query(
    "sweep_bracket",
    "T05",
    f"""WITH g AS ({_GRID}), b AS (SELECT fit_id, CAST(arg_min(offset_s, (cost, offset_s)) AS DOUBLE) AS o, min(cost) AS c FROM g GROUP BY 1)
    SELECT g.fit_id, o AS best_offset_s, c AS best_score, CAST(max(offset_s) FILTER (offset_s < o) AS DOUBLE) AS below_s, CAST(min(offset_s) FILTER (offset_s > o) AS DOUBLE) AS above_s,
      max(offset_s) FILTER (offset_s < o) IS NOT NULL AND min(offset_s) FILTER (offset_s > o) IS NOT NULL AS interior FROM g JOIN b ON b.fit_id = g.fit_id GROUP BY 1, 2, 3""",
)
def sweep_bracket(t: Tables) -> DataFrame:
    return sequences.sweep_bracket(_grid(t), ["fit_id"], "offset_s", "cost")


@query(
    "attempt_order",
    "T04",
    f"""WITH @passes, {_ORDERED}, f AS (SELECT *, unnest([0, 1]) AS family FROM o)
    SELECT contact_id, family, row_number() OVER (PARTITION BY spacecraft_id ORDER BY stop_us, start_us, contact_id, family) AS place FROM f""",
)
def attempt_order(t: Tables) -> DataFrame:
    from passledger.operators.ordered import ordinal

    rows = t.passes.select(
        "spacecraft_id", "contact_id", "stop_us", "start_us", F.explode(F.array(F.lit(0), F.lit(1))).alias("family")
    )
    placed = ordinal(
        rows, ["spacecraft_id"], ["stop_us", "start_us", "contact_id", "family"],
        F.expr("stop_us div 86400000000"), "place",
    )
    return placed.select("contact_id", "family", "place")


@query(
    "vertical_concat",
    "U01",
    """SELECT solution, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT 'source' AS solution, o_orderkey AS k FROM orders UNION ALL
      SELECT 'prior', l_orderkey FROM lineitem UNION ALL SELECT 'fitted', event_id FROM events) GROUP BY 1""",
)
def vertical_concat(t: Tables) -> DataFrame:
    parts = [("source", "orders", "o_orderkey"), ("prior", "lineitem", "l_orderkey"), ("fitted", "events", "event_id")]
    frames = [t.table(n).select(F.lit(s).alias("solution"), F.col(c).alias("k")) for s, n, c in parts]
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return whole.groupBy("solution").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query(
    "set_difference",
    "U02",
    """SELECT 'missing' AS kind, k FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'common', k FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders)""",
)
def set_difference(t: Tables) -> DataFrame:
    lines = t.table("lineitem")
    planned = t.table("orders").select(F.col("o_orderkey").alias("k"))
    missing = planned.subtract(lines.select(F.col("l_orderkey").alias("k")))
    common = lines.select(F.col("l_suppkey").alias("k")).intersect(
        t.table("orders").select(F.col("o_custkey").alias("k"))
    )
    return missing.select(F.lit("missing").alias("kind"), "k").unionByName(
        common.select(F.lit("common").alias("kind"), "k")
    )


@query(
    "fallback_union",
    "U03",
    """WITH w AS (SELECT c_custkey FROM customer), r AS (SELECT o_custkey AS k, max(o_orderkey) AS id FROM orders GROUP BY 1)
    SELECT c_custkey AS spacecraft, coalesce(CAST(id AS VARCHAR), 'none yet') AS recent FROM w LEFT JOIN r ON k = c_custkey""",
)
def fallback_union(t: Tables) -> DataFrame:
    wanted = t.table("customer").select(F.col("c_custkey").alias("spacecraft"))
    recent = t.table("orders").groupBy(F.col("o_custkey").alias("spacecraft")).agg(
        F.max("o_orderkey").cast("string").alias("recent")
    )
    found = recent.join(wanted, "spacecraft", "left_semi")
    absent = wanted.join(recent, "spacecraft", "left_anti").withColumn("recent", F.lit("none yet"))
    return found.unionByName(absent)


@query(
    "ordered_unique",
    "U04",
    """WITH n AS (SELECT o_orderkey AS id, unnest([o_orderstatus, '', o_orderpriority, o_orderstatus]) AS note, unnest([1, 2, 3, 4]) AS p FROM orders),
    f AS (SELECT id, note, min(p) AS p FROM n WHERE note <> '' GROUP BY 1, 2) SELECT id, string_agg(note, '; ' ORDER BY p) AS notes FROM f GROUP BY 1""",
)
def ordered_unique(t: Tables) -> DataFrame:
    notes = F.array("o_orderstatus", F.lit(""), "o_orderpriority", "o_orderstatus")
    kept = F.array_distinct(F.filter(notes, lambda x: x != ""))
    return t.table("orders").select(F.col("o_orderkey").alias("id"), F.array_join(kept, "; ").alias("notes"))
