"""Queries for study statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.operators import planning, study
from passledger.operators.ranges import salted_join
from passledger.plans.joining import _JOBS, jobs, variant_folds
from passledger.plans.ordering import _ORDER, YEARS_US
from passledger.plans.registry import query
from passledger.plans.rounding import r, rd
from passledger.plans.standins import DAY_US, Tables
from passledger.session import cut_lineage


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: r(c) for c in columns})


_NORM = "sqrt(dx_m*dx_m + dy_m*dy_m + dz_m*dz_m) / 1000"
_SOLS = ("source", "prior", "corrected")


@query(
    "contact_results",
    "A14",
    f"""WITH @state_errors, e AS (SELECT fit_id * 2 + segment AS contact_id, CASE solution WHEN 'fitted' THEN 'corrected' ELSE solution END AS solution, {_NORM} AS d FROM state_errors),
    c AS (SELECT s_suppkey * 2 + g AS contact_id, (s_suppkey + g) % 6 <> 0 AS success FROM supplier, (SELECT unnest([0, 1]) AS g)),
    u AS (SELECT e.*, success FROM e JOIN c USING (contact_id) WHERE solution <> 'corrected' OR success),
    a AS (SELECT contact_id, {', '.join(f"{rd(f'median(d) FILTER (solution = {s!r})')} AS {s}_median_km, {rd(f'sqrt(avg(d*d) FILTER (solution = {s!r}))')} AS {s}_rms_km" for s in _SOLS)},
       count(*) FILTER (solution = 'source') AS n FROM u GROUP BY 1)
    SELECT c.contact_id, success, coalesce(n, 0) AS gps_fixes, coalesce(n, 0) >= 5 AS primary, {', '.join(f'{s}_median_km, {s}_rms_km' for s in _SOLS)},
      CASE WHEN NOT success THEN 'not_converged' WHEN coalesce(n, 0) = 0 THEN 'no_fixes' ELSE '' END AS reason
    FROM c LEFT JOIN a USING (contact_id)""".replace("primary,", '"primary",'),
)
def contact_results(t: Tables) -> DataFrame:
    out = _contact_results(t)
    return _rounded(out, *[c for c in out.columns if c.endswith("_km")])


def _contact_results(t: Tables) -> DataFrame:
    errors = t.state_errors.selectExpr(
        "fit_id * 2 + segment AS contact_id",
        "CASE solution WHEN 'fitted' THEN 'corrected' ELSE solution END AS solution",
        f"{_NORM} AS error_km",
    )
    contacts = t.table("supplier").withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
        "s_suppkey * 2 + g AS contact_id", "(s_suppkey + g) % 6 <> 0 AS success"
    )
    return study.contact_results(contacts, errors)


@query(
    "study_aggregate",
    "A15",
    f"""WITH @passes, c AS (SELECT pass_no % 5 AS station, status <> 'P' AS success, pass_no % 3 <> 0 AS prim, CASE WHEN status <> 'P' THEN amount / 1000 END AS m FROM passes)
    SELECT station, count(*) AS fitted_contacts, count(*) FILTER (success) AS converged_contacts, count(*) FILTER (prim) AS primary_contacts,
      count(*) FILTER (prim AND m IS NOT NULL) AS scored_primary_contacts, {rd('median(m) FILTER (prim)')} AS median_contact_error_km FROM c GROUP BY 1""",
)
def study_aggregate(t: Tables) -> DataFrame:
    results = t.passes.selectExpr(
        "pass_no % 5 AS station", "status <> 'P' AS success", "pass_no % 3 <> 0 AS primary",
        "CASE WHEN status <> 'P' THEN amount / 1000 END AS corrected_median_km",
    )
    return _rounded(study.study_aggregate(results, ["station"]), "median_contact_error_km")


@query(
    "distribution_table",
    "A16",
    f"""WITH @fit_scores, l AS (SELECT spacecraft, method, unnest(CASE WHEN accepted THEN ['all', 'kept'] ELSE ['all'] END) AS selection, position_rmse_km, velocity_rmse_m_s FROM fit_scores),
    m AS (SELECT spacecraft, method, selection, 'position_rmse_km' AS metric, position_rmse_km AS v FROM l UNION ALL SELECT spacecraft, method, selection, 'velocity_rmse_m_s', velocity_rmse_m_s FROM l)
    SELECT spacecraft, method, selection, metric, count(*) AS attempted, count(v) AS scored, {rd('min(v)')} AS low, {rd('max(v)')} AS high, {rd('median(v)')} AS median FROM m GROUP BY 1, 2, 3, 4""",
)
def distribution_table(t: Tables) -> DataFrame:
    out = study.distribution_table(
        t.fit_scores, ["spacecraft", "method"], ["position_rmse_km", "velocity_rmse_m_s"], F.col("accepted")
    )
    return _rounded(out, "low", "high", "median")


@query(
    "pooled_rms",
    "A17",
    f"""WITH @fit_scores SELECT spacecraft, {rd('sqrt(sum(sample_count * position_rmse_km * position_rmse_km) FILTER (sample_count > 0) / sum(sample_count) FILTER (position_rmse_km IS NOT NULL AND sample_count > 0))')} AS pooled
    FROM fit_scores GROUP BY 1""",
)
def pooled_rms(t: Tables) -> DataFrame:
    pooled = study.pooled_rms("position_rmse_km", "sample_count")
    return t.fit_scores.groupBy("spacecraft").agg(r(pooled).alias("pooled"))


@query(
    "all_vs_screened",
    "A18",
    f"""WITH @fit_scores, l AS (SELECT method, unnest(CASE WHEN accepted THEN ['all', 'screened'] ELSE ['all'] END) AS selection, position_rmse_km AS v, sample_count AS n FROM fit_scores)
    SELECT method, selection, count(v) AS scored, {rd('median(v)')} AS median, {rd('sqrt(sum(n * v * v) / sum(n) FILTER (v IS NOT NULL))')} AS pooled FROM l GROUP BY 1, 2""",
)
def all_vs_screened(t: Tables) -> DataFrame:
    out = study.all_and_screened(
        t.fit_scores, ["method"], "position_rmse_km", "sample_count", F.col("accepted")
    )
    return _rounded(out, "pooled", "median")


@query(
    "reduction",
    "A19",
    f"""WITH @fit_scores SELECT fold_id, {rd('CASE WHEN accepted AND coalesce(position_rmse_km, 0) <> 0 THEN 100.0 * (position_rmse_km - velocity_rmse_m_s / 10) / position_rmse_km END')} AS reduction_pct FROM fit_scores""",
)
def reduction(t: Tables) -> DataFrame:
    value = study.reduction_percent(
        F.col("position_rmse_km"), F.col("velocity_rmse_m_s") / 10, F.col("accepted")
    )
    return t.fit_scores.select("fold_id", r(value).alias("reduction_pct"))


@query(
    "variant_summary",
    "A20",
    f"""
    WITH f AS (SELECT concat('V', o_orderkey // 3 // 5) AS spacecraft, o_orderkey // 3 AS holdout_id, ['base', 'bstar', 'drag'][o_orderkey % 3 + 1] AS variant,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 1000 END AS score, o_orderkey % 11 <> 0 AS success, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 1e7 END AS k FROM orders),
    p AS (SELECT a.spacecraft, a.variant, count(*) AS paired_folds, avg(a.score - b.score) AS d, count(*) FILTER (a.score < b.score) AS improved_folds
       FROM f a JOIN f b USING (spacecraft, holdout_id) WHERE b.variant = 'base' AND a.variant <> 'base' AND a.score IS NOT NULL AND b.score IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT spacecraft, variant, count(*) AS folds, count(score) AS scored_folds, count(*) FILTER (NOT success) AS failed_folds, {rd('avg(score)')} AS mean_score,
       {rd('avg(k)')} AS coefficient_mean, {rd('stddev_pop(k)')} AS coefficient_std FROM f GROUP BY 1, 2)
    SELECT g.*, paired_folds, {rd('d')} AS paired_delta, improved_folds FROM g LEFT JOIN p ON p.spacecraft = g.spacecraft AND p.variant = g.variant""",
)
def variant_summary(t: Tables) -> DataFrame:
    out = study.variant_summary(
        variant_folds(t), ["spacecraft"], "variant", "base", "score", "coefficient"
    )
    return _rounded(out, "mean_score", "coefficient_mean", "coefficient_std", "paired_delta")


# --- the omission study: folds, qualification, attainment, population ----------

_FOLDS = f"""
    w AS (SELECT *, min(stop_us) OVER (PARTITION BY spacecraft_id) AS f FROM passes),
    o AS (SELECT spacecraft_id, CAST(substring(spacecraft_id, 2) AS BIGINT) AS c, contact_id, stop_us, f, {_ORDER} AS ord FROM w WHERE stop_us <= f + {YEARS_US}),
    g AS (SELECT p.spacecraft_id, p.c, p.ord AS prefix_count, h.ord AS held_ordinal, p.stop_us, p.f FROM o p JOIN o h ON h.spacecraft_id = p.spacecraft_id AND h.ord <= p.ord WHERE p.ord > 1
       UNION ALL SELECT spacecraft_id, c, ord, 0, stop_us, f FROM o),
    x AS (SELECT *, CASE method WHEN 'timing' THEN 1 ELSE 0 END AS m FROM g, (SELECT unnest(['sgp4_L+n', 'timing']) AS method)),
    folds AS (SELECT spacecraft_id, method, prefix_count, held_ordinal, (c * 3 + prefix_count * 7 + held_ordinal * 5 + m) % 11 <> 0 AS success,
       (c * 5 + prefix_count + held_ordinal * 3 + m) % 6 <> 0 AS accepted,
       CASE WHEN (c + prefix_count * held_ordinal) % 29 = 0 THEN NULL ELSE ((c * 31 + prefix_count * 170 + held_ordinal * 13 + m) % 900) / 100.0 END AS position_rmse_km,
       CASE WHEN c % 19 = 0 THEN 'partial' ELSE 'complete' END AS coverage, (stop_us - f) / {YEARS_US} * 24.0 AS elapsed_hours FROM x
       )"""
# A study that lost some of its folds.
_GAP = "NOT (prefix_count = 5 AND held_ordinal = 2)"
_LOST = f"{_FOLDS.rstrip().removesuffix(')')} WHERE {_GAP})"
_QUALIFY = """
    q AS (SELECT spacecraft_id, method, prefix_count, count(*) AS folds, count(*) FILTER (success AND accepted) AS accepted_folds, count(position_rmse_km) AS scored_folds,
       median(CASE WHEN success AND accepted THEN position_rmse_km ELSE 1e300 END) AS md, count(*) FILTER (coverage NOT IN ('complete', 'unknown')) AS unc,
       count(*) FILTER (success AND accepted AND position_rmse_km IS NULL) AS uns FROM folds WHERE held_ordinal > 0 GROUP BY 1, 2, 3),
    qq AS (SELECT *, CASE WHEN unc > 0 THEN 'uncovered' WHEN uns > 0 THEN 'unscored' WHEN md > 1e299 THEN 'not_attained' ELSE 'available' END AS status FROM q)"""
_PREFIXES = """
    s AS (SELECT spacecraft_id, method, prefix_count, count(*) FILTER (held_ordinal = 0) AS fu, count(*) FILTER (held_ordinal > 0) AS planned_folds,
       count(DISTINCT CASE WHEN held_ordinal > 0 THEN held_ordinal END) AS di, max(CASE WHEN held_ordinal = 0 THEN position_rmse_km END) AS full_prefix_rmse_km, max(elapsed_hours) AS elapsed_hours FROM folds GROUP BY 1, 2, 3),
    sw AS (SELECT s.*, fu = 1 AND planned_folds = CASE WHEN s.prefix_count > 1 THEN s.prefix_count ELSE 0 END AND di = planned_folds AS whole, accepted_folds, scored_folds, md, status AS st
       FROM s LEFT JOIN qq ON qq.spacecraft_id = s.spacecraft_id AND qq.method = s.method AND qq.prefix_count = s.prefix_count),
    prefixes AS (SELECT spacecraft_id, method, prefix_count, elapsed_hours, planned_folds, coalesce(accepted_folds, 0) AS accepted_folds, coalesce(scored_folds, 0) AS scored_folds,
       CASE WHEN whole AND st = 'available' THEN md END AS median_km, CASE WHEN NOT whole THEN 'folds_incomplete' WHEN st IS NULL THEN 'no_folds_of_one_pass' ELSE st END AS status, full_prefix_rmse_km FROM sw)"""
_ATTAIN = """
    tr AS (SELECT *, unnest([5.0, 2.0]) AS threshold_km FROM prefixes),
    attain AS (SELECT spacecraft_id, method, CAST(threshold_km AS DOUBLE) AS threshold_km, min(elapsed_hours) FILTER (median_km < threshold_km) AS h,
       arg_min(prefix_count, (elapsed_hours, prefix_count)) FILTER (median_km < threshold_km) AS prefix_count,
       arg_min(median_km, (elapsed_hours, prefix_count)) FILTER (median_km < threshold_km) AS median_km, max(elapsed_hours) AS last_h FROM tr GROUP BY 1, 2, 3)"""


def fold_rows(t: Tables) -> DataFrame:
    """The fold table of a study: planned folds with stand-in outcomes."""
    window = planning.first_window(t.passes, YEARS_US)
    # The first completion comes with the few passes, before they are expanded.
    first = window.groupBy("spacecraft_id").agg(F.min("stop_us").alias("f"))
    ordered = salted_join(planning.pass_order(window), first, ["spacecraft_id"], F.col("contact_id"))
    plan = planning.fold_expansion(ordered, carry=["f"])
    c = "CAST(substring(spacecraft_id, 2) AS BIGINT)"
    m = "CASE method WHEN 'timing' THEN 1 ELSE 0 END"
    rows = plan.selectExpr(
        "spacecraft_id", "method", "prefix_count", "held_ordinal",
        f"({c} * 3 + prefix_count * 7 + held_ordinal * 5 + {m}) % 11 <> 0 AS success",
        f"({c} * 5 + prefix_count + held_ordinal * 3 + {m}) % 6 <> 0 AS accepted",
        f"CASE WHEN ({c} + prefix_count * held_ordinal) % 29 <> 0 THEN "
        f"(({c} * 31 + prefix_count * 170 + held_ordinal * 13 + {m}) % 900) / 100.0D END AS position_rmse_km",
        f"CASE WHEN {c} % 19 = 0 THEN 'partial' ELSE 'complete' END AS coverage",
        f"(checkpoint_us - f) / {YEARS_US} * 24.0D AS elapsed_hours",
    )
    return rows


@query(
    "qualification_median",
    "A21",
    f"""WITH @passes, {_FOLDS}, {_QUALIFY} SELECT spacecraft_id, method, prefix_count, folds, accepted_folds, scored_folds, {rd("CASE WHEN status = 'available' THEN md END")} AS median_km, status FROM qq""",
)
def qualification_median(t: Tables) -> DataFrame:
    folds = fold_rows(t).where("held_ordinal > 0")
    out = study.qualification(folds, ["spacecraft_id", "method", "prefix_count"])
    return _rounded(out, "median_km")


@query(
    "prefix_summary",
    "A22",
    f"""WITH @passes, {_LOST}, {_QUALIFY}, {_PREFIXES} SELECT spacecraft_id, method, prefix_count, {rd('elapsed_hours')} AS elapsed_hours, planned_folds, accepted_folds, scored_folds,
      {rd('median_km')} AS median_km, status, {rd('full_prefix_rmse_km')} AS full_prefix_rmse_km FROM prefixes""",
)
def prefix_summary(t: Tables) -> DataFrame:
    return _rounded(study.prefix_summary(fold_rows(t).where(_GAP)), "elapsed_hours", "median_km", "full_prefix_rmse_km")


@query(
    "first_attainment",
    "A23",
    f"""WITH @passes, {_FOLDS}, {_QUALIFY}, {_PREFIXES}, {_ATTAIN} SELECT spacecraft_id, method, threshold_km, {rd('h')} AS first_attainment_hours, prefix_count, {rd('median_km')} AS median_km,
      {rd('last_h')} AS last_available_hours, CASE WHEN h IS NULL THEN 'not_shown' ELSE 'attained' END AS status,
      coalesce(h <= 8, false) AS attained_by_8h, coalesce(h <= 16, false) AS attained_by_16h, coalesce(h <= 24, false) AS attained_by_24h FROM attain""",
)
def first_attainment(t: Tables) -> DataFrame:
    out = study.first_attainment(study.prefix_summary(fold_rows(t)))
    return _rounded(out, "first_attainment_hours", "median_km", "last_available_hours")


@query(
    "population_attainment",
    "A24",
    f"""WITH @passes, {_FOLDS}, {_QUALIFY}, {_PREFIXES}, {_ATTAIN}, n AS (SELECT *, row_number() OVER (PARTITION BY method, threshold_km ORDER BY h NULLS LAST) AS k,
       count(*) OVER (PARTITION BY method, threshold_km) AS n FROM attain)
    SELECT method, threshold_km, count(*) AS spacecraft_count, count(h) AS attained_count, count(*) FILTER (h <= 8) AS attained_by_8h, count(*) FILTER (h <= 16) AS attained_by_16h,
      count(*) FILTER (h <= 24) AS attained_by_24h, {rd('max(CASE WHEN k = (n + 1) // 2 THEN h END)')} AS fifty_percent_hours FROM n GROUP BY 1, 2""",
)
def population_attainment(t: Tables) -> DataFrame:
    # One row per spacecraft, method and threshold; also read several times.
    events = cut_lineage(study.first_attainment(study.prefix_summary(fold_rows(t))))
    return _rounded(study.population_attainment(events), "fifty_percent_hours")


@query(
    "quality_decision",
    "A26",
    """
    WITH s AS (SELECT l_orderkey AS fit_id, l_linenumber AS c, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
    k AS (SELECT fit_id, CAST(sum(n) AS BIGINT) AS tot, min(n) AS mi, count(*) AS p FROM s GROUP BY 1),
    f AS (SELECT o_orderkey AS fit_id, o_orderkey % 7 AS rk, 4 AS pc, o_orderkey % 50 - 3 AS dof, o_totalprice * (o_orderkey % 10) AS cond,
       CASE WHEN o_orderkey % 31 = 0 THEN 'saved fit lacks replay metadata' ELSE '' END AS why, o_orderkey % 6 + 1 AS req, o_orderkey % 17 = 0 AS ab, o_orderstatus <> 'P' AS ok FROM orders),
    j AS (SELECT f.*, tot, mi, coalesce(p = req, false) AS known FROM f LEFT JOIN k ON k.fit_id = f.fit_id),
    z AS (SELECT fit_id, tot, mi, concat_ws('; ', CASE WHEN why <> '' THEN why END, CASE WHEN why = '' AND rk < pc THEN 'rank' END,
       CASE WHEN why = '' AND dof <= 0 THEN 'no_freedom' END, CASE WHEN why = '' AND cond > 1e6 THEN 'condition number exceeds 1e+06' END,
       CASE WHEN NOT known THEN 'no_counts' END, CASE WHEN known AND tot < 60 THEN 'fewer than 60 retained samples per fit' END,
       CASE WHEN ab THEN 'at_a_bound' END, CASE WHEN NOT ok THEN 'fit/preparation unsuccessful' END) AS rr FROM j)
    SELECT fit_id, tot AS fit_sample_count, mi AS minimum_pass_sample_count, rr = '' AS quality_accepted, rr AS rejection_reasons FROM z""",
)
def quality_decision(t: Tables) -> DataFrame:
    samples = t.table("lineitem").groupBy(
        F.col("l_orderkey").alias("fit_id"), F.col("l_linenumber").alias("contact_id")
    ).agg(F.sum("l_quantity").cast("long").alias("retained"))
    fits = t.table("orders").selectExpr(
        "o_orderkey AS fit_id", "o_orderkey % 7 AS rank", "4 AS parameter_count",
        "o_orderkey % 50 - 3 AS degrees_of_freedom", "o_totalprice * (o_orderkey % 10) AS condition_number",
        "CASE WHEN o_orderkey % 31 = 0 THEN 'saved fit lacks replay metadata' ELSE '' END AS diagnostic_reason",
        "o_orderkey % 6 + 1 AS requested_passes", "o_orderkey % 17 = 0 AS active_bounds", "o_orderstatus <> 'P' AS success",
    )
    return study.quality_decision(fits, samples, min_samples=60)


@query(
    "fit_diagnostics",
    "A27",
    f"""WITH @residuals SELECT fit_id, count(*) AS observation_count, {rd('sqrt(avg(pow(residual_hz / sigma_hz, 2)))')} AS whitened_residual_rms, {rd('sqrt(avg(residual_hz * residual_hz))')} AS residual_rms_hz,
      CASE WHEN bool_and(accepted) THEN '' ELSE 'Optimizer did not converge.' END AS warnings FROM residuals GROUP BY 1""",
)
def fit_diagnostics(t: Tables) -> DataFrame:
    return _rounded(
        study.fit_diagnostics(t.residuals, ["fit_id"]), "whitened_residual_rms", "residual_rms_hz"
    )


_NOW = 1_000_000_000_000_000 + 10 * DAY_US


@query(
    "queue_metrics",
    "A28",
    f"""WITH {_JOBS} SELECT count(*) FILTER (status = 'queued' AND operation = 'estimate') AS depth,
      {rd(f"({_NOW} - min(created_us) FILTER (status = 'queued' AND operation = 'estimate')) / 1e6")} AS age_s FROM jobs""",
)
def queue_metrics(t: Tables) -> DataFrame:
    return _rounded(study.queue_metrics(jobs(t), F.lit(_NOW)), "age_s")


@query(
    "duplicate_keys",
    "A33",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(t: Tables) -> DataFrame:
    return study.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "summary_rows",
    "A34",
    f"""WITH @state_errors, k AS (SELECT fit_id, solution, count(*) AS n, {rd('sqrt(avg(dx_m * dx_m))')} AS rmse FROM state_errors GROUP BY 1, 2),
    u AS (SELECT s_suppkey AS fit_id, s_nationkey AS stage FROM supplier)
    SELECT u.fit_id, stage, coalesce(solution, 'fitted') AS solution, CASE WHEN solution IS NULL THEN 'unavailable' WHEN n > 190 THEN 'complete' ELSE 'partial' END AS coverage, rmse,
      CASE WHEN solution IS NOT NULL THEN '' ELSE 'not executed' END AS reason FROM u LEFT JOIN k ON k.fit_id = u.fit_id AND u.fit_id % 8 <> 0""",
)
def summary_rows(t: Tables) -> DataFrame:
    scores = t.state_errors.groupBy("fit_id", "solution").agg(
        F.count(F.lit(1)).alias("_n"), r(F.sqrt(F.avg(F.col("dx_m") * F.col("dx_m")))).alias("rmse")
    )
    # Three solutions per run at most.
    packed = scores.groupBy("fit_id").agg(
        F.collect_list(
            F.struct("solution", F.when(F.col("_n") > 190, "complete").otherwise("partial").alias("coverage"), "rmse")
        ).alias("statistics")
    )
    runs = t.table("supplier").selectExpr(
        "s_suppkey AS fit_id", "s_nationkey AS stage", "'not executed' AS unavailable_reason"
    ).join(packed, "fit_id", "left").withColumn(
        "statistics", F.when(F.col("fit_id") % 8 != 0, F.col("statistics"))
    )
    return study.summary_rows(runs, "statistics")


@query(
    "wide_scores",
    "A35",
    f"""WITH @state_errors SELECT fit_id, {', '.join(f"{rd(f'sqrt(avg(dx_m * dx_m) FILTER (solution = {s!r}))')} AS {p}_rmse, count(*) FILTER (solution = {s!r}) AS {p}_n" for s, p in (('source', 'source'), ('prior', 'prepared'), ('fitted', 'fitted')))} FROM state_errors GROUP BY 1""",
)
def wide_scores(t: Tables) -> DataFrame:
    scores = t.state_errors.groupBy("fit_id", "solution").agg(
        r(F.sqrt(F.avg(F.col("dx_m") * F.col("dx_m")))).alias("rmse"), F.count(F.lit(1)).alias("n")
    )
    labels = {"source": "source", "prior": "prepared", "fitted": "fitted"}
    return study.wide_scores(scores, "fit_id", labels, ["rmse", "n"])
