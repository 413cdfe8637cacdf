"""Study statistics: contact results, distributions, attainment, quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.functions.scalars import all_reasons, first_reason
from passledger.operators.joins import paired_delta
from passledger.functions.geometry import finite
from passledger.operators.ordered import exact_percentiles

# Thresholds in kilometres and milestones in hours.
THRESHOLDS_KM = (5.0, 2.0)
MILESTONES_H = (8, 16, 24)
SOLUTIONS = ("source", "prior", "corrected")
_NOT_ATTAINED = float("inf")


def contact_results(
    contacts: DataFrame, errors: DataFrame, *, primary_fixes: int = 5
) -> DataFrame:
    """One row per contact: medians and RMS of position errors by solution.

    ``contacts`` holds (contact_id, success), ``errors`` (contact_id, solution,
    error_km). A fit that did not converge has no corrected score.
    """
    keys = ["contact_id", "solution"]
    used = errors.join(contacts.select("contact_id", "success"), "contact_id").where(
        (F.col("solution") != "corrected") | F.col("success")
    )
    medians = exact_percentiles(used, keys, "error_km", {"median_km": 0.5})
    squares = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sqrt(F.avg(F.col("error_km") * F.col("error_km"))).alias("rms_km"),
    )
    wide = (
        medians.join(squares, keys)
        .groupBy("contact_id")
        .pivot("solution", list(SOLUTIONS))
        .agg(
            F.first("median_km").alias("median_km"),
            F.first("rms_km").alias("rms_km"),
            F.first("_n").alias("n"),
        )
    )
    joined = contacts.join(wide, "contact_id", "left")
    fixes = F.coalesce("source_n", F.lit(0))
    return joined.select(
        "contact_id",
        "success",
        fixes.alias("gps_fixes"),
        (fixes >= primary_fixes).alias("primary"),
        *[F.col(f"{s}_{m}") for s in SOLUTIONS for m in ("median_km", "rms_km")],
        first_reason(
            [
                (~F.col("success"), "not_converged"),
                (fixes == 0, "no_fixes"),
            ]
        ).alias("reason"),
    )


def study_aggregate(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and the median of the primary contacts' medians."""
    scored = F.col("primary") & F.col("corrected_median_km").isNotNull()
    counts = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fitted_contacts"),
        F.count_if("success").alias("converged_contacts"),
        F.count_if("primary").alias("primary_contacts"),
        F.count_if(scored).alias("scored_primary_contacts"),
    )
    middle = exact_percentiles(
        results.where(scored), keys, "corrected_median_km", {"median_contact_error_km": 0.5}
    )
    return counts.join(middle, list(keys), "left")


def distribution_table(
    fits: DataFrame, keys: Sequence[str], metrics: Sequence[str], accepted: Column
) -> DataFrame:
    """Median, minimum and maximum per metric, over all and over accepted fits."""
    keys = list(keys)
    labels = F.explode(F.array_compact(F.array(F.lit("all"), F.when(accepted, "kept"))))
    long = fits.select(
        *keys,
        labels.alias("selection"),
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        ).alias("_m"),
    ).select(*keys, "selection", "_m.metric", "_m.value")
    group = [*keys, "selection", "metric"]
    simple = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count("value").alias("scored"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    return simple.join(exact_percentiles(long, group, "value", {"median": 0.5}), group, "left")


def pooled_rms(metric: str, count: str) -> Column:
    """Root of the sample-weighted mean square; null when nothing is scored."""
    used = F.col(metric).isNotNull() & (F.col(count) > 0)
    weight = F.sum(F.when(used, F.col(count)))
    total = F.sum(F.when(used, F.col(count) * F.col(metric) * F.col(metric)))
    return F.sqrt(total / weight)


def all_and_screened(
    fits: DataFrame, keys: Sequence[str], metric: str, count: str, accepted: Column
) -> DataFrame:
    """Scored count, median and pooled RMS over all and over accepted fits."""
    keys = list(keys)
    labelled = fits.withColumn(
        "selection",
        F.explode(F.array_compact(F.array(F.lit("all"), F.when(accepted, "screened")))),
    )
    group = [*keys, "selection"]
    simple = labelled.groupBy(*group).agg(
        F.count(metric).alias("scored"), pooled_rms(metric, count).alias("pooled")
    )
    return simple.join(exact_percentiles(labelled, group, metric, {"median": 0.5}), group, "left")


def reduction_percent(before: Column, after: Column, comparable: Column) -> Column:
    usable = comparable & before.isNotNull() & (before != 0) & after.isNotNull()
    return F.when(usable, 100.0 * (before - after) / before)


def variant_summary(
    folds: DataFrame, keys: Sequence[str], variant: str, baseline: str, score: str, coefficient: str
) -> DataFrame:
    """Per variant: fold counts, equal-pass mean, paired delta, coefficient spread."""
    keys = list(keys)
    plain = folds.groupBy(*keys, variant).agg(
        F.count(F.lit(1)).alias("folds"),
        F.count(score).alias("scored_folds"),
        F.count_if(~F.col("success")).alias("failed_folds"),
        F.avg(score).alias("mean_score"),
        F.avg(coefficient).alias("coefficient_mean"),
        F.stddev_pop(coefficient).alias("coefficient_std"),
    )
    pairs = paired_delta(folds, keys, variant, baseline, score)
    return plain.join(pairs, [*keys, variant], "left")


def _rating(only: Column | None = None) -> list[Column]:
    """Sums over folds that say how a group is qualified; only folds where ``only`` holds count."""
    used = F.lit(True) if only is None else only
    bad = ~(F.col("success") & F.col("accepted"))
    # A failed fold has no usable error; infinity keeps it in the median.
    # An accepted fold whose error is no finite number is not scored.
    value = F.when(bad, F.lit(_NOT_ATTAINED)).when(finite(F.col("position_rmse_km")), F.col("position_rmse_km"))
    return [
        F.count_if(used).alias("folds"),
        F.count_if(used & ~bad).alias("accepted_folds"),
        F.count(F.when(used, F.col("position_rmse_km"))).alias("scored_folds"),
        F.count_if(used & ~F.col("coverage").isin("complete", "unknown")).alias("_uncovered"),
        F.count_if(used & value.isNull()).alias("_unscored"),
        F.percentile(F.when(used, value), 0.5).alias("_median"),
    ]


def _qualified() -> Column:
    return first_reason(
        [
            (F.col("_uncovered") > 0, "uncovered"),
            (F.col("_unscored") > 0, "unscored"),
            (F.col("_median") == _NOT_ATTAINED, "not_attained"),
        ],
        "available",
    )


def qualification(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median fold error where failed or rejected folds count as infinite.

    ``folds`` holds success, accepted, position_rmse_km and coverage. A group is the
    folds of one prefix, at most one for each pass of its spacecraft, while the table
    holds the square of them; so the values of a group fit a task, and one
    aggregation does.
    """
    keys = list(keys)
    rated = folds.groupBy(*keys).agg(*_rating()).withColumn("status", _qualified())
    return rated.select(
        *keys,
        "folds",
        "accepted_folds",
        "scored_folds",
        F.when(F.col("status") == "available", F.col("_median")).alias("median_km"),
        "status",
    )


def prefix_summary(rows: DataFrame) -> DataFrame:
    """One row per prefix: its full fit and the qualification over its folds.

    A prefix of n passes needs one full fit and n distinct folds (none for a
    single pass); anything else is reported as incomplete. The rows are read once.
    """
    keys = ["spacecraft_id", "method", "prefix_count"]
    held = F.coalesce(F.col("held_ordinal") > 0, F.lit(False))
    shape = rows.groupBy(*keys).agg(
        F.count_if(F.col("held_ordinal") <= 0).alias("_full"),
        F.size(F.collect_set(F.when(held, F.col("held_ordinal")))).alias("_distinct"),
        F.max(F.when(F.col("held_ordinal") <= 0, F.col("position_rmse_km"))).alias("full_prefix_rmse_km"),
        F.max("elapsed_hours").alias("elapsed_hours"),
        *_rating(held),
    ).withColumn("status", F.when(F.col("folds") > 0, _qualified()))
    expected = F.when(F.col("prefix_count") > 1, F.col("prefix_count")).otherwise(0)
    whole = (
        (F.col("_full") == 1)
        & (F.col("folds") == expected)
        & (F.col("_distinct") == expected)
    )
    return shape.select(
        *keys,
        "elapsed_hours",
        F.col("folds").alias("planned_folds"),
        "accepted_folds",
        "scored_folds",
        F.when(whole & (F.col("status") == "available"), F.col("_median")).alias("median_km"),
        first_reason(
            [
                (~whole, "folds_incomplete"),
                (F.col("status").isNull(), "no_folds_of_one_pass"),
            ],
            None,
        ).alias("_why"),
        "status",
        "full_prefix_rmse_km",
    ).withColumn("status", F.coalesce("_why", "status")).drop("_why")


def first_attainment(prefixes: DataFrame, thresholds: Sequence[float] = THRESHOLDS_KM) -> DataFrame:
    """First prefix strictly below each threshold, with milestone flags."""
    rated = prefixes.withColumn(
        "threshold_km", F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))
    )
    crossed = F.col("median_km") < F.col("threshold_km")
    place = F.struct("elapsed_hours", "prefix_count", "median_km")
    grouped = rated.groupBy("spacecraft_id", "method", "threshold_km").agg(
        F.min(F.when(crossed, place)).alias("_first"),
        F.max("elapsed_hours").alias("last_available_hours"),
    )
    hours = F.col("_first.elapsed_hours")
    return grouped.select(
        "spacecraft_id",
        "method",
        "threshold_km",
        hours.alias("first_attainment_hours"),
        F.col("_first.prefix_count").alias("prefix_count"),
        F.col("_first.median_km").alias("median_km"),
        "last_available_hours",
        F.when(hours.isNotNull(), "attained")
        .otherwise("not_shown")
        .alias("status"),
        *[
            F.coalesce(hours <= h, F.lit(False)).alias(f"attained_by_{h}h") for h in MILESTONES_H
        ],
    )


def population_attainment(events: DataFrame) -> DataFrame:
    """Counts by milestone and the time by which half the spacecraft attained.

    Spacecraft that never attain stay in the population: they count as infinite,
    so the wanted time is the lower median of all members.
    """
    keys = ["method", "threshold_km"]
    timed = events.withColumn(
        "_h", F.coalesce("first_attainment_hours", F.lit(_NOT_ATTAINED))
    )
    counts = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spacecraft_count"),
        F.count("first_attainment_hours").alias("attained_count"),
        *[F.count_if(f"attained_by_{h}h").alias(f"attained_by_{h}h") for h in MILESTONES_H],
    )
    # Rank ceil(n/2) is the lower of the two middle values; an interpolated
    # median would mix them, so the value at that exact rank is taken.
    ranked = lower_median(timed, keys, "_h", "fifty_percent_hours")
    return counts.join(ranked, keys).withColumn(
        "fifty_percent_hours",
        F.when(F.col("fifty_percent_hours") < _NOT_ATTAINED, F.col("fifty_percent_hours")),
    )


def lower_median(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The value at rank ceil(n/2) of each group."""
    from pyspark.sql import Window

    from passledger.operators.ordered import value_band

    keys = list(keys)
    counted = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_band", value_band(F.col(value))
    )
    bands = counted.groupBy(*keys, "_band").agg(F.sum("_c").alias("_bc"))
    upto = Window.partitionBy(*keys).orderBy("_band")
    whole = Window.partitionBy(*keys)
    wanted = F.expr("(_n + 1) div 2")
    bands = (
        bands.withColumn("_n", F.sum("_bc").over(whole))
        .withColumn("_from", F.sum("_bc").over(upto) - F.col("_bc"))
        .where((wanted > F.col("_from")) & (wanted <= F.col("_from") + F.col("_bc")))
    )
    running = Window.partitionBy(*keys, "_band").orderBy(value)
    placed = counted.join(bands, [*keys, "_band"]).withColumn(
        "_to", F.col("_from") + F.sum("_c").over(running)
    )
    return placed.where(
        (wanted <= F.col("_to")) & (wanted > F.col("_to") - F.col("_c"))
    ).select(*keys, F.col(value).alias(name))


def quality_decision(
    fits: DataFrame,
    samples: DataFrame,
    *,
    min_samples: int = 250,
    max_condition: float = 1e6,
    scope: str = "fit",
) -> DataFrame:
    """Accept a fit or list every reason against it.

    ``fits`` holds rank, parameter_count, degrees_of_freedom, condition_number,
    diagnostic_reason, requested_passes, active_bounds and success; ``samples``
    holds (fit_id, contact_id, retained).
    """
    if scope not in ("fit", "pass"):
        raise ValueError("sample scope must be fit or pass")
    counts = samples.groupBy("fit_id").agg(
        F.sum("retained").alias("fit_sample_count"),
        F.min("retained").alias("minimum_pass_sample_count"),
        F.count(F.lit(1)).alias("_passes"),
    )
    chosen = F.col("fit_sample_count" if scope == "fit" else "minimum_pass_sample_count")
    known = F.coalesce(F.col("_passes") == F.col("requested_passes"), F.lit(False))
    diagnosed = F.col("diagnostic_reason") == ""
    rules = [
        (diagnosed & (F.col("parameter_count") == 0), "no_parameters"),
        (diagnosed & (F.col("rank") < F.col("parameter_count")), "rank"),
        (diagnosed & (F.col("degrees_of_freedom") <= 0), "no_freedom"),
        (
            diagnosed & (F.col("condition_number") > max_condition),
            f"condition number exceeds {max_condition:g}",
        ),
        (~known, "no_counts"),
        (known & (chosen < min_samples), f"fewer than {min_samples} retained samples per {scope}"),
        (F.col("active_bounds"), "at_a_bound"),
        (~F.col("success"), "fit/preparation unsuccessful"),
    ]
    reasons = F.concat_ws(
        "; ", F.when(~diagnosed, F.col("diagnostic_reason")), F.nullif(all_reasons(rules), F.lit(""))
    )
    return fits.join(counts, "fit_id", "left").select(
        "fit_id",
        "fit_sample_count",
        "minimum_pass_sample_count",
        (reasons == "").alias("quality_accepted"),
        reasons.alias("rejection_reasons"),
    )


def fit_diagnostics(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observation count and residual RMS, whitened and in Hz, with warnings."""
    white = F.col("residual_hz") / F.col("sigma_hz")
    return residuals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.sqrt(F.avg(white * white)).alias("whitened_residual_rms"),
        F.sqrt(F.avg(F.col("residual_hz") * F.col("residual_hz"))).alias("residual_rms_hz"),
        F.when(~F.bool_and("accepted"), "Optimizer did not converge.")
        .otherwise("")
        .alias("warnings"),
    )


def queue_metrics(jobs: DataFrame, now_us: Column) -> DataFrame:
    """Depth of the queue and the age of its oldest job in seconds."""
    waiting = (F.col("status") == "queued") & (F.col("operation") == "estimate")
    return jobs.agg(
        F.count_if(waiting).alias("depth"),
        F.coalesce(
            (now_us - F.min(F.when(waiting, F.col("created_us")))) / 1e6, F.lit(0.0)
        ).alias("age_s"),
    )


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def summary_rows(runs: DataFrame, statistics: str) -> DataFrame:
    """One row per run and score, or one row with the reason where none exist."""
    return runs.select(
        *[c for c in runs.columns if c != statistics],
        F.explode_outer(statistics).alias("_score"),
    ).select(
        *[c for c in runs.columns if c not in (statistics, "unavailable_reason")],
        F.coalesce("_score.solution", F.lit("fitted")).alias("solution"),
        F.coalesce("_score.coverage", F.lit("unavailable")).alias("coverage"),
        F.col("_score.rmse").alias("rmse"),
        F.when(F.col("_score").isNull(), F.coalesce("unavailable_reason", F.lit("no_accuracy")))
        .otherwise("")
        .alias("reason"),
    )


def wide_scores(
    scores: DataFrame, key: str, labels: Mapping[str, str], columns: Sequence[str]
) -> DataFrame:
    """Scores of each solution as prefixed columns of one row per fit."""
    named = scores.withColumn(
        "_label", F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("solution")]
    )
    return named.groupBy(key).pivot("_label", list(labels.values())).agg(
        *[F.max(c).alias(c) for c in columns]
    )
