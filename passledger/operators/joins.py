"""Joins between contacts, measurements, priors, bookings and job tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passledger.functions.scalars import all_reasons, first_reason
from passledger.operators.ranges import salted_join


def window_violations(contacts: DataFrame, measurements: DataFrame) -> DataFrame:
    """Identity and window violations of the measurements of each contact."""
    expected = contacts.select(
        "contact_id",
        F.col("spacecraft_id").alias("_craft"),
        F.col("system_id").alias("_system"),
        "start_us",
        "stop_us",
    )
    joined = salted_join(measurements, expected, ["contact_id"], F.col("ts_us"), salts=4)
    inside = F.col("ts_us").between(F.col("start_us"), F.col("stop_us"))
    same_craft = F.col("spacecraft_id") == F.col("_craft")
    same_system = F.col("system_id") == F.col("_system")
    return joined.groupBy("contact_id").agg(
        F.count_if(~same_craft).alias("wrong_spacecraft"),
        F.count_if(~same_system).alias("wrong_system"),
        F.count_if(~inside).alias("outside"),
        F.bool_and(same_craft & same_system & inside).alias("accepted"),
    )


def preparation_check(
    requests: DataFrame, contacts: DataFrame, selected: DataFrame, min_samples: int
) -> DataFrame:
    """Whether each fit can be prepared from its requested contacts.

    ``requests`` holds (fit_id, contact_id), ``selected`` the kept observations
    with a fit_id. Both are reduced before they meet.
    """
    counted = selected.groupBy("fit_id", "contact_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = requests.join(contacts.select("contact_id", "spacecraft_id"), "contact_id", "left")
    both = wanted.withColumn("_wanted", F.lit(True)).join(
        counted, ["fit_id", "contact_id"], "full_outer"
    )
    short = F.col("_wanted") & (F.coalesce("_n", F.lit(0)) < min_samples)
    grouped = both.groupBy("fit_id").agg(
        F.count("_wanted").alias("requested"),
        F.count_if(short).alias("insufficient"),
        F.count_if(F.col("_wanted").isNull()).alias("unrequested"),
        F.count_distinct("spacecraft_id").alias("spacecraft"),
        F.sum(F.when(F.col("_wanted"), F.col("_n"))).alias("samples"),
    )
    return grouped.withColumn(
        "status",
        first_reason(
            [
                (F.col("spacecraft") != 1, "several_spacecraft"),
                (F.col("unrequested") > 0, "unrequested"),
                (F.col("insufficient") > 0, "too_few_samples"),
            ],
            "ready",
        ),
    )


def packet_fixes(positions: DataFrame, epochs: DataFrame, velocities: DataFrame) -> DataFrame:
    """Position packets with receiver epoch and velocity where present."""
    return positions.join(epochs, "packet", "left").join(velocities, "packet", "left")


def compare_states(
    predicted: DataFrame, reference: DataFrame, components: Sequence[str]
) -> DataFrame:
    """Predicted minus reference at identical (object, segment, epoch).

    Nothing is aligned or interpolated: an epoch on one side only becomes an
    ``unmatched`` row with null differences.
    """
    keys = ["object_id", "segment", "t_us"]
    left = predicted.select(
        *keys, *[F.col(c).alias(f"_p_{c}") for c in components], F.lit(True).alias("_p")
    )
    right = reference.select(
        *keys, *[F.col(c).alias(f"_r_{c}") for c in components], F.lit(True).alias("_r")
    )
    return left.join(right, keys, "full_outer").select(
        *keys,
        *[(F.col(f"_p_{c}") - F.col(f"_r_{c}")).alias(f"d{c}") for c in components],
        (F.col("_p").isNull() | F.col("_r").isNull()).alias("unmatched"),
    )


def same_samples(states: DataFrame, keys: Sequence[str], solutions: Sequence[str]) -> DataFrame:
    """Per group: sample keys and how many are missing from some solution."""
    per_key = states.groupBy(*keys, "segment", "t_us").agg(
        F.count_distinct("solution").alias("_solutions"),
        *[F.max(F.when(F.col("solution") == s, 1).otherwise(0)).alias(f"_has_{s}") for s in solutions],
    )
    return per_key.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_keys"),
        *[F.count_if(F.col(f"_has_{s}") == 0).alias(f"missing_{s}") for s in solutions],
        F.bool_and(F.col("_solutions") == len(solutions)).alias("identical"),
    )


def paired_delta(
    folds: DataFrame, keys: Sequence[str], variant: str, baseline: str, score: str
) -> DataFrame:
    """Mean score difference of each variant to its baseline on the same fold."""
    base = folds.where(F.col(variant) == baseline).select(
        *keys, "holdout_id", F.col(score).alias("_base")
    )
    other = folds.where(F.col(variant) != baseline)
    pairs = other.join(base, [*keys, "holdout_id"]).where(
        F.col(score).isNotNull() & F.col("_base").isNotNull()
    )
    delta = F.col(score) - F.col("_base")
    return pairs.groupBy(*keys, variant).agg(
        F.count(F.lit(1)).alias("paired_folds"),
        F.avg(delta).alias("paired_delta"),
        F.count_if(delta < 0).alias("improved_folds"),
    )


def latest_prior(requests: DataFrame, contacts: DataFrame) -> DataFrame:
    """The requested ephemeris, or that of the latest contact by (start, id)."""
    latest = contacts.groupBy("fit_id").agg(
        F.max_by(
            F.struct("contact_id", "ephemeris_id"), F.struct("start_us", "contact_id")
        ).alias("_latest")
    )
    return requests.join(latest, "fit_id").select(
        "fit_id",
        F.coalesce("requested_id", "_latest.ephemeris_id").alias("ephemeris_id"),
        F.when(F.col("requested_id").isNotNull(), "request")
        .otherwise("latest_contact")
        .alias("source"),
        F.when(F.col("requested_id").isNull(), F.col("_latest.contact_id")).alias("contact_id"),
    )


def idempotent_lookup(plans: DataFrame, booked: DataFrame) -> DataFrame:
    """Reuse an existing booking with the same derived reference."""
    known = booked.groupBy("external_ref").agg(F.min("booking_id").alias("existing_id"))
    return plans.join(known, plans["identity"] == known["external_ref"], "left").drop(
        "external_ref"
    )


def _first(children: DataFrame, columns: Sequence[str]) -> DataFrame:
    return children.where(F.col("ordinal") == 0).select("job_id", *columns)


def job_status(jobs: DataFrame, job_contacts: DataFrame, contact_columns: Sequence[str]) -> DataFrame:
    return jobs.join(_first(job_contacts, contact_columns), "job_id", "left")


def job_results(
    jobs: DataFrame,
    runs: DataFrame,
    job_contacts: DataFrame,
    run_columns: Sequence[str],
    contact_columns: Sequence[str],
) -> DataFrame:
    return jobs.join(_first(runs, run_columns), "job_id").join(
        _first(job_contacts, contact_columns), "job_id", "left"
    )


def estimates_view(estimates: DataFrame, jobs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Estimate and job columns with the contact ids in ordinal order.

    An estimate names a request's contacts, so the list is short by nature.
    """
    listed = contacts.groupBy("estimate_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "contact_id"))),
            lambda x: x["contact_id"],
        ).alias("contact_ids")
    )
    return estimates.join(jobs, "job_id").join(listed, "estimate_id", "left")


def estimate_events(estimates: DataFrame, events: DataFrame) -> DataFrame:
    return estimates.select("estimate_id", "job_id").join(events, "job_id")


def text_artifacts(jobs: DataFrame, artifacts: DataFrame, job_contacts: DataFrame) -> DataFrame:
    """Export artifacts with their text and a JSON metadata field decoded."""
    exports = jobs.where(F.col("operation") == "tdm_export").select("job_id", "warnings")
    text = artifacts.where((F.col("kind") == "tdm") & F.col("payload").isNotNull())
    return (
        exports.join(text, "job_id")
        .join(_first(job_contacts, ["contact_id"]), "job_id", "left")
        .select(
            "job_id",
            "artifact_id",
            "contact_id",
            F.get_json_object("metadata", "$.product").alias("product"),
            "sha256",
            F.octet_length("payload").alias("byte_count"),
            "warnings",
            F.decode("payload", "UTF-8").alias("tdm_text"),
        )
    )


def exact_prior_match(priors: DataFrame, ephemerides: DataFrame) -> DataFrame:
    """Recorded lines must match exactly one distinct ephemeris."""
    offered = ephemerides.groupBy("line1", "line2").agg(
        F.count_distinct("ephemeris_id").alias("matches"),
        F.min("ephemeris_id").alias("_id"),
    )
    matched = priors.join(offered, ["line1", "line2"], "left")
    return matched.select(
        *[c for c in priors.columns if c not in ("line1", "line2")],
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, F.col("_id")).alias("ephemeris_id"),
    )


def common_prior(contacts: DataFrame) -> DataFrame:
    """Whether all contacts of a spacecraft carry one and the same prior."""
    lines = F.struct("line1", "line2")
    return contacts.groupBy("spacecraft_id").agg(
        F.count(F.lit(1)).alias("contacts"),
        # Two extremes of a whole order tell "one" from "several" without a set.
        (F.min(lines) == F.max(lines)).alias("common"),
    )


def reference_binding(references: DataFrame, contacts: DataFrame, bindings: DataFrame) -> DataFrame:
    """The reference object must equal the COSPAR id or be bound explicitly."""
    joined = contacts.join(references, "spacecraft_id", "left").join(
        bindings, ["spacecraft_id", "object_id"], "left"
    )
    return joined.select(
        "contact_id",
        first_reason(
            [
                (F.col("object_id").isNull(), "no reference"),
                (F.col("object_id") == F.col("cospar"), "cospar"),
                (F.col("bound"), "explicit binding"),
            ],
            "other_reference",
        ).alias("binding"),
    )


def membership(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Each requested id with whether the available ids contain it."""
    known = requested.join(available.select(key), key, "left_semi")
    unknown = requested.join(available.select(key), key, "left_anti")
    return known.withColumn("known", F.lit(True)).unionByName(
        unknown.withColumn("known", F.lit(False))
    )


def reconcile(planned: DataFrame, saved: DataFrame, key: Sequence[str], checked: Sequence[str]) -> DataFrame:
    """Planned against saved attempts: missing, extra, different or equal."""
    left = planned.select(*key, *[F.col(c).alias(f"_p_{c}") for c in checked], F.lit(1).alias("_p"))
    right = saved.select(*key, *[F.col(c).alias(f"_s_{c}") for c in checked], F.lit(1).alias("_s"))
    rules: list[tuple[Column, str]] = [
        (F.col("_s").isNull(), "missing"),
        (F.col("_p").isNull(), "extra"),
    ]
    for c in checked:
        rules.append(
            (
                F.col("_p").isNotNull()
                & F.col("_s").isNotNull()
                & ~F.col(f"_p_{c}").eqNullSafe(F.col(f"_s_{c}")),
                f"{c} differs",
            )
        )
    return left.join(right, list(key), "full_outer").select(*key, all_reasons(rules).alias("finding"))


def metadata_check(
    contacts: DataFrame, antennas: DataFrame, spacecraft: DataFrame, ephemerides: DataFrame
) -> DataFrame:
    """Contact against antenna, spacecraft and ephemeris identities."""
    joined = (
        contacts.join(antennas, "system_id", "left")
        .join(spacecraft, "spacecraft_id", "left")
        .join(ephemerides, "ephemeris_id", "left")
    )
    return joined.withColumn(
        "reason",
        first_reason(
            [
                (
                    F.col("antenna_name").isNull()
                    | (F.col("antenna_station") != F.col("station_id")),
                    "other_antenna",
                ),
                (
                    F.col("spacecraft_name").isNull(),
                    "other_spacecraft",
                ),
                (
                    F.col("ephemeris_spacecraft").isNull()
                    | (F.col("ephemeris_spacecraft") != F.col("spacecraft_id")),
                    "other_ephemeris",
                ),
            ]
        ),
    )


def link_frequency(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Frequency of a link after its direction and value are checked."""
    joined = requests.join(links, ["spacecraft_id", "link_name"], "left")
    reason = first_reason(
        [
            (F.col("direction").isNull(), "no_link"),
            (F.col("direction") != F.col("wanted"), "link_direction"),
            (F.col("frequency_hz").isNull(), "link_number"),
            (
                F.isnan("frequency_hz")
                | (F.abs("frequency_hz") == float("inf"))
                | (F.col("frequency_hz") <= 0),
                "link_frequency",
            ),
        ]
    )
    return joined.withColumn("reason", reason).withColumn(
        "frequency_hz", F.when(F.col("reason") == "", F.col("frequency_hz"))
    )


def station_calibration(contacts: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Calibration of (antenna, band); a late or missing one fails closed."""
    joined = contacts.join(calibrations, ["antenna", "band"], "left")
    reason = first_reason(
        [
            (F.col("calibrated_us").isNull(), "no_calibration"),
            (
                F.expr("calibrated_us div 86400000000 > start_us div 86400000000"),
                "calibration_later",
            ),
        ]
    )
    return joined.withColumn("reason", reason).withColumn(
        "correction_hz", F.when(F.col("reason") == "", F.col("correction_hz"))
    )
