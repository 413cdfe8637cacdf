"""Requests, profiles and result rows of the estimate service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passledger.functions.scalars import BIAS_PREFIX, first_reason, parameter_unit

# Parameters of the forward-model profiles
# (model, name, initial, lower, upper, scale).
PROFILE_PARAMETERS = (
    ("lofi-time", "time_offset_s", 0.0, -600.0, 600.0, 1.0),
    ("lofi-time-frequency", "time_offset_s", 0.0, -600.0, 600.0, 1.0),
    ("lofi-time-frequency", "center_frequency_offset_hz", 0.0, -1e6, 1e6, 1000.0),
    ("lofi-elements", "mean_motion_rev_per_day", 0.0, -0.2, 0.2, 0.001),
    ("lofi-elements", "mean_longitude_deg", 0.0, -30.0, 30.0, 0.1),
    ("hifi", "position_x_m", 0.0, -1e6, 1e6, 1e4),
    ("hifi", "position_y_m", 0.0, -1e6, 1e6, 1e4),
    ("hifi", "position_z_m", 0.0, -1e6, 1e6, 1e4),
    ("hifi", "velocity_x_m_s", 0.0, -1000.0, 1000.0, 10.0),
    ("hifi", "velocity_y_m_s", 0.0, -1000.0, 1000.0, 10.0),
    ("hifi", "velocity_z_m_s", 0.0, -1000.0, 1000.0, 10.0),
)
PASS_BIAS = (0.0, -150000.0, 150000.0, 200.0)
# Optimizer profiles (name, loss, loss scale, compatible models).
OPTIMIZERS = (
    ("least-squares", "linear", 1.0, ("lofi-time", "lofi-time-frequency", "lofi-elements", "hifi")),
    ("robust", "soft_l1", 200.0, ("lofi-time", "lofi-time-frequency", "lofi-elements", "hifi")),
    ("timing-scan", "linear", 1.0, ("lofi-time",)),
    ("phase-scan", "linear", 1.0, ("lofi-elements",)),
)


def model_parameters(spark: SparkSession) -> DataFrame:
    rows = [(m, i, *rest) for i, (m, *rest) in enumerate(PROFILE_PARAMETERS)]
    return spark.createDataFrame(
        rows,
        "model string, rank int, name string, initial double, lower_bound double, upper_bound double, scale double",
    )


def optimizers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, loss, s, list(models)) for n, loss, s, models in OPTIMIZERS],
        "optimizer string, loss string, loss_scale double, compatible array<string>",
    )


def resolve_requests(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Effective optimizer settings of each request, or why it is refused.

    ``requests`` holds request_id, model, optimizer and loss_scale_override.
    """
    joined = requests.join(F.broadcast(profiles), "optimizer", "left")  # a fixed handful of rows
    return joined.select(
        *[c for c in requests.columns if c != "loss_scale_override"],
        "loss",
        F.coalesce("loss_scale_override", "loss_scale").alias("loss_scale"),
        first_reason(
            [
                (F.col("loss").isNull(), "unknown optimizer profile"),
                (
                    ~F.array_contains("compatible", F.col("model")),
                    "optimizer is incompatible with the forward model",
                ),
                (
                    F.col("loss_scale_override").isNotNull() & (F.col("loss") == "linear"),
                    "loss_scale is only effective for robust-loss profiles",
                ),
            ]
        ).alias("reason"),
    )


def expand_parameters(
    resolved: DataFrame, contacts: DataFrame, parameters: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Parameter rows of each accepted request: the model's, then one per contact.

    ``contacts`` holds request_id, ordinal, contact_id; ``overrides`` request_id,
    name and initial.
    """
    accepted = resolved.where("reason = ''").select("request_id", "model")
    own = accepted.join(F.broadcast(parameters), "model").select(
        "request_id", F.lit(0).alias("part"), F.col("rank").cast("long").alias("place"),
        "name", "initial", "lower_bound", "upper_bound", "scale",
    )
    initial, lower, upper, scale = PASS_BIAS
    biases = accepted.join(contacts, "request_id").select(
        "request_id", F.lit(1).alias("part"), F.col("ordinal").cast("long").alias("place"),
        F.concat(F.lit(BIAS_PREFIX), "contact_id").alias("name"), F.lit(initial).alias("initial"),
        F.lit(lower).alias("lower_bound"), F.lit(upper).alias("upper_bound"), F.lit(scale).alias("scale"),
    )
    given = overrides.select("request_id", "name", F.col("initial").alias("_given"))
    rows = own.unionByName(biases).join(given, ["request_id", "name"], "left")
    return rows.withColumn("initial", F.coalesce("_given", "initial")).drop("_given").withColumn(
        "unit", parameter_unit(F.col("name"))
    )


def parameter_rows(fits: DataFrame) -> DataFrame:
    """Result rows from the parameter arrays of each fit.

    ``fits`` holds fit_id, names, roles, values and the covariance diagonal
    (null where there is none).
    """
    zipped = F.arrays_zip("names", "roles", "values")
    rows = fits.select("fit_id", "variances", F.posexplode(zipped).alias("ordinal", "_p"))
    name = F.col("_p.names")
    variance = F.try_element_at("variances", F.col("ordinal") + 1)
    return rows.select(
        "fit_id", "ordinal", name.alias("parameter_name"), F.col("_p.roles").alias("role"),
        F.col("_p.values").alias("value"), parameter_unit(name).alias("unit"),
        F.sqrt(variance).alias("standard_uncertainty"),
        F.when(name.startswith(BIAS_PREFIX), F.substring_index(name, ":", -1)).alias("contact_id"),
    )


def profile_changes(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Stored versions are immutable: equal, new, or a change that is an error."""
    old = stored.select("name", "version", F.col("definition").alias("_old"))
    return offered.join(old, ["name", "version"], "left").select(
        "name", "version",
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_old") == F.col("definition"), "unchanged")
        .otherwise("profile_changed")
        .alias("status"),
    )


