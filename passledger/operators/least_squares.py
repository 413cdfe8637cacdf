"""Joint fits of an orbit shift, a drift and one bias per pass, many at once.

Damped least squares in rounds. A round is one pass over the samples of the fits that
still move: it sums cost and normal equations per (fit, pass) at a trial point. The
biases are eliminated pass by pass, the shared unknowns solved from what is left, and
every fit keeps or drops its trial by the gain it brought. Only small rows travel: one
for each (fit, pass), and the passes of a fit meet once a round.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from passledger.functions.scalars import clamp, loss_rho, slope_weight
from passledger.session import cut_lineage

SHARED = ("offset_s", "drift")
NAMES = (*SHARED, "bias_hz")
#: estimate: free within its bounds. fixed and consider: stays at its initial value.
ROLES = ("estimate", "fixed", "consider")
PARAMETERS = "fit_id long, contact_id string, name string, role string, initial double, lower double, upper double, prior_sigma double"
_SUMS = ("cost", "aa", "ab", "bb", "ah", "bh", "hh", "ar", "br", "hr")
_FIRST_DAMPING, _MOST_DAMPING = 1e-4, 1e12


def _fit() -> WindowSpec:
    """The passes of a fit: small rows, and all sums over a fit share one exchange."""
    return Window.partitionBy("fit_id")


def _described(passes: DataFrame, parameters: DataFrame | None, bounds: dict[str, float], drift: bool) -> DataFrame:
    """Passes with role, initial value, bounds and prior of each of their parameters.

    A row of ``parameters`` for a pass goes before one for its whole fit.
    """
    out = passes
    for name in NAMES:
        for scope, on in (("own", ["fit_id", "contact_id"]), ("all", ["fit_id"])):
            fields = ("role", "initial", "lower", "upper", "prior_sigma")
            if parameters is None or (name in SHARED and scope == "own"):
                out = out.withColumns({f"_{scope}_{f}": F.lit(None).cast("string" if f == "role" else "double") for f in fields})
                continue
            rows = parameters.where((F.col("name") == name) & (F.col("contact_id").isNotNull() if scope == "own" else F.col("contact_id").isNull()))
            rows = rows.groupBy(*on).agg(F.min(F.struct(*fields)).alias("_d"))
            out = out.join(rows.select(*on, *[F.col(f"_d.{f}").alias(f"_{scope}_{f}") for f in fields]), on, "left")
        told = {f: F.coalesce(f"_own_{f}", f"_all_{f}") for f in ("role", "initial", "lower", "upper", "prior_sigma")}
        role = F.coalesce(told["role"], F.lit("estimate" if name != "drift" or drift else "fixed"))
        low, high = F.coalesce(told["lower"], F.lit(-bounds[name])), F.coalesce(told["upper"], F.lit(bounds[name]))
        out = out.withColumns(
            {
                f"{name}_role": role, f"{name}_low": low, f"{name}_high": high,
                f"{name}_mean": F.coalesce(told["initial"], F.lit(0.0)),
                f"{name}_prior": F.coalesce(1 / (told["prior_sigma"] * told["prior_sigma"]), F.lit(0.0)),
            }
        ).drop(*[f"_{scope}_{f}" for scope in ("own", "all") for f in told])
    return out


def _moving(name: str, gradient: Column) -> Column:
    """Whether a parameter is free and not pressed against a bound."""
    value = F.col(name)
    pressed = ((value <= F.col(f"{name}_low")) & (gradient > 0)) | ((value >= F.col(f"{name}_high")) & (gradient < 0))
    return (F.col(f"{name}_role") == "estimate") & ~pressed


def _advanced(state: DataFrame, tolerance_s: float, tolerance_hz: float) -> DataFrame:
    """The next trial of every fit from its sums, with the decrease of cost that it promises."""
    damped = 1 + F.col("damping")
    slope = F.col("hr") + F.col("bias_hz_prior") * (F.col("bias_hz") - F.col("bias_hz_mean"))
    weight = F.col("hh") * damped + F.col("bias_hz_prior")
    free = _moving("bias_hz", slope) & (weight > 0)
    rows = state.withColumns({"_g": slope, "_inv": F.when(free, 1 / weight).otherwise(0.0)})

    def shared(x: str, y: str) -> Column:
        both = F.col(f"{x}{y}") * (damped if x == y else 1)
        return F.sum(both - F.col(f"{x}h") * F.col(f"{y}h") * F.col("_inv"))

    # what is one for a fit stands on all its rows
    pulled = {x: F.col(f"{n}_prior") * (F.col(n) - F.col(f"{n}_mean")) for x, n in zip("ab", SHARED)}
    rows = rows.withColumns(
        {
            "Taa": shared("a", "a").over(_fit()) + F.col("offset_s_prior"), "Tab": shared("a", "b").over(_fit()), "Tbb": shared("b", "b").over(_fit()) + F.col("drift_prior"),
            **{f"T{x}": F.sum(F.col(f"{x}r") - F.col(f"{x}h") * F.col("_g") * F.col("_inv")).over(_fit()) + pulled[x] for x in "ab"},
        }
    )
    a, b = _moving("offset_s", F.col("Ta")) & (F.col("Taa") > 0), _moving("drift", F.col("Tb")) & (F.col("Tbb") > 0)
    det = F.col("Taa") * F.col("Tbb") - F.col("Tab") * F.col("Tab")
    solvable = a & b & (det > 0)
    da = F.when(solvable, (F.col("Tb") * F.col("Tab") - F.col("Ta") * F.col("Tbb")) / det).when(a, -F.col("Ta") / F.col("Taa")).otherwise(0.0)
    db = F.when(solvable, (F.col("Ta") * F.col("Tab") - F.col("Tb") * F.col("Taa")) / det).when(b & ~a, -F.col("Tb") / F.col("Tbb")).otherwise(0.0)
    moved = rows.withColumns(
        {
            "next_offset_s": clamp(F.col("offset_s") + da, F.col("offset_s_low"), F.col("offset_s_high")),
            "next_drift": clamp(F.col("drift") + db, F.col("drift_low"), F.col("drift_high")),
        }
    )
    da, db = F.col("next_offset_s") - F.col("offset_s"), F.col("next_drift") - F.col("drift")
    bias = F.col("bias_hz") - (F.col("_g") + F.col("ah") * da + F.col("bh") * db) * F.col("_inv")
    moved = moved.withColumn("next_bias_hz", F.when(F.col("_inv") > 0, clamp(bias, F.col("bias_hz_low"), F.col("bias_hz_high"))).otherwise(F.col("bias_hz")))
    dc = F.col("next_bias_hz") - F.col("bias_hz")
    linear = F.col("ar") * da + F.col("br") * db + F.col("_g") * dc
    bend = (
        F.col("aa") * da * da + 2 * F.col("ab") * da * db + F.col("bb") * db * db
        + 2 * (F.col("ah") * da + F.col("bh") * db) * dc + (F.col("hh") + F.col("bias_hz_prior")) * dc * dc
    )
    small = (F.abs(da) <= tolerance_s) & (F.abs(db) * 86_400 <= tolerance_s) & (F.abs(dc) <= tolerance_hz)
    return moved.withColumns({"promised": -linear - bend / 2, "small": small}).drop("_g", "_inv", "Taa", "Tab", "Tbb", "Ta", "Tb")


def joint_fit(
    observations: DataFrame,
    model,
    *,
    drift: bool = False,
    bound_s: float = 600.0,
    drift_bound: float = 0.1,
    bias_bound_hz: float = 150000.0,
    loss: str = "linear",
    loss_scale: float = 1.0,
    steps: int = 40,
    salts: int = 4,
    tolerance_s: float = 1e-6,
    tolerance_hz: float = 1e-3,
    start: DataFrame | None = None,
    parameters: DataFrame | None = None,
) -> DataFrame:
    """One row for each pass of each fit: values, cost, status and how many trials it took.

    The shift of a sample is offset_s + drift * age, with age in seconds from epoch_us.
    ``parameters`` (the columns of ``PARAMETERS``) may give a parameter its role, initial
    value, bounds and a prior of that mean; a null contact_id speaks for all passes of a
    fit. ``start`` may give initial values of a scan, fit_id and offset_s, with contact_id and
    bias_hz if known; they are no priors.

    A trial is kept if it lowers the cost and uses all samples that the first one used.
    ``status`` is converged (a step within the tolerances: offset_s, drift over a day
    and biases), stalled (no damping lowers the cost), unsettled (``steps`` trials did not
    do), or not_finite (the initial point has no cost). A fit that is done is not read again.
    """
    observations = cut_lineage(observations)
    session = observations.sparkSession
    bounds = {"offset_s": bound_s, "drift": drift_bound, "bias_hz": bias_bound_hz}
    state = _described(observations.select("fit_id", "contact_id").distinct(), parameters, bounds, drift)
    begun = {n: F.col(f"{n}_mean") for n in NAMES}
    if start is not None:
        given = start.select("fit_id", F.col("offset_s").alias("_offset")).distinct()
        state = state.join(given, "fit_id", "left")
        begun["offset_s"] = F.coalesce(F.when(F.col("offset_s_role") == "estimate", F.col("_offset")), begun["offset_s"])
        if "bias_hz" in start.columns:
            state = state.join(start.select("fit_id", "contact_id", F.col("bias_hz").alias("_bias")), ["fit_id", "contact_id"], "left")
            begun["bias_hz"] = F.coalesce(F.when(F.col("bias_hz_role") == "estimate", F.col("_bias")), begun["bias_hz"])
    # a held parameter keeps its value even outside of bounds that are not its own
    begun = {n: F.when(F.col(f"{n}_role") == "estimate", clamp(c, F.col(f"{n}_low"), F.col(f"{n}_high"))).otherwise(c) for n, c in begun.items()}
    state = cut_lineage(
        state.withColumns(begun).withColumns({f"next_{n}": F.col(n) for n in NAMES}).withColumns(
            {
                **{s: F.lit(None).cast("double") for s in _SUMS}, "samples": F.lit(0).cast("long"), "total": F.lit(None).cast("double"),
                "promised": F.lit(0.0), "small": F.lit(False), "damping": F.lit(_FIRST_DAMPING), "growth": F.lit(2.0),
                "trials": F.lit(-1), "status": F.lit("running"),
            }
        ).drop("_offset", "_bias")
    )
    # Laid out once by (fit, pass, salt): a hot pass spreads over the salts, and only the
    # small state moves. A lost part of the cache is read again from the written rows.
    spread = (
        observations.withColumn("_age", (F.col("t_us") - F.col("epoch_us")) / 1e6)
        .withColumn("_salt", F.pmod(F.xxhash64("t_us", "observed_hz"), F.lit(salts)))
        .repartition(int(session.conf.get("spark.sql.shuffle.partitions")), "fit_id", "contact_id", "_salt")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    salt = F.explode(F.expr(f"sequence(0L, {salts - 1}L)"))

    def evaluated(active: DataFrame) -> DataFrame:
        """Sums at the trial point of each pass."""
        known = active.select("fit_id", "contact_id", "next_offset_s", "next_drift", "next_bias_hz", salt.alias("_salt"))
        current = spread.join(known, ["fit_id", "contact_id", "_salt"])
        rows = model(current, F.col("next_offset_s") + F.col("next_drift") * F.col("_age")).select(
            "fit_id", "contact_id", "_age",
            ((F.col("predicted_hz") + F.col("next_bias_hz") - F.col("observed_hz")) / F.col("sigma_hz")).alias("r"),
            (F.col("slope_hz_s") / F.col("sigma_hz")).alias("a"), (1.0 / F.col("sigma_hz")).alias("h"),
        ).withColumn("w", slope_weight(F.col("r"), loss, loss_scale)).withColumn("b", F.col("a") * F.col("_age"))
        products = [F.sum(F.col("w") * F.col(s[0]) * F.col(s[1])).alias(f"n_{s}") for s in _SUMS[1:]]
        cost = 0.5 * loss_scale * loss_scale * F.sum(loss_rho(F.col("r"), loss, loss_scale))
        return rows.groupBy("fit_id", "contact_id").agg(F.count("r").alias("n_samples"), cost.alias("n_cost"), *products)

    def squared(name: str, value: str) -> Column:
        miss = F.col(value) - F.col(f"{name}_mean")
        return 0.5 * F.col(f"{name}_prior") * miss * miss

    for trial in range(steps + 1):
        active = state.where("status = 'running'")
        met = active.join(evaluated(active), ["fit_id", "contact_id"], "left")
        promised = [-F.col(f"{n}_prior") * ((F.col(n) - F.col(f"{n}_mean")) * d + 0.5 * d * d) for n in SHARED for d in [F.col(f"next_{n}") - F.col(n)]]
        met = met.withColumns(
            {
                "_new": F.sum(F.col("n_cost") + squared("bias_hz", "next_bias_hz")).over(_fit()) + squared("offset_s", "next_offset_s") + squared("drift", "next_drift"),
                "_hoped": F.sum("promised").over(_fit()) + promised[0] + promised[1],
                "_all": F.bool_and(F.coalesce((F.col("n_samples") >= F.col("samples")) & (F.col("n_samples") > 0), F.lit(False))).over(_fit()),
            }
        )
        sound = F.col("_all") & F.col("_new").isNotNull() & ~F.isnan("_new") & (F.abs("_new") < math.inf)
        first = F.col("total").isNull()
        gain = F.when(F.col("_hoped") > 0, (F.col("total") - F.col("_new")) / F.col("_hoped")).otherwise(0.0)
        # below the rounding of the cost a gain cannot be told; such a step is taken
        blind = F.abs("_hoped") <= 1e-12 * F.col("total")
        met = met.withColumn("_gain", F.when(blind, 1.0).otherwise(gain)).withColumn("_take", sound & (first | (F.col("_gain") > 1e-4)))
        take = F.col("_take")
        pick = lambda new, old: F.when(take, F.col(new)).otherwise(F.col(old))
        shrink = F.greatest(F.lit(0.1), 1 - F.pow(2 * F.col("_gain") - 1, F.lit(3)))
        damping = F.when(first, F.col("damping")).when(take, F.greatest(F.col("damping") * shrink, F.lit(1e-12))).otherwise(F.col("damping") * F.col("growth"))
        status = (
            F.when(first & ~take, "not_finite").when(~take & (F.col("damping") * F.col("growth") > _MOST_DAMPING), "stalled")
            .when(F.lit(trial == steps), "unsettled").otherwise("running")
        )
        chosen = met.select(
            "fit_id", "contact_id", *[pick(f"next_{n}", n).alias(n) for n in NAMES], *[pick(f"n_{s}", s).alias(s) for s in _SUMS],
            *[c for n in NAMES for c in (f"{n}_role", f"{n}_low", f"{n}_high", f"{n}_mean", f"{n}_prior")],
            pick("n_samples", "samples").alias("samples"), pick("_new", "total").alias("total"), damping.alias("damping"),
            F.when(take, 2.0).otherwise(2 * F.col("growth")).alias("growth"), (F.col("trials") + 1).alias("trials"), status.alias("status"),
        )
        after = _advanced(chosen, tolerance_s, tolerance_hz)
        # a small step says nothing where damping has made it so
        done = F.when(F.col("damping") <= 1.0, "converged").otherwise("stalled")
        after = after.withColumn("_still", F.bool_and("small").over(_fit())).withColumn(
            "status", F.when(F.col("_still") & (F.col("status") != "not_finite"), done).otherwise(F.col("status"))
        )
        state = cut_lineage(state.where("status <> 'running'").unionByName(after.select(*state.columns)))
        if not state.where("status = 'running'").limit(1).count():
            break
    spread.unpersist()
    near = lambda n: (F.abs(F.col(n) - F.col(f"{n}_low")) <= 1e-9 * bounds[n]) | (F.abs(F.col(n) - F.col(f"{n}_high")) <= 1e-9 * bounds[n])
    bound = [(F.col(f"{n}_role") == "estimate") & near(n) for n in NAMES]
    return state.select(
        "fit_id", "contact_id", *NAMES, "samples", F.col("total").alias("cost"), "trials", "status",
        (F.col("status") == "converged").alias("converged"), (bound[0] | bound[1] | bound[2]).alias("at_bound"),
    )
