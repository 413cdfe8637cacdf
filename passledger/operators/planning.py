"""Study planning: pass order, groups and leave-one-pass-out folds.

A group of consecutive passes is kept as a range of ordinals, not as a list, so
a plan row has a fixed size however long the history is. ``group_members`` turns
ranges into member rows where the passes themselves are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from passledger.functions.scalars import first_reason
from passledger.operators.ordered import ordinal, value_band
from passledger.operators.ranges import salted_join

# Fit families in their report order, and the study's methods.
FAMILIES = (
    ("timing", "single"),
    ("timing", "cumulative"),
    ("sgp4_L+n", "rolling"),
    ("sgp4_L+n", "cumulative"),
    ("full_state", "cumulative"),
)
METHODS = ("sgp4_L+n", "timing")
_DAY_US = 86_400_000_000
_BLOCK = 64  # ordinals that a group meets at once


def pass_order(contacts: DataFrame, name: str = "ordinal") -> DataFrame:
    """Completion order of the passes of each spacecraft."""
    return ordinal(
        contacts,
        ["spacecraft_id"],
        ["stop_us", "start_us", "contact_id"],
        F.floor(F.col("stop_us") / _DAY_US).cast("long"),
        name,
    )


def pass_labels(contacts: DataFrame) -> DataFrame:
    return pass_order(contacts).withColumn("label", F.format_string("P%02d", "ordinal"))


def first_window(contacts: DataFrame, window_us: int) -> DataFrame:
    """Contacts that end within the window after the first completion."""
    first = contacts.groupBy("spacecraft_id").agg(F.min("stop_us").alias("_first"))
    joined = salted_join(contacts, first, ["spacecraft_id"], F.col("contact_id"))
    return joined.where(F.col("stop_us") <= F.col("_first") + window_us).drop("_first")


def group_expansion(timing: DataFrame, orbit: DataFrame) -> DataFrame:
    """Single, latest-three and cumulative groups of each fit family."""
    def expanded(contacts: DataFrame, wanted: Callable[[str], bool]) -> DataFrame:
        place = F.col("ordinal")
        start = {"single": place, "rolling": place - 2, "cumulative": F.lit(1).cast("long")}
        families = F.array(
            *[
                F.struct(
                    F.lit(method).alias("method"), F.lit(strategy).alias("strategy"),
                    F.lit(rank).alias("family_rank"), start[strategy].alias("first_ordinal"),
                )
                for rank, (method, strategy) in enumerate(FAMILIES)
                if wanted(method)
            ]
        )
        # The passes are put in order once for all their families.
        source = pass_order(contacts).select(
            "spacecraft_id", "contact_id", "start_us", "stop_us", "ordinal", F.inline(families)
        )
        return source.where("first_ordinal >= 1").select(
            "spacecraft_id", "method", "strategy", "family_rank", "first_ordinal",
            F.col("ordinal").alias("last_ordinal"),
            (F.col("ordinal") - F.col("first_ordinal") + 1).alias("pass_count"),
            F.col("contact_id").alias("last_contact_id"),
            F.col("start_us").alias("last_start_us"),
            F.col("stop_us").alias("checkpoint_us"),
        )

    if timing is orbit:
        return expanded(timing, lambda method: True)
    return expanded(timing, lambda method: method == "timing").unionByName(expanded(orbit, lambda method: method != "timing"))


def group_members(groups: DataFrame, ordered: DataFrame) -> DataFrame:
    """One row per member pass of each group.

    A group meets its members by blocks of ordinals, so the rows that are shuffled are
    the groups, once for each block they reach, and not their members.
    """
    block = lambda ordinal: F.floor(ordinal / F.lit(_BLOCK)).cast("long")
    reach = groups.withColumn("_block", F.explode(F.sequence(block(F.col("first_ordinal")), block(F.col("last_ordinal")))))
    members = ordered.select("spacecraft_id", "ordinal", "contact_id", block(F.col("ordinal")).alias("_block"))
    inside = F.col("ordinal").between(F.col("first_ordinal"), F.col("last_ordinal"))
    return reach.join(members, ["spacecraft_id", "_block"]).where(inside).select(*groups.columns, "ordinal", "contact_id")


def fold_expansion(ordered: DataFrame, methods: Sequence[str] = METHODS, carry: Sequence[str] = ()) -> DataFrame:
    """Each prefix as a full fit and, from two passes on, one fold per omitted pass.

    ``ordered`` comes from ``pass_order`` over the contacts of the collection
    window, which bounds the passes of one spacecraft. The members of a fold are
    ordinals 1..prefix_count without held_ordinal. ``carry`` names columns of the
    passes that a prefix takes from its last one. Folds are the members of cumulative
    groups, so prefixes are shuffled and not their folds.
    """
    prefixes = ordered.select(
        "spacecraft_id", F.lit(1).cast("long").alias("first_ordinal"), F.col("ordinal").alias("last_ordinal"),
        F.col("stop_us").alias("checkpoint_us"), *carry,
    )
    kept = ["spacecraft_id", F.col("last_ordinal").alias("prefix_count"), "checkpoint_us", *carry]
    each = group_members(prefixes.where("last_ordinal > 1"), ordered).select(
        *kept, F.col("ordinal").alias("held_ordinal"), F.col("contact_id").alias("holdout_id")
    )
    whole = prefixes.select(*kept, F.lit(0).cast("long").alias("held_ordinal"), F.lit(None).cast(ordered.schema["contact_id"].dataType).alias("holdout_id"))
    named = whole.unionByName(each)
    return named.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).select(
        "spacecraft_id",
        "method",
        "prefix_count",
        "held_ordinal",
        "holdout_id",
        (F.col("prefix_count") - (F.col("held_ordinal") > 0).cast("int")).alias("training_count"),
        "checkpoint_us",
        F.format_string("%s/prefix-%02d/omit-%02d", "method", "prefix_count", "held_ordinal").alias(
            "run_id"
        ),
        *carry,
    )


def omission_plan(ordered: DataFrame, variants: Sequence[str]) -> DataFrame:
    """One full fit and each whole-pass omission per variant, from three passes on."""
    sizes = ordered.groupBy("spacecraft_id").agg(F.count(F.lit(1)).alias("passes"))
    kept = sizes.where(F.col("passes") >= 3)
    full = kept.withColumn("holdout_id", F.lit(None).cast("string"))
    each = salted_join(
        ordered.select("spacecraft_id", F.col("contact_id").alias("holdout_id")),
        kept,
        ["spacecraft_id"],
        F.col("holdout_id"),
    )
    rows = full.unionByName(each)
    return rows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))


def validation_kind(names: Sequence[str]):
    """Labels for full, last-pass, first-pass and interior folds, in that order."""
    full, last, first, interior = names
    return first_reason(
        [
            (F.col("held_ordinal") == 0, full),
            (F.col("held_ordinal") == F.col("prefix_count"), last),
            (F.col("held_ordinal") == 1, first),
        ],
        interior,
    )


def causal_groups(
    eligible: DataFrame, anchors: DataFrame, sizes: Sequence[int] = (1, 3, 5, 8)
) -> DataFrame:
    """The last n eligible contacts up to each anchor, never a future one."""
    if any(n < 1 for n in sizes):
        raise ValueError("window sizes must be positive")
    ordered = ordinal(
        eligible,
        ["spacecraft_id"],
        ["stop_us", "contact_id"],
        F.floor(F.col("stop_us") / _DAY_US).cast("long"),
    ).select("spacecraft_id", "contact_id", "ordinal")
    deepest = max(sizes)
    reach = ordered.select(
        "spacecraft_id",
        F.col("contact_id").alias("anchor_id"),
        F.col("ordinal").alias("_anchor"),
        F.explode(F.sequence(F.lit(0), F.lit(deepest - 1))).alias("_back"),
    ).withColumn("ordinal", F.col("_anchor") - F.col("_back"))
    # At most ``deepest`` members per anchor reach the list.
    members = (
        reach.join(ordered, ["spacecraft_id", "ordinal"])
        .groupBy("spacecraft_id", "anchor_id", "_anchor")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "contact_id"))).alias("_members"))
    )
    joined = anchors.select(
        "spacecraft_id", F.col("contact_id").alias("anchor_id")
    ).join(members, ["spacecraft_id", "anchor_id"], "left")
    rows = joined.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes])))
    tail = F.slice(
        F.col("_members"),
        F.greatest(F.size("_members") - F.col("size") + 1, F.lit(1)),
        F.col("size"),
    )
    return rows.select(
        "spacecraft_id",
        "anchor_id",
        "size",
        F.when(F.col("_members").isNull(), F.array().cast("array<string>"))
        .otherwise(F.transform(tail, lambda m: m["contact_id"]))
        .alias("contact_ids"),
        F.when(F.col("_members").isNull(), "screening_failed")
        .when(F.col("_anchor") >= F.col("size"), "ready")
        .otherwise("warm_up")
        .alias("status"),
        F.when(F.col("_members").isNull(), "anchor_gated")
        .otherwise("")
        .alias("reason"),
    )


def top_fraction(
    candidates: DataFrame, keys: Sequence[str], metric: str, fraction: float = 0.5
) -> DataFrame:
    """Keep the best ceil(fraction * n) full-rank contacts; a reason for the rest.

    Ties go to the newest stop, then to the smaller id. ``rank`` is null where
    the pilot fit failed.
    """
    if not 0 < fraction <= 1:
        raise ValueError("the retained fraction must lie in (0, 1]")
    keys = list(keys)
    valid = candidates.where((F.col("rank") == 6) & F.col(metric).isNotNull()).withColumn(
        "_newest", -F.col("stop_us")
    )
    placed = ordinal(
        valid, keys, [metric, "_newest", "contact_id"], value_band(F.col(metric)), "_place"
    )
    sizes = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = F.ceil(F.col("_n") * F.lit(fraction))
    chosen = placed.join(sizes, keys).select(
        "contact_id", (F.col("_place") <= limit).alias("_kept")
    )
    return candidates.join(chosen, "contact_id", "left").select(
        *keys,
        "contact_id",
        F.coalesce("_kept", F.lit(False)).alias("selected"),
        first_reason(
            [
                (F.col("rank").isNull(), "pilot_failed"),
                (F.col("rank") < 6, "rank_deficient"),
                (F.coalesce("_kept", F.lit(False)), "selected"),
            ],
            "below_fraction",
        ).alias("reason"),
    )


def fraction_status(selection: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each group of ``top_fraction``: counts, and whether it can be fitted.

    ``ready`` with at least one selected contact, else ``selection_failed``.
    """
    counted = selection.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("selected").alias("selected"),
        F.count_if(F.col("reason") == "pilot_failed").alias("pilot_failed"), F.count_if(F.col("reason") == "rank_deficient").alias("rank_deficient"),
    )
    return counted.withColumn("status", F.when(F.col("selected") > 0, "ready").otherwise("selection_failed"))


class PlanGroups:
    """``group_expansion`` as a table function: a row in for each pass in completion order.

    Only the passes counted so far are held, so a partition of any length streams through.
    """

    def __init__(self) -> None:
        self.seen = 0

    @staticmethod
    def analyze(passes: AnalyzeArgument) -> AnalyzeResult:
        if not passes.isTable:
            raise ValueError("plan_groups takes TABLE(passes)")
        lacking = {"spacecraft_id", "contact_id", "start_us", "stop_us"} - {f.name for f in passes.dataType.fields}
        if lacking:
            raise ValueError(f"passes lack {', '.join(sorted(lacking))}")
        kind = {f.name: f.dataType for f in passes.dataType.fields}
        out = StructType().add("spacecraft_id", kind["spacecraft_id"]).add("method", StringType()).add("strategy", StringType()).add("family_rank", IntegerType())
        for name in ("first_ordinal", "last_ordinal", "pass_count"):
            out = out.add(name, LongType())
        return AnalyzeResult(
            out.add("last_contact_id", kind["contact_id"]).add("checkpoint_us", LongType()),
            partitionBy=[PartitioningColumn("spacecraft_id")],
            orderBy=[OrderingColumn(c) for c in ("stop_us", "start_us", "contact_id")],
        )

    def eval(self, row) -> Iterator[tuple]:
        self.seen += 1
        for rank, (method, strategy) in enumerate(FAMILIES):
            first = {"single": self.seen, "rolling": self.seen - 2, "cumulative": 1}[strategy]
            if first > 0:
                yield row["spacecraft_id"], method, strategy, rank, first, self.seen, self.seen - first + 1, row["contact_id"], row["stop_us"]


def register_table_functions(spark: SparkSession) -> None:
    """``SELECT * FROM plan_groups(TABLE(passes))``: partitioned by spacecraft and ordered by itself."""
    spark.udtf.register("plan_groups", udtf(PlanGroups))
