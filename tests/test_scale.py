"""Steps that hold at size: axes, messages, exports, members and folds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from passledger.functions import geometry as geo
from passledger.operators import planning
from passledger.plans import catalog
from passledger.sources import files as keyed
from passledger.sources import oem

_TABLES = "/root/testdata/sf0.001"


def _folders(path):
    return sum(p.is_dir() for p in path.rglob("*"))


def test_axes_stay_small_enough_to_be_compiled(spark):
    # The JVM never compiles a method beyond 8,000 bytes; with the axes inside branches it had 11,569.
    made = catalog.QUERIES["rtn_projection"](spark, _TABLES)._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < 8_000


def test_axes_without_a_frame_are_null(spark):
    rows = [(7e6, 0.0, 0.0, 0.0, 7500.0), (0.0, 0.0, 0.0, 0.0, 7500.0), (7e6, 0.0, 0.0, 7.0, 0.0)]
    frame = spark.createDataFrame(rows, "px double, py double, pz double, vx double, vy double").withColumn("vz", F.lit(0.0))
    axes = geo.rtn_error([F.lit(1.0), F.lit(2.0), F.lit(3.0)], geo.vector("px", "py", "pz"), geo.vector("vx", "vy", "vz"))
    assert [tuple(r) for r in frame.select(*axes).collect()] == [(1.0, 2.0, 3.0), (None,) * 3, (None,) * 3]


def test_files_of_keys_come_back_whole(spark, tmp_path):
    texts = {"a": ["x" * 300, "", "é"], "odd/na=me": [str(i) * 40 for i in range(40_000)], None: ["one"]}
    rows = [(key, i, line or None) for key, lines in texts.items() for i, line in enumerate(lines)]
    frame = spark.createDataFrame(rows, "k string, no long, text string").repartition(3, "text")
    assert keyed.write_keyed(frame, "k", ["no"], str(tmp_path / "out")) == 3
    assert len([p for p in (tmp_path / "out").rglob("*.txt")]) == 3 and not list((tmp_path / "out").rglob(".*.part"))
    names = {k or "__HIVE_DEFAULT_PARTITION__": v for k, v in texts.items()}
    got = {(r.key, r.line_no): r.text for r in keyed.read_keyed(spark, str(tmp_path / "out")).collect()}
    assert got == {(k, i + 1): line for k, lines in names.items() for i, line in enumerate(lines)}
    hashed = {r.key: (r.sha256, r.byte_count) for r in keyed.digests(spark, "file:" + str(tmp_path / "out"), piece=1_000).collect()}
    whole = {k: "".join(line + "\n" for line in lines).encode() for k, lines in names.items()}
    assert hashed == {k: (hashlib.sha256(c).hexdigest(), len(c)) for k, c in whole.items()}
    assert keyed.write_keyed(frame.where("false"), "k", ["no"], str(tmp_path / "none")) == 0
    assert keyed.read_keyed(spark, str(tmp_path / "none")).count() == 0


def test_snapshot_has_no_folder_for_each_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("passledger.plans.products.scratch_path", lambda spark, label: str(tmp_path / label))
    assert catalog.QUERIES["manifest_verification"](spark, _TABLES).count() == spark.read.parquet(f"{_TABLES}/supplier.parquet").count() + 1
    assert _folders(tmp_path) <= 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["oem_findings", "oem_states", "export_files", "angle_files"])
def test_products_have_no_folder_for_each_file(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr("passledger.plans.products.scratch_path", lambda spark, label: str(tmp_path / label))
    assert catalog.QUERIES[name](spark, _TABLES).limit(1).count() == 1
    assert len(list(tmp_path.rglob("*.txt"))) == spark.read.parquet(f"{_TABLES}/supplier.parquet").count()
    assert _folders(tmp_path) <= 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_messages_are_classified_as_they_are_read(spark, tmp_path):
    body = ["CCSDS_OEM_VERS = 3.0", "", "COMMENT META_START", " META_START ", "A = 1", "META_STOP", "1 2 3", "META_START", "B = 2", "META_STOP", "4 5 6"]
    texts = {1: body, 2: body * 3, 3: ["META_STOP", "x"], 4: ["META_START"]}
    rows = [(k, 0, i, 0, line) for k, lines in texts.items() for i, line in enumerate(lines)]
    oem.write_messages(spark.createDataFrame(rows, "object_id long, segment int, t_us int, part int, text string"), str(tmp_path / "m"))
    numbered = spark.createDataFrame([(str(k), i + 1, line) for k, _, i, _, line in rows], "file string, line_no long, text string")
    columns = ["key", "line_no", "text", "segment", "mode"]
    got = sorted(oem.read_messages(spark, str(tmp_path / "m")).select(*columns).collect())
    assert got == sorted(oem.classify(numbered).withColumnRenamed("file", "key").select(*columns).collect()) and len(got) > 30
    # one read for all that is found, where each branch of the plan had its own
    found = oem.message_findings(oem.read_messages(spark, str(tmp_path / "m")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_members_of_long_groups(spark):
    passes = spark.range(150).selectExpr(
        "IF(id < 140, 'A', 'B') AS spacecraft_id", "concat('P', id) AS contact_id", "id * 3600000000 AS start_us", "id * 3600000000 + 60000000 AS stop_us"
    )
    groups = planning.group_expansion(passes, passes)
    other = planning.group_expansion(passes, passes.select("*"))
    assert sorted(groups.collect()) == sorted(other.collect())
    members = planning.group_members(groups, planning.pass_order(passes))
    got = members.groupBy("spacecraft_id", "family_rank", "last_ordinal").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count_distinct("contact_id").alias("d")
    )
    want = {
        (s, rank, last, last - first + 1, first, last, last - first + 1)
        for s, count in (("A", 140), ("B", 10)) for last in range(1, count + 1)
        for rank, first in enumerate((last, 1, last - 2, 1, 1)) if first >= 1
    }
    assert {tuple(r) for r in got.collect()} == want
    # what is shuffled are groups, not members: no explode to single ordinals stands below the join
    assert "sequence(first_ordinal" not in members._jdf.queryExecution().optimizedPlan().toString()
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 4


def test_folds_are_read_once(spark):
    # with a table of folds written first and read for counts, distinct folds and medians there were many more
    for name, most in (("qualification_median", 1), ("prefix_summary", 1), ("first_attainment", 2)):
        plan = catalog.QUERIES[name](spark, _TABLES)._jdf.queryExecution().optimizedPlan().toString()
        assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
        assert plan[: plan.index("Generate")].count("Aggregate [") <= most


def test_folds_keep_columns_of_their_pass(spark):
    passes = spark.range(70).selectExpr(
        "'A' AS spacecraft_id", "id AS contact_id", "id * 10 AS start_us", "id * 10 + 5 AS stop_us", "id + 0.5D AS mark"
    )
    folds = planning.fold_expansion(planning.pass_order(passes), ["timing"], carry=["mark"])
    got = sorted((r.prefix_count, r.held_ordinal, r.holdout_id, r.mark) for r in folds.where("held_ordinal > 0").collect())
    assert got == [(n, h, h - 1, n - 0.5) for n in range(2, 71) for h in range(1, n + 1)]
    assert sorted(r.prefix_count for r in folds.where("held_ordinal = 0 AND holdout_id IS NULL").collect()) == list(range(1, 71))
