"""Queries for joins, membership and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passledger.functions.scalars import derived_identity
from passledger.operators import joins
from passledger.operators.ranges import as_of, without_overlap
from passledger.plans.registry import query
from passledger.plans.rounding import r, rd
from passledger.plans.scans import _SOURCES, source_contacts
from passledger.plans.standins import DAY_US, Tables
from passledger.operators.selectors import eligible_source

MONTH_US = 30 * DAY_US


@query(
    "preparation_check",
    "J01",
    """
    WITH @passes, q AS (SELECT pass_no // 6 AS fit_id, contact_id FROM passes WHERE NOT (status = 'P' AND priority = '5-LOW')),
    cr AS (SELECT contact_id, CASE WHEN pass_no % 40 = 3 THEN spacecraft_id ELSE concat('V', pass_no // 6) END AS spacecraft_id FROM passes),
    s AS (SELECT l_orderkey // 6 AS fit_id, concat('P', l_orderkey) AS contact_id, count(*) AS n FROM lineitem GROUP BY 1, 2),
    w AS (SELECT q.fit_id, q.contact_id, spacecraft_id, true AS wanted FROM q LEFT JOIN cr USING (contact_id)),
    b AS (SELECT * FROM w FULL JOIN s USING (fit_id, contact_id))
    SELECT fit_id, count(wanted) AS requested, count(*) FILTER (wanted AND coalesce(n, 0) < 1) AS insufficient,
      count(*) FILTER (wanted IS NULL) AS unrequested, count(DISTINCT spacecraft_id) AS spacecraft,
      CAST(sum(CASE WHEN wanted THEN n END) AS BIGINT) AS samples,
      CASE WHEN count(DISTINCT spacecraft_id) <> 1 THEN 'several_spacecraft'
        WHEN count(*) FILTER (wanted IS NULL) > 0 THEN 'unrequested'
        WHEN count(*) FILTER (wanted AND coalesce(n, 0) < 1) > 0 THEN 'too_few_samples' ELSE 'ready' END AS status
    FROM b GROUP BY fit_id""",
)
def preparation_check(t: Tables) -> DataFrame:
    fit = F.expr("pass_no div 6").alias("fit_id")
    requests = t.passes.where("NOT (status = 'P' AND priority = '5-LOW')").select(fit, "contact_id")
    contacts = t.passes.selectExpr(
        "contact_id",
        "CASE WHEN pass_no % 40 = 3 THEN spacecraft_id ELSE concat('V', pass_no div 6) END AS spacecraft_id",
    )
    selected = (
        t.table("lineitem")
        .selectExpr("l_orderkey div 6 AS fit_id", "concat('P', l_orderkey) AS contact_id")
    )
    return joins.preparation_check(requests, contacts, selected, 1)


@query(
    "packet_fixes",
    "J04",
    f"""
    WITH e AS (SELECT l_orderkey AS packet, max(epoch_us(l_shipdate)) AS epoch_us, {rd('max(l_discount)')} AS spread FROM lineitem WHERE l_linenumber < 5 GROUP BY 1),
    v AS (SELECT l_orderkey AS packet, {rd('min(l_quantity / 8)')} AS speed FROM lineitem WHERE l_linenumber >= 5 GROUP BY 1)
    SELECT o_orderkey AS packet, o_totalprice AS position, epoch_us, spread, speed FROM orders LEFT JOIN e ON e.packet = o_orderkey LEFT JOIN v ON v.packet = o_orderkey""",
)
def packet_fixes(t: Tables) -> DataFrame:
    lines = t.table("lineitem").withColumnRenamed("l_orderkey", "packet")
    epochs = lines.where("l_linenumber < 5").groupBy("packet").agg(
        F.max(F.expr("unix_micros(CAST(l_shipdate AS TIMESTAMP))")).alias("epoch_us"),
        r(F.max("l_discount")).alias("spread"),
    )
    velocities = lines.where("l_linenumber >= 5").groupBy("packet").agg(
        r(F.min(F.col("l_quantity") / 8)).alias("speed")
    )
    positions = t.table("orders").selectExpr("o_orderkey AS packet", "o_totalprice AS position")
    return joins.packet_fixes(positions, epochs, velocities)


@query(
    "paired_delta",
    "J09",
    f"""
    WITH f AS (SELECT concat('V', o_orderkey // 3 // 5) AS spacecraft, o_orderkey // 3 AS holdout_id,
       ['base', 'bstar', 'drag'][o_orderkey % 3 + 1] AS variant, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 1000 END AS score FROM orders)
    SELECT a.spacecraft, a.variant, count(*) AS paired_folds, {rd('avg(a.score - b.score)')} AS paired_delta,
      count(*) FILTER (a.score < b.score) AS improved_folds
    FROM f a JOIN f b USING (spacecraft, holdout_id) WHERE b.variant = 'base' AND a.variant <> 'base' AND a.score IS NOT NULL AND b.score IS NOT NULL GROUP BY 1, 2""",
)
def paired_delta(t: Tables) -> DataFrame:
    out = joins.paired_delta(variant_folds(t), ["spacecraft"], "variant", "base", "score")
    return out.withColumn("paired_delta", r("paired_delta"))


def variant_folds(t: Tables) -> DataFrame:
    return t.table("orders").selectExpr(
        "concat('V', o_orderkey div 3 div 5) AS spacecraft",
        "o_orderkey div 3 AS holdout_id",
        "element_at(array('base', 'bstar', 'drag'), CAST(o_orderkey % 3 + 1 AS INT)) AS variant",
        "CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 1000 END AS score",
        "o_orderkey % 11 <> 0 AS success",
        "CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 1e7 END AS coefficient",
    )


@query(
    "latest_prior",
    "J10",
    """
    WITH @passes, c AS (SELECT pass_no // 6 AS fit_id, contact_id, concat('E', pass_no % 50) AS ephemeris_id, start_us FROM passes),
    l AS (SELECT fit_id, arg_max(struct_pack(contact_id := contact_id, e := ephemeris_id), (start_us, contact_id)) AS m FROM c GROUP BY 1)
    SELECT fit_id, CASE WHEN fit_id % 5 = 0 THEN concat('R', fit_id) ELSE m.e END AS ephemeris_id,
      CASE WHEN fit_id % 5 = 0 THEN 'request' ELSE 'latest_contact' END AS source, CASE WHEN fit_id % 5 = 0 THEN NULL ELSE m.contact_id END AS contact_id FROM l""",
)
def latest_prior(t: Tables) -> DataFrame:
    contacts = t.passes.selectExpr(
        "pass_no div 6 AS fit_id", "contact_id", "concat('E', pass_no % 50) AS ephemeris_id", "start_us"
    )
    requests = contacts.select("fit_id").distinct().withColumn(
        "requested_id", F.when(F.col("fit_id") % 5 == 0, F.concat(F.lit("R"), "fit_id"))
    )
    return joins.latest_prior(requests, contacts)


@query(
    "as_of_prior",
    "J10 F13",
    """
    WITH q AS (SELECT user_id, event_id, epoch_us(ts) AS at_us FROM events),
    h AS (SELECT user_id, event_id AS prior_id, epoch_us(ts) AS known_us FROM events WHERE event_type = 'purchase')
    SELECT q.event_id, max(known_us) AS known_us FROM q LEFT JOIN h ON h.user_id = q.user_id AND known_us <= at_us GROUP BY 1""",
)
def as_of_prior(t: Tables) -> DataFrame:
    events = t.table("events").selectExpr(
        "user_id", "event_id", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS at_us"
    )
    history = events.where("event_type = 'purchase'").selectExpr("user_id", "at_us AS known_us")
    found = as_of(
        events.drop("event_type"), history, ["user_id"], "at_us", "known_us", ["known_us"], width=DAY_US
    )
    return found.select("event_id", F.col("latest.known_us").alias("known_us"))


@query(
    "overlap_anti",
    "J11",
    """
    WITH @bookings SELECT a.id, a.antenna_id FROM bookings a WHERE a.state = 'F' AND NOT EXISTS (SELECT 1 FROM bookings b
      WHERE b.antenna_id = a.antenna_id AND b.state = 'O' AND a.start_us - 3600000000 < b.end_us AND b.start_us < a.end_us + 1800000000)""",
)
def overlap_anti(t: Tables) -> DataFrame:
    candidates = t.bookings.where("state = 'F'").selectExpr(
        "id", "antenna_id", "start_us - 3600000000 AS setup_us", "end_us + 1800000000 AS teardown_us"
    )
    booked = t.bookings.where("state = 'O'").select("antenna_id", "start_us", "end_us")
    free = without_overlap(
        candidates, booked, ["antenna_id"], "setup_us", "teardown_us",
        booked_start="start_us", booked_stop="end_us", width=MONTH_US,
    )
    return free.select("id", "antenna_id")


@query(
    "first_safe_candidate",
    "T03",
    f"""
    WITH @passes, {_SOURCES}, @bookings, c AS (SELECT s.id, b.antenna_id, s.start_us, b.start_us AS bs, b.end_us FROM s JOIN bookings b ON b.id = s.id
      WHERE b.state <> 'O' AND s.spacecraft_id <> '' AND s.end_us > s.start_us AND s.end_us - s.start_us >= 480000000 AND lower(s.state) IN ('scheduled', 'confirmed', 'booked', 'active')),
    free AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.antenna_id = c.antenna_id AND b.state = 'O' AND c.bs < b.end_us AND b.start_us < c.end_us))
    SELECT antenna_id, arg_min(id, (start_us, id)) AS id FROM free GROUP BY 1""",
)
def first_safe_candidate(t: Tables) -> DataFrame:
    sources = source_contacts(t).where(eligible_source(480_000_000))
    span = t.bookings.where("state <> 'O'").selectExpr(
        "id", "antenna_id", "start_us AS booking_us", "end_us AS teardown_us"
    )
    candidates = sources.select("id", "start_us").join(span, "id")
    booked = t.bookings.where("state = 'O'").select("antenna_id", "start_us", "end_us")
    free = without_overlap(
        candidates, booked, ["antenna_id"], "booking_us", "teardown_us",
        booked_start="start_us", booked_stop="end_us", width=MONTH_US,
    )
    return free.groupBy("antenna_id").agg(F.min_by("id", F.struct("start_us", "id")).alias("id"))


_ID = "concat('pass-', substring(sha256(concat({0}, chr(0), {1}, chr(0), {2})), 1, 24))"


@query(
    "idempotent_lookup",
    "J12 X17",
    f"""
    WITH @passes, p AS (SELECT pass_no, {_ID.format('CAST(pass_no AS VARCHAR)', 'system_id', "'leo'")} AS identity, priority FROM passes),
    b AS (SELECT identity AS external_ref, min(pass_no + 1000000) AS existing_id FROM p WHERE priority = '1-URGENT' GROUP BY 1)
    SELECT pass_no, identity, existing_id FROM p LEFT JOIN b ON b.external_ref = p.identity""",
)
def idempotent_lookup(t: Tables) -> DataFrame:
    identity = derived_identity("pass-", F.col("pass_no").cast("string"), F.col("system_id"), F.lit("leo"))
    planned = t.passes.select("pass_no", identity.alias("identity"), "priority")
    plans = planned.drop("priority")
    booked = planned.where("priority = '1-URGENT'").selectExpr(
        "identity AS external_ref", "pass_no + 1000000 AS booking_id"
    )
    return joins.idempotent_lookup(plans, booked)


# --- job tables: orders as jobs, lineitem as contacts, runs and artifacts ------

_JOBS = """
    jobs AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status,
       o_orderpriority AS stage, o_custkey AS actor_id, epoch_us(o_orderdate) AS created_us,
       CASE WHEN o_orderpriority <> '5-LOW' THEN 'estimate' ELSE 'tdm_export' END AS operation FROM orders),
    job_contacts AS (SELECT l_orderkey AS job_id, l_linenumber - 1 AS ordinal, concat('K', min(l_partkey)) AS contact_id, min(l_suppkey) AS system_no
       FROM lineitem GROUP BY 1, 2)"""


def jobs(t: Tables) -> DataFrame:
    return t.table("orders").selectExpr(
        "o_orderkey AS job_id",
        "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status",
        "o_orderpriority AS stage",
        "o_custkey AS actor_id",
        "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS created_us",
        "CASE WHEN o_orderpriority <> '5-LOW' THEN 'estimate' ELSE 'tdm_export' END AS operation",
    )


def job_contacts(t: Tables) -> DataFrame:
    return t.table("lineitem").groupBy(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).alias("ordinal")
    ).agg(
        F.concat(F.lit("K"), F.min("l_partkey")).alias("contact_id"),
        F.min("l_suppkey").alias("system_no"),
    )


@query(
    "job_status_view",
    "J13",
    f"""WITH {_JOBS} SELECT j.job_id, status, stage, actor_id, created_us, operation, contact_id, system_no FROM jobs j
    LEFT JOIN job_contacts c ON c.job_id = j.job_id AND c.ordinal = 0""",
)
def job_status_view(t: Tables) -> DataFrame:
    return joins.job_status(jobs(t), job_contacts(t), ["contact_id", "system_no"])


@query(
    "job_results_view",
    "J13",
    f"""WITH {_JOBS}, runs AS (SELECT o_orderkey AS job_id, o_orderkey % 3 AS ordinal, o_orderpriority AS algorithm FROM orders)
    SELECT j.job_id, status, algorithm, contact_id FROM jobs j JOIN runs r ON r.job_id = j.job_id AND r.ordinal = 0
    LEFT JOIN job_contacts c ON c.job_id = j.job_id AND c.ordinal = 0""",
)
def job_results_view(t: Tables) -> DataFrame:
    runs = t.table("orders").selectExpr(
        "o_orderkey AS job_id", "o_orderkey % 3 AS ordinal", "o_orderpriority AS algorithm"
    )
    slim = jobs(t).select("job_id", "status")
    return joins.job_results(slim, runs, job_contacts(t), ["algorithm"], ["contact_id"])


_ESTIMATES = "estimates AS (SELECT o_orderkey + 7000000 AS estimate_id, o_orderkey AS job_id, o_custkey % 9 AS model_no FROM orders WHERE o_orderpriority <> '5-LOW')"


def estimates(t: Tables) -> DataFrame:
    return t.table("orders").where("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey + 7000000 AS estimate_id", "o_orderkey AS job_id", "o_custkey % 9 AS model_no"
    )


@query(
    "estimates_view",
    "J14",
    f"""WITH {_JOBS}, {_ESTIMATES} SELECT e.estimate_id, e.job_id, model_no, status, created_us,
      (SELECT string_agg(contact_id, ',' ORDER BY ordinal) FROM job_contacts c WHERE c.job_id = e.job_id) AS contact_ids
    FROM estimates e JOIN jobs j ON j.job_id = e.job_id""",
)
def estimates_view(t: Tables) -> DataFrame:
    contacts = job_contacts(t).withColumn("estimate_id", F.col("job_id") + 7000000)
    view = joins.estimates_view(
        estimates(t), jobs(t).select("job_id", "status", "created_us"), contacts.drop("job_id")
    )
    return view.withColumn("contact_ids", F.array_join("contact_ids", ","))


@query(
    "estimate_events_view",
    "J15",
    f"""WITH {_ESTIMATES} SELECT estimate_id, job_id, l_linenumber AS event_no, l_returnflag AS event_type, l_partkey AS detail
    FROM estimates JOIN lineitem ON l_orderkey = job_id""",
)
def estimate_events_view(t: Tables) -> DataFrame:
    events = t.table("lineitem").selectExpr(
        "l_orderkey AS job_id", "l_linenumber AS event_no", "l_returnflag AS event_type", "l_partkey AS detail"
    )
    return joins.estimate_events(estimates(t), events)


@query(
    "text_artifacts_view",
    "J15",
    f"""WITH {_JOBS}, a AS (SELECT doc_id * 7 AS job_id, doc_id AS artifact_id, text, source FROM documents)
    SELECT j.job_id, artifact_id, contact_id, source AS product, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS byte_count,
      CAST(NULL AS VARCHAR) AS warnings, text AS tdm_text FROM jobs j JOIN a ON a.job_id = j.job_id
      LEFT JOIN job_contacts c ON c.job_id = j.job_id AND c.ordinal = 0 WHERE operation = 'tdm_export'""",
)
def text_artifacts_view(t: Tables) -> DataFrame:
    payload = F.encode("text", "UTF-8")
    artifacts = t.table("documents").select(
        (F.col("doc_id") * 7).alias("job_id"),
        F.col("doc_id").alias("artifact_id"),
        F.lit("tdm").alias("kind"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("sha256"),
        F.to_json(F.struct(F.col("source").alias("product"))).alias("metadata"),
    )
    queue = jobs(t).withColumn("warnings", F.lit(None).cast("string"))
    return joins.text_artifacts(queue, artifacts, job_contacts(t))


_LINES = "concat('1 ', {0}) AS line1, concat('2 ', {0}, '-', {1}) AS line2"


@query(
    "exact_prior_match",
    "J16",
    """
    WITH e AS (SELECT concat('1 ', o_custkey) AS line1, concat('2 ', o_custkey, '-', o_orderkey % 3) AS line2, concat('E', o_orderkey % 8) AS ephemeris_id FROM orders),
    m AS (SELECT line1, line2, count(DISTINCT ephemeris_id) AS matches, min(ephemeris_id) AS id FROM e GROUP BY 1, 2)
    SELECT c_custkey AS craft, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN id END AS ephemeris_id
    FROM customer LEFT JOIN m ON line1 = concat('1 ', c_custkey) AND line2 = concat('2 ', c_custkey, '-', 1)""",
)
def exact_prior_match(t: Tables) -> DataFrame:
    offered = t.table("orders").selectExpr(
        "concat('1 ', o_custkey) AS line1",
        "concat('2 ', o_custkey, '-', o_orderkey % 3) AS line2",
        "concat('E', o_orderkey % 8) AS ephemeris_id",
    )
    priors = t.table("customer").selectExpr(
        "c_custkey AS craft", "concat('1 ', c_custkey) AS line1", "concat('2 ', c_custkey, '-', 1) AS line2"
    )
    return joins.exact_prior_match(priors, offered)


@query(
    "common_prior",
    "J17",
    """
    WITH @passes SELECT spacecraft_id, count(*) AS contacts, count(DISTINCT CASE WHEN pass_no % 29 = 0 THEN 'b' ELSE 'a' END) = 1 AS common FROM passes GROUP BY 1""",
)
def common_prior(t: Tables) -> DataFrame:
    contacts = t.passes.selectExpr(
        "spacecraft_id", "'1 line' AS line1", "CASE WHEN pass_no % 29 = 0 THEN 'b' ELSE 'a' END AS line2"
    )
    return joins.common_prior(contacts)


@query(
    "reference_binding",
    "J18",
    """
    WITH @passes, f AS (SELECT concat('V', c_custkey) AS spacecraft_id, concat('2026-', c_custkey % 7) AS object_id FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    b AS (SELECT concat('V', c_custkey) AS spacecraft_id, concat('2026-', c_custkey % 7) AS object_id FROM customer WHERE c_acctbal > 5000)
    SELECT p.contact_id, CASE WHEN f.object_id IS NULL THEN 'no reference' WHEN f.object_id = concat('2026-', pass_no % 7) THEN 'cospar'
      WHEN b.object_id IS NOT NULL THEN 'explicit binding' ELSE 'other_reference' END AS binding
    FROM passes p LEFT JOIN f ON f.spacecraft_id = p.spacecraft_id LEFT JOIN b ON b.spacecraft_id = p.spacecraft_id AND b.object_id = f.object_id""",
)
def reference_binding(t: Tables) -> DataFrame:
    named = t.table("customer").selectExpr(
        "c_mktsegment", "c_acctbal", "concat('V', c_custkey) AS spacecraft_id", "concat('2026-', c_custkey % 7) AS object_id"
    )
    named_ids = ["spacecraft_id", "object_id"]
    contacts = t.passes.selectExpr("contact_id", "spacecraft_id", "concat('2026-', pass_no % 7) AS cospar")
    bindings = named.where("c_acctbal > 5000").select(*named_ids).withColumn("bound", F.lit(True))
    return joins.reference_binding(named.where("c_mktsegment <> 'MACHINERY'").select(*named_ids), contacts, bindings)


@query(
    "membership",
    "J19",
    """
    SELECT concat('P', l_orderkey * 2) AS contact_id, count(*) AS n, bool_or(o_orderkey IS NOT NULL) AS known
    FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey * 2 GROUP BY 1""",
)
def membership(t: Tables) -> DataFrame:
    requested = t.table("lineitem").selectExpr("concat('P', l_orderkey * 2) AS contact_id")
    counted = requested.groupBy("contact_id").agg(F.count(F.lit(1)).alias("n"))
    return joins.membership(counted, t.passes, "contact_id")


@query(
    "reconcile_attempts",
    "J20",
    """
    WITH @passes, p AS (SELECT pass_no, stop_us FROM passes WHERE priority <> '2-HIGH'),
    s AS (SELECT pass_no, CASE WHEN pass_no % 5 = 0 THEN stop_us + 1 ELSE stop_us END AS stop_us FROM passes WHERE priority <> '4-NOT SPECIFIED')
    SELECT pass_no, CASE WHEN s.stop_us IS NULL THEN 'missing' WHEN p.stop_us IS NULL THEN 'extra'
      WHEN p.stop_us <> s.stop_us THEN 'stop_us differs' ELSE '' END AS finding FROM p FULL JOIN s USING (pass_no)""",
)
def reconcile_attempts(t: Tables) -> DataFrame:
    planned = t.passes.where("priority <> '2-HIGH'").select("pass_no", "stop_us")
    saved = t.passes.where("priority <> '4-NOT SPECIFIED'").selectExpr(
        "pass_no", "CASE WHEN pass_no % 5 = 0 THEN stop_us + 1 ELSE stop_us END AS stop_us"
    )
    return joins.reconcile(planned, saved, ["pass_no"], ["stop_us"])


@query(
    "contact_metadata",
    "S08 X14",
    f"""
    WITH @passes, a AS (SELECT n_nationkey, concat('A', n_nationkey) AS system_id, n_name FROM nation),
    j AS (SELECT p.contact_id, a.n_name AS antenna_name, c_name AS craft,
      CASE WHEN a.n_name IS NULL OR priority = '5-LOW' THEN 'other_antenna'
        WHEN c_name IS NULL THEN 'other_spacecraft'
        WHEN pass_no % 37 = 0 THEN 'other_ephemeris' ELSE '' END AS reason
      FROM passes p LEFT JOIN a ON a.system_id = p.system_id LEFT JOIN customer c ON concat('V', c_custkey) = p.spacecraft_id AND c_mktsegment <> 'HOUSEHOLD')
    SELECT contact_id, antenna_name, craft, reason FROM j""",
)
def contact_metadata(t: Tables) -> DataFrame:
    antennas = t.table("nation").selectExpr(
        "concat('A', n_nationkey) AS system_id", "n_name AS antenna_name", "concat('G', n_nationkey) AS antenna_station"
    )
    craft = t.table("customer").where("c_mktsegment <> 'HOUSEHOLD'").selectExpr(
        "concat('V', c_custkey) AS spacecraft_id", "c_name AS spacecraft_name"
    )
    contacts = t.passes.selectExpr(
        "contact_id", "system_id", "spacecraft_id",
        "CASE WHEN priority = '5-LOW' THEN 'elsewhere' ELSE concat('G', pass_no % 7) END AS station_id",
        "concat('E', pass_no) AS ephemeris_id",
    )
    ephemerides = t.passes.selectExpr(
        "concat('E', pass_no) AS ephemeris_id",
        "CASE WHEN pass_no % 37 = 0 THEN 'other' ELSE spacecraft_id END AS ephemeris_spacecraft",
    )
    checked = joins.metadata_check(contacts, antennas, craft, ephemerides)
    return checked.select("contact_id", "antenna_name", F.col("spacecraft_name").alias("craft"), "reason")


@query(
    "link_frequency",
    "S22",
    """
    WITH q AS (SELECT o_orderkey AS id, o_custkey AS spacecraft_id, concat('L', o_orderkey % 3) AS link_name, CASE WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END AS wanted FROM orders),
    l AS (SELECT c_custkey AS spacecraft_id, concat('L', g) AS link_name, CASE WHEN (c_custkey + g) % 2 = 0 THEN 'up' ELSE 'down' END AS direction,
      CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_acctbal + 500) * 100000 END AS frequency_hz FROM customer, (SELECT unnest([0, 1]) AS g)),
    j AS (SELECT id, frequency_hz AS f, CASE WHEN direction IS NULL THEN 'no_link' WHEN direction <> wanted THEN 'link_direction'
      WHEN frequency_hz IS NULL THEN 'link_number' WHEN frequency_hz <= 0 THEN 'link_frequency' ELSE '' END AS reason
      FROM q LEFT JOIN l ON l.spacecraft_id = q.spacecraft_id AND l.link_name = q.link_name)
    SELECT id, CASE WHEN reason = '' THEN round(f, 3) END AS frequency_hz, reason FROM j""",
)
def link_frequency(t: Tables) -> DataFrame:
    requests = t.table("orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS spacecraft_id", "concat('L', o_orderkey % 3) AS link_name",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END AS wanted",
    )
    links = t.table("customer").withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
        "c_custkey AS spacecraft_id", "concat('L', g) AS link_name",
        "CASE WHEN (c_custkey + g) % 2 = 0 THEN 'up' ELSE 'down' END AS direction",
        "CASE WHEN c_custkey % 7 <> 0 THEN (c_acctbal + 500) * 100000 END AS frequency_hz",
    )
    out = joins.link_frequency(requests, links)
    return out.select("id", F.round("frequency_hz", 3).alias("frequency_hz"), "reason")


@query(
    "station_calibration",
    "S23",
    """
    WITH @passes, k AS (SELECT concat('A', s_suppkey % 5) AS antenna, 'S' AS band, min(epoch_us(TIMESTAMP '1995-01-01') + s_suppkey * 86400000000 * 300) AS cal, min(s_acctbal) AS corr
      FROM supplier GROUP BY 1),
    j AS (SELECT contact_id, corr, CASE WHEN cal IS NULL THEN 'no_calibration' WHEN cal // 86400000000 > start_us // 86400000000
      THEN 'calibration_later' ELSE '' END AS reason FROM passes LEFT JOIN k ON k.antenna = system_id)
    SELECT contact_id, CASE WHEN reason = '' THEN corr END AS correction_hz, reason FROM j""",
)
def station_calibration(t: Tables) -> DataFrame:
    calibrations = (
        t.table("supplier")
        .groupBy(F.concat(F.lit("A"), F.col("s_suppkey") % 5).alias("antenna"), F.lit("S").alias("band"))
        .agg(
            F.min(F.expr("788918400000000 + s_suppkey * 86400000000 * 300")).alias("calibrated_us"),
            F.min("s_acctbal").alias("correction_hz"),
        )
    )
    contacts = t.passes.selectExpr("contact_id", "system_id AS antenna", "'S' AS band", "start_us")
    out = joins.station_calibration(contacts, calibrations)
    return out.select("contact_id", "correction_hz", "reason")



