"""Queries that apply the cohort operators to the star schema, events and embeddings, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions.clean import clean_double, elapsed, hash_order, item_token, sign_bits, stable_path
from .operators import audit, cohort, masks, matching, metrics, modeling, neighbours, pooling, quantiles, relations, review, robust, sampling
from .plans.scratch import kept
from .plans.store import row_digests
from .roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(*columns: str, digits: int = 9):
    return [F.round(c, digits).alias(c) for c in columns]


# catalogue, identity, sequences ----------------------------------------------------------


@query("SELECT count(DISTINCT user_id) AS subjects, count(*) AS items, count(DISTINCT (user_id, event_type)) AS series, count(*) FILTER (user_id % 2 = 0) AS items_0, count(*) FILTER (user_id % 2 = 1) AS items_1 FROM events")
def cohort_summary(spark, d):
    items = _t(spark, d, "events").select("event_id", "event_type", "user_id", (F.col("user_id") % 2).alias("label"))
    return cohort.summary(items, Roles("event_id", "event_type", "user_id", "label"))


@query("SELECT user_id, count(DISTINCT event_type) AS labels FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def mixed_labels(spark, d):
    return cohort.mixed_labels(_t(spark, d, "events"), Roles(subject="user_id", label="event_type"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return cohort.duplicates(_t(spark, d, "events"), "user_id")


@query("""
WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER w - 1 AS seq_index, count(*) OVER (PARTITION BY user_id, event_type) AS seq_length,
  coalesce(lag(event_id) OVER w, event_id) AS prev_item, coalesce(lead(event_id) OVER w, event_id) AS next_item FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, seq_index, seq_length, prev_item, next_item, round(CASE WHEN seq_length <= 1 THEN 0.5 ELSE seq_index::DOUBLE / (seq_length - 1) END, 9) AS seq_position FROM s""")
def sequence_neighbours(spark, d):
    out = cohort.sequence_neighbours(_t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return out.select("event_id", "seq_index", "seq_length", "prev_item", "next_item", *_r("seq_position"))


@query("SELECT page_id, 'p' || (page_id % 7) || '__' || replace(replace('a/b c', '/', '__'), ' ', '_') || '__' || substr(sha256(url), 1, 20) AS token, string_split(url, '/')[-1] AS path_key FROM pages")
def stable_tokens(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", item_token(F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string")), F.lit("a/b c"), F.col("url")).alias("token"), stable_path(F.col("url")).alias("path_key"))


@query("""
WITH n AS (SELECT p_partkey, 'img' || (p_partkey % 100) || 'A' || p_size AS name FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY lpad((p_partkey % 100)::VARCHAR, 20, '0'), lpad(p_size::VARCHAR, 20, '0'), p_partkey) AS turn
FROM part JOIN n USING (p_partkey)""")
def natural_order(spark, d):
    named = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("img"), (F.col("p_partkey") % 100).cast("string"), F.lit("A"), F.col("p_size").cast("string")).alias("name"))
    return cohort.natural_order(named, "name", "p_partkey").select("p_partkey", F.col("turn").cast("int").alias("turn"))


@query("""
WITH s AS (SELECT DISTINCT user_id, user_id % 2 AS label FROM events)
SELECT user_id, label, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42|segmentation-fold|' || label || '|' || user_id), user_id) - 1) % 5)::INT AS fold FROM s""")
def stratified_hash_folds(spark, d):
    return cohort.hash_folds(_t(spark, d, "events").select("user_id", (F.col("user_id") % 2).alias("label")), "user_id", "label")


@query("""
WITH s AS (SELECT DISTINCT user_id, user_id % 3 AS grp FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sha256('42|validation|' || grp || '|' || user_id), user_id) AS t, count(*) OVER (PARTITION BY grp) AS n FROM s)
SELECT user_id, grp, t <= greatest(1, least(round_even(n * 0.2, 0)::BIGINT, n - 1)) AS validation FROM r""")
def validation_pick(spark, d):
    return cohort.validation_pick(_t(spark, d, "events").select("user_id", (F.col("user_id") % 3).alias("grp")), "user_id", "grp")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def leak_guard(spark, d):
    e = _t(spark, d, "events")
    return cohort.leaked(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id")


@query("SELECT least(5, min(n))::INT AS splits FROM (SELECT user_id % 2 AS label, count(DISTINCT user_id) AS n FROM events GROUP BY 1)")
def split_count(spark, d):
    s = _t(spark, d, "events").select("user_id", (F.col("user_id") % 2).alias("label")).distinct()
    return cohort.split_count(s, "label", 5)


@query("""
WITH e AS (SELECT event_id, user_id, event_type, (event_id % 6) AS cluster, (user_id % 2) AS present FROM events),
a AS (SELECT user_id, event_type, cluster, count(*) AS dup FROM e GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS cl FROM a GROUP BY ALL), c AS (SELECT user_id, count(*) AS se FROM b GROUP BY ALL),
r AS (SELECT event_id, present, 1.0 / (se * cl * dup)::DOUBLE AS raw FROM e JOIN a USING (user_id, event_type, cluster) JOIN b USING (user_id, event_type) JOIN c USING (user_id))
SELECT event_id, round(raw / sum(raw) OVER (PARTITION BY present) * CASE WHEN present = 1 THEN 0.7 ELSE 0.3 END, 9) AS weight FROM r""")
def sampling_weights(spark, d):
    items = _t(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 6).alias("cluster"), (F.col("user_id") % 2).alias("present"))
    return cohort.sampling_weights(items, "user_id", "event_type", "cluster", "present").select("event_id", *_r("weight", digits=9))


@query("""
WITH e AS (SELECT *, event_id % 5 / 10.0::DOUBLE AS u, (event_id % 3 > 0)::INT AS v, value / 500 AS peak FROM events), p AS (SELECT *, CASE WHEN u > 0 THEN -u ELSE v END AS pr FROM e),
a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY pr, peak, sha256('42|' || event_id), event_id) AS t FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_type) AS turn FROM a WHERE t <= 12)
SELECT user_id, event_type, event_id, turn FROM b WHERE turn <= 12 ORDER BY turn, user_id LIMIT 300""")
def review_round_robin(spark, d):
    e = _t(spark, d, "events").withColumn("peak", F.col("value") / 500)
    e = e.withColumn("priority", cohort.review_priority(F.col("event_id") % 5 / 10.0, (F.col("event_id") % 3 > 0).cast("int")))
    return cohort.round_robin(e, "user_id", "event_type", "event_id", 12, 300, first_by=["priority", "peak"])


# audits ----------------------------------------------------------------------------------

_QUALITY = """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 41 <> 0 THEN value END AS value, CASE WHEN event_id % 37 <> 0 THEN value / 1000.0 END AS noise, CASE WHEN event_id % 43 <> 0 THEN value / 5.0 END AS spread FROM events),
t AS (SELECT user_id, CASE WHEN count(value) >= 5 THEN greatest(4.0, quantile_cont(value, 0.03)) ELSE 4.0 END AS blur_threshold,
  CASE WHEN count(noise) >= 5 THEN least(0.30, quantile_cont(noise, 0.97)) ELSE 0.30 END AS noise_threshold, count(*) AS n FROM e GROUP BY 1)"""


def _slices(spark, d):
    e = _t(spark, d, "events")
    # not a number in some rows, none in others
    but = lambda n, x, odd: F.when(F.col("event_id") % n != 0, x).otherwise(F.lit(odd).cast("double"))
    return e.select("event_id", "user_id", but(41, F.col("value"), "nan").alias("value"), but(37, F.col("value") / 1000.0, None).alias("noise"), but(43, F.col("value") / 5.0, "inf").alias("spread"))


@query(_QUALITY + " SELECT user_id, round(blur_threshold, 9) AS blur_threshold, round(noise_threshold, 9) AS noise_threshold, n FROM t")
def quality_audit_thresholds(spark, d):
    return audit.quality_thresholds(_slices(spark, d), "user_id", "value", "noise").select("user_id", *_r("blur_threshold", "noise_threshold"), "n")


@query(_QUALITY + """ SELECT event_id, concat_ws(';', CASE WHEN spread IS NULL OR spread < 12 THEN 'low_dynamic_range' END, CASE WHEN value IS NULL OR value < blur_threshold THEN 'blurred' END, CASE WHEN noise IS NULL OR noise > noise_threshold THEN 'noisy' END) AS quality_reason,
  coalesce(spread >= 12 AND value >= blur_threshold AND noise <= noise_threshold, false)::INT AS quality_valid FROM e JOIN t USING (user_id)""")
def quality_audit(spark, d):
    return audit.quality_audit(_slices(spark, d), "user_id", "value", "noise", "spread").select("event_id", "quality_reason", "quality_valid")


_AUDIT = """
WITH i AS (SELECT doc_id, source, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS quality_valid, CASE WHEN n_chars < 300 THEN 'blurred' END AS quality_reason FROM documents WHERE doc_id % 11 <> 0),
m AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'UNUSABLE' WHEN doc_id % 5 = 0 THEN '' WHEN quality = 1 THEN 'HEART_PRESENT' ELSE 'NO_HEART_VISIBLE' END AS told, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 / 7.1::DOUBLE END AS area, doc_id % 3 > 0 OR doc_id % 2 = 0 AS found FROM labels),
j AS (SELECT m.*, i.doc_id AS item, source, quality_valid, quality_reason, CASE WHEN NOT found THEN 'missing' WHEN area IS NULL THEN 'unreadable' WHEN area < 0.0005 THEN 'empty_or_nearly_empty' WHEN area > 0.98 THEN 'nearly_full' ELSE '' END AS mask FROM m LEFT JOIN i USING (doc_id)),
k AS (SELECT *, CASE WHEN item IS NULL OR told <> '' THEN told WHEN mask = '' THEN 'HEART_PRESENT' ELSE 'UNLABELED_EMPTY' END AS target FROM j),
r AS (SELECT *, CASE WHEN item IS NULL THEN 'token_absent_from_dataset' ELSE concat_ws(';', nullif(CASE target WHEN 'HEART_PRESENT' THEN mask
  WHEN 'NO_HEART_VISIBLE' THEN CASE WHEN found AND area IS NULL THEN 'unreadable_negative_mask' WHEN area >= 0.0005 THEN 'no_heart_annotation_has_nonempty_mask' ELSE '' END
  WHEN 'UNUSABLE' THEN 'explicitly_unusable' ELSE 'empty_mask_without_explicit_no_heart_label' END, ''), CASE WHEN target <> 'UNUSABLE' AND quality_valid <> 1 THEN quality_reason END) END AS reason FROM k),
a AS (SELECT doc_id, target, quality_valid, CASE WHEN item IS NULL THEN 'REJECTED' WHEN target = 'UNUSABLE' THEN 'EXCLUDED' WHEN reason = '' THEN 'ACCEPTED' ELSE 'REJECTED' END AS status, reason, source FROM r)"""


def _audited(spark, d):
    good = F.col("n_chars") >= 300
    items = _t(spark, d, "documents").where("doc_id % 11 <> 0").select("doc_id", good.cast("int").alias("quality_valid"), F.when(~good, "blurred").alias("quality_reason"))
    told = F.expr("CASE WHEN toxic = 1 THEN ' unusable ' WHEN doc_id % 5 = 0 THEN 'none' WHEN quality = 1 THEN 'heart_present' ELSE 'no_heart_visible' END")
    marks = _t(spark, d, "labels").select("doc_id", told.alias("target_type"), F.expr("CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 / 7.1D END").alias("mask_area"), F.expr("doc_id % 3 > 0 OR doc_id % 2 = 0").alias("mask_found"))
    return audit.target_audit(items, marks, "doc_id")


def _audited_folds(spark, d):
    return _audited(spark, d).join(_t(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 5).cast("int").alias("fold")), "doc_id")


@query(_AUDIT + ", f AS (SELECT a.*, doc_id % 5 AS fold FROM a) SELECT " + ", ".join(f"count(*) FILTER (status = 'ACCEPTED' AND fold = {k} AND target = '{t}') AS fold_{k}_{n}" for k in range(5) for t, n in (("HEART_PRESENT", "present"), ("NO_HEART_VISIBLE", "absent"))) + " FROM f")
def fold_counters(spark, d):
    return audit.fold_counters(_audited_folds(spark, d), "fold")


@query(_AUDIT + " SELECT count(*) AS positives, count(DISTINCT doc_id % 5) AS folds, count(DISTINCT source) AS subjects FROM a WHERE status = 'ACCEPTED' AND target = 'HEART_PRESENT'")
def integrity_gates(spark, d):
    return audit.integrity(_audited_folds(spark, d), "source", "fold")


@query(_AUDIT + " SELECT doc_id, target, quality_valid, status, reason FROM a")
def target_audit(spark, d):
    return _audited(spark, d).drop("mask_area")


@query(_AUDIT + " SELECT target, count(*) AS n, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (status = 'EXCLUDED') AS excluded FROM a GROUP BY 1")
def audit_counters(spark, d):
    return audit.audit_counters(_audited(spark, d), "target")


@query(_AUDIT + ", u AS (SELECT unnest(string_split(reason, ';')) AS reason FROM a WHERE reason <> '') SELECT reason, count(*) AS n FROM u GROUP BY 1")
def reason_counts(spark, d):
    return audit.reason_counts(_audited(spark, d))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, strftime(max(ts), '%Y-%m-%d') AS day FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'logout'")
def latest_state(spark, d):
    e = _t(spark, d, "events").withColumn("t", F.struct("ts", "event_id"))
    return audit.latest(e, "user_id", "t", "event_type", "logout").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0")
def keyed_upsert(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return audit.upsert(c, c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("SELECT count(*) AS masks, count(*) FILTER (c.c_custkey IS NULL) AS absent, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS already_labelled FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey")
def import_counters(spark, d):
    c = _t(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return audit.import_counters(_t(spark, d, "orders"), c.where("c_acctbal > 0"), c.where("c_nationkey = 3"), "o_custkey")


_REVIEW = """
WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS item, l_suppkey AS subject, l_returnflag AS series, CASE WHEN l_linestatus = 'F' AND l_orderkey % 4 = 0 THEN 'HEART_PRESENT' ELSE '' END AS target, (l_quantity > 10)::INT AS quality_valid, (l_returnflag <> 'R')::INT AS valid,
  l_orderkey % 7 > 0 AS available, l_tax * 3 AS uncertainty, 0.5 + (l_discount - 0.05) * 10 AS presence, l_quantity / 50 AS peak, CASE l_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'empty_or_nearly_empty' ELSE 'missing' END AS mask_reason,
  CASE WHEN l_partkey % 13 > 0 THEN ('0x' || substr(sha256(l_orderkey::VARCHAR), 1, 15))::BIGINT END AS phash FROM lineitem),
seen AS (SELECT o_orderkey * 10 + 1 AS item FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT * FROM q WHERE target = '' AND available AND item NOT IN (SELECT item FROM seen)),
s AS ({S}),
n AS (SELECT greatest(10, ceil(300.0 / greatest(1, count(DISTINCT subject))))::INT AS most FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY subject, series ORDER BY pr, coalesce(peak, 0), sha256('42|' || item), item) AS k FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY k, series) AS turn FROM t, n WHERE k <= most)
SELECT item, subject, series, row_number() OVER (ORDER BY turn, subject) AS queue_position FROM u WHERE turn <= most ORDER BY turn, subject LIMIT 300"""


def _review_rows(spark, d):
    return _t(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS item", "l_suppkey AS subject", "l_returnflag AS series", "CASE WHEN l_linestatus = 'F' AND l_orderkey % 4 = 0 THEN 'HEART_PRESENT' ELSE '' END AS target", "int(l_quantity > 10) AS quality_valid", "int(l_returnflag <> 'R') AS valid",
        "l_orderkey % 7 > 0 AS available", "l_tax * 3 AS uncertainty", "0.5 + (l_discount - 0.05) * 10 AS presence", "0.5D AS presence_threshold", "l_quantity / 50 AS peak", "CASE l_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'empty_or_nearly_empty' ELSE 'missing' END AS mask_reason",
        "CASE WHEN l_partkey % 13 > 0 THEN bigint(conv(substr(sha2(string(l_orderkey), 256), 1, 15), 16, 10)) END AS phash",
    )


def _review(spark, d, scope):
    seen = _t(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10 + 1).alias("item"))
    return audit.review_queue(_review_rows(spark, d), seen, scope, "subject", "series", "item").select("item", "subject", "series", "queue_position")


@query(_REVIEW.replace("{S}", "SELECT *, peak AS pr FROM c WHERE valid = 0"))
def review_invalid(spark, d):
    return _review(spark, d, "invalid")


@query(_REVIEW.replace("{S}", "SELECT *, -uncertainty AS pr FROM c WHERE quality_valid = 1 AND (uncertainty >= 0.18 OR abs(presence - 0.5) <= 0.15 OR valid <> 1)"))
def review_uncertain(spark, d):
    return _review(spark, d, "uncertain")


@query(_REVIEW.replace("{S}", "SELECT *, -uncertainty AS pr FROM c WHERE mask_reason = 'empty_or_nearly_empty'"))
def review_empty(spark, d):
    return _review(spark, d, "empty")


@query("WITH" + _REVIEW.split("WITH", 1)[1].split(",\ns AS")[0] + " SELECT item, subject, series, row_number() OVER (ORDER BY subject, series, item) AS queue_position FROM c WHERE mask_reason <> 'missing' ORDER BY subject, series, item LIMIT 300")
def review_manual(spark, d):
    return _review(spark, d, "manual")


_FAR = "a AS (SELECT DISTINCT phash FROM q WHERE (target <> '' OR mask_reason <> 'missing') AND phash IS NOT NULL), near AS (SELECT DISTINCT c.phash FROM (SELECT DISTINCT phash FROM q WHERE phash IS NOT NULL) c JOIN a ON bit_count(xor(c.phash::BIGINT, a.phash::BIGINT)) <= 6)"


@query(_REVIEW.replace("s AS ({S})", _FAR + ", s AS (SELECT *, -uncertainty AS pr FROM c WHERE mask_reason = 'missing' AND quality_valid = 1 AND phash IS NOT NULL AND phash NOT IN (SELECT phash FROM near))").replace("greatest(10, ceil(300.0 / greatest(1, count(DISTINCT subject))))::INT AS most FROM s", "10 AS most"))
def review_novel(spark, d):
    return _review(spark, d, "novel")


@query("WITH" + _REVIEW.split("WITH", 1)[1].split(", c AS")[0] + ", " + _FAR + """, r AS (SELECT CASE WHEN mask_reason <> 'missing' THEN 'already_annotated' WHEN item IN (SELECT item FROM seen) THEN 'already_reviewed_this_round' WHEN quality_valid <> 1 THEN 'quality_invalid'
  WHEN NOT available THEN 'missing_attention_mask' WHEN phash IS NULL THEN 'missing_phash' WHEN phash IN (SELECT phash FROM near) THEN 'similar_to_annotated' END AS reason FROM q WHERE target = '') SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def review_novel_exclusions(spark, d):
    seen = _t(spark, d, "orders").where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10 + 1).alias("item"))
    return audit.novel_exclusions(_review_rows(spark, d), seen, "item")


# robust statistics, sequences -------------------------------------------------------------

_MAD = """
WITH c AS (SELECT l_suppkey, median(l_extendedprice) AS centre FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, any_value(centre) AS centre, greatest(1e-3, 1.4826 * median(abs(l_extendedprice - centre))) AS scale, count(*) AS n FROM lineitem JOIN c USING (l_suppkey) GROUP BY 1)"""


@query(_MAD + " SELECT l_suppkey, round(centre, 4) AS centre, round(scale, 4) AS scale, n FROM s")
def median_mad(spark, d):
    return robust.median_mad(_t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice").select("l_suppkey", *_r("centre", "scale", digits=4), "n")


@query(_MAD + " SELECT l_orderkey, l_linenumber, round(greatest(-5, least(5, (l_extendedprice - centre) / scale)), 9) AS z FROM lineitem JOIN s USING (l_suppkey)")
def median_mad_standardise(spark, d):
    return robust.standardise(_t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", *_r("z"))


@query("""
WITH c AS (SELECT event_type, median(value) AS m, quantile_cont(value, 0.9) AS q FROM events GROUP BY 1),
s AS (SELECT event_type, any_value(m) AS m, any_value(q) AS q, median(abs(value - m)) AS mad FROM events JOIN c USING (event_type) GROUP BY 1)
SELECT event_type, round(greatest(m, least(m + 2.5 * 1.4826 * mad, q)), 9) AS caliper FROM s""")
def robust_caliper(spark, d):
    return robust.caliper(_t(spark, d, "events"), ["event_type"], "value").select("event_type", *_r("caliper"))


_PAIR_CHANGE = "CASE WHEN {o} IS NULL THEN NULL WHEN p <> {o}.p THEN 1.0 WHEN p = 0 THEN 0.0 ELSE 0.55 * least(1, abs(a - {o}.a) / greatest(0.01, 0.5 * (a + {o}.a))) + 0.45 * coalesce(least(1, sqrt(pow(x - {o}.x, 2) + pow(y - {o}.y, 2)) / 0.25), 1) END"


@query(f"""
WITH e AS (SELECT event_id, user_id, ts, (value > 20)::INT AS p, value / 500 AS a, CASE WHEN event_id % 9 > 0 THEN value / 400 END AS x, (event_id % 10) / 10.0::DOUBLE AS y, (event_id % 7) / 10.0::DOUBLE AS base FROM events),
n AS (SELECT *, lag({{'p': p, 'a': a, 'x': x, 'y': y}}) OVER w AS b, lead({{'p': p, 'a': a, 'x': x, 'y': y}}) OVER w AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT event_id, base, {_PAIR_CHANGE.format(o='b')} AS l, {_PAIR_CHANGE.format(o='f')} AS r FROM n)
SELECT event_id, round(coalesce((l + r) / 2, l, r, 0), 9) AS inconsistency, round(least(1, base + 0.2 * coalesce((l + r) / 2, l, r, 0)), 9) AS uncertainty FROM s""")
def sequence_inconsistency(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") > 20).cast("int").alias("p"), (F.col("value") / 500).alias("a"), F.when(F.col("event_id") % 9 > 0, F.col("value") / 400).alias("x"), ((F.col("event_id") % 10) / 10.0).alias("y"), ((F.col("event_id") % 7) / 10.0).alias("base"))
    return robust.sequence_inconsistency(e, ["user_id"], ["ts", "event_id"], "p", "a", "x", "y", "base").select("event_id", *_r("inconsistency", "uncertainty"))


@query("SELECT event_id, (value::INT // 3600) || 'h ' || lpad((value::INT % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((value::INT % 60)::VARCHAR, 2, '0') || 's' AS told, CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE value END AS cleaned FROM (SELECT event_id, floor(value * 20) AS value FROM events)")
def clean_values(spark, d):
    e = _t(spark, d, "events").select("event_id", F.floor(F.col("value") * 20).cast("double").alias("value"))
    raw = F.when(F.col("event_id") % 6 == 0, "nan").when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("value").cast("string"))
    return e.select("event_id", elapsed(F.col("value")).alias("told"), clean_double(raw, -1.0).alias("cleaned"))


# neighbours, matching ----------------------------------------------------------------------


@query("""
WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings), s AS (SELECT vec_id, array_to_string(b, '') AS b FROM h)
SELECT vec_id FROM s a WHERE vec_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM s k WHERE k.vec_id % 10 = 0 AND hamming(a.b, k.b) <= 6)""")
def hamming_anti_join(spark, d):
    h = _t(spark, d, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("h"))
    return neighbours.hamming_anti(h.where("vec_id % 10 <> 0"), h.where("vec_id % 10 = 0"), "h").select("vec_id")


_EDGES = """
WITH s AS (SELECT vec_id, vec_id % 3 AS family, label % 2 AS y, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.family, a.vec_id AS sick, b.vec_id AS normal, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS distance FROM s a JOIN s b ON a.family = b.family AND a.y = 1 AND b.y = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY family, sick ORDER BY distance, normal) AS rs, row_number() OVER (PARTITION BY family, normal ORDER BY distance, sick) AS rn FROM p),
e AS (SELECT family, sick, normal, distance, CASE WHEN rs <= 12 THEN rs END AS rank_from_sick, CASE WHEN rn <= 12 THEN rn END AS rank_from_normal FROM r WHERE rs <= 12 OR rn <= 12)"""


def _edges(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("family"), (F.col("label") % 2).alias("y"), "embedding")
    return neighbours.mutual_edges(e, "family", "vec_id", "y", "embedding")


@query(_EDGES + """ SELECT family, sick, normal, round(distance, 9) AS distance, rank_from_sick, rank_from_normal, (rank_from_sick IS NOT NULL AND rank_from_normal IS NOT NULL)::INT AS reciprocal,
  (coalesce(rank_from_sick, 99) <= 5 AND coalesce(rank_from_normal, 99) <= 5)::INT AS is_core FROM e""")
def mutual_knn_edges(spark, d):
    return _edges(spark, d).select("family", "sick", "normal", *_r("distance"), "rank_from_sick", "rank_from_normal", "reciprocal", "is_core")


@query("""SELECT user_id % 7 AS family, count(*) FILTER (user_id % 2 = 0) AS items_0, count(*) FILTER (user_id % 2 = 1) AS items_1, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS subjects_0, count(DISTINCT user_id) FILTER (user_id % 2 = 1) AS subjects_1,
  (least(items_0, items_1) >= 12 AND least(subjects_0, subjects_1) >= 2)::INT AS shared FROM events GROUP BY 1""")
def shared_families(spark, d):
    e = _t(spark, d, "events").select((F.col("user_id") % 7).alias("family"), (F.col("user_id") % 2).alias("y"), "user_id")
    return matching.shared_families(e, "family", "y", "user_id")


@query("""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (user_id % 2 = 0) AS n0, count(*) FILTER (user_id % 2 = 1) AS n1, count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS s0, count(DISTINCT user_id) FILTER (user_id % 2 = 1) AS s1 FROM events), t AS (SELECT *, greatest(1, least(round_even(n * 0.5 / 2, 0)::BIGINT, n0, n1)) AS target FROM c)
SELECT target, greatest(60, ceil(target / s0 * 1.7))::BIGINT AS cap_0, greatest(60, ceil(target / s1 * 1.7))::BIGINT AS cap_1 FROM t""")
def match_target(spark, d):
    return matching.match_target(_t(spark, d, "events").select("user_id", (F.col("user_id") % 2).alias("y")), "y", "user_id")


@query("""
WITH c AS (SELECT event_type AS family, count(*) AS capacity FROM events GROUP BY 1), s AS (SELECT *, least(333, sum(capacity) OVER ()) * capacity::DOUBLE / sum(capacity) OVER () AS share FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, capacity DESC, family) AS turn, round(333 - sum(floor(share)) OVER ()) AS rest FROM s)
SELECT family, capacity, least(capacity, floor(share) + (turn <= rest)::INT)::BIGINT AS quota FROM r""")
def extension_allocation(spark, d):
    return matching.allocate(_t(spark, d, "events").groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("capacity")), 333)


def _match_edges(spark, d):
    part = _t(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("item"), F.col("label").cast("string").alias("subject"), (F.col("vec_id") % 40).cast("string").alias("sequence"))
    side = lambda name: part.select(F.col("item").alias(name), F.col("subject").alias(f"{name}_subject"), F.col("sequence").alias(f"{name}_sequence"))
    return _edges(spark, d).join(side("sick"), "sick").join(side("normal"), "normal")


def _match_items(spark, d):
    """Embeddings in the role of images: their signs as hash, four of their numbers as geometry."""
    e = _t(spark, d, "embeddings")
    n = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return e.select(
        F.col("vec_id").cast("long").alias("item"), F.col("label").cast("string").alias("subject"), F.concat_ws("/", "label", F.col("vec_id") % 4).alias("sequence"), (F.col("label") % 2).alias("label"), F.when(F.col("vec_id") % 31 > 0, sign_bits(F.col("embedding"))).alias("hash"),
        (F.col("vec_id") % 17 > 0).cast("int").alias("quality_valid"), (F.col("vec_id") % 19 > 0).cast("int").alias("attention_valid"), F.lit(1).alias("heart_present"), (F.abs(n(0)) / 2 + 0.002).alias("area"), n(1).alias("centroid_x"), n(2).alias("centroid_y"), F.abs(n(3)).alias("boundary"),
        ((F.col("vec_id") % 10) / 9).alias("position"), (F.abs(n(4)) * 100).alias("sharpness"), F.abs(n(5)).alias("noise"), (F.abs(n(6)) * 200).alias("spread"), (F.col("vec_id") % 23 > 0).alias("has_mask"), (F.col("vec_id") % 3).cast("long").alias("family"),
    )


def _scratch(name, df):
    """Tables of a matching that are used more than once."""
    return kept(df)


@query()
def core_matching(spark, d):
    edges = kept(_match_edges(spark, d))
    return matching.pair_ids(matching.core_matching(edges, matching.calipers(edges))).select("family", "sick", "normal", *_r("distance"), "stage", "pair_id")


@query()
def cross_class_matching(spark, d):
    manifest, _, _ = matching.build_matching(_match_items(spark, d), _scratch)
    return manifest.select("item", "subject", "label", "family", "selected", "core", "pair_id", "partner", *_r("distance"), "exclusion_reason")


@query()
def extended_matching(spark, d):
    _, pairs, _ = matching.build_matching(_match_items(spark, d), _scratch)
    return pairs.select("family", "sick", "normal", *_r("distance"), "stage", "pair_id")


_ELIGIBLE = """WITH e AS (SELECT vec_id, quality, attention, area, hash, mask, concat_ws(';', CASE WHEN quality <> 1 THEN 'quality_invalid' END, CASE WHEN attention <> 1 THEN 'attention_invalid' END, CASE WHEN area < 0.003 THEN 'attention_area_too_small' END, CASE WHEN NOT hash THEN 'missing_phash' END, CASE WHEN NOT mask THEN 'missing_attention_mask' END) AS exclusion_reason
  FROM (SELECT vec_id, (vec_id % 17 > 0)::INT AS quality, (vec_id % 19 > 0)::INT AS attention, abs(embedding[1]::DOUBLE) / 2 + 0.002 AS area, vec_id % 31 > 0 AS hash, vec_id % 23 > 0 AS mask FROM embeddings))"""


@query(_ELIGIBLE + " SELECT vec_id AS item, exclusion_reason FROM e")
def matching_eligibility(spark, d):
    return matching.eligibility(_match_items(spark, d)).select("item", "exclusion_reason")


@query("""
WITH v AS (SELECT vec_id AS item, [abs(embedding[1]::DOUBLE) / 2 + 0.002, embedding[2]::DOUBLE, embedding[3]::DOUBLE, abs(embedding[4]::DOUBLE), (vec_id % 10) / 9.0::DOUBLE, ln(1 + abs(embedding[5]::DOUBLE) * 100), abs(embedding[6]::DOUBLE), abs(embedding[7]::DOUBLE) * 200] AS x FROM embeddings),
u AS (SELECT item, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM v), m AS (SELECT k, median(x) AS m FROM u GROUP BY 1), s AS (SELECT k, any_value(m) AS m, greatest(1e-3, 1.4826 * median(abs(x - m))) AS s FROM u JOIN m USING (k) GROUP BY 1)
SELECT item, (k - 1)::INT AS pos, round(greatest(-5, least(5, (x - m) / s)) * sqrt(CASE WHEN k <= 4 THEN 0.25 / 4 WHEN k = 5 THEN 0.15 ELSE 0.15 / 3 END), 9) AS value FROM u JOIN s USING (k)""")
def matching_descriptor(spark, d):
    items = _match_items(spark, d).withColumn("log_sharpness", F.log1p("sharpness"))
    return matching.descriptor(items).select("item", F.posexplode("descriptor").alias("pos", "value")).select("item", "pos", *_r("value"))


@query(_EDGES + """, g AS (SELECT e.* FROM e JOIN embeddings s ON s.vec_id = sick JOIN embeddings n ON n.vec_id = normal WHERE abs(sick % 10 - normal % 10) / 9.0::DOUBLE <= 0.25 AND abs(abs(s.embedding[1]::DOUBLE) - abs(n.embedding[1]::DOUBLE)) <= 0.20)
SELECT family, sick, normal, round(distance, 9) AS distance FROM g""")
def gated_edges(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("family"), (F.col("label") % 2).alias("y"), "embedding", ((F.col("vec_id") % 10) / 9).alias("position"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("area"))
    return neighbours.mutual_edges(e, "family", "vec_id", "y", "embedding", position="position", area="area").select("family", "sick", "normal", *_r("distance"))


_CALIPER = "c{n} AS (SELECT family, median(distance) AS m, quantile_cont(distance, {q}) AS q FROM e {w} GROUP BY 1), k{n} AS (SELECT family, any_value(m) AS m, any_value(q) AS q, median(abs(distance - m)) AS mad FROM e JOIN c{n} USING (family) {w} GROUP BY 1), l{n} AS (SELECT family, greatest(m, least(m + {k} * greatest(1e-9, 1.4826 * mad), q)) AS l FROM k{n})"


@query(_EDGES + ", " + _CALIPER.format(n=0, q=0.9, k=2.5, w="WHERE rank_from_sick <= 5 AND rank_from_normal <= 5") + ", " + _CALIPER.format(n=1, q=0.97, k=3.5, w="") + " SELECT l1.family, round(l0.l, 9) AS core_caliper, round(CASE WHEN l0.l IS NULL THEN l1.l ELSE least(greatest(l1.l, l0.l), 1.18 * l0.l) END, 9) AS extended_caliper FROM l1 LEFT JOIN l0 ON l0.family = l1.family")
def match_calipers(spark, d):
    return matching.calipers(_edges(spark, d)).select("family", *_r("core_caliper", "extended_caliper"))


# pooling, cohorts ---------------------------------------------------------------------------

_POOL = """
WITH u AS (SELECT label, vec_id % 4 AS series, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), i AS (SELECT label, series, pos, avg(x) AS x FROM u GROUP BY ALL)"""


@query(_POOL + " SELECT label, pos::INT AS pos, round(avg(x), 9) AS value FROM i GROUP BY label, pos")
def hierarchical_pooling(spark, d):
    e = _t(spark, d, "embeddings").withColumn("series", F.col("vec_id") % 4)
    return pooling.hierarchical_mean(e, [], "label", "series", "embedding").select("label", "pos", *_r("value"))


_MODES = "WITH m AS (SELECT user_id, event_type, unnest(list_filter([CASE WHEN value >= 0 THEN 'all' END, CASE WHEN value > 50 THEN 'attention' END, CASE WHEN value > 50 AND event_id % 3 = 0 THEN 'matched' END], lambda x: x IS NOT NULL)) AS mode FROM events)"


def _members(spark, d):
    modes = {"all": F.col("value") >= 0, "attention": F.col("value") > 50, "matched": (F.col("value") > 50) & (F.col("event_id") % 3 == 0)}
    return pooling.mode_membership(_t(spark, d, "events"), modes)


@query(_MODES + " SELECT mode, count(DISTINCT user_id) AS subjects, count(*) AS items, count(DISTINCT (user_id, event_type)) AS series FROM m GROUP BY 1")
def mode_cohort_counts(spark, d):
    return pooling.mode_counts(_members(spark, d), "user_id", "event_type")


@query(_MODES + " SELECT DISTINCT user_id FROM m WHERE mode = 'all' AND user_id NOT IN (SELECT user_id FROM m WHERE mode = 'matched')")
def same_cohort_check(spark, d):
    return pooling.cohort_mismatch(_members(spark, d), "user_id", "all", "matched")


# metrics ------------------------------------------------------------------------------------

_SCORED = "WITH s AS (SELECT lang, source, quality AS y, least(1, n_chars / 8000.0::DOUBLE) AS score FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, score, sum((y = 1)::INT)::DOUBLE AS pos, sum((y = 0)::INT)::DOUBLE AS neg FROM s GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER p AS tp, sum(neg) OVER p AS tn FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY lang))"


def _scored(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("score"))
    return docs.join(_t(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query(_SCORED + " SELECT lang, round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM c GROUP BY 1")
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), ["lang"], "y", "score").select("lang", *_r("auc"))


@query(_SCORED + " SELECT lang, round(sum(pos * cp / (cp + cn)) / sum(pos), 9) AS average_precision FROM c GROUP BY 1")
def average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d), ["lang"], "y", "score").select("lang", *_r("average_precision"))


@query(_SCORED + ", j AS (SELECT lang, score, round(cp / tp - cn / tn, 12) AS j FROM c) SELECT lang, round(arg_max(score, (j, score)), 9) AS threshold, round(max(j), 9) AS youden FROM j GROUP BY 1")
def youden_threshold(spark, d):
    return metrics.youden_threshold(_scored(spark, d), ["lang"], "y", "score").select("lang", *_r("threshold", "youden"))


@query(_SCORED + """ SELECT lang, round(avg(pow(score - y, 2)), 9) AS brier, round(avg(((score >= 0.2)::INT = y)::INT), 9) AS accuracy,
  round(count(*) FILTER (score >= 0.2 AND y = 1) / greatest(1, count(*) FILTER (y = 1)), 9) AS sensitivity, round(count(*) FILTER (score < 0.2 AND y = 0) / greatest(1, count(*) FILTER (y = 0)), 9) AS specificity FROM s GROUP BY 1""")
def confusion_metrics(spark, d):
    return metrics.confusion_metrics(_scored(spark, d), ["lang"], "y", "score", 0.2).select("lang", *_r("brier", "accuracy", "sensitivity", "specificity"))


@query(_SCORED + ", r AS (SELECT lang, y, avg(((score >= 0.2)::INT = y)::INT) AS r FROM s GROUP BY ALL) SELECT lang, round(avg(r), 9) AS balanced_accuracy FROM r GROUP BY 1")
def balanced_accuracy(spark, d):
    s = _scored(spark, d).withColumn("hat", (F.col("score") >= 0.2).cast("int"))
    return metrics.balanced_accuracy(s, ["lang"], "y", "hat").select("lang", *_r("balanced_accuracy"))


@query(_SCORED + ", r AS (SELECT lang, source, avg(score) AS m FROM s GROUP BY ALL) SELECT lang, round(avg(m), 9) AS mean, count(*) AS subjects FROM r GROUP BY 1")
def patient_balanced_mean(spark, d):
    return metrics.subject_balanced_mean(_scored(spark, d), ["lang"], "source", "score").select("lang", *_r("mean"), "subjects")


_OVERLAP = "SELECT l_orderkey, sum((l_tax > 0.04 AND l_discount > 0.04)::INT) AS tp, sum((l_tax > 0.04 AND l_discount <= 0.04)::INT) AS fp, sum((l_tax <= 0.04 AND l_discount > 0.04)::INT) AS fn FROM lineitem GROUP BY 1"


@query(f"""WITH c AS ({_OVERLAP}) SELECT l_orderkey, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS dice, round(CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END, 9) AS iou,
  round(CASE WHEN tp + fp = 0 THEN (fn = 0)::INT ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 9) AS recall FROM c""")
def overlap_metrics(spark, d):
    a, b = F.col("l_tax") > 0.04, F.col("l_discount") > 0.04
    c = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"))
    return c.select("l_orderkey", *[F.round(v, 9).alias(k) for k, v in metrics.overlap(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query(_SCORED + """, t AS (SELECT unnest([0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75]::DOUBLE[]) AS threshold), x AS (SELECT threshold, source, y, CASE WHEN y = 1 THEN (2 * greatest(0, 1 - abs(score - threshold)) + 1e-6) / (1 + score + 1e-6) ELSE 1 - least(1, greatest(0, score - threshold) / 0.10) END AS q, (score >= threshold)::INT AS valid FROM s, t),
a AS (SELECT threshold, source, avg(q) AS q, count(*) FILTER (y = 1 AND valid = 0) AS bad, count(*) FILTER (y = 1) AS n FROM x GROUP BY ALL), v AS (SELECT threshold, avg(q) AS mean_quality, sum(bad) / greatest(1, sum(n))::DOUBLE AS invalid_rate FROM a GROUP BY 1), z AS (SELECT *, mean_quality - 0.2 * invalid_rate AS score FROM v)
SELECT arg_max(threshold, (round(score, 12), -abs(threshold - 0.5), -threshold)) AS threshold, round(arg_max(score, (round(score, 12), -abs(threshold - 0.5), -threshold)), 9) AS score, round(arg_max(mean_quality, (round(score, 12), -abs(threshold - 0.5), -threshold)), 9) AS mean_quality, round(arg_max(invalid_rate, (round(score, 12), -abs(threshold - 0.5), -threshold)), 9) AS invalid_rate FROM z""")
def threshold_grid_search(spark, d):
    s = _scored(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, metrics.THRESHOLDS))))
    apart = F.greatest(F.lit(0.0), F.col("score") - F.col("threshold"))
    tried = s.withColumn("q", metrics.target_quality(F.col("y"), F.greatest(F.lit(0.0), 1 - F.abs(F.col("score") - F.col("threshold"))), 1 + F.col("score"), apart)).withColumn("valid", (F.col("score") >= F.col("threshold")).cast("int"))
    return metrics.grid_search(tried, "threshold", "source", "y", "q", "valid").select("threshold", *_r("score", "mean_quality", "invalid_rate"))


@query(_SCORED + """, t AS (SELECT unnest([0.5, 0.1, 0.2, 0.3, 0.4]::DOUBLE[]) AS threshold), h AS (SELECT threshold, y, avg(((score >= threshold)::INT = y)::INT) AS r FROM s, t GROUP BY ALL), b AS (SELECT threshold, avg(r) AS balanced_accuracy FROM h GROUP BY 1)
SELECT arg_max(threshold, (round(balanced_accuracy, 12), -abs(threshold - 0.5), -threshold)) AS threshold, round(arg_max(balanced_accuracy, (round(balanced_accuracy, 12), -abs(threshold - 0.5), -threshold)), 9) AS balanced_accuracy FROM b""")
def presence_threshold(spark, d):
    return metrics.presence_threshold(_scored(spark, d), (0.1, 0.2, 0.3, 0.4), "y", "score").select("threshold", *_r("balanced_accuracy"))


@query("SELECT event_id, (value >= 250 OR value / 500 >= 0.80 OR event_id % 10 >= 8)::INT AS present FROM events")
def presence_decision(spark, d):
    return _t(spark, d, "events").select("event_id", metrics.presence_decision(F.col("value") / 500, F.lit(0.5), F.greatest(F.col("value") / 500, (F.col("event_id") % 10) / 10)).alias("present"))


_BOOT = """
WITH s AS (SELECT user_id, user_id % 2 AS y, avg(value) AS a, max(value) AS b FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS rk, count(*) OVER () AS n FROM s),
d AS (SELECT draw, ('0x' || substr(sha256('bootstrap|' || draw || '|' || rk), 1, 12))::BIGINT % n AS rk FROM k, range(2000) t(draw)), w AS (SELECT draw, rk, count(*)::DOUBLE AS times FROM d GROUP BY ALL),
p AS (SELECT draw, times, y, a, b FROM w JOIN k USING (rk)),
x AS (SELECT p.draw, sum(p.times * q.times * ((p.a > q.a)::INT + (p.a = q.a)::INT / 2)) / sum(p.times * q.times) AS a, sum(p.times * q.times * ((p.b > q.b)::INT + (p.b = q.b)::INT / 2)) / sum(p.times * q.times) AS b FROM p JOIN p q ON p.draw = q.draw AND p.y = 1 AND q.y = 0 GROUP BY 1),
o AS (SELECT avg((p.a > q.a)::INT + (p.a = q.a)::INT / 2) AS a, avg((p.b > q.b)::INT + (p.b = q.b)::INT / 2) AS b FROM s p JOIN s q ON p.y = 1 AND q.y = 0)"""


def _subjects(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("a"), F.max("value").alias("b")).withColumn("y", F.col("user_id") % 2)


@query(_BOOT + " SELECT round((SELECT a FROM o), 9) AS auc, round(quantile_cont(a, 0.025), 9) AS ci_low, round(quantile_cont(a, 0.975), 9) AS ci_high, count(*) AS resamples FROM x")
def bootstrap_auc_ci(spark, d):
    return metrics.bootstrap_auc(_subjects(spark, d), "user_id", "y", "a").select(*_r("auc", "ci_low", "ci_high"), "resamples")


@query(_BOOT + " SELECT (SELECT count(*) FROM s) AS subjects, round((SELECT a - b FROM o), 9) AS auc_difference, round(quantile_cont(a - b, 0.025), 9) AS ci_low, round(quantile_cont(a - b, 0.975), 9) AS ci_high FROM x")
def paired_auc_difference(spark, d):
    s = _subjects(spark, d)
    long = s.select("user_id", "y", F.explode(F.array(F.struct(F.lit("a").alias("mode"), F.col("a").alias("score")), F.struct(F.lit("b").alias("mode"), F.col("b").alias("score")))).alias("m")).select("user_id", "y", "m.mode", "m.score")
    return metrics.paired_auc_difference(long, "mode", "a", "b", "user_id", "y", "score").select("subjects", *_r("auc_difference", "ci_low", "ci_high"))


@query()
def nested_cv_scores(spark, d):
    e = _t(spark, d, "embeddings").withColumn("subject", F.concat_ws("-", F.col("label").cast("string"), (F.col("vec_id") % 6).cast("string"))).withColumn("series", F.col("vec_id") % 12)
    bank = pooling.pooled_vectors(e.withColumn("mode", F.lit("all")), ["mode"], "subject", "series", "embedding").withColumn("y", F.substring_index("subject", "-", 1).cast("int") % 2)
    folds = cohort.hash_folds(bank, "subject", "y")
    out = modeling.nested_cv(bank.join(folds.drop("y"), "subject"), "mode", "subject", "y", "fold", "x")
    return out.withColumns({"score": F.round("score", 9), "threshold": F.round("threshold", 9)})


# store, set operations and relations -----------------------------------------------------------


@query("SELECT count(*) AS n, min(sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}')) AS least FROM nation")
def table_row_digests(spark, d):
    return row_digests(_t(spark, d, "nation")).agg(F.count("*").alias("n"), F.min("digest").alias("least"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_anti_joins(spark, d):
    """Spark's own joins."""
    c = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    r = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").join(r, "o_orderkey", "left_anti").select("o_orderkey")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_operations(spark, d):
    """Spark's own set operations."""
    k = lambda t, c: _t(spark, d, t).select(F.col(c).alias("k"))
    return k("customer", "c_nationkey").intersect(k("supplier", "s_nationkey")).exceptAll(_t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))).distinct()


@query("SELECT n_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def star_revenue(spark, d):
    """Spark's own joins and aggregates."""
    li = _t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_discount")
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    return li.join(s, "l_suppkey").join(_t(spark, d, "nation"), "n_nationkey").groupBy("n_name", "l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, sha256(l_orderkey || '|' || l_linenumber)) AS r FROM lineitem) WHERE r <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), hash_order(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return _t(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "r")


# joins of the cohort ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def complete_join(spark, d):
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    items = _t(spark, d, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left_semi")
    return relations.complete_join(items, lines.join(items.select("o_orderkey"), "o_orderkey", "left_semi"), "o_orderkey")


@query(_AUDIT + " SELECT doc_id, target, n_chars FROM a JOIN documents USING (doc_id) WHERE status = 'ACCEPTED'")
def accepted_items(spark, d):
    return relations.accepted_items(_audited(spark, d), _t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "target", "n_chars")


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL OR doc_id % 6 < 3 THEN '' WHEN toxic = 1 THEN 'UNUSABLE' ELSE 'HEART_PRESENT' END AS target,
  CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'empty_or_nearly_empty' WHEN doc_id % 7 = 6 THEN 'nearly_full' ELSE '' END AS mask_reason FROM documents LEFT JOIN labels l USING (doc_id)""")
def annotated_rows(spark, d):
    empty = F.expr("CASE doc_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'Unlabeled' END")
    marks = _t(spark, d, "labels").select("doc_id", F.coalesce(empty, F.when(F.col("toxic") == 1, " unusable").otherwise("Heart_present")).alias("target_type"))
    masks = _t(spark, d, "documents").where("doc_id % 4 > 0").select("doc_id", F.expr("CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 / 6.0D END").alias("area"))
    return relations.with_annotations(_t(spark, d, "documents").select("doc_id"), marks, masks, "doc_id").select("doc_id", "target", "mask_reason")


_TARGETS = "WITH p AS (SELECT l_orderkey, sum((l_tax > 0.04 AND l_discount > 0.04)::INT) AS tp, sum((l_tax > 0.04 AND l_discount <= 0.04)::INT) AS fp, sum((l_tax <= 0.04 AND l_discount > 0.04)::INT) AS fn, count(*) AS n FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1), e AS (SELECT o_custkey AS subject, (o_orderstatus <> 'F')::INT AS present, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END AS dice, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END AS iou, CASE WHEN tp + fp = 0 THEN (fn = 0)::INT ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS recall, (tp + fp) / n AS pa, fp / n AS fa FROM orders JOIN p ON l_orderkey = o_orderkey WHERE o_orderpriority <> '1-URGENT')"


@query(_TARGETS + """, g AS (SELECT subject, avg(dice) AS da, avg(dice) FILTER (present = 1) AS d, avg(iou) FILTER (present = 1) AS i, avg(precision) FILTER (present = 1) AS p, avg(recall) FILTER (present = 1) AS r FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS targets, (SELECT count(*) FILTER (present = 1) FROM e) AS positives, (SELECT count(*) FILTER (present = 0) FROM e) AS negatives, round(avg(da), 9) AS dice_all, round(avg(d), 9) AS dice_positive, round(avg(i), 9) AS iou_positive, round(avg(p), 9) AS precision_positive, round(avg(r), 9) AS recall_positive,
  round((SELECT avg((pa < 0.003)::INT) FILTER (present = 0) FROM e), 9) AS empty_prediction_rate, round((SELECT avg(fa) FILTER (present = 0) FROM e), 9) AS mean_false_positive_area FROM g""")
def segmentation_summary(spark, d):
    a, b = F.col("l_tax") > 0.04, F.col("l_discount") > 0.04
    found = _t(spark, d, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"), F.count("*").alias("n"))
    targets = _t(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("subject"), (F.col("o_orderstatus") != "F").cast("int").alias("present"))
    rows = relations.evaluated_targets(targets, found, "o_orderkey").withColumns({"predicted_area": (F.col("tp") + F.col("fp")) / F.col("n"), "false_positive_area": F.col("fp") / F.col("n")})
    out = metrics.segmentation_summary(rows, "subject")
    return out.select("targets", "positives", "negatives", *_r(*out.columns[3:]))


@query("""SELECT event_type, count(*) AS predictions, count(*) FILTER (value > 50) AS initially_valid, count(*) FILTER (value > 20) AS finally_valid, count(*) FILTER (event_id % 4 = 0) AS empty, count(*) FILTER (value <= 50) AS repaired, count(*) FILTER (event_id % 10 >= 2) AS uncertain FROM events GROUP BY 1""")
def prediction_summary(spark, d):
    e = _t(spark, d, "events").selectExpr("event_type", "int(value > 50) AS valid_initial", "int(value > 20) AS valid_final", "int(event_id % 4 > 0) AS present", "IF(value > 50, 'none', 'unresolved') AS repair", "event_id % 10 / 10.0D AS uncertainty")
    return metrics.prediction_summary(e, ["event_type"])


@query("""
WITH s AS (SELECT DISTINCT user_id, user_id % 2 AS label FROM events), f AS (SELECT user_id, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42|segmentation-fold|' || label || '|' || user_id), user_id) - 1) % 5)::INT AS fold FROM s)
SELECT event_id, fold FROM events JOIN f USING (user_id)""")
def folds_of_items(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", (F.col("user_id") % 2).alias("label"))
    return relations.folds_of(e, cohort.hash_folds(e, "user_id", "label").drop("label"), "user_id").select("event_id", "fold")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN value ELSE value * 2 END AS guess, (event_id % 5)::INT AS fold FROM events")
def combined_folds(spark, d):
    e = _t(spark, d, "events").select("event_id", "value", (F.col("event_id") % 5).cast("int").alias("fold"))
    parts = {k: e.where(F.col("fold").isin(k, (k + 1) % 5)).select("event_id", (F.col("value") if k == 0 else F.col("value") * 2).alias("guess")) for k in range(5)}
    return relations.combined_parts(parts, e.select("event_id", "fold"), "event_id").select("event_id", "guess", "fold")


_FLAGS = """WITH f AS (SELECT event_id, user_id, event_type, event_id % 11 > 0 AND value > 20 AND event_id % 13 > 0 AND event_id % 17 > 2 AS ka, event_id % 6 = 0 AS km, event_id % 4 = 0 AS sel FROM events),
m AS (SELECT event_id, user_id, event_type, unnest(list_filter([{'mode': 'B0_FULL_IMAGE', 'region': 'full', 'on': true}, {'mode': 'B2_ATTENTION_ELIGIBLE_FULL_IMAGE', 'region': 'full', 'on': ka}, {'mode': 'AU1_ATTENTION_ROI', 'region': 'attention', 'on': ka}, {'mode': 'C1_ATTENTION_COMPLEMENT', 'region': 'attention_complement', 'on': ka},
  {'mode': 'B1_MATCHED_FULL_IMAGE', 'region': 'full', 'on': ka AND sel}, {'mode': 'AU2_MATCHED_ATTENTION_ROI', 'region': 'attention', 'on': ka AND sel}, {'mode': 'C2_MATCHED_ATTENTION_COMPLEMENT', 'region': 'attention_complement', 'on': ka AND sel}, {'mode': 'M1_MANUAL_ROI', 'region': 'manual', 'on': km}, {'mode': 'C3_MANUAL_COMPLEMENT', 'region': 'manual_complement', 'on': km},
  {'mode': 'AU3_ATTENTION_ROI_MANUAL_SUBSET', 'region': 'attention', 'on': km}, {'mode': 'C4_ATTENTION_COMPLEMENT_MANUAL_SUBSET', 'region': 'attention_complement', 'on': km}], lambda x: x.on)) AS t FROM f)"""


def _flagged(spark, d):
    e = _t(spark, d, "events").selectExpr("event_id", "user_id", "event_type", "value", "event_id % 11 > 0 AS quality_valid", "value > 20 AS valid", "CASE event_id % 13 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END AS present", "CASE WHEN event_id % 17 > 0 THEN event_id % 17 / 1000.0D END AS area", "true AS has_mask")
    chosen = e.where("event_id % 4 = 0")
    return pooling.keep_flags(relations.flagged(relations.flagged(e, chosen.unionByName(chosen), "event_id", "selected"), e.where("event_id % 6 = 0"), "event_id", "manual"))


@query(_FLAGS + " SELECT event_id, ka AS keep_attention, km AS keep_manual_matched, ka AND sel AS keep_cross_class_matched FROM f")
def keep_flags(spark, d):
    return _flagged(spark, d).select("event_id", "keep_attention", "keep_manual_matched", "keep_cross_class_matched")


@query(_FLAGS + " SELECT t.mode AS mode, t.region AS region, count(*) AS items, count(DISTINCT user_id) AS subjects FROM m GROUP BY ALL")
def feature_modes(spark, d):
    return pooling.feature_modes(_flagged(spark, d)).groupBy("mode", "region").agg(F.count("*").alias("items"), F.count_distinct("user_id").alias("subjects"))


@query(_FLAGS + """, v AS (SELECT user_id, event_type, t.mode AS mode, unnest([value, value * length(t.region)]) AS x, unnest([0, 1]) AS pos FROM m JOIN events USING (event_id, user_id, event_type)), i AS (SELECT mode, user_id, event_type, pos, avg(x) AS x FROM v GROUP BY ALL), o AS (SELECT mode, user_id, pos, avg(x) AS x FROM i GROUP BY ALL)
SELECT mode, user_id, user_id % 2 AS label, round(max(x) FILTER (pos = 0), 9) AS x0, round(max(x) FILTER (pos = 1), 9) AS x1 FROM o GROUP BY ALL""")
def feature_bank(spark, d):
    # by item before rows become regions and modes, into as many parts as these meet in
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _flagged(spark, d).withColumn("label", F.col("user_id") % 2).repartition(parts, "event_id")
    regions = F.explode(F.array(*[F.lit(r) for r in sorted({r for _, r, _ in pooling.MODES})])).alias("region")
    vectors = rows.select("event_id", "value", regions).select("event_id", "region", F.array("value", F.col("value") * F.length("region")).alias("v"))
    bank = pooling.feature_bank(pooling.feature_modes(rows), vectors, "event_id", "user_id", "event_type", "label", "v")
    return bank.select("mode", "user_id", "label", F.round(F.get("x", F.lit(0)), 9).alias("x0"), F.round(F.get("x", F.lit(1)), 9).alias("x1"))


@query("""
WITH r AS (SELECT event_id, abs(value - 100) / 20 AS a, CASE WHEN event_id % 3 > 0 THEN abs(event_id % 50 - 25) / 5.0::DOUBLE END AS b FROM events) SELECT event_id, round(CASE WHEN event_id % 7 > 0 AND event_id % 4 <> 1 THEN greatest(a, coalesce(b, 0)) ELSE 0 END, 9) AS deviation FROM r""")
def prior_deviation(spark, d):
    e = _t(spark, d, "events")
    second = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 50).cast("double"))
    n = F.when(F.col("event_id") % 4 == 1, 4).otherwise(5)
    dev = robust.deviation([(F.col("value"), F.lit(100.0), F.lit(20.0)), (second, F.lit(25.0), F.lit(5.0))], n, F.col("event_id") % 7 > 0)
    return e.select("event_id", dev.alias("deviation")).select("event_id", *_r("deviation"))


@query("SELECT doc_id, CASE WHEN upper(t) = 'NO_HEART_VISIBLE' THEN 0.9 WHEN s LIKE '%auto%' THEN 0.72 ELSE 1.0 END::DOUBLE AS weight FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'NO_HEART_VISIBLE' ELSE 'HEART_PRESENT' END AS t, CASE WHEN doc_id % 2 = 0 THEN 'legacy_auto' ELSE 'human' END AS s FROM documents)")
def default_weights(spark, d):
    told, source = F.when(F.col("doc_id") % 3 == 0, "NO_HEART_VISIBLE").otherwise("HEART_PRESENT"), F.when(F.col("doc_id") % 2 == 0, "legacy_Auto").otherwise("human")
    return _t(spark, d, "documents").select("doc_id", audit.default_weight(told, source).cast("double").alias("weight"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS code, count(*) AS n FROM events GROUP BY ALL")
def mapped_codes(spark, d):
    codes = F.create_map(F.lit("click"), F.lit(1), F.lit("purchase"), F.lit(2))
    return _t(spark, d, "events").select("event_type", relations.mapped(codes, F.col("event_type"), F.lit(-1)).alias("code")).groupBy("event_type", "code").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, printf('%.12g', l_quantity) AS whole, printf('%.12g', l_discount) AS part, printf('%.12g', l_extendedprice * power(10, l_linenumber * 4 - 16)) AS scaled, printf('%.12g', l_discount / power(10, l_linenumber * 2)) AS tiny FROM lineitem")
def number_texts(spark, d):
    scaled = F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") * 4 - 16)
    numbers = {"whole": F.col("l_quantity"), "part": F.col("l_discount"), "scaled": scaled, "tiny": F.col("l_discount") / F.pow(F.lit(10.0), F.col("l_linenumber") * 2)}
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[relations.number_text(v).alias(k) for k, v in numbers.items()])


_OOF = """, q AS (SELECT t.mode AS mode, user_id AS subject, user_id % 2 AS label, avg(value * length(t.region) % 97) / 97 AS score FROM m JOIN events USING (event_id, user_id, event_type) GROUP BY ALL)"""


def _oof_scores(spark, d):
    """Scores of the library's own modes: of each subject the mean of a number that depends on item and region."""
    rows = pooling.feature_modes(_flagged(spark, d))
    out = rows.groupBy("mode", F.col("user_id").alias("subject")).agg((F.avg(F.col("value") * F.length("region") % 97) / 97).alias("score"))
    return out.withColumns({"label": F.col("subject") % 2, "predicted": (F.col("score") >= 0.5).cast("int")})


_DRAWN = """, u AS ({units}), k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY subject) - 1 AS rk, count(*) OVER (PARTITION BY unit) AS n FROM u),
z AS (SELECT DISTINCT n FROM k), y AS (SELECT draw, place, ('0x' || substr(sha256('bootstrap|' || draw || '|' || place), 1, 12))::BIGINT AS h FROM range(2000) t(draw), (SELECT unnest(range((SELECT max(n) FROM z))) AS place)),
w AS (SELECT n, draw, h % n AS rk, count(*)::DOUBLE AS times FROM y, z WHERE place < n GROUP BY ALL),
e AS (SELECT unit, draw, times * label AS pos, times * (1 - label) AS neg, side, CASE side WHEN 0 THEN a ELSE b END AS score FROM k JOIN w USING (n, rk), (VALUES (0), (1)) v(side)),
g AS (SELECT unit, draw, side, score, sum(pos) AS pos, sum(neg) AS neg FROM e GROUP BY ALL), c AS (SELECT *, sum(pos) OVER (PARTITION BY unit, draw, side ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp FROM g),
x AS (SELECT unit, draw, side, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) END AS auc FROM c GROUP BY ALL),
i AS (SELECT unit, quantile_cont(auc, 0.025) FILTER (side = 0) AS l0, quantile_cont(auc, 0.975) FILTER (side = 0) AS h0 FROM x GROUP BY 1),
r AS (SELECT unit, quantile_cont(p.auc - o.auc, 0.025) AS l, quantile_cont(p.auc - o.auc, 0.975) AS h FROM x p JOIN x o USING (unit, draw) WHERE p.side = 0 AND o.side = 1 GROUP BY 1),
o AS (SELECT p.unit, count(DISTINCT p.subject) + 0 AS n_pos, sum((p.a > q.a)::INT + (p.a = q.a)::INT / 2) / count(*) AS a, sum((p.b > q.b)::INT + (p.b = q.b)::INT / 2) / count(*) AS b FROM k p JOIN k q ON p.unit = q.unit AND p.label = 1 AND q.label = 0 GROUP BY 1)"""


@query(_FLAGS + _OOF + _DRAWN.format(units="SELECT position AS unit, f.subject, f.label, f.score AS a, g.score AS b FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b, _) in enumerate(metrics.COMPARISONS)) + ") v(position, one, two) JOIN q f ON f.mode = one JOIN q g ON g.mode = two AND g.subject = f.subject AND g.label = f.label")
       + " SELECT position::INT AS position, comparison, first, second, (SELECT count(*) FROM u WHERE unit = position) AS subjects, round(a - b, 9) AS auc_difference, round(l, 9) AS ci_low, round(h, 9) AS ci_high FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(metrics.COMPARISONS)) + ") v(position, first, second, comparison) LEFT JOIN o ON o.unit = position LEFT JOIN r ON r.unit = position")
def mode_comparisons(spark, d):
    return metrics.evaluate_modes(_oof_scores(spark, d))[1].select("position", "comparison", "first", "second", "subjects", *_r("auc_difference", "ci_low", "ci_high"))


@query(_FLAGS + _OOF + _DRAWN.format(units="SELECT mode AS unit, subject, label, score AS a, score AS b FROM q")
       + """, s AS (SELECT mode, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM q GROUP BY ALL), t AS (SELECT *, sum(pos) OVER v AS cp, sum(pos + neg) OVER v AS ca FROM s WINDOW v AS (PARTITION BY mode ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT mode, sum(pos * cp / ca) / sum(pos) AS ap FROM t GROUP BY 1),
  b AS (SELECT mode, count(*) AS subjects, avg(power(score - label, 2)) AS brier, avg(((score >= 0.5)::INT = label)::INT) AS accuracy, avg((score >= 0.5)::INT) FILTER (label = 1) AS sensitivity, avg((score < 0.5)::INT) FILTER (label = 0) AS specificity FROM q GROUP BY 1)
  SELECT row_number() OVER (ORDER BY a DESC, mode)::INT AS place, mode, CASE WHEN mode[1:2] IN ('M1', 'C3', 'C4') OR mode[1:3] = 'AU3' THEN 'mask_validation' ELSE 'primary' END AS experiment_group, CASE mode[1:3] WHEN 'B0_' THEN 'all_dataset_slices' WHEN 'B2_' THEN 'attention_eligible_same_slices' WHEN 'AU1' THEN 'attention_eligible_same_slices' WHEN 'C1_' THEN 'attention_eligible_same_slices'
  WHEN 'B1_' THEN 'cross_class_matched_same_slices' WHEN 'AU2' THEN 'cross_class_matched_same_slices' WHEN 'C2_' THEN 'cross_class_matched_same_slices' ELSE 'manual_positive_same_slices' END AS cohort, subjects, round(a, 9) AS auc, round(l0, 9) AS auc_ci_low, round(h0, 9) AS auc_ci_high, round(ap, 9) AS average_precision, round(brier, 9) AS brier, round(accuracy, 9) AS accuracy, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity
  FROM b JOIN ap USING (mode) JOIN o ON o.unit = mode JOIN i ON i.unit = mode""")  # fmt: skip
def mode_metrics(spark, d):
    return metrics.evaluate_modes(_oof_scores(spark, d))[0].select("place", "mode", "experiment_group", "cohort", "subjects", *_r("auc", "auc_ci_low", "auc_ci_high", "average_precision", "brier", "accuracy", "sensitivity", "specificity"))


@query("SELECT event_type, count(DISTINCT user_id) AS subjects, round(avg((user_id % 2 = (value > 100)::INT)::INT), 9) AS accuracy FROM events GROUP BY 1")
def mode_accuracy(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("mode"), F.col("user_id").alias("subject"), (F.col("user_id") % 2).alias("label"), (F.col("value") / 500).alias("score"), (F.col("value") > 100).cast("int").alias("predicted"))
    return metrics.hit_rates(e).select(F.col("mode").alias("event_type"), "subjects", *_r("accuracy"))


# reviews, samples -------------------------------------------------------------------------------

_ACTION = "CASE event_id % 7 WHEN 0 THEN 'save_manual_heart_present' WHEN 1 THEN 'accept_auto_and_save' WHEN 2 THEN 'mark_no_heart_visible' WHEN 3 THEN 'mark_unusable' WHEN 4 THEN 'delete_manual_and_annotation' WHEN 5 THEN 'skip' ELSE 'open' END"


def _review_log(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("item"), F.expr(_ACTION).alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("turn"), ((F.col("event_id") % 3) + 1).alias("review_round"), (F.col("value") / 500 - 0.1).alias("drawn_area"), (F.col("value") / 400 - 0.2).alias("auto_area"))
    return e.withColumns({"queue_position": F.col("turn"), "queue_size": F.lit(0)})


_REVIEW = f"""WITH l AS (SELECT user_id AS item, {_ACTION} AS action, ts, event_id, event_id % 3 + 1 AS review_round, value / 500 - 0.1 AS drawn, value / 400 - 0.2 AS auto FROM events), g AS (SELECT * FROM l WHERE action <> 'open' AND NOT (action = 'save_manual_heart_present' AND drawn < 0.0005) AND NOT (action = 'accept_auto_and_save' AND auto < 0.0005)),
s AS (SELECT item, count(*) FILTER (action <> 'skip') AS actions, count(*) FILTER (action = 'skip') AS skips, arg_max(action, (ts, event_id)) FILTER (action <> 'skip') AS action, arg_max(CASE action WHEN 'save_manual_heart_present' THEN drawn WHEN 'accept_auto_and_save' THEN auto WHEN 'mark_no_heart_visible' THEN 0 ELSE -1 END, (ts, event_id)) FILTER (action <> 'skip') AS area FROM g GROUP BY 1),
b AS (SELECT DISTINCT user_id AS item FROM events WHERE user_id % 4 = 0)"""


@query(_REVIEW + """ SELECT item, CASE WHEN action IS NULL THEN CASE WHEN b.item IS NOT NULL THEN 'HEART_PRESENT' END WHEN action IN ('save_manual_heart_present', 'accept_auto_and_save') THEN 'HEART_PRESENT' WHEN action = 'mark_no_heart_visible' THEN 'NO_HEART_VISIBLE' WHEN action = 'mark_unusable' THEN 'UNUSABLE' END AS target_type,
  CASE action WHEN 'save_manual_heart_present' THEN 1.0 WHEN 'accept_auto_and_save' THEN 0.72 WHEN 'mark_no_heart_visible' THEN 0.90 WHEN 'mark_unusable' THEN 0.0 WHEN 'delete_manual_and_annotation' THEN NULL ELSE CASE WHEN b.item IS NOT NULL THEN 1.0 END END::DOUBLE AS sample_weight,
  CASE action WHEN 'save_manual_heart_present' THEN 'drawn' WHEN 'accept_auto_and_save' THEN 'automatic' WHEN 'mark_no_heart_visible' THEN 'empty' WHEN 'mark_unusable' THEN 'none' WHEN 'delete_manual_and_annotation' THEN 'none' END AS mask, round(CASE WHEN area >= 0 THEN area END, 9) AS mask_area, coalesce(actions, 0) AS actions, coalesce(skips, 0) AS skips FROM s FULL JOIN b USING (item)""")
def review_states(spark, d):
    before = _t(spark, d, "events").where("user_id % 4 = 0").select(F.col("user_id").alias("item"), F.lit("HEART_PRESENT").alias("target_type"), F.lit("legacy").alias("source"), F.lit(1.0).alias("sample_weight")).distinct()
    return review.states(_review_log(spark, d), before).select("item", "target_type", "sample_weight", "mask", *_r("mask_area"), "actions", "skips")


@query(_REVIEW + " SELECT DISTINCT event_type || '-' || user_id AS name, user_id AS item FROM events WHERE user_id NOT IN (SELECT item FROM g WHERE review_round = 2 AND item % 2 = 1)")
def review_pending(spark, d):
    queue = _t(spark, d, "events").select(F.concat_ws("-", "event_type", "user_id").alias("name"), F.col("user_id").alias("item")).distinct()
    return review.pending(queue, _review_log(spark, d).where("item % 2 = 1"), 2)


@query("""WITH w AS (SELECT event_id, value FROM events WHERE value > 0), m AS (SELECT max(value) AS most, count(*) AS n FROM w), u AS (SELECT event_id, floor(value / most * (4503599627370496 >> (length(bin(n - 1)))::INT)::DOUBLE)::BIGINT AS u FROM w, m), i AS (SELECT event_id, u, sum(u) OVER (ORDER BY event_id)::BIGINT AS high FROM u), t AS (SELECT sum(u)::HUGEINT AS total FROM u),
d AS (SELECT draw, (('0x' || substr(sha256('42|draw|' || draw), 1, 15))::BIGINT::HUGEINT * total // 1152921504606846976)::BIGINT AS place FROM range(5000) r(draw), t)
SELECT draw, event_id FROM d JOIN i ON place >= high - u AND place < high""")
def weighted_sample(spark, d):
    """5,000 draws, the size of a training epoch there; the operator draws any number."""
    return sampling.weighted_draws(_t(spark, d, "events").select("event_id", "value"), "event_id", "value", 5000)


# pixels, quantiles -------------------------------------------------------------------------------


@query("""WITH n AS (SELECT event_id, lag(event_id, 1, event_id) OVER w AS previous, lag(event_type, 1, event_type) OVER w AS a, event_type AS b, lead(event_type, 1, event_type) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, previous, a || b || c AS stack FROM n""")
def neighbour_stacks(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").cast("binary").alias("pixels"))
    out = masks.neighbour_stacks(e.select("event_id", "user_id", "ts"), e, "event_id", ["user_id"], ["ts", "event_id"])
    return out.select("event_id", "previous", F.col("stack").cast("string").alias("stack"))


@query("SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.03), 9) AS low, round(quantile_cont(l_extendedprice, 0.5), 9) AS middle, round(quantile_cont(l_extendedprice, 0.97), 9) AS high FROM lineitem GROUP BY 1")
def quantiles_in_passes(spark, d):
    """With a buffer of a thousand values, so groups are read in passes at any size of the tables."""
    out = quantiles.exact_quantiles(_t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.03, 0.5, 0.97], in_buffer=1000)
    return out.select("l_returnflag", "n", *[F.round(F.get("q", F.lit(k)), 9).alias(name) for k, name in enumerate(("low", "middle", "high"))])


@query()
def mask_predictions(spark, d):
    """The 64 numbers of an embedding in the role of a map of 8 x 8, those of the next one as its second view; priors from masks of the maps themselves."""
    e = _t(spark, d, "embeddings").where("vec_id IS NOT NULL")
    level = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double") * 2 + 0.5))
    maps = e.select(F.col("vec_id").alias("item"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.transform("embedding", level).alias("probability"), F.transform("embedding", lambda x: level(x * 0.8)).alias("other"), (F.abs(F.get("embedding", F.lit(0)).cast("double")) * 4).alias("presence"))
    maps = kept(masks.packed_maps(maps, ["probability", "other"]))
    settings = spark.createDataFrame([(k, 0.5 + 0.02 * k, 0.4) for k in range(5)], "fold int, threshold double, presence_threshold double")
    bare = settings.select("fold", F.lit(0).cast("long").alias("n"), F.lit(None).cast("map<string,struct<centre:double,scale:double>>").alias("prior"))
    first = kept(masks.predict_masks(maps, settings, bare, 8).where("heart_present = 1").select("item", "fold", "packed"))
    priors = masks.fold_priors(masks.mask_numbers(first, "item", "packed", 8).join(first.select("item", "fold"), "item"), "fold")
    out = masks.predict_masks(maps, settings, kept(priors), 8)
    return out.select("item", "fold", "valid_initial", "valid_final", "reason_final", "repair_method", "heart_present", *_r("threshold_used", "area_ratio", "uncertainty_score", "prior_deviation"))


@query("""WITH s AS (SELECT DISTINCT user_id FROM events WHERE value >= 0), r AS (SELECT DISTINCT user_id FROM events WHERE event_id % 97 = 0) (SELECT user_id FROM s EXCEPT SELECT user_id FROM r) UNION ALL (SELECT user_id FROM r EXCEPT SELECT user_id FROM s)""")
def cohort_differences(spark, d):
    modes = {"all": F.col("value") >= 0, "rare": F.col("event_id") % 97 == 0}
    return pooling.cohort_mismatch(pooling.mode_membership(_t(spark, d, "events"), modes), "user_id", "all", "rare")


@query("""
WITH t AS (SELECT unnest([0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75]::DOUBLE[]) AS threshold), p AS (SELECT l_orderkey, threshold, count(*) FILTER (l_tax * 10 > threshold AND l_discount > 0.04) AS both_, count(*) FILTER (l_tax * 10 > threshold) AS guess, count(*) FILTER (l_discount > 0.04) AS truth, count(*) AS n FROM lineitem, t GROUP BY ALL),
x AS (SELECT threshold, o_custkey AS subject, (truth > 0)::INT AS y, CASE WHEN truth > 0 THEN (2 * both_ + 1e-6) / (guess + truth + 1e-6) ELSE 1 - least(1, guess / n / 0.10) END AS q, (guess > 0)::INT AS valid FROM p JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT threshold, subject, avg(q) AS q, count(*) FILTER (y = 1 AND valid = 0) AS bad, count(*) FILTER (y = 1) AS n FROM x GROUP BY ALL), v AS (SELECT threshold, avg(q) AS mean_quality, sum(bad) / greatest(1, sum(n))::DOUBLE AS invalid_rate FROM a GROUP BY 1), z AS (SELECT *, mean_quality - 0.2 * invalid_rate AS score FROM v)
SELECT unnest(arg_max({'threshold': threshold, 'score': round(score, 9), 'mean_quality': round(mean_quality, 9), 'invalid_rate': round(invalid_rate, 9)}, (round(score, 12), -abs(threshold - 0.5), -threshold))) FROM z""")
def mask_threshold_search(spark, d):
    """Lines of an order in the role of pixels: the truth by discount, the guess by tax at each threshold."""
    truth = F.col("l_discount") > 0.04
    told = [(t, F.col("l_tax") * 10 > t) for t in metrics.THRESHOLDS]
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.count_if(guess & truth).alias("both"), F.count_if(guess).alias("guess")) for t, guess in told])
    found = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(truth).alias("truth"), F.count("*").alias("n"), each.alias("each"))
    # an order is one row up to its subject's task; its thresholds are made there
    whole = found.join(_t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject")), "o_orderkey").repartition("subject")
    rows = whole.select("subject", "truth", "n", F.explode("each").alias("e")).select("subject", "truth", "n", "e.*").withColumns({"present": (F.col("truth") > 0).cast("int"), "valid": (F.col("guess") > 0).cast("int")})
    tried = rows.withColumn("quality", metrics.target_quality(F.col("present"), F.col("both"), F.col("guess") + F.col("truth"), F.col("guess") / F.col("n")))
    return metrics.grid_search(tried, "threshold", "subject", "present", "quality", "valid").select("threshold", *_r("score", "mean_quality", "invalid_rate"))


@query("SELECT coalesce(l.doc_id, m.doc_id) AS doc_id, CASE WHEN toxic = 1 THEN 'UNUSABLE' WHEN toxic = 0 THEN 'HEART_PRESENT' END AS target_type, mask_area, m.doc_id IS NOT NULL AS found FROM labels l FULL JOIN (SELECT doc_id, doc_id % 7 / 6.0::DOUBLE AS mask_area FROM documents WHERE doc_id % 4 > 0) m ON m.doc_id = l.doc_id")
def all_marks(spark, d):
    told = _t(spark, d, "labels").select("doc_id", F.expr("CASE toxic WHEN 1 THEN 'UNUSABLE' WHEN 0 THEN 'HEART_PRESENT' END").alias("target_type"))
    return audit.all_marks(told, _t(spark, d, "documents").where("doc_id % 4 > 0").select("doc_id", F.expr("doc_id % 7 / 6.0D").alias("area")), "doc_id")


@query("SELECT e.event_id, CASE WHEN m.event_id IS NOT NULL THEN user_id::VARCHAR ELSE event_type || '::' || CASE WHEN user_id % 3 = 0 THEN '.' ELSE 'a/' || (user_id % 5) END END AS sequence, coalesce(m.event_id % 1000, 0) AS index FROM events e LEFT JOIN (SELECT event_id FROM events WHERE event_id % 10 > 2) m ON m.event_id = e.event_id")
def sequences_of_predictions(spark, d):
    e = _t(spark, d, "events")
    predictions = e.select("event_id", F.col("event_type").alias("series"), F.expr("CASE WHEN user_id % 3 = 0 THEN 'x.png' ELSE concat('a/', user_id % 5, '/x.png') END").alias("path"))
    manifest = e.where("event_id % 10 > 2").select("event_id", F.col("user_id").alias("sequence"), (F.col("event_id") % 1000).alias("index"))
    return relations.with_sequence(predictions, manifest, "event_id").select("event_id", "sequence", "index")
