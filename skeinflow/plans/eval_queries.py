"""Queries of splits, sampling, class weights and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.operators import metrics, splits
from skeinflow.sources.tables import table

LABELS_SQL = "ctx as (select context_id, coalesce(nullif(lower(trim(label)), ''), 'unknown') as label, captured_at, duration_seconds, packet_count, total_payload_bytes from flow_context)"


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "flow_context").select("context_id", canon.label("label", "unknown").alias("label"), "captured_at", "duration_seconds", "packet_count", "total_payload_bytes")


def split_temporal(spark: SparkSession, d: str) -> DataFrame:
    return splits.temporal_split(contexts(spark, d), "label", "captured_at", "context_id").select("context_id", "label", "split")


def split_hashed(spark: SparkSession, d: str) -> DataFrame:
    return splits.hashed_split(contexts(spark, d), "label", "context_id", "s1").select("context_id", "label", "split")


def split_test_first(spark: SparkSession, d: str) -> DataFrame:
    return splits.test_first_split(contexts(spark, d), "label", "context_id", "s2").select("context_id", "label", "split")


def subsample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_subsample(contexts(spark, d), "label", "context_id", "s3", 400).select("context_id", "label", "copy")


def balanced_subset(spark: SparkSession, d: str) -> DataFrame:
    return splits.take_per_class(contexts(spark, d), "label", "context_id", "s4", 40).select("context_id", "label")


def targets_per_class(spark: SparkSession, d: str) -> DataFrame:
    return splits.take_per_class(contexts(spark, d), "label", "context_id", "s5", {"benign": 100, "syn_wave": 7, "udp_wave": 10**9}).select("context_id", "label")


def sample_exact(spark: SparkSession, d: str) -> DataFrame:
    return splits.exact_sample(contexts(spark, d), "context_id", "s6", 500).select("context_id", "label")


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    c = contexts(spark, d)
    return splits.interleave(c, "label", "context_id", F.floor(F.col("context_id") / 1000)).select("context_id", "label", F.col("turn").cast("long").alias("turn"))


def class_weights_inverse(spark: SparkSession, d: str) -> DataFrame:
    return splits.class_weights(contexts(spark, d), "label").withColumn("weight", F.round("weight", 6))


def class_weights_cb(spark: SparkSession, d: str) -> DataFrame:
    return splits.class_weights(contexts(spark, d), "label", beta=0.999, max_weight=5.0).withColumn("weight", F.round("weight", 6))


def _measures(spark: SparkSession, d: str) -> DataFrame:
    return contexts(spark, d).select("context_id", canon.measured("duration_seconds").alias("duration"), F.col("packet_count").cast("double").alias("packets"))


def feature_scaling(spark: SparkSession, d: str) -> DataFrame:
    s = splits.scaling(_measures(spark, d), ["duration", "packets"])
    return s.select("feature", F.format_number("mean", 4).alias("mean"), F.format_number("std", 4).alias("std"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """graph_flow nodes with a stand-in prediction: every fourth node is shifted by a few classes."""
    n = F.col("node_id")
    shifted = F.pmod(F.col("flow_y") + 1 + n % 3, F.lit(14)).cast("int")
    return table(spark, d, "graph_flow").where(F.col("flow_y").isNotNull()).select(
        "node_id", F.lower(F.trim("split")).alias("split"), F.col("flow_y").alias("y_true"), F.when(n % 4 == 0, shifted).otherwise(F.col("flow_y")).alias("y_pred")
    )


PRED_SQL = "pred as (select node_id, lower(trim(split)) as split, flow_y as y_true, cast(case when node_id % 4 = 0 then (flow_y + 1 + node_id % 3) % 14 else flow_y end as integer) as y_pred from graph_flow where flow_y is not null)"
CLASSES = tuple(range(14))
WEB = (8, 9, 10)


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(predictions(spark, d), "y_true", "y_pred", CLASSES)


def class_support(spark: SparkSession, d: str) -> DataFrame:
    """Support per class of traffic_class, zeros included."""
    n = predictions(spark, d).groupBy(F.col("y_true").alias("class_id")).agg(F.count(F.lit(1)).alias("support"))
    return table(spark, d, "traffic_class").select("class_id", "label").join(n, "class_id", "left").select("class_id", "label", F.coalesce("support", F.lit(0)).alias("support"))


def prf_per_class(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.scores(metrics.class_counts(predictions(spark, d), "y_true", "y_pred"))
    return s.select("class", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def prf_macro(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.summary(metrics.scores(metrics.class_counts(predictions(spark, d), "y_true", "y_pred", ["split"])), ["split"])
    return _rounded(s, "accuracy", "macro_f1", "weighted_f1")


def binary_pooled(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.pooled_binary(predictions(spark, d), "y_true", "y_pred", WEB), "precision", "recall", "f1")


def worst_classes(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.worst_classes(metrics.scores(metrics.class_counts(predictions(spark, d), "y_true", "y_pred")), 3)
    return s.select("class", F.round("f1", 6).alias("f1"))


def confusion_rows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.row_normalised(metrics.confusion(predictions(spark, d), "y_true", "y_pred", CLASSES)).select("y_true", "y_pred", "n", F.round("share", 6).alias("share"), "rank")


def split_gap(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 of the val and test splits and what lies between them."""
    s = metrics.summary(metrics.scores(metrics.class_counts(predictions(spark, d), "y_true", "y_pred", ["split"])), ["split"])
    f = {k: F.max(F.when(F.col("split") == k, F.col("macro_f1"))) for k in ("val", "test")}
    return s.agg(F.round(f["val"], 6).alias("val_macro_f1"), F.round(f["test"], 6).alias("test_macro_f1"), F.round(f["val"] - f["test"], 6).alias("gap"))


def monitor_score(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.summary(metrics.scores(metrics.class_counts(predictions(spark, d), "y_true", "y_pred")))
    return s.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"), F.round((F.col("macro_f1") + F.col("accuracy")) / 2, 6).alias("mean_of_both"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap(predictions(spark, d), "y_true", "y_pred", CLASSES)


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """Four class scores per node from its features: log1p of four sizes, centred by constants."""
    f = F.col("node_features")
    x = [F.coalesce(F.nanvl(F.try_element_at(f, F.lit(i + 1)), F.lit(0.0)), F.lit(0.0)).cast("double") for i in (3, 6, 9, 15)]
    return table(spark, d, "graph_flow").where("flow_y is not null").select("node_id", (F.col("flow_y") % 4).alias("y4"), F.array(*[F.round(F.log1p(F.abs(v)) - c, 6) for v, c in zip(x, (3.0, 8.5, 1.5, 6.0), strict=True)]).alias("logits"))


def bias_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _logits(spark, d).select("node_id", metrics.argmax(F.col("logits")).alias("raw"), metrics.biased_argmax(F.col("logits"), (0.5, -1.0, 0.0, 0.25)).alias("biased"))


def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    """Softmax, best class, confidence and the alert decision (class 0 is benign, threshold 0.6)."""
    s = _logits(spark, d).select("node_id", metrics.softmax(F.col("logits")).alias("p"))
    best, conf = metrics.argmax(F.col("p")), F.array_max("p")
    return s.select("node_id", best.alias("class_id"), F.round(conf, 6).alias("confidence"), ((best != 0) & (conf >= 0.6)).alias("should_alert"))


def bias_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 before and after calibrating a per-class bias."""
    rows = _logits(spark, d)
    bias = metrics.calibrate_bias(rows, "y4", "logits", 4)
    out = rows.select("y4", F.explode(F.array(F.struct(F.lit("raw").alias("rule"), metrics.argmax(F.col("logits")).alias("p")), F.struct(F.lit("calibrated").alias("rule"), metrics.biased_argmax(F.col("logits"), bias).alias("p")))).alias("r"))
    out = out.select("y4", "r.rule", "r.p")
    return _rounded(metrics.summary(metrics.scores(metrics.class_counts(out, "y4", "p", ["rule"])), ["rule"]), "accuracy", "macro_f1", "weighted_f1")


QUERIES = {
    f.__name__: f
    for f in (
        split_temporal, split_hashed, split_test_first, subsample_stratified, balanced_subset, targets_per_class, sample_exact, round_robin, class_weights_inverse, class_weights_cb,
        feature_scaling, confusion_matrix, class_support, prf_per_class, prf_macro, binary_pooled, worst_classes, confusion_rows, split_gap, monitor_score, bootstrap_ci, bias_argmax,
        policy_decision, bias_calibration,
    )
}

_SIZES = "least(round_even(n * 0.7::double, 0), n - 2)"
_SPLIT = f"""case when n < 3 then 'train' when r <= {_SIZES} then 'train'
  when r <= {_SIZES} + greatest(1, least(round_even(n * 0.15::double, 0), n - {_SIZES} - 1)) then 'val' else 'test' end as split"""


def _hashed(seed: str) -> str:
    return f"with {LABELS_SQL}, rk as (select *, row_number() over (partition by label order by md5('{seed}|' || context_id), context_id) as r, count(*) over (partition by label) as n from ctx)"


_TEST_FIRST = """, a as (select *, case when n >= 3 then greatest(1, round_even(n * 0.15::double, 0)) else round_even(n * 0.15::double, 0) end as t0, case when n >= 3 then greatest(1, round_even(n * 0.15::double, 0)) else round_even(n * 0.15::double, 0) end as v0 from rk),
  b as (select *, case when t0 + v0 >= n then greatest(0, v0 - (t0 + v0 - n + 1)) else v0 end as v1, case when t0 >= n then greatest(0, n - 1) else t0 end as t1 from a)
  select context_id, label, case when r <= t1 then 'test' when r <= t1 + v1 then 'val' else 'train' end as split from b"""
COUNTS_SQL = """cc as (select {by} y_true as class, case when y_true = y_pred then 1 else 0 end as tp, 0 as fp, case when y_true <> y_pred then 1 else 0 end as fn, 1 as support from {src}
  union all select {by} y_pred, 0, case when y_true <> y_pred then 1 else 0 end, 0, 0 from {src}),
 cs as (select {by} class, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(support) as bigint) as support from cc group by {by} class),
 pr as (select *, tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall from cs),
 sc as (select *, 2.0 * precision * recall / greatest(precision + recall, 1e-12) as f1 from pr)"""


def scored_sql(by: str = "", src: str = "pred") -> str:
    return COUNTS_SQL.format(by=f"{by}, " if by else "", src=src)


_SUMMARY = "cast(sum(support) as bigint) as n_rows, round(sum(tp) / greatest(sum(support), 1), 6) as accuracy, round(coalesce(avg(f1) filter (where support > 0), 0.0), 6) as macro_f1, round(sum(f1 * support) / greatest(sum(support), 1), 6) as weighted_f1"
_X = ", ".join(f"round(ln(1 + abs((case when len(node_features) < {i + 1} or node_features[{i + 1}] is null or isnan(node_features[{i + 1}]) then 0.0 else node_features[{i + 1}] end)::double)) - {c}, 6)" for i, c in ((3, 3.0), (6, 8.5), (9, 1.5), (15, 6.0)))
_LOGITS = f"lg as (select node_id, [{_X}] as l from graph_flow where flow_y is not null)"
_ARGMAX = "cast(list_position({0}, list_max({0})) - 1 as integer)"
ORACLE = {
    "split_temporal": f"with {LABELS_SQL}, rk as (select *, row_number() over (partition by label order by captured_at asc nulls last, context_id) as r, count(*) over (partition by label) as n from ctx) select context_id, label, {_SPLIT} from rk",
    "split_hashed": f"{_hashed('s1')} select context_id, label, {_SPLIT} from rk",
    "split_test_first": _hashed("s2") + _TEST_FIRST,
    "subsample_stratified": f"{_hashed('s3')}, c as (select *, case when n < 100 then cast(floor((least(100, greatest(n * 4, 50)) - r) / n) as bigint) + 1 when r <= 400 then 1 else 0 end as copies from rk) select context_id, label, cast(unnest(range(copies)) as bigint) as copy from c where copies > 0",
    "balanced_subset": f"{_hashed('s4')} select context_id, label from rk where r <= 40",
    "targets_per_class": f"{_hashed('s5')} select context_id, label from rk where r <= case label when 'benign' then 100 when 'syn_wave' then 7 when 'udp_wave' then 1000000000 else 0 end",
    "sample_exact": f"with {LABELS_SQL} select context_id, label from ctx order by md5('s6|' || context_id), context_id limit 500",
    "round_robin": f"with {LABELS_SQL} select context_id, label, row_number() over (partition by label order by context_id) as turn from ctx",
    "class_weights_inverse": f"with {LABELS_SQL}, c as (select label, count(*) as n from ctx group by 1), w as (select *, (sum(n) over ())::double / (count(*) over ()) / n as w from c) select label, n, round(w / (avg(w) over ()), 6) as weight from w",
    "class_weights_cb": f"with {LABELS_SQL}, c as (select label, count(*) as n from ctx group by 1), w as (select *, (1.0::double - 0.999::double) / (1.0 - pow(0.999::double, n)) as w from c) select label, n, round(least(w / (avg(w) over ()), 5.0), 6) as weight from w",
    "feature_scaling": "with m as (select case when duration_seconds is null or isnan(duration_seconds) or isinf(duration_seconds) or duration_seconds = -1 then null else duration_seconds end as duration, packet_count::double as packets from flow_context) select 'duration' as feature, format('{:,.4f}', avg(duration)) as mean, format('{:,.4f}', stddev_pop(duration)) as std from m union all select 'packets', format('{:,.4f}', avg(packets)), format('{:,.4f}', stddev_pop(packets)) from m",
    "confusion_matrix": f"with {PRED_SQL}, c as (select unnest(range(14))::integer as k) select a.k as y_true, b.k as y_pred, count(p.node_id) as n from c a cross join c b left join pred p on p.y_true = a.k and p.y_pred = b.k group by 1, 2",
    "class_support": f"with {PRED_SQL} select c.class_id, c.label, count(p.node_id) as support from traffic_class c left join pred p on p.y_true = c.class_id group by 1, 2",
    "prf_per_class": f"with {PRED_SQL}, {scored_sql()} select class, tp, fp, fn, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from sc",
    "prf_macro": f"with {PRED_SQL}, {scored_sql('split')} select split, {_SUMMARY} from sc group by split",
    "binary_pooled": f"with {PRED_SQL}, c as (select sum((y_true in (8,9,10) and y_pred in (8,9,10))::int)::bigint as tp, sum((y_true not in (8,9,10) and y_pred in (8,9,10))::int)::bigint as fp, sum((y_true in (8,9,10) and y_pred not in (8,9,10))::int)::bigint as fn from pred), p as (select *, tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall from c) select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(2.0 * precision * recall / greatest(precision + recall, 1e-12), 6) as f1 from p",
    "worst_classes": f"with {PRED_SQL}, {scored_sql()} select class, round(f1, 6) as f1 from sc where support > 0 order by sc.f1, class limit 3",
    "confusion_rows": f"with {PRED_SQL}, c as (select unnest(range(14))::integer as k), m as (select a.k as y_true, b.k as y_pred, count(p.node_id) as n from c a cross join c b left join pred p on p.y_true = a.k and p.y_pred = b.k group by 1, 2), s as (select *, n / greatest(sum(n) over (partition by y_true), 1) as share, cast(row_number() over (partition by y_true order by n desc, y_pred) as integer) as rank from m) select y_true, y_pred, n, round(share, 6) as share, rank from s where rank <= 3",
    "split_gap": f"with {PRED_SQL}, {scored_sql('split')}, f as (select split, avg(f1) filter (where support > 0) as m from sc group by 1) select round(max(m) filter (where split = 'val'), 6) as val_macro_f1, round(max(m) filter (where split = 'test'), 6) as test_macro_f1, round(max(m) filter (where split = 'val') - max(m) filter (where split = 'test'), 6) as gap from f",
    "monitor_score": f"with {PRED_SQL}, {scored_sql()}, f as (select avg(f1) filter (where support > 0) as m, sum(tp) / sum(support) as a from sc) select round(m, 6) as macro_f1, round(a, 6) as accuracy, round((m + a) / 2, 6) as mean_of_both from f",
    "bias_argmax": f"with {_LOGITS}, b as (select node_id, l, [l[1] + 0.5, l[2] - 1.0, l[3] + 0.0, l[4] + 0.25] as lb from lg) select node_id, {_ARGMAX.format('l')} as raw, {_ARGMAX.format('lb')} as biased from b",
    "policy_decision": f"with {_LOGITS}, e as (select node_id, list_transform(l, lambda x: exp(x - list_max(l))) as e from lg), p as (select node_id, list_transform(e, lambda x: x / list_sum(e)) as p from e) select node_id, {_ARGMAX.format('p')} as class_id, round(list_max(p), 6) as confidence, {_ARGMAX.format('p')} <> 0 and list_max(p) >= 0.6 as should_alert from p",
}
