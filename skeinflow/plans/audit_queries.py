"""Queries of report validation, requests, anchors, nested rows and the hot buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.functions import payload as P
from skeinflow.operators import evidence, flows, labels, metrics, reports, splits
from skeinflow.plans import sqlkit
from skeinflow.plans.flow_queries import CONSENSUS_SQL, RULES_SQL
from skeinflow.plans.graph_queries import _LK, _links
from skeinflow.plans.model_queries import feature_rows
from skeinflow.plans.stream_queries import _drain, _streamed
from skeinflow.plans.text_queries import _BY, _ED, _HX, _edges, class_map, payloads
from skeinflow.session import materialize, scratch
from skeinflow.sources import stores, views
from skeinflow.sources.tables import packet_events, table
from skeinflow.streaming.hot_buffer import hot_flows


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents as reports on their own flow: every second one cites the alert, cards have technique evidence."""
    docs = table(spark, d, "documents").where("text is not null")
    cited = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" [E_ALERT]"))).otherwise(F.col("text"))
    own = F.filter(F.array(canon.host("src_ip"), canon.flow_id("flow_id")), lambda x: x.isNotNull())
    numbers = F.array(F.lit(443.0), F.col("doc_id") % 100 / 100.0)
    return docs.select("doc_id", cited.alias("report"), own.alias("entities"), F.array(F.lit("E_ALERT"), F.lit("E_FLOW_001")).alias("ids"), numbers.alias("numbers"), (F.col("kind") == "card").alias("techniques"))


def report_validation(spark: SparkSession, d: str) -> DataFrame:
    out = reports.validate(_reports(spark, d), "doc_id", "report", "entities", "ids", "numbers", "techniques")
    return out.withColumn("grounding_rate", F.round("grounding_rate", 6))


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flow contexts as JSON without what JSON cannot hold, and the tokens that takes."""
    c = table(spark, d, "flow_context").select("context_id", canon.flow_id("flow_id").alias("flow"), "packet_count", "duration_seconds")
    finite = ~F.isnan("duration_seconds") & (F.abs("duration_seconds") < 1e12)
    text = reports.json_safe([("context_id", F.col("context_id")), ("packet_count", F.coalesce("packet_count", F.lit(0))), ("timed", F.coalesce(finite, F.lit(False)))])
    gaps = reports.json_safe([("seconds", F.when(F.isnan("duration_seconds") | (F.abs("duration_seconds") == float("inf")), F.col("duration_seconds")).otherwise(F.lit(None)))], ("seconds",))
    return c.select("context_id", text.alias("json"), gaps.alias("left_out"), reports.token_estimate(text).alias("n_tokens"))


def _requested(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    verb = F.when(F.col("doc_id") % 5 == 0, "PING ").otherwise("GET ")
    head = F.concat(verb, F.lit("/case/"), F.col("doc_id").cast("string"), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce("source", F.lit("-")), F.lit("\r\n\r\n"), F.col("text"))
    rows = docs.select("doc_id", canon.host("src_ip").alias("target"), (F.col("doc_id") % 3 + 80).cast("int").alias("port"), F.encode(head, "UTF-8").alias("payload"))
    return labels.collect_requests(rows, "payload")


def request_collection(spark: SparkSession, d: str) -> DataFrame:
    return _requested(spark, d).select("doc_id", "line", "host")


def request_targets(spark: SparkSession, d: str) -> DataFrame:
    return _requested(spark, d).groupBy("target", "port").agg(F.count(F.lit(1)).alias("n_requests"), F.count_distinct("host").alias("n_hosts"))


ANCHORS = ("n_ev", "frac_ev", "sum_w", "max_w")
ANCHOR_PROBS = (0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchor statistics of each flow's documents; flows with a ticket are the positives."""
    docs = payloads(spark, d).where("flow is not null")
    edges = _edges(spark, d).select("doc_id", F.round("weight", 4).alias("weight"))
    stats = labels.anchor_statistics(edges, docs.select("flow", "doc_id"), "flow", "doc_id", "weight")
    hit = docs.groupBy("flow").agg(F.bool_or(F.col("label") == "ticket").alias("positive"))
    return materialize(stats.join(hit, "flow"), "anchors")


def anchor_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _anchors(spark, d).withColumns({c: F.round(c, 4) for c in ANCHORS})


def anchor_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of every anchor statistic, positives and others apart."""
    long = _anchors(spark, d).select("positive", F.explode(F.create_map(*[x for c in ANCHORS for x in (F.lit(c), F.col(c))])).alias("anchor", "v"))
    return labels.quantiles(long, ["anchor", "positive"], "v", ANCHOR_PROBS).withColumn("value", F.round("value", 4))


def anchor_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of every anchor statistic at fixed thresholds."""
    a = _anchors(spark, d)
    parts = [labels.threshold_sweep(a.withColumn(c, F.round(c, 4)), c, F.col("positive"), (0.05, 0.1, 0.2, 0.5, 1, 2, 3, 5, 8, 13, 21)).withColumn("anchor", F.lit(c)) for c in ANCHORS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def class_families(spark: SparkSession, d: str) -> DataFrame:
    return evidence.dominant_family(class_map(spark, d)).withColumn("mass", F.round("mass", 6))


def row_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Flows as one row with a JSON list of packets, opened again into packet nodes: direction, size, transport size, payload (missing: 0) and the gap to the next packet."""
    f = flows.assign_flows(views.packets(spark, d))
    listed = F.array_sort(F.collect_list(F.struct(F.round(F.col("ts") * 1000).cast("long").alias("at"), "seq", F.col("is_fwd").cast("int").alias("dir"), "ip_len", F.when(F.col("payload_len") > 0, F.col("payload_len")).alias("payload"))))
    rows = f.groupBy("flow_id").agg(F.to_json(listed).alias("packets"))
    parsed = F.from_json("packets", "array<struct<at:long,seq:long,dir:int,ip_len:int,payload:int>>")
    nodes = rows.select("flow_id", parsed.alias("p")).select("flow_id", F.posexplode("p").alias("pos", "x"), "p")
    gap = F.get("p", F.col("pos") + 1)["at"] - F.col("x.at")
    size = F.coalesce("x.payload", F.lit(0))
    return nodes.select("flow_id", "pos", "x.dir", "x.ip_len", (F.col("x.ip_len") - 20 - size).alias("transport"), size.alias("payload"), F.coalesce(gap, F.lit(0).cast("long")).alias("gap_ms"))


def bundle_parts(spark: SparkSession, d: str) -> DataFrame:
    """The nested evidence bundles of flows, taken apart into rows again."""
    from skeinflow.plans.label_queries import evidence_bundles

    b = materialize(evidence_bundles(spark, d), "bundles")
    none = F.lit(None).cast("string")
    packets = b.select("flow_id", F.explode("packets").alias("p")).select("flow_id", F.lit("packet").alias("part"), F.col("p.seq").cast("string").alias("ref"), F.col("p.payload_len").cast("double").alias("value"))
    techniques = b.select("flow_id", F.explode("techniques").alias("t")).select("flow_id", F.lit("technique"), "t.technique", F.round("t.weight", 6))
    totals = b.select("flow_id", F.lit("packets"), none, F.col("n_packets").cast("double")).unionAll(b.select("flow_id", F.lit("bytes"), none, F.col("n_bytes").cast("double")))
    paths = b.select("flow_id", F.explode("paths").alias("x")).select("flow_id", F.lit("path"), F.concat_ws(">", F.col("x.src").cast("string"), F.col("x.dst").cast("string")), F.round("x.dt", 3))
    drops = b.select("flow_id", F.explode("packets").alias("p")).select("flow_id", F.lit("drop"), F.col("p.seq").cast("string"), F.round("p.drop", 6))
    attention = b.select("flow_id", F.explode("packets").alias("p")).select("flow_id", F.lit("attention"), F.col("p.seq").cast("string"), F.round("p.attention", 6))
    return packets.unionAll(techniques).unionAll(totals).unionAll(paths).unionAll(drops).unionAll(attention)


def log_sealed(spark: SparkSession, d: str) -> DataFrame:
    """Events in shards of a day that are sealed after 150 rows."""
    path = scratch(spark, "sealed-log")
    stores.append_log(table(spark, d, "events").select("ts", "event_id"), path, shard_hours=24, most_rows=150, key="event_id")
    return stores.read_log(spark, path, "event_id long").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def stream_hot_flows(spark: SparkSession, d: str) -> DataFrame:
    """What the hot buffer holds of each flow id after all packets: those of its last hour, at most 5."""
    p = packet_events(_streamed(spark, d, "packet_event")).select(F.col("fid").alias("flow_id"), "at_ms", F.col("event_seq").alias("seq"), F.coalesce("payload", F.lit(0).cast("long")).alias("size"))
    return _drain(spark, hot_flows(p, 3_600_000, 5), "stream-hot")


def sparsity_scores(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("context_id")
    return table(spark, d, "flow_context").select("context_id", F.round(reports.sparsity(i % 7, i % 13), 6).alias("sparsity"))


def technique_drops(spark: SparkSession, d: str) -> DataFrame:
    """Counterfactual drops of the packets of flows, summed by the techniques of the flows' rules."""
    p = materialize(views.packets(spark, d), "packets")
    f = materialize(flows.assign_flows(p), "flowed")
    drops = reports.leave_one_out(f.withColumn("v", F.col("payload_len").cast("double")), "flow_id", "v")
    rules = flows.flow_consensus(flows.flow_features(f, {"": 60.0}, packets=p)).select("flow_id", "technique")
    out = reports.drop_per_technique(drops.withColumn("drop", F.abs("drop")), f.select("seq", "flow_id").join(rules, "flow_id"))
    return out.withColumn("drop", F.round("drop", 4))


def standardized(spark: SparkSession, d: str) -> DataFrame:
    """Packets of flow contexts less their mean, over their deviation."""
    c = table(spark, d, "flow_context").where("packet_count is not null").select("context_id", F.col("packet_count").cast("double").alias("packets"))
    stats = {r["feature"]: (r["mean"], r["std"]) for r in splits.scaling(c, ["packets"]).collect()}
    return splits.standardize(c, ["packets"], stats).withColumn("packets", F.round("packets", 6))


def adjacency_stored(spark: SparkSession, d: str) -> DataFrame:
    """Edges of ten hosts read from a sorted store of all edges."""
    path = scratch(spark, "adjacency")
    e = materialize(_links(spark, d), "host-links")
    stores.write_adjacency(e.select(F.lit("talks").alias("rel"), "src", "dst", "n"), path)
    hosts = [r["src"] for r in e.select("src").distinct().orderBy("src").limit(10).collect()]
    return stores.neighbours_of(spark, path, "talks", hosts).select("src", "dst", "n")


def pending_items(spark: SparkSession, d: str) -> DataFrame:
    """Flow ids of records that no context covers yet: what a resumed run has to do."""
    todo = table(spark, d, "flow_state").select(canon.flow_id("flow_id").alias("fid")).where("fid is not null").distinct()
    return stores.pending(todo, table(spark, d, "flow_context").select(canon.flow_id("flow_id").alias("fid")), "fid")


def baseline_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees that tell attacks from benign flows by their vectors: fitted on the train split, scored on the others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = feature_rows(spark, d).withColumns({"v": array_to_vector("f"), "attack": (F.col("y") > 0).cast("double")})
    model = GBTClassifier(featuresCol="v", labelCol="attack", maxIter=20, maxDepth=4, stepSize=0.3, seed=1).fit(rows.where("split = 'train'"))
    got = model.transform(rows.where("split <> 'train'")).select("split", F.col("attack").cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
    return metrics.summary(metrics.scores(metrics.class_counts(got, "t", "p", ["split"])), ["split"])


def payload_vector_parts(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of every payload vector in figures: size, histogram total, entropy, printable and zero shares, hashed total, ordered total."""
    v = P.payload_vectors(payloads(spark, d), "doc_id", "payload")
    n = P.HISTOGRAM

    def total(first: int, size: int) -> F.Column:
        return F.round(F.aggregate(F.slice("vector", first, size), F.lit(0.0), lambda a, x: a + x.cast("double")), 4)

    def at(i: int) -> F.Column:
        return F.round(F.get("vector", F.lit(i)).cast("double"), 4)

    ordered = n + P.DERIVED + P.HASHED + P.STRUCTURE + 1
    return v.select(
        "doc_id", F.size("vector").alias("size"), total(1, n).alias("histogram"), at(n).alias("entropy"), at(n + 1).alias("printable"), at(n + 2).alias("zeros"),
        total(n + P.DERIVED + 1, P.HASHED).alias("hashed"), total(ordered, P.ORDERED).alias("ordered"),
    )


def flow_payload_parts(spark: SparkSession, d: str) -> DataFrame:
    """The mean payload vector of each flow in figures: mean entropy and mean share of the byte 0x20."""
    from skeinflow.plans.extra_queries import flow_payload_mean

    m = flow_payload_mean(spark, d)
    return m.select("flow", F.round(F.get("mean_vector", F.lit(P.HISTOGRAM)), 4).alias("entropy"), F.round(F.get("mean_vector", F.lit(0x20)), 4).alias("blanks"))


def rendered_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report of every flow's evidence bundle, by sections."""
    from skeinflow.plans.label_queries import evidence_bundles

    text = reports.render("flow_id", "src_ip", "dst_ip", "label", "n_packets", "packets", "techniques", "paths")
    return evidence_bundles(spark, d).select("flow_id", F.length(text).alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        report_validation, json_rows, request_collection, request_targets, anchor_statistics, anchor_quantiles, anchor_thresholds, class_families, row_graphs, bundle_parts, log_sealed, stream_hot_flows,
        sparsity_scores, technique_drops, standardized, adjacency_stored, pending_items, baseline_boosted, payload_vector_parts, flow_payload_parts, rendered_reports,
    )
}

_C = r"\[(?:E_[A-Z]+_\d{3}|E_ALERT|E_FLOW_\d{3})\]"


def _cut(t: str, after: bool) -> str:
    """Sentences: a citation after a full stop is held to it by one mark, then blanks after full stops become another."""
    held = f"regexp_replace(regexp_replace({t}, '^ +| +$', '', 'g'), '([.!?])\\s+({_C})', '\\1' || chr(57344) || '\\2', 'g')"
    stops = r"([.!?\]])\s+" if after else r"([.!?])\s+"
    return f"list_filter(list_transform(string_split(regexp_replace({held}, '{stops}', '\\1' || chr(57345), 'g'), chr(57345)), lambda s: replace(s, chr(57344), ' ')), lambda s: s <> '')"


def _words(t: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({t}, '{w}')" for w in words) + ")"


_KEY = "(" + _words("lower(s)", reports.KEY_WORDS) + f" or regexp_matches(s, '{reports.ADDRESS}|{reports.TECHNIQUE}|pkt_\\w+|flow_\\w+'))"
_CITES = "len(list_intersect(regexp_extract_all(s, '{c}'), ['[E_ALERT]', '[E_FLOW_001]'])) > 0".replace("{c}", _C)
_OK = "len(list_filter(numbers, lambda k: abs(v - k) <= 0.01 or abs(v / 100.0 - k) <= 0.01)) > 0"
_ANCH = f"""{_ED}, fd as (select doc_id, label, flow from lab where flow is not null), ev as (select fd.flow, ed.doc_id, round(weight, 4) as w from ed join fd on ed.doc_id = fd.doc_id),
 es as (select flow, count(distinct doc_id)::double as n_ev, sum(w) as sum_w, max(w) as max_w from ev group by 1),
 an as (select f.flow, coalesce(n_ev, 0.0)::double as n_ev, coalesce(n_ev, 0.0)::double / f.n as frac_ev, coalesce(sum_w, 0.0)::double as sum_w, coalesce(max_w, 0.0)::double as max_w, f.positive
   from (select flow, count(*) as n, bool_or(label = 'ticket') as positive from fd group by 1) f left join es on es.flow = f.flow)"""
_LONG = ", al as (" + " union all ".join(f"select '{a}' as anchor, positive, {a} as v from an" for a in ANCHORS) + ")"
_SHARE = "case when tp + {0} = 0 then 0.0 else round(tp / (tp + {0}), 6) end::double"
_FL = f"with {views.features_sql()}"
ORACLE = {
    "report_validation": f"""with x as (select doc_id, text || case when doc_id % 2 = 0 then ' [E_ALERT]' else '' end as t, kind, list_filter([{sqlkit.host('src_ip')}, {sqlkit.flow_id('flow_id')}], lambda e: e is not null) as entities,
        [443.0::double, doc_id % 100 / 100.0::double] as numbers from documents where text is not null),
      k as (select doc_id, entities, numbers, unnest(list_filter({_cut('t', False)}, lambda s: {_KEY})) as s from x),
      j as (select doc_id, len(list_filter(regexp_extract_all(s, '{reports.ENTITY}'), lambda e: not list_contains(entities, e))) > 0 as unknown, list_transform(regexp_extract_all(s, '{reports.NUMBER_NEAR}', 2), lambda v: v::double) as vs, {_CITES} as cited, numbers from k),
      g as (select doc_id, unknown, cited, case when unknown then 0 else len(vs) end as n, case when unknown then 0 else len(list_filter(vs, lambda v: {_OK})) end as ok from j),
      v as (select doc_id, cast(count(*) filter (where not unknown and ok = n and cited) as integer) as n_entailed, cast(count(*) filter (where unknown or ok < n) as integer) as n_contradicted,
        cast(count(*) filter (where not unknown and ok = n and not cited) as integer) as n_unsupported, cast(sum(n) as integer) as n_numbers, cast(sum(ok) as integer) as n_numbers_supported from g group by 1),
      y as (select doc_id, kind, entities, lower(t) as low, {_cut('t', True)} as ss, list_concat(list_concat(list_concat(regexp_extract_all(t, '{reports.ADDRESS}', 1), regexp_extract_all(t, '{reports.TECHNIQUE}')), list_concat(regexp_extract_all(t, 'pkt_\\w+'), regexp_extract_all(t, 'flow_\\w+'))),
        list_concat(regexp_extract_all(t, '{reports.PORTS[0]}', 1), regexp_extract_all(t, '{reports.PORTS[1]}', 1))) as named from x),
      z as (select doc_id, coalesce(round(len(list_filter(ss, lambda s: {_KEY} and {_CITES})) / nullif(len(list_filter(ss, lambda s: {_KEY})), 0)::double, 6), 1.0) as grounding_rate, len(list_filter(list_distinct(named), lambda e: not list_contains(entities, e)))::integer as n_unknown_entities,
        len(list_filter(ss, lambda s: ({_words('lower(s)', reports.OVERCLAIM)} or regexp_matches(lower(s), '{reports.OVERCLAIM_PATTERN}')) and not {_CITES}))::integer as n_overclaims,
        not coalesce(kind = 'card', false) or {_words('low', reports.CAUTION)} as caution_pass, not {_words('low', reports.BLOCKED)} and not regexp_matches(low, '{reports.BLOCKED_PATTERN}') as safety_pass from y)
      select z.doc_id, coalesce(n_entailed, 0) as n_entailed, coalesce(n_contradicted, 0) as n_contradicted, coalesce(n_unsupported, 0) as n_unsupported, coalesce(n_numbers, 0) as n_numbers, coalesce(n_numbers_supported, 0) as n_numbers_supported,
        grounding_rate, n_unknown_entities, n_overclaims, caution_pass, safety_pass, grounding_rate >= 0.9 and n_unknown_entities = 0 and n_overclaims = 0 and caution_pass and safety_pass as overall_pass from z left join v on v.doc_id = z.doc_id""",
    "report_claims": f"""with x as (select coalesce(nullif(lower(trim(kind)), ''), 'none') as label, unnest({_cut('text', False)}) as c from documents where text is not null)
        select label, count(*) as n_claims, cast(sum(regexp_matches(c, '[0-9]')::int) as bigint) as with_numbers, max(strlen(c)) as longest from x group by 1""",
    "payload_vector_parts": f"""with {_HX}, {_BY}, c as (select doc_id, b, count(*) / max(n)::double as p from byt group by 1, 2), e as (select doc_id, -sum(p * log2(p + 1e-12)) as entropy, sum(case when b between 32 and 126 then p else 0 end) as printable, sum(case when b = 0 then p else 0 end) as zeros from c group by 1),
        o as (select doc_id, sum((b / 255.0::double)::float::double) filter (where i < 256) as s from byt group by 1)
        select hx.doc_id, 2579 as size, case when n > 0 then 1.0 else 0.0 end::double as histogram, round(coalesce(entropy, 0.0)::float::double, 4) + 0.0 as entropy, round(coalesce(printable, 0.0)::float::double, 4) as printable, round(coalesce(zeros, 0.0)::float::double, 4) as zeros,
        case when n > 3 then 1.0 else 0.0 end::double as hashed, round(coalesce(s, 0.0), 4) as ordered from hx left join e on e.doc_id = hx.doc_id left join o on o.doc_id = hx.doc_id""",
    "flow_payload_parts": f"""with {_HX}, {_BY}, c as (select doc_id, b, count(*) / max(n)::double as p from byt group by 1, 2), e as (select doc_id, (-sum(p * log2(p + 1e-12)))::float::double as entropy, coalesce(max(p) filter (where b = 32), 0.0)::float::double as blanks from c group by 1)
        select flow, round(avg(coalesce(entropy, 0.0)), 4) as entropy, round(avg(coalesce(blanks, 0.0)), 4) as blanks from hx left join e on e.doc_id = hx.doc_id where flow is not null group by 1""",
    "rendered_reports": f"""{_FL}, {RULES_SQL}, {CONSENSUS_SQL}, b as (select *, row_number() over (partition by flow_id order by payload_len desc, seq) as r, count(*) over (partition by flow_id) as n from flowed), top as (select * from b where r <= 5),
        nx as (select flow_id, lag(seq) over w as src, seq as dst from flowed window w as (partition by flow_id order by ts, seq)), px as (select flow_id, string_agg(src || ' to ' || dst, chr(10) order by src, dst) as t from nx where src in (select seq from top) and dst in (select seq from top) group by 1),
        pk as (select flow_id, string_agg('Packet ' || seq || ' carries ' || payload_len || ' bytes. [E_PKT_' || lpad(r::varchar, 3, '0') || ']', chr(10) order by r) as t from top group by 1),
        te as (select flow_id, string_agg('Technique ' || technique || ' has weight ' || printf('%.2f', weight) || '. [E_MITRE_' || lpad(i::varchar, 3, '0') || ']', chr(10) order by i) as t from (select *, row_number() over (partition by flow_id order by technique, weight) as i from consensus) group by 1),
        hd as (select flow_id, arg_min(src_ip, (ts, seq)) as s, arg_min(dst_ip, (ts, seq)) as d, arg_min(label, (ts, seq)) as l, count(*) as n from flowed group by 1),
        tx as (select hd.flow_id, 'SUMMARY' || chr(10) || 'Flow ' || hd.flow_id || ' from ' || s || ' to ' || d || ' was labelled ' || l || ' after ' || n || ' packets. [E_FLOW_001]' || chr(10) || 'EVIDENCE' || chr(10) || pk.t
          || coalesce(chr(10) || 'TECHNIQUES' || chr(10) || te.t || chr(10) || 'This is statistical evidence, not a signature.', '') || coalesce(chr(10) || 'PATHS' || chr(10) || px.t, '') as x from hd join pk on pk.flow_id = hd.flow_id left join te on te.flow_id = hd.flow_id left join px on px.flow_id = hd.flow_id)
        select flow_id, length(x) as n_chars, md5(x) as text_md5 from tx""",
    "sparsity_scores": "select context_id, round(case when context_id % 13 = 0 then 0.0 else 1.0::double - least(context_id % 7, context_id % 13)::double / (context_id % 13) end, 6) as sparsity from flow_context",
    "technique_drops": f"""{_FL}, {RULES_SQL}, {CONSENSUS_SQL}, b as (select seq, flow_id, payload_len::double as v, count(*) over (partition by flow_id) as n, sum(payload_len::double) over (partition by flow_id) as s from flowed)
        select technique, round(sum(abs(case when n > 1 then s / n - (s - v) / (n - 1) else 0.0 end)), 4) as drop, count(*) as n_items from b join (select distinct flow_id, technique from consensus) c on c.flow_id = b.flow_id group by 1""",
    "standardized": "with c as (select context_id, packet_count::double as p from flow_context where packet_count is not null) select context_id, round((p - (select avg(p) from c)) / greatest((select stddev_pop(p) from c), 1e-6), 6) as packets from c",
    "adjacency_stored": f"with {_LK} select src, dst, n from lk where src in (select distinct src from lk order by src limit 10)",
    "pending_items": f"select distinct {sqlkit.flow_id('flow_id')} as fid from flow_state where {sqlkit.flow_id('flow_id')} is not null and {sqlkit.flow_id('flow_id')} not in (select {sqlkit.flow_id('flow_id')} from flow_context where {sqlkit.flow_id('flow_id')} is not null)",
    "json_rows": """with j as (select context_id, '{"context_id":' || context_id || ',"packet_count":' || coalesce(packet_count, 0) || ',"timed":' || case when not isnan(duration_seconds) and abs(duration_seconds) < 1e12 then 'true' else 'false' end || '}' as json from flow_context)
        select context_id, json, '{}' as left_out, greatest(length(json) // 4, 1)::bigint as n_tokens from j""",
    "request_collection": "select doc_id, 'GET /case/' || doc_id || ' HTTP/1.1' as line, coalesce(source, '-') as host from documents where text is not null and doc_id % 5 <> 0",
    "request_targets": f"select {sqlkit.host('src_ip')} as target, cast(doc_id % 3 + 80 as integer) as port, count(*) as n_requests, count(distinct coalesce(source, '-')) as n_hosts from documents where text is not null and doc_id % 5 <> 0 group by 1, 2",
    "anchor_statistics": f"{_ANCH} select flow, round(n_ev, 4) as n_ev, round(frac_ev, 4) as frac_ev, round(sum_w, 4) as sum_w, round(max_w, 4) as max_w, positive from an",
    "anchor_quantiles": f"{_ANCH}{_LONG}, ps as (select unnest([{', '.join(f'{p}::double' for p in ANCHOR_PROBS)}]) as prob), rk as (select *, row_number() over (partition by anchor, positive order by v) as r, count(*) over (partition by anchor, positive) as n from al), nr as (select anchor, positive, prob, n, min(v) as a, max(v) as b from rk, ps where r = floor(prob * (n - 1)) + 1 or r = least(floor(prob * (n - 1)) + 2, n) group by 1, 2, 3, 4) select anchor, positive, prob, round(a + (b - a) * (prob * (n - 1) - floor(prob * (n - 1))), 4) as value from nr",
    "anchor_thresholds": f"{_ANCH}{_LONG}, t as (select unnest([0.05, 0.1, 0.2, 0.5, 1, 2, 3, 5, 8, 13, 21]::double[]) as threshold), c as (select anchor, threshold, count(*) filter (where round(v, 4) >= threshold and positive) as tp, count(*) filter (where round(v, 4) >= threshold and not positive) as fp, count(*) filter (where round(v, 4) < threshold and positive) as fn from al, t group by 1, 2) select anchor, threshold, tp, fp, fn, {_SHARE.format('fp')} as precision, {_SHARE.format('fn')} as recall from c",
    "class_families": """with kd(label, c) as (values ('card', 4), ('digest', 5), ('graph_text', 6), ('note', 7), ('report', 8), ('runbook', 9), ('ticket', 10)),
        m as (select kd.label, family, sum(1.0::double - class_id * 0.01::double) as mass from traffic_class t join kd on kd.c = 4 + (t.class_id - 4) % 7 and t.class_id >= 4 where technique_id is not null and family is not null group by 1, 2)
        select label, family, round(mass, 6) as mass from (select *, row_number() over (partition by label order by mass desc, family) as r from m) where r = 1""",
    "row_graphs": f"""with {views.flowed_sql()}, p as (select *, cast(round(ts * 1000) as bigint) as t_ms from flowed)
        select flow_id, cast(row_number() over w - 1 as integer) as pos, is_fwd::int as dir, ip_len, ip_len - 20 - payload_len as transport, payload_len as payload, coalesce(lead(t_ms) over w - t_ms, 0) as gap_ms from p window w as (partition by flow_id order by t_ms, seq)""",
    "log_sealed": """with r as (select event_id, date_trunc('day', ts) as day, (row_number() over (partition by date_trunc('day', ts) order by ts, event_id) - 1) // 150 as part from events)
        select strftime(day, '%Y%m%dT%HZ') || case when part > 0 then '-' || lpad(part::varchar, 4, '0') else '' end as shard, count(*) as n, min(event_id) as first, max(event_id) as last from r group by 1""",
    "stream_hot_flows": f"""with pe as ({sqlkit.packet_event()}), k as (select fid as flow_id, at_ms, event_seq as seq, case when payload_len_raw >= 0 then payload_len_raw else 0 end as size, max(at_ms) over (partition by fid) as newest, count(*) over (partition by fid) as n from pe where fid is not null and at_ms is not null),
        r as (select *, row_number() over (partition by flow_id order by at_ms desc, seq desc) as r from k where at_ms > newest - 3600000)
        select flow_id, count(*) as n_held, cast(sum(size) as bigint) as bytes_held, min(at_ms) as oldest_ms, max(at_ms) as newest_ms, max(n) - count(*) as n_dropped from r where r <= 5 group by 1""",
    "bundle_parts": f"""{_FL}, {RULES_SQL}, {CONSENSUS_SQL}, b as (select *, row_number() over (partition by flow_id order by payload_len desc, seq) as r, count(*) over (partition by flow_id) as n, sum(payload_len::double) over (partition by flow_id) as s,
          (1 + payload_len::double) / sum(1 + payload_len::double) over (partition by flow_id) as att from flowed),
        top as (select * from b where r <= 5), nx as (select flow_id, lag(seq) over w as src, seq as dst, ts - lag(ts) over w as dt from flowed window w as (partition by flow_id order by ts, seq))
        select flow_id, 'packet' as part, seq::varchar as ref, payload_len::double as value from top
        union all select flow_id, 'technique', technique, round(weight, 6) from consensus
        union all select flow_id, 'packets', null, count(*)::double from flowed group by 1 union all select flow_id, 'bytes', null, sum(ip_len)::double from flowed group by 1
        union all select nx.flow_id, 'path', src || '>' || dst, round(dt, 3) from nx where src in (select seq from top) and dst in (select seq from top)
        union all select flow_id, 'drop', seq::varchar, round(case when n > 1 then s / n - (s - payload_len) / (n - 1) else 0.0 end, 6) from top
        union all select flow_id, 'attention', seq::varchar, round(att, 6) from top""",
}
