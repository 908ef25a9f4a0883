"""Queries of stores, scores and references that fit no other module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.functions import payload as P
from skeinflow.operators import metrics, reports
from skeinflow.plans import sqlkit
from skeinflow.plans.graph_queries import _CONS, soft_targets
from skeinflow.plans.label_queries import _states
from skeinflow.plans.text_queries import payloads
from skeinflow.sources import knowledge, stores
from skeinflow.sources.tables import table


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Flow records after upserting the later half of exports into the earlier: one row per flow id, the latest export."""
    s = table(spark, d, "flow_state").select(canon.flow_id("flow_id").alias("fid"), "state_id", "packet_count", F.struct("exported_at", "state_id").alias("version"))
    s = s.where("fid is not null")
    out = stores.upsert(s.where("state_id % 2 = 0"), s.where("state_id % 2 = 1"), "fid", "version")
    return out.select("fid", "state_id", "packet_count")


def technique_rank(spark: SparkSession, d: str) -> DataFrame:
    """Score of techniques within their family from flow counts, packets and distinct sources."""
    t = table(spark, d, "traffic_class").where("technique_id is not null").select("label", "family", F.col("technique_id").alias("technique"))
    n = _states(spark, d).join(t, "label").groupBy("family", "technique").agg(F.count(F.lit(1)).alias("w"), F.sum("packet_count").alias("s"), F.count_distinct("src_host").alias("c"))
    return reports.technique_scores(n, "family", "w", "s", "c").select("family", "technique", F.round("score", 6).alias("score"))


def soft_target_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per label: flows, flows whose target moves to benign (beta under 0.5), and mean beta."""
    b = soft_targets(spark, d).join(_states(spark, d).select(F.col("state_id").alias("node"), "label"), "node")
    return b.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("beta") < 0.5).cast("long")).alias("relabelled"), F.round(F.avg("beta"), 5).alias("mean_beta"))


def technique_reference(spark: SparkSession, d: str) -> DataFrame:
    """Labels of flow records that the class table does not know."""
    used = _states(spark, d).select(F.coalesce("label", F.lit("(none)")).alias("label"))
    return knowledge.missing_techniques(used, table(spark, d, "traffic_class"), "label")


def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Entities a document cites against the endpoints of its own flow."""
    docs = payloads(spark, d).select("doc_id", "flow", reports.named_entities("text").alias("cited"))
    ends = _states(spark, d).where("fid is not null").groupBy(F.col("fid").alias("flow")).agg(F.min("src_host").alias("s"), F.min("dst_host").alias("t"))
    rows = docs.join(ends, "flow", "left")
    own = F.filter(F.array("s", "t", "flow"), lambda x: x.isNotNull())
    scores = reports.citation_scores(F.col("cited"), own, own)
    return rows.select("doc_id", *[F.round(c, 6).alias(n) for n, c in scores.items()])


def payload_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Payloads given as hexadecimal text in some rows and as plain text in others."""
    docs = payloads(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.hex("payload"), F.lit("F"))).alias("payload_hex"), "text")
    return docs.select("doc_id", F.length(P.from_aliases(docs, ("payload",), ("payload_hex",), ("text",))).cast("long").alias("n_bytes"), F.md5(P.from_aliases(docs, ("payload",), ("payload_hex",), ("text",))).alias("md5"))


def padded_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with padding taken off again by their stated length."""
    docs = payloads(spark, d).select("doc_id", F.length("payload").alias("n"), F.concat("payload", F.unhex(F.lit("00000000"))).alias("padded"))
    return docs.select("doc_id", F.md5(P.padded_payload("padded", "n")).alias("md5"))


def mean_ci(spark: SparkSession, d: str) -> DataFrame:
    """Mean packets per flow record of each label with its interval."""
    return metrics.bootstrap_mean(_states(spark, d), "label", "packet_count")


def flow_payload_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean payload vector of each flow's documents."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    docs = payloads(spark, d)
    v = P.payload_vectors(docs, "doc_id", "payload").join(docs.select("doc_id", "flow").where("flow is not null"), "doc_id")
    return v.groupBy("flow").agg(Summarizer.mean(array_to_vector("vector")).alias("m")).select("flow", vector_to_array("m").alias("mean_vector"))


QUERIES = {f.__name__: f for f in (latest_state, technique_rank, soft_target_stats, technique_reference, citation_scores, payload_aliases, padded_payloads, mean_ci, flow_payload_mean)}


def _mm(c: str) -> str:
    return f"(case when max({c}) over e > min({c}) over e then ({c} - min({c}) over e)::double / (max({c}) over e - min({c}) over e) else 0.0 end)"


_BETA = f"""with {_CONS}, r as (select st.state_id as node, st.label, t.class_id, case when t.class_id not in (7, 8, 9, 10) then 1.0 when st.packet_count - 4 > 0 then 1.0 else 0.0 end::double as support, con.consensus,
 (st.state_id * (t.class_id + 1) % 17) / 17.0::double as po, (st.state_id % 17) / 17.0::double as pb from st join traffic_class t on st.label = t.label join con on con.node = st.state_id),
 b as (select label, round(case when class_id in (7, 8, 9, 10) and support = 0 then pow(greatest(1e-8, least(1.0, po / greatest(po + pb, 1e-12))), 0.7::double) * pow(greatest(1e-8, least(1.0, consensus)), 1 - 0.7::double) else 1.0 end, 6) as beta from r)"""
_ST = _CONS.split(", fl as (")[0]
ORACLE = {
    "latest_state": f"select {sqlkit.flow_id('flow_id')} as fid, arg_max(state_id, (exported_at, state_id)) as state_id, arg_max(packet_count, (exported_at, state_id)) as packet_count from flow_state where {sqlkit.flow_id('flow_id')} is not null group by 1",
    "technique_rank": f"with {_ST}, n as (select t.family, t.technique_id as technique, count(*) as w, sum(packet_count)::bigint as s, count(distinct src_host) as c from st join traffic_class t on st.label = t.label where t.technique_id is not null group by 1, 2) select family, technique, round({_mm('w')} * 0.5::double + {_mm('s')} * 0.3::double + {_mm('c')} * 0.2::double, 6) as score from n window e as (partition by family)",
    "soft_target_stats": f"{_BETA} select label, count(*) as n, count(*) filter (where beta < 0.5) as relabelled, round(avg(beta), 5) as mean_beta from b group by 1",
    "technique_reference": f"with {_ST} select distinct coalesce(label, '(none)') as label from st where coalesce(label, '(none)') not in (select label from traffic_class)",
    "citation_scores": f"with {_ST}, x as (select doc_id, {sqlkit.flow_id('flow_id')} as flow, list_concat(regexp_extract_all(text, '\\b(flow_\\w+)', 1), regexp_extract_all(text, '\\b(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\b', 1)) as l from documents where text is not null), m as (select distinct doc_id, lower(e) as e from (select doc_id, unnest(l) as e from x)), en as (select fid as flow, min(src_host) as s, min(dst_host) as t from st where fid is not null group by 1), o as (select doc_id, x.flow as a, s as b, t as c from x left join en on x.flow = en.flow), ow as (select distinct doc_id, unnest([a, b, c]) as e from o), own as (select * from ow where e is not null), k as (select o.doc_id, (select count(*) from own where own.doc_id = o.doc_id) as n_own, (select count(*) from m where m.doc_id = o.doc_id) as n_cited, (select count(*) from m join own on m.doc_id = own.doc_id and m.e = own.e where m.doc_id = o.doc_id) as n_both from o) select doc_id, round(case when n_own = 0 then 1.0 else n_both / n_own end, 6) as coverage, round(case when n_cited = 0 then 0.0 else n_both / n_cited end, 6) as plausibility from k",
    "payload_aliases": "select doc_id, octet_length(encode(text)) as n_bytes, md5(text) as md5 from documents where text is not null",
    "padded_payloads": "select doc_id, md5(text) as md5 from documents where text is not null",
}
