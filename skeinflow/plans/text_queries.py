"""Queries of payload features and evidence, over the whole texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import canon
from skeinflow.functions import payload as P
from skeinflow.operators import evidence as E
from skeinflow.operators.pmi_training import fit_table, presence_rows
from skeinflow.plans import sqlkit
from skeinflow.session import materialize, spread
from skeinflow.sources.tables import table


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as payloads: doc_id, label (their kind), flow (canonical flow id), text and its UTF-8 bytes."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return spread(docs.select("doc_id", canon.label("kind", "none").alias("label"), canon.flow_id("flow_id").alias("flow"), "text")).withColumn("payload", F.encode("text", "UTF-8"))


def tokens_capped(spark: SparkSession, d: str) -> DataFrame:
    rows = payloads(spark, d).select("doc_id", P.tokens("payload").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def _supported(spark: SparkSession, d: str, kind: str, least: int) -> DataFrame:
    rows = P.token_counts(payloads(spark, d), "label", "payload", (kind,))
    return rows.groupBy("token").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= least)


def token_b4(spark: SparkSession, d: str) -> DataFrame:
    return _supported(spark, d, "b4", 50)


def token_b8(spark: SparkSession, d: str) -> DataFrame:
    return _supported(spark, d, "b8", 10)


def token_text(spark: SparkSession, d: str) -> DataFrame:
    return _supported(spark, d, "t", 1)


def printable_ratio(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("doc_id", F.round(P.printable_ratio("payload"), 6).alias("ratio"))


def byte_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.byte_counts(payloads(spark, d), "doc_id", "payload")


def byte_entropy(spark: SparkSession, d: str) -> DataFrame:
    p = P.byte_profile(P.byte_counts(payloads(spark, d), "doc_id", "payload"), "doc_id")
    return p.select("doc_id", *[F.round(c, 6).alias(c) for c in ("entropy", "printable", "zeros")])


def hash_ngram(spark: SparkSession, d: str) -> DataFrame:
    h = P.hashed_grams(payloads(spark, d), "doc_id", "payload")
    return h.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("share"), 6).alias("share"))


def ordered_bytes(spark: SparkSession, d: str) -> DataFrame:
    v = payloads(spark, d).select("doc_id", P.ordered_bytes("payload").alias("v"))
    return v.select("doc_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("v", 1), 6).alias("first"))


def http_structure(spark: SparkSession, d: str) -> DataFrame:
    rows = payloads(spark, d).select("doc_id", F.encode(F.concat(F.lit("POST /case?id="), F.col("doc_id").cast("string"), F.lit("&lang=x HTTP/1.1\r\nContent-Type: text/plain\r\n\r\n"), F.col("text")), "UTF-8").alias("payload"))
    return rows.select("doc_id", *[c.alias(n) for n, c in P.http_structure("payload").items()], P.longest_run("payload").cast("double").alias("max_run_repeated_byte"))


def payload_vector(spark: SparkSession, d: str) -> DataFrame:
    return P.payload_vectors(payloads(spark, d), "doc_id", "payload")


def payload_preview(spark: SparkSession, d: str) -> DataFrame:
    hexed, ascii_ = P.preview("payload", 16)
    return payloads(spark, d).select("doc_id", hexed.alias("hex"), ascii_.alias("ascii"))


def payload_signatures(spark: SparkSession, d: str) -> DataFrame:
    return E.payload_signatures(payloads(spark, d), "doc_id", "payload").select("doc_id", "technique", F.round("weight", 6).alias("weight"))


def counted_tokens(spark: SparkSession, d: str) -> DataFrame:
    """token, label, n_tc over every byte gram and text token of every document, none cut off."""
    return P.token_counts(payloads(spark, d), "label", "payload").withColumnRenamed("n", "n_tc")


def table_tokens(spark: SparkSession, d: str, table: DataFrame) -> DataFrame:
    """doc_id, token: the tokens of every document that a token table knows. The table is the model, so its vocabulary may go to the workers."""
    return P.token_rows(payloads(spark, d), ["doc_id"], "payload", only=E.vocabulary(table))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return E.pmi_candidates(counted_tokens(spark, d), _classes(spark, d))


def pmi_counts(spark: SparkSession, d: str) -> DataFrame:
    return counted_tokens(spark, d)


def pmi_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("token", "label", "n_tc", "n_t", F.round("pmi", 6).alias("pmi"))


def pmi_topk(spark: SparkSession, d: str) -> DataFrame:
    rounded = _candidates(spark, d).withColumn("pmi", F.round("pmi", 6))
    return E.top_per_class(rounded, 20).select("token", "label", "pmi", "rank")


def class_map(spark: SparkSession, d: str) -> DataFrame:
    """label, technique, family, map_weight: kinds stand for the traffic class of their alphabetical place."""
    kinds = ("card", "digest", "graph_text", "note", "report", "runbook", "ticket")
    place = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.pmod(F.col("class_id") - 4, F.lit(7)) + 1)
    place = F.when(F.col("class_id") >= 4, place)
    rows = table(spark, d, "traffic_class").where("technique_id is not null").select(place.alias("label"), F.col("technique_id").alias("technique"), "family", (F.lit(1.0) - F.col("class_id") * 0.01).alias("map_weight"))
    return rows.where("label is not null")


def _pmi_table(spark: SparkSession, d: str) -> DataFrame:
    coefs = _candidates(spark, d).select("token", "label", (F.round("pmi", 6) * 0.2).alias("coef"))
    return E.project_to_techniques(coefs, class_map(spark, d))


def pmi_projection(spark: SparkSession, d: str) -> DataFrame:
    return _pmi_table(spark, d).withColumn("weight", F.round("weight", 6))


def family_filter(spark: SparkSession, d: str) -> DataFrame:
    return E.family_specific(_pmi_table(spark, d).withColumn("weight", F.round("weight", 6)), 0.9)


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "traffic_class").where("technique_id is not null").select(F.lower("label").alias("pattern"), F.col("technique_id").alias("technique"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    patterns = [r["pattern"] for r in dictionary(spark, d).collect()]  # fixed reference table of 14 rows
    return E.literal_hits(payloads(spark, d), "doc_id", "text", patterns)


def literal_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


def literal_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.literal_weights(_hits(spark, d), "doc_id", dictionary(spark, d)).withColumn("weight", F.round("weight", 6))


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, technique, weight from the labels of the document's flow records."""
    states = table(spark, d, "flow_state").select(canon.flow_id("flow_id").alias("flow"), canon.label("label").alias("label"), "packet_count")
    tc = table(spark, d, "traffic_class").where("technique_id is not null").select("label", F.col("technique_id").alias("technique"))
    per = states.join(tc, "label").groupBy("flow", "technique").agg(F.least(F.lit(1.0), F.sum("packet_count") / 40.0).alias("weight"))
    return payloads(spark, d).select("doc_id", "flow").join(per, "flow").select("doc_id", "technique", "weight")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    weights = materialize(family_filter(spark, d), "token-table")
    pmi = E.pmi_hits(table_tokens(spark, d, weights), "doc_id", weights)
    literals = E.literal_weights(_hits(spark, d), "doc_id", dictionary(spark, d))
    families = table(spark, d, "traffic_class").where("technique_id is not null").select(F.col("technique_id").alias("technique"), "family")
    return E.vote(pmi, literals, _consensus(spark, d), families, "doc_id")


def evidence_vote(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("weight", F.round("weight", 4))


def evidence_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.typed_edges(_edges(spark, d)).groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    flows = payloads(spark, d).select("doc_id", "flow").where("flow is not null")
    s = E.evidence_summary(_edges(spark, d).join(flows, "doc_id"), "flow")
    return s.withColumns({c: F.round(c, 6) for c in ("ev_max_weight", "ev_sum_log1p_weight")})


def evidence_by_flow_family(spark: SparkSession, d: str) -> DataFrame:
    flows = payloads(spark, d).select("doc_id", "flow").where("flow is not null")
    out = E.by_family(_edges(spark, d).join(flows, "doc_id"), "flow")
    return out.withColumns({c: F.round(c, 6) for c in E.EDGE_FAMILIES})


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = E.coverage(payloads(spark, d), _edges(spark, d), "doc_id", "label")
    return out.withColumns({c: F.round(c, 6) for c in E.EDGE_FAMILIES})


def pmi_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The matched tokens of each document and technique, with their number and their digest in order."""
    weights = materialize(family_filter(spark, d), "token-table")
    m = E.pmi_provenance(table_tokens(spark, d, weights), "doc_id", weights)
    return m.select("doc_id", "technique", F.size("matched").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("matched", lambda x: x["token"]), " ").cast("binary")).alias("tokens_md5"))


def l1_logistic_pmi(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of every PMI candidate, whatever its frequency."""
    candidates = materialize(_candidates(spark, d), "l1-candidates")
    rows = presence_rows(payloads(spark, d).select("doc_id", "label"), table_tokens(spark, d, candidates), "doc_id", candidates)
    return E.l1_logistic(rows, "tokens", "label", vocabulary=candidates)


def l1_projection(spark: SparkSession, d: str) -> DataFrame:
    """The fit projected to techniques, and its family-specific rows."""
    return E.family_specific(E.project_to_techniques(l1_logistic_pmi(spark, d), class_map(spark, d)), 0.9)


def pmi_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole training: subsample, counts, candidates, L1 fit, projection and family filter."""
    return fit_table(payloads(spark, d).select("doc_id", "label", "payload"), "doc_id", class_map(spark, d))[0]


QUERIES = {
    f.__name__: f
    for f in (
        tokens_capped, token_b4, token_b8, token_text, printable_ratio, byte_histogram, byte_entropy, hash_ngram, ordered_bytes, http_structure, payload_vector, payload_preview,
        payload_signatures, pmi_counts, pmi_candidates, pmi_topk, pmi_projection, family_filter, literal_hits, literal_weights, evidence_vote, evidence_edges, evidence_summary,
        evidence_by_flow_family, evidence_coverage, pmi_provenance, l1_logistic_pmi, l1_projection, pmi_table,
    )
}

_HX = "hx as (select doc_id, coalesce(nullif(lower(trim(kind)), ''), 'none') as label, {fid} as flow, text, lower(hex(encode(text))) as h, octet_length(encode(text)) as n, regexp_extract_all(lower(hex(encode(text))), '..') as l from documents where text is not null)".format(fid=sqlkit.flow_id("flow_id"))
_B4 = "b4 as (select doc_id, 1 as k, i, 'b4:' || l[i + 1] || l[i + 2] || l[i + 3] || l[i + 4] as token from (select doc_id, l, unnest(range(greatest(n - 3, 0))) as i from hx))"
_B8 = "b8 as (select doc_id, 2 as k, i, 'b8:' || l[i + 1] || l[i + 2] || l[i + 3] || l[i + 4] || l[i + 5] || l[i + 6] || l[i + 7] || l[i + 8] as token from (select doc_id, l, unnest(range(0, greatest(n - 7, 0), 4)) as i from hx))"
_BY = "byt as (select doc_id, n, i, (strpos('0123456789abcdef', x[1]) - 1) * 16 + strpos('0123456789abcdef', x[2]) - 1 as b from (select doc_id, n, i, l[i + 1] as x from (select doc_id, l, n, unnest(range(n)) as i from hx)))"
_LAT = "lat as (select doc_id, max(n) as n, string_agg(chr((case when b = 0 then 1 else b end)::integer), '' order by i) as s, sum(case when (b >= 32 and b <= 126) or b in (9, 10, 13) then 1 else 0 end) as p from byt group by doc_id)"
_TT = "tt as (select doc_id, 3 as k, j as i, 't:' || w[j + 1] as token from (select doc_id, w, unnest(range(len(w))) as j from (select doc_id, regexp_split_to_array(lower(s), '[ \\t\\r\\n?&=/]+') as w from lat where p::double / n > 0.7)) where length(w[j + 1]) between 2 and 64)"
_TD = "td as (select distinct doc_id, token from (select doc_id, token from b4 union all select doc_id, token from b8 union all select doc_id, token from tt)), lab as (select doc_id, label, flow from hx), tc as (select t.token, d.label, count(*) as n_tc from td t join lab d on t.doc_id = d.doc_id group by 1, 2)"
_T = f"with {_HX}, {_B4}, {_B8}, {_BY}, {_LAT}, {_TT}, {_TD}"
_CAND = ", nt as (select *, cast(sum(n_tc) over (partition by token) as bigint) as n_t from tc), cl as (select label, count(*) as n_c from hx group by 1), cand as (select token, nt.label, n_tc, n_t, round(ln(n_tc * (select sum(n_c) from cl)::double / (n_t::double * n_c)), 6) as pmi from nt join cl on nt.label = cl.label where n_t >= 50 and n_tc >= 5 and ln(n_tc * (select sum(n_c) from cl)::double / (n_t::double * n_c)) >= 1.0)"
_KINDS = "('card', 4), ('digest', 5), ('graph_text', 6), ('note', 7), ('report', 8), ('runbook', 9), ('ticket', 10)"
_PROJ = f", kd(label, c) as (values {_KINDS}), cm as (select (select min(label) from kd where kd.c = 4 + (c.class_id - 4) % 7 and c.class_id >= 4) as label, technique_id as technique, family, 1.0::double - c.class_id * 0.01::double as map_weight from traffic_class c where technique_id is not null), proj as (select token, technique, family, round(greatest(-1.0, least(1.0, sum(pmi * 0.2::double * map_weight))), 6) as weight from cand join cm on cand.label = cm.label where cm.label is not null group by 1, 2, 3), proj2 as (select * from proj where abs(weight) >= 0.01)"
_FAM = ", fw as (select *, sum(abs(weight)) over (partition by token, family) as fw from proj2), fm as (select *, max(fw) over (partition by token) as m from fw), spec as (select token, technique, family, weight from fm where fw >= 0.9::double * m)"
_LITS = ", dict as (select lower(label) as pattern, technique_id as technique from traffic_class where technique_id is not null), lh as (select doc_id, pattern, technique from hx join dict on contains(lower(text), pattern)), lw as (select doc_id, technique, least(1.0, 0.4::double * count(distinct pattern)) as weight from lh group by 1, 2)"
_VOTE = f""", ph as (select doc_id, technique, min(family) as family, least(1.0, sum(weight)) as weight from td join spec on td.token = spec.token group by 1, 2),
 st as (select {sqlkit.flow_id('flow_id')} as flow, nullif(lower(trim(label)), '') as label, packet_count from flow_state),
 pf as (select flow, technique_id as technique, least(1.0, sum(packet_count) / 40.0::double) as weight from st join traffic_class t on st.label = t.label where technique_id is not null group by 1, 2),
 con as (select doc_id, technique, weight from lab join pf on lab.flow = pf.flow),
 jn as (select coalesce(ph.doc_id, lw.doc_id) as doc_id, coalesce(ph.technique, lw.technique) as technique, ph.family as pfam, coalesce(ph.weight, 0.0)::double as p, coalesce(lw.weight, 0.0)::double as li from ph full join lw on ph.doc_id = lw.doc_id and ph.technique = lw.technique),
 vt as (select jn.doc_id, jn.technique, coalesce(pfam, t.family) as family, least(1.0, (p * 0.55::double + li * 0.45::double) * (case when coalesce(con.weight, 0) > 0.1 then 1.2::double else 1.0 end) * (case when p > 0.1 and li > 0.1 then 1.3::double else 1.0 end)) as weight, (p > 0.1)::int + (li > 0.1)::int as v
   from jn left join con on con.doc_id = jn.doc_id and con.technique = jn.technique left join traffic_class t on t.technique_id = jn.technique),
 ed as (select doc_id, technique, family, weight from vt where v > 0 and weight >= 0.4 and family is not null)"""
_ED = _T + _CAND + _PROJ + _FAM + _LITS + _VOTE
_FAMS = E.EDGE_FAMILIES


def _support(cte: str, name: str, least: int) -> str:
    return f"with {_HX}, {cte} select token, count(distinct doc_id) as n_docs from {name} group by 1 having count(distinct doc_id) >= {least}"


_HTTP = "with p as (select doc_id, 'POST /case?id=' || doc_id || '&lang=x HTTP/1.1' || chr(13) || chr(10) || 'Content-Type: text/plain' || chr(13) || chr(10) || chr(13) || chr(10) || text as s from documents where text is not null), z as (select doc_id, s, regexp_extract_all(lower(hex(encode(s))), '..') as l, octet_length(encode(s)) as n from p), x as (select doc_id, i, l[i + 1] as c from (select doc_id, l, unnest(range(n)) as i from z)), r0 as (select doc_id, i, c, case when lag(c) over w = c then 0 else 1 end as f from x window w as (partition by doc_id order by i)), r1 as (select doc_id, sum(f) over (partition by doc_id order by i rows unbounded preceding) as g from r0), r2 as (select doc_id, g, count(*) as n from r1 group by 1, 2), r3 as (select doc_id, max(n) as m from r2 group by 1)"


def _cnt(cls: str) -> str:
    return f"(length(s) - length(regexp_replace(s, '{cls}', '', 'g')))::double"


_RULE_SQL = " union all ".join(
    f"select doc_id, '{t}' as technique, {w}::double as w from documents where text is not null and regexp_matches({'lower(text)' if 'lowercase' in c else 'text'}, '(?i){p.replace(chr(39), chr(39) * 2)}')"
    for t, p, c, w in E.PAYLOAD_RULES
)
ORACLE = {
    "tokens_capped": f"with {_HX}, {_B4}, {_B8}, {_BY}, {_LAT}, {_TT}, a as (select * from b4 union all select * from b8 union all select * from tt), f as (select doc_id, token, min(k * 1000000 + i) as o from a group by 1, 2), r as (select *, row_number() over (partition by doc_id order by o) as rn from f), g as (select doc_id, count(*) as n, md5(string_agg(token, ' ' order by o)) as m from r where rn <= 200 group by 1) select hx.doc_id, coalesce(g.n, 0) as n_tokens, coalesce(g.m, md5('')) as tokens_md5 from hx left join g on hx.doc_id = g.doc_id",
    "token_b4": _support(_B4, "b4", 50),
    "token_b8": _support(_B8, "b8", 10),
    "token_text": f"with {_HX}, {_BY}, {_LAT}, {_TT} select token, count(distinct doc_id) as n_docs from tt group by 1",
    "printable_ratio": f"with {_HX}, {_BY}, {_LAT} select hx.doc_id, round(p::double / lat.n, 6) as ratio from hx left join lat on hx.doc_id = lat.doc_id",
    "byte_histogram": f"with {_HX}, {_BY} select doc_id, cast(b as integer) as byte, count(*) as n from byt group by 1, 2",
    "byte_entropy": f"with {_HX}, {_BY}, c as (select doc_id, b, count(*) / max(n)::double as p from byt group by 1, 2) select doc_id, round(-sum(p * log2(p + 1e-12)), 6) as entropy, round(sum(case when b between 32 and 126 then p else 0 end), 6) as printable, round(sum(case when b = 0 then p else 0 end), 6) as zeros from c group by 1",
    "hash_ngram": f"with {_HX}, {_B4}, g as (select b4.doc_id, cast(('0x' || substr(md5(unhex(substr(token, 4))), 1, 8)) as bigint) % 2048 as bucket, hx.n - 3 as w from b4 join hx on b4.doc_id = hx.doc_id), s as (select doc_id, bucket, count(*)::double / max(w) as share from g group by 1, 2) select cast(bucket as integer) as bucket, count(*) as n_docs, round(sum(share), 6) as share from s group by 1",
    "ordered_bytes": f"with {_HX}, {_BY} select hx.doc_id, 256 as size, round(coalesce(sum(byt.b / 255.0::double) filter (where byt.i < 256), 0.0), 6) as total, round(coalesce(max(byt.b / 255.0::double) filter (where byt.i = 0), 0.0), 6) as first from hx left join byt on hx.doc_id = byt.doc_id group by hx.doc_id",
    "payload_preview": f"with {_HX}, {_BY}, g as (select doc_id, string_agg(chr((case when b between 32 and 126 then b else 46 end)::integer), '' order by i) as a from byt where i < 16 group by 1) select hx.doc_id, substr(h, 1, 32) as hex, coalesce(a, '') as ascii from hx left join g on hx.doc_id = g.doc_id",
    "http_structure": f"""{_HTTP}, b as (select z.doc_id, z.s, n, m, 'POST /case?id=' || z.doc_id || '&lang=x HTTP/1.1' as l1 from z join r3 on z.doc_id = r3.doc_id)
      select doc_id, 1.0::double as is_http_request, 0.0::double as is_http_response, (length(l1) - 14)::double as url_length, 2.0::double as n_query_params, {_cnt("[<>''\";&%=(){}\\[\\]\\\\]")} as n_special_chars,
      1.0::double as content_type_textlike, contains(lower(s), 'multipart/form-data')::int::double as has_multipart, (length(l1) + 26)::double as header_length_est, (n - length(l1) - 30)::double as body_length_est,
      {_cnt('[A-Z]')} as n_uppercase, {_cnt('[0-9]')} as n_digits, {_cnt('[A-Za-z]')} as n_alpha, 0.0::double as n_null_bytes, {_cnt(chr(10))} as n_newlines, {_cnt(chr(9))} as n_tabs, m::double as max_run_repeated_byte from b""",
    "payload_signatures": f"with r as ({_RULE_SQL}) select doc_id, technique, round(least(1.0, sum(w)), 6) as weight from r group by 1, 2",
    "pmi_counts": f"{_T} select token, label, n_tc from tc",
    "pmi_candidates": f"{_T}{_CAND} select token, label, n_tc, n_t, pmi from cand",
    "pmi_topk": f"{_T}{_CAND}, r as (select token, label, pmi, cast(row_number() over (partition by label order by pmi desc, token) as integer) as rank from cand) select * from r where rank <= 20",
    "pmi_projection": f"{_T}{_CAND}{_PROJ} select * from proj2",
    "family_filter": f"{_T}{_CAND}{_PROJ}{_FAM} select * from spec",
    "pmi_provenance": f"{_T}{_CAND}{_PROJ}{_FAM} select doc_id, technique, count(*) as n_tokens, md5(string_agg(td.token, ' ' order by abs(weight) desc, td.token)) as tokens_md5 from td join spec on td.token = spec.token group by 1, 2",
    "literal_hits": f"with {_HX}{_LITS} select doc_id, pattern from lh",
    "literal_weights": f"with {_HX}{_LITS} select doc_id, technique, round(weight, 6) as weight from lw",
    "evidence_vote": f"{_ED} select doc_id, technique, family, round(weight, 4) as weight from ed",
    "evidence_edges": f"{_ED} select 'evidence_' || family as rel, count(*) as n_edges, round(avg(weight), 6) as mean_weight from ed where family in {_FAMS} group by 1",
    "evidence_summary": f"{_ED}, fe as (select lab.flow, ed.family, ed.weight from ed join lab on ed.doc_id = lab.doc_id where lab.flow is not null), pf2 as (select flow, family, count(*) as n, max(weight) as m, sum(ln(1 + weight)) as s from fe group by 1, 2) select flow, cast(sum(n) as bigint) as ev_count, round(max(m), 6) as ev_max_weight, arg_max(family, (n, family)) as ev_dominant_family, count(*) as ev_n_distinct_families, round(sum(s), 6) as ev_sum_log1p_weight from pf2 group by 1",
    "evidence_by_flow_family": f"{_ED}, fe as (select lab.flow, ed.family, ed.weight from ed join lab on ed.doc_id = lab.doc_id where lab.flow is not null) select flow, " + ", ".join(f"round(coalesce(max(weight) filter (where family = '{f}'), 0.0), 6) as {f}" for f in _FAMS) + " from fe group by 1",
    "evidence_coverage": f"{_ED}, hs as (select doc_id, " + ", ".join(f"max((family = '{f}')::int) as {f}" for f in _FAMS) + " from ed group by 1), cv as (select lab.label, count(*) as n_packets, " + ", ".join(f"round(avg(coalesce({f}, 0)), 6) as {f}" for f in _FAMS) + f" from lab left join hs on lab.doc_id = hs.doc_id group by 1) select *, case when greatest({', '.join(_FAMS)}) > 0 then " + "coalesce(" + ", ".join(f"case when {f} = greatest({', '.join(_FAMS)}) then '{f}' end" for f in _FAMS) + ") end as dominant from cv",
}
