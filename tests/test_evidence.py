import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import payload as P
from skeinflow.operators import evidence as E
from skeinflow.operators import pmi_training
from skeinflow.plans import text_queries


def payload_tokens(spark, raw, **kw):
    return spark.createDataFrame([(bytearray(raw),)], "p binary").select(P.tokens("p", **kw).alias("t")).first()["t"]


def test_tokens(spark):
    assert payload_tokens(spark, b"") == []
    got = payload_tokens(spark, b"GET /index.html HTTP/1.1\r\nHost: a\r\n")
    assert {"t:get", "t:index.html", "t:host:"} <= set(got) and got[0] == "b4:47455420"
    assert {t[:2] for t in payload_tokens(spark, bytes(range(64)))} == {"b4", "b8"}
    assert payload_tokens(spark, b"A" * 10000) == ["b4:41414141", "b8:4141414141414141"]
    assert len(payload_tokens(spark, bytes(i * 7 % 251 for i in range(5000)))) == 200


def test_vector_matches_parts(spark):
    raw = b"GET /a?x=1&y=2 HTTP/1.1\r\n\r\nbody body\x00\x00\x00\x00"
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"")), (3, None)], "k long, p binary")
    got = {r["k"]: r["vector"] for r in P.payload_vectors(df, "k", "p").collect()}
    assert all(len(v) == P.VECTOR_SIZE == 2579 for v in got.values())
    assert sum(got[1][:256]) == pytest.approx(1.0, abs=1e-5) and not any(got[2]) and not any(got[3])
    h = int.from_bytes(hashlib.md5(b"GET ").digest()[:4], "big") % 2048
    assert got[1][259 + h] > 0
    structure = got[1][259 + 2048 : 259 + 2048 + 16]
    assert structure[0] == 1 and structure[2] == len("/a?x=1&y=2") and structure[3] == 2 and structure[15] == 4
    assert got[1][-256] == pytest.approx(raw[0] / 255)


def test_decoders(spark):
    df = spark.createDataFrame([(bytearray(b"%3CSCRIPT%3E 100% &#x41;&lt;"),)], "p binary")
    got = df.select(P.decoded("p", ("lowercase", "url_decode", "html_entity_decode")).alias("d")).first()["d"]
    assert bytes(got) == b"<script> 100% A<"
    assert bytes(df.select(P.decoded(F.lit(b"aGk=").cast("binary"), ("base64_decode",)).alias("d")).first()["d"]) == b"hi"
    with pytest.raises(ValueError):
        P.decoded("p", ("rot13",))


def test_signatures(spark):
    rows = [(1, b"GET /?q=1%20UNION%20ALL%20SELECT%20x FROM information_schema HTTP/1.1"), (2, b"<ScRiPt>"), (3, b"eval(base64_decode('x'))"), (4, b"plain")]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k long, p binary")
    got = {(r["k"], r["technique"]): r["weight"] for r in E.payload_signatures(df, "k", "p").collect()}
    assert got == {(1, "T1190"): 1.0, (2, "T1059.007"): 0.85, (3, "T1505.003"): 1.0}


def vote(spark, pmi=None, literal=None, flow=None, family=True):
    t = "k long, technique string, weight double"
    p = spark.createDataFrame([(1, "T", "injection", pmi)] if pmi is not None else [], "k long, technique string, family string, weight double")
    a = spark.createDataFrame([(1, "T", literal)] if literal is not None else [], t)
    c = spark.createDataFrame([(1, "T", flow)] if flow is not None else [], t)
    fam = spark.createDataFrame([("T", "recon")] if family else [], "technique string, family string")
    return [(r["family"], round(r["weight"], 6)) for r in E.vote(p, a, c, fam, "k").collect()]


def test_vote(spark):
    assert vote(spark, 0.3) == []
    assert vote(spark, 0.8) == [("injection", 0.44)]
    assert vote(spark, 0.5, 0.5) == [("injection", 0.65)]
    assert vote(spark, 0.7, None, 0.5) == [("injection", 0.462)]
    assert vote(spark, 1.0, 1.0, 1.0) == [("injection", 1.0)]
    assert vote(spark, None, 0.9, family=False) == []
    assert vote(spark, None, 0.9) == [("recon", 0.405)]


def test_literals(spark):
    df = spark.createDataFrame([(1, "use `UNION  SELECT` and <code>cat\n/etc/passwd</code> or `x`"), (2, None)], "k long, d string")
    assert df.select(E.extract_literals("d").alias("l")).first()["l"] == ["cat /etc/passwd", "union select"]
    docs = spark.createDataFrame([(1, "A Union Select b, Cat /etc/passwd"), (2, ""), (3, None)], "k long, t string")
    hits = E.literal_hits(docs, "k", "t", ["union select", "cat /etc/passwd", "cmd.exe"])
    assert sorted(map(tuple, hits.collect())) == [(1, "cat /etc/passwd"), (1, "union select")]
    dic = spark.createDataFrame([("union select", "T1190"), ("cat /etc/passwd", "T1190")], "pattern string, technique string")
    assert [r["weight"] for r in E.literal_weights(hits, "k", dic).collect()] == [pytest.approx(0.8)]
    assert E.literal_hits(docs, "k", "t", []).count() == 0


def test_family_filter(spark):
    rows = [("a", "T1", "injection", 0.9), ("a", "T2", "recon", 0.5), ("b", "T1", "injection", -0.4), ("b", "T2", "recon", 0.4)]
    df = spark.createDataFrame(rows, "token string, technique string, family string, weight double")
    assert sorted(tuple(r)[:2] for r in E.family_specific(df, 0.9).collect()) == [("a", "T1"), ("b", "T1"), ("b", "T2")]
    assert E.family_specific(df, 0.0).count() == 4


def test_summary_ties_by_name(spark):
    rows = [("f", "recon", 0.5), ("f", "injection", 0.9), ("f", "recon", 0.4), ("f", "injection", 0.4)]
    r = E.evidence_summary(spark.createDataFrame(rows, "flow string, family string, weight double"), "flow").first()
    assert (r["ev_count"], r["ev_max_weight"], r["ev_dominant_family"], r["ev_n_distinct_families"]) == (4, 0.9, "recon", 2)


def test_l1_logistic_separates(spark):
    rows = [(["t:a", "t:x"], "one")] * 60 + [(["t:b", "t:x"], "two")] * 60
    coefs = {(r["token"], r["label"]): r["coef"] for r in E.l1_logistic(spark.createDataFrame(rows, "tokens array<string>, label string"), "tokens", "label", c=1.0).collect()}
    assert coefs.get(("t:a", "one"), 0) > coefs.get(("t:a", "two"), 0)


def test_token_rows_are_the_lists(spark):
    raws = [b"", None, b"GET /a?b=cc HTTP", bytes(range(90)), b"abc", b"A" * 40]
    df = spark.createDataFrame([(i, None if r is None else bytearray(r), "x") for i, r in enumerate(raws)], "k long, p binary, token string")
    got = {}
    for r in P.token_rows(df, ["k"], "p", chunk=5).collect():
        got.setdefault(r["k"], []).append(r["token"])
    assert got == {i: t for i, r in enumerate(raws) if (t := P.token_list(r, None))}
    assert P.token_list(b"ab cd ab", 3) == ["b4:61622063", "b4:62206364", "b4:20636420"] and P.token_list(b"ab cd ab", None, ("t",)) == ["t:ab", "t:cd"]
    assert P.token_rows(df.limit(0), ["k"], "p").count() == 0
    some = P.token_rows(df, ["k"], "p", only=frozenset({"b4:41414141", "t:get"})).collect()
    assert sorted((r["k"], r["token"]) for r in some) == [(2, "t:get"), (5, "b4:41414141")]
    counted = {(r["token"], r["token_of"]): r["n"] for r in P.token_counts(df.withColumnRenamed("token", "token_of"), "token_of", "p", most=3).collect()}
    want = Counter(t for r in raws for t in P.token_list(r, None))
    assert counted == {(t, "x"): n for t, n in want.items()}
    with pytest.raises(ValueError):
        E.vocabulary(spark.createDataFrame([("a",), ("b",)], "token string"), 1)


def test_provenance_lists_tokens_by_weight(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "z")], "k long, token string")
    table = spark.createDataFrame([("a", "T1", "recon", 0.1), ("b", "T1", "recon", -0.6), ("c", "T1", "recon", 0.1)], "token string, technique string, family string, weight double")
    got = E.pmi_provenance(tokens, "k", table).collect()
    assert [(r["k"], r["technique"], [tuple(m) for m in r["matched"]]) for r in got] == [(1, "T1", [("b", -0.6), ("a", 0.1), ("c", 0.1)])]


def test_training_fits_every_candidate_and_is_stored(spark, tmp_path):
    common = " ".join(f"w{i:04d}" for i in range(300))
    rows = [(i, "note" if i % 2 else "report", bytearray((common + (" rare" if i % 2 else " other")).encode())) for i in range(120)] + [(900, None, None)]
    packets = spark.createDataFrame(rows, "k long, label string, payload binary")
    mapping = spark.createDataFrame([("note", "T1", "recon", 1.0), ("report", "T2", "injection", 1.0)], "label string, technique string, family string, map_weight double")
    table, meta = pmi_training.fit_table(packets, "k", mapping, pmi_min=0.3, global_support=20, iterations=30)
    assert meta["class_total"]["note"] == 60 * 4 and meta["n_candidate_tokens"] < 40 < 300 < meta["n_unique_tokens"]
    signs = {(r["token"], r["technique"]): r["weight"] > 0 for r in table.collect()}
    assert signs and all(up for (t, k), up in signs.items() if k == "T1" and t == "t:rare")
    pmi_training.save_table(table, meta, str(tmp_path / "t"))
    back, read = pmi_training.load_table(spark, str(tmp_path / "t"))
    assert back.count() == meta["rows"] and read == meta
    assert pmi_training.fit_table(packets.limit(0), "k", mapping)[0].count() == 0


def test_l1_projection_uses_the_fit(spark, monkeypatch):
    fit = spark.createDataFrame([("t:a", "card", 0.5), ("t:a", "note", -0.001)], "token string, label string, coef double")
    monkeypatch.setattr(text_queries, "l1_logistic_pmi", lambda spark, d: fit)
    mapped = text_queries.class_map(spark, "/root/testdata/sf0.001").where("label = 'card'").collect()
    got = {(r["token"], r["technique"]): r["weight"] for r in text_queries.l1_projection(spark, "/root/testdata/sf0.001").collect()}
    weights = {r["technique"]: 0.5 * r["map_weight"] for r in mapped}
    assert got and all(t == "t:a" and w == pytest.approx(weights[k]) for (t, k), w in got.items())
