"""Evidence: token statistics, literals, signatures, and the vote that turns them into edges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinflow.functions import payload as P

#: Families that have an edge type of their own.
EDGE_FAMILIES = ("injection", "command_exec", "file_upload", "recon", "c2_beacon")
#: Payload rules as technique, pattern, decoders, weight.
PAYLOAD_RULES = (
    ("T1190", r"union\s+(all\s+)?select\b", ("lowercase", "url_decode"), 0.9),
    ("T1190", r"or\s+1\s*=\s*1\b", ("lowercase", "url_decode"), 0.8),
    ("T1190", r"--\s", ("url_decode",), 0.4),
    ("T1190", r"information_schema\b", ("lowercase", "url_decode"), 0.7),
    ("T1190", r"\bsleep\s*\(", ("lowercase", "url_decode"), 0.6),
    ("T1190", r"\bbenchmark\s*\(", ("lowercase", "url_decode"), 0.6),
    ("T1190", r"\bload_file\s*\(", ("lowercase", "url_decode"), 0.7),
    ("T1190", r"\binto\s+outfile\b", ("lowercase", "url_decode"), 0.8),
    ("T1059.007", r"<script\b", ("lowercase", "url_decode", "html_entity_decode"), 0.85),
    ("T1059.007", r"\bonerror\s*=", ("lowercase", "url_decode", "html_entity_decode"), 0.7),
    ("T1059.007", r"\bonload\s*=", ("lowercase", "url_decode", "html_entity_decode"), 0.6),
    ("T1059.007", r"javascript:", ("lowercase", "url_decode"), 0.7),
    ("T1059.007", r"<iframe\b", ("lowercase", "url_decode"), 0.5),
    ("T1059.007", r"<svg\b[^>]*onload", ("lowercase", "url_decode"), 0.7),
    ("T1059.004", r"/etc/passwd\b", ("lowercase", "url_decode"), 0.85),
    ("T1059.004", r"\$\([^)]+\)", ("url_decode",), 0.6),
    ("T1059.004", r"`[a-z0-9_\-]+`", ("lowercase", "url_decode"), 0.55),
    ("T1059.004", r"\|\s*(sh|bash|zsh)\b", ("lowercase", "url_decode"), 0.7),
    ("T1059.004", r"\b(wget|curl)\s+https?://", ("lowercase", "url_decode"), 0.5),
    ("T1059.004", r"/bin/(sh|bash)\b", ("lowercase", "url_decode"), 0.7),
    ("T1505.003", r"filename=[\"']?[^\"'\\/]*\.(php|jsp|asp|aspx|jspx|phtml)\b", ("lowercase", "url_decode"), 0.85),
    ("T1505.003", r"multipart/form-data;\s*boundary=", ("lowercase",), 0.3),
    ("T1505.003", r"\beval\s*\(", ("lowercase", "url_decode"), 0.6),
    ("T1505.003", r"\bbase64_decode\s*\(", ("lowercase", "url_decode"), 0.7),
    ("T1505.003", r"\b(system|passthru|shell_exec)\s*\(", ("lowercase", "url_decode"), 0.7),
)


def payload_signatures(df: DataFrame, key: str, payload: str, rules: Sequence[tuple] = PAYLOAD_RULES) -> DataFrame:
    """key, technique, weight: summed weights of the rules that match the decoded payload, at most 1."""
    chains = list(dict.fromkeys(r[2] for r in rules))
    rows = df.select(key, *[P.latin(P.decoded(payload, c)).alias(f"_d{i}") for i, c in enumerate(chains)])
    fired = F.array(*[F.when(F.col(f"_d{chains.index(c)}").rlike("(?i)" + p), F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"))) for t, p, c, w in rules])
    hits = rows.select(key, F.explode(F.filter(fired, lambda h: h.isNotNull())).alias("h"))
    return hits.groupBy(key, F.col("h.t").alias("technique")).agg(F.least(F.lit(1.0), F.sum("h.w")).alias("weight"))


def token_class_counts(tokens: DataFrame, label: str = "label") -> DataFrame:
    """token, label, n_tc from rows of (label, token), where a token comes once per payload."""
    return tokens.groupBy("token", label).agg(F.count(F.lit(1)).alias("n_tc"))


def pmi_candidates(counts: DataFrame, classes: DataFrame, label: str = "label", pmi_min: float = 1.0, global_support: int = 50, class_support: int = 5) -> DataFrame:
    """token, label, n_tc, n_t, pmi = ln(p(t,c) / (p(t) p(c))) of pairs with enough support.

    ``classes`` has label and n_c, one row a class; it is joined by label, and its total is one number.
    """
    n = classes.agg(F.sum("n_c")).first()[0] or 0
    support = counts.withColumn("n_t", F.sum("n_tc").over(W.partitionBy("token"))).where((F.col("n_t") >= global_support) & (F.col("n_tc") >= class_support))
    scored = support.join(classes, label).withColumn("pmi", F.log(F.col("n_tc") * F.lit(float(n)) / (F.col("n_t").cast("double") * F.col("n_c"))))
    return scored.where(F.col("pmi") >= pmi_min).drop("n_c")


def top_per_class(candidates: DataFrame, k: int, label: str = "label") -> DataFrame:
    """The ``k`` tokens of highest PMI per class, ties by token."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy(F.desc("pmi"), "token"))).where(F.col("rank") <= k)


def project_to_techniques(coefs: DataFrame, mapping: DataFrame, floor: float = 0.01) -> DataFrame:
    """token, technique, family, weight: class coefficients summed over the class map, clipped to [-1, 1], small ones dropped."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("coef") * F.col("map_weight"))))
    return coefs.join(mapping, "label").groupBy("token", "technique", "family").agg(w.alias("weight")).where(F.abs("weight") >= floor)


def family_specific(table: DataFrame, tau: float) -> DataFrame:
    """Rows of a token only in families that hold at least ``tau`` of its strongest family's summed absolute weight."""
    if tau <= 0:
        return table
    own = F.sum(F.abs("weight")).over(W.partitionBy("token", "family"))
    rows = table.withColumn("_f", own).withColumn("_m", F.max("_f").over(W.partitionBy("token")))
    return rows.where(F.col("_f") >= tau * F.col("_m")).drop("_f", "_m")


def vocabulary(table: DataFrame, most: int = 5_000_000) -> frozenset[str]:
    """The tokens of a token table, which is a model: more than ``most``, counted first, are refused rather than sent to the workers."""
    tokens = table.select("token").where("token is not null").distinct()
    if tokens.count() > most:
        raise ValueError(f"more than {most} tokens in the table; raise class or global support")
    return frozenset(r["token"] for r in tokens.collect())


def pmi_hits(tokens: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """key, technique, family, weight: summed token weights, at most 1 (negative sums are kept). ``tokens`` has one row per key and token."""
    hits = tokens.select(key, "token").join(table, "token")
    return hits.groupBy(key, "technique").agg(F.min("family").alias("family"), F.least(F.lit(1.0), F.sum("weight")).alias("weight"))


def pmi_provenance(tokens: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """key, technique, matched: the tokens behind each hit of ``pmi_hits`` with their weights, largest absolute weight first, ties by token."""
    hits = tokens.select(key, "token").join(table, "token")
    ordered = F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("o"), "token", "weight")))
    return hits.groupBy(key, "technique").agg(F.transform(ordered, lambda m: F.struct(m["token"].alias("token"), m["weight"].alias("weight"))).alias("matched"))


def extract_literals(text: str) -> F.Column:
    """Lower-case literals of 3 to 80 characters set as code in a description."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?s)<code>(.*?)</code>"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1)))
    even = F.transform(found, lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))))
    return F.array_distinct(F.filter(even, lambda s: F.length(s).between(3, 80)))


def literal_hits(df: DataFrame, key: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """key, pattern: every literal that occurs in the lower-case text, by one pass of an automaton.

    The dictionary is reference data of known size (a few thousand literals) and travels with the function.
    """
    kinds = dict(df.dtypes)
    wanted = sorted({p.lower() for p in patterns if p})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in wanted:
            machine.add_word(p, p)
        if wanted:
            machine.make_automaton()
        for b in batches:
            keys, found = [], []
            for k, t in zip(b[key], b[text], strict=True):
                if t and wanted:
                    for p in sorted({p for _, p in machine.iter(t.lower())}):
                        keys.append(k)
                        found.append(p)
            yield pd.DataFrame({key: pd.Series(keys, dtype=b[key].dtype), "pattern": pd.Series(found, dtype="object")})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kinds[key]}, pattern string")


def literal_weights(hits: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """key, technique, weight = min(1, 0.4 * distinct literals). ``dictionary`` has pattern, technique."""
    w = F.least(F.lit(1.0), F.lit(0.4) * F.count_distinct("pattern"))
    return hits.join(dictionary, "pattern").groupBy(key, "technique").agg(w.alias("weight"))


def vote(pmi: DataFrame, literals: DataFrame, consensus: DataFrame, families: DataFrame, key: str, tau: float = 0.4) -> DataFrame:
    """key, technique, family, weight of the evidence edges.

    ``pmi`` (key, technique, family, weight) and ``literals`` (key, technique, weight)
    are voters above 0.1; base = 0.55 pmi + 0.45 literal, times 1.2 if the flow's
    ``consensus`` (key, technique, weight) is above 0.1, times 1.3 if both vote, at
    most 1; kept from ``tau`` on. The family is the PMI table's, else ``families``' (technique, family); none: dropped.
    """
    a = pmi.select(key, "technique", F.col("family").alias("_fam"), F.col("weight").alias("_p"))
    b = literals.select(key, "technique", F.col("weight").alias("_l"))
    c = consensus.select(key, "technique", F.col("weight").alias("_c"))
    joined = a.join(b, [key, "technique"], "full").join(c, [key, "technique"], "left").join(families.withColumnRenamed("family", "_g"), "technique", "left")
    p, lit, flow = (F.coalesce(x, F.lit(0.0)) for x in ("_p", "_l", "_c"))
    votes = (p > 0.1).cast("int") + (lit > 0.1).cast("int")
    base = (p * 0.55 + lit * 0.45) * F.when(flow > 0.1, 1.2).otherwise(1.0) * F.when(votes == 2, 1.3).otherwise(1.0)
    out = joined.select(key, "technique", F.coalesce("_fam", "_g").alias("family"), F.least(F.lit(1.0), base).alias("weight"), votes.alias("_v"))
    return out.where((F.col("_v") > 0) & (F.col("weight") >= tau) & F.col("family").isNotNull()).drop("_v")


def typed_edges(edges: DataFrame) -> DataFrame:
    """Edges of the known families, with the relation name."""
    return edges.where(F.col("family").isin(*EDGE_FAMILIES)).withColumn("rel", F.concat(F.lit("evidence_"), F.col("family")))


def evidence_summary(edges: DataFrame, flow: str) -> DataFrame:
    """Per flow: edges, largest weight, dominant family (most edges, ties by name), families, sum of log1p weights."""
    per = edges.groupBy(flow, "family").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("m"), F.sum(F.log1p("weight")).alias("s"))
    dominant = F.max(F.struct("n", "family"))["family"]
    return per.groupBy(flow).agg(
        F.sum("n").alias("ev_count"), F.max("m").alias("ev_max_weight"), dominant.alias("ev_dominant_family"), F.count(F.lit(1)).alias("ev_n_distinct_families"), F.sum("s").alias("ev_sum_log1p_weight")
    )


def by_family(edges: DataFrame, flow: str, families: Sequence[str] = EDGE_FAMILIES) -> DataFrame:
    """Per flow the largest weight of each family, 0 where there is none."""
    return edges.groupBy(flow).agg(*[F.coalesce(F.max(F.when(F.col("family") == f, F.col("weight"))), F.lit(0.0)).alias(f) for f in families])


def coverage(packets: DataFrame, edges: DataFrame, key: str, label: str, families: Sequence[str] = EDGE_FAMILIES) -> DataFrame:
    """Share of a label's packets with at least one edge of each family, and the family with the largest share."""
    has = edges.groupBy(key).agg(*[F.bool_or(F.col("family") == f).alias(f) for f in families])
    shares = [F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f) for f in families]
    out = packets.select(key, label).join(has, key, "left").groupBy(label).agg(F.count(F.lit(1)).alias("n_packets"), *shares)
    best = F.greatest(*families)
    return out.withColumn("dominant", F.when(best > 0, F.coalesce(*[F.when(F.col(f) == best, F.lit(f)) for f in families])))


def dominant_family(mapping: DataFrame, label: str = "label") -> DataFrame:
    """Per class the family its techniques weigh most in (ties by name), from label, family, map_weight; classes without technique have no row."""
    mass = mapping.where(F.col("family").isNotNull()).groupBy(label, "family").agg(F.sum("map_weight").alias("mass"))
    best = F.row_number().over(W.partitionBy(label).orderBy(F.desc("mass"), "family"))
    return mass.withColumn("_r", best).where("_r = 1").drop("_r")


def l1_logistic(rows: DataFrame, tokens: str, label: str, c: float = 0.1, iterations: int = 200, vocabulary: DataFrame | None = None) -> DataFrame:
    """token, label, coef of an L1-penalised multinomial regression on token presence (zero coefficients are left out).

    ``vocabulary`` (column token) names the tokens fitted on, all of them; without it that is every token of ``rows``.
    It is the model's size, so it goes to the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, StringIndexer

    n = rows.count()
    if vocabulary is None:
        vocabulary = rows.select(F.explode(tokens).alias("token"))
    fitted = sorted(r["token"] for r in vocabulary.select("token").where("token is not null").distinct().collect())
    if not n or not fitted:
        return rows.sparkSession.createDataFrame([], "token string, label string, coef double")
    words = CountVectorizerModel.from_vocabulary(fitted, inputCol=tokens, outputCol="_x").setBinary(True)
    names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    data = names.transform(words.transform(rows)).select("_x", "_y")
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", elasticNetParam=1.0, regParam=1.0 / (c * max(n, 1)), maxIter=iterations, standardization=False).fit(data)
    m = model.coefficientMatrix.toArray()
    entries = [(fitted[j], names.labels[i], float(m[i, j])) for i, j in zip(*m.nonzero(), strict=True)]
    return rows.sparkSession.createDataFrame(entries, "token string, label string, coef double")
