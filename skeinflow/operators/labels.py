"""Cleaning and auditing of labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HTTP_REQUEST = r"^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) "


def request_matches(text: Column, label: Column, literals: Mapping[str, Sequence[str]]) -> Column:
    """Whether a plain HTTP request holds one of its label's literals (lower case, anywhere)."""
    low = F.lower(text)
    hit = F.lit(False)
    for name, words in literals.items():
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | F.contains(low, F.lit(w))
        hit = hit | ((label == name) & any_word)
    return F.coalesce(text.rlike(HTTP_REQUEST) & hit, F.lit(False))


def isolate(df: DataFrame, label: str, key: str, attack: Column, polluted: Sequence[str], benign: str) -> DataFrame:
    """Rows of polluted labels keep their label only if any row of the same (label, key) is an attack; else benign.

    Adds ``clean_label``. The verdicts are aggregated map-side to one row per
    (label, key) before they are joined, so a busy connection is no hot task. A null key matches no verdict.
    """
    verdicts = df.where(F.col(label).isin(list(polluted)) & attack).select(F.col(label).alias("_l"), F.col(key).alias("_k")).distinct().withColumn("_a", F.lit(True))
    joined = df.join(verdicts, (F.col(label) == F.col("_l")) & (F.col(key) == F.col("_k")), "left")
    keep = ~F.col(label).isin(list(polluted)) | F.col("_a").isNotNull()
    return joined.withColumn("clean_label", F.when(keep | F.col(label).isNull(), F.col(label)).otherwise(benign)).drop("_l", "_k", "_a")


def isolation_audit(isolated: DataFrame, label: str) -> DataFrame:
    """Per label: rows, rows kept and rows turned benign."""
    kept = (F.col("clean_label") == F.col(label)).cast("long")
    return isolated.groupBy(label).agg(F.count(F.lit(1)).alias("total"), F.sum(kept).alias("kept"), F.sum(1 - kept).alias("demoted"))


def apply_answer_key(df: DataFrame, key: str, keys: DataFrame, label: str, attacks: Sequence[str], benign: str) -> DataFrame:
    """Attack labels stand only for keys of the answer key (column ``key`` of ``keys``)."""
    known = keys.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(True))
    joined = df.join(known, F.col(key) == F.col("_k"), "left")
    demote = F.col(label).isin(list(attacks)) & F.col("_hit").isNull()
    return joined.withColumn("clean_label", F.when(demote, benign).otherwise(F.col(label))).drop("_k", "_hit")


def threshold_sweep(rows: DataFrame, score: str, positive: Column, thresholds: Sequence[float]) -> DataFrame:
    """Precision and recall of ``score >= threshold`` for each threshold, in one pass."""
    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    hit = F.col("_s") >= F.col("threshold")
    base = rows.select(F.col(score).alias("_s"), positive.alias("_p"), ts.alias("threshold"))
    out = base.groupBy("threshold").agg(
        F.sum((hit & F.col("_p")).cast("long")).alias("tp"), F.sum((hit & ~F.col("_p")).cast("long")).alias("fp"), F.sum((~hit & F.col("_p")).cast("long")).alias("fn")
    )
    return out.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], resolution: float = 1000.0) -> DataFrame:
    """Exact quantiles with linear interpolation per key: keys, prob, value. Values are ranked by many tasks, in buckets of 1/``resolution``, and only those beside a wanted rank are kept."""
    from skeinflow.operators.ranking import distributed_rank

    ranked = distributed_rank(df.where(F.col(value).isNotNull()).withColumn("_id", F.monotonically_increasing_id()), keys, [value, "_id"], F.floor(F.col(value) * resolution), "_r", "_n")
    at = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    low = F.floor(F.col("prob") * (F.col("_n") - 1)) + 1
    near = ranked.withColumn("prob", at).where((F.col("_r") == low) | (F.col("_r") == F.least(low + 1, "_n")))
    share = F.col("prob") * (F.col("_n") - 1) - F.floor(F.col("prob") * (F.col("_n") - 1))
    return near.groupBy(*keys, "prob", "_n").agg(F.min(value).alias("_a"), F.max(value).alias("_b")).select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("value"))


def anchor_statistics(edges: DataFrame, packets: DataFrame, flow: str, packet: str, weight: str) -> DataFrame:
    """Per flow of ``packets`` (flow, packet): n_ev packets with evidence, their share, summed and largest weight; 0 without evidence."""
    own = edges.join(packets, packet).groupBy(flow).agg(F.count_distinct(packet).alias("n_ev"), F.sum(weight).alias("sum_w"), F.max(weight).alias("max_w"))
    sizes = packets.groupBy(flow).agg(F.count(F.lit(1)).alias("_n"))
    both = sizes.join(own, flow, "left").fillna(0, ["n_ev", "sum_w", "max_w"])
    return both.select(flow, F.col("n_ev").cast("double").alias("n_ev"), (F.col("n_ev") / F.greatest("_n", F.lit(1))).alias("frac_ev"), "sum_w", "max_w")


def collect_requests(df: DataFrame, payload: str, most: int = 120) -> DataFrame:
    """Rows whose payload opens with an HTTP request, with ``line`` (its first line, at most ``most`` characters), ``host`` (its Host header, else empty) and ``body`` (all of it in lower case)."""
    text = F.decode(F.col(payload), "ISO-8859-1")
    rows = df.where(text.rlike(HTTP_REQUEST))
    host = F.trim(F.regexp_extract(text, r"[Hh]ost:\s*([^\r\n]+)", 1))
    return rows.withColumns({"line": F.substring(F.substring_index(text, "\r\n", 1), 1, most), "host": host, "body": F.lower(text)})


def mask_audit(rows: DataFrame, label: str, mask: Column, oracle: Column) -> DataFrame:
    """Per label and in TOTAL: masked rows, true ones among them, true rows, precision and recall."""
    m, o = mask.cast("long"), oracle.cast("long")
    out = rows.rollup(label).agg(F.sum(m).alias("masked"), F.sum(m * o).alias("correct"), F.sum(o).alias("true_rows"), F.grouping(label).alias("_g"))
    out = out.withColumn(label, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(label))).drop("_g")
    return out.withColumn("precision", F.col("correct") / F.greatest("masked", F.lit(1))).withColumn("recall", F.col("correct") / F.greatest("true_rows", F.lit(1)))


def rare_classes(df: DataFrame, label: str, k: int, least: int) -> DataFrame:
    """Labels among the ``k`` rarest or with fewer than ``least`` rows."""
    from pyspark.sql import Window as W

    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("n", label)))  # one row per label
    return ranked.where((F.col("rank") <= k) | (F.col("n") < least))
