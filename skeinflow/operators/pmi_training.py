"""Training of the token table: subsample, counts, candidates, L1 fit, projection, family filter."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import payload as P
from skeinflow.operators import evidence as E
from skeinflow.operators.splits import stratified_subsample
from skeinflow.session import materialize


def presence_rows(rows: DataFrame, tokens: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """Each row of ``rows`` with ``tokens``: those of its tokens that are in ``vocabulary``; rows without any keep an empty list."""
    wanted = tokens.select(key, "token").join(vocabulary.select("token").distinct(), "token", "left_semi")
    lists = wanted.groupBy(key).agg(F.collect_list("token").alias("tokens"))
    return rows.join(lists, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def fit_table(
    packets: DataFrame, key: str, mapping: DataFrame, per_class: int = 25_000, seed: str = "42", pmi_min: float = 1.0, global_support: int = 50, class_support: int = 5,
    c: float = 0.1, iterations: int = 200, floor: float = 0.01, tau: float = 0.9,
) -> tuple[DataFrame, dict[str, Any]]:
    """The token table (token, technique, family, weight) and what was done on the way.

    ``packets``: ``key`` (unique), label, payload; ``mapping``: label, technique, family, map_weight.
    The fit runs on at most ``per_class`` packets of a label (the documented bound of the training sample; small labels are
    repeated); counts and candidates see the same packets, and every candidate is fitted on, with all byte grams and text tokens.
    ``tau`` 0 switches the family filter off. Packets without label train nothing; no packets give an empty table.
    """
    sample = stratified_subsample(packets.where("label is not null").select(key, "label", "payload"), "label", key, seed, per_class)
    sample = materialize(sample.withColumn("_id", F.monotonically_increasing_id()), "pmi-sample")
    classes = sample.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    counts = materialize(P.token_counts(sample, "label", "payload").withColumnRenamed("n", "n_tc"), "pmi-counts")
    candidates = materialize(E.pmi_candidates(counts, classes, "label", pmi_min, global_support, class_support), "pmi-candidates")
    tokens = P.token_rows(sample, ["_id"], "payload", only=E.vocabulary(candidates))
    coefs = materialize(E.l1_logistic(presence_rows(sample.select("_id", "label"), tokens, "_id", candidates), "tokens", "label", c, iterations, candidates), "pmi-coefs")
    projected = materialize(E.project_to_techniques(coefs, mapping, floor), "pmi-projected")
    table = E.family_specific(projected, tau)
    meta = {
        "class_total": {r["label"]: r["n_c"] for r in classes.collect()},
        "n_unique_tokens": counts.select("token").distinct().count(),
        "n_candidate_tokens": candidates.select("token").distinct().count(),
        "n_coefficients": coefs.count(),
        "rows_before_family_filter": projected.count(),
        "rows": table.count(),
        "hyperparameters": {
            "per_class": per_class, "seed": seed, "pmi_min": pmi_min, "global_support": global_support, "class_support": class_support,
            "c": c, "iterations": iterations, "floor": floor, "tau": tau,
        },
    }
    return table, meta


def save_table(table: DataFrame, meta: dict[str, Any], path: str) -> None:
    """The table as parquet and its metadata as one JSON row beside it."""
    table.write.mode("overwrite").parquet(os.path.join(path, "table"))
    table.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))


def load_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """What ``save_table`` wrote."""
    return spark.read.parquet(os.path.join(path, "table")), json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
