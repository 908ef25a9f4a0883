"""Reference knowledge: technique maps in CSV, technique objects in STIX JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.evidence import extract_literals

_OBJECT = "struct<type:string,name:string,description:string,revoked:boolean,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<phase_name:string>>>"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header and a given schema; malformed rows come out with nulls."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def techniques(spark: SparkSession, path: str, source: str = "mitre-attack") -> DataFrame:
    """technique_id, name, description, tactics of the attack patterns in STIX bundles; revoked ones are left out."""
    text = spark.read.text(path, wholetext=True)
    objects = text.select(F.explode(F.from_json("value", f"struct<objects:array<{_OBJECT}>>")["objects"]).alias("o"))
    refs = F.filter("o.external_references", lambda r: r["source_name"] == source)
    out = objects.where("o.type = 'attack-pattern' and not coalesce(o.revoked, false)")
    out = out.select(F.get(refs, F.lit(0))["external_id"].alias("technique_id"), "o.name", "o.description", F.transform("o.kill_chain_phases", lambda p: p["phase_name"]).alias("tactics"))
    return out.where("technique_id is not null")


def literal_dictionary(found: DataFrame) -> DataFrame:
    """pattern, technique from the literals in technique descriptions."""
    return found.select(F.explode(extract_literals("description")).alias("pattern"), F.col("technique_id").alias("technique")).distinct()


def class_map(classes: DataFrame, known: DataFrame) -> DataFrame:
    """label, technique, map_weight: unknown techniques and empty cells are skipped, unreadable weights are 1."""
    cleaned = classes.select(F.trim("label").alias("label"), F.trim("technique").alias("technique"), F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("map_weight"))
    return cleaned.where("label <> '' and technique <> ''").join(known.select("technique"), "technique", "left_semi")


def missing_techniques(used: DataFrame, known: DataFrame, col: str = "technique") -> DataFrame:
    """Techniques that are used but not known; empty if the reference holds."""
    return used.select(col).distinct().join(known.select(col), col, "left_anti")
