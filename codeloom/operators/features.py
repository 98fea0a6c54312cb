"""Mapping product features to methods.

Own design (there is no result to match): a template's api names a controller and a method, often led
by an HTTP verb. It maps to the methods of that class and name in any case; in mode ``reachable``, the
default, also to every method that the call graph reaches from there.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import node_key, stable_id, trim_all
from codeloom.plans.staging import cut
from codeloom.schemas import FEATURE_TEMPLATE

VERB = r"(?i)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|HTTP)\s+"
TEMPLATE = "template_feature.json"


def find_template(repository: str) -> str | None:
    """The template in the repository, else in the working folder, else none."""
    return next((p for p in (os.path.join(repository, TEMPLATE), TEMPLATE) if os.path.isfile(p)), None)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """feature_name, controller, method: one row per api."""
    with open(path, encoding="utf-8-sig") as f:
        rows = json.load(f)
    return explode_template(spark.createDataFrame([(rows,)], "template " + FEATURE_TEMPLATE.simpleString()))


def explode_template(templates: DataFrame) -> DataFrame:
    one = templates.select(F.explode("template").alias("f")).select("f.feature_name", F.explode_outer("f.apis").alias("a"))
    return one.select("feature_name", "a.controller", "a.method")


def map_features(apis: DataFrame, methods: DataFrame, edges: DataFrame, run_id: str, mode: str = "reachable", max_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature_records, feature_method_mappings). ``methods``: id, class_name, method_name.

    The closure ends when a level reaches nothing new, or after ``max_levels`` if the caller wants fewer.
    """
    feature_id = stable_id(F.lit(run_id), F.col("feature_name"))
    features = apis.select(feature_id.alias("id"), F.lit(run_id).alias("analysis_run_id"), "feature_name").distinct()
    bare = F.regexp_replace(trim_all(F.col("method")), VERB, "")
    reached = apis.select(feature_id.alias("feature_id"), node_key(F.col("controller"), bare).alias("node")).distinct()
    if mode == "reachable":
        # display names of callers may carry a verb; closure goes by the bare name
        key = lambda c, m: node_key(F.col(c), F.regexp_replace(F.col(m), VERB, ""))
        steps = cut(edges.select(key("caller_class", "caller_method").alias("node"), key("callee_class", "callee_method").alias("to")).distinct())
        reached = frontier = cut(reached)
        level = 0
        while level != max_levels:
            level += 1
            frontier = cut(frontier.join(steps, "node").select("feature_id", F.col("to").alias("node")).distinct().join(reached, ["feature_id", "node"], "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.union(frontier))
    found = methods.select(F.col("id").alias("method_source_id"), node_key(F.col("class_name"), F.col("method_name")).alias("node"))
    maps = reached.join(found, "node").select("feature_id", "method_source_id").distinct()
    return features, maps.select(stable_id("feature_id", "method_source_id").alias("id"), "feature_id", "method_source_id")


def code_flow(features: DataFrame, mappings: DataFrame, methods: DataFrame) -> DataFrame:
    """feature_id, feature_name and its methods as an array; features without methods keep an empty one."""
    joined = features.select(F.col("id").alias("feature_id"), "feature_name").join(mappings.select("feature_id", "method_source_id"), "feature_id", "left")
    joined = joined.join(methods.select(F.col("id").alias("method_source_id"), "class_name", "method_name", "source_code"), "method_source_id", "left")
    method = F.when(F.col("class_name").isNotNull(), F.struct(F.col("class_name"), F.col("method_name"), F.col("method_source_id").alias("id"), F.col("source_code")))
    return joined.groupBy("feature_id", "feature_name").agg(F.sort_array(F.collect_list(method)).alias("methods"))
