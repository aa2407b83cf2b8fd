"""Structured data of pages as rows: JSON-LD blocks as variants, their nodes, types, contexts and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _texts(value: Column, path: str) -> Column:
    """What a field has, as an array of texts: of one value one, of a list its entries, of nothing none."""
    several = F.try_variant_get(value, path, "array<string>")
    single = F.try_variant_get(value, path, "string")
    listed = F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("")), F.lit("ARRAY"))
    return F.when(listed, F.array_compact(several)).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))


def _entries(value: Column, path: str) -> Column:
    """The entries of a list, as variants; null where there is none."""
    return F.try_variant_get(value, path, "array<variant>")


def nodes(pages: DataFrame, key: str = "url", blocks: str = "json_ld") -> DataFrame:
    """(key, block, node, node_id, types, contexts, fields, data): one row per node of each page's JSON-LD blocks (an array of texts).

    A block may be one node, a list of nodes, or hold a list under @graph, whose nodes follow the node that holds it and inherit its contexts where they have none. ``data``
    is the node as a variant, for ``try_variant_get``. A block that is no JSON has no rows, and neither has a null; all is done by expressions."""
    parsed = pages.select(key, F.posexplode(blocks).alias("block", "_text")).withColumn("_value", F.try_parse_json("_text")).filter("_value is not null")
    tops = parsed.select(key, "block", F.posexplode(F.coalesce(_entries(F.col("_value"), "$"), F.array("_value"))).alias("_at", "_top")).filter("_top is not null")
    tops = tops.withColumns({"_graph": _entries(F.col("_top"), '$["@graph"]'), "_context": _texts(F.col("_top"), '$["@context"]')})
    every = tops.select(key, "block", "_at", "_context", F.posexplode(F.concat(F.array("_top"), F.coalesce("_graph", F.array().cast("array<variant>")))).alias("_part", "data")).filter("data is not null")
    # only objects are nodes
    every = every.filter(F.startswith(F.schema_of_variant("data"), F.lit("OBJECT")))
    own = _texts(F.col("data"), '$["@context"]')
    return every.select(
        key, "block", F.struct("_at", "_part").alias("node"), F.try_variant_get("data", '$["@id"]', "string").alias("node_id"), _texts(F.col("data"), '$["@type"]').alias("types"),
        F.when(F.size(own) > 0, own).otherwise(F.col("_context")).alias("contexts"), F.map_keys(F.try_variant_get("data", "$", "map<string,variant>")).alias("fields"), "data",
    )


def type_counts(found: DataFrame, key: str = "url") -> DataFrame:
    """(type, nodes, pages): how often each type comes up."""
    return found.select(key, F.explode("types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct(key).alias("pages"))
