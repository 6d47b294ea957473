"""Strings at any depth of JSON content, in the order in which they stand, and what is found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.plans import shared

LEAF = "path array<int>, text string"


def _children(json: Column) -> Column:
    """The members of an object or array, in order: an array of (raw, v), raw being JSON text and v its VARIANT.

    A VARIANT sorts an object's members by name, so order and nested members come from the text; types come from it.
    """
    as_map, typed = F.from_json(json, "map<string,string>"), F.from_json(json, "map<string,variant>")
    as_list, of_list = F.from_json(json, "array<string>"), F.from_json(json, "array<variant>")
    pair = lambda raw, v: F.struct(raw.alias("raw"), v.alias("v"))
    members = F.zip_with(F.map_values(as_map), F.map_values(typed), pair)
    return F.when(F.startswith(json, F.lit("{")), members).otherwise(F.zip_with(as_list, of_list, pair))


def nested_strings(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, text) of all strings in a column of JSON: values of objects and arrays at any depth, not names.

    path has the places from the outside in, so its order is that of the text; a document that is a string itself has an
    empty one. What is no JSON, or null, has no strings. Each round opens what the last one found to be nested, and is
    written, so the plan's size does not depend on the depth and a document is never held as a whole but by its first one.
    """
    spark = rows.sparkSession
    root = shared.folder(spark, "strings")
    v = F.try_parse_json(F.col(json))
    top = rows.select(F.col(key), F.array().cast("array<int>").alias("path"), F.trim(F.col(json)).alias("raw"), v.alias("v")).where("v IS NOT NULL")
    level, depth, found = top, 0, None
    while True:
        kind = F.schema_of_variant("v")
        seen = Observation()
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        text = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
        out = level.select(key, "path", F.when(nested, F.col("raw")).alias("raw"), text.alias("text")).where("raw IS NOT NULL OR text IS NOT NULL")
        table = shared.written(out.observe(seen, F.count("raw").alias("n")), f"{root}/level{depth}")
        leaves = table.where("text IS NOT NULL").select(key, "path", "text")
        found = leaves if found is None else found.unionByName(leaves)
        if not seen.get["n"]:
            return found
        inside = table.where("raw IS NOT NULL").select(key, "path", F.posexplode(_children(F.col("raw"))).alias("at", "c"))
        level, depth = inside.select(key, F.array_append("path", F.col("at")).alias("path"), F.col("c.raw").alias("raw"), F.col("c.v").alias("v")), depth + 1


def secrets_in_content(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, hits): the names of the secret patterns in a row's content, each once, in order of first appearance.

    The key is unique; a row without a secret has an empty array. Only the first place of each name is brought together.
    """
    hits = nested_strings(rows, key, json).select(key, "path", F.posexplode(T.secret_hits(F.col("text"))).alias("at", "hit"))
    first = hits.groupBy(key, "hit").agg(F.min(F.struct("path", "at")).alias("first"))
    # as many as there are patterns
    per = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "hit"))), lambda x: x["hit"]).alias("hits"))
    return rows.select(key).join(per, key, "left").select(key, F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))
