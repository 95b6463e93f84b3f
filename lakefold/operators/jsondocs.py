"""JSON tree walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import prefix_sums, tree_links, whole
from ..functions.jsontext import is_valid_json, json_tokens


def _string(token: Column) -> Column:
    """Value of a string literal; only literals with escapes need the JSON reader."""
    parsed = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
    return F.when(F.contains(token, F.lit("\\")), parsed).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def json_nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pre-order nodes of valid documents: node id, parent id, depth, key, kind, scalar text, children.

    Tokens, depths, parents and child counts are computed inside the row, so depth is not limited, nothing is
    shuffled, and only finished node rows are exploded.
    """
    toks = F.col("tokens")
    valid = docs.filter(is_valid_json(F.col(text))).select(key, json_tokens(F.col(text)).alias("tokens"))
    steps = F.transform(toks, lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0))
    described = F.zip_with(
        F.transform(toks, lambda t, i: F.struct(
            (~t.isin("}", "]", ",", ":") & F.coalesce(F.get(toks, i + 1) != ":", F.lit(True))).alias("node"),
            F.when((i >= 2) & (F.get(toks, i - 1) == ":"), F.get(toks, i - 2)).alias("key"), t.alias("token"))),
        prefix_sums(steps), lambda t, d: F.struct(t["node"].alias("node"), (d + 1).alias("depth"), t["key"].alias("key"), t["token"].alias("token")))
    nodes = valid.select(key, F.filter(described, lambda d: d["node"]).alias("nodes"))
    linked = nodes.select(key, F.arrays_zip("nodes", tree_links(F.col("nodes.depth")).alias("links")).alias("rows"))
    rows = linked.select(key, F.posexplode(whole("rows")).alias("at", "n")).select(
        key, (F.col("at") + 1).alias("node_id"), (F.col("n.links.parent") + 1).cast("bigint").alias("parent"), F.col("n.nodes.depth").alias("depth"),
        F.col("n.nodes.key").alias("name"), F.col("n.nodes.token").alias("token"), F.col("n.links.children").cast("bigint").alias("children"))
    first = F.substring("token", 1, 1)
    return rows.select(
        key, "node_id", "parent", "depth",
        _string(F.col("name")).alias("key"),
        F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string")
        .when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number").alias("kind"),
        F.when(first == '"', _string(F.col("token")))
        .when(~first.isin("{", "["), F.col("token")).alias("value"),
        "children",
    )
