"""Search in a tree given by parent ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.joins import missing_from
from quillstream.runtime import Workspace


def lineage(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """(node_id, ancestor_id, up) for every node and ancestor, itself at 0 (GRF-01, GRF-03).

    Distances double each step: the ancestors 1, 2, 4 ... up are joined to what
    is known, so a tree of depth d takes log2(d) joins. It ends when a step
    finds no new pair, which is so in a cycle too (each node of a cycle is an
    ancestor of the others, at the fewest steps).
    """
    space = Workspace(tree.sparkSession, "lineage")
    leap = space.put(tree.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node_id"), F.col(parent).alias("ancestor_id")))
    known = space.put(tree.select(F.col(node).alias("node_id"), F.col(node).alias("ancestor_id"), F.lit(0).alias("up")).distinct())
    size, pairs = 1, known.count()
    while True:
        after = leap.select(F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id"))
        further = known.join(after, "ancestor_id").select("node_id", F.col("next_id").alias("ancestor_id"), (F.col("up") + size).alias("up"))
        more = space.put(known.unionByName(further).groupBy("node_id", "ancestor_id").agg(F.min("up").alias("up")))
        known, before, pairs = more, pairs, more.count()
        if pairs == before:
            return known
        leap = space.put(leap.join(after, "ancestor_id").select("node_id", F.col("next_id").alias("ancestor_id")).distinct())
        size *= 2


def orphans(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes whose parent isn't in the tree (GRF-01)."""
    return missing_from(tree.filter(F.col(parent).isNotNull()), tree.select(F.col(node).alias(parent)), [parent])


def nearest_supported(tree: DataFrame, node: str, parent: str, tools: Sequence[str]) -> DataFrame:
    """Per node and tool the supported nodes with the fewest steps up and down: node_id, tool, found_id, distance (GRF-02..05).

    A node supports a tool if the tool's column is neither NULL nor empty. Ties
    give all. Per ancestor only its nearest supported descendants are joined to
    the nodes below it.
    """
    up = lineage(tree, node, parent)
    has = tree.select(F.col(node).alias("found_id"), F.explode(F.create_map(*[x for t in tools for x in (F.lit(t), F.col(t))])).alias("tool", "code")).filter("code <> ''").drop("code")
    down = up.select(F.col("node_id").alias("found_id"), "ancestor_id", F.col("up").alias("down")).join(has, "found_id")
    best = down.groupBy("ancestor_id", "tool").agg(F.min("down").alias("down"))
    reach = up.join(best, "ancestor_id").withColumn("distance", F.col("up") + F.col("down"))
    least = reach.groupBy("node_id", "tool").agg(F.min("distance").alias("distance"))
    via = reach.join(least, ["node_id", "tool", "distance"]).select("node_id", "tool", "distance", "ancestor_id", "down")
    return via.join(down, ["ancestor_id", "tool", "down"]).select("node_id", "tool", "found_id", "distance").distinct()


def chosen_code(choices: DataFrame, tree: DataFrame, node: str, parent: str, tool: str, language: str = "language_iso", override: str = "override") -> DataFrame:
    """``choices`` with the code a tool is to be asked for, how it was found, and a status (GRF-06, GRF-07).

    An override that isn't empty wins. Else the language (its three-letter
    code, else its two-letter code) is looked up in the tree and the nearest
    node the tool knows is taken, on ties the one with the smallest code; status
    is 200, or 400 if there is neither.
    """
    near = nearest_supported(tree, node, parent, [tool])
    code = tree.select(F.col(node).alias("found_id"), F.col(tool).alias("found_code"))
    best = near.join(code, "found_id").groupBy("node_id").agg(F.min("found_code").alias("nearest"), F.min("distance").alias("distance"))
    named = lambda c, rank: tree.filter(F.col(c) != "").select(F.col(c).alias("iso"), F.struct(F.lit(rank).alias("rank"), F.col(node).alias("node_id")).alias("n"))
    codes = named("iso639_3", 0).unionByName(named("iso639_1", 1)).groupBy("iso").agg(F.min("n").alias("n")).select("iso", "n.node_id")
    out = choices.join(codes, choices[language] == codes["iso"], "left").join(best, "node_id", "left")
    given = F.nullif(F.trim(F.coalesce(F.col(override), F.lit(""))), F.lit(""))
    code = F.coalesce(given, F.col("nearest"))
    how = F.when(given.isNotNull(), "override").when(F.col("distance") == 0, "same").when(F.col("nearest").isNotNull(), "nearest").otherwise("none")
    return out.select(*[choices[c] for c in choices.columns], code.alias("code"), how.alias("found_by"), F.when(code.isNull(), 400).otherwise(200).alias("status"))


def main(argv: Sequence[str] | None = None) -> int:
    """``python -m quillstream.operators.graph TREE.parquet TOOL CODE...``: the nearest code the tool knows, a line each (GRF-08)."""
    import sys

    from pyspark.sql import SparkSession

    path, tool, *codes = list(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.getOrCreate()
    asked = spark.createDataFrame([(c, "") for c in codes], "language_iso string, override string")
    rows = chosen_code(asked, spark.read.parquet(path), "id", "parent_id", tool).collect()
    for r in sorted(rows, key=lambda r: codes.index(r.language_iso)):
        print(r.language_iso, r.code or "-", r.found_by)
    return 0 if all(r.status == 200 for r in rows) else 4


if __name__ == "__main__":
    raise SystemExit(main())
