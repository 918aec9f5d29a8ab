"""Scene documents as relations: offsets, triangles, first-seen deduplication, names, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offsets(parts: DataFrame, group: str, order: list[str], length: str) -> DataFrame:
    """parts with `base`: the summed length of the earlier parts of the group."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum(length).over(w), F.lit(0)))


def list_triangles(refs: DataFrame, group: str, order: str, vertex: str) -> DataFrame:
    """Triangles of consecutive threes, the last two swapped; an unfinished three is dropped."""
    w = W.partitionBy(group).orderBy(order)
    rows = refs.withColumn("i", F.row_number().over(w) - 1).withColumns({"b": F.lead(vertex, 2).over(w), "c": F.lead(vertex, 1).over(w)})
    return rows.where("i % 3 = 0 and b is not null").select(group, F.floor(F.col("i") / 3).alias("tid"), F.col(vertex).alias("a"), "b", "c")


def strip_triangles(refs: DataFrame, group: str, order: str, vertex: str) -> DataFrame:
    """Triangles of each three neighbours; every other one is turned, so that all face one way."""
    w = W.partitionBy(group).orderBy(order)
    rows = refs.withColumn("i", F.row_number().over(w) - 1).withColumns({"n1": F.lead(vertex, 1).over(w), "n2": F.lead(vertex, 2).over(w)})
    odd = F.col("i") % 2 == 1
    return rows.where("n2 is not null").select(group, F.col("i").alias("tid"), F.col(vertex).alias("a"), F.when(odd, F.col("n2")).otherwise(F.col("n1")).alias("b"), F.when(odd, F.col("n1")).otherwise(F.col("n2")).alias("c"))


def fan_triangles(refs: DataFrame, group: str, order: str, vertex: str) -> DataFrame:
    """Triangles of the group's first vertex and each two neighbours after it."""
    w = W.partitionBy(group).orderBy(order)
    rows = refs.withColumn("i", F.row_number().over(w) - 1).withColumns({"a": F.first(vertex).over(w), "c": F.lead(vertex, 1).over(w)})
    return rows.where("i >= 1 and c is not null").select(group, (F.col("i") - 1).alias("tid"), "a", F.col(vertex).alias("b"), "c")


def first_in(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where("rank = 1").drop("rank")


def numbered(rows: DataFrame, order: str, name: str, first: int = 0, parts: int = 32) -> DataFrame:
    """rows with `name`: consecutive numbers by a numeric, distinct order, without one task that sees all rows.

    Quantiles cut the order into ranges; each range counts its own rows, and the sums of the ranges before are added.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("__part", part)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # `parts` rows at most
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    dealt = dealt.withColumn("__i", F.row_number().over(W.partitionBy("__part").orderBy(order)))
    return dealt.join(F.broadcast(base), "__part").withColumn(name, (F.col("__base") + F.col("__i") - 1 + first).cast("int")).drop("__part", "__i", "__base")


def first_seen_ids(rows: DataFrame, key: Column, seq: str, first: int = 0) -> DataFrame:
    """key, seen (its first seq, a number), id: ids count the distinct keys in the order in which they first appear."""
    seen = rows.groupBy(key.alias("key")).agg(F.min(seq).alias("seen"))
    return numbered(seen, "seen", "id", first).select("key", "seen", "id")


def merged_ids(rows: DataFrame, group: str, key: Column, seq: str, default: Column) -> DataFrame:
    """group, seq and id of every row: rows of a group that share a key share an id, counted from 1 by first appearance.

    Rows with the key `default` get 0, the entry that every merged list begins with.
    """
    keyed = rows.select(group, seq, key.alias("key"), (key == default).alias("plain"))
    first = keyed.where(~F.col("plain")).groupBy(group, "key").agg(F.min(seq).alias("seen"))
    ids = first.select(group, "key", F.row_number().over(W.partitionBy(group).orderBy("seen")).alias("id"))
    return keyed.join(ids, [group, "key"], "left").select(group, seq, F.coalesce("id", F.lit(0)).alias("id"))


def remapped(surfaces: DataFrame, ids: DataFrame, keys: list[str], column: str = "material") -> DataFrame:
    """surfaces with the merged id in the place of a column; an id that isn't known stays as it is. ids: keys, column, id."""
    return surfaces.join(ids, [*keys, column], "left").withColumn(column, F.coalesce("id", column)).drop("id")


def concatenated(parts: DataFrame, group: str, order: list[str], data: str) -> DataFrame:
    """group, base (of each part, in order), length: how buffers lie in their concatenation, and how long it is."""
    sized = offsets(parts.withColumn("length", F.octet_length(data).cast("bigint")), group, order, "length")
    return sized.withColumn("total", F.sum("length").over(W.partitionBy(group)))


def first_named(handles: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """handles (key, name, ...) with `node`: the first node (key, node, name) of that name, case aside; others are left out."""
    first = nodes.groupBy(*key, F.lower("name").alias("__name")).agg(F.min("node").alias("node"))
    return handles.withColumn("__name", F.lower("name")).join(first, [*key, "__name"]).drop("__name")


def first_vertices(rows: DataFrame, group: str, key: list[str], seq: str, value: str) -> DataFrame:
    """The first vertex of each key in a group, numbered by first appearance within the group."""
    kept = rows.groupBy(group, *key).agg(F.min(seq).alias("seen"), F.min_by(value, seq).alias(value))
    return kept.withColumn("vertex", F.row_number().over(W.partitionBy(group).orderBy("seen")) - 1)


def unique_names(rows: DataFrame, name: str, seq: str) -> DataFrame:
    """rows with `unique`: a name that came before (case aside) gets _1, _2 ... before its extension."""
    n = F.row_number().over(W.partitionBy(F.lower(name)).orderBy(seq)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("n", n).withColumn("unique", F.when(F.col("n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), ext))).drop("n")


def tree(spark: SparkSession, nodes: DataFrame, limit: int = 100) -> DataFrame:
    """node, root, depth, path of every node of a forest of nodes(node, parent), walked down from the roots.

    Roots are the nodes whose parent is null or missing. Nodes on a cycle are never reached. A forest deeper than `limit`
    stops the query with an error; its number of nodes does not limit it.
    """
    nodes.createOrReplaceTempView("__nodes")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # as many rows as there are nodes
    return spark.sql(f"""
        WITH RECURSIVE walk(node, root, depth, path) MAX RECURSION LEVEL {limit} AS (
            SELECT n.node, n.node, 0, CAST(n.node AS STRING) FROM __nodes n LEFT ANTI JOIN __nodes p ON n.parent = p.node
            UNION ALL
            SELECT c.node, w.root, w.depth + 1, concat(w.path, '/', c.node) FROM walk w JOIN __nodes c ON c.parent = w.node)
        SELECT * FROM walk""")


def bearing_nodes(walked: DataFrame, meshes: DataFrame) -> DataFrame:
    """Nodes that hold a mesh or have one below them: the nodes on the paths of those that do."""
    on_path = walked.join(meshes.select("node"), "node", "left_semi").select(F.explode(F.split("path", "/")).alias("node"))
    return walked.join(on_path.select(F.col("node").cast(walked.schema["node"].dataType)).distinct(), "node", "left_semi")


def best_lod(lods: DataFrame, model: str = "model") -> DataFrame:
    """model and its most detailed file: the largest minimum size among those that name a file, the earlier among equals."""
    named = lods.where(F.trim("file") != "").where(F.expr("try_cast(min_size AS INT)").isNotNull())
    return named.groupBy(model).agg(F.max_by("file", F.struct(F.expr("try_cast(min_size AS INT)").alias("size"), (-F.col("seq")).alias("seq"))).alias("file"))
