"""Taxonomy DAG operators over ``nodes``, ``edges`` and their ``closure``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import cut_lineage


def edges_of(nodes: DataFrame) -> DataFrame:
    """(parent, child) pairs of node rows with a ``parents`` array."""
    return nodes.select(F.explode("parents").alias("parent"), F.col("id").alias("child"))


def names_of(nodes: DataFrame) -> DataFrame:
    """(node_id, lang, name, kind) from the names and synonyms of node rows."""
    names = nodes.select("id", F.explode("names").alias("lang", "name")).withColumn("kind", F.lit("name"))
    synonyms = nodes.select("id", F.explode("synonyms").alias("lang", "all")).select("id", "lang", F.explode("all").alias("name"))
    return names.unionByName(synonyms.withColumn("kind", F.lit("synonym"))).withColumnRenamed("id", "node_id")


def taxonomy_closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All (ancestor, descendant) pairs, self excluded.

    Doubling of the shortest paths: where these are longer than ``reach`` and at most twice as
    long, they pass a node exactly ``reach`` above the descendant.  Each round joins the pairs
    at that distance with the pairs above such nodes, so that a path is found once and not cut
    in every possible place.  A DAG of depth d needs log2(d) rounds; every round writes its new
    pairs once and the loop ends when none is at the next distance.
    """
    fresh, _ = cut_lineage(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct().withColumn("steps", F.lit(1)))
    known, reach = fresh, 1
    for _ in range(max_rounds):
        below = fresh.where(F.col("steps") == reach).select(F.col("ancestor").alias("mid"), "descendant")
        mids, n = cut_lineage(below.select("mid").distinct())
        if n == 0:
            return known.drop("steps")
        # few towards the roots: written, so that their size is known when they are joined
        above, n = cut_lineage(known.withColumnRenamed("descendant", "mid").join(mids, "mid", "left_semi"))
        if n == 0:
            return known.drop("steps")
        longer = above.join(below, "mid").groupBy("ancestor", "descendant").agg((F.min("steps") + reach).alias("steps"))
        possible = known.join(above.select("ancestor"), "ancestor", "left_semi").select("ancestor", "descendant")
        fresh, _ = cut_lineage(longer.join(possible, ["ancestor", "descendant"], "left_anti"))
        known, reach = known.unionByName(fresh), reach * 2
    raise ValueError("taxonomy has a cycle or is deeper than 2^max_rounds")


def closure_of(edges: DataFrame, tags: DataFrame, tag: str = "value_tag", max_steps: int = 32) -> DataFrame:
    """The pairs of ``taxonomy_closure`` whose descendant is among ``tags``, found from these alone.

    One edge further up per round; where paths are longer than ``max_steps`` the whole closure
    is made instead.
    """
    wanted, _ = cut_lineage(tags.select(F.col(tag).alias("descendant")).where(F.col(tag).isNotNull()).distinct())
    up, _ = cut_lineage(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("reached")).distinct())
    known, _ = cut_lineage(wanted.join(up.withColumnRenamed("reached", "descendant"), "descendant").select("ancestor", "descendant"))
    fresh = known
    for _ in range(max_steps):
        step = fresh.withColumnRenamed("ancestor", "reached").join(up, "reached").select("ancestor", "descendant").distinct()
        fresh, grown = cut_lineage(step.join(known, ["ancestor", "descendant"], "left_anti"))
        if grown == 0:
            return known
        known = known.unionByName(fresh)
    return taxonomy_closure(edges).join(wanted, "descendant", "left_semi").select("ancestor", "descendant")


def tags_above(members: DataFrame, closure: DataFrame, group: list[str], tag: str) -> DataFrame:
    """(group..., tags): the distinct ancestors of a group's tags, as one array.

    A tag's ancestors are put together before, so that a group adds up a row for each of its tags.
    The array is as long as the taxonomy has tags above the group's, however many rows the group has.
    """
    lists = closure.groupBy(F.col("descendant").alias(tag)).agg(F.collect_list("ancestor").alias("__above"))
    above = members.select(*group, tag).distinct().join(lists, tag)
    return above.groupBy(*group).agg(F.array_distinct(F.flatten(F.collect_list("__above"))).alias("__tags"))


def deepest_nodes(df: DataFrame, closure: DataFrame, group: list[str], tag: str = "value_tag") -> DataFrame:
    """Drop rows whose tag is an ancestor of another tag of the group.

    The ancestors implied by a group's tags are computed once and meet its rows by the group alone, so that
    rows which lie by it stay: no pairwise comparison inside a group.
    """
    implied = tags_above(df, closure, group, tag)
    return df.join(implied, group, "left").where(~F.coalesce(F.array_contains("__tags", F.col(tag)), F.lit(False))).drop("__tags")


def is_parent_of_any(df: DataFrame, members: DataFrame, closure: DataFrame, group: list[str], tag: str = "value_tag") -> DataFrame:
    """Adds ``is_parent``: the tag is an ancestor of some member of its group.

    ``members``: (group..., member).  Unknown ids give false.
    """
    known = members.select(*group, F.col("member").alias("descendant")).distinct()
    implied = known.join(closure, "descendant").select(*group, F.col("ancestor").alias(tag)).distinct().withColumn("is_parent", F.lit(True))
    return df.join(implied, [*group, tag], "left").withColumn("is_parent", F.coalesce("is_parent", F.lit(False)))


def canonical_tag(df: DataFrame, nodes: DataFrame, synonyms: DataFrame, tag: str = "value_tag", out: str = "canonical") -> DataFrame:
    """Known id as it is, else the id of a localised synonym tag, else null.

    ``synonyms``: (tag, id) for ``<lang>:<tag of name or synonym>``.
    """
    ids = nodes.select(F.col("id").alias(tag)).distinct().withColumn("__known", F.lit(True))
    alt = synonyms.groupBy(F.col("tag").alias(tag)).agg(F.min("id").alias("__alt"))
    joined = df.join(ids, tag, "left").join(alt, tag, "left")
    return joined.withColumn(out, F.when(F.col("__known"), F.col(tag)).otherwise(F.col("__alt"))).drop("__known", "__alt")


def localized_name(df: DataFrame, names: DataFrame, lang: str, tag: str = "value_tag", fallback: str = "en") -> DataFrame:
    """Node name in a language, else the fallback language, else the id."""
    both = names.where((F.col("kind") == "name") & F.col("lang").isin(lang, fallback)).groupBy(F.col("node_id").alias(tag)).agg(
        F.max(F.when(F.col("lang") == lang, F.col("name"))).alias("__own"),
        F.max(F.when(F.col("lang") == fallback, F.col("name"))).alias("__fb"),
    )
    return df.join(both, tag, "left").withColumn("localized", F.coalesce("__own", "__fb", tag)).drop("__own", "__fb")


def category_hierarchy(nodes: DataFrame, edges: DataFrame, index: DataFrame, root: int = 0) -> DataFrame:
    """(parent_index, child_index) rows; parentless nodes hang under ``root``.

    ``index``: (id, idx).
    """
    has_parent = edges.select(F.col("child").alias("id")).distinct()
    tops = nodes.select("id").join(has_parent, "id", "left_anti").join(index, "id").select(F.lit(root).cast("long").alias("parent_index"), F.col("idx").cast("long").alias("child_index"))
    up = index.select(F.col("id").alias("parent"), F.col("idx").cast("long").alias("parent_index"))
    down = index.select(F.col("id").alias("child"), F.col("idx").cast("long").alias("child_index"))
    return tops.unionByName(edges.join(up, "parent").join(down, "child").select("parent_index", "child_index")).distinct()


def neighbors(edges: DataFrame, tags: DataFrame, tag: str = "value_tag") -> DataFrame:
    """(tag, relation, neighbor): parents, children and siblings of the given tags."""
    wanted = tags.select(F.col(tag).alias("node")).distinct()
    parents = wanted.join(edges, wanted["node"] == edges["child"]).select("node", F.col("parent").alias("neighbor"))
    children = wanted.join(edges, wanted["node"] == edges["parent"]).select("node", F.col("child").alias("neighbor"))
    other = edges.select(F.col("parent").alias("neighbor"), F.col("child").alias("sibling"))
    siblings = parents.join(other, "neighbor").where(F.col("sibling") != F.col("node")).select("node", F.col("sibling").alias("neighbor")).distinct()
    out = parents.withColumn("relation", F.lit("parent"))
    out = out.unionByName(children.withColumn("relation", F.lit("child"))).unionByName(siblings.withColumn("relation", F.lit("sibling")))
    return out.withColumnRenamed("node", tag)


def taxonomy_export(names: DataFrame, lang: str = "en") -> DataFrame:
    return names.where((F.col("kind") == "name") & (F.col("lang") == lang)).select(F.col("node_id").alias("id"), "name")
