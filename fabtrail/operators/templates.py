"""Message templates: exact ones by masking, then merged by similarity.

Which templates merge depends on the set of distinct templates alone, not on order of arrival or counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fabtrail.functions.masking import WILDCARD, mask_message, template_tokens
from fabtrail.operators.ordering import lookup_join
from fabtrail.session import stored

# fixed values: texts of one shape join when at least this share of their tokens is equal;
# the shape is the number of tokens and the leading tokens
SIMILARITY = 0.4
LEADING_TOKENS = 2


def exact_templates(df: DataFrame, message: str = "raw_message") -> DataFrame:
    """``(template, tokens, n)``: distinct masked messages with their counts."""
    masked = df.where(F.col(message) != "").select(mask_message(F.col(message)).alias("_masked"))
    # count first, so that a frequent message is tokenised once per task, not per row
    counts = masked.groupBy("_masked").agg(F.count(F.lit(1)).alias("n"))
    tokens = template_tokens(F.col("_masked"))
    return counts.select(
        F.col("_masked").alias("masked"),
        F.array_join(tokens, " ").alias("template"),
        tokens.alias("tokens"),
        "n",
    )


def _shape(df: DataFrame, leading: int) -> DataFrame:
    """Add the shape a template belongs to; leading tokens with digits do not tell shapes apart."""
    tokens = F.split("template", " ")
    lead = F.transform(
        F.slice(tokens, 1, leading),
        lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t),
    )
    return df.withColumn(
        "width", F.when(F.col("template") == "", F.lit(0)).otherwise(F.size(tokens))
    ).withColumn("shape", F.xxhash64("width", F.array_join(lead, " ")))


def merge_templates(
    templates: DataFrame, similarity: float = SIMILARITY, leading: int = LEADING_TOKENS
) -> DataFrame:
    """``(template, merged)`` for every distinct template.

    A group (at first a shape) in which at least ``similarity`` of the positions hold one token throughout is
    one cluster; its other positions become wildcards. Any other group is parted by the tokens of the position with the fewest
    different ones, the first of equals. Each parting settles one more position, so it ends by itself; a step
    is two aggregations over the tokens of the groups that are still open.
    """
    nodes = _shape(templates.select("template").distinct(), leading)
    open_groups = nodes.where("width > 0").select("template", "width", F.col("shape").alias("group"))
    open_groups = stored(open_groups, "groups")
    done = [nodes.where("width = 0").select("template", F.col("template").alias("merged"))]
    while not open_groups.isEmpty():
        tokens = open_groups.select("group", "width", F.posexplode(F.split("template", " ")).alias("place", "token"))
        # a token that many templates share leaves a task once
        distinct = tokens.distinct()
        places = distinct.groupBy("group", "width", "place").agg(
            F.count(F.lit(1)).alias("kinds"), F.min("token").alias("token")
        )
        shown = F.struct("place", F.when(F.col("kinds") == 1, F.col("token")).otherwise(F.lit(WILDCARD)).alias("token"))
        groups = places.groupBy("group", "width").agg(
            F.count(F.when(F.col("kinds") == 1, 1)).alias("settled"),
            F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "place"))).alias("narrow"),
            F.sort_array(F.collect_list(shown)).alias("shown"),
        )
        groups = groups.select(
            "group",
            (F.col("settled") >= similarity * F.col("width")).alias("alike"),
            F.col("narrow.place").alias("narrow"),
            F.array_join(F.transform("shown", lambda x: x["token"]), " ").alias("merged"),
        )
        judged = stored(open_groups.join(stored(groups, "judged"), "group"), "judged")
        done.append(judged.where("alike").select("template", "merged"))
        token = F.get(F.split("template", " "), F.col("narrow"))
        open_groups = judged.where(~F.col("alike")).select(
            "template", "width", F.xxhash64("group", "narrow", token).alias("group")
        )
    return reduce(DataFrame.unionByName, done)


def cluster_id(template: Column) -> Column:
    """Stable id of a cluster: a hash of its template."""
    return F.xxhash64(template)


def mine_templates(df: DataFrame, message: str = "raw_message", **settings) -> DataFrame:
    """Rows with ``drain_cluster_id`` and ``drain_template`` filled from their message."""
    exact = stored(exact_templates(df, message), "templates")
    merged = merge_templates(exact, **settings)
    return _filled(df, message, exact, merged.withColumn("cluster", cluster_id(F.col("merged"))))


#: templates that have a cluster for good
BOOK = "template string, merged string, cluster bigint"


def new_in_book(exact: DataFrame, book: DataFrame, **settings) -> DataFrame:
    """The templates of ``exact`` that ``book`` (:data:`BOOK`) does not have, with their clusters.

    They are merged together with the templates of the clusters there are. A new template that falls into one group with such
    clusters belongs to that of the smallest id; others make new clusters. No cluster changes its template or its id.
    """
    fresh = exact.select("template").distinct().join(book.select("template"), "template", "left_anti")
    fresh = stored(fresh, "new-templates")
    clusters = stored(book.select(F.col("merged").alias("template"), "cluster").distinct(), "clusters")
    groups = stored(merge_templates(fresh.unionByName(clusters.select("template")), **settings), "merged")
    first = F.min(F.struct("cluster", F.col("template").alias("merged"))).alias("first")
    taken = groups.join(clusters, "template").groupBy(F.col("merged").alias("group")).agg(first)
    own = fresh.join(groups, "template").withColumnRenamed("merged", "group").join(taken, "group", "left")
    return own.select(
        "template",
        F.coalesce("first.merged", "group").alias("merged"),
        F.coalesce("first.cluster", cluster_id(F.col("group"))).alias("cluster"),
    )


def fill_from_book(df: DataFrame, exact: DataFrame, book: DataFrame, message: str = "raw_message") -> DataFrame:
    """Rows with ``drain_cluster_id`` and ``drain_template`` from a book that has all their templates."""
    return _filled(df, message, exact, book)


def _filled(df: DataFrame, message: str, exact: DataFrame, book: DataFrame) -> DataFrame:
    known = exact.join(book, "template").select(
        "masked", F.col("merged").alias("_template"), F.col("cluster").alias("_cluster")
    )
    keep = [c for c in df.columns if c not in ("drain_cluster_id", "drain_template")]
    masked = df.select(*keep, mask_message(F.col(message)).alias("masked"))
    counts = exact.select("masked", F.col("n").alias("_n"))
    joined = lookup_join(masked, known, ["masked"], counts)
    filled = joined.withColumn("drain_template", F.col("_template")).withColumn("drain_cluster_id", F.col("_cluster"))
    return filled.select(*df.columns, *[c for c in ("drain_cluster_id", "drain_template") if c not in df.columns])


def template_summary(df: DataFrame) -> DataFrame:
    """Per cluster: rows, first and last time, one message."""
    return (
        df.where(F.col("drain_cluster_id").isNotNull())
        .groupBy("drain_cluster_id", "drain_template")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
        .orderBy(F.desc("count"), "drain_template")
    )


def template_peers(df: DataFrame, fault_id: str) -> DataFrame:
    """Other rows of the cluster a row belongs to."""
    cluster = df.where(F.col("id") == fault_id).agg(F.first("drain_cluster_id")).scalar()
    return df.where((F.col("drain_cluster_id") == cluster) & (F.col("id") != fault_id))
