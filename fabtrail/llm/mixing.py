"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Every document gets a random-looking key from its id. A source's documents, in the order of their keys, form a line of
words; the mix takes that line as often as the target asks, and cuts the last round at the exact budget.
The line is split by the leading digits of the keys into slices of like size, so that the prefix sum
needs one shuffle by (source, slice), however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fabtrail.session import stored

WORD = r"[^\x20\x09-\x0D]+"

#: weights of the sources in code point order, repeating
WEIGHTS = (1, 2, 3)

#: a target is at most so many times what its source has
MOST_EPOCHS = 3

#: about so many documents share a slice, up to 16 ** MOST_DIGITS slices
SLICE_ROWS = 500
MOST_DIGITS = 4


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def random_key(doc_id: Column, seed: str) -> Column:
    """32 hex digits of the seed and the id."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: one row per source.

    All sources together get the words that all have. Targets follow the weights, but none is above
    ``most`` times its source; the excess goes to the others by weight. So a target is
    min(most * size, level * weight), where the level makes the sum right: with the sources in order of size / weight the
    first ones are full, and the level is what is left over the weights left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per.withColumn("weight", weight)
        .withColumn("cap", cap.cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn(
            "level", (F.col("total") - F.col("cap_before")) / (F.col("all_weights") - F.col("weight_before"))
        )
        # the first source that stays below its cap sets the level for all after it
        .withColumn("open", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
        .withColumn("level", F.first("open", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def _hex_digits(rows: int) -> int:
    """Leading digits of the key that make slices of about ``SLICE_ROWS`` rows of the whole table."""
    digits = 1
    while digits < MOST_DIGITS and 16**digits * SLICE_ROWS < rows:
        digits += 1
    return digits


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, epochs, part``.

    ``size`` is the number of words of the text (null: 0), ``taken`` the words the mix takes: ``epochs`` whole copies
    and ``part`` words of one more, cut where the source's budget (its target, rounded) ends. So the taken words of a
    source are its rounded target exactly. A null source is a source of its own. A source without words has target 0. Rows that repeat
    a doc_id are further documents, in the order of their sizes. Other columns are not read. Reruns give the same.
    """
    placed = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(F.col("text")).alias("size"),
        ).withColumn("key", random_key(F.col("doc_id"), seed)),
        "sizes",
    )
    digits = _hex_digits(placed.count())
    placed = placed.withColumn("slice", F.substring("key", 1, digits))
    per_slice = placed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        "source", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")
    )
    targets = source_targets(per_slice.withColumnRenamed("words", "size"), weights, most)
    known = (
        starts.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(F.col("s.source").alias("_source"), F.col("slice").alias("_slice"), "start", "source_size", "target")
    )
    inside = (
        Window.partitionBy("source", "slice")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lined = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.round("target").cast("bigint")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("before")))
    return (
        lined.join(known, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
        .withColumn("budget", budget)
        .withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint"),
        )
        .withColumn("part", part.cast("bigint"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select("doc_id", "size", "source_size", "target", "taken", "epochs", "part", "source")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents as often as the mix takes them, all columns as they were; texts stay whole.

    The last round takes a document when at least half of its words lie within the budget, so a source misses its target by
    at most half a document. Documents without words are kept once. Rows that repeat a doc_id count as
    one more copy of it each.
    """
    plan = mix(docs, seed)
    copies = F.col("epochs") + F.when(F.col("part") * 2 >= F.col("size"), 1).otherwise(0)
    per_id = plan.groupBy("doc_id", "size", "source").agg(
        F.max(F.when(F.col("size") == 0, 1).otherwise(copies)).cast("int").alias("_copies")
    )
    per_id = per_id.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"), "_copies")
    own = docs.select(
        F.struct("*").alias("document"), F.col("doc_id").cast("bigint").alias("_id0"), n_words(F.col("text")).alias("_size0"),
        F.col("source").cast("string").alias("_source0"),
    )
    same = F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_size0") == F.col("_size")) & F.col("_source0").eqNullSafe(F.col("_source"))
    return (
        own.join(per_id.where("_copies > 0"), same)
        .select("document", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("document.*")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s
), l AS (
  SELECT a.source, any_value(a.cap) AS cap, any_value(a.weight) AS weight, any_value(a.k) AS k,
         (any_value(a.total) - coalesce(sum(b.cap), 0)) / (any_value(a.weights) - coalesce(sum(b.weight), 0)) AS level
  FROM r a LEFT JOIN r b ON b.k < a.k GROUP BY a.source
), t AS (
  SELECT r.source, r.source_size, least(r.cap, coalesce((SELECT l.level FROM l WHERE l.cap >= l.level * l.weight
         ORDER BY l.k LIMIT 1), 1e300) * r.weight)::DOUBLE AS target FROM r
), c AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c
), f AS (
  SELECT *, greatest(0, least(size, budget - epochs * source_size - start)) AS part FROM e
)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, epochs::BIGINT AS epochs,
       part::BIGINT AS part FROM f
"""
