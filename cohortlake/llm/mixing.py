"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are ranged by key into buckets of equal key width; a small
table of bucket sums gives the offsets, so that the prefix sum of a source is a sum over buckets plus a window inside
one bucket, and no task ever holds a source. The cut is one key per source, so rows learn their fate from a table with
one row per source and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.work import Scratch, bucket_of, count_words, hash_bits


def random_key(doc_id: str = "doc_id", seed: str = "mix") -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size), one row a source -> adds target.

    A table of one row a source goes through windows over all sources, as the targets depend on each other: sources are named
    collections, few whatever the number of documents. The budget is ``share`` of all sizes, dealt by weight; a target stops at ``cap`` times its source and the excess is
    dealt again. Equivalent closed form: sort by cap over weight; the level is that of the first source it does not fill.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(cap))
    by = Window.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    t = (
        t.withColumn("rn", F.row_number().over(by))
        .withColumn("all", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("filled", F.coalesce(F.sum("top").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("filled")) / F.col("open"))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("rn"))).over(every))
        .withColumn("level", F.max(F.when(F.col("rn") == F.col("first"), F.col("level"))).over(every))
    )
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least("top", F.col("level") * F.col("w"))).alias("target"))


def source_cuts(sized: DataFrame, scratch: Scratch, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sized`` (source, key, size) -> one row per source: source_size, target, epochs, cut (key, size) or null.

    Rows alike in source, key and size stand or fall together. Within the last epoch a row is taken if its middle lies
    within the budget, so that a source misses its target by half a document at most.
    """
    bits = hash_bits(sized.count(), 256)
    units = sized.withColumn("tag", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    units = units.groupBy("tag", "source", "key", "size").agg((F.col("size") * F.count(F.lit(1))).alias("units")).withColumn("bucket", bucket_of(F.col("key"), bits))
    sums = units.groupBy("tag", "source", "bucket").agg(F.sum("units").alias("bucket_units"))
    per_source = sums.groupBy("tag", "source").agg(F.sum("bucket_units").alias("source_size"))
    targets = source_targets(per_source.select("source", "source_size"), weights, share, cap)
    targets = scratch.save(
        targets.select(
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("tag"), "source", "source_size", "target",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
        )
    )
    before = Window.partitionBy("tag").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("tag", "bucket", F.coalesce(F.sum("bucket_units").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("tag", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        units.drop("source").join(offsets, ["tag", "bucket"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("units").over(inside), F.lit(0)))
        .join(targets, "tag")
        .filter(2 * F.col("before") + F.col("units") <= 2 * (F.col("target") - F.col("epochs") * F.col("source_size")))
        .groupBy("tag").agg(F.max(F.struct("key", "size")).alias("cut"))
    )
    return scratch.save(targets.join(last, "tag", "left").select("tag", "source_size", "target", "epochs", "cut"))


def copies(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """``df`` with source, key, size -> adds source_size, target, copies (epochs in which the row is taken)."""
    out = df.withColumn("tag", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(cuts, "tag", "left")
    inside = F.coalesce(F.struct("key", "size") <= F.col("cut"), F.lit(False))
    return out.withColumn("copies", F.col("epochs") + inside.cast("long")).drop("tag", "cut", "epochs")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Null text counts no words; very long texts are counted whole; a null source is a source of its own, the last; a null
    doc_id is an empty id; repeated rows are all counted, and rows alike in source, id and size are taken or left together; an empty table gives
    no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(docs.select("doc_id", "source", random_key().alias("key"), count_words(F.col("text")).alias("size")))
    cuts = source_cuts(sized.select("source", "key", "size"), scratch, weights, share, cap)
    return copies(sized, cuts).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever their names.

    Nulls, empty and very long texts, ties and empty tables are as in ``mix``: a text without words takes nothing of the budget and
    stays once for each epoch that its key is within; repeated rows are taken alike.
    """
    scratch = Scratch(docs.sparkSession)
    sized = docs.select("source", random_key().alias("key"), count_words(F.col("text")).alias("size"))
    cuts = source_cuts(scratch.save(sized), scratch, weights, share, cap)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = {name: F.col(f"c{docs.columns.index(name)}") for name in ("doc_id", "text", "source")}
    keyed = plain.select("*", own["source"].alias("source"), own["doc_id"].alias("doc_id"), count_words(own["text"]).alias("size")).withColumn("key", random_key())
    out = copies(keyed, cuts).filter("copies > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*plain.columns).toDF(*docs.columns)


#: The same mix in DuckDB's SQL.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
srcs AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, source_size * CAST(2.0 AS DOUBLE) AS top,
  CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w FROM srcs),
ranked AS (SELECT *, row_number() OVER o AS rn,
  ((SELECT sum(source_size) FROM srcs) * CAST(1.5 AS DOUBLE) - coalesce(sum(top) OVER (ORDER BY top / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY top / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY top / w, source IS NULL, source)),
chosen AS (SELECT level FROM ranked WHERE level <= top / w ORDER BY rn LIMIT 1),
targets AS (SELECT source, source_size, least(top, (SELECT level FROM chosen) * w) AS target FROM ranked),
goals AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM targets),
units AS (SELECT source, k, size, CAST(size * count(*) AS BIGINT) AS units FROM sized GROUP BY source, k, size),
placed AS (SELECT *, coalesce(sum(units) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units),
kept AS (SELECT p.source, p.k, p.size, (2 * p.before + p.units <= 2 * (g.target - g.epochs * g.source_size)) AS last
  FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT s.doc_id, s.size, g.source_size, g.target, CAST(s.size * (g.epochs + CASE WHEN x.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
JOIN kept x ON x.source IS NOT DISTINCT FROM s.source AND x.k = s.k AND x.size = s.size
"""
