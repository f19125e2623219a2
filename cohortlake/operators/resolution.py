"""Which column a sentence means by an endpoint, a group, a time or a variable, with the source of the answer; ambiguity is refused.

Aliases of the columns of many tables are one table (table, role, column, alias, tier). A sentence becomes its runs of words, which meet
aliases of its table by equality, so the work grows with the sentences, not with sentences times aliases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.longform import need, saved

# Words that ask for a role.
ASKS = {
    "endpoint": ["mortality", "death", "dead", "deceased", "outcome", "endpoint", "survival"],
    "group": ["treatment", "trt", "arm", "arms", "group", "groups", "therapy"],
    "time": ["time", "days", "months", "years", "follow-up", "follow up", "duration", "survival"],
}
ROLES = ["endpoint", "group", "time", "variable"]


def plain(text) -> F.Column:
    """Lower-case letters and digits with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def alias_table(columns: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(table, role, column, alias, tier) from ``columns`` (table, role, column), whose names are aliases of tier 1, and ``dictionary`` (table,
    column, alias), whose aliases are of tier 2. A column may have several roles."""
    need(columns, "table", "role", "column")
    own = columns.select("table", "role", "column", plain(F.col("column")).alias("alias"), F.lit(1).alias("tier"))
    if dictionary is not None:
        need(dictionary, "table", "column", "alias")
        more = columns.join(dictionary.withColumnRenamed("alias", "_a"), ["table", "column"]).select("table", "role", "column", plain(F.col("_a")).alias("alias"), F.lit(2).alias("tier"))
        own = own.unionByName(more)
    return own.filter("alias <> ''").distinct()


def mentions(claims: DataFrame, key: str, text: str, table: str, aliases: DataFrame) -> DataFrame:
    """key, role, tier, columns: the columns of the longest aliases of each role and tier that a sentence has as whole words, by name."""
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    words = claims.select(F.col(key).alias("k"), F.col(table).alias("t"), F.split(plain(F.col(text)), " ").alias("w"))
    n = F.size("w")

    def of_length(k: int) -> DataFrame:
        joined = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
        return words.filter(n >= k).select("k", "t", F.lit(k).alias("length"), F.explode(joined).alias("run"))

    runs = reduce(DataFrame.unionByName, map(of_length, range(1, longest + 1)))
    hits = runs.distinct().join(aliases.withColumnRenamed("table", "_t"), (F.col("t") == F.col("_t")) & (F.col("run") == F.col("alias")))
    best = hits.groupBy("k", "role", "tier").agg(F.max("length").alias("length"))
    return hits.join(best, ["k", "role", "tier", "length"]).groupBy("k", "role", "tier").agg(F.array_sort(F.collect_set("column")).alias("columns"))  # columns of one table


def resolved(claims: DataFrame, key: str, text: str, table: str, columns: DataFrame, dictionary: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """key, role, column, source, confidence, warnings: one row a sentence and role.

    In order: the column that the text names (explicit_text); the one that ``metadata`` (table, role, column) states; the one whose description
    in ``dictionary`` the text has (data_dictionary); the only candidate of the role, if the text asks for the role (heuristic). Where a tier
    finds several columns the answer is null, confidence ambiguous, and later tiers are not tried; so too where metadata names a column that the table
    lacks and the text asks for the role (unresolved). A variable is only taken from text and dictionary, and never a column of another role.
    """
    need(claims, key, text, table)
    only = columns.join(columns.filter("role <> 'variable'").select("table", "column").distinct().withColumn("_taken", F.lit(True)), ["table", "column"], "left")
    columns = saved(only.filter("role <> 'variable' OR _taken IS NULL").select("table", "role", "column"))
    found = saved(mentions(claims, key, text, table, saved(alias_table(columns, dictionary))))
    at = lambda tier, name: found.filter(F.col("tier") == tier).select(F.col("k").alias(f"_k{tier}"), F.col("role").alias(f"_r{tier}"), F.col("columns").alias(name))
    rows = claims.select(F.col(key).alias("_k"), F.col(table).alias("_t"), plain(F.col(text)).alias("_p"), F.explode(F.array(*map(F.lit, ROLES))).alias("role"))
    rows = rows.join(at(1, "_named"), (F.col("_k") == F.col("_k1")) & (F.col("role") == F.col("_r1")), "left").join(at(2, "_told"), (F.col("_k") == F.col("_k2")) & (F.col("role") == F.col("_r2")), "left")
    whole = columns.groupBy(F.col("table").alias("_t3"), F.col("role").alias("_r3")).agg(F.array_sort(F.collect_set("column")).alias("_all"))  # columns of one table
    rows = rows.join(whole, (F.col("_t") == F.col("_t3")) & (F.col("role") == F.col("_r3")), "left")
    if metadata is not None:
        need(metadata, "table", "role", "column")
        rows = rows.join(metadata.select(F.col("table").alias("_t4"), F.col("role").alias("_r4"), F.col("column").alias("_stated")).dropDuplicates(["_t4", "_r4"]), (F.col("_t") == F.col("_t4")) & (F.col("role") == F.col("_r4")), "left")
    else:
        rows = rows.withColumn("_stated", F.lit(None).cast("string"))
    asks = F.lit(False)
    for role, said in ASKS.items():
        asks = asks | ((F.col("role") == role) & F.col("_p").rlike(rf"\b(?:{'|'.join(plain_words(w) for w in said)})\b"))
    real = F.filter(F.col("_all"), lambda c: F.lower(c) == F.lower("_stated"))
    many = lambda c, what: F.concat(F.lit(what), F.array_join(c, ", "), F.lit("."))
    none, no = F.lit(None).cast("string"), F.array().cast("array<string>")
    answer = lambda column, source, confidence, warnings=no: F.struct(column.alias("column"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), warnings.alias("warnings"))
    guess = F.col("role") != "variable"
    out = (
        F.when(F.size("_named") == 1, answer(F.col("_named")[0], "explicit_text", "exact"))
        .when(F.size("_named") > 1, answer(none, "explicit_text", "ambiguous", F.array(many(F.col("_named"), "Several columns are named: "))))
        .when(guess & (F.size(real) > 0), answer(real[0], "metadata", "exact", F.array(F.concat(F.lit("Stated by metadata: "), F.col("_stated"), F.lit(".")))))
        .when(guess & F.col("_stated").isNotNull() & asks, answer(none, "metadata", "unresolved", F.array(F.concat(F.lit("Metadata states a column that is not there: "), F.col("_stated"), F.lit(".")))))
        .when(F.size("_told") == 1, answer(F.col("_told")[0], "data_dictionary", "unique_alias", F.array(many(F.col("_told"), "By its description: "))))
        .when(F.size("_told") > 1, answer(none, "data_dictionary", "ambiguous", F.array(many(F.col("_told"), "Descriptions fit several columns: "))))
        .when(guess & asks & (F.size("_all") == 1), answer(F.col("_all")[0], "heuristic", "unique_alias", F.array(many(F.col("_all"), "The only candidate: "))))
        .when(guess & asks & (F.size("_all") > 1), answer(none, "heuristic", "ambiguous", F.array(many(F.col("_all"), "Several candidates: "))))
        .otherwise(answer(none, "heuristic", "unresolved"))
    )
    return rows.select(F.col("_k").alias(key), "role", out.alias("_a")).select(key, "role", "_a.*")


def plain_words(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())
