"""Documents for the index: files, JSON, literature, results of tools, plain text. Columns: id, name, source_type, content, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that speak for a result of statistics; payloads that hold nothing.
SIGNALS = ["p_value", "confidence", "hazard", "odds", "risk", "median", "significant", "effect", "correlation"]
NOTHING = ["", "{}", "[]", "null", "none"]


def _document(df: DataFrame, id_, name, kind: str, content, metadata=None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    rows = df.select(id_.cast("string").alias("id"), name.cast("string").alias("name"), F.lit(kind).alias("source_type"), content.alias("content"), (metadata if metadata is not None else none).alias("metadata"))
    return rows.filter(F.trim(F.coalesce("content", F.lit(""))) != "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Each text file of a folder or pattern is one document; one with a zero byte is binary and an error."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    text = F.when(F.contains("value", F.lit("\0")), F.raise_error(F.concat(F.lit("binary file: "), F.col("path")))).otherwise(F.col("value"))
    return _document(rows, F.sha2("path", 256), F.element_at(F.split("path", "/"), -1), "file", text)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Written reports of analysts: the text, Markdown and JSON files of a folder that are not empty."""
    return files(spark, path).filter(F.lower("name").rlike(r"\.(txt|md|markdown|rst|json)$"))


def dictionary_lines(df: DataFrame, key: str, json: str, label: str) -> DataFrame:
    """A JSON object of each row as "key: value" lines under a label; values that are objects become "key.inner: value" lines."""
    outer = F.from_json(F.col(json), "map<string,string>")
    inner = lambda v: F.from_json(v, "map<string,string>")
    nested = lambda k, v: F.transform(F.array_sort(F.map_keys(inner(v))), lambda i: F.concat(k, F.lit("."), i, F.lit(": "), F.coalesce(F.element_at(inner(v), i), F.lit("null"))))
    lines = F.flatten(F.transform(F.array_sort(F.map_keys(outer)), lambda k: F.when(F.startswith(F.element_at(outer, k), F.lit("{")), nested(k, F.element_at(outer, k))).otherwise(F.array(F.concat(k, F.lit(": "), F.coalesce(F.element_at(outer, k), F.lit("null")))))))
    return _document(df, F.col(key), F.lit(label), "data_dictionary", F.concat(F.lit(f"{label}\n"), F.array_join(lines, "\n")))


def literature(df: DataFrame, key: str, title: str, authors: str, year: str, abstract: str, summary: str | None = None) -> DataFrame:
    """A document a paper: lines of title, up to 5 authors (an array), year, abstract and summary, those that there are."""
    line = lambda name, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{name}: "), v))
    parts = [line("Title", F.col(title)), line("Authors", F.array_join(F.slice(authors, 1, 5), ", ")), line("Year", F.col(year).cast("string")), line("Abstract", F.col(abstract))]
    parts += [line("TLDR", F.col(summary))] if summary else []
    about = F.map_from_arrays(F.array(F.lit("paper_id"), F.lit("year")), F.array(F.col(key).cast("string"), F.coalesce(F.col(year).cast("string"), F.lit(""))))
    return _document(df, F.col(key), F.col(title), "literature", F.concat_ws("\n", *parts), about)


def quality(text) -> F.Column:
    """0 for an empty payload, 0.05 for a short error, else 0.2 and more for length, statistical words and being an object; 1 at most."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low, n = F.lower(t), F.length(t)
    says = F.exists(F.array(*map(F.lit, SIGNALS)), lambda w: F.contains(low, w))
    score = F.lit(0.2) + F.when(n >= 80, 0.25).otherwise(0.0) + F.when(n >= 250, 0.15).otherwise(0.0) + F.when(says, 0.25).otherwise(0.0) + F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), 0.15).otherwise(0.0)
    return F.when(low.isin(NOTHING), 0.0).when(F.contains(low, F.lit('"error"')) & (n < 250), 0.05).otherwise(F.round(score, 3))


def tool_results(df: DataFrame, key: str, tool: str, text: str, own: list[str] = ()) -> DataFrame:
    """Results of tools as documents with their quality and sorted top-level keys. What is not worth an index is left out: empty payloads, short errors
    (below 300 characters), texts below 60 characters and results of the tools in ``own``."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    worth = ~F.lower(t).isin(NOTHING) & ~(F.contains(F.lower(t), F.lit('"error"')) & (F.length(t) < 300)) & (F.length(t) >= 60) & (~F.col(tool).isin(list(own)) if own else F.lit(True))
    keys = F.array_join(F.array_sort(F.coalesce(F.json_object_keys(t), F.array().cast("array<string>"))), ",")
    about = F.map_from_arrays(F.array(F.lit("tool"), F.lit("quality"), F.lit("keys")), F.array(F.col(tool), quality(F.col(text)).cast("string"), keys))
    return _document(df.filter(worth), F.col(key), F.concat(F.lit("tool:"), F.col(tool)), "tool_result", t, about)


def texts(df: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """Non-empty texts of users as documents."""
    return _document(df, F.col(key), F.col(name), "user_input", F.col(text))
