"""How well selected columns predict an outcome, and methods of selection side by side: one split for all, models of pyspark.ml, AUC from ranks."""

from __future__ import annotations

import time

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators import features
from cohortlake.operators.guardrails import numeric_columns
from cohortlake.operators.longform import missing, need, saved
from cohortlake.operators.order import Ranges

BUCKETS = 10_000
#: So many strata at most are sent to every task; more are joined by shuffle, on the bucket too, so that no stratum makes a task.
MOST_STRATA = 100_000


def split(df: DataFrame, key: str, stratum: str | None = None, share: float = 0.2) -> DataFrame:
    """Adds held_out: of each stratum the rows whose key hashes into the first buckets that hold ``share`` of it at least. The same for a
    row whatever the partitioning; counts of buckets decide, no stratum is sorted."""
    need(df, key, *([stratum] if stratum else []))
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("split")), F.lit(BUCKETS)).cast("int")
    rows = df.withColumn("_b", bucket).withColumn("_s", F.col(stratum).cast("string") if stratum else F.lit(""))
    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # buckets, not rows
    ends = counts.withColumn("u", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("_s"))).filter(F.col("u") >= share * F.col("n"))
    ends = saved(ends.groupBy(F.col("_s").alias("_k")).agg(F.min("_b").alias("_end")))
    if ends.count() <= MOST_STRATA:
        cut = rows.join(F.broadcast(ends), F.col("_s").eqNullSafe(F.col("_k")))
    else:
        own = counts.join(ends, F.col("_s").eqNullSafe(F.col("_k"))).select("_k", F.col("_b").alias("_at"), "_end")
        cut = rows.join(own, F.col("_s").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_at"))).drop("_at")
    return cut.withColumn("held_out", F.col("_b") <= F.col("_end")).drop("_b", "_s", "_k", "_end")


def _designed(rows: DataFrame, outcome: str, columns: list[str]) -> DataFrame:
    """held_out, y, x: standardised columns, missing values at the mean, texts as the place of their value in order; means and deviations
    come from the rows that are not held out."""
    numbers = set(numeric_columns(rows))
    texts = [c for c in columns if c not in numbers]
    coded = rows
    for i, c in enumerate(texts):
        places = rows.select(F.col(c).cast("string").alias("_v")).dropna().distinct()
        places = places.withColumn(f"_code{i}", F.row_number().over(Window.orderBy("_v")) - 1)  # the values of a category
        coded = coded.join(places.withColumnRenamed("_v", f"_v{i}"), F.col(c).cast("string") == F.col(f"_v{i}"), "left")
    value = {c: F.when(~missing(c, rows), F.col(c).cast("double")) if c in numbers else F.col(f"_code{texts.index(c)}").cast("double") for c in columns}
    flat = saved(coded.select("held_out", F.col(outcome).cast("double").alias("y"), *(value[c].alias(f"x{i}") for i, c in enumerate(columns))))
    seen = [F.when(~F.col("held_out"), F.col(f"x{i}")) for i in range(len(columns))]
    s = flat.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(seen)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(seen))).first()
    scaled = [F.coalesce((F.col(f"x{i}") - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0), F.lit(0.0)).alias(f"x{i}") for i in range(len(columns))]
    return VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="x").transform(flat.select("held_out", "y", *scaled)).select("held_out", "y", "x")


def auc(scored: DataFrame, score: str, positive: str) -> float | None:
    """The area under the curve: the share of pairs of a positive and a negative row in which the positive one scores higher, ties half, from ranks."""
    rows = scored.select(F.col(score).cast("double").alias("value"), F.col(positive).alias("p"))
    cells = rows.filter("value IS NOT NULL").groupBy("value").agg(F.count_if("p").alias("k"), F.count(F.lit(1)).alias("c"))
    ranges = Ranges(cells, [], ["value"])  # distinct scores, with what is summed of them beside
    ranked = ranges.running(ranges.rows, upto=("sum", "c")).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2)
    s = ranked.agg(F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum("k").alias("p"), F.sum(F.col("c") - F.col("k")).alias("q")).first()
    return (s.r - s.p * (s.p + 1) / 2) / (s.p * s.q) if s.p and s.q else None


def evaluate(rows: DataFrame, outcome: str, columns: list[str], task: str = "classification") -> dict:
    """n_features, n_test, and accuracy and auc (of classes 0 and 1) of a logistic model, or r2 and mse of a linear one, on the rows held
    out by ``split``. Logistic weights are penalised by half their square sum, whatever the rows."""
    need(rows, "held_out", outcome, *columns)
    if task not in ("classification", "regression"):
        raise ValueError("task is classification or regression")
    if not columns:
        raise ValueError("no columns")
    data = _designed(rows.filter(F.col(outcome).isNotNull()), outcome, columns)  # of saved numbers; the fit keeps its own copy
    fitted, test = data.filter("NOT held_out"), data.filter("held_out")
    n = fitted.count()
    if task == "classification":
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / n, standardization=False, maxIter=1000, tol=1e-9).fit(fitted)
        scored = saved(model.transform(test).select("y", "prediction", vector_to_array("probability")[1].alias("p")))
        s = scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("accuracy")).first()
        return {"n_features": len(columns), "n_test": s.n, "accuracy": s.accuracy, "auc": auc(scored.withColumn("one", F.col("y") == 1), "p", "one")}
    model = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(fitted)
    gap = (F.col("y") - F.col("prediction")) ** 2
    s = model.transform(test).agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mse"), F.var_pop("y").alias("v")).first()
    return {"n_features": len(columns), "n_test": s.n, "r2": 1 - s.mse / s.v if s.v else None, "mse": s.mse}


def compare(df: DataFrame, key: str, outcome: str, columns: list[str], methods: tuple[str, ...] = ("mrmr", "lasso", "elastic_net", "univariate"), task: str = "classification", size: int | None = None) -> DataFrame:
    """method, n_features, features, redundancy (mean absolute correlation of pairs), accuracy, auc, r2, mse, n_test, seconds (of the selection):
    each method selects on the rows not held out, and all are judged on the same rows. A method that refuses the data has its reason in ``error``."""
    used = df.select(*dict.fromkeys([key, outcome, *columns]))
    rows = saved(split(used, key, outcome if task == "classification" else None))
    known, out = rows.filter("NOT held_out").drop("held_out"), []
    for method in methods:
        began = time.time()
        try:
            found = features.select_features(known, outcome, columns, method, size, key)
            chosen = sorted(r.variable for r in found.filter("selected").collect())  # a row a column
            took = time.time() - began
            numbers = [c for c in chosen if c in numeric_columns(df)]
            pairs = features.assoc.correlations(known, numbers) if len(numbers) > 1 else None
            redundancy = pairs.agg(F.avg(F.abs("r"))).first()[0] if pairs is not None else 0.0
            p = evaluate(rows, outcome, chosen, task)
            out.append((method, len(chosen), ",".join(chosen), redundancy, p.get("accuracy"), p.get("auc"), p.get("r2"), p.get("mse"), p["n_test"], took, None))
        except ValueError as e:
            out.append((method, *[None] * 9, str(e)))
    return df.sparkSession.createDataFrame(out, "method string, n_features int, features string, redundancy double, accuracy double, auc double, r2 double, mse double, n_test long, seconds double, error string")
