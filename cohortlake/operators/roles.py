"""Which column is the endpoint, the arm, the time, the event; which columns stay when others are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.guardrails import numeric_columns, tokens
from cohortlake.operators.longform import missing
from cohortlake.operators.profile import missingness

# Names of endpoints, certain and likely, and words that speak for one; words of arms, times and events.
ENDPOINTS = ["deathevent", "death", "mortality", "outcome", "survived", "response"]
LIKELY, PARTS = ["event", "status"], ["death", "mortality", "surviv"]
ARMS = "arm group trt treat treatment cohort alloc rand assign intervention branch".split()
TIMES = "time days months years follow duration os pfs efs rfs dfs ttf tte fu".split()
EVENTS = "event status censored dead death died outcome indicator flag relapse tx".split()


def plain(name: str) -> str:
    """A name without case and marks."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


MOST = 7  # distinct values of a column that are told apart


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variable, value) of each column, up to ``MOST`` values."""
    seen: dict[str, set] = {}
    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns):
            own = seen.setdefault(name, set())
            if len(own) < MOST:
                own.update(pc.unique(column).slice(0, 2 * MOST).drop_null().to_pylist())
    for name, own in seen.items():
        own = sorted(own)[:MOST]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.string())], ["variable", "value"])


def levels(df: DataFrame) -> dict[str, tuple[int, bool]]:
    """For every column its number of distinct values (7 stands for more), and whether all are 0 and 1. Each task keeps 7 values a column at
    most, and those meet, so numbers below 7 are exact whatever the size of the table."""
    texts = df.select(*(F.when(~missing(c, df), F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(df.columns)))
    found = texts.mapInArrow(_few, "variable string, value string").distinct().groupBy("variable").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a column
    n = {r.variable: min(MOST, r.n) for r in found}
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    flags = df.agg(*(F.coalesce(F.every(F.when(~missing(c, df), number(c).isNotNull() & number(c).isin(0.0, 1.0))), F.lit(False)).alias(f"b{i}") for i, c in enumerate(df.columns))).first()
    return {c: (n.get(f"c{i}", 0), bool(flags[f"b{i}"])) for i, c in enumerate(df.columns)}


def named(df: DataFrame, name: str | None) -> str | None:
    """The column of this name, or else the first that has it but for case and marks."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if name and plain(c) == plain(name)), None)


def endpoint(df: DataFrame, stated: str | None = None, seen: dict | None = None) -> str | None:
    """The endpoint: the stated one if there is such a column; else the first of the best names: certain ones, then likely ones or those
    with a word that speaks for it, both with 3 values at most."""
    if (found := named(df, stated)) is not None:
        return found
    seen = seen or levels(df)

    def score(c: str) -> int:
        few = seen[c][0] <= 3
        return 4 if plain(c) in ENDPOINTS else 3 if plain(c) in LIKELY and few else 2 if few and any(p in plain(c) for p in PARTS) else 0

    best = max(df.columns, key=score, default=None)  # the first of equals
    return best if best is not None and score(best) else None


def roles(df: DataFrame, stated_endpoint: str | None = None) -> dict[str, str | None]:
    """endpoint, arm, time, event. The arm is named like one and has 2 to 6 values, or else has 2 or 3, and is never named like an event;
    the time is a number named like one; the event holds 0 and 1, named like one if any such is."""
    seen = levels(df)
    says = lambda c, words: bool(set(tokens(c)) & set(words))
    fits = [c for c in df.columns if not says(c, EVENTS)]
    arm = next((c for c in fits if says(c, ARMS) and 2 <= seen[c][0] <= 6), None) or next((c for c in fits if 2 <= seen[c][0] <= 3), None)
    time = next((c for c in numeric_columns(df) if says(c, TIMES)), None)
    flags = [c for c in df.columns if seen[c][1]]
    event = next((c for c in flags if says(c, EVENTS)), None) or next((c for c in flags if c != time), None)
    return {"endpoint": endpoint(df, stated_endpoint, seen), "arm": arm, "time": time, "event": event}


def protected(df: DataFrame, stated_endpoint: str | None = None, important: list[str] = ()) -> list[str]:
    """The endpoint and the columns that the user calls important, in order."""
    found = {endpoint(df, stated_endpoint), *(named(df, v) for v in important)}
    return sorted(c for c in found if c)


def kept_columns(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``df`` without the columns of which more than half is missing, but with all of ``keep``."""
    tiers = missingness_of(df)
    gone = [r.variable for r in tiers.filter("tier = 'excluded'").collect() if r.variable not in keep]  # one row a column
    return df.drop(*gone)


def missingness_of(df: DataFrame) -> DataFrame:
    """``profile.missingness`` of columns of any kind."""
    flags = df.select(*(F.when(~missing(c, df), F.lit(1.0)).alias(c) for c in df.columns))
    return missingness(flags, df.columns)


def role_table(df: DataFrame, stated_endpoint: str | None = None) -> DataFrame:
    """role, variable: one row a role."""
    return df.sparkSession.createDataFrame(list(roles(df, stated_endpoint).items()), "role string, variable string")
