"""Resolution of roles over sentences about two tables, with what must come out in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import resolution
from cohortlake.plans.queries import query, table

COLUMNS = [
    ("liver", "endpoint", "death_event"), ("liver", "group", "trt_arm"), ("liver", "time", "follow_up_days"), ("liver", "variable", "albumin"), ("liver", "variable", "serum_copper"), ("liver", "variable", "trt_arm"),
    ("heart", "endpoint", "died"), ("heart", "endpoint", "relapse"), ("heart", "group", "branch"), ("heart", "variable", "pressure"), ("heart", "variable", "pulse"),
]
DICTIONARY = [("liver", "serum_copper", "copper in blood"), ("heart", "pressure", "blood reading"), ("heart", "pulse", "blood reading"), ("heart", "branch", "study branch taken")]
METADATA = [("liver", "group", "TRT_ARM"), ("heart", "group", "wing")]
#: Table, sentence ({k}: a number), and for each role column, source, confidence.
CASES = [
    ("liver", "Albumin was lower in those with death_event {k}.", {"endpoint": ("death_event", "explicit_text", "exact"), "group": ("trt_arm", "metadata", "exact"), "variable": ("albumin", "explicit_text", "exact")}),
    ("liver", "Albumin and serum copper told mortality at {k} days.", {"endpoint": ("death_event", "heuristic", "unique_alias"), "group": ("trt_arm", "metadata", "exact"), "time": ("follow_up_days", "heuristic", "unique_alias"), "variable": ("serum_copper", "explicit_text", "exact")}),
    ("liver", "Copper in blood was high in {k}.", {"group": ("trt_arm", "metadata", "exact"), "variable": ("serum_copper", "data_dictionary", "unique_alias")}),
    ("heart", "The outcome was rare in {k} subjects.", {"endpoint": (None, "heuristic", "ambiguous")}),
    ("heart", "Of {k} some died and some had a relapse.", {"endpoint": (None, "explicit_text", "ambiguous")}),
    ("heart", "The treatment arms differed in pulse by {k}.", {"group": (None, "metadata", "unresolved"), "variable": ("pulse", "explicit_text", "exact")}),
    ("heart", "A blood reading of {k} was seen, study branch taken.", {"variable": (None, "data_dictionary", "ambiguous"), "group": ("branch", "explicit_text", "exact")}),
]


def _sql() -> str:
    wanted = []
    for i, (_, _, found) in enumerate(CASES):
        for role in resolution.ROLES:
            column, source, confidence = found.get(role, (None, "heuristic", "unresolved"))
            wanted.append(f"({i}, '{role}', {'NULL' if column is None else repr(column)}, '{source}', '{confidence}')")
    return f"""SELECT s_suppkey, role, "column", source, confidence FROM supplier JOIN (VALUES {", ".join(wanted)}) w(kind, role, "column", source, confidence) ON s_suppkey % {len(CASES)} = kind"""


@query("claim_roles", _sql())
def claim_roles(spark, sf_dir):
    text, about = F.lit(None), F.lit(None)
    for i, (name, said, _) in enumerate(CASES):
        mine = F.col("s_suppkey") % len(CASES) == i
        text, about = F.when(mine, F.replace(F.lit(said), F.lit("{k}"), F.col("s_suppkey").cast("string"))).otherwise(text), F.when(mine, name).otherwise(about)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"), about.alias("table"))
    shape = "table string, role string, column string"
    out = resolution.resolved(rows, "s_suppkey", "text", "table", spark.createDataFrame(COLUMNS, shape), spark.createDataFrame(DICTIONARY, "table string, column string, alias string"), spark.createDataFrame(METADATA, shape))
    return out.select("s_suppkey", "role", "column", "source", "confidence")
