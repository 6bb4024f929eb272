"""Dictionary rules as JSON: all rules of a file are taken, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.engine import compiled

RULE = "struct<id:string,termOrPattern:string,replacementType:string,targetCategory:string,isRegex:boolean>"
# Limits of a file.
MOST_BYTES, MOST_RULES = 1_000_000, 1000


def pattern_problem(pattern: str | None) -> str | None:
    """Why a pattern cannot be used, or null."""
    try:
        compiled(pattern or "")
    except Exception as problem:  # every engine has its own error class
        return str(problem)
    return None


def rule_problem(rule: Column) -> Column:
    """Why a rule's own fields do not fit, or null. Patterns are checked apart."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(rule["id"].isNull() | rule["isRegex"].isNull() | rule["replacementType"].isNull(), "a field is missing")
        .when(blank(rule["termOrPattern"]), "a term or pattern is required")
        .when(~rule["replacementType"].isin("FIXED", "CATEGORY"), "the replacement type must be FIXED or CATEGORY")
        .when((rule["replacementType"] == "CATEGORY") & blank(rule["targetCategory"]), "a target category is required")
    )


def case_clashes(rules: DataFrame) -> DataFrame:
    """Categories of rules that differ in case only: lowered, spellings."""
    targets = rules.filter("replacementType = 'CATEGORY'").select(F.trim("targetCategory").alias("t")).filter("t <> ''")
    return (
        targets.groupBy(F.lower("t").alias("lowered")).agg(F.array_sort(F.collect_set("t")).alias("spellings")).filter(F.size("spellings") > 1)
    )


def read(files: DataFrame, json_col: str = "json") -> DataFrame:
    """files with `rules` (empty where anything is wrong) and `problem` (null where nothing is)."""
    given = F.from_json(F.col(json_col), f"array<{RULE}>", {"mode": "PERMISSIVE"})
    wrong = F.udf(pattern_problem, "string")
    rows = files.withColumn("rules", given)
    first = F.get(F.array_compact(F.transform("rules", rule_problem)), F.lit(0))
    targets = F.transform(F.filter("rules", lambda r: r["replacementType"] == "CATEGORY"), lambda r: F.trim(r["targetCategory"]))
    clash = F.size(F.array_distinct(targets)) > F.size(F.array_distinct(F.transform(targets, F.lower)))
    patterns = F.transform(F.filter("rules", lambda r: r["isRegex"]), lambda r: r["termOrPattern"])
    rows = rows.withColumn("__pattern", F.explode_outer(F.when(F.size(patterns) > 0, patterns)))
    checked = rows.withColumn("__bad", F.when(F.col("__pattern").isNotNull(), wrong("__pattern")))
    keys = [F.col(f"`{c}`") for c in files.columns]
    whole = checked.groupBy(*keys, "rules").agg(F.max("__bad").alias("__bad"))
    problem = (
        F.when(F.length(json_col) > MOST_BYTES, "the file is too large")
        .when(F.col("rules").isNull(), "not a JSON array of rules")
        .when(F.size("rules") > MOST_RULES, "too many rules")
        .when(first.isNotNull(), first)
        .when(F.col("__bad").isNotNull(), F.concat(F.lit("not a valid pattern: "), F.col("__bad")))
        .when(clash, "categories differ in case only")
    )
    out = whole.withColumn("problem", problem)
    return out.select(*keys, F.when(F.col("problem").isNull(), F.col("rules")).otherwise(F.array().cast(f"array<{RULE}>")).alias("rules"), "problem")


def write_json(rules: DataFrame) -> DataFrame:
    """One row: all rules as a JSON array, by id."""
    fields = F.struct(*[F.col(c) for c in ("id", "termOrPattern", "replacementType", "targetCategory", "isRegex")])
    return rules.agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("json"))
