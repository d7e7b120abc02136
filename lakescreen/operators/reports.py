"""The stored report: assembly, and the allow-listed projections that an inspector sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a case view may show of each block.
SHOWN = {"validation": ("is_valid", "confidence", "doc_type", "ruleset"), "tampering": ("verdict", "risk_score", "confidence"), "face_verification": ("match_status", "similarity_score", "confidence")}


def analysed(report: Column) -> Column:
    """Whether the report holds a result at all."""
    return F.try_variant_get(report, "$.final_status", "string").isNotNull()


def pick(report: Column, block: str, keys: tuple[str, ...]) -> Column:
    """A map of those keys of a block that are there, values as text."""
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.try_variant_get(report, f"$.{block}.{k}", "string") for k in keys]))
    return F.map_filter(values, lambda k, v: v.isNotNull())


def checks(report: Column) -> Column:
    """(field, status, message) of each check."""
    return F.try_variant_get(report, "$.validation.checks", "array<struct<field:string,status:string,message:string>>")


def indicators(report: Column) -> Column:
    """(type, severity, confidence, note) of each indicator, notes cut at 200 characters."""
    rows = F.try_variant_get(report, "$.tampering.indicators", "array<struct<type:string,severity:string,confidence:double,note:string>>")
    return F.transform(rows, lambda r: F.struct(r["type"].alias("type"), r["severity"].alias("severity"), r["confidence"].alias("confidence"), F.left(r["note"], F.lit(200)).alias("note")))


def case(df: DataFrame, report: str = "report") -> DataFrame:
    """df with the blocks of SHOWN, checks and indicators in place of its VARIANT report; unanalysed cases have nulls."""
    r = F.col(report)
    seen = analysed(r)
    out = df.withColumns({b: F.when(seen, pick(r, b, keys)) for b, keys in SHOWN.items()} | {"checks": F.when(seen, checks(r)), "indicators": F.when(seen, indicators(r))})
    return out.drop(report)


def outcomes(df: DataFrame, report: str = "report") -> DataFrame:
    """Counts of module outcomes over all reports, in one distributed pass: (module, outcome, n)."""
    r = F.col(report)
    valid = F.try_variant_get(r, "$.validation.is_valid", "boolean")
    verdict, match = F.try_variant_get(r, "$.tampering.verdict", "string"), F.try_variant_get(r, "$.face_verification.match_status", "string")
    rows = F.array(
        F.struct(F.lit("validation").alias("module"), F.when(valid, "valid").when(~valid, "invalid").otherwise("unknown").alias("outcome")),
        F.struct(F.lit("tampering").alias("module"), F.when(verdict.isin("suspicious", "likely_manipulated", "inconclusive", "no_obvious_manipulation"), verdict).otherwise("unknown").alias("outcome")),
        F.struct(F.lit("face").alias("module"), F.when(match.isin("MATCH", "NO_MATCH", "INCONCLUSIVE"), match).otherwise("not_performed").alias("outcome")),
    )
    return df.select(F.inline(rows)).groupBy("module", "outcome").agg(F.count(F.lit(1)).alias("n"))


# The outcomes that each module's chart shows.
MODULE_OUTCOMES = {
    "validation": ("valid", "invalid", "unknown"),
    "tampering": ("no_obvious_manipulation", "suspicious", "likely_manipulated", "inconclusive", "unknown"),
    "face": ("match", "no_match", "inconclusive", "not_performed"),
}


def module_chart(df: DataFrame, report: str = "report") -> DataFrame:
    """outcomes() for the chart: (module, outcome, n) in small letters, with a row for each outcome of MODULE_OUTCOMES, none or not. A null report (one that could
    not be read) counts as unknown or not performed."""
    spine = df.sparkSession.createDataFrame([(m, o) for m, of in MODULE_OUTCOMES.items() for o in of], "module string, outcome string")
    counts = outcomes(df, report).withColumn("outcome", F.lower("outcome"))
    return spine.join(counts, ["module", "outcome"], "left").select("module", "outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fields_as_rows(fields: Column) -> Column:
    """A name to struct map as rows in order of names; a null value is an empty text."""
    entries = F.array_sort(F.map_entries(fields), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"]["value"], F.lit("")).alias("value"), e["value"]["confidence"].alias("confidence")))


def confidence_summary(stages: Column) -> Column:
    """Stage name to confidence, to three decimals; the last of a name stands."""
    last = F.aggregate(stages, F.create_map().cast("map<string,double>"), lambda m, s: F.map_concat(F.map_filter(m, lambda k, v: k != s["stage"]), F.create_map(s["stage"], F.bround(s["confidence"], 3))))
    return last
