"""Stages over cases: an ordered chain of column transforms with dependency checks, failure isolation and providers.

A case is a row; what stages need and provide are its columns. A stage's provider gives one payload struct for each row, with
``implemented``, ``confidence``, ``human_review_required``, ``error`` and the provided values, each optional. A payload whose error is not
null is a failed stage of that row alone: columns compute errors with ``try_`` functions, so that no row ends the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pipeline_state import final_status

Context = Callable[[str], Column]
Provider = Callable[[Context], dict[str, Column]]

RESULT = "struct<stage:string,status:string,confidence:double,human_review_required:boolean,error:string,missing_inputs:array<string>>"
# What a provider can stand for.
CAPABILITIES = ("preprocessing", "ocr", "validation", "tampering", "face", "risk")


@dataclass(frozen=True)
class Stage:
    """A name, the columns it needs, those it may set, and the provider that makes its payload."""

    name: str
    requires: tuple[str, ...]
    provides: tuple[str, ...]
    provider: Provider


_PROVIDERS: dict[tuple[str, str], Provider] = {}
_MODELS: dict[tuple[str, str], Callable[..., Column]] = {}


def _known(capability: str) -> None:
    if capability not in CAPABILITIES:
        raise ValueError(f"unknown capability {capability!r}; known are {', '.join(CAPABILITIES)}")


def register_provider(capability: str, name: str, provider: Provider) -> None:
    """Make a provider known; an equal name is replaced."""
    _known(capability)
    _PROVIDERS[(capability, name)] = provider


def placeholder(capability: str) -> Provider:
    """Stands in for a provider that nobody registered: not implemented, and a person has to look."""
    _known(capability)
    return lambda ctx: {"implemented": F.lit(False), "human_review_required": F.lit(True)}


def provider(capability: str, name: str | None = None) -> Provider:
    """The named provider, or the first registered one, or the placeholder."""
    _known(capability)
    if name is not None:
        return _PROVIDERS.get((capability, name)) or placeholder(capability)
    return next((p for (c, _), p in _PROVIDERS.items() if c == capability), placeholder(capability))


def register_model(kind: str, name: str, score: Callable[..., Column]) -> None:
    """A model slot (tampering, embedding): a function of columns, which may be a pandas UDF."""
    _MODELS[(kind, name)] = score


def model(kind: str, name: str | None = None) -> Callable[..., Column]:
    """The model of a slot; without one, a model that abstains (null)."""
    found = _MODELS.get((kind, name)) if name else next((m for (k, _), m in _MODELS.items() if k == kind), None)
    return found or (lambda *columns: F.lit(None).cast("double"))


def isolated(function: Callable[..., pd.Series | np.ndarray], kind: str) -> Callable[..., Column]:
    """A vectorised function of pandas series, to a series or an array, as a function of columns that gives STRUCT<value: kind, error: STRING>.

    Where the function raises, its batch is halved until the row at fault stands alone; that row has the error, all others their values. Each try
    begins behind the last fault and is as long as faults have been apart, doubled after each success, so that a fault costs about as many calls as its
    distance from the last one has bits. The function is called once for each use in a plan: filters on what it says are not moved before it.
    """

    def attempt(columns: list[pd.Series]) -> list[tuple[object, str | None]]:
        def call(start: int, size: int) -> str | None:
            """The error of these rows, or none and their values are kept."""
            try:
                values = list(function(*[c.iloc[start : start + size] for c in columns]))
                if len(values) != size:
                    raise ValueError(f"{len(values)} values for {size} rows")
            except Exception as e:
                return f"{type(e).__name__}: {e}"
            out.extend((v, None) for v in values)
            return None

        out: list[tuple[object, str | None]] = []  # of the rows before the next try
        rows, length, faults = len(columns[0]), len(columns[0]), 0
        while len(out) < rows:
            size = min(length, rows - len(out))
            error = call(len(out), size)
            if error is None:
                length = 2 * size
                continue
            while size > 1:  # of these rows one is at fault; those before the first one are kept
                half = size // 2
                said = call(len(out), half)
                size, error = (size - half, None) if said is None else (half, said)
            if error is None:  # the row is left over and was not called alone
                error = call(len(out), 1)
            if error is None:  # rows that fail together, but not alone
                length = 1
                continue
            out.append((None, error))
            faults += 1
            length = len(out) // faults
        return out

    @F.pandas_udf(f"value {kind}, error string")
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = attempt(list(columns))
        return pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype="object"), "error": pd.Series([e for _, e in out], dtype="object")})

    return run.asNondeterministic()  # else a filter on the result is moved before it and calls it a second time


def model_indicators(df: DataFrame, key: str, name: str | None, *inputs: str) -> DataFrame:
    """What the tampering model of a slot says of each row: key, type, severity and confidence as fusion reads them, probability and error. A model that
    abstains (null) gives no row. The model is a function of columns that gives a probability, or STRUCT<value, error> if it is isolated."""
    said = model("tampering", name)(*[F.col(c) for c in inputs])
    rows = df.select(key, said.alias("_said"))
    whole = rows.schema["_said"].dataType.simpleString().startswith("struct")
    p, error = (F.col("_said.value"), F.col("_said.error")) if whole else (F.col("_said"), F.lit(None).cast("string"))
    severity = F.when(p >= 0.8, "high").when(p >= 0.5, "medium").when(p.isNotNull(), "low").otherwise("info")
    out = rows.select(key, F.lit("model_verdict").alias("type"), severity.alias("severity"), F.coalesce(F.abs(p - 0.5) * 2, F.lit(0.0)).alias("confidence"), p.alias("probability"), error.alias("error"))
    return out.where(F.col("probability").isNotNull() | F.col("error").isNotNull())


def stages(choose: dict[str, Provider] | None = None) -> list[Stage]:
    """The six stages in order; choose names providers for this chain only."""
    pick = lambda c: (choose or {}).get(c) or provider(c)
    return [
        Stage("preprocess", (), ("preprocessed_image_path", "quality_metrics"), pick("preprocessing")),
        Stage("ocr", ("preprocessed_image_path",), ("ocr_fields", "mrz_raw", "doc_type_detected"), pick("ocr")),
        Stage("document_validation", ("ocr_fields",), ("validation",), pick("validation")),
        Stage("tampering_detection", ("preprocessed_image_path",), ("tampering",), pick("tampering")),
        Stage("face_verification", ("preprocessed_image_path",), ("face_verification",), pick("face")),
        # needs nothing: what failed before it is evidence, and a verdict is due in every case
        Stage("risk_assessment", (), ("risk",), pick("risk")),
    ]


def run_stage(df: DataFrame, stage: Stage, fail_fast: bool = False) -> DataFrame:
    """df after one stage: its result appended to stage_results, what it provides set where it ran."""
    context = lambda name: F.col(name) if name in df.columns else F.lit(None)
    payload = stage.provider(context)
    part = lambda name, kind: payload[name].cast(kind) if name in payload else F.lit(None).cast(kind)
    missing = F.array_compact(F.array(*[F.when(context(n).isNull(), F.lit(n)) for n in stage.requires])) if stage.requires else F.array().cast("array<string>")
    stopped = F.exists("stage_results", lambda r: r["status"] == "error") if fail_fast else F.lit(False)
    error = part("error", "string")
    status = F.when(F.size(missing) > 0, "skipped").when(error.isNotNull(), "error").when(~F.coalesce(part("implemented", "boolean"), F.lit(True)), "not_implemented").otherwise("ok")
    confidence = part("confidence", "double")
    result = F.struct(
        F.lit(stage.name).alias("stage"),
        F.col("_status").alias("status"),
        F.when(F.col("_status").isin("ok", "not_implemented") & confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).alias("confidence"),
        (F.col("_status").isin("skipped", "error", "not_implemented") | F.coalesce(part("human_review_required", "boolean"), F.lit(False))).alias("human_review_required"),
        F.when(F.col("_status") == "error", error).alias("error"),
        missing.alias("missing_inputs"),
    )
    with_status = df.withColumn("_status", F.when(~stopped, status))
    ran = F.col("_status").isin("ok", "not_implemented")
    provided = {n: F.when(ran, payload[n]).otherwise(context(n)) if n in df.columns else F.when(ran, payload[n]) for n in stage.provides if n in payload}
    results = F.when(F.col("_status").isNull(), F.col("stage_results")).otherwise(F.concat("stage_results", F.array(result.cast(RESULT))))
    return with_status.withColumns({**provided, "stage_results": results}).drop("_status")


def run(df: DataFrame, chain: list[Stage], fail_fast: bool = False) -> DataFrame:
    """df after all stages, in order."""
    out = df.withColumn("stage_results", F.array().cast(f"array<{RESULT}>"))
    for stage in chain:
        out = out.transform(run_stage, stage, fail_fast)
    return out


def assembled(df: DataFrame, *keep: str) -> DataFrame:
    """The consolidated result of each case: final status, review, what degraded (four stages named at most), confidences, and the blocks."""
    results = F.col("stage_results")
    names = lambda s: F.transform(F.filter(results, lambda r: r["status"] == s), lambda r: r["stage"])
    statuses = F.transform(results, lambda r: r["status"])
    degraded = F.transform(F.filter(results, lambda r: r["status"] != "ok"), lambda r: r["stage"])
    blocks = [F.col(c) for c in ("ocr_fields", "validation", "tampering", "face_verification", "risk") if c in df.columns]
    return df.select(
        *keep,
        final_status(statuses, F.lit(False)).alias("final_status"),
        F.exists(results, lambda r: r["human_review_required"]).alias("human_review_required"),
        F.array_join(F.slice(degraded, 1, 4), ", ").alias("degraded"),
        F.array_join(names("error"), ", ").alias("failed"),
        F.map_from_entries(F.transform(results, lambda r: F.struct(r["stage"], r["confidence"]))).alias("confidence_summary"),
        results.alias("stages"),
        *blocks,
    )


def screen(df: DataFrame, chain: list[Stage], folder: str, events: str, *keep: str) -> DataFrame:
    """Run, assemble, write the results to folder and one completion event a case to events; returns the written results.

    A case that folder holds already is not run again, so that a repeated call adds nothing.
    """
    spark = df.sparkSession
    known = spark.read.parquet(folder) if _exists(spark, folder) else None
    todo = df.join(known.select(*keep), list(keep), "left_anti") if known is not None else df
    assembled(run(todo, chain), *keep).write.mode("append").parquet(folder)
    done = spark.read.parquet(folder)
    told = spark.read.parquet(events).select(*keep) if _exists(spark, events) else None
    fresh = done.join(told, list(keep), "left_anti") if told is not None else done
    fresh.select(*keep, F.lit("screening_completed").alias("event_type"), "final_status", F.lit("pending").alias("anchor_status")).write.mode("append").parquet(events)
    return done


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True
