"""Checks of job requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import parse_float, parse_int

IMPORTS = ("import", "smart_import")
FILE_JOBS = ("clean", "select", "delete")
MODEL_JOBS = ("convert", "evaluate", "judge")
JOBS = (*IMPORTS, *FILE_JOBS, *MODEL_JOBS, "generate")

_COLUMNS = {
    "repo": "string", "split": "string", "filename": "string", "model": "string",
    "quantization": "string", "limit": "double", "sharpness": "int",
    "seed_input": "string", "seed_output": "string", "count": "int",
}


def validate_requests(
    df: DataFrame, files: DataFrame | None = None, max_count: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a frame with a `job` column and any of the request columns.

    Values that JavaScript takes for false (null, empty, 0) get the defaults. With `files` (a
    column `name`), jobs on a file must name one that is there. With `max_count`, accepted
    requests to generate have their count lowered to it.
    """
    missing = {c: F.lit(None).cast(t) for c, t in _COLUMNS.items() if c not in df.columns}
    full = df.withColumns(missing) if missing else df
    types = {f.name: f.dataType for f in full.schema.fields}
    job = F.col("job")

    def given(name: str) -> Column:
        held = F.col(name) != ("" if isinstance(types[name], T.StringType) else 0)
        return F.coalesce(held, F.lit(False))

    def default(name: str, value, read=None) -> Column:
        col = F.col(name)
        if read and isinstance(types[name], T.StringType):
            col = read(col)
        return F.when(given(name), col).otherwise(F.lit(value))

    judged = job == "judge"
    limits = F.when(judged, default("limit", fixed.DEFAULT_JUDGE_LIMIT, parse_float)).when(
        job == "evaluate", default("limit", fixed.DEFAULT_EVALUATE_LIMIT, parse_float))
    ready = full.withColumns({
        "split": F.when(job.isin(*IMPORTS), default("split", fixed.DEFAULT_SOURCE_SPLIT)),
        "model": F.when(job.isin(*MODEL_JOBS), default("model", fixed.DEFAULT_MODEL)),
        "quantization": F.when(
            job.isin(*MODEL_JOBS), default("quantization", fixed.DEFAULT_QUANTIZATION)),
        "limit": limits.cast("double"),
        "sharpness": F.when(
            judged, default("sharpness", fixed.DEFAULT_SHARPNESS, parse_int)).cast("int"),
        "_given_repo": given("repo"),
        "_given_file": given("filename"),
        "_given_seed": given("seed_input") & given("seed_output") & given("count"),
    })

    def error(code: str, message: str) -> Column:
        return F.struct(F.lit(code).alias("error_code"), F.lit(message).alias("error_message"))

    def within(name: str, low: float, high: float) -> Column:
        inside = F.col(name).between(low, high) & ~F.isnan(F.col(name).cast("double"))
        return F.coalesce(inside, F.lit(False))

    bad_repo = ~F.col("repo").rlike(fixed.REPO_PATTERN)
    name = F.col("filename")
    bad_name = (
        name.contains("/") | name.contains("\\") | name.contains("\0")
        | (F.length(name) > fixed.MAX_FILENAME_LENGTH)
    )
    imports, on_file, on_model = job.isin(*IMPORTS), job.isin(*FILE_JOBS), job.isin(*MODEL_JOBS)
    failure = (
        F.when(~F.coalesce(job.isin(*JOBS), F.lit(False)), error("INVALID_INPUT", "Unknown job"))
        .when(imports & ~F.col("_given_repo"), error("INVALID_INPUT", "Repo required"))
        .when(imports & bad_repo, error(
            "INVALID_INPUT", "Invalid repository format. Expected: owner/repo"))
        .when(on_file & ~F.col("_given_file"), error("INVALID_INPUT", "Filename required"))
        .when(on_file & bad_name, error("INVALID_INPUT", "Invalid filename"))
        .when(on_file & (name == ".."), error("PATH_TRAVERSAL", "Invalid path"))
        .when((job == "generate") & ~F.col("_given_seed"), error("INVALID_INPUT", "Missing fields"))
        .when(on_model & ~F.col("quantization").isin(*fixed.QUANTIZATIONS), error(
            "INVALID_PARAM", f"Invalid quantization. Allowed: {', '.join(fixed.QUANTIZATIONS)}"))
        .when((judged | (job == "evaluate")) & ~within("limit", fixed.MIN_LIMIT, fixed.MAX_LIMIT),
              error("INVALID_PARAM", "Limit must be between 0.01 and 1.0"))
        .when(judged & ~within("sharpness", fixed.MIN_SHARPNESS, fixed.MAX_SHARPNESS),
              error("INVALID_PARAM", "Sharpness must be between 0 and 100"))
    )
    ready = ready.withColumn("_failure", failure)
    if files is not None:
        known = files.select(F.col("name").alias("filename")).distinct().withColumn(
            "_known", F.lit(True))
        ready = ready.join(known, "filename", "left").withColumn("_failure", F.coalesce(
            F.col("_failure"),
            F.when(on_file & F.col("_known").isNull(), error("NOT_FOUND", "File not found"))))
    columns = [c for c in full.columns]
    count = F.col("count")
    if max_count is not None:
        count = F.when(job == "generate", F.least(count, F.lit(max_count))).otherwise(count)
    accepted = ready.filter(F.col("_failure").isNull()).withColumn("count", count).select(*columns)
    rejected = ready.filter(F.col("_failure").isNotNull()).select(*columns, "_failure.*")
    return accepted, rejected
