"""Classification that keeps what went wrong: detectors that fail become rows of a table of errors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import Tables
from .classify import Detector, PythonDetector, classify, detectors

_FOUND = T.StructType().add("plugin", "string").add("format", "string").add("variant", "string").add("confidence", "double").add("reasons", T.ArrayType(T.StringType())).add("review_reasons", T.ArrayType(T.StringType()))
_ATTEMPT = T.StructType([*_FOUND.fields]).add("error", "string").add("message", "string")
#: Characters of a message that are kept.
MESSAGE = 500


def attempt(detector: PythonDetector) -> Column:
    """What a Python detector says of a file, or the error that it fails with."""
    plugin, function = detector.plugin, detector.function

    def one(path: str, sample: bytes, text: str | None) -> tuple:
        try:
            found = function(path, sample, text)
            if not found:
                return (None,) * 8
            variant, reasons, review = found.get("variant"), *([str(r) for r in found.get(k, ())] for k in ("reasons", "review_reasons"))
            return plugin, str(found["format"]), None if variant is None else str(variant), float(found.get("confidence", 0.5)), reasons, review, None, None
        except Exception as e:  # whatever a foreign function raises
            return *(None,) * 6, type(e).__name__, str(e)[:MESSAGE]

    @F.pandas_udf(_ATTEMPT)
    def run(paths: pd.Series, samples: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [one(p, bytes(s) if s is not None else b"", t) for p, s, t in zip(paths, samples, texts, strict=True)]
        return pd.DataFrame(rows, columns=_ATTEMPT.names, dtype=object).astype({"confidence": "Float64"})

    return run(F.col("relative_path"), F.col("sample"), F.col("text"))


@dataclass(frozen=True)
class _Recorded:
    """A detector whose results are a column already."""

    plugin: str
    priority: int
    column: str

    def result(self) -> Column:
        found = F.struct(*(F.col(self.column).getField(f.name).alias(f.name) for f in _FOUND))
        return F.when(F.col(self.column).getField("plugin").isNotNull(), found)


def classify_recorded(files: DataFrame, using: Sequence[Detector | PythonDetector] | None = None) -> tuple[DataFrame, DataFrame]:
    """classify() and its errors: path, stage (read, or a detector's name), error and message.

    Every file is classified by the detectors that don't fail on it; a file that
    could not be read (a column error, where files have one) is classified as one
    without a sample. Each Python detector runs once for both tables, whose rows
    are written to the shared folder in between. Rows of a file that is listed
    twice are two.
    """
    using = list(using or detectors())
    foreign = [d for d in using if isinstance(d, PythonDetector)]
    columns = {d.plugin: f"_attempt{k}" for k, d in enumerate(foreign)}
    attempted = files.select("*", *(attempt(d).alias(columns[d.plugin]) for d in foreign))
    attempted = Tables(files.sparkSession, "attempts").write(attempted)
    recorded = [_Recorded(d.plugin, d.priority, columns[d.plugin]) if isinstance(d, PythonDetector) else d for d in using]
    found = classify(attempted, recorded).drop(*columns.values())
    kept = [F.struct(F.lit(name).alias("stage"), F.col(c)["error"].alias("error"), F.col(c)["message"].alias("message")) for name, c in columns.items()]
    if "error" in files.columns:
        kept.append(F.struct(F.lit("read").alias("stage"), F.col("error").alias("error"), F.lit(None).cast("string").alias("message")))
    stages = F.array(*kept) if kept else F.array().cast("array<struct<stage:string,error:string,message:string>>")
    errors = attempted.select(F.col("relative_path").alias("path"), F.inline(F.filter(stages, lambda x: x["error"].isNotNull())))
    return found, errors
