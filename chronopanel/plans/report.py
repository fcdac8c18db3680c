"""The collected facts of an analysis as one tidy table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

COLUMNS = ("section", "series", "item", "metric", "value")


def facts(df: DataFrame, section: str, keys, item: str | None, metrics) -> DataFrame:
    """Numeric columns of one result as (section, series, item, metric, value)."""
    series = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(section).alias("section"), series.alias("series"), (F.col(item) if item else F.lit("")).alias("item"),
                     F.explode(rows).alias("__i")).select("section", "series", "item", "__i.metric", "__i.value")


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def numeric_columns(df: DataFrame, keys) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in keys]


def collect(results: dict, keys) -> DataFrame:
    """Profile, model results, strategy, anomaly counts, importances and agreement, whichever
    the analysis produced."""
    parts = []
    if "profile" in results:
        d = results["profile"]
        parts.append(facts(d, "profile", keys, None, numeric_columns(d, keys)))
    if "scores" in results:
        parts.append(facts(results["scores"], "model", keys, "model", ["mean_mape", "std_mape"]))
    if "weights" in results:
        parts.append(facts(results["weights"], "strategy", keys, "model", ["weight"]))
    if "summary" in results:
        d = results["summary"]
        parts.append(facts(d, "anomaly", keys, None, numeric_columns(d, keys)))
    for name, d in results.get("explanations", {}).items():
        from ..operators.explain import top_features
        parts.append(facts(top_features(d["importance"], (), 5), f"importance:{name}", (), "feature", ["importance_pct"]))
    if "anomaly_explanation" in results:
        d = results["anomaly_explanation"]["method_agreement"]
        parts.append(facts(d, "agreement", keys, None, ["average_agreement"]))
    if not parts:
        raise ValueError("nothing to report: run a forecast or an anomaly detection first")
    return report(parts)
