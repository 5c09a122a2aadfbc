"""Preprocessing fitted on training rows only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..functions.expr import MISSING_TOKEN, finite_or_null
from ..session import materialize
from .windows import prior_features, prior_sum


def long_values(df: DataFrame, cols) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), finite_or_null(F.col(c).cast("double")).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("_p")).select("_p.column", "_p.value")


def exact_median(df: DataFrame, cols) -> DataFrame:
    """Exact median per column from counts per distinct value; no column passes one task whole."""
    c = long_values(df, cols).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("_n"))
    c = materialize(c)
    c = prior_features(c, [(["column"], [prior_sum("_before", "_n")])], ["value"])
    size = c.groupBy("column").agg(F.sum("_n").alias("_all"))
    c = c.join(F.broadcast(size), "column")  # one row per column
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = [(F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")) for at in (lo, hi)]
    picks = [F.max(F.when(h, F.col("value"))) for h in holds]
    return c.groupBy("column").agg(((picks[0] + picks[1]) / 2).alias("median"))


def fit_stats(df: DataFrame, cols) -> DataFrame:
    """Median, mean and population deviation after imputing, and whether nulls were seen."""
    spark, cols = df.sparkSession, list(cols)
    medians = {r["column"]: r["median"] for r in exact_median(df, cols).collect()}
    x = {c: finite_or_null(F.col(c).cast("double")) for c in cols}
    filled = {c: F.coalesce(x[c], F.lit(medians.get(c, 0.0))) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(filled[c]).alias(f"m{i}"), F.stddev_pop(filled[c]).alias(f"s{i}"),
                 F.max(x[c].isNull().cast("int")).alias(f"g{i}")]
    r = df.agg(*aggs).first()
    rows = [(c, float(medians.get(c, 0.0)), float(r[f"m{i}"]), float(r[f"s{i}"]) if r[f"s{i}"] > 1e-12 else 1.0,
             int(r[f"g{i}"])) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "column string, median double, mean double, scale double, indicator int")


def apply_stats(df: DataFrame, stats: DataFrame, centre: bool = True) -> DataFrame:
    """Impute and scale the columns, and add <column>__missing where training had nulls."""
    out = df
    for r in stats.collect():  # one row per feature column
        c = r["column"]
        x = finite_or_null(F.col(c).cast("double"))
        if r["indicator"]:
            out = out.withColumn(f"{c}__missing", x.isNull().cast("double"))
        shift = F.lit(r["mean"] if centre else 0.0)
        out = out.withColumn(c, (F.coalesce(x, F.lit(r["median"])) - shift) / F.lit(r["scale"]))
    return out


def category_levels(train: DataFrame, cols) -> DataFrame:
    """Levels seen in training with their position, missing text included, in sorted order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TOKEN)).alias("level")) for c in cols])
    return train.select(F.explode(pairs).alias("_p")).select("_p.*").distinct()


def encoder(numeric, categorical, keep_unknown: bool = True) -> Pipeline:
    """One-hot with an unknown bucket (or all zero) and one feature vector."""
    stages = []
    handle = "keep"
    idx = [f"{c}__idx" for c in categorical]
    hot = [f"{c}__hot" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx, stringOrderType="alphabetAsc", handleInvalid=handle))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=hot, dropLast=not keep_unknown))
    stages.append(VectorAssembler(inputCols=[*numeric, *hot], outputCol="features"))
    return Pipeline(stages=stages)


def fill_categories(df: DataFrame, cols) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TOKEN))), cols, df)


def save_fit(stats: DataFrame, path: str) -> None:
    stats.write.mode("errorifexists").parquet(path)


def load_fit(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
