"""Reading and writing tables. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import RuleViolation, key_diff
from ..operators.quality import check_not_null, check_unique, strict


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType | str], fmt: str = "csv") -> dict[str, DataFrame]:
    """A named set of tables; a missing file stops the read when its plan is made."""
    out = {}
    for name, schema in schemas.items():
        if fmt == "parquet":
            d = spark.read.parquet(f"{folder}/{name}.parquet")
        else:
            d = spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema, enforceSchema=False)
        out[name] = d
    return out


def read_records(spark: SparkSession, path: str, schema, required, keys, field: str = "records", lines: bool = False) -> DataFrame:
    """Decision records inside JSON documents: required fields present, keys unique. ``lines``: one document per line."""
    doc = spark.read.schema(schema).json(path, multiLine=not lines)
    d = doc.select(F.explode(field).alias("_r")).select("_r.*")
    strict(check_not_null(d, keys, required), check_unique(d, keys))
    return d


def read_bounded(events: DataFrame, children: dict[str, DataFrame], event: str, season: str, last) -> dict[str, DataFrame]:
    """Events up to a season, or a date, then only child rows of kept events. On a stored column
    the bound is pushed to the scan."""
    kept = events.filter(F.col(season) <= F.lit(last))
    out = {"events": kept}
    for name, child in children.items():
        out[name] = child.join(kept.select(event), event, "left_semi")
    return out


def read_splits(spark: SparkSession, path: str, splits, split: str = "split") -> DataFrame:
    """Only the named splits; folders of the others are never listed for reading."""
    return spark.read.parquet(path).filter(F.col(split).isin(*splits))


def write_feature_table(df: DataFrame, path: str, split: str = "split", buckets: int | None = None) -> None:
    """Partitioned by split. ``buckets`` spreads each split over that many writers, so a large
    split is not one task."""
    if buckets:
        df = df.repartition(buckets)
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "csv":
        df.write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_once(df: DataFrame, path: str) -> None:
    """Refuse to overwrite."""
    df.write.mode("errorifexists").parquet(path)


save_features = write_once


def load_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    if schema is not None and [(f.name, f.dataType) for f in d.schema] != [(f.name, f.dataType) for f in schema]:
        raise RuleViolation("stored columns or types differ")
    return d


def to_json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON text per row; NaN and infinities become null."""
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(out))


def flatten_pages(pages: DataFrame, payload: str, schema: str, items: str, by) -> DataFrame:
    """Rows inside captured API pages. ``schema`` has total, offset, limit and the item array."""
    d = pages.select(*by, F.from_json(F.col(payload), schema).alias("_p"))
    return d.select(*by, F.col("_p.total").alias("total"), F.col("_p.offset").alias("offset"), F.explode(f"_p.{items}").alias("item"))


def page_conflicts(pages: DataFrame, payload: str, schema: str, items: str, by) -> DataFrame:
    """Captures whose pages disagree on the total or whose items do not add up to it."""
    d = pages.select(*by, F.from_json(F.col(payload), schema).alias("_p"))
    g = d.groupBy(*by).agg(F.min("_p.total").alias("low"), F.max("_p.total").alias("high"),
                           F.sum(F.size(f"_p.{items}")).alias("items"), F.max(F.col("_p.offset") + F.size(f"_p.{items}")).alias("end"))
    return g.filter((F.col("low") != F.col("high")) | (F.col("items") != F.col("high")) | (F.col("end") != F.col("high")))


def completed_ledger(results: DataFrame, declared: DataFrame, event: str) -> DataFrame:
    """Differences between the events that have results and the declared ledger (expected: none)."""
    return key_diff(results, declared, [event])


FORECAST_SCHEMA = (
    "snapshot_id string, methods array<struct<method:string, drivers:array<struct<entrant:string, predicted_order:int,"
    " rank_score:double, stages:map<string, struct<win:double, podium:double, points:double>>>>>>"
)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Long table of forecast documents: snapshot, method, entrant, order, stage, three p."""
    d = spark.read.schema(FORECAST_SCHEMA).json(path, multiLine=True)
    strict(check_unique(d, ["snapshot_id"]))
    return flatten_forecasts(d)


def flatten_forecasts(docs: DataFrame) -> DataFrame:
    d = docs.select("snapshot_id", F.explode("methods").alias("_m"))
    d = d.select("snapshot_id", "_m.method", F.explode("_m.drivers").alias("_d"))
    d = d.select("snapshot_id", "method", "_d.entrant", "_d.predicted_order", "_d.rank_score",
                 F.explode_outer("_d.stages").alias("stage", "_p"))
    return d.select("snapshot_id", "method", "entrant", "predicted_order", "rank_score", "stage",
                    F.col("_p.win").alias("p_win"), F.col("_p.podium").alias("p_podium"), F.col("_p.points").alias("p_points"))
