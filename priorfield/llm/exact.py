"""Exact deduplication by whole content, in DataFrame operations only.

Equal texts are brought together in three steps, each comparing the full content:

1. locally: the partial aggregate of step 2 combines equal texts inside every input task;
2. in salted digest groups: texts meet by (digest, content, salt). Only digests with many rows
   have more than one salt, so an ordinary text crosses the network once;
3. globally: the winners of the salts of one hot digest meet by (digest, content).

Every row then looks up its group by digest alone, which is exact as long as a digest has one
content; digests with several contents are looked up by content as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

WHITE_SPACE = r"[\x20\x09-\x0D]+"
SALTS = 32
#: A digest is hot if it has more rows than this and than 1/10,000 of all rows; so at most 10,000 are.
HOT_ROWS, HOT_SHARE = 500, 10_000


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark which row of each group of equal texts stays; one row out per row in.

    Texts are equal if they are identical without white space; null counts as empty. The row with
    the most code points in its original text stays, then the smallest id (null ids last), then
    the first row. Rows that repeat in all columns are separate rows of one group, of which one
    stays. All input columns are returned, with ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` (named so whatever ``digest`` is); input columns of these names are replaced.
    An empty table gives an empty table. ``docs`` must be readable again with the same rows in
    the same order, as a table is: rows are numbered by their place.
    """
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    content = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE_SPACE, "")
    rows = docs.select(*names, F.monotonically_increasing_id().alias("_row"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_points"), content.alias("_content"))
    rows = rows.withColumn("_digest", digest(F.col("_content")))
    rank = F.struct(F.col("_points"), F.col(id_col).isNotNull().alias("known"), (-F.col(id_col)).alias("minus_id"),
                    (-F.col("_row")).alias("minus_row"))

    counts = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    # one scan gives the number of rows and the digests above the fixed limit's share of it
    many = materialize(counts.filter(F.col("_n") > 1))
    total = docs.count()
    hot = many.filter(F.col("_n") > max(hot_rows, total // HOT_SHARE)).select("_digest")

    salted = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_digest", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(SALTS))).otherwise(F.lit(0)))
    winner, size = F.max(rank).alias("_best"), F.count(F.lit(1)).alias("_size")
    merged = salted.groupBy("_digest", "_content", "_salt", "_hot").agg(winner, size)
    # contents are kept for hot digests only: they meet again
    merged = materialize(merged.withColumn("_content", F.when(F.col("_hot"), F.col("_content"))))
    again = [F.max("_best").alias("_best"), F.sum("_size").alias("_size")]
    groups = merged.filter(F.col("_hot").isNull()).select("_digest", "_best", "_size").unionByName(
        merged.filter("_hot").groupBy("_digest", "_content").agg(*again).select("_digest", "_best", "_size"))
    groups = materialize(groups.join(many.select("_digest"), "_digest", "left_semi"))
    unclear = groups.groupBy("_digest").count().filter("count > 1").select("_digest")

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    spread = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("_salt")
    keys = ["_digest", "_salt"]
    if unclear.isEmpty():
        found = rows.drop("_content").withColumn("_salt", spread).join(groups.select("*", salts), keys, "left")
    else:  # a digest with several contents: its rows are grouped and looked up by content
        odd = rows.join(unclear, "_digest", "left_semi")
        own = odd.groupBy("_digest", "_content").agg(winner, size)
        clear = groups.join(unclear, "_digest", "left_anti")
        one = rows.join(unclear, "_digest", "left_anti").drop("_content").withColumn("_salt", spread)
        two = odd.withColumn("_salt", spread).join(own.select("*", salts), [*keys, "_content"], "left").drop("_content")
        found = one.join(clear.select("*", salts), keys, "left").unionByName(two)
    alone = F.col("_best").isNull()
    return found.select(
        *names, F.when(alone, F.col(id_col)).otherwise(-F.col("_best.minus_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("_best.minus_row") == -F.col("_row"))).alias("kept"), F.col("_digest").alias("text_sha256"))
