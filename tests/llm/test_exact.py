import hashlib
import re

from pyspark.sql import functions as F

from helpers import SCHEMA, odd_documents
from priorfield.llm.exact import exact_dedup


def plain(rows):
    """Groups of equal texts; the row that stays."""
    groups = {}
    for at, (i, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, at, i))
    out = []
    for text, members in groups.items():
        keep = min(members)
        out += [(i, keep[4], len(members), at == keep[3], hashlib.sha256(text.encode()).hexdigest()) for *_, at, i in members]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("kept", F.lit("mine")).withColumn("group_size", F.lit("x"))
    got = exact_dedup(docs)
    assert result(got) == plain(rows) and set(got.columns) == {"doc_id", "text", "lang", "source", "keep_id", "group_size", "kept", "text_sha256"}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_hot_group_is_salted(spark):
    rows = [(i, "same  text" + " " * (i % 3), None, None) for i in range(300)] + [(1000 + i, f"own {i}", None, None) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(exact_dedup(docs, hot_rows=20)) == plain(rows)


def test_digests_that_collide_do_not_join_texts(spark):
    rows = [(i, f"{'ab'[i % 2]} text {i % 5}", None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for hot in (5, 500):
        got = exact_dedup(docs, digest=lambda c: F.substring(c, 1, 1), hot_rows=hot)
        assert [r[:4] for r in result(got)] == [r[:4] for r in plain(rows)]
