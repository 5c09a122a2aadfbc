import re

import numpy as np
import pytest

import corpus_pipeline
from priorfield.llm import queries
from test_jaccard import plain as components_of


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    toxic, exact, near, mix, pack = (stage for _, stage in corpus_pipeline.STAGES)

    kept = toxic(spark, docs, sf)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    clean = [i for i, v in labels.items() if v == 0]
    assert kept.columns == columns and np.mean([i in left for i in clean]) > 0.9

    rows = docs.collect()
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text), r.doc_id))
    once = exact(spark, docs, sf)
    assert once.columns == columns and {r.doc_id for r in once.collect()} == {i for _, i in best.values()}

    found = components_of([(r.doc_id, r.text) for r in rows], 5, (80, 100))
    single = near(spark, docs, sf)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {c for *_, c in found}

    mixed = mix(spark, docs, sf)
    assert mixed.columns == columns and 0.5 < mixed.count() / len(rows) < 0.9
    pieces = pack(spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in rows}


def test_whole_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert len(got) and (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_is_registered(n):
    assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1


def test_near_copies_of_repeated_and_null_ids(spark):
    """The mark of a near copy lies on the row, not on its id."""
    import random

    from helpers import SCHEMA, edited, prose

    rng = random.Random(2)
    one, two, three = prose(rng, 200), prose(rng, 200), prose(rng, 200)
    copy = edited(rng, one, 1)
    rows = [(3, one), (5, copy), (5, two), (1, three), (1, edited(rng, three, 1)), (None, edited(rng, one, 1)), (None, None), (None, ""), (8, prose(rng, 50)), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).withColumn("component_id", spark_lit("mine")).withColumn("n", spark_lit(1)).repartition(3)
    near = dict(corpus_pipeline.STAGES)["ngram_jaccard"]
    got = near(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    for pair in [(3, one), (5, two), (8, rows[8][1]), (9, ""), (None, None), (None, "")]:
        assert pair in left
    assert len(left) == 7 and sum(i == 1 for i, _ in left) == 1
    # without ids the first row of a group stays
    alone = spark.createDataFrame([(None, one, "en", "s"), (None, copy, "en", "s")], SCHEMA)
    assert near(spark, alone, "").count() == 1


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_stages_on_odd_and_empty_tables(spark, sf):
    from helpers import SCHEMA, odd_documents

    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, sf)
            rows = got.count()
            assert rows <= table.count() or name == "packing"
            assert rows or not table.count() or name == "mixing"
            if name != "packing":
                assert got.columns == docs.columns
    once = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, sf)
    assert once.filter(r"text IS NULL OR text RLIKE '^\\s*$'").count() == 1


def test_near_copies_and_packing_take_small_batches(spark, monkeypatch):
    """Long texts go to Python some at a time in these stages, and the setting is what it was afterwards."""
    from helpers import SCHEMA
    from priorfield.llm import jaccard, packing, stages
    from priorfield.session import BATCH_ROWS

    seen, before = [], spark.conf.get(BATCH_ROWS)

    def noted(operator):
        return lambda *args, **kind: seen.append(int(spark.conf.get(BATCH_ROWS))) or operator(*args, **kind)

    monkeypatch.setattr(jaccard, "ngram_components", noted(jaccard.ngram_components))
    monkeypatch.setattr(packing, "pack_documents", noted(packing.pack_documents))
    docs = spark.createDataFrame([(i, f"{i} some words of a text", None, None) for i in range(30)], SCHEMA)
    near = stages.near(spark, docs, None)
    assert near.count() == 30 and stages.pack(spark, docs, None).select("doc_id").distinct().count() == 30
    assert seen == [1_000, 1_000] and int(before) > 1_000 and spark.conf.get(BATCH_ROWS) == before
