import pytest
from pyspark.sql import functions as F

from priorfield.operators import models, windows as w


def events(spark, days):
    return spark.createDataFrame([(i, d) for i, d in enumerate(days)], "event_id long, event_date int").repartition(3)


def test_blocks_keep_dates_together(spark):
    days = [1, 1, 1, 2, 3, 3, 3, 3, 4, 5, 6, 6]
    got = w.split_blocks(events(spark, days), ["event_date", "event_id"], "event_date", {"a": 1 / 3, "b": 1 / 3}, "c")
    assert got.columns == ["event_id", "event_date", "block"] and got.count() == 12
    assert {(r.event_date, r.block) for r in got.collect()} == {(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, "c")}


@pytest.mark.parametrize("days", [[], [1], [1, 1, 1, 1], [1, 1, 2, 2]])
def test_empty_blocks_are_an_error(spark, days):
    with pytest.raises(ValueError, match="no events"):
        w.split_blocks(events(spark, days), ["event_date", "event_id"], "event_date", {"a": 1 / 3, "b": 1 / 3}, "c")


def test_validation_and_family(spark):
    rows = [(i, 1995 + i % 4, float(i % 7), float(i % 5), int((i % 7) + (i * 2654435761 >> 7) % 5 > 5)) for i in range(800)]
    d = spark.createDataFrame(rows, "id long, season int, a double, b double, y int")
    grid = models.candidate_grid({"one": ("a",), "two": ("a", "b")}, {"logistic": [{}], "forest": [{"trees": 3, "depth": 2}]})
    folds = [("f1", 1996, 1997), ("f2", 1997, 1998)]
    cv = models.temporal_cv(d, ["y"], grid, folds, "season")
    assert cv.count() == len(grid) * len(folds)
    for r in cv.collect():
        c = next(c for c in grid if c.name == r.candidate)
        end, score = {"f1": (1996, 1997), "f2": (1997, 1998)}[r.fold]
        m = models.FIT[c.family](models.assemble(d.filter(F.col("season") <= end), c.features), "y", **c.params)
        p = models.probability(m, models.assemble(d.filter(F.col("season") == score), c.features)).toPandas()
        assert r.brier == pytest.approx(((p.p - p.y) ** 2).mean(), abs=0.02) and r.rows == len(p)  # trees sample rows
    best = {c.family: c for c in grid if len(c.features) == 2}
    table, chosen = models.select_family(d.filter("season < 1997"), d.filter("season = 1997"), d.filter("season = 1998"), ["y"], best)
    got = table.collect()
    assert len(got) == 2 and sum(r.chosen for r in got) == 1 and {r.calibrator for r in got} <= {"none", "platt", "isotonic"}
    winner = min(got, key=lambda r: (r.log_loss, r.brier, r.family))
    assert winner.chosen and chosen["y"][1] == winner.calibrator
