from priorfield.operators import quality

ENTRY = "event long, entrant long, grp long, state string"


def found(df):
    return sorted((r.rule, r.key) for r in df.collect())


def test_evidence_binds_entrant_and_group(spark):
    e = spark.createDataFrame([(1, 1, 7, "announced"), (1, 2, 7, "withdrawn"), (1, 3, 7, None), (2, 1, 7, "withdrawn"), (3, 9, None, "announced")], ENTRY)
    d = spark.createDataFrame([(1, 1, 7, "entry_list"), (1, 2, 7, "season_registration"), (1, 2, 7, "event_lineup"), (1, 2, 7, "withdrawal"), (1, 3, 8, "entry_list"),
                               (2, 1, 7, "season_registration"), (2, 1, 7, None)], "event long, entrant long, grp long, kind string")
    got = found(quality.check_evidence(e, d, "event", "entrant", "grp", "state", "kind"))
    assert got == [("announced", "2"), ("evidence", "1|3"), ("evidence", "2|1"), ("evidence", "3|9"), ("evidence_kind", "2|1"), ("withdrawal", "2|1")]
    assert found(quality.check_evidence(e.limit(0), d.limit(0), "event", "entrant", "grp", "state", "kind")) == []


def test_outcome_field(spark):
    field = spark.createDataFrame([(1, i, 7, 10) for i in range(1, 8)], "event long, entrant long, grp long, cutoff int")
    results = spark.createDataFrame([(1, 1, 7, "1", 1, 25.0), (1, 2, 8, "2", 2, None), (1, 3, 7, "DNS", None, 1.0), (1, 4, 7, "4", 4, -1.0)],
                                    "event long, entrant long, grp long, state string, place int, points double")
    gone = spark.createDataFrame([(1, 5, 7, 11), (1, 6, 7, 10), (1, 1, 7, 11), (1, 7, 8, 11)], "event long, entrant long, grp long, published int")
    args = ("event", "entrant", "grp", "state", "place", "points", "published", "cutoff")
    assert found(quality.check_outcome_field(field, results, gone, *args)) == [
        ("group", "1|2"), ("missing_result", "1|6"), ("missing_result", "1|7"), ("non_start", "1|3"), ("points", "1|4"), ("unused_withdrawal", "1|1"), ("unused_withdrawal", "1|7")]
    assert ("unique", "1|5") in found(quality.check_outcome_field(field, results, gone.unionByName(gone), *args))


def test_schedule_and_times(spark):
    c = spark.createDataFrame([(1, 5, "2024-01-02"), (2, 5, "2024-01-02"), (2, 5, "2024-01-02")], "event long, venue long, day string")
    s = spark.createDataFrame([(1, 5, "2024-01-02 10:00:00"), (1, None, "2024-01-03 10:00:00"), (2, 5, None), (3, 5, None)], "event long, venue long, start string")
    got = sorted((r.key, r.detail) for r in quality.check_schedule(s, c, "event", ["venue"], "start", "day").collect())
    assert got == [("1", "start"), ("1", "venue"), ("2", "event unknown or repeated in the calendar"), ("3", "event unknown or repeated in the calendar")]
    o = spark.createDataFrame([(1, 1, 2, 2, "a", "x"), (2, 2, 2, 1, " ", "y"), (3, None, None, None, None, None)], "id long, s int, c int, r int, by string, p string")
    assert [k for _, k in found(quality.check_outcome_times(o, ["id"], "s", "c", "r", "by", "p", ["x"]))] == ["2"] * 4 + ["3"] * 4
