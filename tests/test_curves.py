import random
import statistics

from pyspark.sql import functions as F

from mnemoscope.operators import curves as V
from mnemoscope.plans import jobs

REPORT = ("manifestHash string, arrival int, scale int, fixtureHash string, deterministic boolean, correct bigint, answered bigint, total bigint,"
          "adapter string, model string")


SCALES = (10, 100, 500, 1000)


def fleet(seed):
    """Reports of several adapters, each over some scales and some of them repeated; some answer nothing."""
    rng, rows = random.Random(seed), []
    for adapter in ("fern", "moss", "reed"):
        for scale in rng.sample(SCALES, rng.choice((2, 3, 4))):
            for _ in range(rng.choice((1, 1, 2, 3))):
                total = rng.randrange(20, 60)
                answered = rng.choice((0, rng.randrange(1, total)))
                rows.append((f"h{len(rows)}", len(rows), scale, f"fixture-{scale}", {"fern": False, "moss": None, "reed": True}[adapter],
                             rng.randrange(answered + 1), answered, total, adapter, "one"))
    return rows


def reports(spark, extra=()):
    rows = [(f"m{scale}", i, scale, f"fixture-{scale}", False, 3 + i, 7, 9, "a", "m") for i, scale in enumerate(SCALES)]
    return spark.createDataFrame([*rows, *extra], REPORT)


def test_points_lines_and_variance_equal_plain_counts(spark):
    for seed in (3, 14):
        rows = fleet(seed)
        made = jobs.compare_reports(spark.createDataFrame(rows, REPORT))
        points = {p.arrival: p for p in made["points"].collect()}
        assert len(points) == len(rows) and len({p.seriesId for p in points.values()}) == len({r[8] for r in rows})
        values, repeats = {}, {}
        for _, arrival, scale, _, _, correct, answered, total, adapter, _ in rows:
            repeats[adapter, scale] = repeats.get((adapter, scale), 0) + 1
            value = correct / answered if answered else None
            assert (points[arrival].accuracy, points[arrival].completionRate, points[arrival].repeat) == (value, answered / total, repeats[adapter, scale])
            values[points[arrival].seriesId, repeats[adapter, scale], scale] = value
        # A line goes on where the scale right below has a value in the same repeat, and begins anew elsewhere.
        want = {}
        for (series, repeat, scale), value in values.items():
            below = SCALES[SCALES.index(scale) - 1] if scale != SCALES[0] else None
            if value is not None:
                want[series, repeat, scale] = "M" if values.get((series, repeat, below)) is None else "L"
        assert {(r.seriesId, r.repeat, r.scale): r.command for r in made["accuracyLines"].collect()} == want
        assert made["missingScales"].count() == sum(len(SCALES) - len({r[2] for r in rows if r[8] == a}) for a in {r[8] for r in rows})
        spread = {}
        for (series, _, scale), value in values.items():
            spread.setdefault((series, scale), []).extend([] if value is None else [value])
        steady = {points[r[1]].seriesId for r in rows if r[8] == "reed"}
        variance = {(r.seriesId, r.scale): r for r in made["variance"].collect()}
        assert set(variance) == {k for k in spread if k[0] not in steady}
        for key, row in variance.items():
            found = spread[key]
            runs = sum((series, scale) == key for series, _, scale in values)
            assert (row.runs, row.accuracyCount, row.status) == (runs, len(found), "reported" if runs > 1 else "not-reported")
            assert len(found) < 2 or abs(row.accuracyVariance - statistics.pvariance(found)) < 1e-12


def test_segments_count_the_gaps_before_them(spark):
    rows = spark.createDataFrame([("x", 2, 100, 0.9), ("x", 2, 1000, 0.3), ("x", 1, 10, 0.2), ("x", 1, 100, 0.1)], "seriesId string, repeat int, scale int, accuracy double")
    got = {(r.repeat, r.scale): (r.segment, r.command) for r in V.segments(rows, "accuracy").collect()}
    assert got[1, 10][1] == "M" and got[1, 100] == (got[1, 10][0], "L") and got[2, 1000] == (got[2, 100][0] + 1, "M")


def test_duplicates_and_odd_scales_are_reported(spark):
    twice = reports(spark, [("m10", 7, 10, "fx10", False, 1, 1, 1, "a", "m"), ("odd", 8, 11, "x", False, 1, 1, 1, "a", "m")])
    assert {r.manifestHash for r in V.curve_violations(twice).collect()} == {"m10", "odd"}


def test_comparability(spark):
    runs = spark.createDataFrame([("a", "h", "m", True, None), ("b", "h", "m", True, None), ("c", "h", "n", None, None), ("d", "h", "m", True, "M20")],
                                 "runId string, fixtureHash string, model string, deterministic boolean, problem string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "ghost")], "runA string, runB string")
    rows = {r.runB: r for r in V.comparability(runs, pairs).collect()}
    assert rows["b"].comparable and not rows["b"].varianceRequired
    assert rows["c"].mismatches == ["model"] and rows["c"].varianceRequired
    assert rows["d"].mismatches == ["manifest_b: M20"] and rows["ghost"].mismatches == ["manifest_b: missing"]


def test_calibration_job(spark):
    expected = "struct<matchType:string, acceptedAnswers:array<string>, targetNumber:string, tolerance:string, toleranceMode:string>"
    rows = spark.createDataFrame([("set", f"p{i}", "blue" if i < 98 else "red", "pass", True, ("exact", ["Blue"], None, None, None)) for i in range(100)],
                                 f"calibrationSetId string, probeId string, candidateAnswer string, goldJudgment string, answerability boolean, expected {expected}")
    headers = spark.createDataFrame([("set", "h", "x", "x", "human", "ann", "human", "bo")], "calibrationSetId string, rowsHash string, labelingMethod string,"
                                    "reviewMethod string, labelKind string, labelerId string, reviewKind string, reviewerId string")
    from mnemoscope.operators.matching import match_answers
    made = jobs.calibrate(rows, headers, match_answers)
    row = made["decision"].first()
    assert (row.matched, row.total, row.approved, row.canonical) == (98, 100, True, True)
    assert made["mismatches"].count() == 2 and made["violations"].isEmpty()
    seen = []
    jobs.calibrate(rows, headers, lambda r: seen.append(r.columns) or match_answers(r))
    assert "goldJudgment" not in seen[0] and "candidateAnswer" not in seen[0] and F.col is not None
