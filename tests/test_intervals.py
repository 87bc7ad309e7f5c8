from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pitchgrid.operators.intervals import continuous_periods

SCHEMA = "e string, s long, t long, kind string"


def brute(rows):
    out = []
    for e in {r[0] for r in rows}:
        frames = sorted({f for k, s, t, _ in rows if k == e and s is not None and t is not None and t >= s for f in range(s, t + 1)})
        periods = []
        for f in frames:
            if periods and periods[-1][1] == f - 1:
                periods[-1][1] = f
            else:
                periods.append([f, f])
        out += [(e, "period", *p) for p in periods]
        out += [(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(periods, periods[1:])]
    return sorted(out, key=str)


def run(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA)  # the column kind clashes with the output's on purpose
    return sorted(map(tuple, continuous_periods(df, ["e"], "s", "t", block).collect()), key=str)


def test_cases(spark):
    rows = [("a", 1, 5, "x"), ("a", 6, 9, "x"), ("a", 2, 3, "x"), ("a", 2, 3, "x"), ("a", 20, 20, None), ("a", 30, 29, "x"), ("a", None, 4, "x"), ("b", 0, 100, "x"), ("b", 50, 60, "x"), (None, 7, 8, "x"), (None, 9, 9, "x")]
    for block in (2, 7, 4096):
        assert run(spark, rows, block) == brute(rows)


def test_empty(spark):
    assert run(spark, [], 8) == []


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(-2, 25)), max_size=25))
def test_random(spark, drawn):
    rows = [(e, s, s + n, "x") for e, s, n in drawn]
    assert run(spark, rows, 8) == brute(rows)
