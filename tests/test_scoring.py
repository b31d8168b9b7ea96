"""Result comparison: what an answer may add, and what it must not miss."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import scoring as S


def _match(spark, gold, got):
    def rows(values):
        names = [f"c{i}" for i in range(len(values[0]) if values else 1)]
        kinds = ["double" if any(isinstance(v[i], float) for v in values) else "date" if any(isinstance(v[i], dt.date) for v in values) else "int" if any(isinstance(v[i], int) for v in values) else "string" for i in range(len(names))]
        df = spark.createDataFrame(values, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
        return S.result_rows(df, F.lit("q"), [F.col(n) for n in names])

    asked = spark.createDataFrame([("q",)], "question string")
    return S.result_match(rows(gold), rows(got), asked).first()["match"]


NOVEMBER = dt.date(2017, 11, 1)


@pytest.mark.parametrize("gold, got, want", [
    ([("SP", 10), ("RJ", 5)], [("RJ", 5.0, 0.33), ("SP", 10.0, 0.67)], True),
    ([("SP", 10), ("RJ", 5)], [(0.33, 5.0, "rj"), (0.67, 10.0, "sp")], True),
    ([("SP", 10), ("RJ", 5)], [("RJ", 10.0), ("SP", 5.0)], False),
    ([(10,)], [(11,)], False),
    ([(10,)], [(10,), (10,)], False),
    ([(NOVEMBER, 4.0864)], [("2017-11-01", 4.0865)], True),
    ([(NOVEMBER,)], [("2017-11",)], True),
    ([(NOVEMBER,)], [("2017-12",)], False),
    ([("late", 2.57), ("on_time", 4.29)], [("On Time", 4.29), ("Late", 2.57)], True),
    ([("a", None), ("b", 1.0)], [("a", None), ("b", 1.0)], True),
    ([("a", None), ("b", 1.0)], [("a", 0.0), ("b", 1.0)], False),
    ([("a", 1, 1)], [("a", 1, 1)], True),
    ([("a", 1, 1)], [("a", 1)], False),
])
def test_result_match(spark, gold, got, want):
    assert _match(spark, gold, got) is want
