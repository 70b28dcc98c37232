"""Functions registered for SQL against the column expressions of the same rules."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from pricelens.functions import scoring
from pricelens.functions.registered import FUNCTIONS, register_functions


def test_sql_functions_equal_the_columns(spark):
    assert register_functions(spark) == register_functions(spark) == [f"listing_{name}" for name in FUNCTIONS]
    numbers = [None, 0.0, 1.0, 7.0, 8.0, 45.0, 1998.0, 120_000.0, -3.0]
    rows = [(a, b, c, flag) for (a, b), (c, flag) in zip(itertools.product(numbers, numbers), itertools.cycle([(6.0, True), (90_000.0, False), (0.5, True)]))]
    df = spark.createDataFrame(rows, "a double, b double, c double, flag boolean")
    a, b, c, flag = (F.col(n) for n in ("a", "b", "c", "flag"))
    pairs = {
        "listing_distance_score(a, b, c)": scoring.distance_score(a, b, c), "listing_mileage_scale(a)": scoring.mileage_scale(a),
        "listing_freshness_score(a, flag)": scoring.freshness_score(a, flag), "listing_similarity(a, b, c, 0.65)": scoring.similarity(a, b, c),
        "listing_percent_change(a, b)": scoring.percent_change(a, b), "listing_price_delta(a, b)": scoring.price_delta(a, b),
        "listing_sample_status(CAST(a AS BIGINT))": scoring.sample_status(a.cast("bigint")),
    }
    assert {call.split("(")[0] for call in pairs} == {f"listing_{name}" for name in FUNCTIONS}
    shown = df.select(*[F.struct(F.expr(call).alias("sql"), column.alias("col")).alias(f"p{i}") for i, (call, column) in enumerate(pairs.items())]).collect()
    wrong = [(call, row[i]) for row in shown for i, call in enumerate(pairs) if row[i]["sql"] != row[i]["col"]]
    assert not wrong
