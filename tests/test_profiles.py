"""Information content and calibration: annotations meet in tasks dealt by profile, in number as the table is long."""

import math

import pytest

from graphloom.operators import ontology as O
from graphloom.shared import dealt


def frames(spark):
    is_a = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("x", "r"), ("y", "r")], "child string, parent string")
    rows = [(1, "a", 0.5), (1, "a", 0.1), (1, "x", None), (1, "b", 1.0), (2, "x", 0.2), (3, "z", 0.4), (None, "q", 0.4), (4, None, 0.4)]
    return spark.createDataFrame(rows, "profile long, term string, frequency double"), O.ancestors(is_a)


def test_tasks_follow_the_rows(spark):
    assert [dealt(spark.range(9), n, "id", each=4).rdd.getNumPartitions() for n in (0, 4, 9)] == [1, 1, 3]


def test_information_content_counts_profiles_once(spark):
    annotations, closure = frames(spark)
    ic = O.information_content(annotations, closure)
    got = {r["term"]: (r["n"], r["ic"]) for r in ic.collect()}
    n = {"a": 1, "b": 1, "x": 2, "y": 1, "r": 2, "z": 1, "q": 0, None: 1}
    assert got == {t: (k, pytest.approx(max(0.0, -math.log(k / 4)) if k else 0.0)) for t, k in n.items()}
    plan = ic._jdf.queryExecution().optimizedPlan().toString()
    # Ancestors are added where the rows of a profile are; they are not sent one by one.
    assert plan.index("Generate") < plan.index("RepartitionByExpression [profile") and "Aggregate [profile" not in plan[plan.index("RepartitionByExpression") :].split("Join")[0]


def test_calibration_finds_its_pairs_once(spark, monkeypatch):
    labels, write = [], O.staged
    monkeypatch.setattr(O, "staged", lambda df, label: (labels.append(label), write(df, label))[1])
    annotations, closure = frames(spark)
    row = O.calibration(annotations.where("profile IS NOT NULL AND term IS NOT NULL"), O.information_content(annotations, closure), closure, 2, 0.45, 1).first()
    assert row["n"] == 1 and row["threshold"] == row["p95"] and "calibration" in labels
