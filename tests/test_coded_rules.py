"""Built-in rules on small tables."""

from wardloom.operators import quality as Q


def test_future_birth_dates(spark):
    df = spark.createDataFrame([("1980-01-02",), ("2026-01-01",), ("2031-05-06",), (None,), ("unknown",)], "birthDate string")
    found = Q.evaluate(df, Q.coded_rules("Patient")).first()
    assert (found["rule_id"], found["passed"], found["total_rows"], found["failed_count"]) == ("birthdate_not_future", False, 3, 1)
    assert Q.evaluate(df, Q.coded_rules("Patient", today="2031-05-06")).first()["passed"]
    assert Q.evaluate(df.selectExpr("try_cast(birthDate AS date) AS birthDate"), Q.coded_rules("Patient")).first()["failed_count"] == 1
    assert Q.evaluate(df.withColumnRenamed("birthDate", "other"), Q.coded_rules("Patient")).first()["total_rows"] == 0
