"""System addresses and terminology names of the reference's vocabularies."""

from pyspark.sql import functions as F

from wardloom.operators import vocabulary as V


def test_systems_and_terminologies(spark):
    assert {"ICD10PCS", "ICD9CM", "CPT4", "HCPCS", "NDC", "CVX", "Gender", "Race", "Ethnicity", "UCUM", "SNOMED", "LOINC", "RxNorm", "ICD10CM"} <= V.SYSTEMS.keys()
    assert {"ICD10PCS", "ICD9CM", "CPT4", "HCPCS", "NDC", "UCUM", "SNOMED", "LOINC", "RxNorm", "ICD10CM"} <= V.TERMINOLOGIES.keys()
    df = spark.createDataFrame([("1", "One", v) for v in ("Gender", "ICD10PCS", "ICD9CM")], "c string, d string, v string")
    cols = F.col("c"), F.col("d"), F.col("v")
    got = {r["v"]: r for r in df.select("v", V.codeable_concept(*cols).alias("x"), V.coded_text(*cols).alias("y")).collect()}
    assert got["Gender"]["x"]["coding"][0]["system"] == "http://hl7.org/fhir/administrative-gender"
    assert got["ICD10PCS"]["x"]["coding"][0]["system"] == "http://www.cms.gov/Medicare/Coding/ICD10"
    assert [got[v]["y"]["defining_code"]["terminology_id"]["value"] for v in ("ICD10PCS", "ICD9CM")] == ["ICD10-PCS", "ICD9-CM"]
