"""Transforms, crossmaps and standards on small records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardloom import standards
from wardloom.functions import transforms as T
from wardloom.operators import crossmap
from wardloom.operators import vocabulary as V
from wardloom.standards import crossmaps


def one(spark, name, value, config=None, kind="string", **others):
    df = spark.createDataFrame([(value, *others.values())], ", ".join([f"v {kind}", *(f"{k} string" for k in others)]))
    return df.select(T.apply(name, F.col("v"), config or {}, F.col).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, value, config, want",
    [
        ("passthrough", "a", {}, "a"), ("nowhere", "a", {}, "a"), ("str", None, {}, ""), ("hl7v2_field", "x", {}, "x"),
        ("int", "3.9", {}, 3), ("int", "-3.9", {}, -3), ("int", "abc", {}, None), ("int", None, {}, None), ("int", "NaN", {}, None),
        ("float", "1.5", {}, 1.5), ("float", "x", {}, None), ("bool", "Yes", {}, True), ("bool", "0", {}, False), ("bool", "2", {}, True), ("bool", None, {}, None),
        ("value_map", "1", {"map": {1: "one"}}, "one"), ("value_map", "2", {"map": {1: "one"}}, "2"), ("value_map", None, {"map": {1: "one"}, "default": "d"}, "d"), ("value_map", "x", {}, "x"),
        ("format", "20240305", {"input_format": "%Y%m%d", "pattern": "%d.%m.%Y"}, "05.03.2024"), ("format", "soon", {"input_format": "%Y%m%d", "pattern": "%Y"}, "soon"), ("format", None, {}, ""), ("format", "7", {"pattern": "n={}!"}, "n=7!"),
        ("fhir_date", "3/5/2024", {}, "2024-03-05"), ("fhir_date", "25/12/2023", {}, "2023-12-25"), ("fhir_date", "later", {}, "later"), ("fhir_date", None, {}, None),
        ("split", "a^b^c", {"separator": "^", "index": 1}, "b"), ("split", "a^b", {"separator": "^", "index": 5}, None), ("split", "a^b", {"separator": "^", "index": -1}, "b"),
        ("extract_id", "Patient/12", {}, "12"), ("extract_id", "", {}, None),
    ],
)
def test_scalars(spark, name, value, config, want):
    assert one(spark, name, value, config) == want


def test_structs(spark):
    cc = one(spark, "codeable_concept", "E11", {"system": "s", "display_field": "d"}, d="Diabetes")
    assert cc["coding"][0].asDict() == {"system": "s", "code": "E11", "display": "Diabetes"} and cc["text"] == "Diabetes"
    assert one(spark, "codeable_concept", "E11", {"display_field": "d"}, d=None)["text"] == "E11"
    assert one(spark, "codeable_concept", None) is None
    assert one(spark, "fhir_reference", "7")["reference"] == "Patient/7" and one(spark, "fhir_reference", None) is None
    assert one(spark, "fhir_period", "x", {"start_field": "a", "end_field": "b"}, a="2024", b="").asDict() == {"start": "2024", "end": None}
    assert one(spark, "dv_quantity", "x", {"unit_field": "u"}, u="mg").asDict() == {"_type": "DV_QUANTITY", "magnitude": 0.0, "units": "mg"}
    text = one(spark, "dv_coded_text", "8507", {"terminology": "T"})
    assert text["value"] == "8507" and text["defining_code"]["terminology_id"]["value"] == "T"
    assert one(spark, "concat", "a", {"fields": ["v", "b"], "separator": "-"}, b=None) == "a"
    assert one(spark, "archetype_wrap", "v", {"archetype": "at1"}).asDict() == {"archetype_node_id": "at1", "value": "v"}


def test_own_transform(spark):
    T.register("twice", lambda v, c, r: F.concat(v, v))
    assert one(spark, "twice", "ab") == "abab"


def test_cross_map_person(spark):
    df = spark.createDataFrame([(1, 8507, dt.date(1980, 1, 2), 5)], "person_id long, gender_concept_id long, birth_datetime date, location_id long")
    got = crossmap.cross_map(df, crossmaps.load("omop_cdm", "fhir_r4"), "person").first().asDict(recursive=True)
    assert got["resourceType"] == "Patient" and got["gender"] == "male" and got["birthDate"] == "1980-01-02"
    assert got["identifier"] == {"value": "1"} and got["address"]["reference"]["reference"] == "Location/5"
    assert crossmap.cross_map(df, crossmaps.load("omop", "fhir"), "unheard_of") is df
    assert crossmap.cross_map(df.limit(0), crossmaps.load("omop", "fhir"), "person").count() == 0


@pytest.mark.parametrize("pair", list(crossmaps.BUILT_IN))
def test_every_entity_maps_an_empty_record(spark, pair):
    rules = crossmaps.load(*pair)
    for entity, (_, fields) in rules.entities.items():
        names = list(dict.fromkeys(r.field for r in fields))
        df = spark.createDataFrame([tuple(None for _ in names)], ", ".join(f"`{n}` string" for n in names))
        assert crossmap.cross_map(df, rules, entity).count() == 1


def test_nest_and_coverage(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    got = df.select(*crossmap.nest({"x.y[0].z": F.col("a"), "x.w": F.col("b"), "k": F.col("a"), "k.j": F.col("b")})).first()
    assert got.asDict(recursive=True) == {"x": {"y": {"z": 1}, "w": 2}, "k": {"j": 2}}
    rest = crossmap.coverage(crossmaps.load("omop", "openehr"), "person", standards.load("omop"), standards.load("openehr"))
    assert "race_concept_id" in rest["unmapped_source"] and "uid" not in rest["unmapped_target"]


def test_standards(tmp_path):
    assert [len(standards.load(a).entities) for a in ("omop", "fhir", "hl7v2", "openehr")] == [19, 18, 8, 7]
    omop = standards.load("omop")
    person = {f.name: f for f in omop.entity("person")}
    assert person["gender_concept_id"].category == "code" and person["year_of_birth"].category == "numeric"
    assert not omop.schema("person")["person_id"].nullable and "FOREIGN KEY (person_id)" in omop.ddl("death")
    assert standards.load("fhir").schema("Condition")["code"].dataType.fieldNames() == ["coding", "text"]
    path = tmp_path / "own.txt"
    path.write_text("own resource Thing.name\nThing: id string!, name text")
    own = standards.load(f"custom:{path}")
    assert own.default == ("Thing", "name") and own.entity("Thing")[0].required
    with pytest.raises(KeyError):
        standards.load("nothing")


def test_vocabulary_structs(spark):
    df = spark.createDataFrame([("1", "One", "SNOMED"), ("2", "", "Other"), (None, "x", "LOINC")], "c string, d string, v string")
    got = df.select(V.codeable_concept(F.col("c"), F.col("d"), F.col("v")).alias("x"), V.coded_text(F.col("c"), F.col("d"), F.col("v")).alias("y")).collect()
    assert got[0]["x"]["coding"][0]["system"] == "http://snomed.info/sct" and got[1]["x"]["coding"][0]["system"] is None
    assert got[1]["x"]["text"] == "2" and got[2]["x"] is None and got[0]["y"]["defining_code"]["terminology_id"]["value"] == "SNOMED-CT"
