"""Built-in crossmaps: entities, fields and values on filled records."""

import datetime as dt

import pytest

from wardloom.operators import crossmap
from wardloom.standards import crossmaps

OMOP_TO_FHIR = {
    "person": "Patient", "visit_occurrence": "Encounter", "condition_occurrence": "Condition", "drug_exposure": "MedicationRequest",
    "measurement": "Observation", "procedure_occurrence": "Procedure", "observation": "Observation",
}
FHIR_TO_OMOP = {
    "Patient": "person", "Encounter": "visit_occurrence", "Condition": "condition_occurrence", "MedicationRequest": "drug_exposure",
    "Observation": "measurement", "Procedure": "procedure_occurrence", "AllergyIntolerance": "observation", "DiagnosticReport": "measurement",
}
CONCEPT = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>"


def fields(pair, entity):
    return {r.field for r in crossmaps.load(*pair).entities[entity][1]}


def mapped(spark, pair, entity, schema, *values):
    df = spark.createDataFrame([values], schema)
    return crossmap.cross_map(df, crossmaps.load(*pair), entity).first().asDict(recursive=True)


def test_entities():
    for pair, want, count in ((("omop", "fhir"), OMOP_TO_FHIR, 7), (("fhir", "omop"), FHIR_TO_OMOP, 8)):
        got = {e: to for e, (to, _) in crossmaps.load(*pair).entities.items()}
        assert len(want) == count and want.items() <= got.items()
    assert fields(("omop", "fhir"), "observation") == {
        "observation_id", "person_id", "observation_concept_id", "observation_date", "value_as_string", "value_as_number",
    }


def test_observation_to_fhir(spark):
    schema = "observation_id long, person_id long, observation_concept_id long, observation_source_value string, observation_date date, value_as_string string, value_as_number double"
    got = mapped(spark, ("omop", "fhir"), "observation", schema, 4, 7, 4275495, "smoker", dt.date(2024, 3, 5), "daily", 2.5)
    assert got["resourceType"] == "Observation" and got["id"] == "4" and got["subject"] == {"reference": "Patient/7"}
    assert got["code"]["coding"] == [{"system": "http://loinc.org", "code": "4275495", "display": "smoker"}] and got["code"]["text"] == "smoker"
    assert got["effectiveDateTime"] == "2024-03-05" and got["valueString"] == "daily" and got["valueQuantity"] == {"value": 2.5}
    got = mapped(spark, ("omop", "fhir"), "observation", schema, 4, 7, None, "smoker", None, None, None)
    assert got["code"] == {"coding": [], "text": "smoker"}


def test_allergy_and_report_to_omop(spark):
    schema = f"id string, patient struct<reference:string>, code {CONCEPT}, recordedDate string"
    code = ([("http://snomed.info/sct", "91936005", "Allergy to penicillin")], "Penicillin")
    got = mapped(spark, ("fhir", "omop"), "AllergyIntolerance", schema, "3", ("Patient/7",), code, "2024-03-05")
    assert got["observation_id"] == 3 and got["person_id"] == 7 and got["observation_date"] == "2024-03-05"
    assert got["observation_source_value"] == "91936005" and got["value_as_string"] == "Penicillin"
    schema = f"id string, subject struct<reference:string>, code {CONCEPT}, effectiveDateTime string, conclusion string"
    got = mapped(spark, ("fhir", "omop"), "DiagnosticReport", schema, "5", ("Patient/a-1",), ([("http://loinc.org", "58410-2", None)], None), "2024-03-06", "normal")
    assert got["measurement_id"] == 5 and got["person_id"] is None and got["person_source_value"] == "a-1"
    assert got["measurement_source_value"] == "58410-2" and got["measurement_date"] == "2024-03-06" and got["value_source_value"] == "normal"


ROUND_TRIPS = [
    ("person", "person_id long, person_source_value string, gender_concept_id int, birth_datetime date", (7, "MRN-7", 8532, dt.date(1980, 1, 2))),
    (
        "visit_occurrence", "visit_occurrence_id long, person_id long, visit_concept_id int, visit_start_date date, visit_end_date date",
        (11, 7, 9201, dt.date(2024, 3, 1), dt.date(2024, 3, 5)),
    ),
    ("condition_occurrence", "condition_occurrence_id long, person_id long, condition_source_value string, condition_start_date date", (12, 7, "E11.9", dt.date(2024, 3, 1))),
    (
        "drug_exposure", "drug_exposure_id long, person_id long, drug_source_value string, drug_exposure_start_date date, quantity double",
        (13, 7, "860975", dt.date(2024, 3, 1), 30.0),
    ),
    (
        "measurement", "measurement_id long, person_id long, measurement_source_value string, value_as_number double, unit_source_value string, measurement_date date",
        (14, 7, "4548-4", 6.1, "%", dt.date(2024, 3, 1)),
    ),
    ("procedure_occurrence", "procedure_occurrence_id long, person_id long, procedure_source_value string, procedure_date date", (15, 7, "80146002", dt.date(2024, 3, 1))),
]


@pytest.mark.parametrize("entity, schema, values", ROUND_TRIPS, ids=[x[0] for x in ROUND_TRIPS])
def test_round_trip_by_fhir(spark, entity, schema, values):
    df = spark.createDataFrame([values], schema)
    there = crossmap.cross_map(df, crossmaps.load("omop", "fhir"), entity)
    back = crossmap.cross_map(there, crossmaps.load("fhir", "omop"), OMOP_TO_FHIR[entity]).first().asDict(recursive=True)
    for name, value in zip(df.columns, values):
        assert back[name] == (value.isoformat() if isinstance(value, dt.date) else value), name


def test_fhir_records_as_json_and_plain_text(spark):
    got = mapped(
        spark, ("fhir", "omop"), "Observation", "id string, subject string, code string, valueQuantity string, valueString string", "1", '{"reference": "Patient/7"}',
        '{"coding": [{"system": "http://loinc.org", "code": "718-7"}]}', '{"value": 13.5, "unit": "g/dL"}', "trace",
    )
    assert (got["person_id"], got["measurement_source_value"], got["value_as_number"], got["unit_source_value"], got["value_source_value"]) == (7, "718-7", 13.5, "g/dL", "trace")
    got = mapped(spark, ("fhir", "omop"), "Observation", "id string, subject string, code string, valueQuantity double", "1", "Patient/7", "718-7", 13.5)
    assert (got["person_id"], got["measurement_source_value"], got["value_as_number"], got["unit_source_value"]) == (7, "718-7", 13.5, None)


def test_fhir_to_openehr(spark):
    schema = f"code {CONCEPT}, valueQuantity struct<value:double,unit:string>, valueString string"
    got = mapped(spark, ("fhir", "openehr"), "Observation", schema, ([("http://loinc.org", "718-7", "Hb")], None), (13.5, "g/dL"), "high")
    assert got["test_name"]["value"] == "Hb" and got["test_name"]["defining_code"]["code_string"] == "718-7"
    assert got["result_value"] == {"_type": "DV_QUANTITY", "magnitude": 13.5, "units": "g/dL"} and got["result_text"] == "high"
    got = mapped(spark, ("fhir", "openehr"), "Encounter", "id string, period struct<start:string,end:string>", "1", ("2024-03-01", None))
    assert "2024-03-01" in got.values()


# Source fields of the reference, by entity.
REFERENCE = {
    ("omop", "fhir"): """
person: person_id gender_concept_id birth_datetime person_source_value race_concept_id
visit_occurrence: visit_occurrence_id person_id visit_concept_id visit_start_date visit_source_value
condition_occurrence: condition_occurrence_id person_id condition_concept_id condition_start_date condition_source_value
drug_exposure: drug_exposure_id person_id drug_concept_id drug_exposure_start_date drug_source_value
measurement: measurement_id person_id measurement_concept_id measurement_date value_as_number measurement_source_value
procedure_occurrence: procedure_occurrence_id person_id procedure_concept_id procedure_date
observation: observation_id person_id observation_concept_id observation_date value_as_string value_as_number
""",
    ("fhir", "omop"): """
Patient: id gender birthDate identifier
Encounter: id subject type period
Condition: id subject code onsetDateTime
MedicationRequest: id subject medicationCodeableConcept authoredOn
Observation: id subject code effectiveDateTime valueQuantity valueString
Procedure: id subject code performedDateTime
""",
    ("hl7v2", "fhir"): """
PID: patient_id patient_name date_of_birth administrative_sex race patient_address phone_home marital_status ssn ethnic_group patient_death_date patient_death_indicator
PV1: visit_number patient_class admission_type admit_date_time attending_doctor hospital_service discharge_disposition
DG1: diagnosis_code diagnosis_description diagnosis_date_time diagnosis_type
OBX: observation_identifier observation_value units reference_range abnormal_flags date_time_of_observation observation_result_status
OBR: placer_order_number filler_order_number universal_service_identifier observation_date_time result_status ordering_provider
RXE: give_code give_amount_minimum give_route prescription_number
AL1: allergen_code allergy_type allergy_severity allergy_reaction identification_date
""",
    ("omop", "openehr"): """
person: person_id person_source_value birth_datetime gender_concept_id race_concept_id
visit_occurrence: visit_occurrence_id visit_start_date visit_end_date visit_source_value care_site_id
condition_occurrence: condition_source_value condition_concept_id condition_start_date
drug_exposure: drug_source_value drug_exposure_start_date drug_exposure_end_date quantity sig route_concept_id drug_concept_id
measurement: measurement_source_value measurement_date value_as_number unit_source_value range_low range_high
procedure_occurrence: procedure_source_value procedure_date
""",
    ("fhir", "openehr"): """
Patient: id name birthDate gender address telecom
Encounter: id period class serviceProvider
Condition: code onsetDateTime verificationStatus clinicalStatus
MedicationRequest: medicationCodeableConcept authoredOn dosageInstruction status
Observation: code effectiveDateTime valueQuantity valueString status
Procedure: code performedDateTime
""",
}


@pytest.mark.parametrize("pair, count", list(zip(REFERENCE, (36, 26, 45, 28, 25))), ids=["-".join(p) for p in REFERENCE])
def test_every_field_of_the_reference_is_read(pair, count):
    wanted = [(e, f) for e, _, fs in (x.partition(": ") for x in REFERENCE[pair].split("\n") if x) for f in fs.split()]
    read = {(e, f) for e, (_, rules) in crossmaps.load(*pair).entities.items() for r in rules for f in r.reads}
    left_out = {("person", "race_concept_id")} if pair == ("omop", "openehr") else set()  # README, Not built
    assert len(wanted) == count and set(wanted) - read == left_out


def test_value_maps(spark):
    hl7 = ("hl7v2", "fhir")
    for code, want in {"I": "IMP", "O": "AMB", "E": "EMER", "P": "PRENC", "?": "AMB"}.items():
        assert mapped(spark, hl7, "PV1", "patient_class string", code)["class"]["code"] == want
    for name in ("observation_result_status", "result_status"):
        got = [mapped(spark, hl7, "OBX", f"{name} string", x)["status"] for x in "FPCDRX?"]
        assert got == ["final", "preliminary", "corrected", "cancelled", "registered", "cancelled", "unknown"]
    assert [mapped(spark, hl7, "OBR", "result_status string", x)["status"] for x in "ARX"] == ["partial", "registered", "cancelled"]
    assert [mapped(spark, hl7, "AL1", "allergy_type string", x)["category"] for x in ("FA", "EA", "PA", "DA")] == ["food", "environment", "biologic", "medication"]
    assert [mapped(spark, ("omop", "fhir"), "person", "gender_concept_id int", x)["gender"] for x in (8507, 8551, 8570, 0)] == ["male", "other", "unknown", "unknown"]
    assert [mapped(spark, ("omop", "openehr"), "person", "gender_concept_id int", x)["sex"]["value"] for x in (8532, 8551, None)] == ["Female", "Indeterminate", "Not known"]
    assert mapped(spark, ("fhir", "openehr"), "Encounter", "class struct<code:string>", ("HH",))["context_setting"]["value"] == "home health"


def test_hl7_records(spark):
    hl7 = ("hl7v2", "fhir")
    pid = mapped(spark, hl7, "PID", "patient_id string, ssn string, date_of_birth string, race string, ethnic_group string, patient_death_indicator string", "7", "123", "198001020830", "R5", "", "Y")
    assert [(x["type"]["coding"][0]["code"], x["value"]) for x in pid["identifier"]] == [("MR", "7"), ("SS", "123")]
    assert pid["birthDate"] == "1980-01-02" and [x["valueString"] for x in pid["extension"]] == ["R5"] and pid["deceasedBoolean"] is True
    assert mapped(spark, hl7, "PID", "patient_identifier_list string, date_of_birth string", "8", "198001")["identifier"][0]["value"] == "8"
    pv1 = mapped(spark, hl7, "PV1", "admit_date_time string, discharge_date string", "20240301101500.5+0100", "20240305")
    assert pv1["period"] == {"start": "2024-03-01", "end": "2024-03-05"}
    dg1 = mapped(spark, hl7, "DG1", "diagnosis_code string, diagnosis_description string, diagnosis_date_time string", None, "Gout", "20240301")
    assert dg1["code"]["text"] == "Gout" and dg1["onsetDateTime"] == "2024-03-01"
    obx = mapped(spark, hl7, "OBX", "observation_value string, units string, abnormal_flags string, date_time_of_observation string", "5.4", "mmol/L", "H", "20240301")
    assert obx["valueQuantity"] == {"value": 5.4, "unit": "mmol/L"} and obx["valueString"] == "5.4" and obx["interpretation"]["text"] == "H" and obx["effectiveDateTime"] == "2024-03-01"
    obr = mapped(spark, hl7, "OBR", "filler_order_number string, universal_service_identifier string", "F1", "58410-2")
    assert obr["identifier"][0]["value"] == "F1" and obr["code"]["coding"][0]["code"] == "58410-2"


def test_concept_and_source_code(spark):
    schema = "condition_concept_id long, condition_source_value string"
    got = mapped(spark, ("omop", "fhir"), "condition_occurrence", schema, 201826, "E11.9")
    assert [x["code"] for x in got["code"]["coding"]] == ["E11.9", "201826"] and got["identifier"]["value"] == "E11.9"
    got = mapped(spark, ("omop", "fhir"), "condition_occurrence", schema, 201826, None)
    assert [x["code"] for x in got["code"]["coding"]] == ["201826"]
    assert mapped(spark, ("omop", "fhir"), "condition_occurrence", schema, 0, None)["code"] is None
    got = mapped(spark, ("omop", "openehr"), "condition_occurrence", schema, 201826, "E11.9")["problem_diagnosis_name"]
    assert got["value"] == "E11.9" and got["defining_code"]["code_string"] == "201826"
