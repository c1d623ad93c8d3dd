"""Crossmaps between standards, one field a line: ``field|other name -> target.path = transform(json)``."""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    field: str
    target: str
    transform: str
    config: dict
    others: tuple[str, ...] = ()

    @property
    def reads(self) -> tuple[str, ...]:
        """Names of all source fields."""
        c = self.config
        named = [c[k] for k in c if k.endswith("_field")] + list(c.get("fields", [])) + list(c.get("else", [])) + ([c["source"]["field"]] if "source" in c else [])
        return (self.field, *self.others, *named)


@dataclass(frozen=True)
class Crossmap:
    source: str
    target: str
    entities: dict[str, tuple[str, list[Rule]]]


def parse(source: str, target: str, text: str) -> Crossmap:
    """``[entity -> target entity]`` heads, then rules; a missing transform passes the value through."""
    entities: dict[str, tuple[str, list[Rule]]] = {}
    rules: list[Rule] = []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        if line.startswith("["):
            name, _, to = line.strip("[]").partition(" -> ")
            rules = []
            entities[name] = (to, rules)
            continue
        field, _, rest = line.partition(" -> ")
        path, _, how = rest.partition(" = ")
        name, _, config = how.partition("(")
        field, *others = field.split("|")
        rules.append(Rule(field, path, name or "passthrough", json.loads(config[:-1]) if config else {}, tuple(others)))
    return Crossmap(source, target, entities)


_GENDER = '{"map": {"8507": "male", "8532": "female", "8551": "other", "8570": "unknown"}, "default": "unknown"}'
_SEX = '{"map": {"M": "male", "F": "female", "O": "other", "U": "unknown", "A": "other", "N": "unknown"}, "default": "unknown"}'
_CLASS = '{"map": {"I": "IMP", "O": "AMB", "E": "EMER", "P": "PRENC"}, "default": "AMB"}'
_RESULT = '{"map": {"F": "final", "P": "preliminary", "C": "corrected", "D": "cancelled", "R": "registered", "X": "cancelled"}, "default": "unknown"}'
_REPORT = '{"map": {"F": "final", "P": "preliminary", "A": "partial", "C": "corrected", "R": "registered", "X": "cancelled"}, "default": "unknown"}'
_ALLERGY = '{"map": {"DA": "medication", "FA": "food", "MA": "medication", "MC": "medication", "EA": "environment", "AA": "environment", "LA": "environment", "PA": "biologic"}, "default": "medication"}'
_SEVERITY = '{"map": {"MI": "low", "MO": "low", "SV": "high", "U": "unable-to-assess"}, "default": "unable-to-assess"}'
_RACE = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-race"
_ETHNICITY = "http://hl7.org/fhir/us/core/StructureDefinition/us-core-ethnicity"
OMOP_FHIR = f"""
[person -> Patient]
person_id -> id = str
person_source_value -> identifier.value = first({{"else": {{"person_id": []}}}})
gender_concept_id -> gender = value_map({_GENDER})
birth_datetime -> birthDate = fhir_date
race_concept_id -> extension = extensions({{"fields": {{"race_concept_id": "{_RACE}"}}}})
location_id -> address.reference = fhir_reference({{"resource_type": "Location"}})
[visit_occurrence -> Encounter]
visit_occurrence_id -> id = str
visit_source_value -> identifier.value = str
person_id -> subject = fhir_reference
visit_concept_id -> class.code = value_map({{"map": {{"9201": "IMP", "9202": "AMB", "9203": "EMER"}}, "default": "AMB"}})
visit_concept_id -> type = codeable_concept({{"system": "http://terminology.hl7.org/CodeSystem/v3-ActCode", "source": {{"field": "visit_source_value"}}}})
visit_start_date -> period = fhir_period({{"start_field": "visit_start_date", "end_field": "visit_end_date"}})
[condition_occurrence -> Condition]
condition_occurrence_id -> id = str
condition_source_value -> identifier.value = str
person_id -> subject = fhir_reference
condition_concept_id -> code = codeable_concept({{"system": "http://snomed.info/sct", "display_field": "condition_source_value", "source": {{"field": "condition_source_value", "system": "http://hl7.org/fhir/sid/icd-10-cm"}}}})
condition_start_date -> onsetDateTime = fhir_date
[drug_exposure -> MedicationRequest]
drug_exposure_id -> id = str
drug_source_value -> identifier.value = str
person_id -> subject = fhir_reference
drug_concept_id -> medicationCodeableConcept = codeable_concept({{"system": "http://www.nlm.nih.gov/research/umls/rxnorm", "display_field": "drug_source_value", "source": {{"field": "drug_source_value", "system": "http://www.nlm.nih.gov/research/umls/rxnorm"}}}})
drug_exposure_start_date -> authoredOn = fhir_date
quantity -> dispenseRequest.quantity.value = float
[measurement -> Observation]
measurement_id -> id = str
measurement_source_value -> identifier.value = str
person_id -> subject = fhir_reference
measurement_concept_id -> code = codeable_concept({{"system": "http://loinc.org", "display_field": "measurement_source_value", "source": {{"field": "measurement_source_value", "system": "http://loinc.org"}}}})
value_as_number -> valueQuantity.value = float
unit_source_value -> valueQuantity.unit = str
measurement_date -> effectiveDateTime = fhir_date
[procedure_occurrence -> Procedure]
procedure_occurrence_id -> id = str
person_id -> subject = fhir_reference
procedure_concept_id -> code = codeable_concept({{"system": "http://snomed.info/sct", "display_field": "procedure_source_value", "source": {{"field": "procedure_source_value", "system": "http://snomed.info/sct"}}}})
procedure_date -> performedDateTime = fhir_date
[observation -> Observation]
observation_id -> id = str
person_id -> subject = fhir_reference
observation_concept_id -> code = codeable_concept({{"system": "http://loinc.org", "display_field": "observation_source_value", "text_alone": true}})
observation_date -> effectiveDateTime = fhir_date
value_as_string -> valueString = str
value_as_number -> valueQuantity.value = float
[provider -> Practitioner]
provider_id -> id = str
provider_name -> name.text = str
npi -> identifier.value = str
"""
FHIR_OMOP = """
[Patient -> person]
id -> person_id = int
identifier -> person_source_value = first({"path": ["value"], "else": {"id": []}})
gender -> gender_concept_id = value_map({"map": {"male": 8507, "female": 8532, "other": 8551, "unknown": 8570}, "default": 8551})
birthDate -> birth_datetime = fhir_date
[Encounter -> visit_occurrence]
id -> visit_occurrence_id = int
subject -> person_id = extract_number
subject -> person_source_value = extract_id
class -> visit_concept_id = value_map({"path": ["code"], "map": {"IMP": 9201, "AMB": 9202, "EMER": 9203}, "default": 0})
type -> visit_source_value = first({"path": ["coding[0].code", "text"], "else": {"identifier": ["value"], "id": []}})
period -> visit_start_date = fhir_date({"path": ["start"]})
period -> visit_end_date = fhir_date({"path": ["end"], "plain": false})
[Condition -> condition_occurrence]
id -> condition_occurrence_id = int
subject -> person_id = extract_number
subject -> person_source_value = extract_id
code -> condition_source_value = passthrough({"path": ["coding[0].code", "text"]})
onsetDateTime -> condition_start_date = fhir_date
[MedicationRequest -> drug_exposure]
id -> drug_exposure_id = int
subject -> person_id = extract_number
subject -> person_source_value = extract_id
medicationCodeableConcept -> drug_source_value = passthrough({"path": ["coding[0].code", "text"]})
authoredOn -> drug_exposure_start_date = fhir_date
dispenseRequest -> quantity = float({"path": ["quantity.value"], "plain": false})
[Observation -> measurement]
id -> measurement_id = int
subject -> person_id = extract_number
subject -> person_source_value = extract_id
code -> measurement_source_value = first({"path": ["coding[0].code", "text"], "else": {"valueString": []}})
valueQuantity -> value_as_number = float({"path": ["value"]})
valueQuantity -> unit_source_value = passthrough({"path": ["unit", "code"], "plain": false})
valueString -> value_source_value = first
effectiveDateTime -> measurement_date = fhir_date
[Procedure -> procedure_occurrence]
id -> procedure_occurrence_id = int
subject -> person_id = extract_number
subject -> person_source_value = extract_id
code -> procedure_source_value = passthrough({"path": ["coding[0].code", "text"]})
performedDateTime -> procedure_date = fhir_date
[AllergyIntolerance -> observation]
id -> observation_id = int
patient -> person_id = extract_number
patient -> person_source_value = extract_id
code -> observation_source_value = passthrough({"path": ["coding[0].code", "text"]})
code -> value_as_string = passthrough({"path": ["text", "coding[0].display"], "plain": false})
onsetDateTime|recordedDate -> observation_date = fhir_date
[DiagnosticReport -> measurement]
id -> measurement_id = int
subject -> person_id = extract_number
subject -> person_source_value = extract_id
code -> measurement_source_value = passthrough({"path": ["coding[0].code", "text"]})
effectiveDateTime|issued -> measurement_date = fhir_date
conclusion -> value_source_value = passthrough
[Practitioner -> provider]
id -> provider_source_value = str
name -> provider_name = extract_name
[Organization -> care_site]
id -> care_site_source_value = str
name -> care_site_name = str
"""
HL7_FHIR = f"""
[PID -> Patient]
patient_id|patient_identifier_list -> id = hl7v2_field
patient_id|patient_identifier_list -> identifier = identifiers({{"fields": {{"patient_id": "MR", "ssn": "SS", "patient_account_number": "AN"}}}})
patient_name -> name.family = split({{"separator": "^", "index": 0}})
patient_name -> name.given = split({{"separator": "^", "index": 1}})
patient_name -> name.text = str
date_of_birth -> birthDate = hl7v2_date
administrative_sex -> gender = value_map({_SEX})
race -> extension = extensions({{"fields": {{"race": "{_RACE}", "ethnic_group": "{_ETHNICITY}"}}}})
patient_address -> address = str
phone_home -> telecom = str
marital_status -> maritalStatus = codeable_concept({{"system": "http://terminology.hl7.org/CodeSystem/v3-MaritalStatus"}})
patient_death_date|death_date -> deceasedDateTime = hl7v2_date
patient_death_indicator -> deceasedBoolean = bool
[PV1 -> Encounter]
visit_number -> id = hl7v2_field
visit_number -> identifier.value = str
patient_class -> class.code = value_map({_CLASS})
admission_type -> type = codeable_concept({{"system": "http://terminology.hl7.org/CodeSystem/v3-ActCode"}})
admit_date_time|admit_date -> period.start = hl7v2_date
discharge_date_time|discharge_date -> period.end = hl7v2_date
attending_doctor -> participant = str
hospital_service -> serviceType = codeable_concept({{"system": "http://terminology.hl7.org/CodeSystem/service-type"}})
discharge_disposition -> hospitalization = str
[DG1 -> Condition]
diagnosis_code -> code = codeable_concept({{"system": "http://hl7.org/fhir/sid/icd-10-cm", "display_field": "diagnosis_description", "text_alone": true}})
diagnosis_date_time|diagnosis_date -> onsetDateTime = hl7v2_date
diagnosis_type -> category = codeable_concept({{"system": "http://terminology.hl7.org/CodeSystem/condition-category"}})
[OBX -> Observation]
observation_identifier -> code = codeable_concept({{"system": "http://loinc.org"}})
observation_value -> valueString = str
observation_value -> valueQuantity.value = float
units -> valueQuantity.unit = str
reference_range -> referenceRange = str
abnormal_flags -> interpretation = codeable_concept({{"system": "http://terminology.hl7.org/CodeSystem/v3-ObservationInterpretation"}})
date_time_of_observation|observation_date -> effectiveDateTime = hl7v2_date
observation_result_status|result_status -> status = value_map({_RESULT})
[OBR -> DiagnosticReport]
placer_order_number -> identifier = identifiers({{"fields": {{"placer_order_number": "PLAC", "filler_order_number": "FILL"}}}})
universal_service_identifier|universal_service_id -> code = codeable_concept({{"system": "http://loinc.org"}})
observation_date_time|observation_date -> effectiveDateTime = hl7v2_date
result_status|results_status -> status = value_map({_REPORT})
ordering_provider -> performer = str
[RXE -> MedicationRequest]
give_code -> medicationCodeableConcept = codeable_concept({{"system": "http://www.nlm.nih.gov/research/umls/rxnorm"}})
give_amount_minimum -> dosageInstruction.doseQuantity.value = float
give_units -> dosageInstruction.doseQuantity.unit = str
give_route -> dosageInstruction.route.text = str
prescription_number -> identifier.value = str
[AL1 -> AllergyIntolerance]
allergen_code -> code = codeable_concept({{"system": "http://snomed.info/sct"}})
allergy_type|allergen_type -> category = value_map({_ALLERGY})
allergy_severity -> criticality = value_map({_SEVERITY})
allergy_reaction -> reaction = str
identification_date -> recordedDate = hl7v2_date
"""
OMOP_OPENEHR = """
[person -> demographics.person]
person_id -> uid = str
person_source_value -> name = str
birth_datetime -> date_of_birth = fhir_date
gender_concept_id -> sex = dv_coded_text({"display_field": "gender_source_value", "map": {"8507": "Male", "8532": "Female", "8551": "Indeterminate", "8570": "Not known"}, "default": "Not known"})
[visit_occurrence -> composition.encounter]
visit_occurrence_id -> uid = str
visit_start_date -> context_start_time = fhir_date
visit_end_date -> context_end_time = fhir_date
visit_source_value -> context_setting = str
care_site_id -> context_health_care_facility = str
[condition_occurrence -> evaluation.problem_diagnosis]
condition_concept_id -> problem_diagnosis_name = dv_coded_text({"terminology": "SNOMED-CT", "display_field": "condition_source_value", "else_field": "condition_source_value"})
condition_start_date -> date_time_of_onset = fhir_date
[drug_exposure -> instruction.medication_order]
drug_source_value -> medication_item = dv_coded_text({"terminology": "RxNorm"})
drug_exposure_start_date -> order_start_date = fhir_date
drug_exposure_end_date -> order_end_date = fhir_date
quantity -> dose_amount = dv_quantity({"unit": "dose"})
sig -> frequency = str
route_concept_id -> route = str
drug_concept_id -> clinical_indication = str
[measurement -> observation.laboratory_test_result]
measurement_source_value -> test_name = dv_coded_text({"terminology": "LOINC"})
measurement_date -> test_timestamp = fhir_date
value_as_number -> result_value = dv_quantity({"unit_field": "unit_source_value"})
unit_source_value -> result_unit = str
range_low -> reference_range_lower = float
range_high -> reference_range_upper = float
[procedure_occurrence -> action.procedure]
procedure_source_value -> procedure_name = dv_coded_text({"terminology": "SNOMED-CT"})
procedure_date -> datetime_procedure_performed = fhir_date
"""
FHIR_OPENEHR = """
[Patient -> demographics.person]
id -> uid = str
name -> name = extract_name
birthDate -> date_of_birth = fhir_date
gender -> sex = dv_coded_text({"terminology": "local", "map": {"male": "Male", "female": "Female", "other": "Indeterminate", "unknown": "Not known"}, "default": "Not known"})
address -> address = extract_text({"parts": ["text"]})
telecom -> telecom = extract_text({"parts": ["value"]})
[Encounter -> composition.encounter]
id -> uid = str
period -> context_start_time = fhir_date({"path": ["start"]})
period -> context_end_time = fhir_date({"path": ["end"], "plain": false})
class -> context_setting = dv_coded_text({"path": ["code"], "map": {"AMB": "ambulatory", "EMER": "emergency", "IMP": "inpatient", "PRENC": "pre-admission", "SS": "short stay", "HH": "home health", "VR": "virtual"}, "default": "other"})
serviceProvider -> context_health_care_facility = extract_text({"parts": ["display", "reference"]})
[Condition -> evaluation.problem_diagnosis]
code -> problem_diagnosis_name = extract_coded_text({"terminology": "SNOMED-CT"})
onsetDateTime -> date_time_of_onset = fhir_date
abatementDateTime -> resolution_date = fhir_date
clinicalStatus -> status = extract_coded_text
verificationStatus -> diagnostic_certainty = dv_coded_text({"path": ["coding[0].code", "text"], "map": {"confirmed": "Confirmed", "unconfirmed": "Suspected", "provisional": "Probable", "differential": "Suspected", "refuted": "Ruled out"}, "default": "Suspected"})
[MedicationRequest -> instruction.medication_order]
medicationCodeableConcept -> medication_item = extract_coded_text({"terminology": "RxNorm"})
authoredOn -> order_start_date = fhir_date
dosageInstruction -> dose_amount = extract_text({"parts": ["text"]})
status -> clinical_indication = str
[Observation -> observation.laboratory_test_result]
code -> test_name = extract_coded_text({"terminology": "LOINC"})
effectiveDateTime -> test_timestamp = fhir_date
valueQuantity -> result_value = extract_quantity
valueString -> result_text = first
status -> overall_test_status = dv_coded_text({"map": {"final": "Final", "preliminary": "Interim", "registered": "Registered", "corrected": "Amended", "cancelled": "Cancelled"}, "default": "Interim"})
[Procedure -> action.procedure]
code -> procedure_name = extract_coded_text({"terminology": "SNOMED-CT"})
performedDateTime -> datetime_procedure_performed = fhir_date
"""
BUILT_IN = {
    ("omop", "fhir"): OMOP_FHIR,
    ("fhir", "omop"): FHIR_OMOP,
    ("hl7v2", "fhir"): HL7_FHIR,
    ("omop", "openehr"): OMOP_OPENEHR,
    ("fhir", "openehr"): FHIR_OPENEHR,
}


def load(source: str, target: str, path: str | None = None) -> Crossmap:
    """A crossmap from a file in the same notation, else the built-in one; an empty one where there is none."""
    short = lambda s: s.split("_")[0]
    if path:
        with open(path) as f:
            return parse(source, target, f.read())
    return parse(source, target, BUILT_IN.get((short(source), short(target)), ""))
