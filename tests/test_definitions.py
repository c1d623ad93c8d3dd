"""Definitions against the fields of the reference's definitions, by entity."""

import pytest

from wardloom import standards
from wardloom.standards import crossmaps

REFERENCE = {
    "omop": """
person: person_id gender_concept_id year_of_birth month_of_birth day_of_birth birth_datetime race_concept_id ethnicity_concept_id person_source_value
location: location_id address_1 address_2 city state zip county country_source_value location_source_value
visit_occurrence: visit_occurrence_id person_id visit_concept_id visit_start_date visit_end_date visit_type_concept_id care_site_id provider_id visit_source_value
condition_occurrence: condition_occurrence_id person_id condition_concept_id condition_start_date condition_end_date condition_type_concept_id condition_source_value
drug_exposure: drug_exposure_id person_id drug_concept_id drug_exposure_start_date drug_exposure_end_date drug_type_concept_id quantity sig drug_source_value route_concept_id provider_id
measurement: measurement_id person_id measurement_concept_id measurement_date value_as_number value_as_concept_id unit_concept_id measurement_source_value unit_source_value range_low range_high
procedure_occurrence: procedure_occurrence_id person_id procedure_concept_id procedure_date procedure_type_concept_id procedure_source_value
observation: observation_id person_id observation_concept_id observation_date value_as_number value_as_string value_as_concept_id observation_source_value
provider: provider_id provider_name npi dea specialty_concept_id care_site_id year_of_birth gender_concept_id provider_source_value specialty_source_value gender_source_value
care_site: care_site_id care_site_name place_of_service_concept_id location_id care_site_source_value place_of_service_source_value
death: person_id death_date death_datetime death_type_concept_id cause_concept_id cause_source_value cause_source_concept_id
observation_period: observation_period_id person_id observation_period_start_date observation_period_end_date period_type_concept_id
device_exposure: device_exposure_id person_id device_concept_id device_exposure_start_date device_exposure_end_date device_type_concept_id unique_device_id quantity provider_id visit_occurrence_id device_source_value device_source_concept_id
note: note_id person_id note_date note_datetime note_type_concept_id note_class_concept_id note_title note_text encoding_concept_id language_concept_id provider_id visit_occurrence_id note_source_value
concept: concept_id concept_name domain_id vocabulary_id concept_class_id standard_concept concept_code valid_start_date valid_end_date invalid_reason
vocabulary: vocabulary_id vocabulary_name vocabulary_reference vocabulary_version vocabulary_concept_id
concept_relationship: concept_id_1 concept_id_2 relationship_id valid_start_date valid_end_date invalid_reason
domain: domain_id domain_name domain_concept_id
concept_class: concept_class_id concept_class_name concept_class_concept_id
""",
    "fhir": """
Patient: id identifier active name telecom gender birthDate address maritalStatus contact
Encounter: id identifier status class type subject period serviceProvider
Condition: id identifier clinicalStatus verificationStatus code subject onsetDateTime recordedDate
Observation: id identifier status category code subject effectiveDateTime valueQuantity valueCodeableConcept valueString
MedicationRequest: id identifier status intent medicationCodeableConcept subject authoredOn dosageInstruction
Procedure: id identifier status code subject performedDateTime
AllergyIntolerance: id identifier clinicalStatus verificationStatus code patient recordedDate
DiagnosticReport: id identifier status category code subject effectiveDateTime result
Practitioner: id identifier active name telecom address gender birthDate qualification communication
Organization: id identifier active type name alias telecom address partOf
Location: id identifier status name description mode type telecom address physicalType managingOrganization
Specimen: id identifier accessionIdentifier status type subject receivedTime collection container
Immunization: id identifier status vaccineCode patient encounter occurrenceDateTime recorded primarySource lotNumber expirationDate site route
ServiceRequest: id identifier status intent category priority code subject encounter occurrenceDateTime authoredOn requester
MedicationAdministration: id identifier status statusReason medicationCodeableConcept subject context effectiveDateTime performer dosage
MedicationDispense: id identifier status medicationCodeableConcept subject context performer quantity daysSupply whenPrepared whenHandedOver
Bundle: id meta identifier type timestamp total link entry signature
DocumentReference: id identifier masterIdentifier status docStatus type category subject date author description content
""",
    "hl7v2": """
PID: patient_id patient_name date_of_birth administrative_sex race patient_address phone_home phone_business primary_language marital_status ssn ethnic_group birth_place patient_death_date patient_death_indicator
PV1: patient_class assigned_location admission_type attending_doctor referring_doctor hospital_service admit_date_time discharge_date_time visit_number discharge_disposition
DG1: diagnosis_coding_method diagnosis_code diagnosis_description diagnosis_date_time diagnosis_type diagnosis_priority
OBX: value_type observation_identifier observation_sub_id observation_value units reference_range abnormal_flags observation_result_status date_time_of_observation
OBR: placer_order_number filler_order_number universal_service_identifier observation_date_time specimen_received_date_time ordering_provider result_status
RXE: quantity_timing give_code give_amount_minimum give_amount_maximum give_units give_dosage_form give_route dispense_amount dispense_units prescription_number
AL1: allergy_type allergen_code allergy_severity allergy_reaction identification_date
NK1: nk1_name relationship nk1_address nk1_phone
""",
    "openehr": """
demographics.person: uid name date_of_birth sex address telecom ethnicity
composition.encounter: uid context_start_time context_end_time context_setting context_health_care_facility composer
evaluation.problem_diagnosis: problem_diagnosis_name clinical_description body_site date_time_of_onset date_time_clinically_recognised severity diagnostic_certainty resolution_date
instruction.medication_order: medication_item dose_amount dose_unit route frequency order_start_date order_end_date clinical_indication
observation.laboratory_test_result: test_name overall_test_status test_timestamp specimen_type result_value result_unit reference_range_lower reference_range_upper result_status
observation.blood_pressure: systolic diastolic mean_arterial_pressure timestamp
action.procedure: procedure_name procedure_description procedure_type body_site datetime_procedure_performed
""",
}


@pytest.mark.parametrize("name, count", list(zip(REFERENCE, (151, 171, 66, 47))))
def test_every_field_is_defined(name, count):
    wanted = [(e, f) for e, _, fs in (x.partition(": ") for x in REFERENCE[name].split("\n") if x) for f in fs.split()]
    own = {(e, f.name) for e, fs in standards.load(name).entities.items() for f in fs}
    assert len(wanted) == count and not set(wanted) - own


@pytest.mark.parametrize("source", ["omop", "fhir"])
def test_crossmaps_write_defined_archetype_fields(source):
    target = standards.load("openehr")
    for entity, rules in crossmaps.load(source, "openehr").entities.values():
        assert {r.target.split(".")[0] for r in rules} <= {f.name for f in target.entity(entity)}
