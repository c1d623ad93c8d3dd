"""Built-in definitions, written from the public specifications: entity: field type[!][*][->key], ...

Fixed values: names and types of the standards' own fields (! required, * coded, -> foreign key).
"""

OMOP = """
person: person_id integer!, gender_concept_id integer!*->concept.concept_id, year_of_birth integer!, month_of_birth integer, day_of_birth integer, birth_datetime datetime, race_concept_id integer!*->concept.concept_id, ethnicity_concept_id integer!*->concept.concept_id, location_id integer->location.location_id, provider_id integer->provider.provider_id, care_site_id integer->care_site.care_site_id, person_source_value string, gender_source_value string, race_source_value string, ethnicity_source_value string
location: location_id integer!, address_1 string, address_2 string, city string, state string, zip string, county string, location_source_value string, country_concept_id integer*, country_source_value string
visit_occurrence: visit_occurrence_id integer!, person_id integer!->person.person_id, visit_concept_id integer!*->concept.concept_id, visit_start_date date!, visit_start_datetime datetime, visit_end_date date!, visit_end_datetime datetime, visit_type_concept_id integer!*, provider_id integer->provider.provider_id, care_site_id integer->care_site.care_site_id, visit_source_value string
condition_occurrence: condition_occurrence_id integer!, person_id integer!->person.person_id, condition_concept_id integer!*->concept.concept_id, condition_start_date date!, condition_start_datetime datetime, condition_end_date date, condition_type_concept_id integer!*, visit_occurrence_id integer->visit_occurrence.visit_occurrence_id, condition_source_value string, condition_source_concept_id integer*
drug_exposure: drug_exposure_id integer!, person_id integer!->person.person_id, drug_concept_id integer!*->concept.concept_id, drug_exposure_start_date date!, drug_exposure_end_date date!, drug_type_concept_id integer!*, refills integer, quantity float, days_supply integer, sig string, route_concept_id integer*, provider_id integer->provider.provider_id, drug_source_value string, dose_unit_source_value string
measurement: measurement_id integer!, person_id integer!->person.person_id, measurement_concept_id integer!*->concept.concept_id, measurement_date date!, measurement_datetime datetime, measurement_type_concept_id integer!*, operator_concept_id integer*, value_as_number float, value_as_concept_id integer*, unit_concept_id integer*, range_low float, range_high float, measurement_source_value string, unit_source_value string
procedure_occurrence: procedure_occurrence_id integer!, person_id integer!->person.person_id, procedure_concept_id integer!*->concept.concept_id, procedure_date date!, procedure_type_concept_id integer!*, quantity integer, procedure_source_value string
observation: observation_id integer!, person_id integer!->person.person_id, observation_concept_id integer!*->concept.concept_id, observation_date date!, observation_type_concept_id integer!*, value_as_number float, value_as_string string, value_as_concept_id integer*, unit_concept_id integer*, observation_source_value string
provider: provider_id integer!, provider_name string, npi string, specialty_concept_id integer*, care_site_id integer->care_site.care_site_id, year_of_birth integer, gender_concept_id integer*, provider_source_value string, dea string, specialty_source_value string, gender_source_value string
care_site: care_site_id integer!, care_site_name string, place_of_service_concept_id integer*, location_id integer->location.location_id, care_site_source_value string, place_of_service_source_value string
death: person_id integer!->person.person_id, death_date date!, death_datetime datetime, death_type_concept_id integer*, cause_concept_id integer*, cause_source_value string, cause_source_concept_id integer*
observation_period: observation_period_id integer!, person_id integer!->person.person_id, observation_period_start_date date!, observation_period_end_date date!, period_type_concept_id integer!*
device_exposure: device_exposure_id integer!, person_id integer!->person.person_id, device_concept_id integer!*->concept.concept_id, device_exposure_start_date date!, device_exposure_end_date date, device_type_concept_id integer!*, unique_device_id string, quantity integer, device_source_value string, provider_id integer->provider.provider_id, visit_occurrence_id integer->visit_occurrence.visit_occurrence_id, device_source_concept_id integer*
note: note_id integer!, person_id integer!->person.person_id, note_date date!, note_type_concept_id integer!*, note_title string, note_text text!, encoding_concept_id integer*, language_concept_id integer*, note_source_value string, note_datetime datetime, note_class_concept_id integer!*, provider_id integer->provider.provider_id, visit_occurrence_id integer->visit_occurrence.visit_occurrence_id
concept: concept_id integer!, concept_name string!, domain_id string!, vocabulary_id string!, concept_class_id string!, standard_concept string, concept_code string!, valid_start_date date!, valid_end_date date!, invalid_reason string
vocabulary: vocabulary_id string!, vocabulary_name string!, vocabulary_reference string, vocabulary_version string, vocabulary_concept_id integer!
concept_relationship: concept_id_1 integer!->concept.concept_id, concept_id_2 integer!->concept.concept_id, relationship_id string!, valid_start_date date!, valid_end_date date!, invalid_reason string
domain: domain_id string!, domain_name string!, domain_concept_id integer!
concept_class: concept_class_id string!, concept_class_name string!, concept_class_concept_id integer!
"""
FHIR = """
Patient: id string!, identifier string, active boolean, name string, telecom string, gender code, birthDate date, deceasedDateTime dateTime, address string, maritalStatus CodeableConcept, managingOrganization Reference, contact string
Encounter: id string!, identifier string, status code!, class code!, type CodeableConcept, subject Reference, participant string, period Period, reasonCode CodeableConcept, serviceProvider Reference
Condition: id string!, identifier string, clinicalStatus CodeableConcept, verificationStatus CodeableConcept, category CodeableConcept, code CodeableConcept, subject Reference!, encounter Reference, onsetDateTime dateTime, recordedDate dateTime
Observation: id string!, identifier string, status code!, category CodeableConcept, code CodeableConcept!, subject Reference, encounter Reference, effectiveDateTime dateTime, issued instant, valueQuantity string, valueCodeableConcept CodeableConcept, interpretation CodeableConcept, valueString string
MedicationRequest: id string!, identifier string, status code!, intent code!, medicationCodeableConcept CodeableConcept!, subject Reference!, encounter Reference, authoredOn dateTime, requester Reference, dosageInstruction string
Procedure: id string!, identifier string, status code!, code CodeableConcept, subject Reference!, encounter Reference, performedDateTime dateTime
AllergyIntolerance: id string!, identifier string, clinicalStatus CodeableConcept, type code, category code, criticality code, code CodeableConcept, patient Reference!, onsetDateTime dateTime, verificationStatus CodeableConcept, recordedDate dateTime
DiagnosticReport: id string!, identifier string, status code!, category CodeableConcept, code CodeableConcept!, subject Reference, effectiveDateTime dateTime, issued instant, result Reference, conclusion string
Practitioner: id string!, identifier string, active boolean, name string, telecom string, gender code, birthDate date, qualification string, address string, communication CodeableConcept
Organization: id string!, identifier string, active boolean, type CodeableConcept, name string, telecom string, address string, partOf Reference, alias string
Location: id string!, identifier string, status code, name string, type CodeableConcept, address string, managingOrganization Reference, description string, mode code, telecom string, physicalType CodeableConcept
Specimen: id string!, identifier string, status code, type CodeableConcept, subject Reference, receivedTime dateTime, collection string, accessionIdentifier string, container string
Immunization: id string!, identifier string, status code!, vaccineCode CodeableConcept!, patient Reference!, occurrenceDateTime dateTime!, lotNumber string, encounter Reference, recorded dateTime, primarySource boolean, expirationDate date, site CodeableConcept, route CodeableConcept
ServiceRequest: id string!, identifier string, status code!, intent code!, code CodeableConcept, subject Reference!, authoredOn dateTime, requester Reference, category CodeableConcept, priority code, encounter Reference, occurrenceDateTime dateTime
MedicationAdministration: id string!, identifier string, status code!, medicationCodeableConcept CodeableConcept!, subject Reference!, effectiveDateTime dateTime!, dosage string, statusReason CodeableConcept, context Reference, performer string
MedicationDispense: id string!, identifier string, status code!, medicationCodeableConcept CodeableConcept!, subject Reference, quantity string, whenHandedOver dateTime, context Reference, performer string, daysSupply string, whenPrepared dateTime
Bundle: id string!, identifier string, type code!, timestamp instant, total integer, entry string, meta string, link string, signature string
DocumentReference: id string!, identifier string, status code!, type CodeableConcept, subject Reference, date instant, content string!, masterIdentifier string, docStatus code, category CodeableConcept, author Reference, description string
"""
HL7 = """
PID: set_id ST, patient_id CX!, patient_name XPN!, date_of_birth TS, administrative_sex IS, race CE, patient_address XAD, phone_home XTN, marital_status CE, patient_account_number CX, patient_death_date TS, phone_business XTN, primary_language CE, ssn ST, ethnic_group CE, birth_place ST, patient_death_indicator ID
PV1: set_id ST, patient_class IS!, assigned_location PL, admission_type IS, attending_doctor XCN, hospital_service IS, visit_number CX, discharge_disposition IS, admit_date_time TS, discharge_date_time TS, referring_doctor XCN
DG1: set_id ST!, diagnosis_coding_method ID, diagnosis_code CE, diagnosis_description ST, diagnosis_date_time TS, diagnosis_type IS!, diagnosis_priority ID
OBX: set_id ST, value_type ID, observation_identifier CE!, observation_sub_id ST, observation_value ST, units CE, reference_range ST, abnormal_flags IS, observation_result_status ID!, date_time_of_observation TS
OBR: set_id ST, placer_order_number EI, filler_order_number EI, universal_service_identifier CE!, observation_date_time TS, specimen_received_date_time TS, ordering_provider XCN, result_status ID
RXE: give_code CE!, give_amount_minimum NM!, give_amount_maximum NM, give_units CE!, give_dosage_form CE, dispense_amount NM, prescription_number ST, quantity_timing TQ, give_route CE, dispense_units CE
AL1: set_id ST!, allergy_type CE, allergen_code CE!, allergy_severity CE, allergy_reaction ST, identification_date DT
NK1: set_id ST!, nk1_name XPN, relationship CE, nk1_address XAD, nk1_phone XTN, contact_role CE
"""
OPENEHR = """
demographics.person: uid string!, name DV_TEXT, date_of_birth DV_DATE, sex DV_CODED_TEXT, ethnicity DV_CODED_TEXT, address DV_TEXT, telecom DV_TEXT
composition.encounter: uid string!, context_start_time DV_DATE_TIME!, context_end_time DV_DATE_TIME, context_setting DV_CODED_TEXT, context_health_care_facility PARTY_IDENTIFIED, subject PARTY_IDENTIFIED, composer PARTY_IDENTIFIED!
evaluation.problem_diagnosis: problem_diagnosis_name DV_CODED_TEXT!, date_time_of_onset DV_DATE_TIME, resolution_date DV_DATE_TIME, severity DV_CODED_TEXT, status DV_CODED_TEXT, comment DV_TEXT, subject PARTY_IDENTIFIED, clinical_description DV_TEXT, body_site DV_CODED_TEXT, date_time_clinically_recognised DV_DATE_TIME, diagnostic_certainty DV_CODED_TEXT
instruction.medication_order: medication_item DV_CODED_TEXT!, dose_amount DV_QUANTITY, route DV_CODED_TEXT, order_start_date DV_DATE_TIME, order_end_date DV_DATE_TIME, comment DV_TEXT, subject PARTY_IDENTIFIED, dose_unit DV_TEXT, frequency DV_TEXT, clinical_indication DV_TEXT
observation.laboratory_test_result: test_name DV_CODED_TEXT!, result_value DV_QUANTITY, result_text DV_TEXT, result_status DV_CODED_TEXT, reference_range DV_TEXT, test_timestamp DV_DATE_TIME, subject PARTY_IDENTIFIED, overall_test_status DV_CODED_TEXT, specimen_type DV_CODED_TEXT, result_unit DV_TEXT, reference_range_lower DV_QUANTITY, reference_range_upper DV_QUANTITY
observation.blood_pressure: systolic DV_QUANTITY, diastolic DV_QUANTITY, position DV_CODED_TEXT, timestamp DV_DATE_TIME, subject PARTY_IDENTIFIED, mean_arterial_pressure DV_QUANTITY
action.procedure: procedure_name DV_CODED_TEXT!, datetime_procedure_performed DV_DATE_TIME, body_site DV_CODED_TEXT, outcome DV_TEXT, subject PARTY_IDENTIFIED, procedure_description DV_TEXT, procedure_type DV_TEXT
"""
STANDARDS = {
    "omop_cdm_v5.4": ("relational", "observation.observation_source_value", OMOP),
    "fhir_r4": ("resource", "Patient.identifier", FHIR),
    "hl7v2_2.5.1": ("segment", "OBX.observation_value", HL7),
    "openehr_1.0.4": ("archetype", "observation.laboratory_test_result.result_value", OPENEHR),
}
