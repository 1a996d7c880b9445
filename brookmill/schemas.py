"""Schemas of messages, drafts and what is derived from them."""

RECORD = "struct<record_type:string,job_title:string,job_description:string,company:string,required_skills:array<string>,preferred_skills:array<string>,years_of_experience:int,location:string,work_authorization:string,employment_type:string,rate_or_salary:string,parse_confidence:double,requires_review:boolean,warnings:array<string>>"
PARSING = f"struct<document_kind:string,confidence:double,requires_review:boolean,warnings:array<string>,records:array<{RECORD}>>"
CONTACT = "map<string,struct<value:string,raw:string,confidence:double,method:string,source:string>>"

MESSAGES = "channel string, source_message_id string, sender struct<email:string,sender_name:string>, content_type string, text string, received_at timestamp, metadata map<string,string>"
DRAFTS = f"draft_id string, draft_type string, status string, source string, channel string, source_message_id string, title string, confidence double, requires_review boolean, created_at timestamp, updated_at timestamp, errors array<string>, parsing {PARSING}, contact {CONTACT}"
FIELD_PROVENANCE = "parse_run_id string, field_path string, raw_value string, normalized_value string, source_region string, extractor string, extraction_method string, confidence double, value_kind string, recorded_at timestamp"
INTAKE_LOG = "duplicate_key string, channel string, source_message_id string, status string, detail string, recorded_at timestamp"
DICTIONARY = "canonical string, alias string, kind string, category string, family string"
OBSERVATIONS = "draft_id string, company_id string, company_label string, contact_email string, confidence double, method string, channel string, observed_at timestamp, jobs array<struct<key:string,title:string,location:string,named_client:string>>"
