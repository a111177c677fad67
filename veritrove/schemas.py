"""Schemas of the tables this library reads and writes. Declared, never inferred."""

SNAK = "struct<snaktype:string,datatype:string,id:string,label:string,raw:string,unit:string,precision:int>"
QUALIFIER = f"struct<property_id:string,property_label:string,value:{SNAK}>"
STATEMENT = (
    "subject_id string, subject_label string, property_id string, property_label string, "
    f"value {SNAK}, rank string, qualifiers array<{QUALIFIER}>, direction string, source_entity_id string, statement_id string"
)
CHUNK = "text string, source_entity_id string, title string, index int, n_chunks int, revision_id bigint"
ENTITY = "label string, description string, aliases array<string>, redirect string"
MENTION = "struct<name:string,entityType:string,label:string,mention:string,span:array<int>>"
QUESTION = (
    "id string, question string, translations map<string,string>, category string, complexityType string, "
    f"questionEntity array<{MENTION}>, answer string"
)
RESULT = (
    "id string, question string, expected string, answer_value string, answer_forms array<string>, answer_entities array<string>, "
    "answer_type string, type string, complexity string, answer_qids array<string>, entity_qids array<string>, "
    "answers map<string,string>, contexts map<string,string>, context_words map<string,int>, finish_reasons map<string,string>, errors map<string,string>"
)
JUDGED = "id string, config string, outcome string, score double, status string, n_claims int, n_supported int, claims array<string>, verdicts array<boolean>, instrument_version int"
STATEMENT_CACHE = (
    f"v int, meta struct<label:string,description:string,aliases:array<string>,redirect:string>, query_succeeded map<string,boolean>, "
    f"truncated map<string,boolean>, fingerprint map<string,string>, statements array<struct<"
    f"subject_id:string,subject_label:string,property_id:string,property_label:string,value:{SNAK},rank:string,direction:string,"
    f"source_entity_id:string,statement_id:string,qualifiers:array<{QUALIFIER}>>>"
)
ARTICLE_CACHE = "v int, fingerprint map<string,string>, qid string, title string, revision_id bigint, fetch_succeeded boolean, reason string, fetched_at string, chunks array<string>"
