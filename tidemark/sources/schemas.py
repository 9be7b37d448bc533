"""Schemas as DDL; every reader states its columns, so that no file is read to infer them."""

SEGMENT = "segment_id INT, start_date STRING, end_date STRING, type_distribution MAP<STRING,BIGINT>"
CHUNK = "id STRING, title STRING, contents STRING, text STRING, segment_id INT, entities ARRAY<STRING>, extracted_date STRING"
RETRIEVED = "ARRAY<STRUCT<id: STRING, content: STRING, metadata: MAP<STRING,STRING>, score: DOUBLE>>"
TEMPLATE = "id STRING, template STRING, question_topic STRING, description STRING, placeholders ARRAY<STRING>, topic STRING"
PERSONA = "player_description STRING, source_content STRING, source_topic STRING"
QA = f"question STRING, answer STRING, references ARRAY<STRING>, time STRING, template STRING, question_topic STRING, task_type STRING, retrieved_docs {RETRIEVED}, entities ARRAY<STRING>, segment_id INT, game_name STRING, inherited_from INT, inheritance_status STRING"
QA_CSV = "game_name STRING, question STRING, answer STRING, question_topic STRING, task_type STRING, time STRING, references STRING, retrieved_docs STRING, entities STRING"
RETRIEVAL = f"question STRING, game_name STRING, retrieved_docs {RETRIEVED}, retrieved_doc_ids ARRAY<STRING>, retrieval_time DOUBLE, timestamp STRING, question_index INT, ground_truth_answer STRING, ground_truth_doc_ids ARRAY<STRING>, error STRING"
GENERATION = f"question STRING, answer STRING, rag_answer STRING, contexts ARRAY<STRING>, generation_time DOUBLE, retrieved_docs {RETRIEVED}, retrieved_doc_ids ARRAY<STRING>, retrieval_time DOUBLE, ground_truth_answer STRING, ground_truth_doc_ids ARRAY<STRING>, game_name STRING, question_index INT, error STRING"
METRICS = "STRUCT<topk: STRING, recall: STRING, f1: STRING, ndcg: STRING, correctness: STRING, faithfulness: STRING>"
SUBMISSION = f"system_name STRING, description STRING, games MAP<STRING,{METRICS}>, average {METRICS}"
TAXONOMY = "MAP<STRING,STRUCT<code: STRING, description: STRING, subcategories: MAP<STRING,STRUCT<code: STRING, description: STRING, keywords: ARRAY<STRING>, examples: ARRAY<STRING>>>>>"
PROGRESS = "processed_template_ids ARRAY<STRING>, attempt_count INT, max_attempts INT, generated_count INT, last_updated STRING"
EMPTY_LIST = "ARRAY<STRING>"
