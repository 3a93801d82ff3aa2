"""Schemas of the raw entities and artifacts, as DDL."""

DOCUMENT = "post_id string, text string, subreddit string, created_utc string"
PASSAGE = "post_id string, sent_id string, text string, char_span array<int>"
TOPIC = "cid string, name string, is_core boolean, desc string"
LABEL_SC = "post_id string, sent_id string, cid string, label int, rationale string"
LABEL_PC = "post_id string, cid string, label int"
RETRIEVAL = "post_id string, cid string, candidates array<string>"
SCORE_SC = "post_id string, cid string, sent_id string, logit double, prob double"
SCORE_PC = "post_id string, cid string, chunk_id string, logit double, prob double"
SCORE_PC_AGG = "post_id string, cid string, agg string, logit double, prob double"
OOF_SC = "post_id string, sent_id string, cid string, label int, logit double, prob_uncal double, prob_cal double, prob double, text string"
OOF_PC = "post_id string, cid string, label int, logit double, prob_uncal double, prob_cal double, prob double, fold int"
ANNOTATION = "post_id string, sentence_id string, sentence_text string, DSM5_symptom string, status int, explanation string"
SPAN = "post_id string, post string, evidence_sentence_id int, evidence_sentence string, criterion string, start_idx int, end_idx int"
COOCCURRENCE = "cid1 string, cid2 string, pmi double, cofreq int"

#: Rules a typed scan enforces: column, SQL condition that must hold.
CHECKS = {
    "label": "label IN (0, 1)",
    "prob": "prob BETWEEN 0 AND 1",
    "char_span": "char_span IS NULL OR (size(char_span) = 2 AND 0 <= char_span[0] AND char_span[0] <= char_span[1])",
    "candidates": "size(array_distinct(transform(candidates, x -> coalesce(get_json_object(x, '$.sent_id'), get_json_object(x, '$[0]'))))) = size(candidates)",
}
