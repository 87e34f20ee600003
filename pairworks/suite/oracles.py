"""What the queries must give, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from string import Formatter

from pairworks.functions import fixed_values as fixed
from pairworks.suite.fixtures import REGEX_RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    return f"trim({expr}, {_text(fixed.PYTHON_WHITESPACE)})"


def _trim(expr: str) -> str:
    return f"trim({expr}, {_text(fixed.JS_WHITESPACE)})"


def _collapse(expr: str) -> str:
    return f"regexp_replace({_trim(expr)}, {_text('[' + fixed.JS_WHITESPACE + ']+')}, ' ', 'g')"


def _fill(template: str, **values: str) -> str:
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(_text(literal))
        if field is not None:
            parts.append(values[field])
    return "(" + " || ".join(parts) + ")"


NL = "chr(10)"
PAIRS = "SELECT doc_id AS sample_id, source AS dataset, lang AS input, text AS target FROM documents"
GAPPY = f"""SELECT sample_id, input AS dataset,
    CASE WHEN dataset = 'src3' THEN ' ' || {NL} ELSE input END AS input,
    CASE WHEN dataset = 'src5' THEN NULL ELSE target END AS target FROM ({PAIRS})"""
FULL = f"coalesce({_strip('input')} <> '' AND {_strip('target')} <> '', false)"
CHAT = f"""SELECT conv_id, turn, 'User: ' || before || ' ' || {NL} AS input, text AS target FROM (
    SELECT *, lag(role) OVER w AS asker, lag(text) OVER w AS before FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND asker = 'user'"""


def _first(source: str, keys: str, order: str = "sample_id") -> str:
    return f"SELECT * FROM ({source}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


def _split(source: str, keys: str) -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT * EXCLUDE (place, n, quota),
        CASE WHEN place <= (CASE WHEN quota >= n THEN 0 ELSE quota END) THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, greatest(1, floor(n * CAST(0.1 AS DOUBLE))) AS quota FROM (
          SELECT *, row_number() OVER ({over} ORDER BY md5('42:' || sample_id), sample_id) AS place,
                 count(*) OVER ({over}) AS n FROM ({source})))"""


ORACLES: dict[str, str] = {}

_prompt = _fill(fixed.PROMPT_TEMPLATE, input="input")
ORACLES["flagship_sft_pairs"] = f"""
    SELECT sample_id, conv_id, turn, split, {_prompt} || ' ' || target || '</s>' AS text FROM ({_split(
        _first(f"SELECT conv_id || '-' || turn AS sample_id, * FROM ({CHAT}) WHERE {FULL}", "input, target"), "")})"""

# --- sources and sinks ------------------------------------------------------------------------

ORACLES["jsonl_round_trip"] = PAIRS
ORACLES["jsonl_rejects"] = f"""
    SELECT sample_id, CASE WHEN input IN ('de', 'fr', 'es') THEN '' ELSE input END AS input,
           CASE WHEN input IN ('de', 'fr') THEN '' ELSE target END AS target,
           CASE WHEN input IN ('de', 'fr') THEN 'INVALID_JSON' ELSE '' END AS error_code FROM ({PAIRS})"""
ORACLES["line_numbers"] = """
    SELECT source AS dataset, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no,
           count(*) OVER (PARTITION BY source) AS file_lines, doc_id AS sample_id FROM documents"""
_MODELS = """
    SELECT 'artifact' AS kind, name, '/models/' || name AS url, CAST(sum(octet_length(encode(s_name)) + 1) AS BIGINT) AS size
    FROM (SELECT 'model-' || s_nationkey || CASE s_nationkey % 3 WHEN 0 THEN '.gguf' WHEN 1 THEN '.report.json' ELSE '.bin' END AS name, s_name
          FROM supplier) WHERE name LIKE '%.gguf' OR name LIKE '%.json' GROUP BY name"""
ORACLES["artifacts"] = _MODELS
ORACLES["stream_watched_sizes"] = _MODELS
ORACLES["file_inventory"] = f"""
    SELECT 'dataset' AS kind, source || '.jsonl' AS name, source = 'src3' AS selected, CAST(NULL AS VARCHAR) AS url,
           CAST(sum(octet_length(encode(lang)) + 1) AS BIGINT) AS size FROM documents GROUP BY source
    UNION ALL SELECT kind, name, NULL, url, size FROM ({_MODELS})"""
ORACLES["eval_head_lines"] = "SELECT source AS dataset, count(*) AS lines, true AS cut FROM documents GROUP BY 1"
ORACLES["gate_files"] = """
    WITH named AS (SELECT page_id, split_part(url, '/', 5) || CASE WHEN url LIKE '%.html' THEN ''
                          WHEN url LIKE 'https%' THEN '.jsonl' ELSE ' new.jsonl' END AS name,
                          length(html) * 20000 AS size FROM pages),
    checked AS (SELECT *, regexp_replace(name, '[^a-zA-Z0-9_.-]', '_', 'g') AS safe,
                       CASE WHEN name = '' THEN 'No file uploaded'
                            WHEN NOT suffix(name, '.jsonl') THEN 'Only .jsonl files are allowed'
                            WHEN size > 104857600 THEN 'File too large' ELSE '' END AS error_message FROM named)
    SELECT page_id, CASE WHEN error_message = '' THEN safe ELSE '' END AS safe_name,
           error_message = '' AND count(*) FILTER (error_message = '') OVER (PARTITION BY safe) > 1 AS collides,
           error_message FROM checked"""
ORACLES["folder_inventory"] = """
    SELECT DISTINCT 'dataset' AS kind, source AS name, source = 'src3' AS selected, true AS filled FROM documents"""
ORACLES["jsonl_order"] = """
    SELECT source AS dataset, doc_id AS sample_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position
    FROM documents"""
ORACLES["inspect_first"] = """
    SELECT 'doc_id,text,lang,source,n_chars' AS columns, min(doc_id) AS first_id, arg_min(text, doc_id) AS first_text
    FROM documents"""
ORACLES["plain_pairs"] = """
    SELECT source AS dataset, count(*) AS rows, CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) AS held,
           CAST(sum(length(text)) AS BIGINT) AS chars
    FROM (SELECT DISTINCT source, lang, text FROM documents WHERE trim(text) <> '') GROUP BY source"""
ORACLES["inspect_datasets"] = """
    SELECT source, 'doc_id,text,lang,source,n_chars' AS columns, min(doc_id) AS first_id,
           arg_min(text, doc_id) AS first_text FROM documents GROUP BY source"""

# --- normalising ------------------------------------------------------------------------------

ORACLES["normalize_instruction"] = f"""
    SELECT doc_id, source AS dataset, {_strip(f"source || CASE WHEN lang = 'de' THEN '' ELSE {NL} || lang END")} AS input,
           {_strip('text')} AS target FROM documents WHERE lang <> 'fr' AND {_strip('text')} <> ''"""
ORACLES["normalize_act"] = f"""
    SELECT doc_id, 'Act as ' || source AS input, {_strip('text')} AS target FROM documents
    WHERE {_strip('text')} <> ''"""
ORACLES["normalize_response"] = f"""
    SELECT doc_id, lang || ': ' || source AS input, {_strip('text')} AS target FROM documents
    WHERE {_strip('text')} <> ''"""
ORACLES["normalize_mixed_json"] = f"""
    SELECT doc_id, CASE lang WHEN 'de' THEN source || {NL} || lang WHEN 'fr' THEN 'Act as ' || source
                   WHEN 'es' THEN source ELSE n_chars::VARCHAR END AS input,
           {_strip('text')} AS target FROM documents"""
ORACLES["import_stats"] = f"""
    SELECT source AS dataset, count(*) FILTER (lang <> 'fr' AND {_strip('text')} <> '') AS count,
           count(*) FILTER (lang = 'fr' OR {_strip('text')} = '') AS skipped FROM documents GROUP BY 1"""
ORACLES["transform_sql"] = """
    SELECT doc_id, lang || '/' || source AS input, CASE WHEN lang <> 'es' THEN text END AS target FROM documents"""
ORACLES["transform_rows"] = """
    SELECT doc_id, CASE WHEN lang <> 'es' AND n_chars >= 500 THEN lang || '/' || source END AS input,
           CASE WHEN lang <> 'es' AND n_chars >= 500 THEN text END AS target,
           CASE WHEN lang <> 'es' AND n_chars < 500 THEN 'ValueError: too short' ELSE '' END AS error FROM documents"""
ORACLES["chat_pairs"] = CHAT
ORACLES["validate_requests"] = f"""
    WITH asked AS (SELECT page_id, ['import', 'clean', 'convert', 'evaluate', 'judge', 'generate'][page_id % 6 + 1] AS job,
        replace(split_part(url, '/', 3), '.', '-') || '/' || split_part(url, '/', 5) AS repo,
        split_part(url, '/', 5) AS filename,
        ['f16', 'q8_0', 'q4_0', 'q2_k', 'q8_0'][page_id % 5 + 1] AS quant,
        (page_id % 7)::DOUBLE / 5 AS lim, (page_id % 131)::INTEGER AS sharp, (page_id % 9)::INTEGER AS count FROM pages),
    ready AS (SELECT page_id, job, repo, filename, count,
        CASE WHEN job = 'import' THEN 'train' END AS split,
        CASE WHEN job IN ('convert', 'evaluate', 'judge') THEN 'tuned' END AS model,
        CASE WHEN job IN ('convert', 'evaluate', 'judge') THEN quant END AS quantization,
        CASE job WHEN 'evaluate' THEN CASE WHEN lim = 0 THEN 1.0 ELSE lim END
                 WHEN 'judge' THEN CASE WHEN lim = 0 THEN 0.2 ELSE lim END END AS "limit",
        CASE WHEN job = 'judge' THEN CASE WHEN sharp = 0 THEN 50 ELSE sharp END END AS sharpness FROM asked),
    checked AS (SELECT *, CASE
        WHEN job = 'import' AND NOT regexp_full_match(repo, '[a-zA-Z0-9_-]+/[a-zA-Z0-9_.-]+')
          THEN 'Invalid repository format. Expected: owner/repo'
        WHEN job = 'clean' AND filename = '' THEN 'Filename required'
        WHEN job = 'generate' AND count = 0 THEN 'Missing fields'
        WHEN quantization NOT IN ('f16', 'q8_0', 'q5_0', 'q4_0') THEN 'Invalid quantization. Allowed: f16, q8_0, q5_0, q4_0'
        WHEN "limit" NOT BETWEEN 0.01 AND 1 THEN 'Limit must be between 0.01 and 1.0'
        WHEN sharpness NOT BETWEEN 0 AND 100 THEN 'Sharpness must be between 0 and 100' ELSE '' END AS error_message FROM ready)
    SELECT page_id, split, model, quantization, round("limit", 6) AS "limit", sharpness, count,
           CASE WHEN error_message = '' THEN ''
                WHEN job IN ('import', 'clean', 'generate') THEN 'INVALID_INPUT' ELSE 'INVALID_PARAM' END AS error_code,
           error_message FROM checked"""
ORACLES["log_text"] = f"SELECT doc_id, substr(regexp_replace(text, '[\\n\\r]', ' ', 'g'), 1, 500) AS line FROM documents"

# --- cleaning ---------------------------------------------------------------------------------

ORACLES["dedupe_pairs"] = _first(GAPPY, "dataset, input, target")
ORACLES["drop_blank"] = f"SELECT * FROM ({GAPPY}) WHERE {FULL}"
ORACLES["clean_pairs"] = _first(f"SELECT * FROM ({GAPPY}) WHERE {FULL}", "dataset, input, target")
ORACLES["clean_stats"] = f"""
    SELECT dataset, initial, initial - count AS removed, count FROM (
      SELECT dataset, sum(copies)::BIGINT AS initial, count(*) FILTER ({FULL}) AS count FROM (
        SELECT dataset, input, target, count(*) AS copies FROM ({GAPPY}) GROUP BY ALL) GROUP BY dataset)"""

# --- preparing --------------------------------------------------------------------------------

SPLIT = _split(PAIRS, "dataset")
ORACLES["split_exact"] = f"SELECT dataset, sample_id, split FROM ({SPLIT})"
ORACLES["rendered_prompts"] = f"""
    SELECT sample_id, {_prompt} AS prompt, {_prompt} || ' ' || target || '</s>' AS text FROM ({PAIRS})"""


def _words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '[ \\t\\n\\r]+'), lambda w: w <> '')"


TOKENS = f"""
    SELECT *, least(256, len(words) + 1) AS n_tokens, len(words) + 1 > 256 AS truncated, least(256, len(asked)) AS shown,
           list_transform(words[1:256], lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT % 49999 + 1) AS ids
    FROM (SELECT *, {_words(f"{_prompt} || ' ' || target")} AS words, {_words(_prompt)} AS asked FROM ({PAIRS}))"""
_STATS = """
    SELECT sample_id, n_tokens, greatest(n_tokens - shown, 0) AS n_trainable, n_tokens <= shown AS dead, truncated,
           coalesce(list_sum(ids), 0)::BIGINT AS id_sum,
           (coalesce(list_sum(ids[shown + 1:]), 0) - 100 * least(shown, n_tokens))::BIGINT AS label_sum"""
ORACLES["token_mask_stats"] = f"{_STATS} FROM ({TOKENS})"


def _bytes(expr: str) -> str:
    return f"list_transform(regexp_extract_all(hex({expr}), '..'), lambda b: ('0x' || b)::BIGINT)"


ORACLES["loaded_tokenizer_stats"] = f"""{_STATS} FROM (
    SELECT sample_id, least(4096, len(bytes) + 1) AS n_tokens, len(bytes) + 1 > 4096 AS truncated, least(4096, strlen({_prompt})) AS shown, bytes[1:4096] AS ids
    FROM (SELECT *, {_bytes(f"{_prompt} || ' ' || target")} AS bytes FROM ({PAIRS})))"""
ORACLES["batch_padding"] = f"""
    SELECT dataset, batch_id, count(*) AS batch_rows, max(n_tokens) AS max_len,
           string_agg(sample_id::VARCHAR, ',' ORDER BY place) AS members,
           (count(*) * max(n_tokens))::BIGINT AS cells, sum(greatest(n_tokens - shown, 0))::BIGINT AS trainable
    FROM (SELECT *, (place - 1) // 4 AS batch_id FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:0:' || sample_id), sample_id) AS place
      FROM ({TOKENS}))) GROUP BY dataset, batch_id"""
ORACLES["training_plan"] = f"""
    SELECT dataset, n_train, n_val, batches, steps_per_epoch, 3 * steps_per_epoch AS total_steps,
           least(50, 3 * steps_per_epoch) AS warmup
    FROM (SELECT *, ceil(batches / 2)::BIGINT AS steps_per_epoch FROM (SELECT *, ceil(n_train / 4)::BIGINT AS batches FROM (
      SELECT dataset, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_val
      FROM ({SPLIT}) GROUP BY dataset)))"""

# --- rules ------------------------------------------------------------------------------------

_regexes = ", ".join(
    f"({ord_}, 'regex-{ord_}', {_text(trigger)}, 'regex', {ci}, {ws}, 'answer {ord_}', true)".lower()
    for ord_, trigger, ci, ws in REGEX_RULES)
RULES = f"""
    SELECT conv_id * 1000 + turn AS rule_ord, 'rule-' || (conv_id * 1000 + turn) AS id,
        CASE turn WHEN 0 THEN lower(text) WHEN 2 THEN '  ' || replace(text, ' ', ' ' || chr(9) || ' ') || {NL}
                  WHEN 4 THEN lower(text) || ' ' ELSE text END AS trigger,
        CASE WHEN turn = 6 THEN 'semantic' ELSE 'exact' END AS kind, turn IN (0, 4) AS ci, turn IN (2, 4) AS ws,
        'answer ' || (conv_id * 1000 + turn) AS response, length(text) > 60 AS enabled
    FROM conversations WHERE role = 'user'
    UNION ALL SELECT * FROM (VALUES {_regexes}) AS r"""


def _seen(expr: str) -> str:
    spaced = f"CASE WHEN ws THEN {_collapse(expr)} ELSE {expr} END"
    return f"CASE WHEN ci THEN lower({spaced}) ELSE {spaced} END"


EXACT = f"""SELECT m.conv_id, m.turn, min(rule_ord) AS ord FROM conversations m JOIN ({RULES}) r
    ON r.enabled AND r.kind = 'exact' AND {_seen('m.text')} = {_seen('r.trigger')} GROUP BY ALL"""
REGEX = f"""SELECT m.conv_id, m.turn, min(rule_ord) AS ord FROM conversations m JOIN (
      SELECT * FROM ({RULES}) WHERE enabled AND kind = 'regex') r
    ON CASE WHEN ci THEN regexp_matches({_seen('m.text')}, r.trigger, 'i')
            ELSE regexp_matches({_seen('m.text')}, r.trigger) END GROUP BY ALL"""
RESOLVED = f"""SELECT m.conv_id, m.turn, m.text, least(e.ord, x.ord) AS matched_ord, r.id AS matched_id, r.response
    FROM conversations m LEFT JOIN ({EXACT}) e USING (conv_id, turn) LEFT JOIN ({REGEX}) x USING (conv_id, turn)
    LEFT JOIN ({RULES}) r ON r.rule_ord = least(e.ord, x.ord)"""
ORACLES["rule_dataset"] = f"""
    SELECT rule_ord, trigger AS input, response AS target FROM ({RULES})
    WHERE enabled AND trigger <> '' AND response <> ''"""
ORACLES["match_exact"] = f"""
    SELECT m.conv_id, m.turn, e.ord AS exact_ord FROM conversations m LEFT JOIN ({EXACT}) e USING (conv_id, turn)"""
ORACLES["match_regex"] = f"""
    SELECT m.conv_id, m.turn, x.ord AS regex_ord FROM conversations m LEFT JOIN ({REGEX}) x USING (conv_id, turn)"""
ORACLES["match_regex_rejects"] = """
    SELECT s_suppkey AS rule_ord, 'regex-' || s_suppkey AS id, s_name || CASE s_suppkey % 3 WHEN 0 THEN '(' ELSE '[a' END AS trigger,
           'INVALID_INPUT' AS error_code FROM supplier WHERE s_suppkey % 3 < 2"""
ORACLES["resolve_rules"] = f"SELECT conv_id, turn, matched_ord, matched_id, response FROM ({RESOLVED})"
ORACLES["route_chats"] = f"""
    SELECT conv_id, CASE WHEN matched_ord IS NULL THEN 'upstream' ELSE 'rule' END AS route, matched_id, text AS input,
           CASE WHEN matched_ord IS NOT NULL THEN 'chatcmpl-' || conv_id END AS reply_id, response AS content
    FROM ({RESOLVED}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""

ORACLES["answer_chats"] = ORACLES["stream_answers"] = f"""
    SELECT a.conv_id, route, matched_id, status, CASE WHEN status = 200 THEN 'chatcmpl-' || a.conv_id END AS reply_id,
           CASE WHEN status = 200 THEN CASE route WHEN 'rule' THEN 'override-rules' ELSE 'upstream' END END AS model,
           CASE WHEN status = 200 THEN CASE route WHEN 'rule' THEN response ELSE 'be brief: ' || role || ' ' || text END END AS content,
           CASE status WHEN 400 THEN 'INVALID_INPUT' WHEN 429 THEN 'INTERNAL_ERROR' END AS error_code,
           CASE status WHEN 400 THEN 'Invalid messages' WHEN 429 THEN 'ModelError: model API returned 429: busy' END AS error_message
    FROM (SELECT conv_id || '-' || turn AS conv_id, response, text, CASE WHEN turn <> 3 THEN matched_id END AS matched_id,
                 CASE WHEN turn = 3 THEN 'rejected' WHEN matched_ord IS NULL THEN 'upstream' ELSE 'rule' END AS route,
                 CASE WHEN turn = 3 THEN 400 WHEN matched_ord IS NULL AND contains(text, 'z') THEN 429 ELSE 200 END AS status
          FROM ({RESOLVED})) a
    JOIN (SELECT conv_id || '-' || turn AS conv_id, role FROM conversations) b ON a.conv_id = b.conv_id"""
ORACLES["stream_routing"] = f"""
    SELECT conv_id || '-' || turn AS conv_id, CASE WHEN matched_ord IS NULL THEN 'upstream' ELSE 'rule' END AS route,
           matched_id, text AS input FROM ({RESOLVED})"""

SLOTTED = """
    SELECT *, post OR s - step - low > 0 AS found,
           CASE WHEN post THEN posts WHEN del THEN dels + least(low, s) ELSE dels + least(low, s) + 1 END AS slot
    FROM (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY id ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM (
      SELECT *, sum(step) OVER w AS s, sum(post::INT) OVER w AS posts, sum(del::INT) OVER w AS dels FROM (
        SELECT event_id AS seq, ts, user_id::VARCHAR AS id, event_type, value, props,
               event_type = 'signup' AS post, event_type = 'error' AS del,
               CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS step
        FROM events WHERE event_type <> 'view') WINDOW w AS (PARTITION BY id ORDER BY seq)))"""
# The log replayed change by change, each id with the list of its live rules.
ORACLES["rule_fold"] = """
    WITH RECURSIVE log AS (
      SELECT user_id::VARCHAR AS id, event_type AS kind, event_id AS seq, ts, props,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
      FROM events WHERE event_type <> 'view' AND user_id IS NOT NULL),
    state AS (
      SELECT DISTINCT id, 0::BIGINT AS n, []::STRUCT(rule_ord BIGINT, trigger VARCHAR, response VARCHAR, enabled BOOLEAN,
             created TIMESTAMP, updated TIMESTAMP)[] AS live FROM log
      UNION ALL
      SELECT id, l.n, CASE
          WHEN kind = 'signup' THEN list_append(live, {rule_ord: seq, trigger: 't' || seq, response: props, enabled: TRUE,
                                                       created: ts::TIMESTAMP, updated: ts::TIMESTAMP})
          WHEN len(live) = 0 THEN live
          WHEN kind = 'error' THEN live[2:]
          WHEN kind = 'purchase' THEN list_prepend({rule_ord: live[1].rule_ord, trigger: 'p' || seq, response: live[1].response,
               enabled: FALSE, created: live[1].created, updated: ts::TIMESTAMP}, live[2:])
          WHEN kind = 'click' THEN list_prepend({rule_ord: live[1].rule_ord, trigger: live[1].trigger, response: 'c' || seq,
               enabled: live[1].enabled, created: live[1].created, updated: ts::TIMESTAMP}, live[2:])
          ELSE list_prepend({rule_ord: live[1].rule_ord, trigger: live[1].trigger, response: live[1].response,
               enabled: live[1].enabled, created: live[1].created, updated: ts::TIMESTAMP}, live[2:]) END
      FROM state s JOIN log l USING (id) WHERE l.n = s.n + 1)
    SELECT r.rule_ord AS rule_ord, id, r.trigger AS trigger, r.response AS response, r.enabled AS enabled, 'exact' AS match_type,
           strftime(r.created, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(r.updated, '%Y-%m-%d %H:%M:%S') AS updated_at
    FROM (SELECT id, unnest(live) AS r FROM state QUALIFY n = max(n) OVER (PARTITION BY id))"""
ORACLES["stream_rule_fold"] = ORACLES["rule_fold"]
ORACLES["rule_fold_rejects"] = f"""
    SELECT seq, CASE WHEN del THEN 'DELETE' ELSE 'PUT' END AS op, id, 'NOT_FOUND' AS error_code
    FROM ({SLOTTED}) WHERE NOT found
    UNION ALL SELECT event_id, 'PATCH', user_id::VARCHAR, 'INVALID_INPUT' FROM events WHERE event_type = 'view'"""

# --- model calls ------------------------------------------------------------------------------

_variation = _fill(fixed.VARIATION_TEMPLATE, count="least(50, n_chars)::VARCHAR", seed_input="source", seed_output="text")
ORACLES["variation_prompts"] = f"""
    SELECT doc_id, least(50, n_chars)::INTEGER AS count, {_variation} AS prompt FROM documents
    WHERE source <> '' AND text <> '' AND n_chars <> 0"""
ORACLES["variation_rows"] = """
    SELECT doc_id, 0 AS variation, source AS input, text AS target, '' AS error_code FROM documents WHERE lang <> 'es'
    UNION ALL SELECT doc_id, 1, lang, NULL, '' FROM documents WHERE lang <> 'es'
    UNION ALL SELECT doc_id, NULL, NULL, NULL, 'INTERNAL_ERROR' FROM documents WHERE lang = 'es'"""
ORACLES["model_calls"] = """
    SELECT doc_id, CASE WHEN lang <> 'fr' THEN length(lang || ' ' || text) || ' at 0.5: ' || lang || ' ' || text END AS reply,
           CASE WHEN lang = 'fr' THEN 'TimeoutError: no answer' END AS error FROM documents"""
ORACLES["generate_job"] = """
    WITH d AS (SELECT lang = 'es' AS refused, doc_id % 60 = 0 AS rejected FROM documents),
    t AS (SELECT count(*) FILTER (NOT rejected AND NOT refused) AS n, count(*) FILTER (rejected) AS missing, count(*) FILTER (refused AND NOT rejected) AS failed FROM d)
    SELECT 'generated_2024-05-06T07-08-09-010Z.jsonl' AS filename, 2 * n AS count, unnest(['a', 'b', 'INVALID_INPUT', 'INTERNAL_ERROR']) AS input,
           unnest([n, n, missing, failed]) AS rows FROM t"""
ORACLES["training_job"] = f"""
    WITH s AS ({SPLIT}), t AS (SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation,
        CAST(sum(length(target)) FILTER (split = 'validation') AS BIGINT) AS validation_chars FROM s GROUP BY dataset)
    SELECT dataset, CAST(ceil(train / 4) AS BIGINT) AS batches, train, validation, validation_chars FROM t"""
ORACLES["fenced_text"] = f"""
    SELECT doc_id, {_trim(f"replace(text, '```', '') || {NL} || ' ' || lang")} AS text FROM documents"""

# --- evaluation -------------------------------------------------------------------------------

ORACLES["eval_head"] = f"""
    SELECT dataset, sample_id FROM ({PAIRS})
    QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sample_id)
            <= greatest(1, floor(count(*) OVER (PARTITION BY dataset) * CAST(0.3 AS DOUBLE)))"""
ORACLES["finalize_predictions"] = f"""
    SELECT doc_id, {_strip(f"split_part(split_part(' ' || text || 'Input: ' || lang, 'Input:', 1), {NL}, 1)")} AS output
    FROM documents"""
SCORED = """
    SELECT d.doc_id, source AS model, lang AS quantization, text AS input, quality::VARCHAR AS target,
           quality * 40 + toxic * 35 AS sharpness,
           CASE WHEN toxic = 1 THEN NULL WHEN n_chars > 500 THEN '1' ELSE '0' END AS output, output = target AS correct
    FROM documents d JOIN labels USING (doc_id)"""
ACCURACY = f"""
    SELECT model, quantization, CASE WHEN total > 0 THEN correct / total ELSE 0 END AS accuracy, total, correct, skipped FROM (
      SELECT source AS model, lang AS quantization, count(s.correct) AS total, count(*) FILTER (s.correct) AS correct,
             count(*) FILTER (s.doc_id IS NULL) AS skipped
      FROM documents d LEFT JOIN ({SCORED}) s USING (doc_id) GROUP BY 1, 2)"""
ORACLES["score_exact"] = f"SELECT doc_id, output, correct FROM ({SCORED})"
ORACLES["accuracy_report"] = f"SELECT * REPLACE (round(accuracy, 6) AS accuracy) FROM ({ACCURACY})"
ORACLES["report_round_trip"] = f"""
    SELECT model, quantization, round(accuracy, 6) AS accuracy, total, correct, total AS listed
    FROM ({ACCURACY}) WHERE total > 0"""
_instruction = (f"CASE WHEN sharpness < 30 THEN {_text(fixed.LENIENT)} WHEN sharpness > 70 THEN {_text(fixed.STRICT)} "
                f"ELSE {_text(fixed.BALANCED)} END")
ORACLES["judge_prompts"] = f"""
    SELECT doc_id, {_fill(fixed.JUDGE_TEMPLATE, instruction=_instruction, input='input', target='target', output='output')}
      AS prompt FROM ({SCORED}) WHERE output IS NOT NULL"""
JUDGED = """
    SELECT doc_id, source AS model, lang AS quantization, 50 AS sharpness,
           CASE WHEN good THEN n_chars / 1000 ELSE 0 END AS score,
           CASE WHEN good THEN source ELSE 'Judge Failed' END AS reason, NOT good AS failed,
           good AND n_chars / 1000 > 10 AS out_of_range
    FROM (SELECT *, quality = 1 AND toxic = 0 AS good FROM documents JOIN labels USING (doc_id))"""
ORACLES["parse_judgments"] = f"""
    SELECT doc_id, round(score, 6) AS score, reason, failed, out_of_range FROM ({JUDGED})"""
ORACLES["judge_report"] = f"""
    SELECT model, quantization, sharpness, round(average_score, 6) AS average_score, round(accuracy, 6) AS static_accuracy
    FROM (SELECT model, quantization, sharpness, avg(score) AS average_score FROM ({JUDGED}) GROUP BY ALL)
    JOIN ({ACCURACY}) USING (model, quantization)"""

ORACLES["import_job"] = f"""
    SELECT 'demo/instruct' AS repo, 'demo_instruct.jsonl' AS filename, count(*) FILTER (ok) AS count,
           count(*) FILTER (NOT ok) AS skipped, count(*) FILTER (ok) AS written,
           sum(length({_strip('text')})) FILTER (ok)::BIGINT AS target_chars
    FROM (SELECT *, lang <> 'fr' AND {_strip('text')} <> '' AS ok FROM documents)
    UNION ALL
    SELECT 'demo/persona', 'demo_persona.jsonl', count(*) FILTER (ok), count(*) FILTER (NOT ok), count(*) FILTER (ok),
           sum(length({_strip('text')})) FILTER (ok)::BIGINT
    FROM (SELECT *, {_strip('text')} <> '' AS ok FROM documents)"""
ORACLES["judge_job"] = """
    SELECT 'demo' AS model, 'f16' AS quantization, 80 AS sharpness, 1.0::DOUBLE AS "limit",
           round(avg(CASE WHEN lang = 'de' THEN 9.0::DOUBLE ELSE 0 END), 6) AS average_score,
           round(avg(CASE WHEN source < 'src2' OR text = lang THEN 1.0::DOUBLE ELSE 0 END), 6) AS static_accuracy
    FROM documents"""

# --- monitoring -------------------------------------------------------------------------------

LOG = """
    SELECT user_id AS run_id, event_id AS seq, kind,
      CASE WHEN kind = 'metric' THEN value END AS loss, CASE WHEN kind = 'metric' THEN value * 2 END AS grad_norm,
      CASE WHEN kind = 'metric' THEN 1 / (event_id * 7 + 2) END AS learning_rate,
      CASE WHEN kind = 'metric' THEN event_id / 100 END AS epoch, CASE WHEN kind = 'metric' THEN event_id END AS step,
      CASE kind WHEN 'raw' THEN 'epoch done ' || event_id WHEN 'stderr' THEN 'epoch done ' || event_id
                WHEN 'message' THEN 'hello ' || user_id WHEN 'status' THEN 'Training complete'
                WHEN 'error' THEN 'failed at ' || event_id END AS text
    FROM (SELECT *, CASE WHEN value > 200 THEN 'stderr' WHEN value > 150 THEN 'raw'
                         WHEN event_type IN ('click', 'view') THEN 'metric' WHEN event_type = 'signup' THEN 'message'
                         WHEN event_type = 'purchase' THEN 'status' ELSE 'error' END AS kind FROM events)"""
_rounded = ("round(loss, 9) AS loss, round(grad_norm, 9) AS grad_norm, "
            "round(learning_rate, 9) AS learning_rate, round(epoch, 9) AS epoch")
LATEST = f"""SELECT * FROM ({LOG}) WHERE loss <> 0
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1"""
ORACLES["log_chunks"] = ORACLES["stream_log_chunks"] = f"""
    SELECT l.run_id, channel, line_no, kind, {_rounded}, step, text
    FROM ({LOG}) l JOIN (SELECT event_id, CASE WHEN value > 200 THEN 'stderr' ELSE 'stdout' END AS channel,
        row_number() OVER (PARTITION BY user_id, value > 200 ORDER BY event_id) AS line_no FROM events) e ON e.event_id = l.seq"""
ORACLES["parse_logs"] = f"SELECT * REPLACE ({_rounded}) FROM ({LOG})"
ORACLES["latest_metrics"] = f"SELECT run_id, seq, {_rounded}, step FROM ({LATEST})"
ORACLES["stream_latest_metrics"] = ORACLES["latest_metrics"]
ORACLES["metric_cards"] = f"""
    SELECT run_id, printf('%.2f', epoch) AS epoch, printf('%.4f', loss) AS loss, printf('%.2f', grad_norm) AS grad_norm,
           regexp_replace(printf('%.2e', learning_rate), 'e([+-])0([0-9])$', 'e\\1\\2') AS learning_rate FROM ({LATEST})"""
ORACLES["recent_logs"] = f"""
    SELECT run_id, seq, kind, text FROM ({LOG})
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 101"""
ORACLES["stream_recent_logs"] = ORACLES["recent_logs"]
ORACLES["file_sizes"] = """
    SELECT file, size, round(size / 1048576, 2) AS size_mb FROM (
      SELECT event_type || '-' || user_id || '.gguf' AS file,
             arg_max(floor(value * 1000000)::BIGINT, ts) AS size FROM events GROUP BY 1)"""
ORACLES["stream_file_sizes"] = ORACLES["file_sizes"]
ORACLES["run_status"] = """
    SELECT user_id AS run_id, max(event_id) AS seq, arg_max(event_type, event_id) = 'signup' AS running,
           arg_max_null(CASE WHEN event_type = 'signup' THEN event_id::INTEGER END, event_id) AS pid,
           arg_max_null(CASE WHEN event_type = 'error' THEN floor(value)::INTEGER END, event_id) AS code,
           bool_or(event_type = 'purchase' AND value > 100) AS killed
    FROM events WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY user_id"""
ORACLES["stream_run_status"] = ORACLES["run_status"]
ORACLES["message_log"] = """
    SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'train-log' WHEN 'error' THEN 'system' ELSE 'status' END AS type,
           CASE event_type WHEN 'error' THEN 'm' || event_id END AS text,
           CASE event_type WHEN 'click' THEN round(value, 9) END AS loss,
           CASE event_type WHEN 'click' THEN event_id END AS step,
           CASE event_type WHEN 'signup' THEN true WHEN 'purchase' THEN false END AS running,
           CASE event_type WHEN 'signup' THEN event_id::INTEGER END AS pid,
           CASE event_type WHEN 'purchase' THEN (event_id % 3)::INTEGER END AS code
    FROM events WHERE event_type IN ('signup', 'purchase', 'click') OR event_type = 'error' AND event_id % 2 = 0"""
ORACLES["message_state"] = """
    SELECT * FROM (
      SELECT user_id AS run_id, arg_max(event_type, event_id) = 'signup' AS running,
             arg_max_null(CASE WHEN event_type = 'signup' THEN event_id::INTEGER END, event_id) AS pid,
             arg_max_null(CASE WHEN event_type = 'purchase' THEN (event_id % 3)::INTEGER END, event_id) AS code
      FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)
    FULL JOIN (SELECT user_id AS run_id, round(arg_max(value, event_id), 9) AS loss, max(event_id) AS step
               FROM events WHERE event_type = 'click' AND value <> 0 GROUP BY 1) USING (run_id)
    FULL JOIN (SELECT user_id AS run_id, max(event_id) * 1000 AS size
               FROM events WHERE event_type = 'view' GROUP BY 1) USING (run_id)"""
ORACLES["overlapping_runs"] = """
    SELECT run_id, started, ended FROM (
      SELECT *, max(coalesce(ended, 9223372036854775807)) OVER (
               ORDER BY started ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active FROM (
        SELECT event_id AS run_id, event_id AS started,
               CASE WHEN value < 300 THEN event_id + floor(value / 20)::BIGINT END AS ended
        FROM events WHERE event_type = 'signup')) WHERE active > started"""

# --- catalogue --------------------------------------------------------------------------------

ORACLES["model_search"] = """
    SELECT p_name || ' ' || p_partkey AS id, p_retailprice AS downloads FROM part
    WHERE p_type = 'PROMO' AND contains(lower(p_name || ' ' || p_partkey), 'ring')
    ORDER BY downloads DESC, id LIMIT 10"""
ORACLES["recent_models"] = """
    WITH RECURSIVE saves AS (
      SELECT user_id AS u, event_type || '-' || floor(value / 25)::BIGINT AS model,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place,
             count(*) OVER (PARTITION BY user_id) AS n FROM events),
    lists AS (
      SELECT u, place, n, [model] AS listed FROM saves WHERE place = 1
      UNION ALL
      SELECT s.u, s.place, s.n, CASE WHEN list_contains(listed, model) THEN listed
                                     ELSE list_prepend(model, listed)[1:20] END
      FROM lists l JOIN saves s ON s.u = l.u AND s.place = l.place + 1)
    SELECT u AS user, unnest(generate_series(1, len(listed)))::INTEGER AS position, unnest(listed) AS model
    FROM lists WHERE place = n"""
