"""The given tables in the shapes the operators take. Every row and whole texts are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairworks.operators.rules import RULE_SCHEMA


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("dataset"),
        F.col("lang").alias("input"), F.col("text").alias("target"))


def gappy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one dataset has blank inputs and one no targets."""
    return pairs(spark, folder).selectExpr(
        "sample_id", "input AS dataset",
        "CASE WHEN dataset = 'src3' THEN ' \\n' ELSE input END AS input",
        "CASE WHEN dataset = 'src5' THEN NULL ELSE target END AS target")


def instructions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id", "source AS dataset", "source AS instruction",
        "CASE WHEN lang = 'de' THEN '' ELSE lang END AS input",
        "CASE WHEN lang = 'fr' THEN NULL ELSE text END AS output")


def mixed_json(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object per document; its fields depend on the language."""
    return table(spark, folder, "documents").selectExpr("doc_id", """
        CASE lang
          WHEN 'de' THEN to_json(named_struct('instruction', source, 'input', lang, 'output', text))
          WHEN 'fr' THEN to_json(named_struct('act', source, 'prompt', text))
          WHEN 'es' THEN to_json(named_struct('prompt', source, 'response', text))
          ELSE to_json(named_struct('input', n_chars, 'instruction', '', 'target', text))
        END AS raw""")


# Regex rules added to those made from the tables.
REGEX_RULES = [
    # rule_ord, trigger, case_insensitive, normalize_ws
    (50, "ing (the|an) ", False, False),
    (4050, "^éa", True, False),
    (20050, "zu[a-z]* der, ", False, True),
    (90_000_000, "ción", True, True),
    (90_000_001, "[aeiou]{4}", False, False),
]


def rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every user message as a rule, its flags by its turn, and the regex rules above."""
    made = table(spark, folder, "conversations").filter("role = 'user'").selectExpr(
        "conv_id * 1000 + turn AS rule_ord",
        "concat('rule-', conv_id * 1000 + turn) AS id",
        """CASE turn WHEN 0 THEN lower(text) WHEN 2 THEN concat('  ', replace(text, ' ', ' \\t '), '\\n')
           WHEN 4 THEN concat(lower(text), ' ') ELSE text END AS trigger""",
        """named_struct('type', CASE WHEN turn = 6 THEN 'semantic' ELSE 'exact' END,
                        'case_insensitive', turn IN (0, 4), 'normalize_ws', turn IN (2, 4)) AS match""",
        "concat('answer ', conv_id * 1000 + turn) AS response",
        "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS updated_at",
        "length(text) > 60 AS enabled")
    regexes = spark.createDataFrame(
        [(ord_, f"regex-{ord_}", trigger, ("regex", ci, ws), f"answer {ord_}", None, None, True)
         for ord_, trigger, ci, ws in REGEX_RULES], RULE_SCHEMA)
    return made.unionByName(regexes)


def changes(events: DataFrame) -> DataFrame:
    """Events as a rule log: signup POST, error DELETE, view an unknown operation, others PUT."""
    return events.selectExpr(
        "event_id AS seq", "CAST(ts AS timestamp) AS ts",
        """CASE event_type WHEN 'signup' THEN 'POST' WHEN 'error' THEN 'DELETE'
           WHEN 'view' THEN 'PATCH' ELSE 'PUT' END AS op""",
        "CAST(user_id AS string) AS id",
        """CASE event_type
             WHEN 'signup' THEN map('trigger', concat('t', event_id), 'response', props,
                                    'enabled', 'true', 'match', '{"type": "exact"}')
             WHEN 'click' THEN map('response', concat('c', event_id))
             WHEN 'purchase' THEN map('trigger', concat('p', event_id), 'enabled', 'false')
           END AS body""")


def log_lines(events: DataFrame) -> DataFrame:
    """Events as a trainer's output; large values become plain text or stderr."""
    return events.selectExpr(
        "user_id AS run_id", "event_id AS seq",
        """CASE WHEN value > 150 THEN concat('epoch done ', event_id)
                WHEN event_type IN ('click', 'view') THEN concat(
                  '{"loss": ', value, ', "grad_norm": ', value * 2, ', "learning_rate": ', 1 / (event_id * 7 + 2),
                  ', "epoch": ', event_id / 100, ', "step": ', event_id, '}')
                WHEN event_type = 'signup' THEN concat('{"message": "hello ', user_id, '"}')
                WHEN event_type = 'purchase' THEN '{"status": "complete", "message": "Training complete"}'
                ELSE concat('{"error": "failed at ', event_id, '"}') END AS line""",
        "CASE WHEN value > 200 THEN 'stderr' ELSE 'stdout' END AS channel")


def messages(events: DataFrame) -> DataFrame:
    """Events as messages; errors become a message of another type, or texts that are none."""
    return events.selectExpr(
        "user_id AS run_id", "event_id AS seq",
        """CASE event_type
             WHEN 'signup' THEN concat('{"type": "status", "payload": {"running": true, "pid": ', event_id, '}}')
             WHEN 'purchase' THEN concat('{"type": "status", "payload": {"running": false, "code": ', event_id % 3, '}}')
             WHEN 'click' THEN concat('{"type": "train-log", "payload": {"loss": ', value, ', "step": ', event_id, '}}')
             WHEN 'view' THEN concat('{"type": "file-size", "payload": {"file": "', user_id, '.gguf", "size": ',
                                     event_id * 1000, ', "timestamp": ', 1700000000000 + event_id, '}}')
             ELSE CASE WHEN event_id % 2 = 0 THEN concat('{"type": "system", "payload": {"message": "m', event_id, '"}}')
                       ELSE concat('{"type": "train-log", "payload": ', event_id) END END AS message""")


def status_events(events: DataFrame) -> DataFrame:
    return events.filter("event_type IN ('signup', 'error', 'purchase')").selectExpr(
        "user_id AS run_id", "event_id AS seq", "event_type = 'signup' AS running",
        "CASE WHEN event_type = 'signup' THEN CAST(event_id AS int) END AS pid",
        "CASE WHEN event_type = 'error' THEN CAST(floor(value) AS int) END AS code",
        "event_type = 'purchase' AND value > 100 AS killed")


def size_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat(event_type, '-', user_id, '.gguf') AS file",
        "CAST(floor(value * 1000000) AS bigint) AS size", "ts")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as evaluation samples; calls for toxic ones have failed."""
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return labelled.selectExpr(
        "doc_id", "source AS model", "lang AS quantization", "text AS input",
        "CAST(quality AS string) AS target",
        "CASE WHEN toxic = 1 THEN NULL WHEN n_chars > 500 THEN ' 1 Input: next' ELSE '0\\nmore' END AS reply",
        "CASE WHEN toxic = 1 THEN 'timeout' END AS error",
        "quality * 40 + toxic * 35 AS sharpness")


def judge_replies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").join(
        table(spark, folder, "documents"), "doc_id").selectExpr(
        "doc_id", "source AS model", "lang AS quantization", "50 AS sharpness",
        """CASE WHEN toxic = 1 THEN 'I would say 7'
                WHEN quality = 1 THEN concat('```json\\n{"score": ', n_chars / 1000, ', "reason": "', source, '"}\\n```')
                ELSE '{"score": "none"}' END AS reply""")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as job requests with values taken from their address and id."""
    return table(spark, folder, "pages").selectExpr(
        "page_id",
        """element_at(array('import', 'clean', 'convert', 'evaluate', 'judge', 'generate'),
                      CAST(page_id % 6 AS int) + 1) AS job""",
        "concat(replace(split_part(url, '/', 3), '.', '-'), '/', split_part(url, '/', 5)) AS repo",
        "split_part(url, '/', 5) AS filename",
        "element_at(array('f16', 'q8_0', 'q4_0', 'q2_k', ''), CAST(page_id % 5 AS int) + 1) AS quantization",
        "CAST(page_id % 7 AS double) / 5 AS limit",
        "CAST(page_id % 131 AS int) AS sharpness",
        "url AS seed_input", "html AS seed_output", "CAST(page_id % 9 AS int) AS count")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as uploaded files; a text is taken as 20,000 bytes per character."""
    return table(spark, folder, "pages").selectExpr(
        "page_id",
        """concat(split_part(url, '/', 5), CASE WHEN url LIKE '%.html' THEN ''
           WHEN url LIKE 'https%' THEN '.jsonl' ELSE ' new.jsonl' END) AS name""",
        "CAST(length(html) AS bigint) * 20000 AS size")
