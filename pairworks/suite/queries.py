"""A query per operator over the given tables, as (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairworks.functions import fixed_values as fixed
from pairworks.functions.text import sanitize_for_log, strip_fences, unescape
from pairworks.operators import (
    catalog, chats, clean, completion, evaluate, jobs, monitor, normalize, prepare, requests, rules,
)
from pairworks.plans.shared import materialise, new_path
from pairworks.sources import files, lines, tables
from pairworks.streaming import lines as stream_lines
from pairworks.streaming import monitor as stream_monitor
from pairworks.streaming import rules as stream_rules
from pairworks.streaming.batches import BatchTable
from pairworks.streaming.newest import start_newest
from pairworks.suite import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def flagship_sft_pairs(spark, folder):
    made = normalize.chat_to_pairs(fx.table(spark, folder, "conversations")).withColumn(
        "sample_id", F.concat_ws("-", "conv_id", "turn"))
    kept = materialise(clean.clean(made, keys=()), "clean-pairs")
    split = prepare.split_pairs(kept, 0.1, keys=())
    return prepare.render_prompt(split, "</s>").select("sample_id", "conv_id", "turn", "split", "text")


# --- sources and sinks ------------------------------------------------------------------------


def _written(spark: SparkSession, folder: str) -> str:
    path = new_path(spark, "jsonl")
    tables.write_pairs_jsonl(fx.pairs(spark, folder), path)
    return path


@query
def jsonl_round_trip(spark, folder):
    path = _written(spark, folder)
    rows, rejects = lines.read_pairs_jsonl(spark, f"{path}/*/*.json", extra={"sample_id": "bigint"})
    back = rows.select("sample_id", tables.dataset_name(F.col("file")).alias("dataset"), "input", "target")
    return back.unionByName(rejects.selectExpr(
        "NULL AS sample_id", "error_code AS dataset", "value AS input", "NULL AS target"))


@query
def jsonl_order(spark, folder):
    """Where each pair stands in the files of its dataset, written in order."""
    path = new_path(spark, "jsonl")
    pairs = fx.table(spark, folder, "documents").selectExpr(
        "source AS dataset", "doc_id AS sample_id", "lang AS input", "text AS target")
    tables.write_pairs_jsonl(pairs, path, order="sample_id")
    rows, _ = lines.read_pairs_jsonl(spark, f"{path}/*/*.json", extra={"sample_id": "bigint"}, numbered=True)
    rows = rows.withColumn("dataset", tables.dataset_name(F.col("file")))
    earlier = Window.partitionBy("dataset").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select("dataset", "file", "file_lines").distinct().select(
        "file", F.coalesce(F.sum("file_lines").over(earlier), F.lit(0)).alias("before"))
    return rows.join(offsets, "file").select(
        "dataset", "sample_id", (F.col("before") + F.col("line_no")).alias("position"))


@query
def jsonl_rejects(spark, folder):
    """Lines of which some are cut off, blank or followed by more."""
    text = fx.pairs(spark, folder).selectExpr(
        "sample_id", """CASE input WHEN 'de' THEN concat(to_json(struct(input, target)), ' more')
            WHEN 'fr' THEN substr(to_json(struct(input, target)), 2)
            WHEN 'es' THEN to_json(struct(target)) ELSE to_json(struct(input, target)) END AS value""")
    rows, rejects = lines.parse_pairs(text)
    return rows.select("sample_id", "input", "target", F.lit("").alias("error_code")).unionByName(
        rejects.select("sample_id", F.lit("").alias("input"), F.lit("").alias("target"), "error_code"))


@query
def plain_pairs(spark, folder):
    """Lines of {input, target} without ids: read, cleaned and split by file and line number."""
    path = new_path(spark, "plain")
    fx.pairs(spark, folder).select("dataset", "input", "target").write.partitionBy("dataset").json(path)
    rows, _ = lines.read_pairs_jsonl(spark, f"{path}/*/*.json", identified=True)
    parted = split_stats(prepare.split_pairs(materialise(clean.clean(rows.withColumn(
        "dataset", tables.dataset_name(F.col("file"))).withColumn("sample_id", F.concat_ws(":", "file", "line_no"))), "plain"), 0.1))
    return parted


def split_stats(parted):
    return parted.groupBy("dataset").agg(F.count("*").alias("rows"), F.count_if(F.col("split") == "validation").alias("held"),
                                         F.sum(F.length("target")).alias("chars"))


@query
def line_numbers(spark, folder):
    """The number of every line in the files of each dataset, written in order by many tasks, and what the line holds."""
    path = new_path(spark, "ordered")
    pairs = fx.table(spark, folder, "documents").selectExpr("source AS dataset", "doc_id AS sample_id", "lang AS input", "text AS target")
    tables.write_pairs_jsonl(pairs, path, order="sample_id")
    numbered = lines.with_line_no(spark, f"{path}/*/*.json").withColumn("dataset", tables.dataset_name(F.col("file")))
    return lines.across_files(numbered, "dataset").select(
        "dataset", "line_no", "file_lines",
        F.try_variant_get(F.try_parse_json("value"), "$.sample_id", "bigint").alias("sample_id"))


@query
def eval_head_lines(spark, folder):
    """Whether the head of every file is its first lines, and as many as asked for."""
    numbered = lines.with_line_no(spark, f"{_written(spark, folder)}/*/*.json")
    head = evaluate.head_lines(numbered, 0.3).groupBy("file").agg(
        F.count("*").alias("n"), F.max("line_no").alias("high"), F.max("file_lines").alias("told"))
    right = (F.col("n") == F.col("high")) & (
        F.col("n") == F.greatest(F.lit(1), F.floor(F.col("told") * F.lit(0.3).cast("double"))))
    return head.groupBy(tables.dataset_name(F.col("file")).alias("dataset")).agg(
        F.sum("told").alias("lines"), F.bool_and(right).alias("cut"))


@query
def gate_files(spark, folder):
    accepted, rejected = files.gate_files(fx.uploads(spark, folder), fixed.MAX_FILE_BYTES)
    return accepted.select("page_id", "safe_name", "collides", F.lit("").alias("error_message")).unionByName(
        rejected.select("page_id", F.lit("").alias("safe_name"), F.lit(False).alias("collides"), "error_message"))


@query
def folder_inventory(spark, folder):
    listed = files.folder_inventory(files.list_files(spark, _written(spark, folder)), "src3")
    return listed.select("kind", "name", "selected", (F.col("size") > 0).alias("filled"))


def _inventory_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as a pair file per source and suppliers as model files and reports per nation."""
    sources = fx.table(spark, folder, "documents").selectExpr("concat(source, '.jsonl') AS name", "lang AS value")
    models = fx.table(spark, folder, "supplier").selectExpr(
        """concat('model-', s_nationkey, CASE s_nationkey % 3 WHEN 0 THEN '.gguf' WHEN 1 THEN '.report.json' ELSE '.bin' END) AS name""",
        "s_name AS value")
    return sources, models


def _write_files(rows: DataFrame, path: str) -> None:
    rows.repartition("name").write.mode("append").partitionBy("name").text(path)


def _inventory_folder(spark: SparkSession, folder: str) -> str:
    path = new_path(spark, "inventory")
    for root, rows in zip(("data", "models"), _inventory_rows(spark, folder), strict=True):
        _write_files(rows, f"{path}/{root}")
    return path


def _by_folder(listed: DataFrame) -> DataFrame:
    """Spark names the files it writes itself: the folder's name stands for the file's here."""
    return listed.withColumn("name", unescape(F.regexp_extract("path", r"/name=([^/]+)/", 1)))


@query
def artifacts(spark, folder):
    listed = _by_folder(files.list_files(spark, f"{_inventory_folder(spark, folder)}/models"))
    return files.artifact_inventory(listed).groupBy("kind", "name", "url").agg(F.sum("size").alias("size"))


@query
def file_inventory(spark, folder):
    path = _inventory_folder(spark, folder)
    datasets = files.dataset_inventory(_by_folder(files.list_files(spark, f"{path}/data")), "../data/src3.jsonl")
    models = files.artifact_inventory(_by_folder(files.list_files(spark, f"{path}/models")))
    return datasets.unionByName(models).groupBy("kind", "name", "selected", "url").agg(F.sum("size").alias("size"))


@query
def inspect_datasets(spark, folder):
    each = tables.inspect_each(fx.table(spark, folder, "documents"), ["source"], "doc_id")
    sample = F.try_parse_json("sample")
    return each.select(
        "source", F.array_join("schema", ",").alias("columns"),
        F.try_variant_get(sample, "$.doc_id", "bigint").alias("first_id"),
        F.try_variant_get(sample, "$.text", "string").alias("first_text"))


@query
def inspect_first(spark, folder):
    return tables.inspect(fx.table(spark, folder, "documents").orderBy("doc_id")).select(
        F.array_join("schema", ",").alias("columns"), F.get_json_object("sample", "$.doc_id").cast("bigint").alias("first_id"),
        F.get_json_object("sample", "$.text").alias("first_text"))


@query
def report_round_trip(spark, folder):
    scored = evaluate.score_exact(fx.samples(spark, folder)).filter("output IS NOT NULL")
    path = new_path(spark, "report")
    tables.write_report(evaluate.accuracy_report(scored), scored, path)
    listed = spark.read.parquet(f"{path}/samples").groupBy("model", "quantization").agg(
        F.count("*").alias("listed"))
    return spark.read.json(f"{path}/summary-json").join(listed, ["model", "quantization"]).select(
        "model", "quantization", F.round("accuracy", 6).alias("accuracy"), "total", "correct", "listed")


# --- normalising ------------------------------------------------------------------------------


@query
def normalize_instruction(spark, folder):
    return normalize.keep_valid(normalize.normalize_pairs(fx.instructions(spark, folder)))


@query
def normalize_act(spark, folder):
    raw = fx.table(spark, folder, "documents").selectExpr("doc_id", "source AS act", "text AS prompt")
    return normalize.keep_valid(normalize.normalize_pairs(raw))


@query
def normalize_response(spark, folder):
    raw = fx.table(spark, folder, "documents").selectExpr(
        "doc_id", "concat(lang, ': ', source) AS prompt", "text AS response")
    return normalize.keep_valid(normalize.normalize_pairs(raw))


@query
def normalize_mixed_json(spark, folder):
    return normalize.normalize_json(fx.mixed_json(spark, folder), "raw", ["doc_id"])


@query
def import_stats(spark, folder):
    return normalize.import_stats(
        normalize.normalize_pairs(fx.instructions(spark, folder)), ["dataset"])


@query
def transform_sql(spark, folder):
    return normalize.transform_sql(
        fx.table(spark, folder, "documents"), "concat(lang, '/', source)",
        "CASE WHEN lang <> 'es' THEN text END", ["doc_id"])


@query
def transform_rows(spark, folder):
    def transform(row):
        if row["lang"] == "es":
            return None
        if row["n_chars"] < 500:
            raise ValueError("too short")
        return {"input": f"{row['lang']}/{row['source']}", "target": row["text"]}

    made = normalize.transform_rows(fx.table(spark, folder, "documents"), transform, ["doc_id"])
    return made.withColumn("error", F.coalesce("error", F.lit("")))


@query
def chat_pairs(spark, folder):
    return normalize.chat_to_pairs(fx.table(spark, folder, "conversations"))


@query
def validate_requests(spark, folder):
    accepted, rejected = requests.validate_requests(fx.requests(spark, folder), max_count=fixed.MAX_VARIATIONS)
    columns = ["page_id", "split", "model", "quantization", F.round("limit", 6).alias("limit"),
               "sharpness", "count"]
    none = F.lit("")
    return accepted.select(*columns, none.alias("error_code"), none.alias("error_message")).unionByName(
        rejected.select(*columns, "error_code", "error_message"))


@query
def log_text(spark, folder):
    return fx.table(spark, folder, "documents").select(
        "doc_id", sanitize_for_log(F.col("text"), fixed.LOG_TEXT_LENGTH).alias("line"))


# --- cleaning ---------------------------------------------------------------------------------


@query
def dedupe_pairs(spark, folder):
    return clean.dedupe_pairs(fx.gappy_pairs(spark, folder))


@query
def drop_blank(spark, folder):
    return clean.drop_blank(fx.gappy_pairs(spark, folder))


@query
def clean_pairs(spark, folder):
    return clean.clean(fx.gappy_pairs(spark, folder))


@query
def clean_stats(spark, folder):
    return clean.clean_stats(fx.gappy_pairs(spark, folder))


# --- preparing --------------------------------------------------------------------------------


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.split_pairs(fx.pairs(spark, folder), 0.1)


@query
def split_exact(spark, folder):
    return _split(spark, folder).select("dataset", "sample_id", "split")


@query
def rendered_prompts(spark, folder):
    return prepare.render_prompt(fx.pairs(spark, folder), "</s>").select("sample_id", "prompt", "text")


def _token_stats(tokens: DataFrame) -> DataFrame:
    def total(column: str):
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return tokens.select(
        "sample_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("n_trainable").cast("bigint").alias("n_trainable"), "dead", "truncated",
        total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))


@query
def token_mask_stats(spark, folder):
    return _token_stats(prepare.tokenize_and_mask(fx.pairs(spark, folder), max_len=256))


@query
def loaded_tokenizer_stats(spark, folder):
    def load():
        return lambda texts: [list(text.encode()) for text in texts]

    return _token_stats(prepare.tokenize_and_mask(
        fx.pairs(spark, folder), prepare.LoadedTokenizer(load, "\x00", 0), max_len=4096))


@query
def batch_padding(spark, folder):
    tokens = prepare.tokenize_and_mask(fx.pairs(spark, folder), max_len=256)
    batches = prepare.make_batches(tokens, 4, pad_id=0)

    def cells(column: str, wanted=None):
        def row(r):
            return F.size(F.filter(r, lambda x: x != wanted) if wanted is not None else r)
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda a, r: a + row(r))

    return batches.select(
        "dataset", "batch_id", F.col("batch_rows").cast("bigint").alias("batch_rows"),
        F.col("max_len").cast("bigint").alias("max_len"),
        F.array_join("sample_ids", ",").alias("members"),
        cells("input_ids").alias("cells"), cells("labels", -100).alias("trainable"))


@query
def training_plan(spark, folder):
    return prepare.plan_training(_split(spark, folder), 4, accumulate=2, epochs=3, warmup=50)


@query
def rule_dataset(spark, folder):
    return rules.build_rule_dataset(fx.rules(spark, folder))


# --- rules ------------------------------------------------------------------------------------


def _fold(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    log = fx.changes(fx.table(spark, folder, "events"))
    return rules.apply_rule_changes(spark.createDataFrame([], rules.RULE_SCHEMA), log)


def _folded(rules_: DataFrame) -> DataFrame:
    return rules_.select(
        "rule_ord", "id", "trigger", "response", "enabled", F.col("match.type").alias("match_type"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query
def rule_fold(spark, folder):
    return _folded(_fold(spark, folder)[0])


@query
def rule_fold_rejects(spark, folder):
    return _fold(spark, folder)[1].select("seq", "op", "id", "error_code")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return fx.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("text").alias("input"))


@query
def match_exact(spark, folder):
    return rules.match_exact(_messages(spark, folder), fx.rules(spark, folder)).drop("input")


@query
def match_regex(spark, folder):
    return rules.match_regex(_messages(spark, folder), fx.rules(spark, folder))[0].drop("input")


@query
def match_regex_rejects(spark, folder):
    """Of rules of which two thirds do not compile, those; the supplier names are the patterns."""
    made = fx.table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS rule_ord", "concat('regex-', s_suppkey) AS id",
        "concat(s_name, CASE s_suppkey % 3 WHEN 0 THEN '(' WHEN 1 THEN '[a' ELSE '' END) AS trigger",
        "named_struct('type', 'regex', 'case_insensitive', false, 'normalize_ws', false) AS match",
        "'answer' AS response", "true AS enabled")
    return rules.match_regex(_messages(spark, folder), made)[1].drop("error_message")


@query
def resolve_rules(spark, folder):
    return rules.resolve(_messages(spark, folder), fx.rules(spark, folder))[0].drop("input")


@query
def route_chats(spark, folder):
    routed = rules.route_chats(fx.table(spark, folder, "conversations"), fx.rules(spark, folder))
    return routed.select(
        "conv_id", "route", "matched_id", "input", F.col("envelope.id").alias("reply_id"),
        F.col("envelope.choices")[0]["message"]["content"].alias("content"))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every message as a chat of its own; those of turn 3 have no messages."""
    return fx.table(spark, folder, "conversations").selectExpr(
        "concat(conv_id, '-', turn) AS conv_id",
        """CASE WHEN turn <> 3 THEN array(named_struct('role', 'system', 'content', 'be brief'),
                                         named_struct('role', role, 'content', text)) END AS messages""")


def _chat_model(refusal=completion.ModelError):
    def call(prompt, temperature, timeout):
        system, last = json.loads(prompt)
        if "z" in last["content"]:
            raise refusal(429, "busy")
        return f"{system['content']}: {last['role']} {last['content']}"
    return call


def _answers(answered: DataFrame) -> DataFrame:
    return answered.select(
        "conv_id", "route", "matched_id", "status", F.col("envelope.id").alias("reply_id"), F.col("envelope.model").alias("model"),
        F.col("envelope.choices")[0]["message"]["content"].alias("content"), F.col("error.code").alias("error_code"),
        F.col("error.message").alias("error_message"))


@query
def answer_chats(spark, folder):
    """Chats answered by rules and by a stub model, of which it refuses some."""
    return _answers(chats.answer_chats(_requests(spark, folder), fx.rules(spark, folder), _chat_model))


# --- model calls ------------------------------------------------------------------------------


@query
def variation_prompts(spark, folder):
    seeds = fx.table(spark, folder, "documents").selectExpr(
        "doc_id", "source AS seed_input", "text AS seed_output", "CAST(n_chars AS int) AS count")
    return completion.variation_prompts(seeds, fixed.MAX_VARIATIONS)[0].select("doc_id", "count", "prompt")


@query
def variation_rows(spark, folder):
    replies = fx.table(spark, folder, "documents").selectExpr("doc_id", """
        CASE WHEN lang = 'es' THEN 'I cannot do that'
             ELSE concat('```json\\n[', to_json(struct(source AS input, text AS target)),
                         ', {"input": "', lang, '"}]\\n```') END AS reply""")
    rows, rejected = completion.parse_variations(replies, ["doc_id"])
    return rows.withColumn("error_code", F.lit("")).unionByName(rejected.select(
        "doc_id", F.lit(None).cast("int").alias("variation"), F.lit(None).cast("string").alias("input"),
        F.lit(None).cast("string").alias("target"), "error_code"))


@query
def model_calls(spark, folder):
    def client():
        def call(prompt, temperature, timeout):
            if prompt.startswith("fr"):
                raise TimeoutError("no answer")
            return f"{len(prompt)} at {temperature}: {prompt}"
        return call

    asked = fx.table(spark, folder, "documents").select(
        "doc_id", F.concat_ws(" ", "lang", "text").alias("prompt"))
    done = completion.complete_once(asked, ["doc_id"], "prompt", client, temperature=0.5)
    return done.select("doc_id", "reply", "error")


@query
def fenced_text(spark, folder):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```python "), F.col("lang"), F.lit("``` \n"))
    return fx.table(spark, folder, "documents").select("doc_id", strip_fences(fenced).alias("text"))


# --- evaluation -------------------------------------------------------------------------------


@query
def eval_head(spark, folder):
    return evaluate.head_fraction(fx.pairs(spark, folder), 0.3, ("dataset",), "sample_id").select(
        "dataset", "sample_id")


@query
def finalize_predictions(spark, folder):
    reply = F.concat(F.lit(" "), F.col("text"), F.lit("Input: "), F.col("lang"))
    return fx.table(spark, folder, "documents").select(
        "doc_id", evaluate.finalize_prediction(reply).alias("output"))


@query
def score_exact(spark, folder):
    return evaluate.score_exact(fx.samples(spark, folder)).select("doc_id", "output", "correct")


def _accuracy(spark: SparkSession, folder: str) -> DataFrame:
    documents = fx.table(spark, folder, "documents").selectExpr(
        "doc_id", "source AS model", "lang AS quantization")
    unlabelled = documents.join(fx.table(spark, folder, "labels"), "doc_id", "left_anti")
    return evaluate.accuracy_report(
        evaluate.score_exact(fx.samples(spark, folder)), runs=documents, rejects=unlabelled)


@query
def accuracy_report(spark, folder):
    return _accuracy(spark, folder).withColumn("accuracy", F.round("accuracy", 6))


@query
def judge_prompts(spark, folder):
    scored = evaluate.score_exact(fx.samples(spark, folder)).filter("output IS NOT NULL")
    return evaluate.judge_prompts(scored).select("doc_id", "prompt")


@query
def parse_judgments(spark, folder):
    return evaluate.parse_judgments(fx.judge_replies(spark, folder)).select(
        "doc_id", F.round("score", 6).alias("score"), "reason", "failed", "out_of_range")


@query
def judge_report(spark, folder):
    judged = evaluate.parse_judgments(fx.judge_replies(spark, folder))
    return evaluate.judge_report(judged, _accuracy(spark, folder)).select(
        "model", "quantization", "sharpness", F.round("average_score", 6).alias("average_score"),
        F.round("static_accuracy", 6).alias("static_accuracy"))


@query
def import_job(spark, folder):
    """What an import counts next to what it writes, per shape of the source."""
    path = new_path(spark, "imports")
    sources = {
        "demo/instruct": fx.instructions(spark, folder),
        "demo/persona": fx.table(spark, folder, "documents").selectExpr("source AS act", "text AS prompt"),
    }
    told = [(repo, *jobs.import_dataset(raw, repo, path).values()) for repo, raw in sources.items()]
    counts = spark.createDataFrame(told, "repo string, filename string, count bigint, skipped bigint")
    rows, _ = lines.read_pairs_jsonl(spark, f"{path}/*/*.json")
    written = rows.groupBy(F.element_at(F.split("file", "/"), -2).alias("filename")).agg(
        F.count("*").alias("written"), F.sum(F.length("target")).alias("target_chars"))
    return counts.join(written, "filename")


@query
def judge_job(spark, folder):
    """Evaluation and judging of a stub model over the documents, written as test sets."""
    def model():
        return lambda prompt, temperature, timeout: prompt[len("Input: "):].split("\n")[0] + "\nInput: x"

    def judge():
        return lambda prompt, temperature, timeout: (
            '{"score": 9, "reason": "same"}' if 'Output: "de"' in prompt else "hm")

    path = new_path(spark, "test-sets")
    tests = fx.table(spark, folder, "documents").selectExpr(
        "source AS dataset", "lang AS input", "CASE WHEN source < 'src2' THEN lang ELSE text END AS target")
    tables.write_pairs_jsonl(tests, path)
    numbered = lines.with_line_no(spark, f"{path}/*/*.json")
    report, samples = jobs.evaluate_model(numbered, "demo", "f16", model)
    return jobs.judge_model(samples, report, judge, limit=1.0, sharpness=80)[0].select(
        "model", "quantization", "sharpness", "limit", F.round("average_score", 6).alias("average_score"),
        F.round("static_accuracy", 6).alias("static_accuracy"))


@query
def training_job(spark, folder):
    """Batches and val.jsonl of one published split, read back, per dataset."""
    path = new_path(spark, "training")
    jobs.training_job(fx.pairs(spark, folder), 0.1, 4, prepare.WhitespaceTokenizer(), path)
    batches, held = jobs.published_run(spark, path)
    trained = spark.read.parquet(batches).groupBy("dataset").agg(
        F.count("*").alias("batches"), F.sum(F.size("sample_ids")).alias("train"))
    rows, _ = lines.read_pairs_jsonl(spark, f"{held}/*/*.json")
    validation = rows.groupBy(tables.dataset_name(F.col("file")).alias("dataset")).agg(
        F.count("*").alias("validation"), F.sum(F.length("target")).alias("validation_chars"))
    return trained.join(validation, "dataset")


@query
def generate_job(spark, folder):
    """Variations that a stub model makes of every document, written and counted, read back next to the counts."""
    def model():
        def call(prompt, temperature, timeout):
            if 'Seed Input: "es"' in prompt:
                return "I cannot do that"
            return '```json\n[{"input": "a", "target": "' + str(len(prompt)) + '"}, {"input": "b", "target": "c"}]\n```'
        return call

    path = new_path(spark, "generated")
    seeds = fx.table(spark, folder, "documents").selectExpr("doc_id", "lang AS seed_input", "source AS seed_output", "CAST(doc_id % 60 AS int) AS count")
    told, rejects = jobs.generate_job(seeds, ["doc_id"], model, path, made=datetime.datetime(2024, 5, 6, 7, 8, 9, 10_000))
    rows, _ = lines.read_pairs_jsonl(spark, f"{path}/*/*.json")
    written = rows.groupBy("input").agg(F.count("*").alias("rows"))
    refused = rejects.groupBy(F.col("error_code").alias("input")).agg(F.count("*").alias("rows"))
    return written.unionByName(refused).select(F.lit(told["filename"]).alias("filename"), F.lit(told["count"]).alias("count"), "input", "rows")


# --- monitoring -------------------------------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return fx.table(spark, folder, "events")


def _log(events: DataFrame) -> DataFrame:
    return monitor.parse_log_stream(fx.log_lines(events))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({m: F.round(m, 9) for m in monitor.METRICS})


@query
def parse_logs(spark, folder):
    return _rounded(_log(_events(spark, folder)))


def _chunks(events: DataFrame) -> DataFrame:
    """The log as a process's output, cut within its lines: a chunk ends in the middle of each."""
    told = fx.log_lines(events).withColumn("half", F.floor(F.length("line") / 2).cast("int"))
    halves = F.array(
        F.struct((F.col("seq") * 2).alias("seq"), F.expr("substr(line, 1, half)").alias("data")),
        F.struct((F.col("seq") * 2 + 1).alias("seq"), F.expr("concat(substr(line, half + 1), '\n')").alias("data")))
    return told.select("run_id", "channel", F.explode(halves).alias("chunk")).select("run_id", "channel", "chunk.*")


def _parsed_lines(numbered: DataFrame) -> DataFrame:
    parsed = monitor.parse_log_stream(numbered.withColumn("seq", F.struct("channel", "line_no")))
    return _rounded(parsed).select("run_id", "seq.*", "kind", *monitor.METRICS, "step", "text")


@query
def log_chunks(spark, folder):
    """Output in chunks put together to lines and parsed."""
    return _parsed_lines(monitor.chunk_lines(_chunks(_events(spark, folder))))


@query
def latest_metrics(spark, folder):
    return _rounded(monitor.latest_metrics(_log(_events(spark, folder))))


@query
def metric_cards(spark, folder):
    return monitor.metric_cards(monitor.latest_metrics(_log(_events(spark, folder))))


@query
def recent_logs(spark, folder):
    return monitor.recent_logs(_log(_events(spark, folder))).select("run_id", "seq", "kind", "text")


@query
def file_sizes(spark, folder):
    return monitor.latest_file_sizes(fx.size_events(_events(spark, folder)))


@query
def run_status(spark, folder):
    return monitor.run_status(fx.status_events(_events(spark, folder)))


@query
def message_log(spark, folder):
    parsed = monitor.parse_messages(fx.messages(_events(spark, folder)))
    return monitor.log_messages(parsed).select(
        "run_id", "seq", "type", "text", F.round("loss", 9).alias("loss"), "step", "running", "pid", "code")


@query
def message_state(spark, folder):
    """Per run: its last status, metrics and file size, all from one log of messages."""
    parsed = monitor.parse_messages(fx.messages(_events(spark, folder)))
    status = monitor.run_status(monitor.status_messages(parsed)).select("run_id", "running", "pid", "code")
    metrics = monitor.latest_metrics(parsed).select("run_id", F.round("loss", 9).alias("loss"), "step")
    sizes = monitor.latest_file_sizes(monitor.size_messages(parsed)).select(
        F.substring_index("file", ".", 1).cast("bigint").alias("run_id"), "size")
    return status.join(metrics, "run_id", "full").join(sizes, "run_id", "full")


@query
def overlapping_runs(spark, folder):
    runs = _events(spark, folder).filter("event_type = 'signup'").selectExpr(
        "event_id AS run_id", "event_id AS started",
        "CASE WHEN value < 300 THEN event_id + CAST(floor(value / 20) AS bigint) END AS ended")
    return monitor.overlapping_runs(runs)


# --- the same as streams ----------------------------------------------------------------------


def _in_runs(rows: DataFrame, order: str, start: Callable[[DataFrame], StreamingQuery], runs: int = 5) -> None:
    """A stream over `rows` that is stopped and started again: run by run later rows arrive."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "arrived")
    least, most = rows.agg(F.min(order), F.max(order)).first()
    place = F.width_bucket(order, F.lit(least), F.lit(most + 1), F.lit(runs)) if least is not None else F.lit(1)
    for run in range(1, runs + 1):
        rows.filter(F.coalesce(place, F.lit(1)) == run).write.mode("append").parquet(path)
        start(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def _followed(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame], start, label: str) -> DataFrame:
    """What a stream over the events has appended in the end."""
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    _in_runs(_events(spark, folder), "event_id", lambda stream: start(make(stream), path, checkpoint, once=True))
    return spark.read.parquet(path)


@query
def stream_latest_metrics(spark, folder):
    return _rounded(monitor.latest_metrics(_followed(spark, folder, _log, stream_monitor.start_metrics, "metrics")))


@query
def stream_file_sizes(spark, folder):
    return monitor.latest_file_sizes(_followed(spark, folder, fx.size_events, stream_monitor.start_file_sizes, "sizes"))


@query
def stream_watched_sizes(spark, folder):
    """Files that are there at first do not count; those of later writes do, run by run."""
    sources, models = _inventory_rows(spark, folder)
    path, sizes, checkpoint = (new_path(spark, label) for label in ("watched", "watched-sizes", "watched-checkpoint"))
    for rows in (sources, models.filter("hash(value) % 2 = 0"), models.filter("hash(value) % 2 <> 0")):
        _write_files(rows, path)
        stream_monitor.start_watched_sizes(spark, path, sizes, checkpoint, once=True).awaitTermination()
    latest = monitor.latest_file_sizes(spark.read.parquet(sizes).withColumn("file", F.col("path")))
    listed = _by_folder(latest.select(F.col("file").alias("path"), "size", F.lit(None).cast("timestamp").alias("modified")))
    return files.artifact_inventory(listed).groupBy("kind", "name", "url").agg(F.sum("size").alias("size"))


@query
def stream_run_status(spark, folder):
    """The state of ended runs is dropped at once, while later events of theirs may still come."""
    return monitor.run_status(_followed(
        spark, folder, fx.status_events, partial(stream_monitor.start_status, keep_ms=0), "status"))


@query
def stream_recent_logs(spark, folder):
    return monitor.recent_logs(_followed(
        spark, folder, lambda e: _log(e).select("run_id", "seq", "kind", "text"), stream_monitor.start_recent_logs, "tail"))


@query
def stream_log_chunks(spark, folder):
    """The same as the chunks arrive; a run ends between the two halves of a line."""
    path, checkpoint = new_path(spark, "lines"), new_path(spark, "lines-checkpoint")
    chunks = _chunks(_events(spark, folder))
    _in_runs(chunks, "seq", lambda stream: start_newest(stream_lines.chunk_lines(stream), path, checkpoint, once=True), 3)
    return _parsed_lines(spark.read.parquet(path))


@query
def stream_rule_fold(spark, folder):
    table = BatchTable(spark, new_path(spark, "rules"), rules.RULE_SCHEMA, "id")
    rejects, checkpoint = new_path(spark, "rule-rejects"), new_path(spark, "rules-checkpoint")
    _in_runs(_events(spark, folder), "event_id", lambda stream: stream_rules.start_rule_changes(
        fx.changes(stream), table, rejects, checkpoint, once=True))
    return _folded(table.latest())


@query
def stream_routing(spark, folder):
    """Every message as a request of its own, routed as it arrives."""
    table = BatchTable(spark, new_path(spark, "rules"), rules.RULE_SCHEMA, "id")
    table.put(0, fx.rules(spark, folder))
    output, checkpoint = new_path(spark, "routing"), new_path(spark, "routing-checkpoint")
    asked = fx.table(spark, folder, "conversations").selectExpr(
        "conv_id AS chat", "concat(conv_id, '-', turn) AS conv_id",
        "array(named_struct('role', role, 'content', text)) AS messages")
    _in_runs(asked, "chat", lambda stream: stream_rules.start_routing(stream, table, output, checkpoint, once=True), 2)
    return spark.read.parquet(f"{output}/routed").select("conv_id", "route", "matched_id", "input")


@query
def stream_answers(spark, folder):
    """The same as they arrive, with a ledger that outlives the runs."""
    table = BatchTable(spark, new_path(spark, "rules"), rules.RULE_SCHEMA, "id")
    table.put(0, fx.rules(spark, folder))
    output, ledger, checkpoint = (new_path(spark, f"answers{suffix}") for suffix in ("", "-ledger", "-checkpoint"))
    asked = _requests(spark, folder).withColumn("chat", F.substring_index("conv_id", "-", 1).cast("bigint"))
    _in_runs(asked, "chat", lambda stream: stream_rules.start_answering(
        stream.drop("chat"), table, _chat_model, output, ledger, checkpoint, once=True), 2)
    return _answers(spark.read.parquet(output).drop("batch"))


# --- catalogue --------------------------------------------------------------------------------


@query
def model_search(spark, folder):
    catalog_ = fx.table(spark, folder, "part").selectExpr(
        "concat(p_name, ' ', p_partkey) AS id", "p_retailprice AS downloads", "p_type AS pipeline_tag")
    return catalog.search_models(catalog_, "Ring", "10", tag="PROMO").select("id", "downloads")


@query
def recent_models(spark, folder):
    return catalog.recent_models(_events(spark, folder).selectExpr(
        "user_id AS user", "event_id AS seq",
        "concat(event_type, '-', CAST(floor(value / 25) AS bigint)) AS model"))
