"""Chats answered to the end: by a rule if one matches, else by a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairworks.operators.completion import Client, complete_once
from pairworks.operators.rules import envelope, route_requests
from pairworks.plans.shared import materialise

RULE_MODEL, UPSTREAM_MODEL = "override-rules", "upstream"


def _error(code: str | Column, message: Column) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"))


def answer_chats(
    requests: DataFrame,
    rules: DataFrame,
    client_factory: Callable[[], Client],
    path: str | None = None,
    rule_model: str = RULE_MODEL,
    upstream_model: str = UPSTREAM_MODEL,
    id_prefix: str = "chatcmpl-",
    created: int = 0,
    **options,
) -> DataFrame:
    """conv_id, route, matched_id, status, envelope, error for chats as (conv_id, messages array<struct<role, content>>).

    The last message is matched against the rules. A chat without a match goes to the model with all
    its messages, as JSON, by way of the ledger at `path`: run again, with the same or other chats, no
    answered call is made twice. Every request has a row: an answer from either side comes in the same
    envelope with status 200; a failed call keeps the status that the model API gave, or has 500; a
    request without messages has the route 'rejected' and status 400.
    """
    numbered = materialise(requests.withColumn("_chat", F.monotonically_increasing_id()), "chats")
    routed, refused = route_requests(numbered.select(F.col("_chat").alias("conv_id"), "messages"), rules, rule_model, id_prefix, created)
    content = F.col("envelope.choices")[0]["message"]["content"]
    routed = materialise(routed.select(F.col("conv_id").alias("_chat"), "route", "matched_id", content.alias("response")), "routes")
    nothing = F.lit(None).cast("string")
    by_rule = routed.filter("route = 'rule'").select(
        "_chat", "route", "matched_id", F.lit(200).alias("status"), "response", F.lit(None).cast("struct<code: string, message: string>").alias("error"))
    upstream = numbered.join(routed.filter("route = 'upstream'").select("_chat"), "_chat", "left_semi")
    asked = upstream.select("_chat", "conv_id", F.to_json("messages").alias("prompt"))
    # The call is the chat and its messages; row numbers may be others in the next run.
    replies = complete_once(asked, ["conv_id"], "prompt", client_factory, path=path, **options)
    by_model = replies.select(
        "_chat", F.lit("upstream").alias("route"), nothing.alias("matched_id"), "status", F.col("reply").alias("response"),
        F.when(F.col("error").isNotNull(), _error("INTERNAL_ERROR", F.col("error"))).alias("error"))
    rejected = refused.select(
        F.col("conv_id").alias("_chat"), F.lit("rejected").alias("route"), nothing.alias("matched_id"),
        F.lit(400).alias("status"), nothing.alias("response"),
        _error(F.col("error_code"), F.col("error_message")).alias("error"))
    answers = by_model.unionByName(rejected).unionByName(by_rule)
    model = F.when(F.col("route") == "rule", rule_model).otherwise(upstream_model)
    return numbered.select("_chat", "conv_id").join(answers, "_chat").select(
        "conv_id", "route", "matched_id", "status",
        F.when(F.col("status") == 200, envelope(F.col("conv_id"), F.col("response"), model, id_prefix, created)).alias("envelope"),
        "error")
