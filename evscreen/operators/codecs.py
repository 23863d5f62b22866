"""Requests to rating services and their answers on the wire, as Columns.

A request is a row (custom_id, system, user, size) for a single record or a
packed chunk of them. body() is what a live call sends, line() a row of a batch
job's JSONL file; answered() and returned() read what comes back. Nothing here
calls a service.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from evscreen.errors import InputError

#: How services take a chat: the body's shape, the name of its token limit, and what wraps it in a batch row.
CHAT = {"openai": "max_completion_tokens", "mistral": "max_tokens", "fireworks": "max_tokens", "together": "max_tokens", "openmodel": "max_tokens"}
URL = "/v1/chat/completions"
TOP_LOGPROBS, TOKENS_A_RECORD = 5, 16


@dataclass(frozen=True)
class Options:
    """What a service is asked with; log probabilities are asked for single records only."""

    model: str
    temperature: float = 0.0
    max_tokens: int = 8
    logprobs: bool = False


def _limit(options: Options, size: Column) -> Column:
    return F.when(size > 1, F.greatest(F.lit(options.max_tokens), size.cast("int") * TOKENS_A_RECORD)).otherwise(F.lit(options.max_tokens))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _body(vendor: str, options: Options, system: Column, user: Column, size: Column) -> Column:
    limit, warmth = _limit(options, size), F.lit(float(options.temperature)).alias("temperature")
    asked = F.when(size == 1, F.lit(True)) if options.logprobs else F.lit(None).cast("boolean")  # nulls are left out
    most = F.when(asked, F.lit(TOP_LOGPROBS))
    if vendor == "anthropic":
        return F.struct(F.lit(options.model).alias("model"), limit.alias("max_tokens"), warmth, system.alias("system"), F.array(_message("user", user)).alias("messages"))
    if vendor == "google":
        part = lambda c: F.struct(F.array(F.struct(c.alias("text"))).alias("parts"))
        ways = F.struct(limit.alias("max_output_tokens"), warmth, asked.alias("response_logprobs"), most.alias("logprobs"))
        return F.struct(F.array(part(user)).alias("contents"), part(system).alias("system_instruction"), ways.alias("generation_config"))
    if vendor not in CHAT:
        raise InputError(f"unknown service {vendor}")
    return F.struct(F.lit(options.model).alias("model"), limit.alias(CHAT[vendor]), warmth, F.array(_message("system", system), _message("user", user)).alias("messages"), asked.alias("logprobs"), most.alias("top_logprobs"))


def body(vendor: str, options: Options, system: Column, user: Column, size: Column) -> Column:
    """The JSON of a live request."""
    return F.to_json(_body(vendor, options, system, user, size))


def line(vendor: str, options: Options, custom_id: Column, system: Column, user: Column, size: Column) -> Column:
    """A row of a batch job's file. Rows for fireworks carry no id: their answers come in the same order."""
    own = _body(vendor, options, system, user, size)
    if vendor == "anthropic":
        return F.to_json(F.struct(custom_id.alias("custom_id"), own.alias("params")))
    if vendor == "google":
        return F.to_json(F.struct(custom_id.alias("key"), own.alias("request")))
    if vendor == "mistral":
        return F.to_json(F.struct(custom_id.alias("custom_id"), own.alias("body")))
    if vendor == "fireworks":
        return F.to_json(F.struct(own["messages"].alias("messages")))
    if vendor == "openmodel":
        raise InputError("openmodel has no batch service")
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(URL).alias("url"), own.alias("body")))


def _texts(parts: Column, only: str | None = None) -> Column:
    """The texts of a JSON array of parts, joined."""
    own = F.from_json(parts, "array<struct<type:string,text:string>>")
    own = F.filter(own, lambda p: p["type"] == only) if only else own
    return F.array_join(F.transform(own, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def answered(vendor: str, reply: Column, at: str = "$") -> Column:
    """struct(text, model, logprobs) of a live answer's JSON, which lies at a path of reply."""
    get = lambda path: F.get_json_object(reply, f"{at}{path}")
    none = F.lit(None).cast("string")
    if vendor == "anthropic":
        text, model, probable = _texts(get(".content"), "text"), get(".model"), none
    elif vendor == "google":
        text, model = F.coalesce(get(".text"), _texts(get(".candidates[0].content.parts"))), none
        probable = F.coalesce(get(".candidates[0].logprobs_result"), get(".candidates[0].logprobsResult"))
    else:
        text, model, probable = get(".choices[0].message.content"), get(".model"), get(".choices[0].logprobs")
        probable = none if vendor == "openmodel" else probable
    return F.struct(text.alias("text"), model.alias("model"), probable.alias("logprobs"))


def returned(vendor: str, reply: Column, place: Column | None = None) -> Column:
    """struct(custom_id, text, model, logprobs) of a row of a batch job's results; text is null where the request failed.

    Answers of fireworks are told by place, their row's number in the file, and have it as custom_id.
    """
    get = lambda path: F.get_json_object(reply, path)
    if vendor == "fireworks":
        own = F.filter(F.from_json(get("$.messages"), "array<struct<role:string,content:string>>"), lambda m: m["role"] == "assistant")
        text = F.nullif(F.try_element_at(own, F.lit(-1))["content"], F.lit(""))
        return F.struct(place.cast("string").alias("custom_id"), text.alias("text"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("logprobs"))
    if vendor == "anthropic":
        key, at, good = "$.custom_id", "$.result.message", get("$.result.type") == "succeeded"
    elif vendor == "google":
        key, at, good = "$.key", "$.response", get("$.response").isNotNull()
    else:
        key, at, good = "$.custom_id", "$.response.body", get("$.error").isNull()
    own = answered(vendor, reply, at)
    return F.struct(get(key).alias("custom_id"), *(F.when(good, own[c]).alias(c) for c in ("text", "model", "logprobs")))


def answer(vendor: str, custom_id: Column, text: Column, model: str) -> Column:
    """A row of results as the service would write it: for rehearsals without one."""
    if vendor == "fireworks":
        return F.to_json(F.struct(F.array(_message("user", F.lit("")), _message("assistant", text)).alias("messages")))
    if vendor == "anthropic":
        message = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
        return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(F.lit("succeeded").alias("type"), message.alias("message")).alias("result")))
    if vendor == "google":
        content = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
        return F.to_json(F.struct(custom_id.alias("key"), F.struct(F.array(F.struct(content.alias("content"))).alias("candidates")).alias("response")))
    own = F.struct(F.lit(model).alias("model"), F.array(F.struct(_message("assistant", text).alias("message"))).alias("choices"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(own.alias("body")).alias("response")))
