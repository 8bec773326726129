"""Chat requests: messages as tokens, the note to the model, the way back, and translation between provider forms.

A request is a row with ``messages``: array<struct<role, content>>. All is row-local.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import kernel
from cloakframe.functions import native
from cloakframe.operators.guard import resolve_keys
from cloakframe.policy import Policy

# The note to the model, before and after the list of tokens.
NOTE_HEAD = "NOTE: The following tokens represent redacted sensitive information. Reference these exact tokens in your response — they will be reconstructed to the original values for the user.\n\n"
NOTE_TAIL = "\n\nIMPORTANT: Use the token markers (e.g., [[PII_0]]) directly in your response. Do NOT attempt to write the original values."


def tokenise(df: DataFrame, messages: str = "messages", policy: Policy | None = None, detectors: list | None = None) -> DataFrame:
    """A message that redaction changes becomes [[PII_k]], k in message order; ``tokens`` keeps the originals. Null contents stay.

    The contents of a row cross to Python as one array of strings and come back redacted.
    """
    p, dets = policy or Policy(), kernel.built_in() if detectors is None else detectors

    @F.arrow_udf(returnType="array<boolean>")
    def changed(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [bool(t) and kernel.redact(dets, p, t).text != t for t in x] for x in a.to_pylist()], pa.list_(pa.bool_()))

    flagged = df.withColumn("__flags", changed(F.transform(messages, lambda m: m["content"])))
    return apply_flags(flagged, messages, "__flags").drop("__flags")


def apply_flags(df: DataFrame, messages: str, flags: str) -> DataFrame:
    """Tokens for the flagged messages, as Catalyst expressions."""
    m, f = F.col(messages), F.col(flags)
    numbered = F.aggregate(
        F.zip_with(m, f, lambda x, y: F.struct(x.alias("m"), F.coalesce(y, F.lit(False)).alias("hit"))),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<role:string,content:string,token:string,original:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["n"] + x["hit"].cast("int")).alias("n"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        x["m"]["role"].alias("role"),
                        F.when(x["hit"], F.concat(F.lit("[[PII_"), acc["n"].cast("string"), F.lit("]]"))).otherwise(x["m"]["content"]).alias("content"),
                        F.when(x["hit"], F.concat(F.lit("[[PII_"), acc["n"].cast("string"), F.lit("]]"))).alias("token"),
                        F.when(x["hit"], x["m"]["content"]).alias("original"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    out = df.withColumn("__numbered", numbered)
    hits = F.filter("__numbered", lambda x: x["token"].isNotNull())
    return out.withColumn(messages, F.transform("__numbered", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).withColumn("tokens", F.map_from_entries(F.transform(hits, lambda x: F.struct(x["token"], x["original"])))).drop("__numbered")


def system_note(tokens: Column) -> Column:
    """The note that names the tokens, in their order; null without tokens."""
    listed = F.transform(F.array_sort(F.transform(F.map_entries(tokens), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))), lambda e: F.concat(e["key"], F.lit(" = redacted value ("), native.mask_original(e["value"]), F.lit(")")))
    return F.when(F.size(tokens) > 0, F.concat(F.lit(NOTE_HEAD), F.array_join(listed, "\n"), F.lit(NOTE_TAIL)))


def with_note(df: DataFrame, messages: str = "messages", tokens: str = "tokens") -> DataFrame:
    note = F.struct(F.lit("system").alias("role"), system_note(F.col(tokens)).alias("content"))
    return df.withColumn(messages, F.when(F.size(tokens) > 0, F.concat(F.array(note), F.col(messages))).otherwise(F.col(messages)))


def reconstruct(content: Column, tokens: Column) -> Column:
    """content with every token replaced by its original."""
    return F.aggregate(F.map_entries(tokens), content, lambda acc, e: F.replace(acc, e["key"], e["value"]))


# Provider names, their aliases, model rows, addresses and headers. Placeholders in braces stay as they are.
PROVIDERS = {
    "openai": dict(aliases=(), model="gpt-4", owner="openai", base="https://api.openai.com/v1", path="chat/completions"),
    "anthropic": dict(aliases=(), model="claude-3-sonnet-20240229", owner="anthropic", base="https://api.anthropic.com/v1", path="messages"),
    "gemini": dict(aliases=("google",), model="gemini-pro", owner="google", base="https://generativelanguage.googleapis.com/v1beta", path="models/{model}:generateContent"),
    "mistral": dict(aliases=("mistralai",), model="mistral-large-latest", owner="mistral", base="https://api.mistral.ai/v1", path="chat/completions"),
    "cohere": dict(aliases=(), model="command-r-plus", owner="cohere", base="https://api.cohere.com/v1", path="chat"),
    "azure": dict(aliases=("azure_openai",), model="gpt-4", owner="azure-openai", base="https://PLACEHOLDER.openai.azure.com", path="openai/deployments/{deployment_id}/chat/completions"),
    "bedrock": dict(aliases=("aws",), model="anthropic.claude-3-sonnet-20240229-v1:0", owner="aws-bedrock", base="https://bedrock-runtime.{region}.amazonaws.com", path="model/{model_id}/invoke"),
    "ollama": dict(aliases=("vllm",), model="llama3", owner="ollama", base="http://localhost:11434/v1", path="chat/completions"),
}
ALIASES = {a: k for k, v in PROVIDERS.items() for a in (k, *v["aliases"])}
DEFAULT_MAX_TOKENS = 4096


def headers(provider: str, key: str, api_version: str = "2024-02-01") -> dict[str, str]:
    h = {"Content-Type": "application/json"}
    if provider == "anthropic":
        h |= {"x-api-key": key, "anthropic-version": "2023-06-01"}
    elif provider == "gemini":
        h |= {"x-goog-api-key": key}
    elif provider == "azure":
        h |= {"api-key": key, "api-version": api_version}
    elif key or provider != "ollama":
        h |= {"Authorization": f"Bearer {key}"}
    if provider == "cohere":
        h |= {"Accept": "application/json"}
    if provider == "bedrock":
        h |= {"X-Amz-Target": "BedrockRuntime.InvokeModel"}
    return h


def route(df: DataFrame, configured: list[str], provider: str = "provider") -> DataFrame:
    """df with the lower-cased provider (openai if none), its URL, and status 404 with an error where it isn't configured. configured is broadcast: as many rows as providers."""
    spark = df.sparkSession
    rows = [(name, f"{PROVIDERS[ALIASES[name]]['base']}/{PROVIDERS[ALIASES[name]]['path']}") for name in configured if name in ALIASES]
    dim = spark.createDataFrame(rows, "__name string, url string")
    named = df.withColumn("__name", F.lower(F.coalesce(F.col(provider), F.lit("openai"))))
    return named.join(F.broadcast(dim), "__name", "left").withColumn("status", F.when(F.col("url").isNull(), 404)).withColumn("error", F.when(F.col("url").isNull(), F.concat(F.lit("Unknown provider: "), F.col("__name")))).withColumn(provider, F.col("__name")).drop("__name")


def models(spark, configured: list[str]) -> DataFrame:
    """A model row for each configured provider; unknown ones have a default row."""
    rows = []
    for name in configured:
        p = PROVIDERS.get(ALIASES.get(name, ""))
        rows.append((p["model"] if p else "default", "model", p["owner"] if p else name, name))
    return spark.createDataFrame(rows, "id string, object string, owned_by string, provider string")


def _role(m: Column) -> Column:
    return F.coalesce(m["role"], F.lit("user"))


def _content(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def translate_request(provider: str, df: DataFrame, out: str = "body") -> DataFrame:
    """The provider's request as JSON text, from model, max_tokens, temperature, top_p, stream and messages. Absent fields are null."""
    m = F.col("messages")
    plain = F.transform(m, lambda x: F.struct(_role(x).alias("role"), _content(x).alias("content")))
    said = F.filter(plain, lambda x: x["role"] != "system")
    system = F.filter(plain, lambda x: x["role"] == "system")
    limit = F.coalesce(F.col("max_tokens"), F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens")
    model, stream, heat, top = F.col("model").alias("model"), F.col("stream").alias("stream"), F.col("temperature").alias("temperature"), F.col("top_p").alias("top_p")
    last_system = F.try_element_at(system, F.lit(-1))["content"].alias("system")
    if provider == "anthropic":
        body = F.struct(model, limit, last_system, said.alias("messages"), stream)
    elif provider == "gemini":
        config = F.struct(F.col("max_tokens").alias("maxOutputTokens"), F.col("temperature").alias("temperature"), F.col("top_p").alias("topP"))
        some = F.coalesce(F.col("max_tokens").cast("double"), F.col("temperature").cast("double"), F.col("top_p").cast("double")).isNotNull()

        def parts(text: Column) -> Column:
            return F.array(F.struct(text.alias("text"))).alias("parts")

        body = F.struct(model, F.transform(said, lambda x: F.struct(x["role"].alias("role"), parts(x["content"]))).alias("contents"), F.when(some, config).alias("generationConfig"), F.when(F.size(system) > 0, F.struct(parts(F.get(system, 0)["content"]))).alias("systemInstruction"))
    elif provider == "cohere":
        body = F.struct(model, F.array_join(F.transform(plain, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n\n").alias("message"), F.col("max_tokens").alias("max_tokens"), heat, F.col("top_p").alias("p"))
    elif provider == "bedrock":
        body = F.struct(F.transform(said, lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["content"].alias("text"))).alias("content"))).alias("messages"), last_system, limit, heat, top)
    elif provider in ("mistral", "azure", "ollama"):
        body = F.struct(model, m.alias("messages"), limit, heat, top, stream)
    elif provider == "openai":
        body = F.struct(model, m.alias("messages"), F.col("max_tokens").alias("max_tokens"), heat, top, stream)
    else:
        raise ValueError(f"unknown provider {provider!r}")
    return df.withColumn(out, F.to_json(body))


_FORMS = {
    "anthropic": "content array<struct<type string, text string>>, stop_reason string",
    "bedrock": "content array<struct<type string, text string>>, stop_reason string",
    "gemini": "candidates array<struct<content struct<parts array<struct<text string>>>, finishReason string>>, usageMetadata struct<promptTokenCount int, candidatesTokenCount int, totalTokenCount int>",
    "cohere": "message struct<content struct<text string>>, stop_reason string",
    "openai": "choices array<struct<message struct<role string, content string>, finish_reason string>>, usage struct<prompt_tokens int, completion_tokens int, total_tokens int>",
}
RESPONSE = "struct<choices:array<struct<message:struct<role:string,content:string>,finish_reason:string>>,usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>>"


def translate_response(provider: str, response: Column) -> Column:
    """A provider's reply (JSON text) as struct<choices, usage>."""
    form = provider if provider in _FORMS else "openai"
    r = F.from_json(response, _FORMS[form])
    if form == "openai":
        return r.cast(RESPONSE)

    def choice(text: Column, finish: Column) -> Column:
        return F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"), finish.alias("finish_reason"))

    def finish(reason: Column, long: str) -> Column:
        return F.when(reason == long, "length").when(reason.isNotNull(), "stop")

    usage = F.lit(None).cast("struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>")
    if form == "gemini":
        choices = F.transform(r["candidates"], lambda c: choice(F.array_join(F.transform(c["content"]["parts"], lambda p: p["text"]), ""), finish(c["finishReason"], "MAX_TOKENS")))
        usage = F.when(r["usageMetadata"].isNotNull(), F.struct(r["usageMetadata"]["promptTokenCount"].alias("prompt_tokens"), r["usageMetadata"]["candidatesTokenCount"].alias("completion_tokens"), r["usageMetadata"]["totalTokenCount"].alias("total_tokens")))
    elif form == "cohere":
        choices = F.when(r["message"].isNotNull(), F.array(choice(r["message"]["content"]["text"], finish(r["stop_reason"], "MAX_TOKENS"))))
    else:
        text = F.array_join(F.transform(F.filter(r["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), "")
        choices = F.when(r["content"].isNotNull(), F.array(choice(text, finish(r["stop_reason"], "max_tokens"))))
    return F.struct(F.coalesce(choices, F.array()).alias("choices"), usage.alias("usage")).cast(RESPONSE)


def build_providers(config: dict[str, dict]) -> tuple[dict[str, str], list[str]]:
    """(key by provider, warnings) from {name: {"value": key} or {"env": variable}}. Providers that are unknown or have no key are left out."""
    keys, warnings = {}, []
    for name, entry in config.items():
        found = resolve_keys([entry], enabled=False)
        if not found:
            warnings.append(f"no API key for provider {name!r}, skipped")
        elif name not in ALIASES:
            warnings.append(f"unknown provider {name!r}, skipped")
        else:
            keys[name] = found[0]
    return keys, warnings


# What an answer says of its failure, and the kinds that counters know.
PARSE_ERROR, REQUEST_ERROR = "parse_error", "request_error"
PARSE_FAILED, REQUEST_FAILED = "Failed to parse provider response", "Provider request failed"


def exchange(df: DataFrame, responder, configured: list[str], provider: str = "provider", policy: Policy | None = None, detectors: list | None = None) -> DataFrame:
    """The whole way of requests to several providers: tokens, routing, each provider's form, the reply, and the originals put back.

    ``responder`` makes the reply column (text) from the columns of the provider and the body; a null reply is a failed request, one that isn't JSON
    a reply that can't be read. Adds body, reply, status (200, 404 for a provider that isn't configured, 502), error and error_kind.
    Only the fields of the request that a provider's form has are sent. All is row-local; one Arrow function detects.
    """
    sent = route(tokenise(df, policy=policy, detectors=detectors), configured, provider)
    known = sorted({name for name in configured if name in ALIASES})
    for name in known:
        sent = translate_request(ALIASES[name], sent, f"__body_{name}")
    sent = sent.withColumn("body", F.coalesce(*[F.when(F.col(provider) == name, F.col(f"__body_{name}")) for name in known], F.lit(None).cast("string")))
    got = sent.drop(*[f"__body_{name}" for name in known]).withColumn("__raw", F.when(F.col("status").isNull(), responder(F.col(provider), F.col("body"))))
    readable = F.try_parse_json("__raw").isNotNull()
    kind = F.when(F.col("status") == 404, F.lit(None).cast("string")).when(F.col("__raw").isNull(), REQUEST_ERROR).when(~readable, PARSE_ERROR)
    got = got.withColumn("error_kind", kind)
    fine = F.col("error_kind").isNull() & F.col("status").isNull()
    reply = F.coalesce(*[F.when(fine & (F.col(provider) == name), translate_response(ALIASES[name], F.col("__raw"))) for name in known], F.lit(None).cast(RESPONSE))
    back = F.transform("reply.choices", lambda c: c.withField("message", c["message"].withField("content", reconstruct(c["message"]["content"], F.col("tokens")))))
    got = got.withColumn("reply", reply).withColumn("reply", F.when(F.col("reply").isNotNull(), F.col("reply").withField("choices", back)))
    error = F.when(F.col("error_kind") == PARSE_ERROR, PARSE_FAILED).when(F.col("error_kind") == REQUEST_ERROR, REQUEST_FAILED).otherwise(F.col("error"))
    return got.withColumn("error", error).withColumn("status", F.coalesce("status", F.when(F.col("error_kind").isNotNull(), 502).otherwise(200))).drop("__raw")


def complete(df: DataFrame, responder, provider: str = "openai", policy: Policy | None = None, note: bool = False) -> DataFrame:
    """The whole way of a request: tokens, the provider's form, ``responder`` (a function from the body column to the reply column), and back."""
    sent = tokenise(df, policy=policy)
    sent = translate_request(provider, with_note(sent) if note else sent)
    got = sent.withColumn("reply", translate_response(provider, responder(F.col("body"))))
    back = F.transform("reply.choices", lambda c: c.withField("message", c["message"].withField("content", reconstruct(c["message"]["content"], F.col("tokens")))))
    return got.withColumn("reply", F.col("reply").withField("choices", back)).withColumn("status", F.when(F.size("reply.choices") > 0, 200).otherwise(502))


def echo(body: Column) -> Column:
    """A responder for tests: repeats the last message of an openai body."""
    last = F.try_element_at(F.from_json(body, "messages array<struct<role string, content string>>")["messages"], F.lit(-1))["content"]
    return F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), last.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices")))
