"""Requests and responses of model providers as one shape, and the events that are made of them.

Bodies come as JSON text. Each provider's fields are read with one from_json and mapped by column
expressions; nothing leaves the JVM. Streamed answers are put together from their chunks by a grouping.

Differences from what the providers' own streams leave out: chunks of usage alone count, tool calls keep
their order of appearance, and streamed arguments of tools are joined for every provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = "struct<text:string,type:string,thought:boolean,functionCall:struct<name:string,args:string>>"
_TOOL = "struct<type:string,name:string,description:string,parameters:string,input_schema:string,function:struct<name:string,description:string,parameters:string>,functionDeclarations:array<struct<name:string,description:string,parameters:string>>>"
_REQUEST = (
    f"model string, messages array<struct<role:string,content:string,tool_call_id:string,name:string>>, system string, contents array<struct<role:string,parts:array<{_PART}>>>, systemInstruction struct<parts:array<{_PART}>>, tools array<{_TOOL}>,"
    " functions array<struct<name:string,description:string,parameters:string>>, temperature double, max_tokens long, stream boolean, generationConfig struct<temperature:double,maxOutputTokens:long>, options struct<temperature:double,num_predict:long>"
)
_CALL = "struct<id:string,index:int,name:string,function:struct<name:string,arguments:string>>"
_RESPONSE = (
    f"choices array<struct<finish_reason:string,message:struct<content:string,tool_calls:array<{_CALL}>,function_call:struct<name:string,arguments:string>>,delta:struct<content:string,tool_calls:array<{_CALL}>>>>,"
    f" usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long,input_tokens:long,output_tokens:long>, stop_reason string, content array<struct<type:string,text:string,id:string,name:string,input:string>>,"
    f" candidates array<struct<finishReason:string,content:struct<parts:array<{_PART}>>>>, usageMetadata struct<promptTokenCount:long,candidatesTokenCount:long,totalTokenCount:long>,"
    f" message struct<content:string,tool_calls:array<{_CALL}>>, done boolean, done_reason string, prompt_eval_count long, eval_count long,"
    " type string, index int, delta struct<type:string,text:string,partial_json:string,stop_reason:string>, content_block struct<type:string,id:string,name:string>"
)
#: Providers that share the first one's shape, and finish reasons by provider.
LIKE_OPENAI = ("openai", "azure")
REASONS = {"anthropic": {"end_turn": "stop", "max_tokens": "length", "stop_sequence": "stop", "tool_use": "tool_calls"}, "google": {"STOP": "stop", "MAX_TOKENS": "length", "SAFETY": "content_filter", "RECITATION": "content_filter"}}


def _mapped(value: Column, names: dict[str, str]) -> Column:
    out = value
    for a, b in names.items():
        out = F.when(value == a, b).otherwise(out)
    return out


def _message(role: Column, content: Column) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(role.alias("role"), content.alias("content"), nothing.alias("tool_call_id"), nothing.alias("name"))


def _tool(name: Column, description: Column, parameters: Column) -> Column:
    return F.struct(F.coalesce(name, F.lit("")).alias("name"), description.alias("description"), parameters.alias("parameters"))


def _said(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")


def requests(rows: DataFrame, body: str = "body", provider: str = "provider") -> DataFrame:
    """rows with model, messages, tools, temperature, max_tokens and stream of each request; provider: openai, azure, anthropic, google or ollama."""
    r, who = F.from_json(body, _REQUEST), F.col(provider)
    b = lambda f: F.col("_r")[f]
    none = F.array().cast("array<struct<role:string,content:string,tool_call_id:string,name:string>>")
    messages = F.coalesce(b("messages"), none)
    blocks = F.from_json(b("system"), "array<struct<text:string>>")
    system = F.when(F.substring(F.ltrim(b("system")), 1, 1) == "[", _said(blocks)).otherwise(b("system"))
    google = F.transform(F.coalesce(b("contents"), F.array().cast(f"array<struct<role:string,parts:array<{_PART}>>>")), lambda c: _message(F.when(c["role"] == "model", "assistant").otherwise("user"), _said(c["parts"])))
    messages = F.when(
        who == "google", F.when(b("systemInstruction").isNotNull(), F.concat(F.array(_message(F.lit("system"), _said(b("systemInstruction")["parts"]))), google)).otherwise(google)
    ).otherwise(F.when((who == "anthropic") & (F.coalesce(system, F.lit("")) != ""), F.concat(F.array(_message(F.lit("system"), system)), messages)).otherwise(messages))
    no_tools = F.array().cast("array<struct<name:string,description:string,parameters:string>>")
    given = F.coalesce(b("tools"), F.array().cast(f"array<{_TOOL}>"))
    wrapped = F.transform(given, lambda t: F.when((t["type"] == "function") & t["function"].isNotNull(), _tool(t["function"]["name"], t["function"]["description"], t["function"]["parameters"])).otherwise(_tool(t["name"], t["description"], F.coalesce(t["parameters"], t["input_schema"]))))
    legacy = F.transform(F.coalesce(b("functions"), no_tools), lambda f: _tool(f["name"], f["description"], f["parameters"]))
    declared = F.flatten(F.transform(given, lambda t: F.transform(F.coalesce(t["functionDeclarations"], no_tools), lambda f: _tool(f["name"], f["description"], f["parameters"]))))
    tools = F.when(who == "google", declared).when(who.isin(*LIKE_OPENAI) & (F.size(wrapped) == 0), legacy).otherwise(wrapped)
    out = rows.withColumn("_r", r)
    return out.withColumns(
        {
            "model": F.coalesce(b("model"), F.lit("unknown")), "messages": messages, "tools": tools,
            "temperature": F.when(who == "google", b("generationConfig")["temperature"]).when(who == "ollama", b("options")["temperature"]).otherwise(b("temperature")),
            "max_tokens": F.when(who == "google", b("generationConfig")["maxOutputTokens"]).when(who == "ollama", b("options")["num_predict"]).otherwise(b("max_tokens")),
            "stream": F.when(who == "google", False).otherwise(F.coalesce(b("stream"), who == "ollama")),
        }
    ).drop("_r")


def _called(id_: Column, name: Column, arguments: Column) -> Column:
    return F.struct(F.coalesce(id_, F.lit("")).alias("id"), F.coalesce(name, F.lit("")).alias("name"), F.coalesce(arguments, F.lit("{}")).alias("arguments"))


def _usage(prompt: Column, completion: Column, total: Column) -> Column:
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"))


def responses(rows: DataFrame, body: str = "body", provider: str = "provider") -> DataFrame:
    """rows with response_text, finish_reason, tool_calls (id, name, arguments) and token_usage of each whole answer. A body without an answer gives nulls and no calls."""
    who = F.col(provider)
    b = lambda f: F.col("_r")[f]
    zero = lambda c: F.coalesce(c, F.lit(0))
    no_calls = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    first = F.try_element_at(b("choices"), F.lit(1))
    calls = F.transform(F.coalesce(first["message"]["tool_calls"], F.array().cast(f"array<{_CALL}>")), lambda t: _called(t["id"], t["function"]["name"], t["function"]["arguments"]))
    legacy = first["message"]["function_call"]
    calls = F.when((F.size(calls) == 0) & legacy.isNotNull(), F.array(_called(F.concat(F.lit("call_"), F.substring(F.sha2(F.coalesce(legacy["name"], F.lit("")), 256), 1, 8)), legacy["name"], legacy["arguments"]))).otherwise(calls)
    blocks = F.coalesce(b("content"), F.array().cast("array<struct<type:string,text:string,id:string,name:string,input:string>>"))
    parts = F.coalesce(F.try_element_at(b("candidates"), F.lit(1))["content"]["parts"], F.array().cast(f"array<{_PART}>"))
    spoken = F.filter(parts, lambda p: p["text"].isNotNull() & ~F.coalesce(p["thought"], F.lit(False)))
    asked = F.filter(parts, lambda p: p["functionCall"].isNotNull() & p["text"].isNull())
    last = lambda xs: F.try_element_at(xs, F.lit(-1))["text"]
    kinds = {
        "anthropic": (
            last(F.filter(blocks, lambda x: x["type"] == "text")), _mapped(b("stop_reason"), REASONS["anthropic"]), F.transform(F.filter(blocks, lambda x: x["type"] == "tool_use"), lambda x: _called(x["id"], x["name"], x["input"])),
            F.when(b("usage").isNotNull(), _usage(b("usage")["input_tokens"], b("usage")["output_tokens"], zero(b("usage")["input_tokens"]) + zero(b("usage")["output_tokens"]))),
        ),
        "google": (
            last(spoken), _mapped(F.try_element_at(b("candidates"), F.lit(1))["finishReason"], REASONS["google"]), F.transform(asked, lambda p: _called(F.concat(F.lit("call_"), F.coalesce(p["functionCall"]["name"], F.lit("fn"))), p["functionCall"]["name"], p["functionCall"]["args"])),
            F.when(b("usageMetadata").isNotNull() & (F.size(b("candidates")) > 0), _usage(b("usageMetadata")["promptTokenCount"], b("usageMetadata")["candidatesTokenCount"], b("usageMetadata")["totalTokenCount"])),
        ),
        "ollama": (
            b("message")["content"], F.when(b("done"), F.coalesce(b("done_reason"), F.lit("stop"))), F.transform(F.coalesce(b("message")["tool_calls"], F.array().cast(f"array<{_CALL}>")), lambda t, i: _called(F.concat(F.lit("call_"), F.coalesce(t["function"]["name"], F.lit("fn")), F.lit("_"), i.cast("string")), t["function"]["name"], t["function"]["arguments"])),
            F.when((zero(b("prompt_eval_count")) > 0) | (zero(b("eval_count")) > 0), _usage(b("prompt_eval_count"), b("eval_count"), zero(b("prompt_eval_count")) + zero(b("eval_count")))),
        ),
    }
    plain = (first["message"]["content"], first["finish_reason"], calls, F.when(b("usage").isNotNull() & (F.size(b("choices")) > 0), _usage(b("usage")["prompt_tokens"], b("usage")["completion_tokens"], b("usage")["total_tokens"])))
    pick = lambda i: F.coalesce(*[F.when(who == k, v[i]) for k, v in kinds.items()], F.when(who.isin(*LIKE_OPENAI), plain[i]))
    out = rows.withColumn("_r", F.from_json(body, _RESPONSE))
    return out.withColumns({"response_text": pick(0), "finish_reason": pick(1), "tool_calls": F.coalesce(pick(2), no_calls), "token_usage": pick(3)}).drop("_r")


def streamed(chunks: DataFrame, keys: tuple[str, ...] = ("run_id",), order: str = "place") -> DataFrame:
    """Answers put together from their chunks: keys, provider, response_text, finish_reason, tool_calls and token_usage.

    chunks: the keys, provider, the chunk's place in its stream, and data (JSON; "[DONE]" and what isn't JSON count as nothing). Texts and arguments are joined in order,
    the last finish reason and usage stand. A stream is one row's worth of text, so a group is bounded by one answer.
    """
    who = F.col("provider")
    b = lambda f: F.col("_r")[f]
    choice = F.try_element_at(b("choices"), F.lit(1))
    google = F.coalesce(F.try_element_at(b("candidates"), F.lit(1))["content"]["parts"], F.array().cast(f"array<{_PART}>"))
    text = (
        F.when(who == "anthropic", F.when(b("delta")["type"] == "text_delta", b("delta")["text"]))
        .when(who == "google", F.try_element_at(F.filter(google, lambda p: p["text"].isNotNull() & ~F.coalesce(p["thought"], F.lit(False))), F.lit(-1))["text"])
        .when(who == "ollama", b("message")["content"])
        .otherwise(choice["delta"]["content"])
    )
    reason = (
        F.when(who == "anthropic", _mapped(b("delta")["stop_reason"], REASONS["anthropic"])).when(who == "google", _mapped(F.try_element_at(b("candidates"), F.lit(1))["finishReason"], REASONS["google"]))
        .when(who == "ollama", F.when(b("done"), F.coalesce(b("done_reason"), F.lit("stop")))).otherwise(choice["finish_reason"])
    )
    usage = (
        F.when(who == "google", F.when(b("usageMetadata").isNotNull(), _usage(b("usageMetadata")["promptTokenCount"], b("usageMetadata")["candidatesTokenCount"], b("usageMetadata")["totalTokenCount"])))
        .when(who == "ollama", F.when(F.coalesce(b("prompt_eval_count"), b("eval_count")).isNotNull(), _usage(b("prompt_eval_count"), b("eval_count"), F.coalesce(b("prompt_eval_count"), F.lit(0)) + F.coalesce(b("eval_count"), F.lit(0)))))
        .otherwise(F.when(b("usage").isNotNull(), _usage(F.coalesce(b("usage")["prompt_tokens"], b("usage")["input_tokens"]), F.coalesce(b("usage")["completion_tokens"], b("usage")["output_tokens"]), b("usage")["total_tokens"])))
    )
    piece = lambda i, id_, name, arguments: F.struct(F.coalesce(i, F.lit(0)).alias("i"), id_.alias("id"), name.alias("name"), F.coalesce(arguments, F.lit("")).alias("arguments"))
    nothing = F.lit(None).cast("string")
    pieces = (
        F.when((who == "anthropic") & (b("content_block")["type"] == "tool_use"), F.array(piece(b("index"), b("content_block")["id"], b("content_block")["name"], nothing)))
        .when((who == "anthropic") & (b("delta")["type"] == "input_json_delta"), F.array(piece(b("index"), nothing, nothing, b("delta")["partial_json"])))
        .when(who == "google", F.transform(F.filter(google, lambda p: p["functionCall"].isNotNull()), lambda p: piece(F.lit(None).cast("int"), F.concat(F.lit("call_"), F.coalesce(p["functionCall"]["name"], F.lit("fn"))), p["functionCall"]["name"], p["functionCall"]["args"])))
        .otherwise(F.transform(choice["delta"]["tool_calls"], lambda t: piece(t["index"], t["id"], t["function"]["name"], t["function"]["arguments"])))
    )
    rows = chunks.withColumn("_r", F.from_json("data", _RESPONSE)).select(*keys, "provider", order, text.alias("text"), reason.alias("reason"), usage.alias("usage"), F.coalesce(pieces, F.array().cast("array<struct<i:int,id:string,name:string,arguments:string>>")).alias("pieces"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    out = rows.groupBy(*keys, "provider").agg(F.array_sort(F.collect_list(F.struct(order, "text", "pieces"))).alias("all"), latest("reason").alias("finish_reason"), latest("usage").alias("token_usage"))
    flat = F.flatten(F.transform("all", lambda x: x["pieces"]))
    order_of = F.array_distinct(F.transform(flat, lambda p: p["i"]))
    own = lambda i: F.filter(flat, lambda p: p["i"] == i)
    last = lambda i, f: F.coalesce(F.try_element_at(F.filter(F.transform(own(i), lambda p: p[f]), lambda v: v.isNotNull() & (v != "")), F.lit(-1)), F.lit(""))
    calls = F.transform(order_of, lambda i: F.struct(last(i, "id").alias("id"), last(i, "name").alias("name"), F.array_join(F.transform(own(i), lambda p: p["arguments"]), "").alias("arguments")))
    said = F.array_join(F.transform("all", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    return out.select(*keys, "provider", F.nullif(said, F.lit("")).alias("response_text"), "finish_reason", calls.alias("tool_calls"), "token_usage")


def _envelope(kind: str, payload: Column) -> list[Column]:
    """The fields of an event that isn't signed yet, from columns org_id, session_id, agent_id, provider, model, run_id, parent_run_id, sequence_number and timestamp_ns."""
    text = lambda v: F.lit(v).cast("string")
    who = F.concat_ws("|", "org_id", "session_id", F.col("sequence_number").cast("string"), F.lit(kind))
    parent = F.col("parent_run_id") if kind == "LLM_CALL_START" else text(None)
    return [
        F.concat(F.lit("ev_"), F.substring(F.sha2(who, 256), 1, 26)).alias("event_id"), text("1.0").alias("schema_version"), F.col("org_id"), F.col("session_id"), F.col("agent_id"), F.col("provider"), F.col("model"), text("proxy").alias("interception_layer"), F.col("run_id"), parent.alias("parent_run_id"),
        text(kind).alias("event_type"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"), text(None).alias("payload_hash"), F.array().cast("array<string>").alias("pii_detected"), text(None).alias("security"), F.col("timestamp_ns"), F.col("sequence_number"), text("").alias("previous_hash"), text("").alias("current_hash"),
    ]


def _fields(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def call_starts(rows: DataFrame) -> DataFrame:
    """LLM_CALL_START events from requests(). Ids are made of the event's place, so a run again gives the same ones. chain.signed() fills the hashes."""
    tools = F.transform("tools", lambda t: F.struct(F.when(t["name"] == "", "unknown").otherwise(t["name"]).alias("name"), t["description"].alias("description"), t["parameters"].alias("parameters")))
    asked = F.transform("messages", lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), m["content"].alias("content"), m["tool_call_id"].alias("tool_call_id"), m["name"].alias("name")))
    return rows.select(*_envelope("LLM_CALL_START", F.struct(asked.alias("messages"), tools.alias("tools_available"), "temperature", "max_tokens", "stream")))


def call_ends(rows: DataFrame) -> DataFrame:
    """LLM_CALL_END events from responses() or streamed(), with latency_ms and http_status."""
    return rows.select(*_envelope("LLM_CALL_END", _fields("response_text", "finish_reason", "tool_calls", "token_usage", "latency_ms", "http_status")))


def errors(rows: DataFrame) -> DataFrame:
    """SYSTEM_ERROR events from error_code, error_message and http_status."""
    return rows.select(*_envelope("SYSTEM_ERROR", _fields("error_code", "error_message", "provider", "http_status")))


def tool_starts(calls: DataFrame) -> DataFrame:
    """TOOL_CALL_START events: one for each call of an answer, numbered on from the answer's own number. calls: responses() rows."""
    each = calls.select("*", F.posexplode("tool_calls").alias("_i", "_call")).withColumn("sequence_number", F.col("sequence_number") + F.col("_i") + 1)
    return each.select(*_envelope("TOOL_CALL_START", F.struct(F.col("_call.name").alias("tool_name"), F.col("_call.id").alias("tool_call_id"), F.col("_call.arguments").alias("tool_input"))))


def tool_ends(rows: DataFrame) -> DataFrame:
    """TOOL_CALL_END events: one for each tool message of a request."""
    said = F.filter("messages", lambda m: m["role"] == "tool")
    each = rows.select("*", F.posexplode(said).alias("_i", "_m")).withColumn("sequence_number", F.col("sequence_number") + F.col("_i"))
    return each.select(*_envelope("TOOL_CALL_END", F.struct(F.col("_m.name").alias("tool_name"), F.col("_m.tool_call_id").alias("tool_call_id"), F.col("_m.content").alias("tool_output_masked"))))


def finishes(rows: DataFrame) -> DataFrame:
    """AGENT_FINISH events from final_output, total_llm_calls, total_tool_calls and session_duration_ms."""
    return rows.select(*_envelope("AGENT_FINISH", _fields("final_output", "total_llm_calls", "total_tool_calls", "session_duration_ms")))


def checkpoints(roots: DataFrame) -> DataFrame:
    """CHECKPOINT events from merkle_root, events_covered, from_sequence and to_sequence."""
    return roots.select(*_envelope("CHECKPOINT", _fields("merkle_root", "events_covered", "from_sequence", "to_sequence")))
