"""Operators over conversations (conv_id, turn, role, text) and over events of streamed answers.

A conversation, and a stream, is worked out within one group: they are as long as people talk.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, LATER = "First question: {REQUEST}", "Next question: {REQUEST}"
#: Where the text of an event is looked for, by a server and by a client, and its thinking.
SERVER = ("message.delta.content", "message.content", "delta.content", "content", "response")
CLIENT = ("message.content", "message.delta.content", "delta.content", "response", "content")
THINKING = ("message.thinking", "message.delta.thinking", "delta.thinking", "thinking")


def templated(template: Column, request: Column) -> Column:
    """The template with the request in its place; the bare request without a template or a place in it."""
    return F.when(template.contains("{REQUEST}"), F.replace(template, F.lit("{REQUEST}"), request)).otherwise(request)


def last_requests(turns: DataFrame, first: str = FIRST, later: str = LATER, unfiltered: tuple[str, str] | None = None, variables: dict[str, str] | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_user, template, prompt): the last user message in the template that fits.

    ``variables``: FILTER=NONE takes the templates ``unfiltered``, PROMPT=NONE takes none (template
    0).  ``bodies`` (conv_id, body) are the raw requests of conversations without a user message;
    without one those have no row, or an empty prompt if they are among ``bodies`` with a null.
    """
    mode = {k: v.upper() for k, v in (variables or {}).items()}
    if mode.get("FILTER") == "NONE" and unfiltered:
        first, later = unfiltered
    user = turns.where("role = 'user' AND text IS NOT NULL")
    last = user.groupBy("conv_id").agg(F.count("*").alias("n_user"), F.max_by("text", "turn").alias("request"))
    if bodies is not None:
        raw = bodies.select("conv_id", F.col("body")).dropDuplicates(["conv_id"])
        last = last.join(raw, "conv_id", "full").select("conv_id", F.coalesce("n_user", F.lit(0)).alias("n_user"), F.coalesce("request", "body", F.lit("")).alias("request"))
    if mode.get("PROMPT") == "NONE":
        return last.select("conv_id", "n_user", F.lit(0).alias("template"), F.col("request").alias("prompt"))
    number = F.when(F.col("n_user") <= 1, 1).otherwise(2)
    prompt = templated(F.when(F.col("n_user") <= 1, F.lit(first)).otherwise(F.lit(later)), F.col("request"))
    return last.select("conv_id", "n_user", number.alias("template"), prompt.alias("prompt"))


def system_text(texts: dict[str, str], fun: str | None = None) -> str:
    """The system message: the variant that ``fun`` names, if there is one, else the plain one; stripped."""
    for name in ([f"system-{fun.upper()}"] if fun else []) + ["system"]:
        if name in texts:
            return texts[name].strip()
    return ""


def history(turns: DataFrame, system: str, prompts: DataFrame) -> DataFrame:
    """(conv_id, pos, role, content): a system message, unless it is empty, then user and assistant turns, the last user turn as its prompt.

    A conversation with a prompt and no user turn gets the prompt as one at its end.
    """
    kept = turns.where("role IN ('user', 'assistant')").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    last = Window.partitionBy("conv_id")
    kept = kept.withColumn("last", F.max(F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.col("turn"))).over(last))
    asked = prompts.select("conv_id", "prompt")
    both = kept.join(asked, "conv_id", "left")
    content = F.when(F.col("turn") == F.col("last"), F.coalesce("prompt", "text")).otherwise(F.col("text"))
    rows = both.select("conv_id", "turn", "role", content.alias("content"))
    alone = asked.join(kept.where("last IS NOT NULL").select("conv_id").distinct(), "conv_id", "left_anti")
    rows = rows.unionByName(alone.select("conv_id", F.lit((1 << 63) - 1).alias("turn"), F.lit("user").alias("role"), F.col("prompt").alias("content")))
    if system:
        rows = rows.unionByName(rows.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(system).alias("content")))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return rows.select("conv_id", pos.alias("pos"), "role", "content")


def augmented(messages: DataFrame, context: DataFrame, lead: str = "Context: ", reply: str = "Understood.") -> DataFrame:
    """``messages`` (conv_id, pos, role, content) with a user and an assistant turn that carry ``context`` (conv_id, text) at each end."""
    end = messages.groupBy("conv_id").agg(F.max("pos").alias("end")).join(context.select("conv_id", "text"), "conv_id")
    user = end.select("conv_id", (F.col("end") + 1).alias("pos"), F.lit("user").alias("role"), F.concat(F.lit(lead), F.coalesce("text", F.lit(""))).alias("content"))
    assistant = end.select("conv_id", (F.col("end") + 2).alias("pos"), F.lit("assistant").alias("role"), F.lit(reply).alias("content"))
    return messages.select("conv_id", "pos", "role", "content").unionByName(user).unionByName(assistant)


def commands(messages: DataFrame, text: str) -> DataFrame:
    """Messages that are slash commands, with cmd in lower case, its first two arguments, and whether everyone may give it."""
    parts = F.split(F.trim(F.substr(F.trim(text), F.lit(2))), r"\s+")
    out = messages.where(F.trim(F.col(text)).startswith("/"))
    cmd = F.lower(F.get(parts, F.lit(0)))
    return out.select("*", cmd.alias("cmd"), F.get(parts, F.lit(1)).alias("arg1"), F.get(parts, F.lit(2)).alias("arg2"), cmd.isin("help").alias("open"))


def variables(commands: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, name, value): what the /set commands leave set; the last for a name counts, and one without a value deletes it."""
    sets = commands.where((F.col("cmd") == "set") & F.col("arg1").isNotNull() & (F.col("arg1") != ""))
    # max_by ignores a row whose value is null unless it is wrapped
    last = sets.groupBy(*keys, F.col("arg1").alias("name")).agg(F.max_by(F.struct(F.nullif("arg2", F.lit("")).alias("v")), order).alias("last"))
    return last.where("last.v IS NOT NULL").select(*keys, "name", F.col("last.v").alias("value"))


def shown(variables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, listing): the variables as name=value in order of their names, joined by ';'."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    listing = F.array_join(F.transform(pairs, lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";")
    return variables.groupBy(*keys).agg(listing.alias("listing")) if keys else variables.agg(listing.alias("listing"))


def client_history(messages: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """User and assistant messages with content; the very last message of each is left out if it is a command."""
    last = F.max(order).over(Window.partitionBy(*keys))
    command = (F.col("__lectern_last") == F.col(order)) & F.trim(F.col(text)).startswith("/")
    kept = messages.withColumn("__lectern_last", last).where(F.col("role").isin("user", "assistant") & (F.col(text) != "") & ~command)
    return kept.drop("__lectern_last")


def delta(event: Column, paths: tuple[str, ...] = SERVER) -> Column:
    """The first text that an event's JSON has at one of the paths; null for none, or no JSON."""
    return F.coalesce(*(F.nullif(F.get_json_object(event, f"$.{p}"), F.lit("")) for p in paths))


def _called(event: Column) -> Column:
    calls = F.get_json_object(event, "$.message.tool_calls")
    return F.coalesce(calls.startswith("[") & ~calls.rlike(r"^\[\s*\]"), F.lit(False))


def answers(events: DataFrame, keys: list[str], order: str = "seq", paths: tuple[str, ...] = CLIENT) -> DataFrame:
    """(keys, answer, thinking, done): the deltas of each stream up to its end, in order.

    The first end after a tool call doesn't count.  Lines that aren't JSON are passed over, and so
    is an event that carries messages.  Thinking is what is being thought when the stream ends:
    content clears it.
    """
    done = F.coalesce(F.get_json_object("event", "$.done") == "true", F.lit(False))
    skip = F.coalesce(F.get_json_object("event", "$.messages").startswith("["), F.lit(False))
    e = events.where(~skip).select(*keys, F.col(order).alias("o"), delta(F.col("event"), paths).alias("piece"), delta(F.col("event"), THINKING).alias("thought"), done.alias("end"), _called(F.col("event")).alias("call"))
    w = Window.partitionBy(*keys).orderBy("o")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # an end is passed over if a call came since the last end, or with it
    e = e.withColumn("last_end", F.last(F.when(F.col("end"), F.col("o")), ignorenulls=True).over(before))
    e = e.withColumn("last_call", F.last(F.when(F.col("call"), F.col("o")), ignorenulls=True).over(upto))
    pending = F.col("last_call").isNotNull() & (F.col("last_end").isNull() | (F.col("last_call") > F.col("last_end")))
    e = e.withColumn("ends", F.col("end") & ~pending)
    e = e.withColumn("over", F.coalesce(F.max(F.col("ends").cast("int")).over(before), F.lit(0))).where("over = 0")
    pieces = F.array_sort(F.collect_list(F.struct("o", F.coalesce("piece", F.lit("")).alias("p"), F.when(F.col("piece").isNull(), F.col("thought")).alias("t"))))
    out = e.groupBy(*keys).agg(pieces.alias("x"), F.max("ends").alias("done"), F.max(F.when(F.col("piece").isNotNull(), F.col("o"))).alias("spoke"))
    answer = F.array_join(F.transform("x", lambda x: x["p"]), "")
    still = F.filter("x", lambda x: x["t"].isNotNull() & (F.col("spoke").isNull() | (x["o"] > F.col("spoke"))))
    return out.select(*keys, answer.alias("answer"), F.array_join(F.transform(still, lambda x: x["t"]), "").alias("thinking"), "done")


def terminated(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """(keys, order, event): ``events``, and an end after the last of each stream that has none."""
    done = F.coalesce(F.get_json_object("event", "$.done") == "true", F.lit(False))
    open_ = events.groupBy(*keys).agg(F.max(done).alias("done"), F.max(order).alias(order)).where("NOT done")
    kind = events.schema[order].dataType
    return events.select(*keys, order, "event").unionByName(open_.select(*keys, (F.col(order) + 1).cast(kind).alias(order), F.lit('{"done":true}').alias("event")))


def arguments(raw: Column) -> Column:
    """A tool call's arguments as a map: a JSON object, or a string of one; any other text is its 'text'."""
    text = F.coalesce(F.from_json(raw, "string"), raw)
    is_object = F.coalesce(F.try_parse_json(raw).isNotNull() & raw.rlike(r"^\s*\{"), F.lit(False))
    return F.when(raw.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.when(is_object, F.from_json(raw, "map<string,string>")).otherwise(F.create_map(F.lit("text"), text)))


Chat = Callable[[list[dict]], dict]
Tools = dict[str, Callable[[dict], str]]


def parsed_arguments(raw: object) -> dict:
    """A tool call's arguments: an object, a string of one, or a text; nothing for anything else."""
    if isinstance(raw, dict):
        return raw
    if not isinstance(raw, str):
        return {}
    try:
        return json.loads(raw)
    except ValueError:
        return {"text": raw}


def converse(messages: list[dict], chat: Chat, tools: Tools, rounds: int = 5) -> tuple[str, list[dict]]:
    """(answer, all messages): asks again with the tools' results until there is an answer, at most ``rounds`` times."""
    messages = list(messages)
    for _ in range(rounds):
        said = chat(messages)
        content, calls = said.get("content") or "", said.get("tool_calls") or said.get("tool_call") or []
        if not isinstance(calls, list) or not calls:
            return (content, [*messages, {"role": "assistant", "content": content}]) if content else ("", messages)
        messages.append({"role": "assistant", "content": content, "tool_calls": calls})
        for call in calls:
            function = (call or {}).get("function") or {}
            name = function.get("name")
            result = tools[name](parsed_arguments(function.get("arguments"))) if name in tools else f"Erreur: outil non supporté '{name}'"
            answer = {"role": "tool", "name": name or "unknown", "content": result}
            if isinstance((call or {}).get("id"), str) and call["id"]:
                answer["tool_call_id"] = call["id"]
            messages.append(answer)
    return "", messages


def conversed(questions: DataFrame, chat: Callable[[], Chat], tools: Tools, rounds: int = 5, text: str = "text") -> DataFrame:
    """``questions`` with answer and n_messages, by a chat provider that is made once for each batch."""

    def answer(texts: pa.Array) -> pa.Array:
        model = chat()
        found = [converse([{"role": "user", "content": t or ""}], model, tools, rounds) for t in texts.to_pylist()]
        return pa.array([{"answer": a, "n_messages": len(m)} for a, m in found], pa.struct([("answer", pa.string()), ("n_messages", pa.int32())]))

    out = questions.withColumn("__lectern_a", F.arrow_udf(answer, "struct<answer:string,n_messages:int>")(text))
    return out.withColumns({"answer": F.col("__lectern_a.answer"), "n_messages": F.col("__lectern_a.n_messages")}).drop("__lectern_a")
