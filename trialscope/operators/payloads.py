"""Recorded payloads: tool arguments and results, agent events, case inputs, attributes and other small JSON shapes."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.functions import formats

#: How an agent's event ended, and the attributes that only the merge itself sets.
EVENT_STATUS = {"completed": "ok", "failed": "error", "cancelled": "cancelled"}


def reserved_keys(prefix: str = formats.PREFIX) -> tuple[str, ...]:
    return ("input", "output", *(f"{prefix}.{k}" for k in ("evidence.source", "agent.run_id", "agent.revision", "agent.environment", "agent.effects", "agent.event.sequence")))


def present(v: Column, key: str) -> Column:
    """Whether an object has the key, be its value null."""
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def decoded_once(v: Column) -> Column:
    """A text that is itself JSON becomes what it says; any other value stays as it is. NaN and Infinity are no JSON."""
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    bare = F.regexp_replace(text, r'"(\\.|[^"\\])*"', "")
    return F.when(text.isNotNull() & ~bare.rlike("NaN|Infinity"), F.coalesce(F.try_parse_json(text), v)).otherwise(v)


def tool_payload(attributes: Column, canonical: str, attached: str, flat: str, prefix: str = formats.PREFIX) -> tuple[Column, Column]:
    """(value, recorded): under the canonical key; attached to an agent run's evidence; or flat. Recorded tells a null
    value from none."""
    by_run = F.coalesce(F.try_variant_get(attributes, f'$["{prefix}.evidence.source"]', "string") == "agent_run", F.lit(False))
    places = [(present(attributes, canonical), canonical), (by_run & present(attributes, attached), attached), (present(attributes, flat), flat)]
    value = recorded = None
    for there, key in places:
        got = decoded_once(member(attributes, key))
        value = F.when(there, got) if value is None else value.when(there, got)
        recorded = there if recorded is None else recorded | there
    return value, recorded


def with_tool_payloads(spans: DataFrame, prefix: str = formats.PREFIX) -> DataFrame:
    """Adds arguments, result and whether each was recorded, from the variant column attributes."""
    a, had_a = tool_payload(F.col("attributes"), f"{prefix}.tool.args", "input", "arguments", prefix)
    r, had_r = tool_payload(F.col("attributes"), f"{prefix}.tool.result", "output", "result", prefix)
    return spans.withColumns({"arguments": a, "arguments_recorded": had_a, "result": r, "result_recorded": had_r})


def event_spans(events: DataFrame, prefix: str = formats.PREFIX) -> DataFrame:
    """Agent events (run_id, revision, environment, effects, sequence, id, parent_id, name, kind, status, started_at,
    ended_at, attributes, input, output as map<string, string> and text) as spans.

    Attributes that only the merge may set are taken out of the event's own before they are set.
    """
    own = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string, string>")), lambda k, _: ~k.isin(*reserved_keys(prefix)))
    payload = F.map_filter(F.create_map(F.lit("input"), F.col("input"), F.lit("output"), F.col("output")), lambda _, v: v.isNotNull())
    said = {"evidence.source": F.lit("agent_run"), "agent.run_id": F.col("run_id"), "agent.revision": F.col("revision"), "agent.environment": F.col("environment"), "agent.effects": F.col("effects"), "agent.event.sequence": F.col("sequence").cast("string")}
    origin = F.create_map(*(x for k, v in said.items() for x in (F.lit(f"{prefix}.{k}"), v)))
    status = F.create_map(*(F.lit(x) for pair in EVENT_STATUS.items() for x in pair))[F.col("status")]
    return events.select("run_id", "sequence", F.col("id").alias("span_id"), "parent_id", "name", "kind", F.when(F.col("kind") == "tool", F.col("name")).alias("tool_name"), "started_at", "ended_at", status.alias("status"), F.map_concat(own, payload, origin).alias("attributes"))


def case_input(row: Column, explicit: Column | None = None) -> Column:
    """A case's input from its row (variant): the explicit one, its input, its messages, its only other field, or all
    other fields."""
    fields = F.map_filter(F.try_variant_get(row, "$", "map<string, variant>"), lambda k, _: k != "id")
    out = F.when(present(row, "input"), F.to_json(member(row, "input"))).when(present(row, "messages"), F.to_json(member(row, "messages")))
    out = out.when(F.size(fields) == 1, F.to_json(F.element_at(F.map_values(fields), 1))).otherwise(F.to_json(fields))
    return out if explicit is None else F.coalesce(F.to_json(explicit), out)


def group_id(node_id: Column) -> Column:
    """A node id without its trial numbers and the brackets they leave empty."""
    return F.replace(F.regexp_replace(node_id, r"-?trial\d+-?|trial\d+-?", ""), F.lit("[]"), F.lit(""))


def case_id(inner: Column, case: Column, group: Column) -> Column:
    """The case's own id, the trial's, its group, else unknown; empty ones don't count."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (inner, case, group)), F.lit("unknown"))


def group_of(group: Column, case: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), case)


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def strict_object(value) -> dict:
    """The value if it is a JSON object all through: text keys, no NaN. TypeError otherwise."""

    def check(x) -> None:
        if isinstance(x, Mapping):
            if not all(isinstance(k, str) for k in x):
                raise TypeError("keys are texts")
            for y in x.values():
                check(y)
        elif isinstance(x, list):
            for y in x:
                check(y)
        else:
            try:
                json.dumps(x, allow_nan=False)
            except ValueError as error:
                raise TypeError(str(error)) from error

    if not isinstance(value, Mapping):
        raise TypeError("a filter is a JSON object")
    check(value)
    return dict(value)


def flat_attributes(nested: Column, explicit: Column) -> Column:
    """Nested attributes under the explicit ones, which win."""
    empty = F.create_map().cast("map<string, string>")
    explicit = F.coalesce(explicit, empty)
    kept = F.map_filter(F.coalesce(nested, empty), lambda k, _: ~F.map_contains_key(explicit, k))
    return F.map_concat(kept, explicit)


def body_hint(text: Column, limit: int = 300) -> Column:
    """An error body on one line, printable characters alone, cut with dots; null if nothing is left."""
    line = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}", ""))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(F.nullif(line, F.lit("")))


def valid_timeout(value: Column) -> Column:
    """A positive finite number of seconds, else null."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < F.lit(float("inf"))), value)


def timeout_text(value: Column) -> Column:
    """Whole seconds without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def retryable(statuses: Column, names: Column, retry_names: tuple[str, ...], own_timeout: Column) -> Column:
    """Whether an error may be tried again: by its HTTP statuses if it has any, else by its names; never a timeout of
    the caller's own."""
    by_status = F.exists(statuses, lambda s: (s == 429) | (s >= 500))
    by_name = F.arrays_overlap(names, F.array(*map(F.lit, retry_names)))
    return ~own_timeout & F.when(F.size(statuses) > 0, by_status).otherwise(by_name)


def http_reason(status: Column) -> Column:
    known = {401: "rejected the credentials", 403: "denied access", 404: "could not find the requested endpoint", 429: "rate limited the caller"}
    return F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[status], F.concat(F.lit("returned HTTP "), status.cast("string")), F.lit("returned an error"))


def remote_endpoints(env: DataFrame, fragments: tuple[str, ...] = ("ENDPOINT", "URL", "HOST"), local: tuple[str, ...] = ("localhost", "127.0.0.1", "::1", "0.0.0.0")) -> DataFrame:
    """Keys of settings (key, value) that name a web host elsewhere."""
    named = env.filter(F.upper("key").rlike("|".join(fragments)) & (F.lower("value").rlike("^https?://")))
    host = F.lower(F.regexp_extract("value", r"^[A-Za-z]+://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    return named.withColumn("host", host).filter((F.col("host") != "") & ~F.col("host").isin(*local) & ~F.col("host").endswith(".local")).select("key").distinct()


def satisfies(version: Column, clauses: str) -> Column:
    """Whether a dotted version fulfils all clauses, such as ">=3.8,<3.9"."""
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    out = F.lit(True)
    for clause in clauses.split(","):
        op = next(o for o in (">=", "<=", "==", ">", "<") if clause.strip().startswith(o))
        wanted, own = parts(F.lit(clause.strip()[len(op) :])), parts(version)
        out = out & {">=": own >= wanted, "<=": own <= wanted, "==": own == wanted, ">": own > wanted, "<": own < wanted}[op]
    return out
