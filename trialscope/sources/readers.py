"""Readers of trace exports: JSON and JSONL records or span rows, OTLP JSON and observation exports.

Files are read as text and parsed to variant once; each span is then shredded by a wide schema, whose table of keys finds
the place of every alias as the object is read, so no key is looked up by itself. Every reader ends in the same two
tables. `spans` has one row per span in file order (trace_ord, span_ord), `traces` one row per trace. Rows that are no
JSON objects are dropped; a line that is no JSON, a missing id, a span id used twice in a trace, and a mix of trace
records and span rows fail the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialscope.functions import expr, formats
from trialscope.sources.stage import staged

SPAN_COLUMNS = ("trace_id", "span_id", "parent_id", "name", "kind", "tool_name", "started_at", "ended_at", "duration_ms", "status", "status_message", "input", "output", "usage")


USAGE_SQL = "struct<model_provider: string, model: string, input_tokens: long, output_tokens: long, total_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long, cost_usd: double>"


@dataclass(frozen=True)
class Export:
    """What a reader returns: spans, and trace rows with the fields their records state (null for grouped spans)."""

    spans: DataFrame
    stated: DataFrame | None = None


def path(key: str) -> str:
    return f'$["{key}"]'


#: from_json reads a text of any length; an object that has a field of another type keeps the others.
OPTIONS = {"mode": "PERMISSIVE", "maxStringLen": str((1 << 31) - 1)}


def shape(texts: Iterable[str] = (), values: Iterable[str] = (), **nested: T.StructType) -> T.StructType:
    """The keys that are read of an object, in one pass over it: as text, as variant, or as objects themselves."""
    kinds: dict[str, T.DataType] = dict.fromkeys(texts, T.StringType()) | dict.fromkeys(values, T.VariantType()) | nested
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


class Fields:
    """The fields of an object that was read by a shape."""

    def __init__(self, object_: Column, of: T.StructType):
        self.object, self.kinds = object_, {f.name: f.dataType for f in of}

    def __getitem__(self, key: str) -> Column:
        if key not in self.kinds:
            raise KeyError(key)
        return self.object.getField(key)

    def nested(self, key: str) -> Fields:
        return Fields(self[key], self.kinds[key])

    def raw(self, *keys: str) -> Column:
        """The first of the keys that is neither absent nor null, as variant."""
        return F.coalesce(*(F.when(~F.is_variant_null(self[k]), self[k]) for k in keys))

    def text(self, *keys: str) -> Column:
        """The first of the keys that is neither absent nor null, as text."""
        return F.coalesce(*(self[k] if self.kinds[k] == T.StringType() else self.raw(k).cast("string") for k in keys))


def shredded(json_: Column, of: T.StructType) -> Column:
    """The fields of an object's JSON, each of its keys looked up once in the shape's table."""
    return F.from_json(json_, of, OPTIONS)


def then(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, as a step by itself: an expression that is used more than once is computed once."""
    return rows.withColumns(columns)


def text(v: Column, *keys: str) -> Column:
    """The first of the keys that is neither absent nor null, as text, of a variant of which few keys are read."""
    return F.coalesce(*(F.try_variant_get(v, path(k), "string") for k in keys))


def whole(value: Column) -> Column:
    """A variant as text, but a string that writes a fraction ("1.5") gives an empty text, which no number is read from:
    unlike the number 1.5 it isn't cut to 1."""
    got = value.cast("string")
    fraction = got.rlike(r"^\s*[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?\d+[eE][+-]?\d+\s*$")
    return F.when(fraction & F.to_json(value).startswith('"'), F.lit("")).otherwise(got)


def raw(v: Column, *keys: str) -> Column:
    """The first of the keys that is neither absent nor null, as variant."""
    found = (F.try_variant_get(v, path(k), "variant") for k in keys)
    return F.coalesce(*(F.when(~F.is_variant_null(x), x) for x in found))


def objects(array: Column) -> Column:
    """The JSON of an array's objects; what else it holds is left out. None if it is no array."""
    got = F.coalesce(F.try_variant_get(array, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(got, lambda x: F.to_json(x)), lambda x: x.startswith("{"))


def required(value: Column, what: str) -> Column:
    missing = value.isNull() | (value == "")
    return F.when(missing, F.raise_error(F.lit(f"{what} is missing")).cast("string")).otherwise(value)


def status(value: Column) -> Column:
    """Of a variant: a boolean says whether there was an error."""
    shown = value.cast("string")
    return F.when(F.to_json(value).isin("true", "false"), expr.status_of_flag(shown == "true")).otherwise(expr.status_of(shown))


def number(value: Column, kind: str) -> Column:
    """Long or double of a text; booleans and other text give null, a fraction is cut for longs if it was a number."""
    if kind == "long":
        return F.when(~F.lower(value).isin("true", "false"), F.coalesce(expr.long_of(F.trim(value)), expr.double_of(value).cast("long")))
    return F.when(~F.lower(value).isin("true", "false"), expr.double_of(value))


#: Keys of evidence whose numbers are read by type.
TOKEN_KEYS = tuple(f"gen_ai.usage.{k}" for k in ("input_tokens", "output_tokens", "total_tokens", "cache_read.input_tokens", "cache_creation.input_tokens"))
#: For each of them, in this order, its column, its names in a usage object and those beside it.
TOKENS = (
    ("input_tokens", formats.INPUT_TOKENS, ("inputUsage", "input_usage")),
    ("output_tokens", formats.OUTPUT_TOKENS, ("outputUsage", "output_usage")),
    ("total_tokens", formats.TOTAL_TOKENS, ("totalUsage", "total_usage")),
    ("cache_read_input_tokens", formats.CACHE_READ, ()),
    ("cache_creation_input_tokens", formats.CACHE_WRITE, ()),
)
USAGE_SHAPE = shape(values=[n for _, names, _ in TOKENS for n in names])
COST_SHAPE = shape(texts=("total", "total_cost", "totalCost"))
MODELS = ("providedModelName", "model", "modelName", "model_name")
COSTS = ("totalCost", "total_cost", "calculatedTotalCost")
#: Keys of usage, cost, model and provider that any span may have.
USAGE_TEXTS, USAGE_VALUES = ("model_provider", "modelProvider", *MODELS, *COSTS), (*formats.USAGE, *formats.COST, *(k for _, _, own in TOKENS for k in own))
#: Keys of any span, trace record or observation.
TEXTS = ("name", "type", "id", "traceName", "status_message", "statusMessage", "status.message", *formats.SPAN_TRACE_ID, *USAGE_TEXTS)
VALUES = ("status", "spans", *formats.SPAN_MARKS, *formats.STARTED, *formats.ENDED, *formats.INPUT, *formats.OUTPUT, *USAGE_VALUES)


def evidence_shape(prefix: str) -> T.StructType:
    """The evidence attributes: others aren't read."""
    return shape([k for k in formats.evidence_keys(prefix) if k not in TOKEN_KEYS], TOKEN_KEYS)


def span_shape(prefix: str) -> T.StructType:
    """What is read of a span row or a trace record: its own keys, among them the evidence, and two places of evidence."""
    held = evidence_shape(prefix)
    texts = (*(f.name for f in held if f.dataType == T.StringType()), *TEXTS, "tool_name", "toolName", "kind")
    return shape(texts, (*VALUES, *formats.PARENT_MARKS, *TOKEN_KEYS, "status_code", "statusCode"), metadata=held, attributes=held)


def observation_shape(prefix: str) -> T.StructType:
    return shape((*TEXTS, "observationType", "observation_type", "parentObservationId", "parent_observation_id"), (*VALUES, "level", "error"), metadata=evidence_shape(prefix))


def looker(*places: Fields) -> Callable[..., Column]:
    """Looks up evidence attributes: for each key, the first of the places that has it."""
    return lambda *keys: F.coalesce(*(place.text(k) for k in keys for place in places if k in place.kinds))


def with_usage(rows: DataFrame, f: Fields, places: tuple[Fields, ...], prefix: str) -> DataFrame:
    """rows with `usage`: tokens, cost, model and provider. Token counts of a place are taken by type if it holds
    variants; if it holds texts, their tags told their types."""
    look = looker(*places)
    rows = then(rows, _u=f.raw(*formats.USAGE), _c=f.raw(*formats.COST))
    rows = then(rows, _u=F.try_variant_get("_u", "$", USAGE_SHAPE.simpleString()), _c=F.try_variant_get("_c", "$", COST_SHAPE.simpleString()))
    u, c = Fields(F.col("_u"), USAGE_SHAPE), Fields(F.col("_c"), COST_SHAPE)
    typed = [p for p in places if p.kinds[TOKEN_KEYS[0]] != T.StringType()]
    first = {f"_{n}": F.coalesce(u.raw(*names), *([f.raw(*own)] if own else []), *(p.raw(k) for p in typed)) for (n, names, own), k in zip(TOKENS, TOKEN_KEYS, strict=True)}
    rows = then(rows, **first)
    told = {f"_{n}": whole(F.col(f"_{n}")) if typed else F.coalesce(whole(F.col(f"_{n}")), look(k)) for (n, _, _), k in zip(TOKENS, TOKEN_KEYS, strict=True)}
    cost = F.coalesce(c.text("total", "total_cost", "totalCost"), f.text(*COSTS), look(f"{prefix}.cost_usd", "cost_usd"))
    provider, model = f.text("modelProvider", "model_provider"), f.text(*MODELS)
    rows = then(rows, **told, _cost=cost, _provider=provider, _model=model)
    rows = then(rows, **{f"_{n}": number(F.col(f"_{n}"), "long") for n, _, _ in TOKENS})
    total = expr.total_tokens(F.col("_total_tokens"), F.col("_input_tokens"), F.col("_output_tokens"))
    kept = F.struct(
        F.coalesce(expr.first_text(F.col("_provider")), look(*formats.provider_keys(prefix))).alias("model_provider"),
        F.coalesce(expr.first_text(F.col("_model")), look(*formats.model_keys(prefix))).alias("model"),
        *(total.alias(n) if n == "total_tokens" else F.col(f"_{n}").alias(n) for n, _, _ in TOKENS),
        number(F.col("_cost"), "double").alias("cost_usd"),
    )
    return then(rows, usage=kept)


def _finish(rows: DataFrame, kind: Column, name: Column) -> DataFrame:
    """Span rows in SPAN_COLUMNS and file order, from rows with the parts' columns: texts of ids, name and kind, the
    tool, variants of times and status, payloads and usage."""
    told = {c: whole(F.col(c)) for c in ("_started", "_ended") if rows.schema[c].dataType == T.VariantType()}
    rows = then(rows, kind=kind, **told)
    rows = then(rows, started_at=expr.nanos_of(F.col("_started")), ended_at=expr.nanos_of(F.col("_ended")), name=name, trace_id=required(F.col("_trace"), "trace id"), span_id=required(F.col("_span"), "span id"), status=status(F.col("_status")))
    return rows.withColumn("duration_ms", expr.duration_ms(F.col("started_at"), F.col("ended_at"))).select("trace_ord", "span_ord", *SPAN_COLUMNS)


def json_spans(rows: DataFrame, prefix: str, of: T.StructType) -> DataFrame:
    """rows: trace_ord, span_ord, trace_id (of the record, or null), r (by the shape)."""
    f = Fields(F.col("r"), of)
    places = (f, f.nested("metadata"), f.nested("attributes"))
    look = looker(*places)
    tool, kind = f.text("tool_name", "toolName"), f.text("kind", "type")
    rows = then(
        with_usage(rows, f, places, prefix),
        _own_tool=tool,
        _own_kind=kind,
        _own_trace=f.text(*formats.SPAN_TRACE_ID),
        _span=f.text(*formats.SPAN_ID[:2], "id", "observationId"),
        parent_id=f.text("parent_span_id", "parentSpanId", "parent_id"),
        _name=f.text("name"),
        _started=f.raw(*formats.STARTED),
        _ended=f.raw(*formats.ENDED),
        _status=f.raw("status", "status_code", "statusCode"),
        status_message=f.text("status_message", "status.message"),
        input=f.raw(*formats.INPUT),
        output=f.raw(*formats.OUTPUT),
    )
    rows = then(rows, tool_name=F.coalesce(expr.first_text(F.col("_own_tool")), look(*formats.tool_name_keys(prefix))), _kind=F.trim(F.coalesce(expr.first_text(F.col("_own_kind")), look(f"{prefix}.span.kind"))), _trace=expr.first_text(F.col("_own_trace"), F.col("trace_id")))
    return _finish(rows, expr.kind_of(F.col("_kind"), F.col("tool_name")), F.coalesce(expr.first_text(F.col("_name")), F.col("kind")))


def observation_spans(rows: DataFrame, prefix: str, of: T.StructType) -> DataFrame:
    f = Fields(F.col("r"), of)
    places = (f.nested("metadata"),)
    look = looker(*places)
    rows = then(
        with_usage(rows, f, places, prefix),
        _type=f.text("type", "observationType", "observation_type"),
        _own_trace=f.text("traceId", "trace_id"),
        _span=f.text(*formats.SPAN_ID[:2], "id", "observationId"),
        parent_id=f.text("parentObservationId", "parent_observation_id"),
        _name=f.text("name"),
        _started=f.raw(*formats.STARTED),
        _ended=f.raw(*formats.ENDED),
        _status=f.raw("status", "level", "error"),
        status_message=f.text("status_message", "statusMessage"),
        input=f.raw(*formats.INPUT),
        output=f.raw(*formats.OUTPUT),
        _held_tool=look("tool.name", f"{prefix}.tool.name", "openinference.tool.name"),
    )
    rows = then(rows, _type=F.coalesce(expr.first_text(F.col("_type")), F.lit("span")), _trace=expr.first_text(F.col("_own_trace"), F.col("trace_id")))
    rows = then(rows, _name=F.coalesce(expr.first_text(F.col("_name")), F.col("_type")))
    rows = then(rows, tool_name=F.when(F.lower("_type") == "tool", F.col("_name")).otherwise(F.col("_held_tool")))
    return _finish(rows, expr.kind_of(F.trim("_type"), F.col("tool_name")), F.col("_name"))


#: The tags of an OTLP value, in order.
TAGS = ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue")


def untagged(value):
    """What a tagged OTLP value stands for: lists and key-value lists at any depth."""
    if not isinstance(value, dict):
        return value
    for tag in TAGS:
        if tag in value:
            return value[tag]
    values = lambda tag: [x for x in (value[tag] or {}).get("values") or []]
    if "arrayValue" in value:
        return [untagged(x) for x in values("arrayValue")]
    if "kvlistValue" in value:
        return {str(x["key"]): untagged(x.get("value")) for x in values("kvlistValue") if isinstance(x, dict) and x.get("key") is not None}
    return value


@F.pandas_udf(T.StringType())
def untagged_json(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON of tagged values to JSON of what they stand for. Spark's expressions have no recursion."""
    for s in values:
        yield s.map(lambda x: None if x is None else json.dumps(untagged(json.loads(x)), ensure_ascii=False))


def payload_keys(prefix: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Keys of a span's input and output, in order."""
    return ("input", "gen_ai.input.messages", "gen_ai.prompt", f"{prefix}.case.input"), ("output", "gen_ai.output.messages", "gen_ai.completion", f"{prefix}.final_output")


def otlp_attributes(pairs: Column, prefix: str) -> Column:
    """The evidence of a list of tagged attributes as JSON of an object: a key's last value that isn't null. Payloads stay
    tagged; a scalar is what its tag holds, a list or key-value list what its entries hold."""
    payloads = [k for keys in payload_keys(prefix) for k in keys]
    known = F.transform(F.coalesce(pairs, F.array().cast("array<variant>")), lambda p: F.struct(text(p, "key").alias("key"), raw(p, "value").alias("value")))
    known = F.filter(known, lambda p: p["key"].isin(*formats.evidence_keys(prefix)) & p["value"].isNotNull())
    flat = lambda x: F.coalesce(text(x, *TAGS), F.to_json(x))

    def held(p: Column) -> Column:
        value = p["value"]
        array = F.try_variant_get(value, '$["arrayValue"]["values"]', "array<variant>")
        entries = F.try_variant_get(value, '$["kvlistValue"]["values"]', "array<variant>")
        nested = F.to_json(F.map_from_entries(F.transform(entries, lambda x: F.struct(text(x, "key"), flat(raw(x, "value"))))))
        tagged = F.to_json(value).startswith("{") & ~p["key"].isin(payloads)
        return F.concat(F.lit('"'), p["key"], F.lit('":'), F.when(tagged, F.coalesce(F.to_json(raw(value, *TAGS)), F.to_json(F.transform(array, flat)), nested)).otherwise(F.to_json(value)))

    return F.concat(F.lit("{"), F.array_join(F.transform(known, held), ","), F.lit("}"))  # nulls are left out


def otlp_shape() -> T.StructType:
    texts = ("traceId", "spanId", "parentSpanId", "name", "kind", "startTimeUnixNano", "endTimeUnixNano", *USAGE_TEXTS)
    return shape(texts, ("attributes", *USAGE_VALUES), status=shape(("message",), ("code",)))


def otlp_spans(rows: DataFrame, prefix: str) -> DataFrame:
    """rows: trace_ord, span_ord, r (by otlp_shape)."""
    payloads, of = payload_keys(prefix), otlp_shape()
    kept = shape([k for k in formats.evidence_keys(prefix) if k not in sum(payloads, ())], sum(payloads, ()))
    f, held = Fields(F.col("r"), of), Fields(F.col("held"), kept)
    look, state = looker(held), f.nested("status")
    rows = then(rows, pairs=F.try_variant_get(f["attributes"], "$", "array<variant>"))
    rows = then(rows, held=shredded(otlp_attributes(F.col("pairs"), prefix), kept))
    rows = then(
        with_usage(rows, f, (held,), prefix),
        tool_name=look("tool.name", f"{prefix}.tool.name", "openinference.tool.name"),
        _trace=f.text("traceId"),
        _span=f.text("spanId"),
        _parent=f.text("parentSpanId"),
        _kind=F.trim(f.text("kind")),
        _name=f.text("name"),
        _started=f.text("startTimeUnixNano"),
        _ended=f.text("endTimeUnixNano"),
        _status=state.raw("code"),
        status_message=state.text("message"),
        **{name: F.to_json(held.raw(*keys)) for name, keys in zip(("input", "output"), payloads, strict=True)},
    )
    rows = then(rows, parent_id=expr.first_text(F.col("_parent")), input=F.parse_json(untagged_json("input")), output=F.parse_json(untagged_json("output")))
    return _finish(rows, expr.kind_of(F.col("_kind"), F.col("tool_name")), F.coalesce(expr.first_text(F.col("_name")), F.col("kind")))


def documents(spark: SparkSession, source: str) -> DataFrame:
    """(file_ord, v): one row per document of a .json file, or per non-blank line of any other. Lines keep their order
    within a file; many files are taken in the order of their paths."""
    if source.endswith(".json"):
        d = spark.read.text(source, wholetext=True).withColumn("file_ord", F.struct(F.input_file_name(), F.lit(0).cast("long")))
    else:
        d = spark.read.text(source).filter(F.trim("value") != "").withColumn("file_ord", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    d = d.select("file_ord", F.try_parse_json("value").alias("v"))
    return d.select("file_ord", F.when(F.col("v").isNull(), F.raise_error(F.lit("malformed JSON")).cast("variant")).otherwise(F.col("v")).alias("v"))


def records(spark: SparkSession, source: str) -> DataFrame:
    """(ord, j), the JSON of the objects of a source: list, {"traces": [...]}, or single object."""
    d = documents(spark, source)
    d = then(d, listed=F.try_variant_get("v", "$", "array<variant>"), traces=F.try_variant_get("v", '$["traces"]', "array<variant>"))
    held = F.transform(F.coalesce("listed", "traces", F.array("v")), lambda x: F.to_json(x))
    rows = d.select("file_ord", F.posexplode(F.filter(held, lambda j: j.startswith("{"))).alias("pos", "j"))
    return rows.select(F.struct("file_ord", "pos").alias("ord"), "j")


def is_span_row(f: Fields) -> Column:
    marked = F.greatest(*(f[k].isNotNull() for k in (*formats.SPAN_MARKS, *formats.PARENT_MARKS)))
    return marked & F.try_variant_get(f["spans"], "$", "array<variant>").isNull()


def _numbered(spans: DataFrame) -> DataFrame:
    """trace_ord: where the trace first appears. The spans are shredded once, here; a large trace is not gathered."""
    spans = staged(spans.drop("trace_ord"), "spans")
    first = spans.groupBy("trace_id").agg(F.min("span_ord").alias("trace_ord"))
    return spans.join(first, "trace_id").select("trace_ord", "span_ord", *SPAN_COLUMNS)


def read_json(spark: SparkSession, source: str, prefix: str = formats.PREFIX) -> Export:
    """The first object tells whether the source has span rows or trace records; one of the other kind fails the job."""
    of = span_shape(prefix)
    f = Fields(F.col("r"), of)
    rows = records(spark, source).select("ord", shredded(F.col("j"), of).alias("r"))
    rows = then(rows, is_span=is_span_row(f))
    first = rows.select("is_span").first()
    spans = bool(first and first.is_span)
    # a column, as a filter would be pushed below the shredding and shred each object a second time
    rows = rows.select("ord", F.when(F.col("is_span") == F.lit(spans), F.col("r")).otherwise(F.raise_error(F.lit("trace records and span rows are mixed")).cast(of)).alias("r"))
    if spans:
        none = F.lit(None).cast("string")
        return Export(_numbered(json_spans(rows.select(F.col("ord").alias("trace_ord"), F.col("ord").alias("span_ord"), none.alias("trace_id"), "r"), prefix, of)))
    r = then(rows, _id=f.text("id", "trace_id", "traceId"))
    r = then(r, trace_id=required(F.col("_id"), "trace id"))
    own = r.select(F.col("ord").alias("trace_ord"), "trace_id", F.posexplode(objects(f["spans"])).alias("pos", "j"))
    spans = json_spans(own.select("trace_ord", F.struct("trace_ord", "pos").alias("span_ord"), "trace_id", shredded(F.col("j"), of).alias("r")), prefix, of)
    return Export(staged(spans, "spans"), _stated(r, f, f.raw("status", "status_code", "statusCode"), formats.INPUT, formats.OUTPUT))


def _stated(rows: DataFrame, f: Fields, state: Column, inputs: tuple[str, ...], outputs: tuple[str, ...]) -> DataFrame:
    """What trace records say of themselves."""
    rows = then(rows, _started=f.raw(*formats.STARTED), _ended=f.raw(*formats.ENDED), _status=state, name=f.text(*formats.NAME), input=f.raw(*inputs), output=f.raw(*outputs))
    rows = then(rows, _started=whole(F.col("_started")), _ended=whole(F.col("_ended")))
    return rows.select("trace_id", F.col("ord").alias("trace_ord"), "name", expr.nanos_of(F.col("_started")).alias("started_at"), expr.nanos_of(F.col("_ended")).alias("ended_at"), status(F.col("_status")).alias("status"), "input", "output")


def read_otlp(spark: SparkSession, source: str, prefix: str = formats.PREFIX) -> Export:
    d = documents(spark, source)
    for level, key in (("resource", "resourceSpans"), ("scope", "scopeSpans")):  # what is no object has no such list
        held = F.coalesce(F.try_variant_get("v", path(key), "array<variant>"), F.array().cast("array<variant>"))
        d = d.select(*[c for c in d.columns if c != "v"], F.posexplode(held).alias(level, "v"))
    d = d.select("file_ord", "resource", "scope", F.posexplode(objects(F.try_variant_get("v", path("spans"), "variant"))).alias("span", "j"))
    rows = d.select(F.struct("file_ord", "resource", "scope", "span").alias("span_ord"), shredded(F.col("j"), otlp_shape()).alias("r"))
    return Export(_numbered(otlp_spans(rows.withColumn("trace_ord", F.col("span_ord")), prefix)))


def read_observations(spark: SparkSession, source: str, prefix: str = formats.PREFIX) -> Export:
    """{"data": [...]} groups observations by trace; {"traces", "observations"} joins them to their traces, a trace's
    own observations before the top-level ones."""
    d, of = documents(spark, source), observation_shape(prefix)
    f = Fields(F.col("r"), of)
    none = F.lit(None)
    at = lambda key: objects(F.try_variant_get("v", path(key), "variant"))
    if d.filter(F.try_variant_get("v", '$["data"]', "variant").isNotNull()).limit(1).count():
        rows = d.select("file_ord", F.posexplode(at("data")).alias("pos", "j")).select(F.struct("file_ord", "pos").alias("span_ord"), shredded(F.col("j"), of).alias("r"))
        spans = _numbered(observation_spans(rows.select(F.col("span_ord").alias("trace_ord"), "span_ord", none.cast("string").alias("trace_id"), "r"), prefix, of))
        named = rows.select(f.text("traceId", "trace_id").alias("trace_id"), "span_ord", f.text("traceName").alias("name"))
        names = named.groupBy("trace_id").agg(F.min_by("name", "span_ord").alias("name"), F.min("span_ord").alias("trace_ord"))
        return Export(spans, names.select("trace_id", "trace_ord", "name", none.cast("long").alias("started_at"), none.cast("long").alias("ended_at"), F.lit("unknown").alias("status"), none.cast("variant").alias("input"), none.cast("variant").alias("output")))
    record = shape(("id", "trace_id", "traceId", *formats.NAME), ("status", "level", "error", "observations", "input", "output", *formats.STARTED, *formats.ENDED))
    t = Fields(F.col("r"), record)
    r = then(records(spark, source), r=shredded(F.col("j"), record))
    r = then(r, _id=t.text("id", "trace_id", "traceId"))
    r = then(r, trace_id=required(F.col("_id"), "trace id"))
    nested = r.select("trace_id", F.col("ord").alias("trace_ord"), F.posexplode(objects(t["observations"])).alias("pos", "j"))
    nested = nested.select("trace_id", "trace_ord", "pos", F.lit(0).alias("late"), shredded(F.col("j"), of).alias("r"))
    top = d.select(F.posexplode(at("observations")).alias("pos", "j")).select("pos", F.lit(1).alias("late"), shredded(F.col("j"), of).alias("r"))
    top = top.withColumn("trace_id", f.text("traceId", "trace_id")).join(r.select("trace_id", F.col("ord").alias("trace_ord")), "trace_id")
    rows = nested.unionByName(top).select("trace_ord", F.struct("trace_ord", "late", "pos").alias("span_ord"), "trace_id", "r")
    return Export(staged(observation_spans(rows, prefix, of), "spans"), _stated(r, t, t.raw("status", "level", "error"), ("input",), ("output",)))


READERS = {"json": read_json, "jsonl": read_json, "local-jsonl": read_json, "otlp": read_otlp, "langfuse": read_observations}


def trace_rows(export: Export, limit: int | None = None) -> DataFrame:
    """One row per trace: stated fields first, else those of its spans; the first `limit` traces to appear."""
    s = export.spans.groupBy("trace_id").agg(
        F.min("trace_ord").alias("trace_ord"),
        F.min("started_at").alias("span_start"),
        F.max("ended_at").alias("span_end"),
        F.min_by("name", "span_ord").alias("span_name"),
        F.bool_or(F.col("status") == "error").alias("any_error"),
        F.bool_and(F.col("status") == "ok").alias("all_ok"),
        F.count("*").alias("span_count"),
        F.count_distinct("span_id").alias("span_ids"),
    )
    once = F.assert_true(F.col("span_ids") == F.col("span_count"), F.concat(F.lit("a span id occurs twice in trace "), F.col("trace_id")))
    s = s.withColumn("checked", once).filter(F.col("checked").isNull()).drop("checked", "span_ids")
    by_spans = F.when(F.col("any_error"), "error").when(F.col("all_ok"), "ok").otherwise("unknown")
    none = F.lit(None)
    if export.stated is None:
        out = s.select("trace_ord", F.col("trace_id").alias("id"), F.col("span_name").alias("name"), F.col("span_start").alias("started_at"), F.col("span_end").alias("ended_at"), by_spans.alias("status"), none.cast("variant").alias("input"), none.cast("variant").alias("output"), "span_count")
    else:
        j = export.stated.join(s.drop("trace_ord"), "trace_id", "left")
        out = j.select("trace_ord", F.col("trace_id").alias("id"), "name", F.coalesce("started_at", "span_start").alias("started_at"), F.coalesce("ended_at", "span_end").alias("ended_at"), F.when(F.col("status") != "unknown", F.col("status")).otherwise(F.coalesce(by_spans, F.lit("unknown"))).alias("status"), "input", "output", F.coalesce("span_count", F.lit(0)).alias("span_count"))
    out = out.withColumn("duration_ms", expr.duration_ms(F.col("started_at"), F.col("ended_at")))
    return out.orderBy("trace_ord").limit(limit) if limit else out


def read(spark: SparkSession, provider: str, source: str, prefix: str = formats.PREFIX) -> Export:
    kind = provider.lower()
    if kind not in READERS:
        raise ValueError(f"unknown provider {provider!r}; one of {', '.join(READERS)}")
    return READERS[kind](spark, source, prefix)
