"""Span rows to traces, tool calls and trace measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions import expr
from trialscope.operators.payloads import strict_object

ORDER = ("started_at", "span_id")


def rollup(spans: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row a trace: bounds, duration, status, span count and the first span's name. Partial aggregates only: no
    span list is gathered."""
    g = spans.groupBy("trace_id").agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.count("*").alias("span_count"),
        F.min_by("name", F.struct(*order)).alias("name"),
        F.bool_or(F.col("status") == "error").alias("any_error"),
        F.bool_and(F.col("status") == "ok").alias("all_ok"),
    )
    status = F.when(F.col("any_error"), "error").when(F.col("all_ok"), "ok").otherwise("unknown")
    return g.select("trace_id", "name", "started_at", "ended_at", expr.duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"), status.alias("status"), "span_count")


def first_traces(spans: DataFrame, limit: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The spans of the first traces to appear. The trace keys are ranked by a bounded top-k."""
    keys = spans.groupBy("trace_id").agg(F.min(F.struct(*order)).alias("first")).orderBy("first", "trace_id").limit(limit).select("trace_id")
    return spans.join(F.broadcast(keys), "trace_id", "left_semi")  # at most `limit` keys


def tool_calls(spans: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Tool spans in order, numbered from 0 in each trace."""
    calls = spans.filter((F.col("tool_name").isNotNull() & (F.col("tool_name") != "")) | (F.col("kind") == "tool"))
    w = Window.partitionBy("trace_id").orderBy(*order)
    return calls.select("trace_id", "span_id", expr.first_text(F.col("tool_name"), F.col("name")).alias("tool"), "status", (F.row_number().over(w) - 1).cast("long").alias("sequence"), *[c for c in ("props", "arguments", "result", "arguments_recorded", "result_recorded") if c in spans.columns])


def tool_names(calls: DataFrame) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "tool"))), lambda x: x["tool"])
    return calls.groupBy("trace_id").agg(names.alias("names"))


def tool_checks(calls: DataFrame, wanted: list[str], banned: list[str]) -> DataFrame:
    """(trace_id, includes, excludes, no_repeats) by partial aggregates: no trace's names are gathered."""
    seen = lambda name: F.bool_or(F.col("tool") == name)
    every = reduce(lambda a, b: a & b, map(seen, wanted), F.lit(True))
    none = ~F.bool_or(F.col("tool").isin(*banned)) if banned else F.lit(True)
    return calls.groupBy("trace_id").agg(every.alias("includes"), none.alias("excludes"), (F.count("tool") == F.count_distinct("tool")).alias("no_repeats"))


def include(names: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), names)) == 0


def exclude(names: Column, banned: list[str]) -> Column:
    return ~F.arrays_overlap(F.array(*map(F.lit, banned)).cast("array<string>"), names)


def no_repeats(names: Column) -> Column:
    return F.size(names) == F.size(F.array_distinct(names))


def _type_name(value) -> str:
    return {bool: "BOOLEAN", int: "BIGINT", str: "STRING"}.get(type(value), "")


def _equal(document: Column, value, path: str) -> Column:
    """Whether the variant at the path is the JSON value: same types, same keys, element by element."""
    at = F.try_variant_get(document, path, "variant")
    kind = F.schema_of_variant(at)
    if isinstance(value, (dict, list)):
        keyed = isinstance(value, dict)
        inner = F.map_keys(F.try_variant_get(document, path, "map<string, variant>")) if keyed else F.try_variant_get(document, path, "array<variant>")
        checks = [kind.startswith("OBJECT" if keyed else "ARRAY"), F.size(inner) == len(value)]
        checks += [_equal(document, v, f'{path}["{k}"]') for k, v in value.items()] if keyed else [_equal(document, v, f"{path}[{i}]") for i, v in enumerate(value)]
        return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))
    if value is None:
        return F.coalesce(F.is_variant_null(at), F.lit(False))
    if isinstance(value, float):
        return F.coalesce((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.try_variant_get(document, path, "double") == F.lit(value)), F.lit(False))
    if not _type_name(value):
        raise TypeError(f"not JSON: {value!r}")
    spark_type = {"BOOLEAN": "boolean", "BIGINT": "bigint", "STRING": "string"}[_type_name(value)]
    return F.coalesce((kind == _type_name(value)) & (F.try_variant_get(document, path, spark_type) == F.lit(value)), F.lit(False))


def contains_json(document: Column, wanted: dict) -> Column:
    """Whether a variant object holds `wanted`: objects by subset at every depth, arrays and scalars by type and value
    (true is not 1, 1 is not 1.0). An absent document never does, not even for an empty filter."""
    if not isinstance(wanted, dict):
        raise TypeError("a filter is a JSON object")
    checks = [document.isNotNull(), F.schema_of_variant(document).startswith("OBJECT")]

    def walk(value, path: str) -> None:
        at = F.try_variant_get(document, path, "variant")
        if isinstance(value, dict):
            checks.append(F.coalesce(F.schema_of_variant(at).startswith("OBJECT"), F.lit(False)))
            for k, v in value.items():
                walk(v, f'{path}["{k}"]')
        else:
            checks.append(_equal(document, value, path))

    for k, v in wanted.items():
        walk(v, f'$["{k}"]')
    return reduce(lambda a, b: a & b, checks)


def matching(calls: DataFrame, name: str, arguments: dict | None = None, result: dict | None = None, status: str | None = None) -> DataFrame:
    out = calls.filter(F.col("tool") == name)
    if status is not None:
        out = out.filter(F.col("status") == status)
    for column, wanted in (("arguments", arguments), ("result", result)):
        if wanted is not None:
            out = out.filter(F.col(f"{column}_recorded") & contains_json(F.col(column), strict_object(wanted)))
    return out


def called(calls: DataFrame, name: str, arguments: dict | None = None, result: dict | None = None, status: str | None = None) -> DataFrame:
    """Whether any call of each trace that has calls satisfies the filters."""
    hits = matching(calls, name, arguments, result, status).select("trace_id", F.lit(True).alias("hit")).distinct()
    return calls.select("trace_id").distinct().join(hits, "trace_id", "left").select("trace_id", F.coalesce("hit", F.lit(False)).alias("called"))


def trace_documents(spans: DataFrame) -> DataFrame:
    """One document per trace: its tool names and calls in order, cost, turns and extent. Only tool calls are gathered."""
    names = tool_names(tool_calls(spans))
    m = measures(spans).join(costs(spans), "trace_id").join(names, "trace_id", "left")
    none = F.array().cast("array<string>")
    return m.select("trace_id", F.coalesce("names", none).alias("tools"), "cost", "known_cost", "cost_available", "llm_turns", F.col("extent_ms").alias("duration_ms"))


def generative_spans(spans: DataFrame) -> DataFrame:
    """Spans of instrumented model calls: no kind of their own, and by operation, attributes and tool a model's."""
    from_attributes = expr.runtime_kind(F.lit(None).cast("string"), F.col("tool_name"), F.col("operation"), F.coalesce("has_genai", F.lit(False)))
    return spans.filter(F.col("explicit_kind").isNull() & (from_attributes == "llm"))


def costs(spans: DataFrame) -> DataFrame:
    """Known cost, whether every billable span is priced, and the cost if so."""
    billable = F.coalesce(F.lower("kind") == "llm", F.lit(False)) | F.col("cost_usd").isNotNull()
    priced = F.coalesce(F.col("cost_usd") >= 0, F.lit(False))
    g = spans.groupBy("trace_id").agg(F.round(F.sum(F.when(priced, F.col("cost_usd"))), 8).alias("known_cost"), F.count_if(billable).cast("long").alias("billable"), F.bool_and(priced | ~billable).alias("all_priced"))
    available = (F.col("billable") > 0) & F.col("all_priced")
    return g.select("trace_id", "known_cost", available.alias("cost_available"), F.when(available, F.col("known_cost")).alias("cost"))


def measures(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.count_if(F.lower("kind") == "llm").cast("long").alias("llm_turns"), F.coalesce(F.greatest(F.lit(0.0), (F.max("ended_at") - F.min("started_at")) / F.lit(1e6)), F.lit(0.0)).alias("extent_ms"))


def merge_spans(local: DataFrame, external: DataFrame) -> DataFrame:
    """Local spans with those of agent runs, numbered by (no start, start, source, run, sequence)."""
    a = local.select("trace_id", "span_id", "name", "started_at", F.lit(0).alias("source"), F.lit(0).cast("long").alias("run"), F.col("sequence").cast("long").alias("sequence"))
    b = external.select("trace_id", "span_id", "name", "started_at", F.lit(1).alias("source"), F.col("run").cast("long").alias("run"), F.col("sequence").cast("long").alias("sequence"))
    w = Window.partitionBy("trace_id").orderBy(F.col("started_at").isNull(), F.coalesce("started_at", F.lit(0)), "source", "run", "sequence")
    return a.unionByName(b).withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def dedup_spans(spans: DataFrame, order: str = "ord") -> DataFrame:
    """The first row of each span id."""
    return spans.groupBy("trace_id", "span_id").agg(F.min_by(F.struct(*[c for c in spans.columns if c not in ("trace_id", "span_id")]), order).alias("first")).select("trace_id", "span_id", "first.*")


def resolve_parents(spans: DataFrame) -> DataFrame:
    """parent_id, or null where no span of the trace has that id. A self left join on (trace, id): no trace's spans are
    gathered."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("found")).distinct()
    return spans.join(ids, ["trace_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("found"), F.col("parent_id"))).drop("found")


def attach_observations(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Traces with their observations; traces without any stay, observations without a trace go."""
    return traces.join(observations.filter("trace_id is not null"), "trace_id", "left")


def register_runs(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Equal duplicates once; raises on unlike rows of one id."""
    rest = F.to_json(F.struct(*[c for c in runs.columns if c != key]))
    g = runs.groupBy(key).agg(F.min(rest).alias("low"), F.max(rest).alias("high"), F.first(F.struct(*[c for c in runs.columns if c != key])).alias("row"))
    checked = g.withColumn("ok", F.assert_true(F.col("low") == F.col("high"), F.concat(F.lit("conflicting evidence for "), F.col(key).cast("string"))))
    return checked.filter(F.col("ok").isNull()).select(key, "row.*")
