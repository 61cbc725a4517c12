"""Redaction: hits to disjoint spans, spans to run-wide numbered aliases, aliases into the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.operators import detectors
from trialscope.operators.queues import folded, squeezed
from trialscope.sources.stage import staged

HIDDEN = "[REDACTED]"
#: Traces whose counts one task sums up at a time for the alias offsets.
STRIDE = 1 << 16


def union_spans(hits: Column) -> Column:
    """Overlapping hits joined; touching ones stay apart. The best (score, priority) names a span; if hits of different
    types share the best, the span is conflicted. Within a row: no shuffle."""
    ordered = F.array_sort(hits)  # by start, then end
    empty = F.array().cast("array<struct<start:int,end:int,type:string,score:double,priority:int,conflicted:boolean>>")

    def one(h: Column, like: Column | None = None) -> Column:
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), h["type"].alias("type"), h["score"].alias("score"), h["priority"].alias("priority"), F.lit(False).alias("conflicted"))

    def step(acc: Column, h: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        key, best = F.struct(h["score"], h["priority"]), F.struct(last["score"], last["priority"])
        better = key > best
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], h["end"]).alias("end"),
            F.when(better, h["type"]).otherwise(last["type"]).alias("type"),
            F.when(better, h["score"]).otherwise(last["score"]).alias("score"),
            F.when(better, h["priority"]).otherwise(last["priority"]).alias("priority"),
            F.when(better, F.lit(False)).otherwise(last["conflicted"] | ((key == best) & (h["type"] != last["type"]))).alias("conflicted"),
        )
        overlaps = (F.size(acc) > 0) & (h["start"] < last["end"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(one(h))))

    return F.aggregate(ordered, empty, step)


def splice(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, alias), in order, replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["alias"]).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def alias_numbers(found: DataFrame) -> DataFrame:
    """found: (trace_ord, leaf_ord, start, type, identity). Adds number: per type, identities in order of their first
    place in the run, an identity counting anew in each trace.

    A number is the identity's rank within its trace plus what earlier traces used, summed in strides of traces, so no
    task orders all hits.
    """
    first = found.groupBy("type", "trace_ord", "identity").agg(F.min(F.struct("leaf_ord", "start")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("type", "trace_ord").orderBy("first"))
    ranked = first.select("type", "trace_ord", "identity", rank.alias("rank"))
    used = ranked.groupBy("type", "trace_ord").agg(F.count("*").alias("n")).withColumn("stride", F.floor(F.col("trace_ord") / STRIDE))
    by_stride = used.groupBy("type", "stride").agg(F.sum("n").alias("n"))
    before = by_stride.select("type", "stride", (F.sum("n").over(Window.partitionBy("type").orderBy("stride").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("type", "stride").orderBy("trace_ord").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = used.withColumn("within", within).join(before, ["type", "stride"]).select("type", "trace_ord", (F.col("before") + F.col("within")).alias("offset"))
    return ranked.join(offsets, ["type", "trace_ord"]).select("type", "trace_ord", "identity", (F.col("rank") + F.col("offset")).alias("number"))


def named_spans(found: DataFrame) -> DataFrame:
    """found: (trace_ord, leaf_ord, text, spans), as from union_spans, and any other columns. Adds replaced (the text with
    its aliases), n_spans and types (type and number of each alias). Rows must be written before: they are read thrice."""
    known = F.col("s.type").isin(*detectors.TYPES) & ~F.col("s.conflicted")
    value = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    exploded = found.select("trace_ord", "leaf_ord", "text", F.explode("spans").alias("s")).select("trace_ord", "leaf_ord", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.when(known, F.col("s.type")).alias("type"), value.alias("value"))
    folds = F.col("type").isin(*detectors.FOLDED_TYPES)
    plain = exploded.filter(~F.coalesce(folds, F.lit(False))).withColumn("identity", F.col("value"))
    names = exploded.filter(folds).withColumn("identity", squeezed(folded(F.col("value"))))
    exploded = plain.unionByName(names)
    numbers = alias_numbers(exploded.filter("type is not null"))
    named = exploded.join(numbers, ["type", "trace_ord", "identity"], "left")
    alias = F.when(F.col("type").isNull(), F.lit(HIDDEN)).otherwise(F.concat(F.lit("["), F.col("type"), F.lit("_"), F.col("number").cast("string"), F.lit("]")))
    by_leaf = named.groupBy("trace_ord", "leaf_ord").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", alias.alias("alias")))).alias("aliases"),
        F.collect_set(F.when(F.col("type").isNotNull(), F.struct("type", "number"))).alias("types"),
    )
    out = found.drop("spans").join(by_leaf, ["trace_ord", "leaf_ord"])
    return out.withColumns({"replaced": splice(F.col("text"), F.col("aliases")), "n_spans": F.size("aliases")}).drop("aliases")


def redact(leaves: DataFrame, drop_dates: str | None = None) -> DataFrame:
    """leaves: (trace_ord long, leaf_ord long, text). Adds redacted and n_spans. drop_dates names a boolean column: where
    it is true, dates stay. A null text stays null. Texts without a sign of any value never reach the detectors."""
    dates = F.coalesce(F.col(drop_dates), F.lit(False)) if drop_dates else F.lit(False)
    read = leaves.filter(detectors.gated(F.col("text"))).select("trace_ord", "leaf_ord", "text", dates.alias("no_dates"))
    hits = F.filter(detectors.detector_udf()(F.col("text")), lambda h: ~F.col("no_dates") | (h["type"] != "DATE_TIME"))
    found = staged(read.withColumn("spans", union_spans(hits)).filter(F.size("spans") > 0).drop("no_dates"), "found")
    named = named_spans(found).select("trace_ord", "leaf_ord", "replaced", "n_spans")
    out = leaves.join(named, ["trace_ord", "leaf_ord"], "left")
    return out.withColumns({"redacted": F.coalesce("replaced", "text"), "n_spans": F.coalesce("n_spans", F.lit(0))}).drop("replaced")


def manifest(redacted: DataFrame) -> DataFrame:
    """One row: spans, changed values, traces and the ruleset."""
    return redacted.agg(
        F.coalesce(F.sum("n_spans"), F.lit(0)).alias("redacted_span_count"),
        F.count_if(F.col("redacted") != F.col("text")).cast("long").alias("changed_value_count"),
        F.count_distinct("trace_ord").alias("trace_count"),
        F.lit(detectors.ruleset_hash()).alias("ruleset_hash"),
    )
