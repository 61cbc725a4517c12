"""Redaction of whole JSON documents: a walk with path rules turns them into leaves, detection reads each leaf once, and
aliases go back by place.

A document's texts, numbers and free-form keys are leaves, numbered in the order of the walk. A first pass over the
documents emits the leaves with hits alone; these are few, and only they are shuffled. A second pass walks the documents
in the same order and puts the replaced leaves in.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.operators import detectors, redaction
from trialscope.sources.stage import staged

#: Names of secret fields, containers whose keys are data, and paths with rules of their own.
SECRET_KEY = re.compile(r"(secret|token|password|api[_-]?key|authorization|credential)", re.I)
FREE_FORM = frozenset(("attributes", "raw", "input", "output", "events", "metadata"))
SPAN = ("spans", "[]")
USAGE = (*SPAN, "usage")
TIMING = frozenset(
    [("duration_ms",), ("ended_at_unix_nano",), ("started_at_unix_nano",)]
    + [(*SPAN, k) for k in ("duration_ms", "ended_at_unix_nano", "started_at_unix_nano")]
    + [(*USAGE, k) for k in ("cache_creation_input_tokens", "cache_read_input_tokens", "cost_usd", "input_tokens", "output_tokens", "total_tokens")]
)
PROVENANCE = frozenset([("id",), ("schema_version",), ("source", "import_run_id"), ("source", "imported_at"), ("source", "provider"), (*SPAN, "id"), (*SPAN, "parent_id"), (*SPAN, "trace_id")])

KEY, TEXT, SECRET = "key", "text", "secret"
Visit = Callable[[str, str, bool], str | None]


def _stored(key: str, taken: dict) -> str:
    """The key, or a numbered one where redaction made two keys alike."""
    if key not in taken:
        return key
    n = 1
    while (other := f"[REDACTED_KEY_{n}]") in taken:
        n += 1
    return other


def walk(value, path: tuple[str, ...], visit: Visit):
    """The value with each leaf replaced by what visit(kind, text, timing) gives, if it isn't None.

    The whole value below a secret field, whatever its shape, is one leaf. Numbers keep their type unless replaced.
    Provenance fields aren't visited, timing numbers neither.
    """
    if isinstance(value, dict):
        out: dict = {}
        free = not FREE_FORM.isdisjoint(path)
        for key, item in value.items():
            shown = visit(KEY, key, False) if free and key.strip() else None
            stored = _stored(key if shown is None else shown, out)
            if path != USAGE and SECRET_KEY.search(key):
                out[stored] = visit(SECRET, item if isinstance(item, str) else json.dumps(item, sort_keys=True), False)
            else:
                out[stored] = walk(item, (*path, key), visit)
        return out
    if isinstance(value, list):
        return [walk(x, (*path, "[]"), visit) for x in value]
    if isinstance(value, str):
        new = None if path in PROVENANCE else visit(TEXT, value, path in TIMING)
        return value if new is None else new
    if value is None or isinstance(value, bool) or path in TIMING:
        return value
    new = visit(TEXT, str(value), False)
    return value if new is None else new


_LEAF = pa.schema([("trace_ord", pa.int64()), ("doc_ord", pa.int64()), ("leaf", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("score", pa.float64()), ("priority", pa.int32())])))])
_LEAF_SQL = "trace_ord long, doc_ord long, leaf int, kind string, text string, hits array<struct<start: int, end: int, type: string, score: double, priority: int>>"


def _found(registry: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for trace, doc, path, text in zip(*(batch.column(c).to_pylist() for c in ("trace_ord", "doc_ord", "path", "doc")), strict=True):
                n = 0

                def visit(kind: str, leaf: str, timing: bool, trace=trace, doc=doc) -> None:
                    nonlocal n
                    whole = [{"start": 0, "end": len(leaf), "type": "SECRET", "score": detectors.SECRET_SCORE, "priority": detectors.SECRETS}]
                    hits = whole if kind == SECRET else [h for h in detectors.detect(leaf, registry) if not (timing and h["type"] == "DATE_TIME")]
                    if hits:
                        rows.append({"trace_ord": trace, "doc_ord": doc, "leaf": n, "kind": kind, "text": leaf, "hits": hits})
                    n += 1

                walk(json.loads(text), tuple(path), visit)
            yield from pa.Table.from_pylist(rows, _LEAF).to_batches()

    return run


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = []
        for path, text, replaced in zip(*(batch.column(c).to_pylist() for c in ("path", "doc", "replaced")), strict=True):
            if not replaced:
                docs.append(text)
                continue
            new, n = {r["leaf"]: r["text"] for r in replaced}, 0

            def visit(kind: str, leaf: str, timing: bool, new=new) -> str | None:
                nonlocal n
                n += 1
                return new.get(n - 1)

            docs.append(json.dumps(walk(json.loads(text), tuple(path), visit), ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([batch.column("trace_ord"), batch.column("doc_ord"), pa.array(docs, pa.string())], ["trace_ord", "doc_ord", "doc"])


def redact_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: (trace_ord long, doc_ord long, path array<string>, doc string). Returns (trace_ord, doc_ord, doc), redacted,
    and its leaves (trace_ord, doc_ord, leaf, kind, type, number, text, replaced, n_spans).

    doc is a JSON text and stands at path in its trace, which the path rules refer to. Aliases are numbered through the
    run, an identity anew in each trace, in the order of documents and leaves. A document that is no JSON fails the job.
    """
    chosen = list(detectors.REGISTRY)
    docs = docs.select("trace_ord", "doc_ord", "path", "doc").filter("doc is not null")
    found = docs.mapInArrow(_found(chosen), _LEAF_SQL)
    found = staged(found.withColumn("spans", redaction.union_spans(F.col("hits"))).drop("hits"), "leaves")
    place = F.struct("doc_ord", "leaf")
    named = redaction.named_spans(found.withColumn("leaf_ord", place))
    leaves = staged(named.select("trace_ord", "leaf_ord.doc_ord", "leaf_ord.leaf", "kind", "text", "replaced", "n_spans", "types"), "replaced")
    by_doc = leaves.groupBy("trace_ord", "doc_ord").agg(F.collect_list(F.struct("leaf", F.col("replaced").alias("text"))).alias("replaced"))
    out = docs.join(by_doc, ["trace_ord", "doc_ord"], "left").mapInArrow(_replaced, "trace_ord long, doc_ord long, doc string")
    return out, leaves


def statistics(leaves: DataFrame) -> dict:
    """Spans, changed values, whether a secret field was found, and the aliases of each entity type."""
    row = leaves.agg(F.coalesce(F.sum("n_spans"), F.lit(0)).alias("spans"), F.count_if(~F.col("text").eqNullSafe(F.col("replaced"))).alias("changed"), F.coalesce(F.bool_or(F.col("kind") == SECRET), F.lit(False)).alias("secret")).first()
    counts = leaves.select(F.explode("types").alias("t")).groupBy("t.type").agg(F.max("t.number").alias("n")).orderBy("type").collect()  # a row per type
    return {"redacted_span_count": row.spans, "changed_value_count": row.changed, "secret_keys_redacted": row.secret, "entity_instance_counts": {r.type: r.n for r in counts}}
