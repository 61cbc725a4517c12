"""Artifacts: gated reads of redacted traces, staged writes, manifests and reports.

Driver-side code here handles one-row manifests and file moves only; trace rows stay in DataFrames.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import secrets
import tempfile
import uuid
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.functions import expr, formats
from trialscope.operators import contracts, detectors, documents, scoring
from trialscope.operators import traces as operators
from trialscope.sources import exporter, readers, versions
from trialscope.sources.stage import exists, numbered, shared_dir, staged

VERSION = "redactor-v2"
SCHEME = "hmac-sha256-96"


class GateError(RuntimeError):
    """The artifact must not be read."""


def file_size(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def bounded(spark: SparkSession, path: str, most: int) -> None:
    if file_size(spark, path) > most:
        raise ValueError(f"{path} is larger than {most} bytes")


def digest(spark: SparkSession, path: str) -> str:
    """One digest for all files of a path: that of the files' digests in order of their names."""
    parts = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    return parts.agg(F.sha2(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha"))), lambda x: x["sha"]), ","), "UTF-8"), 256)).first()[0]


#: Model and version that a manifest may name: the pattern detectors. register_model() adds a named-entity model.
MODELS: set[tuple[str, str]] = {("patterns", "1")}

_MANIFEST = (
    "raw_source boolean, version string, mandatory boolean, value_redaction_applied boolean, redaction_available boolean, ruleset_hash string, "
    "language string, pseudonymization string, model struct<name: string, version: string, checksum_verified: boolean>"
)


def register_model(name: str, version: str) -> None:
    MODELS.add((name, version))


def _rules(rules: str) -> list[tuple[Column, str]]:
    """What makes a manifest unsafe, in order."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    model = F.struct(F.col("model.name"), F.col("model.version"))
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("version")) for n, v in sorted(MODELS)))
    return [
        (yes("raw_source"), "raw source"),
        (~F.col("version").eqNullSafe(VERSION), "not redacted by this version"),
        (~yes("mandatory"), "redaction was not mandatory"),
        (~yes("value_redaction_applied"), "values were not redacted"),
        (~yes("redaction_available"), "redaction was not available"),
        (~F.col("ruleset_hash").eqNullSafe(rules), "unknown ruleset"),
        (~F.col("language").eqNullSafe("en"), "unsupported language"),
        (F.coalesce("pseudonymization", F.lit("")) == "", "no pseudonyms"),
        (~F.col("pseudonymization").eqNullSafe(SCHEME), "unsupported pseudonyms"),
        (F.col("model").isNull(), "no model"),
        (~F.coalesce(F.array_contains(known, model), F.lit(False)), "unknown model"),
        (~yes("model.checksum_verified"), "unverified model"),
    ]


def manifest_problems(manifests: DataFrame, rules: str | None = None) -> DataFrame:
    """path and problem of each unsafe manifest, of a table of them (path, and the columns of _MANIFEST)."""
    problem: Column | None = None
    for bad, why in _rules(rules or detectors.ruleset_hash()):
        problem = F.when(bad, why) if problem is None else problem.when(bad, why)
    return manifests.withColumn("problem", problem).filter("problem is not null").select("path", "problem")


def manifest_problem(manifest: dict | None, rules: str | None = None) -> str | None:
    """Why a manifest isn't safe, by the same rules; None if it is."""
    if not isinstance(manifest, dict) or not manifest:
        return "no manifest"
    spark = SparkSession.active()
    text = F.lit(json.dumps(manifest))
    row = spark.range(1).select(F.lit("").alias("path"), F.from_json(text, _MANIFEST).alias("m")).select("path", "m.*")
    found = manifest_problems(row, rules).first()
    return found.problem if found else None


def manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """path and fields of all manifests of a pattern; those that are no JSON have no fields."""
    text = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.from_json("value", _MANIFEST).alias("m")).select("path", "m.*")


def _paths(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs, _ = _paths(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def pseudonym_key(path: str) -> bytes:
    """The key of a file on the driver, made if there is none: 32 random bytes for the owner alone. The file appears
    whole or not at all; of two writers at once the first one's key stays."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        handle, new = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
        try:
            os.write(handle, secrets.token_bytes(32))
            os.close(handle)
            os.link(new, path)
        except FileExistsError:
            pass
        finally:
            os.unlink(new)
    os.chmod(path, 0o600)
    with open(path, "rb") as f:
        key = f.read()
    if len(key) != 32:
        raise ValueError(f"{path} holds no key of 32 bytes")
    return key


def pseudonymous(traces: DataFrame, spans: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """Both tables with keyed hashes for ids; a parent that is no span of the trace becomes null."""
    own = lambda c: expr.pseudonym(key, "span", F.col("trace_id"), F.col(c))
    s = operators.resolve_parents(spans).withColumns({"span_id": own("span_id"), "parent_id": own("parent_id"), "trace_id": expr.pseudonym(key, "trace", F.col("trace_id"))})
    return traces.withColumn("id", expr.pseudonym(key, "trace", F.col("id"))), s.select(*spans.columns)


#: Fields of a trace and of a span that are redacted, as one document each.
TRACE_FIELDS, SPAN_FIELDS = ("name", "status", "input", "output"), ("name", "kind", "tool_name", "status", "status_message", "input", "output", "usage")


def _document(fields: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*fields))


def _fields(doc: Column, fields: tuple[str, ...]) -> dict[str, Column]:
    """The fields of a redacted document: payloads as JSON text, usage as it was but for its texts, others as text."""
    v = F.parse_json(doc)
    out = {}
    for f in fields:
        got = F.try_variant_get(v, readers.path(f), "variant")
        out[f] = F.to_json(got) if f in ("input", "output") else F.from_json(F.to_json(got), readers.USAGE_SQL) if f == "usage" else F.try_variant_get(v, readers.path(f), "string")
    return out


def import_traces(spark: SparkSession, provider: str, source: str, out: str, limit: int | None = 1000, max_bytes: int = 50_000_000, prefix: str = formats.PREFIX, key: bytes | None = None, run_id: str | None = None) -> dict:
    """Reads an export, replaces ids by pseudonyms, redacts the first `limit` traces (None: all) and writes traces, spans
    and their manifest as one version. key: of the pseudonyms, 32 bytes; without one, a key drawn for this import links nothing else.

    A jsonl beside a manifest that calls it a local capture is one. The detectors read each value once.
    """
    if (limit is not None and limit < 1) or max_bytes < 1:
        raise ValueError("limit and max_bytes are at least 1")
    if key is not None and len(key) < 16:
        raise ValueError("a key has at least 16 bytes")
    provider = capture_provider(spark, provider.lower(), source)
    bounded(spark, source, max_bytes)
    export = readers.read(spark, provider, source, prefix)
    traces = numbered(readers.trace_rows(export), ["trace_ord"], "n")
    traces = staged(traces.filter(F.col("n") < limit) if limit else traces, "import-traces")
    spans = numbered(export.spans.drop("trace_ord").join(traces.select(F.col("id").alias("trace_id"), "n"), "trace_id"), ["n", "span_ord"], "place")
    first = spans.groupBy("n").agg(F.min("place").alias("first"))
    spans = staged(spans.join(first, "n").withColumn("doc_ord", F.col("place") - F.col("first") + 1).drop("span_ord", "place", "first"), "import-spans")
    whole = F.array().cast("array<string>")
    docs = traces.select(F.col("n").alias("trace_ord"), F.lit(0).cast("long").alias("doc_ord"), whole.alias("path"), _document(TRACE_FIELDS).alias("doc"))
    docs = docs.unionByName(spans.select(F.col("n").alias("trace_ord"), "doc_ord", F.array(*map(F.lit, documents.SPAN)).alias("path"), _document(SPAN_FIELDS).alias("doc")))
    safe, leaves = documents.redact_documents(docs)
    safe = staged(safe, "import-safe")
    key = key or secrets.token_bytes(32)
    run_id = run_id or uuid.uuid4().hex
    now = dt.datetime.now(dt.UTC).isoformat()
    s = spans.join(safe.filter("doc_ord > 0").withColumnRenamed("trace_ord", "n"), ["n", "doc_ord"]).withColumns(_fields(F.col("doc"), SPAN_FIELDS)).drop("doc")
    t = traces.join(safe.filter("doc_ord = 0").select(F.col("trace_ord").alias("n"), "doc"), "n").withColumns(_fields(F.col("doc"), TRACE_FIELDS))
    t = t.withColumns({"provider": F.lit(provider), "import_run_id": F.lit(run_id), "imported_at": F.lit(now)})
    t, s = pseudonymous(t, s, key)
    parts = {"spans": s.select("n", "doc_ord", *readers.SPAN_COLUMNS), "traces": t.select("n", *TRACE_COLUMNS)}
    made = {name: versions.written(df, out) for name, df in parts.items()}
    stats = documents.statistics(leaves)
    manifest = {"version": VERSION, "mandatory": True, "language": "en", "value_redaction_applied": True, "redaction_available": True, "ruleset_hash": detectors.ruleset_hash(), "pseudonymization": SCHEME, "model": {"name": "patterns", "version": "1", "checksum_verified": True}}
    manifest |= stats | {"trace_count": traces.count(), "span_count": spans.count(), "provider": provider, "import_run_id": run_id, "imported_at": now, "sha256": _digests(spark, out, made)}
    schemas = {name: df.schema.json() for name, df in parts.items()}
    versions.transact(spark, out, lambda _: versions.Change(made, schemas, tuple(made), {"manifest": manifest}))
    write_text(spark, f"{out}/manifest.json", json.dumps(manifest, sort_keys=True))  # for those who look; the version holds its own
    return manifest


def import_records(spark: SparkSession, provider: str, payload: object, out: str, **options) -> dict:
    """An import of records held by the driver, as when a connector fetched them: bounded by their JSON's length."""
    text = json.dumps(payload, sort_keys=True)
    if len(text.encode()) > options.get("max_bytes", 50_000_000):
        raise ValueError("the records are larger than max_bytes")
    source = f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}.json"
    write_text(spark, source, text)
    return import_traces(spark, provider, source, out, **options)


TRACE_COLUMNS = ("id", "name", "provider", "import_run_id", "imported_at", "started_at", "ended_at", "duration_ms", "status", "input", "output", "span_count")


def _digests(spark: SparkSession, out: str, members: Mapping[str, versions.Parts]) -> str:
    return ",".join(digest(spark, f"{out.rstrip('/')}/{members[name][versions.WHOLE]}") for name in ("traces", "spans"))


def warnings(manifest: dict) -> list[str]:
    """What an import's user should know."""
    out = ["secret-like fields were redacted"] if manifest.get("secret_keys_redacted") else []
    changed = int(manifest.get("changed_value_count") or 0)
    return out + ([f"redaction changed {changed} value(s)"] if changed else [])


def load(spark: SparkSession, out: str, part: str = "spans", number: int | None = None) -> DataFrame:
    """The spans or traces of an import, by default the last into this folder, if its manifest is safe, its files are
    those that were written and their columns those of the format. An import under way or cut short is not seen."""
    found = versions.version(spark, out, number)
    manifest = found.state.get("manifest")
    if not manifest:
        raise GateError("no readable manifest")
    problem = manifest_problem(manifest)
    if problem:
        raise GateError(problem)
    if _digests(spark, out, found.members) != manifest.get("sha256"):
        raise GateError("the files are not those of the manifest")
    df = versions.read(spark, out, part, found)
    wanted = {"n", "doc_ord", *readers.SPAN_COLUMNS} if part == "spans" else {"n", *TRACE_COLUMNS}
    if set(df.columns) != wanted:
        raise GateError("the columns are not those of the format")
    return df


def load_traces(spark: SparkSession, out: str) -> DataFrame:
    return load(spark, out)


def capture_provider(spark: SparkSession, provider: str, source: str) -> str:
    """local-jsonl for a jsonl whose folder, or the one above, has a manifest that says so."""
    if provider != "jsonl":
        return provider
    folder = source.rsplit("/", 1)[0]
    for place in (folder, folder.rsplit("/", 1)[0]):
        if exists(spark, f"{place}/manifest.json"):
            try:
                found = json.loads(read_text(spark, f"{place}/manifest.json"))
            except ValueError:
                continue
            return "local-jsonl" if isinstance(found, dict) and found.get("source") == "local-jsonl" else provider
    return provider


def write_spans(spans: DataFrame, folder: str, run_id: str, batch: tuple[str, int] | None = None) -> dict:
    """Adds to a run's raw spans and writes their manifest, which is never safe: raw spans become evidence by an import
    only. Counts are carried on from append to append; a batch, (source, number), is added once."""
    manifest = exporter.append(spans, folder, run_id, batch)
    write_text(spans.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


LATEST = "trace-import-latest-1"


def write_latest(spark: SparkSession, pointer: str, artifact: str, manifest: dict) -> None:
    keep = {k: manifest.get(k) for k in ("provider", "trace_count", "span_count", "imported_at")}
    write_text(spark, pointer, json.dumps({"schema_version": LATEST, "artifact_path": artifact, **keep}, sort_keys=True))


def resolve_latest(spark: SparkSession, source: str | None, pointer: str) -> str:
    """The named source, without file:, or what the pointer names, relative to the pointer's folder."""
    if source:
        return source.removeprefix("file:")
    if not exists(spark, pointer):
        raise ValueError("no latest import: import traces first or name a source")
    try:
        found = json.loads(read_text(spark, pointer))
    except ValueError as error:
        raise ValueError("the pointer to the latest import is malformed") from error
    if not isinstance(found, dict) or found.get("schema_version") != LATEST:
        raise ValueError("the pointer to the latest import is malformed")
    artifact = found.get("artifact_path")
    if not isinstance(artifact, str) or not artifact:
        raise ValueError("the pointer to the latest import names no artifact")
    path = artifact if "://" in artifact or artifact.startswith("/") else f"{pointer.rsplit('/', 1)[0]}/{artifact}"
    if not exists(spark, path):
        raise ValueError(f"the latest import is not there: {path}")
    return path


RESULT = "run-result-1"
TRIAL_COLUMNS = ("nodeid", "group_id", "case_id", "trial_index", "configured_trials", "status", "failure_kind", "failure_category", "smoke", "duration_ms", "cost_usd", "llm_turns")


def write_run(trials: DataFrame, out: str, run_id: str, complete: bool = True, interruption: str | None = None) -> dict:
    """A run's trials in order, its aggregates and summary, and its manifest, as one version. A broken contract, or a
    writer that dies, leaves the old run."""
    spark = trials.sparkSession
    t = staged(trials.select(*TRIAL_COLUMNS), "run-trials")
    provisional = t.filter("status = 'provisional'").count()
    broken = contracts.trial_contract(t).first()
    if broken:
        raise ValueError(f"{broken.rule}: {broken.key}")
    if complete and (provisional or interruption):
        raise ValueError("a complete run is neither interrupted nor provisional")
    members = {"trials": t.orderBy("group_id", "trial_index", "nodeid"), "aggregates": scoring.verdicts(t)}
    members |= {f"summary/{name}": df for name, df in scoring.run_summary(t).items()}
    manifest = {"schema_version": RESULT, "run_id": run_id, "complete": complete, "interruption": interruption, "trials": t.count()}
    versions.replace(spark, out, members, {"manifest": manifest})
    return manifest


def load_run(spark: SparkSession, out: str, number: int | None = None) -> DataFrame:
    """The trials of a run, after its version, contract, aggregates and summary were found right."""
    found = versions.version(spark, out, number)
    manifest = found.state.get("manifest")
    if not isinstance(manifest, dict) or "schema_version" not in manifest:
        raise ValueError("no readable result of a known schema version")
    if manifest["schema_version"] != RESULT:
        raise ValueError(f"unsupported schema version {manifest['schema_version']!r}")
    t = versions.read(spark, out, "trials", found)
    if set(t.columns) != set(TRIAL_COLUMNS):
        raise ValueError("the trials' columns are not those of the format")
    run = spark.createDataFrame([(manifest["run_id"], manifest["complete"], manifest["interruption"], t.filter("status = 'provisional'").count())], "run_id string, complete boolean, interruption string, provisional long")
    stored = {name: versions.read(spark, out, f"summary/{name}", found) for name in scoring.SUMMARY_PARTS}
    problems = contracts.all_of(contracts.run_complete(run), contracts.trial_contract(t), contracts.derived_equal(t, versions.read(spark, out, "aggregates", found)), contracts.summary_equal(t, stored))
    broken = problems.first()
    if broken:
        raise ValueError(f"{broken.rule}: {broken.key}")
    return t


def trial_traces(trials: DataFrame, run_id: str) -> DataFrame:
    """One record per trial with a case, under an id of run, case and index."""
    id_ = F.concat_ws("_", F.lit(run_id), "case_id", F.concat(F.lit("trial"), F.col("trial_index").cast("string")))
    return trials.filter("case is not null").select(id_.alias("id"), F.lit(run_id).alias("run_id"), *[c for c in trials.columns if c not in ("id", "run_id")])


def queue_files(spark: SparkSession, folder: str, parse: Callable[[str], object]) -> tuple[DataFrame, DataFrame]:
    """Review queues of a folder's .yaml, .yml and .json files: (file, item) with items as JSON text, and (file, problem)
    of files that can't be read; other files count as legacy. parse turns a file's text into an object and runs on
    executors: json.loads, or a YAML loader where one is installed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    named = files.filter(F.col("file").rlike(r"\.(ya?ml|json)$"))

    def read(batches):
        for batch in batches:
            rows = {"file": [], "item": [], "problem": []}
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                items, problem = [], None
                try:
                    found = parse(content.decode())
                    items = found["items"] if isinstance(found, dict) and isinstance(found.get("items"), list) else None
                    if items is None or any(not isinstance(x, dict) for x in items):
                        items, problem = [], "no list of items"
                except Exception as error:  # a file's own fault is a row, not the job's end
                    problem = f"cannot be read: {type(error).__name__}"
                for item, why in [(json.dumps(x, sort_keys=True), None) for x in items] + ([(None, problem)] if problem else []):
                    rows["file"].append(file)
                    rows["item"].append(item)
                    rows["problem"].append(why)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([(c, pa.string()) for c in rows]))

    got = staged(named.mapInArrow(read, "file string, item string, problem string"), "queues")
    legacy = files.filter(F.col("file").endswith(".md")).select("file", F.lit("legacy queue ignored").alias("problem"))
    return got.filter("item is not null").select("file", "item"), got.filter("problem is not null").select("file", "problem").unionByName(legacy)


def latest_path(spark: SparkSession, pattern: str) -> str | None:
    """The newest file of a pattern."""
    return spark.read.format("binaryFile").load(pattern).agg(F.max_by("path", "modificationTime")).first()[0]


def since(text: str, now: dt.datetime | None = None) -> dt.datetime | str:
    """30m, 12h, 7d or 2w ago, an ISO time (naive is UTC, without microseconds), or the text as it is."""
    now = now or dt.datetime.now(dt.UTC)
    if m := re.fullmatch(r"(\d+)([mhdw])", text.strip()):
        unit = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
        return now - dt.timedelta(**{unit: int(m[1])})
    try:
        t = dt.datetime.fromisoformat(text.strip())
    except ValueError:
        return text
    return (t if t.tzinfo else t.replace(tzinfo=dt.UTC)).replace(microsecond=0)


def pages(fetch, limit: int, size: int = 100) -> list[dict]:
    """Rows of a paged source: fetch(page, size) gives {"data": [...], "meta": {...}}; until limit or the last page."""
    rows: list[dict] = []
    page = 1
    while len(rows) < limit:
        got = fetch(page, min(limit, size))
        data, meta = got.get("data"), got.get("meta") or {}
        if not isinstance(data, list):
            raise ValueError("a page has no data list")
        rows += [r for r in data if isinstance(r, dict)]
        last = meta.get("totalPages", meta.get("total_pages"))
        if not data or (last is not None and page >= int(last)) or (last is None and len(data) < size):
            break
        page += 1
    return rows[:limit]


def discover(fetch, limit: int) -> list[str]:
    """Ids of a source paged by cursor, each once, in the order they were first seen, up to limit: fetch(cursor) gives
    {"data": [{"traceId": ...}], "meta": {"cursor": ...}}. A cursor that comes again fails."""
    ids: dict[str, None] = {}
    cursor, seen = None, set()
    while len(ids) < limit:
        got = fetch(cursor)
        data, cursor = got.get("data"), (got.get("meta") or {}).get("cursor")
        if not isinstance(data, list):
            raise ValueError("a page has no data list")
        ids |= dict.fromkeys(str(r["traceId"]) for r in data if isinstance(r, dict) and r.get("traceId"))
        if not cursor:
            break
        if cursor in seen:
            raise ValueError("the source's cursor does not advance")
        seen.add(cursor)
    return list(ids)[:limit]


def fetched(legacy: Callable[[], list], current: Callable[[], list], mode: str = "auto") -> list:
    """Records of a connector by the mode asked for; auto takes the newer interface only if the older isn't there."""
    if mode != "auto":
        return {"legacy": legacy, "current": current}[mode]()
    try:
        return legacy()
    except FileNotFoundError:
        return current()


def report(summary: dict[str, DataFrame], verdicts: DataFrame, top: int = 200) -> str:
    """A Markdown report: the reliability curve, cost and latency, and the first `top` groups that did not pass."""
    lines = ["# Report", "", "| k | pass^k | cohorts |", "|-|-|-|"]
    lines += [f"| {r.k} | {r.value:.3f} | {r.cohorts} |" for r in summary["pass_k_curve"].orderBy("k").limit(top).collect()]
    for name in ("latency", "cost"):
        lines += ["", f"## {name.capitalize()}", "", *(f"- {k}: {v}" for k, v in summary[name].first().asDict().items())]
    lines += ["", "## Not passed", ""]
    lines += [f"- {r.group_id}: {r.verdict} ({r.passed}/{r.total})" for r in verdicts.filter("verdict <> 'pass'").orderBy("group_id").limit(top).collect()]
    return "\n".join(lines) + "\n"
