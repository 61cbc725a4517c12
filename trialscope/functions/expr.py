"""Scalar expressions of the trace and trial model."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialscope.functions import formats


def status_of(value: Column) -> Column:
    """ok, error or unknown from a status text: blank is unknown, anything with error or fail in it is an error."""
    t = F.lower(F.trim(value))
    bad = reduce(lambda a, b: a | b, [t.contains(p) for p in formats.ERROR_PARTS])
    return F.when(t.isNull() | (t == ""), "unknown").when(bad | t.isin(*formats.ERROR_WORDS), "error").when(t.isin(*formats.OK_WORDS), "ok").otherwise("unknown")


def status_of_flag(is_error: Column) -> Column:
    """A boolean status says whether there was an error."""
    return F.when(is_error.isNull(), "unknown").when(is_error, "error").otherwise("ok")


def kind_of(kind: Column, tool_name: Column) -> Column:
    k, tool = F.lower(kind), F.coalesce(tool_name != "", F.lit(False))
    return F.when(k.isNull(), F.when(tool, "tool").otherwise("span")).when((k == "tool") | tool, "tool").when(k.isin("generation", "llm"), "llm").otherwise(k)


def runtime_kind(explicit: Column, tool_name: Column, operation: Column, has_genai: Column) -> Column:
    """Explicit kind as it is, tool, generative operation or another, any generative attribute, else span."""
    tool = F.coalesce(tool_name != "", F.lit(False))
    by_operation = F.when(operation.isin(*formats.GENERATION), "llm").otherwise("span")
    return F.when(F.coalesce(explicit != "", F.lit(False)), explicit).when(tool, "tool").when(operation.isNotNull(), by_operation).when(has_genai, "llm").otherwise("span")


def long_of(value: Column) -> Column:
    """The long that a text writes, else null. What is no number isn't cast: a failed cast costs an exception a row."""
    return F.when(value.rlike(r"^[\s\p{Cntrl}]*[+-]?[0-9]+[\s\p{Cntrl}]*$"), value.try_cast("long"))


def double_of(value: Column) -> Column:
    """The double that a text writes, else null. Texts without a digit are cast only if they may name a number."""
    return F.when(value.rlike(r"[0-9]|[iInN]"), value.try_cast("double"))


def nanos_of(value: Column) -> Column:
    """Unix nanoseconds of an integer text (as it is), a float text (truncated) or an ISO timestamp (naive is UTC).

    ISO times go through a float number of seconds, as in the format's own readers, so the last digits agree.
    """
    s = F.trim(value)
    iso = (F.unix_micros(F.try_to_timestamp(s)) / F.lit(1e6) * F.lit(1e9)).cast("long")
    number = F.when(s.rlike(r"^[+-]?\d+\.\d*$"), s.try_cast("double").cast("long"))
    return F.coalesce(long_of(s), number, F.when(s.rlike(r"^\d{4}-"), iso))


def nanos_of_timestamp(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) / F.lit(1e6) * F.lit(1e9)).cast("long")


def duration_ms(start: Column, end: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), (end - start) / F.lit(1e6)), F.lit(0.0))


def int_of(value: Column) -> Column:
    """Whole-number text only ("12"); "1.5" and booleans give null."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).try_cast("long"))


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def cost_of(value: Column) -> Column:
    """A finite cost of at least 0, else null."""
    return F.when(finite(value) >= 0, value)


def total_tokens(given: Column, inputs: Column, outputs: Column) -> Column:
    both = F.coalesce(inputs, F.lit(0)) + F.coalesce(outputs, F.lit(0))
    return F.coalesce(given, F.when(inputs.isNotNull() | outputs.isNotNull(), both))


def first_text(*values: Column) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*(F.when(v != "", v) for v in values))


def pass_hat_k(passed: Column, total: Column, k: Column) -> Column:
    """C(passed, k) / C(total, k): the chance that k trials drawn from all pass."""
    product = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), F.lit(1.0), lambda a, i: a * (passed - i) / (total - i))
    return F.when((k <= 0) | (total < k), F.lit(None).cast("double")).when(passed < k, F.lit(0.0)).otherwise(product)


def p95(values: Column) -> Column:
    """Nearest rank with half-even rounding of 0.95 (n - 1), over a sorted array."""
    return F.when(F.size(values) > 0, F.element_at(values, F.bround(F.lit(0.95) * (F.size(values) - 1), 0).cast("int") + 1)).otherwise(F.lit(0.0))


def subsequence(wanted: list[str], names: Column) -> Column:
    """Whether wanted occurs in names in this order, gaps allowed, each name used once."""

    def step(at: Column, x: Column) -> Column:
        found = F.array_position(F.slice(names, at + 1, F.greatest(F.size(names) - at, F.lit(0))), x).cast("int")
        return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

    return F.aggregate(F.array(*map(F.lit, wanted)).cast("array<string>"), F.lit(0), step) >= 0


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column, from sha2 alone."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def pseudonym(key: bytes, namespace: str, *values: Column) -> Column:
    """namespace_ and 24 hex digits of the keyed hash of the namespace and values, joined by NUL."""
    message = F.concat_ws("\0", F.lit(namespace), *(v.cast("string") for v in values))
    return F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), F.concat(F.lit(f"{namespace}_"), F.substring(hmac_sha256(key, message), 1, 24)))


def iban_valid(value: Column) -> Column:
    compact = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)

    def step(a: Column, i: Column) -> Column:
        n = code(F.substring(turned, i, F.lit(1)))
        return F.pmod(F.when(n > 9, a * 100).otherwise(a * 10) + n, F.lit(97)).cast("long")

    return F.when(compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0).cast("long"), step) == 1).otherwise(F.lit(False))


def card_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return digits.rlike("^[2-6][0-9]{12,18}$") & ~digits.rlike(r"^(\d)\1*$") & F.call_function("luhn_check", digits)


def ssn_valid(value: Column) -> Column:
    return value.rlike(r"^(?!000|666|9)\d{3}[- ]?(?!00)\d{2}[- ]?(?!0000)\d{4}$")


def ipv4_valid(value: Column) -> Column:
    return value.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")


def name_tokens(value: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(value), r"[^\p{Alnum}]", "_"), "_"), lambda x: x != "")


def safe_endpoint(url: Column, hidden: str = "[REDACTED]") -> Column:
    """Scheme, host, port and path of a URL, without user info, query and fragment; secret-looking parts hidden."""
    scheme, host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.transform(F.split(path, "/"), lambda p: F.when(p.rlike(r"(?i)secret|token|password|api[_-]?key|credential|[A-Za-z0-9_-]{32,}"), F.lit(hidden)).otherwise(p))
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.array_join(parts, "/")))


def format_duration(seconds: Column) -> Column:
    return F.when(seconds >= 60, F.format_string("%dm %04.1fs", F.floor(seconds / 60), F.pmod(seconds, F.lit(60.0)))).otherwise(F.format_string("%.1fs", seconds))


def cut_text(value: Column, limit: int = 64) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 1), F.lit("…"))).otherwise(value)


def heartbeat_text(value: Column) -> Column:
    """Over-long, non-identifier and secret-like text is hidden; the rest is cut to 64 characters."""
    unsafe = (F.length(value) > 256) | ~value.rlike(r"^[\w.:/\[\]-]+$") | value.rlike(r"(?i)secret|token|password|api[_-]?key|authorization|credential|[A-Fa-f0-9]{32,}")
    return F.when(unsafe, F.lit("[REDACTED]")).otherwise(cut_text(value))
