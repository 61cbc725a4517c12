"""Locators (paths and URLs of a trace's source): their segments are redacted one by one, in decoded form."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from urllib.parse import SplitResult, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialscope.operators import detectors, redaction
from trialscope.sources.stage import staged

#: A piece of a locator: what stands there, what the detectors read (null: nothing) and whether it is an address.
PIECES = T.ArrayType(T.StructType([T.StructField("own", T.StringType()), T.StructField("plain", T.StringType()), T.StructField("address", T.BooleanType())]))
Piece = tuple[str, str | None, bool]


def _fixed(own: str) -> Piece:
    return own, None, False


def _path(path: str, decode: bool) -> list[Piece]:
    return [_fixed(s) if s in "/\\" else (s, unquote(s) if decode else s, False) for s in re.split(r"([/\\])", path) if s]


def _address(host: str) -> bool:
    try:
        return bool(ipaddress.ip_address(host.split("%", 1)[0]))
    except ValueError:
        return False


def _authority(url: SplitResult) -> list[Piece]:
    """Host and port; the user's part is left out, and so is a port that isn't a number from 1 on."""
    authority = url.netloc.rpartition("@")[2]
    host = authority[1:].partition("]")[0] if authority.startswith("[") else authority.rpartition(":")[0] or authority
    if _address(host):
        pieces = [(host, host, True)]
    else:
        labels = [p for label in host.split(".") for p in (_fixed("."), (label, label, False))][1:]
        pieces = [_fixed("["), *labels, _fixed("]")] if ":" in host else labels
    try:
        port = url.port
    except ValueError:
        port = None
    return [*pieces, _fixed(f":{port}")] if port else pieces


def pieces(locator: str | None) -> list[Piece]:
    """The pieces of a locator in order. Query and fragment of a URL are left out; what is no URL with a host is a path,
    which isn't decoded."""
    try:
        url = urlsplit(locator or "")
    except ValueError:
        url = SplitResult("", "", "", "", "")
    if url.scheme and url.netloc:
        return [_fixed(f"{url.scheme}://"), *_authority(url), *_path(url.path, decode=True)]
    return _path(locator or "", decode=False)


@F.pandas_udf(PIECES)
def _pieces(locators: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in locators:
        yield s.map(lambda x: [dict(zip(("own", "plain", "address"), p, strict=True)) for p in pieces(x)])


def redact_locators(locators: DataFrame) -> DataFrame:
    """locators: (trace_ord long, leaf_ord long, locator), a row each by trace_ord and leaf_ord, and any other columns.
    Adds redacted and n_spans.

    A segment with a hit becomes its decoded text with aliases; one without stays byte for byte, however it is encoded. A
    host that is an address is replaced whole. A null locator stays null, an empty one empty. Only pieces with hits are
    shuffled.
    """
    whole = staged(locators.select("trace_ord", "leaf_ord", _pieces(F.col("locator")).alias("pieces")), "locators")
    one = whole.select("trace_ord", "leaf_ord", F.posexplode("pieces").alias("at", "p"))
    one = one.select("trace_ord", F.struct("leaf_ord", "at").alias("leaf_ord"), F.col("p.plain").alias("text"), F.col("p.address").alias("address"))
    read = one.filter(F.col("text").isNotNull() & (F.col("address") | detectors.gated(F.col("text"))))
    all_of = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("IP_ADDRESS").alias("type"), F.lit(detectors.PARSER_SCORE).alias("score"), F.lit(detectors.DETERMINISTIC).alias("priority"))
    hits = F.when(F.col("address"), F.array(all_of)).otherwise(detectors.detector_udf()(F.col("text")))
    found = staged(read.withColumn("spans", redaction.union_spans(hits)).filter(F.size("spans") > 0).drop("address"), "located")
    named = redaction.named_spans(found).groupBy("trace_ord", F.col("leaf_ord.leaf_ord").alias("leaf_ord")).agg(
        F.map_from_entries(F.collect_list(F.struct("leaf_ord.at", "replaced"))).alias("replaced"),
        F.sum("n_spans").cast("int").alias("n_spans"),
    )
    new = F.transform("pieces", lambda p, i: F.coalesce(F.try_element_at("replaced", i), p["own"]))
    out = whole.join(named, ["trace_ord", "leaf_ord"], "left").select("trace_ord", "leaf_ord", F.concat_ws("", new).alias("redacted"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
    out = locators.join(out, ["trace_ord", "leaf_ord"], "left")
    return out.withColumn("redacted", F.when(F.col("locator").isNotNull(), F.col("redacted")))
