import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from trialscope.operators import detectors, locators

ROWS = [
    "https://u:p@h.example.org:8443/a/ann%40example.org/x?q=1#f",
    "https://h.example.org/ann%2540example.org",
    "https://h.example.org:0/clean%20path/%C3%BC%ZZ/%FF",
    "http://h.example.org:port/a\\b@example.org//",
    "/srv/ann@example.org/ann%40example.org/bob@example.org\\ann@example.org",
    "http://10.0.0.1/10.0.0.1",
    "http://[::1]:80/",
    "http://[fe80::1%25eth0]/x",
    "http://[broken/ann@example.org",
    "HTTPS://Host.example.org",
    "file:///home/ann@example.org",
    "",
    " ",
    None,
    "a/" * 20_000 + "ann@example.org",
]
LEAVES = "trace_ord long, leaf_ord long, locator string, redacted_before string, text string, plain string, at int"


def frame(spark, rows):
    return spark.createDataFrame([(t, leaf, x, None, "t", "p", 1) for t, leaf, x in rows], LEAVES)


def walk(rows):
    """Each locator's pieces in turn, with aliases numbered as they come, anew in each trace."""
    used, out, before = {}, {}, None
    for t, leaf, locator in sorted(rows, key=lambda r: r[:2]):
        seen = seen if t == before else {}  # noqa: F821
        before, text, n = t, [], 0

        def alias(kind, value):
            if (kind, value) not in seen:
                used[kind] = used.get(kind, 0) + 1
                seen[kind, value] = f"[{kind}_{used[kind]}]"
            return seen[kind, value]

        for own, plain, address in locators.pieces(locator):
            hits = [(0, len(plain), "IP_ADDRESS")] if address else [(h["start"], h["end"], h["type"]) for h in detectors.detect(plain)]
            at, new = 0, ""
            for start, end, kind in sorted(hits):
                assert start >= at  # none of these rows has overlapping hits
                new += plain[at:start] + alias(kind, plain[start:end])
                at, n = end, n + 1
            text.append(new + plain[at:] if hits else own)
        out[t, leaf] = (None if locator is None else "".join(text), n)
    return out


@pytest.mark.parametrize("traces", [1, 4])
def test_locators_equal_a_plain_walk(spark, traces):
    rows = [(i % traces, i, x) for i, x in enumerate(ROWS)]
    df = frame(spark, rows)
    out = locators.redact_locators(df)
    assert out.columns == [*df.columns, "redacted", "n_spans"]
    assert {(r.trace_ord, r.leaf_ord): (r.redacted, r.n_spans) for r in out.collect()} == walk(rows)


def test_locators_by_hand(spark):
    got = {r.leaf_ord: r.redacted for r in locators.redact_locators(frame(spark, [(0, i, x) for i, x in enumerate(ROWS)])).collect()}
    assert got[0] == "https://h.example.org:8443/a/[EMAIL_ADDRESS_1]/x"
    assert got[1] == ROWS[1] and got[2] == "https://h.example.org/clean%20path/%C3%BC%ZZ/%FF"
    assert got[3] == "http://h.example.org/a\\[EMAIL_ADDRESS_2]//"
    assert got[4] == "/srv/[EMAIL_ADDRESS_1]/ann%40example.org/[EMAIL_ADDRESS_3]\\[EMAIL_ADDRESS_1]"
    assert got[5] == "http://[IP_ADDRESS_1]/[IP_ADDRESS_1]" and got[6] == "http://[IP_ADDRESS_2]:80/" and got[7] == "http://[IP_ADDRESS_3]/x"
    assert got[8] == "http://[broken/[EMAIL_ADDRESS_1]" and got[9] == "https://Host.example.org" and got[10] == "file:///home/[EMAIL_ADDRESS_1]"
    assert got[11] == "" and got[12] == " " and got[13] is None and got[14].endswith("/[EMAIL_ADDRESS_1]")


def test_no_locators(spark):
    assert locators.redact_locators(frame(spark, [(0, 0, "x")]).filter(F.lit(False))).collect() == []


@pytest.mark.parametrize("path", ["a%2Fb/c%5Cd", "/%25/%%/é", "x\\y//", "%"])
def test_clean_pieces_join_to_their_path(path):
    found = locators.pieces("http://h" + path if path.startswith("/") else path)
    assert "".join(own for own, _, _ in found) == ("http://h" + path if path.startswith("/") else path)
    assert all(re.fullmatch(r"[/\\]|http://", own) or plain in (own, unquote(own)) for own, plain, _ in found)
