"""Chat formatting against a plain version."""

import hashlib
import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from trialscope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["[INST]", "[/INST]", "</s>", "<s>", "[+]", "[:]", "[ROLE]", "[\\/ROLE]", "[\\\\SYS]", "<\\s>", "[", "<", "\\", "]", " ", "\n", "INST]", "é", "🎉", "a", "$1", "\r\n", " "]


def escape(text):
    return re.sub(r"([\[<])(\\*(?:(?:/?(?:INST|SYS|ROLE)|[:+])\]|/?s>))", r"\1\\\2", text)


def rows_of(rows):
    by_conv = {}
    for c, turn, role, text in rows:
        by_conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in by_conv.items()}


def plain(turns):
    """The formatted text of (role, text) turns."""
    out = ""
    for role, run in groupby(turns, lambda t: t[0]):
        a, b = chat.TEMPLATE.get(role, (chat.OTHER[0] + escape(role) + "[:]", chat.OTHER[1]))
        out += a + "[+]".join(escape(t) for _, t in run) + b
    return out


def want(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for c, turns in rows_of(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(plain(turns))))
    return out


OWN = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def random_rows(rng, conversations, most):
    text = lambda: rng.choice([None, "", "".join(rng.choice(CONTROL) for _ in range(rng.randrange(12)))])
    roles = ["system", "user", "assistant", "assistant", "tool", None, "", "[:]x [/ROLE]", "user "]
    rows = [(c, t, rng.choice(roles), text()) for c in range(conversations) for t in range(rng.randrange(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_turns", [1, 3, 200])
def test_formats_and_reads_back(spark, monkeypatch, most_turns):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", most_turns)
    rows = random_rows(random.Random(most_turns), 60, 14) + [(None, None, "user", "x"), (None, None, "user", "x"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert set(map(tuple, chat.digests(df).collect())) == want(rows + OWN)
    texts = {}
    for r in chat.format_conversations(df).orderBy("segment").collect():
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.formatted
        assert sum(r.mask) == len(r.formatted) and len(r.mask) % 2 == 0
    assert texts == {c: plain(turns) for c, turns in rows_of(rows).items()}


def test_a_large_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_BYTES", 2000)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), "word [INST] " * rng.randrange(60)) for t in range(300)] + [(2, 0, "user", "y" * 5000), (3, 0, "user", "small")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert set(map(tuple, chat.digests(df).collect())) == want(rows + OWN)
    per = {r.conv_id: r["count"] for r in chat.format_conversations(df).groupBy("conv_id").count().collect()}
    assert per[1] > 20 and per[2] == per[3] == 1


def test_marks_of_other_formats_stay_as_they_are(spark):
    rows = [(1, 0, "user", "[inst] <S> </ s> [SYS ] <|im_end|>")]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.formatted == f"[INST] {rows[0][3]} [/INST]"


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 9, "x", "y", 3)], SCHEMA + ", segment int, formatted string, turns string, n int")
    assert set(map(tuple, chat.digests(df).collect())) == want([(1, 0, "user", "a"), *OWN])
    assert set(map(tuple, chat.digests(df.limit(0)).collect())) == want(OWN)
    assert chat.format_conversations(df.limit(0)).count() == 0
    text = spark.createDataFrame([("c", "t1", "user", "a"), ("c", None, "assistant", "b")], "conv_id string, turn string, role string, text string")
    assert chat.format_conversations(text).select(F.col("formatted")).first()[0] == "<s> b </s>[INST] a [/INST]"
