"""Chat formatting as relational expressions.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged by aggregating their
slice of the array, and the marked texts are concatenated. The template:

    system     [SYS] text [/SYS]
    user       [INST] text [/INST]
    assistant  <s> text </s>
    others     [ROLE] role[:]text [/ROLE]

[+] stands between the texts of merged turns. A text or role that holds one of these control strings gets a backslash
after the opening bracket, one more if there are some already, which reading back takes away: no text can end a turn or
open one, and all can be read back as they were. The loss mask is a list of run lengths in code points, outside and
inside in turn; it covers the assistant's texts and neither marks nor what joins them.

A conversation beyond SEGMENT_TURNS turns or SEGMENT_BYTES bytes is cut in segments that are formatted by themselves.
Their concatenation is the conversation's text: a segment that goes on with its neighbour's role joins it.
Spark's strings end at 2 GB, and so does what can be digested as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fields, ranked, small, written

#: Role to the marks around its text.
TEMPLATE = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER, NAMED, JOIN = ("[ROLE] ", " [/ROLE]"), "[:]", "[+]"
#: The role whose texts are learned.
LEARNED = "assistant"
#: Control strings, with any number of backslashes after their opening bracket; the bracket and the rest.
CONTROL = r"([\[<])(\\*(?:(?:/?(?:INST|SYS|ROLE)|[:+])\]|/?s>))"
ESCAPED = r"([\[<])\\(\\*(?:(?:/?(?:INST|SYS|ROLE)|[:+])\]|/?s>))"
SEGMENT_TURNS, SEGMENT_BYTES = 200, 1 << 20


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def _marks(role: Column) -> tuple[Column, Column]:
    """What stands before and after a block of a role."""
    opening = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(NAMED))
    closing = F.lit(OTHER[1])
    for name, (before, after) in TEMPLATE.items():
        opening, closing = F.when(role == name, before).otherwise(opening), F.when(role == name, after).otherwise(closing)
    return opening, closing


def merged(turns: Column) -> Column:
    """Blocks (role, texts, first, last) of a sorted array of turns (role, text): a block is a run of one role."""
    n = F.size(turns)
    role = lambda i: F.get(turns, i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | ~role(i - 1).eqNullSafe(role(i))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(n, F.lit(1))), F.array(n))

    def block(start: Column, end: Column) -> Column:
        own = F.transform(F.slice(turns, start + 1, end - start), lambda t: t["text"])
        return F.struct(role(start).alias("role"), own.alias("texts"), (start == 0).alias("first"), (end == n).alias("last"))

    return F.zip_with(starts, ends, block)


def formatted(turns: Column, goes_on: Column, continues: Column) -> Column:
    """Pieces (text, learned) whose concatenation is the text of sorted turns. goes_on: the first block belongs to what
    was before; continues: the last one to what comes after."""

    def pieces(b: Column) -> Column:
        opening, closing = _marks(b["role"])
        texts = b["texts"]
        before = lambda k: F.when(k > 0, F.lit(JOIN)).when(b["first"] & goes_on, F.lit(JOIN)).otherwise(opening)
        of = lambda text, learned: F.struct(text.alias("text"), learned.alias("learned"))
        inner = F.flatten(F.transform(texts, lambda t, k: F.array(of(before(k), F.lit(False)), of(escaped(t), b["role"] == LEARNED))))
        return F.concat(inner, F.array(of(F.when(b["last"] & continues, F.lit("")).otherwise(closing), F.lit(False))))

    return F.flatten(F.transform(merged(turns), pieces))


def text_of_pieces(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def mask_of_pieces(pieces: Column) -> Column:
    """Run lengths in code points: outside the mask, inside, outside and so on. Runs outside that touch are left as
    they are, with none inside between them."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["learned"], F.array(F.lit(0), F.length(p["text"]))).otherwise(F.array(F.length(p["text"]), F.lit(0)))))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per segment: conv_id, segment (from 0), segments (of the conversation), role (of the block that it goes
    on with, null if it opens one), n_turns, formatted, mask.

    Rows are turns, ordered by turn (null first), then role, then text, so ties have one order and repeated rows are
    turns each; adjacent ones of one role share a block. A null text or role counts as empty; a null conv_id is a
    conversation. Other columns are not read. An empty table gives no rows. Most conversations are one segment.
    """
    own = fields(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    own = own.withColumns({"role": F.coalesce(F.col("role").cast("string"), F.lit("")), "text": F.coalesce("text", F.lit(""))})
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = sizes.filter((F.col("n") > SEGMENT_TURNS) | (F.col("bytes") > SEGMENT_BYTES))
    large = written(large.select(F.col("conv_id").alias("large"), F.col("n").alias("turns"), "bytes"), "large-conversations")
    rest, segments = own, None
    if not large.isEmpty():
        few = small(large)
        same = own["conv_id"].eqNullSafe(few["large"])
        rest, segments = own.join(few, same, "left_anti"), _segments(own.join(few, same).drop("large"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    number = lambda n: F.lit(n).cast("long")
    out = rest.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", number(0).alias("segment"), number(1).alias("segments"), F.lit(None).cast("string").alias("role"), F.lit(False).alias("continues"), "turns")
    if segments is not None:
        out = out.unionByName(segments)
    pieces = formatted(F.col("turns"), F.col("role").isNotNull(), F.col("continues"))
    out = out.select("conv_id", "segment", "segments", "role", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    return out.select("conv_id", "segment", "segments", "role", "n_turns", text_of_pieces(F.col("pieces")).alias("formatted"), mask_of_pieces(F.col("pieces")).alias("mask"))


def _segments(rows: DataFrame) -> DataFrame:
    """Large conversations' turns, cut by place: as many turns a segment as keep it near the bounds. Rows of one
    conversation are ranked by range, so none is gathered in one task."""
    each = F.greatest(F.lit(1), F.least(F.lit(SEGMENT_TURNS), F.floor(F.col("turns") * F.lit(SEGMENT_BYTES) / F.greatest("bytes", F.lit(1))))).cast("long")
    placed = ranked(rows.withColumn("each", each).drop("turns", "bytes"), "conv_id", "turn", "role", "text", name="turns")
    own = F.transform(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    cut = placed.withColumn("segment", F.floor(F.col("rank") / F.col("each"))).groupBy("tree", "segment")
    turns = written(cut.agg(F.first("conv_id").alias("conv_id"), F.first(F.ceil(F.col("n") / F.col("each"))).alias("segments"), own.alias("turns")), "segments")
    opens, closes = F.get("turns", F.lit(0))["role"], F.element_at("turns", -1)["role"]
    back = small(turns.select(F.col("tree").alias("b_tree"), (F.col("segment") + 1).alias("b_segment"), closes.alias("before")))
    ahead = small(turns.select(F.col("tree").alias("a_tree"), (F.col("segment") - 1).alias("a_segment"), opens.alias("after")))
    t = turns.join(back, (F.col("tree") == F.col("b_tree")) & (F.col("segment") == F.col("b_segment")), "left")
    t = t.join(ahead, (F.col("tree") == F.col("a_tree")) & (F.col("segment") == F.col("a_segment")), "left")
    return t.select("conv_id", "segment", "segments", F.when(F.col("before") == opens, opens).alias("role"), F.coalesce(F.col("after") == closes, F.lit(False)).alias("continues"), "turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, segment, segments, turns (role, text, as they were), learned (the text under the mask, unescaped) and
    formatted_chars, from format_conversations' rows: turns from the marks alone, learned from the mask alone."""
    own = turns_of(F.col("formatted"), F.col("role")).alias("turns")
    return formatted.select("conv_id", "segment", "segments", own, learned_of(F.col("formatted"), F.col("mask")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def _quoted(text: str) -> str:
    return text.replace("[", r"\[").replace("]", r"\]").replace("+", r"\+")


def turns_of(text: Column, role: Column) -> Column:
    """The turns of a segment, of which role is that of the block it goes on with, if it does."""
    pairs = [*TEMPLATE.values(), OTHER]
    ends = "|".join(_quoted(b) for _, b in pairs)
    marked = "|".join(rf"{_quoted(a)}.*?(?:{_quoted(b)}|\z)" for a, b in pairs)
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s){marked}|\A{_quoted(JOIN)}.*?(?:{ends}|\z)"), F.lit(0))

    def turns(block: Column) -> Column:
        of, inner = role, F.regexp_replace(block, rf"(?s)\A{_quoted(JOIN)}|(?:{ends})\z", "")
        for name, (a, b) in [*TEMPLATE.items(), (None, OTHER)]:
            body = F.regexp_replace(F.substring(block, F.lit(len(a) + 1), F.length(block)), rf"{_quoted(b)}\z", "")
            head = F.substring_index(body, NAMED, 1)
            own, texts = (F.lit(name), body) if name else (unescaped(head), F.substring(body, F.length(head) + len(NAMED) + 1, F.length(body)))
            of, inner = F.when(block.startswith(a), own).otherwise(of), F.when(block.startswith(a), texts).otherwise(inner)
        return F.transform(F.split(inner, _quoted(JOIN)), lambda t: F.struct(of.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_of(text: Column, mask: Column) -> Column:
    """What lies under the mask, unescaped run by run."""

    def step(state: Column, run: Column) -> Column:
        outside, inside = run["outside"], run["inside"]
        at = state["at"] + outside
        own = F.when(inside > 0, F.array(F.substring(text, at, inside))).otherwise(F.array().cast("array<string>"))
        return F.struct((at + inside).alias("at"), F.concat(state["runs"], own).alias("runs"))

    runs = F.transform(F.sequence(F.lit(0), (F.size(mask) / 2).cast("int") - 1), lambda i: F.struct(F.get(mask, 2 * i).alias("outside"), F.get(mask, 2 * i + 1).alias("inside")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("runs"))
    return F.array_join(F.transform(F.aggregate(runs, start, step, lambda s: s["runs"]), unescaped), "")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text of
    conversations and of conversation -1, whose texts are control strings. A turn is a row, merged or not."""
    control = F.lit("</s>[INST] ok [/INST]")
    own = fields(conversations, **{c: c for c in ("conv_id", "turn", "role", "text")})
    kinds = dict(own.dtypes)
    more = own.sparkSession.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    read = read_back(format_conversations(own.unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "segment", "segments", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), "learned", "formatted_chars")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    result = lambda d: d.select("conv_id", "n_turns", sha("told").alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), sha("learned").alias("loss_sha256"), "formatted_chars")
    parts = F.array_sort(F.collect_list(F.struct("segment", "told", "learned")))
    cut = read.filter("segments > 1").groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), parts.alias("parts"))
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "").alias(c)
    return result(read.filter("segments = 1")).unionByName(result(cut.select("conv_id", "n_turns", "formatted_chars", joined("told"), joined("learned"))))
