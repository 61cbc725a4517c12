"""Recorded dialogues of a simulator and an agent: the fold to messages and output, how they ended, how they failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folded_turns(responses: DataFrame) -> DataFrame:
    """responses: (case_id, turn, source, content, output, has_output, reason). Adds role and the output so far.

    Content of a simulator is a user's, of an agent an assistant's; a response without content adds no message. The
    agent's output is the one it states, else its content, else what it was.
    """
    agent = F.col("source") == "agent"
    stated = F.when(agent & F.col("has_output"), F.struct(F.col("output"))).when(agent & F.col("content").isNotNull(), F.struct(F.col("content").alias("output")))
    sofar = F.last(stated, ignorenulls=True).over(Window.partitionBy("case_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    role = F.when(F.col("content").isNotNull(), F.when(agent, "assistant").otherwise("user"))
    return responses.select("case_id", "turn", "source", role.alias("role"), "content", sofar["output"].alias("output"), "reason")


def results(responses: DataFrame, max_turns: int | None) -> DataFrame:
    """One row per case: messages, agent turns, final output, and who ended it why. A responder's reason ends it at once,
    the max_turns-th agent response ends it for the engine; without a bound it is a direct call.

    Aggregates alone: a case's responses aren't gathered."""
    agent, reason = F.col("source") == "agent", F.col("reason").isNotNull()
    stated = F.when(agent & F.col("has_output"), F.struct(F.col("output"))).when(agent & F.col("content").isNotNull(), F.struct(F.col("content").alias("output")))
    g = responses.groupBy("case_id").agg(
        F.count("content").alias("messages"),
        F.count_if(agent).alias("agent_turns"),
        F.max_by(stated, F.when(stated.isNotNull(), F.col("turn"))).alias("last"),
        F.min_by(F.struct("source", "reason"), F.when(reason, F.col("turn"))).alias("ended"),
    )
    engine = F.when(F.col("agent_turns") >= (max_turns or 0), "max_turns" if max_turns else "direct")
    return g.select("case_id", "messages", "agent_turns", F.col("last.output").alias("output"), F.coalesce("ended.source", F.when(engine.isNotNull(), "engine")).alias("ended_by"), F.coalesce("ended.reason", engine).alias("reason"))


def response_rules(responses: DataFrame, simulated: bool = True) -> DataFrame:
    """Responses that break their contract: blank content or reason, an output of a simulator, neither content nor an
    end in a simulated dialogue."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(False))
    rules = {
        "blank content": blank("content"),
        "blank reason": blank("reason"),
        "output of a simulator": (F.col("source") == "simulator") & F.col("has_output"),
        "neither content nor reason": F.lit(simulated) & F.col("content").isNull() & F.col("reason").isNull(),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return responses.select(F.explode(found).alias("rule"), F.concat_ws("/", F.col("case_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("source").alias("detail"))


def failure_kind(responses: DataFrame) -> DataFrame:
    """(case_id, source, kind) of cases that failed: their first bad response; contract if it broke a rule, else
    execution if it raised an error (column error)."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(False))
    broken = blank("content") | blank("reason") | ((F.col("source") == "simulator") & F.col("has_output")) | (F.col("content").isNull() & F.col("reason").isNull())
    kind = F.when(F.col("error"), "execution").when(broken, "contract")
    bad = responses.withColumn("kind", kind).filter("kind is not null")
    return bad.groupBy("case_id").agg(F.min_by(F.struct("source", "kind"), "turn").alias("f")).select("case_id", "f.source", "f.kind")
