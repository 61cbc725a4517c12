"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words and phrases of a clause into symbols: insults, threats, targets, negation, reporting verbs, quotes
and breaks. One small transducer each for target, negation (with a scope), reported speech (with quotation) and insults
reads these; they are composed into one weighted automaton. A clause counts with the weight of its accepted path, so an
aimed insult weighs more than a bare one, and a denied or reported one less. Insult words are learned from labelled
training rows beside a short seed list; a logistic model turns clause weights into a score. It is fitted on rows whose
words were weighed without them: those of each fold with the words of the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fields, frugal, slices, text_of, written

#: Labelled rows that the model is fitted on, at most; beyond it a hash of the id chooses them.
TRAINING_ROWS = 200_000
#: Learned insult words, at most (they are broadcast), and the fewest toxic documents that speak for one.
WORDS, SUPPORT = 20_000, 3
THRESHOLD = 0.7
#: The model is fitted on features whose words were learned without the row's fold.
FOLDS = 5

#: Seed words and phrases of the grammar, English, German, French, Spanish.
SEEDS = {
    "insult": "stupid idiot idiots idiotic moron morons loser losers scum trash pathetic worthless disgusting clown dumb imbecile dumm idioten abschaum stupide imbécile ordure estúpido imbécil basura escoria",
    "threat": "kill hurt destroy beat burn smash töten verletzen zerstören tuer frapper détruire matar golpear destruir",
    "target": "you your yours u he she they them him her du dich ihr euch tu te vous toi tú usted vosotros",
    "negation": "not no never isn aren wasn don doesn without nicht kein keine nie pas jamais sans nunca jamás sin",
    "report": "said says say called calls claimed reported quoted wrote sagte sagt nannte schrieb dit disait appelé dijo dice llamó escribió",
    "break": "but aber mais pero",
}
PHRASES = {
    "insult": ["waste of space", "piece of trash", "piece of dirt", "good for nothing", "shut up", "drop dead", "go to hell", "halt den mund", "ferme la", "vete al infierno"],
    "threat": ["beat up", "hunt down", "make you pay", "break your neck"],
    "negation": ["far from", "anything but", "by no means", "keineswegs", "pas du tout", "en absoluto"],
    "report": ["according to", "so called", "laut", "selon", "según"],
}
SYMBOLS = ("insult", "threat", "target", "negation", "report", "quote", "break", "other")
_LEXICON = {w: k for k in reversed(SYMBOLS) for w in SEEDS.get(k, "").split()}
_BY_FIRST: dict[str, list[tuple[list[str], str]]] = {}
for _symbol, _phrases in PHRASES.items():
    for _words in sorted(map(str.split, _phrases), key=len, reverse=True):
        _BY_FIRST.setdefault(_words[0], []).append((_words, _symbol))
#: Words without which no clause is accepted, beside the learned ones.
MARKS = {w for w, k in _LEXICON.items() if k in ("insult", "threat")} | {ws[0] for group in _BY_FIRST.values() for ws, k in group if k in ("insult", "threat")}

# a stop before a closing quote, and a colon before an opening one, end no clause
_CLAUSE = re.compile(r"""[.!?;\n]+(?!["”»])|:(?!\s*["“„«])""")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"""[^\W\d_]+|["“”„«»,()]""")
#: Words that a negation reaches.
SCOPE = 3
FEATURES = ("clauses", "weight", "heaviest", "aimed", "threats", "softened")


class Factors(NamedTuple):
    """What an arc multiplies: the weight of the symbol read; those so far of the segment and of the clause; and that of
    threats which wait for a target."""

    own: float = 1.0
    segment: float = 1.0
    clause: float = 1.0
    waiting: float = 1.0


Arcs = dict[tuple, tuple[tuple, Factors]]


def machine(start, move: Callable) -> Arcs:
    """The arcs of a transducer, from its start state and its moves."""
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            to, factors = move(state, symbol)
            arcs[state, symbol] = (to, factors)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return arcs


def _target(seen: bool, symbol: str):
    """An insult or threat at someone weighs more, wherever in the clause the target is."""
    if symbol == "target" and not seen:
        return True, Factors(segment=1.5, clause=1.5, waiting=2.0)
    return seen, Factors(own={"insult": 1.5, "threat": 2.0}.get(symbol, 1.0)) if seen else Factors()


def _negation(left: int, symbol: str):
    """A negation reaches the next SCOPE words up to a break, and what came before it in its segment."""
    if symbol == "negation":
        return SCOPE, Factors(segment=0.5, waiting=0.5)
    if symbol == "break":
        return 0, Factors()
    return max(0, left - (symbol != "quote")), Factors(own=0.5) if left and symbol in ("insult", "threat") else Factors()


def _reported(state: tuple[bool, str], symbol: str):
    """After a reporting verb, what is said counts less: the quotation if there is one, else all; before it too."""
    reported, quote = state
    if symbol == "quote":
        return (reported, "in" if quote != "in" else "after"), Factors()
    if symbol == "report" and not reported:
        return (True, quote), Factors(segment=0.4, clause=0.4, waiting=0.4)
    return state, Factors(own=0.4) if reported and quote != "after" and symbol in ("insult", "threat") else Factors()


def _repeated(seen: bool, symbol: str):
    """A second insult in a clause adds weight."""
    return seen or symbol == "insult", Factors(own=1.2) if seen and symbol == "insult" else Factors()


def compose(parts: list[tuple[object, Arcs]]) -> tuple[tuple, Arcs]:
    """The product of transducers (start, arcs): a state for each reachable combination, factors multiplied along common
    symbols."""

    def move(state, symbol):
        steps = [arcs[s, symbol] for (_, arcs), s in zip(parts, state, strict=True)]
        return tuple(to for to, _ in steps), Factors(*(float(np.prod([f[i] for _, f in steps])) for i in range(len(Factors._fields))))

    start = tuple(s for s, _ in parts)
    return start, machine(start, move)


PARTS = [(start, machine(start, move)) for start, move in ((False, _target), (0, _negation), ((False, "no"), _reported), (False, _repeated))]
START, GRAMMAR = compose(PARTS)


def symbols(tokens: list[str], insults: dict[str, float]) -> Iterator[tuple[str, float]]:
    """(symbol, worth) of each word or phrase, the longest phrase first."""
    i = 0
    while i < len(tokens):
        t = tokens[i]
        for words, symbol in _BY_FIRST.get(t, ()):
            if tokens[i : i + len(words)] == words:
                yield symbol, 1.0
                i += len(words)
                break
        else:
            worth = insults.get(t)
            yield ("insult", worth) if worth is not None else (_LEXICON.get(t) or ("break" if t in ",()" else "other" if t[0].isalpha() else "quote"), 1.0)
            i += 1


def clause_weight(tokens: list[str], insults: dict[str, float]) -> tuple[float, bool, bool, bool]:
    """(weight, aimed, threat, softened) of a clause's accepted path; a weight of 0 if nothing in it is toxic. Threats
    count if a target is read as well, before or after them."""
    state, clause, segment, waiting, hit, threat, softened = START, 0.0, 0.0, 0.0, False, False, False
    for symbol, worth in symbols(tokens, insults):
        state, f = GRAMMAR[state, symbol]
        clause, segment, waiting = clause * f.clause, segment * f.segment, waiting * f.waiting
        softened = softened or symbol in ("negation", "report")
        if symbol == "insult":
            hit, segment = True, segment + worth * f.own
        elif symbol == "threat" and state[0]:
            hit = threat = True
            segment += f.own
        elif symbol == "threat":
            waiting += f.own
        elif symbol == "target":
            if waiting:
                hit = threat = True
            segment, waiting = segment + waiting, 0.0
        elif symbol == "break":
            clause, segment = clause + segment, 0.0
    return (clause + segment, state[0], threat, softened) if hit else (0.0, False, False, False)


def features(text: str, insults: dict[str, float], marks: set[str]) -> tuple[float, ...]:
    """FEATURES of a text. Texts without an insult or threat word are settled by one look at their words."""
    low = text.lower()
    if marks.isdisjoint(_WORD.findall(low)):
        return (0.0,) * len(FEATURES)
    found = [c for c in (clause_weight(_TOKEN.findall(x), insults) for x in _CLAUSE.split(low)) if c[0] > 0]
    if not found:
        return (0.0,) * len(FEATURES)
    return float(np.log1p(len(found))), float(np.log1p(sum(c[0] for c in found))), max(c[0] for c in found), float(any(c[1] for c in found)), float(any(c[2] for c in found)), sum(c[3] for c in found) / len(found)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scored(insults, coefficients: list[float] | None) -> Callable:
    """Scores, or, without coefficients, FEATURES by the words for each row's fold."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = insults.value
        marks = [set(w) | MARKS for w in words]
        for batch in slices(batches):
            folds = batch.column("fold").to_pylist()
            x = np.array([features(t.as_py() or "", words[k], marks[k]) for t, k in zip(batch.column("text"), folds, strict=True)], float).reshape(-1, len(FEATURES))
            if coefficients is None:
                columns = [pa.array(x[:, i]) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *FEATURES])
            else:
                b = np.array(coefficients)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x @ b[1:] + b[0], -40, 40))))], ["doc_id", "score"])

    return run


def learn_insults(training: DataFrame) -> list[dict[str, float]]:
    """Words whose documents are mostly toxic, with log odds as weights of about 1, and the seed insults: for each fold
    as learned from the others, and last from all."""
    words = training.select("toxic", "fold", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = [F.count("*").alias("n"), F.sum("toxic").alias("t")]
    sums = [f(F.when(F.col("fold") == k, c)).alias(f"{name}{k}") for k in range(FOLDS) for name, f, c in (("n", F.count, F.lit(1)), ("t", F.sum, F.col("toxic")))]
    total = training.agg(*counts, *sums).first().asDict()
    seen = written(words.groupBy("word").agg(*counts, *sums).filter(F.col("t") >= SUPPORT), "toxic-words")
    out = []
    for without in (*range(FOLDS), None):
        count = lambda name: total[name] or 0 if without is None else (total[name] or 0) - (total[f"{name}{without}"] or 0)  # noqa: B023, E731
        toxic, clean = count("t"), count("n") - count("t")
        n, t = (F.col(x) if without is None else F.col(x) - F.coalesce(f"{x}{without}", F.lit(0)) for x in "nt")
        odds = F.log(((t + 0.5) / (toxic + 1)) / ((n - t + 0.5) / (clean + 1)))
        best = seen.filter((t >= SUPPORT) & (t >= 0.8 * n)).select("word", odds.alias("odds")).orderBy(F.desc("odds"), "word").limit(WORDS)
        top = {r["word"]: max(0.25, min(r["odds"] / 4.0, 2.5)) for r in best.collect()}
        out.append({w: 1.0 for w, k in _LEXICON.items() if k == "insult"} | top)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return [-4.0, 1.0, 2.0, 0.5, 0.5, 1.0, -0.5]
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([0, *b[1:]]) * 1e-2)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels of rows with crc32(id) mod 3 = 1 are never learned from. A null or empty text is scored like one without
    any toxic clause. Null labels are left out, a document labelled twice counts as toxic if any label says so; without
    labels the seed words and fixed coefficients are used. Repeated rows score alike, texts are scored whole; other
    columns of docs and labels aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = fields(docs, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    known = fields(labels, doc_id="doc_id", toxic="toxic").filter("toxic is not null and doc_id is not null").filter(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = written(known, "labels")
    if (n := known.count()) > TRAINING_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * TRAINING_ROWS / n))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    training = written(own.join(F.broadcast(known), "doc_id").withColumn("fold", fold), "training")  # at most TRAINING_ROWS, nearly
    insults = spark.sparkContext.broadcast(learn_insults(training))
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = training.select("doc_id", "text", "fold").mapInArrow(_scored(insults, None), f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))
    sample = rows.join(F.broadcast(known), "doc_id").select(*FEATURES, "toxic").toPandas()
    b = fit(sample[list(FEATURES)].to_numpy(float), sample["toxic"].to_numpy(float))
    out = own.withColumn("fold", F.lit(FOLDS)).mapInArrow(_scored(insults, b), f"doc_id {kind}, score double")
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
