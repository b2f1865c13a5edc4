"""Toxicity by a weighted finite-state grammar over clauses.

Tokens become symbols: insult in three strengths (words and stems learnt from labelled documents), threat,
target, negation, reporting verb, quotation mark. Clauses end at sentence punctuation and newlines. Five
transducers, each a table of arcs, are composed into one: negation, reported speech and target mark what
stands in their scope, threat turns a threat and its target into an attack, and insult puts a weight on every
marked insult or attack. The weights are fitted on labelled documents; a clause scores the sum of its arcs'
weights, and a document's score is calibrated from the scores of its matched clauses.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import released, small_batches, staged
from quaylark.llm.quality import fit_logistic

#: At most so many labelled rows, by hash order of the id, teach the lexicon, the arcs and the calibration.
TRAIN_ROWS = 12_000
#: At most so many learnt words, and stems.
TERMS = 2_000
STEM, LONGEST_STEM = 5, 12
#: Toxic documents that a word, or stem, must occur in.
LEAST = {"word": 3, "stem": 8}
#: Log-odds that a word, or stem, must have by their lower bound.
ODDS = {"word": 0.7, "stem": 0.9}
#: Log-odds at which an insult is of the second and of the third strength.
STRONG = (2.5, 4.0)
#: Words whose symbol a worker keeps; bounds its memory.
KEPT_WORDS = 200_000

THREAT = frozenset("kill hurt destroy beat shoot stab burn töten verletzen schlagen tuer frapper détruire matar golpear destruir".split())
TARGET = frozenset("you your yours he she they them him her these those people du dich dein ihr sie euch tu toi ton vous ils elle tú usted ustedes ellos ella".split())
NEGATION = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie pas jamais ne nunca jamás".split())
REPORT = frozenset("said says called quoted wrote reported claims sagte nannte schrieb disait écrit appelé dijo llamó escribió".split())
QUOTES = frozenset("\"“”„«»")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”„«»]|[.!?;\n]+")

INSULTS = ("insult1", "insult2", "insult3")
SYMBOLS = ("other", *INSULTS, "threat", "target", "negation", "report", "quote")


# ---------------------------------------------------------------- transducers


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> (state, symbol, weight). State 0 starts, every state accepts, and a symbol
    without an arc stays as it is, in the same state, at no weight."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def run(self, symbols: Iterable[str]) -> tuple[list[str], float]:
        state, out, total = 0, [], 0.0
        for s in symbols:
            state, symbol, weight = self.step(state, s)
            out.append(symbol)
            total += weight
        return out, total


def transducer(start: object, symbols: Iterable[str], step: Callable[[object, str], tuple[object, str, float]]) -> Transducer:
    """The table of the states that step reaches from start over symbols."""
    numbers, todo, arcs, symbols = {start: 0}, [start], {}, list(symbols)
    while todo:
        state = todo.pop()
        for s in symbols:
            to, out, weight = step(state, s)
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            arcs[numbers[state], s] = (numbers[to], out, weight)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """The transducer that gives, over symbols, what second makes of first's output; weights add up."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str, float]:
        a, between, w = first.step(state[0], symbol)
        b, out, v = second.step(state[1], between)
        return (a, b), out, w + v

    return transducer((0, 0), symbols, step)


def _scope(opener: str, mark: str, length: int, bases: tuple[str, ...], symbols: Iterable[str]) -> Transducer:
    """Marks symbols of bases within length tokens after opener."""

    def step(left: int, s: str) -> tuple[int, str, float]:
        if s == opener:
            return length, s, 0.0
        return max(left - 1, 0), s + mark if left and s.split("|")[0] in bases else s, 0.0

    return transducer(0, symbols, step)


def _marked(bases: tuple[str, ...], marks: str) -> list[str]:
    return [b + "".join(f"|{m}" for m, on in zip(marks, which, strict=True) if on) for b in bases for which in itertools.product((0, 1), repeat=len(marks))]


def negation_machine() -> Transducer:
    """Marks insults and threats within three tokens after a negation."""
    return _scope("negation", "|n", 3, (*INSULTS, "threat"), SYMBOLS)


def report_machine() -> Transducer:
    """Marks insults and threats in a quotation after a reporting verb."""

    def step(state: tuple[bool, bool], s: str) -> tuple[tuple[bool, bool], str, float]:
        said, quoted = state
        if s == "report":
            return (True, quoted), s, 0.0
        if s == "quote":
            return (said, not quoted), s, 0.0
        return state, s + "|r" if said and quoted and s.split("|")[0] in (*INSULTS, "threat") else s, 0.0

    return transducer((False, False), {*SYMBOLS, *_marked((*INSULTS, "threat"), "n")}, step)


def target_machine() -> Transducer:
    """Marks insults within four tokens after a target."""
    return _scope("target", "|t", 4, INSULTS, {*SYMBOLS, *_marked((*INSULTS, "threat"), "nr")})


def threat_machine() -> Transducer:
    """Turns a target within three tokens after a threat into an attack with the threat's marks."""

    def step(state: tuple[int, str], s: str) -> tuple[tuple[int, str], str, float]:
        left, marks = state
        if s.split("|")[0] == "threat":
            return (3, s.removeprefix("threat")), s, 0.0
        if s == "target" and left:
            return (0, ""), "attack" + marks, 0.0
        return (left - 1, marks) if left > 1 else (0, ""), s, 0.0

    return transducer((0, ""), {*SYMBOLS, *_marked(INSULTS, "nrt"), *_marked(("threat",), "nr")}, step)


#: What the first four machines make of a clause that bears on its score.
EVENTS = tuple(_marked(INSULTS, "nrt") + _marked(("attack",), "nr"))


def insult_machine(weights: dict[str, float]) -> Transducer:
    """Weighs every event."""
    return Transducer({(0, e): (0, e, weights.get(e, 0.0)) for e in EVENTS})


def machines(weights: dict[str, float]) -> list[Transducer]:
    return [negation_machine(), report_machine(), target_machine(), threat_machine(), insult_machine(weights)]


def composed(weights: dict[str, float]) -> Transducer:
    first, *rest = machines(weights)
    for m in rest:
        first = compose(first, m, SYMBOLS)
    return first


# ---------------------------------------------------------------- the grammar


@dataclass
class Grammar:
    """Log-odds of learnt words and stems, weights of the events' arcs, and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: {e: 1.0 for e in EVENTS})
    calibration: tuple[float, ...] = (1.0, 0.0, 0.0, -2.0)
    _known: dict[str, int] = field(default_factory=dict, init=False, repr=False)
    _tables: tuple[list, list, list] | None = field(default=None, init=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_tables": None}

    def symbol(self, word: str) -> str:
        """An insult by the word's odds, or else the longest known stem's."""
        w = self.words.get(word)
        if w is None and word in THREAT:
            return "threat"
        if w is None and word in TARGET:
            return "target"
        if w is None and word in NEGATION:
            return "negation"
        if w is None and word in REPORT:
            return "report"
        if w is None and word in QUOTES:
            return "quote"
        if w is None and len(word) > STEM:
            w = next((self.stems[word[:n]] for n in range(min(len(word), LONGEST_STEM), STEM - 1, -1) if word[:n] in self.stems), None)
        return "other" if w is None else INSULTS[sum(w >= x for x in STRONG)]

    def number(self, word: str) -> int:
        n = self._known.get(word)
        if n is None:
            if len(self._known) >= KEPT_WORDS:
                self._known.clear()
            n = self._known[word] = SYMBOLS.index(self.symbol(word))
        return n

    def tables(self) -> tuple[list, list, list]:
        """By state and number of the symbol: the next state, the event or -1, and the weight."""
        if self._tables is None:
            arcs = composed(self.weights).arcs
            states = 1 + max(s for s, _ in arcs)
            rows = [[arcs[s, x] for x in SYMBOLS] for s in range(states)]
            at = {e: i for i, e in enumerate(EVENTS)}
            self._tables = ([[a[0] for a in r] for r in rows], [[at.get(a[1], -1) for a in r] for r in rows], [[a[2] for a in r] for r in rows])
        return self._tables


_FIRST, _LAST_INSULT, _THREAT_NO = 1, len(INSULTS), SYMBOLS.index("threat")


def clauses(text: str | None) -> Iterator[list[str]]:
    now: list[str] = []
    for t in TOKEN.findall((text or "").lower()):
        if t[0] in ".!?;\n":
            if now:
                yield now
            now = []
        else:
            now.append(t)
    if now:
        yield now


def clause_score(numbers: Iterable[int], g: Grammar, events: list[int] | None = None) -> float:
    """The composed machine's weight of a clause of symbols' numbers; counts its events."""
    to, event, weight = g.tables()
    state, total = 0, 0.0
    for n in numbers:
        if events is not None and event[state][n] >= 0:
            events[event[state][n]] += 1
        total += weight[state][n]
        state = to[state][n]
    return total


def evidence(text: str | None, g: Grammar) -> tuple[tuple[float, float, float, float], list[int]]:
    """The logarithm of 1 + the sum of the clauses' scores, the best, the sum over the root of the clauses, 1: what calibration sees;
    and the counts of events, which the weights are fitted to."""
    total, best, n, events = 0.0, 0.0, 0, [0] * len(EVENTS)
    for c in clauses(text):
        n += 1
        numbers = [g.number(t) for t in c]
        # a clause without an insult or threat scores nothing
        if any(_FIRST <= x <= _LAST_INSULT or x == _THREAT_NO for x in numbers):
            s = clause_score(numbers, g, events)
            total, best = total + s, max(best, s)
    return (math.log1p(total), best, total / math.sqrt(1 + n), 1.0), events


def score(text: str | None, g: Grammar) -> float:
    """The calibrated score, 0 to 1; that of an empty text is the calibration's for no match."""
    z = sum(a * b for a, b in zip(g.calibration, evidence(text, g)[0], strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# ---------------------------------------------------------------- training


def terms(text: str | None) -> set[tuple[str, str]]:
    """The words and stems of a text."""
    own = {w for c in clauses(text) for w in c}
    return {("word", w) for w in own} | {("stem", w[:n]) for w in own for n in range(STEM, min(len(w), LONGEST_STEM))}


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, y, fold), written, of at most rows labelled rows: whole ids by hash, each while its rows still fit.
    Equal texts are in one of the two folds."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    there = texts.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(marks, "id").where(F.col("n") <= rows)
    left, chosen = rows, []
    for r in there.orderBy(F.xxhash64("id"), "id").limit(rows).collect():
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["id"], int(r["y"] == 1)))
    # at most rows ids, so the broadcast is bounded
    return staged(texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, y int")), "id").select("text", "y", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")))


def _counted(rows: DataFrame) -> DataFrame:
    """(fold, kind, term, yes, no), written: toxic and other documents with a term, counted where the texts are."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            found = [(fold, *t, y) for x, y, fold in zip(df["text"], df["y"], df["fold"], strict=True) for t in terms(x)]
            yield pd.DataFrame(found, columns=["fold", "kind", "term", "y"]).groupby(["fold", "kind", "term"], as_index=False).agg(yes=("y", "sum"), n=("y", "size"))

    by = rows.mapInPandas(f, "fold int, kind string, term string, yes long, n long").groupBy("fold", "kind", "term")
    return staged(by.agg(F.sum("yes").alias("yes"), (F.sum("n") - F.sum("yes")).alias("no")))


def _lexicon(counted: DataFrame, yes: int, no: int) -> Grammar:
    """Words and stems with high log-odds of toxic documents, by document counts. At most TERMS of either kind
    come to the driver."""
    by = counted.groupBy("kind", "term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    z = F.log((F.col("yes") + 0.3) / (F.col("no") + 0.3)) - math.log((yes + 1) / (no + 1))
    # the bound of the odds at about two standard errors
    low = F.col("z") - 2 * F.sqrt(1 / (F.col("yes") + 0.3) + F.when(F.col("no") > 0, 1 / (F.col("no") + 0.3)).otherwise(1.0))
    out = []
    for kind in ("word", "stem"):
        fits = by.where((F.col("kind") == kind) & (F.col("yes") >= LEAST[kind])).withColumn("z", z).where(low > ODDS[kind])
        out.append({r["term"]: r["z"] for r in fits.orderBy(F.desc("z"), "term").limit(TERMS).collect()})
    return Grammar({w: z for w, z in out[0].items() if w not in TARGET | NEGATION | REPORT | THREAT | QUOTES}, out[1])


def _evidence_rows(rows: DataFrame, g: Grammar) -> np.ndarray:
    """y, evidence and events of each row: numbers, as many as there are labelled rows."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = [evidence(t, g) for t in df["text"]]
            yield pd.DataFrame({"x": [[float(y), *a, *map(float, b)] for y, (a, b) in zip(df["y"], got, strict=True)]})

    got = sorted(r["x"] for r in rows.mapInPandas(f, "x array<double>").collect())
    return np.array(got, float).reshape(-1, 5 + len(EVENTS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Grammar:
    """The grammar learnt from at most rows labelled rows of docs; without both labels nothing matches.

    Texts stay on the executors. The lexicon is by odds, the events' weights by a logistic regression on their
    counts, and the calibration by another one on the clauses' scores."""
    small_batches(docs.sparkSession)
    data = _labelled(docs, labels, id_col, text_col, label_col, rows)
    n = {(r["fold"], r["y"]): r["count"] for r in data.groupBy("fold", "y").count().collect()}
    yes, no = ([n.get((k, y), 0) for k in (0, 1)] for y in (1, 0))
    g = Grammar()
    if sum(yes) and sum(no):
        counted = _counted(data)
        g = _lexicon(counted, sum(yes), sum(no))
        # each fold is seen with the other's lexicon, as new texts are
        folds = [(data.where(F.col("fold") == k), _lexicon(counted.where(F.col("fold") != k), yes[1 - k], no[1 - k])) for k in (0, 1)] if all(yes + no) else [(data, g)]
        g.weights = _arc_weights(np.vstack([_evidence_rows(d, x) for d, x in folds]))
        x = np.vstack([_evidence_rows(d, replace(x, weights=g.weights)) for d, x in folds])
        g.calibration = tuple(fit_logistic(x[:, 1:5], x[:, 0], ridge=1e-4).tolist())
        released(counted)
    released(data)
    return g


def _arc_weights(x: np.ndarray) -> dict[str, float]:
    """By a logistic regression on the counts of events; an event in few documents gets the weight of its base
    as asserted, less if negated or reported. No weight is below 0."""
    found = np.minimum(x[:, 5:], 20.0)
    w = fit_logistic(np.hstack((found, np.ones((len(x), 1)))), x[:, 0], ridge=1e-4)[:-1].clip(0.0)
    often = dict(zip(EVENTS, ((found > 0).sum(0) >= 20).tolist(), strict=True))
    own = dict(zip(EVENTS, w.tolist(), strict=True))
    asserted = {b: max([own[e] for e in (b, b + "|t") if often.get(e)], default=own[b]) for b in (*INSULTS, "attack")}
    return {e: own[e] if often[e] else asserted[e.split("|")[0]] * (0.3 if "|n" in e or "|r" in e else 1.0) for e in EVENTS}


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row of docs, by its whole text alone. Null texts count as
    empty; a null id stays null; rows that repeat are each scored. Other columns are ignored."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([score(t, grammar) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(f, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below 0.5. Nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(t, grammar) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    # plain names meanwhile, as mapInArrow finds no column with a dot in its name
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(f, plain.schema).toDF(*docs.columns)
