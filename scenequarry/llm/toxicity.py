"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to symbols: insult, threat (active or passive), target, agent, negation, reporting verb, other. Five weighted
transducers are composed into one machine. Insults and threats become mentions; targeting looks for a target near a
mention, ahead or behind, lets a mention with one through in full, an insult without one at a discount, and drops
threats without one; negation and reported speech mark what stands in their scope and discount it. An arc has a weight,
the arcs of a path multiply, and a mention's path carries its lexicon weight; a clause is matched if a path emits a
mention. Documents add up the path weights of their clauses by mark, and a logistic fit on labelled rows says what each
mark is worth; no feature looks at words outside paths.

The insult lexicon is learned from labelled rows: words and word beginnings whose document frequencies under the
labels differ beyond doubt (log-likelihood ratio), weighted by log odds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, labelled_ids, texts, texts_of

OTHER, INSULT, ACTIVE, PASSIVE, TARGET, AGENT, NEGATION, REPORT = range(8)
#: Function words of the grammar, in English, German, French and Spanish. Threats are active, done to somebody named as
#: an object, or passive, happening to whoever is named; targets can be objects, agents are subjects alone.
WORDS = {
    ACTIVE: "kill kills killing hurt hurts hurting destroy destroys destroying punish punishes punishing beat beats beating "
    "töten töte tötet vernichten vernichte vernichtet schlagen schlage schlägt tuer tue tuez tuerai détruire détruis détruirai frapper frappe frapperai "
    "matar mato mata mataré destruir destruyo destruiré golpear golpeo golpearé",
    PASSIVE: "killed destroyed punished beaten getötet zerstört geschlagen tué tuée tués détruit détruits frappé frappés matado matados destruido destruidos golpeado golpeados",
    TARGET: "you your him her them dich euch ihn ihr sie toi vous elle elles les ustedes usted te ti os",
    AGENT: "he she they du er il ils tu tú él ellos ellas",
    NEGATION: "not never no nicht kein keine nie pas jamais ne nunca jamás",
    REPORT: "said says wrote called quoted sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
}
PREFIXES = (5, 6, 7, 8)
CLAUSE = re.compile(rb"[.!?;\n]+")
#: ASCII other than letters, digits and apostrophes reads as a blank.
BLANKS = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))
#: Marks of an emitted mention.
PLAIN, TARGETED, NEGATED, REPORTED, BOTH = range(5)
MARKS = 5
FEATURES = MARKS + 1
#: Weights of arcs: an insult that nobody is the target of, and what stands in a negation's or a report's scope.
WITHOUT_TARGET, IN_NEGATION, IN_REPORT = 0.5, 0.25, 0.25
SCOPE = 3
REMEMBERED = 300_000


class Transducer:
    """Reads symbols with marks and emits them with marks; step(state, symbol, mark) -> (state, symbol, mark, arc weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def insults() -> Transducer:
    """An insult is a mention, plain so far."""
    return Transducer(0, lambda state, symbol, mark: (state, symbol, PLAIN if symbol == INSULT else mark, 1.0))


def threats() -> Transducer:
    """A threat is a mention, plain so far."""
    return Transducer(0, lambda state, symbol, mark: (state, symbol, PLAIN if symbol in (ACTIVE, PASSIVE) else mark, 1.0))


def targeting() -> Transducer:
    """Mentions up to SCOPE words after or before a target are targeted: active threats need one that can be an object,
    others take agents too. Insults without one go on at a discount, threats without one go on as no mention.

    What is read comes out SCOPE words later. The state is how far the last target and the last of either still reach,
    and what is held.
    """
    open_to = {TARGET: (INSULT, ACTIVE, PASSIVE), AGENT: (INSULT, PASSIVE)}

    def step(state, symbol, mark):
        of_target, of_any, held = state
        if symbol in open_to:
            held = tuple((s, TARGETED if s in open_to[symbol] else m) for s, m in held)
            of_target, of_any = SCOPE if symbol == TARGET else max(of_target - 1, 0), SCOPE
            new = (OTHER, None)
        else:
            reached = mark is not None and (of_target if symbol == ACTIVE else of_any)
            new = (symbol, TARGETED if reached else mark)
            of_target, of_any = max(of_target - 1, 0), max(of_any - 1, 0)
        (out, at), *rest = *held, new
        weight = WITHOUT_TARGET if at == PLAIN else 1.0
        if out in (ACTIVE, PASSIVE) and at == PLAIN:
            at, weight = None, 1.0
        if at is not None:
            out = INSULT  # what kind of mention it was makes no difference any more
        elif out in (ACTIVE, PASSIVE):
            out = OTHER
        return (of_target, of_any, tuple((INSULT, m) if m == TARGETED else (s, m) for s, m in rest)), out, at, weight

    return Transducer((0, 0, ((OTHER, None),) * SCOPE), step)


def negation() -> Transducer:
    """Mentions up to SCOPE words after a negation are negated."""

    def step(left, symbol, mark):
        if symbol == NEGATION:
            return SCOPE, symbol, mark, 1.0
        within = left and mark is not None
        return max(left - 1, 0), symbol, NEGATED if within else mark, IN_NEGATION if within else 1.0

    return Transducer(0, step)


def reporting() -> Transducer:
    """Mentions after a reporting verb, to the end of the clause, are reported."""

    def step(on, symbol, mark):
        if symbol == REPORT:
            return 1, symbol, mark, 1.0
        within = on and mark is not None
        return on, symbol, (BOTH if mark == NEGATED else REPORTED) if within else mark, IN_REPORT if within else 1.0

    return Transducer(0, step)


def compose(*parts: Transducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One deterministic machine: next state, emitted mark (-1: none) and weight by state and symbol; state 0 is the start."""
    start = tuple(p.start for p in parts)
    number, todo, rows = {start: 0}, [start], []
    for state in todo:
        row = []
        for symbol in range(8):
            after, mark, weight = [], None, 1.0
            for p, s in zip(parts, state, strict=True):
                s, symbol, mark, w = p.step(s, symbol, mark)
                after.append(s)
                weight *= w
            key = tuple(after)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append((number[key], -1 if mark is None else mark, weight))
        rows.append(row)
    table = np.array(rows)
    return table[:, :, 0].astype(np.int32), table[:, :, 1].astype(np.int8), table[:, :, 2]


@cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grammar's composed tables; marks come out SCOPE words after their word was read."""
    return compose(insults(), threats(), targeting(), negation(), reporting())


class Grammar:
    """The composed machine with a lexicon {word or beginning + '*': weight}."""

    def __init__(self, lexicon: dict[str, float], tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.lexicon = {k.encode(): v for k, v in lexicon.items()}
        self.fixed = {w.encode(): s for s, ws in WORDS.items() for w in ws.split()}
        self.nxt, self.out, self.weight = (x.tolist() for x in tables or machine())
        self.known: dict[bytes, tuple[int, float]] = {}

    def read(self, word: bytes) -> tuple[int, float]:
        """Symbol and lexicon weight of a word; the grammar's own words come before the lexicon's."""
        got = self.known.get(word)
        if got is None:
            if word in self.fixed:
                got = (self.fixed[word], 1.0)
            else:
                weight = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
                got = (INSULT, weight) if weight > 0 else (OTHER, 1.0)
            if len(self.known) < REMEMBERED:
                self.known[word] = got
        return got

    def paths(self, clause: bytes) -> list[tuple[int, float]]:
        """Mark and weight of each mention that the machine emits over a clause."""
        symbols, state, out = [self.read(w) for w in clause.translate(BLANKS).split()], 0, []
        for i, (symbol, _) in enumerate(symbols + [(OTHER, 0.0)] * SCOPE):
            mark = self.out[state][symbol]
            if mark >= 0:
                out.append((mark, self.weight[state][symbol] * symbols[i - SCOPE][1]))
            state = self.nxt[state][symbol]
        return out

    def measure(self, data: bytes) -> np.ndarray:
        """Features of a document: its clauses' path weights added up by mark, and how many clauses matched; logarithmic."""
        text = data.decode("utf-8", "replace").lower().encode()
        sums, clauses, read = np.zeros(MARKS), 0, self.read
        if any(read(w)[0] in (INSULT, ACTIVE, PASSIVE) for w in set(text.translate(BLANKS).split())):
            for clause in CLAUSE.split(text):
                found = self.paths(clause)
                clauses += bool(found)
                for mark, weight in found:
                    sums[mark] += weight
        return np.append(np.log1p(sums), math.log1p(clauses))


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, marked with a star; beginnings are counted in characters."""
    out = [word]
    if len(word) >= PREFIXES[0]:
        chars = word.decode("utf-8", "replace")
        out += [chars[:n].encode() + b"*" for n in PREFIXES if len(chars) >= n]
    return out


def count_features(rows: DataFrame) -> DataFrame:
    """feature, pos, neg: in how many of the (text, label) rows each occurs; tasks add up first."""

    def run(batches):
        seen: dict[bytes, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], ["feature", "neg", "pos"])

        for b in batches:
            for data, label in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                words = set((data or b"").decode("utf-8", "replace").lower().encode().translate(BLANKS).split())
                for f in {f for w in words for f in features(w)}:
                    seen.setdefault(f, [0, 0])[label] += 1
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    return rows.select("text", "label").mapInArrow(run, "feature binary, neg long, pos long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(rows: DataFrame, ratio: float = 20.0, odds: float = 1.5, most: int = 4000) -> dict[str, float]:
    """Features that a toxic label goes with: log-likelihood ratio and log odds of at least these, the strongest `most`."""
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    p, n = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not p or not n:
        return {}
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    share = (a + b) / (p + n)
    g2 = 2 * (part(a, p * share) + part(b, n * share) + part(p - a, p * (1 - share)) + part(n - b, n * (1 - share)))
    weight = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (n + 1))
    found = count_features(rows).filter("pos >= 3").withColumn("g2", g2).withColumn("weight", weight).filter((F.col("g2") >= ratio) & (F.col("weight") >= odds))
    return {bytes(r.feature).decode(): r.weight for r in found.orderBy(F.desc("g2"), "feature").limit(most).select("feature", "weight").collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method with a ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pull = np.zeros(x.shape[1]), np.append(1e-6, np.full(x.shape[1] - 1, ridge))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - pull * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: dict[str, float], coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients


def measured(rows: DataFrame, lexicon: dict[str, float], extra: str = "") -> DataFrame:
    """The rows' first column as it is, and an array of features of their text, the second column."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, machine()))
    key, kind = rows.dtypes[0]

    def run(batches: Iterator[pa.RecordBatch]):
        grammar = Grammar(*shared.value)
        for b in batches:
            xs = [grammar.measure(data or b"").tolist() for data in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.list_(pa.float64()))], [key, "x"])

    return rows.mapInArrow(run, f"{key} {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = 20_000) -> Model:
    """Fits on labelled rows where `keep` holds, about `most` of them at most, chosen by a hash of the id.

    labels: doc_id, toxic; null labels and unknown ids don't count, and an id that repeats counts once. Without both labels every score is the base rate.
    """
    sample = texts_of(docs, bounded_sample(labelled_ids(docs, labels, "toxic", keep), F.col("doc_id"), most))
    lexicon = learn_lexicon(sample)
    got = measured(sample, lexicon).collect()  # `most` rows of a few numbers
    if not got:
        return Model({}, np.append(-3.0, np.zeros(FEATURES)))
    y = np.array([r.label for r in got], float)
    x = np.array([r.x for r in got])
    if y.min() == y.max():
        return Model(lexicon, np.append(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), np.zeros(FEATURES)))
    return Model(lexicon, logistic(x, y))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for every row of docs; null and empty texts have no mentions.

    Equal texts get equal scores, in repeated rows too. A text of any length is read clause by clause. Other columns,
    whatever their names, don't matter.
    """
    w = model.coefficients
    z = F.lit(float(w[0]))
    for i, c in enumerate(w[1:]):
        z = z + float(c) * F.col("x")[i]
    score = 1 / (1 + F.exp(-z))
    return measured(texts(docs), model.lexicon).select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
