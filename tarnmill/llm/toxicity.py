"""Toxicity by a weighted finite-state pattern grammar over clauses.

Word level: an acceptor (a trie of words and word beginnings) turns each word into a class and a
weight: insult, threat, target, negation, reported speech. The function words of the grammar are
fixed; the weighted insults are learned as log odds of words and word beginnings in labelled
documents, on top of a small seed list. Clause level: five small transducers, one for each class, are
composed into one deterministic machine. It reads the classes of a clause and weighs an insult or
threat by what has been read (negated, reported, a threat begun) and by whether the clause is aimed
at someone. Only scores of clauses go into the logistic model that gives a document's probability:
the greatest, their sum, how many there are, and how dense they are in the document.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Scratch, free_others, texts_of, with_fields

#: Labelled documents used at most; their ids and labels are broadcast.
MAX_LABELLED = 40_000
#: A learned arc: so many documents hold it, its log odds are above this, and it is so many deviations commoner in toxic ones.
LEAST_DOCUMENTS, LEAST_ODDS, LEAST_DEVIATIONS = 3, 1.0, 4.0
#: A clause with such a score is a strong one.
STRONG = 3.5
LEAST_LENGTH, MOST_LENGTH = 3, 9
_CACHED = 300_000

# The words of the grammar by class.
_WORDS = {
    "insult": "idiot moron scum trash loser pathetic worthless stupid disgusting clown imbecile dumb filth vermin dummkopf abschaum arschloch widerlich imbécile ordure crétin débile basura imbécil escoria asqueroso estúpido",
    "threat": "kill hurt destroy beat stab shoot burn die töten umbringen schlagen tuer frapper brûler matar golpear quemar",
    "will": "will gonna going shall must should werde wirst sollst vais vas dois voy vas debes",
    "target": "you your yours u they them he she du dich dein ihr euch sie vous toi tu votre ton ils elles tú te usted ustedes ellos",
    "negation": "not never no don't doesn't isn't aren't didn't won't nicht nie kein keine ne pas jamais non nunca jamás ni",
    "report": "said says wrote writes called claimed reported quoted according allegedly sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según",
}
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
_CLAUSE_END = frozenset(".!?;:\n")


def pieces(word: str) -> list[str]:
    """What an arc may read of a word: all of it (marked by its end) and its beginnings."""
    return [word + "$", *(word[:k] for k in range(LEAST_LENGTH, min(len(word), MOST_LENGTH) + 1))]


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine over word classes, from state 0; what isn't listed leaves the state as it is.

    ``scale`` is what a state makes of the weight of an insult or threat read in it, ``emits`` the weight
    that reading a class in a state adds, ``ends`` what a final state makes of insults and of threats.
    """

    moves: dict[tuple[int, str], int]
    scale: dict[int, float] = field(default_factory=dict)
    emits: dict[tuple[int, str], float] = field(default_factory=dict)
    ends: dict[int, tuple[float, float]] = field(default_factory=dict)


MACHINES = {
    "insult": Transducer({}, emits={(0, "insult"): 1.0}),  # times the weight of the arc that was read
    "threat": Transducer({(0, "will"): 1}, emits={(1, "threat"): 2.0}),
    "target": Transducer({(0, "target"): 1}, ends={0: (1.0, 0.0), 1: (1.1, 1.1)}),
    "negation": Transducer({(s, k): 2 if k == "negation" else max(0, s - 1) for s in range(3) for k in _WORDS}, scale={1: 0.5, 2: 0.5}),  # reaches over two symbols
    "report": Transducer({(0, "report"): 1}, scale={1: 0.6}),
}


@dataclass(frozen=True)
class Composed:
    """``moves[state][class]`` -> next state, factor of the weight; ``ends[state]`` -> factors of insults and of threats."""

    moves: list[dict[str, tuple[int, float]]]
    ends: list[tuple[float, float]]


def compose(machines: list[Transducer]) -> Composed:
    """The product of the machines: all of them read each class; scales and ends are multiplied, emissions added up."""
    start = (0,) * len(machines)
    number, todo, moves, ends = {start: 0}, [start], [], []
    for state in todo:  # grows
        scale = math.prod(m.scale.get(s, 1.0) for m, s in zip(machines, state, strict=True))
        row = {}
        for kind in _WORDS:
            after = tuple(m.moves.get((s, kind), s) for m, s in zip(machines, state, strict=True))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row[kind] = (number[after], scale * sum(m.emits.get((s, kind), 0.0) for m, s in zip(machines, state, strict=True)))
        moves.append(row)
        ends.append(tuple(math.prod(m.ends.get(s, (1.0, 1.0))[k] for m, s in zip(machines, state, strict=True)) for k in (0, 1)))
    return Composed(moves, ends)


CLAUSE = compose(list(MACHINES.values()))


@dataclass
class Grammar:
    """The acceptor's arcs: function words by class, and insults by word or beginning with a weight."""

    arcs: dict[str, float]
    cache: dict[str, tuple[str, float] | None] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.classes = {w: kind for kind, words in _WORDS.items() if kind != "insult" for w in words.split()}

    def read(self, word: str) -> tuple[str, float] | None:
        """The class of a word: the heaviest insult that it matches, else its function."""
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) > _CACHED:
            self.cache.clear()
        weight = max((self.arcs[p] for p in pieces(word) if p in self.arcs), default=0.0)
        kind = ("insult", weight) if weight > 0 else (self.classes[word], 0.0) if word in self.classes else None
        self.cache[word] = kind
        return kind

    def clause(self, symbols: list[tuple[str, float]]) -> tuple[float, float]:
        """Runs the composed machine over a clause: its score, and its greatest single weight."""
        state, insults, threats, insult, threat = 0, 0.0, 0.0, 0.0, 0.0
        for kind, weight in symbols:
            state, factor = CLAUSE.moves[state][kind]
            if kind == "insult":
                insults += weight * factor
                insult = max(insult, weight * factor)
            elif factor:
                threats += factor
                threat = max(threat, factor)
        aimed, meant = CLAUSE.ends[state]
        return insults * aimed + threats * meant, max(insult * aimed, threat * meant)

    def features(self, text: str) -> list[float]:
        read, cache = self.read, self.cache
        words = _TOKEN.findall(text.lower())
        clauses, symbols = [], []
        for w in words:
            kind = cache[w] if w in cache else read(w)
            if kind:
                symbols.append(kind)
            elif w in _CLAUSE_END and symbols:
                clauses.append(self.clause(symbols))
                symbols = []
        if symbols:
            clauses.append(self.clause(symbols))
        scores = [s for s, _ in clauses if s > 0]
        total, most = sum(scores), max((m for _, m in clauses), default=0.0)
        n = max(len(words), 1)
        strong = sum(s >= STRONG for s in scores)
        return [1.0, most, math.log1p(total), math.log1p(len(scores)), math.log1p(100 * total / n), math.log(n) / 5, math.log1p(strong), math.log1p(1000 * strong / n), float(not scores)]


def _expand(x: np.ndarray) -> np.ndarray:
    """The features and their products in pairs."""
    i, j = np.triu_indices(x.shape[1])
    return x[:, i] * x[:, j]


@dataclass
class ToxicityModel:
    arcs: dict[str, float]
    weights: list[float]

    def scores(self, grammar: Grammar, texts: list[str]) -> np.ndarray:
        x = np.array([grammar.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(_expand(x) @ np.array(self.weights), -30, 30))) if len(texts) else np.zeros(0)

    def to_json(self) -> str:
        return json.dumps({"arcs": self.arcs, "weights": self.weights})


def _piece_counts(batches):
    """Per piece the number of toxic and of other documents that hold it, summed within the task."""
    free_others()
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = set(_TOKEN.findall(text.lower())) - _CLAUSE_END
            for p in {p for w in words for p in pieces(w)}:
                counts.setdefault(p, [0, 0])[0 if toxic else 1] += 1
        if len(counts) > 1_000_000:
            yield _count_rows(counts)
            counts = {}
    yield _count_rows(counts)


def _count_rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["piece", "toxic", "other"])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the labelled documents used, one for each id (the least of several), with one label (the greater of several).

    The bound is taken by a hash of the id.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic_label"))
    some = one.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic_label").agg(F.min("text").alias("text"))
    return rows.select("text", "toxic_label", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).alias("half"))


def _learn_arcs(rows: DataFrame) -> dict[str, float]:
    """Log odds of pieces that are clearly more frequent in toxic documents, smoothed; seeds have at least 3.

    Their number is bounded by the labelled documents: each holds so many words.
    """
    n = {r.toxic_label: r["count"] for r in rows.groupBy("toxic_label").count().collect()}
    toxic, other = n.get(True, 0), n.get(False, 0)
    arcs: dict[str, float] = {}
    if toxic and other:
        counted = rows.select("text", "toxic_label").mapInArrow(_piece_counts, "piece string, toxic long, other long").groupBy("piece").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
        weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("o") + 0.5) / (other + 1))
        expected = (F.col("t") + F.col("o")) * (toxic / (toxic + other))
        kept = counted.withColumn("w", weight).where((F.col("t") >= LEAST_DOCUMENTS) & (F.col("w") > LEAST_ODDS) & (F.col("t") - expected >= LEAST_DEVIATIONS * F.sqrt(expected)))
        arcs = {r.piece: min(r.w, 8.0) for r in kept.select("piece", "w").collect()}
    for w in _WORDS["insult"].split():
        arcs[w + "$"] = max(arcs.get(w + "$", 0.0), 3.0)
    return arcs


def _features(arcs):
    def features(batches):
        free_others()
        grammar = Grammar(arcs.value)
        for batch in batches:
            x = [grammar.features(t) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return features


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from ``labels(doc_id, toxic)`` of documents in ``docs``; no other column is an input.

    The logistic model is fitted on features by arcs from the other half of the labelled documents, so
    that it sees arcs as they are on new texts; the arcs kept are learned from both halves.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = scratch.save(_labelled(docs, labels), "labelled")
    x, y = [], []
    for half in (0, 1):
        arcs = spark.sparkContext.broadcast(_learn_arcs(rows.where(F.col("half") == 1 - half)))
        found = rows.where(F.col("half") == half).select("text", "toxic_label").mapInArrow(_features(arcs), "x array<double>, y boolean").collect()
        x += [r.x for r in found]
        y += [float(r.y) for r in found]
    arcs = _learn_arcs(rows)
    scratch.drop("labelled")
    if len(set(y)) < 2:
        return ToxicityModel(arcs, _prior_weights().tolist())
    x, y = np.array(x), np.array(y)
    z, w = _expand(x), np.zeros(_expand(x).shape[1])
    for _ in range(40):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + 1e-4 * w
        hess = z.T @ (z * (p * (1 - p))[:, None]) / len(y) + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return ToxicityModel(arcs, w.tolist())


def _prior_weights() -> np.ndarray:
    """Without labels of both kinds: toxic from one clause with a seed word on."""
    n = len(Grammar({}).features(""))
    w = np.zeros(n * (n + 1) // 2)
    w[0], w[1] = -3.0, 2.0
    return w


def _score(model):
    def score(batches):
        free_others()
        grammar = Grammar(model.value.arcs)
        for batch in batches:
            yield batch.append_column("score", pa.array(model.value.scores(grammar, texts_of(batch.column("text"))), pa.float64()))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs(text, ...)`` with ``score``: the probability (0 to 1) that a text is toxic.

    A null or empty text is scored as one without any word. Rows are scored each by itself, repeated or
    not; an empty table gives an empty result; a column ``score`` of the input is replaced.
    """
    docs = docs.drop("score")
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), with_fields(docs.schema, score=DoubleType()))
