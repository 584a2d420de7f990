"""Toxicity by a weighted finite-state pattern grammar.

Five transducers, each a small machine of arcs (input, output, weight), are composed left to right and run over the words
of a clause; the path of the greatest weight counts:

1. insult: a lexicon of weighted entries (whole words, or stems with any ending), learned from labelled rows, turns words
   into the symbols I(nsult), T(hreat), Y(ou: target), N(ot), S(aid), C(losing a scope) or O(ther);
2. reported speech: from S to the next C, insults and threats are another's;
3. negation: N denies insults and threats among the next few words, up to C;
4. threat: T stands if a target is among a few words before or after it, and is dropped if not;
5. target: I is aimed if a target is near it, and plain if not.

2 and 3 follow one path; 4 and 5 guess that a target will come, pay nothing for it, and end a path whose guess fails.
What the best path leaves of a clause (plain, aimed, denied, reported, threat) carries the entries' weights; a text's
features are their sums, and the weights of these are fitted by logistic regression on labelled rows. So an isolated
word scores only as part of the clause it stands in.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, spread, texts_of

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[,:()]")
CLAUSE = re.compile(r"[.!?;\n]+")
#: Cue words for English, German, French and Spanish.
THREAT = frozenset("kill hurt destroy beat shoot stab burn attack töten umbringen schlagen verletzen vernichten tuer frapper blesser détruire matar golpear herir destruir".split())
TARGET = frozenset("you your yours yourself u du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros he she they them".split())
NEGATION = frozenset("not never no isn aren wasn don doesn nicht kein keine nie niemals pas jamais aucun nunca jamás".split())
REPORTED = frozenset("said says wrote writes quoted claimed alleged reported sagte sagt schrieb behauptete dit écrit affirmé dijo dice escribió".split())
CLOSING = frozenset(", : ( ) but aber sondern mais pero sino".split())
STATES = ("plain", "aimed", "denied", "reported", "threat")
#: What symbols of the last transducer are, by state.
MARKS = {"I": "plain", "A": "aimed", "In": "denied", "Tn": "denied", "Ir": "reported", "Tr": "reported", "X": "threat"}
#: Words that a negation, a threat and a target reach.
REACH = {"negation": 4, "threat": 6, "target": 6}
STEMS = (4, 5, 6, 7, 8)


class Lexicon:
    """word$ entries match whole words, others are stems at the start of a word; the longest entry counts."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.auto = ahocorasick.Automaton()
        for k in [*weights, *(t + "$" for t in THREAT)]:
            self.auto.add_word(k.rstrip("$"), 1)
        if len(self.auto):
            self.auto.make_automaton()
        self.longest = max(map(len, weights), default=0)

    def weight(self, word: str) -> float:
        get = self.weights.get
        w = get(word + "$")
        if w is not None:
            return w
        for n in range(min(len(word), self.longest), 0, -1):
            w = get(word[:n])
            if w is not None:
                return w
        return 0.0


class Transducer:
    """States, and for each state and input symbol the arcs (output symbol, weight, next state). Every arc reads and writes one
    symbol. An input without arcs ends a path; `final` says where paths may end."""

    start: object = 0

    def arcs(self, state, symbol) -> list[tuple[object, float, object]]:
        raise NotImplementedError

    def final(self, state) -> bool:
        return True


class InsultLexicon(Transducer):
    """Words to symbols. A word of several classes has an arc for each; an insult's arc carries its entry's weight."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def arcs(self, state, word):
        out = []
        if w := self.lexicon.weight(word):
            out.append(("I", w, 0))
        out += [(symbol, 0.0, 0) for symbol, words in (("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("S", REPORTED), ("C", CLOSING)) if word in words]
        return out or [("O", 0.0, 0)]


class ReportedSpeech(Transducer):
    """State 1: after S."""

    def arcs(self, state, x):
        if x == "S":
            return [("O", 0.0, 1)]
        return [(f"{x}r" if state and x in ("I", "T") else x, 0.0, 0 if x == "C" else state)]


class Negation(Transducer):
    """The state counts the words that the last N still reaches."""

    def __init__(self, reach: int = REACH["negation"]):
        self.reach = reach

    def arcs(self, state, x):
        if x == "N":
            return [("O", 0.0, self.reach)]
        return [(f"{x}n" if state and x in ("I", "T") else x, 0.0, 0 if x == "C" else max(0, state - 1))]


class NearTarget(Transducer):
    """Writes `hit` for `symbol` if a Y is within reach before or after it, and `miss` if not.

    A state is (words left in the reach of the last Y, words left until a promised Y has to come). Where no Y has been,
    there is an arc for each guess; the one that a Y will come weighs 1, and its path ends if none comes in time."""

    start = (0, 0)

    def __init__(self, symbol: str, hit: str, miss: str, reach: int):
        self.symbol, self.hit, self.miss, self.reach = symbol, hit, miss, reach

    def arcs(self, state, x):
        seen, owed = state
        if x == "Y":
            return [("Y", 0.0, (self.reach, 0))]
        if owed == 1:  # the last word that could have kept the promise
            return []
        after = (max(0, seen - 1), max(0, owed - 1))
        if x != self.symbol:
            return [(x, 0.0, after)]
        if seen:
            return [(self.hit, 1.0, after)]
        return [(self.hit, 1.0, (after[0], after[1] or self.reach)), (self.miss, 0.0, after)]

    def final(self, state):
        return not state[1]


class Composed(Transducer):
    """The composition of two transducers: the second reads what the first writes. States are pairs, and only those that
    some text reaches are ever made; arcs are kept once found."""

    KEPT = 200_000

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.start, self._known = first, second, (first.start, second.start), {}

    def arcs(self, state, x):
        found = self._known.get((state, x))
        if found is None:
            a, b = state
            found = [(z, v + w, (c, d)) for y, v, c in self.first.arcs(a, x) for z, w, d in self.second.arcs(b, y)]
            if len(self._known) >= self.KEPT:
                self._known.clear()
            self._known[state, x] = found
        return found

    def final(self, state):
        return self.first.final(state[0]) and self.second.final(state[1])


def grammar(lexicon: Lexicon) -> Transducer:
    """Words to what is left of a clause; the symbols' transducers are composed first, so that words meet one machine."""
    rules = Composed(Composed(ReportedSpeech(), Negation()), Composed(NearTarget("T", "X", "O", REACH["threat"]), NearTarget("I", "A", "I", REACH["target"])))
    return Composed(InsultLexicon(lexicon), rules)


def best_path(machine: Transducer, word_list: list[str]) -> tuple[float, list[object]]:
    """(weight, outputs) of the heaviest path over the words; of equally heavy ones the first found. Never without a path here:
    each guess has its opposite."""
    front: dict[object, tuple[float, tuple | None]] = {machine.start: (0.0, None)}
    for word in word_list:
        after: dict[object, tuple[float, tuple | None]] = {}
        for state, (weight, path) in front.items():
            for out, w, to in machine.arcs(state, word):
                if to not in after or weight + w > after[to][0]:
                    after[to] = (weight + w, (out, path))
        front = after
    ends = [x for state, x in front.items() if machine.final(state)]
    if not ends:
        return float("-inf"), []
    weight, path = max(ends, key=lambda x: x[0])
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return weight, out[::-1]


def clause_weights(word_list: list[str], machine: Transducer, lexicon: Lexicon) -> dict[str, float]:
    """Weights of the matched parts of a clause by state: an insult's is its entry's, a threat's is 1."""
    out: dict[str, float] = {}
    for word, symbol in zip(word_list, best_path(machine, word_list)[1]):
        if symbol in MARKS:
            out[MARKS[symbol]] = out.get(MARKS[symbol], 0.0) + (1.0 if symbol[0] in "TX" else lexicon.weight(word))
    return out


def text_features(text: str, lexicon: Lexicon, machine: Transducer) -> list[float]:
    """log(1 + summed weight) by state, then the log number of matched clauses."""
    sums, clauses = dict.fromkeys(STATES, 0.0), 0
    low = text.lower()
    if len(lexicon.auto) and next(lexicon.auto.iter(low), None) is not None:
        for clause in CLAUSE.split(low):
            if next(lexicon.auto.iter(clause), None) is None:
                continue
            own = clause_weights(TOKEN.findall(clause), machine, lexicon)
            for state, w in own.items():
                sums[state] += w
            clauses += bool(own)
    return [*np.log1p([sums[s] for s in STATES]).tolist(), float(np.log1p(clauses))]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    coef: list[float]
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ np.asarray(self.coef) + self.bias)))


def choose_entries(counts: list[tuple[str, int, int]], n: int, n_toxic: int, least: int = 3, z: float = 4.0) -> dict[str, float]:
    """(key, documents, toxic documents) to entries: far more often toxic than chance and mostly toxic.

    A stem gives way to a longer entry that stands in nearly all its toxic documents, a longer entry to a remaining shorter one.
    """
    p = max(n_toxic, 1) / max(n, 1)
    good = {k: (d, t) for k, d, t in counts if t >= least and t > 0.6 * d and t - d * p > z * np.sqrt(d * p * (1 - p) + 1e-9)}
    kept: dict[str, float] = {}
    dropped = set()
    for k in sorted(good, key=len, reverse=True):
        for n_ in range(min(STEMS), len(k)):
            s = k[:n_]
            if s in good and good[k][1] >= 0.98 * good[s][1]:
                dropped.add(s)
    for k in sorted(good, key=len):
        if k not in dropped and not any(k[:m] in kept for m in range(min(STEMS), len(k))):
            d, t = good[k]
            kept[k] = float(np.log((t + 0.5) / (d - t + 0.5)) - np.log(p / (1 - p + 1e-9)))
    return kept


def keys_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in STEMS if len(w) >= n} | {w + "$" for w in words if len(w) > 2}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton steps with a ridge on the weights; features without variation keep weight 0."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    penalty = np.diag([ridge * max(1, len(y))] * x.shape[1] + [1e-6])
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        step = np.linalg.solve(xb.T @ (xb * (p * (1 - p))[:, None]) + penalty, xb.T @ (p - y) + penalty @ (w - np.eye(len(w))[-1] * w[-1]))
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(labelled: DataFrame, max_rows: int = 6000) -> ToxicityModel:
    """Fit on (doc_id, text, label); at most max_rows rows, the first by a hash of doc_id.

    To the driver come the chosen lexicon entries and six numbers for each sampled row.
    Null labels are left out; without any toxic row every score is the same low value. Rows of one doc_id, or of none, are
    ordered by a hash of their text where the bound cuts between them; repeated rows count as often as they stand.
    """
    sample = materialize(labelled.filter(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "label").limit(max_rows), "toxic-sample").repartition(12)

    def count(batches):
        docs, toxic = Counter(), Counter()
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                keys = keys_of(text)
                docs.update(keys)
                if label:
                    toxic.update(keys)
        keys = list(docs)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield {"key": part, "docs": [docs[k] for k in part], "toxic": [toxic[k] for k in part]}

    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    sums = map_rows(sample, count, "key string, docs long, toxic long").groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    found = sums.filter((F.col("toxic") >= 3) & (F.col("toxic") > 0.6 * F.col("docs"))).collect()
    weights = choose_entries([tuple(r) for r in found], n, n_toxic)
    lexicon_of = _lexicon(weights)

    def features(batches):
        lexicon = lexicon_of()
        machine = grammar(lexicon)
        for b in batches:
            yield {"label": b["label"], "x": [text_features(t, lexicon, machine) for t in b["text"]]}

    rows = map_rows(sample.select("text", "label"), features, "label int, x array<double>").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(STATES) + 1)
    coef, bias = fit_logistic(x, np.array([r.label for r in rows], float))
    return ToxicityModel(weights, coef.tolist(), bias)


def _lexicon(weights: dict[str, float]):
    held = []

    def get() -> Lexicon:
        if not held:
            held.append(Lexicon(weights))
        return held[0]

    return get


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and the clause weights by state, for every row. Null and empty texts get the score of no matched
    clause; texts of any length are read whole, clause by clause; repeated rows and null doc_ids are scored like any other,
    an empty table gives an empty result."""
    weights, m = model.weights, model

    def run(batches):
        lexicon = Lexicon(weights)
        machine = grammar(lexicon)
        for b in batches:
            x = np.array([text_features(t, lexicon, machine) for t in b["text"]])
            score = m.score(x)
            yield {"doc_id": b["doc_id"], "score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist(), "clause_weights": x[:, : len(STATES)].tolist()}

    return map_rows(spread(texts_of(docs, id_col, text_col)), run, "doc_id long, score double, predicted int, clause_weights array<double>")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most max_rows labelled training rows; only that many ids are sent to the scan of the texts."""
    chosen = labels.filter(F.col(label).isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return texts_of(docs).join(F.broadcast(chosen), "doc_id")
