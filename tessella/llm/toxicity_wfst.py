"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five weighted transducers mark what a text says: negation and its scope, reported speech (verbs of saying, also over a colon, and quotes
over clauses), insults with a target on either side, and threats (a harm, whom it is meant for, a speaker's will). Words map to
symbols; an insult's weight comes from the lexicon. The transducers are composed once into one machine of states, symbols and
weighted arcs. Some arcs guess that a target will follow; where the clause ends without one that path ends too. The best path
(largest weight) of a line yields events: an insult asserted, at a target, negated, reported; a threat. Only lines that hold an insult or
a harm are read: one Aho-Corasick pass over the text finds them. Events weigh in a logistic score per document; its weights
start from a prior, so that threats count also where no label has shown any.

The insult transducer's lexicon is learned: from at most `sample` labelled documents of the training fold of each class, chosen by
a hash of doc_id, word stems are taken greedily by the toxic documents that they newly cover less the clean ones they touch.
All other words of the grammar are fixed lists; scoring covers all rows and whole texts.

Defined results: null and empty texts have no event and score as a document without any; very long texts are read whole, line by
line; rows that repeat a doc_id score each by its own text; several labels of one document, or of equal texts, count as their
maximum; null labels and doc_ids teach nothing; without both classes every document scores the share of toxic ones; equal gains of stems
are decided by length, then by name; extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, QUOTE, COLON, END, SPEAKER, BUT, BRING, UM = range(13)
#: Marks that transducers add to an insult or a harm.
NEGATED, REPORTED, AIMED, MEANT = 16, 32, 64, 128
KIND = 15
SCOPE = 6

# Fixed word lists of the grammar.
WORDS = {
    TARGET: "you your yours yourself u he she they them him her his their du dich dir dein deine ihr euch sie er tu te toi vous votre ton ta il elle ils tú usted ustedes vosotros ti él ella ellos",
    NEGATION: "not no never none nobody isn't aren't wasn't don't won't nicht kein keine nie niemals ne pas jamais aucun aucune nunca ni ningún ninguna jamás",
    REPORT: "said says say told called calls wrote quoted reported claimed sagte sagt nannte schrieb behauptete dit disait appelé écrit dijo dice llamó escribió",
    SPEAKER: "i i'll i'm we we'll we're will gonna going shall should must deserve ich wir werde werden sollst je j'ai nous vais allons yo voy vamos nosotros",
    BUT: "but aber sondern mais pero sino",
    BRING: "bring bringe bringen bringt",
    UM: "um",
}
# Fixed stems and endings of harms, by language.
HARMS = (
    ("kill hurt beat burn shoot destroy murder stab smash slaughter punch", "s ed ing en er"),
    ("strangl", "e es ed ing"),
    ("töt erschieß verprügel verbrenn erschlag schlag", "e st t en n et"),
    ("umbring umgebracht erschossen tötlich", "e en"),
    ("tu frapp brûl poignard", "er e es era erai ons ez"),
    ("mat golpe quem apuñal", "ar o aré aremos aré an"),
    ("shot dead die dying stirb stirbst verreck crève muere muérete mato mataré kys", ""),
)


def harms() -> frozenset[str]:
    """The forms of all harms."""
    return frozenset(stem + ending for stems, endings in HARMS for stem in stems.split() for ending in ("" if len(stem) > 3 else "er" if stem == "tu" else "ar", *endings.split()))


FIXED: dict[str, int] = {w: HARM for w in harms()} | {w: kind for kind, words in WORDS.items() for w in words.split()}
FIXED |= dict.fromkeys('"“”„«»', QUOTE) | dict.fromkeys(".!?;", END) | {":": COLON}

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]|[.!?;:]")
_STEM = re.compile(r"[^\W\d_]{3,}")
STEM_SIZES = (4, 5, 6, 7)

Arc = tuple[object, int, float]


class Transducer:
    """A weighted letter transducer: arcs(state, symbol) lists (next state, symbol that goes on, weight); none ends a path."""

    def __init__(self, arcs: Callable[[object, int], list[Arc]], start: object = 0):
        self.arcs, self.start = arcs, start

    def compose(self, after: Transducer) -> Transducer:
        def arcs(state, symbol):
            return [((mine, other), out, w + v) for mine, mid, w in self.arcs(state[0], symbol) for other, out, v in after.arcs(state[1], mid)]

        return Transducer(arcs, (self.start, after.start))

    def table(self, symbols: Iterable[int]) -> list[list[list[tuple[int, int, float]]]]:
        """Arcs by state and symbol, over the states that can be reached; state 0 is the start."""
        number, queue, table = {self.start: 0}, [self.start], []
        for state in queue:
            row = []
            for s in symbols:
                found = []
                for to, out, w in self.arcs(state, s):
                    if to not in number:
                        number[to] = len(queue)
                        queue.append(to)
                    found.append((number[to], out, w))
                row.append(found)
            table.append(row)
        return table


def _negation(state: int, symbol: int) -> list[Arc]:
    """state: words that the negation still reaches."""
    if symbol == NEGATION:
        return [(SCOPE, symbol, 0.0)]
    if symbol in (BUT, END, COLON):
        return [(0, symbol, 0.0)]
    return [(max(0, state - 1), symbol | NEGATED if state and symbol in (INSULT, HARM) else symbol, 0.0)]


def _report(state: int, symbol: int) -> list[Arc]:
    """State 1: behind a verb of saying; 2: inside quotes; 3: behind such a verb and a colon, to the sentence's end."""
    kind = symbol & KIND
    if kind == QUOTE:
        return [(0 if state == 2 else 2, symbol, 0.0)]
    if kind == REPORT:
        return [(state or 1, symbol, 0.0)]
    if kind == COLON:
        return [(3 if state in (1, 3) else state, symbol, 0.0)]
    if kind == END:
        return [(state if state == 2 else 0, symbol, 0.0)]
    return [(state, symbol | REPORTED if state and kind in (INSULT, HARM) else symbol, 0.0)]


def _aimed(wanted: int) -> Callable[[tuple[int, int], int], list[Arc]]:
    """State: (a target was seen in the clause, one is owed). A target behind the match is guessed, and worth a little less."""

    def arcs(state: tuple[int, int], symbol: int) -> list[Arc]:
        seen, owed = state
        kind = symbol & KIND
        if kind == TARGET:
            return [((1, 0), symbol, 0.0)]
        if kind in (END, COLON):
            return [] if owed else [((0, 0), symbol, 0.0)]
        if kind != wanted:
            return [(state, symbol, 0.0)]
        if seen or owed:
            return [(state, symbol | AIMED, 1.0)]
        return [((0, 0), symbol, 0.0), ((0, 1), symbol | AIMED, 0.5)]

    return arcs


def _threat(state: tuple[int, int], symbol: int) -> list[Arc]:
    """State: (a speaker or a will was named in the clause, a separable verb of harm is open). "bringe ... um" is one harm."""
    meant, open_ = state
    kind = symbol & KIND
    if kind == SPEAKER:
        return [((1, open_), symbol, 0.0)]
    if kind == BRING:
        return [((meant, 1), symbol, 0.0)]
    if kind in (END, COLON):
        return [((0, 0), symbol, 0.0)]
    if kind == UM and open_:
        return [((meant, 0), HARM | (MEANT if meant else 0), 0.5 * meant)]
    return [(state, symbol | MEANT if meant and kind == HARM else symbol, 0.5 * (meant and kind == HARM))]


#: In the order in which a symbol passes them.
PARTS = (Transducer(_negation), Transducer(_threat, (0, 0)), Transducer(_report), Transducer(_aimed(INSULT), (0, 0)), Transducer(_aimed(HARM), (0, 0)))
GRAMMAR = PARTS[0].compose(PARTS[1]).compose(PARTS[2]).compose(PARTS[3]).compose(PARTS[4])
_ARCS = GRAMMAR.table(range(UM + 1))


def best_path(symbols: Iterable[int]) -> list[int]:
    """What goes out on the path of the largest weight; a line's end is a clause's end."""
    live: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for s in symbols:
        then: dict[int, tuple[float, tuple]] = {}
        for state, (weight, path) in live.items():
            for to, out, w in _ARCS[state][s]:
                if to not in then or then[to][0] < weight + w:
                    then[to] = (weight + w, (path, out))
        live = then
    _, path = max(live.values(), key=lambda x: x[0])
    found = []
    while path:
        path, out = path
        found.append(out)
    return found[::-1]


def stems_of(text: str | None) -> set[str]:
    """Whole words ("word$") and beginnings ("word") that a lexicon may take up."""
    out = set()
    for w in set(_STEM.findall((text or "").lower())):
        out.add(w + "$")
        out.update(w[:k] for k in STEM_SIZES if len(w) >= k)
    return out


#: Weights before learning: asserted, strongest clause, aimed, negated, reported, threats, any insult, other harms.
PRIOR = np.array([0.5, 0.5, 0.5, -0.5, 0.0, 4.0, 0.0, 0.0])
FEATURES = len(PRIOR)


@dataclass
class Grammar:
    """The learned lexicon (stem to weight) and the logistic weights of events."""

    lexicon: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    offset: float = 0.0

    def __post_init__(self):
        self._finder = None

    def __getstate__(self):
        return {**self.__dict__, "_finder": None}

    def _find(self):
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for w in {k.rstrip("$") for k in self.lexicon} | harms() | set(WORDS[BRING].split()):
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        return self._finder

    def _symbol(self, word: str) -> tuple[int, float]:
        w = self.lexicon.get(word + "$")
        if w is None:
            w = next((self.lexicon[word[:k]] for k in STEM_SIZES if word[:k] in self.lexicon and len(word) >= k), None)
        return (FIXED.get(word, OTHER), 0.0) if w is None else (INSULT, w)

    def lines(self, low: str) -> Iterator[tuple[int, int]]:
        """Spans of the lines that hold a word of the lexicon or a harm."""
        done = 0
        for end, size in self._find().iter(low):
            begin = end - size + 1
            if begin >= done and not (begin and low[begin - 1].isalnum()):
                after = low.find("\n", end)
                first, done = low.rfind("\n", done, begin) + 1 or done, after + 1 if after >= 0 else len(low) + 1
                yield first, done - 1

    def matches(self, text: str | None) -> list[tuple[int, int, list[tuple[int, float]]]]:
        """(begin, end, [(marked symbol, weight)]) of every clause of the lower-cased text with an insult or a harm."""
        low, out = (text or "").lower(), []
        for begin, end in self.lines(low):
            words = list(_TOKEN.finditer(low, begin, end))
            quotes = [i for i, m in enumerate(words) if m.group() == '"']
            single = quotes[-1] if len(quotes) % 2 else -1
            read = [(OTHER, 0.0) if i == single else self._symbol(m.group()) for i, m in enumerate(words)]
            marked = best_path([*(s for s, _ in read), END])
            clause, first = [], begin
            for m, (s, weight), mark in zip([*words, None], [*read, (END, 0.0)], marked, strict=True):
                if mark & KIND in (INSULT, HARM):
                    clause.append((mark, weight))
                if s in (END, COLON):
                    if clause:
                        out.append((first, m.start() if m else end, clause))
                    clause, first = [], m.end() if m else end
        return out

    def clauses(self, text: str | None) -> list[tuple[int, int]]:
        """Spans of the clauses that hold a match."""
        return [(begin, end) for begin, end, _ in self.matches(text)]

    def events(self, text: str | None) -> np.ndarray:
        """Sums of weights of insults asserted, of the strongest clause, aimed, negated, reported; threats; any insult; other harms at a target."""
        out = np.zeros(FEATURES)
        for _, _, clause in self.matches(text):
            strength = 0.0
            for mark, weight in clause:
                if mark & KIND == HARM:
                    threat = mark & AIMED and mark & MEANT and not mark & (NEGATED | REPORTED)
                    out[5] += bool(threat)
                    out[7] += bool(mark & AIMED) and not threat
                    continue
                out[6] = 1
                if mark & NEGATED:
                    out[3] += weight
                elif mark & REPORTED:
                    out[4] += weight
                else:
                    out[0] += weight
                    strength += weight
                    out[2] += weight if mark & AIMED else 0
            out[1] = max(out[1], strength)
        out[:6] = np.log1p(out[:6])
        out[7] = np.log1p(out[7])
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.events(text) @ self.weights + self.offset, -30, 30))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _choose(found: list[set[int]], toxic: np.ndarray, names: list[str]) -> dict[str, float]:
    """Greedy cover: the stem with the largest gain, newly covered toxic less `price` times clean documents, again and again."""
    of: dict[int, tuple[list[int], int]] = {}
    for d, present in enumerate(found):
        for i in present:
            pos, neg = of.get(i, ([], 0))
            of[i] = (pos + [d], neg) if toxic[d] else (pos, neg + 1)
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    price, least = 3 * n_pos / n_neg, max(2, 0.004 * n_pos)
    open_ = {d for d in range(len(found)) if toxic[d]}
    lexicon: dict[str, float] = {}
    # Among equal gains the longer stem wins, as it means less else, and a beginning wins over the whole word.
    bonus = [1e-3 * len(n.rstrip("$")) - 1e-4 * n.endswith("$") for n in names]
    while open_:
        best, gain = None, 0.1
        for i, (pos, neg) in of.items():
            g = sum(d in open_ for d in pos) - price * neg + bonus[i]
            if g > gain:
                best, gain = i, g
        if best is None or gain < least:
            break
        pos, neg = of.pop(best)
        open_.difference_update(pos)
        lexicon[names[best]] = float(np.clip(np.log((len(pos) + 0.5) / (n_pos + 1) * (n_neg + 1) / (neg + 0.5)), 0.5, 8))
    # Stems that co-occur with the chosen ones are as sure: whole-word insults seldom stand alone.
    for i, (pos, neg) in of.items():
        w = np.log((len(pos) + 0.5) / (n_pos + 1) * (n_neg + 1) / (neg + 0.5))
        if len(pos) >= max(4, 0.03 * n_pos) and neg * price <= 0.02 * len(pos) and w > 3 and not any(names[i].startswith(k.rstrip("$")) for k in lexicon):
            lexicon[names[i]] = float(min(w, 8))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset by Newton's method, drawn towards the prior."""
    design, prior = np.column_stack([x, np.ones(len(x))]), np.append(PRIOR, 0.0)
    p, penalty = prior.copy(), np.append(np.full(x.shape[1], 0.05), 1e-6)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(design @ p, -30, 30)))
        hessian = design.T @ (design * (q * (1 - q))[:, None]) + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, design.T @ (y - q) - penalty * (p - prior))
        p = p + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return p[:-1], float(p[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2500, candidates: int = 4000) -> Grammar:
    """Learns lexicon and weights from at most `sample` documents of each class outside the held-out fold."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    rated = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = rated.where("toxic > 0").orderBy(*order).limit(sample).union(rated.where("toxic <= 0").orderBy(*order).limit(sample))
    # At most 2 x sample rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Copies of one text teach once; repeated doc_ids don't widen the sample.
    taught = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    taught = scratch.keep(taught.orderBy(*order, F.xxhash64("text")).limit(2 * sample).select("doc_id", "text", "toxic"))
    n_toxic, n_clean = rated.agg(F.count(F.when(F.col("toxic") > 0, 1)), F.count(F.when(F.col("toxic") <= 0, 1))).first()
    share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0

    def count(batches: Iterable) -> Iterator:
        import pandas as pd

        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(stems_of(t))
        if seen:
            yield pd.DataFrame({"stem": list(seen), "n": np.fromiter(seen.values(), np.int64, len(seen))})

    stems = taught.where("toxic > 0").coalesce(8).select("text").mapInPandas(count, "stem string, n long")
    stems = stems.groupBy("stem").agg(F.sum("n").alias("n")).where("n >= 2").orderBy(F.desc("n"), "stem").limit(candidates * 5)
    # Of the commonest stems of toxic documents those that clean ones share least.
    pool = {r["stem"]: r["n"] for r in stems.toLocalIterator()}

    def count_clean(batches: Iterable) -> Iterator:
        import pandas as pd

        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                seen.update(stems_of(t) & pool.keys())
        if seen:
            yield pd.DataFrame({"stem": list(seen), "n": np.fromiter(seen.values(), np.int64, len(seen))})

    clean = {r["stem"]: r["n"] for r in taught.where("toxic <= 0").coalesce(8).select("text").mapInPandas(count_clean, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).toLocalIterator()}
    names = sorted(pool, key=lambda s: (-(pool[s] - 2 * clean.get(s, 0)), s))[:candidates]
    number = {s: i for i, s in enumerate(names)}

    def present(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "stems": [sorted(number[s] for s in stems_of(t) & number.keys()) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(taught.mapInPandas(present, f"doc_id {kind}, toxic int, stems array<int>").toLocalIterator(), key=lambda r: (r["doc_id"], r["toxic"], r["stems"]))
    toxic = np.array([r["toxic"] > 0 for r in got], float)
    if len(np.unique(toxic)) < 2:
        return Grammar({}, offset=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    grammar = Grammar(_choose([set(r["stems"]) for r in got], toxic, names))

    def events(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "events": [grammar.events(t).tolist() for t in pdf["text"]]})

    rows = sorted(taught.mapInPandas(events, f"doc_id {kind}, toxic int, events array<double>").toLocalIterator(), key=lambda r: (r["doc_id"], r["toxic"], r["events"]))
    x, y = np.array([r["events"] for r in rows]), np.array([r["toxic"] > 0 for r in rows], float)
    grammar.weights, grammar.offset = _logistic(x, y)
    # The sample holds more toxic documents than the corpus; the offset goes back to their share.
    grammar.offset += float(np.log((share + 1e-6) / (1 - share + 1e-6)) - np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    return grammar


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.array([grammar.score(t) for t in pdf["text"]], float)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInPandas(lambda batches: lean(run(batches)), f"doc_id {kind}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
