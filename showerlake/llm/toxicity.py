"""Operator 5: toxicity by a weighted finite-state grammar over clauses.

A lexicon, a transducer over letters, turns words into classes: insult, threat,
intent, target, negation, reporting, other. Composed with it are five transducers
over classes: one marks insults; one marks threats, which weigh WEAK unless a word
of intent stands up to NEAR words before; one knows whether the clause names a
target, which makes its final weight TARGETED; one marks insults and threats as
negated (a negation up to NEAR words before), one as reported (a reporting word
before in the clause). A clause's weight is the sum of its hits' weights along
the path, times the path's final weight; a text's score is the logistic function
of the sum over its matched clauses, less BIAS. Clauses end at . ! ? ; or a new
line and are found once, so that the work grows with the text alone, however long
it is. In words with an apostrophe ("l'idiot", "moron's") each part counts.

The lexicon is a small fixed one and what labels teach: words and word stems
chosen greedily for how many more toxic texts they explain (MIN_TEXTS at least)
without occurring in clean ones. How much negation and reporting count is learned
too. Learning takes labelled rows of the smallest crc32 of their id, whole texts,
until there are SAMPLE of them or they have SAMPLE_CHARACTERS; of rows with one id,
the smallest text.

Texts that are null or empty score like texts without a match (1 / (1 +
exp(BIAS))). Repeated rows are scored each; an empty table gives no rows; other
columns than id and text are not read. Labels for missing documents and null
labels are ignored; without labels the fixed lexicon decides alone.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showerlake.llm.common import materialise, mod_crc, prepare, row_slices, text_buffers, tidy

#: Bounds of the labelled rows that are learned from, and of their characters.
SAMPLE, SAMPLE_CHARACTERS = 16_000, 64_000_000
BIAS, NEAR, MIN_TEXTS, WEAK, TARGETED, THREAT_WEIGHT = 2.0, 3, 3, 0.4, 1.5, 2.6
STEMS = range(3, 9)
#: Fixed lexicon.
INSULTS = "idiot moron stupid dumb fool loser scum trash pathetic worthless disgusting ugly filthy clown imbecile jerk crap damn bastard bitch asshole fuck shit cretin vermin".split()
THREATS = "kill hurt destroy punch stab shoot murder beat burn hang rape strangle".split()
TARGETS = "you your yours yourself u he she him her they them their these those all such".split()
NEGATIONS = "not no never isn't aren't don't doesn't didn't won't wasn't nicht kein keine nie pas jamais ne no nunca ni".split()
REPORTS = "said says say wrote writes claimed called quoted reported told sagte dit dijo".split()
INTENTS = "will gonna going shall should must i'll we'll i'm we're werde werden vais vamos voy".split()
_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r"[^\W_]+(?:['\u2019][^\W_]+)*")
CLASSES = OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = tuple(range(7))
HITS = ("insult", "threat")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, symbol, weight); missing arcs keep state and symbol, missing final weights are 1."""

    arcs: dict[tuple[object, object], tuple[object, object, float]] = field(default_factory=dict)
    finals: dict[object, float] = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def final(self, state) -> float:
        return self.finals.get(state, 1.0)

    def compose(self, other: Transducer, symbols) -> Transducer:
        """This one's outputs read by the other; states are pairs, weights are multiplied."""
        made, todo = Transducer(finals={(0, 0): self.final(0) * other.final(0)}), [(0, 0)]
        while todo:
            p, q = todo.pop()
            for s in symbols:
                p2, mid, w = self.step(p, s)
                q2, out, v = other.step(q, mid)
                made.arcs[((p, q), s)] = ((p2, q2), out, w * v)
                if (p2, q2) not in made.finals:
                    made.finals[p2, q2] = self.final(p2) * other.final(q2)
                    todo.append((p2, q2))
        renumbered = {state: k for k, state in enumerate(sorted(made.finals, key=lambda x: (x != (0, 0), str(x))))}  # 0 begins
        return Transducer({(renumbered[a], s): (renumbered[b], o, w) for (a, s), (b, o, w) in made.arcs.items()}, {renumbered[a]: w for a, w in made.finals.items()})


def insults() -> Transducer:
    return Transducer({(0, INSULT): (0, "insult", 1.0)})


def threats() -> Transducer:
    """States count down the words that an intent reaches."""
    t = Transducer()
    for n in range(NEAR + 1):
        for s in (*CLASSES, "insult"):
            out, weight = ("threat", 1.0 if n else WEAK) if s == THREAT else (s, 1.0)
            t.arcs[n, s] = (NEAR if s == INTENT else max(n - 1, 0), out, weight)
    return t


def targets() -> Transducer:
    """State 1: a target was named."""
    return Transducer({(0, TARGET): (1, TARGET, 1.0)}, {1: TARGETED})


def negations(factor: float) -> Transducer:
    """States count down the words that a negation reaches."""
    t = Transducer()
    for n in range(NEAR + 1):
        for s in (*CLASSES, *HITS):
            hit = n > 0 and s in HITS
            t.arcs[n, s] = (NEAR if s == NEGATION else max(n - 1, 0), f"negated {s}" if hit else s, factor if hit else 1.0)
    return t


def reports(factor: float) -> Transducer:
    """State 1: a reporting word came before in the clause."""
    t = Transducer({(n, REPORT): (1, REPORT, 1.0) for n in (0, 1)})
    for hit in (*HITS, *(f"negated {h}" for h in HITS)):
        t.arcs[1, hit] = (1, f"reported {hit}", factor)
    return t


def grammar(negated: float, reported: float) -> Transducer:
    made = insults()
    for other in (threats(), targets(), negations(negated), reports(reported)):
        made = made.compose(other, CLASSES)
    return made


class Lexicon:
    """A transducer over letters: arcs (state, letter) -> state; a word's end in a state, or a stem's state passed, gives class and weight."""

    MOST_REMEMBERED = 20_000

    def __init__(self, words: dict[str, tuple[int, float]], stems: dict[str, float]):
        self.arcs: dict[tuple[int, str], int] = {}
        self.whole = {self._path(w): v for w, v in words.items()}
        self.stems = {self._path(w): v for w, v in stems.items()}
        self.memory: dict[str, tuple[int, float]] = {}

    def _path(self, word: str) -> int:
        state = 0
        for c in word:
            state = self.arcs.setdefault((state, c), len(self.arcs) + 1)
        return state

    def _read(self, word: str) -> tuple[int, float]:
        state, stem = 0, 0.0
        for c in word:
            state = self.arcs.get((state, c), -1)
            if state < 0:
                break
            stem = max(stem, self.stems.get(state, 0.0))
        kind, weight = self.whole.get(state, (OTHER, 1.0))
        if stem and (kind != INSULT or stem > weight):
            return INSULT, stem
        return kind, weight

    def __call__(self, word: str) -> tuple[int, float]:
        found = self.memory.get(word)
        if found is None:
            plain = word.replace("\u2019", "'")
            found = self._read(plain)
            if found[0] == OTHER and "'" in plain:
                found = max((self._read(x) for x in plain.split("'")), key=lambda x: (x[0] in (INSULT, THREAT), x[0] != OTHER, x[1]))
            if len(self.memory) >= self.MOST_REMEMBERED:
                self.memory.clear()
            self.memory[word] = found
        return found


@dataclass
class Model:
    """words and stems: weights of insults; negated and reported: what is left of a hit's weight."""

    words: dict[str, float]
    stems: dict[str, float]
    negated: float = 0.3
    reported: float = 0.4

    def __post_init__(self):
        import ahocorasick

        self.grammar = grammar(self.negated, self.reported)
        fixed = {w: (kind, 1.0) for kind, group in ((INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in group}
        fixed |= {w: (THREAT, THREAT_WEIGHT) for w in THREATS} | {w: (INSULT, v) for w, v in self.words.items()}
        self.lexicon = Lexicon(fixed, self.stems)
        find = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREATS]:
            find.add_word(w, len(w))
        find.make_automaton()
        self.find = find

    def clause(self, text: str) -> tuple[float, set]:
        """Weight of a clause and the marks of its insults and threats."""
        state, total, marks = 0, 0.0, set()
        for word in _TOKEN.findall(text):
            kind, weight = self.lexicon(word)
            state, out, factor = self.grammar.step(state, kind)
            if isinstance(out, str):
                total += weight * factor
                marks.add(out.split()[0] if " " in out else "plain")
        return total * self.grammar.final(state), marks

    def match(self, text: str) -> tuple[float, int, set]:
        """Weight of all matched clauses of a lower-cased text, their number, and their marks."""
        total, clauses, marks, upto = 0.0, 0, set(), -1
        starts: list[int] = []
        for end, n in self.find.iter(text):
            begin = end - n + 1
            if end < upto or begin and text[begin - 1].isalnum():
                continue
            if not starts:
                borders = [m.span() for m in _CLAUSE.finditer(text)]
                starts, stops = [0, *(b for _, b in borders)], [*(a for a, _ in borders), len(text)]
            k = bisect_right(starts, begin) - 1
            upto = stops[k]
            weight, own = self.clause(text[starts[k] : upto])
            if own:
                total, clauses, marks = total + weight, clauses + 1, marks | own
        return total, clauses, marks


def _texts(column: pa.Array) -> Iterator[str]:
    """Lower-cased texts, a slice at a time; null is empty."""
    _, at = text_buffers(column)
    for lo, hi in row_slices(at):
        yield from pc.utf8_lower(pc.fill_null(column.slice(lo, hi - lo), "")).to_pylist()


def features(text: str) -> set[str]:
    """A lower-cased text's words, as `=word`, and their stems."""
    words = {w for token in _TOKEN.findall(text) for w in (token.replace("\u2019", "'"), *re.split("['\u2019]", token))}
    return {f"={w}" for w in words} | {w[:n] for w in words for n in STEMS if n <= len(w)}


def sampled(docs: DataFrame, labels: DataFrame, rows: int, characters: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that are learned from."""
    at = F.crc32(F.concat(F.lit("toxic "), F.col("doc_id").cast("string")).cast("binary")).alias("at")
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.withColumn("at", at).orderBy("at", "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = materialise(texts.join(F.broadcast(own), "doc_id").groupBy("doc_id", "toxic", "at").agg(F.min("text").alias("text")), "toxicity-sample")
    before = F.sum("size").over(Window.orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # over `rows` rows at most
    sizes = found.select("doc_id", "at", F.length("text").alias("size"))
    kept = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < characters).select("doc_id")
    return found.join(F.broadcast(kept), "doc_id", "left_semi").select("doc_id", "text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS) -> Model:
    """Learns from documents(doc_id, text) and labels(doc_id, toxic); which rows those are is the caller's choice."""
    spark = docs.sparkSession
    prepare(spark)
    rows = sampled(docs, labels, sample, characters).repartition(3 * max(2, spark.sparkContext.defaultParallelism))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                (toxic if y == 1 else clean).update(features(text))
        # what is only in clean texts explains nothing
        names = list(toxic) + [f for f in clean if f not in toxic]
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": part, "toxic": pa.array([toxic[f] for f in part], pa.int64()), "clean": pa.array([clean[f] for f in part], pa.int64())})

    counted = rows.mapInArrow(tidy(count), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.where((F.col("toxic") >= MIN_TEXTS) & (F.col("clean") <= 0.02 * F.col("toxic")))
    candidates = {r.feature: (r.toxic, r.clean) for r in counted.toLocalIterator()}  # of the sample, so bounded by its characters
    holds: dict[str, set[int]] = defaultdict(set)
    n = 0
    for r in rows.where("toxic = 1").select("text").toLocalIterator():
        for f in features(r.text.lower()):
            if f in candidates:
                holds[f].add(n)
        n += 1
    words, stems = dict.fromkeys(INSULTS, 1.5), {}
    # greedy cover, lazily: a feature's gain only falls; of equals whole words first, then longer stems
    order = lambda f, gain: (-gain, f[0] != "=", -len(f), f)
    heap = [order(f, len(x)) for f, x in holds.items()]
    heapq.heapify(heap)
    covered: set[int] = set()
    while heap:  # ends after n / MIN_TEXTS choices at most
        best = heapq.heappop(heap)[-1]
        gain = len(holds[best] - covered)
        if gain < MIN_TEXTS:
            continue
        if heap and order(best, gain) > heap[0]:
            heapq.heappush(heap, order(best, gain))
            continue
        covered |= holds[best]
        toxic, clean = candidates[best]
        weight = min(6.0, math.log((toxic + 0.5) / (clean + 0.5)) + 2.0)
        (words if best[0] == "=" else stems)[best.lstrip("=")] = weight
    model = Model(words, stems)
    shared = spark.sparkContext.broadcast(model)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.match(t)[2] for t in _texts(batch.column(1))]
            only = [next(iter(m)) if len(m) == 1 else "" for m in found]
            yield pa.RecordBatch.from_arrays([pa.array(only), batch.column(2)], ["mark", "toxic"])

    seen = {(r.mark, r.toxic): r.n for r in rows.mapInArrow(tidy(marks), "mark string, toxic int").groupBy("mark", "toxic").agg(F.count("*").alias("n")).collect()}
    factor = lambda mark, prior: (seen.get((mark, 1), 0) + 4 * prior) / (seen.get((mark, 1), 0) + seen.get((mark, 0), 0) + 4)
    return Model(words, stems, factor("negated", 0.3), factor("reported", 0.4))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, clauses): how many clauses matched, and the score of the whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # at most SAMPLE / MIN_TEXTS words and stems, beside the fixed ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.match(t)[:2] for t in _texts(batch.column(1))]
            weights = np.array([w for w, _ in found], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(BIAS - np.minimum(weights, 50)))), pa.array([n for _, n in found], pa.int64())], ["doc_id", "score", "clauses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double, clauses long")


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [shared.value.match(t)[0] for t in _texts(batch.column(at))]
            yield batch.filter(pa.array([1 / (1 + math.exp(BIAS - min(w, 50))) < threshold for w in weights], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out():
    return mod_crc("doc_id", 5) == 0


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Operator 5's result: learned from labels that aren't held out, scored for all documents."""
    model = learn(docs, labels.where(~held_out()))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "clauses")
