"""Operator 2: scoring texts with a log-bilinear language model.

The WORDS commonest words have vectors of their own, as context and as outcome.
All other words fall, by their last three bytes, into CLUSTERS classes, made by
clustering those endings by the common words beside which they occur. The model
is p(word | before) = p(class | before) * p(word | class, before): classes are
the end of a text, groups of common words (of about equal frequency, so that the
commonest are alone) and the clusters. Vectors of the CONTEXT symbols before,
weighted by position, add up to a prediction; its products with the classes'
vectors, plus biases, are the scores that a softmax over all classes normalises,
and its products with the vectors of a group's words are normalised over that
group. A word of a cluster has its count + 1 over those of the cluster, with a
place for words never seen.

Both are trained in numpy by noise-contrastive estimation: every task starts from
the same parameters, trains on its own texts, and the results are averaged by
their tokens, ROUNDS times; in each round every ROUNDS-th token is a training
case, other ones each time, so that each token of the training texts is one once,
with all words before it as context.

Counts, classes and training use all training texts. A text is cut into words
twice, to count them and to write it as a sequence of symbols (two bytes a token,
to the shared folder); training and scoring read the sequences. Counts of the
HEAD commonest words are broadcast (12 bytes each, 16 where a count needs 64
bits); words beyond are looked up by a shuffle. Words are told apart by 64-bit
hashes.

Null and empty texts are one end token. Repeated rows are scored each; a very long
text is one row, scored in pieces. Other columns than id and text are not read,
but for what the training condition names. Without training texts every token has
count 0, and each class is as likely; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerlake.llm.common import U64, Words, keyed, materialise, mod_crc, prepare, tidy, words_of

WORDS, GROUPS, MOST_OF_GROUP, CLUSTERS, ENDINGS, BESIDE = 2047, 63, 128, 64, 2048, 63
DIMENSIONS, CONTEXT, NOISE, ROUNDS, RATE, BATCH, MIN_STEPS = 16, 6, 32, 2, 0.15, 1024, 480
HEAD = 3_000_000
#: Tokens of a task that are trained on together; tokens scored at once; parameters of a row that tasks send.
BUFFER, PIECE, CHUNK = 2_000_000, 16_384, 4096
END = 0


def endings(words: Words) -> np.ndarray:
    """Bucket of each word's last three bytes."""
    code = np.zeros(len(words.h), U64)
    for back in (1, 2, 3):
        at = words.end - back
        byte = words.buf[np.maximum(at, 0)].astype(U64)
        byte[(byte >= 65) & (byte <= 90)] += U64(32)
        code = code * U64(256) + np.where(at >= words.start, byte, U64(0))
    return (keyed(code, 21) % U64(ENDINGS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Symbols of words: 1 + rank of a common word, else WORDS + 1 + its ending's bucket; 0 is the end."""

    hashes: np.ndarray  # sorted
    rank: np.ndarray

    def symbols(self, words: Words) -> np.ndarray:
        out = 1 + WORDS + endings(words)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words.h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == words.h, 1 + self.rank[at], out)
        return out


class Classes:
    """What symbols are as context and as outcome.

    context: symbol -> row of the context vectors; kind: symbol -> class; group
    g of words, class 1 + g, holds the words of ranks first[g] to first[g + 1].
    """

    def __init__(self, counts: np.ndarray, cluster: np.ndarray):
        self.first = [0]
        counts = np.asarray(counts, float)
        left = counts.sum()
        for g in range(GROUPS):
            if self.first[-1] >= len(counts):
                break
            a, rest, mass, b = self.first[-1], GROUPS - g - 1, 0.0, self.first[-1]
            while b < len(counts) and b - a < MOST_OF_GROUP and (b == a or mass + counts[b] / 2 < left / (rest + 1) or len(counts) - b > rest * MOST_OF_GROUP):
                mass += counts[b]
                b += 1
            self.first.append(b)
            left -= mass
        self.words = self.first[-1]
        group = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        symbols = 1 + WORDS + ENDINGS
        self.kind, self.context = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
        self.kind[1 : 1 + self.words] = 1 + group
        self.kind[1 + WORDS :] = 1 + GROUPS + cluster
        self.context[: 1 + WORDS] = np.arange(1 + WORDS)
        self.context[1 + WORDS :] = 1 + WORDS + cluster
        alone = np.ones(self.number, bool)  # classes of one symbol
        alone[1 : len(self.first)] = np.diff(self.first) < 2
        self.shares = (np.arange(symbols) <= WORDS) & ~alone[self.kind]  # symbols that share their class with other common words

    @property
    def number(self) -> int:
        return 1 + GROUPS + CLUSTERS


def before(context: np.ndarray, at: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Rows of context vectors before the tokens at `where`, nearest first; before a text's begin stands END."""
    begin = np.repeat(at[:-1], np.diff(at))[where]
    out = np.full((CONTEXT, len(where)), END, np.int16)
    for i in range(CONTEXT):
        place = where - 1 - i
        ok = place >= begin
        out[i, ok] = context[place[ok]]
    return out


def scattered(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each index below n."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        own = index[order]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[begin]] = np.add.reduceat(rows[order], begin, axis=0)
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    np.clip(x, -60, 60, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """r: context vectors, c: weights of positions; q, b: vectors and biases of classes; w, d: of common words."""

    TABLES = ("r", "c", "q", "b", "w", "d")

    def __init__(self, classes: Classes, share: np.ndarray, word_share: np.ndarray, seed: int = 2):
        rng = np.random.default_rng(seed)
        vectors = lambda n: (rng.standard_normal((n, DIMENSIONS)) * 0.1).astype(np.float32)
        self.classes, self.share, self.word_share = classes, share, word_share
        self.r, self.q, self.w = vectors(1 + WORDS + CLUSTERS), vectors(classes.number), vectors(WORDS)
        self.c = np.repeat((1.0 / (1 + np.arange(CONTEXT)))[:, None], DIMENSIONS, 1).astype(np.float32)
        self.b, self.d = np.log(share).astype(np.float32), np.log(word_share).astype(np.float32)
        self.noise = [np.cumsum(x) / x.sum() for x in (share, word_share)]

    def predicted(self, ahead: np.ndarray) -> np.ndarray:
        """Predictions, a row for each token."""
        out = np.zeros((ahead.shape[1], DIMENSIONS), np.float32)
        for i in range(CONTEXT):
            out += np.take(self.r * self.c[i], ahead[i], axis=0)
        return out

    def log10(self, ahead: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities: of words for common ones, of the end, and of the clusters of all others."""
        hat, kind = self.predicted(ahead), self.classes.kind[symbols]
        out = self._normalised(hat, self.q, self.b, kind)
        order = np.argsort(kind.astype(np.int16), kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(GROUPS + 2))
        for g, (lo, hi) in enumerate(zip(self.classes.first[:-1], self.classes.first[1:], strict=True)):
            own = order[cuts[g + 1] : cuts[g + 2]]
            if hi - lo > 1 and len(own):
                out[own] += self._normalised(hat[own], self.w[lo:hi], self.d[lo:hi], symbols[own] - 1 - lo)
        return out

    @staticmethod
    def _normalised(hat: np.ndarray, vectors: np.ndarray, bias: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        scores = hat @ vectors.T
        scores += bias
        own = scores[np.arange(len(outcome)), outcome].astype(float)
        if scores.max(initial=0) > 80:
            top = scores.max(1)
            return (own - top - np.log(np.exp(scores - top[:, None]).sum(1))) / np.log(10)
        np.exp(scores, out=scores)
        return (own - np.log(scores @ np.ones(scores.shape[1], np.float32))) / np.log(10)

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.TABLES])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for name in self.TABLES:
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    @staticmethod
    def _contrast(hat, vectors, bias, floor, outcome, noise):
        """Gradients (of hat, vectors, bias) of outcomes against noise that a step's tokens share."""
        own, false = vectors[outcome], vectors[noise]
        shift = bias - floor
        up = 1 - logistic((hat * own).sum(1) + shift[outcome])
        bad = logistic(hat @ false.T + shift[noise])
        to_hat = own * up[:, None] - bad @ false
        to_vectors = scattered(outcome, hat * up[:, None], len(vectors))
        np.subtract.at(to_vectors, noise, bad.T @ hat)
        to_bias = np.bincount(outcome, up, len(bias)) - np.bincount(noise, bad.sum(0), len(bias))
        return to_hat, to_vectors, to_bias.astype(np.float32)

    def train(self, ahead: np.ndarray, symbols: np.ndarray, rng: np.random.Generator, squares: dict[str, np.ndarray]) -> None:
        """One pass of noise-contrastive steps, with noise shared by a step's tokens; Adagrad."""
        order = rng.permutation(len(symbols))
        floors = [np.log(NOISE * x).astype(np.float32) for x in (self.share, self.word_share)]
        for a in range(0, len(order), BATCH):
            picked = order[a : a + BATCH]
            ahead_, out = np.take(ahead, picked, axis=1), symbols[picked]
            rows = [np.take(self.r, own, axis=0) for own in ahead_]
            hat = rows[0] * self.c[0]
            for i in range(1, CONTEXT):
                hat += rows[i] * self.c[i]
            noise = [np.searchsorted(x, rng.random(NOISE)).astype(np.int64) for x in self.noise]
            to_hat, gq, gb = self._contrast(hat, self.q, self.b, floors[0], self.classes.kind[out], noise[0])
            gw, gd = np.zeros_like(self.w), np.zeros_like(self.d)
            common = np.flatnonzero(self.classes.shares[out])
            if len(common):
                more, gw, gd = self._contrast(hat[common], self.w, self.d, floors[1], (out[common] - 1).astype(np.int16), noise[1])
                to_hat[common] += more
            gc = np.stack([(to_hat * rows[i]).sum(0) for i in range(CONTEXT)])
            gr = scattered(ahead_.ravel(), np.concatenate([to_hat * self.c[i] for i in range(CONTEXT)]), len(self.r))
            for name, g in (("r", gr), ("c", gc), ("q", gq), ("b", gb), ("w", gw), ("d", gd)):
                g *= 50 / len(picked)
                squares[name] += g * g
                setattr(self, name, getattr(self, name) + RATE * g / np.sqrt(squares[name]))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, ending, c): every word's hash, ending bucket and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, e, c = (np.concatenate(x) for x in zip(*held, strict=True))
            h, first, back = np.unique(h, return_index=True, return_inverse=True)
            return h, e[first], np.bincount(back, c).astype(np.int64)

        def out() -> pa.RecordBatch:
            h, e, c = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(e, pa.int32()), pa.array(c)], ["h", "ending", "c"])

        for batch in batches:
            for _, _, words in words_of(batch.column(1)):
                h, first, c = np.unique(words.h, return_index=True, return_counts=True)
                held.append((h, endings(words)[first], c))
                rows += len(h)
                if rows > 2_000_000:
                    if rows > 1.5 * len((whole := merged())[0]):
                        held, rows = [whole], len(whole[0])
                    if rows > 1_500_000:
                        yield out()
                        held, rows = [], 0
        if rows:
            yield out()

    return docs.mapInArrow(tidy(run), "h long, ending int, c long").groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def encoded(docs: DataFrame, vocabulary: Vocabulary, known: pa.Table, texts: int, alone: float, tails: bool) -> DataFrame:
    """A row for each document: its sequence of symbols, what its counts come to, and with `tails` the words not in `known`.

    base lacks the words in `tail`; rare is the sum of log10(count + 1) of the words that aren't common.
    """
    spark = docs.sparkSession
    h, c = known["h"].to_numpy().view(U64), known["c"].to_numpy()
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((vocabulary, h[order], c[order].astype(np.int32 if c.max(initial=0) < 2**31 else np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, h, c = shared.value
        serial, row_id = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for lo, hi, words in words_of(batch.column(1)):
                rows = hi - lo
                found, count = np.zeros(len(words.h), bool), np.zeros(len(words.h))
                if len(h):
                    place = np.minimum(np.searchsorted(h, words.h), len(h) - 1)
                    found = h[place] == words.h
                    count = np.where(found, c[place], 0).astype(float)
                plain, symbols = np.log10(count + 1), vocabulary.symbols(words)
                add = lambda x, r=words.row, m=rows: np.bincount(r, x, m).astype(float)
                at = words.at + np.arange(len(words.at))
                sequence = np.insert(symbols, words.at[1:], END).astype("<i2")
                n_tokens = np.diff(at)
                left = np.flatnonzero(~found) if tails else np.empty(0, int)
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(words.row[left], np.arange(rows + 1)), pa.int32()), pa.array(words.h[left].astype(np.int64)))
                column = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((at * 2).astype(np.int32).tobytes()), pa.py_buffer(sequence.tobytes())])
                base, n_known = add(plain) + np.log10(texts + 1) - n_tokens * alone, add(found.astype(float)) + (texts > 0)
                columns = [pa.array(serial + row_id + np.arange(rows)), batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows), pa.array(n_tokens), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(add(np.where(symbols > WORDS, plain, 0.0))), column, tail]
                row_id += rows
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "learned", "n_tokens", "n_known", "base", "rare", "sequence", "tail"])

    return docs.select("doc_id", "text", "learned").mapInArrow(tidy(run), "row long, doc_id long, learned boolean, n_tokens long, n_known long, base double, rare double, sequence binary, tail array<long>")


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of a column of sequences."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    return np.frombuffer(data, "<i2")[at[0] : at[-1]].astype(np.int64), at - at[0]


def cluster_endings(learned: DataFrame) -> np.ndarray:
    """Cluster of each ending: k-means over the BESIDE commonest words before and after its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENDINGS * BESIDE, np.int64)
        for batch in batches:
            symbols, _ = sequences(batch.column(0))  # texts end in END, which is neither
            for word, beside in ((symbols[1:], symbols[:-1]), (symbols[:-1], symbols[1:])):
                ok = (word > WORDS) & (beside > END) & (beside <= BESIDE)
                total += np.bincount((word[ok] - 1 - WORDS) * BESIDE + beside[ok] - 1, minlength=len(total))
        some = np.flatnonzero(total)
        for a in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 50_000]), pa.array(total[some[a : a + 50_000]])], ["cell", "n"])

    cells = learned.select("sequence").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most ENDINGS * BESIDE
    table = np.zeros(ENDINGS * BESIDE)
    table[cells["cell"].to_numpy().astype(np.int64)] = cells["n"].to_numpy()
    table = table.reshape(ENDINGS, BESIDE)
    weight = table.sum(1)
    unit = np.sqrt(table / np.maximum(weight, 1)[:, None])
    rng = np.random.default_rng(4)
    chance = weight + 1e-9
    centre = unit[rng.choice(ENDINGS, CLUSTERS, replace=False, p=chance / chance.sum())]
    for _ in range(25):
        nearest = (unit @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        mass = np.bincount(nearest, chance, CLUSTERS)
        for d in range(unit.shape[1]):
            centre[:, d] = np.where(mass > 0, np.bincount(nearest, chance * unit[:, d], CLUSTERS) / np.maximum(mass, 1e-12), centre[:, d])
    return nearest


def averaged(sent: DataFrame, size: int) -> np.ndarray | None:
    """Parameters, weighted by tokens, from rows (chunk, used, values) of the tasks; sums run over a stream of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, used, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(chunk, [0.0, 0.0])
                own[0] += used
                own[1] = own[1] + used * np.frombuffer(values, "<f4").astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(v / w).astype("<f4").tobytes() for w, v in sums.values()], pa.binary())], ["chunk", "mean"])

    found = sent.repartition("chunk").mapInArrow(tidy(run), "chunk int, mean binary").toArrow()  # the parameters once
    if not found.num_rows:
        return None
    parts = dict(zip(found["chunk"].to_pylist(), found["mean"].to_pylist(), strict=True))
    return np.frombuffer(b"".join(parts[i] for i in range(-(-size // CHUNK))), "<f4")


def train(learned: DataFrame, classes: Classes, share: np.ndarray, word_share: np.ndarray) -> Model:
    spark = learned.sparkSession
    model = Model(classes, share, word_share)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((classes, share, word_share, model.parameters(), turn))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            classes, share, word_share, flat, turn = shared.value
            own = Model(classes, share, word_share)
            own.put(flat)
            rng = np.random.default_rng(1000 * turn + TaskContext.get().partitionId())
            squares = {x: np.full(getattr(own, x).shape, 1e-1 if x in "wd" else 1e-2, np.float32) for x in Model.TABLES}
            held, tokens, used = [], 0, 0

            def learn() -> None:
                ahead = np.concatenate([b for b, _ in held], axis=1)
                symbols = np.concatenate([o for _, o in held])
                steps = -(-len(symbols) // BATCH)
                for _ in range(max(1, min(20, -(-MIN_STEPS // steps)))):
                    own.train(ahead, symbols, rng, squares)

            for batch in batches:
                symbols, at = sequences(batch.column(1))
                # a text begins in either round, by its id, so that equal or equally long ones don't train the same places together
                ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64).astype(U64)
                begin = np.repeat((keyed(ids, 31) % U64(ROUNDS)).astype(np.int64), np.diff(at))
                picked = np.flatnonzero((np.arange(len(symbols)) - np.repeat(at[:-1], np.diff(at)) + begin) % ROUNDS == turn)
                context = classes.context[symbols]
                for a in range(0, len(picked), BUFFER):
                    where = picked[a : a + BUFFER]
                    held.append((before(context, at, where), symbols[where].astype(np.int16)))
                    tokens, used = tokens + len(where), used + len(where)
                    if tokens >= BUFFER:
                        learn()
                        held, tokens = [], 0
            if tokens:
                learn()
            if used:
                values = own.parameters().astype("<f4")
                parts = [values[a : a + CHUNK].tobytes() for a in range(0, len(values), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(used)] * len(parts)), pa.array(parts, pa.binary())], ["chunk", "used", "values"])

        sent = learned.select("doc_id", "sequence").mapInArrow(tidy(run), "chunk int, used double, values binary")
        if (found := averaged(sent, len(model.parameters()))) is not None:
            model.put(found)
    return model


def score(df: DataFrame, training, *, id_column: str = "doc_id", text_column: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); training: the condition for texts that are learned from."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("learned", F.coalesce(training, F.lit(False)))
    learned = docs.where("learned")
    counts = materialise(count_words(learned), "word-counts")
    sums = counts.agg(F.count("*"), F.sum("c")).first()
    texts = learned.count()
    n, v = int(sums[1] or 0) + texts, sums[0] + (texts > 0)
    best = counts.orderBy(F.desc("c"), "h").limit(WORDS).toPandas()
    common = best["h"].to_numpy().astype(np.int64).view(U64)
    order = np.argsort(common)
    vocabulary = Vocabulary(common[order], order)

    if v - 1 <= head:
        known, tail = counts, None
    else:  # the commonest words, as far as a whole count fits
        steps = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))  # a row for each different count; below, as many as fit
        fits = steps.limit(head).toPandas()
        fits = fits[fits["n"].cumsum() <= head]["c"]
        least = int(fits.min()) if len(fits) else 1 << 62
        # the common words are always known: they are certain in their classes, and get no gain from the tail
        direct = (F.col("c") >= least) | F.col("h").isin(best["h"].tolist())
        known, tail = counts.where(direct), counts.where(~direct)
    coded = materialise(encoded(docs, vocabulary, known.select("h", "c").toArrow(), texts, float(np.log10(n + (v + 1))), tail is not None), "sequences")
    learned = coded.where("learned")

    # the classes' counts: the end, the groups of common words, then each cluster
    cluster = cluster_endings(learned)
    classes = Classes(best["c"].to_numpy(), cluster)
    size, slots = np.zeros(classes.number), np.ones(classes.number)
    size[END] = texts
    np.add.at(size, classes.kind[1 : 1 + len(best)], best["c"].to_numpy().astype(float))
    rest = counts.join(F.broadcast(spark.createDataFrame(best[["h"]], "h long")), "h", "left_anti")
    for r in rest.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # ENDINGS rows at most
        size[1 + GROUPS + cluster[r.ending]] += r.c
        slots[1 + GROUPS + cluster[r.ending]] += r.n
    inside = np.where(np.arange(classes.number) > GROUPS, np.log10(size + slots), 0.0)
    share = (size + 1) / (size + 1).sum()
    words = np.ones(WORDS)
    words[: len(best)] += best["c"].to_numpy()
    model = train(learned, classes, share, words / words.sum())
    shared = spark.sparkContext.broadcast((classes, share, words / words.sum(), model.parameters(), inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, share, word_share, flat, inside = shared.value
        model = Model(classes, share, word_share)
        model.put(flat)
        for batch in batches:
            symbols, at = sequences(batch.column(5))
            context, logs = classes.context[symbols], np.empty(len(symbols))
            for a in range(0, len(symbols), PIECE):
                where = np.arange(a, min(a + PIECE, len(symbols)))
                logs[where] = model.log10(before(context, at, where), symbols[where])
            # common words and the end are certain by now; unseen words have count 0 in their cluster
            logs -= inside[classes.kind[symbols]]
            scores = (np.add.reduceat(logs, at[:-1]) if len(at) > 1 else np.empty(0)) + np.asarray(batch.column(4))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 2, 3, 6)] + [pa.array(scores)], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = coded.select("row", "doc_id", "n_tokens", "n_known", "rare", "sequence", "base").mapInArrow(tidy(run), "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    if tail is not None:
        missing = coded.select("row", F.explode("tail").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
        seen = missing.join(tail.select("h", "c"), "h").groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain"))
        scored = scored.join(seen, "row", "left")
        gain = F.coalesce("gain", F.lit(0.0))
        scored = scored.withColumns({"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base_score": F.col("base_score") + gain, "score": F.col("score") + gain})
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def held_out():
    return mod_crc("doc_id", 7) == 2
