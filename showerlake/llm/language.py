"""Operator 8: language identification by cross-parsing.

For each language the running text of a bounded sample of labelled documents is
put into a suffix automaton. A text is parsed against it into the fewest phrases
that each occur in that language's sample: every phrase is the longest match from
where the last one ended, across words, and a letter that the sample lacks is a
phrase of its own. Phrases times log2 of the sample's length over letters is the
cross-parsing entropy in bits a letter; the language needing the fewest phrases
wins (ties: the smaller name), samples being of about the same length.

Texts are lower-cased, and what isn't a letter becomes one space. A text is
parsed in chunks of about CHUNK characters that begin before a word (inside one
only if it is longer than four chunks), so that all chunks of a batch advance
together, a character at a time; a chunk's end ends a phrase, for all languages
alike, and a very long text is many chunks.

Null texts and texts without a letter get `und` and score 0; unlabelled rows and
languages without letters are not learned from; with nothing learned every text
is `und`. Repeated rows are predicted each, an empty table gives no rows, and
other columns than id, text and label are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showerlake.llm.common import mod_crc, prepare, row_slices, text_buffers, tidy

#: Bounds of what is learned from, for each language: documents and characters. Whole documents are taken until they
#: have SAMPLE_CHARACTERS, and only ones that are shorter than that, unless a language has no such one.
SAMPLE_DOCS, SAMPLE_CHARACTERS = 400, 60_000
#: Low bits of a 32-bit hash that are dropped for the counts by which a language's sample is found.
BUCKET_BITS = 22
#: Bytes of text that are parsed at once, and characters of a chunk.
SLICE, CHUNK = 2_000_000, 128
#: Texts of LEAST_LETTERS and more that need over WORST phrases a letter are in none of the languages.
WORST, LEAST_LETTERS = 0.5, 60
_GAP = re.compile(r"[\W\d_]+")


def running(text: str) -> str:
    """Lower-cased words between single spaces; empty without letters."""
    words = _GAP.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


class Automaton:
    """The suffix automaton of a text: all its substrings, as an open-addressed table of transitions."""

    def __init__(self, text: str, code: dict[str, int]):
        moves: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in (code[x] for x in text):
            new = len(moves)
            moves.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:  # the longer contexts of q part from the shorter ones
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
            last = new
        self.letters, self.width = len(text), len(code) + 1
        key = np.array([s * self.width + c for s, m in enumerate(moves) for c in m], np.int64)
        to = np.array([t for m in moves for t in m.values()], np.int32)
        bits = max(4, int(2 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = left[self.key[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.key[at], self.to[at] = key[free[first]], to[free[first]]
            left = np.setdiff1d(left, free[first])
            slot[left] = (slot[left] + 1) & self.mask
        self.begin = self.go(np.zeros(self.width, np.int64), np.arange(self.width))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def go(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """States after a character; -1 where none of the text's substrings goes on so."""
        key = state * self.width + c
        slot = self._slot(key)
        there = self.key[slot]
        out = np.where(there == key, self.to[slot], -1)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.key[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Automata:
    """Suffix automata of several languages' running texts, with one alphabet."""

    def __init__(self, texts: dict[str, str]):
        texts = {k: running(v) for k, v in texts.items()}
        self.names = sorted(k for k, v in texts.items() if v)
        letters = sorted({c for v in texts.values() for c in v})
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        self.made = [Automaton(texts[k], self.code) for k in self.names]

    def phrases(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases that pieces of a text (code points) need in each language: an array of pieces x languages."""
        out = np.zeros((len(start), len(self.names)), np.int64)
        if not len(start) or not self.names:
            return out
        known = np.zeros(0x110000, np.int32)
        known[[ord(c) for c in self.code]] = list(self.code.values())
        codes = known[flat]
        order = np.argsort(-length, kind="stable")
        start, longest_first = start[order], length[order]
        for k, made in enumerate(self.made):
            state, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            for i in range(int(longest_first[0])):
                n = int(np.searchsorted(-longest_first, -i, side="left"))  # pieces longer than i
                c = codes[start[:n] + i]
                to = made.go(state[:n], c)
                cut = to < 0
                count[:n] += cut & (state[:n] > 0)
                to = np.where(cut, made.begin[c], to)
                count[:n] += to < 0  # a character that the sample lacks
                state[:n] = np.maximum(to, 0)
            out[order, k] = count + (state > 0)
        return out


def learn(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", docs: int = SAMPLE_DOCS, characters: int = SAMPLE_CHARACTERS) -> Automata:
    """Learns from at most `docs` texts of each language, of the smallest crc32 of their id, up to `characters` characters."""
    rows = df.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull())
    rows = rows.select(F.col(lang_column).cast("string").alias("lang"), F.col(id_column).cast("long").alias("doc_id"), F.crc32(F.concat(F.lit("language "), F.col(id_column).cast("string")).cast("binary")).alias("at"), F.col(text_column).alias("text"))
    # the ids first, without their texts: those of each language up to the bucket of hashes that fills its sample
    ids = rows.select("lang", "doc_id", "at", F.shiftrightunsigned("at", BUCKET_BITS).alias("bucket"))
    counts = ids.groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket")) - F.col("n")
    cuts = counts.withColumn("before", before).where(F.col("before") < docs).groupBy("lang").agg(F.max("bucket").alias("last"))
    first = ids.join(F.broadcast(cuts), "lang").where(F.col("bucket") <= F.col("last"))
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))).where(F.col("n") <= docs).select("lang", "doc_id").distinct()
    # whole texts until there are enough characters; longer ones only where a language has no others, then its shortest
    texts = rows.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").withColumn("size", F.length("text"))
    long = (F.col("size") > characters).cast("int")
    order = Window.partitionBy("lang").orderBy(long, F.col("size") * long, "at", "doc_id", F.xxhash64("text"))
    texts = texts.withColumns({"place": F.row_number().over(order), "before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    texts = texts.where((F.col("place") == 1) | (F.col("before") < characters) & (long == 0))
    found: dict[str, list[str]] = {}
    for r in texts.select("lang", "place", "text").orderBy("lang", "place").toLocalIterator():
        found.setdefault(r.lang, []).append(r.text)
    return Automata({lang: " ".join(own) for lang, own in found.items()})


def pieces(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of the chunks of rows of spaced words, rows[at[i]:at[i + 1]] of code points."""
    space = np.flatnonzero(flat == 32)
    row = np.searchsorted(at, space, side="right") - 1
    inner = space < at[row + 1] - 1  # a row's last space begins nothing
    space, row = space[inner], row[inner]
    part = (space - at[row]) // CHUNK
    new = np.ones(len(space), bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    start, row = space[new], row[new]
    end = at[row + 1].copy()
    same = np.flatnonzero(row[1:] == row[:-1])
    end[same] = start[same + 1] + 1  # with the space before the next chunk's word
    most = 4 * CHUNK
    parts = -(-(end - start) // most)
    which = np.repeat(np.arange(len(start)), parts)
    start = start[which] + most * (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts))
    return start, np.minimum(end[which] - start, most), row[which]


def judge(texts: pa.Array, made: Automata):
    """(first row, end row, languages, scores, phrases, letters) for slices of a text column."""
    names = np.array([*made.names, "und"], dtype=object)
    texts = texts.fill_null("") if texts.null_count else texts
    _, bytes_at = text_buffers(texts)
    for lo, hi in row_slices(bytes_at, SLICE):
        n = hi - lo
        words = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.slice(lo, n).cast(pa.large_string())), r"[^\p{L}]+", " "))
        words = pc.if_else(pc.equal(words, ""), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))
        raw, where = text_buffers(words)
        flat = np.frombuffer(raw[where[0] : where[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        solid = np.concatenate([[0], np.cumsum(flat != 32)])
        letters = solid[at[1:]] - solid[at[:-1]]
        if not made.names:
            yield lo, hi, names[np.zeros(n, int)], np.zeros(n), letters, letters
            continue
        start, length, row = pieces(flat, at)
        phrases = made.phrases(flat, start, length)
        total = np.stack([np.bincount(row, phrases[:, k], minlength=n) for k in range(len(made.names))], 1)
        least = total.min(1)
        second = np.partition(total, 1, axis=1)[:, 1] if len(made.names) > 1 else letters
        some = letters > 0
        score = np.where(some, np.clip(1 - least / np.maximum(second, 1e-9), 0, 1), 0.0)
        yield lo, hi, names[np.where(some, total.argmin(1), len(made.names))], score, least, letters


def predict(df: DataFrame, model: Automata, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, phrases, letters, bits): score is 1 - phrases / phrases of the second language."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's characters for each language
    size = dict(zip(model.names, (np.log2(max(2, m.letters)) for m in model.made), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, pred, score, least, letters in judge(batch.column(1), shared.value):
                bits = least * np.array([size.get(p, 0.0) for p in pred]) / np.maximum(letters, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score), pa.array(least.astype(np.int64)), pa.array(letters.astype(np.int64)), pa.array(bits)], ["doc_id", "lang_pred", "score", "phrases", "letters", "bits"])

    schema = "doc_id long, lang_pred string, score double, phrases long, letters long, bits double"
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def keep(df: DataFrame, model: Automata, *, languages: tuple[str, ...] | None = None, worst: float = WORST) -> DataFrame:
    """The rows of df, with all their columns, whose predicted language is one of `languages` (of the learned ones).

    Rows go that are `und`, or that no language fits: of LEAST_LETTERS letters or
    more, and with more than `worst` phrases a letter in the best one. Where
    nothing was learned nothing can be judged, and all rows stay.
    """
    if not model.names:
        return df
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index("text")
    wanted = set(model.names if languages is None else languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, pred, _, least, letters in judge(batch.column(at), shared.value):
                fits = (letters < LEAST_LETTERS) | (least <= worst * letters)
                yield batch.slice(lo, hi - lo).filter(pa.array(np.array([p in wanted for p in pred], bool) & fits))

    return df.mapInArrow(tidy(run), df.schema)


def identify(df: DataFrame) -> DataFrame:
    """Operator 8's result for documents: learned where crc32(doc_id) mod 3 is not 1, predicted for all."""
    model = learn(df.where(mod_crc("doc_id", 3) != 1))
    found = predict(df, model)
    return found.select("doc_id", (mod_crc("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "phrases", "letters", "bits")
