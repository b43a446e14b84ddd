"""Byte-level BPE over Arrow batches with the tokenizers library.

A text is cut into chunks at which its pre-tokens provably begin (before a
single space, or around white space), and each different chunk is encoded once:
its pre-tokens go through the library's BPE model, the ids of the batch are
then gathered in numpy. What the short rules don't cover (letters beyond
U+024F, possible special tokens) goes through the library's whole pipeline.
Null and empty texts have no ids; memory is bounded by CACHE_CHUNKS chunks, one
Arrow batch and the longest text.
"""

from __future__ import annotations

import codecs
import gc
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Different chunks and pre-tokens that a worker remembers between batches, at about 200 bytes each.
CACHE_CHUNKS = 1_000_000
#: Text whose ids are held at once.
BATCH_BYTES = 4_000_000

_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = regex.compile(rf" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_RISKY = r"[ ][\t-\r \x{85}\p{Z}]|[\t-\r\x{85}\p{Z}][ ]"
_FAR = re.compile(r"[^\x00-\u024f]|<\|")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


BYTE_TO_CHAR = byte_characters()
CHAR_TO_BYTE = {c: b for b, c in enumerate(BYTE_TO_CHAR)}
_MAP = {b: c for b, c in enumerate(BYTE_TO_CHAR)}


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizers BPE that merges as a rank file says.

    Every way to split a token into two others is a merge at that token's rank,
    and a pre-token that is itself a token needs no merges.
    """
    import base64

    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    name = {t: "".join(BYTE_TO_CHAR[b] for b in t) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    made = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


class BatchEncoder:
    """Encodes Arrow string arrays; one per worker and vocabulary (see `encoder`)."""

    def __init__(self, tokenizer, pattern: str, spaced: bool, lower: bool):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.tokenizer.encode_special_tokens = True
        self.pattern, self.spaced, self.lower = regex.compile(pattern), spaced, lower
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.flat, self.begin = array("i"), array("q", [0])

    def _model(self, piece: str) -> list[int]:
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isascii() and bare.isalpha():
            named = piece if bare is piece else "Ġ" + bare
        else:
            named = piece.encode().decode("latin1").translate(_MAP)
        return [t.id for t in self.model.tokenize(named)]

    def _new(self, chunk: str) -> int:
        """Encodes a chunk that the cache doesn't have. Its pieces are cached like chunks."""
        if _FAR.search(chunk):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        else:
            text = chunk.lower() if self.lower else chunk
            pieces = [text] if text.isalpha() or text[:1] == " " and self.spaced and text[1:].isalpha() else self.pattern.findall(text)
            if len(pieces) == 1 and pieces[0] == chunk:
                ids = self._model(chunk)
            else:
                ids = []
                for piece in pieces:
                    k = self.chunks.get(piece)
                    k = self._new(piece) if k is None else k
                    ids += self.flat[self.begin[k] : self.begin[k + 1]]
        k = self.chunks[chunk] = len(self.chunks)
        self.flat.extend(ids)
        self.begin.append(len(self.flat))
        return k

    def _index(self, chunk: str) -> int:
        k = self.chunks.get(chunk)
        return self._new(chunk) if k is None else k

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): row i of texts has ids[offsets[i]:offsets[i + 1]]."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.clear()
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived token objects, none in a cycle
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        mask = pc.match_substring_regex(texts, _RISKY) if self.spaced else None
        risky = np.flatnonzero(mask.to_numpy(zero_copy_only=False)) if self.spaced else []
        if len(risky):
            whole = texts.take(pa.array(risky)).to_pylist()
            texts = pc.if_else(mask, "", texts)
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        at = split.offsets.to_numpy(zero_copy_only=False)
        codes = split.flatten().dictionary_encode()
        names = codes.dictionary.to_numpy(zero_copy_only=False)
        get, index, new = self.chunks.get, self._index, self._new
        if self.spaced:
            names = [" " + w for w in names]
        where = np.array([new(w) if (k := get(w)) is None else k for w in names], np.int64)
        codes = codes.indices.to_numpy(zero_copy_only=False)
        chunk = where[codes]
        if self.spaced:  # the first of a row has no space before it
            first = at[:-1]
            chunk[first] = [index(names[c][1:]) for c in codes[first]]
        if len(risky):
            parts, sizes, last = [], np.diff(at), 0
            for r, text in zip(risky, whole, strict=True):
                own = [index(c) for c in _CHUNKS.findall(text)]
                parts += [chunk[at[last] : at[r]], np.array(own, np.int64)]
                sizes[r], last = len(own), r + 1
            parts.append(chunk[at[last] :])
            chunk, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return self._gather(chunk, at)

    def _gather(self, chunk: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, flat = np.array(self.begin), np.array(self.flat)  # copies: an exported array can't grow
        sizes = (begin[1:] - begin[:-1])[chunk]
        out = np.concatenate([[0], np.cumsum(sizes)])
        return flat[np.repeat(begin[chunk] - out[:-1], sizes) + np.arange(out[-1])], out[at]


_encoders: dict[tuple, BatchEncoder] = {}


def encoder(path: str, pattern: str | None = None) -> BatchEncoder:
    """This worker's encoder for a vocabulary file, kept between tasks.

    `.tiktoken` rank files need their pattern. Of `.json` files, the two kinds
    with byte-level pre-tokens are known: GPT-2's pattern in the ByteLevel
    step, or a lower-casing normaliser with a Split of its own.
    """
    key = (path, pattern)
    if key not in _encoders:
        if path.endswith(".tiktoken"):
            _encoders[key] = BatchEncoder(tokenizer_from_ranks(path, pattern), pattern, True, False)
        else:
            from tokenizers import Tokenizer

            spec = json.load(open(path))["pre_tokenizer"]
            if spec["type"] == "Sequence":
                own, lower = spec["pretokenizers"][0]["pattern"]["Regex"], True
            else:
                # fixed value: the public pattern of this vocabulary
                own, lower = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", False
            _encoders[key] = BatchEncoder(Tokenizer.from_file(path), own, not lower, lower)
    return _encoders[key]


def encode_batches(made: BatchEncoder, texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) for row ranges of bounded size."""
    from showerlake.llm.common import row_slices, text_buffers

    _, at = text_buffers(texts)
    for lo, hi in row_slices(at, most):
        yield lo, hi, *made.encode(texts.slice(lo, hi - lo))


class ByteTable:
    """Decoding: the bytes of each id, and texts or offsets made from them."""

    def __init__(self, made: BatchEncoder):
        vocab = made.tokenizer.get_vocab(with_added_tokens=True)
        table: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, k in vocab.items():
            table[k] = bytes(CHAR_TO_BYTE[c] for c in token) if all(c in CHAR_TO_BYTE for c in token) else token.encode()
        self.table, self.size = table, np.array([len(t) for t in table], np.int64)
        self.flat, self.begin = np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of rows of ids."""
        sizes = self.size[ids]
        out = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.begin[ids] - out[:-1], sizes) + np.arange(out[-1])], out[at]

    def text_parts(self, ids: list[int]) -> list[str]:
        """Text that each id completes; a character split over ids comes with its last one."""
        step = codecs.getincrementaldecoder("utf-8")("replace")
        return [step.decode(self.table[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]

    def offsets(self, ids: list[int], text: str) -> list[tuple[int, int]]:
        """Character span of each id in text; ids inside a character share that character."""
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with a byte
        sizes = self.size[np.asarray(ids, np.int64)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        return [(int(begins[s] - 1), int(begins[e - 1])) if e > s else (0, 0) for s, e in zip(starts, ends, strict=True)]
