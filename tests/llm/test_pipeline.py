"""The corpus pipeline, stage by stage and as a whole, against a brute-force version."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from showerlake.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def _texts() -> dict[int, str | None]:
    rng = np.random.default_rng(4)
    words = [f"term{i}" for i in range(400)]
    texts: dict[int, str | None] = {}
    for i in range(60):
        own = " ".join(rng.choice(words, 40))
        texts[i] = f"{own} {'you gromble thing' if i % 4 == 0 else 'and so on'}."
    texts |= {100: texts[1], 101: texts[1], 102: texts[2] + " more", 103: " ".join(texts[3].split()[:20] + ["other"] * 20)}
    texts |= {200: None, 201: "", 202: " \n\t", 203: "12 34 !?", 204: "12 34 !?", 300: "long " * 5000}
    return texts


def _is_toxic(text: str | None) -> bool:
    return "gromble" in (text or "")


def _shingles(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def _one_of_each(texts: dict[int, str]) -> set[int]:
    sets, seen, kept = {i: _shingles(t) for i, t in texts.items()}, set(), set()
    for first in sorted(sets):
        if first in seen:
            continue
        kept.add(first)
        front = [first]
        while front:
            i = front.pop()
            seen.add(i)
            front += [j for j in sets if j not in seen and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return kept


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, at = _texts(), str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", "web", -1, "clash") for i, t in texts.items()], SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(_is_toxic(t))) for i, t in texts.items() if i < 60] + [(9999, 0, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_equals_brute_force(spark, folder):
    texts = _texts()
    clean = {i: t for i, t in texts.items() if not _is_toxic(t)}
    spoken = {i: t for i, t in clean.items() if any(c.isalpha() for c in t or "")}
    last = _one_of_each(spoken)
    assert 100 not in last and 101 not in last and 102 not in last and {1, 2, 3, 103, 300} <= last

    docs, expected = spark.read.parquet(f"{folder}/documents.parquet"), [set(clean), set(spoken), last]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        kept = stage(spark, docs, folder)
        assert kept.schema.names == docs.schema.names, name
        rows = kept.collect()
        assert sorted(r.doc_id for r in rows) == sorted(want), name
        assert all(r.text == texts[r.doc_id] and r.score == "clash" for r in rows), name
        docs = docs.where(docs.doc_id.isin(sorted(want)))

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces: dict[int, list] = {}
    sequences: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == last
    for i, own in pieces.items():
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        upto = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (upto, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[upto : upto + r.length].tobytes())
            upto += r.length
        assert upto == len(ids)
    for parts in sequences.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= 2048 and upto & (upto - 1) == 0


def test_pipeline_of_nothing(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
