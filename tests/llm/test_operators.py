"""Each operator against a brute-force version, on rows that hold the awkward cases."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from showerlake.llm import codec, embedding_dedup, jaccard, language, licenses, lm, neighbours, packing, tokenfiles, toxicity
from showerlake.llm.common import components, shared_dir
from showerlake.llm.queries import pattern, vocabulary

BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", " \n\t ", "one", "one two three", BASE, BASE, BASE + " tail", BASE.replace("word30", "other"), "é中  日本\n\n x  <|endoftext|> a", "The MIT notice. Released under the MIT License. More words come here.", "long " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "src", -1, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_bpe_equals_tiktoken(docs, none):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    for r in codec.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern()).collect():
        text = TEXTS[r.doc_id] or ""
        ids = np.array(own.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    encoded = codec.encode(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), offsets=True)
    assert {r.id: r.text for r in codec.decode(encoded, vocabulary("byte_bpe_50k.tiktoken"), pattern()).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert codec.round_trip(none, vocabulary("byte_bpe_50k.tiktoken"), pattern()).count() == 0


def test_bpe_spans_and_split_characters(spark):
    text = "A caf\u00e9 \U0001f600 \u65e5\u672c end"
    row = codec.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary("byte_bpe_50k.tiktoken"), pattern(), offsets=True).first()
    table = codec.ByteTable(codec.encoder(vocabulary("byte_bpe_50k.tiktoken"), pattern()))
    parts = table.text_parts(row.ids)
    assert "".join(parts) == text and "" in parts  # ids inside a character complete nothing
    assert len(row.spans) == len(row.ids) and row.spans[0].start == 0 and row.spans[-1].end == len(text)
    for i, span in zip(row.ids, row.spans, strict=True):
        raw = table.table[i]
        assert raw in text[span.start : span.end].encode() and span.start < span.end


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    for encoding in ("delta", "dictionary"):
        folder = shared_dir(spark, "test")
        manifest = tokenfiles.write(docs, folder, vocabulary("byte_bpe_50k.json"), encoding=encoding)
        start = 0
        for r in tokenfiles.read_digests(manifest, folder).orderBy("doc_id").collect():
            ids = np.array([*plain.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        assert tokenfiles.read_ids(spark, folder, manifest, ("doc_id",)).count() == len(TEXTS)
    assert tokenfiles.read_digests(tokenfiles.write(none, shared_dir(spark, "test"), vocabulary("byte_bpe_50k.json")), folder).count() == 0


def test_token_files_read_in_part(spark):
    import pyarrow.parquet as pq

    rows = [(3 * i, f"text number {i} " * (1 + i % 7), "clash") for i in range(500)] + [(None, "no id", ""), (30, "again", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    folder = shared_dir(spark, "test")
    manifest = tokenfiles.write(df, folder, vocabulary("byte_bpe_50k.json"), partitions=5, row_group=32, group_tokens=300)
    about = manifest.orderBy("part").collect()
    assert len(about) >= 4 and sum(r.rows for r in about) == len(rows)
    assert all(a.last_id < b.first_id for a, b in zip(about[:-1], about[1:], strict=True))
    for r in about:
        file = pq.ParquetFile(r.path)
        for k in range(file.num_row_groups):
            group = file.metadata.row_group(k)
            assert group.num_rows <= 32 and all(group.column(c).has_offset_index for c in range(3)) and group.column(0).has_column_index
            assert "DELTA_BINARY_PACKED" in group.column(2).encodings
            longest = max(file.read_row_group(k, ["n_tokens"])["n_tokens"].to_pylist())
            assert group.column(2).num_values < 300 + longest
    whole = {r.doc_id: r.ids for r in tokenfiles.read_ids(spark, folder, manifest).collect()}
    found = tokenfiles.read_range(manifest, folder, 31, 100).collect()
    assert sorted(r.doc_id for r in found) == list(range(33, 100, 3)) and all(r.ids == whole[r.doc_id] for r in found)
    assert sorted(r.n_tokens for r in tokenfiles.read_range(manifest, folder, 30, 30, ("n_tokens",)).collect()) == sorted(r.n_tokens for r in tokenfiles.read_digests(manifest, folder).where("doc_id = 30").collect())


def test_token_folders():
    system, path = tokenfiles.open_folder("file:///tmp/some/folder")
    assert system.type_name == "local" and path == "/tmp/some/folder"
    with pytest.raises(Exception):
        tokenfiles.open_folder("nothing://x/y")


def test_packing(docs, none):
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), length=64).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert set(total) == set(range(len(TEXTS))) and all(total[r.doc_id] == r.doc_tokens for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
        size = sum(n for _, n in parts)
        assert size <= 64 and size & (size - 1) == 0
    assert packing.pack(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_pieces_hold_the_right_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = ["some words here " * n for n in (1, 3, 200, 5000)] + ["copy of a text " * 40] * 30 + [None, ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(2, texts[2], "")], "doc_id long, text string, start string")
    rows = packing.pack(df, vocabulary("word_bpe_49k.json"), partitions=7).collect()
    seen = Counter()
    for r in rows:
        ids = np.array([*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen.update((r.doc_id, x) for x in range(r.start, r.start + r.length))
    assert all(n == (2 if d == 2 else 1) for (d, _), n in seen.items()) and len({d for d, _ in seen}) == len(texts)


def test_packing_ranges_have_equal_bytes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "hot copy of one text " * 50) for i in range(600)] + [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(1, 400))))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = packing.along_curve(packing.with_curve_key(df), packing.curve_bytes(df), 8)
    sizes = [r.b for r in ranges.groupBy(packing.F.spark_partition_id().alias("p")).agg(packing.F.sum(packing.F.length("text")).alias("b")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 1.5 * sum(sizes) / 8


def test_licenses(docs, none):
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(10, "MIT")}
    assert licenses.scan(none).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the \u201cSoftware\u201d), to deal"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _commented(text, mark):
    return "\n".join(f"{mark}{line}" for line in text.split("\n"))


def test_licenses_in_wrapped_and_commented_headers(spark):
    heads = {"Apache-2.0": APACHE, "GPL-3.0": GPL3, "MIT": MIT, "MPL-2.0": MPL}
    rows, want = [], {}
    for mark in ("", "# ", " * ", "//", ";; ", "> "):
        for name, text in heads.items():
            want[len(rows)] = {name}
            rows.append((len(rows), f"first words\n{_commented(text, mark)}\nint main() {{ return 0; }}"))
    for name, text in [("MIT", "Released under the MIT License, see there"), ("CC-BY-NC-4.0", "(Licensed under CC BY-NC 4.0)"), ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"), (None, "Licensed under CC BY-NC 3.0."), (None, "Licensed under the Apache License, Version 1.1."), (None, "This work is licensed under the GNU General Public License, version 5.")]:
        want[len(rows)] = {name} - {None}
        rows.append((len(rows), text))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {i: {r.license for r in found if r.doc_id == i} for i, _ in rows}
    assert got == want
    # words are counted as white space parts them
    assert {r.word_start for r in found if r.doc_id == 0 and r.template == 0} == {2}
    assert {r.word_start for r in found if r.doc_id == 8 and r.template == 0} == {3}
    assert {r.word_start for r in found if r.doc_id == 25} == {0}


def test_licenses_of_whole_texts_and_notices(spark):
    free = "This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU {} as\n * published by the Free Software Foundation; either {}, or\n * (at your option) any later version."
    some = [
        ("GPL-2.0", free.format("General Public License", "version 2 of the License")),
        ("GPL-2.0", free.format("General Public License", "version 2 of the License").replace("software;", "software:")),
        ("LGPL-2.1", free.format("Lesser General Public License", "version 2.1 of the License")),
        ("LGPL-3.0", free.format("Lesser General Public License", "version 3 of the License")),
        ("AGPL-3.0", free.format("Affero General Public License", "version 3 of the License")),
        ("GPL", free.format("General Public License", "version 9 of the License")),
        ("CC-BY-SA-4.0", "# Text under a license\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
        ("EPL-2.0", "// SPDX-License-Identifier: EPL-2.0"), ("MIT-0", "SPDX-License-Identifier: MIT-0"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"),
        ("BSD", licenses.TEMPLATES["BSD"][0]), ("CC0-1.0", "Licensed under CC0 1.0"), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ]
    whole = licenses._whole()
    assert {"Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"} <= set(whole)
    some += [(name, f"Copyright (c) 1999 Someone\n\n{_commented(text, ' * ')}\nand what follows") for name, text in whole.items()]
    some.append((None, whole["MIT"][:60]))
    found = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(some)], "doc_id long, text string")).collect()
    assert [(i, {r.license for r in found if r.doc_id == i}) for i in range(len(some))] == [(i, {name} - {None}) for i, (name, _) in enumerate(some)]
    # the order of two texts doesn't matter
    both = [(0, whole["BSD-2-Clause"] + " other words " * 300 + whole["BSD-3-Clause"]), (1, whole["BSD-3-Clause"] + " other words " * 300 + whole["BSD-2-Clause"])]
    found = licenses.scan(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert all({r.license for r in found if r.doc_id == i} == {"BSD-2-Clause", "BSD-3-Clause"} for i in (0, 1))


def test_licenses_equal_plain_containment(spark):
    """Against exact containment in windows at every place."""
    rng = np.random.default_rng(7)
    own = {"a": ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"], "b": [" ".join(f"t{i}" for i in range(60))], "c": ["one two three"]}
    texts = []
    for _ in range(60):
        words = [f"f{x}" for x in rng.integers(0, 99, 80)]
        for group in own.values():
            part = group[0].split()
            for _ in range(int(rng.integers(0, 4))):
                part[int(rng.integers(len(part)))] = "changed"
            at = int(rng.integers(len(words)))
            words[at:at] = part
        texts.append(" ".join(words))
    made = licenses.Templates(own)

    def grams(t):
        w = t.split()
        return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]

    want = set()
    for i, t in enumerate(texts):
        for name, group in own.items():
            part = set(grams(group[0]))
            inside = grams(t)
            w = next(x for x in reversed(made.windows) if len(part) * 1.5 <= x)
            best = max(len(part & set(inside[a : a + w])) / len(part) for a in range(len(inside)))
            if best >= licenses.MATCH and (name != "b" or all(g in set(inside) for g in part)):  # b's numbers must all be there
                want.add((i, name))
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string"), own).collect()}
    assert found == want and len(want) > 30


def test_license_bands_retrieve_whole_templates():
    """Windows that hold a template are retrieved with the stated probability."""
    rng = np.random.default_rng(8)
    misses = 0
    for trial in range(300):
        n = int(rng.integers(5, 60))
        part, window = rng.integers(0, 1 << 62, n).astype(np.uint64), rng.integers(0, 1 << 62, int(n * 1.2)).astype(np.uint64)
        both = np.concatenate([part, window])
        misses += not any(licenses.keyed(part, 500 + b).min() == licenses.keyed(both, 500 + b).min() for b in range(licenses.BANDS))
    assert misses == 0


def _sets(texts, k=4):
    out = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def _smallest(n, linked):
    at = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if linked(i, j):
                    at[i] = at[j] = min(at[i], at[j])
    return at


def test_jaccard(spark, docs, none):
    sets = _sets(TEXTS)
    want = _smallest(len(TEXTS), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = {r.doc_id: r for r in jaccard.components_of(docs).collect()}
    assert [got[i].component_id for i in range(len(TEXTS))] == want and all(got[i].n_shingles == len(s) for i, s in sets.items())
    assert jaccard.components_of(none).count() == 0
    assert {r.doc_id for r in jaccard.one_of_each(docs).collect()} == {i for i in range(len(TEXTS)) if want[i] == i}
    # chains of edits, which cross size bands and blocks
    rng = np.random.default_rng(1)
    texts = []
    for size in (8, 20, 60, 300):
        words = [f"w{size}x{i}" for i in range(size)]
        for _ in range(12):
            words = words.copy()
            words[rng.integers(len(words))] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(words[: len(words) - int(rng.integers(3))]))
    sets = _sets(texts)
    want = _smallest(len(texts), lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.components_of(made).collect()} == dict(enumerate(want))


def _smallest_of(linked):
    """Smallest index reachable over a symmetric matrix."""
    out, left = np.arange(len(linked)), np.ones(len(linked), bool)
    for i in range(len(linked)):
        if left[i]:
            inside, front = np.zeros(len(linked), bool), np.array([i])
            inside[i] = True
            while len(front):
                new = linked[front].any(0) & ~inside
                inside |= new
                front = np.flatnonzero(new)
            out[inside], left = i, left & ~inside
    return out


@pytest.mark.parametrize("kind", ["plain", "deletions", "mixed", "none", "costs"])
@pytest.mark.parametrize("percent", [85, 80])
def test_linked_sets_share_a_key_under_any_allocation(kind, percent):
    rng = np.random.default_rng(len(kind) + percent)
    sets = []
    for size in (1, 2, 3, 5, 7, 8, 9, 12, 20, 50, 120, 400):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for _ in range(8):
            own = base.copy()
            for _ in range(int(rng.integers(0, max(1, size * (100 - percent) // 100) + 1))):
                how = rng.integers(3)
                own = np.delete(own, rng.integers(len(own))) if how == 0 and len(own) > 1 else np.append(own, rng.integers(0, 1 << 62, 1).astype(np.uint64)) if how == 1 else own
                if how == 2:
                    own[rng.integers(len(own))] = rng.integers(0, 1 << 62)
            sets.append(np.unique(own))
    alloc = jaccard.Allocation(percent, max(map(len, sets)))
    for b in alloc.bands:
        if kind == "deletions":
            b.segments, b.levels = b.most + 1, np.ones(jaccard.CLASSES, np.int8)
        if kind in ("mixed", "none"):
            b.levels = rng.integers(-1, 2 if kind == "mixed" else 0, jaccard.CLASSES).astype(np.int8)
    alloc.arrays()
    if kind == "costs":
        keys = rng.random((len(alloc.bands), 2, jaccard.CLASSES, 2)) * 100
        keys[..., 1] += 3 * keys[..., 0]
        alloc.allocate(keys, rng.random(keys.shape) * 1e5)
        assert any((b.levels != 0).any() for b in alloc.bands)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    key, who = jaccard.set_keys(at, np.concatenate(sets), np.arange(len(sets)), alloc)
    by = {}
    for k, w in zip(key.tolist(), who.tolist(), strict=True):
        by.setdefault(k, set()).add(w)
    met = {(a, b) for g in by.values() for a in g for b in g if a < b}
    plain = [set(x.tolist()) for x in sets]
    want = {(i, j) for i, x in enumerate(plain) for j, y in enumerate(plain) if i < j and x != y and 100 * len(x & y) >= percent * len(x | y)}
    assert len(want) > 50 and want <= met


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(11)
    for n in (40, 700, 5000):
        for share in (0.9, 0.86, 0.5):
            one = rng.integers(0, 1 << 62, n).astype(np.uint64)
            two = np.concatenate([one[: int(n * share)], rng.integers(0, 1 << 62, int(n * 0.1) + 1).astype(np.uint64)])
            raw = []
            for own in (one, two):
                width = int(jaccard.sketch_bits(np.array([len(own)]), 85)[0])
                raw.append(np.packbits(np.bincount((own & np.uint64(width - 1)).astype(int), minlength=width).astype(np.uint8) & 1).tobytes())
            differ, sketch = len(set(one.tolist()) ^ set(two.tolist())), jaccard.folded([raw[0], raw[1] + bytes(len(raw[1]))] if len(raw[0]) == len(raw[1]) else raw)
            found = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            assert found <= differ
            if share == 0.5:  # and those of sets that aren't alike tell them apart, however large
                assert found > jaccard.differ_most(len(one), len(two), 85)


def test_allocation_leaves_out_dear_segments():
    cost = np.zeros((jaccard.CLASSES, 2))
    cost[:10] = [100, 700]
    cost[3] = [1e6, 2e6]
    total, levels = jaccard.cheapest(cost, np.r_[np.ones(10, int), np.zeros(jaccard.CLASSES - 10, int)], 10)
    assert levels[3] == -1 and sorted(levels[:10].tolist()) == [-1] + [0] * 8 + [1] and total == 1500
    assert jaccard.cheapest(cost, np.r_[np.ones(4, int), np.zeros(jaccard.CLASSES - 4, int)], 9) is None


def test_measured_pairs(spark):
    """The sketches' pairs come near the true ones, copies counted once."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*words[:20], *(f"x{rng.integers(10**9)}" for _ in range(4))]) for _ in range(120)] + [" ".join(words)] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, alloc = jaccard.profiles(docs, 4, 85), jaccard.Allocation(85, 40)
    keys, pairs = jaccard.measured(docs, known, 4, alloc)
    found = {}
    for t in set(texts):
        values = np.concatenate([v for *_, v in jaccard._sets(jaccard.pa.array([t]), 4)])
        for k in jaccard.set_keys(np.array([0, len(values)]), values, np.zeros(1, int), alloc)[0].tolist():
            found[k] = found.get(k, 0) + 1
    # every set is measured in one of its two groups
    true = sum(n * (n - 1) / 2 for n in found.values()) / 2
    assert keys[:, 0, :, 0].sum() == pytest.approx(sum(found.values()) / 2, rel=0.1)
    assert true / 3 < pairs[:, 0, :, 0].sum() < 3 * true


@pytest.mark.parametrize("block", [12, 2048])
def test_jaccard_of_hot_groups(spark, monkeypatch, block):
    """Near copies over many blocks, in chains and around a core, with and without links between them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SET_BLOCK", block // 2)
    monkeypatch.setattr("showerlake.llm.common.MOST_OF_KEY", 20 if block < 100 else 256)
    rng = np.random.default_rng(9)
    texts = []
    for size, number in ((40, 150), (300, 80), (9, 60)):
        core = [f"c{size}x{i}" for i in range(size)]
        chain = core
        for i in range(number):
            own = core.copy() if i % 3 else chain
            for _ in range(int(rng.integers(1, max(2, size // 80 + 2)))):
                own = own.copy()
                own[int(rng.choice([0, len(own) - 1, rng.integers(len(own))]))] = f"n{rng.integers(10**6)}"
            if i % 3 == 0:
                chain = own
            texts.append(" ".join(own))
    sets = _sets(texts)
    linked = np.array([[i != j and 100 * len(x & y) >= 85 * len(x | y) for j, y in sets.items()] for i, x in sets.items()])
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in jaccard.components_of(made).orderBy("doc_id").collect()] == _smallest_of(linked).tolist()


def test_jaccard_of_five_thousand_copies(spark):
    rng = np.random.default_rng(10)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        own = core.copy()
        if i % 2:
            own[-1] = f"n{rng.integers(10**7)}"
        rows.append((i, " ".join(own)))
    rows += [(5000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(50)]
    found = jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5050 and all(r.component_id == (0 if r.doc_id < 5000 else r.doc_id) for r in found)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95), (7, 7), (200, 200)], "a long, b long")
    want = dict.fromkeys(range(1, 31), 1) | {100: 90, 90: 90, 95: 90, 200: 200}
    assert {r.node: r.component for r in components(edges).collect()} == want
    hub = spark.createDataFrame([(5, i) for i in range(6, 400)] + [(399, 1000), (1000, 3)], "a long, b long")
    assert {r.component for r in components(hub).collect()} == {3} and components(edges.where("false")).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session(), "x")
    Context.master = "local[4]"
    assert shared_dir(Session(), "x").startswith("file:/")


def test_lm(docs, none):
    train = lm.mod_crc("doc_id", 7) != 2
    count, texts = Counter(), 0
    for i, t in enumerate(TEXTS):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*(t or "").encode().lower().split(), "end"])
            texts += 1
    n, v = sum(count.values()), len(count)
    for head in (lm.HEAD, 5):
        for r in lm.score(docs, train, head=head).collect():
            words = [*(TEXTS[r.doc_id] or "").encode().lower().split(), "end"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
            assert math.isfinite(r.score) and r.score <= 0
    assert lm.score(none, train).count() == 0


def test_lm_counts_beyond_32_bits(spark, monkeypatch):
    plain = lm.count_words
    monkeypatch.setattr(lm, "count_words", lambda docs: plain(docs).withColumn("c", lm.F.col("c") * 5_000_000_000))
    made = spark.createDataFrame([(0, "red red blue")], "doc_id long, text string")
    (r,) = lm.score(made, lm.F.lit(True)).collect()
    n = 15_000_000_000 + 1
    want = sum(math.log10((c + 1) / (n + 3 + 1)) for c in (10**10, 10**10, 5 * 10**9, 1))
    assert r.train_tokens == n and r.base_score == pytest.approx(want, abs=1e-6)


def test_lm_trains_on_every_position(spark):
    # four tokens a text, so that a stride of four or eight meets the same position of each
    same = spark.createDataFrame([(i, "red green blue") for i in range(400)], "doc_id long, text string")
    scores = [r.score for r in lm.score(same, lm.F.lit(True)).collect()]
    assert len(scores) == 400 and min(scores) > -0.3


def test_lm_probabilities_are_normalised():
    classes = lm.Classes(np.arange(2000, 0, -1), np.arange(lm.ENDINGS) % lm.CLUSTERS)
    assert classes.words == 2000 and max(np.diff(classes.first)) <= lm.MOST_OF_GROUP and len(classes.first) == lm.GROUPS + 1
    model = lm.Model(classes, np.full(classes.number, 1 / classes.number), np.full(lm.WORDS, 1 / lm.WORDS))
    # the end, every common word, and each cluster once
    outcomes = np.concatenate([[0], 1 + np.arange(2000), 1 + lm.WORDS + np.arange(lm.CLUSTERS)])
    ahead = np.random.default_rng(1).integers(0, 60, (lm.CONTEXT, 1)).repeat(len(outcomes), 1)
    assert (10 ** model.log10(ahead, outcomes)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_learns_from_context(spark):
    rng = np.random.default_rng(5)
    follows = {w: f"{w}{w}" for w in "abcdefgh"}
    texts = [" ".join(x for w in rng.choice(list(follows), 40) for x in (w, follows[w])) for _ in range(300)]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, "a bb c dd"), (1001, "a aa c cc")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm.score(made, lm.F.col("doc_id") < 300).collect()}
    assert found[1001] > found[1000] + 1


def test_language(spark, none):
    rows = [(i, ("the of and " if i % 2 else "der und das ") * (1 + i % 5) + str(i), "en" if i % 2 else "de", "clash") for i in range(60)] + [(100, None, None, ""), (101, "12 34", "en", ""), (102, "", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    found = {r.doc_id: r for r in language.identify(df.union(df.where("doc_id = 3"))).collect()}
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") for i in range(60)) and {found[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert language.identify(none).count() == 0 and language.identify(df.union(df)).count() == 2 * len(rows)
    # nothing learned: all is undetermined, and nothing can be rejected
    blank = df.withColumn("lang", language.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(blank).collect()} == {"und"}
    assert language.keep(df, language.learn(blank)).count() == len(rows)


def _phrases(text, inside):
    """Fewest phrases of `inside`, or unknown characters, that make up a text."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in inside:
            j += 1
        n, i = n + 1, max(i + 1, j - 1)
    return n


def test_language_equals_plain_parsing(spark):
    rng = np.random.default_rng(2)
    alphabet = {"aa": "abcde  ", "bb": "abxyz  ", "cc": "déßøñ  "}
    sample = {k: language.running("".join(rng.choice(list(v), 600))) for k, v in alphabet.items()}
    made = language.Automata(sample)
    texts = ["".join(rng.choice(list(alphabet[k] + "Qж.1"), n)) for k in alphabet for n in (1, 2, 5, 20, 90, 300, 2000)] + ["ABCDE abc", "x" * 5000, "一二三"]
    found = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), made).collect()}
    for i, t in enumerate(texts):
        words = language.running(t)
        if not words.strip():
            assert (found[i].lang_pred, found[i].score, found[i].letters) == ("und", 0, 0)
            continue
        flat = np.array([ord(c) for c in words])
        start, length, _ = language.pieces(flat, np.array([0, len(flat)]))
        total = {k: sum(_phrases(words[a : a + n], v) for a, n in zip(start, length, strict=True)) for k, v in sample.items()}
        assert (found[i].lang_pred, found[i].phrases) == (min(sorted(total), key=total.get), min(total.values())), t
    # chunks cover a text, overlap by a space at most, and are short
    flat = np.array([ord(c) for c in language.running("some words " * 500 + "y" * 3000)])
    start, length, _ = language.pieces(flat, np.array([0, len(flat)]))
    assert start[0] == 0 and start[-1] + length[-1] == len(flat) and max(length) <= 4 * language.CHUNK
    assert all(0 <= a + n - b <= 1 for a, n, b in zip(start[:-1], length[:-1], start[1:], strict=True))


def test_language_stage_rejects_what_fits_no_language(spark):
    rows = [(i, "the cat and the dog of the house " * 3, "en") for i in range(9)] + [(50, "жизнь это хорошо и очень много слов здесь " * 3, None), (51, "12", None), (52, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    assert sorted(r.doc_id for r in language.keep(df, model).collect()) == [*range(9), 52]
    assert language.keep(df, model, languages=()).count() == 0


def test_language_sample_is_bounded_for_each_language(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list("abcdefghijklmnop"), 12)), "fi" if i in (7, 311, 312, 650, 907) else "sv" if i == 500 else "en") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def learned(**bounds):
        made = language.learn(df, **bounds)
        assert made.names == ["en", "fi", "sv"]
        flat, width = np.array([ord(c) for _, t, _ in rows for c in f" {t} "]), 14
        whole = made.phrases(flat, np.arange(len(rows)) * width, np.full(len(rows), width)) == 1
        return [np.flatnonzero(whole[:, k]).tolist() for k in range(3)]

    own = [[i for _, i in sorted((zlib.crc32(f"language {i}".encode()), i) for i, _, name in rows if name == lang)] for lang in ("en", "fi", "sv")]
    assert learned(docs=3) == [sorted(x[:3]) for x in own]
    assert learned(characters=13) == [sorted(x[:2]) for x in own]  # whole texts, until there are enough characters
    assert learned(characters=5) == [x[:1] for x in own]  # all are longer: the shortest, of equals the first


def test_toxicity_equals_plain_rules():
    model = toxicity.Model({"idiot": 4.0, "moron": 2.0}, {"grom": 3.0}, 0.2, 0.5)

    def plain(text):
        total, matched = 0.0, 0
        for clause in toxicity.re.split(r"[.!?;\n]+", text):
            words, hits, sums = toxicity._TOKEN.findall(clause), 0, 0.0
            kinds = [model.lexicon(w) for w in words]
            for i, (kind, weight) in enumerate(kinds):
                if kind not in (toxicity.INSULT, toxicity.THREAT):
                    continue
                near = [k for k, _ in kinds[max(0, i - toxicity.NEAR) : i]]
                if kind == toxicity.THREAT and toxicity.INTENT not in near:
                    weight *= toxicity.WEAK
                weight *= model.negated if toxicity.NEGATION in near else 1.0
                weight *= model.reported if toxicity.REPORT in [k for k, _ in kinds[:i]] else 1.0
                hits, sums = hits + 1, sums + weight
            matched += hits > 0
            total += sums * (toxicity.TARGETED if toxicity.TARGET in [k for k, _ in kinds] else 1.0)
        return total, matched

    rng = np.random.default_rng(6)
    words = "you idiot morons moron gromble l'idiot moron's will kill not never said he thing that's word , . ! ; \n".split(" ")
    for n in (0, 1, 2, 5, 9, 20, 60):
        for _ in range(60):
            text = " ".join(rng.choice(words, n))
            total, clauses, _ = model.match(text)
            assert (pytest.approx(plain(text)[0]), plain(text)[1]) == (total, clauses), text
    assert model.match("l'idiot")[0] == model.match("idiot")[0] == 4 and model.match("moron's")[0] == 2
    assert model.match("we will kill you")[0] > model.match("we kill you")[0] > 0
    import time

    def took(n):
        t = time.process_time()
        model.match("some idiot words, " * n)  # one long clause
        model.match("you idiot. " * n)  # many
        return time.process_time() - t

    took(1000)
    assert took(80_000) < 30 * took(8_000) + 0.2


def test_toxicity_sample_bounds(spark):
    docs = spark.createDataFrame([(i, "you gromble thing " * 10 if i % 2 else "and so on " * 10, "clash") for i in range(50)] + [(1, "zz", "")] * 30, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, None), (None, 1), (900, 1)], "doc_id long, toxic int")
    order = sorted(range(50), key=lambda i: (zlib.crc32(f"toxic {i}".encode()), i))
    assert {r.doc_id for r in toxicity.sampled(docs, labels, 20, 10**6).collect()} <= set(order[:20]) | {900}
    some = toxicity.sampled(docs, labels, 100, 500).collect()
    assert len(some) < 9 and sum(len(r.text) for r in some) >= 500 and len({r.doc_id for r in some}) == len(some)
    assert "grom" in " ".join([*(m := toxicity.learn(docs, labels)).words, *m.stems])


def test_toxicity(spark, none):
    rows = [(i, f"some words here {'you gromble thing' if i % 4 == 0 else 'and nothing else'} number{i}.") for i in range(80)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    assert all(found[i].predicted == int(i % 4 == 0) for i in range(80)) and found[200].predicted == found[201].predicted == 0
    assert toxicity.detect(none, labels).count() == 0
    assert toxicity.detect(docs, labels.where("false")).count() == len(rows)
    model = toxicity.Model({"idiot": 4.0}, {})
    assert model.match("you idiot")[0] > model.match("he said you are an idiot")[0] > 0
    assert model.match("you are not an idiot")[0] < model.match("you are an idiot")[0]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[10:20] = x[10] + rng.normal(size=(10, 8)) * 0.05
    x[5] = x[4]
    rows = [(i, [float(np.float32(a)) for a in v], i % 2 if i > 20 else 0) for i, v in enumerate(x)]
    rows += [(60, None, 0), (61, [0.0] * 8, 0), (62, [float("nan")] * 8, 0), (63, [1.0], 0), (64, rows[10][1], None)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours(vectors):
    rows, df = vectors
    good = {i: np.array(v) for i, v, _ in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    found = {}
    for r in neighbours.search(df.withColumn("score", neighbours.F.lit("clash"))).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 20 == 0}
    for q, got in found.items():
        want = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q))[:20]
        assert [i for i, _ in got] == [i for _, i in want]
    assert neighbours.search(df.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
def test_neighbours_by_curves(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32))
    if kind == "clustered":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.15 * x
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    made = neighbours.Curves(x[:2000], neighbours.CURVES)
    window = neighbours.fitted_window(made, x[:2000], neighbours.CURVES, 20)
    assert window < (0.3 if kind == "clustered" else 0.8)
    ask = np.arange(0, 4000, 20)
    near = x[ask] @ x.T
    near[np.arange(len(ask)), ask] = -np.inf
    want = {int(q): set(np.argsort(-row)[:20].tolist()) for q, row in zip(ask, near, strict=True)}
    found = {q: [] for q in want}
    for r in neighbours.search(df).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, own in found.items():
        own.sort()
        assert [k for k, *_ in own] == list(range(1, 21)) and [s for *_, s in own] == sorted((s for *_, s in own), reverse=True)
        assert all(s == pytest.approx(near[q // 20, i], abs=1e-12) for _, i, s in own)
        hits += len({i for _, i, _ in own} & want[q])
    assert hits >= 0.93 * 20 * len(want)


def test_neighbours_with_ties_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(7, [0.5, 0.0]), (7, [1.0, 0.0])]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(20))


def test_vector_links(vectors):
    rows, df = vectors
    good = {i: (np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v) and k is not None}
    linked = lambda i, j: i != j and i in good and j in good and good[i][1] == good[j][1] and good[i][0] @ good[j][0] >= 0.93
    want = _smallest(65, linked)
    for r in embedding_dedup.links(df.withColumn("n_links", embedding_dedup.F.lit("clash"))).collect():
        assert r.n_links == sum(linked(r.vec_id, j) for j in range(65)) and r.component_id == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup.links(df.where("false")).count() == 0


def test_vector_links_of_a_hot_group(spark, monkeypatch):
    """A group over many blocks: all components are right, and nearly all link ends are found."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    near = rng.normal(size=16) + 0.09 * rng.normal(size=(600, 16))
    x = np.concatenate([near, rng.normal(size=(400, 16)), near[:50]])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    found = {r.vec_id: r for r in embedding_dedup.links(df).collect()}
    assert sum(r.n_links for r in found.values()) >= 0.995 * linked.sum() and all(found[i].n_links <= linked[i].sum() for i in range(len(x)))
    want = _smallest_of(linked)
    assert sum(found[i].component_id == want[i] for i in range(len(x))) >= 0.999 * len(x)


def test_vectors_of_one_id_and_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [-1.0, 0.0], 0), (5, [1.0, 0.0, 0.0], 0), (6, [1.0, 0.0, 0.0], 0), (2, None, 0), (9, None, None)]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert found == [(1, 1, 1), (1, 1, 1), (2, 0, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (5, 1, 5), (6, 1, 5), (9, 0, 9)]
