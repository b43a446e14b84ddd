"""Operator 4: license notices in texts.

Words are runs of letters and digits: punctuation, quotes and comment marks part
them and are left out, in templates and texts alike, so that wrapped and commented
notices count as plain ones. word_start still counts words parted by white space.

Each template's word shingles are MinHashed into bands; so is every window of a
text; windows overlap by two thirds and are one and a half to 2.2 times as long as
the templates they are for. A window that shares a band with a template retrieves it; then the share of the
template's shingles that the window holds is counted exactly, and MATCH or more
is a match; those of a notice (up to NOTICE words), or of a longer text's first
line, that hold a number, so that tell the version, must all be there. A match whose
shingles are all among those of another template's match there, which has more of
them, or as many and a larger share, is left out: of a BSD-3-Clause text, BSD-2-Clause;
of a whole text, the notices inside it. With BANDS bands of one row each, a window that holds a template
whole (so has a Jaccard similarity of over 0.45 with it) is retrieved with
probability 1 - 0.55**BANDS at least, over 0.99999.

Null, empty and too short texts match nothing and give no rows; a template that
occurs at several places is reported once for each text, with its best window;
repeated rows are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerlake.llm.common import Words, keyed, prepare, row_slices, shingles, text_buffers, tidy

BANDS, MATCH, SHINGLE, NOTICE = 20, 0.8, 3, 80


def _gnu(name: str, short: str, version: str) -> list[str]:
    """Notices of a GNU license: or later, only, in short."""
    free = f"is free software: you can redistribute it and/or modify it under the terms of the {name}"
    fsf = "as published by the Free Software Foundation"
    return [
        f"{free} {fsf}, either version {version} of the License, or (at your option) any later version.",
        f"{free} {fsf}; either version {version}, or (at your option) any later version.",
        f"{free} {fsf}; version {version} of the License.",
        f"{free} {fsf}, version {version}.",
        f"{free}, version {version}, {fsf}.",
        f"Licensed under the {name}, version {version}",
        f"Licensed under the {name} v{version}",
        f"Licensed under the {short} v{version}",
        f"Licensed under {short}-{version}",
    ]


def _spdx(*names: str) -> list[str]:
    return [f"SPDX-License-Identifier: {name}" for name in names]


def _under(*names: str) -> list[str]:
    return [f"{how} under the {name}" for name in names for how in ("Licensed", "Released", "Distributed")]


_BOTH = _spdx("MIT OR Apache-2.0", "Apache-2.0 OR MIT")
#: Notices by which licenses are commonly declared, and opening or telling passages of texts that are not in license_texts.
#: GPL, LGPL and BSD without a number: what a text says that leaves the version or the variant open.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Apache License 2.0", *_spdx("Apache-2.0"), *_BOTH],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT License", "Distributed under the MIT License", "Licensed under MIT", *_spdx("MIT"), *_BOTH],
    "MIT-0": _spdx("MIT-0"),
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_gnu("GNU General Public License", "GPL", "3"), "Licensed under the GPLv3", *_spdx("GPL-3.0")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_gnu("GNU General Public License", "GPL", "2"), "Licensed under the GPLv2", *_spdx("GPL-2.0")],
    "GPL": ["is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "LGPL-3.0": [*_gnu("GNU Lesser General Public License", "LGPL", "3"), "Licensed under the LGPLv3", *_spdx("LGPL-3.0")],
    "LGPL-2.1": [*_gnu("GNU Lesser General Public License", "LGPL", "2.1"), *_spdx("LGPL-2.1")],
    "LGPL-2.0": [*_gnu("GNU Library General Public License", "LGPL", "2"), *_spdx("LGPL-2.0")],
    "LGPL": ["is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL-3.0": [
        *_gnu("GNU Affero General Public License", "AGPL", "3"), "Licensed under the AGPLv3", *_spdx("AGPL-3.0"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License", *_spdx("CC-BY-NC-4.0")],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License", *_spdx("CC-BY-4.0")],
    "BSD-3-Clause": [*_spdx("BSD-3-Clause"), *_under("BSD 3-Clause License", "3-Clause BSD License")],
    "BSD-2-Clause": [*_spdx("BSD-2-Clause"), *_under("BSD 2-Clause License", "2-Clause BSD License")],
    "BSD-4-Clause": _spdx("BSD-4-Clause"),
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", *_under("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"), *_spdx("MPL-2.0")],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", *_spdx("MPL-1.1")],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License", *_spdx("CC-BY-SA-4.0")],
    "CC-BY-SA-3.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "Licensed under CC BY-SA 3.0.", *_spdx("CC-BY-SA-3.0")],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License", *_spdx("CC-BY-NC-SA-4.0")],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.", *_spdx("CC-BY-ND-4.0")],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0.", *_spdx("CC-BY-NC-ND-4.0")],
    "CC0-1.0": ["has waived all copyright and related or neighboring rights to", "Licensed under CC0 1.0", "Creative Commons CC0 1.0 Universal", *_spdx("CC0-1.0")],
    "EPL-2.0": ['Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").', "made available under the terms of the Eclipse Public License 2.0", "made available under the terms of the Eclipse Public License v2.0", "Licensed under the Eclipse Public License 2.0", *_spdx("EPL-2.0")],
    "EPL-1.0": ['Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").', "made available under the terms of the Eclipse Public License v1.0", *_spdx("EPL-1.0")],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", *_under("Unlicense"), *_spdx("Unlicense")],
    "ISC": [*_under("ISC License"), *_spdx("ISC")],
    "0BSD": _spdx("0BSD"),
    "Zlib": [*_under("zlib License"), *_spdx("Zlib")],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", *_spdx("BSL-1.0")],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", *_spdx("OFL-1.1")],
}


def _whole() -> dict[str, str]:
    """The license texts of this package, by SPDX name; copyright lines are left out."""
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files("showerlake.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


#: Fixed texts: a license's notices, then its whole text. Numbers in the first line of a whole text must match too.
TEMPLATES = {name: list(group) for name, group in NOTICES.items()}
for _name, _text in _whole().items():
    TEMPLATES.setdefault(_name, []).append(_text)


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def plain(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with spaces for ASCII, Latin-1 and general (U+2000 to U+207F) punctuation; lengths stay."""
    out = _PLAIN[raw]
    two = np.flatnonzero(raw[:-1] == 0xC2)
    out[two] = out[two + 1] = 0x20
    three = np.flatnonzero((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81)))
    out[three] = out[three + 1] = out[three + 2] = 0x20
    return out


def white_word(text: bytes, at: int) -> int:
    """Number of the white-space word of a text in which the byte `at` lies."""
    before = text[:at]
    return len(before.split()) - (not before[-1:].isspace() and at > 0)


class Templates:
    """Shingles and bands of the templates, by length class."""

    def __init__(self, texts: dict[str, list[str]] | None = None):
        flat = [(name, k, t) for name, group in (TEMPLATES if texts is None else texts).items() for k, t in enumerate(group)]
        self.names, self.parts = [n for n, _, _ in flat], [k for _, k, _ in flat]
        self.sets, self.needed = [], []
        for _, _, t in flat:
            raw = plain(np.frombuffer(t.encode(), np.uint8))
            value = shingles(Words(raw, np.array([0, len(raw)])), SHINGLE)[1]
            words = bytes(raw).split()
            head = len(words) if len(words) <= NOTICE else len(plain(np.frombuffer(t.split("\n", 1)[0].encode(), np.uint8)).tobytes().split())
            number = [i + SHINGLE <= max(head, SHINGLE) and any(c in b"0123456789" for w in words[i : i + SHINGLE] for c in w) for i in range(len(value))]
            self.sets.append(np.unique(value))
            self.needed.append(value[np.array(number, bool)])
        self.bands: dict[tuple[int, int], list[int]] = {}  # (band, MinHash) -> templates
        self.near = np.zeros((BANDS, 1 << 16), dtype=bool)  # by the MinHash's last 16 bits
        for i, s in enumerate(self.sets):
            for b in range(BANDS):
                least = int(keyed(s, 500 + b).min()) if len(s) else 0
                self.bands.setdefault((b, least), []).append(i)
                self.near[b, least & 0xFFFF] = True
        # windows of w shingles serve templates of w / 2.2 to w / 1.5 shingles
        self.windows: list[int] = []
        for n in sorted({len(s) for s in self.sets}, reverse=True):
            if not self.windows or n * 2.2 < self.windows[-1]:
                self.windows.append(max(2, -(-3 * n // 2)))

    def scan(self, words: Words) -> dict[tuple[int, int], tuple[float, int]]:
        """(row, template) -> (containment, first word) of the best window."""
        row, value = shingles(words, SHINGLE)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        if not len(value):
            return found
        at = np.searchsorted(row, np.arange(words.rows + 1))
        layout = []
        for w in self.windows:  # blocks of a third of a window; a window begins at each
            step = max(1, w // 3)
            number = -(-np.diff(at) // step)
            owner = np.repeat(np.arange(words.rows), number)
            lo = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * step
            layout.append((owner, lo, np.minimum(lo + w, at[owner + 1]), -(-w // step), set()))
        for b in range(BANDS):
            mixed = keyed(value, 500 + b)
            for owner, lo, _, blocks, hits in layout:
                block = np.minimum.reduceat(mixed, lo)
                least = block.copy()
                for j in range(1, min(blocks, len(block))):
                    least[:-j] = np.where(owner[j:] == owner[:-j], np.minimum(least[:-j], block[j:]), least[:-j])
                for i in np.flatnonzero(self.near[b][(least & np.uint64(0xFFFF)).astype(np.int64)]):
                    hits.update((int(i), t) for t in self.bands.get((b, int(least[i])), ()))
        held: list[dict[int, list[tuple[int, float, np.ndarray, int]]]] = []  # of each layout: window -> matches
        for _, lo, hi, _, hits in layout:
            held.append(matches := {})
            for i, t in sorted(hits):
                if hi[i] - lo[i] < MATCH * len(self.sets[t]):
                    continue
                inside = value[lo[i] : hi[i]]
                there = self.sets[t][np.isin(self.sets[t], inside)]
                share = len(there) / len(self.sets[t])
                if share >= MATCH and np.isin(self.needed[t], there).all():
                    first = int(lo[i] + np.flatnonzero(np.isin(inside, there))[0])
                    matches.setdefault(i, []).append((t, share, there, first))
        for k, (owner, lo, hi, _, _) in enumerate(layout):
            for i, own in held[k].items():
                near = []  # matches in windows over this one, as long, longer, or of the next shorter kind
                for (_, a, z, _, _), w, matches in zip(layout[: k + 2], self.windows, held):
                    if matches:
                        span = range(int(np.searchsorted(a, lo[i] - w)), int(np.searchsorted(a, hi[i])))
                        near += [m for j in span if j in matches and z[j] > lo[i] for m in matches[j]]
                for t, share, there, first in own:
                    if any(u != t and (len(other) > len(there) or len(other) == len(there) and more > share) and np.isin(there, other).all() for u, more, other, _ in near):
                        continue
                    r = int(owner[i])
                    best = found.get((r, t))
                    if best is None or (-share, first - int(at[r])) < (-best[0], best[1]):
                        found[r, t] = (share, first - int(at[r]))
        return found


def scan(df: DataFrame, templates: dict[str, list[str]] | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, license, template, word_start, containment) for each template that a text holds."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Templates(templates)
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = []
            raw, at = text_buffers(batch.column(1))
            for lo, hi in row_slices(at):
                words = Words(plain(raw[at[lo] : at[hi]]), at[lo : hi + 1] - at[lo])
                for (r, t), (share, first) in sorted(made.scan(words).items()):
                    begin = int(words.start[words.at[r] + first] - (at[lo + r] - at[lo]))
                    rows.append((names[lo + r], made.names[t], made.parts[t], white_word(raw[at[lo + r] : at[lo + r + 1]].tobytes(), begin), share))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "template", "word_start", "containment"])

    schema = "doc_id long, license string, template int, word_start long, containment double"
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(run), schema)
