"""License scan by conditional compression (operator 3)."""

import bisect
import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from vacantia.llm.shared import documents, ready

#: Usual wordings of license notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying is prohibited."],
}
#: Words of a cue may stand on two lines, with a comment mark between them.
CUE = re.compile(
    rb"licen[sc]e|copyright|spdx|all\W{1,40}rights\W{1,40}reserved|permission\W{1,40}is\W{1,40}hereby|public\W{1,40}domain"
    rb"|creative\W{1,40}commons|redistribution\W{1,40}and\W{1,40}use|\bcc(?:\W{1,40})?by\b|\bcc0\b|free\W{1,40}software"
    rb"|source\W{1,40}code\W{1,40}form|\bgpl", re.I)
WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
#: Runs of letters and digits, with all bytes of longer characters: line breaks and comment marks are between them.
RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Fixed words that tell licenses apart; numbers do as well. A fit that differs in one is no notice of that license.
TELLING = frozenset([
    "lesser", "affero", "noncommercial", "sharealike", "noderivatives", "nc", "sa", "nd", "by", "by-sa", "by-nc", "by-nd", "by-nc-sa",
    "2-clause", "3-clause", "4-clause", "apache", "mit", "bsd", "isc", "gnu", "mozilla", "cc", "cc0",
])
NUMBER = re.compile(r"v?(\d+(?:\.\d+)*)")
SPDX = re.compile(r"SPDX-License-Identifier:[^\S\n]*([\w.+-]+(?:[^\S\n]+(?:OR|AND|WITH)[^\S\n]+[\w.+-]+)*)", re.I)
#: Templates, by size reduction, whose wordings may name a notice.
WINNERS = 5
#: Least share of a wording's words that a notice must hold; at most the rest of it may be added.
PERCENT = 80
#: Runs before and after a cue that belong to its block: the longest wording with all that may be added, twice over for hyphens.
REACH = 2 * max(len(RUN.findall(w.encode())) for ws in TEMPLATES.values() for w in ws) * (200 - PERCENT) // 100
REMEMBER = 50_000
#: Longest block whose notices are remembered, in bytes.
LONGEST = 4_000


@functools.cache
def _coders():
    make = lambda text: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(
        text, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return zstandard.ZstdCompressor(level=9), {name: make("\n".join(t).encode()) for name, t in TEMPLATES.items()}


def blocks(raw):
    """Candidate blocks of one text: (place, bytes) of the words around license cues.

    A block holds REACH runs on either side of each of its cues, over any line breaks; cues
    whose words meet share one block, so no notice is cut at an edge.
    """
    cues = [(m.start(), m.end()) for m in CUE.finditer(raw)]
    if not cues:
        return []
    runs = [m.span() for m in RUN.finditer(raw)]
    starts, ends, out = [r[0] for r in runs], [r[1] for r in runs], []
    for i, j in cues:
        first = max(0, bisect.bisect_right(ends, i) - REACH)
        last = min(len(runs), bisect.bisect_left(starts, j) + REACH) - 1
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    return [(starts[i], raw[starts[i] : ends[j]]) for i, j in out]


def words_of(text):
    return [w.lower() for w in WORD.findall(text)]


@functools.cache
def _wordings():
    """Every wording as word numbers: (license, words, numbers, how often each), and the numbers."""
    number, out = {}, []
    for name, wordings in TEMPLATES.items():
        for wording in wordings:
            words = words_of(wording)
            ids = [number.setdefault(w, len(number) + 1) for w in words]
            out.append((name, words, ids, Counter(ids)))
    return out, number


def _costs(a, b):
    """Least differences of each beginning of ``a`` ending at each place of ``b``, begun anywhere: one row each."""
    steps = np.arange(len(b) + 1)
    rows = [np.zeros(len(b) + 1, np.int64)]
    for word in a:
        above = rows[-1]
        here = above + 1
        here[1:] = np.where(b == word, np.minimum(here[1:], above[:-1]), here[1:])
        rows.append(np.minimum.accumulate(here - steps) + steps)
    return rows


def _fit(a, b, rows, end):
    """The best fit of ``a`` ending before ``end``: pairs of places that match, first to last."""
    i, j, out = len(a), end, []
    while i and j:
        if b[j - 1] == a[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _fits(ids):
    """All fits of all wordings among word numbers: (differences, -words, start, end, license, missing, added)."""
    held, out = Counter(ids.tolist()), []
    for name, words, a, often in _wordings()[0]:
        total = len(a)
        if 100 * sum(min(n, held[k]) for k, n in often.items()) < PERCENT * total:
            continue
        rows = _costs(a, ids)
        last = rows[-1]
        near = (100 * last <= 2 * (100 - PERCENT) * total) & (last <= np.append(last[1:], total)) & (last <= np.append(total, last[:-1]))
        for end in np.flatnonzero(near).tolist():
            met = _fit(a, ids, rows, end)
            if not met or 100 * len(met) < PERCENT * total:
                continue
            start, stop = met[0][1], met[-1][1] + 1
            in_a, in_b = {i for i, _ in met}, {j for _, j in met}
            added = [j for j in range(start, stop) if j not in in_b]
            if 100 * len(added) <= (100 - PERCENT) * total:
                missing = [w for k, w in enumerate(words) if k not in in_a]
                out.append((len(missing) + len(added), -total, start, stop, name, missing, added))
    return out


def _numbers(words):
    """The numbers among some words, 2.0 being 2."""
    found = [NUMBER.fullmatch(w) for w in words]
    return sorted(re.sub(r"(\.0+)+$", "", m[1]) for m in found if m)


def _told_apart(missing, added):
    """Whether the differences hold a word that tells licenses apart, or another number."""
    return not TELLING.isdisjoint(missing + added) or _numbers(missing) != _numbers(added)


def judge(block):
    """All notices of a block, by place: (place, name, reduction, missing, added, rank of reduction).

    Wordings are fitted word by word at every place. Every template then compresses the bytes
    under a fit as a raw dictionary, and templates are ranked by how much smaller that gets
    than without one. Of the first ``WINNERS`` templates the highest ranked one whose wording
    confirms it names the notice; a fit that differs in a word that tells licenses apart does not confirm.
    Templates with the same wording there are named together. The words of a notice are
    marked, and what is left is judged again until nothing fits.

    An SPDX line names its expression itself. "All rights reserved" counts only where its block has no license.
    """
    text = block.decode("utf-8", "replace")
    spans = [m.span() for m in WORD.finditer(text)]
    number = _wordings()[1]
    words = [text[i:j].lower() for i, j in spans]
    ids = np.array([number.get(w, 0) for w in words], np.int64)
    ranks, out = {}, []

    def ranking(start, stop):
        part = text[spans[start][0] : spans[stop - 1][1]].encode()
        if part not in ranks:
            plain, coders = _coders()
            size = len(plain.compress(part))
            gain = {name: (size - len(coder.compress(part))) / size for name, coder in coders.items()}
            ranks[part] = gain, {n: k for k, n in enumerate(sorted(gain, key=lambda n: (-gain[n], n)))}
        return ranks[part]

    def place(start):
        return len(text[: spans[start][0]].encode())

    for m in SPDX.finditer(text):
        inside = [k for k, (i, j) in enumerate(spans) if i < m.end() and j > m.start()]
        gain, order = ranking(inside[0], inside[-1] + 1)
        name = " ".join(m[1].split()).rstrip(".")
        best = min(order, key=order.get)
        out.append((place(inside[0]), name, gain[best], [], [], order.get(name, order[best])))
        ids[inside] = -1
    while True:
        confirmed = []
        for fit in _fits(ids):
            if not _told_apart(fit[5], [words[j] for j in fit[6]]):
                gain, order = ranking(fit[2], fit[3])
                if order[fit[4]] < WINNERS:
                    confirmed.append((order[fit[4]], *fit[:4], gain[fit[4]], fit))
        confirmed = [f for f in confirmed if (ids[f[3] : f[4]] >= 0).all()]
        if not confirmed:
            break
        confirmed.sort(key=lambda f: f[:5])
        free = ids >= 0
        for rank, cost, _, start, stop, gain, fit in confirmed:
            if free[start:stop].all():
                free[start:stop] = False
                same = {f[6][4] for f in confirmed if f[3:5] == (start, stop) and f[6][5:] == fit[5:]}
                out.append((place(start), " / ".join(sorted(same)), gain, fit[5], [words[j] for j in fit[6]], rank))
        ids = np.where(free, ids, -1)
    licensed = any(n[1] != "proprietary" for n in out)
    return sorted((n for n in out if n[1] != "proprietary" or not licensed), key=lambda n: n[0])


def scan(docs, id_col="doc_id", text_col="text"):
    """License notices in whole texts, one row per confirmed wording.

    Returns doc_id, place (byte of the text where the notice starts), license, reduction
    (share of the compressed size that the license's template saves), gain_rank, n_missing
    and n_added words, exact (no differences), differences (text, -missing and +added).

    Candidate blocks are the words around any license cue, anywhere in the text, over line
    breaks and comment marks; every wording that a block holds counts, but no word twice.
    Texts without cues, null and empty ones give no rows; repeated rows and notices give
    repeated rows; a null id stays null; extra columns are ignored. Narrow: no shuffle;
    equal blocks are judged once per worker.
    """
    ready(docs)
    schema = ("doc_id bigint, place bigint, license string, reduction double, gain_rank int, n_missing int, "
              "n_added int, exact boolean, differences string")
    names = [part.split(" ")[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches):
        seen = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for place, block in blocks(text or b""):
                    notices = seen.get(block)
                    if notices is None:
                        notices = judge(block)
                        if len(block) <= LONGEST:
                            if len(seen) > REMEMBER:
                                seen.clear()
                            seen[block] = notices
                    for at, name, gain, missing, added, rank in notices:
                        text_of = " ".join([f"-{w}" for w in missing] + [f"+{w}" for w in added])
                        rows.append((doc_id, place + at, name, gain, rank, len(missing), len(added), not missing and not added, text_of))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return documents(docs, id_col, text_col).mapInArrow(run, schema)
