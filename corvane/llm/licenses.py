"""License notices found by patience alignment.

Words that occur once in a stretch of text and once in a template anchor the two to each other; the longest increasing
run of anchors is kept, and the gaps between them are aligned in the same way. Coverage is the share of the
template's words that are matched. Where words are enough for a notice that the stretch does not give, or for a second
one, it is aligned again in windows around single words, each up to the word's next occurrences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import text_bytes, text_slices, word_hashes, word_spans

# Notices as their licenses' authors publish them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
COVERAGE = 0.8
_TOKEN = re.compile(r"[^\W_]+")


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal words of a and b, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            pairs.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            pairs.append((ahi, bhi))
        anchors = _increasing(_shared_once(a, alo, ahi, b, blo, bhi))
        if not anchors:
            continue
        pairs += anchors
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if p + 1 < q and r + 1 < s]
    return sorted(pairs)


def _shared_once(a: list[str], alo: int, ahi: int, b: list[str], blo: int, bhi: int) -> list[tuple[int, int]]:
    where: list[dict[str, int]] = []
    for words, lo, hi in ((a, alo, ahi), (b, blo, bhi)):
        own: dict[str, int] = {}
        for i in range(lo, hi):
            own[words[i]] = -1 if words[i] in own else i
        where.append(own)
    one, two = where
    return [(i, two[w]) for w, i in one.items() if i >= 0 and two.get(w, -1) >= 0]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of the first number) whose second numbers increase."""
    ends: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back.append(last[at - 1] if at else -1)
        ends[at:at + 1], last[at:at + 1] = [j], [n]
    out = []
    n = last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in _TOKEN.finditer(text)]


def scan(docs: DataFrame, notices: dict[str, str] | None = None, *, coverage: float = COVERAGE) -> DataFrame:
    """Notices in every whole text of docs(doc_id, text): doc_id, license, start, end, matched, coverage.

    start and end count characters (code points) of the text, end exclusive. A text is searched around the words that
    tell templates apart from prose (those of few letters in common use do not start a search), in stretches as wide
    as the longest template on either side. Where several templates match the same words, the one with the most
    matched words stays, then the higher coverage, then the name. Defined results: null, empty and unlicensed texts
    give no rows; each occurrence is a row; repeated rows are scanned each; other columns are ignored.
    """
    known = NOTICES if notices is None else notices
    templates = {name: words_of(text) for name, text in known.items()}
    templates = {name: words for name, words in templates.items() if words}
    reach = max(map(len, templates.values()), default=0)
    telling = sorted({w for words in templates.values() for w in words if len(w) >= 5} | {w for words in templates.values() if max(map(len, words)) < 5 for w in words})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.sort(_hashes(telling))
        for whole in batches:
            for batch in text_slices(whole, "text"):
                raw, offsets = text_bytes(batch.column("text"))
                starts, ends, first = word_spans(raw, offsets)
                hit = np.isin(word_hashes(raw, *_trimmed(raw, starts, ends)), wanted)
                upto = np.concatenate([[0], np.cumsum(hit)])
                rows = []
                for d in np.flatnonzero(upto[first[1:]] - upto[first[:-1]]).tolist():
                    text = batch.column("text")[d].as_py()
                    rows += [(batch.column("doc_id")[d].as_py(), *found) for found in notices_in(text, templates, set(telling), reach, coverage)]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                names = ["doc_id", "license", "start", "end", "matched", "coverage"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, license string, start long, end long, matched int, coverage double")


def _hashes(words: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(words, pa.string()))
    starts, ends, _ = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends)


def _trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without punctuation around them: ASCII letters, digits and all other scripts stay."""
    solid = raw >= 128
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        solid |= (raw >= lo) & (raw < hi)
    at = np.concatenate([np.flatnonzero(solid), [len(raw)]])
    begin = np.minimum(at[np.searchsorted(at, starts)], ends)
    before = np.concatenate([[-1], np.flatnonzero(solid)])
    return begin, np.maximum(before[np.searchsorted(before, ends) - 1] + 1, begin)


def notices_in(text: str, templates: dict[str, list[str]], telling: set[str], reach: int, coverage: float) -> list[tuple[str, int, int, int, float]]:
    """(license, start, end, matched, coverage) of all notices in a text, in order."""
    spans = [(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [w for w, _, _ in spans]
    seeds = [i for i, w in enumerate(words) if w in telling]
    found = []
    at = 0
    while at < len(seeds):
        to = at
        # Telling words that are close belong to one notice.
        while to + 1 < len(seeds) and seeds[to + 1] - seeds[to] <= 8 and seeds[to + 1] - seeds[at] <= 2 * reach:
            to += 1
        for name, template in templates.items():
            lo, hi = max(0, seeds[at] - len(template)), min(len(words), seeds[to] + len(template) + 1)
            hits = {hit for hit in [_aligned(words, lo, hi, template, coverage)] if hit}
            need, have = Counter(template), Counter(words[lo:hi])
            copies = len(hits) + 1
            if sum(min(have[w], copies * n) for w, n in need.items()) >= copies * coverage * len(template):
                hits |= _repeats(words, lo, hi, template, coverage)
            found += [(-n, -n / len(template), name, last - first, first, last) for n, first, last in hits]
        at = to + 1
    out: list[tuple[str, int, int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for matched, share, name, _, first, last in sorted(set(found)):
        if all(last < lo or first > hi for lo, hi in taken):
            taken.append((first, last))
            out.append((name, spans[first][1], spans[last][2], -matched, -share))
    return sorted(out, key=lambda r: r[1:])


def _aligned(words: list[str], lo: int, hi: int, template: list[str], coverage: float) -> tuple[int, int, int] | None:
    """(matched, first, last) of the notice in words[lo:hi]."""
    pairs = patience(words[lo:hi], template)
    if not pairs or len(pairs) < coverage * len(template):
        return None
    first, last = lo + pairs[0][0], lo + pairs[-1][0]
    # A notice is one passage: its words are not strewn over the text.
    return (len(pairs), first, last) if last - first + 1 <= 1.5 * len(template) else None


def _repeats(words: list[str], lo: int, hi: int, template: list[str], coverage: float) -> set[tuple[int, int, int]]:
    """(matched, first, last) of notices that stand so close that the words of one hide those of another.

    Exact copies are found from their first word. For the others, words that the template has once are taken until a
    notice of the wanted coverage cannot lack them all; a window reaches from the occurrence before to the one after.
    """
    size = len(template)
    wide = int(1.5 * size)
    found = {(size, i, i + size - 1) for i in range(lo, hi) if words[i] == template[0] and words[i : i + size] == template}
    whole = {i for _, first, last in found for i in range(first, last + 1)}
    often, have = Counter(template), Counter(words[lo:hi])
    once = sorted((w for w in template if often[w] == 1), key=lambda w: (have[w], w))
    for pivot in once[: int(size - coverage * size) + 1]:
        places = [i for i in range(max(0, lo - wide), min(len(words), hi + wide)) if words[i] == pivot]
        for before, i, after in zip([-1, *places], places, [*places[1:], len(words)]):
            if i not in whole and (hit := _aligned(words, max(before + 1, i - wide), min(after, i + wide), template, coverage)):
                found.add(hit)
                if hit[0] == size == hit[2] - hit[1] + 1:
                    whole.update(range(hit[1], hit[2] + 1))
    return found
