"""Licence scan: passages of whole texts that match a licence template by the Dice coefficient over word bigrams.

Words are runs of ASCII letters and digits, lower-cased. A passage is any run of words; its Dice coefficient with a
template is twice the number of shared bigrams (with their counts) over the sum of both numbers of bigrams. From
``dice >= t`` follow bounds: a passage has between ``t / (2 - t)`` and ``(2 - t) / t`` times the template's bigrams and
shares at least ``t / (2 - t)`` of them. Templates whose bounds cannot be met by a text are left out.

A high coefficient does not tell a licence from its relatives, so a template may have marks: a passage gets its name
only if it holds one of some phrases (a version, a family word) and none of others. It holds what stands between
its first and last bigram of the template.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.llm.batches import bound_batches, slices, texts_of
from tapeledger.llm.license_texts import MARKS, TEMPLATES

THRESHOLD = 0.9
_WORD = re.compile("[A-Za-z0-9]+")

FOUND = "array<struct<license:string,dice:double,start:int,end:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))


@dataclass
class Template:
    """The bounds of one wording that follow from the threshold, its bigrams by number, and its marks as word sequences."""

    name: str
    total: int
    least: int
    most: int
    bigrams: np.ndarray
    counts: np.ndarray
    needs: list[tuple[str, ...]]
    bans: list[tuple[str, ...]]


@dataclass
class Library:
    """Templates, the numbers of their bigrams, and by number the templates that hold it (``owner[begins[i]:begins[i + 1]]``).

    ``anchors`` are words of which every matching passage holds at least one.
    """

    templates: list[Template]
    numbers: dict[tuple[str, str], int]
    begins: np.ndarray
    owner: np.ndarray
    held: np.ndarray
    least: np.ndarray
    anchors: set[str]


#: Words that say little about a licence; they become anchors last.
_COMMON = frozenset("a an and any are as at by for from in is it license licensed no not of on or published released distributed available project software such terms that the this to under version with work you".split())


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _anchors(bigrams: Counter, lack: int) -> set[str]:
    """Words that cover more than ``lack`` bigrams, so that a passage which lacks no more holds one of them."""
    of: dict[str, set] = {}
    for b in bigrams:
        for w in b:
            of.setdefault(w, set()).add(b)
    chosen, covered, n = set(), set(), 0
    for word in sorted(of, key=lambda w: (w not in _COMMON and len(w) > 1, len(w), w), reverse=True):
        if n > lack:
            break
        n += sum(bigrams[b] for b in of[word] - covered)
        covered |= of[word]
        chosen.add(word)
    return chosen


def prepare(templates: dict[str, str | tuple[str, ...]], threshold: float = THRESHOLD, marks: dict[str, tuple[list[str], list[str]]] | None = None) -> Library:
    """The templates by name, one for each wording; one of less than two words cannot match and is left out.

    ``marks`` are, by name, the phrases of which a passage holds at least one and those of which it holds none.
    """
    out, numbers, anchors, seen = [], {}, set(), set()
    for name in sorted(templates):
        needs, bans = ([tuple(_words(p)) for p in phrases] for phrases in (marks or {}).get(name, ([], [])))
        for wording in [templates[name]] if isinstance(templates[name], str) else templates[name]:
            words = _words(wording)
            bigrams = Counter(zip(words, words[1:]))
            total = sum(bigrams.values())
            if not total or (name, *words) in seen:
                continue
            seen.add((name, *words))
            least = math.ceil(threshold / (2 - threshold) * total - 1e-9)
            anchors |= _anchors(bigrams, total - least)
            ids = np.array([numbers.setdefault(b, len(numbers)) for b in bigrams], np.int64)
            order = np.argsort(ids)
            out.append(Template(name, total, least, math.floor((2 - threshold) / threshold * total + 1e-9), ids[order], np.array(list(bigrams.values()), np.int64)[order], needs, bans))
    ids = np.concatenate([t.bigrams for t in out] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(out)), [len(t.bigrams) for t in out])
    order = np.argsort(ids, kind="stable")
    held = np.concatenate([t.counts for t in out] or [np.zeros(0, np.int64)])[order]
    return Library(out, numbers, np.searchsorted(ids[order], np.arange(len(numbers) + 1)), owner[order], held, np.array([t.least for t in out], np.int64), anchors)


def _candidates(library: Library, ids: np.ndarray) -> np.ndarray:
    """The templates of which a text with these bigrams may hold enough."""
    present = np.unique(ids[ids >= 0])
    sizes = library.begins[present + 1] - library.begins[present]
    at = np.repeat(library.begins[present] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    bound = np.bincount(library.owner[at], weights=library.held[at], minlength=len(library.templates))
    return np.flatnonzero(bound >= library.least)


def _places(words: list[str], where: dict[str, list[int]], phrases: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """``(first word, last word)`` of the phrases in the text, by their first word."""
    return sorted({(i, i + len(p) - 1) for p in phrases for i in where.get(p[0], ()) if tuple(words[i:i + len(p)]) == p})


def _passages(template: Template, ids: np.ndarray, words: list[str], where: dict[str, list[int]], threshold: float) -> list[tuple[float, int, int]]:
    """``(dice, first bigram, last bigram)`` of the best passages with the marks, none overlapping. A passage
    begins and ends with a bigram of the template; without marks the best ones do, else they could be cut."""
    place = np.minimum(np.searchsorted(template.bigrams, ids), len(template.bigrams) - 1)
    at = np.flatnonzero(template.bigrams[place] == ids)
    if len(at) < template.least:
        return []
    starts = np.flatnonzero(at[template.least - 1:] - at[:len(at) - template.least + 1] < template.most)
    if not len(starts):
        return []
    needs, bans = _places(words, where, template.needs), _places(words, where, template.bans)
    if template.needs and not needs:
        return []
    # a bigram is shared by the passages that begin after its n-th last place, n being the template's number of it
    last, number = np.full(len(at), -1), place[at]
    order = np.argsort(number, kind="stable")
    same = number[order]
    n = template.counts[same]
    back = np.arange(len(at)) - n
    full = (back >= 0) & (same[np.maximum(back, 0)] == same)
    last[order[full]] = order[back[full]]
    ends = np.searchsorted(at, at[starts] + template.most)
    found = []
    for s, end in zip(starts.tolist(), ends.tolist()):
        low = s
        if template.needs:
            after = [y for x, y in needs[bisect_left(needs, (at[s], 0)):]]
            if not after:
                break
            low = max(s, int(np.searchsorted(at, min(after) - 1)))
        if bans:
            behind = [y for x, y in bans[bisect_left(bans, (at[s], 0)):]]
            end = min(end, int(np.searchsorted(at, min(behind) - 1))) if behind else end
        if low >= end:
            continue
        dice = 2 * np.cumsum(last[s:end] < s) / (at[s:end] - at[s] + 1 + template.total)
        e = low + int(np.argmax(dice[low - s:]))
        if dice[e - s] >= threshold - 1e-12:
            found.append((float(dice[e - s]), int(at[s]), int(at[e])))
    kept: list[tuple[float, int, int]] = []
    for dice, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
        if all(b < c or a > d for _, c, d in kept):
            kept.append((dice, a, b))
    return kept


def find_licenses(text: str, library: Library, threshold: float = THRESHOLD) -> list[dict]:
    """The licence passages of one text by place (code points, end exclusive). A passage within one of a wording
    at least twice as long is part of that wording. Of overlapping ones that with the larger coefficient stays, then the
    longer, then the first by name."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    if len(words) < 2:
        return []
    ids = np.fromiter((library.numbers.get(b, -1) for b in zip(words, words[1:])), np.int64, len(words) - 1)
    where: dict[str, list[int]] = {}
    some = _candidates(library, ids)
    if len(some):
        for i, w in enumerate(words):
            where.setdefault(w, []).append(i)
    found = []
    for i in some:
        t = library.templates[i]
        found += [(dice, a, b, t.name, t.total) for dice, a, b in _passages(t, ids, words, where, threshold)]
    longer = [f for f in found if f[4] >= 2 * min(f[4] for f in found)]
    found = [f for f in found if not any(k[1] <= f[1] and f[2] <= k[2] and k[4] >= 2 * f[4] for k in longer)]
    kept: list[tuple[float, int, int, str, int]] = []
    for f in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[3], f[1])):
        if all(f[2] < k[1] or f[1] > k[2] for k in kept):
            kept.append(f)
    return [{"license": name, "dice": dice, "start": spans[a][0], "end": spans[b + 1][1]} for dice, a, b, name, _ in sorted(kept, key=lambda k: k[1])]


def scan_licenses(documents: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, threshold: float = THRESHOLD, text_col: str = "text", found_col: str = "licenses") -> DataFrame:
    """``documents`` without the text and with ``found_col``, the licence passages of every whole text.

    Texts that hold no anchor word are passed over after one search. Null and empty texts, and texts of one word, have
    no passages; every row stays, repeated ones too; a column named like ``found_col`` is replaced.
    """
    bound_batches(documents.sparkSession)
    prepared = prepare(TEMPLATES, threshold, MARKS) if templates is None else prepare(templates, threshold)
    library = documents.sparkSession.sparkContext.broadcast(prepared)  # of fixed size: the bigrams of the templates
    anchors = f"(?:^|[^A-Za-z0-9])(?:{'|'.join(sorted(prepared.anchors))})(?:[^A-Za-z0-9]|$)" if prepared.anchors else "[^\\x00-\\x{10FFFF}]"
    rest = [c for c in documents.columns if c not in (text_col, found_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = texts_of(batch, text_col)
            hold = pc.match_substring_regex(texts, anchors, ignore_case=True).to_pylist()
            found = pa.array([find_licenses(t.as_py(), library.value, threshold) if h else [] for t, h in zip(texts, hold, strict=True)], _FOUND_TYPE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found], [*rest, found_col])

    kept = documents.select(*rest, text_col)
    return kept.mapInArrow(run, kept.select(*rest, F.lit(None).cast(FOUND).alias(found_col)).schema)
