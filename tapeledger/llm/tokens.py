"""Token ids of whole texts by a public tokenizer, with every distinct piece of text encoded once per worker.

A text is cut where the tokenizer itself always begins a new piece, the pieces of a batch are made distinct by Arrow,
and the ids of the distinct pieces are put together again. The result is that of encoding each text as a whole.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word parts a worker remembers, at most; longer ones are encoded each time.
MOST_PARTS, LONGEST_PART = 400_000, 60

#: The white space of the tokenizers' patterns.
_SPACE = "\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"


class PieceTokenizer:
    """Encodes Arrow texts to ids; ``definition`` is the content of a tokenizer file of the ``tokenizers`` library.

    A tokenizer with a normaliser drops white space but for its splitting words (``word_bpe``); one without lets a
    space belong to the word after it (byte-level BPE). The strings of added tokens become their ids, as in the
    library's own call.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(definition)
        self.drops_space = self.tokenizer.normalizer is not None
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: shown.pre_tokenize_str(chr(i))[0][0] for i in range(1, 256)}  # how the model's vocabulary writes each character
        self.parts: dict[str, bytes] = {}
        space = "" if self.drops_space else " ?"
        self.simple = re.compile(f"({space}[{_LETTERS}]+)([.,;:!?|%#$*&]*)")
        self.runs = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")
        #: Texts that are encoded whole: a space within white space, or what only one side takes for white space.
        self.odd = "[\x1c-\x1f]" if self.drops_space else f"[{_SPACE}] (?:[{_SPACE}]|$)|^ (?:[{_SPACE}]|$)"
        for token in self.tokenizer.get_added_tokens_decoder().values():  # or that hold the string of an added token
            self.odd += "|" + re.escape(token.content)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, part: str, whole: bool) -> bytes:
        ids = self.whole(part) if whole else array("I", [t.id for t in self.tokenizer.model.tokenize(part.translate(self.shown))]).tobytes()
        if len(part) <= LONGEST_PART:
            if len(self.parts) >= MOST_PARTS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def pieces(self, names: list[str], lead: str = "") -> list[bytes]:
        """The ids of each piece, ``lead`` put before it. Letters of Latin-1 and the punctuation after them are looked
        up apart: the tokenizer never joins them."""
        known, new, split, out = self.parts.get, self._new, self.simple.fullmatch, []
        for name in names:
            if not name:
                out.append(known(lead) or new(lead, True) if lead else b"")
                continue
            piece = lead + name
            m = split(piece)
            if m is None:
                if self.drops_space or "\n" not in piece:
                    out.append(known(piece) or new(piece, True))
                else:
                    found = [(x, split(x)) for x in self.runs.findall(piece)]
                    out.append(b"".join([(known(x) or new(x, True)) if y is None else (known(y[1]) or new(y[1], False)) + ((known(y[2]) or new(y[2], False)) if y[2] else b"") for x, y in found]))
                continue
            word, tail = m.groups()
            if self.drops_space:
                word = word.lower()
            ids = known(word) or new(word, False)
            out.append(ids + (known(tail) or new(tail, False)) if tail else ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)``: the ids of text ``i`` are ``ids[offsets[i]:offsets[i + 1]]``."""
        n = len(texts)
        lists = pc.utf8_split_whitespace(texts) if self.drops_space else pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        pieces, rows = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_pylist()
        if self.drops_space:
            table = self.pieces(names)
        else:  # the first piece of a text has no space before it
            first = np.ones(len(rows), bool)
            first[1:] = rows[1:] != rows[:-1]
            begins, at = np.unique(code[first], return_inverse=True)
            table = self.pieces(names, " ") + self.pieces([names[c] for c in begins])
            code[first] = len(names) + at
        size = np.fromiter(map(len, table), np.int64, len(table)) >> 2
        flat = np.frombuffer(b"".join(table), np.uint32)
        begin = np.cumsum(size) - size
        count = size[code]
        ends = np.cumsum(count)
        ids = flat[np.repeat(begin[code] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, count, n).astype(np.int64))]).astype(np.int64)
        if len(odd):
            parts = [ids[offsets[i]:offsets[i + 1]] for i in range(n)]
            for i in odd:
                parts[i] = np.frombuffer(self.whole(texts[i].as_py()), np.uint32)
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return offsets, ids


@functools.lru_cache(maxsize=2)
def piece_tokenizer(definition: str) -> PieceTokenizer:
    """One per worker process and tokenizer, so that what it remembers serves all tasks of the worker."""
    return PieceTokenizer(definition)


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every text followed by the end id."""
    return offsets + np.arange(len(offsets)), np.insert(ids, offsets[1:], np.uint32(end))
