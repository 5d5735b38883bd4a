"""Token ids of whole texts by a byte-level BPE vocabulary file, a batch at a time.

A batch's texts are cut into pre-tokens by numpy over their code points (the cuts are those of the vocabulary's own
pattern), distinct pre-tokens are encoded once by the tokenizers library, and the ids are gathered back. Texts in
which the vocabulary's added tokens are spelled out go through the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioground.llm.base import chunks, texts_of

#: Pre-tokens that a Python worker remembers, at most; forgetting only costs time.
REMEMBERED = 1_000_000
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 0
_CLASSES = {_LETTER: r"\p{L}+", _NUMBER: r"\p{N}+", _BLANK: r"\s+"}
#: What the pattern cuts off after an apostrophe.
_SHORT = [("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l")]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, by the same regular expressions."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in _CLASSES.items():
        for m in regex.finditer(pattern, every):
            out[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    return out


class Encoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        plain = [p for p in pieces if not p.isspace()]
        # Many pre-tokens in one text, a line each: the pattern cuts at the line ends.
        groups = [plain[i: i + 100] for i in range(0, len(plain), 100)]
        for group, made in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) + "\n" for g in groups], add_special_tokens=False)):
            ids = np.array(made.ids, np.uint32)
            ends = np.flatnonzero(ids == self.newline[0])
            for piece, low, high in zip(group, np.concatenate([[0], ends[:-1] + 1]), ends):
                self.known[piece] = ids[low:high].tobytes()
        for piece in pieces:
            if piece.isspace():
                self.known[piece] = self._whole(piece).tobytes()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``first`` are the places of the texts' first code points."""
        kind = _classes()[points]
        n = len(points)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start[first] = True
        end_of_text = np.zeros(n + 1, bool)
        end_of_text[first], end_of_text[n] = True, True
        # The last blank before a word stands alone, or goes with the word if it is a space.
        last_blank = (kind == _BLANK) & ~end_of_text[1:]
        last_blank[:-1] &= kind[1:] != _BLANK
        start |= last_blank
        with_word = np.flatnonzero(last_blank & (points == 32)) + 1
        start[with_word] = False
        # 's 't 'm 'd 're 've 'll, where an apostrophe starts a pre-token by itself.
        quote = np.flatnonzero((points == 39) & start)
        if len(quote):
            padded = np.concatenate([points, np.zeros(3, points.dtype)])
            ends = np.flatnonzero(np.concatenate([end_of_text, [True, True]]))
            limit = ends[np.searchsorted(ends, quote, "right")]
            for tail in _SHORT:
                fits = quote[(quote + len(tail) < limit) & np.logical_and.reduce([padded[quote + 1 + i] == ord(c) for i, c in enumerate(tail)])]
                start[fits + 1] = False
                after = fits + 1 + len(tail)
                start[after[after < n]] = True
        return np.flatnonzero(start)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all rows end to end, and the place of each row in them."""
        ids, counts = [np.zeros(0, np.uint32)], []
        data, at = texts_of(column)
        for low, high in chunks(at):
            part = pc.fill_null(column.slice(low, high - low), "")
            spelled = np.zeros(high - low, bool)
            for token in self.added:
                spelled |= np.array(pc.match_substring(part, token))
            if spelled.any():  # one row at a time where needed
                made = [self._whole(row) if own else self.encode(pa.array([row]))[0] for row, own in zip(part.to_pylist(), spelled)]
                ids += made
                counts += [len(x) for x in made]
                continue
            text = data[at[low]: at[high]]
            lengths = np.array(pc.utf8_length(part)).astype(np.int64)
            counts_here = np.zeros(high - low, np.int64)
            if len(text):
                points = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
                row_end = np.cumsum(lengths)
                first = (row_end - lengths)[lengths > 0]
                starts = self._starts(points, first)
                width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
                bytes_before = np.concatenate([[0], np.cumsum(width)])
                offsets = bytes_before[np.append(starts, len(points))].astype(np.int64)
                pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(text)).dictionary_encode()
                distinct = pieces.dictionary.to_pylist()
                unknown = [p for p in distinct if p not in self.known]
                if unknown:
                    before = len(self.known)
                    self._learn(unknown)
                    if len(self.known) < before:  # forgotten meanwhile
                        self._learn([p for p in distinct if p not in self.known])
                found = [self.known[p] for p in distinct]
                table = np.frombuffer(b"".join(found), np.uint32)
                size = np.array([len(x) // 4 for x in found])
                base = np.cumsum(size) - size
                which = np.array(pieces.indices)
                each = size[which]
                ends = np.cumsum(each)
                take = np.arange(ends[-1]) + np.repeat(base[which] - (ends - each), each)
                ids.append(table[take])
                upto = np.concatenate([[0], ends])[np.searchsorted(starts, row_end)]
                counts_here = np.diff(upto, prepend=0)
            counts += counts_here.tolist()
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder; its memory of pre-tokens lasts from task to task."""
    return Encoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` after each row."""
    rows = len(offsets) - 1
    return np.insert(ids, offsets[1:], end), offsets + np.arange(rows + 1)
