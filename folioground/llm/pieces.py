"""SentencePiece encoding and decoding, in numpy, with the ids of the model's own kind.

Unigram models: of all ways to cut a text into pieces of the model file, the one with the highest sum of scores is taken, by
batched Viterbi. BPE models: the pair of neighbours whose merged piece has the highest score is merged, the leftmost of equals,
until no pair makes a piece. Characters that are in no piece become byte pieces. No piece reaches from a character
into a following word mark, so a text falls into words that are best cut each for itself. Distinct words are cut once:
words of equal length advance together. For Viterbi they advance one place at a time; hashes of all their substrings of a
length are probed in the sorted hashes of the pieces of that length, hits are compared character by character, and vectorised
maxima store back-pointers. Sums are in double precision: the longest last piece wins a tie (the library adds in single
precision). For BPE they advance one merge at a time; all pairs are probed in the sorted pairs that make a piece. Words above
``LONG`` characters, as texts without spaces have them, are merged from a heap.

Defined cases: null and empty texts have no pieces and decode to the empty text; a text that holds the word mark U+2581
itself decodes with spaces there, as the format has it; repeated rows are encoded alike; an empty table gives no
rows; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioground.llm.base import chunks, mixed, texts_of

MARK = "▁"
#: Kinds of pieces in a model file, and what an unknown character costs below the lowest score. Fixed values.
NORMAL, UNKNOWN, BYTE, USER_DEFINED, UNUSED = 1, 2, 6, 4, 5
UNKNOWN_PENALTY = 10.0
#: Words of one length that advance together, and words that a Python worker remembers; forgetting only costs time.
TOGETHER, REMEMBERED = 2048, 300_000
#: Kinds of models, and the length in characters above which a word is merged by itself.
UNIGRAM, BPE = 1, 2
LONG = 64


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            size, i = _varint(b, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = b[i: i + size], i + size
        yield tag >> 3, value


class Pieces:
    """The pieces of a model file: ids, scores, and their characters by length. Cuts words by the highest sum of scores."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.text, score, kind, self.dummy, self.model_type = [], [], [], True, UNIGRAM
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                self.text.append(own[1].decode())
                score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kind.append(own.get(3, NORMAL))
            elif number == 2:
                self.model_type = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without text normalisation are supported")
                self.dummy = bool(spec.get(3, 1))
        used = [i for i, k in enumerate(kind) if k in (NORMAL, USER_DEFINED)]
        if any(re.search(f"[^{MARK}]{MARK}", self.text[i]) for i in used):
            raise ValueError("a piece reaches over a word mark")
        if BYTE not in kind:
            raise ValueError("only models with byte pieces are supported")
        self.kind = kind
        self.byte = np.zeros(256, np.int64)
        for i, k in enumerate(kind):
            if k == BYTE:
                self.byte[int(self.text[i][3:5], 16)] = i
        ordinary = [x for x, k in zip(score, kind) if k == NORMAL]
        self.unknown_score = min(ordinary) - UNKNOWN_PENALTY
        # Such pieces are taken before all others, as the library does.
        score = [len(t.encode()) * max(ordinary) - 0.1 if k == USER_DEFINED else x for t, x, k in zip(self.text, score, kind)]
        characters = sorted({c for i in used for c in self.text[i]})
        self.code = np.zeros(0x110000, np.int32)  # of characters; 0: in no piece
        self.code[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.characters = np.array([0, *map(ord, characters)])
        self.by_length = {}
        for n in sorted({len(self.text[i]) for i in used}):
            own = np.array([i for i in used if len(self.text[i]) == n])
            codes = self.code[np.array([[ord(c) for c in self.text[i]] for i in own])]
            key = self._keys(codes, n)[:, 0]
            order = np.argsort(key)
            self.by_length[n] = key[order], codes[order], own[order], np.array(score)[own[order]]
        # What each piece decodes to.
        out = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k not in (NORMAL, USER_DEFINED) else t.replace(MARK, " ").encode() for t, k in zip(self.text, kind)]
        self.size = np.array([len(x) for x in out])
        self.base = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _keys(codes: np.ndarray, n: int) -> np.ndarray:
        """Hash of every substring of ``n`` characters of each row."""
        width = codes.shape[1] - n + 1
        key = np.zeros((len(codes), width), np.uint64)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[:, i: i + width].astype(np.uint64)
        return mixed(key)

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words of one length: the best ``counts`` ids of each stand at the right of its row.
        -1 - c stands for the character of code c, unknown by itself."""
        rows, length = codes.shape
        score = np.full((rows, length + 1), -np.inf)
        score[:, 0] = 0
        last, piece = np.zeros((rows, length + 1), np.int32), np.zeros((rows, length + 1), np.int64)
        found = {}
        for n, (keys, own, ids, scores) in self.by_length.items():
            if n <= length:
                wanted = self._keys(codes, n)
                at = np.searchsorted(keys, wanted)
                at[at == len(keys)] = 0
                hit = keys[at] == wanted
                r, c = np.nonzero(hit)
                same = (codes[r[:, None], c[:, None] + np.arange(n)] == own[at[r, c]]).all(axis=1)
                hit[r[~same], c[~same]] = False
                found[n] = hit, at
        for end in range(1, length + 1):
            for n in sorted((n for n in self.by_length if n <= end), reverse=True):
                hit, at = found[n]
                start = end - n
                _, _, ids, scores = self.by_length[n]
                candidate = np.where(hit[:, start], score[:, start] + scores[at[:, start]], -np.inf)
                if n == 1:
                    lone = ~hit[:, start]
                    candidate = np.where(lone, score[:, start] + self.unknown_score, candidate)
                better = candidate > score[:, end]
                score[better, end] = candidate[better]
                last[better, end] = n
                piece[better, end] = ids[at[better, start]]
                if n == 1:
                    piece[better & lone, end] = -1 - codes[better & lone, start]
        # Back from the ends, all words at once; the last piece of a word goes to the last column.
        cut, place, column = np.zeros((rows, length), np.int64), np.full(rows, length), length
        used = np.zeros(rows, np.int64)
        while (active := np.flatnonzero(place > 0)).size:
            column -= 1
            cut[active, column] = piece[active, place[active]]
            place[active] -= last[active, place[active]]
            used[active] += 1
        return cut[:, column:], used

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        text = b"".join(words).decode()
        codes = self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        lengths = np.array([len(w.decode()) for w in words])
        first = np.cumsum(lengths) - lengths
        lone = codes[first] == 0  # one unknown character
        for i in np.flatnonzero(lone):
            self.known[words[i]] = self.byte[list(words[i])].astype(np.uint32).tobytes()
        rest = np.flatnonzero(~lone)
        rest = rest[np.argsort(lengths[rest], kind="stable")]
        for group in np.split(rest, np.flatnonzero(np.diff(lengths[rest])) + 1):
            for low in range(0, len(group), TOGETHER):
                part = group[low: low + TOGETHER]
                cut, used = self.best(codes[first[part][:, None] + np.arange(lengths[part[0]])])
                for i, row, signed, n, odd in zip(part, cut.astype(np.uint32), cut, used, (cut < 0).any(axis=1)):
                    self.known[words[i]] = self._with_bytes(signed, n) if odd else row[len(row) - n:].tobytes()

    def _with_bytes(self, row: np.ndarray, n: int) -> bytes:
        """Stored ids of a word, unknown characters as bytes."""
        parts = [self.byte[list(chr(self.characters[-1 - p]).encode())] if p < 0 else [p] for p in row[len(row) - n:]]
        return np.concatenate(parts).astype(np.uint32).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all rows."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        _, at = texts_of(column)
        for low, high in chunks(at):
            marked = [(MARK if self.dummy else "") + t.replace(" ", MARK) if t else "" for t in column.slice(low, high - low).to_pylist()]
            text = "".join(marked)
            row_end = np.cumsum([len(t) for t in marked])
            if not text:
                counts.append(np.zeros(high - low, np.int64))
                continue
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            mark, alone = points == ord(MARK), self.code[points] == 0
            start = np.ones(len(points), bool)
            start[1:] = (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
            start[row_end[row_end < len(points)]] = True
            starts = np.flatnonzero(start)
            width = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
            before = np.concatenate([[0], np.cumsum(width)])
            raw = text.encode()
            offsets = before[np.append(starts, len(points))].astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            if len(self.known) + len(distinct) > REMEMBERED:
                self.known.clear()
            self._learn([w for w in distinct if w not in self.known])
            found = [self.known[w] for w in distinct]
            table, size = np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found])
            out, each = gathered(table, np.cumsum(size) - size, size, np.array(words.indices))
            ids.append(out)
            upto = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, row_end)]
            counts.append(np.diff(upto, prepend=0))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids, without the word mark that encoding puts before it."""
        out, _ = gathered(self.bytes, self.base, self.size, ids)
        text = out.tobytes()
        return text[1:] if self.dummy and text[:1] == b" " else text


class Merges(Pieces):
    """The pieces of a BPE model file. Cuts words by merging pairs of neighbours in the order of scores."""

    def __init__(self, path: str):
        super().__init__(path)
        if UNUSED in self.kind:
            raise ValueError("BPE models with unused pieces are not supported")
        # User-defined pieces stand wherever their text does, the longest first, and merge with nothing.
        own = sorted((t for t, k in zip(self.text, self.kind) if k == USER_DEFINED), key=len, reverse=True)
        self.fixed = {t.encode(): np.uint32(i).tobytes() for i, (t, k) in enumerate(zip(self.text, self.kind)) if k == USER_DEFINED}
        self.split = re.compile(b"(%s)" % b"|".join(re.escape(t.encode()) for t in own)) if own else None
        # Symbols: pieces by id, then the characters that are no piece by themselves, by code.
        symbol, pieces, score = {}, len(self.text), np.zeros(len(self.text))
        for _, _, ids, scores in self.by_length.values():
            score[ids] = scores
            symbol |= {self.text[i]: int(i) for i in ids if self.kind[i] == NORMAL}
        self.symbol = np.zeros(len(self.characters), np.int64)
        for code in range(1, len(self.characters)):
            self.symbol[code] = symbol.setdefault(chr(self.characters[code]), pieces + code)
        self.symbols = pieces + len(self.characters)
        pairs = []
        for _, _, ids, _ in self.by_length.values():
            for i in ids:
                t = self.text[i] if self.kind[i] == NORMAL else ""
                pairs += [(x, y, int(i)) for at in range(1, len(t)) if (x := symbol.get(t[:at])) is not None and (y := symbol.get(t[at:])) is not None]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        order = np.argsort(left * self.symbols + right)
        # After the last pair stands one that no pair equals.
        self.pairs = np.append((left * self.symbols + right)[order], np.iinfo(np.int64).max)
        self.made = np.append(made[order], 0)
        rank = np.unique(-score, return_inverse=True)[1]
        self.rank = np.append(rank[made[order]], 0)
        self.never = len(self.text)

    def _learn(self, words: list[bytes]) -> None:
        cut = {w: [x for x in self.split.split(w) if x] for w in words if self.split.search(w)} if self.split else {}
        super()._learn(list({x: None for w in words for x in cut.get(w, [w]) if x not in self.fixed and x not in self.known}))
        for w, parts in cut.items():
            self.known[w] = b"".join(self.fixed.get(x) or self.known[x] for x in parts)

    def _probed(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs; ``never`` where they make no piece."""
        wanted = left * self.symbols + right
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.rank[at], self.never), self.made[at]

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, length = codes.shape
        symbols = self.symbol[codes]
        used = np.full(rows, length)
        if length > LONG:
            for r in range(rows):
                own = self._merged(symbols[r])
                used[r] = len(own)
                symbols[r, length - len(own):] = own
        elif length > 1:
            rank, made = self._probed(symbols[:, :-1], symbols[:, 1:])
            live, now = np.arange(rows), symbols.copy()
            while True:
                each = np.arange(len(live))
                at = rank.argmin(axis=1)
                more = rank[each, at] < self.never
                done = live[~more]
                width = now.shape[1]
                symbols[done, length - width:] = now[~more]
                used[done] = width
                live, now, rank, made, at = live[more], now[more], rank[more], made[more], at[more]
                if not len(live):
                    break
                each = np.arange(len(live))
                now[each, at] = made[each, at]
                # The right one of the pair goes; all rows have the same width, as each has one merge a turn.
                stay = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
                now = np.take_along_axis(now, stay, axis=1)
                width -= 1
                stay = np.arange(width - 1) + (np.arange(width - 1) >= at[:, None])
                rank, made = np.take_along_axis(rank, stay, axis=1), np.take_along_axis(made, stay, axis=1)
                if width == 1:
                    symbols[live, -1], used[live] = now[:, 0], 1
                    break
                for shift in (-1, 0):
                    r = np.flatnonzero((at + shift >= 0) & (at + shift < width - 1))
                    c = at[r] + shift
                    rank[r, c], made[r, c] = self._probed(now[r, c], now[r, c + 1])
        return np.where(symbols >= len(self.text), len(self.text) - 1 - symbols, symbols), used

    def _merged(self, word: np.ndarray) -> np.ndarray:
        """Symbols of one long word after all merges."""
        symbols, n = word.tolist(), len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, made = self._probed(word[:-1], word[1:])
        heap = [(int(rank[i]), int(i), symbols[i], symbols[i + 1], int(made[i])) for i in np.flatnonzero(rank < self.never)]
        heapq.heapify(heap)
        known = {(x, y): (k, m) for k, _, x, y, m in heap}

        def push(i: int, j: int) -> None:
            pair = symbols[i], symbols[j]
            if pair not in known:
                k, m = self._probed(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = int(k[0]), int(m[0])
            k, m = known[pair]
            if k < self.never:
                heapq.heappush(heap, (k, i, *pair, m))

        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since then
            symbols[i], symbols[j], after[i] = piece, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in symbols if x >= 0], np.int64)


def gathered(table: np.ndarray, base: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``which`` of a table of entries of different size, end to end, and their sizes."""
    each = size[which]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.arange(total) + np.repeat(base[which] - (ends - each), each)], each


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """The model of a file, by its kind."""
    tool = Pieces(path)
    if tool.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Merges(path) if tool.model_type == BPE else tool


def encode(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``ids`` (little-endian unsigned 32-bit) and ``n_pieces`` of every whole text."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    def run(batches):
        tool = pieces(model)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                ids, offsets = tool.encode(part.column(len(keep)))
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], stored, pa.array(np.diff(offsets))], [*keep, "ids", "n_pieces"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, ids binary, n_pieces bigint")


def decode(encoded: DataFrame, model: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``text``; bytes that are no UTF-8 become the replacement character."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in encoded.select(*keep).dtypes)

    def run(batches):
        tool = pieces(model)
        for batch in batches:
            made = [tool.decode(np.frombuffer(x or b"", "<u4")).decode(errors="replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.string())], [*keep, "text"])

    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, f"{kinds}, text string")
