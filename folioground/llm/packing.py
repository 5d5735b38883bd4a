"""Packing examples into training sequences: vector bin packing with a dot-product heuristic.

Every sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. An example's ids that
bear loss are those from some place to its end (the answer of an instruction; all of a plain document). Examples
longer than a sequence are cut into full sequences first; what is left of each example, and every shorter example,
is placed as a whole into the sequence being filled: the example next is the one whose demand (tokens, 1 segment,
loss tokens, each as a share of the limit) has the largest dot product with what the sequence still offers. When
nothing fits whole and cutting is allowed, the example of the largest dot product is cut to what still fits. The
last sequence of a batch is cut at powers of two, so that it needs no padding either.

Rows are packed where they lie, a batch of input rows at a time: nothing is shuffled or gathered, a batch bounds the
memory, and a batch leaves at most a handful of short sequences. Sequence ids are unique, not gapless.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each by itself; a limit of loss
tokens or segments that a sequence reaches early closes it, and the rest is padding, unless its length is a power of two; an
empty table gives no rows; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioground.llm.tokens import encoder, with_end


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


def place(lengths: np.ndarray, loss_from: np.ndarray, limits: Limits) -> list[np.ndarray]:
    """Arrays (example, start, length, sequence, offset) of one batch; ``loss_from``: place of the first id with loss.

    Examples are kept in classes of equal remaining (tokens, loss tokens), so that a choice is one dot product over
    the classes that are left, not over all examples.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    start = np.zeros(len(lengths), np.int64)
    if limits.loss_tokens >= limits.tokens:
        for i in np.flatnonzero(lengths >= limits.tokens):  # full sequences
            while lengths[i] - start[i] >= limits.tokens:
                out.append((i, start[i], limits.tokens, sequence, 0))
                start[i] += limits.tokens
                sequence += 1
    classes: dict[tuple[int, int], list[int]] = {}

    def add(i: int) -> None:
        left = int(lengths[i] - start[i])
        if left:
            classes.setdefault((left, int(lengths[i] - max(start[i], loss_from[i]))), []).append(i)

    for i in range(len(lengths)):
        add(i)
    shapes = np.array(list(classes), float).reshape(-1, 2)
    alive = np.ones(len(shapes), bool)

    def choose(free: np.ndarray) -> tuple[tuple[int, int], bool] | None:
        nonlocal shapes, alive
        if alive.sum() * 2 < len(shapes):
            shapes, alive = shapes[alive], alive[alive]
        if free[1] < 1 or not alive.any():
            return None
        score = (shapes[:, 0] * free[0] / cap[0] ** 2 + free[1] / cap[1] ** 2 + shapes[:, 1] * free[2] / cap[2] ** 2) * alive
        fits = (shapes[:, 0] <= free[0]) & (shapes[:, 1] <= free[2]) & alive
        at = int(np.argmax(np.where(fits, score, -1.0))) if fits.any() else int(np.argmax(np.where(alive, score, -1.0)))
        return (int(shapes[at, 0]), int(shapes[at, 1])), bool(fits[at]), at

    def close(pieces: list[tuple[int, int, int]]) -> None:
        """Write a sequence; one that is short is cut at powers of two, as far as the pieces allow."""
        nonlocal sequence
        total = sum(n for _, _, n in pieces)
        room, offset = total if total == limits.tokens else 1 << (total.bit_length() - 1), 0
        for i, s, n in pieces:
            while n:
                take = min(n, room - offset)
                out.append((i, s, take, sequence, offset))
                s, n, offset, total = s + take, n - take, offset + take, total - take
                if offset == room and total:
                    sequence, offset, room = sequence + 1, 0, 1 << (total.bit_length() - 1)
        sequence += 1

    while alive.any():
        free, pieces = cap.copy(), []
        while free[0] > 0 and (found := choose(free)):
            shape, fits, at = found
            i = classes[shape].pop()
            if not classes[shape]:
                del classes[shape]
                alive[at] = False
            left, loss = shape
            take = left
            if not fits:
                quiet = left - loss
                take = int(min(left, free[0], quiet + free[2]))
                if take <= 0:
                    add(i)
                    if shape in classes and not alive[at]:
                        alive[at] = True
                    break
            begin = int(start[i])
            pieces.append((i, begin, take))
            start[i] += take
            used = max(0, begin + take - max(begin, int(loss_from[i])))
            free -= (take, 1, used)
            if take < left:
                rest = (int(lengths[i] - start[i]), int(lengths[i] - max(start[i], loss_from[i])))
                if rest not in classes:
                    shapes, alive = np.vstack([shapes, rest]), np.append(alive, True)
                add(i)
        close(pieces)
    return [np.array(c, np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def pack(examples: DataFrame, vocabulary: str, end: int, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", prompt: str | None = None) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, loss_tokens, sequence_id, offset) of all examples.

    An example is the ids of ``prompt``, which bear no loss, of ``text`` and ``end``. ``ids`` are little-endian
    unsigned 32-bit integers.
    """
    kind = dict(examples.dtypes)[key]

    def run(batches):
        tool, number = encoder(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, offsets = with_end(*tool.encode(batch.column(1)), end)
            quiet = np.zeros(len(batch), np.int64)
            if prompt:
                first, at = tool.encode(batch.column(2))
                quiet = np.diff(at)
                both = [x for i in range(len(batch)) for x in (first[at[i]: at[i + 1]], ids[offsets[i]: offsets[i + 1]])]
                ids, offsets = np.concatenate([np.zeros(0, np.uint32), *both]), offsets + at
            lengths = np.diff(offsets)
            i, start, length, sequence, offset = place(lengths, quiet, limits)
            begin = offsets[i] + start
            cuts = np.concatenate([[0], np.cumsum(length)])
            take = np.arange(cuts[-1]) + np.repeat(begin - cuts[:-1], length)
            data = ids[take].astype("<u4").tobytes()
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(cuts * 4), pa.py_buffer(data)]).cast(pa.binary())
            loss = np.maximum(0, start + length - np.maximum(start, quiet[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(i)), pa.array(start), pa.array(length), pieces, pa.array(lengths[i]), pa.array(loss), pa.array(sequence + number), pa.array(offset)],
                ["key", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])
            number += int(sequence.max() + 1) if len(sequence) else 0

    columns = [F.col(key), F.col(text), *([F.col(prompt)] if prompt else [])]
    packed = examples.select(*columns).mapInArrow(run, f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("key", key)
