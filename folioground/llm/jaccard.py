"""N-gram Jaccard join by pigeonholes over a partitioned universe.

A document is the set of hashes of its distinct ``k``-word shingles. Two sets r and s whose Jaccard similarity
reaches 3/4 differ in at most (|r| + |s|) / 7 elements. The universe of hashes is cut into m segments, m by size
band, so that the differences fall into pigeonholes: whenever tolerances v_i of -1 (segment not used), 0 (subsets
equal) or 1 (subsets differ in one element) are given to the segments with sum(v_i + 1) above that bound, one
segment at least keeps within its tolerance. Every set indexes its subset of each segment and, in the segments
where a tolerance of 1 may be given, the subsets with one element left out. Sets count how many others share each
subset they could probe with, and give the tolerances where that is cheapest: subsets that many sets share (empty
ones, those that a common passage fills) are passed over as long as others, with a tolerance of 1, make up for them.

Before that, one part of the universe as a whole serves as the first segment: a set with more than a quarter of
its size in elements there that no other set has can have no partner, and does not go on. Of the sets that do, the
elements of one set alone are differences for certain: they are counted, taken off the bound, and left out. All
this is exact.

Equal sets become one class first. In a group of sets with an equal subset, each round tries only the pairs with
one leader and joins what it confirms; pairs that are already linked through others need no test, so thousands of
near copies cost about as many tests as there are sets. What then remains across different components meets by its
subsets; pairs that parity sketches of their elements already prove too different are not formed, the others are
tested exactly. Nothing is capped or sampled.

Shingles, and classes of equal sets, are identified by 64-bit hashes.

Defined cases: null and empty texts, and texts of white space, have the empty set and link with nothing, not with
each other; repeated rows and exact copies are one class, one result row for each input row; a null doc_id keeps
its row and its links, and does not become a ``component_id`` unless nothing else is there (then null); an empty
table gives no rows; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioground.llm.base import NOT_BLANK, Words, chunks, components, drop_staged, mixed, staged, texts_of, unused, window_hashes

#: Share of the universe that makes the first segment; small sets take half of it, as theirs varies more.
SHARE, SHARE_SMALL, SMALL = 0.30, 0.50, 192
INDEX, INDEX_LESS, PROBE, PROBE_ONE, PROBE_LESS = 1, 2, 4, 8, 16
#: While more pairs than this for each set are left to test, leaders join components first, for some rounds.
PAIRS_A_SET, ROUNDS = 50, 3
#: 64-bit words of a set's parity sketch.
SKETCH = 8
#: Elements of a block, within which sets are compared before anything moves, and about how many meet in a bucket.
BLOCK = BUCKET = 1 << 19
#: Elements that make a task worth while: what a table with fewer to a partition holds is worked on by fewer tasks.
TASK = 1 << 17
#: About how many bytes of text there are for each shingle; only the number of buckets follows from it.
BYTES = 6
#: Bits for each wanted row in the filter of the texts, and those of the filter at most (16 MB); with fewer it lets more texts through.
FILTER, FILTER_MOST = 16, 1 << 27


# -- sets -------------------------------------------------------------------------------------------------------

def _sets_by_chunk(column: pa.Array, k: int):
    """Sorted distinct shingle hashes of each whole text of a batch, in row order, those of some MB of text at a time."""
    data, offsets = texts_of(column)
    for low, high in chunks(offsets):
        words = Words(data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low], NOT_BLANK)
        windows, found = window_hashes(words.hash, k), []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= k:
                s = windows[a: b - k + 1]
                s.sort()  # windows that cross texts lie between
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                found.append(s[new])
            elif b > a:
                found.append(window_hashes(words.hash[a:b], b - a))
            else:
                found.append(np.zeros(0, np.uint64))
        yield found


def _sets(column: pa.Array, k: int):
    for found in _sets_by_chunk(column, k):
        yield from found


def _class_of(s: np.ndarray) -> int:
    return int((mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)) if len(s) else 0


def _classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """``_class_of`` each of several sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    if sizes.any():
        out[sizes > 0] = np.add.reduceat(mixed(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(sizes) - sizes)[sizes > 0])
    return (out + sizes.view(np.uint64)).view(np.int64)


def _in_first(s: np.ndarray, share: float) -> np.ndarray:
    """Those of sorted elements that lie in the first segment."""
    return s[: np.searchsorted(s, np.uint64(int(share * (1 << 24)) << 40))]


def document_classes(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set_id, text_hash) of every row; ``set_id`` is equal for equal sets."""
    return _classes(_told(docs, k, key, text, 0))


def _classes(told: DataFrame) -> DataFrame:
    return told.where("bucket is null").select("key", "n_shingles", "set_id", "text_hash")


# -- elements that sets share -------------------------------------------------------------------------------------

class _Block:
    """Sets that wait until they have about ``BLOCK`` elements."""

    def __init__(self):
        self.held, self.owners, self.size = [], [], 0

    def add(self, set_id: int, s: np.ndarray) -> None:
        if len(s):
            self.held.append(s)
            self.owners.append(set_id)
            self.size += len(s)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements in order, their owners, where each distinct element begins."""
        h, o = np.concatenate(self.held), np.repeat(np.array(self.owners, np.int64), [len(s) for s in self.held])
        self.__init__()
        order = np.argsort(h)
        h = h[order]
        return h, o[order], np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


def _blocks(sets):
    """Blocks of (set_id, elements)."""
    block = _Block()
    for set_id, s in sets:
        block.add(set_id, s)
        if block.size >= BLOCK:
            yield block.take()
    if block.size:
        yield block.take()


def _by_bucket(h: np.ndarray, buckets: int, *columns: np.ndarray) -> list[list[bytes]]:
    """For each column the bytes of the values of each bucket; the low half of an element decides."""
    at = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    cuts = np.cumsum(np.bincount(at, minlength=buckets))[:-1]
    return [[x.tobytes() for x in np.split(c[order], cuts)] for c in columns]


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _buckets(elements: int | None) -> int:
    return 1 + (elements or 0) // BUCKET


def _few(df: DataFrame, elements: int | None) -> DataFrame:
    """``df`` in as many tasks as its sets' ``elements`` have use for, where a setting makes more of them; every row stays."""
    return df.coalesce(1 + (elements or 0) // TASK)


def _told(docs: DataFrame, k: int, key: str, text: str, buckets: int) -> DataFrame:
    """In one pass over the texts, (key, n_shingles, set_id, text_hash) of every row, with a null ``bucket``; and rows of
    (bucket, hashes, owners), what each block of texts says of the elements of the first segment, if there are ``buckets``.

    A block says of each element which sets have it, the least and the greatest that it knows.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, n_shingles bigint, set_id bigint, text_hash bigint, bucket bigint, hashes binary, owners binary"
    names = ["key", "n_shingles", "set_id", "text_hash", "bucket", "hashes", "owners"]

    def run(batches):
        block, types = _Block(), None

        def made(columns, n):
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, types)], names)

        def said():
            h, o, first = block.take()
            low, high, h = np.minimum.reduceat(o, first), np.maximum.reduceat(o, first), h[first]
            several = low != high
            h, o = np.concatenate([h, h[several]]), np.concatenate([low, high[several]])
            hashes, owners = _by_bucket(h, buckets, (h >> np.uint64(32)).astype(np.uint32), o)
            at = [i for i, x in enumerate(hashes) if x]
            return made([None, None, None, None, pa.array(at, pa.int64()), pa.array([hashes[i] for i in at], pa.binary()), pa.array([owners[i] for i in at], pa.binary())], len(at))

        for batch in batches:
            types = [batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            sizes, classes = [], []
            for sets in _sets_by_chunk(batch.column(1), k):
                of = _classes_of(sets)
                sizes += map(len, sets)
                classes.append(of)
                if not buckets:
                    continue
                for set_id, s in zip(of.tolist(), sets):
                    # A set counts what its own size allows; it shows partners of up to 4/3 of its size all they may count.
                    block.add(set_id, _in_first(s, SHARE_SMALL if len(s) < SMALL * 4 / 3 else SHARE))
                    if block.size >= BLOCK:
                        yield said()
            yield made([batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *classes])), batch.column(2), None, None, None], len(batch))
        if block.size:
            yield said()

    return docs.select(F.col(key), F.col(text), F.xxhash64(text)).mapInArrow(run, schema)


def _alone(told: DataFrame) -> DataFrame:
    """(set_id, alone): elements of the first segment that no other set has.

    In a bucket elements go by their high halves; if two are taken for one, fewer are alone, which only lets more sets go on.
    """
    def alone(rows):
        h, o = _joined(rows["hashes"], np.uint32), _joined(rows["owners"], np.int64)
        order = np.argsort(h)
        h, o = h[order], o[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(o, first) if len(h) else o
        own = low == (np.maximum.reduceat(o, first) if len(h) else o)
        return pa.table({"set_id": low[own], "small": (h[first][own] >> np.uint32(8)) < np.uint32(int(SHARE * (1 << 24)))})

    met = told.where("bucket is not null").select("bucket", "hashes", "owners")
    each = met.groupBy("bucket").applyInArrow(alone, "set_id bigint, small boolean")  # a row an element, as many as the input has
    return each.groupBy("set_id").agg(F.count("*").alias("alone_small"), F.count_if("small").alias("alone"))


def _lonely(docs: DataFrame, k: int, text: str, buckets: int) -> DataFrame:
    """(set_id, alone) of the sets of ``docs``, by ``buckets``."""
    return _alone(_told(docs.select(F.lit(0).alias("_"), text), k, "_", text, buckets))


def _filter_of(codes: DataFrame) -> np.ndarray:
    """A Bloom filter, two bits for each of the 64-bit ``code``; its size follows their number, up to ``FILTER_MOST`` bits."""
    size = min(FILTER_MOST, max(1 << 16, 1 << int(FILTER * codes.count()).bit_length()))
    place = lambda c: F.pmod(c, F.lit(size))
    bits = codes.select(F.explode(F.array(place(F.col("code")), place(F.shiftrightunsigned("code", 32)))).alias("_bit"))
    words = bits.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words["_word"].to_numpy()] = words["_bits"].to_numpy()
    return out.view(np.uint64)


def _wanted_texts(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(set_id, n, elements) of the rows that stand for a wanted set, and of a few others that the filter lets through; by
    text too, as a key may stand on many texts. No text moves."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_filter_of(wanted.select(F.xxhash64("_rep.key", "_rep.text_hash").alias("code"))))  # at most FILTER_MOST bits

    def run(batches):
        bits = shared.value
        for batch in batches:
            codes = np.asarray(batch.column(0)).view(np.uint64)
            keep = np.ones(len(codes), bool)
            for at in (codes, codes >> np.uint64(32)):
                at = at % np.uint64(64 * len(bits))
                keep &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            found = [(_class_of(s), len(s), s.tobytes()) for s in _sets(batch.column(1).filter(pa.array(keep)), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["set_id", "n", "elements"])

    return docs.select(F.xxhash64(key, F.xxhash64(text)), F.col(text)).mapInArrow(run, "set_id bigint, n int, elements binary")


def _surviving_sets(docs: DataFrame, told: DataFrame, rows: DataFrame, elements: int | None, k: int, key: str, text: str) -> DataFrame:
    """(set_id, n, elements as little-endian 64-bit words) of the sets that may have a partner, once each."""
    sizes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.first("n_shingles").alias("n"), F.min(F.struct("key", "text_hash")).alias("_rep"))
    counted = sizes.join(_alone(told), "set_id", "left")
    alone = F.coalesce(F.when(F.col("n") < SMALL, F.col("alone_small")).otherwise(F.col("alone")), F.lit(0))
    wanted = staged(_few(counted.where(4 * alone <= F.col("n")).select("_rep"), elements), "wanted")
    return _few(_wanted_texts(docs, wanted, k, key, text).groupBy("set_id").agg(F.first("n").alias("n"), F.first("elements").alias("elements")), elements)


def _shared_elements(sets: DataFrame) -> DataFrame:
    """(set_id, n, elements): the elements that some other set has too, of the sets that may still have a partner.

    An element of one set alone is a difference from every other set, so it only has to be counted (n - elements). Elements
    that sets of one block share are known to be shared: their bucket is told once, and their owners are spread evenly.
    """
    elements = sets.agg(F.sum("n")).first()[0]
    buckets = _buckets(elements)
    columns = ("hashes", "owners", "told", "known", "known_owners")

    def dealt(batches):
        stored = ((c, np.frombuffer(x, np.uint64)) for batch in batches for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for h, o, first in _blocks(stored):
            times = np.diff(np.append(first, len(h)))
            several = np.repeat(times > 1, times)
            one, told = h[~several], h[first][times > 1]
            parts = [*_by_bucket(one, buckets, one, o[~several]), *_by_bucket(told, buckets, told), *([x.tobytes() for x in np.array_split(c[several], buckets)] for c in (h, o))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), *(pa.array(x, pa.binary()) for x in parts)], ["bucket", *columns])

    def shared(rows):
        h, o, told = (_joined(rows[c], kind) for c, kind in zip(columns, (np.uint64, np.int64, np.uint64)))
        every, times = np.unique(np.concatenate([h, told]), return_counts=True)
        keep = np.isin(h, every[times > 1])
        return pa.table({"h": np.concatenate([h[keep].view(np.int64), _joined(rows["known"], np.int64)]), "set_id": np.concatenate([o[keep], _joined(rows["known_owners"], np.int64)])})

    met = sets.select("set_id", "elements").mapInArrow(dealt, "bucket bigint, hashes binary, owners binary, told binary, known binary, known_owners binary")
    each = _few(met.groupBy("bucket").applyInArrow(shared, "h bigint, set_id bigint"), elements)
    kept = each.groupBy("set_id").agg(F.collect_list("h").alias("elements"))  # at most the set
    return _few(kept.join(sets.select("set_id", "n"), "set_id").where(4 * (F.col("n") - F.size("elements")) <= F.col("n")), elements)


def _sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each cell of the hashes: whether the number of elements there is odd.

    Equal elements cancel out, so two sketches differ in at most as many bits as the sets have elements apart.
    """
    odd = np.bincount(((s >> np.uint64(32)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _stored(sets: DataFrame) -> DataFrame:
    """Elements sorted, as little-endian 64-bit words, and their parity sketch."""
    def run(batches):
        for batch in batches:
            own = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([_sketch(x) for x in own], pa.list_(pa.int64()))], ["set_id", "n", "elements", "sketch"])

    return sets.select("set_id", "n", "elements").mapInArrow(run, "set_id bigint, n int, elements binary, sketch array<bigint>")


# -- segments ---------------------------------------------------------------------------------------------------

def _bands(top: int) -> list[int]:
    """Lower bounds of size bands: a set and a partner of at least 3/4 of its size lie in one band or in two that adjoin."""
    bounds = [1, 2]
    while bounds[-1] <= top:
        bounds.append(max(bounds[-1] + 1, 4 * (bounds[-1] - 1) // 3 + 1))
    return bounds


_BOUNDS = _bands(1 << 40)
def _scheme(band: int) -> tuple[int, int]:
    """Number of segments of a band, and of those that may have tolerance 1."""
    m = max(1, -(-(_BOUNDS[band + 1] - 1) // 4))
    return m, m if m <= 16 else -(-m // 2)


def _tolerances(first: np.ndarray, second: np.ndarray, need: int) -> np.ndarray:
    """Cheapest v_i of -1, 0 or 1 (1 in the first ``len(second)`` segments) with sum(v_i + 1) = need.

    ``first``: how many sets share the subset of each segment; ``second``: how many more one left out brings in. A
    segment's second unit never comes before its first, so the cheapest units make the allocation.
    """
    units = np.concatenate([first, np.maximum(second, first[: len(second)])])
    if need > len(units):
        raise ValueError("too few segments for the size band")
    taken = np.zeros(len(units), bool)
    taken[np.argsort(units, kind="stable")[:need]] = True
    v = taken[: len(first)].astype(np.int8) - 1
    v[: len(second)] += taken[len(first):]
    return v


def _subsets(s: np.ndarray, n: int):
    """For the band of a set of ``n`` elements (``s`` of them shared), where it indexes and probes, and for the band below,
    where it probes: (own, bound on differences, keys of whole subsets, keys of subsets with one left out, their segment,
    number of segments that may have tolerance 1)."""
    band = bisect_right(_BOUNDS, n) - 1
    for at in (band, band - 1):
        if at < 0 or at < band and 4 * (_BOUNDS[band] - 1) < 3 * n:
            continue
        most = (n + min(n, _BOUNDS[at + 1] - 1)) // 7 - (n - len(s))
        if most < 0 and at < band:
            continue
        m, loose = _scheme(at)
        seg = ((s & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        e, seg = mixed(s[order]), seg[order]
        sizes = np.bincount(seg, minlength=m)
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(e, out=sums[1:])
        ends = np.cumsum(sizes)
        subset = sums[ends] - sums[ends - sizes]
        salt = mixed(np.arange(m, dtype=np.uint64) + np.uint64(at << 40))
        free = seg < loose
        yield at == band, most, mixed(subset + salt), mixed(subset[seg] - e + salt[seg])[free], seg[free], loose


def _possible(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, flags) of all subsets that a set indexes or may probe with."""
    keys, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
    for own, most, whole, less, _, _ in _subsets(s, n):
        probe, probe_less = (PROBE, PROBE_LESS) if most >= 0 else (0, 0)
        keys += [whole, less]
        flags += [np.full(len(whole), probe + (INDEX if own else 0), np.int8), np.full(len(less), probe_less + (INDEX_LESS if own else 0), np.int8)]
    return np.concatenate(keys), np.concatenate(flags)


def _allocated(s: np.ndarray, n: int, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, flags) of a set after allocation; ``known``: sorted keys that other sets have too, ``counts``: by how many."""
    def cost(keys):
        if not len(known):
            return np.zeros(len(keys))
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return np.where(known[at] == keys, counts[at], 0)

    keys, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
    for own, most, whole, less, seg, loose in _subsets(s, n):
        v = np.full(len(whole), -1, np.int8)
        if most >= 0:
            v = _tolerances(cost(whole), np.bincount(seg, weights=cost(less), minlength=loose)[:loose], most + 1)
        flag = np.where(v >= 0, PROBE, 0) + np.where(v == 1, PROBE_ONE, 0) + (INDEX if own else 0)
        flag_less = np.where(v[seg] == 1, PROBE_LESS, 0) + (INDEX_LESS if own else 0)
        keys += [whole, less]
        flags += [flag.astype(np.int8), flag_less.astype(np.int8)]
    keys, flags = np.concatenate(keys), np.concatenate(flags)
    useful = (flags > 0) & (cost(keys) > 0)
    return keys[useful], flags[useful]


def signatures(sets: DataFrame, elements: int | None) -> DataFrame:
    """(sig, set_id, flags, n, alone) of all sets, after each has put its tolerances where they are cheap.

    First all subsets are counted that sets index or may probe with; each set then learns how many others share its own.
    """
    def possible(batches):
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                made = [_possible(np.frombuffer(x, np.uint64), n) for x, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in made]).view(np.int64)), pa.array(np.repeat(np.array(part.column(0)), [len(k) for k, _ in made])), pa.array(np.concatenate([f for _, f in made]))], ["sig", "set_id", "flags"])

    def allocated(batches):
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                made, alone = [], []
                for s, n, sigs, counts in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                    s, sigs = np.frombuffer(s, np.uint64), np.array(sigs, np.int64).view(np.uint64)
                    order = np.argsort(sigs)
                    made.append(_allocated(s, n, sigs[order], np.array(counts)[order]))
                    alone.append(n - len(s))
                if made:
                    sizes = [len(k) for k, _ in made]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in made]).view(np.int64)), pa.array(np.repeat(np.array(part.column(0)), sizes)), pa.array(np.concatenate([f for _, f in made])),
                                                      pa.array(np.repeat(np.array(part.column(2)), sizes)), pa.array(np.repeat(np.array(alone, np.int32), sizes))], ["sig", "set_id", "flags", "n", "alone"])

    every = sets.select("set_id", "elements", "n").mapInArrow(possible, "sig bigint, set_id bigint, flags tinyint")
    both = lambda bits: F.bit_or("flags").bitwiseAND(F.lit(bits)) != 0
    groups = every.groupBy("sig").agg(F.count("*").alias("c"), F.min("set_id").alias("low"), F.max("set_id").alias("high"), both(INDEX | INDEX_LESS).alias("i"), both(PROBE | PROBE_LESS).alias("p"))
    groups = staged(_few(groups.where("low < high and i and p").select("sig", "c"), elements), "shared_signatures")
    of_set = _few(every.select("sig", "set_id").join(groups, "sig"), elements).groupBy("set_id").agg(F.collect_list("sig").alias("sigs"), F.collect_list("c").alias("counts"))  # at most two for each element
    joined = _few(sets.join(of_set, "set_id").select("set_id", "elements", "n", "sigs", "counts"), elements)
    return joined.mapInArrow(allocated, "sig bigint, set_id bigint, flags tinyint, n int, alone int")


# -- tests ------------------------------------------------------------------------------------------------------

def _confirmed(pairs: DataFrame, sets: DataFrame, elements: int | None) -> DataFrame:
    """Of pairs (u, v), each once, those with 100 * intersection >= 75 * union, by the whole sets: elements that one
    set has alone count by their number."""
    def run(batches):
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            left, right, sizes = batch.column(2), batch.column(3), batch.column(4).to_pylist()
            for i in range(len(batch)):
                held, other = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                at = np.searchsorted(held, other)
                at[at == len(held)] = 0
                both = int((held[at] == other).sum()) if len(held) else 0
                keep[i] = 100 * both >= 75 * (sizes[i] - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["u", "v"])

    each = _few(pairs.distinct(), elements)
    with_u = _few(each.join(sets.select(F.col("set_id").alias("u"), F.col("elements").alias("a"), F.col("n").alias("na")), "u"), elements)
    with_v = with_u.join(sets.select(F.col("set_id").alias("v"), F.col("elements").alias("b"), F.col("n").alias("nb")), "v")
    return _few(with_v.select("u", "v", "a", "b", F.col("na") + F.col("nb")), elements).mapInArrow(run, "u bigint, v bigint")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _fits(n: str, m: str, alone: str, other: str):
    """Whether the sizes, the elements that each has alone, and the numbers of those that others share leave room for a
    similarity of 3/4."""
    differ = F.col(alone) + F.col(other) + F.abs((F.col(n) - F.col(alone)) - (F.col(m) - F.col(other)))
    return (4 * F.col(n) >= 3 * F.col(m)) & (4 * F.col(m) >= 3 * F.col(n)) & (7 * differ <= F.col(n) + F.col(m))


def _near(n: str, m: str, alone: str, other: str, sketch: str, held: str):
    """Whether the bits in which the sketches differ, and the elements that each has alone, leave that room."""
    bits = sum((F.bit_count(F.col(sketch)[i].bitwiseXOR(F.col(held)[i])) for i in range(SKETCH)), F.lit(0))
    return 7 * (F.col(alone) + F.col(other) + bits) <= F.col(n) + F.col(m)


def _has(flags: str, bits: int):
    return F.col(flags).bitwiseAND(F.lit(bits)) != 0


def links(sets: DataFrame) -> DataFrame:
    """(u, v): links between sets whose components are those of all links."""
    n_sets, elements = sets.agg(F.count("*"), F.sum("n")).first()
    open_ = staged(signatures(sets, elements).withColumn("component", F.col("set_id")), "candidates")
    # Only subsets that some set probes for and another has indexed bring sets together.
    has = lambda bits: F.bit_or("flags").bitwiseAND(F.lit(bits)) != 0
    useful = open_.groupBy("sig").agg(has(INDEX | INDEX_LESS).alias("i"), has(PROBE | PROBE_LESS).alias("p"), F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high and i and p").select("sig")
    candidates, open_ = open_, staged(_few(open_.join(useful, "sig"), elements), "open")
    drop_staged(candidates)
    found, turn = None, 0
    while True:
        by = _few(open_.groupBy("sig", "component").agg(F.count("*").alias("c")), elements)
        of_group = staged(_few(by.groupBy("sig").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.max("c").alias("most"), F.sum("c").alias("all")).where("most < all"), elements), "groups")
        left = of_group.agg(F.sum(((F.col("all") - F.col("most")) * F.col("all")).cast("double"))).first()[0]
        if not left:
            break
        leading = turn < ROUNDS and left > PAIRS_A_SET * n_sets
        pairs = _few(_led(open_, of_group, turn), elements) if leading else _all_left(open_, of_group, sets)
        new = staged(_confirmed(pairs, sets, elements), "confirmed")
        found = new if found is None else found.union(new)
        if not leading:
            break
        if new.isEmpty():
            # No leader links to anything across components: what is left is for the exact tests.
            found = found.union(staged(_confirmed(_all_left(open_, of_group, sets), sets, elements), "confirmed_rest"))
            break
        turn += 1
        of = components(found).withColumnRenamed("node", "set_id")
        named = _few(open_.join(of_group.select("sig"), "sig").drop("component"), elements).join(of, "set_id", "left")
        before, open_ = open_, staged(_few(named.withColumn("component", F.coalesce("component", "set_id")), elements), "open")
        drop_staged(before, of_group)
    return sets.select(F.col("set_id").alias("u"), F.col("set_id").alias("v")).where("false") if found is None else found


def _led(open_: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """Pairs of each group's leader, another one of its largest component each turn, with the members of other components."""
    inside = open_.join(groups.select("sig", "largest"), "sig")
    leaders = inside.where("component = largest").groupBy("sig").agg(F.min_by(F.struct("set_id", "n", "alone"), F.xxhash64(F.lit(turn), "set_id")).alias("l"))
    tried = inside.where("component != largest").join(leaders, "sig").select("set_id", "n", "alone", F.col("l.set_id").alias("leader"), F.col("l.n").alias("ln"), F.col("l.alone").alias("la"))
    return tried.where(_fits("n", "ln", "alone", "la")).select(*_pair("set_id", "leader"))


def _all_left(open_: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs across components that some group and the sketches allow: sets outside its largest component, against
    the whole group."""
    sketched = open_.join(sets.select("set_id", "sketch"), "set_id")
    inside = sketched.join(groups.select("sig", "largest"), "sig")
    outside = inside.where("component != largest").select("sig", F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("alone").alias("ua"), F.col("flags").alias("fa"), F.col("component").alias("ca"), F.col("sketch").alias("sa"))
    whole = inside.select("sig", F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("alone").alias("ub"), F.col("flags").alias("fb"), F.col("component").alias("cb"), F.col("sketch").alias("sb"))
    meets = lambda p, i: (_has(p, PROBE | PROBE_LESS) & _has(i, INDEX)) | (_has(p, PROBE_ONE) & _has(i, INDEX_LESS))
    return outside.join(whole, "sig").where((F.col("ca") != F.col("cb")) & _fits("na", "nb", "ua", "ub") & _near("na", "nb", "ua", "ub", "sa", "sb") & (meets("fa", "fb") | meets("fb", "fa"))).select(*_pair("a", "b"))


def _judged(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(key, n_shingles, set_id, _group, _least) of every row: its component, null for empty sets, and the smallest key there."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0]
    told = staged(_told(docs, k, key, text, _buckets(int(SHARE * (size or 0) / BYTES))), "told")
    rows = staged(_classes(told), "classes")
    elements = rows.agg(F.sum("n_shingles")).first()[0]
    sets = staged(_surviving_sets(docs, told, rows, elements, k, key, text), "sets")
    drop_staged(told)
    shared = staged(_stored(_shared_elements(sets)), "shared_elements")
    drop_staged(sets)
    of = staged(_few(components(links(shared)), elements), "components")
    joined = _few(rows.join(of.withColumnRenamed("node", "set_id"), "set_id", "left"), elements)
    # The smallest key of a component, pre-aggregated by class; empty sets stay alone.
    least = joined.where("n_shingles > 0").groupBy(F.coalesce("component", "set_id").alias("_group")).agg(F.min("key").alias("_least"))
    group = F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_id"))
    return _few(joined.withColumn("_group", group).join(least, "_group", "left").select("key", "n_shingles", "set_id", "_group", "_least"), elements)


def near_duplicates(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of documents linked at a Jaccard similarity of 0.75 or more."""
    return _judged(docs, k, key, text).select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("key")).alias("component_id"))


def _with_sets(docs: DataFrame, k: int, text: str, name: str) -> DataFrame:
    """All columns and the class of each text's set under ``name``, null for the empty set."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            sets = pa.array([_class_of(s) if len(s) else None for s in _sets(batch.column(at), k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sets], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, of those with its smallest key, all columns; empty texts stay, repeated rows once.

    Columns of ``docs`` may have any names: the helper columns take names that are free.
    """
    kept_key, chosen_set, of_row, empty_text = unused(docs.columns, "_kept", "_chosen", "_set", "_empty")
    judged = staged(_judged(docs, k, key, text), "judged")
    own = F.col("key").eqNullSafe(F.col("_least"))
    full = judged.where((F.col("n_shingles") > 0) & own).groupBy("_group").agg(F.first("key").alias(kept_key), F.min("set_id").alias(chosen_set)).drop("_group")
    empty = judged.where("n_shingles = 0").select(F.col("key").alias(kept_key), F.lit(None).cast("bigint").alias(chosen_set))
    kept = staged(full.union(empty.distinct()), "kept")
    # The keys alone decide unless one stands in several rows; then the set chosen for the component decides too.
    several = judged.groupBy("key").count().where("count > 1").select("key")
    out = docs.join(kept, F.col(key).eqNullSafe(F.col(kept_key)), "left_semi")
    if several.join(kept, F.col("key").eqNullSafe(F.col(kept_key)), "left_semi").isEmpty():
        return out
    chosen = F.col(key).eqNullSafe(F.col(kept_key)) & F.col(of_row).eqNullSafe(F.col(chosen_set))
    rows = _with_sets(out, k, text, of_row).join(kept, chosen, "left_semi").withColumn(empty_text, F.when(F.col(of_row).isNull(), F.col(text)))
    return rows.dropDuplicates([key, of_row, empty_text]).select(*docs.columns)
