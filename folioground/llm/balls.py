"""Ranked lexical search: exact inner products of sparse document vectors by ball trees.

A document's vector has, for each of its terms, ``(10^9 * tf) div (1000 * tf + 8 * m)`` with
``m = 100 - 90 + ((90 * n * N) div L)``; an item's vector has the weights ``floor(1000 * ln((2N + 2) / (2df + 1)))`` of
its terms. Scores are their inner products, 64-bit integers.

The index is a forest: about ``TREE`` bytes of text make one tree, a row of a written table. Terms that at least one in
``OFTEN`` documents of a tree hold are coordinates of their own; the others are hashed to ``PARTS`` parts. A node has a
centre, the mean of its documents in the coordinates of the frequent terms and zero elsewhere, and a radius for each
such coordinate and each part: the largest distance there of a document below to the centre, computed from integers and
rounded up. For an item q, ``<q, centre> + sum of |q| * radius`` over coordinates and parts is above every score below
the node; bounds are widened by more than rounding can take away. A search walks each tree best-first with the k-th best
score known so far and scores the documents of the leaves that it cannot prune exactly. A sixteenth of the trees is searched
first and gives every task a score to start from; each task returns k documents of an item at most.

Terms are 64-bit hashes of whole words. Counts (documents, terms, documents of each term) come from one pass over all
texts, added up in tasks first. Items are searched in blocks of about ``ITEM_TERMS`` terms that are sent to all tasks.

Defined cases: a null or empty text, or one without a term, counts nowhere and is never found; very long texts are
read whole and make a tree of their own; equal scores go by ascending document id, a null id last; repeated rows are
documents each and take a rank each; an item without terms, or with none that a document holds, has no rows; a null item
id and repeated items keep their rows; empty tables give no rows; columns other than the named ones are ignored,
whatever they are called.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioground.llm.base import ALNUM, Words, chunks, drop_staged, shuffles_dropped, staged, texts_of
from folioground.staging import stage_path

#: Bytes of text of a tree, documents of a leaf, parts of the rarer terms, share of documents that makes a term frequent,
#: terms counted before they leave a task, terms of items of one block, share of the trees that is searched first.
TREE, LEAF, PARTS, OFTEN, FLUSH, ITEM_TERMS, FIRST = 1 << 20, 16, 1 << 16, 4, 1 << 20, 1 << 18, 16
#: Radii of parts are kept as powers of two, rounded up, this many to an octave.
STEPS = 8
_RADIUS = 2.0 ** (np.arange(256) / STEPS)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of each different term of each text, by document and term, and the number of terms of each text."""
    words = Words(data, offsets, ALNUM)
    n = np.diff(words.first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.hash, doc))
    doc, term = doc[order], words.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return doc[at], term[at], np.diff(np.append(at, len(doc))), n


def _parts_of_texts(column: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = texts_of(column)
    for low, high in chunks(offsets, limit):
        yield low, high, data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]


def corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, held, words): documents of each term; the row of the null term has all documents with a term, and all terms."""
    def run(batches):
        held, size, documents, words = [], 0, 0, 0

        def flush():
            terms, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            total = np.zeros(len(terms) + 1, bool)
            total[0] = True
            columns = [pa.array(np.append(0, terms.view(np.int64)), mask=total), pa.array(np.append(documents, counts)), pa.array(np.where(total, words, 0))]
            return pa.RecordBatch.from_arrays(columns, ["term", "held", "words"])

        for batch in batches:
            for _, _, data, offsets in _parts_of_texts(batch.column(0), TREE):
                _, term, _, n = term_counts(data, offsets)
                held.append(term)
                size, documents, words = size + len(term), documents + int((n > 0).sum()), words + int(n.sum())
                if size > FLUSH:
                    yield flush()
                    held, size, documents, words = [], 0, 0, 0
        yield flush()

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "term bigint, held bigint, words bigint").groupBy("term").agg(F.sum("held").alias("held"), F.sum("words").alias("words"))


# -- trees ------------------------------------------------------------------------------------------------------

def _part_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(40)).astype(np.int64) % PARTS


def _largest(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group once, in order, with its largest value."""
    if not len(group):
        return group, values
    order = np.argsort(group, kind="stable")
    group = group[order]
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return group[at], np.maximum.reduceat(values[order], at)


def _split(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of some documents, by which of two far points is nearer."""
    x = points[own]
    a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    lean = x @ (b - a)
    order = np.argsort(lean, kind="stable")
    cut = int(np.searchsorted(lean[order], (a @ (b - a) + b @ (b - a)) / 2))
    least = max(len(own) // 4, 1)
    cut = min(max(cut, least), len(own) - least)
    return own[order[:cut]], own[order[cut:]]


def build_tree(doc: np.ndarray, terms: np.ndarray, values: np.ndarray, documents: int) -> dict:
    """A ball tree over documents given by (document, term, value); documents are renumbered leaf by leaf (``order``)."""
    distinct, which, held = np.unique(terms, return_inverse=True, return_counts=True)
    rare = np.log1p(documents / held)
    high = distinct >> np.uint64(20)
    sign = np.where(high & np.uint64(1), rare, -rare)
    points = np.bincount(doc * 32 + ((high >> np.uint64(1)).astype(np.int64) % 32)[which], sign[which] * values, documents * 32).reshape(documents, 32)
    children, members, parents, order, todo = [], [], [], [], [(np.arange(documents), -1)]
    spans: list[tuple[int, int]] = []
    while todo:
        own, parent = todo.pop()
        node = len(children)
        if parent >= 0:
            children[parent].append(node)
        children.append([])
        members.append(own)
        parents.append(parent)
        spans.append((-1, -1))
        if len(own) > LEAF:
            todo += [(quarter, node) for half in _split(points, own) for quarter in (_split(points, half) if len(half) > LEAF else [half])]
        else:
            spans[node] = (len(order), len(order) + len(own))
            order += own.tolist()
    order = np.array(order, np.int64)
    place = np.empty(documents, np.int64)
    place[order] = np.arange(documents)
    new = place[doc]
    by = np.lexsort((which, new))
    doc, which, values = new[by], which[by], values[by]
    starts = np.searchsorted(doc, np.arange(documents + 1))
    # Frequent terms: a column each.
    often = np.flatnonzero(held * OFTEN >= documents)
    column = np.full(len(distinct), -1)
    column[often] = np.arange(len(often))
    mine = column[which] >= 0
    dense = np.zeros((documents, len(often)), np.int64)
    dense[doc[mine], column[which[mine]]] = values[mine]
    centres, spread = np.zeros((2, len(members), len(often)), np.int64)
    for node, own in enumerate(members):
        x = dense[place[own]]
        centres[node] = x.sum(axis=0) // max(len(x), 1)
        spread[node] = np.maximum(x.max(axis=0) - centres[node], centres[node] - x.min(axis=0))
    # Others: the largest length in each part, from the leaves up.
    leaf_of = np.zeros(documents, np.int64)
    for node, (low, high_) in enumerate(spans):
        leaf_of[low: high_] = node
    rest = ~mine
    group = doc[rest] * PARTS + _part_of(distinct)[which[rest]]
    by = np.argsort(group, kind="stable")
    group = group[by]
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    squares = np.add.reduceat(values[rest][by] ** 2, at) if len(at) else np.zeros(0, np.int64)
    group = group[at]
    radius = np.ceil(np.log2(squares.astype(np.float64)) * (STEPS / 2) + 1e-6).astype(np.int64)
    parts: list = [None] * len(members)
    node, part = leaf_of[group // PARTS], group % PARTS
    both, radius = _largest(node * PARTS + part, radius)
    cuts = np.searchsorted(both, np.arange(len(members) + 1) * PARTS)
    for node in range(len(members)):
        parts[node] = [(both[cuts[node]: cuts[node + 1]] % PARTS, radius[cuts[node]: cuts[node + 1]])]
    for node in range(len(members) - 1, -1, -1):  # children come after their parents
        if len(parts[node]) > 1:
            parts[node] = [_largest(*map(np.concatenate, zip(*parts[node])))]
        if parents[node] >= 0:
            parts[parents[node]].append(parts[node][0])
    parts = [p[0] for p in parts]
    return {"order": order, "starts": starts, "terms": distinct, "which": which, "values": values, "often": often, "centres": centres, "spread": spread,
            "children": np.array([c + [-1] * (4 - len(c)) for c in children], np.int64), "spans": np.array(spans, np.int64),
            "part_starts": np.append(0, np.cumsum([len(p[0]) for p in parts])), "parts": np.concatenate([p[0] for p in parts]), "radii": np.concatenate([p[1] for p in parts])}


_STORED = {"starts": "<i4", "terms": "<u8", "which": "<i4", "values": "<u4", "often": "<i4", "centres": "<u4", "spread": "<u4", "children": "<i4", "spans": "<i4", "part_starts": "<i4", "parts": "<u2", "radii": "u1"}


def index(docs: DataFrame, documents: int, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each tree; ``first`` marks those to search first. Documents without a term are in none."""
    kind = dict(docs.dtypes)[key]
    schema = f"first boolean, keys array<{kind}>, " + ", ".join(f"{name} binary" for name in _STORED)

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in _parts_of_texts(batch.column(1), TREE):
                doc, term, tf, n = term_counts(data, offsets)
                held = np.flatnonzero(n)
                if not len(held):
                    continue
                number = np.zeros(len(n), np.int64)
                number[held] = np.arange(len(held))
                m = np.array([10 + 90 * int(x) * documents // words for x in n[held]], np.int64)
                doc = number[doc]
                tree = build_tree(doc, term, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc]), len(held))
                keys = batch.column(0).take(pa.array(low + held[tree["order"]]))
                first = pa.array([zlib.crc32(tree["terms"].tobytes()) % FIRST == 0])
                yield pa.RecordBatch.from_arrays([first, pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)] + [pa.array([tree[name].astype(of).tobytes()], pa.binary()) for name, of in _STORED.items()], ["first", "keys", *_STORED])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


# -- items ------------------------------------------------------------------------------------------------------

def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(row, item, term): each different term of each item."""
    kind = dict(items.dtypes)[item]

    def run(batches):
        for batch in batches:
            for low, _, data, offsets in _parts_of_texts(batch.column(2), TREE):
                which, term, _, _ = term_counts(data, offsets)
                at = pa.array(low + which)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(term.view(np.int64))], ["row", "item", "term"])

    return items.select(F.monotonically_increasing_id().alias("row"), F.col(item).alias("item"), F.col(text).cast("string")).mapInArrow(run, f"row bigint, item {kind}, term bigint")


class Items:
    """Some items with the weights of their terms: ``vocabulary`` is sorted, postings go from a term to its items."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.rows, item = np.unique(rows, return_inverse=True)
        self.vocabulary, word = np.unique(terms, return_inverse=True)
        order = np.argsort(word, kind="stable")
        self.item, self.word, self.weight = item[order], word[order], weights[order]
        self.starts = np.searchsorted(self.word, np.arange(len(self.vocabulary) + 1))
        by_item = np.argsort(self.item, kind="stable")
        cuts = np.searchsorted(self.item[by_item], np.arange(len(self.rows) + 1))
        self.of = [(self.word[by_item[a:b]], self.weight[by_item[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some terms an item has, and their places in the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == terms)
        return hit, at[hit]

    def bounds(self, tree: dict) -> np.ndarray:
        """For each node and item a number that no score below the node exceeds."""
        nodes, items = len(tree["children"]), len(self.rows)
        hit, at = self.places(tree["terms"][tree["often"]])
        gain = (tree["centres"][:, hit].astype(np.float64) + tree["spread"][:, hit])
        frequent = np.zeros(len(self.vocabulary), bool)
        frequent[at] = True
        column = np.zeros(len(self.vocabulary), np.int64)
        column[at] = np.arange(len(hit))
        mine = np.flatnonzero(frequent[self.word])
        weights = np.zeros((len(hit), items))
        weights[column[self.word[mine]], self.item[mine]] = self.weight[mine]
        bound = gain @ weights
        others = np.flatnonzero(~frequent[self.word])
        part = _part_of(self.vocabulary)[self.word[others]]
        group, which = np.unique(part * items + self.item[others], return_inverse=True)
        length = np.sqrt(np.bincount(which, self.weight[others].astype(np.float64) ** 2, len(group)))
        asked, cuts = np.unique(group // items, return_index=True)
        cuts = np.append(cuts, len(group))
        if len(asked):
            table = np.full(PARTS, -1)
            table[asked] = np.arange(len(asked))
            to = table[tree["parts"]]
            found = np.flatnonzero(to >= 0)
            node, to = np.searchsorted(tree["part_starts"], found, "right") - 1, to[found]
            many = cuts[to + 1] - cuts[to]
            which = np.repeat(cuts[to] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            bound += np.bincount(np.repeat(node, many) * items + group[which] % items, np.repeat(_RADIUS[tree["radii"][found]], many) * length[which], nodes * items).reshape(nodes, items)
        return bound * (1 + 1e-9) + 1


def _rank(entry: tuple) -> tuple:
    return (-entry[0], entry[1] is None, 0 if entry[1] is None else entry[1])


def search_tree(tree: dict, items: Items, best: list[list[tuple]], k: int, floors: np.ndarray) -> int:
    """Put into ``best`` (a list of (score, key) for each item, best first) what a tree has that reaches ``floors``, which
    rise with the k-th best; returns the number of leaves scored."""
    bounds, scored = items.bounds(tree), 0
    asking = np.flatnonzero(bounds[0] >= floors)
    if not len(asking):
        return 0
    hit, word = items.places(tree["terms"])
    to = np.full(len(tree["terms"]), -1)
    to[hit] = word
    word = to[tree["which"]]
    hit = np.flatnonzero(word >= 0)
    word, value = word[hit], tree["values"][hit].astype(np.int64)
    doc = np.searchsorted(tree["starts"], hit, "right") - 1
    children, keys, edges = tree["children"], tree["keys"], np.searchsorted(doc, tree["spans"])
    weight_of, leaves, first = np.zeros(len(items.vocabulary), np.int64), {}, np.ones(1, bool)
    for i in asking:
        words, weights = items.of[i]
        mine, up = best[i], bounds[:, i]
        weight_of[words] = weights
        heap = [(-up[0], 0)]
        while heap and -heap[0][0] >= floors[i]:
            _, node = heapq.heappop(heap)
            if children[node, 0] >= 0:
                for child in children[node]:
                    if child >= 0 and up[child] >= floors[i]:
                        heapq.heappush(heap, (-up[child], int(child)))
                continue
            scored += 1
            if node not in leaves:
                a, b = edges[node]
                at = doc[a:b]
                cut = np.flatnonzero(np.concatenate([first, at[1:] != at[:-1]])) if a < b else at
                leaves[node] = word[a:b], value[a:b], cut, at[cut]
            its_words, its_values, cut, at = leaves[node]
            if len(cut):
                scores = np.add.reduceat(weight_of[its_words] * its_values, cut)
                if scores.max() >= floors[i]:
                    mine += [(int(scores[j]), keys[at[j]]) for j in (scores >= floors[i]).nonzero()[0]]
                    if len(mine) >= k:
                        mine.sort(key=_rank)
                        del mine[k:]
                        floors[i] = max(floors[i], mine[-1][0])
        weight_of[words] = 0
    return scored


def _read_tree(row: dict) -> dict:
    tree = {name: np.frombuffer(row[name], of) for name, of in _STORED.items()}
    for name, width in (("children", 4), ("spans", 2), ("centres", len(tree["often"])), ("spread", len(tree["often"]))):
        tree[name] = tree[name].reshape(-1, width) if width else np.zeros((len(row["children"]) // 16, 0))
    return tree | {"keys": row["keys"]}


def _searched(trees: DataFrame, items: Items, k: int, floors: np.ndarray) -> DataFrame:
    """(row, score, key): the k best documents of each item and task, of those that reach its floor."""
    kind = dict(trees.dtypes)["keys"][6:-1]

    def run(batches):
        best: list[list[tuple]] = [[] for _ in items.rows]
        reached = floors.copy()
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i].as_py() for name in ("keys", *_STORED)}
                search_tree(_read_tree(row), items, best, k, reached)
        found = [(int(items.rows[i]), score, key) for i, mine in enumerate(best) for score, key in sorted(mine, key=_rank)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], batch_type[0])], ["row", "score", "key"])

    from pyspark.sql.pandas.types import to_arrow_type
    batch_type = [to_arrow_type(trees.schema["keys"].dataType.elementType)]
    return trees.mapInArrow(run, f"row bigint, score bigint, key {kind}")


def _written(spark: SparkSession, df: DataFrame, name: str, batch: int, by: str | None = None) -> DataFrame:
    """``df`` written with ``batch`` rows at a time to Python: a row may be a whole tree."""
    path = stage_path(spark, name)
    with shuffles_dropped(spark):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 of each item."""
    spark = docs.sparkSession
    counts = staged(corpus_counts(docs, text), "term_counts")
    total = counts.where("term IS NULL").first()
    documents, words = (int(total["held"]), int(total["words"])) if total else (0, 0)
    kinds = dict(items.dtypes)[item], dict(docs.dtypes)[key]
    if not documents:
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
    trees = _written(spark, index(docs, documents, words, key, text), "ball_trees", 1000, "first")
    asked = staged(_item_terms(items, item, item_text), "item_terms")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("held") + 1).cast("double"))).cast("bigint")
    weighed = staged(asked.join(counts.where("term IS NOT NULL"), "term").select("row", "term", weight.alias("weight")).where("weight > 0"), "item_weights")
    blocks = max(1, -(-weighed.count() // ITEM_TERMS))
    found: list[DataFrame] = []
    for block in range(blocks):  # each a bounded part of the items
        some = weighed.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()
        if len(some):
            held = Items(some.column("row").to_numpy(), some.column("term").to_numpy().view(np.uint64), some.column("weight").to_numpy())
            floors = np.ones(len(held.rows), np.int64)
            start = _written(spark, _searched(trees.where("first"), held, k, floors), "first_ranked", 2)
            kth = start.groupBy("row").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("kth"))
            for r in kth.where("kth IS NOT NULL").collect():  # one number for each item of the block
                floors[np.searchsorted(held.rows, r["row"])] = r["kth"]
            found += [start, _written(spark, _searched(trees.where("NOT first"), held, k, floors), "ranked_documents", 2)]
    drop_staged(trees)
    if not found:
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item").distinct(), "row").select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")
