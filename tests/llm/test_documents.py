"""Operators on documents against brute force, on documents with every odd case and on the smallest tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from folioground.llm import base, binary, jaccard, language, licenses, packing, pieces, quality, sharding, tokens

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counted(items):
    return Counter(map(tuple, items))


# -- sharding -----------------------------------------------------------------------------------------------------

def jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 1000])
def test_jump_is_the_published_function(spark, shards):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, 12345, *range(500, 560)]
    got = sharding.jump_shards(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", shards).collect()
    assert {r["k"]: (r["shard"], r["grown_shard"]) for r in got} == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


def test_shards_of_odd_documents(docs, rows, no_docs):
    got = sharding.shard_documents(docs, 5).collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(i or 0, 5), jump(i or 0, 6)) for i, t, *_ in rows]
    assert counted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == counted(want)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)
    assert sharding.shard_documents(no_docs).count() == 0


def test_string_keys_are_hashed(docs):
    got = sharding.jump_shards(docs.select("text"), "text", 7).groupBy("text").agg(F.countDistinct("shard").alias("n"), F.max("shard").alias("m")).collect()
    assert all(r["n"] == 1 and 0 <= r["m"] < 7 for r in got)


# -- quality ------------------------------------------------------------------------------------------------------

def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_odd_documents(docs, rows, no_docs):
    got = quality.text_statistics(docs, ["doc_id"]).collect()
    assert counted((r["doc_id"], *(r[c] for c in quality.COUNTS)) for r in got) == counted((i, *counts(t)) for i, t, *_ in rows)
    assert quality.text_statistics(no_docs, ["doc_id"]).count() == 0


def test_rules_are_learned_and_take_effect(spark, docs, rows):
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    judged, rules = quality.judge(*tables)
    assert rules and all(len(rule) <= 3 for rule in rules)
    right = judged.where("not base_failed").join(tables[1], "doc_id").select((F.col("kept") == (F.col("quality") == 1)).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right >= 0.95
    nothing = tables[1].where("false")
    judged, rules = quality.judge(docs, nothing)
    assert rules == [] and judged.count() == len(rows)
    assert judged.where("kept = base_failed").count() == 0
    one = quality.learn_rules(tables[0], tables[1].where("quality = 1"))
    assert one == [] and quality.keep_good(docs, one).columns == docs.columns


def test_an_order_of_rules():
    a, b = quality.Condition("x", True, 1.0), quality.Condition("y", False, 2.0)
    assert str(a) == "x >= 1" and str(b) == "y < 2"


# -- near duplicates ----------------------------------------------------------------------------------------------

def shingles(text):
    w = WORDS.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]


def test_near_duplicates_of_odd_documents(docs, rows, no_docs):
    want = classes(rows)
    assert counted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()) == counted(want)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted({i if i is not None else -1 for i, _, c in want if i == c})
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_a_hot_id_meets_each_text_once(spark, monkeypatch):
    met, texts = [], jaccard._wanted_texts
    monkeypatch.setattr(jaccard, "_wanted_texts", lambda *a: met.append(texts(*a).count()) or texts(*a))
    both = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(None, f"{both} own{i}") for i in range(30)] + [(7, f"{both} other{i}") for i in range(30)], "doc_id bigint, text string")
    assert {r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == {7}
    assert met == [60]


def test_texts_stay_and_shared_elements_meet_in_buckets(spark, docs, rows, monkeypatch):
    """No exchange lies above the texts, and many buckets over several blocks give the sets of one comparison."""
    classes_ = jaccard.document_classes(docs)
    wanted = classes_.select(F.struct("key", "text_hash").alias("_rep"))
    monkeypatch.setattr(jaccard, "BUCKET", 40)
    with_join = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    texts = jaccard._wanted_texts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), wanted, 5, "doc_id", "text")
    plan = texts._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_join)
    assert "Exchange" not in plan and "Join" not in plan
    sets = {c: set(s.tolist()) for s in jaccard._sets(pa.array([t for _, t, *_ in rows], pa.string()), 5) for c in [jaccard._class_of(s)]}
    times = Counter(h for s in sets.values() for h in s)
    alone = {c: sum(times[h] == 1 for h in s if h >> 40 < int(jaccard.SHARE * (1 << 24))) for c, s in sets.items()}
    assert {r["set_id"]: r["alone"] for r in jaccard._lonely(docs, 5, "text", 23).collect() if r["alone"]} == {c: n for c, n in alone.items() if n}
    stored = spark.createDataFrame([(c, len(s), np.array(sorted(s), np.uint64).tobytes()) for c, s in sets.items() if s], "set_id bigint, n int, elements binary").repartition(4)
    want = {c: sorted(h for h in s if times[h] > 1) for c, s in sets.items()}
    got = {r["set_id"]: sorted(np.array(r["elements"], np.int64).view(np.uint64).tolist()) for r in jaccard._shared_elements(stored).collect()}
    assert got == {c: kept for c, kept in want.items() if kept and 4 * (len(sets[c]) - len(kept)) <= len(sets[c])}


def test_one_row_of_each_component(spark):
    body = [" ".join(f"t{t}w{j}" for j in range(60)) for t in range(5)]
    rows = [(None, body[0] + " a"), (None, body[0] + " b"), (None, body[1] + " a"), (4, body[1] + " b"), (None, body[2]), (None, body[2].upper()), (5, body[3] + " a"), (5, body[3] + " b"),
            (6, body[4] + " a"), (5, body[4] + " b"), (6, "another text that stands alone"), (None, ""), (None, ""), (None, None), (5, " ")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    by = lambda t: [i for i, x in kept if x and x.lower().startswith(body[t])]
    assert [by(t) for t in range(5)] == [[None], [4], [None], [5], [5]]
    assert counted(r for r in kept if len((r[1] or "").split()) < 60) == counted([(6, "another text that stands alone"), (None, ""), (None, None), (5, " ")])


def test_every_pair_shares_a_signature():
    """Sets at the limit of similarity meet where one probes and the other has indexed."""
    r = np.random.Generator(np.random.PCG64(5))
    for n in [*range(1, 40), 60, 100, 333]:
        for _ in range(6):
            both = max(1, -(-6 * n // 7))
            extra = int(r.integers(0, max(1, (4 * both) // 3 - n + 1)))
            own, other = n - both, extra
            while 4 * both < 3 * (both + own + other):
                if other:
                    other -= 1
                else:
                    own -= 1
            x = r.integers(0, 1 << 63, both + own + other, dtype=np.uint64)
            a, b = np.sort(x[: both + own]), np.sort(np.concatenate([x[:both], x[both + own:]]))
            a, b = sorted((a, b), key=len)
            everything = np.unique(np.concatenate([jaccard._possible(a, len(a))[0], jaccard._possible(b, len(b))[0]]))
            costs = r.integers(1, 1000, len(everything))  # whatever the costs, the allocation must hold
            (ka, fa), (kb, fb) = (jaccard._allocated(x, len(x), everything, costs) for x in (a, b))
            index = defaultdict(int)
            for k, f in zip(ka, fa):
                index[k] |= int(f)
            met = any((f & (jaccard.PROBE | jaccard.PROBE_LESS) and index[k] & jaccard.INDEX) or (f & jaccard.PROBE_ONE and index[k] & jaccard.INDEX_LESS) for k, f in zip(kb, fb))
            assert met, (n, both, own, other)


def test_sketches_never_prove_too_much():
    r = np.random.default_rng(7)
    refused = 0
    for n in (1, 3, 20, 90, 300, 1500):
        for share in (0.3, 0.6, 0.86, 0.95):
            x = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            both = int(share * n)
            a, b = x[:n], np.concatenate([x[:both], x[n: 2 * n - both]])
            bits = int(np.bitwise_count((jaccard._sketch(a) ^ jaccard._sketch(b)).view(np.uint64)).sum())
            assert bits <= 2 * (n - both)
            refused += 7 * bits > 2 * n and n == 300
    assert refused == 2 and not jaccard._sketch(np.zeros(0, np.uint64)).any()


def test_family_of_texts_that_are_near_but_not_near_enough(spark):
    """Texts around one text, each with a share of its words changed: some pairs reach the limit, most do not."""
    r = np.random.default_rng(11)
    base = [f"w{i}" for i in range(240)]
    texts = []
    for i in range(40):
        words = list(base)
        at = int(r.integers(0, 60))
        words[at: at + 5 + i % 30] = [f"v{i}x{j}" for j in range(5 + i % 30)]
        if i % 3:
            words[150 + i: 170 + i] = [f"u{i % 5}x{j}" for j in range(20)]
        texts.append(" ".join(words))
    shingles = [{tuple(t.split()[j: j + 5]) for j in range(236)} for t in texts]
    of = list(range(40))
    for a in range(40):
        for b in range(a):
            if 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b]) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = [low if x == high else x for x in of]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(of))
    assert 1 < len(set(of)) < 40


# -- licenses -----------------------------------------------------------------------------------------------------

def test_license_scan_of_odd_documents(docs, rows, no_docs):
    texts, spans = licenses.scan(docs)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t, *_ in rows:
        w = pattern.findall((t or "").translate(UPPER))
        found = [(j, label) for phrase, label in licenses.PHRASES.items() for j in range(len(w)) if w[j: j + len(phrase.split())] == phrase.split()]
        starts = [j for j, _ in found]
        want.append((i, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))))
    got = texts.collect()
    assert counted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == counted(want)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[19] == "mit" and labels[20] == "cc-by-nc,mit" and labels[21] == "apache-2" and labels[0] == "" and labels[200] == ""
    assert all(0 <= r["score"] <= 1 for r in got)
    altered = [r for r in spans.collect() if r["doc_id"] == 21]
    assert len(altered) == 1 and altered[0]["share"] < 1  # "Licence" is not the template's word
    assert licenses.scan(no_docs)[0].count() == 0


def test_diagonals_merge_over_an_inserted_word(spark):
    template = licenses.TEMPLATES["bsd"][0]
    words = template.split()
    broken = " ".join(["intro"] * 7 + words[:8] + ["really"] + words[8:] + ["outro"] * 9)
    _, spans = licenses.scan(spark.createDataFrame([(1, broken)], "doc_id bigint, text string"))
    got = spans.collect()
    assert [(r["label"], r["low"], r["high"]) for r in got] == [("bsd", 7, 7 + len(licenses.words_of(template)) + 1)]


def test_near_misses_get_no_wrong_license(spark):
    gpl = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
           "either version {} of the License, or (at your option) any later version.")
    lgpl = gpl.replace("program", "library").replace("General", "Lesser General")
    want = {"Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY-ND 4.0.": "cc-by-nd", "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa",
            "Licensed under CC BY-SA 9.0.": "", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
            "This work is licensed under the GNU General Public License, version 2.": "gpl-2", "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
            "This work is licensed under the GNU General Public License, version 3.0.": "gpl-3", "This work is licensed under the GNU General Public License, version 3.1.": "",
            "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3", "This work is licensed under the GNU Free Documentation License, version 3.": "",
            "This work is licensed under the GNU Library General Public License, version 2.": "",
            gpl.format(2): "gpl-2", gpl.format(3): "gpl-3", lgpl.format("2.1"): "lgpl-2.1", lgpl.format("2.0"): "", gpl.replace("General", "Affero General").format(3): "agpl-3",
            "Licensed under the Apache License, Version 1.1.": "", "Licensed under the Eclipse Public License, Version 2.0.": "epl-2", "Licensed under the Mozilla Public License, Version 2.0.": "mpl-2",
            "Licensed under the Educational Community License, Version 2.0.": "", "Released under the BSD License.": "bsd", "Released under the ISC License.": "isc", "Released under the NCSA License.": "",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy": "mpl-2",
            licenses.TEMPLATES["isc"][1]: "isc", licenses.TEMPLATES["bsl-1"][1]: "bsl-1", licenses.TEMPLATES["mit"][3]: "mit"}
    docs = spark.createDataFrame([(i, f"some text before\n{t}\nand more behind it") for i, t in enumerate(want)], "doc_id bigint, text string")
    _, spans = licenses.scan(docs)
    found = defaultdict(set)
    for r in spans.collect():
        found[r["doc_id"]].add(r["label"])
    assert {t: ",".join(sorted(found[i])) for i, t in enumerate(want)} == want


# -- languages ----------------------------------------------------------------------------------------------------

def test_languages_of_odd_documents(spark, docs, rows, no_docs):
    got = language.identify(docs).collect()
    assert counted((r["doc_id"], r["held_out"]) for r in got) == counted((i, zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, *_ in rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 9, 25))
    assert by[None]["lang_pred"] in ("de", "en", "fr") and all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(no_docs).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    one = language.fit(docs.where("lang = 'en'"))
    known = language.keep_known(docs, one)
    assert known.columns == docs.columns and known.count() == sum(bool(t and re.search(r"[^\W\d_]", t)) for _, t, *_ in rows)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    right = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    n, ok = right.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and ok / n >= 0.97


# -- tokens -------------------------------------------------------------------------------------------------------

def reference_ids(text):
    return tokens.encoder(tokens.vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(rows):
    texts = [t for _, t, *_ in rows] + ["x <|endoftext|> y", "'s't're", "it's 'll  x'd\n 'm", "a\n\n b \t c  ", "漢字 １２ ٣ ²", "　 a b", "I'LL we'Re"]
    ids, at = tokens.Encoder(tokens.vocabulary_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference_ids(t) for t in texts]


def test_token_files_of_odd_documents(docs, rows, no_docs, tmp_path):
    got = binary.token_output(docs, tokens.vocabulary_path(), 2, f"{tmp_path}/out").collect()
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
        ids = np.array([*reference_ids(t), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert counted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == counted(want)
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix in (".bin", ".idx"))
    flat = np.concatenate([np.fromfile(tmp_path / "out" / n, "<u2") for n in names if n.endswith(".bin")])
    assert len(flat) == start
    offsets = [np.fromfile(tmp_path / "out" / n, "<i8") for n in names if n.endswith(".idx")]
    assert all(a[-1] == b[0] for a, b in zip(offsets, offsets[1:])) and offsets[-1][-1] == start
    assert binary.token_output(no_docs, tokens.vocabulary_path(), 2).count() == 0


# -- packing ------------------------------------------------------------------------------------------------------

def check_pieces(got, want, limit):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert counted((r["doc_id"], r["start"], r["length"]) for r in got).total() == len(got)
    for key, n in want.items():
        assert sum(r["length"] for r in by_doc[key]) == n
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limit
    return {k: sum(r["length"] for r in v) for k, v in by_sequence.items()}


def test_packing_of_odd_documents(docs, rows, no_docs):
    got = packing.pack(docs, tokens.vocabulary_path(), 1).collect()
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(reference_ids(t)) + 1
    filled = check_pieces(got, want, 2048)
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
    ids = {i: np.array([*reference_ids(t), 1], "<u4") for i, t, *_ in rows}
    assert all(bytes(r["ids"]) == ids[r["doc_id"]][r["start"]: r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(ids[r["doc_id"]]) for r in got)
    assert packing.pack(no_docs, tokens.vocabulary_path(), 1).count() == 0


def test_all_three_limits_hold(spark):
    rows = [(i, "question words " * (i % 17), "answer " * (1 + i % 23)) for i in range(300)]
    limits = packing.Limits(tokens=128, segments=4, loss_tokens=60)
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, ask string, text string"), tokens.vocabulary_path(), 1, limits, prompt="ask").collect()
    check_pieces(got, {i: len(reference_ids(a)) + len(reference_ids(t)) + 1 for i, a, t in rows}, 128)
    loss, segments = Counter(), Counter()
    for r in got:
        quiet = len(reference_ids(rows[r["doc_id"]][1]))
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], quiet))
        loss[r["sequence_id"]] += r["loss_tokens"]
        segments[r["sequence_id"]] += 1
    assert max(loss.values()) <= 60 and max(segments.values()) <= 4


# -- pieces -------------------------------------------------------------------------------------------------------

def best_cut(tool, word):
    """Highest sum of scores of one word, by the plain recurrence."""
    score = {tool.text[i]: s for _, (_, _, ids, scores) in tool.by_length.items() for i, s in zip(ids, scores)}
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - 16), end):
            if (piece := word[start:end]) in score:
                best[end] = max(best[end], best[start] + score[piece])
        if word[end - 1] not in score:
            best[end] = max(best[end], best[end - 1] + tool.unknown_score)
    return best[-1], score


def test_cuts_are_the_best(rows):
    tool = pieces.Pieces(tokens.vocabulary_path("piece_bpe_32k.model"))
    words = sorted({w for _, t, *_ in rows[11:40] for w in (t or "").split() if len(w) < 60})[:1500] + ["  x   y ", "naïve", "日本語", "    four"]
    ids, at = tool.encode(pa.array(words))
    for w, a, b in zip(words, at, at[1:]):
        best, score = best_cut(tool, pieces.MARK + w.replace(" ", pieces.MARK))
        assert sum(score[tool.text[i]] for i in ids[a:b]) == best, w


ODD = ["  x   y ", "naïve", "日本語" * 200, "    four", "x" * 5000, "a▁b ▁c", "", "a" + " " * 40 + "b", "\x00a\n\tb", "\U0001F600 hi\U0001F600", "the government", "internationalization" * 20, None]


def test_bpe_ids_are_the_librarys(spark, rows, sf_dir):
    model = tokens.vocabulary_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [t for _, t, *_ in rows] + ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(200).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in pieces.encode(docs, model, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t or "") for t in texts]


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_ids_of_trained_models_are_the_librarys(rows, tmp_path, kind):
    texts = [t for _, t, *_ in rows if t and len(t) < 4000]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(texts), model_prefix=f"{tmp_path}/m", model_type=kind, vocab_size=500, byte_fallback=True, normalization_rule_name="identity",
                                             remove_extra_whitespaces=False, user_defined_symbols=["<sep>", "<se", "der"], hard_vocab_limit=False, minloglevel=2)
    library = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/m.model")
    tool = pieces.pieces(f"{tmp_path}/m.model")
    texts += ODD + ["a<sep>b <sep> under<se>", "<sep><sep>the", "wonder der"]
    ids, at = tool.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "") for t in texts]


def test_pieces_of_odd_documents_come_back(docs, rows, no_docs):
    model = tokens.vocabulary_path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, model, ["doc_id"])
    got = pieces.decode(encoded, model, ["doc_id"]).collect()
    assert counted((r["doc_id"], r["text"]) for r in got) == counted((i, t or "") for i, t, *_ in rows)
    assert pieces.decode(pieces.encode(no_docs, model, ["doc_id"]), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("links", [1 << 18, 40])
def test_tasks_join_links_before_rounds(spark, monkeypatch, links):
    """Chains, stars, repeated links and loops; in one task no round follows, in several the rounds join what they leave."""
    rnd = random.Random(11)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(-5, i) for i in range(40)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(7, 7), (1, 0), (0, 1)]
    least = {}
    find = lambda x: x if least.setdefault(x, x) == x else find(least[x])
    for u, v in pairs:
        a, b = sorted((find(u), find(v)))
        least[b] = a
    monkeypatch.setattr(base, "LINKS", links)
    seen, write = [], base.staged
    monkeypatch.setattr(base, "staged", lambda df, name: seen.append(name) or write(df, name))
    got = [tuple(r) for r in base.components(spark.createDataFrame(pairs, "u bigint, v bigint").repartition(6)).collect()]
    alone = {n for n in least if all(u == v for u, v in pairs if n in (u, v))}
    assert len(got) == len(set(got)) and set(got) == {(n, find(n)) for n in least if n not in alone}
    assert ("large_star" in seen) == (links == 40)


@pytest.mark.parametrize("links", [1 << 18, 40])
@pytest.mark.parametrize("kind", ["binary", "string", "int"])
def test_nodes_of_any_type(spark, monkeypatch, links, kind):
    """Nodes keep their type and go by its order: bytes without signs, equal links of several tasks and many to a node."""
    pairs = [(i, i + 1) for i in range(1, 120)] + [(200, i) for i in range(201, 290)] + [(300, 301), (301, 300)] * 30 + [(5, 5)]
    node = {"binary": lambda i: bytes([i % 256, i // 256]), "string": lambda i: f"n{i % 256}-{i}", "int": lambda i: i - 100}[kind]
    monkeypatch.setattr(base, "LINKS", links)
    got = base.components(spark.createDataFrame([(node(u), node(v)) for u, v in pairs], f"u {kind}, v {kind}").repartition(5))
    assert dict(got.dtypes)["node"] == kind
    want = [(node(i), min(map(node, part))) for part in (range(1, 121), range(200, 290), range(300, 302)) for i in part]
    assert sorted((bytes(n) if kind == "binary" else n, bytes(c) if kind == "binary" else c) for n, c in got.collect()) == sorted(want)


def test_texts_are_split_once_for_classes_and_small_tables_take_few_tasks(spark, docs, monkeypatch):
    """With many shuffle partitions, what the sets of a few texts leave is written by few tasks, and no row is lost by it."""
    want = sorted(tuple(-1 if x is None else x for x in r) for r in jaccard.near_duplicates(docs).collect())
    parts, write = {}, jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: parts.setdefault(name, df.rdd.getNumPartitions()) and write(df, name))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(before, ("60", "false")):
            spark.conf.set(c, v)
        out = jaccard.near_duplicates(docs)
        got = sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == want and len(got) == docs.count()
    assert parts["told"] == docs.rdd.getNumPartitions() and max(n for name, n in parts.items() if name not in ("told", "classes")) < 10
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 63, i, dtype=np.uint64)) for i in (3, 0, 40, 1, 0)]
    assert jaccard._classes_of(sets).tolist() == [jaccard._class_of(s) for s in sets] and jaccard._classes_of([]).tolist() == []
