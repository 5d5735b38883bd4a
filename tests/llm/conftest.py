"""Documents with everything that real tables hold: nulls, empty and very long texts, copies, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

CLASHES = ["score", "key", "row", "set_id", "shard", "slot", "ids", "n_words", "u", "v", "part", "_text", "component_id", "base", "kept"]


def prose(seed: int, words: int, syllables="the of an re ing tion er at on sh") -> str:
    r = random.Random(seed)
    parts = syllables.split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(words))


def near(text: str, seed: int, changes: int) -> str:
    words, r = text.split(" "), random.Random(seed)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"w{r.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    base = prose(1, 200)
    texts = [None, "", " \n\t ", "one", "two words", "ONE", "a b c d e", "A b c d E", "é ü ß", "12 34 !!", "don't  stop\n\n'tis  it's", prose(2, 20_000),
             "x" * 50_000, base, base, base.upper(), near(base, 3, 2), near(base, 4, 5), near(base, 5, 60), prose(6, 60) + "\nReleased under the MIT License.\n" + prose(7, 30),
             "Licensed under CC BY-NC 4.0. under the mit license under the MIT license", prose(8, 80) + " Licensed under the Apache Licence, Version 2.0. " + prose(9, 40),
             "der die das und ist ein " * 30, "les des une dans pour avec " * 30, "dup line here\n" * 5 + "other", "#" * 40 + " | " * 30]
    out = [(i, t, ["en", "de", "fr", None][i % 4], f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(100 + i, near(base, 50 + i, 3), "en", "src0", 1) for i in range(25)]
    out += [(200 + i, prose(300 + i, 70 + i), "en", None, None) for i in range(30)]
    out += [(300 + i, prose(400 + i, 70 + i, "der sch ung ich ein zu für ß keit"), "de", None, None) for i in range(30)]
    out.append(out[13])  # a repeated row
    out.append((None, "no id at all", None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
