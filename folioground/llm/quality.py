"""Quality rules: decision lists learned by sequential covering, run as ordered conditional expressions.

Everything is DataFrame functions: statistics of a text are built-in expressions over its words and lines, rules
are grown and pruned on counts that Spark aggregates over all labelled rows, and the result is one chain of
``when`` conditions.

Defined cases: a null or empty text has no words, all statistics are 0 and the fixed rules reject it; null labels
and labels without a document teach nothing; a document labelled more than once counts with its lowest label;
repeated documents are judged alike, one result a row; without labels, or with one class only, the list is empty
and only the fixed rules hold; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from folioground.staging import stage_table

BLANK = " \t\n\u000b\f\r"
_BREAK = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may ask about; every statistic is a ratio or a length and 0 where its base is 0.
FEATURES = ["n_words", "mean_word", "symbol_ratio", "upper_ratio", "mark_ratio", "repeat_ratio", "distinct_ratio", "dup_line_ratio"]


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _repeated_words(words: str) -> tuple[Column, Column]:
    """The mask of a place (named ``_low`` before the second is used) and the number of words that stand in a 3-word
    window found twice or more in the text.

    Windows are hashed to the high bits of a long whose low bits hold the place, so that a plain sort of longs
    brings equal windows together; the few windows with a neighbour of equal high bits are compared as words.
    """
    w = F.col(words)
    last = F.size(w) - 3
    bits = F.length(F.bin(F.size(w)))
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

    def packed(i: Column) -> Column:
        h = F.xxhash64(w[i], w[i + 1], w[i + 2])
        return h.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("bigint"))

    def near(s: Column, x: Column, i: Column, same) -> Column:
        before = F.when(i > 0, same(x, s[i - 1])).otherwise(False)
        after = F.when(i < F.size(s) - 1, same(x, s[i + 1])).otherwise(False)
        return before | after

    def let(value: Column, fn) -> Column:
        return F.transform(F.array(value), fn)[0]

    def candidates(s: Column) -> Column:
        high = lambda a: a.bitwiseAND(F.bitwise_not(F.col("_low")))
        return F.transform(F.filter(s, lambda x, i: near(s, x, i, lambda a, b: high(a) == high(b))), lambda x: x.bitwiseAND(F.col("_low")).cast("int"))

    def exact(places: Column) -> Column:
        windows = F.array_sort(F.transform(places, lambda p: F.struct(w[p].alias("a"), w[p + 1].alias("b"), w[p + 2].alias("c"), p.alias("p"))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return let(windows, lambda s: F.filter(s, lambda x, i: near(s, x, i, same)))

    def covered(found: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    places = let(F.sort_array(F.transform(F.sequence(F.lit(0), last), packed)), candidates)
    return low, F.when(last < 0, 0).otherwise(let(places, lambda p: F.when(F.size(p) == 0, 0).otherwise(covered(exact(p)))))


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the statistics of every whole text; nothing is shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    low, repeated = _repeated_words("_words")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    trimmed = docs.select(*keep, body.alias("_text"), F.btrim(body, F.lit(BLANK)).alias("_trim"))
    split = trimmed.select(*keep, "_text", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", _BREAK)).alias("_words"),
                           F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "").alias("_lines"))
    counted = split.select(
        *keep, "_words", low.alias("_low"), F.size("_words").cast("bigint").alias("n_words"), F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(_SYMBOL)).cast("bigint").alias("n_symbols"), F.regexp_count("_text", F.lit("[A-Z]")).alias("_upper"),
        F.regexp_count("_text", F.lit("[!?=~^_]")).alias("_marks"), F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), F.size(F.array_distinct("_words")).alias("_distinct"))
    whole = counted.select(*keep, *COUNTS[:-1], repeated.cast("bigint").alias("n_repeat_words"), "_upper", "_marks", "_n_lines", "_distinct")
    return whole.select(
        *keep, *COUNTS, ratio("word_chars", "n_words").alias("mean_word"), ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("_upper", "word_chars").alias("upper_ratio"), ratio("_marks", "word_chars").alias("mark_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("_distinct", "n_words").alias("distinct_ratio"), ratio("n_dup_lines", "_n_lines").alias("dup_line_ratio"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _grid(rows: DataFrame, cuts: int) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each statistic within each class."""
    points = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(f, points, 1000).alias(f) for f in FEATURES)).collect()  # two rows
    return {f: sorted({float(x) for row in found for x in row[f] or []}) for f in FEATURES}


def _tallies(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """(bad, all) rows by statistic and bin; as many rows come back as there are bins."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES if thresholds[f])))
    out = rows.select(pairs.alias("_x"), "bad").groupBy("_x.feature", "_x.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    return {(r["feature"], r["bin"]): (int(r["bad"]), int(r["n"])) for r in out}


def _best(tallies, thresholds, total_bad: int, total: int, least: int) -> Condition | None:
    """Condition with the highest gain of information over the rows that are still covered."""
    import math

    prior, best, gain = math.log2(total_bad / total), None, 1e-9
    for feature, cuts in thresholds.items():
        bad = n = 0
        for i, cut in enumerate(cuts):
            b, k = tallies.get((feature, i), (0, 0))
            bad, n = bad + b, n + k
            for at_least, (p, all_) in ((False, (bad, n)), (True, (total_bad - bad, total - n))):
                if p >= least and all_ < total and (g := p * (math.log2(p / all_) - prior)) > gain:
                    best, gain = Condition(feature, at_least, cut), g
    return best


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, cuts: int = 16, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Ordered rules that reject, by sequential covering over all ``labelled`` rows (FEATURES, ``bad`` 0/1, ``fold`` 0-2).

    A rule grows by the condition of highest information gain on folds 0 and 1 and drops final conditions as
    long as that does not lower (bad - good) / covered on fold 2. Covered rows are taken out before the next rule.
    A rule that is right for less than ``precision`` of what it covers, in either part, ends the list. Each step
    is one aggregation over binned rows; the driver sees counts by bin only.
    """
    thresholds = _grid(labelled, cuts)
    if not any(thresholds.values()):
        return []
    binned = stage_table(labelled.select("bad", "fold", *FEATURES, *(
        sum((F.when(F.col(f) >= F.lit(t), 1).otherwise(0) for t in thresholds[f]), F.lit(0)).alias(f"bin_{f}") for f in FEATURES)), "binned")
    grow, rules, left = F.col("fold") < 2, [], F.lit(True)
    for _ in range(max_rules):
        rule: Rule = ()
        while len(rule) < max_conditions:
            covered = binned.where(left & grow & reduce(lambda a, c: a & c.column(), rule, F.lit(True)))
            tallies = _tallies(covered, thresholds)
            some = next((f for f in FEATURES if thresholds[f]), None)
            bad = sum(b for (f, _), (b, _) in tallies.items() if f == some)
            n = sum(k for (f, _), (_, k) in tallies.items() if f == some)
            if bad < least or bad == n or not (found := _best(tallies, thresholds, bad, n, least)):
                break
            rule += (found,)
        if not rule:
            break
        heads = [reduce(lambda a, c: a & c.column(), rule[:i], F.lit(True)) for i in range(1, len(rule) + 1)]
        sums = binned.where(left).agg(*(F.sum(F.when(h & part, value).otherwise(0)).alias(f"{what}{i}") for i, h in enumerate(heads)
                                        for what, part, value in (("pb", ~grow, F.col("bad")), ("pn", ~grow, F.lit(1)), ("gb", grow, F.col("bad")), ("gn", grow, F.lit(1))))).first()
        worth = lambda i: (2 * sums[f"pb{i}"] - sums[f"pn{i}"]) / sums[f"pn{i}"] if sums[f"pn{i}"] else -1.0
        at = max(range(len(rule)), key=lambda i: (worth(i), -i))
        right = min(sums[f"{p}b{at}"] / max(sums[f"{p}n{at}"], 1) for p in ("g", "p"))
        if right < precision:
            break
        rules.append(rule[: at + 1])
        left = left & ~heads[at]
    return rules


def rejecting_rule(rules: list[Rule]) -> Column:
    """Number from 1 of the first rule that holds; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = None
    for i, rule in enumerate(rules, 1):
        holds = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return out.cast("int")


def training_rows(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics of the labelled documents that pass the fixed rules, with ``bad`` and the fold."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    rows = stats.where(~base_failed()).join(known, F.col(key) == F.col("_key"))
    return rows.select(*FEATURES, (F.col("_label") == 0).cast("int").alias("bad"), F.pmod(F.xxhash64(F.col("_key")), F.lit(3)).alias("fold"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> tuple[DataFrame, list[Rule]]:
    """Statistics and verdict of every row (key, COUNTS, base_failed, rule, kept) and the learned rules.

    The statistics are written once and serve both the learning and the verdicts.
    """
    stats = stage_table(text_statistics(docs, [key], text), "statistics")
    rules = learn(training_rows(stats, labels, key), **limits)
    judged = stats.select(key, *COUNTS, base_failed().alias("base_failed"), rejecting_rule(rules).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def learn_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, **limits) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled documents, chosen by a hash of their id; only their texts are read closely."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    sample = known.orderBy(F.xxhash64(F.lit("quality"), key), key).limit(max_rows)
    some = docs.select(key, text).join(F.broadcast(sample.select(key)), key, "left_semi")  # max_rows rows
    stats = stage_table(text_statistics(some, [key], text), "sampled_statistics")
    return learn(training_rows(stats, sample, key, label), **limits)


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the fixed and the learned rules, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_body"))
    # The place of a row keeps the conditions above the statistics: moved into the scan, they would repeat them.
    judged = text_statistics(rows, ["_row"], "_body").withColumn("_place", F.monotonically_increasing_id())
    return judged.where((F.col("_place") >= 0) & ~base_failed() & rejecting_rule(rules).isNull()).select("_row.*")
