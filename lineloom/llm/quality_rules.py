"""Learned decision lists over document statistics, in DataFrame expressions only.

Statistics are Spark expressions over the text. Sequential covering learns an ordered list of rules for low-quality
documents from labelled statistics: a conjunction of thresholds is grown on two thirds of the sample by information
gain, pruned on the rest, kept while its precision holds, and the documents it covers are set aside. The list becomes
one CASE expression. Learning uses a documented sample: the labelled documents with the ``sample`` smallest hashes.

Edge cases: null, empty or blank text has no words: all statistics 0, base_failed (n_words < 50), not kept. Repeated
rows are judged alike; ties don't matter, rules depend on one row alone. Without labels of both kinds the list is empty
and keeps what passes the base. Labels: null ids or qualities are ignored, repeated labels of a document must agree,
else the document is not learned from. Other columns are kept; judge() replaces columns named _s, base_failed or kept, and
keep_good() returns the rows just as they came, whatever the names of their columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE = 10_000
MIN_WORDS, REPEAT_PERCENT = 50, 50
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Ratios that rules may use, over the statistics below.
RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "mean_word_chars": "word_chars / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "mark_share": "n_marks / word_chars",
    "words_per_line": "n_words / n_lines",
    "log_words": "ln(n_words)",
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: equal windows meet by sorting (hash, position)."""
    none = F.lit(0).cast("long")

    def of_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
            places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["i"]))
            covered = lambda p: F.aggregate(p, F.struct(none.alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")))["n"]
            return let(places, covered)

        # most texts repeat no window, which a hash set tells
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(placed, of_sorted))

    def of_words(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) > 3, let(of_words(words), of_hashes)).otherwise(none)


def statistics(text: Column) -> Column:
    """Struct of whole-text statistics: those of the contract and a few more."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
        return let(
            lines,
            lambda s: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                count(SYMBOLS).alias("n_symbols"),
                (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
                _repeated(w).alias("n_repeat_words"),
                F.size(s).cast("long").alias("n_lines"),
                count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
                count("0123456789").alias("n_digits"),
                count("!?;:\"'()[]{}@^~`\\/_=+-").alias("n_marks"),
            ),
        )

    return let(F.filter(F.split(t, BLANK, -1), lambda x: x != ""), of_words)


def ratios(stats: str) -> dict[str, Column]:
    """Ratio columns over a struct column of statistics, 0 where they have no denominator."""
    out = {}
    for name, rule in RATIOS.items():
        for field in ("n_symbols", "word_chars", "n_repeat_words", "n_dup_lines", "n_upper", "n_digits", "n_marks", "n_lines", "n_words"):
            rule = " ".join(f"{stats}.{x}" if x == field else x for x in rule.replace("(", "( ").replace(")", " )").split())
        out[name] = F.coalesce(F.expr(f"try_divide({rule.replace(' / ', ', ')})" if "/" in rule else rule), F.lit(0.0)).cast("double")
    return out


def base_failed(stats: str, min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT) -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < min_words) | (100 * r > repeat_percent * n)


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    at: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.at if self.above else row[self.name] <= self.at

    def column(self, ratio: dict[str, Column]) -> Column:
        return ratio[self.name] > F.lit(self.at) if self.above else ratio[self.name] <= F.lit(self.at)


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gain of narrowing (p0, n0) to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -1.0)


def _grow(rows: list[tuple[dict, int]], names: list[str], longest: int) -> list[Test]:
    """Tests added one by one, each with the largest information gain, until no good document is covered."""
    tests: list[Test] = []
    while len(tests) < longest:
        y = np.array([y for _, y in rows], np.int64)
        p0 = int(y.sum())
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best: tuple[float, Test | None] = (1e-9, None)
        for name in names:
            v = np.array([r[name] for r, _ in rows])
            order = np.argsort(v, kind="stable")
            v, p = v[order], np.cumsum(y[order])
            n = np.arange(1, len(v) + 1) - p
            cut = np.flatnonzero(v[1:] > v[:-1])
            for above, gain in ((False, _gain(p0, n0, p[cut], n[cut])), (True, _gain(p0, n0, p0 - p[cut], n0 - n[cut]))):
                if len(cut) and gain.max() > best[0]:
                    i = cut[int(gain.argmax())]
                    best = float(gain.max()), Test(name, above, float((v[i] + v[i + 1]) / 2))
        if best[1] is None:
            break
        tests.append(best[1])
        rows = [x for x in rows if best[1].holds(x[0])]
    return tests


def _prune(tests: list[Test], rows: list[tuple[dict, int]]) -> list[Test]:
    """Shortest prefix with the best (p - n) / (p + n) on held-back rows."""
    best, kept = -2.0, tests
    for k in range(1, len(tests) + 1):
        got = [y for r, y in rows if all(t.holds(r) for t in tests[:k])]
        worth = (2 * sum(got) - len(got)) / len(got) if got else -1.0
        if worth > best:
            best, kept = worth, tests[:k]
    return kept


def learn(rows: list[tuple[dict, int]], precision: float = 0.8, max_rules: int = 12, longest: int = 4) -> list[list[Test]]:
    """Ordered conjunctions for low quality from (ratios, 1 if low) rows, whose order fixes the grow and prune parts."""
    names, rules = list(RATIOS), []
    while len(rules) < max_rules and any(y for _, y in rows):
        grow, prune = [x for i, x in enumerate(rows) if i % 3], rows[::3]
        rule = _grow(grow, names, longest)
        if not rule:
            break
        rule = _prune(rule, prune)
        got = [y for r, y in rows if all(t.holds(r) for t in rule)]
        if not got or sum(got) < 2 or sum(got) / len(got) < precision:
            break
        rules.append(rule)
        rows = [x for x in rows if not all(t.holds(x[0]) for t in rule)]
    return rules


def verdict(rules: list[list[Test]], ratio: dict[str, Column]) -> Column:
    """True (good) unless a rule of the ordered list fires."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for t in rule:
            test = test & t.column(ratio)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Test]]:
    """Rules from the labelled documents with the ``sample`` smallest id hashes."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q1")).where("q = q1")
    known = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "q", "_h")
    # at most `sample` rows: a proven bound
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(known), "_id").select("_h", "_id", "q", statistics(F.col("_text")).alias("_s"))
    # the statistics are worked out once, before anything reads them twice
    rows = Scratch(docs.sparkSession, "rules").keep(rows.repartition(8))
    got = rows.where(~base_failed("_s")).select("_h", "_id", "q", *(c.alias(n) for n, c in ratios("_s").items())).collect()
    got.sort(key=lambda r: (r["_h"], r["_id"]))
    return learn([({n: r[n] for n in RATIOS}, int(r["q"] == 0)) for r in got])


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """docs with _s (statistics), base_failed and kept."""
    out = docs.withColumn("_s", statistics(F.col("text")))
    failed = base_failed("_s")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules, ratios("_s")))


def keep_good(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """Rows of docs, as they are, that pass the base and the rules."""
    packed = docs.select(F.col("text"), F.struct("*").alias("row"))
    return judge(packed, rules).where("kept").select("row.*")
