"""Quality rules as a learned decision list (operator 4); native functions only.

Text statistics are Column expressions evaluated where the text is read. The
list is learned by sequential covering: on a bounded sample of labelled rows
the statistics are cut at quantiles of both classes and counted per cell by
Spark; from these counts the driver grows rules (conjunctions of thresholds)
by information gain on two thirds of the rows and prunes them on the rest. A
rule stays only if it is precise on the pruning rows. The result is an ordered
``when`` expression; text that no rule catches is kept.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodline.llm.common import WORD_SEPARATORS, written

#: Bound of the training sample (expected number of labelled rows).
TRAIN_ROWS = 16_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
QUANTILES = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
MAX_RULES = 12
MAX_CONDITIONS = 4
#: Precision on the pruning rows and positives on all rows that a rule needs.
MIN_PRECISION = 0.95
MIN_POSITIVES = 12


def _removed(text: Column, characters: str) -> Column:
    """How many of the ASCII ``characters`` the text holds."""
    rest = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def text_statistics(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_bangs of every row; null counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(t, f"[{WORD_SEPARATORS}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WORD_SEPARATORS}]"))
    split = docs.select(
        *keep, words.alias("_w"), lines.alias("_l"), _removed(t, SYMBOLS).alias("n_symbols"),
        (F.char_length(t) - _removed(t, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _removed(t, "!").alias("n_bangs"))
    names = [*keep, "n_symbols", "word_chars", "n_bangs"]
    hashed = split.select(
        *names, F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_w"))
    # one hash for each window, from its words' hashes (each taken by index:
    # a slice would copy the whole array); without an equal pair a text is done
    n = F.size("_w")
    hashes = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("_w")[i + k] for k in range(WINDOW)]))) \
        .otherwise(F.array().cast("array<bigint>"))
    counted = hashed.select(*names, "n_lines", "n_dup_lines", n.cast("long").alias("n_words"), hashes.alias("_h"))
    names += ["n_words", "n_lines", "n_dup_lines"]
    # (hash, place) pairs in order: equal windows are neighbours
    pairs = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform(
        "_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = counted.select(*names, pairs.alias("_p"))
    left = F.concat(F.array(F.lit(None).cast("bigint")), F.col("_p.h"))
    right = F.concat(F.slice(F.col("_p.h"), 2, F.greatest(F.size("_p"), F.lit(1))),
                     F.array(F.lit(None).cast("bigint")))
    # arrays_zip pads to the longest; its last entry has no pair and drops out
    zipped = ordered.select(*names, F.when(F.col("_p").isNotNull(), F.arrays_zip(
        F.col("_p").alias("p"), left.alias("a"), right.alias("b"))).alias("_z"))
    places = F.sort_array(F.transform(
        F.filter("_z", lambda z: (z["p"]["h"] == z["a"]) | (z["p"]["h"] == z["b"])), lambda z: z["p"]["i"]))
    placed = zipped.select(*names, places.alias("_at"))
    # windows overlap: a window adds only the words behind the one before it
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"),
                                p.alias("last")),
        lambda acc: acc["n"])
    return placed.select(*names, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The quantities that rules compare with thresholds."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"words": F.col("n_words").cast("double"), "chars_per_word": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"), "bangs_per_word": share("n_bangs", "n_words"),
            "dup_lines": share("n_dup_lines", "n_lines"), "repeat_words": share("n_repeat_words", "n_words"),
            "words_per_line": share("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def column(self) -> Column:
        m = measures()[self.measure]
        return m >= self.threshold if self.above else m < self.threshold


Cell = tuple[tuple[int, ...], bool, int, int]  # bins, pruning fold, bad rows, good rows


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information gain of narrowing (p0, n0) to (p1, n1)."""
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else 0.0


def _holds(cell: Cell, conditions: list[tuple[int, bool, int]]) -> bool:
    return all((cell[0][m] >= k) == above for m, above, k in conditions)


def _totals(cells: list[Cell]) -> tuple[int, int]:
    return sum(c[2] for c in cells), sum(c[3] for c in cells)


def _grow(cells: list[Cell], widths: list[int]) -> list[tuple[int, bool, int]]:
    """Conditions (measure, above, bin) added one by one by largest gain."""
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < MAX_CONDITIONS:
        p, n = _totals(cells)
        if not p or not n:
            break
        best, choice = 1e-9, None
        for m, width in enumerate(widths):
            by_bin = defaultdict(lambda: [0, 0])
            for c in cells:
                by_bin[c[0][m]][0] += c[2]
                by_bin[c[0][m]][1] += c[3]
            low_p = low_n = 0
            for k in range(1, width + 1):
                low_p, low_n = low_p + by_bin[k - 1][0], low_n + by_bin[k - 1][1]
                for above, (q, r) in ((True, (p - low_p, n - low_n)), (False, (low_p, low_n))):
                    g = _gain(p, n, q, r)
                    if g > best:
                        best, choice = g, (m, above, k)
        if choice is None:
            break
        rule.append(choice)
        cells = [c for c in cells if _holds(c, [choice])]
    return rule


def cover(cells: list[Cell], widths: list[int]) -> list[list[tuple[int, bool, int]]]:
    """Ordered rules by sequential covering over class counts of cells."""
    rules = []
    while len(rules) < MAX_RULES:
        rule = _grow([c for c in cells if not c[1]], widths)
        held_out = [c for c in cells if c[1]]
        scored = []
        for size in range(1, len(rule) + 1):  # prune: drop last conditions
            p, n = _totals([c for c in held_out if _holds(c, rule[:size])])
            scored.append(((p - n) / (p + n) if p + n else -1.0, -size, p, n))
        if not scored:
            break
        worth, size, p, n = max(scored)
        rule = rule[:-size]
        caught = _totals([c for c in cells if _holds(c, rule)])
        if not p + n or p / (p + n) < MIN_PRECISION or caught[0] < MIN_POSITIVES:
            break
        rules.append(rule)
        cells = [c for c in cells if not _holds(c, rule)]
    return rules


def _bin(value: Column, edges: list[float]) -> Column:
    """How many of the edges the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge <= value))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    """Rules that catch documents labelled quality 0. Labels with a null are
    not used; of several labels of a document the lowest counts. Without
    labels, or with one class only, there is no rule."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
             .agg((F.min("quality") == 0).alias("_bad")))
    total = known.count()
    if not total:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20))
    sample = known.filter(draw < int(min(1.0, train_rows / total) * (1 << 20)))
    # about train_rows ids of 8 bytes: bounded, so broadcast to the text
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    named = measures()
    # written first: a filter would be pushed below and repeat the statistics
    stats = written(text_statistics(rows, "doc_id", "_bad")).filter(~base_failed())
    stats = stats.select("doc_id", "_bad", *[c.alias(k) for k, c in named.items()])
    cuts = stats.groupBy("_bad").agg(*[F.percentile_approx(k, QUANTILES, 20_000).alias(k) for k in named]).collect()
    if len(cuts) < 2:
        return []
    edges = {k: sorted({v for r in cuts for v in r[k]}) for k in named}
    bins = [_bin(F.col(k), edges[k]).alias(f"_{k}") for k in named]
    fold = (F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(3)) == 0).alias("_fold")
    # at most one cell a sampled row; counts, not rows, reach the driver
    counts = (stats.select(*bins, fold, "_bad").groupBy(*[f"_{k}" for k in named], "_fold")
              .agg(F.sum(F.col("_bad").cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).collect())
    cells = [(tuple(r[f"_{k}"] for k in named), r["_fold"], r["p"], r["n"] - r["p"])
             for r in sorted(counts, key=lambda r: [*(r[f"_{k}"] for k in named), r["_fold"]])]
    keys = list(named)
    return [[Condition(keys[m], above, edges[keys[m]][k - 1]) for m, above, k in rule]
            for rule in cover(cells, [len(edges[k]) for k in keys])]


def rule_number(rules: list[list[Condition]]) -> Column:
    """Number (from 1) of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, [c.column() for c in rules[i - 1]]), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, rule (first
    rule that holds, null if none or base_failed), kept. Null and empty texts
    have no words and fail the base; repeated rows each give a row; further
    columns are ignored; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = text_statistics(rows, "doc_id").withColumn("base_failed", base_failed())
    return (stats.withColumn("rule", F.when(~F.col("base_failed"), rule_number(rules)))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
