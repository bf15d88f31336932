"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are computed in one pass (``text_statistics``). From labelled ones a list of rules for bad documents is learned:
each rule is a conjunction of thresholds, grown on two thirds of what is not yet covered by the condition with the best information gain,
then pruned on the other third from its end while that does not lower (bad - good) / (bad + good); a rule that is not good enough on the
pruning third ends the list. The list becomes one Spark ``CASE`` over the statistics, so applying it is plain column work.

Defined results: null text has no words and fails the base rules; empty label table gives the base rules alone; repeated documents are
judged each; other columns of the input are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import WHITE, arrow_map, texts_of
from ticketlens.llm.labelled import label_sample

# ---- fixed values
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Labelled documents the list is learned from, at most.
FIT_ROWS = 40_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_upper", "n_digits", "n_marks", "n_letters", "n_same_next", "n_distinct")
STATISTICS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE_COUNTS)
_UPPER, _DIGIT, _MARK = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[0-9]+"), re.compile(r"[!?]+")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered = np.zeros(len(words), bool)
    at = np.flatnonzero(np.fromiter((counts[g] > 1 for g in grams), bool, len(grams)))
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    chars = len(text) - sum(map(text.count, WHITE))
    upper = sum(map(len, _UPPER.findall(text)))
    digits, marks = sum(map(len, _DIGIT.findall(text))), sum(map(len, _MARK.findall(text)))
    same = sum(a == b for a, b in zip(words, words[1:]))
    symbols = sum(map(text.count, SYMBOLS))
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words),
        len(lines), upper, digits, marks, chars - symbols - digits - marks, same, len(set(words)),
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text, in one pass over the whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*map(text_counts, texts_of(batch))) if batch.num_rows else [[] for _ in COUNTS + MORE_COUNTS]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *COUNTS, *MORE_COUNTS])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, STATISTICS_SCHEMA)


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What conditions may be about.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _per("word_chars", "n_words"),
    "symbol_share": lambda: _per("n_symbols", "word_chars"),
    "dup_line_share": lambda: _per("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _per("n_repeat_words", "n_words"),
    "upper_share": lambda: _per("n_upper", "word_chars"),
    "digit_share": lambda: _per("n_digits", "word_chars"),
    "mark_share": lambda: _per("n_marks", "word_chars"),
    "same_next_share": lambda: _per("n_same_next", "n_words"),
    "distinct_share": lambda: _per("n_distinct", "n_words"),
}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for condition in rule:
        hit &= condition.holds(x[condition.feature])
    return hit


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold, in whichever direction, with the most information gained for bad rows. Ties go to the first feature."""
    p0, n0 = bad.sum(), (~bad).sum()
    if p0 == 0 or n0 == 0:
        return 0.0, None
    now, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, p = values[order], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_p, below = p[cut].astype(float), cut + 1.0
        for above in (False, True):
            pos, all_ = (p0 - below_p, len(v) - below) if above else (below_p, below)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / all_) - now), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = _covers(rule, x, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int = 4, max_rules: int = 12, least_worth: float = 0.8) -> list[Rule]:
    """Ordered rules for bad rows. ``least_worth``: 0.8 asks for nine bad rows to one good one on the pruning third."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < max_rules and bad[left].sum() >= 3:
        grow, prune = left[left % 3 != 0], left[left % 3 == 0]
        rule: Rule = ()
        inside = grow
        while len(rule) < max_conditions and not bad[inside].all():
            _, condition = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
            if condition is None:
                break
            rule += (condition,)
            inside = inside[condition.holds(x[condition.feature][inside])]
        if not rule:
            break
        held = {k: v[prune] for k, v in x.items()}
        while len(rule) > 1 and _worth(rule[:-1], held, bad[prune]) >= _worth(rule, held, bad[prune]):
            rule = rule[:-1]
        if _worth(rule, held, bad[prune]) < least_worth:
            break
        rules.append(rule)
        left = left[~_covers(rule, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def fit(statistics: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> list[Rule]:
    """Learn from at most ``limit`` labelled rows (quality 0 is bad) that pass the base rules."""
    sample = label_sample(labels, "quality", limit).withColumnRenamed("doc_id", "_id")
    rows = statistics.filter(~base_failed()).join(sample, F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.col("doc_id"), (F.col("y") == 0).alias("bad"), *[f().alias(k) for k, f in FEATURES.items()])
    frame = rows.orderBy(F.md5(F.col("doc_id").cast("string")), *FEATURES).limit(limit).toPandas()  # bounded by ``limit``
    return learn({k: frame[k].to_numpy(float) for k in FEATURES}, frame["bad"].to_numpy(bool))


def rule_number(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds &= condition.column()
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    out = statistics.withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in rules]
