"""Row features of an enriched ticket.

A feature block is a function ``columns -> {name: Column}``: given the names a table has, it returns the
expressions it can compute. All blocks go into one projection, so 37 features cost one pass and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens import params

Block = Callable[[Collection[str]], dict[str, Column]]
LEVELS = (1, 2, 3)


def _group(level: int) -> str:
    return f"TAB_N{level}_GROUP"


def _score(level: int) -> str:
    return f"TAB_N{level}_SENT_SCORE"


def _mood(level: int) -> str:
    return f"TAB_N{level}_SENT_LABEL"


def _flag(condition: Column) -> Column:
    """0/1 indicator; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def mentions(column: str, pattern: str) -> Column:
    """Case-insensitive search, accented letters included."""
    return F.col(column).rlike(f"(?iu){pattern}")


def critical_cluster_block(critical: Sequence[tuple[str, str, str]] = tuple(params.CRITICAL_CLUSTERS)) -> Block:
    """An indicator per critical cluster; several labels of one name are alternatives."""
    labels: dict[tuple[str, str], list[str]] = {}
    for tab, name, label in critical:
        labels.setdefault((tab, name), []).append(label)

    def block(columns: Collection[str]) -> dict[str, Column]:
        return {
            f"count_{tab.lower()}_{name}": _flag(F.col(f"{tab}_GROUP").isin(texts))
            for (tab, name), texts in labels.items()
            if f"{tab}_GROUP" in columns
        }

    return block


def sentiment_block(columns: Collection[str]) -> dict[str, Column]:
    """Per text level: an indicator for each mood, and the score with 0 for missing."""
    out = {}
    for level in LEVELS:
        if _mood(level) not in columns:
            continue
        for mood in (params.NEGATIVE, params.NEUTRAL, params.POSITIVE):
            out[f"prop_tab_n{level}_{mood}"] = _flag(F.col(_mood(level)) == mood)
        if _score(level) in columns:
            out[f"sent_score_tab_n{level}"] = F.coalesce(_score(level), F.lit(0.0))
    return out


def escalation_block(columns: Collection[str]) -> dict[str, Column]:
    """Indicators of a mood that gets worse from the coarse to the fine level."""
    present = {level for level in LEVELS if _mood(level) in columns}

    def mood_in(level: int, *moods: str) -> Column:
        return F.col(_mood(level)).isin(*moods)

    out: dict[str, Column] = {}
    if 3 not in present:
        return out
    ends_badly = mood_in(3, params.NEGATIVE)
    for level in (1, 2):
        if level in present:
            out[f"escalation_n{level}_to_n3"] = _flag(mood_in(level, params.NEUTRAL) & ends_badly)
    if present == set(LEVELS):
        slide = mood_in(1, params.POSITIVE, params.NEUTRAL) & mood_in(2, params.NEUTRAL, params.NEGATIVE) & ends_badly
        out["degradacao_continua"] = _flag(slide)
    return out


def flag_block(columns: Collection[str]) -> dict[str, Column]:
    """Indicators of critical situations. The billing flag exists even for a table without any group column."""
    fine = _group(3)
    billing = F.lit(False)
    for level in LEVELS:
        if _group(level) in columns:
            billing = billing | F.coalesce(mentions(_group(level), params.BILLING_PATTERN), F.lit(False))
    out = {"flag_teve_cobranca": _flag(billing)}
    if fine in columns:
        out["flag_problema_tecnico_grave"] = _flag(F.col(fine).isin(params.SEVERE_TECHNICAL_LABELS))
        out["flag_mencionou_cancelamento"] = _flag(mentions(fine, params.CANCELLATION_PATTERN))
        out["flag_bloqueado"] = _flag(mentions(fine, params.BLOCKED_PATTERN))
    if _mood(3) in columns:
        out["flag_insatisfacao_n3"] = _flag(F.col(_mood(3)) == params.NEGATIVE)
    return out


def row_mean(names: Sequence[str]) -> Column:
    """Mean of the known values of a row, null if none is known."""
    total, known = F.lit(0.0), F.lit(0)
    for name in names:
        total = total + F.coalesce(name, F.lit(0.0))
        known = known + F.col(name).isNotNull().cast("int")
    return F.when(known > 0, total / known)


def row_std(names: Sequence[str]) -> Column:
    """Sample standard deviation of the known values of a row, 0 for fewer than two.

    From the squared gaps between pairs of values, which needs no mean: exact zeros stay zero, and the generated
    code stays small enough to be compiled.
    """
    squares, known = F.lit(0.0), F.lit(0)
    for i, name in enumerate(names):
        known = known + F.col(name).isNotNull().cast("int")
        for other in names[:i]:
            gap = F.col(name) - F.col(other)
            squares = squares + F.coalesce(gap * gap, F.lit(0.0))
    return F.when(known > 1, F.sqrt(squares / (known * (known - 1)))).otherwise(F.lit(0.0))


def score_block(columns: Collection[str]) -> dict[str, Column]:
    """Spread of the scores over the levels, and how many levels are negative or positive."""
    out = {}
    scores = [_score(level) for level in LEVELS if _score(level) in columns]
    if scores:
        lowest = F.least(*scores) if len(scores) > 1 else F.col(scores[0])
        highest = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
        out["sent_score_mean"] = row_mean(scores)
        out["sent_score_min"] = lowest
        out["sent_score_max"] = highest
        out["sent_score_std"] = row_std(scores)
    moods = [_mood(level) for level in LEVELS if _mood(level) in columns]
    if moods:
        for mood, name in ((params.NEGATIVE, "count_insatisfacao_total"), (params.POSITIVE, "count_positivo_total")):
            hits = F.lit(0)
            for column in moods:
                hits = hits + F.coalesce(F.col(column) == mood, F.lit(False)).cast("int")
            out[name] = hits
    return out


DEFAULT_BLOCKS: tuple[Block, ...] = (
    critical_cluster_block(),
    sentiment_block,
    escalation_block,
    flag_block,
    score_block,
)


def feature_columns(columns: Iterable[str], blocks: Sequence[Block] = DEFAULT_BLOCKS) -> dict[str, Column]:
    """Name -> expression of every feature the table allows. A name that exists already keeps its first meaning."""
    existing = set(columns)
    found: dict[str, Column] = {}
    for block in blocks:
        for name, column in block(existing).items():
            if name not in existing:
                found.setdefault(name, column)
    return found


def build_features(df: DataFrame, blocks: Sequence[Block] = DEFAULT_BLOCKS) -> DataFrame:
    """The table with all features appended in one projection; the label column is untouched."""
    features = feature_columns(df.columns, blocks)
    return df.select("*", *[column.alias(name) for name, column in features.items()])


def feature_names(df: DataFrame, blocks: Sequence[Block] = DEFAULT_BLOCKS) -> list[str]:
    return list(feature_columns(df.columns, blocks))


def occurrences(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """How many rows each 0/1 feature marks, as (feature, occurrences): one aggregate over all of them."""
    sums = df.agg(*[F.coalesce(F.sum(F.col(n).cast("long")), F.lit(0)).alias(n) for n in names])
    return sums.unpivot([], list(names), "feature", "occurrences")
