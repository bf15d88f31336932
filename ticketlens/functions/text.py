"""Text functions as Spark expressions, so they stay inside the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlens import params

ColumnOrName = Column | str

# Whitespace that a Unicode-aware strip removes.
_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORD = r"[\p{L}\p{N}_]{2,}"


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: ColumnOrName) -> Column:
    return F.regexp_replace(_col(text), f"^{_SPACE}|{_SPACE}$", "")


def prepare_text(text: ColumnOrName, null_text: str = "nan") -> Column:
    """Text as the encoders see it. A missing text reads ``nan``, or ``null_text`` if given."""
    return strip(F.coalesce(_col(text), F.lit(null_text)))


@cache
def _fold_tables() -> tuple[str, str, tuple[str, ...], tuple[str, ...]]:
    """What the ASCII characters of a character's compatibility form are: (from, to) for one, (from, to) for several of them.

    All code points that have such a form; those without one go away later.
    """
    one, to_one, many, to_many = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128)
        if len(plain) == 1:
            one.append(chr(code))
            to_one.append(plain)
        elif plain:
            many.append(chr(code))
            to_many.append(plain)
    return "".join(one), "".join(to_one), tuple(many), tuple(to_many)


def normalize_text(text: ColumnOrName) -> Column:
    """Upper case, accents removed, ASCII only, stripped; null gives an empty text.

    Characters are replaced by the ASCII part of their compatibility form, in all scripts. Texts of Latin letters below
    U+0250 need a short table only. Characters that stand for several ones are first moved into one range of private characters, whose
    own ones go; only texts that then have one of these are cut into pieces.
    """
    one, to_one, many, to_many = _fold_tables()
    private = [chr(0xE000 + i) for i in range(len(many))]
    marked = F.translate(F.upper(_col(text)), "".join([*many, *private]), "".join(private))
    several = f"[{private[0]}-{private[-1]}]"
    table = F.map_from_arrays(F.lit(private), F.lit(list(to_many)))
    pieces = F.split(marked, f"(?<={several})|(?={several})")
    opened = F.concat_ws("", F.transform(pieces, lambda c: F.coalesce(F.try_element_at(table, c), c)))
    single = F.when(marked.rlike(several), opened).otherwise(marked)
    near = [i for i, c in enumerate(one) if ord(c) < 0x250]
    latin = F.translate(single, "".join(one[i] for i in near), "".join(to_one[i] for i in near))
    folded = F.when(single.rlike(r"[^\x{0}-\x{24f}]"), F.translate(single, one, to_one)).otherwise(latin)
    ascii_only = F.regexp_replace(folded, r"[^\x{0}-\x{7f}]", "")
    return F.coalesce(F.regexp_replace(ascii_only, r"^[\x{9}-\x{d}\x{1c}-\x{20}]+|[\x{9}-\x{d}\x{1c}-\x{20}]+$", ""), F.lit(""))


def tokens(text: ColumnOrName, stopwords: Sequence[str] = tuple(params.STOPWORDS)) -> Column:
    """Lower-case words of two or more characters, without stopwords, in text order."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(_WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stopwords)))


def has_token(text: ColumnOrName, stopwords: Sequence[str] = tuple(params.STOPWORDS)) -> Column:
    """Whether ``tokens`` finds any. Most texts show one, with its end, in their first characters; only others are read as a whole."""
    mark = r"[\p{L}\p{N}_]"
    stop = "|".join(re.escape(w) for w in stopwords)
    token = rf"(?<!{mark})(?!(?:{stop})(?!{mark})){_WORD}" if stop else _WORD
    begin = F.lower(F.substring(_col(text), 1, 200))
    return begin.rlike(rf"{token}+(?!{mark}|$)") | F.lower(_col(text)).rlike(token)


def one_and_two_grams(words: ColumnOrName) -> Column:
    """The words, followed by all pairs of neighbours."""
    words = _col(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def term_counts(terms: ColumnOrName) -> Column:
    """Distinct terms of an array with their counts, as ``array<struct<term, tf>>``.

    Runs of the sorted array are counted in place: the text is not exploded and not shuffled for this.
    """
    ordered = F.sort_array(_col(terms))

    def runs(words: Column) -> Column:
        size = F.size(words)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
        )
        return _bind(
            starts,
            lambda at: F.transform(
                at,
                lambda start, i: F.struct(
                    F.get(words, start).alias("term"),
                    (F.coalesce(F.get(at, i + 1), size) - start).cast("long").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(_col(terms)) > 0, _bind(ordered, runs)).otherwise(empty)


def _bind(value: Column, body) -> Column:
    """``body(value)`` for array values, with ``value`` computed once."""
    return F.flatten(F.transform(F.array(value), body))


def label_sentiment(score: ColumnOrName, bounds: tuple[float, float] = params.SENTIMENT_BOUNDS) -> Column:
    """Mood of a score; both bounds are inclusive, a missing score is neutral."""
    score = F.nanvl(_col(score).cast("double"), F.lit(None))
    low, high = bounds
    return (
        F.when(score <= F.lit(float(low)), params.NEGATIVE)
        .when(score >= F.lit(float(high)), params.POSITIVE)
        .otherwise(params.NEUTRAL)
    )


def feature_kind(name: ColumnOrName) -> Column:
    """Report kind of a feature name; the order of the rules matters."""
    name = _col(name)
    kind = None
    for parts, label in params.FEATURE_KINDS:
        hit = F.lit(False)
        for part in parts:
            hit = hit | name.contains(part)
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    return kind.otherwise(params.OTHER_KIND)
