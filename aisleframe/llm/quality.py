"""Line-first cleaning of documents with DataFrame functions only.

Every line is judged on its own: a line without any sentence end, a line of
marks, a navigation line, a boilerplate line and a repeat of an earlier line of
the same document fail. Failing lines go, and a document that would lose more
than ``max_lost`` of its characters is rejected as a whole. Before that, a
document fails when it has too few words or too much repeated text.

Nulls: a null text counts as an empty one. An empty text has zero counts, fails
and is not kept. A null id is carried through; repeated rows get equal results;
an empty table gives an empty one. Other columns of the input are carried
unless they bear the name of a result column, which then wins.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import fresh, words_of

SYMBOLS = r"[#*$%&|<>]"
#: A sentence ends with one of these, maybe behind a closing quote or bracket.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*(\s|$)"
#: The end of a word that ends in a row of marks or in a symbol; one match a word.
NOISY_WORD = r"([!?]{2}|[#*$%&<>])(\s|$)"
NAVIGATION_MARK = r"[|»›•]"
BOILERPLATE = (
    r"(?i)(\bcopyright\b|all rights reserved|\blicen[sc]ed under\b|\breleased under\b|\bcookies?\b|privacy policy"
    r"|terms of (use|service)|\bsubscribe\b|\b(sign|log) (in|up)\b|click here|\bjavascript\b|lorem ipsum|^\s*share this\b)"
)
#: Every boilerplate match has one of these in lower case: a quick test before the pattern.
BOILERPLATE_STEMS = [
    "copyright", "all rights reserved", "licen", "released under", "cookie", "privacy policy", "terms of",
    "subscribe", "sign ", "log ", "click here", "javascript", "lorem ipsum", "share this",
]
HAS_WORD = r"[^\x20\x09-\x0D]"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]


def _boilerplate(line: Column) -> Column:
    # An array of one binds the lower-cased line, so it is made once and not per stem.
    stems = F.exists(F.array(F.lower(line)), lambda low: reduce(or_, [low.contains(x) for x in BOILERPLATE_STEMS]))
    return stems & line.rlike(BOILERPLATE)


def _line_fails(line: Column) -> Column:
    """Whether a line with a word fails. Words are counted only where marks make their number matter."""
    noisy = F.regexp_count(line, F.lit(NOISY_WORD))
    marks = F.regexp_count(line, F.lit(NAVIGATION_MARK))
    n_words = F.size(words_of(line))
    return (
        ~line.rlike(SENTENCE_END)
        | F.exists(F.array(noisy), lambda k: (k > 0) & (k * 10 > n_words * 3))
        | F.exists(F.array(marks), lambda k: (k >= 3) & (k * 5 >= n_words))
        | _boilerplate(line)
    )


def quality(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 50,
    max_repeat_pct: int = 50,
    max_lost: float = 0.5,
) -> DataFrame:
    """The input with counts, ``base_failed``, ``kept`` and ``clean_text``.

    ``n_repeat_words`` counts the words inside three-word windows that occur
    twice or more. Windows are compared by 64-bit hashes; within one document
    of a million words two different ones meet with a chance of 1 in 10^7.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    names = ("_words", "_hash", "_sorted", "_places", "_body", "_lines", "_filled", "_good")
    w, h, s, p, body, lines, full, sound = (fresh(docs, n) for n in names)
    out = out.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(w, words_of(F.col(body)))
    out = out.withColumn("n_words", F.size(w).cast("long")).withColumn(
        h,
        F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    # Places of the repeated windows: equal hashes stand side by side once sorted.
    out = out.withColumn(
        s,
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    out = out.withColumn(
        p,
        F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    out = out.withColumn(full, F.filter(F.split(body, "\n"), lambda x: x.rlike(HAS_WORD)))
    out = out.withColumn(lines, F.array_distinct(full))
    out = (
        out.withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size(full) - F.size(lines)).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    )
    # Of equal lines array_distinct leaves the first in its place.
    out = out.withColumn(sound, F.filter(lines, lambda x: ~_line_fails(x)))
    total = F.length(F.array_join(full, ""))
    left = F.length(F.array_join(sound, ""))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    out = out.withColumn("base_failed", failed).withColumns(
        {"kept": ~F.col("base_failed") & ((total - left) <= total * F.lit(max_lost)), "clean_text": F.array_join(sound, "\n")}
    )
    # The results leave through a generator, below which no later filter is pushed:
    # it would repeat the chain above once per element.
    carried = [c for c in docs.columns if c.lower() not in RESULTS]
    return out.select(*carried, F.inline(F.array(F.struct(*RESULTS))))


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The kept documents with their cleaned texts, in the columns of the input.

    A column ``n_chars`` is set to the length of the cleaned text.
    """
    kept = quality(docs, **settings).filter("kept")
    text = settings.get("text", "text")
    values = {text: F.col("clean_text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("clean_text").cast("long")
    return kept.withColumns(values).select(*docs.columns)
