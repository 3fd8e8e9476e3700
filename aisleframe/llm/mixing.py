"""Mixing sources to target weights by entropy balancing.

Of all document rates, capped at ``most_copies``, those closest in relative
entropy to "every document once" that give each source its target of words are
``min(most_copies, exp(lambda_source * size / mean size of the source))``. The
multipliers solve the convex dual by Newton steps. Words and rates depend on
source and size alone, so a step is one aggregation over the counts per source
and size, for all sources at once, and between steps there is one row a source.
Rates become whole copies size by size, the rest of each rounding carried to
the next smaller size, so a source misses its target by no more than its short
documents; that runs over the distinct sizes of a source, of which there are no
more than the longest text has words.

Which documents of a size get the extra copy is decided on keys and sizes; the
texts are joined to their copies once.

Nulls: a null text has no words; the null source is a source of its own and
sorts last; null ids are carried and told apart by their texts. Documents
without words take nothing. Rows that repeat in id and text are documents of
their own; when only some of them get an extra copy, which is left open. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisleframe.llm.common import document_key, fresh, settle, stored, words_of

#: Documents of one source and size that are ranked in one window.
RANKED_TOGETHER = 2_000


def _ranked(sources: DataFrame) -> DataFrame:
    """Position of each source by code point, null last, without one task for all."""
    spread = settle(
        sources.repartitionByRange("_none", "_name").withColumn("_part", F.spark_partition_id()).select("*")
    )
    counts = spread.groupBy("_part").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b._part") < F.col("a._part"), "left")
    before = before.groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_none", "_name")) - 1
    return spread.withColumn("_inside", inside).join(before, "_part").withColumn("_rank", F.col("_inside") + F.col("_before"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_copies: int) -> DataFrame:
    """Adds ``target`` to (_none, _name, words): weights cycle in source order.

    A target stops at ``most_copies`` times its source; what it leaves is shared
    again by weight among the others until nobody is above.
    """
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = settle(
        _ranked(sources).select(
            "_none", "_name", "words", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_weight")
        )
    )
    total = (ranked.agg(F.sum("words")).first()[0] or 0) * share
    most = F.col("words") * most_copies
    level = 0.0
    while True:
        capped = most <= F.col("_weight") * level
        held, open_weight = ranked.agg(
            F.sum(F.when(capped, most).otherwise(0)), F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("_weight")))
        ).first()
        higher = (total - (held or 0)) / open_weight if open_weight else level
        if higher <= level:
            break
        level = higher
    return ranked.withColumn("target", F.least(most.cast("double"), F.col("_weight") * level)).drop("_weight")


#: A source is solved when its words are this near to its target, relatively.
TOLERANCE = 1e-10


def solve(cells: DataFrame, goals: DataFrame, most_copies: int) -> DataFrame:
    """(_none, _name, words, target, multiplier, mean) of every source: Newton on the dual, kept inside a bracket.

    ``cells`` has (_none, _name, _size, _n), ``goals`` (_none, _name, words,
    target). The words taken grow with the multiplier, so each step also
    narrows the bracket; a Newton step that leaves it is replaced by its middle.
    A source whose target is all it can give has an infinite multiplier.
    """
    source = ["_none", "_name"]
    sums = cells.groupBy(*source).agg(F.sum("_n").alias("_docs"))
    inf = F.lit(float("inf"))
    full = F.col("target") >= F.col("words") * most_copies * (1 - 1e-12)
    state = settle(
        goals.join(sums, source).select(
            *source,
            "words",
            "target",
            F.try_divide(F.col("words").cast("double"), "_docs").alias("mean"),
            F.when(full, inf).otherwise(F.lit(0.0)).alias("at"),
            (-inf).alias("low"),
            inf.alias("high"),
            full.alias("done"),
        )
    )
    while state.filter(~F.col("done")).limit(1).count():
        x = F.col("_size") / F.col("mean")
        tilt = F.exp(F.least(F.col("at") * x, F.lit(700.0)))
        words = (F.col("_size") * F.col("_n")).cast("double")
        step = (
            cells.join(state.filter(~F.col("done")).select(*source, "mean", "at"), source)
            .groupBy(*source)
            .agg(
                F.sum(words * F.least(tilt, F.lit(float(most_copies)))).alias("_taken"),
                F.sum(F.when(tilt < most_copies, words * x * tilt).otherwise(0.0)).alias("_slope"),
            )
        )
        off = F.col("_taken") - F.col("target")
        at, low, high = F.col("at"), F.col("_low"), F.col("_high")
        newton = F.when(F.col("_slope") > 0, at - off / F.col("_slope")).otherwise(inf)
        wide = (low == -inf) | (high == inf)
        middle = F.when(wide, at + (1 + 2 * F.abs(at)) * F.when(off < 0, 1.0).otherwise(-1.0)).otherwise((low + high) / 2)
        inside = (newton > low) & (newton < high) & (F.abs(newton - at) <= 4 * (1 + F.abs(at)))
        open_still = F.col("_taken").isNotNull() & ~F.col("done")
        solved = (F.abs(off) <= TOLERANCE * F.greatest("target", F.lit(1.0))) | (F.col("high") - F.col("low") <= 1e-13 * (1 + F.abs(at)))
        moved = (
            state.join(step, source, "left")
            .withColumn("_low", F.when(off < 0, at).otherwise(F.col("low")))
            .withColumn("_high", F.when(off < 0, F.col("high")).otherwise(at))
            .withColumn("_solved", ~open_still | solved)
        )
        keep = F.col("_solved")
        state = settle(
            moved.select(
                *source,
                "words",
                "target",
                "mean",
                F.when(keep, at).otherwise(F.when(inside, newton).otherwise(middle)).alias("at"),
                F.when(keep, F.col("low")).otherwise(low).alias("low"),
                F.when(keep, F.col("high")).otherwise(high).alias("high"),
                keep.alias("done"),
            )
        )
    return state.select(*source, "words", "target", F.col("at").alias("multiplier"), "mean")


PLAN = "_none boolean, _name string, _size long, _n long, words long, target double, _rate double, _lots long, _extra long"


def _whole_copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Sets ``_extra``, the documents of each size that get one copy above the rate's floor.

    Long documents come first, and what rounding leaves of the words wanted is
    carried to the next size. The rows are the distinct sizes of one source,
    not its documents.
    """
    cells = cells.sort_values("_size", ascending=False)
    owed, extra = 0.0, []
    for size, n, rate in zip(cells["_size"].tolist(), cells["_n"].tolist(), cells["_rate"].tolist()):
        part = rate - math.floor(rate)
        owed += part * size * n
        k = min(max(math.floor(owed / size + 0.5), 0), n) if size and part else 0
        owed -= k * size
        extra.append(k)
    return cells.assign(_extra=extra)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    most_copies: int = 3,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The input with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    A column of the input with one of these names is replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    rows = docs.drop(*[c for c in docs.columns if c.lower() in made and c not in (id_col, text, source)])
    key = fresh(rows, "_key")
    cell = ["_none", "_name", "_size"]
    # Keys and sizes of all documents; the texts are read for that once. Equal rows are one row with a count.
    narrow = stored(
        docs.select(
            document_key(id_col, text).alias("_key"),
            F.col(source).isNull().alias("_none"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_name"),
            F.size(words_of(F.col(text))).cast("long").alias("_size"),
        )
        .groupBy("_key", *cell)
        .agg(F.count("*").alias("_m")),
        "sizes",
    )
    cells = settle(narrow.groupBy(*cell).agg(F.sum("_m").alias("_n")))
    sources = cells.groupBy("_none", "_name").agg(F.sum(F.col("_size") * F.col("_n")).alias("words"))
    goals = targets(sources.select("_none", "_name", "words"), weights, share, most_copies)
    tilt = F.exp(F.least(F.col("multiplier") * F.col("_size") / F.col("mean"), F.lit(700.0)))
    rate = F.coalesce(F.least(tilt, F.lit(float(most_copies))), F.lit(0.0))
    # Rates within rounding of a whole number are that number.
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    lots = F.ceil(F.col("_n") / RANKED_TOGETHER).cast("long")
    # Written, so that Spark knows its size: a join by a hot size must not decide where its documents are counted.
    plan = stored(
        cells.join(solve(cells, goals, most_copies), ["_none", "_name"])
        .select(*cell, "_n", "words", "target", rate.alias("_rate"), lots.alias("_lots"), F.lit(0).cast("long").alias("_extra"))
        .groupBy("_none", "_name")
        .applyInPandas(_whole_copies, PLAN),
        "mix",
    )
    here = narrow.join(plan, cell).withColumn("_lot", F.pmod(F.xxhash64(F.lit("lot"), "_key"), F.col("_lots")))
    # The extra copies of a size are dealt to its lots in proportion, by the steps of a running share.
    dealt = here.groupBy(*cell, "_lot").agg(F.sum("_m").alias("_held"), F.first("_n").alias("_n"), F.first("_extra").alias("_extra"))
    along = Window.partitionBy(*cell).orderBy("_lot").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_run", F.sum("_held").over(along))
    share_to = F.floor(F.col("_run") * F.col("_extra") / F.col("_n"))
    share_from = F.floor((F.col("_run") - F.col("_held")) * F.col("_extra") / F.col("_n"))
    dealt = dealt.select(*cell, "_lot", (share_to - share_from).alias("_mine"))
    in_lot = Window.partitionBy(*cell, "_lot").orderBy(F.xxhash64(F.lit("rank"), "_key"), "_key").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("_mine") - (F.sum("_m").over(in_lot) - F.col("_m"))
    decided = stored(
        here.join(dealt, [*cell, "_lot"]).select(
            F.col("_key").alias(key),
            F.struct(
                F.col("_size").alias("size"),
                F.col("words").alias("source_size"),
                "target",
                F.floor("_rate").cast("long").alias("whole"),
                F.greatest(F.lit(0), F.least(left, F.col("_m"))).cast("long").alias("extra"),
                F.col("_m").alias("rows"),
            ).alias("_told"),
            *[F.col(c).alias(f"{key}{c}") for c in ("_none", "_name")],
        ),
        "copies",
    )
    told, none, name, number = fresh(rows, "_told"), fresh(rows, "_source_none"), fresh(rows, "_source_name"), fresh(rows, "_nr")
    decided = decided.withColumnsRenamed({"_told": told, f"{key}_none": none, f"{key}_name": name})
    keyed = rows.withColumns(
        {
            key: document_key(id_col, text),
            none: F.col(source).isNull(),
            name: F.coalesce(F.col(source).cast("string"), F.lit("")),
        }
    )
    # Equal rows of which some get the extra copy are the only ones that have to be told apart.
    some = f"`{told}`.extra > 0 AND `{told}`.extra < `{told}`.rows"
    both = keyed.join(decided, [key, none, name])
    even = both.filter(f"NOT ({some})").withColumn(number, F.lit(1))
    uneven = both.filter(some).withColumn(number, F.row_number().over(Window.partitionBy(key, none, name).orderBy(key)))
    out = even.unionByName(uneven)
    fact = {c: F.col(f"`{told}`.{c}") for c in ("size", "source_size", "target", "whole", "extra")}
    copies = F.least(fact["whole"] + F.when(F.col(number) <= fact["extra"], 1).otherwise(0), F.lit(most_copies)).cast("long")
    return out.select(
        *rows.columns,
        fact["size"].alias("size"),
        fact["source_size"].alias("source_size"),
        fact["target"].alias("target"),
        copies.alias("copies"),
        (fact["size"] * copies).alias("taken"),
    )
