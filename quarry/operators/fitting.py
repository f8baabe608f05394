"""Answers of several sections cut to their token budgets, for a whole table of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING, CARD, NOTE = 0, 1, 2


def fit_answers(answers: DataFrame, sections: DataFrame, cards: DataFrame) -> DataFrame:
    """(answer, section, kind, pos, shown): every heading, card and note, in the order in which they stand, and whether the budget shows it.

    answers: answer, title_cost, budget. sections: answer, section (their order), heading_cost (null without a heading), note_cost (null without
    a note). cards: answer, section, pos, cost (at least 1). A section without cards and note is left out. An item that would go over
    the budget ends its answer; a section without a heading still has to find room for two tokens. Notes are not cut: one stands
    wherever its section began, and what it costs counts for what follows.

    A card of more than budget cards before it can't be shown, whatever they cost, so only the first budget + 1 of a section travel; the
    windows over an answer are bounded by that.
    """
    known = cards.join(answers.select("answer", "budget"), "answer")
    place = F.row_number().over(Window.partitionBy("answer", "section").orderBy("pos"))
    # The limit has to be a number for the filter to go below the exchange; each answer's own follows.
    most = answers.agg(F.coalesce(F.max("budget"), F.lit(0)).cast("int")).first()[0]
    near = known.withColumn("place", place).where(F.col("place") <= most + 1).where(F.col("place") <= F.col("budget") + 1)
    filled = cards.select("answer", "section").distinct().withColumn("filled", F.lit(True))
    stand = sections.join(filled, ["answer", "section"], "left").where(F.col("filled") | F.col("note_cost").isNotNull())
    own = lambda kind, pos, cost, need: (F.lit(kind).alias("kind"), pos.alias("pos"), cost.cast("long").alias("cost"), need.cast("long").alias("need"))
    nothing = F.lit(None)
    price = F.coalesce("heading_cost", F.lit(0))
    items = (
        stand.select("answer", "section", *own(HEADING, nothing.cast("long"), price, F.coalesce("heading_cost", F.lit(2))))
        .unionByName(near.select("answer", "section", *own(CARD, F.col("pos").cast("long"), F.col("cost"), F.col("cost"))))
        .unionByName(stand.where(F.col("note_cost").isNotNull()).select("answer", "section", *own(NOTE, nothing.cast("long"), F.col("note_cost"), nothing))))
    order = Window.partitionBy("answer").orderBy("section", "kind", "pos")
    ahead, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.col("title_cost") + F.coalesce(F.sum("cost").over(ahead), F.lit(0))
    priced = items.join(answers, "answer").withColumn("over", spent + F.col("need") > F.col("budget"))
    first = F.min(F.when(F.col("over"), F.struct("section", "kind"))).over(upto)
    noted = (F.col("kind") == NOTE) & (F.col("end.section") == F.col("section")) & (F.col("end.kind") == CARD)
    return priced.withColumn("end", first).select("answer", "section", "kind", "pos", (F.col("end").isNull() | noted).alias("shown"))
