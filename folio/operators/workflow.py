"""States of batches moved by a log of commands (R19), and a book's analysis that goes on where it stopped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import shipped

# Which command moves a batch from which state to which. Others are not allowed and change nothing.
MOVES = {
    ("pending", "next"): "assigned", ("assigned", "pass"): "done", ("assigned", "fail"): "failed", ("failed", "pass"): "done", ("failed", "fail"): "failed",
    ("failed", "retry"): "pending", ("assigned", "retry"): "pending", ("done", "reopen"): "assigned",
}
FIRST = "pending"


def batch_states(log: DataFrame) -> DataFrame:
    """(book, batch, seq, command, before, after, legal): a log (book, batch, seq, command) replayed.

    Rows stream in order through sorted partitions; one state is held, whatever the length of a batch's log.
    """

    def run(batches):
        at, state = None, FIRST
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.book, r.batch) != at:
                    at, state = (r.book, r.batch), FIRST
                after = MOVES.get((state, r.command))
                out.append((r.book, r.batch, r.seq, r.command, state, after or state, after is not None))
                state = after or state
            yield pd.DataFrame(out, columns=["book", "batch", "seq", "command", "before", "after", "legal"])

    rows = shipped(log.select("book", "batch", "seq", "command")).repartition("book", "batch").sortWithinPartitions("book", "batch", "seq", "command")
    return rows.mapInPandas(run, "book long, batch long, seq long, command string, before string, after string, legal boolean")


def next_batches(states: DataFrame) -> DataFrame:
    """(book, batch): the batch that a book gives out next, its first pending one; states: book, batch, after, as they stand."""
    return states.where(F.col("after") == FIRST).groupBy("book").agg(F.min("batch").alias("batch"))


def run_book(units: DataFrame, cache: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(book, chapter, phase, unit, action): what an analysis does with each unit of its plan, in order.

    units: book, chapter, idx (the chapter's place), phase, unit, key (of the ids that it reads), version, model; cache:
    key, version, model, of answers that are there; outcomes: book, chapter, phase, unit, ok, of the calls that are made.
    A unit whose answer is there is `cached`, others are `called`; the first call that fails has `failed`, and all units
    of its book after it are `waiting`. A unit without an outcome was never called and waits as well.
    """
    there = cache.select("key", "version", "model").distinct().withColumn("there", F.lit(True))
    rows = units.join(there, ["key", "version", "model"], "left").join(outcomes.select("book", "chapter", "phase", "unit", "ok"), ["book", "chapter", "phase", "unit"], "left")
    fails = F.col("there").isNull() & ~F.coalesce("ok", F.lit(False))
    order = ["idx", "chapter", "phase", "unit"]
    stop = rows.where(fails).groupBy("book").agg(F.min(F.struct(*order)).alias("stop"))
    at = F.struct(*order)
    rows = rows.join(stop, "book", "left")
    action = (
        F.when(F.col("stop").isNull() | (at < F.col("stop")), F.when(F.col("there"), "cached").otherwise("called"))
        .when((at == F.col("stop")) & F.col("ok").isNotNull(), "failed").otherwise("waiting")
    )
    return rows.select("book", "chapter", "phase", "unit", action.alias("action"))


def book_states(actions: DataFrame) -> DataFrame:
    """(book, state, chapters_done, calls): Succeeded, or Interrupted where a unit failed or waits."""
    chapters = actions.groupBy("book", "chapter").agg(F.bool_and(F.col("action").isin("cached", "called")).alias("whole"), F.count_if(F.col("action").isin("called", "failed")).alias("calls"))
    state = F.when(F.bool_and("whole"), "Succeeded").otherwise("Interrupted")
    return chapters.groupBy("book").agg(state.alias("state"), F.count_if("whole").alias("chapters_done"), F.sum("calls").alias("calls"))
