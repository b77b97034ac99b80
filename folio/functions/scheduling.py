"""The review scheduler: published FSRS-6 formulas as columns, and the replay of a log as an ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published default parameters and the retention aimed at.
PARAMETERS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
RETENTION = 0.9
DAY_MS = 86_400_000
FACTOR = RETENTION ** (-1 / PARAMETERS[20]) - 1
p = PARAMETERS


def retrievability(stability: Column, last: Column, now: Column) -> Column:
    """The chance to remember now; 0 for a card that was never reviewed."""
    days = F.greatest(F.lit(0.0), F.floor((now - last) / DAY_MS).cast("double"))
    return F.when(stability.isNull() | last.isNull(), F.lit(0.0)).otherwise(F.pow(1 + FACTOR * days / stability, F.lit(-p[20])))


def _clamped(d: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), d))


def first_difficulty(rating: Column) -> Column:
    return _clamped(p[4] - F.exp(p[5] * (rating - 1)) + 1)


def next_difficulty(d: Column, rating: Column) -> Column:
    moved = d - p[6] * (rating - 3) * (10 - d) / 9
    easiest = p[4] - F.exp(F.lit(p[5] * 3)) + 1
    return _clamped(p[7] * easiest + (1 - p[7]) * moved)


def next_stability(s: Column, d: Column, r: Column, rating: Column, days: Column) -> Column:
    bonus = F.when(rating == 2, F.lit(p[15])).when(rating == 4, F.lit(p[16])).otherwise(F.lit(1.0))
    recalled = s * (1 + F.exp(F.lit(p[8])) * (11 - d) * F.pow(s, F.lit(-p[9])) * (F.exp(p[10] * (1 - r)) - 1) * bonus)
    forgotten = F.least(p[11] * F.pow(d, F.lit(-p[12])) * (F.pow(s + 1, F.lit(p[13])) - 1) * F.exp(p[14] * (1 - r)), s / F.exp(F.lit(p[17] * p[18])))
    same = F.exp(p[17] * (rating - 3 + p[18])) * F.pow(s, F.lit(-p[19]))
    same_day = s * F.when(rating >= 3, F.greatest(F.lit(1.0), same)).otherwise(same)
    return F.greatest(F.lit(0.001), F.when(days < 1, same_day).when(rating == 1, forgotten).otherwise(recalled))


def first_stability(rating: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in p[:4]]), (rating - 1).cast("int"))


def interval(stability: Column) -> Column:
    """Days until the chance to remember falls to the retention; at least 1."""
    return F.greatest(F.lit(1), F.round(stability / FACTOR * (RETENTION ** (-1 / p[20]) - 1)).cast("int"))


def step(s: Column, d: Column, last: Column, rating: Column, now: Column) -> tuple[Column, Column]:
    """Stability and difficulty after a rating (1 forgotten, 2 hard, 3 good, 4 easy); a null stability is a new card."""
    rating = rating.cast("double")
    days = F.floor((now - last) / DAY_MS).cast("double")
    known = next_stability(s, d, retrievability(s, last, now), rating, days)
    return F.when(s.isNull(), first_stability(rating)).otherwise(known), F.when(s.isNull(), first_difficulty(rating)).otherwise(next_difficulty(d, rating))


def review(cards: DataFrame, now: Column) -> DataFrame:
    """Cards (fsrs_stability, fsrs_difficulty, last_review_at, rating) with their next state and interval."""
    s, d = step(F.col("fsrs_stability"), F.col("fsrs_difficulty"), F.col("last_review_at"), F.col("rating"), now)
    out = cards.withColumns({"stability": s, "difficulty": d})
    return out.withColumns({"interval_days": interval(F.col("stability")), "due": now + interval(F.col("stability")).cast("long") * DAY_MS})


def preview(cards: DataFrame, now: Column) -> DataFrame:
    """The interval that each of the four ratings would give."""
    for i, name in enumerate(("forgot", "fuzzy", "remember", "easy"), 1):
        s, _ = step(F.col("fsrs_stability"), F.col("fsrs_difficulty"), F.col("last_review_at"), F.lit(i), now)
        cards = cards.withColumn(f"{name}_days", interval(s))
    return cards


def replay(log: DataFrame, card: str, order: str, rating: str, at: str) -> DataFrame:
    """ST08: (card, stability, difficulty, reviews, last): each card's log folded in order. Undo is dropping its last row."""
    rows = F.sort_array(F.collect_list(F.struct(order, F.col(rating).alias("rating"), F.col(at).alias("at"))))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("n"))

    def fold(acc: Column, row: Column) -> Column:
        s, d = step(acc["s"], acc["d"], acc["last"], row["rating"], row["at"])
        return F.struct(s.alias("s"), d.alias("d"), row["at"].cast("long").alias("last"), (acc["n"] + 1).alias("n"))

    folded = log.groupBy(card).agg(rows.alias("rows")).select(card, F.aggregate("rows", start, fold).alias("r"))
    return folded.select(card, F.round("r.s", 6).alias("stability"), F.round("r.d", 6).alias("difficulty"), F.col("r.n").alias("reviews"), F.col("r.last").alias("last"))
