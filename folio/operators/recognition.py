"""What a text recogniser's matrices say (M07): letters of a line, and boxes of a page's map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import shipped

# What is a box, how far it grows, and when two are one.
SURE, LEAST_AREA, LEAST_MEAN, GROWS, ROW = 0.3, 32, 0.5, 0.25, 24


def ctc_decode(scores: Column, classes: int, alphabet: Column) -> Column:
    """(text, confidence) of a flat matrix of steps by classes: each step's best class, without repeats and blanks (0).

    Of equal scores the lowest class is the best. Class k is the letter k of the alphabet; classes beyond it are left
    out. The confidence is the mean score of the letters, 0 if there is none.
    """
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(scores) / classes).cast("int"))), lambda i: F.slice(scores, (i - 1) * classes + 1, classes))
    steps = F.when(F.size(scores) >= classes, steps).otherwise(F.array().cast("array<array<float>>"))
    best = F.transform(steps, lambda s: F.struct((F.array_position(s, F.array_max(s)) - 1).cast("int").alias("k"), F.array_max(s).cast("double").alias("p")))
    first = F.transform(best, lambda b, i: F.struct(b["k"].alias("k"), b["p"].alias("p"), (b["k"] != F.coalesce(F.get(best, i - 1)["k"], F.lit(0))).alias("new")))
    kept = F.filter(first, lambda b: b["new"] & (b["k"] != 0) & (b["k"] <= F.length(alphabet)))
    text = F.array_join(F.transform(kept, lambda b: F.substring(alphabet, b["k"], F.lit(1))), "")
    total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b["p"])
    return F.struct(text.alias("text"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0)).alias("confidence"))


def _boxes(flat, width: int, least: int) -> list[tuple[int, int, int, int]]:
    """Boxes of touching cells (also at corners) above the threshold, large and sure enough, grown by a quarter."""
    height, found, seen = len(flat) // width, [], set()
    for at in range(height * width):
        if at in seen or not flat[at] > SURE:
            continue
        seen.add(at)
        todo, cells = [at], []
        while todo:
            y, x = divmod(todo.pop(), width)
            cells.append((y, x))
            for ny in range(max(0, y - 1), min(height, y + 2)):
                for nx in range(max(0, x - 1), min(width, x + 2)):
                    near = ny * width + nx
                    if near not in seen and flat[near] > SURE:
                        seen.add(near)
                        todo.append(near)
        ys, xs = [y for y, _ in cells], [x for _, x in cells]
        w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        if w * h >= least and sum(flat[y * width + x] for y, x in cells) / len(cells) >= LEAST_MEAN:
            gx, gy = max(2, int(w * GROWS)), max(2, int(h * GROWS))
            found.append((max(0, min(xs) - gx), max(0, min(ys) - gy), min(width - 1, max(xs) + gx), min(height - 1, max(ys) + gy)))
    return _one_line(found)


def _one_line(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes of one line that overlap by 30 % of the narrower one become their hull, until none does; in reading order."""
    order = lambda b: (b[1] // ROW, b[0])
    boxes = sorted(boxes, key=order)

    def one(a, b) -> bool:
        high, wide = min(a[3] - a[1], b[3] - b[1]), min(a[2] - a[0], b[2] - b[0])
        return high > 0 and wide > 0 and min(a[3], b[3]) - max(a[1], b[1]) >= high // 2 and (min(a[2], b[2]) - max(a[0], b[0])) * 10 >= wide * 3

    while pair := next(((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if one(boxes[i], boxes[j])), None):
        a, b = boxes[pair[0]], boxes.pop(pair[1])
        boxes[pair[0]] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
    return sorted(boxes, key=order)


def detected_boxes(maps: DataFrame, width: int, least: int = LEAST_AREA) -> DataFrame:
    """(id, n, x0, y0, x1, y1) of maps (id, cells), each row by row one probability map; a task holds one map at a time."""

    def run(batches):
        for pdf in batches:
            rows = [(r.id, n, *map(int, b)) for r in pdf.itertuples() if r.cells is not None for n, b in enumerate(_boxes(list(r.cells), width, least))]
            yield pd.DataFrame(rows, columns=["id", "n", "x0", "y0", "x1", "y1"])

    return shipped(maps.select(F.col("id").cast("long").alias("id"), "cells")).mapInPandas(run, "id long, n int, x0 int, y0 int, x1 int, y1 int")
