"""Homomorphic multiset fingerprints of documents.

A paragraph (line) hashes to a wide vector; a document's vector is the sum of its paragraphs' vectors modulo powers
of two. So the order of paragraphs doesn't matter, and a paragraph is added or removed by adding or subtracting
its vector (combine, remove). A vector has two parts:

- exact lanes modulo 2^32, each a seeded hash of the paragraph's SHA-512: two multisets of paragraphs are equal if,
  but for a chance of 2^-256, these are;
- signed lanes modulo 2^32, for likeness: each sentence or clause of the paragraph adds one bit of its hash to every lane. Twice
  a lane less the number of sentences is then a sum of random signs, and the inner product of two documents' lanes
  estimates that of their sentence counts; likeness() is the cosine, clipped to 0..1.

Defined results: null and empty texts are one empty paragraph; texts of any length; repeated rows give equal
fingerprints. All is column expressions: nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: 32-bit lanes for equality; pairs of 32-bit lanes for likeness, packed two to a long.
EXACT, PAIRS = 8, 32
LOW32 = (1 << 32) - 1
PAIR_BITS = (1 << 32) + 1
SENTENCE_END = r"[.!?,;:|\n]+"


def _add(a: Column, b: Column, sign: int = 1) -> Column:
    """Lane by lane modulo 2^32: two lanes packed in a long are added apart."""
    low = (a.bitwiseAND(F.lit(LOW32)) + F.lit(sign) * b.bitwiseAND(F.lit(LOW32))).bitwiseAND(F.lit(LOW32))
    high = (F.shiftrightunsigned(a, 32) + F.lit(sign) * F.shiftrightunsigned(b, 32)).bitwiseAND(F.lit(LOW32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def exact_lanes(text: Column) -> Column:
    """Array of EXACT longs below 2^32."""

    def lanes(paragraph: Column) -> Column:
        digest = F.sha2(paragraph, 512)
        return F.array(*[F.xxhash64(F.lit(i), digest).bitwiseAND(F.lit(LOW32)) for i in range(EXACT)])

    zero = F.array_repeat(F.lit(0).cast("long"), EXACT)
    vectors = F.transform(F.split(text, "\n", -1), lanes)
    return F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: (a + b).bitwiseAND(F.lit(LOW32))))


def likeness_lanes(text: Column) -> Column:
    """Array of 1 + PAIRS longs: the number of sentences, then two lanes of counted hash bits in each.

    A lane is below 2^32 and counts sentences, of which a text has fewer: no sum runs into its neighbour.
    """
    hashes = F.transform(F.filter(F.split(text, SENTENCE_END), lambda s: F.length(s) > 0), lambda s: F.xxhash64(F.trim(s)))
    # the number of sentences is carried along: the array of hashes is made once
    zero = F.array_repeat(F.lit(0).cast("long"), PAIRS + 1)

    def add(acc: Column, h: Column) -> Column:
        return F.transform(acc, lambda a, i: a + F.when(i == 0, F.lit(1).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, i - 1).bitwiseAND(F.lit(PAIR_BITS))))

    return F.aggregate(hashes, zero, add)


def fingerprint(text: Column) -> Column:
    """Struct of the two parts."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(exact_lanes(text).alias("exact"), likeness_lanes(text).alias("like"))


def _merge(x: Column, y: Column, sign: int) -> Column:
    exact = F.zip_with(x["exact"], y["exact"], lambda a, b: (a + F.lit(sign) * b).bitwiseAND(F.lit(LOW32)))
    return F.struct(exact.alias("exact"), F.zip_with(x["like"], y["like"], lambda a, b: _add(a, b, sign)).alias("like"))


def combine(x: Column, y: Column) -> Column:
    """The fingerprint of the paragraphs of both: insertion."""
    return _merge(x, y, 1)


def remove(x: Column, y: Column) -> Column:
    """The fingerprint of x without the paragraphs of y: deletion."""
    return _merge(x, y, -1)


def hexed(x: Column) -> Column:
    """The exact lanes, then the likeness lanes, as lowercase hex; equal multisets of paragraphs have equal strings."""
    exact = F.array_join(F.transform(x["exact"], lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")
    return F.concat(exact, F.array_join(F.transform(x["like"], lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), ""))


def _signed(x: Column) -> Column:
    """The likeness lanes as sums of signs, as doubles."""
    n = F.get(x["like"], 0)
    packed = F.slice(x["like"], 2, PAIRS)
    low = F.transform(packed, lambda v: (F.lit(2) * v.bitwiseAND(F.lit(LOW32)) - n).cast("double"))
    high = F.transform(packed, lambda v: (F.lit(2) * F.shiftrightunsigned(v, 32) - n).cast("double"))
    return F.concat(low, high)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def likeness(x: Column, y: Column) -> Column:
    """1 for equal exact lanes, else the estimated cosine of the sentence counts, from 0 to 1."""
    a, b = _signed(x), _signed(y)
    norms = F.sqrt(_dot(a, a) * _dot(b, b))
    cosine = F.when(norms > 0, _dot(a, b) / norms).otherwise(F.lit(0.0))
    return F.when(x["exact"] == y["exact"], F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def id_cuts(docs: DataFrame, rows: int, most: int) -> list[int]:
    """Document ids that cut docs, by ascending id, into ranges of about `rows` rows; at most `most`, each an id that occurs.

    The smallest id is the first cut.
    """
    n = docs.count()
    parts = max(1, min(most, n // rows))
    found = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts + 100).alias("cuts")).first()
    if found["least"] is None:
        return []
    return sorted({found["least"], *(found["cuts"] if parts > 1 else [])})


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """The number of the range that doc_id is in, by bisection; ids below the first cut, or null, are in range 0."""
    steps, step = [], 1
    while step < len(cuts):
        steps.append(step)
        step *= 2
    if not steps:
        return F.lit(0)
    ids = F.array(*[F.lit(c).cast("long") for c in cuts])
    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(ids, at + s) <= doc_id, F.lit(False)), at + s).otherwise(at))


def with_next(docs: DataFrame, columns: list[str], rows: int = 50, most: int = 8192) -> DataFrame:
    """docs with `next`, a struct of the named columns of the row that follows by doc_id (nulls first), after the last the first.

    Rows are dealt into ranges of ids, each a window partition; the first row of a range also goes to the range
    before, so that no row needs another shuffle to find its next one. Rows with one doc_id follow each other by
    the first of these columns.
    """
    cuts = id_cuts(docs.select("doc_id"), rows, most)
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    has_null = bool(docs.where("doc_id is null").limit(1).count())
    if has_null:
        cuts = sorted({-(1 << 63), *cuts})
    number = range_of(order, cuts)
    starts = F.get(F.array(*[F.lit(c).cast("long") for c in cuts]), number) if cuts else F.lit(None).cast("long")
    before = F.pmod(number - 1, F.lit(max(1, len(cuts))))
    dealt = docs.select(
        "*",
        F.explode(
            F.when(order == starts, F.array(F.struct(number.alias("r"), F.lit(False).alias("again")), F.struct(before.alias("r"), F.lit(True).alias("again"))))
            .otherwise(F.array(F.struct(number.alias("r"), F.lit(False).alias("again"))))
        ).alias("__at"),
    ).select("*", F.col("__at.r").alias("__range"), F.col("__at.again").alias("__again")).drop("__at")
    w = W.partitionBy("__range").orderBy(F.col("__again"), F.col("doc_id").asc_nulls_first(), columns[0])
    out = dealt.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("not __again")
    return out.drop("__range", "__again")
