"""Order perturbations: scrambles with their four rules of partition, attacks, negative sampling.

Permutations and choices come from md5 keys, so they are the same in any engine and need no generator state;
every pair or item has a seed of its own.  Exact generator streams of numpy are in ``resample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.arrays import let, pick, range0
from strandline.scratch import Scratch

_INDEX = "int"


def md5_seed(text: Column) -> Column:
    """The md5 of a text as a number modulo 2^31 (the last eight hexadecimal digits hold all of it)."""
    return (F.conv(F.substring(F.md5(text), 25, 8), 16, 10).cast("bigint") % 2147483648).cast("bigint")


def shuffled(places: Column, *key: Column) -> Column:
    """An array of places in the order of the md5 of (key parts, place)."""
    tagged = F.transform(places, lambda p: F.struct(F.md5(F.concat_ws("|", *(k.cast("string") for k in key), p.cast("string"))).alias("h"), p.alias("p")))
    return F.transform(F.array_sort(tagged), lambda s: s["p"])


def _joined(x: Column, chunks: Column, start, length) -> Column:
    return F.flatten(F.transform(chunks, lambda c: F.slice(x, (start(c) + 1).cast(_INDEX), length(c).cast(_INDEX))))


def scramble_balanced(x: Column, chunks: Column, k: Column) -> Column:
    """``x`` in k parts of which the first (T mod k) are one longer, put in the order of ``chunks``; k <= 1: as it is."""
    t = F.size(x)
    k = F.greatest(F.least(k, t), F.lit(1))
    q, r = F.floor(t / k), t % k
    return _joined(x, chunks, lambda c: c * q + F.least(c, r), lambda c: q + (c < r).cast("int"))


def scramble_hashed(x: Column, id: Column, k: Column, seed: Column) -> Column:
    """The balanced scramble with the permutation of (id, k, seed)."""
    parts = F.least(k, F.size(x))
    return F.when(parts <= 1, x).otherwise(scramble_balanced(x, shuffled(range0(parts), id, k, seed), k))


def scramble_tail(x: Column, id: Column, k: Column, seed: Column, short_stays: bool = False) -> Column:
    """Parts of floor(T / k) steps, the last takes the rest; fewer steps than k: single steps, or as it is."""
    t = F.size(x)
    n = F.least(k, t)
    size = F.floor(t / F.greatest(n, F.lit(1)))
    mixed = _joined(x, shuffled(range0(n), id, k, seed), lambda c: c * size, lambda c: F.when(c == n - 1, t - c * size).otherwise(size))
    stays = (n <= 1) | (t < k) if short_stays else n <= 1
    return F.when(stays, x).otherwise(mixed)


def local_reversal(x: Column, id: Column, seed: Column) -> Column:
    """A stretch of max(1, T div 4) steps turned round; where it starts comes from (id, seed)."""
    t = F.size(x)
    n = F.greatest(F.lit(1), F.floor(t / 4)).cast(_INDEX)
    start = (md5_seed(F.concat_ws("|", id.cast("string"), seed.cast("string"))) % (t - n + 1)).cast(_INDEX)
    return F.when(t > 0, let(start, lambda s: F.concat(F.slice(x, F.lit(1), s), F.reverse(F.slice(x, s + 1, n)), F.slice(x, s + n + 1, t - s - n)))).otherwise(x)


def frame_drop(x: Column, id: Column, seed: Column) -> Column:
    """max(1, T div 5) steps dropped; as many of the kept ones doubled, the length stays; order by time."""
    t = F.size(x)
    n = F.greatest(F.lit(1), F.floor(t / 5)).cast(_INDEX)
    order = shuffled(range0(t), id, seed)
    kept = let(order, lambda o: F.slice(o, n + 1, F.greatest(t - n, F.lit(0))))
    index = let(kept, lambda o: F.array_sort(F.concat(o, F.transform(range0(n), lambda i: F.element_at(o, (i % F.greatest(F.size(o), F.lit(1)) + 1).cast(_INDEX))))))
    return F.when(t > 1, pick(x, index)).otherwise(x)


def cut_paste(x: Column, id: Column, seed: Column) -> Column:
    """Four parts (the last takes the rest) in another order."""
    return scramble_tail(x, id, F.lit(4), seed)


def linspace_index(n: Column, k: Column) -> Column:
    """k whole numbers spread from 0 to n - 1, cut off towards zero."""
    return F.transform(range0(k), lambda i: F.when(k > 1, F.floor(i * (n - 1) / (k - 1))).otherwise(F.lit(0)).cast(_INDEX))


def change_speed(x: Column, factor: float) -> Column:
    """max(3, T / factor) steps taken evenly."""
    t = F.size(x)
    return F.when(t > 0, let(F.greatest(F.lit(3), F.floor(t / factor)).cast(_INDEX), lambda k: pick(x, linspace_index(t, k)))).otherwise(x)


def random_crop(x: Column, id: Column, seed: Column, steps: int = 4) -> Column:
    """min(steps, T) steps chosen by (id, seed), in order of time."""
    chosen = F.slice(shuffled(range0(F.size(x)), id, seed), 1, steps)
    return pick(x, F.array_sort(chosen))


ATTACKS = {
    "reversal": lambda x, id, seed: F.reverse(x),
    "local_reversal": local_reversal,
    "frame_drop": frame_drop,
    "cut_paste": cut_paste,
    "speed_2": lambda x, id, seed: change_speed(x, 2.0),
}


def register_attack(name: str, build) -> None:
    """``build(x, id, seed)`` gives the attacked sequence column."""
    ATTACKS[name] = build


def attack_positives(pairs: DataFrame, x: str, label: str, id: str, attack: str, seed: int = 0) -> DataFrame:
    """The b-sides of positive pairs attacked, each with a seed of its own; negatives stay."""
    return pairs.withColumn(x, F.when(F.col(label) == 1, ATTACKS[attack](F.col(x), F.col(id), F.lit(seed))).otherwise(F.col(x)))


def sample_negatives(candidates: DataFrame, positives: DataFrame, a: str, b: str, ratio: int, seed: int) -> DataFrame:
    """(a, b, label): all positives, and ``ratio`` times as many of the other pairs, those of the smallest md5 keys.

    Ratio 0 takes all other pairs.  The limit is a distributed top-N (each task keeps its own first ones).
    """
    pos = positives.select(a, b).distinct()
    rest = candidates.select(a, b).distinct().join(pos, [a, b], "left_anti")
    if ratio:
        key = F.md5(F.concat_ws("|", F.col(a).cast("string"), F.col(b).cast("string"), F.lit(str(seed))))
        rest = rest.orderBy(key, a, b).limit(ratio * pos.count())
    return pos.withColumn("label", F.lit(1)).unionByName(rest.withColumn("label", F.lit(0)))


def draw_negatives(numbered: DataFrame, positives: DataFrame, id: str, place: str, n: int, draws: int, seed: int) -> DataFrame:
    """(draw, id_a, id_b): the first ``n`` of ``draws`` pairs of items drawn with replacement that are no pair of an item
    with itself and no positive; a pair may come up again.  ``place`` numbers the items from 0.

    Raises where the draws don't suffice.  Draw k takes the items at md5(k|a|seed) and md5(k|b|seed) modulo their number; both are looked up by joins.
    """
    spark = numbered.sparkSession
    size = numbered.count()
    if size < 2 or n < 1:
        return numbered.limit(0).select(F.lit(0).cast("bigint").alias("draw"), F.col(id).alias("id_a"), F.col(id).alias("id_b"))
    at = lambda side: (md5_seed(F.concat_ws("|", F.col("id").cast("string"), F.lit(side), F.lit(str(seed)))) % size).alias(f"at_{side}")
    drawn = spark.range(draws).select(F.col("id").alias("draw"), at("a"), at("b"))
    for side in "ab":
        drawn = drawn.join(numbered.select(F.col(place).cast("bigint").alias(f"at_{side}"), F.col(id).alias(f"id_{side}")), f"at_{side}")
    pairs = drawn.where("id_a <> id_b").select("draw", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    fit = Scratch(spark, "negatives").table(pairs.join(positives.select("id_a", "id_b").distinct(), ["id_a", "id_b"], "left_anti").select("draw", "id_a", "id_b"), n=F.count(F.lit(1)))
    if fit.measured["n"] < n:
        raise ValueError(f"{draws} draws gave {fit.measured['n']} of {n} negatives; allow more draws")
    return fit.orderBy("draw").limit(n)
