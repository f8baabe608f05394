"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's target is its share of the budget by weight, at most CAP times its size; what that cuts off is shared out again by weight until
no target is above. The budget is dealt in blocks of equal words: sources get whole blocks by the highest quotients target / (2 * blocks + 1),
and a source's blocks are dealt to its shards in the same way by their sizes, so each shard has an integer quota. A shard is a hashed part of
one source of about the same number of words, so a source with most of the corpus is many shards; there are SHARDS and one for each source at most.

Within a shard the documents stand in order of a seeded hash, end to end, and are cut into blocks. A quota of q for n blocks takes every block q div n
times and q mod n blocks once more: those that a seeded permutation of the block numbers puts first. A document takes the words of the blocks that
lie in it, so no block is ever moved; one window over each shard gives the documents their places.

Only a row for each source and each shard reaches the driver. Selection depends on the rows and the seed alone, so reruns agree.

Nulls: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last; null ids are ids. Repeated rows
are documents of their own, with places of their own. Sources without words have target 0. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import staged

SHARDS, SHARD_WORDS, BLOCK, FINE = 1 << 16, 1 << 18, 256, 4096
WEIGHTS, SHARE, CAP = (3, 1, 2), Fraction(3, 2), 2


def targets(sizes: Sequence[int], weights: Sequence[int], budget: Fraction, cap: int) -> list[Fraction]:
    """The budget by weight, none above cap * size: what is above goes to the others by their weights, again and again."""
    out, open_ = [Fraction(0)] * len(sizes), list(range(len(sizes)))
    rest = Fraction(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if total and rest * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total if total else Fraction(0)
            break
        for i in full:
            out[i] = Fraction(cap * sizes[i])
            rest -= out[i]
        taken = set(full)
        open_ = [i for i in open_ if i not in taken]
    return out


def sainte_lague(votes: Sequence[Fraction | int], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats + 1), ties to the first; most: a bound for each.

    The first seats, those that a divisor a little too large gives everyone, are taken at once; only the rest are dealt one by one.
    """
    total = sum(votes)
    out = [0] * len(votes)
    most = [seats] * len(votes) if most is None else list(most)
    if not total:
        return out
    seats = min(seats, sum(m for m, v in zip(most, votes, strict=True) if v))
    # with the divisor d, floor(votes / d + 1/2) seats each are the highest quotients; d is raised until they are not too many
    rough, bound = np.array([float(v) for v in votes]), np.array(most, float)
    low, high = float(total) / (2 * seats + 2 * len(votes) + 1), 2 * float(total) + 1
    while high > low * (1 + 1e-12):
        middle = (low + high) / 2
        if np.minimum(bound, np.floor(rough / middle + 0.5)).sum() > seats:
            low = middle
        else:
            high = middle
    divisor = Fraction(high)
    while sum(out := [min(m, math.floor(v / divisor + Fraction(1, 2))) for v, m in zip(votes, most, strict=True)]) > seats:
        divisor *= 1 + Fraction(1, 10**9)
    queue = [(-Fraction(v) / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, out, most, strict=True)) if s < m and v]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-Fraction(votes[i]) / (2 * out[i] + 1), i))
    return out


def permutation(n: int, *key: object) -> tuple[int, int]:
    """Factor and shift of a seeded permutation j -> (factor * j + shift) mod n."""
    drawn = hashlib.sha256(repr(key).encode()).digest()
    factor, shift = int.from_bytes(drawn[:8], "little") % n, int.from_bytes(drawn[8:16], "little") % n
    while math.gcd(factor, n) != 1:
        factor = (factor + 1) % n if n > 1 else 1
    return factor, shift


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: id, source, size, source_size, target (its source's), taken (words, repeats counted), shard, place (its first word in the shard).

    weights repeat over the sources in code point order, null last; share: the budget as a share of all words."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    kind, of = docs.schema[id_col].dataType.simpleString(), docs.schema[source_col].dataType.simpleString()
    sized = staged(spark, docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw")))
    found = sized.groupBy("source").agg(F.sum("size").alias("words")).collect()  # a row for each source
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode() if isinstance(r.source, str) or r.source is None else r.source))
    sizes = [r.words for r in found]
    total, order = sum(sizes), [weights[i % len(weights)] for i in range(len(found))]
    goals = targets(sizes, order, Fraction(share) * total, cap)
    if block is None:  # small sources need small blocks to come near their targets
        block = max(1, min([BLOCK, *(int(g) // FINE for g in goals if g)]))
    per_shard = max(shard_words, -(-total // SHARDS))
    plan = spark.createDataFrame([(i, r.source, r.words, float(g), max(1, -(-r.words // per_shard))) for i, (r, g) in enumerate(zip(found, goals, strict=True))],
                                 f"rank int, of {of}, source_size long, target double, shards long")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.pmod(F.col("draw"), "shards"))
    shards = placed.where("size > 0").groupBy("rank", "shard").agg(F.sum("size").alias("words")).collect()  # SHARDS + sources at most
    own: dict[int, list] = {}
    for r in sorted(shards, key=lambda r: (r.rank, r.shard)):
        own.setdefault(r.rank, []).append(r)
    blocks = {rank: [-(-r.words // block) for r in rows] for rank, rows in own.items()}
    quotas = sainte_lague(goals, round(sum(goals) / block), [cap * sum(blocks.get(i, [])) for i in range(len(goals))])
    dealt = []
    for rank, rows in own.items():
        for r, n, q in zip(rows, blocks[rank], sainte_lague([r.words for r in rows], quotas[rank], [cap * n for n in blocks[rank]]), strict=True):
            dealt.append((rank, r.shard, n, q // n, q % n, *permutation(n, seed, found[rank].source, r.shard)))
    quota = spark.createDataFrame(dealt, "rank int, shard long, n long, base long, extra long, factor long, shift long")
    ahead = Window.partitionBy("rank", "shard").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.where("size > 0").withColumn("place", F.sum("size").over(ahead) - F.col("size")).join(quota, ["rank", "shard"])
    first, end, width = F.col("place"), F.col("place") + F.col("size"), F.lit(block).cast("long")

    def held(j):  # words of block j in this document, if the permutation takes the block once more
        inside = F.least(end, (j + 1) * width) - F.greatest(first, j * width)
        return F.when(F.pmod(F.col("factor") * j + F.col("shift"), F.col("n")) < F.col("extra"), inside).otherwise(F.lit(0).cast("long"))

    numbers = F.sequence(F.expr(f"place div {block}"), F.expr(f"(place + size - 1) div {block}"))
    once = F.when(F.col("extra") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(numbers, F.lit(0).cast("long"), lambda x, j: x + held(j)))
    columns = ["id", "source", "size", "source_size", "target", "taken", "shard", "place"]
    taken = at.withColumn("taken", F.col("base") * F.col("size") + once).select(*columns)
    rest = placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "place": F.lit(None).cast("long")}).select(*columns)
    return taken.unionByName(rest).withColumn("id", F.col("id").cast(kind)).withColumnsRenamed({"id": id_col, "source": source_col})
