"""Filling fixed-capacity containers (problem 9).

Items are only looked at through their histogram of sizes, which has at most as
many bins as the capacity, whatever the number of items.  For each group, in
one task over its histogram, patterns of one to three sizes that fill a
container exactly are enumerated, non-negative least squares fit how often each
is used to the histogram, the counts are rounded down to what the histogram
holds, and the residual is packed best fit decreasing, on counts again.  The
plan, container numbers for slots of each size, is a table, and each item takes
the slot of its rank among the items of its size.

The rank is exact and needs no large task: a size that more than ``PER_TASK``
items have is ranked in salted parts, offset by a running count.

Defined results: an item larger than the capacity fills containers by itself and
its rest is packed like any item; items of size 0 (null and empty texts) stand
in the first container; items of a group without a capacity (null or unknown
source, or a capacity that is null or not above 0) are packed under the name
``unknown`` with the smallest capacity there is; repeated rows of one id are one
item.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: items of one size that one task ranks
PER_TASK = 200_000
ROUNDS = 400
#: rows up to which a table of slots, of five numbers each, is broadcast
BROADCAST_ROWS = 500_000
SLOTS = "g string, rest long, lo long, hi long, each long, at long"
UNKNOWN = "unknown"


def _patterns(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c) of sizes, 0 for none, a >= b >= c, that sum to the capacity."""
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    out = []
    if have[capacity]:
        out.append(np.array([[capacity, 0, 0]]))
    s = sizes[(sizes > 0) & (sizes < capacity)]
    rest = capacity - s
    two = s[have[rest] & (s >= rest)]
    out.append(np.stack([two, capacity - two, np.zeros_like(two)], 1))
    for a in s[::-1]:
        b = s[(s <= a) & (2 * s >= capacity - a) & (s < capacity - a)]
        b = b[have[capacity - a - b]]
        if len(b):
            out.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def _fit(patterns: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram (accelerated projected gradient)."""
    n = len(hist)
    target = hist.astype(float).copy()
    target[0] = 0.0
    # weights: many items of one size must not drown the rare ones
    w = 1.0 / np.sqrt(np.maximum(target, 1.0))
    w[0] = 0.0

    def use(x):
        u = np.bincount(patterns.ravel(), np.repeat(x, 3), n)
        u[0] = 0.0
        return u

    degree = np.bincount(patterns.ravel(), minlength=n).astype(float)
    degree[0] = 0.0
    step = 1.0 / max(1e-9, 3.0 * float((w * w * degree).max()))
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(ROUNDS):
        g = (w * w * (use(y) - target))[patterns].sum(1)
        nx = np.maximum(0.0, y - step * g)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nx + (t - 1) / nt * (nx - x), nx, nt
    return x


def plan(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(sizes of a container with their counts, number of such containers)] that hold exactly the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in hist.items():
        left[s] += n
    left[0] = 0
    sizes = np.nonzero(left)[0]
    out: list[tuple[dict[int, int], int]] = []
    pats = _patterns(sizes, capacity)
    if len(pats):
        x = _fit(pats, left)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            mix: dict[int, int] = defaultdict(int)
            for s in pats[i]:
                if s:
                    mix[int(s)] += 1
            k = min(int(x[i] + 0.5), *(int(left[s]) // m for s, m in mix.items()))
            if k > 0:
                for s, m in mix.items():
                    left[s] -= k * m
                out.append((dict(mix), k))
    # residual: best fit decreasing; containers alike are one group with a count
    room: dict[int, list[list]] = defaultdict(list)
    spaces = np.zeros(capacity + 1, bool)
    for s in np.nonzero(left)[0][::-1]:
        s = int(s)
        n = int(left[s])
        while n:
            fits = np.nonzero(spaces[s:])[0]
            if len(fits):
                gap = int(fits[0]) + s
                group = room[gap][-1]
                each = 1 if gap - s >= s and group[1] * (gap // s) > n and group[1] <= n else min(gap // s, n)
                take = min(group[1], n // each) or 1
                if take * each > n:
                    each, take = n, 1
                group[1] -= take
                mix = dict(group[0])
                if not group[1]:
                    room[gap].pop()
                    if not room[gap]:
                        spaces[gap] = False
            else:
                gap, mix = capacity, {}
                each = min(capacity // s, n)
                take = n // each
            mix[s] = mix.get(s, 0) + each
            room[gap - each * s].append([mix, take])
            spaces[gap - each * s] = True
            n -= each * take
    out += [(mix, k) for groups in room.values() for mix, k in groups]
    return out


def _limits(limits: DataFrame, group: str, capacity: str) -> dict[str, int]:
    """The capacity of each group that has one, and of the others; a bounded table of settings."""
    caps = {r[0]: int(r[1]) for r in limits.select(group, capacity).where(F.col(group).isNotNull() & (F.col(capacity) > 0)).collect()}
    caps.setdefault(UNKNOWN, min(caps.values(), default=1))
    return caps


def _small(df: DataFrame, n: int) -> DataFrame:
    """The table, to be broadcast if its checked number of rows allows it, else joined as any."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _plans(spark: SparkSession, bins: list[Row], caps: dict[str, int]) -> list[Row]:
    """Slots (g, rest, lo, hi, each, at) of every group, each planned in a task of its own; rest 0 gives the first container after them.

    There are at most a few for each bin of a histogram, and no more than containers.
    """
    rows = spark.createDataFrame([(b.g, caps[b.g], b.rest, b.c) for b in bins], "g string, cap long, rest long, c long")

    def slots(h: pd.DataFrame) -> pd.DataFrame:
        at, seen, out = 1, defaultdict(int), []
        for mix, k in plan({int(s): int(c) for s, c in zip(h.rest, h.c)}, int(h.cap.iloc[0])):
            for s, m in mix.items():
                out.append((h.g.iloc[0], s, seen[s], seen[s] + m * k, m, at))
                seen[s] += m * k
            at += k
        out.append((h.g.iloc[0], 0, 0, 0, 1, at))
        return pd.DataFrame(out, columns=["g", "rest", "lo", "hi", "each", "at"])

    return rows.repartition(max(1, len(caps)), "g").groupBy("g").applyInPandas(slots, SLOTS).collect()


def pack(items: DataFrame, limits: DataFrame, *, id: str = "doc_id", group: str = "source", size: str = "tokens", capacity: str = "capacity") -> DataFrame:
    """(id, group, part, tokens, container) for every item; containers are numbered from 1 in each group.

    ``limits`` has one row for each group, a bounded table of settings.
    """
    spark = items.sparkSession
    caps = _limits(limits, group, capacity)
    known = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    name = F.when(F.col(group).isin(*caps), F.col(group)).otherwise(F.lit(UNKNOWN))
    base = (
        items.select(F.col(id).alias("id"), name.alias("g"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
        .dropDuplicates(["id"])
        .withColumn("cap", known[F.col("g")])
        .withColumn("whole", F.expr("case when n > cap then n div cap else 0L end"))
        .withColumn("rest", F.expr("case when n > cap then n % cap else n end"))
    )
    base = cut(base)
    bins = base.groupBy("g", "rest").agg(F.count("*").alias("c"), F.sum("whole").alias("w")).collect()  # at most the sum of the capacities
    slots = _plans(spark, bins, caps)
    # parts of the sizes that many items have, and what comes before each part; both small, and none in most runs
    hot = {(b.g, int(b.rest)): int(b.c) // PER_TASK + 1 for b in bins if b.c > PER_TASK}
    before = {(b.g, int(b.rest), 0): (0, int(b.w)) for b in bins if (b.g, int(b.rest)) not in hot}
    if hot:
        salts = spark.createDataFrame([(*k, n) for k, n in hot.items()], "g string, rest long, salts long")
        base = base.join(_small(salts, len(hot)), ["g", "rest"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)))
        parts = base.where("salts is not null").groupBy("g", "rest", "salt").agg(F.count("*").alias("c"), F.sum("whole").alias("w"))
        for r in parts.collect():  # one row for each PER_TASK items of a hot size
            before[r.g, int(r.rest), int(r.salt)] = (int(r.c), int(r.w))
    else:
        base = base.withColumn("salt", F.lit(0).cast("long"))
    ranks, offs, whole = [], defaultdict(int), defaultdict(int)
    for (g, s, k), (c, w) in sorted(before.items()):
        ranks.append((g, s, k, offs[g, s], whole[g]))
        offs[g, s] += c
        whole[g] += w
    part = "partition by g, rest, salt order by id"
    ranked = base.withColumn("r", F.expr(f"row_number() over ({part}) - 1"))
    any_whole = any(whole.values())
    if any_whole:
        ranked = ranked.withColumn("wr", F.expr(f"coalesce(sum(whole) over ({part} rows between unbounded preceding and 1 preceding), 0)"))
    if any_whole or hot:
        known = spark.createDataFrame(ranks, "g string, rest long, salt long, off long, woff long")
        ranked = ranked.join(_small(known, len(ranks)), ["g", "rest", "salt"]).withColumn("r", F.col("r") + F.col("off"))
    # one pass: the slot of the rest, the full containers before it, and container 1 for items of size 0
    taken = [tuple(r) for r in slots if r["rest"]]
    slot = spark.createDataFrame(taken, SLOTS).toDF(*[f"t_{c}" for c in ("g", "rest", "lo", "hi", "each", "at")])
    after = {r["g"]: r["at"] for r in slots if not r["rest"]}
    first = F.create_map(*[F.lit(x) for kv in (after or {UNKNOWN: 1}).items() for x in kv])
    placed = ranked.join(_small(slot, len(taken)), F.expr("g = t_g and rest = t_rest and r >= t_lo and r < t_hi"), "left")
    piece = "struct(whole as part, rest as tokens, case when rest > 0 then t_at + (r - t_lo) div t_each else 1L end as container)"
    if not any_whole:
        pieces = F.expr(piece)
        return placed.select(F.col("id").alias(id), F.col("g").alias(group), pieces.alias("p")).select(id, group, "p.*")
    full = "transform(case when whole > 0 then sequence(0L, whole - 1) else array() end, i -> struct(i as part, cast(cap as bigint) as tokens, first + woff + wr + i as container))"
    pieces = F.expr(f"concat({full}, case when rest > 0 or n = 0 then array({piece}) else array() end)")
    return placed.withColumn("first", first[F.col("g")].cast("long")).select(F.col("id").alias(id), F.col("g").alias(group), F.explode(pieces).alias("p")).select(id, group, "p.*")


def fill(packed: DataFrame, limits: DataFrame, *, group: str = "source", capacity: str = "capacity") -> DataFrame:
    """Per group: items, containers, tokens, and the share of the room that is used."""
    caps = _limits(limits, group, capacity)
    known = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    per = packed.where("tokens > 0").groupBy(group).agg(F.count("*").alias("items"), F.max("container").alias("containers"), F.sum("tokens").alias("tokens"))
    cap = F.coalesce(known[F.col(group)], F.lit(caps[UNKNOWN])).cast("long")
    return per.select(group, "items", "containers", "tokens", cap.alias("capacity"), F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("filled"))
