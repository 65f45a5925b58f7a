"""Shards by balanced label propagation: linked documents gather in one shard, sizes stay even.

Documents start in shards dealt by hash. In each round every group of linked documents names the shard most of
its members are in, members elsewhere ask to move there, and requests between two shards are granted up to a
quota: what the other direction swaps back plus the room left in the target. Documents without links then fill
the room, and an exact last step moves the few rows by which a shard misses its quota. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, running_sum, settle

SHARDS, ROUNDS = 8, 6


def _draw(seed: int, *cols: str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _pick(options: list[tuple[float, int]], draw: Column, otherwise: Column) -> Column:
    """The option in whose share of [0, 1) the draw falls."""
    result, end = otherwise, sum(p for p, _ in options)
    for p, s in reversed(options):
        result = F.when(draw < F.lit(end), F.lit(s)).otherwise(result)
        end -= p
    return result


def propagate(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (row_id, group) with ``shard``: members of a group in one shard as far as quotas allow.

    A group's goal is the shard with most of its members among those that have room. Members of a full shard
    follow to it only if the group is small; a large one keeps what it has there and fills the next shard. A
    small group moves as one, so half a wish never splits it. What reaches the driver in a round are counts
    between two shards: shards x shards numbers.
    """
    n = len(quotas)
    small = max(1, min(quotas) // 16)
    state = linked.withColumn("shard", (F.floor(_draw(0, "row_id") * n)).cast("int"))
    full: list[int] = []
    for turn in range(1, rounds + 1):
        counts = state.groupBy("group", "shard").agg(F.count("*").alias("n"))
        rank = F.when(~F.col("shard").isin(full) if full else F.lit(True), F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard"))
        best = settle(counts.groupBy("group").agg(F.max(rank)["shard"].alias("best"), F.sum("n").alias("copies")))
        held_back = F.col("shard").isin(full) & (F.col("copies") > small) if full else F.lit(False)
        goal = F.when(F.col("best").isNull() | held_back, F.col("shard")).otherwise(F.col("best"))
        chance = F.when(F.col("copies") > small, _draw(turn, "row_id")).otherwise(_draw(turn, "group"))
        asked = settle(join_spread(state, best, "group", "copies").select("row_id", "group", "shard", goal.alias("goal"), chance.alias("chance")))
        flow = {(r["shard"], r["goal"]): r["n"] for r in asked.groupBy("shard", "goal").agg(F.count("*").alias("n")).collect()}
        held = [sum(k for (a, _), k in flow.items() if a == s) for s in range(n)]
        want = {ab: k for ab, k in flow.items() if ab[0] != ab[1]}
        if not want:
            return asked.select("row_id", "group", "shard")
        grant, after = F.lit(0.0), held[:]
        for b in range(n):
            asking = {a: k for (a, x), k in want.items() if x == b}
            swaps = {a: min(k, want.get((b, a), 0)) for a, k in asking.items()}
            rest = sum(asking.values()) - sum(swaps.values())
            room = max(0, quotas[b] - held[b])
            for a, k in asking.items():
                allowed = swaps[a] + ((k - swaps[a]) * min(1.0, room / rest) if rest else 0)
                grant = F.when((F.col("shard") == a) & (F.col("goal") == b), F.lit(allowed / k)).otherwise(grant)
                after[a] -= allowed
                after[b] += allowed
        full = [s for s in range(n) if after[s] >= 0.98 * quotas[s]]
        state = asked.select("row_id", "group", F.when(F.col("chance") < grant, F.col("goal")).otherwise(F.col("shard")).alias("shard"))
    return state


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Linked are rows of equal text. size: UTF-8 bytes plus 1, null and empty texts 1 (they are equal). Shards
    hold equally many rows, the first ones one more if the division leaves a rest; slot counts from 0 in each.
    A group larger than a shard is spread over as few as hold it. Rows that repeat are rows of their own. An
    empty table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))
    one = rows.withColumn("one", F.lit(1).cast("long"))
    numbered = settle(running_sum(one, ["group", "doc_id"], "one", "row_id").drop("one"))
    total = numbered.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    many = settle(numbered.groupBy("group").agg(F.count("*").alias("copies")).filter("copies > 1"))
    state = propagate(join_spread(numbered, many, "group", "copies").select("row_id", "group"), quotas)
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    room = [max(0, quotas[s] - held.get(s, 0)) for s in range(shards)]
    shares = [(r / sum(room), s) for s, r in enumerate(room) if r]
    free = _pick(shares, _draw(7, "row_id"), F.lit(shares[-1][1])) if shares else F.lit(0)
    placed = numbered.join(state.select("row_id", "shard"), "row_id", "left")
    placed = placed.withColumn("loose", F.col("shard").isNull()).withColumn("shard", F.coalesce("shard", free).cast("int"))
    # rank in the shard, linked rows first; rows beyond the quota go on to the shards that miss some
    ranked = settle(running_sum(placed.withColumn("one", F.lit(1).cast("long")), ["loose", "group", "row_id"], "one", "rank", by=["shard"]))
    have = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    surplus = F.lit(0).cast("long")
    stays = F.lit(False)
    first = 0
    for s in range(shards):
        beyond = max(0, have.get(s, 0) - quotas[s])
        stays = stays | ((F.col("shard") == s) & (F.col("rank") < quotas[s]))
        surplus = F.when(F.col("shard") == s, F.col("rank") - quotas[s] + first).otherwise(surplus)
        first += beyond
    gap_shard, gap_slot, at = F.lit(0), F.lit(0).cast("long"), 0
    for s in range(shards):
        missing = max(0, quotas[s] - have.get(s, 0))
        here = (F.col("surplus") >= at) & (F.col("surplus") < at + missing)
        gap_shard = F.when(here, F.lit(s)).otherwise(gap_shard)
        gap_slot = F.when(here, F.col("surplus") - at + have.get(s, 0)).otherwise(gap_slot)
        at += missing
    final = ranked.withColumn("surplus", surplus).withColumn("stays", stays)
    return final.select(
        "doc_id", "size", "text_crc32", "group",
        F.when(F.col("stays"), F.col("shard")).otherwise(gap_shard).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("rank")).otherwise(gap_slot).cast("long").alias("slot"),
    )
