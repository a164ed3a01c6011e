"""Sharding by balanced label propagation.

Documents of equal texts are linked. A linked document starts in a shard by its hash and moves, round by round, to the
shard where most of its group is, as far as the shards' quotas of rows allow; documents without links, and what the
quotas turn away, fill the shards up. The row counts of the shards differ by one at most.

The state of a round is a table of cells (group part, first shard, shard, rows): documents that share one move together.
Groups that fit into a shard are one part; only what no shard could hold is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS, ROUNDS = 24, 8
#: Ranks are made by dealing rows into so many buckets per shuffle partition and counting the buckets.
SPREAD = 4


def _rank(scratch: Scratch, rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `rank`, gapless from 0 within the keys: ranks in buckets of hashed rows, after the rows of the buckets before."""
    buckets = SPREAD * int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(*keys, "_bucket").count()
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = rows.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(offsets) if not keys else offsets, [*keys, "_bucket"])
    return scratch.keep(ranked.withColumn("rank", (F.col("_at") + F.col("_before")).cast("bigint")).drop("_at", "_before", "_bucket"), name)


def _quotas(loads: dict[int, int], wishes: dict[tuple[int, int], int], cap: dict[int, int]) -> dict[tuple[int, int], float]:
    """The share of each wish (from, to) that may move: what leaves a shard makes room for what comes.

    A small problem of shards x shards, solved by raising all flows until no room is left.
    """
    flow = dict.fromkeys(wishes, 0)
    for _ in range(50):
        moved = False
        for to in sorted(cap):
            room = cap[to] - loads.get(to, 0)
            asked = sorted((k for k in wishes if k[1] == to and wishes[k] > flow[k]), key=lambda k: -loads.get(k[0], 0))
            for k in asked:
                n = min(room, wishes[k] - flow[k])
                if n <= 0:
                    break
                flow[k] += n
                room -= n
                loads[to] = loads.get(to, 0) + n
                loads[k[0]] -= n
                moved = True
        # two shards that are full may still swap
        for a, b in sorted(wishes):
            if a < b and (b, a) in wishes:
                n = min(wishes[a, b] - flow[a, b], wishes[b, a] - flow[b, a])
                if n > 0:
                    flow[a, b] += n
                    flow[b, a] += n
                    moved = True
        if not moved:
            break
    return {k: flow[k] / wishes[k] for k in wishes if flow[k]}


def _lookup(values: dict, default, *keys: Column) -> Column:
    """A small driver-side table as an expression."""
    if not values:
        return F.lit(default)
    name = F.concat_ws(" ", *(k.cast("string") for k in keys))
    made = F.create_map(*(F.lit(x) for k, v in values.items() for x in (" ".join(map(str, k if isinstance(k, tuple) else (k,))), v)))
    return F.coalesce(F.try_element_at(made, name), F.lit(default))


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked for each row.

    Reads doc_id and text, whatever other columns there are. size is the text's UTF-8 bytes (null: none) plus 8; null and
    empty texts are equal; a very long text is one row like any other. Law `rows`: the shards' row counts differ by one at
    most; grown_shard is null. Repeated rows are rows of their own, null doc_ids are allowed. A group of more rows than the
    smallest shard holds cannot stay together: it is split into parts of a shard's size at most, which move on their own.
    Of shards with as many neighbours a hash decides; after `rounds` rounds what still moves stays where it is. An empty
    table gives no rows.
    """
    scratch = Scratch(spark, "shards")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("text"))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "raw")
    total = rows.count()
    cap = {s: total // shards + (s < total % shards) for s in range(shards)}
    least = max(1, total // shards)
    # no more groups than shards can be larger than a shard, but in tables of fewer rows than shards, where none is split
    sizes = scratch.keep(rows.groupBy("text").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    large = {r.text.hex(): -(-r.n // least) for r in sizes.filter(F.col("n") > least).collect()} if total >= shards else {}
    parts = _lookup(large, 1, F.lower(F.hex("text")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).withColumn("first", F.pmod(F.xxhash64("row", "text"), F.lit(shards)).cast("int"))
    # rows of a group meet in cells: a hot text is as many keys as it has parts and first shards
    every = rows.groupBy("text", "part", "first").agg(F.count("*").alias("n"))
    cells = scratch.keep(every.join(sizes.select("text"), "text", "left_semi").withColumn("shard", F.col("first")), "cells-0")
    for step in range(1, rounds + 1):
        load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = {s: max(cap[s] - load.get(s, 0), 0) for s in range(shards)}
        here = cells.groupBy("text", "part", "shard").agg(F.sum("n").alias("m"))
        whole = here.groupBy("text", "part").agg(F.sum("m").alias("whole"))
        # towards the shard of the most neighbours among those that have room for all of them; of as many, the text's own
        # hash decides. Where none has, all go to a shard drawn by room.
        fits = F.col("m") + _lookup(room, 0, F.col("shard")) >= F.col("whole")
        here = here.join(whole, ["text", "part"]).withColumn("fits", fits)
        best = here.groupBy("text", "part").agg(F.max_by(F.struct("shard", "fits"), F.struct("fits", "m", F.xxhash64("text", "part", "shard"))).alias("best"))
        ends = [sum(room[k] for k in range(s + 1)) for s in range(shards)]
        drawn = F.pmod(F.xxhash64("text", "part", F.lit(step)), F.lit(max(ends[-1], 1)))
        other = F.least(F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= drawn)), F.lit(shards - 1)).cast("int")
        best = best.select("text", "part", F.when(F.col("best.fits"), F.col("best.shard")).otherwise(other).alias("to"))
        asked = scratch.keep(cells.join(best, ["text", "part"]), f"asked-{step}")
        sums = asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # shards x shards rows
        loads: dict[int, int] = {}
        for r in sums:
            loads[r.shard] = loads.get(r.shard, 0) + r.n
        wishes = {(r.shard, r.to): r.n for r in sums if r.shard != r.to}
        share = _quotas(loads, wishes, cap)
        if not share:
            break
        draw = F.pmod(F.xxhash64("text", "part", "shard", F.lit(step)), F.lit(1 << 20)) / float(1 << 20)
        moves = (F.col("shard") != F.col("to")) & (draw < _lookup(share, 0.0, F.col("shard"), F.col("to")))
        cells = scratch.keep(asked.select("text", "part", "first", "n", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")), f"cells-{step}")
        scratch.drop(f"cells-{step - 1}", f"asked-{step}")
    over = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    placed = cells.select("text", "part", "first", F.col("shard").alias("wish"))
    wanted = rows.join(placed, ["text", "part", "first"], "left").withColumn("order", F.when(F.col("wish").isNotNull(), F.xxhash64("text", "part")))
    wanted = scratch.keep(wanted.drop("text", "part", "first"), "wanted")
    scratch.drop("raw", "sizes")
    if any(n > cap[s] for s, n in over.items()):
        # A quota was drawn too full: what lies beyond a shard's capacity, by rank, is placed like a document without links.
        ranked = _rank(scratch, wanted.filter("wish is not null"), ["wish"], ["order", "row"], "ranked")
        wanted = wanted.filter("wish is null").unionByName(ranked.withColumn("wish", F.when(F.col("rank") < _lookup(cap, 0, F.col("wish")), F.col("wish"))).drop("rank"))
    held = {s: min(n, cap[s]) for s, n in over.items()}
    fill = _rank(scratch, wanted.filter("wish is null"), [], ["row"], "fill")
    ends, at = [], 0
    for s in range(shards):
        at += cap[s] - held.get(s, 0)
        ends.append(at)
    where = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("rank"))).cast("int")
    out = wanted.filter("wish is not null").withColumn("shard", F.col("wish")).unionByName(fill.withColumn("shard", where).drop("rank"))
    out = out.select("doc_id", "size", "text_crc32", "shard", "row", F.col("order").isNotNull().alias("linked"))
    out = _rank(scratch, out, ["shard"], ["row"], "slots")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")


def cut_links(groups: DataFrame) -> DataFrame:
    """One row: links, cut. The pairs of rows of a group, and those of them whose rows are in different shards.

    groups: text, shard, one row for each document; any other columns may stand beside them. Null texts are one group.
    Pairs are counted from the groups' sizes, none is made.
    """
    here = groups.groupBy("text", "shard").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    each = here.groupBy("text").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("kept"))
    zero = F.lit(0).cast("decimal(38,0)")
    every, kept = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), zero), F.coalesce(F.sum("kept"), zero)
    return each.agg((every / 2).cast("bigint").alias("links"), ((every - kept) / 2).cast("bigint").alias("cut"))
