"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``replicas`` points on the ring of 64-bit hashes. A key belongs to the first point clockwise of its hash,
and walks on from there past full shards. A shard may hold ``1 + slack`` times the mean number of bytes, and closes before
what doesn't fit; what finds all shards closed comes again, and in the end each takes rows until it is full. So no shard
holds more than that and its last rows, and one shard lacks no more than the slack of all others.
The ring's points don't depend on how many shards there are, so a shard more takes over its own arcs, and otherwise only
rows that had overflowed, or now do, move.

Rows arrive in batches, those of larger size classes first, then by hash, so that what comes last is small. Rows of one
batch arrive together: they go where shards were open before the batch. Which batch fills which shard is found by rounds of
proposals: all rows go to their first shard that isn't known to be full by then; running sums by batch show where shards
fill; what came later walks on. A shard only ever fills earlier than the round before showed, so the rounds end, and they
end at what one arrival after the other gives. Between rounds the driver holds one number a shard.

Rounds run over sums by arc and batch, of which there are no more than arcs x batches, however many rows there are. A key
that holds more bytes than a batch should (repeated ids) is dealt to further batches by the rows' places in the input.

Defined results for odd input: a null text has no bytes (its crc32 is 0) and counts the fixed part only; a null key is a key
of its own; rows that share a key and a text are rows of their own; empty texts, ties and an empty table need no rule of
their own; columns that aren't kept are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseload.llm.ranks import ranked
from caseload.session import stored

#: Upper bits of a hash by which rows meet the arcs of the ring; bits of a batch from hash and from dealing.
RING_BITS, HASH_BITS, DEAL_BITS = 12, 16, 12
OPEN = (1 << 62) - 1
#: A cell of one arc and batch with more than this part of a shard's mean is dealt to further batches.
HEAVY = 1 / 64
RESULTS = ("size", "text_crc32", "shard", "slot")


def ring(spark: SparkSession, shards: int, replicas: int, seed: int) -> DataFrame:
    """(arc, low, high, shard_order): arcs of the ring, and all shards in the order in which their points come from there.

    ``shards`` x ``replicas`` arcs; the one over the end of the hash range is two rows with one name.
    """
    n = shards * replicas
    at = spark.range(n).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    at = at.select("shard", F.xxhash64(F.lit(seed), "shard", "replica").alias("point"))
    line = Window.orderBy("point", "shard")  # n rows
    at = at.select("shard", (F.row_number().over(line) - 1).alias("arc"), F.lag("point").over(line).alias("low"), F.col("point").alias("high"))
    own = F.when(F.col("shard") == F.col("of"), F.col("arc"))
    ahead = Window.partitionBy("of").orderBy(F.desc("arc")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = at.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = met.withColumn("next", F.coalesce(F.min(own).over(ahead), F.min(own).over(Window.partitionBy("of")) + n))
    order = F.transform(F.array_sort(F.collect_list(F.struct("next", "of"))), lambda x: x["of"])
    arcs = met.groupBy("arc").agg(order.alias("shard_order"), F.min("low").alias("low"), F.min("high").alias("high"))
    over = arcs.where(F.col("arc") == 0).select("arc", "shard_order", F.lit(None).cast("long").alias("high"))
    over = over.crossJoin(at.agg(F.max("high").alias("low")))  # one row
    return stored(arcs.unionByName(over))


def on_ring(rows: DataFrame, arcs: DataFrame, hashed: Column) -> DataFrame:
    """Rows with the arc that their hash lies on, by an equal join on the hash's upper bits.

    What is sent to every task is shards x replicas + 2 ** RING_BITS rows at most, whatever the table.
    """
    upper = lambda c: F.shiftright(c, 64 - RING_BITS).cast("int")
    ends = 1 << (RING_BITS - 1)
    cells = arcs.select("arc", "low", "high", F.explode(F.sequence(F.coalesce(upper(F.col("low")), F.lit(-ends)), F.coalesce(upper(F.col("high")), F.lit(ends - 1)))).alias("_cell"))
    inside = (F.col("low").isNull() | (F.col("_h") > F.col("low"))) & (F.col("high").isNull() | (F.col("_h") <= F.col("high")))
    met = rows.withColumn("_h", hashed).withColumn("_cell", upper(F.col("_h"))).join(F.broadcast(cells), "_cell").where(inside)
    return met.select(*rows.columns, "arc")


def first_open(cuts: list[int]) -> Column:
    """The first shard clockwise that a batch finds open; ``cuts``: each shard's last batch."""
    last = F.array(*[F.lit(c).cast("long") for c in cuts])
    is_open = lambda s: F.element_at(last, s + 1) >= F.col("batch")
    home = F.col("shard_order")[0]
    return F.when(is_open(home), home).otherwise(F.get(F.filter("shard_order", is_open), F.lit(0)))


def settled(cells: DataFrame, rooms: list[float], fitting: bool, capacity: float) -> list[int]:
    """Each shard's last batch, from ``cells`` (shard_order, batch, bytes) and the shards' rooms.

    ``fitting``: a shard closes before the first batch that doesn't fit (an empty one takes any), else with the one that fills it.
    """
    cuts = [OPEN] * len(rooms)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)
    upto = Window.partitionBy("shard").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = of([float(r) for r in rooms])
    full = F.col("upto") > room if fitting else F.col("upto") >= room
    first = of([r >= capacity for r in rooms]) & (F.col("upto") == F.col("bytes"))
    last = F.when(first, F.col("batch")).otherwise(F.col("batch") - 1) if fitting else F.col("batch")
    while True:
        sums = cells.groupBy(first_open(cuts).alias("shard"), "batch").agg(F.sum("bytes").alias("bytes")).where(F.col("shard").isNotNull())
        found = sums.withColumn("upto", F.sum("bytes").over(upto)).where(full).groupBy("shard").agg(F.min(last).alias("last"))
        found = {r["shard"]: r["last"] for r in found.collect()}  # a row a shard at most
        after = [min(c, found.get(s, OPEN)) for s, c in enumerate(cuts)]
        if after == cuts:
            return cuts
        cuts = after


def openings(cells: DataFrame, shards: int, capacity: float, fits: int) -> list[list[int]]:
    """Each opening's last batches. Shards close before a batch that doesn't fit, and what then found all of them closed
    comes again, to the rooms that are left; after ``fits`` such openings each shard takes rows until it is full."""
    rooms, out = [capacity] * shards, []
    for k in range(fits + 1):
        cuts = settled(cells, rooms, k < fits, capacity)
        out.append(cuts)
        if k == fits or OPEN in cuts:
            return out
        at = cells.withColumn("shard", first_open(cuts))
        held = {r["shard"]: r["bytes"] for r in at.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
        rooms = [room - held.get(s, 0) for s, room in enumerate(rooms)]
        cells = stored(at.where(F.col("shard").isNull()).drop("shard"))
    return out


def measured(docs: DataFrame, keep: list[str], arcs: DataFrame, key: str, fixed_bytes: int, seed: int) -> DataFrame:
    """Narrow rows: the kept columns, size, text_crc32, arc and batch."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + fixed_bytes).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(*keep, F.col(key).alias("_key"), size.alias("size"), crc.alias("text_crc32"))
    large_first = 63 - F.floor(F.log2("size")).cast("long")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "_key", "text_crc32"), 64 - HASH_BITS)
    rows = on_ring(rows, arcs, F.xxhash64(F.lit(seed), "_key"))
    return rows.withColumn("batch", F.shiftleft(F.shiftleft(large_first, HASH_BITS) + drawn, DEAL_BITS)).drop("_key")


def dealt(rows: DataFrame, mean: float) -> DataFrame:
    """Rows of heavy cells (at most shards / HEAVY of them) dealt to further batches by their places in the stored input."""
    heavy = rows.groupBy("arc", "batch").agg(F.sum("size").alias("_b"), F.count("*").alias("_n")).where((F.col("_b") > mean * HEAVY) & (F.col("_n") > 1))
    heavy = heavy.select("arc", "batch", F.lit(True).alias("_heavy"))
    placed = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << DEAL_BITS))
    met = rows.withColumn("_deal", placed).join(F.broadcast(heavy), ["arc", "batch"], "left")
    return met.withColumn("batch", F.col("batch") + F.when(F.col("_heavy"), F.col("_deal")).otherwise(0)).drop("_deal", "_heavy")


def assigned(docs: DataFrame, shards: int, slack: float = 0.0005, replicas: int = 128, fits: int = 3, key: str = "doc_id", fixed_bytes: int = 16, keep: list[str] | None = None, seed: int = 11) -> DataFrame:
    """The ``keep`` columns (the key by default) with size, text_crc32 and shard."""
    spark = docs.sparkSession
    keep = [c for c in ([key] if keep is None else keep) if c not in RESULTS]
    names = {c: f"_k{i}" for i, c in enumerate(keep)}
    arcs = ring(spark, shards, replicas, seed)
    held = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(key).alias("_own_key"), "text")
    rows = stored(measured(held, list(names.values()), arcs, "_own_key", fixed_bytes, seed))
    mean = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    rows = stored(dealt(rows, mean))
    order = F.broadcast(arcs.select("arc", "shard_order").dropDuplicates(["arc"]))
    cells = stored(rows.groupBy("arc", "batch").agg(F.sum("size").alias("bytes")).join(order, "arc"))
    shard = F.coalesce(*[first_open(cuts) for cuts in openings(cells, shards, mean * (1 + slack), fits)])
    return rows.join(order, "arc").select(*[F.col(n).alias(c) for c, n in names.items()], "size", "text_crc32", shard.alias("shard"), "batch")


def shard_rows(docs: DataFrame, shards: int, **options) -> DataFrame:
    """``assigned`` rows with their ``slot``, gapless from 0 in each shard, in the order of arrival."""
    rows = stored(assigned(docs, shards, **options))
    own = [c for c in rows.columns if c not in RESULTS and c != "batch"]
    placed = ranked(rows, "shard", ["batch", "text_crc32", *own], place="slot", size="_shard_rows")
    return placed.drop("batch", "_shard_rows")
