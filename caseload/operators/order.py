"""Places, quantiles and cuts in a total order, when one key may hold a third of all rows.

No window spans a key's rows. Rows are counted by tiers (a coarse part of the order, then finer ones), running sums over
the counts give each cell its offset, and only rows of one cell are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import stored


def placed(rows: DataFrame, keys: list[str], tiers: list[Column], order: list[Column], sums: dict[str, Column], rank: str = "rank") -> DataFrame:
    """Rows with their ``rank`` in ``order`` within ``keys``, and running sums (own row included) of ``sums``.

    ``tiers`` are descending, never null, each refines the one before it, and all agree with ``order``. Keys without
    nulls are assumed, as joins pass them over.
    """
    names = [f"_t{i}" for i in range(len(tiers))]
    parts = {rank: F.lit(1).cast("long"), **sums}
    r = rows.withColumns(dict(zip(names, tiers, strict=True)))
    cells = r.groupBy(*keys, *names).agg(*[F.sum(c).alias(f"_n_{k}") for k, c in parts.items()])
    offsets = None
    for i in range(len(names)):
        by = [*keys, *names[: i + 1]]
        at = cells.groupBy(*by).agg(*[F.sum(f"_n_{k}").alias(f"_n_{k}") for k in parts])
        above = Window.partitionBy(*keys, *names[:i]).orderBy(F.desc(names[i])).rowsBetween(Window.unboundedPreceding, -1)
        at = at.select(*by, *[F.coalesce(F.sum(f"_n_{k}").over(above), F.lit(0)).alias(f"_o{i}_{k}") for k in parts])
        offsets = at if offsets is None else offsets.join(at, by[:-1])
    up = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    values = {k: sum((F.col(f"_o{i}_{k}") for i in range(len(names))), F.sum(c).over(up)) for k, c in parts.items()}
    return r.join(offsets, [*keys, *names]).withColumns(values).select(*rows.columns, *parts)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums (own row included) of ``sums`` in ``order`` within ``keys``, when nothing is known of the order
    columns that tiers could be made from: rows are dealt by ranges, and each range starts from the sums of those before it.

    Keys without nulls are assumed; ``order`` has no ties within a key.
    """
    ranged = stored(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    held = ranged.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_n_{k}") for k, c in sums.items()])
    above = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    held = held.select(*keys, "_part", *[F.coalesce(F.sum(f"_n_{k}").over(above), F.lit(0)).alias(f"_o_{k}") for k in sums])
    up = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(held, [*keys, "_part"])
    return out.withColumns({k: F.col(f"_o_{k}") + F.sum(c).over(up) for k, c in sums.items()}).select(*rows.columns, *sums)


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], small: int = 100_000) -> DataFrame:
    """Linear quantiles of a value for each key, one column a share; nulls are passed over, a key without values has no row.

    Rows are counted by distinct value, once, into a stored table. Up to ``small`` counts meet in one buffer a key; more get
    running sums by ranges of the values, from which the wanted places are read. Both ways give the same values.
    """
    at = stored(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k")))
    if at.count() <= small:
        return at.groupBy(*keys).agg(*[F.percentile(value, F.lit(share), F.col("_k")).alias(name) for name, share in shares.items()])
    ran = stored(running(at, keys, [value], {"_to": F.col("_k")}))
    n = ran.groupBy(*keys).agg(F.max("_to").alias("_n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(share)).alias("at")) for name, share in shares.items()]))
    places = n.select(*keys, wanted.alias("_w")).select(*keys, F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at"))
    low = F.floor("_at")
    ends = F.explode(F.array(F.struct(low.alias("i"), (1 - F.col("_at") + low).alias("part")), F.struct((low + 1).alias("i"), (F.col("_at") - low).alias("part"))))
    places = places.select(*keys, "_name", ends.alias("_e")).select(*keys, "_name", F.col("_e.i").alias("_i"), F.col("_e.part").alias("_part")).where("_part > 0")
    met = _with(ran, places, keys).where("_to - _k <= _i and _i < _to")  # two places a share and key
    return met.groupBy(*keys).agg(*[F.sum(F.when(F.col("_name") == name, F.col("_part") * F.col(value))).alias(name) for name in shares])


def _with(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(b)


def lowest(rows: DataFrame, score: Column, key: str, want: int, cells: int = 4096) -> DataFrame:
    """The ``want`` rows with the lowest score in [0, 1), ties by key: whole cells below the cut, and the cut's own cell ranked."""
    cell = F.least(F.floor(score * cells), F.lit(cells - 1))
    keyed = rows.withColumns({"_s": score, "_c": cell})
    upto = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)  # over at most ``cells`` counts
    ends = keyed.groupBy("_c").agg(F.count("*").alias("_n")).withColumn("_to", F.sum("_n").over(upto)).where(F.col("_to") - F.col("_n") < want)
    got = keyed.join(F.broadcast(ends), "_c")  # ``cells`` rows at most
    cut = got.where(F.col("_to") > want).withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_s", key)))
    cut = cut.where(F.col("_r") <= want - F.col("_to") + F.col("_n")).drop("_r")
    return got.where(F.col("_to") <= want).unionByName(cut).select(*rows.columns)


def lowest_by_group(rows: DataFrame, group: str, score: Column, key: str, wants: DataFrame, cells: int = 4096) -> DataFrame:
    """For each group the rows with the lowest score in [0, 1), ties by key, as many as ``wants`` (group, want) says.

    Counts by cell of the score give each group's cut; only rows of the cut's own cell are ranked.
    """
    cell = F.least(F.floor(score * cells), F.lit(cells - 1))
    keyed = rows.withColumns({"_s": score, "_c": cell})
    upto = Window.partitionBy(group).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)  # ``cells`` counts a group at most
    at = keyed.groupBy(group, "_c").agg(F.count("*").alias("_n")).withColumn("_to", F.sum("_n").over(upto))
    ends = at.join(wants.select(group, F.col("want").alias("_want")), group).where(F.col("_to") - F.col("_n") < F.col("_want"))
    got = keyed.join(ends, [group, "_c"])
    cut = got.where(F.col("_to") > F.col("_want")).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_c").orderBy("_s", key)))
    cut = cut.where(F.col("_r") <= F.col("_want") - F.col("_to") + F.col("_n")).drop("_r")
    return got.where(F.col("_to") <= F.col("_want")).unionByName(cut).select(*rows.columns)
