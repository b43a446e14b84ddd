"""Deposits as one long table, and how they are read and written.

A row of `steps` is a deposit: shower_id, point_index (its 0-based place in the
shower), x, y, z, e as FLOAT, and optional t, cell_id, pdg, track_id,
subdetector. Unsigned 64-bit cell ids are kept as BIGINT with the same bits.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = {"shower_id": "int", "point_index": "bigint", "x": "float", "y": "float", "z": "float", "e": "float"}
OPTIONAL = {"t": "float", "cell_id": "bigint", "pdg": "int", "track_id": "int", "subdetector": "smallint", "cluster_label": "bigint"}
PRIMARY = "shower_id int, pdg int, vertex array<float>, momentum array<float>"
#: Cell encoding of the deposits made from lineitem.
ENCODING = "system:8,layer:8,x:-8,y:-8"


def signed_bits(column):
    """BIGINT with the bits of an unsigned 64-bit number that was read as DECIMAL(20,0)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c >= F.lit("9223372036854775808").cast("decimal(20,0)"), c - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c).cast("bigint")


def conform(df: DataFrame) -> DataFrame:
    """Casts the known columns of a table of deposits; others are dropped, a missing one raises ValueError."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"steps lack {', '.join(missing)}")
    kinds = dict(df.dtypes)
    columns = []
    for name, kind in (REQUIRED | OPTIONAL).items():
        if name in df.columns:
            wide = name == "cell_id" and kinds[name].startswith("decimal")
            columns.append((signed_bits(name) if wide else F.col(name).cast(kind)).alias(name))
    return df.select(*columns)


def check_steps(df: DataFrame) -> DataFrame:
    """df, failing at run time where an energy is negative (NaN passes; see the sanity validator)."""
    bad = F.raise_error(F.concat(F.lit("negative energy in shower "), F.col("shower_id").cast("string")))
    return df.withColumn("e", F.when((F.col("e") < 0) & ~F.isnan("e"), bad.cast("float")).otherwise(F.col("e")))


READERS = {".parquet": "parquet", ".json": "json", ".csv": "csv", ".orc": "orc"}
GATED = (".h5", ".hdf5", ".root")


def read_steps(spark: SparkSession, path: str, *, shower_limit: int | None = None, collections: list[str] | None = None) -> DataFrame:
    """Deposits of a file or folder; its last suffix names the format. collections: what is read of ROOT event files."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix in GATED:
        return limit_showers(_gated(spark, path, suffix, collections), shower_limit)
    if suffix not in READERS:
        raise ValueError(f"unknown format {suffix or path!r}")
    kind = READERS[suffix]
    if kind in ("json", "csv"):
        schema = ", ".join(f"{k} {v}" for k, v in (REQUIRED | OPTIONAL).items())
        df = spark.read.schema(schema).option("header", "true").format(kind).load(path)
    else:
        df = spark.read.format(kind).load(path)
    return limit_showers(conform(df), shower_limit)


def _gated(spark: SparkSession, path: str, suffix: str, collections: list[str] | None) -> DataFrame:
    from showerlake.sources import files

    return conform(files.events(spark, path, collections)[0] if suffix == ".root" else files.hdf5_steps(spark, path))


def limit_showers(steps: DataFrame, n: int | None) -> DataFrame:
    """Deposits of the n smallest shower ids."""
    if n is None:
        return steps
    ids = steps.select("shower_id").distinct().orderBy("shower_id").limit(n)
    return steps.join(ids, "shower_id", "left_semi")


def flatten_events(events: DataFrame, collections: list[str] | None, *, pdg: bool = True, track_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """(steps, primaries) of nested events.

    events: event, particles array<struct<pdg, vertex, momentum, created>>, hits
    map<string, array<struct<cell_id, contributions array<struct<x, y, z, e, t,
    pdg, particle>>>>>. The subdetector is the collection's place in the list;
    the primary is the first particle that the simulation did not create; no
    collections give no deposits.
    """
    first = F.element_at(F.filter("particles", lambda p: ~p["created"]), 1)
    primaries = events.where(F.exists("particles", lambda p: ~p["created"])).select(F.col("event").cast("int").alias("shower_id"), first["pdg"].alias("pdg"), first["vertex"].alias("vertex"), first["momentum"].alias("momentum"))
    names = F.array(*[F.lit(c) for c in collections or []]).cast("array<string>")
    hits = events.select("event", F.posexplode(names).alias("subdetector", "name"), "hits")
    hits = hits.select("event", "subdetector", F.posexplode(F.element_at("hits", F.col("name"))).alias("hit", "h"))
    flat = hits.select("event", "subdetector", "hit", F.col("h.cell_id").alias("cell_id"), F.posexplode("h.contributions").alias("part", "c"))
    order = F.row_number().over(Window.partitionBy("event").orderBy("subdetector", "hit", "part")) - 1
    columns = [F.col("event").cast("int").alias("shower_id"), order.cast("bigint").alias("point_index"), *[F.col(f"c.{k}").cast("float").alias(k) for k in ("x", "y", "z", "e", "t")], F.col("cell_id").cast("bigint"), F.col("subdetector").cast("smallint")]
    columns += [F.col("c.pdg").cast("int").alias("pdg")] if pdg else []
    columns += [F.col("c.particle").cast("int").alias("track_id")] if track_id else []
    return flat.select(*columns), primaries


def last_primary(primaries: DataFrame, order: str) -> DataFrame:
    """One primary for each shower: of duplicates that with the largest `order`."""
    cols = [c for c in primaries.columns if c not in ("shower_id", order)]
    return primaries.groupBy("shower_id").agg(*[F.max_by(c, order).alias(c) for c in cols])


def write_steps(steps: DataFrame, path: str, *, algorithm: str, source_input: str, primaries: DataFrame | None = None, extra: dict | None = None) -> str:
    """Writes steps (and primaries) as Parquet under path, and metadata as one JSON row beside them."""
    spark = steps.sparkSession
    steps.write.mode("overwrite").parquet(f"{path}/steps.parquet")
    if primaries is not None:
        zero = F.array(*[F.lit(0.0).cast("float")] * 3)
        filled = primaries.select("shower_id", F.coalesce("pdg", F.lit(0)).alias("pdg"), F.coalesce("vertex", zero).alias("vertex"), F.coalesce("momentum", zero).alias("momentum"))
        filled.write.mode("overwrite").parquet(f"{path}/primary.parquet")
    meta = json.dumps({"algorithm": algorithm, "source_input": source_input} | (extra or {}), sort_keys=True)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")
    return path


def write_debug_steps(steps: DataFrame, labels: DataFrame, path: str, *, algorithm: str, source_input: str, ordinals: list[int]) -> str:
    """Deposits of the showers at the given ordinals, with the cluster each went to."""
    labelled = pick_showers(steps, ordinals).join(labels, ["shower_id", "point_index"])
    return write_steps(labelled, path, algorithm=algorithm, source_input=source_input, extra={"debug_output": True, "debug_event_indices": ordinals})


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta.json").first()[0])


def pick_showers(steps: DataFrame, ordinals: list[int]) -> DataFrame:
    """Deposits of the showers at 0-based ordinals among the ascending ids; an ordinal out of range raises IndexError."""
    most = max(ordinals, default=-1)
    ids = steps.select("shower_id").distinct().orderBy("shower_id").limit(most + 1)
    numbered = ids.select("shower_id", (F.row_number().over(Window.orderBy("shower_id")) - 1).alias("k"))  # bounded by the largest ordinal
    if most >= 0 and (min(ordinals) < 0 or numbered.count() <= most):
        raise IndexError(f"no shower {most if min(ordinals) >= 0 else min(ordinals)}")
    return steps.join(numbered.where(F.col("k").isin(ordinals)).select("shower_id"), "shower_id", "left_semi")


def steps_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's lineitem as deposits: a shower for each supplier."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    bits = lambda c: c.bitwiseAND(F.lit(255))
    cell = F.expr("l_suppkey % 4 + l_linenumber * 256")
    cell = cell + bits(F.floor(F.col("l_quantity") / 10).cast("bigint") - 2) * 65536 + bits(F.floor(F.round(F.col("l_discount") * 100) / 3).cast("bigint") - 2) * 16777216
    return li.select(
        F.col("l_suppkey").cast("int").alias("shower_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("point_index"),
        (F.col("l_quantity") * 4).cast("float").alias("x"),
        (F.lit(1250) + F.col("l_discount") * 1000).cast("float").alias("y"),
        (F.col("l_tax") * 1000).cast("float").alias("z"),
        (F.col("l_extendedprice") / 1000).cast("float").alias("e"),
        F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("float").alias("t"),
        cell.cast("bigint").alias("cell_id"),
    )


def primaries_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A primary for each supplier: its momentum runs along +-x by the sign of its balance."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").cast("int").alias("shower_id"), F.lit(22).alias("pdg"), F.array(*[F.lit(0.0).cast("float")] * 3).alias("vertex"), F.array(F.col("s_acctbal").cast("float"), F.lit(0.0).cast("float"), F.lit(0.0).cast("float")).alias("momentum"))
