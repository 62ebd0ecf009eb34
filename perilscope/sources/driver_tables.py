"""Stand-ins for the reference's inputs, derived from the driver's tables.

The reference reads per-hazard ``(country, year, affected | death)`` files
and a wide economic-damage file. Here they are derived from the TPC-H-like
tables so that every query's work grows with the data:

* hazard  := ``o_orderpriority`` (fixed mapping below, all five priorities);
* affected := ``sum(l_quantity)`` of line items with ``l_returnflag <> 'N'``;
* death    := number of orders with ``o_orderstatus <> 'P'``, as a double;
* damage   := ``avg(l_discount) * 100`` per hazard, pivoted wide.

Entity is ``c_name`` (customer grain) or ``n_name`` (nation grain); period is
the year, ``year*12 + month - 1`` or ``year*4 + quarter - 1``.

Plan shape (built for scale): line items are pre-aggregated per order
(partial aggregation map-side; line items of an order sit together in the
files, so this shrinks the largest table about four-fold before it is
shuffled), joined to orders on the key they are already partitioned by and
reduced to (customer, period, hazard) with a partial aggregate, which
collapses a hot customer map-side. Only that table is joined to customer
and the 25-row nation table and reduced to the entity. All three measures
come from that one fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DAMAGE_COLUMNS, HAZARDS
from ..session import stage

# ---------------------------------------------------------------------------
# The driver tables' priority → hazard mapping.
# ---------------------------------------------------------------------------
PRIORITY_HAZARD = {
    "1-URGENT": "flood",
    "2-HIGH": "drought",
    "3-MEDIUM": "storms",
    "4-NOT SPECIFIED": "extreme_temp",
    "5-LOW": "storms",
}
# Hazard name → column of the wide damage stand-in (totals spelling).
DAMAGE_OF_HAZARD = {"drought": "drought", "flood": "flood", "storms": "storm",
                    "extreme_temp": "extreme_temp"}

# Grain name → (entity level, period unit).
GRAINS = {
    "sparse": ("customer", "year"),
    "gappy": ("nation", "month"),
    "model": ("nation", "quarter"),
    "dense": ("nation", "year"),
}

# Stand-in entity lists for the aggregate-row filter (the reference's list
# names regions that do not exist in the driver tables).
EXCLUDED_NATIONS = ["NATION_0", "NATION_5", "NATION_10", "NATION_15",
                    "NATION_20"]
EXCLUDED_CUSTOMERS = ["Customer#000000000", "Customer#000000007",
                      "Customer#000000011", "Customer#000000042",
                      "Customer#000000100"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar_date(df: DataFrame, col: str) -> Column:
    """Calendar date of a timestamp column, independent of the session zone.

    Wall-clock timestamps (NTZ) convert directly; instants are read in UTC
    through epoch seconds, so a cluster in another zone gets the same years.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampType):
        return F.date_from_unix_date(
            F.floor(F.unix_seconds(F.col(col)) / 86400).cast("int"))
    return F.to_date(F.col(col))


def period_of(date: Column, unit: str) -> Column:
    y = F.year(date)
    if unit == "year":
        return y
    if unit == "month":
        return y * 12 + F.month(date) - 1
    if unit == "quarter":
        return y * 4 + F.quarter(date) - 1
    raise ValueError(f"unknown period unit {unit!r}")


def hazard_of(priority: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in PRIORITY_HAZARD.items()
                             for x in kv])
    return mapping[priority]


def order_facts(spark: SparkSession, sf_dir: str, grain: str,
                materialise: bool = True) -> DataFrame:
    """One row per (country, year, hazard) with the sums behind all measures.

    Columns: ``country, year, hazard, aff_sum, aff_n, disc_sum, disc_n,
    death_n``. ``year`` is the period number of the grain. With
    ``materialise`` the table is written once to the checkpoint folder:
    every measure and pipeline branch then reads that one aggregate
    instead of re-running the scans and joins per branch.
    """
    level, unit = GRAINS[grain]
    li = (table(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
          .groupBy("l_orderkey")
          .agg(F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity")))
               .alias("aff_sum"),
               F.count_if(F.col("l_returnflag") != "N").alias("aff_n"),
               F.sum("l_discount").alias("disc_sum"),
               F.count("l_discount").alias("disc_n")))
    orders = table(spark, sf_dir, "orders")
    o = (orders
         .select("o_orderkey", "o_custkey",
                 period_of(calendar_date(orders, "o_orderdate"), unit).alias("year"),
                 hazard_of(F.col("o_orderpriority")).alias("hazard"),
                 (F.col("o_orderstatus") != "P").alias("is_death")))
    per_order = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    sums = [F.sum("aff_sum").alias("aff_sum"), F.sum("aff_n").alias("aff_n"),
            F.sum("disc_sum").alias("disc_sum"), F.sum("disc_n").alias("disc_n")]
    # Reduced by customer before any further join: a customer with a large
    # share of the orders collapses map-side, and customer joins a table of
    # (customer, period, hazard) rows instead of the orders.
    per_cust = (per_order.groupBy("o_custkey", "year", "hazard")
                .agg(*sums, F.count_if("is_death").alias("death_n")))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name",
                                                   "c_nationkey")
    joined = per_cust.join(cust, per_cust["o_custkey"] == cust["c_custkey"])
    if level == "customer":
        entity = F.col("c_name")
    else:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        joined = joined.join(nation, joined["c_nationkey"] == nation["n_nationkey"])
        entity = F.col("n_name")
    facts = (joined.groupBy(entity.alias("country"), "year", "hazard")
             .agg(*sums, F.sum("death_n").alias("death_n")))
    return stage(facts, f"facts-{grain}") if materialise else facts


def affected(facts: DataFrame) -> DataFrame:
    """``country, year, hazard, affected`` (line items with a return flag)."""
    return (facts.where(F.col("aff_n") > 0)
            .select("country", "year", "hazard",
                    F.col("aff_sum").cast("double").alias("affected")))


def death(facts: DataFrame) -> DataFrame:
    """``country, year, hazard, death`` (orders not pending), as a double."""
    return (facts.where(F.col("death_n") > 0)
            .select("country", "year", "hazard",
                    F.col("death_n").cast("double").alias("death")))


def damage_wide(facts: DataFrame) -> DataFrame:
    """``country, year, drought, flood, storm, extreme_temp`` (% of GDP
    stand-in). One group-by with a value per hazard of an explicit list."""
    long = (facts.where(F.col("disc_n") > 0)
            .select("country", "year", "hazard",
                    (F.try_divide(F.col("disc_sum"), F.col("disc_n")) * 100).alias("pct")))
    wide = long.groupBy("country", "year").agg(*[
        F.max(F.when(F.col("hazard") == h, F.col("pct"))).alias(h) for h in HAZARDS])
    hazard_of_column = {v: k for k, v in DAMAGE_OF_HAZARD.items()}
    return wide.select("country", "year",
                       *[F.col(hazard_of_column[c]).alias(c)
                         for c in DAMAGE_COLUMNS])


def measures_long(facts: DataFrame, how: str = "full") -> DataFrame:
    """affected ⋈ death on (country, year, hazard) — J1 (full) / J2 (inner).

    Both stand-in measures are columns of the same fact table, unique per
    key, so the join is a filter on which of them is present: no shuffle.
    :func:`measures_joined` runs the literal join of the two tables.
    """
    aff = F.col("aff_n") > 0
    dth = F.col("death_n") > 0
    cond = (aff | dth) if how == "full" else (aff & dth)
    return facts.where(cond).select(
        "country", "year", "hazard",
        F.when(aff, F.col("aff_sum").cast("double")).alias("affected"),
        F.when(dth, F.col("death_n").cast("double")).alias("death"))


def measures_joined(facts: DataFrame, how: str = "full") -> DataFrame:
    """J1 / J2 as the reference writes it: join the affected and death
    tables on (country, year, hazard)."""
    from ..operators.joins import join_on_keys
    return join_on_keys(affected(facts), death(facts),
                        ["country", "year", "hazard"], how)


def hazard_frame(long: DataFrame, hazard: str) -> DataFrame:
    """One hazard's ``country, year, affected, death`` frame, as the
    reference reads it."""
    return long.where(F.col("hazard") == hazard).drop("hazard")
