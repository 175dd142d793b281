"""Event, area, boundary and demographic tables derived from the test tables, with the library's input schemas.

Every formula uses exact integer arithmetic before one division, so that the checking SQL gets identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventrates.functions import fixed_values as fixed

YEARS = [2017, 2018, 2019]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(column: str, n: int) -> Column:
    return F.col(column) % n


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the columns of a raw event export."""
    events = table(spark, sf_dir, "events")
    years_back = F.when(_mod("event_id", 101) == 0, 3).otherwise(5 + _mod("event_id", 3))
    shifted = F.col("ts") + F.make_ym_interval(-years_back.cast("int"), _mod("event_id", 12).cast("int"))
    signup = (
        F.when(_mod("event_id", 4) == 0, "Native American")
        .when(_mod("event_id", 4) == 1, "")
        .when(_mod("event_id", 4) == 2, "Asian")
        .otherwise("Other")
    )
    race = (
        F.when(F.col("event_type") == "click", "Black")
        .when(F.col("event_type") == "view", "White")
        .when(F.col("event_type") == "error", "East African")
        .when(F.col("event_type") == "purchase", "Latino")
        .otherwise(signup)
    )
    return events.select(
        "event_id",
        F.when(_mod("user_id", 37) == 0, "")
        .otherwise(F.concat(F.lit("N"), _mod("user_id", 50).cast("string")))
        .alias("neighborhood"),
        F.when(_mod("event_id", 40) == 0, "Truancy (P)")
        .when(_mod("event_id", 3) == 0, "Suspicious Person (P)")
        .otherwise("Traffic Law Enforcement (P)")
        .alias("problem"),
        F.when(_mod("event_id", 7) < 3, "Female").when(_mod("event_id", 7) == 6, "Unknown").otherwise("Male").alias("gender"),
        race.alias("race"),
        F.when(_mod("event_id", 3) == 0, "Unknown").otherwise(race).alias("preRace"),
        F.when(_mod("event_id", 17) == 0, "").when(F.col("value") >= 60, "YES").otherwise("NO").alias("personSearch"),
        F.when(_mod("event_id", 19) == 0, "")
        .when(F.col("value").between(40, 90), "YES")
        .otherwise("NO")
        .alias("vehicleSearch"),
        F.when(_mod("event_id", 6) == 0, fixed.BOOKED).otherwise("TAG-Tagged").alias("callDisposition"),
        F.when(_mod("event_id", 9) == 0, F.lit(None).cast("string"))
        .when(_mod("event_id", 2) == 0, "Citizen / 9-1-1")
        .otherwise("Investigative")
        .alias("reason"),
        F.concat(F.date_format(shifted, "yyyy/MM/dd HH:mm:ss"), F.lit("+00")).alias("responseDate"),
        (44.9 + (F.col("event_id") * 7919 % 2003) / 10000.0).alias("lat"),
        (-93.4 + (F.col("event_id") * 104729 % 2503) / 10000.0).alias("long"),
    )


def _vertex(x: Column, y: Column) -> Column:
    return F.named_struct(F.lit("x"), -93.4 + x / 320.0, F.lit("y"), 44.9 + y / 400.0)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per nation and year: a notched square of a 5 x 5 grid, every third one with a hole."""
    n = F.col("n_nationkey")
    x, y = n % 5 * 16, F.floor(n / 5) * 16

    def ring(points: list[tuple[int, int]]) -> Column:
        return F.array(*[_vertex(x + dx, y + dy) for dx, dy in points])

    outer = ring([(0, 0), (16, 0), (16, 16), (8, 8), (0, 16), (0, 0)])
    hole = ring([(6, 2), (10, 2), (10, 6), (6, 6)])
    return table(spark, sf_dir, "nation").select(
        F.explode(F.array(*[F.lit(v) for v in YEARS])).alias("YEAR"),
        geoid(n).alias("GEOID"),
        F.col("n_name").alias("NAME"),
        F.when(n % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"),
    )


def geoid(nation: Column) -> Column:
    return F.concat(F.lit("27053"), F.lpad(nation.cast("string"), 6, "0"))


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per region: a slanted band over the middle rows of the grid."""
    x = F.col("r_regionkey") * 16
    corners = [(1, 20), (14, 24), (14, 56), (1, 60)]
    ring = F.array(*[_vertex(x + dx, F.lit(dy)) for dx, dy in corners])
    return table(spark, sf_dir, "region").select(F.array(ring).alias("rings"))


def demographics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation, year and source variable, from the number of customers of the nation."""
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    nation = table(spark, sf_dir, "nation")
    placed = nation.join(customers, nation.n_nationkey == customers.c_nationkey, "left")
    codes = F.array(*[F.lit(code) for code in fixed.VARIABLE_CODES.values()])
    variables = placed.select(
        "n_nationkey",
        "n_name",
        F.coalesce("people", F.lit(0)).alias("people"),
        F.posexplode(codes).alias("i", "variable"),
    )
    return variables.select(
        F.explode(F.array(*[F.lit(v) for v in YEARS])).alias("YEAR"),
        geoid(F.col("n_nationkey")).alias("GEOID"),
        F.col("n_name").alias("NAME"),
        "variable",
        "i",
        "people",
    ).select(
        "YEAR",
        "GEOID",
        "NAME",
        "variable",
        (F.col("people") * (1 + F.col("i") % 7) + F.col("i") + F.col("YEAR") - 2017).cast("double").alias("estimate"),
        F.col("i").cast("double").alias("moe"),
    )


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation of their customer and their year; the small sides are left to the optimizer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.year("o_orderdate").alias("YEAR"),
            F.col("n_name").alias("NAME"),
            F.col("o_orderpriority").alias("category"),
            F.col("o_totalprice").alias("price"),
        )
    )


def nation_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation - all, and by market segment - for every nation and year with orders."""
    segment = F.col("c_mktsegment")
    people = (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(
            F.count(F.lit(1)).alias("tot_pop"),
            F.count_if(segment == "MACHINERY").alias("tot_black"),
            F.count_if(segment.isin("BUILDING", "FURNITURE")).alias("tot_white"),
        )
    )
    nation = table(spark, sf_dir, "nation")
    named = people.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        geoid(F.col("n_nationkey")).alias("GEOID"), F.col("n_name").alias("NAME"), "tot_pop", "tot_black", "tot_white"
    )
    return nation_orders(spark, sf_dir).select("YEAR", "NAME").distinct().join(named, "NAME")
