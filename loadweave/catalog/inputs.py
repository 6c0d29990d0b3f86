"""Model inputs derived from the test tables (see FIXTURES.md, part B).

The readings come from `events`; feeds, weather and station records are
derived from its hourly or daily sums, regional statistics from `orders`,
`customer` and `nation`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timeparts import slot_start
from ..operators.calendar import HolidayRule

# fixed values: the event types act as communities
COMMUNITIES = ("click", "error", "purchase", "signup", "view")
# one community has no region, as in the weather data
COMMUNITY_REGION = {"click": "ES61", "error": "ES24", "purchase": "ES12", "view": "ES13"}

HOLDOUT_START = "2024-01-24 00:00:00"
HOLDOUT_END = "2024-01-31 00:00:00"

# fixed values: two national and several regional rules, among them a regional
# Tuesday, a regional Thursday and holidays at the turn of the year
RULES = (
    HolidayRule("New Year", 1, 1),
    HolidayRule("Epiphany", 1, 6),
    HolidayRule("Good Friday", easter_offset=-2),
    HolidayRule("Labour Day", 5, 1),
    HolidayRule("Christmas", 12, 25),
    HolidayRule("Click Day", 1, 16, region="click"),
    HolidayRule("Error Day", 1, 18, region="error"),
    HolidayRule("Easter Monday", easter_offset=1, region="view"),
    HolidayRule("Signup Day", 2, 29, region="signup"),
    HolidayRule("Purchase Eve", 12, 31, region="purchase"),
)


# the columns of the test tables that the model inputs come from
TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as meter readings."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"),
        F.col("ts").alias("datetime_local"),
        F.col("event_type").alias("community_code"),
        F.col("value").alias("active_kw"),
    )


def _cents() -> F.Column:
    return F.rint(F.col("value") * 100).cast("long")


def feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three hourly feeds of (datetime_local, value); solar and wind lack some hours."""
    ev = table(spark, sf_dir, "events").select(slot_start("ts", 60).alias("datetime_local"), "event_type", "value")

    def of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("datetime_local").agg((F.sum(_cents()).cast("double") / 100.0).alias("value"))

    return {
        "demand_fc": of(ev),
        "pv_fc": of(ev.where("event_type = 'view'")),
        "wind_fc": of(ev.where("event_type = 'click'")),
    }


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather per community; every 17th hour or so lacks its temperature."""
    ev = table(spark, sf_dir, "events").select(
        slot_start("ts", 60).alias("datetime_local"), F.col("event_type").alias("community_code"), "event_id", "value"
    )
    hours = ev.groupBy("datetime_local", "community_code").agg(F.sum(_cents()).alias("s"), F.min("event_id").alias("e"))
    return hours.selectExpr(
        "datetime_local",
        "community_code",
        "case when e % 17 <> 0 then double(s % 4000) / 100 - 5.0D end as temperature_2m",
        "double(s % 3000) / 100 - 10.0D as dew_point_2m",
        "double(s % 101) as cloud_cover",
        "double(s % 97) as relative_humidity_2m",
        "to_date(datetime_local) as date",
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily station records as text with decimal commas and trace marks."""
    ev = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("d"), F.col("event_type").alias("community_code"), "event_id", "value"
    )
    days = ev.groupBy("d", "community_code").agg(F.sum(_cents()).alias("s"), F.min("event_id").alias("e"))

    def comma(modulus: int) -> F.Column:
        return F.replace(((F.col("s") % modulus).cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))

    return days.select(
        F.when(F.col("e") % 29 == 0, F.lit("no date")).otherwise(F.col("d").cast("string")).alias("fecha"),
        "community_code",
        F.concat(F.lit(" "), comma(4000), F.lit(" ")).alias("tmed"),
        F.when(F.col("e") % 3 == 0, F.lit("Ip")).when(F.col("e") % 3 == 1, F.lit("Acum")).otherwise(comma(900)).alias("prec"),
        comma(2300).alias("velmedia"),
        F.when(F.col("e") % 2 == 0, F.lit("Varias")).otherwise(F.lit("12:30")).alias("horatmax"),
    )


def weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly weather as documents with parallel arrays, one per community and day."""
    hours = weather(spark, sf_dir).select("community_code", "date", F.date_format("datetime_local", "yyyy-MM-dd'T'HH:mm").alias("time"), "temperature_2m", "cloud_cover")
    rows = F.sort_array(F.collect_list(F.struct("time", "temperature_2m", "cloud_cover")))
    docs = hours.groupBy("community_code", "date").agg(rows.alias("r"))
    arrays = [F.col(f"r.{c}").alias(c) for c in ("time", "temperature_2m", "cloud_cover")]
    empty = F.transform("r.time", lambda _: F.lit(None).cast("double")).alias("snow_depth")
    return docs.select(
        "community_code",
        (F.length("community_code") + 0.5).alias("latitude"),
        F.lit(-3.5).alias("longitude"),
        F.lit(650.0).alias("elevation"),
        F.struct(*arrays, empty).alias("hourly"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nuts2_code, population): customers per nation."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    counts = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("population"))
    return counts.join(n, "n_nationkey").select(F.col("n_name").alias("nuts2_code"), "population")


def area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nuts2_code, region_name, area_km2); NATION_7 has no area."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("nuts2_code"),
        F.concat(F.lit("Region "), F.col("n_nationkey").cast("string")).alias("region_name"),
        F.when(F.col("n_nationkey") != 7, F.pmod(F.col("n_nationkey"), F.lit(5)) * F.lit(0.02) + F.lit(0.03)).alias("area_km2"),
    )


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, segment, status, y, cents, orders): all that the regional statistics need of the orders.

    Orders are summed per customer before they meet the customers, and again per
    nation and segment, so the join sees a row per customer, year and status.
    """
    o, c = (table(spark, sf_dir, x) for x in ("orders", "customer"))
    per_customer = o.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("y")).agg(
        F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("orders")
    )
    rows = per_customer.join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    keys = [F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"), "status", "y"]
    return rows.groupBy(*keys).agg(F.sum("cents").alias("cents"), F.sum("orders").alias("orders"))


def sector_values(spark: SparkSession, sf_dir: str, totals: DataFrame | None = None) -> DataFrame:
    """Wide table: region x sector (TOTAL for all) with one text column per order year."""
    totals = order_totals(spark, sf_dir) if totals is None else totals
    # a row per nation, segment, status and year by now, so the second copy is small
    rows = totals.select("n_nationkey", F.explode(F.array("segment", F.lit("TOTAL"))).alias("nace_r2"), "y", "cents")
    sums = rows.groupBy("n_nationkey", "nace_r2").pivot("y", list(range(1995, 2002)))
    wide = sums.agg((F.sum("cents").cast("decimal(30,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").cast("string"))
    named = wide.join(table(spark, sf_dir, "nation"), "n_nationkey").drop("n_nationkey", "n_regionkey")
    return named.withColumnRenamed("n_name", "nuts2_code")


def nights(spark: SparkSession, sf_dir: str, totals: DataFrame | None = None) -> DataFrame:
    """(nuts2_code, nights): order counts per nation and status, several rows per region."""
    totals = order_totals(spark, sf_dir) if totals is None else totals
    sums = totals.groupBy("n_nationkey", "status").agg(F.sum("orders").cast("double").alias("nights"))
    return sums.join(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("n_name").alias("nuts2_code"), "nights")
