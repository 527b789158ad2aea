"""Registration of queries with their SQL, and the logical tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.session import table

ORDERS_AS_OF = "2001-08-01 00:00:00"  # the greatest order date of the data
EVENTS_AS_OF = "2024-01-31 00:00:00"


def orders_now():
    """The clock of the orders as a column."""
    return F.lit(ORDERS_AS_OF).cast("timestamp")


def events_now():
    """The clock of the events as a column."""
    return F.lit(EVENTS_AS_OF).cast("timestamp")


class Tables:
    """The tables of one data directory; attributes read them on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def tasks(self) -> DataFrame:
        """Orders as tasks and facts: status, verified_at, a replacement link for every seventh."""
        status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("blocked")
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("owner"),
            status.alias("status"),
            F.col("o_orderpriority").alias("source"),
            F.col("o_orderdate").cast("timestamp").alias("verified_at"),
            F.col("o_totalprice").alias("value"),
            F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") + 1).alias("superseded_by"),
        )

    @property
    def log(self) -> DataFrame:
        """Events as an audit log and as sessions and recalls."""
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("actor"),
            F.col("event_type").alias("action"),
            F.col("ts").cast("timestamp").alias("at"),
            F.col("value"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            F.col("props"),
        )

    @property
    def runs(self) -> DataFrame:
        """Lineitems as command runs."""
        return self.lineitem.select(
            F.col("l_orderkey"),
            F.col("l_linenumber"),
            F.col("l_returnflag").alias("kind"),
            F.col("l_linestatus").alias("cmdline"),
            (F.col("l_discount") < 0.05).alias("success"),
            F.col("l_shipdate").cast("timestamp").alias("run_at"),
        )


class Family:
    """A set of queries under construction."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Registers f(tables) as a query; without SQL its rows alone are checked."""

        def register(f: Callable[[Tables], DataFrame]):
            self.QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.SQL[name] = sql.strip()
            return f

        return register
