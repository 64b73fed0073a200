"""Where observations come from, and where results go.

Prices, series and vectors are plain DataFrames; these readers give the columns that the operators expect. The panel
reader takes any table of (date, ticker, price); ``ohlcv`` reads daily bars from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OHLCV = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double"

TICKERS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Daily bars with a fixed schema, so that no pass over the files is spent on inferring one."""
    reader = spark.read.schema(OHLCV)
    bars = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    if bars.isEmpty():
        raise ValueError(f"no bars in {path}")
    return bars


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, ticker, price): each line item is a trade of the ticker named by its return flag."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.lit("market").alias("series"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("ticker"), F.col("l_extendedprice").alias("price"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, ticker, open .. volume): a day's bar of each ticker; its first and last trades are those of least and greatest order."""
    lines = table(spark, sf_dir, "lineitem")
    price, place = F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber")
    by = lines.groupBy(F.lit("market").alias("series"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("ticker"))
    return by.agg(F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.avg(price).alias("adj_close"), F.sum("l_quantity").alias("volume"))


def event_series(spark: SparkSession, sf_dir: str, processes: int = 3) -> DataFrame:
    """(process, series, step, x): the values of each user in order of time, users being dealt to processes."""
    from pyspark.sql.window import Window

    events = table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    process = F.element_at(F.array(*[F.lit(chr(65 + k)) for k in range(processes)]), (F.pmod("user_id", F.lit(processes)) + 1).cast("int"))
    return events.select(process.alias("process"), F.col("user_id").alias("series"), step.alias("step"), F.col("value").alias("x"))


def labelled_vectors(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """(process, id, x_1..x_k): the first dimensions of each embedding as one sample of the process of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.concat(F.lit("L"), F.col("label").cast("string")).alias("process"), F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(f"x_{k + 1}") for k in range(channels)])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A result table with a header; ``single`` for one file, where the table is small enough to be read by people."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
