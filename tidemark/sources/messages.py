"""Trade messages as JSON text to rows, a message whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed format of a message: names of its fields and the topic's start. Rows are maps, as two fields differ in case alone.
MESSAGE = "topic string, ts bigint, data array<map<string, string>>"
TOPIC = "publicTrade."


def _positive(x: Column) -> Column:
    number = x.try_cast("double")
    return F.coalesce((number > 0) & (number < F.lit(float("inf"))), F.lit(False))


def _whole(x: Column) -> Column:
    return F.when(x.rlike(r"^[0-9]{1,18}$"), x.try_cast("bigint"))


def parse_messages(df: DataFrame, raw: str, quote: str = "") -> DataFrame:
    """df's columns, symbol, message_ts_ms, valid and message; control messages of other topics go.

    A message is valid if its envelope and all its rows are: the topic's symbol
    (ending in ``quote``), distinct ids, times that never fall nor pass the
    message's own, a side, a sequence number and positive price and quantity.
    """
    parsed = df.withColumn("message", F.from_json(raw, MESSAGE)).where(F.startswith(F.col("message.topic"), F.lit(TOPIC)))
    parsed = parsed.withColumn("symbol", F.upper(F.trim(F.substring("message.topic", len(TOPIC) + 1, 1000)))).withColumn("message_ts_ms", F.col("message.ts"))
    data, ids = F.col("message.data"), F.transform("message.data", lambda x: F.trim(x["i"]))
    times = F.transform(data, lambda x: _whole(x["T"]))

    def fits(x: Column) -> Column:
        tests = [
            F.upper(F.trim(x["s"])) == F.col("symbol"), F.trim(x["i"]) != "", _whole(x["T"]).between(1, F.col("message_ts_ms")),
            _whole(x["seq"]) >= 0, F.initcap(F.trim(x["S"])).isin("Buy", "Sell"), _positive(x["p"]), _positive(x["v"]), x["BT"].isin("true", "false"), F.coalesce(x["RPI"], F.lit("false")).isin("true", "false"),
        ]
        whole = F.lit(True)
        for test in tests:
            whole = whole & F.coalesce(test, F.lit(False))
        return whole

    valid = (
        F.endswith("symbol", F.lit(quote)) & (F.col("message_ts_ms") > 0) & (F.size(data) > 0) & F.forall(data, fits)
        & (F.size(F.array_distinct(ids)) == F.size(ids)) & (times == F.array_sort(times))
    )
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def message_rows(parsed: DataFrame) -> DataFrame:
    """The trades of valid messages, in delivered order within a message: row_index from 0."""
    x, t = parsed.where("valid").select("symbol", "message_ts_ms", F.posexplode("message.data").alias("row_index", "t")), F.col("t")
    return x.select(
        "symbol", "message_ts_ms", "row_index", F.trim(t["i"]).alias("trade_id"), _whole(t["T"]).alias("trade_ts_ms"), _whole(t["seq"]).alias("seq"), F.initcap(F.trim(t["S"])).alias("side"),
        t["p"].cast("double").alias("price"), t["v"].cast("double").alias("qty"), (t["BT"] == "true").alias("is_block_trade"), (F.coalesce(t["RPI"], F.lit("false")) == "true").alias("is_rpi_trade"),
    )
