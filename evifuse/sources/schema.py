"""The event table every operator reads."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evifuse.functions.fields import micros

EVENT = T.StructType(
    [
        T.StructField("entity_ref", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("end_timestamp", T.TimestampNTZType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("counterparty", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("raw_row_ref", T.LongType()),
        T.StructField("utr", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("imei", T.StringType()),
        T.StructField("imsi", T.StringType()),
        T.StructField("_public_ip", T.StringType()),
        T.StructField("_private_ip", T.StringType()),
        T.StructField("_port", T.IntegerType()),
        T.StructField("_data_volume_kb", T.DoubleType()),
        T.StructField("entity_id", T.StringType()),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """Event columns in order and type, missing ones null, plus us / end_us in microseconds."""
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields
    ]
    out = df.select(*cols)
    return out.withColumn("us", micros(F.col("timestamp"))).withColumn("end_us", micros(F.col("end_timestamp")))
