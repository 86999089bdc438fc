"""Packet and segment tables: decoding, port and interface filters, copy removal, flow keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from apilens import schemas
from apilens.functions.values import big_endian

# The three port lists.
CAPTURE_PORTS = (80, 8080, 8000, 3000, 5000, 8443, 9000)
PACKET_PORTS = (80, 443, 8080, 8000, 3000, 5000, 8443, 9000)
RAW_SOCKET_PORTS = (80, 8080, 8000, 3000, 5000)

TCP = 6
LOOPBACK = "lo"
# Fixed value: interfaces that carry pod, host or bridge traffic.
PREFERRED_INTERFACES = r"^(?:veth.*|eth0|docker.*|br.*|cni.*|flannel.*)$"

FLOW = ("node", "src_ip", "src_port", "dst_ip", "dst_port")


def read_segments(
    spark: SparkSession, path: str, streaming: bool = False, max_files_per_trigger: int = 64
) -> DataFrame:
    """Stored segments with a payload; a stream takes a bounded number of files per batch."""
    if streaming:
        table = (
            spark.readStream.schema(schemas.SEGMENTS)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path)
        )
    else:
        table = spark.read.schema(schemas.SEGMENTS).parquet(path)
    return non_empty(table)


def non_empty(segments: DataFrame) -> DataFrame:
    return segments.filter(F.length("payload") > 0)


def decode_packets(packets: DataFrame) -> DataFrame:
    """IPv4/TCP packets to segments: fixed 20-byte IP header, TCP data offset honoured."""
    packet = F.col("packet")

    def address(start: int) -> Column:
        return F.concat_ws(
            ".", *[big_endian(packet, start + at, 1).cast("string") for at in range(4)]
        )

    offset = F.shiftright(big_endian(packet, 33, 1).cast("int"), 4) * 4
    size = F.length(packet)
    return packets.filter(
        (size > 40) & (big_endian(packet, 10, 1) == TCP) & (size > offset + 20)
    ).select(
        "ts",
        "node",
        "iface",
        address(13).alias("src_ip"),
        big_endian(packet, 21, 2).cast("int").alias("src_port"),
        address(17).alias("dst_ip"),
        big_endian(packet, 23, 2).cast("int").alias("dst_port"),
        big_endian(packet, 25, 4).alias("seq"),
        F.substring(packet, offset + 21, size).alias("payload"),
    )


def http_port_filter(
    df: DataFrame,
    ports: tuple[int, ...] = CAPTURE_PORTS,
    source: str = "src_port",
    destination: str = "dst_port",
) -> DataFrame:
    """Rows with an HTTP port on either side; pushed to Parquet."""
    return df.filter(F.col(destination).isin(*ports) | F.col(source).isin(*ports))


def select_interfaces(df: DataFrame) -> DataFrame:
    """Keep pod, host and bridge interfaces; per node, if it has none of them, all but loopback.

    Which interfaces exist is a property of the node, so the test is one small aggregate per node.
    """
    usable = df.filter(F.col("iface") != LOOPBACK)
    fallback = (
        usable.groupBy("node")
        .agg(F.bool_or(F.col("iface").rlike(PREFERRED_INTERFACES)).alias("has_preferred"))
        .filter(~F.col("has_preferred"))
        .select("node", F.lit(True).alias("take_all"))
    )
    return (
        usable.join(fallback, "node", "left")
        .filter(F.col("iface").rlike(PREFERRED_INTERFACES) | F.col("take_all"))
        .drop("take_all")
    )


# Copies of a segment follow each other within this time.
COPY_GAP_SECONDS = 10


def dedup_segments(segments: DataFrame, gap_seconds: int = COPY_GAP_SECONDS) -> DataFrame:
    """Of copies of a segment on a node the earliest: same flow, seq and payload, and no more than
    ``gap_seconds`` after the copy before. What comes later is a new segment (a reused port, a wrapped
    seq); so is every segment whose seq is unknown (null).

    Copies inside a stretch of ``gap_seconds`` combine before the shuffle, so a segment that is repeated
    very often costs one row per input partition.
    """
    width = gap_seconds * 1_000_000
    copy = [*FLOW, "seq", "payload"]
    ts_us = F.unix_micros("ts")
    stretches = (
        segments.filter(F.col("seq").isNotNull())
        .groupBy(*copy, F.floor(ts_us / F.lit(width)).alias("stretch"))
        .agg(F.min("ts").alias("ts"), F.max("ts").alias("last"))
    )
    before = F.lag("last").over(W.partitionBy(*copy).orderBy("stretch"))
    first = stretches.withColumn("before", before).filter(
        F.col("before").isNull() | (ts_us - F.unix_micros("before") > width)
    )
    unknown = segments.filter(F.col("seq").isNull())
    return first.select("ts", *copy).unionByName(unknown.select("ts", *copy))


def flow_key(*parts: Column) -> Column:
    """``src:port-dst:port`` from source address, port, destination address, port."""
    source_ip, source_port, destination_ip, destination_port = parts
    return F.concat(
        F.concat_ws(":", source_ip, source_port),
        F.lit("-"),
        F.concat_ws(":", destination_ip, destination_port),
    )
