"""Topic and file streams as sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import PACKET


def topic_options(
    servers: str,
    topic: str,
    max_per_trigger: int,
    offset: str = "latest",
    partitions: Sequence[int] | None = None,
    fail_on_data_loss: bool = True,
) -> dict[str, str]:
    """Options of a topic subscription, or of an assignment when partitions are given.

    ``max_per_trigger`` bounds a micro-batch, and with it what one worker holds of a device. Offsets that are gone stop
    the stream unless the caller says that loss is fine.
    """
    options = {
        "kafka.bootstrap.servers": servers, "startingOffsets": offset, "failOnDataLoss": str(fail_on_data_loss).lower(),
        "maxOffsetsPerTrigger": str(max_per_trigger),
    }
    if partitions:
        numbers = ",".join(str(p) for p in partitions)
        options["assign"] = f'{{"{topic}":[{numbers}]}}'
    else:
        options["subscribe"] = topic
    return options


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    max_per_trigger: int,
    offset: str = "latest",
    partitions: Sequence[int] | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """Stream of (key, value, timestamp). Needs the Kafka connector on the class path."""
    options = topic_options(servers, topic, max_per_trigger, offset, partitions, fail_on_data_loss)
    return spark.readStream.format("kafka").options(**options).load().select("key", "value", "timestamp")


def read_packet_files(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """The same stream from JSON files of packets, for replays and tests."""
    return spark.readStream.schema(PACKET).option("maxFilesPerTrigger", max_files).json(path)
