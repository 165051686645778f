"""Rollups kept up by differences: what a batch changes is added to stored partials, and no stored row is read for it.

The state store keeps the present image of every source row by its key. A new or corrected row goes on as signed changes, the old image
out and the new one in; a row that comes again as it is changes nothing. The changes of a batch are added up by group and
written under the batch's id. A reader adds up the batches that are whole.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import rollup
from tidemark.operators.common import DIMS
from tidemark.sources import files
from tidemark.streaming.streams import BatchFn

SLOTS = 256  # groups that the keys are dealt to; a group's state has an entry for each page of its images
PAGE = 256  # images that a page holds about; at twice as many the pages of the group double in number
SIGN = "sign"
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # of times in images
BY = ("log_date", *DIMS, "page_name")
MEASURES = (*rollup.SUMMED, *rollup.AVERAGED)
IMAGE = (*BY, "device_id", *MEASURES)


class _Images(StatefulProcessor):
    """Keeps a group's images by key and tells how each row changes them.

    A call to the state costs far more than a row, so images stand in pages by hash of their key: a batch reads and writes a page once for
    all of its rows. Pages double in number as they fill, each split by one more bit, so a lone row costs a page of bounded size.
    """

    def __init__(self, keys: int, columns: Sequence[str], keep_ms: int | None):
        self.keys, self.columns, self.keep_ms = keys, list(columns), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A page that was not written for so long holds no image that was changed since.
        self.pages = handle.getMapState("pages", "page int", "images binary", self.keep_ms)
        self.bits = handle.getValueState("bits", "bits int")

    def _read(self, page: int, since: float) -> dict[tuple, tuple]:
        """Images of a page by key, each with its key's hash, the time of its last change, and its version."""
        kept = self.pages.getValue((page,))
        images = pickle.loads(zlib.decompress(kept[0])) if kept is not None else {}
        return {at: image for at, image in images.items() if image[1] > since} if self.keep_ms else images

    def _write(self, page: int, images: dict[tuple, tuple]) -> None:
        self.pages.updateValue((page,), (zlib.compress(pickle.dumps(images, pickle.HIGHEST_PROTOCOL), 1),))

    def _double(self, bits: int, since: float) -> int:
        for page in range(1 << bits):
            images = self._read(page, since)
            for half in (page, page + (1 << bits)):
                part = {at: image for at, image in images.items() if _page(image[0], bits + 1) == half}
                if part or images:
                    self._write(half, part)
        self.bits.update((bits + 1,))
        return bits + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        k, end = self.keys, self.keys + len(self.columns)
        newest: dict[tuple, Row] = {}
        for row in rows:
            at = tuple(["NaN" if x != x else x for x in row[:k]])
            if at not in newest or row[end:end + 2] >= newest[at][end:end + 2]:  # version and rank
                newest[at] = row
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        since = now - self.keep_ms if self.keep_ms else -1
        kept = self.bits.get()
        bits = kept[0] if kept is not None else 0
        while len(newest) > 2 * PAGE << bits:
            bits = self._double(bits, since)
        by_page: dict[int, list[tuple]] = {}
        for at, row in newest.items():
            by_page.setdefault(_page(row[end + 2], bits), []).append(at)
        made, held = Row(SIGN, *self.columns), 0
        for page, found in by_page.items():
            images, changed = self._read(page, since), False
            for at in found:
                row = newest[at]
                image, version, old = row[k:end], row[end], images.get(at)
                if old is not None:
                    if old[2] > version or (old[2] == version and old[3] == image):
                        continue
                    if old[3] != image:
                        yield made(-1, *old[3])
                if old is None or old[3] != image:
                    yield made(1, *image)
                images[at], changed = (row[end + 2], now, version, image), True
            if changed:
                self._write(page, images)
            held += len(images)
        while held > 2 * PAGE * len(by_page):
            bits, held = self._double(bits, since), held / 2

    def close(self) -> None:
        pass


def _page(hashed: int, bits: int) -> int:
    """Page of a key among 2 to the ``bits``, by bits that do not tell its group."""
    return (hashed >> 24) & ((1 << bits) - 1)


def signed_changes(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str] = IMAGE, version: str | None = None, keep_ms: int | None = None, slots: int = SLOTS
) -> DataFrame:
    """Changes (sign, columns) of a stream of rows that may come again, late, or corrected.

    A row replaces the image of its key if its ``version`` (a number; NULL counts as 0) is not less; without one, what comes later
    replaces. Of several in one batch the newest counts, then the greatest by content. NULL keys are keys like any other.
    Images stay for ``keep_ms`` after their last change, or for good; a row that is corrected later than that counts as new.
    The stream's session has to keep state by entry, see ``streams.stateful_session``.
    """
    shape, hashed = rows.select(*columns).schema, F.xxhash64(*keys)
    # An image goes to Python and back as one text: each column of a row costs there as much as the work on it.
    given = rows.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.to_json(F.struct(*columns), EXACT).alias("_image"),
        F.coalesce(F.col(version) if version else F.lit(0), F.lit(0)).cast("long").alias("_version"), F.xxhash64(*columns).alias("_rank"),
        hashed.alias("_hash"), F.pmod(hashed, F.lit(slots)).cast("int").alias("_slot"),
    )
    processor = _Images(len(keys), ["_image"], keep_ms)
    changes = given.groupBy("_slot").transformWithState(processor, f"{SIGN} int, _image string", "Append", "ProcessingTime" if keep_ms else "None")
    return changes.select(SIGN, F.from_json("_image", shape, EXACT).alias("_image")).select(SIGN, "_image.*")


def _ranged(rows: DataFrame, first: Sequence[str]) -> DataFrame:
    """Even ranges of the folders' rows, so that a task writes into a folder or two.

    Streams with state run without adaptive execution, which would rebalance the rows; as they come, every task writes into every folder.
    """
    return rows.repartitionByRange(*first, F.xxhash64(*[c for c in rows.columns if c not in first]))


def difference_sink(path: str, by: Sequence[str] = BY) -> BatchFn:
    """Write a batch's changes by group, and by group and device, and last that the batch is whole.

    Groups that a batch does not change get no row. A replayed batch replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            parts = rollup.signed_rollup(batch, by, SIGN)
            devices = rollup.signed_devices(batch, by, SIGN)
            first = [by[0]]
            files.write_batch(_ranged(parts, first), f"{path}/parts", batch_id, first)
            files.write_batch(_ranged(devices, first), f"{path}/devices", batch_id, first)
            _mark(batch.sparkSession, path, "commits", batch_id)
        finally:
            batch.unpersist()

    return write


_MARK = T.StructType([T.StructField("upto", T.LongType())])


def _mark(spark: SparkSession, path: str, kind: str, upto: int) -> None:
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{kind}/of={upto}")


def _newest(spark: SparkSession, path: str, kind: str) -> int:
    if not files.exists(spark, f"{path}/{kind}"):
        return -1
    return spark.read.schema(_MARK).parquet(f"{path}/{kind}").agg(F.max("upto")).first()[0]


def _stored(spark: SparkSession, path: str, table: str, upto: int, base: int) -> list[DataFrame]:
    """The settled base and the whole batches after it, as far as there are any."""
    found = []
    if base >= 0:
        found.append(spark.read.parquet(f"{path}/base/of={base}/{table}"))
    if upto > base and files.exists(spark, f"{path}/{table}"):
        later = spark.read.parquet(f"{path}/{table}").filter(F.col("batch_id").between(base + 1, upto))
        found.append(later.drop("batch_id"))
    return found


def read_differences(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """The rollup by ``by`` as of the last whole batch: sums, averages and distinct devices, all of one moment."""
    upto, base = _newest(spark, path, "commits"), _newest(spark, path, "bases")
    parts, devices = (_stored(spark, path, t, upto, base) for t in ("parts", "devices"))
    if not parts:
        raise ValueError(f"no whole batch in {path}")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    present = union(devices).groupBy(*by, "device_id").agg(F.sum("n").alias("n")).filter("n > 0")
    return rollup.merge_rollup(union(parts), by, present.drop("n")).filter("cnt > 0")


def settle_differences(spark: SparkSession, path: str, by: Sequence[str] = BY) -> None:
    """Add up all whole batches into one base, so that readers need not list every batch.

    The base gets a folder of its own and counts once it is marked; a run that fails before leaves all as it was. What the base before
    last covered is removed, so readers that began with the last one can end.
    """
    upto, base = _newest(spark, path, "commits"), _newest(spark, path, "bases")
    if upto <= base:
        return
    sums = {"parts": [*by], "devices": [*by, "device_id"]}
    for table, keys in sums.items():
        frames = _stored(spark, path, table, upto, base)
        rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        measures = [c for c in rows.columns if c not in keys]
        settled = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures]).filter("cnt <> 0" if table == "parts" else "n <> 0")
        files.write_partitioned(settled, f"{path}/base/of={upto}/{table}", [by[0]], "overwrite")
    _mark(spark, path, "bases", upto)
    for table in sums:
        files.remove_batches(spark, f"{path}/{table}", base)
    files.remove_below(spark, f"{path}/base", "of", base)
