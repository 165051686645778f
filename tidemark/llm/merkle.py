"""Merkle manifest of a dataset by time-forward processing: child digests go forward to parents, then proof suffixes back to leaves.

A node's label is its group, level and number. Work goes by blocks of 8^4 nodes of one level. Spark's sorted shuffle is the external
queue: it brings the nodes of a block in the order of their labels and spills where it must. A sweep over the block takes digests from a
heap ordered by the label they go to, and sends each parent's digest on. The tops of the blocks are the nodes of the next stage, until
one node is left in each group. The sweeps then run again from the top stage down, reversed: each block gets the proof suffix of its
top in front of its nodes and hands it down.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import cut, lower_ascii

ARITY = 8
BLOCK_LEVELS = 4  # levels that one block folds
WIDTH = ARITY**BLOCK_LEVELS  # nodes of a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 10_000  # rows of a record batch that a sweep sends
_NODE = T.StructType([T.StructField("grp", T.LongType()), T.StructField("number", T.LongType()), T.StructField("size", T.LongType()), T.StructField("digest", T.BinaryType())])
_GROUP = T.StructType([T.StructField("grp", T.LongType()), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("steps", T.ArrayType(T.StringType()))])
_STEPS = T.StructType([T.StructField("grp", T.LongType()), T.StructField("number", T.LongType()), T.StructField("steps", T.ArrayType(T.StringType()))])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """SHA-256, lowercase hex, of a row's values one after the other: UTF-8 byte count, ``:`` and value of each, ``-`` for NULL."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def number_rows(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``number``, a row's place from 0 in its group by ``order`` (NULLs first), and ``size``, the rows of the group.

    Rows are dealt by ranges of (group, order), so no task holds a group; equal rows stand in any order and spread over
    tasks like others. Beside them only a count for each task and group moves. Both steps are written to the shared folder.
    """
    marked = cut(df.withColumn("__mark", F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "__mark")]
    dealt = marked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = cut(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__place").alias("__first"),
    )
    in_group = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__rows").over(in_group.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__shift", before - F.col("__first")).withColumn("size", F.sum("__rows").over(in_group))
    met = ordered.join(parts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return met.withColumn("number", F.col("__place") + F.col("__shift")).drop("__mark", "__part", "__place", "__group", "__of", "__rows", "__first", "__shift")


def levels_in_block(size: int) -> int:
    """Levels that each block of a group of ``size`` nodes folds: all of the group's, or as many as a block has."""
    levels = 0
    while levels < BLOCK_LEVELS and size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


class Sweep:
    """One block on its way through: a heap of digests by the label they go to, and the runs that were delivered."""

    def __init__(self, block: int, size: int):
        self.levels = levels_in_block(size)
        self.top = block if self.levels == BLOCK_LEVELS else 0  # number of the block's last node; a group of fewer levels is one block
        self.heap: list[tuple[int, int, str]] = []
        self.runs: dict[tuple[int, int], list[str]] = {}

    def send(self, number: int, found: str) -> None:
        heapq.heappush(self.heap, (0, number, found))

    def forward(self) -> str:
        """Deliver label by label: a run of up to 8 children makes their parent's digest, which is sent on. Returns the top's."""
        heap = self.heap
        while True:
            level, number, found = heapq.heappop(heap)
            if level == self.levels:
                return found
            parent, run = number // ARITY, [found]
            while heap and heap[0][0] == level and heap[0][1] // ARITY == parent:
                run.append(heapq.heappop(heap)[2])
            self.runs[level, parent] = run
            heapq.heappush(heap, (level + 1, parent, digest("".join(run))))

    def backward(self, suffix: list[str]) -> dict[int, list[str]]:
        """The reversed sweep: parents hand their suffix, with the siblings in front, to each child. Returns those of the block's nodes."""
        now = {self.top: suffix}
        for level in range(self.levels - 1, -1, -1):
            below: dict[int, list[str]] = {}
            for parent, rest in now.items():
                run = self.runs[level, parent]
                for k in range(len(run)):
                    below[parent * ARITY + k] = ["".join(run[:k]) + "|" + "".join(run[k + 1:]), *rest]
            now = below
        return now


def proof_text(steps: list[str]) -> str:
    """The siblings of a path from a leaf to the root, left to right and level by level."""
    return "".join(steps).replace("|", "")


def fold(found: str, steps: list[str]) -> str:
    """The root that a leaf's digest and its steps lead to; a step has the siblings on the left, ``|`` and those on the right."""
    for step in steps:
        left, right = step.split("|")
        found = digest(left + found + right)
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """Group, block and rows of each block. Rows come in order of (grp, block), and have those two in front."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
            if row[:2] != now:
                if rows:
                    yield *now, rows
                now, rows = row[:2], []
            rows.append(row)
    if rows:
        yield *now, rows


def _swept(nodes: DataFrame, rows_of: Callable[[int, int, list[tuple]], Iterator[tuple]], out: T.StructType) -> DataFrame:
    """Rows that ``rows_of`` makes of each block; the shuffle brings a block's nodes to one task in order of their numbers."""
    schema = to_arrow_schema(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for block in _blocks(batches):
            held.extend(rows_of(*block))
            if len(held) >= ROWS:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    placed = nodes.select("grp", F.shiftright("number", 3 * BLOCK_LEVELS).alias("block"), *[c for c in nodes.columns if c != "grp"])
    return placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "number").mapInArrow(run, out)


def _tops(group: int, block: int, rows: list[tuple]) -> Iterator[tuple]:
    size = rows[0][3]
    sweep = Sweep(block, size)
    for row in rows:
        sweep.send(row[2], row[4].hex())
    yield group, block, -(-size // WIDTH), bytes.fromhex(sweep.forward())


def _stages(nodes: DataFrame) -> list[DataFrame]:
    """The given nodes (grp, number, size, digest) and those of each further stage; in the last each group has one."""
    out = [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        out.append(cut(_swept(out[-1].select(*_NODE.names), _tops, _NODE)))
        largest = -(-largest // WIDTH)
    return out


def _handed_down(nodes: DataFrame, suffixes: DataFrame, deliver: Callable[[tuple, list[str]], tuple], out: T.StructType) -> DataFrame:
    """``deliver(row, steps)`` of each node, with what the suffixes (grp, number, steps) of the next stage's nodes hand down."""
    steps_at = 2 + len(nodes.columns) - 1
    given = nodes.withColumn("steps", F.lit(None).cast("array<string>"))
    # In front of its nodes, under the least number, a block gets the suffix of its top.
    heads = suffixes.select("grp", (F.col("number") * WIDTH).alias("first"), "steps")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields if f.name not in ("grp", "number")]
    heads = heads.select("grp", F.col("first").alias("number"), *others, "steps").select(*given.columns)

    def rows_of(group: int, block: int, rows: list[tuple]) -> Iterator[tuple]:
        suffix = next(r[steps_at] for r in rows if r[steps_at] is not None)
        below = [r for r in rows if r[steps_at] is None]
        sweep = Sweep(block, below[0][3])
        for row in below:
            sweep.send(row[2], row[4].hex())
        sweep.forward()
        steps = sweep.backward(suffix)
        for row in below:
            yield deliver(row, steps[row[2]])

    return _swept(given.unionByName(heads), rows_of, out)


def _steps_row(row: tuple, steps: list[str]) -> tuple:
    return row[0], row[2], steps


def _group_row(row: tuple, steps: list[str]) -> tuple:
    subroot = row[4].hex()
    return row[2], subroot, fold(subroot, steps), steps


def _suffixes(stages: list[DataFrame], suffixes: DataFrame) -> DataFrame:
    """Suffixes of the nodes of the second stage, from those of the last."""
    for nodes in reversed(stages[1:-1]):
        suffixes = _handed_down(nodes, suffixes, _steps_row, _STEPS)
    return suffixes


@dataclass(frozen=True)
class Manifest:
    """Numbered leaves (grp, number, size, digest, id, claimed), the stages above them, groups (grp, subroot, root) and their suffixes."""

    stages: list[DataFrame]
    groups: DataFrame
    suffixes: DataFrame


def build(leaves: DataFrame) -> Manifest:
    """Manifest of rows (id, group, digest, claimed), all digests binary; ``claimed`` is what ``audit`` checks.

    Leaves of a group ascend by id, those of one id by digest. Groups ascend as UTF-8 bytes. NULL ids and the NULL group come first.
    """
    numbered = number_rows(leaves, "group", ["id", "digest"])
    names = number_rows(numbered.select("group").distinct().withColumn("all", F.lit(0)), "all", ["group"])
    names = cut(names.select(F.col("group").alias("name"), F.col("number").alias("grp"), F.col("size").alias("n_groups")))
    placed = numbered.join(names, F.col("group").eqNullSafe(F.col("name"))).select("grp", "number", "size", "digest", "id", "claimed")
    stages = _stages(cut(placed))
    tops = stages[-1].select("grp", F.col("digest").alias("subroot"))
    above = tops.join(names, "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("number"), F.col("n_groups").alias("size"), F.col("subroot").alias("digest"))
    above = _stages(above)
    none = above[-1].select("grp", "number", F.array().cast("array<string>").alias("steps"))
    if len(above) > 1:
        of_groups = _handed_down(above[0], _suffixes(above, none), _group_row, _GROUP)
    else:  # one group, whose subroot is the root, or none
        as_hex = F.lower(F.hex("digest"))
        of_groups = above[0].select(F.col("number").alias("grp"), as_hex.alias("subroot"), as_hex.alias("root"), F.array().cast("array<string>").alias("steps"))
    groups = cut(of_groups)
    suffixes = _suffixes(stages, groups.select("grp", F.lit(0).cast("long").alias("number"), "steps"))
    return Manifest(stages, groups.drop("steps"), suffixes)


def _delivered(manifest: Manifest, deliver: Callable[[str, str, list[str]], tuple], fields: list[T.StructField]) -> DataFrame:
    leaves = manifest.stages[0]
    out = T.StructType([T.StructField("grp", T.LongType()), T.StructField("id", leaves.schema["id"].dataType), T.StructField("leaf", T.StringType()), *fields])

    def row_of(row: tuple, steps: list[str]) -> tuple:
        leaf = row[4].hex()
        return row[0], row[5], leaf, *deliver(leaf, row[6].hex(), steps)

    if len(manifest.stages) > 1:
        return _handed_down(leaves, manifest.suffixes, row_of, out)
    # Every group is one leaf, and its suffix is the leaf's.
    met = leaves.join(manifest.suffixes.drop("number"), "grp").select("grp", "number", "size", "digest", "id", "claimed", "steps")
    return _swept(met, lambda group, block, rows: (row_of(r[:7], r[7]) for r in rows), out)


def proofs(manifest: Manifest) -> DataFrame:
    """One row (id, leaf, steps) per leaf: the siblings level by level up to the root, each level's left ones, ``|`` and right ones."""
    return _delivered(manifest, lambda leaf, claimed, steps: (steps,), [T.StructField("steps", T.ArrayType(T.StringType()))]).drop("grp")


def audit(manifest: Manifest) -> DataFrame:
    """One row (id, leaf, subroot, root, proof_sha256, folded_root, verified) per leaf, checking its claimed digest against the root.

    A proof is hashed where it is made; no proof moves.
    """
    fields = [T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())]
    rows = _delivered(manifest, lambda leaf, claimed, steps: (digest(proof_text(steps)), fold(claimed, steps)), fields)
    return rows.join(manifest.groups, "grp").select(
        "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def leaves_of(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", claimed: dict[str, Column] | None = None) -> DataFrame:
    """Leaf digests of whole rows, hashed by Spark's own functions, and of what is claimed to be the same rows.

    ``claimed`` names columns whose value is another in the claimed rows. NULLs, empty and very long values are values like others; other
    columns are left out, whatever their names. Repeated rows are leaves of their own. An empty frame gives an empty frame.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    given = leaf_of(list(values.values()))
    other = leaf_of([(claimed or {}).get(c, v) for c, v in values.items()])
    return docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.unhex(given).alias("digest"),
        (F.unhex(other) if claimed else F.unhex(given)).alias("claimed"),
    )


def tampered(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with A-Z lower-cased in rows whose crc32 of the id is divisible by 3, else as it is; a NULL id is left alone."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))
    return F.when(hit, lower_ascii(F.col(text_col))).otherwise(F.col(text_col))


def check_documents(docs: DataFrame) -> DataFrame:
    """Audit of a documents table against its manifest, some of its texts tampered with: one row per document, under its id."""
    return audit(build(leaves_of(docs, claimed={"text": tampered()}))).withColumnRenamed("id", "doc_id")
