"""Canonical JSON, content commitments, and hash chains."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.storage import staged


def canonical_json(value, ascii_only: bool = False) -> str:
    """Sorted keys, no spaces, finite numbers only. The two dialects give different bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def write_json(path: str | Path, value, replace: bool = False) -> None:
    """Whole file or nothing; refuses to replace unless told to."""
    path = Path(path)
    fd, temp = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "w") as f:
            f.write(canonical_json(value) + "\n")
            f.flush()
            os.fsync(f.fileno())
        if replace:
            os.replace(temp, path)
        else:
            os.link(temp, path)
    finally:
        Path(temp).unlink(missing_ok=True)


def commitments(rows: DataFrame, by: list[str], key: str, line: str) -> DataFrame:
    """SHA-256 over the lines of each group in key order.

    Two levels, so that a large group is read by many tasks: lines are hashed by key bucket (leading hex digits of the
    key's hash), and the 256 buckets' hashes by group. Lines stream past in order; no bucket is held.
    """
    bucketed = rows.withColumn("bucket", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2))
    inner = streamed_digests(bucketed, [*by, "bucket"], [key, line], F.col(line))
    return inner.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "sha256"))), lambda x: x["sha256"]), ""), 256).alias("commitment"), F.sum("n").alias("n"))


def streamed_digests(rows: DataFrame, by: list[str], order: list[str], piece: Column, before: str = "", between: str = "", after: str = "") -> DataFrame:
    """``(by, sha256, n)``: SHA-256 of each group's pieces in order, with texts before, between and after them.

    A digest of one long text has to be taken in its order, so a group is read by one task; but it is sorted by Spark, which
    spills, and streams past: the task holds a batch and the state of the digest. Null pieces are left out, though they
    count in ``n``; order columns must tell rows apart where their pieces differ.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    src = rows.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], piece.alias("_piece"), group.alias("_group"))
    out = T.StructType([*[f for f in src.schema.fields if f.name in by], T.StructField("sha256", T.StringType()), T.StructField("n", T.LongType())])
    src = src.repartition("_group") if by else src.coalesce(1)
    src = src.sortWithinPartitions("_group", *[f"_o{i}" for i in range(len(order))]).select(*by, "_piece", "_group")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, first, state, n, some = None, None, None, 0, False

        def result() -> pa.RecordBatch:
            state.update(after.encode())
            return pa.RecordBatch.from_arrays([*first, pa.array([state.hexdigest()]), pa.array([n])], [*by, "sha256", "n"])

        for b in batches:
            columns = [b.column(c) for c in by]
            for i, (g, p) in enumerate(zip(b.column("_group").to_pylist(), b.column("_piece").to_pylist(), strict=True)):
                if g != held or state is None:
                    if state is not None:
                        yield result()
                    held, first, state, n, some = g, [c.slice(i, 1) for c in columns], hashlib.sha256(before.encode()), 0, False
                n += 1
                if p is not None:
                    state.update(((between if some else "") + p).encode())
                    some = True
        if state is not None:
            yield result()

    return src.mapInArrow(run, out)


def chain_breaks(entries: DataFrame, by: list[str], sequence: str, payload: str) -> DataFrame:
    """Entries of each chain with the hash that they must carry on from: sha256(previous payload) and a flag of gaps.

    Entries are dealt to ranges of (chain, sequence), so a chain of any length lies in several; the first of a range
    carries on from the last of the range before.
    """
    dealt = entries.withColumn("entry_sha256", F.sha2(F.col(payload), 256)).repartitionByRange(*by, sequence).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "chains")
    own = F.struct(F.struct(*by).alias("chain"), F.col(sequence).alias("at"), F.col("entry_sha256").alias("sha256"))
    last = dealt.groupBy("_range").agg(F.max_by(own, F.struct(*by, sequence)).alias("_last"))
    last = last.select("_range", F.lag("_last").over(W.orderBy("_range")).alias("_last"))  # one row for each range
    before = F.coalesce(F.lag(own).over(W.partitionBy("_range").orderBy(*by, sequence)), F.col("_last"))
    out = dealt.join(last, "_range").withColumn("_before", before)
    same = F.col("_before.chain").eqNullSafe(F.struct(*by))
    out = out.withColumn("previous_sha256", F.when(same, F.col("_before.sha256"))).withColumn("gap", F.when(same, F.col(sequence) - F.col("_before.at")))
    return out.drop("_range", "_last", "_before")


class Chain:
    """An append-only JSONL file in which each entry commits to the one before."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def read(self) -> list[dict]:
        out, before = [], None
        for i, text in enumerate(self.path.read_text().splitlines() if self.path.exists() else []):
            entry = json.loads(text)
            body = {k: v for k, v in entry.items() if k != "entry_sha256"}
            if entry["sequence"] != i or entry["previous_entry_sha256"] != before or entry["entry_sha256"] != sha256_text(canonical_json(body)):
                raise ValueError(f"entry {i} breaks the chain")
            out.append(entry)
            before = entry["entry_sha256"]
        return out

    def append(self, payload: dict) -> dict:
        entries = self.read()
        body = {"sequence": len(entries), "previous_entry_sha256": entries[-1]["entry_sha256"] if entries else None, "payload": payload}
        entry = body | {"entry_sha256": sha256_text(canonical_json(body))}
        with self.path.open("a") as f:
            f.write(canonical_json(entry) + "\n")
            f.flush()
            os.fsync(f.fileno())
        return entry


def put_or_conflict(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): the same key with the same payload is no news, with another one it is a conflict."""
    both = incoming.select(F.col(key), F.col(payload)).distinct().join(existing.select(F.col(key).alias("_k"), F.col(payload).alias("_p")), F.col(key) == F.col("_k"), "left")
    return both.where("_k is null").select(key, payload), both.where(F.col("_k").isNotNull() & ~F.col(payload).eqNullSafe(F.col("_p"))).select(key, payload)


def verify_steps(lines: Iterable[str]) -> str:
    """Commitment of lines in order."""
    h = hashlib.sha256()
    for x in lines:
        h.update(x.encode())
    return h.hexdigest()
