"""Operator 9: WARC archives with a two-level capture index.

Writing: every task writes its pages as gzip members of one WARC file in the shared folder, under a name
of its own attempt, so that a task that is run again leaves the rows of only one file behind. Pages whose
payload another page repeats become revisit records that name the record which holds it.

Index: one line per record, keyed by the reversed host and the path, range-partitioned and sorted by key;
lines go into compressed blocks of ``lines`` lines, and each block's first key and place into the sparse
directory of its partition. Reading: look-ups, range-partitioned alike, find their partition's directory
by its first key, the block by binary search in the directory, the line by binary search in the block,
and then read only the record's bytes. The driver holds one row per partition, a fixed number.

Scale: payloads are moved once (to learn whether they are repeated); counts by digest are aggregated
first, and rows of a hot digest learn of it by broadcast. Blocks, directories and records
are read by range.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import os
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.operators.hot import meet
from kindred.storage import new_folder, staged

LINES = 512
DATE = "2024-01-01T00:00:00Z"


def _open_fs(folder: str):
    """(file system, path) of a folder that driver and executors share; any store that pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def surt(url: str | None) -> str:
    """Sort key of a URL: host reversed at its dots, then port and path; scheme, "www." and case of the host don't matter."""
    if not url:
        return ")/"
    rest = url.split("://", 1)[-1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:].split("#", 1)[0] or "/"
    host, _, port = host.partition(":")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (path if path.startswith("/") else "/" + path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, url: str | None, payload: bytes, sha: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit holds no payload, but its length and digest."""
    head = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()]
    block = head[0] + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:kindred:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:kindred:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x), payload


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write one record per row to WARC files in ``folder``; one index row per record: surt, key, file, at, size.

    Of records with equal payloads of at least ``least`` bytes, the one with the largest key is the
    response, and the others are revisits that refer to it. A null html is an empty payload, a null url an
    empty one; a null key is written as "null" and never chosen. Rows that repeat the key of the response
    are responses as well.
    """
    src = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("h"))
    src = src.withColumn("sha", F.sha1("h"))
    best = src.groupBy("sha").agg(F.max(F.when(F.octet_length("h") >= least, F.col("k"))).alias("best"), F.count("*").alias("n"))
    kind = pages.schema[key].dataType.simpleString()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for pdf in batches:
            rows = []
            for k, u, h, sha, best in zip(pdf["k"], pdf["u"], pdf["h"], pdf["sha"], pdf["best"], strict=True):
                own = best is None or k == best
                b32 = base64.b32encode(bytes.fromhex(sha)).decode()
                member = record("response" if own else "revisit", "null" if k is None else k, u, h, b32, None if own else best)
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                rows.append((surt(u), k, name, at, len(member)))
                at += len(member)
            if rows:
                yield pd.DataFrame(rows, columns=["surt", "k", "file", "at", "size"])
        if out is not None:
            out.close()

    # payloads of hot digests stay where they are; keys go to Python as strings, which a null beside them doesn't change
    rows = meet(src, best, "sha", "n").select(F.col("k").cast("string").alias("k"), "u", "h", "sha", F.col("best").cast("string").alias("best"))
    rows = rows.mapInPandas(write, "surt string, k string, file string, at long, size long")
    return staged(rows.withColumn("k", F.col("k").cast(kind)), "captures")


def _line_key(key: str, name) -> str:
    return f"{key} {'' if name is None else name}"


def build_index(captures: DataFrame, folder: str, parts: int, lines: int = LINES) -> tuple[list[str], list[str]]:
    """Write the sorted index; (first keys, names) of its partitions, in order: at most ``parts`` rows on the driver.

    Captures with a null key stand under their surt alone; repeated lines all stay. No captures give two empty lists.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, out, at, held, directory = uuid.uuid4().hex, None, 0, [], []

        def flush() -> None:
            nonlocal out, at, held
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}.idx", compression=None)
            block = gzip.compress("\n".join(json.dumps(x) for x in held).encode(), 3, mtime=0)
            out.write(block)
            directory.append((held[0][0], at, len(block)))
            at, held = at + len(block), []

        for pdf in batches:
            for key, surt_, k, file, start, size in zip(pdf["line"], pdf["surt"], pdf["k"], pdf["file"], pdf["at"], pdf["size"], strict=True):
                held.append((key, surt_, k, file, int(start), int(size)))
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as d:
                d.write(json.dumps(directory).encode())
            yield pd.DataFrame({"first": [directory[0][0]], "name": [name]})

    ordered = captures.withColumn("line", F.concat_ws(" ", "surt", F.coalesce(F.col("k").cast("string"), F.lit(""))))
    ordered = ordered.repartitionByRange(parts, "line", "file", "at").sortWithinPartitions("line")
    top = staged(ordered.select("line", "surt", F.col("k").cast("string").alias("k"), "file", "at", "size").mapInPandas(write, "first string, name string"), "directory")
    rows = sorted((r["first"].encode(), r["name"]) for r in top.collect())
    return [r[0] for r in rows], [r[1] for r in rows]


class Reader:
    """Range reads of captures by (surt, key); keeps some directories, blocks and open files."""

    def __init__(self, folder: str, firsts: list[bytes], names: list[str], most: int = 8):
        self.fs, self.base = _open_fs(folder)
        self.firsts, self.names, self.most = firsts, names, most
        self.kept: dict[str, OrderedDict] = {"dir": OrderedDict(), "block": OrderedDict(), "file": OrderedDict()}

    def _keep(self, kind: str, name, make):
        held = self.kept[kind]
        if name in held:
            held.move_to_end(name)
        else:
            held[name] = make()
            if len(held) > self.most * (4 if kind == "file" else 1):
                gone = held.popitem(last=False)[1]
                if kind == "file":
                    gone.close()
        return held[name]

    def _read(self, name: str, at: int, size: int) -> bytes:
        f = self._keep("file", name, lambda: self.fs.open_input_file(f"{self.base}/{name}"))
        return f.read_at(size, at)

    def _directory(self, p: int) -> list:
        def load():
            with self.fs.open_input_file(f"{self.base}/{self.names[p]}.dir") as f:
                return [(k.encode(), at, size) for k, at, size in json.loads(f.read())]

        return self._keep("dir", p, load)

    def lines(self, key: str) -> Iterator[tuple]:
        """Index lines with exactly this key, across blocks and partitions."""
        want = key.encode()
        p = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while p < len(self.names) and (self.firsts[p] <= want):
            directory = self._directory(p)
            b = max(0, bisect.bisect_left(directory, (want,)) - 1)
            while b < len(directory) and directory[b][0] <= want:
                _, at, size = directory[b]
                block = self._keep("block", (p, b), lambda at=at, size=size, p=p: [json.loads(x) for x in gzip.decompress(self._read(f"{self.names[p]}.idx", at, size)).split(b"\n")])
                keys = self._keep("dir", ("keys", p, b), lambda block=block: [x[0].encode() for x in block])
                i = bisect.bisect_left(keys, want)
                while i < len(keys) and keys[i] == want:
                    yield block[i]
                    i += 1
                b += 1
            p += 1

    def record(self, line: tuple) -> tuple[dict[str, str], dict[str, str], bytes]:
        return parsed(self._read(line[3], line[4], line[5]))


def read_archives(pages: DataFrame, folder: str, firsts: list[bytes], names: list[str], parts: int, key: str = "page_id", url: str = "url") -> DataFrame:
    """Look up every row's capture by url and key: key, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``payload`` (null in revisits).

    Null urls and keys are looked up as such; rows that share both take their captures in turn. Further columns
    are ignored; an empty table gives no rows. A damaged response raises, and so does a row without a capture.
    """
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, before, turn = Reader(folder, firsts, names), None, 0
        for pdf in batches:
            rows = []
            for k, u, line_key in zip(pdf["k"], pdf["u"], pdf["line"], strict=True):
                # rows that share url and key take their captures in turn
                turn = turn + 1 if line_key == before else 0
                before = line_key
                found = list(reader.lines(line_key))
                if not found:
                    raise KeyError(f"no capture of {line_key!r} in the index")
                fields, http, payload = reader.record(found[turn % len(found)])
                response = fields["WARC-Type"] == "response"
                sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if response and digest(payload) != sha:
                    raise ValueError(f"damaged record {line_key}")
                refers = None if response else fields["WARC-Refers-To"].removeprefix("<urn:kindred:page:").removesuffix(">")
                rows.append((k, int(http["Content-Length"]), sha, fields["WARC-Type"], refers, payload if response else None))
            yield pd.DataFrame(rows, columns=["k", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    to_surt = F.pandas_udf(lambda s: s.map(surt), "string")
    asked = pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u")).withColumn("line", F.concat_ws(" ", to_surt(F.coalesce("u", F.lit(""))), F.coalesce("k", F.lit(""))))
    asked = asked.repartitionByRange(parts, "line").sortWithinPartitions("line")
    out = asked.mapInPandas(read, "k string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out.select(F.col("k").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "payload")


def archive_round_trip(pages: DataFrame, folder: str | None = None, parts: int | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, index them, and read every one back through the index; nulls, repeats and empty tables as in its three steps."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts, names = build_index(write_archives(pages, folder, key, url, html), folder, parts)
    return read_archives(pages, folder, firsts, names, parts, key, url)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("payload")


