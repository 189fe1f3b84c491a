"""WARC archives: a deterministic sharded writer and its reader.

Records are dealt to shards by ranges of their key and sorted in each; a shard rolls over to its next file when the
compressed size passes a limit. Headers and digests are made anew from the payload. Of records with equal payloads one
is the response and the others are revisits that refer to it. Equal input gives equal files, whatever the number of
executors: ranges come from byte counts, each record is a gzip member without a time stamp.

A task writes under a temporary name of its own; the manifest is a staged table, so it lists what successful attempts
wrote; only then do files get their final names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import commit_files, file_system, shared_dir, stage

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Compressed bytes at which a file is closed, and the least and most bytes of payload that a shard gets; between them it
#: grows with the root of the total, so that shards are neither few nor tiny. They depend on the rows alone.
FILE_BYTES, SHARD_BYTES = 64 << 20, (16 << 20, 2 << 30)
#: Ranges of the key in which bytes are counted to find the shards' borders; ranges that are too full are cut again.
CELLS = 4096

#: Fixed values of the format.
VERSION, DATE, PROFILE = "WARC/1.1", "2000-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, key: int | None, again: int, url: str | None, digest: str, size: int, payload: bytes, refers: tuple[int | None, str | None] | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head of its response, without a body.

    `again` counts the records of the same key before it and makes its id another one.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:x-page:{'null' if key is None else key}{f':{again}' if again else ''}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": _plain(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    }
    if refers is not None:
        head |= {"WARC-Refers-To": f"<urn:x-page:{'null' if refers[0] is None else refers[0]}>", "WARC-Refers-To-Target-URI": _plain(refers[1]), "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return _member(head, block)


def _member(head: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v != "")
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(f"{VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + member.flush()


def file_info(name: str) -> bytes:
    """The record at the head of the file `name`, which says what wrote it."""
    block = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:x-file:{name}>", "WARC-Date": DATE, "WARC-Filename": name}
    return _member(head | {"Content-Type": "application/warc-fields", "Content-Length": str(len(block))}, block)


def _plain(url: str | None) -> str:
    """A URL on one line."""
    return "".join(f"%{b:02X}" if b < 0x21 or b == 0x7F else chr(b) for b in (url or "").encode()).encode("latin-1").decode()


def parse(stream, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open gzip-by-record archive."""
    member, data, text = zlib.decompressobj(31), b"", []
    while data or (data := stream.read(step)):
        text.append(member.decompress(data))
        data = member.unused_data
        if member.eof:
            whole = b"".join(text)
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]
            member, text = zlib.decompressobj(31), []


def _key_of(uri: str) -> int | None:
    part = uri.strip("<>").removeprefix("urn:x-page:").partition(":")[0]
    return None if part == "null" else int(part)


def _borders(sizes: DataFrame, shard_bytes: int | None) -> list[int]:
    """Keys at which a new shard begins, from exact byte counts by range: a function of the rows alone.

    Ranges that are too full for a shard are cut again, all of a level in one job, into a number of cells that goes with
    their bytes; so the driver gets a few counts for each shard and level.
    """
    low, high, total = sizes.agg(F.min("key"), F.max("key"), F.sum("payload_bytes")).first()
    if low is None:
        return []
    spark = sizes.sparkSession
    shard_bytes = shard_bytes or min(max(SHARD_BYTES[0], int((int(total) << 20) ** 0.5)), SHARD_BYTES[1])
    shards = max(1, -(-int(total) // shard_bytes))
    cells: list[tuple[int, int]] = []
    level = sizes.where("key is not null").select(F.col("key").cast("decimal(20,0)").alias("key"), "payload_bytes", F.lit(0).cast("long").alias("cell"))
    ranges = [(0, int(low), int(high), CELLS)]  # cell of the level before, first and last key, cells to cut it into
    while ranges:
        steps, base = [], 0
        for cell, first, last, n in ranges:
            width = -(-(last - first + 1) // n)
            steps.append((cell, first, last, width, base))
            base += n
        rows = [(cell, Decimal(first), Decimal(width), at) for cell, first, _, width, at in steps]
        table = spark.createDataFrame(rows, "cell bigint, first decimal(20,0), width decimal(20,0), base bigint")
        level = level.join(F.broadcast(table), "cell").select("key", "payload_bytes", F.expr("base + (key - first) div width").alias("cell"))
        bases, ranges = [s[4] for s in steps], []
        for cell, n in level.groupBy("cell").agg(F.sum("payload_bytes")).collect():
            _, start, end, width, at = steps[bisect_right(bases, cell) - 1]
            first = start + (cell - at) * width
            last = min(end, first + width - 1)
            if n > shard_bytes and last > first:
                ranges.append((cell, first, last, 8 * -(-int(n) // shard_bytes)))
            else:
                cells.append((first, int(n)))
    borders, filled, share = [], 0, total / shards
    for first, n in sorted(cells):
        if filled and filled + n > share * 1.05:
            borders.append(first)
            filled = 0
        filled += n
    return borders


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES, shard_bytes: int | None = None, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of `pages`; returns the manifest (name, records, bytes, folder), which is staged.

    The payload is the text in UTF-8; a null one is empty. Of equal payloads of at least `revisit_bytes` bytes the one
    with the largest `key` is the response, the others are revisits of it; if rows of that key repeat, each of them is
    a response. Null keys come first, are written as 'null', and count as smaller than all others: if all keys of a
    payload are null, all its records are responses. Ids of records are the keys, and of later records of one key the key
    and a number; revisits refer to the first. A null url leaves its header out. Other columns are not read. An empty
    table gives no files. Each file begins with a warcinfo record, which the manifest does not count.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    facts = stage(rows.select("key", "url", "payload_bytes", "digest"), "pages")
    firsts = facts.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest").agg(F.max("key").alias("ref"), F.max_by("url", F.struct("key", "url")).alias("ref_url"), F.count("*").alias("n"))
    firsts = stage(firsts.where("n > 1").select("digest", "ref", "ref_url"), "responses")
    refs = facts.where(F.col("payload_bytes") >= revisit_bytes).join(firsts, "digest").where("not key <=> ref and ref is not null")
    refs = stage(refs.select(F.col("key").alias("k"), F.col("digest").alias("d"), "ref", "ref_url").distinct(), "revisits")

    borders = _borders(facts, shard_bytes)
    shard: Column = F.lit(0)
    if borders:
        shard = F.coalesce(F.expr("aggregate(array(" + ",".join(f"{b}L" for b in borders) + "), 0, (n, b) -> n + int(key >= b))") if len(borders) < 64 else _shard_udf(borders)(F.col("key")), F.lit(0))

    # Marks of revisits travel beside the records and sort just before them, so payloads are shuffled once.
    records = rows.select(shard.cast("int").alias("shard"), "key", "digest", F.lit(1).alias("kind"), "url", "payload_bytes", "payload", F.lit(None).cast("long").alias("ref"))
    marks = refs.select(F.col("k").alias("key"), F.col("d").alias("digest"), F.lit(0).alias("kind"), F.col("ref_url").alias("url"), F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload"), "ref")
    marks = marks.withColumn("shard", shard.cast("int"))
    dealt = records.unionByName(marks).repartitionById(len(borders) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("key"), "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        made: list[tuple] = []
        out, at, n, number, shard_now = None, 0, 0, 0, None
        name, temporary, mark = "", "", (None, None, None, None)
        key_now, again = object(), 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((temporary, name, n, at))
                out = None

        for batch in batches:
            for shard_id, k, digest, kind, u, size, text, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    mark = (k, digest, ref, u)
                    continue
                if out is None or shard_id != shard_now or at >= file_bytes:
                    close()
                    number = number + 1 if shard_id == shard_now else 0
                    shard_now, n, temporary = shard_id, 0, f"_tmp/{uuid.uuid4().hex}.warc.gz"
                    name = f"part-{shard_now:06d}-{number:05d}.warc.gz"
                    system.create_dir(f"{base}/_tmp", recursive=True)
                    out = system.open_output_stream(f"{base}/{temporary}", compression=None)
                    out.write(head := file_info(name))
                    at = len(head)
                key_now, again = k, again + 1 if k == key_now else 0
                marked = mark[:2] == (k, digest)
                data = record("revisit" if marked else "response", k, again, u, digest, size, text.encode(), mark[2:] if marked else None)
                out.write(data)
                at, n = at + len(data), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["temporary", "name", "records", "bytes"])

    manifest = stage(dealt.mapInArrow(run, "temporary string, name string, records bigint, bytes bigint"), "manifest")
    commit_files(manifest, folder)
    return manifest.select("name", "records", "bytes", F.lit(folder).alias("folder"))


def _shard_udf(borders: list[int]):
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(borders, np.int64), keys.fillna(borders[0] - 1).to_numpy(np.int64), "right"), dtype="int32")

    return of


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """What the archives of `manifest` hold: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Digests of responses are computed from what was read and must equal the header's; payload_bytes of a revisit is its
    HTTP head's Content-Length, and its payload is null. Without `payloads` all payloads are null in the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for name, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, base = file_system(folder)
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in parse(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        response = fields["WARC-Type"] == "response"
                        if response and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload differs from its header")
                        refers = _key_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                        rows.append((_key_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], refers, size, digest, body.decode() if response and payloads else None))
                        held += len(body)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    # The number is given, as what the small rows stand for is large.
    spread = manifest.select("name", "folder").repartition(min(10_000, max(1, manifest.count())), F.col("name"))
    return spread.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string")
