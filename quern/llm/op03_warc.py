"""WARC archives: written as one gzip member per record, read back in parallel byte ranges.

Reading.  A task gets a byte range of a file.  Every gzip magic in the range is a
*candidate* record; a candidate that inflates to a WARC header yields its
successor, the offset where its member ends.  Payloads may hold such magic, even
whole archives stored without compression, so a candidate proves nothing by
itself.  Within a range the task links candidates into chains; between ranges
the chains form a graph of a few nodes per range, on which pointer jumping from
offset 0 of each file marks what is reachable in a logarithmic number of rounds.
Only candidates that the chain from the file's start runs through are records.

Writing.  Records are compressed before the one shuffle, which brings each
payload's digest to the row that stands for its copies; a join that adaptive
execution can split does that, so a payload that a third of all pages share is no
hot task.  Files are written under fresh names; only files that a finished task
reports belong to the archive, so a lost executor leaves no half-written member.

Null html is an empty payload, a null url an empty target; a null page_id sorts
below all others and is kept as null.  Rows that repeat the largest page_id of
their payload are all responses.  Empty tables give an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, shared_path, stored

#: Payloads below this many bytes are always stored.
REVISIT_MIN = 1000
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: str | None) -> str:
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", value or "")


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, n: int, payload: bytes = b"", refers_to: int | None = None) -> bytes:
    """One WARC record; the HTTP head of a revisit keeps the full payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Target-URI: {_clean(url)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(head) + len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + head + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> dict | None:
    """The fields of one inflated record, or None if it isn't one."""
    cut = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or cut < 0:
        return None
    fields = dict(x.split(": ", 1) for x in data[:cut].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = data[cut + 4 : cut + 4 + int(fields.get("Content-Length", "0"))]
    at = block.find(b"\r\n\r\n") + 4
    length = re.search(rb"Content-Length: (\d+)", block[:at])
    payload = block[at:]
    number = lambda x: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", x or "")) else None
    digest = fields.get("WARC-Payload-Digest", "")
    stated = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else ""
    kind = fields.get("WARC-Type", "")
    stored_sha = hashlib.sha1(payload).hexdigest() if kind == "response" else stated
    return {
        "record_type": kind,
        "page_id": number(fields.get("WARC-Record-ID")),
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else 0,
        "payload_digest": stored_sha,
        "digest_ok": stored_sha == stated,
        "url": fields.get("WARC-Target-URI", ""),
    }


def write_archives(pages: DataFrame, root: str, least: int = REVISIT_MIN) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` under ``root``; returns (file, bytes, records)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keep = (
        pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n"))
        .where(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "keeper")
    )

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, members = [], [], []
        for i, u, h in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            payload = h.encode()
            d = hashlib.sha1(payload).hexdigest()
            digests.append(d)
            sizes.append(len(payload))
            members.append(member(record("response", i, u, d, len(payload), payload)))
        return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "digest": digests, "n": pa.array(sizes, pa.int64()), "member": pa.array(members, pa.binary())})

    packed = map_batches(pages, pack, "page_id long, url string, digest string, n long, member binary")
    marked = packed.join(keep, "digest", "left").withColumn("again", F.expr(f"keeper is not null and n >= {least} and not (page_id <=> keeper)"))
    marked = marked.withColumn("member", F.expr("case when not again then member end"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, n = None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store, path = pafs.FileSystem.from_uri(root)
                    store.create_dir(path, recursive=True)
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                data = member(record("revisit", r["page_id"], r["url"], r["digest"], r["n"], refers_to=r["keeper"])) if r["again"] else r["member"]
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name.rpartition("/")[2]], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return stored(marked.mapInArrow(write, "file string, bytes long, records long"), "warc-files")


class _Ahead:
    """Bytes of a file from an offset on, read in blocks as they are asked for."""

    def __init__(self, source: pa.NativeFile, at: int, size: int, block: int = 1 << 20):
        self.source, self.at, self.size, self.block, self.data = source, at, size, block, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.at + len(self.data)
        if end > have:
            n = min(max(end - have, self.block), self.size - have)
            self.source.seek(have)
            self.data += self.source.read(n)


def candidates_in(ahead: _Ahead, start: int, end: int) -> list[dict]:
    """Candidate records that begin in [start, end), with successor, chain and the chain's exit."""
    ahead.upto(end + 64)
    found: dict[int, dict] = {}
    at = ahead.data.find(MAGIC, start - ahead.at)
    while 0 <= at < end - ahead.at:
        z, pos, parts, broken = zlib.decompressobj(31), at, [], False
        try:
            parts.append(z.decompress(ahead.data[pos : pos + 4096], 64))
            if parts[0].startswith(b"WARC/1."):
                rest = z.unconsumed_tail
                pos = min(pos + 4096, len(ahead.data))
                parts.append(z.decompress(rest))
                while not z.eof:
                    if pos == len(ahead.data):
                        ahead.upto(ahead.at + pos + 1)
                        if pos == len(ahead.data):
                            broken = True
                            break
                    step = ahead.data[pos : pos + (1 << 16)]
                    parts.append(z.decompress(step))
                    pos += len(step)
                if not broken and (fields := parse(b"".join(parts))):
                    found[ahead.at + at] = fields | {"next": ahead.at + pos - len(z.unused_data)}
        except (zlib.error, ValueError):
            pass
        at = ahead.data.find(MAGIC, at + 1)
    of: dict[int, int] = {}
    exits: dict[int, int] = {}
    for offset in sorted(found):
        if offset in of:
            continue
        x = offset
        while x in found and x not in of:
            of[x] = offset
            x = found[x]["next"]
        exits[offset] = x
    return [v | {"offset": k, "chain": of[k], "exit": exits[of[k]]} for k, v in sorted(found.items())]


CANDIDATE = "file string, offset long, next long, chain long, exit long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, url string"


def candidates(files: DataFrame, root: str, split: int) -> DataFrame:
    """All candidate records of ``files(file, bytes)``, read in byte ranges of ``split``."""
    ranges = files.select("file", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split}L)")).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = ranges.repartition(int(min(n, 20_000)))
    names = ["file", *(x.split()[0] for x in CANDIDATE.split(", ")[1:])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{path}/{r['file']}") as source:
                    rows = candidates_in(_Ahead(source, r["start"], r["bytes"]), r["start"], min(r["start"] + split, r["bytes"]))
                if rows:
                    kinds = {"file": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "url": pa.string(), "digest_ok": pa.bool_()}
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(rows) if k == "file" else [x[k] for x in rows], kinds.get(k, pa.int64())) for k in names], names=names)

    return stored(ranges.mapInArrow(read, CANDIDATE), "warc-candidates")


def read_archives(files: DataFrame, root: str, split: int = 8 << 20) -> DataFrame:
    """The records of the archives: those candidates that the chain from offset 0 reaches."""
    found = candidates(files, root, split)
    chains = found.select("file", "chain", "exit").distinct()
    entries = chains.select("file", F.col("exit").alias("at")).union(files.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    # A node is an offset where a chain may be entered; it leads to that chain's exit.
    jump = stored(entries.join(found.select("file", F.col("offset").alias("at"), "chain", "exit"), ["file", "at"]), "warc-nodes")
    chain_of = jump.select("file", "at", "chain")
    jump = jump.select("file", "at", F.col("exit").alias("to"))
    reach = files.select("file", F.lit(0).cast("long").alias("at"))
    n = -1
    while True:
        more = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = stored(reach.union(more).distinct(), "warc-reached")
        now = reach.count()
        if now == n or now == 0:
            break
        n = now
        then = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = stored(jump.join(then, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "warc-jumps")
    from_ = reach.join(chain_of, ["file", "at"]).groupBy("file", "chain").agg(F.min("at").alias("entry"))
    return found.join(from_, ["file", "chain"]).where("offset >= entry").drop("chain", "exit", "entry")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "warc")
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_archives(files, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


WARC_SQL = f"""
with p as (
  select page_id, encode(coalesce(html, '')) as b, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages
), k as (select d, max(page_id) as keeper from p where n >= {REVISIT_MIN} group by d)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when keeper is not null and keeper <> page_id then 'revisit' else 'response' end as record_type,
  case when keeper is not null and keeper <> page_id then keeper end as refers_to, true as digest_ok
from p left join k using (d)
"""
