"""Exact substring dedup with suffix arrays of shards.

A byte goes when a string of ``least`` bytes that covers it also starts earlier, in
a smaller document or at a smaller place of the same one.

Strings that are equal are brought to the same shard by content: among the 32-byte
pieces of each 100-byte string, the one with the least hash is its *anchor*, so
equal strings have equal anchors.  Strings that follow each other with one anchor
make a *run*.  Runs, not strings, are what moves:

1. An anchor that occurs once proves its strings unique; most end here.
2. Of runs with equal bytes all but the first go, within a task's rows already
   before the shuffle; the rest of an anchor's runs differ, and only those need a
   comparison of bytes.  This is a stream over rows sorted by anchor; it holds the
   runs of one anchor, and of a frequent one no more than a bounded number.
3. Shards of such runs are sorted by their suffixes: suffixes are classified, the
   leftmost-smaller substrings sorted and named, their names sorted recursively, and
   the array is induced from them; permuted common prefixes then tell which neighbours share ``least`` bytes,
   and each such group keeps its earliest string.
4. An anchor with more different runs than a shard should hold is not gathered:
   its strings are compared by 128-bit hash, combined before the shuffle.

Every text is processed whole, in pieces of bounded size that overlap.  Nulls and
empty texts have no bytes.  Rows that repeat id and text are one document and get
the same result; texts that share an id follow each other in the order of their
SHA-1.  A row with a null doc_id takes no part and keeps its text.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, released, stored
from .suffix import permuted_prefixes, suffix_array

LEAST, PIECE = 100, 32
#: Bits of a position among bytes that are looked at together.
PLACE_BITS = 22
#: Bytes of texts that are looked at together; of runs in a shard; different runs of an anchor in one.
TOGETHER, SHARD_BYTES, HOT_RUNS = 1 << 21, 2 << 20, 4000


def piece_hashes(raw: np.ndarray, k: int = PIECE) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on; k is a multiple of 8."""
    n = len(raw) - k + 1
    word = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    h = np.zeros(n, np.uint64)
    for j in range(0, k, 8):
        h ^= word[j : j + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def anchors(raw: np.ndarray, least: int = LEAST, k: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``least`` bytes the position of its anchor, and the pieces' hashes."""
    hashes = piece_hashes(raw, k)
    width = least - k + 1
    n = len(hashes) - width + 1
    # hash first, then place: the least is the leftmost of the least hashes
    bits = np.uint64(PLACE_BITS)
    key = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    # sliding minimum: of the rest of one block and the start of the next
    blocks = -(-len(key) // width)
    whole = np.full(blocks * width, np.uint64(2**64 - 1))
    whole[: len(key)] = key
    whole = whole.reshape(blocks, width)
    ahead = np.minimum.accumulate(whole, axis=1).ravel()
    behind = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    least_key = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least_key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), hashes


def runs_of(texts: list[bytes], least: int = LEAST, k: int = PIECE, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first string, last string, anchor's hash, hash of the bytes) of each run of each
    text, as arrays for about ``together`` bytes at a time."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - least + 1), together):
            part = raw[at : at + together + least - 1]
            if len(part) < least:
                continue
            if size + len(part) > 1 << PLACE_BITS:
                yield _runs(group, least, k)
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
            if size >= together:
                yield _runs(group, least, k)
                group, size = [], 0
    if group:
        yield _runs(group, least, k)


def _runs(group: list[tuple[int, int, bytes]], least: int, k: int) -> tuple[np.ndarray, ...]:
    joined = b"".join(p for _, _, p in group)
    ends = np.cumsum([len(p) for _, _, p in group])
    starts = ends - [len(p) for _, _, p in group]
    anchor, hashes = anchors(np.frombuffer(joined, np.uint8), least, k)
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    new[starts[starts < len(new)]] = True
    valid = np.zeros(len(anchor), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        valid[a : b - least + 1] = True
    new &= valid
    first = np.flatnonzero(new)
    # a run ends before the next begins, or where its text has no more strings
    of = np.searchsorted(ends, first, side="right")
    last = np.minimum(np.r_[first[1:] - 1, len(anchor) - 1], ends[of] - least)
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(joined[a:b]) for a, b in zip(first.tolist(), (last + least).tolist(), strict=True)), np.uint64, len(first)).view(np.int64)
    shift = (np.array([at for _, at, _ in group], np.int64) - starts)[of]
    return np.array([i for i, _, _ in group], np.int64)[of], first + shift, last + shift, hashes[anchor[first]].view(np.int64), content


def shard_spans(pieces: list[tuple[int, int, bytes]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(run's name, from, to) of the bytes that go, of runs (name, first string, bytes) in order."""
    # no mark is needed between runs: strings that would cross are left out below
    text = b"".join(p for _, _, p in pieces)
    sa = suffix_array(np.frombuffer(text, np.uint8))
    same = permuted_prefixes(text, sa, least)
    inside = np.zeros(len(text), bool)
    at = 0
    begins = []
    for _, _, p in pieces:
        inside[at : at + len(p) - least + 1] = True
        begins.append(at)
        at += len(p)
    # groups of strings with equal bytes are stretches of the array
    group = np.cumsum(~same[sa])
    keep = inside[sa]
    place, group = sa[keep], group[keep]
    if not len(place):
        return []
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    earliest = np.minimum.reduceat(place, first)
    gone = place != np.repeat(earliest, np.diff(np.r_[first, len(place)]))
    out = []
    hit = np.sort(place[gone])
    which = np.searchsorted(begins, hit, side="right") - 1
    for i, b in zip(which.tolist(), hit.tolist(), strict=True):
        name, start, _ = pieces[i]
        b = b - begins[i] + start
        if out and out[-1][0] == name and b <= out[-1][2]:
            out[-1] = (name, out[-1][1], b + least)
        else:
            out.append((name, b, b + least))
    return out


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)


RUNS = "part long, known long, anchor long, content long, text_id long, first long, last long"
SPAN, COOL, HOT = 0, 1, 2
FOUND = "kind long, anchor long, text_id long, first long, last long"


def _local_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The runs of texts.  Those that repeat one of a smaller place nearby are known to go: they
    are dealt out by text, so copies don't meet at their anchor."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            ids = some.column(0).to_numpy()
            for of, first, last, anchor, content in runs_of([t.encode() for t in some.column(1).to_pylist()], least):
                text_id = ids[of]
                order = np.lexsort((first, text_id, content, anchor))
                anchor, content, text_id, first, last = (x[order] for x in (anchor, content, text_id, first, last))
                known = np.r_[False, (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])][: len(anchor)]
                part = np.where(known, text_id, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, known.astype(np.int64), anchor, content, text_id, first, last)], names=names)


def sift(batches: Iterator[list[np.ndarray]], hot_runs: int = HOT_RUNS) -> Iterator[np.ndarray]:
    """From rows (known, anchor, content, text_id, first, last), sorted so, to rows (kind, anchor,
    text_id, first, last): spans that go, and first runs of each content where an anchor has more
    than one.  Holds one anchor's first runs, up to ``hot_runs``."""
    held: list[np.ndarray] = []  # first runs of the anchor that may go on
    n_held, flowing, before = 0, False, None

    def close() -> Iterator[np.ndarray]:
        if n_held and (flowing or n_held > 1):
            rows = np.concatenate(held)
            yield np.c_[np.full(len(rows), HOT if flowing or len(rows) > hot_runs else COOL), rows]

    for known, anchor, content, text_id, first, last in batches:
        rows = np.c_[anchor, text_id, first, last]
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        new_content = new_anchor | np.r_[True, content[1:] != content[:-1]]
        if before is not None and len(rows):
            new_anchor[0] = anchor[0] != before[0] or bool(known[0]) != before[2]
            new_content[0] = new_anchor[0] or content[0] != before[1]
        new_anchor |= np.r_[False, known[1:] != known[:-1]]
        new_content |= new_anchor
        gone = (known == 1) | ~new_content
        if gone.any():
            yield np.c_[np.full(int(gone.sum()), SPAN), rows[gone]]
        heads = rows[~gone]
        opens = new_anchor[~gone]
        starts = np.flatnonzero(opens)
        if len(rows):
            if (known == 1).any() or len(starts):
                cut = starts[0] if len(starts) else len(heads)
                held.append(heads[:cut])
                n_held += cut
                yield from close()
                held, n_held, flowing = [], 0, False
                if len(starts):
                    # groups that lie within the batch, all but the last
                    sizes = np.diff(np.r_[starts, len(heads)])
                    inner = np.repeat(sizes, sizes)[: len(heads) - cut - sizes[-1]]
                    whole = heads[cut : len(heads) - sizes[-1]]
                    keep = inner > 1
                    if keep.any():
                        yield np.c_[np.where(inner[keep] > hot_runs, HOT, COOL), whole[keep]]
                    held, n_held = [heads[len(heads) - sizes[-1] :]], int(sizes[-1])
            else:
                held.append(heads)
                n_held += len(heads)
            if n_held > hot_runs:
                rows_h = np.concatenate(held)
                yield np.c_[np.full(len(rows_h), HOT), rows_h]
                held, n_held, flowing = [np.empty((0, 4), np.int64)], 0, True
            before = (anchor[-1], content[-1], bool(known[-1]))
    if n_held:
        yield from close()


def dedup_spans(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(text_id, from_byte, to_byte) of the spans that go, for ``docs(text_id, text)`` whose ids are
    unique and in order; spans may overlap."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("text_id", "text").mapInArrow(lambda batches: _local_runs(batches, least), RUNS).repartition(n, "part").sortWithinPartitions("known", "anchor", "content", "text_id", "first")
    names = [x.split()[0] for x in FOUND.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sift(([b.column(i).to_numpy() for i in range(1, 7)] for b in batches), hot_runs):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T.astype(np.int64)], names=names)

    found = stored(runs.mapInArrow(stream, FOUND), "dedup-runs")
    del runs
    released(spark)
    spans = found.where(F.col("kind") == SPAN).select("text_id", F.col("first").alias("from_byte"), (F.col("last") + least).alias("to_byte"))

    mixed = found.where(F.col("kind") != SPAN)
    total = mixed.agg(F.sum(F.col("last") - F.col("first") + least)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    wanted = mixed.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "kind", "first", "last")).alias("runs"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, t, found in zip(batch.column("text_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = t.encode()
            rows += [(i, r["anchor"], r["kind"], r["first"], raw[r["first"] : r["last"] + least]) for r in found]
        return _columns(rows, ["text_id", "anchor", "kind", "first", "bytes"])

    bytes_of = stored(map_batches(docs.join(wanted, "text_id").select("text_id", "text", "runs"), cut, "text_id long, anchor long, kind long, first long, bytes binary"), "dedup-bytes")

    released(spark)

    def sort_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text_id", "first"], kind="stable")
        gone = shard_spans(list(zip(pdf["text_id"].tolist(), pdf["first"].tolist(), pdf["bytes"], strict=True)), least)
        return pd.DataFrame(gone, columns=["text_id", "from_byte", "to_byte"], dtype="int64")

    cool = bytes_of.where(F.col("kind") == COOL).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "text_id", "first", "bytes")
    sorted_ = cool.groupBy("shard").applyInPandas(sort_shard, "text_id long, from_byte long, to_byte long")

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, a, raw in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            rows += [(i, a + j, xxhash.xxh3_128_digest(raw[j : j + least])) for j in range(len(raw) - least + 1)]
        return _columns(rows, ["text_id", "at", "bytes"]) if rows else None

    hot = bytes_of.where(F.col("kind") == HOT).select("text_id", "first", "bytes")
    if hot.limit(1).count():
        hot = stored(map_batches(hot, strings, "text_id long, at long, bytes binary"), "dedup-hot")
        heads = hot.groupBy("bytes").agg(F.min(F.struct("text_id", "at")).alias("head"), F.count("*").alias("n")).where("n > 1").select("bytes", "head")
        hot = hot.join(heads, "bytes").where("not (head.text_id = text_id and head.at = at)")
        sorted_ = sorted_.union(hot.select("text_id", F.col("at").alias("from_byte"), (F.col("at") + least).alias("to_byte")))
    return spans.union(stored(sorted_, "dedup-spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """Adds text_id, a number in the order of (doc_id, text) that is one for equal rows."""
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "dedup-again")
    most = again.agg(F.max("n")).first()[0]
    if most is None:
        return docs.withColumn("text_id", F.col("doc_id"))
    hashed = docs.withColumn("h", F.sha1(F.col("text").cast("binary")))
    each = hashed.join(again.select("doc_id"), "doc_id").select("doc_id", "h").distinct()
    place = each.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1)
    width = 1 << int(most).bit_length()
    hashed = hashed.join(place, ["doc_id", "h"], "left").drop("h")
    return hashed.withColumn("text_id", F.col("doc_id") * width + F.coalesce("place", F.lit(0))).drop("place")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, **more: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): what is left of each text, as bytes, and
    the spans that went as (from_byte, to_byte)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = _identified(docs.where("doc_id is not null"))
    long = known.where(F.octet_length("text") >= least).select("text_id", "text")
    if "place" in known.columns or known.select("text_id").groupBy("text_id").count().where("count > 1").limit(1).count():
        long = long.dropDuplicates(["text_id"])
    spans = dedup_spans(long, least, **more).groupBy("text_id").agg(F.collect_list(F.struct("from_byte", "to_byte")).alias("found"))
    rows = known.join(spans, "text_id", "left").select("doc_id", "text", "found")
    rows = rows.union(docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<from_byte:bigint,to_byte:bigint>>")))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "spans")}
        for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = t.encode()
            gone = merged([(x["from_byte"], x["to_byte"]) for x in found or ()])
            at, kept = 0, []
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(b - a for a, b in gone))
            out["n_spans"].append(len(gone))
            out["kept"].append(b"".join(kept))
            out["spans"].append([{"from_byte": a, "to_byte": b} for a, b in gone])
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())]))]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return map_batches(rows, keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<from_byte:bigint,to_byte:bigint>>")


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


DEDUP_SQL = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, md5(hex(b[i + 1 : i + 100])) as h from (select doc_id, b, unnest(range(n - 99)) as i from d where n >= 100)),
g as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as k from w) where k > 1),
m as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as fresh from g)),
s as (select doc_id, min(i) as a, max(i) + 100 as z from m group by doc_id, run),
k as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from s),
o as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed, max(z) as last, list(struct_pack(f := before, t := a) order by a) as parts from k group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  case when o.doc_id is null then sha256(b) else sha256(unhex(array_to_string(list_transform(parts, lambda p: hex(b[p.f + 1 : p.t])), '') || hex(b[last + 1 : n]))) end as kept_sha256
from d left join o using (doc_id)
"""
