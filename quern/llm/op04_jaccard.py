"""N-gram Jaccard join over prefix trees.

A document's set holds its distinct 5-word shingles as 64-bit hashes.  Two sets
with similarity t or more share a shingle among their first |x| - ceil(t |x|) + 1
in any global order.  The order here is by class of frequency, then by hash, so
that passages which many documents share come last.

1. Each task counts its shingles in a fixed number of buckets; buckets that stand
   out are summed over all tasks.  The class of a shingle is the logarithm of its
   bucket's sum.  The table of classes has a fixed size, whatever the input.
2. Only prefixes are shuffled, by shingle: (shingle, set, size, place).  A pair
   whose first common shingle lies at places i and j overlaps in at most
   min(|x| - i, |y| - j), so for each place there is a greatest size of partner.
   Rows without a partner of fitting size at a fitting place end here.  Rows of a
   frequent shingle are dealt out by set as well, and kept.
3. Sets have bitmaps, in which each shingle flips one bit, so those of similar sets
   differ in at most (|x| + |y|) / 9 bits.  Each set left picks the shingle that most
   others have, and sets with the same pick meet in blocks of bounded size.  Those
   with a close bitmap beside them make a prefix tree: a set that looks for
   partners walks it, carries the overlap so far to all sets below, and leaves a
   subtree as soon as the elements still to come, of either side, can't reach the
   overlap needed, or when all sets below are in its class already.  Of each block
   a few leaders meet again, in blocks, until one is left.  This joins large groups
   of near copies in proportion to their size.
4. A pair may still be in two classes.  Shingles whose sets are of one class are
   done.  Of the others, sets outside the shingle's largest class meet the rest, as
   bitmaps.  Sets that pass, grouped with those they pass with, go to prefix trees
   again; groups that several shingles give are joined once.

Only narrow rows move in these steps; texts of sets that have candidates are
brought out once, and come to a block together with its narrow rows.  Equal sets
are one node, whatever the number of documents, and verification is by 64-bit
hashes of shingles: two sets of 1,000 shingles have one too many in common by
chance once in 10**13 pairs.  Classes are found over sets; documents with several
texts (rows that repeat a doc_id) join the classes of each.  A text with a null
doc_id is a node as well and can join others, but gives no row.  Documents
without words or text have an empty set and no links.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, documents, released, stored
from .shingles import shingle_sets

K, PERCENT = 5, 80
#: Sets in a block, and shingles in it at most.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 1_000_000
#: Buckets in which shingles are counted, as a power of two; sets of a shingle that are dealt together.
BUCKET_BITS, TOGETHER = 22, 1 << 16
#: Leaders of a block.
LEADERS = 4


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets([text], K)[0]


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def similar(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def widest(n, place, percent: int = PERCENT):
    """The greatest size of a partner whose first common shingle lies at this place of a set of n."""
    return (100 + percent) * (n - place) // percent - n


class Classes:
    """Union-find over the sets of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


class Trie:
    """Ordered sets as paths; a path without branches is kept as one array."""

    def __init__(self, percent: int, classes: Classes):
        self.percent, self.classes = percent, classes
        # a node: [path, children by first element, sets that end here, least size, most size, members]
        self.root: list = [(), {}, [], 1 << 60, 0, []]
        self.sizes: dict[int, int] = {}

    def add(self, name: int, items: list[int]) -> None:
        n, node, i = len(items), self.root, 0
        self.sizes[name] = n
        while True:
            old = node[3:5]
            node[3], node[4] = min(node[3], n), max(node[4], n)
            node[5].append(name)
            path = node[0]
            k = 0
            while k < len(path) and i < n and path[k] == items[i]:
                k += 1
                i += 1
            if k < len(path):  # split the path where the sets part
                below = [path[k:], node[1], node[2], *old, node[5][:-1]]
                node[0], node[1], node[2] = path[:k], {path[k]: below}, []
            if i == n:
                node[2].append(name)
                break
            nxt = node[1].get(items[i])
            if nxt is None:
                node[1][items[i]] = [tuple(items[i:]), {}, [name], n, n, [name]]
                break
            node = nxt

    def partners(self, name: int, items: list[int]) -> Iterator[int]:
        """Sets of the trie that are similar to this one and not yet in its class."""
        n, p = len(items), self.percent
        rank = {x: i for i, x in enumerate(items)}  # place in the probe
        find, least_size = self.classes.find, -(-p * n // 100)
        most_size = 100 * n // p
        # (node, overlap so far, elements of the path so far, place in the probe)
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, common, depth, at = stack.pop()
            if node[3] > most_size or node[4] < least_size:
                continue
            own = find(name)
            members = node[5]
            if find(members[0]) == own and all(find(x) == own for x in members):
                continue
            # for sets of size s >= smallest below, overlap must reach p (n + s) / (100 + p)
            need = -(-p * (n + max(node[3], least_size)) // (100 + p))
            big = node[4]
            dead = False
            for x in node[0]:
                depth += 1
                j = rank.get(x)
                if j is not None:
                    common += 1
                    at = j + 1
                elif common + min(n - at, big - depth) < need:
                    dead = True
                    break
            if dead or common + min(n - at, big - depth) < need:
                continue
            for x in node[2]:
                if similar(common, n, self.sizes[x], p) and find(x) != find(name):
                    yield x
            stack += [(child, common, depth, at) for child in node[1].values()]


def join_block(sets: list[list[int]], percent: int = PERCENT, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links among ``sets``, each in the global order; not all of them, but no two sets with a link are left
    in different classes.  ``known`` has the classes that the sets are in."""
    classes = Classes(len(sets))
    first: dict[int, int] = {}
    for i, c in enumerate(known or ()):
        classes.join(first.setdefault(c, i), i)
    trie = Trie(percent, classes)
    out: list[tuple[int, int]] = []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        if trie.root[5]:
            for j in trie.partners(i, sets[i]):
                if classes.join(i, j):
                    out.append((i, j))
        trie.add(i, sets[i])
    return out


# The global order


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.intp)


def in_order(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: by class of frequency, then by hash."""
    c = classes[bucket_of(s)]
    often = c > 0
    if not often.any():
        return s
    high = np.flatnonzero(often)
    return np.concatenate([s[~often], s[high[np.argsort(c[high], kind="stable")]]])


def by_bytes(batch: pa.RecordBatch, column: int | str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have so many bytes at most, or that are one row: what is made of them at a time
    stays small, whatever the lengths of texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


LIGHT = "doc_id long, hash long, set long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, set, size) for each row, and (bucket, null, null, count) for buckets that stand out in
    the task: those above the mean by eight times its root and 16."""
    names = [x.split()[0] for x in LIGHT.split(", ")]
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for some in by_bytes(batch, 2):
            sets = shingle_sets(some.column(2).to_pylist(), K)
            np.add.at(counts, bucket_of(np.concatenate(sets)), 1)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(map(set_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64())], names=names)
    mean = counts.mean()
    often = np.flatnonzero(counts > mean + 8 * mean**0.5 + 16)
    if len(often):
        none = pa.nulls(len(often), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(often), none, none, pa.array(counts[often])], names=names)


def frequency_classes(found: DataFrame) -> np.ndarray:
    """The class of each bucket; a table of a fixed size, from at most as many rows."""
    table = found.where("set is null").groupBy(F.col("doc_id").alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    if table.num_rows:
        out[table.column("bucket").to_numpy()] = np.log2(table.column("n").to_numpy()).astype(np.uint8)
    return out


# Prefixes

PREFIXES = "token long, set long, n int, place int, salt int"
SHARED = "token long, set long, n int, place int, sets int"


def _prefixes(batches: Iterator[pa.RecordBatch], classes: np.ndarray, percent: int, together: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The prefix of each set, once for sets that come again soon in the task.  Shingles have 48 bits
    here; an equal one by chance makes a candidate only.  Frequent ones are salted by set."""
    names = [x.split()[0] for x in PREFIXES.split(", ")]
    salts = np.array([max(0, c - together.bit_length() + 1) for c in range(256)])
    seen: set[int] = set()
    for batch in batches:
        for some in by_bytes(batch, 0):
            tokens, keys, sizes, bounds, cls = [], [], [], [], []
            for s in shingle_sets(some.column(0).to_pylist(), K):
                k = set_key(s)
                if not len(s) or k in seen:
                    continue
                if len(seen) >= most:
                    seen.clear()
                seen.add(k)
                p = in_order(s, classes)[: prefix_length(len(s), percent)]
                tokens.append(p)
                cls.append(classes[bucket_of(p)])
                keys.append(k)
                sizes.append(len(s))
                bounds.append(len(p))
            if not tokens:
                continue
            of = np.repeat(np.arange(len(keys)), bounds)
            place = np.arange(len(of)) - np.repeat(np.cumsum([0, *bounds[:-1]]), bounds)
            key = np.array(keys, np.int64)[of]
            salt = np.where(salts[np.concatenate(cls)] > 0, 1 + (key & ((1 << salts[np.concatenate(cls)]) - 1)), 0)
            columns = ((np.concatenate(tokens) >> np.uint64(16)).view(np.int64), key, np.array(sizes, np.int32)[of], place.astype(np.int32), salt.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def partnered(token: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of (token, n), whole tokens only: which have a partner of fitting size at a
    fitting place, and how many rows their token has.  Of a pair of sizes a <= b, the larger must have b >= a as
    a possible partner's size, which only places early enough allow; those rows are called open."""
    first = np.r_[True, token[1:] != token[:-1]]
    group = np.cumsum(first) - 1
    size = np.bincount(group)[group]
    reach = widest(n.astype(np.int64), place, percent)
    open_ = reach >= n
    top = np.int64(1) << 32
    key = group * top + n
    low = np.searchsorted(key, group * top + -(-percent * n.astype(np.int64) // 100))
    high = np.searchsorted(key, group * top + np.minimum(np.minimum(reach, 100 * n.astype(np.int64) // percent), top - 1), side="right")
    opens = np.r_[0, np.cumsum(open_)]
    among = np.where(open_, high - low - 1, np.maximum(0, opens[np.maximum(high, low)] - opens[low]))
    return among > 0, size


def sift(batches: Iterator[tuple[np.ndarray, ...]], percent: int = PERCENT, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """From (token, set, n, place, salt) in the order of token, n and set to (token, set, n, place, rows of the
    token) of rows that have a partner.  A token with more than ``most`` rows is passed on as it comes."""
    held: list[tuple[np.ndarray, ...]] = []
    rows, flowing = 0, None

    def close(part: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
        token, key, n, place, salt = part
        if len(token):
            fresh = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
            token, key, n, place, salt = (x[fresh] for x in part)
            good, size = partnered(token, n, place, percent)
            good |= salt > 0
            yield token[good], key[good], n[good], place[good], np.where(salt[good] > 0, most, size[good])

    for batch in batches:
        token = batch[0]
        if not len(token):
            continue
        if flowing is not None:
            cut = int(np.searchsorted(token, flowing, side="right")) if token[0] == flowing else 0
            if cut:
                yield (*(x[:cut] for x in batch[:4]), np.full(cut, most))
                batch = tuple(x[cut:] for x in batch)
                token = batch[0]
                if not len(token):
                    continue
            flowing = None
        held.append(batch)
        rows += len(token)
        if rows < 1 << 16:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(whole[0], whole[0][-1]))
        yield from close(tuple(x[:cut] for x in whole))
        held, rows = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if rows > most:
            flowing = held[0][0][-1]
            yield (*held[0][:4], np.full(rows, most))
            held, rows = [], 0
    if held:
        yield from close(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def _shared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SHARED.split(", ")]
    for part in sift((tuple(c.to_numpy() for c in b.columns) for b in batches), percent):
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(part, kinds, strict=True)], names=names)


# Bitmaps


def bitmap(s: np.ndarray) -> np.ndarray:
    """64-bit words in which each shingle flips one bit; about two to four bits a shingle."""
    bits = 64 << max(0, (max(1, len(s) // 32) - 1).bit_length())
    out = np.bincount(((s >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1
    return np.packbits(out.astype(np.uint8), bitorder="little").view("<u8")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of a and of b differ; the longer ones are folded to the shorter."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    out = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


def close_pairs(n: np.ndarray, reach: np.ndarray, cls: np.ndarray, maps: list[np.ndarray], probes: np.ndarray, targets: np.ndarray, percent: int = PERCENT, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a probe and a target, as positions, that may be similar and are in different classes."""
    by: dict[int, list[int]] = defaultdict(list)
    for j in targets.tolist():
        by[len(maps[j])].append(j)
    for width, of in by.items():
        of = np.array(of)
        theirs = np.stack([maps[j] for j in of.tolist()])
        mine: dict[int, list[int]] = defaultdict(list)
        fit = (100 * n[of].max() >= percent * n[probes]) & (percent * n[of].min() <= 100 * n[probes])
        for i in probes[fit].tolist():
            mine[len(maps[i])].append(i)
        for own in mine.values():
            for at in range(0, len(own), rows):
                some = np.array(own[at : at + rows])
                a, b = n[some][:, None], n[of][None, :]
                good = (cls[some][:, None] != cls[of][None, :]) & (percent * a <= 100 * b) & (percent * b <= 100 * a)
                good &= (b <= reach[some][:, None]) & (a <= reach[of][None, :])
                if good.any():
                    # |x| + |y| - 2 common, with common >= p (|x| + |y|) / (100 + p)
                    good &= differing(np.stack([maps[i] for i in some.tolist()]), theirs) * (100 + percent) <= (100 - percent) * (a + b)
                    x, y = np.nonzero(good)
                    if len(x):
                        yield some[x], of[y]


def close_rows(n: np.ndarray, reach: np.ndarray, cls: np.ndarray, maps: list[np.ndarray], unit: np.ndarray, probe: np.ndarray, target: np.ndarray, small: int = 256, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for rows of whole units, in their order.  The pairs of small units are looked at together."""
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    size = np.diff(np.r_[first, len(unit)])
    for a, g in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
        rows = np.arange(a, a + g)
        yield from close_pairs(n, reach, cls, maps, rows[probe[rows]], rows[target[rows]], percent)
    own = np.flatnonzero(probe & np.repeat(size <= small, size))
    if not len(own):
        return
    start, g = np.repeat(first, size)[own], np.repeat(size, size)[own]
    x = np.repeat(own, g)
    y = np.arange(len(x)) - np.repeat(np.cumsum(g) - g, g) + np.repeat(start, g)
    good = target[y] & (cls[x] != cls[y]) & ((x < y) | ~probe[y] | ~target[x])
    x, y = x[good], y[good]
    good = (percent * n[x] <= 100 * n[y]) & (percent * n[y] <= 100 * n[x]) & (n[y] <= reach[x]) & (n[x] <= reach[y])
    x, y = x[good], y[good]
    width = np.array([len(m) for m in maps])
    rank = np.empty(len(maps), np.int64)
    stacks = {}
    for w in np.unique(width[np.r_[x, y]]).tolist():
        of = np.flatnonzero(width == w)
        rank[of] = np.arange(len(of))
        stacks[w] = np.stack([maps[i] for i in of.tolist()])
    kind = width[x] * (1 << 32) + width[y]
    for k in np.unique(kind).tolist():
        both = np.flatnonzero(kind == k)
        a, b = stacks[k >> 32], stacks[k & 0xFFFFFFFF]
        for at in range(0, len(both), 1 << 14):
            i, m = x[both[at : at + (1 << 14)]], y[both[at : at + (1 << 14)]]
            u, v = a[rank[i]], b[rank[m]]
            while u.shape[1] > v.shape[1]:
                u = u[:, : u.shape[1] // 2] ^ u[:, u.shape[1] // 2 :]
            while v.shape[1] > u.shape[1]:
                v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
            near = np.bitwise_count(u ^ v).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n[i] + n[m])
            yield i[near], m[near]


UNIT = "unit long, set long, class long"


def near_groups(rows: dict[str, np.ndarray], maps: list[np.ndarray], percent: int = PERCENT) -> tuple[list[int], list[int], list[int]]:
    """(unit, set, class) of sets with a close one in another class, grouped as such pairs connect; a group's name
    is made of its sets, so that equal groups have one."""
    keys, cls, role = rows["set"], rows["class"], rows["role"]
    n = rows["n"].astype(np.int64)
    reach = widest(n, rows["place"].astype(np.int64), percent)
    at = Classes(len(keys))
    met: set[int] = set()
    for x, y in close_rows(n, reach, cls, maps, rows["unit"], role > 0, role < 2, percent=percent):
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            at.join(i, j)
        met.update(x.tolist(), y.tolist())
    same: dict[tuple[int, int], int] = {}
    for i in sorted(met):  # a set may stand in a unit twice, as probe and as target
        at.join(same.setdefault((int(rows["unit"][i]), int(keys[i])), i), i)
    groups: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for i in met:
        groups[at.find(i)].add((int(keys[i]), int(cls[i])))
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for g in groups.values():
        name = xxhash.xxh3_64_intdigest(np.array(sorted(g), np.int64).tobytes()) - (1 << 63)
        for s, c in g:
            for column, value in zip(out, (name, s, c), strict=True):
                column.append(value)
    return out


def whole_units(batches: Iterator[pa.RecordBatch], rows: int = 4096, most: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of whole units from rows in the order of ``unit``: at least so many rows or bytes, or the rest."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < rows and size < most:
            continue
        table = pa.Table.from_batches(held)
        unit = table.column("unit").to_numpy()
        cut = int(np.searchsorted(unit, unit[-1]))
        if cut:
            yield table.slice(0, cut)
        table = table.slice(cut)
        held, n, size = table.combine_chunks().to_batches(), table.num_rows, table.nbytes
    if n:
        yield pa.Table.from_batches(held)


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in UNIT.split(", ")]
    for table in whole_units(batches):
        columns = {c: table.column(c).to_numpy() for c in ("unit", "role", "set", "n", "place", "class")}
        found = near_groups(columns, [np.frombuffer(x, "<u8") for x in table.column("bits").to_pylist()], percent)
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)


def unit_links(table: pa.Table, classes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links within units of (unit, set, n, class, text, bits).  A set without a close bitmap of another class in
    its unit has no part in its prefix tree."""
    unit, key, n, cls = (table.column(c).to_numpy() for c in ("unit", "set", "n", "class"))
    all_ = np.ones(len(unit), bool)
    met = np.zeros(len(unit), bool)
    for x, y in close_rows(n, widest(n, 0, percent), cls, [np.frombuffer(b, "<u8") for b in table.column("bits").to_pylist()], unit, all_, all_, percent=percent):
        met[x] = met[y] = True
    rows = np.flatnonzero(met)
    if not len(rows):
        return
    texts = table.column("text").take(pa.array(rows)).to_pylist()
    for part in np.split(np.arange(len(rows)), np.flatnonzero(unit[rows][1:] != unit[rows][:-1]) + 1):
        of = {int(key[rows[i]]): i for i in part.tolist()}  # a set may come twice
        sets = [in_order(s, classes).tolist() for s in shingle_sets((texts[i] for i in of.values()), K)]
        nodes = list(of)
        for i, j in join_block(sets, percent, [int(cls[rows[i]]) for i in of.values()]):
            yield nodes[i], nodes[j]


def _linked(batches: Iterator[pa.RecordBatch], classes: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    for table in whole_units(batches):
        found = list(unit_links(table, classes, percent))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


# The join


TEXTS = "set long, n long, token long, block int, blocks int, text string, bits binary"


def _texts(source: DataFrame, light: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(set, n, token, block, blocks)`` with texts and bitmaps, each from one document: that with the
    smallest id and hash."""
    first = light.select("set", "doc_id", "hash").join(wanted, "set").groupBy(*wanted.columns).agg(F.min(F.struct("doc_id", "hash")).alias("x"))
    first = first.select(*wanted.columns, F.col("x.doc_id").alias("d"), F.col("x.hash").alias("h"))
    # by merging at every size, so that what moves stays in proportion
    rows = source.withColumn("j", F.coalesce("doc_id", "hash")).join(first.withColumn("j", F.coalesce("d", "h")).hint("merge"), "j").where("hash = h and d <=> doc_id").select(*wanted.columns, "t")
    names = [x.split()[0] for x in TEXTS.split(", ")]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat id and text come together
        for batch in batches:
            for some in by_bytes(batch, "t"):
                sets = shingle_sets(some.column("t").to_pylist(), K)
                keep = []
                for s, k in zip(sets, some.column("set").to_pylist(), strict=True):
                    # a text whose 64-bit hash is that of another is not the one looked for
                    keep.append(k not in seen and set_key(s) == k)
                    if keep[-1]:
                        seen.add(k)
                bits = pa.array([bitmap(s).tobytes() for s, ok in zip(sets, keep, strict=True) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.filter(pa.array(keep, pa.bool_())).columns, bits], names=names)

    return rows.mapInArrow(one, TEXTS)


def set_classes(docs: DataFrame, key: str, text: str, percent: int = PERCENT, block_sets: int = BLOCK_SETS, together: int = TOGETHER, by_id: bool = True) -> DataFrame:
    """(doc_id, hash, set, n, class) for each row, where the hash is that of the text and the class is the smallest
    set that links reach; null for empty sets.  With ``by_id`` texts of the same id are linked."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")).withColumn("hash", F.xxhash64("t"))
    found = stored(source.select("doc_id", "hash", "t").mapInArrow(_count, LIGHT), "jaccard-light")
    light = found.where("set is not null")
    classes = spark.sparkContext.broadcast(frequency_classes(found))  # of a fixed size: 2 ** BUCKET_BITS bytes

    prefixes = source.select("t").mapInArrow(lambda b: _prefixes(b, classes.value, percent, together), PREFIXES)
    ordered = prefixes.repartition(parts, "token", "salt").sortWithinPartitions("token", "n", "set")
    shared = stored(ordered.mapInArrow(lambda b: _shared(b, percent), SHARED), "jaccard-shared")
    del prefixes, ordered
    released(spark)

    # each set picks the shingle of most sets, and a block of its sets
    picks = shared.groupBy("set").agg(F.max(F.struct("sets", "token")).alias("x"), F.first("n").cast("long").alias("n")).select("set", "n", F.col("x.token").alias("token"))
    picks = stored(picks, "jaccard-picks")

    def blocked(members: DataFrame, level: int) -> DataFrame:
        sizes = members.groupBy("token").agg(F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        return members.join(sizes, "token").select("set", "n", "token", F.pmod(F.xxhash64("set", F.lit(level)), F.col("blocks")).cast("int").alias("block"), "blocks")

    texts = stored(_texts(source, light.where("n > 0"), blocked(picks, 0)), "jaccard-texts")
    released(spark)

    def joined(rows: DataFrame) -> DataFrame:
        """(a, b): links within the units of ``rows(unit, set, n, class, text, bits)``."""
        rows = rows.select("unit", "set", "n", "class", "text", "bits").repartition(parts, "unit").sortWithinPartitions("unit")
        return stored(rows.mapInArrow(lambda b: _linked(b, classes.value, percent), "a long, b long"), "jaccard-links")

    alone = F.col("set").alias("class")
    pick = F.xxhash64("token", "block").alias("unit")

    # the blocks of a shingle, then blocks of their leaders, until each shingle has one block
    members, level, tables = texts, 0, [texts, shared, picks]
    links = joined(texts.select(pick, "set", "n", alone, "text", "bits"))
    while True:
        some = members.where("blocks > 1").withColumn("leader", F.pmod(F.xxhash64("set", F.lit(-1 - level)), F.lit(LEADERS)))
        some = some.groupBy("token", "block", "leader").agg(F.min(F.struct(F.xxhash64("set"), "set", "n")).alias("x")).select("token", "x.set", "x.n")
        some, level = stored(some, "jaccard-leaders"), level + 1
        tables.append(some)
        if not some.limit(1).count():
            break
        members = stored(blocked(some, level), "jaccard-blocks")
        more = joined(members.select(pick, "set", alone).join(texts.select("set", "n", "text", "bits"), "set"))
        links = links.union(more)
        tables += [members, more]

    # pairs that are left: shingles with sets of several classes
    known = connected_components(links).select(F.col("node").alias("set"), F.col("component").alias("class"))
    posts = shared.drop("sets").join(known, "set", "left").withColumn("class", F.coalesce("class", "set"))
    posts = stored(posts, "jaccard-posts")
    sums = [F.sum(F.xxhash64("set", F.lit(k)).bitwiseAND(0xFFFFFFFF)).alias(f"h{k}") for k in range(4)]
    names = [f"h{k}" for k in range(4)]
    mixed = posts.groupBy("token", "class").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum("place").alias("places"), *sums)
    main = F.max_by("class", F.struct("k", -F.col("class"))).alias("main")
    mixed = mixed.groupBy("token").agg(main, F.count("*").alias("of"), *[F.sum(c).alias(c) for c in ("k", "s", "places", *names)]).where("of > 1")
    # of shingles with the same sets, known by sums of hashes, the first in the order has the earliest places in all
    blocks = F.ceil(F.greatest(F.col("k") / block_sets, F.col("s") / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.groupBy("k", "s", *names).agg(F.min(F.struct("places", "token", "main")).alias("x")).select("x.token", "x.main", blocks.alias("blocks"))
    left = posts.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    # in units of one block or two: those outside the main class as probes (role 2), all as targets (0), or both (1)
    left = left.withColumn("stray", F.col("class") != F.col("main")).drop("main")
    full = stored(left.hint("merge").join(texts.select("set", "bits"), "set"), "jaccard-left")
    own = ["role", "set", "n", "place", "class", "bits"]
    unit = lambda u, v: F.xxhash64("token", u, v).alias("unit")
    one = full.where("blocks = 1").select(unit(F.lit(0), F.lit(0)), F.col("stray").cast("int").alias("role"), *own[1:])
    several = full.where("blocks > 1")
    occupied = several.where("stray").select("token", F.col("block").alias("u")).distinct()
    targets = several.join(occupied, "token").select(unit(F.col("u"), F.col("block")), F.lit(0).alias("role"), *own[1:])
    probes = several.where("stray").withColumn("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(unit(F.col("block"), F.col("v")), F.lit(2).alias("role"), *own[1:])
    rows = one.union(targets).union(probes).repartition(parts, "unit").sortWithinPartitions("unit")
    units = stored(rows.mapInArrow(lambda b: _near(b, percent), UNIT).distinct(), "jaccard-units")
    more = joined(units.hint("merge").join(texts.select("set", "n", "text", "bits"), "set"))
    links = links.union(more)
    if by_id:
        ids = light.where("n > 0 and doc_id is not null").select("doc_id", "set").distinct()
        low = ids.groupBy("doc_id").agg(F.min("set").alias("b"), F.max("set").alias("high")).where("b <> high").drop("high")
        links = links.union(ids.join(low, "doc_id").select(F.col("set").alias("a"), "b"))
    final = stored(connected_components(links).select(F.col("node").alias("set"), F.col("component").alias("class")), "jaccard-classes")
    discard(*tables, posts, full, units, more)
    return light.join(final, "set", "left").select("doc_id", "hash", "set", "n", F.when(F.col("n") > 0, F.coalesce("class", "set")).alias("class"))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, **more: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row with an id."""
    rows = set_classes(docs, key, text, percent, **more)
    low = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component"))
    out = rows.join(low, "class", "left").where("doc_id is not null")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from w
), e as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r as (select a, b from p union select r.a, p.b from r join p on r.b = p.a)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce((select min(b) from r where r.a = s.doc_id), doc_id)) as component_id from s
"""


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each class, that with the smallest id, with all their columns.
    Rows are told apart by id and text: of a class the least of both stays, once, and rows of an id
    whose texts have nothing to do with each other all stay.  Rows with a null id stay, though their
    texts can link others; so do rows without words."""
    rows = set_classes(docs, key, text, by_id=False)
    of = rows.where("doc_id is not null")
    kept = of.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "hash")).alias("x")).select("x.*")
    kept = stored(kept.union(of.where("class is null").select("doc_id", "hash")).distinct(), "jaccard-kept")
    again = of.join(kept, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    own = docs.where(F.col(f"`{key}`").isNotNull())
    mark = max((len(c) for c in docs.columns), default=0) * "_"  # longer than any other name
    kept = kept.select(F.col("doc_id").alias(mark + "id"), F.col("hash").alias(mark + "hash"))
    match = (F.col(f"`{key}`").cast("long") == F.col(mark + "id")) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(mark + "hash"))
    # by merging at every size, so that what moves stays in proportion
    own = own.join(kept.hint("merge"), match, "left_semi")
    if again:  # rows that repeat id and text
        own = own.dropDuplicates([key, text])
    return own.union(docs.where(F.col(f"`{key}`").isNull()))
