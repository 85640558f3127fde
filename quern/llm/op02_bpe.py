"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The encoder reads a text left to right.  White space cuts it into chunks, the
vocabulary's pattern cuts chunks into words, and a word is merged by rank.  A
word of any length passes through a buffer: ``sufficient_lookahead`` computes
from the merge list how far left an unknown continuation can still move a token
boundary, and tokens that end before that margin are emitted at once, so memory
stays constant however long a word is.  [Berglund and van der Merwe, "Formalizing
BPE Tokenization", 2023, show that proper merge lists have such a bound.]

Why the bound holds: rules apply in rank order.  Take two continuations of one
prefix.  To the left of some boundary p both have equal tokens; at first p is the
last symbol read, which may or may not carry the end-of-word mark.  A rule (u, v)
moves p only if u ends at p and v starts there in one of the two, and then to the
left edge of u.  A token that starts at the new p has u as prefix in either, so
the next rule to move p has a higher rank and a v that starts with u.  The
longest such chain of |u| is the bound.

A text goes through in pieces: white space is a certain boundary, so the buffer
flushes there, and what a word came to is kept as a memo.  Ids leave as they become
certain, are hashed at once and pass on to the decoder, a state machine that turns
ids into text piece by piece; neither ids nor decoded text are held whole.  A run
without white space is normalised whole.

Texts are encoded whole, each in the task that reads it, without a shuffle.  A null
or empty text has no tokens.  A null id stays null.  Repeated rows give repeated
rows; extra columns are ignored by ``digests`` and kept by ``encode``, but for one
with the name of its result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_batches, worker_memo

#: White space of Python that the vocabulary's pattern takes as ordinary characters.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + k)
            k += 1
    return out


def sufficient_lookahead(merges: Iterable[tuple[str, str]], end: str) -> int:
    """Symbols that must follow a token for it to be final, computed from the merge list."""
    best: dict[str, int] = {}
    most = 0
    size = lambda t: len(t[: -len(end)]) if end and t.endswith(end) else len(t)
    for u, v in merges:
        reach = max((best[v[:i]] for i in range(1, len(v) + 1) if v[:i] in best), default=0) + size(u)
        if reach > best.get(u, 0):
            best[u] = reach
        most = max(most, reach)
    return most + 1


class BpeModel:
    """A merge list with its vocabulary, read from a tokenizer file of the BPE kind."""

    def __init__(self, path: str, cache_size: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges, self.end)
        self.rules = {(self.vocab[u], self.vocab[v]): (rank, self.vocab[u + v]) for rank, (u, v) in enumerate(merges)}
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.lengths = [len(t[: -len(self.end)]) if self.end and t.endswith(self.end) else len(t) for t in self.tokens]
        of = {s: b for b, s in enumerate(symbols)}
        special = set(self.special.values())
        self.bytes = [t.encode() if i in special else bytes(of[c] for c in (t[: -len(self.end)] if self.end and t.endswith(self.end) else t)) + (b" " if self.end and t.endswith(self.end) else b"") for i, t in enumerate(self.tokens)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        if any(len(t.split()) != 1 or t != t.strip() for t in self.special):
            raise ValueError("special tokens with white space would span certain boundaries")
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.plain_decoder = not spec.get("decoder")
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self, cache_size)
        self.cache_size = cache_size

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the rules, lowest rank first, then leftmost."""
        if len(ids) > 40:
            return self._merge_long(ids)
        rules = self.rules
        while len(ids) > 1:
            low, at, to = 1 << 60, -1, 0
            a = ids[0]
            for i in range(1, len(ids)):
                b = ids[i]
                r = rules.get((a, b))
                if r is not None and r[0] < low:
                    low, to = r
                    at = i
                a = b
            if at < 0:
                break
            ids[at - 1 : at + 1] = [to]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long words."""
        n = len(ids)
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = []

        def push(i: int) -> None:
            j = right[i]
            if j >= 0 and (r := self.rules.get((ids[i], ids[j]))):
                heapq.heappush(heap, (r[0], i, ids[i], ids[j], r[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = right[i]
            if not live[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], right[i] = to, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                push(left[i])
            push(i)
        return [x for x, keep in zip(ids, live, strict=True) if keep]

    def stream_word(self, pieces: Iterable[bytes], block: int = 1024) -> Iterator[list[int]]:
        """Token lists of one word that comes in pieces of bytes; what is held is bounded
        by the lookahead, the block and the longest piece."""
        held: list[int] = []
        for piece in pieces:
            for k in range(0, len(piece), block):
                held += [self.inner[b] for b in piece[k : k + block]]
                if len(held) < self.lookahead + block:
                    continue
                out, done = [], 0
                for t in self.merge(list(held)):
                    if done + self.lengths[t] > len(held) - self.lookahead:
                        break
                    done += self.lengths[t]
                    out.append(t)
                if out:
                    held = held[done:]
                    yield out
        if held:
            b = self.inner.index(held[-1])
            yield self.merge([*held[:-1], self.last[b]])

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers, as the transducer emits them."""
        out = self.words.get(word)
        if out is None:
            raw = word.encode()
            out = b"".join(np.array(x, "<u4").tobytes() for x in self.stream_word(raw[i : i + 1024] for i in range(0, len(raw), 1024)))
            if len(raw) <= 64:
                if len(self.words) >= self.cache_size:
                    self.words.clear()
                self.words[word] = out
        return out

    def normal(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunk(self, chunk: str) -> bytes:
        """Ids of text without white space."""
        return b"".join([self.word(m[0]) for m in self.pattern.finditer(self.normal(chunk))])

    def _plain(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self.chunk(text)
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.split()])

    def section(self, text: str) -> bytes:
        """Ids of text between certain boundaries; strings of special tokens become their ids, none is added."""
        if self.special_pattern is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])]) if out else self._plain(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        return b"".join(Transducer(self).run(text))

    def decode(self, ids: Iterable[int]) -> str:
        """The whole text of some ids."""
        machine = TextDecoder(self)
        return machine.feed(ids) + machine.finish()


class Transducer:
    """Text in pieces to ids: ``feed`` gives those that no later piece can change."""

    def __init__(self, model: BpeModel, piece: int = 1 << 16):
        self.model, self.piece, self.held = model, piece, ""

    def feed(self, piece: str) -> bytes:
        held = self.held + piece
        cut = 1 + max(held.rfind(" "), held.rfind("\n"))
        self.held = held[cut:]
        return self.model.section(held[:cut]) if cut else b""

    def finish(self) -> bytes:
        out, self.held = self.model.section(self.held), ""
        return out

    def run(self, text: str | None) -> Iterator[bytes]:
        """The ids of a whole text, piece by piece."""
        for at in range(0, len(text or ""), self.piece):
            yield self.feed(text[at : at + self.piece])
        yield self.finish()


class _Chunks(dict):
    """Chunk to ids, filled on demand and emptied when full."""

    def __init__(self, model: BpeModel, most: int):
        self.model, self.most = model, most

    def __missing__(self, chunk: str) -> bytes:
        out = self.model.chunk(chunk)
        if len(chunk) <= 24:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


class TextDecoder:
    """Ids to text, piece by piece.  For a file that names no decoder tokens stand as they are with
    single spaces between, as in the tokenizers library; the state is whether any came yet.
    Otherwise, or with ``readable``, a state machine over bytes that holds back an incomplete
    character only, and turns ends of words into single spaces."""

    def __init__(self, model: BpeModel, readable: bool = False):
        self.model = model
        self.bytes = readable or not model.plain_decoder
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        if self.bytes:
            return self.state.decode(b"".join(map(self.model.bytes.__getitem__, ids)))
        out = " ".join(map(self.model.tokens.__getitem__, ids))
        if out and self.begun:
            out = " " + out
        self.begun |= bool(out)
        return out

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.bytes else ""


def model_of(path: str) -> BpeModel:
    return worker_memo(f"bpe:{path}", lambda: BpeModel(path))  # type: ignore[return-value]


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of each text as an array of integers; an existing column of that name goes."""
    fields = [f for f in df.schema.fields if f.name != into]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = model_of(path)
        raw = [model.encode(t) for t in batch.column(text).to_pylist()]
        offsets = np.zeros(len(raw) + 1, np.int32)
        np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
        return pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [ids], names=[f.name for f in fields] + [into])

    return map_batches(df.select([F.col(f"`{f.name}`") for f in fields]), one, T.StructType([*fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per row: key, number of tokens, digest of the ids and of the text decoded from them;
    with ``ids`` the ids as well."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = model_of(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        parts = []
        for t in batch.column(text).to_pylist():
            n, coded, plain, machine, kept = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder(model), []
            for raw in Transducer(model).run(t):
                n += len(raw) // 4
                coded.update(raw)
                plain.update(machine.feed(np.frombuffer(raw, "<u4").tolist()).encode())
                if ids:
                    kept.append(raw)
            plain.update(machine.finish().encode())
            for k, v in zip(out, (n, coded.hexdigest(), plain.hexdigest()), strict=True):
                out[k].append(v)
            parts.append(b"".join(kept))
        columns = {key: batch.column(key), **out}
        if ids:
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in parts], out=offsets[1:])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        return pa.RecordBatch.from_pydict(columns)

    return map_batches(df.select(F.col(key).cast("long").alias(key), text), one, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), default_vocabulary())
