"""Token-ID output: shards of concatenated ids whose document boundaries are Elias-Fano coded.

A shard holds a header, the ids (16 or 32 bits each), the boundaries and the doc_ids, the last two
as Elias-Fano sequences with sampled select. Shards are written by the tasks into the shared
folder under names no other attempt uses; the names that count are those of the attempts that
Spark accepted, so a lost executor leaves at most a file nobody reads.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, map_rows, materialize, scratch, texts_of

MAGIC = b"LTKF0001"
UNSIGNED = "I" if array("I").itemsize == 4 else "L"  # of 32 bits


class EliasFano:
    """A non-decreasing sequence of n integers below u in about 2 + log2(u / n) bits each.

    The upper bits are unary in a bit vector, the lower ones packed. Every SAMPLE-th one's
    place is kept in 32 bits; select scans 64-bit words from there.
    """

    SAMPLE = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        if (v[1:] < v[:-1]).any():
            raise ValueError("the sequence decreases")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        shift = np.uint64(low_bits)
        ones = (v >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) // 64 + 1) * 64, np.uint8)
        bits[ones] = 1
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little").view("<u8"), ones[:: cls.SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (a + self.low_bits) // 8 + 1].tobytes(), "little")
        return (word >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The place of the i-th one of the upper bits."""
        at = int(self.samples[i // self.SAMPLE])
        left, w = i % self.SAMPLE, at // 64
        word = int(self.high[w]) >> (at % 64) << (at % 64)
        while (ones := word.bit_count()) <= left:
            left, w = left - ones, w + 1
            word = int(self.high[w])
        for _ in range(left):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.low_bits) | self._low(i)

    def __len__(self) -> int:
        return self.n

    def walk(self, i: int = 0):
        """The values from the i-th on, one at a time: select finds the first one, and each next is the next one of the bits."""
        if i >= self.n:
            return
        at = self.select(i)
        w = at // 64
        word = int(self.high[w]) >> (at % 64) << (at % 64)
        while i < self.n:
            while not word:
                w += 1
                word = int(self.high[w])
            at = w * 64 + (word & -word).bit_length() - 1
            yield ((at - i) << self.low_bits) | self._low(i)
            word &= word - 1
            i += 1

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")).astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes

    def dump(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, self.low.nbytes, self.high.nbytes, self.samples.nbytes) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, "<u8", b // 8, at + a), np.frombuffer(data, "<u4", c // 4, at + a + b))


def pack_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """doc_ids ascend, nulls first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])).dump()
    names = EliasFano.of((known - base).astype(np.uint64)).dump()
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    head = json.dumps({"docs": len(doc_ids), "nulls": nulls, "base": base, "ids": len(ids), "width": 4 if wide else 2, "bounds": len(bounds), "names": len(names), "crc": zlib.crc32(names, zlib.crc32(bounds, zlib.crc32(body)))}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + body + bounds + names


class Shard:
    """A shard's bytes, opened: ids of document i are ids[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<I", data, len(MAGIC))
        at = len(MAGIC) + 4
        h = json.loads(data[at : at + n])
        at += n
        size = h["ids"] * h["width"]
        body, bounds, names = data[at : at + size], data[at + size : at + size + h["bounds"]], data[at + size + h["bounds"] : at + size + h["bounds"] + h["names"]]
        if zlib.crc32(names, zlib.crc32(bounds, zlib.crc32(body))) != h["crc"]:
            raise ValueError("the shard is damaged")
        self.docs, self.ids = h["docs"], np.frombuffer(body, "<u4" if h["width"] == 4 else "<u2")
        self.bounds, self._names, self._nulls, self._base = EliasFano.load(bounds), EliasFano.load(names), h["nulls"], h["base"]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i] : self.bounds[i + 1]]

    def doc_id(self, i: int) -> int | None:
        return None if i < self._nulls else self._names[i - self._nulls] + self._base

    def documents(self):
        """(doc_id, from, to) of all documents, in order; ids are ids[from:to]."""
        ends, names, low = self.bounds.walk(1), self._names.walk(), 0
        for i, high in enumerate(ends):
            yield None if i < self._nulls else next(names) + self._base, low, high
            low = high


#: The pattern of public word vocabularies whose matches hold either letters, one digit, or neither.
WORDS_APART = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


class WordIds(dict):
    """Ids of texts by a vocabulary that drops white space: each word between spaces or line ends is
    encoded by the library for itself and kept while there is room. Texts that may hold a special
    token's string go to the library whole.

    With apart, the vocabulary's pattern never joins letters and punctuation: of a word that ends
    in one of ENDS the letters and the rest are looked up for themselves, if all letters are below
    PLAIN: normalising gives letters for those, and marks for some beyond."""

    ENDS = frozenset(".,;:!?")
    PLAIN = "\u0130"

    ROOM = 1_300_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        steps = json.loads(self.lib.to_str())["pre_tokenizer"] or {}
        self.apart = [s.get("pattern", {}).get("Regex") for s in steps.get("pretokenizers", [])][:1] == [WORDS_APART]
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]

    def library(self, text: str) -> bytes:
        ids = array(UNSIGNED, self.lib.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.apart and word[-1:] in self.ENDS and word[:-1].isalpha() and (word.isascii() or max(word) < self.PLAIN):
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = self.library(word)
        if len(self) < self.ROOM and len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self.library(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def word_ids(path: str) -> WordIds:
    """This Python process's ids, kept for a worker's later tasks of this operator."""
    return kept("token_files", path, lambda: WordIds(path))


def _fs(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


#: Documents in a shard at most: bounds the coding of boundaries where documents are tiny.
SHARD_DOCS = 1 << 18


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 4_000_000) -> DataFrame:
    """Write shards under `out` in ascending doc_id order; returns (part, seq, path, n_docs, n_ids, start), a table in the shared folder.

    shard_ids bounds a shard, and so a task's memory, but for a single document of more. Null text counts as empty (its
    end id alone), null doc_ids come first, equal doc_ids are ordered by text, and many of them are dealt out by the
    texts' first letters; an empty table gives no shards. To the driver comes one sum for each task that wrote.
    """
    spark = docs.sparkSession
    rows = texts_of(docs, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        from pyspark import TaskContext

        words = word_ids(tokenizer_path)
        part, names, counts, parts, total, seq = TaskContext.get().partitionId(), [], [], [], 0, 0

        def flush():
            fs, base = _fs(out)
            fs.create_dir(base, recursive=True)
            name = f"shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(pack_shard(names, counts, np.concatenate(parts)))
            return {"part": [part], "seq": [seq], "path": [f"{out}/{name}"], "n_docs": [len(names)], "n_ids": [total]}

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.frombuffer(words.encode(text) + end_id.to_bytes(4, "little"), "<u4")
                if total and (total + len(ids) > shard_ids or len(names) >= SHARD_DOCS):
                    yield flush()
                    names, counts, parts, total, seq = [], [], [], 0, seq + 1
                names.append(doc_id)
                counts.append(len(ids))
                parts.append(ids)
                total += len(ids)
        if names:
            yield flush()

    shards = materialize(map_rows(rows, run, "part int, seq int, path string, n_docs long, n_ids long", owner="token_files"), "shards")
    sums = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect()))
    before = spark.createDataFrame([(p, s) for (p, _), s in zip(sums, np.cumsum([0, *(n for _, n in sums)]).tolist())], "part int, before long")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    # one number for each task that wrote a shard
    return shards.join(F.broadcast(before), "part").select("part", "seq", "path", "n_docs", "n_ids", (F.col("before") + F.col("start")).alias("start"))


def read_token_files(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, where asked for, ids.

    Boundaries and doc_ids come from the coded sequences one document at a time, by select and the next set bit; no table of them is made."""

    def run(batches):
        names = ("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
        for b in batches:
            for path, start in zip(b["path"], b["start"]):
                fs, name = _fs(path)
                with fs.open_input_file(name) as f:
                    shard = Shard(f.read())
                out = {n: [] for n in names}
                for doc_id, low, high in shard.documents():
                    ids = shard.ids[low:high]
                    for n, v in zip(names, (doc_id, start + low, high - low, zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None)):
                        out[n].append(v)
                    if len(out["doc_id"]) == 2048:
                        yield out
                        out = {n: [] for n in names}
                yield out

    rows = shards.select("path", "start")
    rows = rows.repartition(max(1, rows.count()), "path")  # the rows are small and the files are not: a number that is given is not coalesced
    return map_rows(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def encode_to_files(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Write, then read back; `out` is a new folder in the shared one unless given."""
    return read_token_files(write_token_files(docs, tokenizer_path, out or scratch(docs.sparkSession, "tokens"), end_id), with_ids)
