"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where it is unset, as in tests on one machine, a
    temporary one; on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
    return sc._jsc.sc().getCheckpointDir().get()


_FOLDERS: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder, or in the one of temporary() while that is open."""
    return f"{_FOLDERS[-1] if _FOLDERS else shared_dir(spark).rstrip('/') + '/lattica'}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession, tag: str):
    """All tables that are written within go when it ends: for a step whose result is stored elsewhere."""
    _FOLDERS.append(scratch(spark, tag))
    try:
        yield
    finally:
        remove(spark, _FOLDERS.pop())


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more: it does so when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame | None) -> None:
    """Remove the files of what materialize() wrote, of one table or a union, and nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()} if table is not None else ():
        remove(table.sparkSession, folder)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text read as empty; other columns are not read at all."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def spread(df: DataFrame, least_bytes: int = 4 << 20) -> DataFrame:
    """A small input over all cores: a file of one row group is one task's otherwise. By the planner's estimate, so nothing runs
    for it, and inputs of `least_bytes` for each core or more stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * least_bytes else df


_KEPT: dict[str, dict] = {}


def kept(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a Python process keeps for later tasks of the same operator."""
    own = _KEPT.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def keep_only(owner: str | None = None) -> None:
    """Drop what tasks of other operators have kept in this Python process, and give its memory back: workers live longer than an operator."""
    others = [n for n in _KEPT if n != owner]
    for name in others:
        del _KEPT[name]
    if others:
        gc.collect()
        with suppress(AttributeError, OSError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


#: Bytes of texts that are worked on at once, but for a single row of more.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows, and fewer where texts are long."""
    if batch.nbytes <= SLICE_BYTES:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
        return
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1
        end = max(at + 1, min(at + rows, end))
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str, rows: int = 256, owner: str | None = None) -> DataFrame:
    """mapInArrow over column lists: fn gets dicts of Python lists (binary and arrays as numpy where asked) and yields dicts of lists.
    owner: whose kept() things the tasks use."""
    fields = T._parse_datatype_string(schema)
    names = fields.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches):
        keep_only(owner)

        def small():
            for b in batches:
                for part in slices(b, rows):
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        for out in fn(small()):
            if len(out[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, fields)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


_BASE = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)


_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd constant, or of its inverse modulo 2 ** 64; those of short texts are kept."""
    known = _POWERS.get(inverse)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 16:
            _POWERS[inverse] = known
    return known[:n]


_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = _IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = True


class WordHasher:
    """64-bit hashes of words, many texts at a time. A word is a run of letters and digits of the lower-case
    text: ASCII punctuation and white space separate words, everything beyond ASCII belongs to them."""

    def __init__(self):
        self.pow = powers(1 << 16)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All word hashes, in order, and the number of words of each text."""
        data = [t.lower().encode() for t in texts]
        buf = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
        word = _IN_WORD[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # the first and last bytes are line ends
        starts, ends = edge[::2], edge[1::2]
        counts = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)])))
        if not len(starts):
            return np.zeros(0, np.uint64), counts
        length = ends - starts
        if (most := int(length.max())) > len(self.pow):
            self.pow = powers(2 * most)
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        h = np.add.reduceat((buf[word].astype(np.uint64) + np.uint64(1)) * self.pow[place], first)
        return mix64(h ^ (length.astype(np.uint64) << np.uint64(40))), counts

    def shingles(self, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words and their number per text; a text of fewer than k words has one run of all of them (none when empty)."""
        return shingle_hashes(*self.words(texts), k)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    if not n:
        return np.zeros(0, np.uint64), out_counts
    with np.errstate(over="ignore"):
        mul = np.uint64(0x9FB21C651E98DF25)
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        first = np.cumsum(counts) - counts
        end = np.repeat(first + counts, counts)
        at = np.arange(n)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * mul + np.where(at + j < end, padded[j : j + n], np.uint64(0))
        h = mix64(h)
        keep = (at + k <= end) | ((np.repeat(counts, counts) < k) & (at == np.repeat(first, counts)))
    return h[keep], out_counts
