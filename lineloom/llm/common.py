"""Shared helpers: durable intermediate tables, word splitting, hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split on ASCII white space: bytes.split() cuts at exactly
#: \x20 and \x09-\x0D, and bytes.lower() changes A-Z alone.
CHUNK_WORDS = 400_000
#: Bits of a filter that spares most rows a shuffle; its size is fixed.
FILTER_BITS = 1 << 26
#: Bytes of whole rows that are on their way to a Python worker at once.
BATCH_BYTES = 1 << 22
_local: dict[SparkSession, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets a temporary one; others may not go on."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark not in _local:
        _local[spark] = tempfile.mkdtemp(prefix="lineloom-")
    return _local[spark]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_caches: dict[str, object] = {}


def enter(name: str, clear=None) -> None:
    """Called by a task when it begins: what other operators have left in this worker process (`clear` frees it) goes."""
    others = [k for k in _caches if k != name]
    for k in others:
        _caches.pop(k)()
    if others:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    if clear:
        _caches[name] = clear


def keep_freed(most: int = 1 << 26) -> None:
    """For tasks of many short-lived arrays: up to `most` freed bytes stay with the process, else each array's pages may be asked for anew."""
    with contextlib.suppress(OSError, AttributeError):
        c = ctypes.CDLL(None)
        c.mallopt(-3, most // 2)  # M_MMAP_THRESHOLD
        c.mallopt(-1, most)  # M_TRIM_THRESHOLD


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless it has a bound of its own.

    By their number alone a whole partition of texts is one batch, held several times over by the JVM and the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Intermediate Parquet tables in the shared folder, so that a lost executor costs no recomputation.

    keep(df) writes and rereads; drop(df) deletes a table that no later plan reads. What a lazy result still reads goes
    when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, files = self._path(self.root)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            p, files = self._path(path)
            files.delete(p, True)

    def clear(self) -> None:
        """Delete all tables."""
        p, files = self._path(self.root)
        files.delete(p, True)

    def _path(self, path: str):
        """A Hadoop path and its file system."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


class Bits:
    """Filter of longs by a bitmap of fixed size, which is broadcast: passes all that are in `ids`, and few others.

    With more ids than bits it lets everything pass.
    """

    def __init__(self, ids: DataFrame):
        """ids: one column of longs without nulls."""

        def run(batches):
            held = np.zeros(FILTER_BITS >> 6, np.uint64)
            for b in batches:
                at = self.of(b.column(0).to_numpy())
                np.bitwise_or.at(held, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].view(np.int64))], names=["w", "v"])

        got = ids.mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
        bitmap = np.zeros(FILTER_BITS >> 6, np.int64)
        bitmap[got["w"].to_numpy()] = got["v"].to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @staticmethod
    def of(x: np.ndarray) -> np.ndarray:
        return (mix(x.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(40)).astype(np.int64) % FILTER_BITS

    def __getstate__(self):
        return {"shared": self.shared} if hasattr(self, "shared") else {}

    def passing(self, ids: list[int | None] | np.ndarray) -> np.ndarray:
        """Places of the ids that may be in; a null always may."""
        none = np.array([x is None for x in ids], bool) if isinstance(ids, list) else np.zeros(len(ids), bool)
        at = self.of(np.array([x or 0 for x in ids], np.int64) if isinstance(ids, list) else ids)
        return np.flatnonzero(none | ((self.shared.value.view(np.uint64)[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer than k words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(k, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def long_array(parts: list[np.ndarray]) -> pa.Array:
    """array<bigint> column of uint64 or int64 arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, one table per key; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_pylist()
        cuts = [0, *(i for i in range(1, len(k)) if k[i] != k[i - 1]), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0].as_py() != k[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node of the links a-b that isn't the smallest of its component; root is."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while len(x):
        # larger roots hang on smaller ones; each round at least halves the roots that have links
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := low[low], low):
            low = up
        x, y = low[x], low[y]
        x, y = x[x != y], y[x != y]
    some = np.flatnonzero(low != np.arange(len(ids)))
    return ids[some], ids[low[some]]


def _forests(held: int):
    """Links of a task as forests; more than `held` links are never in memory beside a batch."""

    def run(batches):
        a = b = np.empty(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        for batch in batches:
            a, b = np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy()))
            if len(a) > held:
                a, b = forest(a, b)
                if 2 * len(a) > held:
                    yield out()
                    a = b = np.empty(0, np.int64)
        a, b = forest(a, b)
        yield out()

    return run


def components(scratch: Scratch, edges: DataFrame, drop_input: bool = False, held: int = 1 << 19) -> DataFrame:
    """Connected components of undirected links (a, b), a table: one row (id, root) for each id in a link, root the smallest id.

    Tasks of about `held` links replace theirs by forests, as long as that halves the links; a graph of one task is done
    then. Between forests, a large-star and a small-star step; each is two partial aggregates and a joinable shuffle, so a
    hub of any degree is combined before it moves. Every step is a table in the shared folder.
    """
    given, own = edges, drop_input
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    while True:
        n = edges.count()
        tasks = max(1, -(-n // held))
        after = scratch.keep(edges.coalesce(tasks).mapInArrow(_forests(held), "a long, b long"))
        if own:
            scratch.drop(given)
        given, own, edges = after, True, after
        # stars already: no node hangs on two, or is hung on and hangs itself
        if tasks == 1 or _are_stars(edges):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            )
        if 2 * edges.count() <= n:
            continue
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a table of its own, so that both sides of the join are shuffled and a hub's rows can be split
        low = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        after = scratch.keep(small)
        scratch.drop(edges)
        scratch.drop(low)
        given, edges = after, after


def _are_stars(edges: DataFrame) -> bool:
    both = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    both = both.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return both.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()
