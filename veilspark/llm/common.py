"""Helpers shared by the operators: slicing of Arrow batches, byte-level words, shared tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step works on; a single longer text is one step of its own.
SLICE_BYTES = 2 << 20


def sliced(batches: Iterable[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``budget`` bytes of ``column``, and at least one row; at the end the worker gives memory back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + budget, "right")))
            yield batch.slice(start, end - start)
            start = end
    trimmed()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (case is ignored)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one on a local master and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation, and the
    planner knows the table's size, so that it broadcasts only what is small.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for at in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does so when the driver collects its garbage."""
    for _ in range(2):  # what the first round frees lets go of the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def trimmed() -> None:
    """Give memory that a worker no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(spark: SparkSession) -> None:
    """Small Arrow batches and small row groups, so that a task of long texts holds few of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    spark.conf.set("parquet.block.size", 16 << 20)


# -- words and hashes ---------------------------------------------------------------------------

#: Seed of the words' hashes.
SEED = 0x5EED0F17

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Powers that a process keeps; longer ones, for single long texts, are made anew.
KEPT_POWERS = 1 << 22
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """base**0.. and base**-0.. modulo 2**64, at least ``n`` of each; the process keeps up to KEPT_POWERS of them."""
    out = []
    for b in (int(base), pow(int(base), -1, 1 << 64)):
        if (x := _powers.get(b)) is None or len(x) < n:
            x = np.full(max(n, 1 << 16), b, np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                x = np.multiply.accumulate(x)
            if n <= KEPT_POWERS:
                _powers[b] = x
        out.append(x)
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: True for the bytes that end a word: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for the bytes that end a word of letters and digits: all of ASCII but 0-9, a-z (and A-Z, which become a-z).
PLAIN = np.ones(256, bool)
PLAIN[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = False


def word_codes(texts: list[bytes], ends: np.ndarray = SPACE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of ``texts``, which of them stands at each place, and the number of words of each text.

    A-Z count as a-z; ``ends`` tells the bytes that no word holds.  Words are
    compared byte by byte.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    edges = np.flatnonzero(np.diff(ends[data].view(np.int8), prepend=np.int8(1)))
    counts = np.diff(np.searchsorted(edges[::2], limits, "left"), prepend=0)
    if not len(edges):
        return pa.array([], pa.binary()), np.zeros(0, np.int32), counts
    runs = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])  # a word, what follows it, a word, ...
    found = runs.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False), counts


#: Bytes of the longest word that is its own hash, with its length in the eighth byte.
OWN = 7
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(OWN + 1)], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all ``texts`` in order, and the number of words of each text.

    A-Z count as a-z; words are runs of bytes other than \\x20 and \\x09-\\x0D.
    Words of up to OWN bytes never share a hash with each other; of longer ones
    the whole word is hashed with a seed.  Texts are taken SLICE_BYTES at a time,
    as a step needs some twenty times its bytes.
    """
    sizes = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    out, start = [], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE_BYTES, "right")))
        out.append(_word_hashes(texts[start:end]))
        start = end
    if len(out) == 1:
        return out[0]
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    body = b"\n".join(texts).lower() + b"\n" * 8
    data = np.frombuffer(body, np.uint8)
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    edges = np.flatnonzero(np.diff(SPACE[data].view(np.int8), prepend=np.int8(1)))
    starts, sizes = edges[::2], np.diff(edges)[::2]
    eight = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))  # the eight bytes from each place on
    short = np.minimum(sizes, OWN)
    hashes = mixed(eight[starts] & _MASKS[short] | sizes.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(sizes > OWN)
    if len(long):
        begins, digest = starts[long], xxhash.xxh3_64_intdigest
        cuts = zip(begins.tolist(), (begins + sizes[long]).tolist(), strict=True)
        hashes[long] = np.fromiter((digest(body[i:j], SEED) for i, j in cuts), np.uint64, len(long))
    return hashes, np.diff(np.searchsorted(starts, limits, "left"), prepend=0)
