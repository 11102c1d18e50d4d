"""What several operators share: stored steps, table reading, token hashes.

Python functions run in executors are pickled by value (``by_value``), so a
worker needs numpy, pyarrow and xxhash but not this package.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.session import ensure_checkpoint_dir


def by_value(*names: str) -> None:
    """Pickle the functions of these modules by value."""
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage is cut, a
    lost executor loses nothing, and later branches read instead of repeating."""
    spark, where = df.sparkSession, shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


ARROW_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batches to ``ARROW_ROWS`` rows: texts are long,
    and a worker holds a batch several times over while it works on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= ARROW_ROWS:
        df.sparkSession.conf.set(key, str(ARROW_ROWS))
    return df


def text_key(text) -> F.Column:
    """A second key beside the document id, so that rows which share an id are
    told apart by their texts (rows equal in both are interchangeable): the 128
    bits of the text's md5, as 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


K1, K2, K3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9  # fixed values: odd 64-bit multipliers
K4 = 0x94D049BB133111EB  # fixed value


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of uint64 values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(K3)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(K4)
    return x ^ (x >> np.uint64(31))


def mix(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Order-sensitive 64-bit hash of two uint64 arrays."""
    return scramble(scramble(a * np.uint64(K1) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)) + b * np.uint64(K2))


def span_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of words[i : i + length] for every i where it fits."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size = scramble(words), 1
    while size * 2 <= length:
        h = mix(h[:-size], h[size:], size)
        size *= 2
    return mix(h[:n], h[length - size: length - size + n], length)


SPACE = b"\t\n\x0b\x0c\r "
LONG_WORD = 1 << 15


def _byte_values() -> np.ndarray:
    return scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(K1))


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, (K4 & ~7) | 5, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class WordHash:
    """Splits texts (bytes) into words and hashes each to 64 bits, whole
    batches at a time: the bytes' random values times powers of an odd number,
    summed per word, scrambled.

    ``separators`` are the bytes between words; ``fold`` treats A-Z as a-z.
    """

    def __init__(self, separators: bytes = SPACE, fold: bool = False):
        self.is_sep = np.zeros(256, bool)
        self.is_sep[list(separators)] = True
        self.value, self.power = _byte_values(), _powers(LONG_WORD)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.gap = bytes(separators[:1])
        self.fold = fold

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text."""
        buf = self.gap.join([t or b"" for t in texts]) + self.gap
        data = np.frombuffer(buf, np.uint8)
        ends = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64))
        sep = self.is_sep[data]
        inside = ~sep
        first = inside.copy()
        first[1:] &= sep[:-1]
        begin = np.flatnonzero(first)
        counts = np.diff(np.searchsorted(begin, ends), prepend=0)
        if not len(begin):
            return np.zeros(0, np.uint64), counts
        stop = np.flatnonzero(sep[1:] & inside[:-1]) + 1
        size = stop - begin
        at = np.cumsum(size) - size
        rel = np.arange(size.sum()) - np.repeat(at, size)
        h = scramble(np.add.reduceat(self.value[data[inside]] * self.power[rel & (LONG_WORD - 1)], at)
                     + size.astype(np.uint64))
        for i in np.flatnonzero(size > LONG_WORD):  # beyond the powers: hashed by themselves
            import xxhash
            word = buf[begin[i]: stop[i]]
            h[i] = xxhash.xxh64_intdigest(word.lower() if self.fold else word)
        return h, counts


def chunks(batch, sizes, limit: int):
    """Row ranges [a, b) of a batch whose sizes sum to about ``limit``."""
    a, total = 0, 0
    for i, s in enumerate(sizes):
        if i > a and total + s > limit:
            yield a, i
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield a, len(sizes)
