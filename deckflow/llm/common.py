"""What the operators share: reading tables, slices of Arrow batches, shared files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.session import file_store

#: Characters of text that one numpy step works on; bounds a worker's memory.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, so other columns can have any names."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def slices(
    batch: pa.RecordBatch, chars: int = SLICE_CHARS, text_col: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Cut a batch by its text column so that a piece holds about ``chars`` characters.

    A longer text is a piece of its own; no text is cut.
    """
    lengths = pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if i > first and held + n > chars:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


#: The file system of a folder in the shared store, and the path inside it.
shared_files = file_store


_remembered = None


def only(memory):
    """``memory``, which has ``clear()``; another one that this process was given before is cleared.

    A worker process outlives its task and runs those of other operators. What one of them
    remembers of its words is not kept beside what the next one does.
    """
    global _remembered
    if _remembered is not memory:
        if _remembered is not None:
            _remembered.clear()
        _remembered = memory
    return memory


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound per worker process."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        only(self)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One per process, so that words last over tasks.
WORD_HASHES = WordHashes()


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def keep_rows(df: DataFrame, decide: Callable[[list[str | None]], list[bool]], text_col: str) -> DataFrame:
    """The rows whose text ``decide`` keeps, in one pass with all their columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text_col=text_col):
                texts = some.column(text_col).cast(pa.string()).to_pylist()
                yield some.filter(pa.array(decide(texts), pa.bool_()))

    return df.mapInArrow(rows, df.schema)
