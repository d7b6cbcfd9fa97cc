"""Token files: flat unsigned integers, 64-bit document offsets, read by memory map.

Documents are dealt into ranges of the id order; the task of a range writes

* ``<name>.ids``      all token ids of its documents, little-endian ``uint16`` (``uint32``
  where the vocabulary needs it), nothing between documents,
* ``<name>.offsets``  n + 1 little-endian ``int64``: where each document starts in it,
* ``<name>.docs``     n little-endian ``int64`` document ids (zero where it is null).

A manifest (one row per file) names the files of the tasks that ended well, so what a
lost task leaves is never read. The place of a file in the whole corpus is the prefix
sum of the token counts before it.

Defined cases: a null or empty text has the end id only; null ids come first; rows with
one id stand next to each other, ordered by a hash of their text; an empty table makes
an empty manifest; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckflow.llm.common import shared_files, slices, text_rows
from deckflow.llm.tokens import encoder
from deckflow.session import materialize, scratch_path

MANIFEST = (
    "part int, name string, width int, n_docs long, n_null_ids long, n_tokens long"
)
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


def write(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the token files of ``docs`` in id order; returns the stored manifest.

    ``folder`` must be one that all executors reach (default: in the shared folder). The
    manifest gains ``base``, the number of ids in all files before, and ``folder``.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token_files")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = shared_files(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        tokens, offsets, ids, nulls, out = encoder(tokenizer), [0], [], 0, None
        end = np.array([end_id], tokens.dtype).tobytes()
        for batch in batches:
            for some in slices(batch):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}.ids")
                for got in tokens.encode(some.column("text").to_pylist()):
                    out.write(got + end)
                    offsets.append(offsets[-1] + len(got) // len(end) + 1)
                of = some.column("doc_id")
                nulls += of.null_count
                ids.append(of.fill_null(0).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        for kind, values in (("offsets", offsets), ("docs", np.concatenate(ids))):
            with fs.open_output_stream(f"{path}/{name}.{kind}") as file:
                file.write(np.asarray(values, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "name": [name],
                "width": pa.array([len(end)], pa.int32()),
                "n_docs": [len(offsets) - 1],
                "n_null_ids": [nulls],
                "n_tokens": [int(offsets[-1])],
            }
        )

    order = ["doc_id", F.xxhash64("text")]
    ranges = text_rows(docs, id_col, text_col).repartitionByRange(*order)
    written = ranges.sortWithinPartitions(*order).mapInArrow(files, MANIFEST)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: the only step over the whole corpus in one task.
    return materialize(written, "token_manifest").select(
        "*",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"),
        F.lit(folder).alias("folder"),
    )


def _mapped(fs, path: str) -> np.ndarray:
    """The bytes of a file, mapped where the store is a mounted one."""
    if fs.type_name == "local":
        return np.frombuffer(pa.memory_map(path).read_buffer(), np.uint8)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), np.uint8)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, int, np.ndarray]]:
    """Ids of documents, their offsets, the base and the mapped token ids, file by file."""
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = shared_files(row["folder"])
            path = f"{path}/{row['name']}"
            ids = _mapped(fs, f"{path}.ids").view(f"<u{row['width']}")
            offsets = _mapped(fs, f"{path}.offsets").view("<i8")
            docs = [None] * row["n_null_ids"] + _mapped(fs, f"{path}.docs").view("<i8")[row["n_null_ids"] :].tolist()
            yield docs, offsets, row["base"], ids


def _by_file(manifest: DataFrame) -> DataFrame:
    """A task for each file: its rows are few, what they name is large."""
    return manifest.repartition(max(1, manifest.count()))


def read(manifest: DataFrame) -> DataFrame:
    """The documents of token files: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (bytes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, offsets, base, ids in _documents(batches):
            for at in range(0, len(docs), 1000):
                cut = offsets[at : at + 1001]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(docs[at : at + 1000], pa.int64()),
                        "start": base + cut[:-1],
                        "n_tokens": np.diff(cut),
                        "ids": pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    }
                )

    return _by_file(manifest).mapInArrow(rows, DOCUMENT)


def digests(manifest: DataFrame) -> DataFrame:
    """As ``read``, with the crc32 of the ids as 32-bit integers instead of the ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, offsets, base, ids in _documents(batches):
            for at in range(0, len(docs), 10_000):
                cut = offsets[at : at + 10_001]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(docs[at : at + 10_000], pa.int64()),
                        "start": base + cut[:-1],
                        "n_tokens": np.diff(cut),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    return _by_file(manifest).mapInArrow(
        rows, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
