"""Finding files, dispatching on their format, decoding text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deckflow.session import file_store, materialize, materialize_measured

# --- fixed values -----------------------------------------------------------
EXTENSIONS = (".pdf", ".pptx", ".ppt", ".md", ".txt")
SYNC_ARTIFACTS = r"^(\.syncthing|syncthing-)"
SIDECAR_SUFFIX = ".ocr.md"
PAGE_FORMATS = (".pdf",)
SLIDE_FORMATS = (".pptx", ".ppt")
TEXT_FORMATS = (".md", ".txt")
# ----------------------------------------------------------------------------

# Names that a task hands on at a time.
LISTING_PAGE = 10_000


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``folder``, ``name``, ``stem`` and ``ext`` (with its dot) of a path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract("name", r"[^.](\.[^.]*)$", 1)
    return (
        df.withColumn("name", name)
        .withColumn("folder", F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
        .withColumn("ext", F.when(ext == ".", F.lit("")).otherwise(ext))
        .withColumn(
            "stem", F.substr("name", F.lit(1), (F.length("name") - F.length("ext")).cast("int"))
        )
    )


def extension_rank(name: Column, extensions=EXTENSIONS) -> Column:
    """Position in the allow-list of the first extension that ends ``name``."""
    ranks = [F.when(name.endswith(e), F.lit(k)) for k, e in enumerate(extensions)]
    return F.coalesce(*ranks)


def by_extension(files: DataFrame, extensions=EXTENSIONS, name: str = "name") -> DataFrame:
    """Keep files on the case-sensitive allow-list and add ``ext_rank``."""
    ranked = files.withColumn("ext_rank", extension_rank(F.col(name), extensions))
    return ranked.where(F.col("ext_rank").isNotNull())


def without_artifacts(files: DataFrame, name: str = "name") -> DataFrame:
    """Drop what a sync tool leaves behind, and sidecars of scanned documents."""
    return files.where(
        ~F.col(name).rlike(SYNC_ARTIFACTS) & ~F.col(name).endswith(SIDECAR_SUFFIX)
    )


def with_format(files: DataFrame, ext: str = "ext") -> DataFrame:
    """Add the reader a file needs, or an error for an unknown extension."""
    e = F.lower(F.col(ext))
    fmt = (
        F.when(e.isin(*PAGE_FORMATS), "pages")
        .when(e.isin(*SLIDE_FORMATS), "slides")
        .when(e.isin(*TEXT_FORMATS), "text")
    )
    return files.withColumn("format", fmt).withColumn(
        "error", F.when(fmt.isNull(), F.concat(F.lit("unsupported: "), e))
    )


def decode_text(content: Column) -> Column:
    """UTF-8 text of raw bytes; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _store(root: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of ``root``, its path there, and what full names have before such paths."""
    fs, path = file_store(root)
    return fs, path, root[: -len(path)] if "://" in root and root.endswith(path) else ""


LISTING_SCHEMA = "path string, length bigint, modified bigint"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modified)`` of every file below ``root``, whatever its name.

    ``modified`` counts nanoseconds. Folders are listed in tasks, one round for each level of
    the tree, and a long one is handed on in pages. (Spark's own listing leaves out names
    that begin with ``_`` or a dot.)
    """

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, before = _store(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = fs.get_file_info(pafs.FileSelector(folder.removeprefix(before)))
                for at in range(0, len(found), LISTING_PAGE):
                    some = found[at : at + LISTING_PAGE]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([before + f.path for f in some], pa.string()),
                            pa.array([f.size for f in some], pa.int64()),
                            pa.array([f.mtime_ns for f in some], pa.int64()),
                            pa.array([f.type == pafs.FileType.Directory for f in some], pa.bool_()),
                        ],
                        ["path", "length", "modified", "is_folder"],
                    )

    _, top, before = _store(root)
    level, out = spark.createDataFrame([(before + top.rstrip("/"),)], "path string"), None
    while True:
        found, seen = materialize_measured(
            level.mapInArrow(children, f"{LISTING_SCHEMA}, is_folder boolean"), "listing", folders=F.count_if("is_folder")
        )
        files = found.where("NOT is_folder").drop("is_folder")
        out = files if out is None else out.unionByName(files)
        if not seen["folders"]:
            return out
        level = _dealt(found.where("is_folder").select("path"))


def _dealt(paths: DataFrame) -> DataFrame:
    """Names spread over tasks: they are few bytes, what they name is many."""
    return paths.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _opened(paths: DataFrame, root: str, content: bool) -> DataFrame:
    """Add ``sha256``, ``error`` and, if asked for, ``content``; a file that cannot be read has an error only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _, before = _store(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                data, error = None, None
                try:
                    with fs.open_input_file(path.removeprefix(before)) as file:
                        data = file.readall()
                except OSError as e:  # gone, or not ours to read
                    error = f"{type(e).__name__}: {e}"
                digest = None if data is None else hashlib.sha256(data).hexdigest()
                columns = [pa.array([x], pa.string()) for x in (path, digest, error)]
                names = ["path", "sha256", "error"]
                if content:
                    columns, names = [*columns, pa.array([data], pa.binary())], [*names, "content"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "path string, sha256 string, error string" + ", content binary" * content
    return _dealt(paths).mapInArrow(read, schema)


HASHES_SCHEMA = "path string, length bigint, modified bigint, sha256 string, run bigint"


def find_files(listing: DataFrame, root: str, extensions=EXTENSIONS, known: DataFrame | None = None) -> DataFrame:
    """The supported files of a listing: path parts and the hash of the content (null if unreadable).

    ``known`` has hashes of earlier runs (``HASHES_SCHEMA``). A file whose length and time of
    change are those of its last known hash keeps it and is not opened; ``hashed`` tells the
    others. Without ``known`` every file is read.
    """
    named = without_artifacts(by_extension(with_path_parts(listing), extensions))
    if known is None:
        fresh = _opened(named.select("path"), root, content=False).drop("error")
        return named.join(fresh, "path").withColumn("hashed", F.lit(True))
    last = known.groupBy("path").agg(F.max_by(F.struct("length", "modified", "sha256"), "run").alias("last"))
    looked = named.join(last, "path", "left")
    same = (F.col("length") == F.col("last.length")) & (F.col("modified") == F.col("last.modified"))
    looked = materialize(looked.withColumn("same", F.coalesce(same & F.col("last.sha256").isNotNull(), F.lit(False))), "looked_up")
    kept = looked.where("same").withColumn("sha256", F.col("last.sha256"))
    moved = looked.where("NOT same")
    moved = moved.join(_opened(moved.select("path"), root, content=False).drop("error"), "path")
    both = kept.withColumn("hashed", F.lit(False)).unionByName(moved.withColumn("hashed", F.lit(True)))
    return both.drop("last", "same")


def read_content(files: DataFrame, root: str) -> DataFrame:
    """``(path, content, error)`` of files below ``root``, each opened by its name.

    A file that is gone meanwhile, or cannot be read, has an error and no content.
    """
    return _opened(files.select("path"), root, content=True).drop("sha256")


def read_sidecars(listing: DataFrame, root: str, documents: DataFrame) -> DataFrame:
    """Text read off scanned documents beforehand: ``(folder, stem, sidecar)``, for ``documents`` alone."""
    parts = with_path_parts(listing.select("path").where(F.col("path").endswith(SIDECAR_SUFFIX)))
    cut = (F.length("name") - len(SIDECAR_SUFFIX)).cast("int")
    named = parts.select("path", "folder", F.substr("name", F.lit(1), cut).alias("stem"))
    named = named.join(documents.select("folder", "stem").distinct(), ["folder", "stem"], "left_semi")
    texts = read_content(named, root).where("error IS NULL").select("path", decode_text(F.col("content")).alias("sidecar"))
    return named.join(texts, "path").select("folder", "stem", "sidecar")
