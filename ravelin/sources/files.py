"""File trees as tables: which files count, their text, their chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.config import Retrieval
from ravelin.functions import rules
from ravelin.functions import text as T
from ravelin.operators import chunking, dedup
from ravelin.sources import extract as X


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]*$", 0))


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def wanted_name(name: Column, ignored: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether a file's name passes: no denied extension, not hidden, no leftover of an editor, no ignored pattern."""
    return ~extension(name).isin(rules.IGNORED_EXTENSIONS) & ~name.startswith(".") & ~name.startswith("~$") & ~T.contains_any(name, list(ignored))


def wanted_folders(inside: Column, ignored: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether no folder of a path below the root is hidden or ignored. Patterns are parts of names, without regard to case."""
    folders = F.slice(F.split(inside, "/"), 1, F.greatest(F.size(F.split(inside, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda f: f.startswith(".") | f.isin(rules.IGNORED_DIRECTORIES) | T.contains_any(f, list(ignored)))


def enough_text(text: Column) -> Column:
    return F.octet_length(F.btrim(text, F.lit(T.WHITE))) >= chunking.LEAST_BYTES


def scanned(spark: SparkSession, root: str, settings: Retrieval = Retrieval()) -> DataFrame:
    """path, inside (the path below the root), content of all files that count. Names are filtered before anything is extracted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return _filtered(files, spark, root, settings)


def _filtered(files: DataFrame, spark: SparkSession, root: str, settings: Retrieval) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    below = F.regexp_replace("path", r"^file:/+", "/")
    named = files.withColumn("path", below).withColumn("inside", F.substring("path", len(re.sub(r"^file:/+", "/", full).rstrip("/")) + 2, 2**31 - 1))
    return named.where(wanted_folders(F.col("inside"), settings.ignored_dirs) & wanted_name(base(F.col("inside")), settings.ignored_file_patterns)).select("path", "inside", "content")


def texts(files: DataFrame) -> DataFrame:
    """path, filename, text, extract_error of files with path and content. A file that can't be read has a null text and the reason."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows.append((path, X.basename(path), X.extract(ext, data or b""), None))
                except ValueError as e:
                    rows.append((path, X.basename(path), None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["path", "filename", "text", "extract_error"])

    return files.select("path", extension(base(F.col("path"))).alias("e"), "content").mapInArrow(read, "path string, filename string, text string, extract_error string")


def file_chunks(files: DataFrame, settings: Retrieval = Retrieval()) -> DataFrame:
    """id, filename, path, chunk_ord, text: chunks of all files, capped per file, copies within a file name left out. Indexing again gives the same identifiers."""
    read = texts(files).where("text is not null")
    cut = chunking.chunked(read, "path", "text", settings.chunk_size, settings.chunk_overlap)
    capped = dedup.capped_per_file(cut, "path", [F.col("chunk_ord")], settings.max_chunks_per_file, settings.core_file_patterns)

    @F.arrow_udf("string")
    def cited(paths: pa.Array) -> pa.Array:
        return pa.array([X.basename(p) for p in paths.to_pylist()], pa.string())

    named = capped.withColumn("filename", cited("path"))
    kept = dedup.without_copies(named, [F.col("path"), F.col("chunk_ord")])
    return kept.select(T.chunk_id(F.col("path"), F.col("chunk_ord").cast("string"), F.col("text")).alias("id"), "filename", "path", "chunk_ord", "text")
