"""Source trees as DataFrames."""

from __future__ import annotations

import os

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions import paths as P
from quarry.plans.extract import utf8_text


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _TreeReader(DataSourceReader):
    """Lists folders only until there are enough of them to share out; tasks walk and read the rest. Roots are paths or URIs."""

    def __init__(self, options):
        self.uri = options["path"]
        self.target = int(options.get("partitions", "64"))
        limit = options.get("maxBytes", str(P.MAX_FILE_BYTES))
        self.limit = int(limit) if limit else None

    def _open(self) -> tuple[FileSystem, str]:
        store, root = FileSystem.from_uri(self.uri) if ":" in self.uri else (LocalFileSystem(), os.path.abspath(self.uri))
        return store, root.rstrip("/")

    @staticmethod
    def _inside(store: FileSystem, folder: str) -> tuple[list[str], list[str]]:
        """Folders and files of a folder in order, those of ignored names left out."""
        found = sorted(store.get_file_info(FileSelector(folder)), key=lambda i: i.base_name)
        local = isinstance(store, LocalFileSystem)
        folders = [i.path for i in found if i.type == FileType.Directory and i.base_name not in P.IGNORED_DIRS and not (local and os.path.islink(i.path))]
        return folders, [i.path for i in found if i.type == FileType.File and i.size > 0]

    def partitions(self):
        store, root = self._open()
        shallow, open_folders = [], [root]
        while open_folders and len(open_folders) < self.target:
            below = [child for folder in open_folders for child in self._inside(store, folder)[0]]
            shallow += open_folders
            open_folders = below
        return [_Folder(f, False) for f in shallow] + [_Folder(f, True) for f in open_folders] or [_Folder(root, False)]

    def read(self, partition):
        store, root = self._open()
        waiting = [partition.path]
        while waiting:
            folders, files = self._inside(store, waiting.pop())
            waiting += reversed(folders if partition.deep else [])
            for path in files:
                size = store.get_file_info(path).size
                if self.limit is None or size <= self.limit:
                    with store.open_input_stream(path, compression=None) as handle:
                        yield path[len(root) + 1:], size, handle.read()


class SourceTree(DataSource):
    """Files of a folder every executor can see, dotted and underscored names included."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema):
        return _TreeReader(self.options)


def read_files(spark: SparkSession, root: str, max_bytes: int | None = P.MAX_FILE_BYTES) -> DataFrame:
    """path (relative), length, content of every file, whatever its name begins with. max_bytes: larger files are left out; None
    takes them all."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", root).option("maxBytes", str(max_bytes or "")).load()


def ignore_patterns(root: str) -> list[str]:
    """Lines of the root ignore file; nested ones do not count."""
    store, folder = FileSystem.from_uri(root) if ":" in root else (LocalFileSystem(), os.path.abspath(root))
    path = f"{folder.rstrip('/')}/.gitignore"
    if store.get_file_info(path).type != FileType.File:
        return []
    with store.open_input_stream(path, compression=None) as handle:
        return handle.read().decode("utf-8", "replace").splitlines()


def keep_indexable(files: DataFrame, patterns: list[str] = (), only: str | None = None, max_bytes: int | None = P.MAX_FILE_BYTES) -> DataFrame:
    """Classify and filter rows (path, length, ...): adds lang, is_data, is_test."""
    code, data = P.code_language(F.col("path")), P.data_language(F.col("path"))
    typed = files.withColumn("lang", F.coalesce(code, data)).withColumn("is_data", code.isNull())
    kept = typed.where(
        F.col("lang").isNotNull() & ~P.in_ignored_dir(F.col("path"))
        & ~P.ignored_by(F.col("path"), P.IGNORED_GLOBS) & ~P.ignored_by(F.col("path"), list(patterns))
        & (F.col("length") > 0) & (F.lit(True) if max_bytes is None else F.col("length") <= max_bytes))
    if only:
        kept = kept.where(F.startswith("path", F.lit(only.strip("/") + "/")) | (F.col("path") == only))
    return kept.withColumn("is_test", P.is_test_path(F.col("path")))


def scan_tree(spark: SparkSession, root: str, repo: str, only: str | None = None, max_bytes: int | None = P.MAX_FILE_BYTES) -> DataFrame:
    """Indexable files of a tree: repo, path, lang, is_data, is_test, sha256, size, text."""
    kept = keep_indexable(read_files(spark, root, max_bytes), ignore_patterns(root), only, max_bytes)
    return kept.select(
        F.lit(repo).alias("repo"), "path", "lang", "is_data", "is_test", F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size"), utf8_text(F.col("content")).alias("text"))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive, clamped); null when the start is outside the file."""
    from quarry.functions.text import split_lines

    lines = split_lines(text)
    inside = (start >= 1) & (start <= F.size(lines))
    return F.when(inside, F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"))
