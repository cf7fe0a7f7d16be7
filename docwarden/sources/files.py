"""Trees of files as tables.

Spark's own file sources skip every name that begins with a dot or an underscore,
so hidden folders would be scanned by nobody.  This source lists a tree on the
driver (names and sizes, no contents) and reads the files on the executors, which
must see the tree under the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "docwarden_files"
DOCUMENT_NAME = "SKILL.md"
SERVERS_NAME = ".mcp.json"
_PART_FILES, _PART_BYTES = 2_000, 32 << 20


class Files(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int, int]]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = Path(options["path"]).resolve()
        self.globs = [g for g in options.get("globs", "**/*").split("\n") if g]
        self.name = options.get("name")
        self.most = int(options.get("maxbytes", str(1 << 62)))
        self.content = options.get("includecontent", "true").lower() == "true"

    def _listed(self) -> Iterator[tuple[str, str, int, int]]:
        seen = set()
        for pattern in self.globs:
            for found in self.root.glob(pattern):
                if (self.name and found.name != self.name) or not found.is_file():
                    continue
                path = found.resolve()
                about = path.stat()
                if path in seen or about.st_size > self.most:
                    continue
                seen.add(path)
                rel = os.path.relpath(path, self.root) if path.is_relative_to(self.root) else str(found.relative_to(self.root))
                yield str(path), Path(rel).as_posix(), about.st_mtime_ns, about.st_size

    def partitions(self) -> Sequence[InputPartition]:
        parts: list[Files] = []
        rows: list[tuple[str, str, int, int]] = []
        size = 0
        for row in sorted(self._listed(), key=lambda r: r[1]):
            if rows and (len(rows) >= _PART_FILES or size + row[3] > _PART_BYTES):
                parts.append(Files(rows))
                rows, size = [], 0
            rows.append(row)
            size += row[3] if self.content else 0
        return [*parts, Files(rows)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, rel, mtime, size in partition.rows:
            yield path, rel, mtime, size, Path(path).read_bytes() if self.content else None


class FileTree(DataSource):
    """Options: path, globs (one a line), name, maxBytes, includeContent."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, rel_path string, mtime_ns long, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def files(spark: SparkSession, root: str | Path, *, globs: Sequence[str] = ("**/*",), name: str | None = None, max_bytes: int | None = None, content: bool = True) -> DataFrame:
    spark.dataSource.register(FileTree)
    reader = spark.read.format(NAME).option("globs", "\n".join(globs)).option("includeContent", str(content).lower())
    for key, value in (("name", name), ("maxBytes", max_bytes)):
        if value is not None:
            reader = reader.option(key, value)
    return reader.load(str(root))


def documents(spark: SparkSession, root: str | Path, *, globs: Sequence[str] = ("**/SKILL.md",), max_file_mb: int = 2) -> DataFrame:
    """path, rel_path, folder, root, mtime_ns, sha256 and raw_text (null where it isn't UTF-8) of the instruction files."""
    found = files(spark, root, globs=globs, name=DOCUMENT_NAME, max_bytes=max_file_mb << 20)
    return found.select(
        "path", "rel_path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.lit(str(Path(root).resolve())).alias("root"),
        "mtime_ns", F.sha2("content", 256).alias("sha256"), F.try_validate_utf8(F.col("content").cast("string")).alias("raw_text"),
    )


def package_files(spark: SparkSession, root: str | Path) -> DataFrame:
    """path and rel_path of every file of the tree, without contents."""
    return files(spark, root, content=False).select("path", "rel_path")


def server_files(spark: SparkSession, root: str | Path) -> DataFrame:
    """path and text of the files that name remote servers."""
    return files(spark, root, globs=(f"**/{SERVERS_NAME}",), name=SERVERS_NAME).select("path", F.col("content").cast("string").alias("text"))
