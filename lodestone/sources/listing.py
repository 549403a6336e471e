"""File trees listed by the executors, one level of folders a round.

A round takes the folders found by the last one, each with the ignore rules of all folders above it as a column, lists them in tasks, and writes
what it found as a checkpoint; the driver only sees whether there are more. Any file system that Arrow can open by its address can be listed; symbolic links
are told on local ones and never followed. With a limit, what can't be among the first entries in path order isn't listed:
all that is below a folder comes behind the folder itself. One folder is listed by one task, in batches.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import checkpointed
from lodestone.sources.files import MOST_ENTRIES, ignored, parse_rules

_RULES = "array<struct<base:string,text:string>>"
_FOUND = f"path string, depth int, is_dir boolean, is_symlink boolean, symlink_target string, mtime double, size bigint, rules {_RULES}"
_ROWS = 10_000


def opened(address: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of an address; ``file:/a`` as Hadoop writes it, and plain paths, are local."""
    if address.startswith("file:"):
        address = "/" + address.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(address if "://" in address else os.path.abspath(address))


def _children(fs: arrow_fs.FileSystem, folder: str) -> Iterator[tuple]:
    """(name, is_dir, link target or None, is_symlink, mtime, size) of what is in a folder; one that can't be read has nothing."""
    try:
        if isinstance(fs, arrow_fs.LocalFileSystem):
            with os.scandir(folder) as found:
                for e in found:
                    s, link = e.stat(follow_symlinks=False), e.is_symlink()
                    yield e.name, e.is_dir(follow_symlinks=False), os.readlink(e.path) if link else None, link, s.st_mtime, s.st_size
        else:
            for e in fs.get_file_info(arrow_fs.FileSelector(folder)):
                yield e.base_name, e.type == arrow_fs.FileType.Directory, None, False, e.mtime.timestamp() if e.mtime else None, e.size
    except (PermissionError, FileNotFoundError, NotADirectoryError):
        return


def _own_rules(fs: arrow_fs.FileSystem, folder: str) -> str:
    out = []
    for name in (".gitignore", ".ignore"):
        try:
            with fs.open_input_stream(f"{folder}/{name}") as f:
                out.append(f.read().decode("utf-8", errors="replace"))
        except OSError:
            continue
    return "\n".join(out)


def _level(frontier: DataFrame, root: str) -> DataFrame:
    """What is in the folders of ``frontier`` (path, depth, rules), hidden and ignored entries left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        parsed = functools.lru_cache(10_000)(parse_rules)
        rule = pa.list_(pa.struct([("base", pa.string()), ("text", pa.string())]))
        types = [pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.float64(), pa.int64(), rule]
        names = ["path", "depth", "is_dir", "is_symlink", "symlink_target", "mtime", "size", "rules"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.to_pylist():
                rel = folder["path"]
                at = f"{base}/{rel}" if rel else base
                own = _own_rules(fs, at)
                texts = [*folder["rules"], *([{"base": rel, "text": own}] if own else [])]
                rules = [(r["base"], parsed(r["text"])) for r in texts]
                for name, is_dir, target, link, mtime, size in _children(fs, at):
                    path = f"{rel}/{name}" if rel else name
                    if not name.startswith(".") and not ignored(path, is_dir, rules):
                        rows.append((path, folder["depth"] + 1, is_dir, link, target, mtime, size, texts if is_dir else None))
                        if len(rows) >= _ROWS:
                            yield pack(rows)
                            rows = []
        if rows:
            yield pack(rows)

    return frontier.select("path", "depth", "rules").mapInArrow(run, _FOUND)


def entries(spark: SparkSession, root: str, max_depth: int | None = None, most: int | None = MOST_ENTRIES) -> DataFrame:
    """Entries below ``root``, the first ``most`` in path order (all if None); depth 0 or None has no limit, depth 1 is one round.

    Columns: path below ``root``, depth (from 1), is_dir, is_symlink, symlink_target, mtime, size. An empty or missing folder has no entries.
    """
    frontier = spark.sql(f"SELECT '' AS path, 0 AS depth, CAST(array() AS {_RULES}) AS rules")
    out: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        found = checkpointed(_level(frontier, root))
        out = found if out is None else out.unionByName(found)
        frontier = found.filter("is_dir")
        if most is not None:
            # One row at most: the last path that can still be shown, if there are as many already.
            last = out.select("path").orderBy("path").limit(most).agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last")).filter(F.col("n") >= most).select("last")
            edge = last.first()
            if edge is not None:
                out, frontier = out.filter(F.col("path") <= edge["last"]), frontier.filter(F.col("path") < edge["last"])
        if (max_depth and depth >= max_depth) or frontier.isEmpty():
            break
        frontier = frontier.repartition("path")
    out = out.drop("rules").withColumn("mtime", F.timestamp_seconds("mtime"))
    return out if most is None else out.orderBy("path").limit(most)


def write_tree(files: DataFrame, root: str) -> None:
    """Writes (path, content) below ``root`` from the executors; a task that runs twice writes the same files."""

    def put(rows) -> None:
        fs, base = opened(root)
        for r in rows:
            at = f"{base}/{r['path']}"
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f:
                f.write((r["content"] or "").encode())

    files.select("path", "content").foreachPartition(put)
