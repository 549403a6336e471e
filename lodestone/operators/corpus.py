"""Rollups over the files of a corpus: one row for each file in, directory, language and top-k reports out."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.functions.scalars import base_name, decode_cursor, encode_cursor, line_count, top_component

MOST_BYTES = 10_000_000
PAGE, MOST_PAGE = 100, 10_000


def eligible(sources: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Files of binary ``content`` that aren't too large and are UTF-8, the content as text."""
    return sources.filter((F.octet_length("content") <= most) & F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.col("content").cast("string"))


def files(sources: DataFrame, functions: str = r"(?m)^The", classes: str = r"(?m)^And") -> DataFrame:
    """Language, lines and counts of each file; the counts by pattern, where no extractor has run."""
    c = F.col("content")
    return sources.select("path", paths.language_label(F.col("path")).alias("language"), line_count(c).cast("bigint").alias("line_count"), F.regexp_count(c, F.lit(functions)).cast("bigint").alias("function_count"), F.regexp_count(c, F.lit(classes)).cast("bigint").alias("class_count"), paths.is_test(F.col("path")).alias("is_test"))


def entries(files_: DataFrame) -> DataFrame:
    """The files and all directories above them, with their depth."""
    dirs = files_.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return files_.select("path", F.lit(False).alias("is_dir")).unionByName(dirs).withColumn("depth", F.size(F.split("path", "/")))


def totals(f: DataFrame) -> DataFrame:
    """A1."""
    return f.agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("loc"), F.sum("function_count").alias("functions"), F.sum("class_count").alias("classes"), F.count_if(~F.col("is_test")).alias("prod"), F.count_if("is_test").alias("test"))


def by_language(f: DataFrame) -> DataFrame:
    """A2: files and whole per cent of each language."""
    n = f.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    return n.withColumn("percent", F.expr("files * 100 div nullif(sum(files) OVER (), 0)"))


def primary_language(f: DataFrame) -> DataFrame:
    """A3: the language of most files, ties by name."""
    return by_language(f).orderBy(F.desc("files"), "language").limit(1).select("language", "files")


def by_directory(f: DataFrame) -> DataFrame:
    """Sums over the files below each top directory."""
    inside = f.filter(F.contains("path", F.lit("/")))
    return inside.groupBy(top_component(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("loc"), F.sum("function_count").alias("functions"), F.sum("class_count").alias("classes"))


def subtree_counts(f: DataFrame) -> DataFrame:
    """A5: files under each first component, excluded directories left out; a file at the root counts by its own name."""
    return f.filter(~paths.is_excluded(F.col("path"))).groupBy(top_component(F.col("path")).alias("component")).agg(F.count(F.lit(1)).alias("n"))


def largest_directory(f: DataFrame) -> DataFrame:
    """Ties in path order."""
    return subtree_counts(f).orderBy(F.desc("n"), "component").limit(1)


def top_files(f: DataFrame, n: int = 3) -> DataFrame:
    """O2: the first files of each top directory, by classes, functions, path; by functions, path where it has no classes. Empty ones go afterwards."""
    d = f.filter(F.contains("path", F.lit("/"))).withColumn("dir", top_component(F.col("path")))
    # Without classes all counts are 0, so that the functions decide. Only the first rows of each task are shuffled.
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("class_count"), F.desc("function_count"), "path"))).filter(F.col("rank") <= n)
    return d.filter((F.col("class_count") > 0) | (F.col("function_count") > 0)).select("dir", "rank", "path", "class_count", "function_count")


def sub_directories(f: DataFrame, n: int = 5) -> DataFrame:
    """The first names of second-level directories."""
    parts = F.split("path", "/")
    d = f.filter(F.size(parts) > 2).select(F.get(parts, F.lit(0)).alias("dir"), F.get(parts, F.lit(1)).alias("sub"))
    return d.groupBy("dir").agg(F.array_join(F.slice(F.array_sort(F.collect_set("sub")), 1, n), ",").alias("subs"))


def changed_only(e: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed files, and the directories above them."""
    up = changed.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return e.filter("not is_dir").join(changed.select("path").distinct(), "path", "left_semi").unionByName(e.filter("is_dir").join(up, "path", "left_semi"))


def structure(e: DataFrame, f: DataFrame) -> DataFrame:
    """Entries with what is known of them; directories and unread files stay."""
    return e.join(f, "path", "left")


def import_counts(i: DataFrame) -> DataFrame:
    """A11."""
    return i.groupBy("module").agg(F.count(F.lit(1)).alias("n"))


def import_lookup(i: DataFrame, q: str) -> DataFrame:
    """The first import of each file that names ``q`` as module or among its items."""
    hit = i.filter((F.col("module") == q) | F.array_contains("items", q))
    return hit.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("line"))).filter("rn = 1").drop("rn")


def top_level(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Functions outside the line ranges of the file's classes."""
    f, c = functions.alias("f"), classes.alias("c")
    return f.join(c, (F.col("f.path") == F.col("c.path")) & (F.col("f.line") >= F.col("c.line")) & (F.col("f.end_line") <= F.col("c.end_line")), "left_anti")


def methods(functions: DataFrame, classes: DataFrame, n: int = 10) -> DataFrame:
    """Functions inside a class, the first ``n`` by line and how many more there are."""
    f, c = functions.alias("f"), classes.alias("c")
    j = c.join(f, (F.col("f.path") == F.col("c.path")) & (F.col("f.line") >= F.col("c.line")) & (F.col("f.end_line") <= F.col("c.end_line")))
    j = j.select("c.path", F.col("c.name").alias("class"), F.col("f.name").alias("method"), F.col("f.line").alias("line"))
    w = Window.partitionBy("path", "class")
    j = j.withColumn("rank", F.row_number().over(w.orderBy("line", "method"))).withColumn("more", F.greatest(F.count(F.lit(1)).over(w) - n, F.lit(0)))
    return j.filter(F.col("rank") <= n)


def enclosing(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """The innermost function around each site (path, line, site), ``<module>`` outside all."""
    kind = sites.schema["path"].dataType.simpleString()

    def sweep(path, rows: list[tuple]) -> list[tuple]:
        """From which line on a function is the innermost one; a null name where none is open."""
        edges = sorted({r[0] for r in rows} | {r[1] + 1 for r in rows})
        out, heap, k = [], [], 0
        for at in edges:
            while k < len(rows) and rows[k][0] <= at:
                line, end, name = rows[k]
                heapq.heappush(heap, (-line, end, tuple(-ord(c) for c in name), name))
                k += 1
            while heap and heap[0][1] < at:
                heapq.heappop(heap)
            out.append((path, at, heap[0][3] if heap else None))
        return out

    def by_file(batches):
        """Functions come sorted by file and line."""
        path, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for p, line, end, name in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "end_line", "name")), strict=True):
                if p != path:
                    out += sweep(path, rows)
                    path, rows = p, []
                rows.append((line, end, name))
            yield made(out, batch.column("path").type)
        if rows:
            yield made(sweep(path, rows), batch.column("path").type)

    def made(out: list[tuple], kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((kind, pa.int64(), pa.string()))], ["path", "line", "name"])

    inner = functions.select("path", "line", "end_line", "name").filter("path is not null").repartition("path").sortWithinPartitions("path", "line", "end_line", "name").mapInArrow(by_file, f"path {kind}, line long, name string")
    none = F.lit(None)
    places = inner.select("path", "line", F.struct(F.col("name").alias("x")).alias("at"), none.cast(sites.schema["site"].dataType).alias("site"), none.cast(sites.schema["line"].dataType).alias("own"))
    both = places.unionByName(sites.select("path", F.col("line").cast("long").alias("line"), none.cast("struct<x:string>").alias("at"), "site", F.col("line").alias("own")))
    before = Window.partitionBy("path").orderBy("line", F.col("at").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("name", F.last("at", ignorenulls=True).over(before)["x"]).filter("own is not null")
    return found.select("path", F.col("own").alias("line"), "site", F.coalesce("name", F.lit("<module>")).alias("caller")).distinct()


def largest_functions(functions: DataFrame, n: int = 10) -> DataFrame:
    """O3: by lines, ties by line and name."""
    span = F.greatest(F.col("end_line") - F.col("line"), F.lit(0))
    return functions.withColumn("span", span).orderBy(F.desc("span"), "path", "line", "name").limit(n)


def page(df: DataFrame, order: list[str], offset: int = 0, size: int = PAGE, mode: str = "default", cursor: str | None = None) -> tuple[DataFrame, str | None, int]:
    """Rows of one page, the cursor of the next one (None at the end) and the number of all rows."""
    if size <= 0:
        raise ValueError("page size must be above 0")
    spark = df.sparkSession
    if cursor is not None:
        got = spark.range(1).select(decode_cursor(F.lit(cursor)).alias("c")).first()["c"]
        if got is None or got["offset"] is None or got["mode"] != mode:
            raise ValueError("invalid cursor")
        offset = got["offset"]
    size, total = min(size, MOST_PAGE), df.count()
    rows = df.orderBy(*order).offset(offset).limit(size)
    more = spark.range(1).select(encode_cursor(F.lit(mode), F.lit(offset + size)).alias("c")).first()["c"] if offset + size < total else None
    return rows, more, total


def complete_paths(e: DataFrame, directory: str, prefix: str, n: int = 100) -> DataFrame:
    """Entries of one directory whose names start with ``prefix``."""
    if ".." in directory.split("/") or ".." in prefix or prefix.startswith("/"):
        raise ValueError("path leaves the root")
    return e.filter((F.regexp_replace("path", r"/?[^/]*$", "") == directory.strip("/")) & F.startswith(base_name(F.col("path")), F.lit(prefix))).orderBy("path").limit(n)


def complete_symbols(functions: DataFrame, classes: DataFrame, prefix: str, n: int = 100) -> DataFrame:
    """Functions, then classes."""
    both = functions.select("name", F.lit(0).alias("k"), "line").unionByName(classes.select("name", F.lit(1).alias("k"), "line"))
    return both.filter(F.startswith("name", F.lit(prefix))).orderBy("k", "line", "name").limit(n).select("name")


def project_fields(analysis: DataFrame, fields: list[str] | None) -> DataFrame:
    """Sections that weren't asked for are empty; None asks for all. The call counts stay with the functions."""
    if fields is None:
        return analysis
    out = analysis
    for section in ("functions", "classes", "imports"):
        if section not in fields:
            out = out.withColumn(section, F.array().cast(analysis.schema[section].dataType))
    if "functions" not in fields and "call_frequency" in out.columns:
        out = out.withColumn("call_frequency", F.map_from_arrays(F.array(), F.array()).cast(analysis.schema["call_frequency"].dataType))
    return out
