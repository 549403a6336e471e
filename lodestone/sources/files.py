"""Readers of the engine's inputs: file trees, logs, sessions, transcripts, scores, rules and SQLite tables."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.operators.corpus import eligible

MOST_ENTRIES = 50_000
ENTRIES = "path string, depth int, is_dir boolean, is_symlink boolean, symlink_target string, mtime timestamp, size bigint"
METRICS = (
    "ts bigint, tool string, duration_ms bigint, output_chars bigint, param_path_depth bigint, max_depth int, result string, error_type string, error_subtype string, session_id string, seq int, cache_hit boolean, cache_tier string, "
    "cache_write_failure boolean, exit_code int, timed_out boolean, output_truncated boolean, chars_threshold_breach boolean, file_ext string, filter_applied string, language string, git_ref_used boolean, summary_mode boolean, "
    "is_paginated boolean, fields_projected boolean, match_mode string, follow_depth int, import_lookup boolean, def_use boolean, impl_only boolean, stdin_provided boolean, timeout_configured_ms bigint, drain_timeout_ms bigint, "
    "working_dir_used boolean, l1_eviction_count bigint, l2_entry_count bigint, l2_size_bytes bigint, stdout_bytes_raw bigint, stderr_bytes_raw bigint"
)
MESSAGES = "session string, idx int, ts string, role string, content array<struct<type:string,id:string,name:string,input:string,text:string>>, usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"


# ---------------------------------------------------------------- file trees


def parse_rules(text: str) -> list[tuple[re.Pattern, bool, bool, bool]]:
    """(pattern, negated, directories only, anchored) of the lines of an ignore file."""
    out = []
    for line in text.splitlines():
        p = re.sub(r"(?<!\\)\s+$", "", line)
        if not p or p.startswith("#"):
            continue
        negated, p = p.startswith("!"), p.removeprefix("!")
        only_dirs, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        if p:
            out.append((glob_regex(p), negated, only_dirs, anchored))
    return out


def _ignore_rules(folder: Path) -> list[tuple[re.Pattern, bool, bool, bool]]:
    out = []
    for name in (".gitignore", ".ignore"):
        try:
            out += parse_rules((folder / name).read_text(encoding="utf-8", errors="replace"))
        except OSError:
            continue
    return out


def glob_regex(pattern: str) -> re.Pattern:
    """A pattern of an ignore file: ``*`` and ``?`` stay within a path component, ``**`` as a whole component crosses them."""
    out, i, n = "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == n:
            out, i = out + "/.+", i + 3
        elif c == "*":
            out += "[^/]*"
            i += 1 + (pattern[i + 1 : i + 2] == "*")
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in "!^"))) > 0:
            own = pattern[i + 1 : end]
            out += f"(?!/)[{'^' if own[0] in '!^' else ''}{re.escape(own.lstrip('!^')).replace(chr(92) + '-', '-')}]"
            i = end + 1
        elif c == "\\" and i + 1 < n:
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out, re.S)


def ignored(rel: str, is_dir: bool, rules: list[tuple[str, list]]) -> bool:
    hit = False
    for base, own in rules:
        inside = rel[len(base) + 1 :] if base else rel
        for pattern, negated, only_dirs, anchored in own:
            if only_dirs and not is_dir:
                continue
            name = inside if anchored else inside.rsplit("/", 1)[-1]
            if pattern.fullmatch(name):
                hit = not negated
    return hit


def walk(root: str, max_depth: int | None = None, most: int = MOST_ENTRIES) -> list[tuple]:
    """Entries below ``root`` in path order; hidden and ignored ones left out; depth 0 or None has no limit."""
    top, out = Path(root), []

    def visit(folder: Path, rel: str, depth: int, rules: list) -> None:
        rules = [*rules, (rel, _ignore_rules(folder))]
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{rel}/{e.name}" if rel else e.name
            if e.name.startswith(".") or ignored(path, e.is_dir(follow_symlinks=False), rules) or len(out) >= most:
                continue
            s = e.stat(follow_symlinks=False)
            link = e.is_symlink()
            out.append((path, depth, e.is_dir(follow_symlinks=False), link, os.readlink(e.path) if link else None, s.st_mtime, s.st_size))
            if e.is_dir(follow_symlinks=False) and (not max_depth or depth < max_depth):
                visit(Path(e.path), path, depth + 1, rules)

    visit(top, "", 1, [])
    return sorted(out)[:most]


def entries(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """S1 as a table, listed by the executors (``listing``); ``walk`` is the same on one machine."""
    from lodestone.sources import listing

    return listing.entries(spark, root, max_depth)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """Path below ``root`` and content of all files that can be analysed, read by the executors."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    return eligible(raw.filter("length <= 10000000").select(F.substring_index(F.col("path"), base, -1).alias("path"), "content"))


def literal(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(path, language or extension, content) in memory."""
    return spark.createDataFrame(rows, "path string, language string, content string").withColumn("language", F.lower("language"))


REF = re.compile(r"[A-Za-z0-9_./~^@{}-]+")


def changed_files(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """S3: files that differ from a git ref; the ref may not look like an option or hold shell characters."""
    if ref.startswith("-") or not REF.fullmatch(ref):
        raise ValueError(f"invalid ref {ref!r}")
    out = subprocess.run(["git", "-C", root, "diff", "--name-only", ref, "--"], capture_output=True, text=True, check=True, timeout=60).stdout
    return spark.createDataFrame([(p,) for p in out.splitlines() if p], "path string")


# ---------------------------------------------------------------- logs and sessions


def metric_log(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The daily JSONL files, those outside the days skipped by the name of the file or its folder, broken lines dropped."""
    raw = spark.read.schema(f"{METRICS}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    day = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})(?:\.[^/]*|/[^/]*)?$", 1)
    if start:
        raw = raw.filter((day == "") | (day >= start))
    if end:
        raw = raw.filter((day == "") | (day <= end))
    return raw.filter("_bad is null and ts is not null").drop("_bad")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON message a line; broken lines are dropped."""
    schema = "type string, timestamp string, message struct<role:string,content:array<struct<type:string,id:string,name:string,input:string,text:string>>,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>"
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return raw.select(F.col("_metadata.file_name").alias("session"), F.monotonically_increasing_id().alias("idx"), F.col("timestamp").alias("ts"), "message.role", "message.content", "message.usage")


def scores(spark: SparkSession, path: str, metrics: str = "map<string,double>") -> DataFrame:
    """One JSON object of runs by name, a row for each."""
    raw = spark.read.option("multiLine", True).schema(f"runs map<string, struct<condition:string,scores:{metrics}>>").json(path)
    return raw.select(F.explode("runs").alias("run_id", "r")).select("run_id", "r.*")


def handoff_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session folders with up to three JSON documents in .handoff; a missing or broken one is empty. Folders named with a dash first are skipped."""

    def one(name: str, schema: str) -> DataFrame:
        files = sorted(Path(folder).glob(f"*/.handoff/{name}.json"))
        raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json([str(f) for f in files]) if files else spark.createDataFrame([], schema).withColumn("_p", F.lit(""))
        path = F.col("_metadata.file_path") if files else F.col("_p")
        session = F.regexp_extract(path, r"([^/]+)/\.handoff/", 1)
        return raw.select(session.alias("session_id"), F.lit(True).alias(f"has_{name}"), *[c for c in raw.columns if c != "_p"]).filter(~F.startswith("session_id", F.lit("-")))

    out = one("plan", "complexity string").join(one("build", "pr_url string, retry boolean"), "session_id", "full_outer").join(one("validation", "verdict string"), "session_id", "full_outer")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("session_id", "complexity", "pr_url", flag("retry"), "verdict", flag("has_plan"), flag("has_build"), flag("has_validation")).withColumn("incomplete", ~F.col("has_validation"))


def filter_rules(path: str | None) -> list[tuple]:
    """A project's rules from TOML, none if the file is missing, broken or of another version."""
    import tomllib

    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
        if data.get("schema_version") != 1:
            return []
        return [(r["match_command"], r.get("description"), r.get("strip_ansi", False), r.get("strip_lines_matching", []), r.get("keep_lines_matching", []), r.get("max_lines"), r.get("on_empty")) for r in data.get("filters", []) if re.compile(r["match_command"])]
    except (OSError, tomllib.TOMLDecodeError, KeyError, re.error):
        return []


# ---------------------------------------------------------------- SQLite


class SqliteSource(DataSource):
    """Format ``sqlite``: options path, query, order and partitions. A partition reads every n-th row id of the table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, len(schema))


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, width: int) -> None:
        self.options, self.width = dict(options), width

    def partitions(self):
        return [InputPartition(k) for k in range(int(self.options.get("partitions", "1")))]

    def read(self, partition):
        import sqlite3

        n = int(self.options.get("partitions", "1"))
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            yield from db.execute(f"SELECT {self.options.get('columns', '*')} FROM {self.options['table']} WHERE rowid % ? = ? ORDER BY {self.options.get('order', 'rowid')}", (n, partition.value))
        finally:
            db.close()


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, columns: str = "*", partitions: int = 1) -> DataFrame:
    for word in (table, *re.split(r"\s*,\s*", columns)):
        if not re.fullmatch(r"\w+|\*", word):
            raise ValueError(f"not a name: {word!r}")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("columns", columns).option("schema", schema).option("partitions", str(partitions)).load()
