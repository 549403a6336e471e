"""Reports as text: what is shown for directories, files, modules, symbols and commands.

Reports over a whole corpus are tables of lines (block, key, line), ordered by block and key, so that they are made by the executors
and can be written as they are; ``text`` puts one together. Reports on one file are expressions over a row that holds its
``functions``, ``classes``, ``imports`` and ``call_frequency``, and so are made for all files at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import EXCLUDED, is_test
from lodestone.functions.scalars import base_name, call_marker, compact_signature, info_parts, snippet_one_line, strip_base, top_component
from lodestone.operators import corpus
from lodestone.operators.graph import chain_tree

#: Bytes above which a report is summarised, width of wrapped lines, entries shown in one line, methods of a class.
SIZE_LIMIT, WIDTH, INLINE, METHODS = 5_000, 100, 10, 10


def _row(block: int, line: Column, key: Column | None = None) -> list[Column]:
    return [F.lit(block).alias("block"), (F.lit("") if key is None else key).alias("key"), line.alias("line")]


def _fixed(spark, block: int, line: str) -> DataFrame:
    return spark.range(1).select(*_row(block, F.lit(line)))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _in_path_order(path: Column) -> Column:
    """Sorts components, not letters: a/b comes before a-b."""
    return F.translate(path, "/", "\x01")


def text(lines: DataFrame) -> str:
    """A report put together; its size is that of what is shown."""
    return "".join(f"{r['line']}\n" for r in lines.orderBy("block", "key").collect())


def shown(full: DataFrame, summary: DataFrame, asked: bool | None = None, limit: int = SIZE_LIMIT) -> DataFrame:
    """The summary if it is asked for, or if that is left open and the full report has over ``limit`` bytes."""
    if asked is None:
        asked = (full.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0) > limit
    return summary if asked else full


def wrapped(items: Column, width: int = WIDTH) -> Column:
    """Items in lines of about ``width`` bytes, two spaces before and commas between; null without items."""
    step = lambda a, x: F.when(a["line"].isNull(), F.struct(a["out"].alias("out"), F.concat(F.lit("  "), x).alias("line"))).when(F.octet_length(a["line"]) + F.octet_length(x) + 2 > width, F.struct(F.concat(a["out"], F.array(a["line"])).alias("out"), F.concat(F.lit("  "), x).alias("line"))).otherwise(F.struct(a["out"].alias("out"), F.concat(a["line"], F.lit(", "), x).alias("line")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("line"))
    return F.aggregate(items, start, step, lambda a: F.when(a["line"].isNotNull(), F.array_join(F.concat(a["out"], F.array(a["line"])), "\n")))


# ---------------------------------------------------------------- directories


def _depth_label(max_depth: int | None) -> str:
    return f" (max_depth={max_depth})" if max_depth else ""


def _counts(t: DataFrame, prefix: Column, suffix: Column) -> Column:
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return F.concat(prefix, n("loc"), F.lit("L, "), n("functions"), F.lit("F, "), n("classes"), F.lit("C"), suffix)


def _languages(files: DataFrame) -> DataFrame:
    by = corpus.by_language(files).select(F.struct("language", F.format_string("%s (%d%%)", F.col("language"), F.col("percent")).alias("x")).alias("p"))
    return by.agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), ", ").alias("l")).filter("l <> ''")


def structure_lines(entries: DataFrame, files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The tree of a corpus: ``entries`` (path, is_dir, depth) and ``files`` (path, language, counts, is_test)."""
    spark, t = files.sparkSession, corpus.totals(files)
    each = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("line_count", "function_count", "class_count")])
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sum("line_count").alias("loc"), F.sum("function_count").alias("functions"), F.sum("class_count").alias("classes"), F.max_by("language", F.struct(F.col("n"), F.col("language"))).alias("language"), F.max("n").alias("n"))
    primary = F.coalesce(F.format_string("%s %d%%", F.col("language"), F.expr("n * 100 div files")), F.lit("unknown 0%"))
    first = one.select(*_row(0, _counts(one, F.concat(F.col("files").cast("string"), F.lit(" files, ")), F.concat(F.lit(" ("), F.when(F.col("files") > 0, primary).otherwise("unknown 0%"), F.lit(")")))))
    about = t.select(*_row(2, _counts(t, F.format_string("Shown: %d files (%d prod, %d test), ", F.col("files"), F.col("prod"), F.col("test")), F.lit(_depth_label(max_depth)))))
    rows = entries.filter("depth > 0").join(files.drop("language"), "path", "left").withColumn("info", info_parts(F.col("line_count"), F.col("function_count"), F.col("class_count")))
    indent = F.repeat(F.lit("  "), F.col("depth") - 1)
    place = _in_path_order(F.col("path"))
    dirs = rows.filter("is_dir").select(*_row(6, F.concat(indent, base_name(F.col("path")), F.lit("/")), place))
    named = rows.filter("not is_dir and info is not null")
    entry = F.concat(indent, base_name(F.col("path")), F.lit(" "), F.col("info"))
    tests = named.filter("is_test")
    head = tests.limit(1).select(F.explode(F.array(F.struct(*_row(7, F.lit(""))), F.struct(*_row(8, F.lit("TEST FILES [LOC, FUNCTIONS, CLASSES]"))))).alias("x")).select("x.*")
    return _all([
        first, _fixed(spark, 1, "SUMMARY:"), about, _languages(files).select(*_row(3, F.concat(F.lit("Languages: "), "l"))), _fixed(spark, 4, ""), _fixed(spark, 5, "PATH [LOC, FUNCTIONS, CLASSES]"),
        dirs, named.filter("not is_test").select(*_row(6, entry, place)), head, tests.select(*_row(9, entry, place)),
    ])


def summary_lines(entries: DataFrame, files: DataFrame, max_depth: int | None = None, subtrees: DataFrame | None = None) -> DataFrame:
    """The top level of a corpus, with what is most worth a look in each directory; ``subtrees``: (component, n) of files at any depth."""
    spark, t = files.sparkSession, corpus.totals(files)
    about = t.select(*_row(1, _counts(t, F.format_string("%d files (%d prod, %d test), ", F.col("files"), F.col("prod"), F.col("test")), F.lit(_depth_label(max_depth)))))
    top = entries.filter("depth = 1")
    d = top.filter("is_dir").select(F.col("path").alias("dir")).join(corpus.by_directory(files), "dir", "left")
    best = corpus.top_files(files).withColumn("has", F.max("class_count").over(_by("dir")) > 0)
    n = F.when(F.col("has"), F.col("class_count")).otherwise(F.col("function_count"))
    best = best.withColumn("n", n).filter("n > 0").withColumn("x", F.concat(F.expr("substring(path, length(dir) + 2)"), F.lit("("), F.col("n").cast("string"), F.when(F.col("has"), "C").otherwise("F"), F.lit(")")))
    best = best.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda y: y["x"]), ", ").alias("best"))
    subs = entries.filter("depth = 2 and is_dir").groupBy(top_component(F.col("path")).alias("dir")).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_set(base_name(F.col("path")))), 1, 5), lambda x: F.concat(x, F.lit("/"))), ", ").alias("subs"))
    d = d.join(best, "dir", "left").join(subs, "dir", "left")
    d = d.join(subtrees.withColumnRenamed("component", "dir").withColumnRenamed("n", "whole"), "dir", "left") if subtrees is not None else d.withColumn("whole", F.lit(None).cast("bigint"))
    sums = _counts(d, F.lit(""), F.lit(""))
    whole = F.coalesce("whole", "files") if subtrees is not None else F.col("files")
    shown_ = F.when(whole == F.col("files"), F.concat(F.col("files").cast("string"), F.lit(" files, "), sums)).otherwise(F.concat(whole.cast("string"), F.lit(" files total; showing "), F.coalesce("files", F.lit(0)).cast("string"), F.lit(f" at depth={max_depth or 0}, "), sums))
    hint = F.when((F.col("files") > 1) & F.col("best").isNotNull(), F.concat(F.lit(" top: "), "best")).otherwise("")
    tail = F.when(F.col("files").isNotNull() & F.col("subs").isNotNull(), F.concat(F.lit("  sub: "), "subs")).otherwise("")
    known = F.col("files").isNotNull() | (F.coalesce("whole", F.lit(0)) > 0)
    dirs = d.select(*_row(5, F.concat(F.lit("  "), "dir", F.lit("/"), F.when(known, F.concat(F.lit(" ["), shown_, F.lit("]"), hint, tail)).otherwise("")), F.col("dir")))
    own = top.filter("not is_dir").join(files, "path").select(*_row(5, F.concat_ws(" ", F.concat(F.lit("  "), "path"), info_parts(F.col("line_count"), F.col("function_count"), F.col("class_count"))), F.col("path")))
    largest = d.filter(~F.col("dir").isin(*EXCLUDED)).select("dir", F.coalesce("whole", "files").alias("n")).filter("n > 0").agg(F.max_by("dir", F.struct(F.col("n"), _descending(F.col("dir")))).alias("dir"), F.max("n").alias("n"))
    advice = F.when(F.col("dir").isNull(), F.lit("SUGGESTION:\nUse a narrower path for details (e.g., analyze src/core/)")).otherwise(F.concat(F.lit("SUGGESTION: Largest source directory: "), "dir", F.lit("/ ("), F.col("n").cast("string"), F.lit(" files total). For module details, re-run with path="), "dir", F.lit(" and max_depth=2.")))
    return _all([
        _fixed(spark, 0, "SUMMARY:"), about, _languages(files).select(*_row(2, F.concat(F.lit("Languages: "), "l"))), _fixed(spark, 3, ""), _fixed(spark, 4, "STRUCTURE (depth 1):"),
        dirs, own, _fixed(spark, 6, ""), largest.select(*_row(7, advice)),
    ])


def _by(*c: str):
    from pyspark.sql import Window

    return Window.partitionBy(*c)


def _descending(c: Column) -> Column:
    """Sorts texts the other way round, as code points below the largest."""
    return F.transform(F.split(c, ""), lambda x: -F.ascii(x))


def file_page_lines(page: DataFrame, total: int, max_depth: int | None = None, base: str | None = None, verbose: bool = False) -> DataFrame:
    """A page of files, production before tests."""
    spark = page.sparkSession
    path = strip_base(F.col("path"), base) if base else F.col("path")
    entry = F.concat_ws(" ", path, info_parts(F.col("line_count"), F.col("function_count"), F.col("class_count")))
    head = page.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_test")).alias("prod"), F.count_if("is_test").alias("test"))
    title = head.select(*_row(0, F.concat(F.lit("PAGINATED: showing "), F.col("n").cast("string"), F.lit(f" of {total} files{_depth_label(max_depth)}\n"))))
    parts = [title, page.filter("not is_test").select(*_row(2, entry, F.col("path"))), page.filter("is_test").select(*_row(4, entry, F.col("path")))]
    if verbose:
        parts += [head.filter("prod > 0").select(*_row(1, F.lit("FILES [LOC, FUNCTIONS, CLASSES]"))), head.filter("test > 0").select(*_row(3, F.lit("\nTEST FILES [LOC, FUNCTIONS, CLASSES]")))]
    else:
        parts.append(head.filter("prod > 0 and test > 0").select(*_row(3, F.lit(""))))
    return _all(parts) if spark else title


# ---------------------------------------------------------------- one file


def _inside(f: Column, c: Column) -> Column:
    return (f["line"] >= c["line"]) & (f["end_line"] <= c["end_line"])


def _class(c: Column) -> Column:
    at = F.concat(c["name"], F.lit(":"), c["line"].cast("string"), F.lit("-"), c["end_line"].cast("string"))
    return F.when(F.size(c["inherits"]) > 0, F.concat(at, F.lit(" ("), F.array_join(c["inherits"], ", "), F.lit(")"))).otherwise(at)


def _block(title: str, body: Column) -> Column:
    """A titled part of a report; nothing without a body."""
    return F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"{title}\n"), body, F.lit("\n"))).otherwise("")


def classes_section(classes: Column, functions: Column) -> Column:
    """Classes in one line if they are few and have no methods, else each with its first methods."""
    own = lambda c: F.array_sort(F.transform(F.filter(functions, lambda f: _inside(f, c)), lambda f: F.struct(f["line"].alias("line"), f["name"].alias("name"))))
    method = lambda m: F.concat(F.lit("    "), m["name"], F.lit(":"), m["line"].cast("string"))
    many = lambda ms: F.concat(F.transform(F.slice(ms, 1, METHODS), method), F.when(F.size(ms) > METHODS, F.array(F.concat(F.lit("    ... ("), (F.size(ms) - METHODS).cast("string"), F.lit(" more)")))).otherwise(F.array().cast("array<string>")))
    each = F.array_join(F.flatten(F.transform(classes, lambda c: F.concat(F.array(F.concat(F.lit("  "), _class(c))), many(own(c))))), "\n")
    inline = F.concat(F.lit("  "), F.array_join(F.transform(classes, _class), "; "))
    has = F.exists(classes, lambda c: F.exists(functions, lambda f: _inside(f, c)))
    return F.when(F.size(classes) > 0, _block("C:", F.when((F.size(classes) <= INLINE) & ~has, inline).otherwise(each))).otherwise("")


def imports_section(imports: Column) -> Column:
    """Modules with their counts, in order."""
    modules = F.array_sort(F.array_distinct(F.transform(imports, lambda i: i["module"])))
    said = F.transform(modules, lambda m: F.concat(m, F.lit("("), F.size(F.filter(imports, lambda i: i["module"] == m)).cast("string"), F.lit(")")))
    return F.when(F.size(imports) > 0, _block("I:", F.concat(F.lit("  "), F.when(F.size(said) <= INLINE, F.array_join(said, "; ")).otherwise(F.array_join(said, "\n  "))))).otherwise("")


def _signatures(functions: Column, classes: Column, calls: Column) -> Column:
    top = F.filter(functions, lambda f: ~F.exists(classes, lambda c: _inside(f, c)))
    return F.transform(top, lambda f: call_marker(compact_signature(f["name"], f["parameters"], f["return_type"], f["line"], f["end_line"]), F.coalesce(F.try_element_at(calls, f["name"]), F.lit(0))))


def file_details(base: str | None = None) -> Column:
    """All of a file: classes with methods, functions outside of them, imports."""
    f, c, i = F.col("functions"), F.col("classes"), F.col("imports")
    path = strip_base(F.col("path"), base) if base else F.col("path")
    head = F.concat(F.when(F.col("is_test"), "FILE [TEST] ").otherwise("FILE: "), path, F.format_string("(%dL, %dF, %dC, %dI)\n", F.col("line_count"), F.size(f), F.size(c), F.size(i)))
    return F.concat(head, classes_section(c, f), _block("F:", wrapped(_signatures(f, c, F.col("call_frequency")))), imports_section(i))


def file_details_page(offset: int, size: int, verbose: bool = False, fields: list[str] | None = None) -> Column:
    """A page of a file's functions; classes and imports are on the first one."""
    f, c, i = F.col("functions"), F.col("classes"), F.col("imports")
    everything = not fields
    wants = lambda x: everything or "all" in fields or x in fields
    page = F.slice(f, offset + 1, size)
    out = [F.concat(F.lit("FILE: "), "path", F.format_string(f" (%dL, {offset + 1}-%d/%dF, %dC, %dI)\n", F.col("line_count"), F.size(page) + offset, F.size(f), F.size(c), F.size(i)))]
    if wants("classes") and not offset:
        out.append(classes_section(c, f))
    if wants("imports") and not offset and (verbose or not everything):
        out.append(imports_section(i))
    if wants("functions"):
        out.append(_block("F:", wrapped(_signatures(page, c, F.col("call_frequency")))))
    return F.concat(*out)


def file_summary() -> Column:
    """A large file in short: its largest functions, classes and imports."""
    f, c, i = F.col("functions"), F.col("classes"), F.col("imports")
    span = lambda x: F.greatest(x["end_line"] - x["line"], F.lit(0))
    # The largest first; those of one size stay in the file's order.
    order = F.array_sort(F.transform(f, lambda x, k: F.struct((-span(x)).alias("s"), k.alias("k"), x.alias("x"))))
    params = lambda x: F.when(F.size(x["parameters"]) > 0, F.concat(F.lit("("), F.array_join(x["parameters"], ", "), F.lit(")"))).otherwise("")
    functions = F.array_join(F.transform(F.slice(order, 1, 10), lambda o: F.concat(F.lit("  "), o["x"]["line"].cast("string"), F.lit(":"), o["x"]["end_line"].cast("string"), F.lit(": "), o["x"]["name"], F.lit(" "), params(o["x"]), F.lit(" ["), (-o["s"]).cast("string"), F.lit("L]"))), "\n")
    few = F.concat(F.lit("  "), F.array_join(F.transform(c, _class), "; "))
    many = F.concat(F.lit("  "), F.size(c).cast("string"), F.lit(" classes total\n"), F.array_join(F.transform(F.slice(c, 1, 5), lambda x: F.concat(F.lit("    "), x["name"])), "\n"), F.lit("\n    ... and "), (F.size(c) - 5).cast("string"), F.lit(" more"))
    imports = F.array_join(F.transform(i, lambda x: F.concat(F.lit("  "), x["module"], F.when(F.size(x["items"]) > 0, F.concat(F.lit(": "), F.array_join(x["items"], ", "))).otherwise(""))), "\n")
    part = lambda title, items, body: F.when(F.size(items) > 0, F.concat(_block(title, body), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("FILE:\n  path: "), "path", F.format_string("\n  %dL, %dF, %dC\n\n", F.col("line_count"), F.size(f), F.size(c)), part("TOP FUNCTIONS BY SIZE:", f, functions), part("CLASSES:", c, F.when(F.size(c) <= INLINE, few).otherwise(many)),
        part("IMPORTS:", i, imports), F.lit("SUGGESTION:\nUse analyze_file for full function list, signatures, imports, and classes\n"),
    )


def module_info() -> Column:
    """names and lines of a module's functions, and its imports with their items."""
    f, i = F.col("functions"), F.col("imports")
    names = F.array_join(F.transform(f, lambda x: F.concat(x["name"], F.lit(":"), x["line"].cast("string"))), ", ")
    modules = F.array_join(F.transform(i, lambda x: F.when(F.size(x["items"]) > 0, F.concat(x["module"], F.lit(":"), F.array_join(x["items"], ", "))).otherwise(x["module"])), "; ")
    head = F.concat(F.lit("FILE: "), base_name(F.col("path")), F.format_string(" (%dL, %dF, %dI)\n", F.col("line_count"), F.size(f), F.size(i)))
    return F.concat(head, F.when(F.size(f) > 0, _block("F:", F.concat(F.lit("  "), names))).otherwise(""), F.when(F.size(i) > 0, _block("I:", F.concat(F.lit("  "), modules))).otherwise(""))


def command_output() -> Column:
    """A command's exit and output: streams as they came, or each by itself if there is no joint one."""
    note = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"Full {label} available at: "), c, F.lit("\n"))).otherwise("")
    body = F.when(F.coalesce("interleaved", F.lit("")) == "", F.concat(F.lit("Stdout:\n"), "stdout", F.lit("\n\nStderr:\n"), "stderr")).otherwise(F.concat(F.lit("Output:\n"), "interleaved"))
    return F.concat(F.lit("Command: "), "command", F.lit("\nExit code: "), F.coalesce(F.col("exit_code").cast("string"), F.lit("null")), F.lit("\nOutput truncated: "), F.col("output_truncated").cast("string"), F.lit("\n"), note("output", "stdout_path"), note("stderr", "stderr_path"), note("output", "interleaved_path"), body)


# ---------------------------------------------------------------- symbols


def tree_lines(chains: DataFrame, symbol: str, arrow: str, block: int) -> DataFrame:
    """First items of chains, under each the second ones, most frequent first; (none) without chains."""
    t = chain_tree(chains)
    parents = t.select("parent").distinct().select(*_row(block, F.concat(F.lit(f"  {symbol} {arrow} "), "parent"), F.concat("parent", F.lit("\x01"))))
    times = F.when(F.col("n") > 1, F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise("")
    children = t.filter("child <> ''").select(*_row(block, F.concat(F.lit(f"    {arrow} "), "child", times), F.concat("parent", F.lit("\x01\x01"), F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0"), "child")))
    return parents.unionByName(children).unionByName(_none(chains, block))


def _none(rows: DataFrame, block: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(*_row(block, F.lit("  (none)")))


def sites_lines(sites: DataFrame, block: int, base: str | None = None) -> DataFrame:
    """Writes, then reads, each with its function and line."""
    path = strip_base(F.col("path"), base) if base else F.col("path")
    scope = F.when(F.col("scope").isNotNull(), F.concat("scope", F.lit("()"))).otherwise("")
    wr = F.when(F.col("kind") == "write_read", " [write_read]").otherwise("")
    line = F.concat(F.lit("    "), path, F.lit(":"), F.col("line").cast("string"), F.lit("  "), scope, F.lit("  "), snippet_one_line(F.col("snippet")), wr)
    read = F.col("kind") == "read"
    heads = sites.select(read.alias("read")).distinct().select(*_row(block, F.when(F.col("read"), "  READS").otherwise("  WRITES"), F.when(F.col("read"), "1").otherwise("0")))
    return heads.unionByName(sites.select(*_row(block, line, F.concat(F.when(read, "1").otherwise("0"), F.lit("\x01"), F.lpad(F.col("ord").cast("string"), 12, "0")))))


def next_page(mode: str, cursor: str | None, callees: bool, sites: bool, summary: bool = False) -> str | None:
    """The mode that follows an exhausted page: callers, callees, defuse; none in a summary or while a page follows."""
    if cursor or summary or mode not in ("callers", "callees"):
        return None
    if mode == "callers" and callees:
        return "callees"
    return "defuse" if sites and (mode == "callees" or not callees) else None


def focus_lines(focus, base: str | None = None) -> DataFrame:
    """A symbol: definitions, callers, tests, callees, files and sites (``focused.Focus``)."""
    spark = focus.definitions.sparkSession
    show = lambda c: strip_base(c, base) if base else c
    parts = [focus.head().select(*_row(0, F.col("line"))), _fixed(spark, 1, f"DEPTH: {focus.follow_depth}"), *_defined(focus, base), _fixed(spark, 4, "CALLERS:"), tree_lines(focus.production, focus.symbol, "<-", 5)]
    tests = focus.tests.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(show(F.col("chain")[0]["path"]))), ", ").alias("files")).filter("n > 0")
    parts.append(tests.select(*_row(6, F.concat(F.lit("CALLERS (test): "), F.col("n").cast("string"), F.lit(" test functions (in "), "files", F.lit(")")))))
    parts += [_fixed(spark, 7, "CALLEES:"), tree_lines(focus.outgoing, focus.symbol, "->", 8), _fixed(spark, 9, "FILES:")]
    files = focus.files().withColumn("t", is_test(F.col("path")))
    place = _in_path_order(F.col("path"))
    parts += [_none(files, 10), files.filter("not t").select(*_row(10, F.concat(F.lit("  "), show(F.col("path"))), place)), files.filter("t").limit(1).select(*_row(11, F.lit("  TEST FILES:"))), files.filter("t").select(*_row(12, F.concat(F.lit("    "), show(F.col("path"))), place))]
    if focus.sites is not None:
        n = focus.site_counts()
        parts += [n.filter("n > 0").select(*_row(13, F.format_string(f"DEF-USE SITES  {focus.symbol}  (%d total: %d writes, %d reads)", F.col("n"), F.col("writes"), F.col("reads")))), sites_lines(focus.sites, 14, base)]
    return _all(parts)


def _defined(focus, base: str | None) -> list[DataFrame]:
    spark, d = focus.definitions.sparkSession, focus.definitions
    path = strip_base(F.col("path"), base) if base else F.col("path")
    found = d.agg(F.count(F.lit(1)).alias("n")).select(*_row(2, F.when(F.col("n") > 0, "DEFINED:").otherwise("DEFINED: (not found)")))
    return [found, d.select(*_row(3, F.concat(F.lit("  "), path, F.lit(":"), F.col("line").cast("string")), F.concat(_in_path_order(F.col("path")), F.lit("\x01"), F.lpad(F.col("line").cast("string"), 12, "0"))))] if spark else []


def focus_summary_lines(focus, base: str | None = None, n: int = 10) -> DataFrame:
    """A symbol in short: the most frequent callers and callees, ties by name."""
    spark = focus.definitions.sparkSession
    first = lambda c: c.select(F.col("chain")[0]["symbol"].alias("name"), F.col("chain")[0]["path"].alias("path"))
    often = lambda c: first(c).groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.min("path").alias("path")).orderBy(F.desc("k"), "name").limit(n)
    place = F.concat(F.lpad((F.lit(10**12) - F.col("k")).cast("string"), 13, "0"), "name")
    path = strip_base(F.col("path"), base) if base else F.col("path")
    parts = [focus.head().select(*_row(0, F.col("line"))), _fixed(spark, 1, f"DEPTH: {focus.follow_depth}"), *_defined(focus, base)]
    parts += [_fixed(spark, 4, f"CALLERS (top {n}):"), often(focus.production).select(*_row(5, F.concat(F.lit("  "), "name", F.lit(" "), path), place)), _none(focus.production, 5)]
    tests = focus.tests.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("chain")[0]["path"]).alias("files")).filter("n > 0")
    parts.append(tests.select(*_row(6, F.format_string("CALLERS (test): %d test functions (in %d files)", F.col("n"), F.col("files")))))
    parts += [_fixed(spark, 7, f"CALLEES (top {n}):"), often(focus.outgoing).select(*_row(8, F.concat(F.lit("  "), "name"), place)), _none(focus.outgoing, 8), _fixed(spark, 9, "SUGGESTION:\nUse summary=false with force=true for full output")]
    if focus.sites is not None:
        parts.append(focus.site_counts().filter("n > 0").select(*_row(10, F.format_string("DEF-USE SITES: %d total (%d writes, %d reads)", F.col("n"), F.col("writes"), F.col("reads")))))
    return _all(parts)


def focus_page_lines(focus, page: DataFrame, mode: str, total: int, offset: int, base: str | None = None) -> DataFrame:
    """A page of a symbol's callers, callees or sites."""
    spark, n = page.sparkSession, page.count()
    if mode == "defuse":
        return _fixed(spark, 0, f"DEF-USE SITES  {focus.symbol}  ({offset + 1 if n else 0}-{offset + n if n else 0} of {total})").unionByName(sites_lines(page, 1, base))
    show = lambda c: strip_base(c, base) if base else c
    callers, callees, defs = focus.production.count(), focus.outgoing.count(), focus.definitions.count()
    tests = focus.tests.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(show(F.col("chain")[0]["path"]))), ", ").alias("files")).filter("n > 0")
    head = _fixed(spark, 0, f"FOCUS: {focus.symbol} ({defs} defs, {callers} callers, {callees} callees)")
    about = F.concat(F.lit("CALLERS (test): "), F.col("n").cast("string"), F.lit(" test functions"))
    if mode == "callers":
        end = _fixed(spark, 4, f"CALLEES: {callees} (use cursor for callee pagination)" if callees else "CALLEES: (none)")
        return _all([head, _fixed(spark, 1, f"CALLERS ({offset + 1}-{offset + n} of {total}):"), tree_lines(page, focus.symbol, "<-", 2), tests.select(*_row(3, F.concat(about, F.lit(" (in "), "files", F.lit(")")))), end])
    return _all([head, _fixed(spark, 1, f"CALLERS: {callers} production callers"), tests.select(*_row(2, about)), _fixed(spark, 3, f"CALLEES ({offset + 1}-{offset + n} of {total}):"), tree_lines(page, focus.symbol, "->", 4)])
