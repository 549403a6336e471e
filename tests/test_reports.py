"""Reports, the focused analysis, request checks, and faults that were found in scalar and stream operators."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import corpus, focused, render, requests, text
from lodestone.operators.ranks import global_rank
from lodestone.sources import files, stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


FILE = "path string, language string, line_count bigint, function_count bigint, class_count bigint, is_test boolean"
FILES = [("src/a.py", "python", 10, 2, 1, False), ("src/b.py", "python", 5, 0, 0, False), ("src/core/c.rs", "rust", 7, 3, 0, False), ("tests/t.py", "python", 4, 1, 0, True), ("x.md", "markdown", 3, 0, 0, False), ("src-x/d.py", "python", 0, 0, 0, False)]


def test_directory_reports(spark):
    f = spark.createDataFrame(FILES, FILE)
    e = corpus.entries(f)
    assert render.text(render.structure_lines(e, f, 2)) == (
        "6 files, 29L, 6F, 1C (python 66%)\nSUMMARY:\nShown: 6 files (5 prod, 1 test), 29L, 6F, 1C (max_depth=2)\nLanguages: markdown (16%), python (66%), rust (16%)\n\nPATH [LOC, FUNCTIONS, CLASSES]\n"
        "src/\n  a.py [10L, 2F, 1C]\n  b.py [5L]\n  core/\n    c.rs [7L, 3F]\nsrc-x/\ntests/\nx.md [3L]\n\nTEST FILES [LOC, FUNCTIONS, CLASSES]\n  t.py [4L, 1F]\n"
    )
    got = render.text(render.summary_lines(e, f, 1, spark.createDataFrame([("src", 9), ("src-x", 1), ("tests", 1)], "component string, n bigint")))
    assert got == (
        "SUMMARY:\n6 files (5 prod, 1 test), 29L, 6F, 1C (max_depth=1)\nLanguages: markdown (16%), python (66%), rust (16%)\n\nSTRUCTURE (depth 1):\n"
        "  src/ [9 files total; showing 3 at depth=1, 22L, 5F, 1C] top: a.py(1C)  sub: core/\n  src-x/ [1 files, 0L, 0F, 0C]\n  tests/ [1 files, 4L, 1F, 0C]\n  x.md [3L]\n\n"
        "SUGGESTION: Largest source directory: src/ (9 files total). For module details, re-run with path=src and max_depth=2.\n"
    )
    none = f.limit(0)
    assert render.text(render.structure_lines(corpus.entries(none), none)).startswith("0 files, 0L, 0F, 0C (unknown 0%)\nSUMMARY:\nShown: 0 files (0 prod, 0 test), 0L")
    assert render.text(render.summary_lines(corpus.entries(none), none)).endswith("SUGGESTION:\nUse a narrower path for details (e.g., analyze src/core/)\n")
    page = f.filter("path in ('src/a.py', 'tests/t.py')")
    assert render.text(render.file_page_lines(page, 6, 2, "src")) == "PAGINATED: showing 2 of 6 files (max_depth=2)\n\na.py [10L, 2F, 1C]\n\ntests/t.py [4L, 1F]\n"
    assert "FILES [LOC, FUNCTIONS, CLASSES]\nsrc/a.py [10L, 2F, 1C]\n\nTEST FILES [LOC, FUNCTIONS, CLASSES]\n" in render.text(render.file_page_lines(page, 6, verbose=True))
    full, short = render.structure_lines(e, f), render.summary_lines(e, f)
    assert render.shown(full, short) is full and render.shown(full, short, limit=100) is short and render.shown(full, short, True) is short and render.shown(full, short, False, 1) is full


UNIT = "path string, line_count bigint, is_test boolean, functions array<struct<name:string,line:bigint,end_line:bigint,parameters:array<string>,return_type:string>>, classes array<struct<name:string,line:bigint,end_line:bigint,inherits:array<string>>>, imports array<struct<module:string,items:array<string>>>, call_frequency map<string,int>"


def test_file_reports(spark):
    fs = [("top", 1, 3, ["a", "b: int"], "str"), ("m1", 6, 7, ["self"], None), ("m2", 8, 9, [], None)]
    cs = [("K", 5, 20, ["Base", "Other"])]
    ims = [("os", []), ("re", ["compile"]), ("os", ["path"])]
    many = [(f"function_number_{k}", k, k, [], None) for k in range(9)]
    rows = [("d/a.py", 20, False, fs, cs, ims, {"top": 5}), ("d/tests/b.py", 9, True, many, [("P", 30, 31, []), ("Q", 40, 41, ["P"])], [], {}), ("e", 0, False, [], [], [], {})]
    t = spark.createDataFrame(rows, UNIT)
    got = [r.x for r in t.select(render.file_details("d").alias("x")).collect()]
    assert got[0] == "FILE: a.py(20L, 3F, 1C, 3I)\nC:\n  K:5-20 (Base, Other)\n    m1:6\n    m2:8\nF:\n  top(a, b: int) -> str :1-3•5\nI:\n  os(2); re(1)\n"
    assert got[1].startswith("FILE [TEST] tests/b.py(9L, 9F, 2C, 0I)\nC:\n  P:30-31; Q:40-41 (P)\nF:\n  function_number_0() :0-0, ") and all(len(x) <= 100 for x in got[1].split("\n"))
    assert got[2] == "FILE: e(0L, 0F, 0C, 0I)\n"
    page = [r.x for r in t.select(render.file_details_page(1, 2).alias("x")).collect()]
    assert page[0] == "FILE: d/a.py (20L, 2-3/3F, 1C, 3I)\n" and page[1].endswith("F:\n  function_number_1() :1-1, function_number_2() :2-2\n")
    assert t.select(render.file_details_page(0, 1, fields=["imports"]).alias("x")).first().x == "FILE: d/a.py (20L, 1-1/3F, 1C, 3I)\nI:\n  os(2); re(1)\n"
    short = [r.x for r in t.select(render.file_summary().alias("x")).collect()]
    assert short[0] == "FILE:\n  path: d/a.py\n  20L, 3F, 1C\n\nTOP FUNCTIONS BY SIZE:\n  1:3: top (a, b: int) [2L]\n  6:7: m1 (self) [1L]\n  8:9: m2  [1L]\n\nCLASSES:\n  K:5-20 (Base, Other)\n\nIMPORTS:\n  os\n  re: compile\n  os: path\n\nSUGGESTION:\nUse analyze_file for full function list, signatures, imports, and classes\n"
    assert t.select(render.module_info().alias("x")).first().x == "FILE: a.py (20L, 3F, 3I)\nF:\n  top:1, m1:6, m2:8\nI:\n  os; re:compile; os:path\n"
    eleven = spark.createDataFrame([("p", 1, False, [(f"m{k}", k, k, [], None) for k in range(12)], [("K", 0, 50, [])] + [(f"C{k}", 60, 61, []) for k in range(10)], [], {})], UNIT)
    assert "    m9:9\n    ... (2 more)\n  C0:60-61\n" in eleven.select(render.file_details().alias("x")).first().x
    assert "  11 classes total\n    K\n    C0\n    C1\n    C2\n    C3\n    ... and 6 more\n" in eleven.select(render.file_summary().alias("x")).first().x
    runs = spark.createDataFrame([("ls", 0, False, "a\n", "", "a\n", None, None, None), ("x", None, True, "", "", "", "/t/o", "/t/e", None)], "command string, exit_code int, output_truncated boolean, stdout string, stderr string, interleaved string, stdout_path string, stderr_path string, interleaved_path string")
    assert [r.x for r in runs.select(render.command_output().alias("x")).collect()] == ["Command: ls\nExit code: 0\nOutput truncated: false\nOutput:\na\n", "Command: x\nExit code: null\nOutput truncated: true\nFull output available at: /t/o\nFull stderr available at: /t/e\nStdout:\n\n\nStderr:\n"]


def test_focus(spark):
    fn = spark.createDataFrame([("main", "src/m.rs", 1), ("work", "src/w.rs", 5), ("help", "src/h.rs", 9), ("test_work", "tests/t.rs", 2)], "name string, path string, line bigint")
    calls = spark.createDataFrame([("main", "x::work", "src/m.rs", 2), ("other", "work", "src/o.rs", 3), ("test_work", "work", "tests/t.rs", 3), ("work", "help", "src/w.rs", 6), ("work", "gone", "src/w.rs", 7)], "caller string, callee string, path string, line bigint")
    sites = spark.createDataFrame([("src/w.rs", 6, 1, "write", "work", "a\n  work = 1\nb"), ("src/w.rs", 7, 1, "read", None, "x\nuse(work)\ny"), ("src/w.rs", 8, 1, "write_read", "work", "x\nwork += 1\n")], "path string, line bigint, column int, kind string, scope string, snippet string")
    x = focused.focus(fn, fn.limit(0), calls, "WORK", "insensitive", 1, sites=sites)
    assert render.text(render.focus_lines(x, "src")) == (
        "FOCUS: work (1 defs, 2 callers, 1 callees)\nDEPTH: 1\nDEFINED:\n  w.rs:5\nCALLERS:\n  work <- main\n    <- work\n  work <- other\n    <- work\nCALLERS (test): 1 test functions (in tests/t.rs)\n"
        "CALLEES:\n  work -> work\n    -> gone\n    -> help\nFILES:\n  m.rs\n  o.rs\n  w.rs\nDEF-USE SITES  work  (3 total: 2 writes, 1 reads)\n  WRITES\n    w.rs:6  work()  work = 1\n    w.rs:8  work()  work += 1 [write_read]\n  READS\n    w.rs:7    use(work)\n"
    )
    short = render.text(render.focus_summary_lines(x))
    assert short.startswith("FOCUS: work (1 defs, 2 callers, 1 callees)\nDEPTH: 1\nDEFINED:\n  src/w.rs:5\nCALLERS (top 10):\n  main src/m.rs\n  other src/o.rs\nCALLERS (test): 1 test functions (in 1 files)\nCALLEES (top 10):\n  work\nSUGGESTION:\n") and short.endswith("DEF-USE SITES: 3 total (2 writes, 1 reads)\n")
    # Callers, then callees, then sites.
    seen, mode, offset = [], "callers", 0
    while mode:
        rows, total, then = x.page(mode, offset, 1)
        seen.append((mode, offset, total, render.text(render.focus_page_lines(x, rows, mode, total, offset)).split("\n")[0:2]))
        mode, offset = then or (None, 0)
    assert [s[:3] for s in seen] == [("callers", 0, 2), ("callers", 1, 2), ("callees", 0, 2), ("callees", 1, 2), ("defuse", 0, 3), ("defuse", 1, 3), ("defuse", 2, 3)]
    assert seen[0][3] == ["FOCUS: work (1 defs, 2 callers, 2 callees)", "CALLERS (1-1 of 2):"] and seen[4][3] == ["DEF-USE SITES  work  (1-1 of 3)", "  WRITES"]
    assert x.page("callers", 0, 100, summary=True)[2] is None
    lonely = focused.focus(fn, fn.limit(0), calls.limit(0), "help")
    assert "CALLERS:\n  (none)\nCALLEES:\n  (none)\nFILES:\n  src/h.rs\n" in render.text(render.focus_lines(lonely))
    with pytest.raises(LookupError):
        focused.focus(fn, fn.limit(0), calls, "nobody")


def test_request_checks(spark, tmp_path):
    heredocs = {
        "cat <<EOF\nhello\nEOF\n": None, "tee output.txt <<EOF\ncontent\nEOF\n": "file_write", "curl --data - <<EOF\ncontent\nEOF\n": "stdin_flag", "": None, "echo hello": None, "cat > f << EOF\nx\nEOF": "file_write", "cat >> f << EOF\nx\nEOF": "file_write",
        "tee -a f << EOF\nx\nEOF": "file_write", "printf 'c' > f << EOF\nEOF": "file_write", "dd of=f << EOF\nEOF": "file_write", "cp /dev/stdin f << EOF\nEOF": "file_write", "> f << EOF\nEOF": "file_write", "(cat > f << EOF\nx\nEOF\n)": "file_write",
        "cat > $(cmd) << EOF\nEOF": "file_write", "cat << 'EOF'\nx": "unclosed", "echo '<< EOF'": None, "cat <<< word": None, "cat <<-EOF\n\tx\n\tEOF": None, "git commit -F - <<M\nx\nM": "stdin_flag", "cat 2>/dev/null <<EOF\nEOF": None,
    }
    assert {c: requests.heredoc_error(c) for c in heredocs} == heredocs
    assert requests.heredoc_error("cat <<EOF\nx\nEOF", True) == "stdin_conflict"
    for bad in ({"summary": True, "cursor": "x"}, {"import_lookup": True, "def_use": True, "symbol": "s"}, {"import_lookup": True}):
        with pytest.raises(ValueError):
            requests.check_modes(**bad)
    requests.check_modes(summary=False, cursor="x", import_lookup=True, symbol="s")
    with pytest.raises(ValueError):
        requests.check_impl_only(spark.createDataFrame([("a.py",)], "path string"))
    requests.check_impl_only(spark.createDataFrame([("a.RS",)], "path string"))
    root = tmp_path / "root"
    root.mkdir()
    assert requests.overwrite("new/dir/f.txt", "é", str(root)) == 2 and (root / "new/dir/f.txt").read_text() == "é" and os.listdir(root / "new/dir") == ["f.txt"]
    requests.overwrite("new/dir/f.txt", "b", str(root))
    assert (root / "new/dir/f.txt").read_text() == "b" and requests.inside_root("new", str(root)) == str(root / "new")
    (root / "out").symlink_to(tmp_path)
    for path in ("../x", "out/x", "/etc/passwd"):
        with pytest.raises(PermissionError):
            requests.overwrite(path, "x", str(root))
    with pytest.raises(FileNotFoundError):
        requests.inside_root("none", str(root))
    runs = spark.createDataFrame([(1, 30_000.0), (2, 30_001.0), (3, None)], "run int, latency_ms double")
    assert sorted(r.run for r in requests.counted(runs).collect()) == [1, 3]
    assert [(one(spark, requests.file_ext(F.lit(p))), one(spark, requests.file_language(F.lit(p)))) for p in ("a/b.RS", "x.zzz", "Makefile")] == [("rs", "rust"), ("other", None), (None, None)]


def test_scalar_faults(spark):
    assert [one(spark, scalars.tail(F.lit(s), n)) for s, n in (("éééé", 4), ("éééé", 3), ("abc", 2), ("abc", 9), ("a€", 1), ("😀b", 2), ("", 3))] == ["éé", "éé", "bc", "abc", "€", "😀b", ""]
    assert one(spark, scalars.match_lines(F.lit("a\\Eb\n\\E x\\Q"), F.lit("\\E"))) == [1, 2] and one(spark, scalars.match_lines(F.lit("q\\Q\nx"), F.lit("\\Q"))) == [1]
    rows = [("a\\E b \\E", "\\E", "$1", True, None), ("a\\E b \\E", "\\E", "z", False, None)]
    got = text.replace_block(spark.createDataFrame(rows, "content string, old_text string, new_text string, replace_all boolean, expected_hash string")).collect()
    assert [(r.status, r.new_content, r.match_lines) for r in got] == [("ok", "a$1 b $1", None), ("ambiguous", "a\\E b \\E", [1, 1])]
    css = spark.createDataFrame([("p", "@media x {\n  .deep .er {\n\t#id,\n}\n.a:hover {\n")], "path string, content string")
    assert [(r.name, r.line) for r in text.keys(css, "css").orderBy("line").collect()] == [(".deep .er", 2), ("#id", 3), (".a:hover", 5)]


def test_ignore_globs(spark, tmp_path):
    match = lambda p, s: files.glob_regex(p).fullmatch(s) is not None
    assert match("*.o", "a.o") and not match("src/*.o", "src/deep/a.o") and match("src/*.o", "src/a.o")
    assert match("**/foo", "foo") and match("**/foo", "a/b/foo") and not match("**/foo", "barfoo") and match("a/**/b", "a/b") and match("a/**/b", "a/x/y/b") and match("a/**", "a/x/y") and not match("a/**", "a")
    assert match("f[0-9]?", "f1x") and not match("f[!0-9]", "f1") and match("\\*x", "*x") and not match("\\*x", "ax") and not match("?", "/")
    for d in ("src/deep", "barfoo", "x/foo", "build"):
        (tmp_path / d).mkdir(parents=True)
    for p in ("src/a.o", "src/deep/a.o", "barfoo/k", "x/foo/k", "keep.log", "gone.log", "build/z", "x/build.py"):
        (tmp_path / p).write_text("")
    (tmp_path / ".gitignore").write_text("src/*.o\n**/foo\n*.log\n!keep.log\nbuild/\n")
    assert [p[0] for p in files.walk(str(tmp_path)) if not p[2]] == ["barfoo/k", "keep.log", "src/deep/a.o", "x/build.py"]
    assert [p[0] for p in files.walk(str(tmp_path), 1)] == ["barfoo", "keep.log", "src", "x"]


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(7)
    assert [(r.v, r.k) for r in global_rank(df, [F.desc("v")], "k").orderBy("k").collect()] == [(v, i + 1) for i, v in enumerate(sorted((i * 7919 % 1009 for i in range(1000)), reverse=True))]
    assert global_rank(df.limit(0), [F.col("v")], "k").count() == 0


def test_enclosing_is_the_innermost(spark):
    import random

    r = random.Random(3)
    fs = [(f"f{k % 3}", name, a, a + r.randint(0, 40)) for k in range(120) for name, a in [(f"n{k:03}", r.randint(1, 60))]]
    sites = [(f"f{k % 4}", r.randint(0, 110), k) for k in range(300)]
    got = {(x.path, x.line, x.site): x.caller for x in corpus.enclosing(spark.createDataFrame(sites, "path string, line int, site int"), spark.createDataFrame(fs, "path string, name string, line bigint, end_line bigint")).collect()}
    for path, line, site in sites:
        inner = max(((a, -b, n) for p, n, a, b in fs if p == path and a <= line <= b), default=None)
        assert got[path, line, site] == (inner[2] if inner else "<module>")


def test_streams_forget_and_drop(spark, tmp_path):
    from lodestone.streaming import metrics as S

    log = tmp_path / "in"
    log.mkdir()

    def put(name, rows):
        (log / name).write_text("".join(json.dumps({"session_id": "s", "duration_ms": 1, "output_chars": 1, **r}) + "\n" for r in rows))
        os.utime(log / name, (time.time(), time.time() + len(os.listdir(log))))

    day = 86_400_000
    put("a.jsonl", [{"ts": day * 10, "tool": "t", "result": "error"}, {"ts": day * 10 + 1, "tool": "u", "result": "error"}])
    put("b.jsonl", [{"ts": day * 20, "tool": "t", "result": "ok"}])
    put("c.jsonl", [{"ts": day * 2, "tool": "t", "result": "ok"}, {"ts": day * 21, "tool": "t", "result": "ok"}])  # the first is 18 days late
    put("d.jsonl", [{"ts": day * 40, "tool": "t", "result": "ok"}])
    stream = lambda: S.events(spark, str(log), files=1)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return q, spark.table(name)

    _, late = run(S.daily_trend(stream()), "late_q", "append")
    days = {r.day.date().isoformat() for r in late.collect()}
    assert "1970-01-03" not in days and {"1970-01-11", "1970-01-21", "1970-01-22"} <= days  # R7
    _, every = run(S.daily_trend(stream()), "every_q", "complete")
    assert every.count() == 6  # R8
    q, _ = run(S.breaker(stream(), 2), "state_q", "append")
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # R5: the streak of t has ended, that of u runs
    S.write_daily(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), batch=1).awaitTermination(180)
    names = [f for d, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".json")]
    assert len(names) == 6 and all(d.endswith(time.strftime("%Y-%m-%d", time.gmtime())) for d in os.listdir(tmp_path / "out") if d.startswith("date="))


def test_eviction_and_memory_sources(spark, tmp_path):
    top = str(tmp_path / "cache")
    stores.put_cached(spark.range(3), top, "t", "aa01")
    stores.put_cached(spark.range(4), top, "t", "bb01")
    for d, _, fs in os.walk(f"{top}/tool=t/shard=aa"):
        for f in fs:
            os.utime(f"{d}/{f}", (0, time.time() - 40 * 86_400))
    assert stores.fresh(spark, top).count() == 4 and stores.evict(spark, top, 30) >= 1
    spark.catalog.clearCache()
    assert spark.read.parquet(f"{top}/tool=t/shard=bb").count() == 4 and not [f for f in os.listdir(f"{top}/tool=t/shard=aa") if f.endswith(".parquet")]
    assert [(r.path, r.language) for r in files.literal(spark, [("a", "RUST", "fn x() {}")]).collect()] == [("a", "rust")]
    stores.shutdown_summary(spark.createDataFrame([("t", 5, 2, "s", 1)], "tool string, duration_ms bigint, output_chars bigint, session_id string, ord bigint"), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).count() == 1
