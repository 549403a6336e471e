"""Small cases of the engine's operators; the large ones are compared with SQL in test_oracles."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, scalars
from lodestone.operators import corpus, graph, sessions, telemetry, text
from lodestone.sources import files, stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    for s, n in (("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("a\nb", 2)):
        assert one(spark, scalars.line_count(F.lit(s))) == n
    assert [one(spark, scalars.strip_scope(F.lit(s))) for s in ("self.method", "Type::method", "module::sub::method", "method")] == ["method"] * 4
    assert one(spark, scalars.occurrences(F.lit("aXbXc"), F.lit("X"))) == 2 and one(spark, scalars.occurrences(F.lit("a"), F.lit(""))) == 0
    assert one(spark, scalars.match_lines(F.lit("x\ny x\nx"), F.lit("x"))) == [1, 2, 3]
    c = one(spark, scalars.encode_cursor(F.lit("callers"), F.lit(100)))
    assert one(spark, scalars.decode_cursor(F.lit(c))).asDict() == {"mode": "callers", "offset": 100}
    assert one(spark, scalars.candidates(F.array(*[F.lit(f"n{i:02}") for i in range(23)]))).endswith("n19 (and 3 more)")
    assert one(spark, scalars.cut_bytes(F.lit("é" * 60))) == "é" * 38 + "..."
    assert one(spark, scalars.any_timestamp(F.lit("2024-01-01T00:00:00Z"))) == one(spark, scalars.any_timestamp(F.lit("1704067200")))


@pytest.mark.parametrize("path,test", [("tests/a.rs", True), ("src/test_x.py", True), ("src/x_test.go", True), ("a/TestX.java", True), ("a/XTest.java", True), ("a/x.spec.ts", True), ("a/testing.rs", False), ("src/main.rs", False)])
def test_test_files(spark, path, test):
    assert one(spark, paths.is_test(F.lit(path))) is test


def test_languages(spark):
    assert [one(spark, paths.language_label(F.lit(p))) for p in ("a.RS", "b.tsx", "c.xyz", "Makefile", "d/.gitignore")] == ["rust", "tsx", "xyz", "unknown", "unknown"]


def test_pages(spark):
    df = spark.range(250)
    rows, cursor, total = corpus.page(df, ["id"], 100, 100)
    assert [r.id for r in rows.collect()] == list(range(100, 200)) and total == 250 and cursor
    rows, cursor, _ = corpus.page(df, ["id"], cursor=cursor)
    assert rows.count() == 50 and cursor is None
    assert corpus.page(df, ["id"], 300, 10)[0].count() == 0
    with pytest.raises(ValueError):
        corpus.page(df, ["id"], 0, 0)
    with pytest.raises(ValueError):
        corpus.page(df, ["id"], cursor="%%%")


EDGES = "node string, neighbor string, path string, line int, ord int"


def test_chains(spark):
    e = spark.createDataFrame([("C", "B", "f", 15, 1), ("B", "A", "f", 2, 1)], EDGES)
    first = graph.chains(e, "C", 2, incoming=True).orderBy("depth").first()
    assert [x.symbol for x in first.chain] == ["B", "A", "C"]
    assert graph.chains(e, "C", 0, incoming=True).count() == 1
    loop = spark.createDataFrame([("A", "B", "f", 1, 1), ("B", "A", "f", 2, 1)], EDGES)
    assert graph.chains(loop, "A", 3).count() == 2 and graph.chains(loop, "nobody", 2).count() == 0
    diamond = spark.createDataFrame([("A", "B", "f", 1, 1), ("A", "C", "f", 1, 2), ("B", "D", "f", 1, 1), ("C", "D", "f", 1, 1)], EDGES)
    assert {r.node: r.depth for r in graph.blast_radius(diamond, "A", 2).collect()} == {"B": 1, "C": 1, "D": 2}


def test_resolution(spark):
    names = spark.createDataFrame([("parse",), ("Parser",), ("parse_all",)], "name string")
    assert graph.resolve(names, "parse") == "parse" and graph.resolve(names, "PARSER", "insensitive") == "Parser"
    with pytest.raises(LookupError, match="ambiguous: Parser, parse, parse_all"):
        graph.resolve(names, "pars", "prefix")
    with pytest.raises(LookupError, match="not found"):
        graph.resolve(names, "x", "contains")
    calls = spark.createDataFrame([("main", c) for c in ("self.method", "Type::method", "module::method", "gone::away")], "caller string, callee string")
    got = graph.resolve_callees(calls, spark.createDataFrame([("method",)], "name string"))
    assert sorted(r.callee for r in got.collect()) == ["gone::away", "method", "method", "method"]


def test_impl_only(spark):
    calls = spark.createDataFrame([("main", "write", "a.rs", 3)], "caller string, callee string, path string, line int")
    traits = spark.createDataFrame([("Write", "WriterImpl", "a.rs", 9)], "trait_name string, impl_type string, path string, line int")
    assert [r.neighbor for r in graph.caller_edges(calls, None, traits, impl_only=True).collect()] == ["WriterImpl"]
    assert graph.caller_edges(calls, None, traits).count() == 2


def test_structural(spark):
    f = spark.createDataFrame([("a", "main", 1), ("a", "helper", 9), ("b", "main", 1), ("b", "helper", 9)], "path string, name string, line int")
    c = spark.createDataFrame([("a", "K", 20)], "path string, name string, line int")
    i = spark.createDataFrame([("a", "std::io")], "path string, module string")
    k = spark.createDataFrame([("main", "helper", "a"), ("main", "helper", "b"), ("main", "nobody", "a")], "caller string, callee string, path string")
    nodes, edges = graph.structural(f, c, i, k)
    assert nodes.count() == 8 and {r.kind: r["count"] for r in edges.groupBy("kind").count().collect()} == {"contains": 5, "imports": 1, "calls": 1}


def test_uris():
    assert graph.parse_uri("graph/ab12/blast-radius/main?depth=2") == {"hash": "ab12", "kind": "blast-radius", "argument": "main", "cursor": None, "depth": 2}
    assert graph.graph_offset(graph.graph_cursor(50)) == 50 and graph.graph_offset("!") is None
    with pytest.raises(ValueError):
        graph.parse_uri("graph/ab/none/x")


def test_regex_extractors(spark):
    def keys(language, content):
        return [r.name for r in text.keys(spark.createDataFrame([("p", content)], "path string, content string"), language).orderBy("line").collect()]

    assert keys("css", ".a {\n}\n#b, p\n") == [".a", "#b, p"]  # the line without what opens the rule
    assert keys("yaml", "name: x\n  nested: y\nver: 1\n") == ["name", "ver"]
    assert keys("json", '{\n  "a": 1,\n  "b": {\n      "deep": 2\n  }\n}') == ["a", "b"]
    assert keys("toml", "[pkg]\nx=1\n[dep.y]\n") == ["pkg", "dep.y"] and keys("toml", "") == []
    assert one(spark, text.frontmatter(F.lit("---\nimport X\n---\n<p/>"))) == "import X\n" and one(spark, text.frontmatter(F.lit("<p/>"))) is None


def test_edits(spark):
    rows = [("a\r\nb", "a\nb", "c", False, None), ("xx", "x", "y", False, None), ("xx", "x", "y", True, None), ("a", "q", "y", False, None), ("a", "", "y", False, None), ("a", "a", "y", False, "old")]
    got = text.replace_block(spark.createDataFrame(rows, "content string, old_text string, new_text string, replace_all boolean, expected_hash string")).collect()
    assert [(r.status, r.new_content) for r in got] == [("ok", "c"), ("ambiguous", "xx"), ("ok", "yy"), ("not_found", "a"), ("invalid", "a"), ("stale", "a")]


def test_filters(spark):
    runs = spark.createDataFrame([(1, "git pull", 0, [" create mode 1", "ok"]), (2, "git pull", 0, [" | 3 ++", ""]), (3, "git pull", 1, [" | 3 ++"]), (4, "ls", 0, ["a"]), (5, "git add .", 0, ["\x1b[1mx INF y\x1b[0m"]), (6, "mine", 0, ["keep me", "drop"])], "run_id int, command string, exit_code int, lines array<string>")
    rules = text.builtin_rules(spark, [("^mine", None, False, [], ["keep"], None, None)])
    got = {r.run_id: (r["lines"], r.filter_applied) for r in text.filtered(runs, rules).collect()}
    assert got[1] == (["ok"], "git pull") and got[2] == (["ok (up-to-date)"], "git pull") and got[3] == ([" | 3 ++"], None) and got[4] == (["a"], None)
    assert got[5] == (["ok staged"], "git add") and got[6] == (["keep me"], "^mine")
    assert one(spark, text.budget(F.array(F.lit("aaaa"), F.lit("b" * 29), F.lit("ccc")), 10)) == ["aaaa", "ccc"]


def test_whole_tables(spark, tmp_path):
    from lodestone.plans import registry

    q, d = registry.queries(), str(tmp_path)
    spark.sql("SELECT id AS p_partkey, 1 AS p_size FROM range(49, 60)").write.parquet(f"{d}/part.parquet")
    spark.sql("SELECT id AS l_orderkey, 2 AS l_linenumber, id AS l_partkey, 0.1D AS l_discount, 0.2D AS l_tax FROM range(395, 505)").write.parquet(f"{d}/lineitem.parquet")
    assert {r.path for r in q["e16_j12_wildcards"](spark, d).collect()} == {f"d/u{k}.py" for k in range(49, 60)}
    assert [r.path for r in q["o8_j11_def_use_order"](spark, d).orderBy("ord").collect()] == list(range(395, 505))
    assert {(r.path, r.writes, r.reads) for r in q["a12_p16_def_use_counts"](spark, d).collect()} == {(k, 1, 0) for k in range(395, 505)}
    assert q["x_unpivot"](spark, d).count() == 220


def test_cosine_of_every_twentieth(spark, tmp_path):
    import math
    import random

    from lodestone.plans import relational

    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(130)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(45)] + [(300, [0.0] * 6), (320, None), (340, [1.0, 2.0]), (341, [2.0, 1.0]), (None, [1.0] * 6)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and any(v)]
    want = []
    for q, a in good:
        if q % 20 == 0:
            cos = [(-round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6), i) for i, b in good if i != q and len(a) == len(b)]
            want += [(q, i, -c, k + 1) for k, (c, i) in enumerate(sorted(cos)[:3])]
    for options in ({}, {"rows": 20, "asked": 3}):
        assert sorted(tuple(x) for x in relational._cosine_all(spark, str(tmp_path), **options).collect()) == sorted(want)


def test_rank_test(spark):
    rows = [("A", v) for v in (1.0, 2.0, 2.0)] + [("B", v) for v in (2.0, 3.0)]
    r = sessions.rank_tests(spark.createDataFrame(rows, "condition string, score double"), "score").first()
    assert (r.u, r.n1, r.n2, r.r) == (1.0, 3, 2, round(1 - 2 / 6, 4))


def test_received_and_three_valued_flags(spark):
    m = spark.createDataFrame([(1, "exec_command", 0, "received", None), (2, "exec_command", 10, "ok", True), (3, "exec_command", 20, "error", False)], "ord int, tool string, duration_ms bigint, result string, summary_mode boolean").withColumns({"fields_projected": F.lit(None).cast("boolean"), "working_dir_used": F.lit(None).cast("boolean"), "stdin_provided": F.lit(None).cast("boolean")})
    assert telemetry.params_usage(m).collect()[0].asDict() == {"tool": "exec_command", "field": "summary_mode", "true_count": 1, "present": 2}
    assert telemetry.current(m.withColumn("ts", F.lit(0).cast("bigint")), include_received=False).count() == 2


def test_tree_and_rules(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    for p, c in (("src/a.py", "x = 1\n"), ("src/b.log", "?"), ("target/c.rs", ""), (".hidden", ""), (".gitignore", "target/\n*.log\n")):
        (tmp_path / p).write_text(c)
    assert [r.path for r in files.entries(spark, str(tmp_path)).orderBy("path").collect()] == ["src", "src/a.py"]
    assert [p[0] for p in files.walk(str(tmp_path), 1)] == ["src"]
    assert files.contents(spark, str(tmp_path / "src")).filter("path = 'a.py'").first().content == "x = 1\n"
    (tmp_path / "r.toml").write_text('schema_version = 1\n[[filters]]\nmatch_command = "^x"\nmax_lines = 3\n')
    assert files.filter_rules(str(tmp_path / "r.toml")) == [("^x", None, False, [], [], 3, None)] and files.filter_rules("/none") == []
    with pytest.raises(ValueError):
        files.changed_files(spark, str(tmp_path), "--output=x")


def test_logs_sessions_and_stores(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "metrics-2024-01-01.jsonl").write_text(json.dumps({"ts": 1, "tool": "exec_command", "duration_ms": 5}) + "\nbroken\n")
    (log / "metrics-2024-01-02.jsonl").write_text(json.dumps({"ts": 2, "tool": "exec_command", "duration_ms": 7}) + "\n")
    assert files.metric_log(spark, str(log)).count() == 2 and files.metric_log(spark, str(log), start="2024-01-02").first().duration_ms == 7
    for s, docs in (("20240101-a", {"plan": {"complexity": "SIMPLE"}, "validation": {"verdict": "PASS"}}), ("-skip", {"plan": {}}), ("20240102-b", {"build": {"pr_url": "u"}})):
        (tmp_path / "wt" / s / ".handoff").mkdir(parents=True)
        for k, v in docs.items():
            (tmp_path / "wt" / s / ".handoff" / f"{k}.json").write_text(json.dumps(v))
    got = {r.session_id: (r.incomplete, r.verdict, r.pr_url) for r in files.handoff_sessions(spark, str(tmp_path / "wt")).collect()}
    assert got == {"20240101-a": (False, "PASS", None), "20240102-b": (True, None, "u")}
    df = spark.range(3)
    stores.put_cached(df, str(tmp_path / "cache"), "t", "abcd")
    assert stores.get_cached(spark, str(tmp_path / "cache"), "t", "abcd").count() == 3 and stores.cache_stats(spark, str(tmp_path / "cache")).first().entries == 1
    stores.put_graph(df, df, str(tmp_path / "g"))
    assert stores.get_graph(spark, str(tmp_path / "g"))[0].count() == 3
    assert json.loads(stores.render(df, "json")) == [{"id": 0}, {"id": 1}, {"id": 2}] and stores.render(df, "csv").splitlines()[0] == "id"
    import sqlite3

    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("create table messages (id integer, body text)")
    db.executemany("insert into messages values (?, ?)", [(i, f"m{i}") for i in range(5)])
    db.commit()
    assert files.sqlite_table(spark, str(tmp_path / "s.db"), "messages", "id bigint, body string", "id, body", 2).count() == 5


def test_streams(spark, tmp_path):
    from lodestone.streaming import metrics as S

    log = tmp_path / "in"
    log.mkdir()
    rows = [{"ts": i * 1000, "tool": "exec_command", "session_id": "s", "duration_ms": i, "output_chars": 1, "result": "error" if i in (1, 2, 4) else "ok"} for i in range(6)]
    (log / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "broken\n")
    S.write_daily(S.events(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    q = S.running_totals(S.events(spark, str(log))).writeStream.format("memory").queryName("totals_q").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("totals_q").first().call_count == 6
    q = S.breaker(S.events(spark, str(log)), 2).writeStream.format("memory").queryName("breaker_q").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.ts, r.streak, r.tripped) for r in spark.table("breaker_q").orderBy("ts").collect()] == [(1000, 1, False), (2000, 2, True), (4000, 1, False)]
