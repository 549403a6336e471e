"""What goes wrong only on larger tables, on the smallest rows that show it."""

from pathlib import Path

from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import extract, sessions, sites, tokens, trees
from lodestone.plans import languages, registry, relational
from lodestone.session import shared_folder


def test_rank_test_of_millions(spark):
    n = 2_100_000  # n * n * (2 n + 1) is beyond a long
    rows = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("condition"), (F.col("id") % 4).cast("double").alias("score"))
    r = sessions.rank_tests(rows, "score").first()
    # A holds 0 and 2, B holds 1 and 3: A wins (n / 2) ** 2 of the pairs.
    u = (n // 2) ** 2
    assert (r.n1, r.n2, r.u, r.r) == (n, n, float(u), round(1 - 2 * u / n**2, 4))
    assert r.z == round((u - n * n / 2) / (n * n * (2 * n + 1) / 12) ** 0.5, 4)


def test_numbers_are_no_years(spark):
    row = spark.sql("SELECT '5000' AS a, '123456' AS b, '2024-01-01T00:00:00Z' AS c, '12.5' AS d, 'x' AS e")
    got = row.select(*[F.unix_micros(scalars.any_timestamp(F.col(c))) for c in "abcde"]).first()
    assert tuple(got) == (5_000_000_000, 123_456_000_000, 1_704_067_200_000_000, 12_500_000, None)
    turns = spark.createDataFrame([(1, 0, "995"), (1, 1, "1056")], "session int, idx int, ts string")
    assert sessions.wall_time(turns).first().wall_s == 61


def test_days_after_the_year_9999(spark):
    days = spark.sql("SELECT unnest AS ms FROM (SELECT explode(array(253402300799999L, 253402300800000L, 311040000000000L)) AS unnest)")
    assert [r.d for r in days.select(scalars.utc_day(F.col("ms")).alias("d")).collect()] == ["9999-12-31", "10000-01-01", "11826-06-20"]


def test_sketches_are_near_for_many_parts(spark, tmp_path):
    rows = spark.range(1_200_000).select(F.lit("A").alias("l_returnflag"), (F.col("id") + 1).alias("l_partkey"), (F.col("id") % 50).cast("double").alias("l_quantity"))
    rows.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS l_returnflag, CAST(NULL AS BIGINT) AS l_partkey, 1.0D AS l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = relational._approximate(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == [("A", 1_200_000, True, True), (None, 0, True, True)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_work_of_a_small_file_is_spread(spark):
    files = spark.range(200).coalesce(1)
    py = files.select(F.concat(F.lit("a"), "id", F.lit(".py")).alias("path"), F.lit("def f(x):\n    total = x\n    return total\n").alias("content"))
    go = files.select(F.concat(F.lit("a"), "id", F.lit(".go")).alias("path"), F.lit("package p\nfunc f() { g(1) }\n").alias("content"))
    for made in (extract.extract(py), tokens.tokens(go), trees.trees(py, "python")):
        tasks = made.groupBy(F.spark_partition_id()).agg(F.count_distinct("path").alias("n")).collect()
        assert len(tasks) > 1 and sum(r.n for r in tasks) == 200
    # Reads, writes and ranks come from one extraction.
    assert "MapInArrow" not in plan_of(extract.def_use(extract.extract(py), "total"))


def test_rows_made_by_python_are_not_sent_to_the_driver(spark, tmp_path):
    spark.range(50).select(F.concat(F.lit("a"), "id", F.lit(".go")).alias("path"), F.lit("package p\nfunc f(x int) { x = g(x) }\n").alias("content")).write.parquet(f"{tmp_path}/go")
    spark.range(50).select(F.concat(F.lit("a"), "id", F.lit(".py")).alias("path"), F.lit("def f(x):\n    return g(x)\n").alias("content")).write.parquet(f"{tmp_path}/py")
    go, py = spark.read.parquet(f"{tmp_path}/go"), spark.read.parquet(f"{tmp_path}/py")
    for df, n in ((tokens.functions(go), 50), (tokens.calls(go), 50), (tokens.references(go), 50), (sites.sites(go, ["x"]), 150), (trees.captures(py, "(function_definition name: (identifier) @f body: (block (return_statement (call function: (identifier) @g))))"), 100)):
        assert "BroadcastExchange" not in plan_of(df)
        assert df.count() == n


def test_only_what_the_kinds_need_is_visited():
    deep = "import os\nx = " + "1 + " * 700 + "1\nclass A(B):\n    def f(self, y=(lambda: 0)): return g(y)\n"
    assert [r[0] for r in extract.rows_of(deep, "python")] == ["error"]
    for kind, name in (("import", "os"), ("class", "A"), ("function", "f")):
        assert [r[:2] for r in extract.rows_of(deep, "python", kinds=frozenset((kind,)))] == [(kind, name)]
    nested = "try:\n    import a\nexcept E:\n    def f(): pass\nelse:\n    class C: pass\nfinally:\n    import b\nmatch x:\n    case 1:\n        import c\nfor i in g(i):\n    y: T = h(i)\nelse:\n    y += k(y)\n"
    rust = "impl T for S { fn f(&self) -> X { g(1) } }\nstruct S;\nuse a::b;\n"
    for text, language in ((nested, "python"), (rust, "rust"), *((c.replace("{k}", "7"), k) for k, (_, shapes) in languages.SHAPES.items() for c, _ in shapes)):
        every = extract.rows_of(text, language)
        for kinds in ({"impl_trait"}, {"import"}, {"class"}, {"function"}, {"reference"}, {"call"}, {"site"}, {"function", "class", "import"}):
            assert extract.rows_of(text, language, kinds=frozenset(kinds)) == [r for r in every if r[0] in kinds], (language, kinds)


def test_sources_are_made_after_the_shuffle(spark):
    for name in ("e8_impl_traits", "e5_imports", "e1_e3_go"):
        plan = plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "hashpartitioning(p_partkey" in plan and plan.count("MapInArrow") == 1 and "hashpartitioning(path#" not in plan.split("MapInArrow")[-1], plan


def exchanges(df):
    return plan_of(df).count("Exchange ")


def test_functions_of_brackets_leave_no_tokens_on_disk(spark):
    df = registry.queries()["e3_bracket_functions"](spark, "/root/testdata/sf0.001")
    assert exchanges(df) == 1 and "hashpartitioning(p_partkey" in plan_of(df) and plan_of(df).count("MapInArrow") == 1 and "ExistingRDD" not in plan_of(df)
    odd = [("a.go", "func (x T"), ("b.go", "func f() { return func ("), ("c.java", "class A { void m() { n(List<A> (")]
    assert [tuple(r) for r in tokens.functions(spark.createDataFrame(odd, "path string, content string")).orderBy("path").collect()] == [("b.go", "f", 1, 1), ("c.java", "m", 1, 1)]


def test_calls_in_brackets_leave_no_tokens_on_disk(spark):
    df = registry.queries()["e4_bracket_calls"](spark, "/root/testdata/sf0.001")
    assert exchanges(df) == 1 and "hashpartitioning(p_partkey" in plan_of(df) and plan_of(df).count("MapInArrow") == 1 and "ExistingRDD" not in plan_of(df)
    # Functions that end together: what follows is in neither.
    row = ("a.c", "int f(int a)\nint g(int b) { h(a); }\nint k = m(1);\n")
    assert {(r.caller, r.callee) for r in tokens.calls(spark.createDataFrame([row], "path string, content string")).collect()} == {("g", "h"), ("<module>", "m")}


def test_bound_sites_leave_no_tokens_on_disk(spark):
    df = registry.queries()["e9_bound_sites"](spark, "/root/testdata/sf0.001")
    assert exchanges(df) == 1 and "hashpartitioning(p_partkey" in plan_of(df) and plan_of(df).count("MapInArrow") == 1 and "ExistingRDD" not in plan_of(df)
    # An unclosed bar of Rust and unclosed parameters.
    odd = [("a.rs", "fn f() { let g = |x"), ("b.ts", "function f(x")]
    assert {(r.path, r.kind, r.declared_line) for r in sites.sites(spark.createDataFrame(odd, "path string, content string"), ["x"]).collect()} == {("a.rs", "read", 1), ("b.ts", "read", None)}


def test_def_use_holds_a_packed_row_a_file(spark):
    shared = Path(shared_folder(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    files = spark.range(2_000).select(F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".go")).alias("path"), F.lit("package p\nfunc f(x int) {\n" + "\tx = g(x)\n" * 20 + "}\n").alias("content"))
    before = held()
    found = sites.def_use(files, "x")
    assert held() - before < 2_000 * 400  # 41 sites a file
    got = [(r.ord, r.path, r.kind, r.line, r.column) for r in found.collect()]
    order = [(k, f"a{p:04d}.go", line, col) for k, places in (("write", [(line, 1) for line in range(3, 23)]), ("read", [(2, 7), *((line, 7) for line in range(3, 23))])) for p in range(2_000) for line, col in places]
    assert sorted(got) == [(n, p, k, line, col) for n, (k, p, line, col) in enumerate(order, 1)]
    # A path that comes twice is one file to the order, files without the name have no place in it.
    twice = spark.createDataFrame([("b.c", "int x = 1;\nint y = x;\n"), ("b.c", "\nint x = 2;\n"), ("a.c", "int y;"), ("c.c", None)], "path string, content string")
    assert [(r.ord, r.path, r.kind, r.line) for r in sites.def_use(twice, "x").orderBy("ord").collect()] == [(1, "b.c", "write", 1), (2, "b.c", "write", 2), (3, "b.c", "read", 2)]
    assert sites.def_use(twice, "z").count() == 0
