"""Agent sessions, transcripts and benchmark scores: classification, sums, medians, pivots and rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import any_timestamp, cost_usd, pct

# Tool classes, commands that only keep house, places of results.
MCP_TOOLS = ("analyze_directory", "analyze_file", "analyze_module", "analyze_symbol")
NATIVE_TOOLS = ("Glob", "Grep", "Read", "Bash")
SYSTEM_COMMANDS = ("mkdir", "cd", "git", "ls", "pwd", "echo", "cat")
OUTPUT_PREFIXES = ("/tmp/", "results/")
STRUCTURAL = r"\b(fn|struct|enum|trait|impl)\s"


def tool_calls(messages: DataFrame) -> DataFrame:
    """Tool uses in the content of assistant messages; requests of an extension are named ext__name."""
    c = messages.filter("role = 'assistant'").select("session", "idx", F.posexplode("content").alias("pos", "c"))
    name = F.when(F.col("c.type") == "toolRequest", F.regexp_replace(F.col("c.name"), r"\.", "__")).otherwise(F.col("c.name"))
    return c.filter(F.col("c.type").isin("tool_use", "toolRequest")).select("session", "idx", "pos", name.alias("tool"), F.col("c.input").alias("input"))


def tool_class(tool: Column, command: Column, file: Column, outputs: tuple[str, ...] = OUTPUT_PREFIXES, target: str | None = None) -> Column:
    """Mcp, native, system (a housekeeping command), output (looks at results) or other."""
    first = F.get(F.split(F.trim(command), r"\s+"), F.lit(0))
    starts = lambda c: F.coalesce(sum((F.startswith(c, F.lit(p)).cast("int") for p in outputs), F.lit(0)) > 0, F.lit(False))
    holds = F.coalesce(sum((F.contains(command, F.lit(p)).cast("int") for p in outputs), F.lit(0)) > 0, F.lit(False))
    if target:
        holds = holds & ~F.coalesce(F.contains(command, F.lit(target)), F.lit(False))
    system = (tool == "Bash") & F.coalesce(first.isin(*SYSTEM_COMMANDS), F.lit(False))
    output = ((tool == "Read") & starts(file)) | ((tool == "Bash") & holds)
    return F.when(tool.isin(*MCP_TOOLS), "mcp").when(tool.isin(*NATIVE_TOOLS), F.when(system, "system").when(output, "output").otherwise("native")).otherwise("other")


def tool_kind(tool: Column) -> Column:
    """By what follows the last two underscores."""
    last = F.element_at(F.split(tool, "__"), -1)
    return F.when(F.startswith(last, F.lit("analyze")), "analyze").when(last.isin("shell", "Bash"), "shell").when(last.isin("text_editor", "Edit", "Write", "Read"), "editor").when(last.isin("tree", "Glob"), "tree").otherwise("other")


def structural_search(tool: Column, command: Column) -> Column:
    """A shell call of a search tool for definitions."""
    return (tool_kind(tool) == "shell") & F.contains(command, F.lit("rg")) & command.rlike(STRUCTURAL)


def validate(calls: DataFrame, budget: int = 10) -> DataFrame:
    """P20: session, condition, class give issues and whether there is no error. A and A2 allow native tools only, others the rest."""
    n = lambda k: F.count_if(F.col("class") == k)
    s = calls.groupBy("session", "condition").agg(n("mcp").alias("mcp"), n("native").alias("native"), (n("mcp") + n("native")).alias("research"))
    own = F.col("condition").isin("A", "A2")
    issues = F.array_compact(F.array(
        F.when(own & (F.col("native") == 0), "ERROR: no native tools"), F.when(own & (F.col("mcp") > 0), "ERROR: MCP tools used"),
        F.when(~own & (F.col("mcp") == 0), "ERROR: no MCP tools"), F.when(~own & (F.col("native") > 0), "ERROR: native tools used"),
        F.when(F.col("research") > budget, F.concat(F.lit("WARN: research calls "), F.col("research").cast("string"))),
    ))
    return s.select("session", "condition", "mcp", "native", "research", issues.alias("issues")).withColumn("valid", ~F.exists("issues", lambda x: F.startswith(x, F.lit("ERROR"))))


def handoffs(plan: DataFrame, build: DataFrame, validation: DataFrame) -> DataFrame:
    """One row for each session with a plan, a build or a validation."""
    return plan.join(build, "session_id", "full_outer").join(validation, "session_id", "full_outer")


def verdicts(s: DataFrame) -> DataFrame:
    """A24."""
    return s.groupBy(F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def retry_rate(s: DataFrame) -> DataFrame:
    """A25."""
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if("retry").alias("retries"), F.round(pct(F.count_if("retry"), F.count(F.lit(1))), 2).alias("rate"))


def pr_success(s: DataFrame) -> DataFrame:
    """Completed sessions with a pull request, of all sessions."""
    ok = F.count_if(~F.col("incomplete") & F.col("pr_url").isNotNull())
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("incomplete")).alias("completed"), ok.alias("with_pr"), F.round(pct(ok, F.count(F.lit(1))), 2).alias("rate"))


def complexity(s: DataFrame) -> DataFrame:
    """A27."""
    return s.groupBy(F.when(F.col("complexity").isin("SIMPLE", "MEDIUM", "COMPLEX"), F.col("complexity")).otherwise("other").alias("complexity")).agg(F.count(F.lit(1)).alias("n"))


def session_trend(s: DataFrame) -> DataFrame:
    """By the eight digits that a session's name starts with."""
    day = F.regexp_extract("session_id", r"^(\d{8})", 1)
    done = ~F.col("incomplete")
    passed = F.count_if(done & (F.col("verdict") == "PASS"))
    return s.filter(day != "").groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), passed.alias("passed"), F.count_if(done & (F.col("verdict") == "FAIL")).alias("failed"),
        F.count_if("incomplete").alias("incomplete"), F.count_if("retry").alias("retry"), F.round(pct(passed, F.count_if(done)), 2).alias("pass_pct"),
    )


def calls_by_tool(calls: DataFrame) -> DataFrame:
    """A29."""
    return calls.groupBy("session", "tool").agg(F.count(F.lit(1)).alias("n"))


def tools_used(calls: DataFrame) -> DataFrame:
    """The tools of a session, those among the native ones, and those beyond them."""
    s = calls.groupBy("session").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    native = F.array(*map(F.lit, NATIVE_TOOLS))
    return s.select("session", F.array_join("tools", ",").alias("tools"), F.array_join(F.array_intersect("tools", native), ",").alias("native"), F.array_join(F.array_except("tools", native), ",").alias("others"))


def token_sums(messages: DataFrame) -> DataFrame:
    """Usage of assistant messages; what is missing counts 0."""
    u = lambda c: F.sum(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c)
    return messages.filter("role = 'assistant'").groupBy("session").agg(u("input_tokens"), u("output_tokens"), u("cache_creation_input_tokens"), u("cache_read_input_tokens"))


def wall_time(messages: DataFrame) -> DataFrame:
    """Whole seconds from the first message to the last, in message order."""
    t = F.unix_micros(any_timestamp(F.col("ts"))) / 1e6
    return messages.groupBy("session").agg((F.max_by(t, "idx") - F.min_by(t, "idx")).cast("bigint").alias("wall_s"))


def costs(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """prices (provider, model, price_in, price_out) are a short list."""
    return tokens.join(prices, ["provider", "model"], "left").select("session", F.round(cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out")), 6).alias("cost_usd"))


def parameter_usage(calls: DataFrame, tool: str) -> DataFrame:
    """How often a tool's JSON input names each parameter, and in how many per cent of the runs."""
    has = lambda k: F.get_json_object("input", f"$.{k}").isNotNull()
    r = calls.filter(F.col("tool") == tool).groupBy("session").agg(*[F.count_if(has(k)).alias(k) for k in ("summary", "cursor", "page_size")])
    return r.agg(F.count(F.lit(1)).alias("runs"), *[F.sum(k).alias(k) for k in ("summary", "cursor", "page_size")], *[F.round(pct(F.count_if(F.col(k) > 0), F.count(F.lit(1)))).cast("bigint").alias(f"{k}_pct") for k in ("summary", "cursor", "page_size")])


def stats(runs: DataFrame, value: str, by: str = "condition") -> DataFrame:
    """A33."""
    v = F.col(value)
    return runs.groupBy(by).agg(F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 4).alias("mean"), F.count(v).alias("n"))


def factorial(runs: DataFrame, rows: str, columns: str, values: list[str], value: str) -> DataFrame:
    """Medians, rows by columns."""
    return runs.groupBy(rows).pivot(columns, values).agg(F.median(value))


def effective_cost(runs: DataFrame) -> DataFrame:
    """Median cost by (median quality x mean reliability), infinite where that is 0."""
    d = F.median("quality") * F.avg("reliability")
    return runs.groupBy("condition").agg(F.when(d == 0, F.lit(float("inf"))).otherwise(F.round(F.median("cost") / F.nullif(d, F.lit(0.0)), 4)).alias("effective_cost"))


def violations(runs: DataFrame, columns: list[str]) -> DataFrame:
    """A36."""
    return runs.groupBy("condition").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns])


def rank_tests(runs: DataFrame, value: str, by: str = "condition") -> DataFrame:
    """U, z and rank-biserial r for each pair of groups, ties ranked by their mean.

    Values are counted first, and ranks come from the counts of different values, so the pairs join counts and not runs.
    """
    held = runs.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    sizes = held.groupBy("g").agg(F.sum("c").alias("n"))
    pairs = sizes.select(F.col("g").alias("a"), F.col("n").alias("n1")).join(sizes.select(F.col("g").alias("b"), F.col("n").alias("n2")), F.col("a") < F.col("b"))
    both = pairs.join(held, F.col("g") == F.col("a")).unionByName(pairs.join(held, F.col("g") == F.col("b")))
    at = both.groupBy("a", "b", "n1", "n2", "v").agg(F.sum("c").alias("t"), F.sum(F.when(F.col("g") == F.col("a"), F.col("c")).otherwise(0)).alias("own"))
    w = Window.partitionBy("a", "b").orderBy("v")
    rank = F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t") + (F.col("t") + 1) / 2
    r1 = at.withColumn("r", F.col("own") * rank).groupBy("a", "b", "n1", "n2").agg(F.sum("r").alias("r1"))
    # Products of counts are beyond a long from about two million rows a group.
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    mean, dev = n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return r1.select("a", "b", "n1", "n2", u.alias("u"), F.round(F.when(dev > 0, (u - mean) / dev).otherwise(0.0), 4).alias("z"), F.round(F.when(n1 * n2 > 0, 1 - 2 * u / (n1 * n2)).otherwise(0.0), 4).alias("r"))


def deltas(now: DataFrame, base: DataFrame, value: str) -> DataFrame:
    """Against another version, by condition."""
    return now.join(base.select("condition", F.col(value).alias("base")), "condition", "left").withColumn("delta", F.col(value) - F.col("base"))


def checks(runs: DataFrame, names: list[str]) -> DataFrame:
    """Whether all checks hold, and how many files changed."""
    ok = names[0] if len(names) == 1 else " and ".join(names)
    return runs.withColumn("ok", F.coalesce(F.expr(ok), F.lit(False))).withColumn("n_files", F.size(F.coalesce("files", F.array().cast("array<string>"))))


def convert(messages: DataFrame) -> DataFrame:
    """Requests and responses of tools in the one form, all token sums on the first assistant message."""
    to = lambda c: F.struct(F.when(c["type"] == "toolRequest", "tool_use").when(c["type"] == "toolResponse", "tool_result").otherwise(c["type"]).alias("type"), c["id"].alias("id"), c["name"].alias("name"), c["input"].alias("input"), c["text"].alias("text"))
    m = messages.withColumn("content", F.transform("content", to))
    w = Window.partitionBy("session")
    first = F.row_number().over(w.orderBy(F.when(F.col("role") == "assistant", 0).otherwise(1), "idx"))
    m = m.withColumn("_rn", first).withColumn("_in", F.sum("usage.input_tokens").over(w)).withColumn("_out", F.sum("usage.output_tokens").over(w))
    return m.withColumn("usage", F.when((F.col("_rn") == 1) & (F.col("role") == "assistant"), F.struct(F.coalesce("_in", F.lit(0)).alias("input_tokens"), F.coalesce("_out", F.lit(0)).alias("output_tokens")))).drop("_rn", "_in", "_out")
