"""Block edits, rule-driven filtering of command output, truncation, and regex extractors, over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import content_hash, lf, match_lines, occurrences
from lodestone.operators.ranks import global_rank
from lodestone.session import shuffled

# ---------------------------------------------------------------- regex extractors

# Patterns of the extractors, by language; group 1 is the name where there is one.
PATTERNS = {
    "css": r"^[.#][\w-]+[\s,:{]",
    "yaml": r"^(\w[\w-]*): ",
    "json": r'^\s{0,2}"(\w+)":',
    "toml": r"^\[([^\]]+)\]",
}


def numbered(sources: DataFrame, text: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Lines of a text with their number from 1; a final line feed adds none."""
    body = F.regexp_replace(text, r"\n\z", "")
    return sources.filter(F.length(text) > 0).select(*keep, F.posexplode(F.split(body, "\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def keys(sources: DataFrame, language: str) -> DataFrame:
    """(path, name, line) of the selectors, keys or sections."""
    rule, lines = PATTERNS[language], numbered(sources)
    if language == "css":  # selectors may be indented; the name is the line without what opens or goes on with the rule
        lines = lines.withColumn("line", F.regexp_replace("line", r"^\s+", ""))
    found = lines.filter(F.col("line").rlike(rule))
    name = F.regexp_extract("line", rule, 1) if "(" in rule else F.regexp_replace("line", r"[\s,:{]+$", "")
    return found.select("path", name.alias("name"), F.col("pos").alias("line"))


def frontmatter(content: Column) -> Column:
    """What is between the first two lines of three dashes, null if there aren't two at the start."""
    return F.nullif(F.regexp_extract(content, r"\A---[ \t]*\n((?:.*\n)*?)---[ \t]*(?:\n|\z)", 1), F.lit(""))


# ---------------------------------------------------------------- edits


def replace_block(edits: DataFrame) -> DataFrame:
    """Content, old_text, new_text, replace_all, expected_hash give status, matches, lines, preview and new content.

    CR LF counts as LF. Nothing is replaced for an empty old text, a stale hash, no match, or several without ``replace_all``.
    """
    c, old, new = lf(F.col("content")), lf(F.col("old_text")), lf(F.col("new_text"))
    e = edits.withColumn("_c", c).withColumn("_o", old).withColumn("matches", occurrences(F.col("_c"), F.col("_o")))
    stale = F.coalesce(F.col("expected_hash") != content_hash(F.col("content")), F.lit(False))
    status = F.when(F.col("_o") == "", "invalid").when(stale, "stale").when(F.col("matches") == 0, "not_found").when((F.col("matches") > 1) & ~F.col("replace_all"), "ambiguous").otherwise("ok")
    e = e.withColumn("status", status)
    return e.withColumn("match_lines", F.when(F.col("status") == "ambiguous", match_lines(F.col("_c"), F.col("_o")))).withColumn("first_lines", F.when(F.col("status") == "not_found", F.slice(F.split("_c", "\n", -1), 1, 20))).withColumn("new_content", F.when(F.col("status") == "ok", F.replace("_c", F.col("_o"), new)).otherwise(F.col("content"))).drop("_c", "_o")


# ---------------------------------------------------------------- command output

# The built-in rules (match, description, strip ANSI, strip lines, keep lines, most lines, on empty).
_BUNDLED = [
    (r"^git\s+pull", "git pull", False, [r"^\s*\|\s*\d+\s*[+-]+", r"^\s+create mode", r"^\s+delete mode", r"^\s+rename ", r"^\s+mode change"], [], None, "ok (up-to-date)"),
    (r"^git\s+fetch", "git fetch", False, [r"^From ", r"^\s+[a-f0-9]+\.\."], [], 10, "ok fetched"),
    (r"^git\s+push", "git push", False, [r"^remote:\s+$", r"^remote: Resolving", r"^remote: Compressing", r"^remote: Counting", r"^To "], [], 10, "ok pushed"),
    (r"^git\s+log", "git log", False, [], [], 20, None),
    (r"^git\s+status", "git status", False, [], [], 20, None),
    (r"^cargo\s+build", "cargo build", False, [r"^\s*Compiling ", r"^\s*Checking ", r"^\s*Downloading ", r"^\s*Updating ", r"^\s*Fresh "], [], None, "ok (build clean)"),
    (r"^cargo\s+test", "cargo test", False, [r"^\s*Compiling ", r"^\s*Checking ", r"^\s*Fresh "], [], None, None),
    (r"^git\s+show", "git show", True, [r"^@@", r"^[+-][^+-]"], [], 200, None),
    (r"^git\s+commit", "git commit", True, [r"^gpg:", r"^\s*[○│╲░]", r"^.*gitleaks", r"^.*INF\b", r"^.*no leaks found"], [], 10, "ok committed"),
    (r"^git\s+diff", "git diff", True, [], [], 100, "ok (working tree clean)"),
    (r"^git\s+add", "git add", True, [r"^\s*[○│╲░]", r"^.*gitleaks", r"^.*INF\b"], [], 5, "ok staged"),
]
RULES = "priority int, match_command string, description string, strip_ansi boolean, strip_lines_matching array<string>, keep_lines_matching array<string>, max_lines int, on_empty string"
#: Rules are sent to every executor.
MOST_RULES = 10_000
ANSI = r"\x1B\[[0-?]*[ -/]*[@-~]"


def builtin_rules(spark, first: list[tuple] = ()) -> DataFrame:
    """Project rules first, then the built-in ones."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate([*first, *_BUNDLED])], RULES)


def with_rule(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Each run with exit code 0 and the first rule that matches its command; rules are a short list.

    Rules are matched with different commands, not with runs.
    """
    if rules.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    commands = runs.filter("exit_code = 0 and command is not null").select(F.col("command").alias("said")).distinct()
    best = commands.join(F.broadcast(rules), F.expr("said RLIKE match_command")).groupBy("said").agg(F.min("priority").alias("priority"))
    return runs.join(best, (F.col("exit_code") == 0) & (F.col("command") == F.col("said")), "left").drop("said").join(F.broadcast(rules), "priority", "left")


def filter_lines(lines: Column, strip: Column, keep: Column, most: Column, on_empty: Column, ansi: Column) -> Column:
    """Lines without those that a strip rule matches, only those that a keep rule matches if there are any, the first ``most``."""
    clean = F.when(ansi, F.transform(lines, lambda x: F.regexp_replace(x, ANSI, ""))).otherwise(lines)
    left = F.filter(clean, lambda x: ~F.exists(strip, lambda p: F.rlike(x, p)))
    left = F.when(F.size(keep) > 0, F.filter(left, lambda x: F.exists(keep, lambda p: F.rlike(x, p)))).otherwise(left)
    left = F.when(most.isNotNull(), F.slice(left, F.lit(1), F.coalesce(most, F.lit(1)))).otherwise(left)
    return F.when((F.size(F.filter(left, lambda x: F.trim(x) != "")) == 0) & on_empty.isNotNull(), F.array(on_empty)).otherwise(left)


def filtered(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """run_id, command, exit_code, lines give the filtered lines and the rule's description, else its pattern."""
    r = with_rule(runs, rules)
    out = filter_lines(F.col("lines"), F.col("strip_lines_matching"), F.col("keep_lines_matching"), F.col("max_lines"), F.col("on_empty"), F.col("strip_ansi"))
    return r.select("run_id", "command", F.when(F.col("match_command").isNull(), F.col("lines")).otherwise(out).alias("lines"), F.coalesce("description", "match_command").alias("filter_applied"))


def budget(lines: Column, most: int) -> Column:
    """Lines while they fit in ``most`` bytes with their line feeds; a later, shorter line may fit again."""
    step = lambda a, x: F.when(a["n"] + F.octet_length(x) + 1 <= most, F.struct((a["n"] + F.octet_length(x) + 1).alias("n"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    return F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), step, lambda a: a["out"])


def preview(lines: Column, most: int = 2000, last: int = 50) -> Column:
    """The last lines of long output, all of short."""
    return F.when(F.size(lines) > most, F.slice(lines, -last, last)).otherwise(lines)


def head(content: Column, n: int = 50) -> Column:
    """O14."""
    return F.slice(F.split(content, "\n", -1), 1, n)


def snippets(lines: DataFrame, key: str = "path") -> DataFrame:
    """Each line with the one before and after, trailing white space cut; empty at the edges."""
    w = Window.partitionBy(key).orderBy("pos")
    end = lambda c: F.regexp_replace(c, r"\s+$", "")
    return lines.withColumn("snippet", F.concat_ws("\n", end(F.lag("line", 1, "").over(w)), end(F.col("line")), end(F.lead("line", 1, "").over(w))))


def stream_bytes(lines: DataFrame) -> DataFrame:
    """Raw bytes of each run's streams, a line feed for each line."""
    return lines.groupBy("run_id", "is_stderr").agg(F.sum(F.octet_length("line") + 1).alias("bytes_raw"))


def without_cd(command: Column) -> tuple[Column, Column]:
    """(directory, rest) of ``cd X && rest``; no directory otherwise."""
    rule = r"^\s*cd\s+(\S+)\s*&&\s*(.*)$"
    has = command.rlike(rule)
    return F.when(has, F.regexp_extract(command, rule, 1)), F.when(has, F.regexp_extract(command, rule, 2)).otherwise(command)


def no_stat(command: Column) -> Column:
    """Git pull without its statistics."""
    return F.when(command.rlike(r"^git\s+pull\b") & ~F.contains(command, F.lit("--no-stat")), F.regexp_replace(command, r"^(git\s+pull)", r"$1 --no-stat")).otherwise(command)


def def_use_order(sites: DataFrame) -> DataFrame:
    """Reads at the place of a write go; writes come first, then path, line and column."""
    w, r = sites.filter("kind <> 'read'"), sites.filter("kind = 'read'")
    left = r.join(shuffled(w.select("path", "line", "column")), ["path", "line", "column"], "left_anti").select(sites.columns)
    both = w.unionByName(left)
    return global_rank(both, [F.when(F.col("kind") == "read", 1).otherwise(0), F.col("path"), F.col("line"), F.col("column")], "ord")
