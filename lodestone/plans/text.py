"""Text program: extractors, edits, filters and truncation over text columns made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import text as T
from lodestone.plans.adapters import LINES, lines
from lodestone.session import table

_CSS = r"""'.part-' || p_partkey || ' {' || chr(10) || '  color: red;' || chr(10) || '}' || chr(10) || '#x' || p_size || ', p' || chr(10) || '@media print {' || chr(10) || chr(9) || '  .in' || p_size || ' .deep:hover, {' || chr(10) || '}' || chr(10)"""
_YAML = r"""'name: ' || p_name || chr(10) || '  nested: 1' || chr(10) || 'size_' || p_size || ': 2'"""
_JSON = r"""'{' || chr(10) || '  "k' || p_size || '": 1,' || chr(10) || '    "deep": 2' || chr(10) || '}'"""
_TOML = r"""'[part.' || p_size || ']' || chr(10) || 'key = 1' || chr(10) || '[x]'"""
_ASTRO = r"""CASE WHEN p_partkey % 2 = 0 THEN '---' || chr(10) || 'import X from "' || p_size || '";' || chr(10) || '---' || chr(10) || '<p/>' ELSE '<p/>' END"""
_KEYS = lambda content, rule, g: f"SELECT path, regexp_extract(line, '{rule}', {g}) AS name, CAST(pos AS INTEGER) AS line FROM (SELECT p_partkey AS path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT p_partkey, string_split(rtrim({content}, chr(10)), chr(10)) AS ls FROM part)) WHERE regexp_matches(line, '{rule}')"


def _part(s, d, content):
    return table(s, d, "part").select(F.col("p_partkey").alias("path"), F.expr(content).alias("content"))


def _edits(s, d):
    p = table(s, d, "documents")
    k = F.col("doc_id")
    return p.select(k.alias("path"), F.col("text").alias("content"), F.when(k % 7 == 0, "").when(k % 3 == 0, "the ").when(k % 3 == 1, "\n").otherwise("zqx").alias("old_text"), F.lit("[X]").alias("new_text"), (k % 2 == 0).alias("replace_all"), F.when(k % 5 == 0, F.sha2("text", 256)).when(k % 11 == 0, "stale").alias("expected_hash"))


def _edit_rows(s, d):
    e = T.replace_block(_edits(s, d))
    return e.select("path", "status", "matches", F.sha2("new_content", 256).alias("new_hash"), F.array_join(F.transform("match_lines", lambda x: x.cast("string")), ",").alias("lines"), F.size(F.coalesce("first_lines", F.array().cast("array<string>"))).alias("n_first"))


_COMMANDS = ("git status", "git log --oneline", "cargo build", "ls -la", "git fetch origin")


def _runs(s, d):
    k = F.col("doc_id")
    cmd = F.element_at(F.array(*map(F.lit, _COMMANDS)), (k % 5 + 1).cast("int"))
    own = F.array(F.lit("   Compiling x v1"), F.lit("From github"), F.lit("\x1b[31mred\x1b[0m"))
    return table(s, d, "documents").select(k.alias("run_id"), cmd.alias("command"), F.when(k % 6 == 0, 1).otherwise(0).alias("exit_code"), F.concat(own, F.split("text", "\n", -1)).alias("lines"))


def _output_lines(s, d):
    return lines(s, d).select(F.col("doc_id").alias("run_id"), (F.col("pos") % 3 == 0).alias("is_stderr"), "line")


def _sites(s, d):
    """Each order is a file."""
    li, path = table(s, d, "lineitem"), F.col("l_orderkey")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "write").when(F.col("l_linenumber") % 3 == 1, "read").otherwise("write_read")
    return li.select(path.alias("path"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 4).alias("column"), kind.alias("kind"), F.col("l_orderkey").alias("id")).dropDuplicates(["path", "line", "column", "kind"]).drop("id")


def _use_counts(sites):
    return T.def_use_order(sites).groupBy("path").agg(F.count_if(F.col("kind") != "read").alias("writes"), F.count_if(F.col("kind") == "read").alias("reads"))


QUERIES = {
    "e10_css": lambda s, d: T.keys(_part(s, d, _CSS), "css"),
    "e11_yaml": lambda s, d: T.keys(_part(s, d, _YAML), "yaml"),
    "e12_json": lambda s, d: T.keys(_part(s, d, _JSON), "json"),
    "e13_toml": lambda s, d: T.keys(_part(s, d, _TOML), "toml"),
    "e14_astro": lambda s, d: _part(s, d, _ASTRO).select("path", T.frontmatter(F.col("content")).alias("script")),
    "w5_f11_snippets": lambda s, d: T.snippets(lines(s, d), "doc_id").select("doc_id", "pos", F.sha2("snippet", 256).alias("snippet_hash"), scalars.snippet_one_line(F.col("snippet")).alias("one_line")),
    "w8_budget": lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.budget(F.split("text", "\n", -1), 900)).alias("kept")),
    "w9_preview": lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.preview(F.split("text", "\n", -1), 8, 3)).alias("n"), F.sha2(F.array_join(T.preview(F.split("text", "\n", -1), 8, 3), "\n"), 256).alias("h")),
    "o14_head": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(F.array_join(T.head(F.col("text"), 5), "\n"), 256).alias("h")),
    "d1_d2_f14_f15_edits": _edit_rows,
    "d5_d6_p21_p22_j16_filters": lambda s, d: T.filtered(_runs(s, d), T.builtin_rules(s)).select("run_id", F.size("lines").alias("n"), F.sha2(F.array_join("lines", "\n"), 256).alias("h"), "filter_applied"),
    "a40_stream_bytes": lambda s, d: T.stream_bytes(_output_lines(s, d)),
    "p27_p29_commands": lambda s, d: table(s, d, "nation").select("n_nationkey", F.concat(F.when(F.col("n_nationkey") % 2 == 0, "cd /tmp && ").otherwise(""), F.lit("git pull origin")).alias("c")).select("n_nationkey", T.without_cd(F.col("c"))[0].alias("dir"), T.no_stat(T.without_cd(F.col("c"))[1]).alias("rest")),
    "o8_j11_def_use_order": lambda s, d: T.def_use_order(_sites(s, d)),
    "a12_p16_def_use_counts": lambda s, d: _use_counts(_sites(s, d)),
}

_SPLIT = "string_split(text, chr(10))"
_RULES = "CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'git status' WHEN doc_id % 5 = 1 THEN 'git log' WHEN doc_id % 5 = 2 THEN 'cargo build' WHEN doc_id % 5 = 4 THEN 'git fetch' END"
_SITES = "s AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line, l_partkey % 4 AS \"column\", CASE l_linenumber % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'read' ELSE 'write_read' END AS kind FROM lineitem), o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN kind = 'read' THEN 1 ELSE 0 END, path, line, \"column\") AS ord FROM s WHERE kind <> 'read' OR (path, line, \"column\") NOT IN (SELECT (path, line, \"column\") FROM s WHERE kind <> 'read'))"

ORACLES = {
    "e10_css": f"SELECT path, rtrim(ltrim(name, ' ' || chr(9)), ' ,:{{') AS name, line FROM ({_KEYS(_CSS, r'^\s*[.#][\w-]+[\s,:{].*', 0)})",
    "e11_yaml": _KEYS(_YAML, r"^(\w[\w-]*): ", 1),
    "e12_json": _KEYS(_JSON, r'^\s{0,2}"(\w+)":', 1),
    "e13_toml": _KEYS(_TOML, r"^\[([^\]]+)\]", 1),
    "e14_astro": """SELECT p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'import X from "' || p_size || '";' || chr(10) END AS script FROM part""",
    "w5_f11_snippets": f"WITH {LINES}, t AS (SELECT doc_id, pos, rtrim(coalesce(lag(line) OVER w, '')) AS a, rtrim(line) AS b, rtrim(coalesce(lead(line) OVER w, '')) AS c FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, sha256(a || chr(10) || b || chr(10) || c) AS snippet_hash, CASE WHEN strlen(trim(b)) > 80 THEN (SELECT max_by(left(trim(b), n), n) FROM range(0, 78) r(n) WHERE strlen(left(trim(b), n)) <= 77) || '...' ELSE trim(b) END AS one_line FROM t",
    "w8_budget": f"SELECT doc_id, CAST(list_reduce(list_prepend({{'n': 0, 'k': 0}}, list_transform({_SPLIT}, lambda x: {{'n': CAST(strlen(x) + 1 AS INTEGER), 'k': 1}})), lambda a, x: CASE WHEN a.n + x.n <= 900 THEN {{'n': a.n + x.n, 'k': a.k + 1}} ELSE a END).k AS INTEGER) AS kept FROM documents",
    "w9_preview": f"WITH p AS (SELECT doc_id, CASE WHEN len({_SPLIT}) > 8 THEN {_SPLIT}[-3:] ELSE {_SPLIT} END AS ls FROM documents) SELECT doc_id, CAST(len(ls) AS INTEGER) AS n, sha256(array_to_string(ls, chr(10))) AS h FROM p",
    "o14_head": f"SELECT doc_id, sha256(array_to_string({_SPLIT}[1:5], chr(10))) AS h FROM documents",
    "d1_d2_f14_f15_edits": """WITH e AS (SELECT doc_id, text, replace(text, chr(13) || chr(10), chr(10)) AS c, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'the ' WHEN doc_id % 3 = 1 THEN chr(10) ELSE 'zqx' END AS o FROM documents),
 m AS (SELECT *, CASE WHEN o = '' THEN 0 ELSE (length(c) - length(replace(c, o, ''))) // length(o) END AS matches FROM e),
 x AS (SELECT *, CASE WHEN o = '' THEN 'invalid' WHEN doc_id % 5 <> 0 AND doc_id % 11 = 0 THEN 'stale' WHEN matches = 0 THEN 'not_found' WHEN matches > 1 AND doc_id % 2 <> 0 THEN 'ambiguous' ELSE 'ok' END AS status FROM m)
 SELECT doc_id AS path, status, CAST(matches AS BIGINT) AS matches, sha256(CASE WHEN status = 'ok' THEN replace(c, o, '[X]') ELSE text END) AS new_hash,
 CASE WHEN status = 'ambiguous' THEN array_to_string(list_transform(range(1, matches + 1), lambda k: CAST(len(string_split(list_reduce(string_split(c, o)[1:k], lambda a, x: a || o || x), chr(10))) AS VARCHAR)), ',') END AS lines,
 CAST(CASE WHEN status = 'not_found' THEN least(20, len(string_split(c, chr(10)))) ELSE 0 END AS INTEGER) AS n_first FROM x""",
    "d5_d6_p21_p22_j16_filters": f"""WITH r AS (SELECT doc_id, {_RULES} AS rule, list_concat(['   Compiling x v1', 'From github', chr(27) || '[31mred' || chr(27) || '[0m'], {_SPLIT}) AS ls FROM documents),
 f AS (SELECT doc_id, rule, CASE rule WHEN 'git status' THEN ls[1:20] WHEN 'git log' THEN ls[1:20] WHEN 'cargo build' THEN list_filter(ls, lambda x: NOT regexp_matches(x, '^\\s*(Compiling|Checking|Downloading|Updating|Fresh) '))
 WHEN 'git fetch' THEN list_filter(ls, lambda x: NOT regexp_matches(x, '^From |^\\s+[a-f0-9]+\\.\\.'))[1:10] ELSE ls END AS o FROM r) SELECT doc_id AS run_id, CAST(len(o) AS INTEGER) AS n, sha256(array_to_string(o, chr(10))) AS h, rule AS filter_applied FROM f""",
    "a40_stream_bytes": f"WITH {LINES} SELECT doc_id AS run_id, pos % 3 = 0 AS is_stderr, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes_raw FROM l GROUP BY 1, 2",
    "p27_p29_commands": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '/tmp' END AS dir, 'git pull --no-stat origin' AS rest FROM nation",
    "o8_j11_def_use_order": f"WITH {_SITES} SELECT * FROM o",
    "a12_p16_def_use_counts": f"WITH {_SITES} SELECT path, count_if(kind <> 'read') AS writes, count_if(kind = 'read') AS reads FROM o GROUP BY path",
}
