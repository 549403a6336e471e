"""Call graphs and structural graphs as tables of edges: build, resolve, traverse, roll up.

``ord`` columns carry the order that "first" refers to. Traversals are bounded by a depth and unrolled into joins, one a
level; each level keeps only nodes that are new, so cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import strip_scope
from lodestone.session import checkpointed

MODULE, REFERENCE = "<module>", "<reference>"
#: Levels after which a traversal cuts its lineage.
CUT = 5
#: Names that an ambiguous query is answered with.
CANDIDATES = 20
#: A side of so many rows may be sent to every executor.
SEND_ROWS = 200_000


def all_definitions(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """U1."""
    return functions.unionByName(classes)


def first_definitions(definitions: DataFrame, order: list[str]) -> DataFrame:
    """The first definition of each name."""
    w = Window.partitionBy("name").orderBy(*order)
    return definitions.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def resolve_callees(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """The callee as written if it is defined, else without its scope if that is, else as written."""
    names = definitions.select("name").distinct()
    a, b = names.select(F.col("name").alias("whole")), names.select(F.col("name").alias("bare"))
    # Each different callee is resolved once, then joined.
    said = calls.select(F.col("callee").alias("said")).distinct()
    said = said.join(a, F.col("said") == F.col("whole"), "left").join(b, strip_scope(F.col("said")) == F.col("bare"), "left")
    said = checkpointed(said.select("said", F.coalesce("whole", "bare").alias("found")).filter("found <> said"))
    j = calls.join(F.broadcast(said) if said.count() <= SEND_ROWS else said, F.col("callee") == F.col("said"), "left")
    return j.withColumn("callee", F.coalesce("found", "callee")).drop("said", "found")


def caller_edges(calls: DataFrame, references: DataFrame | None = None, impl_traits: DataFrame | None = None, impl_only: bool = False) -> DataFrame:
    """(node, neighbor, path, line, is_impl_trait) from callee to caller; types are referred to by a pseudo-caller, traits called by implementors."""
    out = calls.select(F.col("callee").alias("node"), F.col("caller").alias("neighbor"), "path", "line", F.lit(False).alias("is_impl_trait"))
    if references is not None:
        out = out.unionByName(references.select(F.col("symbol").alias("node"), F.lit(REFERENCE).alias("neighbor"), "path", "line", F.lit(False).alias("is_impl_trait")))
    if impl_traits is not None:
        out = out.unionByName(impl_traits.select(F.col("trait_name").alias("node"), F.col("impl_type").alias("neighbor"), "path", "line", F.lit(True).alias("is_impl_trait")))
    return out.filter("is_impl_trait") if impl_only else out


def callee_edges(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("caller").alias("node"), F.col("callee").alias("neighbor"), "path", "line", F.lit(False).alias("is_impl_trait"))


def symbols(definitions: DataFrame, callers: DataFrame, callees: DataFrame) -> DataFrame:
    """Every name that is defined or has an edge."""
    return definitions.select("name").union(callers.select("node")).union(callees.select("node")).distinct()


def match(name: Column, query: str, mode: str = "exact") -> Column:
    """P9, F24."""
    q = F.lit(query.lower())
    if mode == "exact":
        return name == query
    if mode == "insensitive":
        return F.lower(name) == q
    if mode == "prefix":
        return F.startswith(F.lower(name), q)
    if mode == "contains":
        return F.contains(F.lower(name), q)
    raise ValueError(f"no match mode {mode}")


def resolve(names: DataFrame, query: str, mode: str = "exact") -> str:
    """The one name that matches; LookupError for none, and with the first 20 candidates for several."""
    hits = names.select("name").distinct().filter(match(F.col("name"), query, mode)).orderBy("name")
    found = [r["name"] for r in hits.limit(CANDIDATES + 1).collect()]
    if not found:
        raise LookupError(f"symbol not found: {query}")
    if len(found) > 1:
        more = hits.count() - CANDIDATES if len(found) > CANDIDATES else 0
        raise LookupError("ambiguous: " + ", ".join(found[:CANDIDATES]) + (f" (and {more} more)" if more else ""))
    return found[0]


def unique_callers(callers: DataFrame) -> DataFrame:
    """Different callers of each symbol, all and through traits only."""
    return callers.groupBy("node").agg(F.count_distinct("neighbor").alias("callers"), F.count_distinct(F.when(F.col("is_impl_trait"), F.col("neighbor"))).alias("impl_callers"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within ``depth`` steps of ``start`` (node), each at its least depth, the start at 0."""
    known = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = known
    pairs = edges.select("node", "neighbor")
    if depth > 1:  # read at each level
        pairs = checkpointed(pairs.distinct())
    for level in range(1, depth + 1):
        step = front.select("node").join(pairs, "node").select(F.col("neighbor").alias("node")).distinct()
        front = step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        if level < depth:
            front = checkpointed(front)
            n = front.count()
            if not n:
                break
            known = known.unionByName(front)
            front = F.broadcast(front) if n <= SEND_ROWS else front
        else:
            known = known.unionByName(front)
    return known


def blast_radius(edges: DataFrame, symbol: str, depth: int = 3) -> DataFrame:
    """What can be reached from a symbol, itself left out."""
    start = edges.sparkSession.createDataFrame([(symbol,)], "node string")
    return reach(edges, start, depth).filter("depth > 0")


def import_closure(imports: DataFrame, module: str, depth: int = 3) -> DataFrame:
    """Files that import a module, and those that import them: the reverse of the import edges."""
    back = imports.select(F.col("module").alias("node"), F.col("path").alias("neighbor"))
    return blast_radius(back, module, depth)


def chains(edges: DataFrame, symbol: str, follow_depth: int = 1, incoming: bool = False) -> DataFrame:
    """One chain for each edge of each node within ``follow_depth`` steps.

    A chain is the node, then first neighbours of the edge's neighbour until ``follow_depth``, then the neighbour; incoming
    chains are turned round. ``edges``: node, neighbor, path, line, ord. Returns depth, node, neighbor, ord, chain, callee.
    """
    item = lambda s, p, l: F.struct(F.col(s).alias("symbol"), F.col(p).alias("path"), F.col(l).alias("line"))
    first = edges.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("ord"))).filter("rn = 1")
    first = first.select(F.col("node").alias("f_node"), F.col("neighbor").alias("f_next"), F.col("path").alias("f_path"), F.col("line").alias("f_line"))
    start = edges.sparkSession.createDataFrame([(symbol,)], "node string")
    out = reach(edges, start, follow_depth).join(edges, "node").withColumn("chain", F.array(item("node", "path", "line"))).withColumn("at", F.col("neighbor"))
    for k in range(follow_depth):
        j = out.join(first, (F.col("at") == F.col("f_node")) & (F.col("depth") + k < follow_depth), "left")
        out = j.withColumn("chain", F.when(F.col("f_next").isNotNull(), F.concat("chain", F.array(item("f_next", "f_path", "f_line")))).otherwise(F.col("chain"))).withColumn("at", F.col("f_next")).drop("f_node", "f_next", "f_path", "f_line")
    out = out.withColumn("chain", F.concat("chain", F.array(item("neighbor", "path", "line"))))
    if incoming:
        out = out.withColumn("chain", F.reverse("chain"))
    return out.select("depth", "node", "neighbor", "ord", "chain", F.col("neighbor").alias("callee"))


def chain_entries(c: DataFrame, n: int = 10) -> DataFrame:
    """First items of the first chains."""
    return c.orderBy("depth", "node", "ord").limit(n).select(F.col("chain")[0]["symbol"].alias("symbol"), F.col("chain")[0]["path"].alias("file"), F.col("chain")[0]["line"].alias("line"))


def by_test(c: DataFrame, is_test: Column) -> DataFrame:
    """Chains with whether they start in a test: a test file, or a name that says so."""
    return c.withColumn("from_test", is_test | F.startswith(F.col("chain")[0]["symbol"], F.lit("test_")))


def chain_tree(c: DataFrame) -> DataFrame:
    """Parents with their children and counts; a parent without a child stays."""
    return c.select(F.col("chain")[0]["symbol"].alias("parent"), F.coalesce(F.get("chain", F.lit(1))["symbol"], F.lit("")).alias("child")).groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n"))


def frequencies(edges: DataFrame, n: int = 10) -> DataFrame:
    """The neighbours with most edges, with the path of the first; ties by name."""
    return edges.groupBy(F.col("neighbor").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min_by("path", "ord").alias("path")).orderBy(F.desc("n"), "name").limit(n)


def files_involved(production: DataFrame, outgoing: DataFrame, definitions: DataFrame) -> DataFrame:
    """U4: paths of chains and definitions."""
    of = lambda c: c.select(F.explode("chain").alias("x")).select("x.path")
    return of(production).union(of(outgoing)).union(definitions.select("path")).distinct()


def structural(functions: DataFrame, classes: DataFrame, imports: DataFrame, calls: DataFrame, visible_so_far: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type, name, kind, file_path) and edges (src, dst, kind).

    Ids are hashes of what a node is. A call joins the first definitions of its two names; with ``visible_so_far`` only
    if neither is in a file after the call's. Of edges between the same two nodes the first kind stays.
    """
    ident = lambda *c: F.xxhash64(*c)
    calls = checkpointed(calls.select("caller", "callee", "path").distinct())
    paths = functions.select("path").union(classes.select("path")).union(imports.select("path")).union(calls.select("path")).distinct()
    files = paths.select(ident(F.lit("file"), "path").alias("id"), F.lit("file").alias("node_type"), F.col("path").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("path").alias("file_path"))
    sym = functions.select("path", "name", "line", F.lit("function").alias("kind")).unionByName(classes.select("path", "name", "line", F.lit("class").alias("kind")))
    symbol_id = ident(F.lit("symbol"), "kind", "path", "name", "line")
    syms = sym.select(symbol_id.alias("id"), F.lit("symbol").alias("node_type"), "name", "kind", F.col("path").alias("file_path"))
    mods = imports.filter("module <> ''").select("path", "module").distinct()
    module_id = ident(F.lit("module"), "path", "module")
    modules = mods.select(module_id.alias("id"), F.lit("module").alias("node_type"), F.col("module").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("path").alias("file_path"))
    contains = sym.select(ident(F.lit("file"), "path").alias("src"), symbol_id.alias("dst"), F.lit("contains").alias("kind"))
    imported = mods.select(ident(F.lit("file"), "path").alias("src"), module_id.alias("dst"), F.lit("imports").alias("kind"))
    order = [F.col("path"), F.col("kind").desc(), F.col("line")]
    first = first_definitions(sym.withColumn("id", symbol_id), order).select("name", "id", F.col("path").alias("def_path"))
    a, b = first.select(F.col("name").alias("caller"), F.col("id").alias("src"), F.col("def_path").alias("p1")), first.select(F.col("name").alias("callee"), F.col("id").alias("dst"), F.col("def_path").alias("p2"))
    called = calls.join(a, "caller").join(b, "callee")
    if visible_so_far:
        called = called.filter("p1 <= path and p2 <= path")
    called = called.select("src", "dst", F.lit("calls").alias("kind")).distinct()
    # A file contains a symbol, imports a module, and symbols call symbols: no two kinds have both ends in common.
    edges = contains.distinct().unionByName(imported).unionByName(called)
    return files.unionByName(syms).unionByName(modules), edges


def cache_key(entries: DataFrame) -> DataFrame:
    """A digest of all paths and times: of the digests of 4,096 parts by hash of the path, each in path order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "mtime"))), lambda x: F.concat_ws(":", x["path"], x["mtime"].cast("string"))), "\n")
    parts = entries.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(lines, 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "\n"), 256).alias("key"))


def parse_uri(uri: str) -> dict:
    """graph/{hash}/{kind}/{argument}?cursor=..&depth=.."""
    import re
    from urllib.parse import parse_qs, unquote

    m = re.fullmatch(r"(?:[a-z]+://)?graph/([0-9A-Za-z]+)/(blast-radius|import-closure|subgraph)/([^?]+)(?:\?(.*))?", uri)
    if not m:
        raise ValueError("not a graph URI")
    q = parse_qs(m[4] or "")
    depth = {"blast-radius": 3, "import-closure": 1, "subgraph": 2}[m[2]]
    return {"hash": m[1], "kind": m[2], "argument": unquote(m[3]), "cursor": q.get("cursor", [None])[0], "depth": int(q["depth"][0]) if "depth" in q else depth}


def graph_cursor(offset: int) -> str:
    """base64url without padding."""
    import base64

    return base64.urlsafe_b64encode(b'{"g":%d}' % offset).decode().rstrip("=")


def graph_offset(cursor: str) -> int | None:
    import base64
    import json

    try:
        return int(json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))["g"])
    except (ValueError, KeyError, TypeError):
        return None
