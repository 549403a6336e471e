"""Everything about one symbol, from the tables of a corpus to callers, callees, files and sites.

The phases are those of one analysis: definitions and resolved calls give the edges, the query resolves to one symbol, chains are
followed both ways, callers are split into production and tests, and sites are put in order. Each is a table, read by
``render`` or paged with ``page``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.paths import is_test
from lodestone.operators import corpus, graph
from lodestone.operators.render import next_page
from lodestone.operators.text import def_use_order


@dataclass
class Focus:
    symbol: str
    follow_depth: int
    definitions: DataFrame  # path, line
    production: DataFrame  # chains that start outside tests
    tests: DataFrame
    outgoing: DataFrame
    sites: DataFrame | None = None  # path, line, kind, scope, snippet, ord

    def head(self) -> DataFrame:
        """One line: definitions, different callers and callees."""
        rows = self.definitions.select(F.lit("d").alias("of"), F.concat_ws(":", "path", "line").alias("name"))
        for of, chains in (("i", self.production), ("o", self.outgoing)):
            rows = rows.unionByName(chains.select(F.lit(of).alias("of"), F.col("chain")[0]["symbol"].alias("name")))
        n = rows.agg(*[F.count_distinct(F.when(F.col("of") == of, F.col("name"))).alias(of) for of in "dio"])
        return n.select(F.concat(F.lit(f"FOCUS: {self.symbol} ("), F.col("d").cast("string"), F.lit(" defs, "), F.col("i").cast("string"), F.lit(" callers, "), F.col("o").cast("string"), F.lit(" callees)")).alias("line"))

    def files(self) -> DataFrame:
        return graph.files_involved(self.production, self.outgoing, self.definitions)

    def site_counts(self) -> DataFrame:
        return self.sites.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") != "read").alias("writes"), F.count_if(F.col("kind") == "read").alias("reads"))

    def page(self, mode: str = "callers", offset: int = 0, size: int = corpus.PAGE, summary: bool = False) -> tuple[DataFrame, int, tuple[str, int] | None]:
        """(rows, total, next page as (mode, offset)): callers, then callees, then sites."""
        rows, order = {"callers": (self.production, ["depth", "node", "ord"]), "callees": (self.outgoing, ["depth", "node", "ord"]), "defuse": (self.sites, ["ord"])}[mode]
        shown, more, total = corpus.page(rows, order, offset, size)
        if more:
            return shown, total, (mode, offset + size)
        then = next_page(mode, None, not self.outgoing.isEmpty(), self.sites is not None and not self.sites.isEmpty(), summary)
        return shown, total, (then, 0) if then else None


def focus(
    functions: DataFrame, classes: DataFrame, calls: DataFrame, query: str, mode: str = "exact", follow_depth: int = 1, references: DataFrame | None = None, impl_traits: DataFrame | None = None,
    impl_only: bool = False, sites: DataFrame | None = None,
) -> Focus:
    """``functions``, ``classes``: path, name, line; ``calls``: caller, callee, path, line; ``sites`` of the symbol: path, line, column, kind, scope, snippet.

    LookupError if no symbol matches, or several do; a symbol without an edge has empty tables.
    """
    defined = graph.all_definitions(functions.select("name", "path", "line"), classes.select("name", "path", "line"))
    calls = graph.resolve_callees(calls, defined)
    callers, callees = graph.caller_edges(calls, references, impl_traits, impl_only), graph.callee_edges(calls)
    symbol = graph.resolve(graph.symbols(defined, callers, callees), query, mode)
    ordered = lambda e: e.withColumn("ord", F.row_number().over(Window.partitionBy("node").orderBy("path", "line", "neighbor")))
    incoming = graph.by_test(graph.chains(ordered(callers), symbol, follow_depth, incoming=True), is_test(F.col("chain")[0]["path"]))
    return Focus(
        symbol, follow_depth, defined.filter(F.col("name") == symbol).select("path", "line").distinct(), incoming.filter("not from_test"), incoming.filter("from_test"),
        graph.chains(ordered(callees), symbol, follow_depth), None if sites is None else def_use_order(sites),
    )
