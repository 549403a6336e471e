"""Relational extensions: joins, grouping sets, windows and sets over the star schema, beyond what the reports need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.session import table


def _orders_nations(s, d):
    o, c, n, r = (table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows, fixed


def _full_outer(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    p = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(p, "k", "full_outer")


def _right_outer(s, d):
    p = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return p.join(table(s, d, "nation"), F.col("k") == F.col("n_nationkey"), "right").select("n_name", "suppliers")


def _merge_join(s, d):
    li = table(s, d, "lineitem")
    return table(s, d, "part").hint("merge").join(li, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


def _as_of(s, d):
    """Each event with its user's latest order before it: one sort over both, no range join."""
    e = table(s, d, "events").select(F.col("user_id").alias("k"), "ts", "event_id", F.lit(None).cast("bigint").alias("o"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("bigint").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("ts", F.col("event_id").isNotNull(), "o").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("order_id", F.last("o", ignorenulls=True).over(w)).filter("event_id is not null").select("event_id", "order_id")


def _interval(s, d, minutes=60):
    """Pairs of one user's events within an hour: joined on the hour and its neighbour, then checked."""
    e = table(s, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    step = minutes * 60
    a = e.withColumn("b", F.floor(F.col("t") / step))
    b = e.select(F.col("user_id").alias("u2"), F.col("event_id").alias("e2"), F.col("t").alias("t2"), F.explode(F.array(F.floor(F.col("t") / step), F.floor(F.col("t") / step) - 1)).alias("b2"))
    j = a.join(b, (F.col("user_id") == F.col("u2")) & (F.col("b") == F.col("b2")) & (F.col("t2") - F.col("t")).between(0, step) & ((F.col("t2") > F.col("t")) | (F.col("e2") > F.col("event_id"))))
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


def _windows(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rk"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dr"), F.ntile(4).over(w).alias("nt"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey", 2).over(w).alias("next2"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


def _range_frame(s, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-86_400, 0)
    return table(s, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("day_count"))


def _variant(s, d):
    return table(s, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


def _cosine_all(s, d, k=3, every=20, rows=8192, asked=2048):
    """Best matches of each vector whose id is divisible by ``every``, blocks of queries against blocks of rows.

    Only vectors of the same length are compared; those that are null, of length 0 or not finite have no cosine.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    v = v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).withColumn("n", F.sqrt(dot(F.col("v"), F.col("v")))).filter("n > 0")
    n = v.select(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, -(-n[0] // rows)), max(1, -(-n[1] // asked))
    dealt = lambda by: F.pmod(F.xxhash64("vec_id", "v"), F.lit(by)).cast("int")
    all_of = lambda by: F.explode(F.sequence(F.lit(0), F.lit(by - 1)))
    own = v.withColumn("query", F.lit(False)).withColumn("shard", dealt(shards)).withColumn("block", all_of(blocks))
    q = v.filter(F.col("vec_id") % every == 0).withColumn("query", F.lit(True)).withColumn("shard", all_of(shards)).withColumn("block", dealt(blocks))

    def score(t: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        row, ask = t.filter(pc.invert(t["query"])), t.filter(t["query"])
        matrix = lambda part: part["v"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        if row.num_rows and ask.num_rows:
            x, y, ids, asks = matrix(row), matrix(ask), row["vec_id"].to_numpy(), ask["vec_id"].to_numpy()
            norms, lengths = row["n"].to_numpy(), ask["n"].to_numpy()
            for at in range(0, len(y), 256):
                c = y[at : at + 256] @ x.T / (lengths[at : at + 256, None] * norms[None, :])
                c = np.copysign(np.floor(np.abs(c) * 1e6 + 0.5), c) / 1e6 + 0.0
                c[asks[at : at + 256, None] == ids[None, :]] = -np.inf
                last = max(0, len(x) - k)
                least = np.partition(c, last, axis=1)[:, last]
                for i, own in enumerate(c):
                    hit = np.flatnonzero((own >= least[i]) & (own > -np.inf))
                    hit = hit[np.lexsort((ids[hit], -own[hit]))][:k]
                    out[0] += [int(asks[at + i])] * len(hit)
                    out[1] += ids[hit].tolist()
                    out[2] += own[hit].tolist()
        return pa.table([pa.array(o, kind) for o, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "vec_id", "cos"])

    c = own.unionByName(q).withColumn("dim", F.size("v")).groupBy("dim", "shard", "block").applyInArrow(score, "q long, vec_id long, cos double")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "vec_id"))).filter(F.col("rank") <= k)


def _approximate(s, d):
    """Sketches beside what they estimate: distinct parts within 10 % (two standard errors of 5 %), a median of the values in its middle tenth."""
    q = F.col("l_quantity")
    li = table(s, d, "lineitem")
    # Each by itself: beside a distinct count, every different part of a flag would carry a sketch and a table of quantities.
    median = li.groupBy("l_returnflag").agg(F.percentile_approx(q, 0.5).alias("m"))
    # The sum of a sketch for each sixteenth of the parts, as one sketch alone misses the 10 % for one set of parts in twenty.
    slices = li.groupBy(F.col("l_returnflag").alias("flag0"), F.pmod(F.hash("l_partkey"), F.lit(16))).agg(F.approx_count_distinct("l_partkey", 0.05).alias("a"))
    near = median.join(slices.groupBy("flag0").agg(F.sum("a").alias("a")), F.col("l_returnflag").eqNullSafe(F.col("flag0")))
    parts = li.select("l_returnflag", "l_partkey").distinct().groupBy(F.col("l_returnflag").alias("flag1")).agg(F.count("l_partkey").alias("parts"))
    range_of = li.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("l_returnflag").alias("flag2")).agg(F.percentile(q, F.array(F.lit(0.45), F.lit(0.55)), F.col("n")).alias("r"))
    a = near.join(parts, F.col("l_returnflag").eqNullSafe(F.col("flag1"))).join(range_of, F.col("l_returnflag").eqNullSafe(F.col("flag2")))
    return a.select("l_returnflag", "parts", (F.abs(F.col("a") - F.col("parts")) <= 0.1 * F.col("parts")).alias("parts_near"), F.col("m").between(F.col("r")[0], F.col("r")[1]).alias("median_near"))


def _q1(s, d):
    li = table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "x_full_outer_join": _full_outer,
    "x_right_outer_join": _right_outer,
    "x_sort_merge_join": _merge_join,
    "x_as_of_join": _as_of,
    "x_interval_join": _interval,
    "x_rollup": lambda s, d: _orders_nations(s, d).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("gid")),
    "x_cube": lambda s, d: _orders_nations(s, d).cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
    "x_grouping_sets": lambda s, d: _orders_nations(s, d).groupingSets([["r_name"], ["o_orderstatus"], []], "r_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
    "x_window_functions": _windows,
    "x_range_frame": _range_frame,
    "x_intersect_except": lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")).exceptAll(table(s, d, "nation").filter("n_regionkey = 0").select("n_nationkey")),
    "x_tumbling_window": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 day").start.cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")),
    "x_sliding_window": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").start.cast("string").alias("start")).agg(F.count(F.lit(1)).alias("n")),
    "x_session_window": lambda s, d: table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")),
    "x_pivot": lambda s, d: table(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count(),
    "x_unpivot": lambda s, d: table(s, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "what", "value"),
    "x_variant_json": _variant,
    "x_exists_subquery": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
    "x_cosine_top_k": _cosine_all,
    "x_pricing_summary": _q1,
    "x_approximate": _approximate,
}

_ON = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

ORACLES = {
    "x_approximate": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS parts_near, true AS median_near FROM lineitem GROUP BY 1",
    "x_full_outer_join": "WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), p AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT coalesce(c.k, p.k) AS k, customers, suppliers FROM c FULL OUTER JOIN p ON c.k = p.k",
    "x_right_outer_join": "SELECT n_name, suppliers FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) RIGHT JOIN nation ON k = n_nationkey",
    "x_sort_merge_join": "SELECT p_brand, round(sum(l_quantity), 2) AS qty FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1",
    "x_as_of_join": "WITH m AS (SELECT event_id, (SELECT o_orderkey FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS order_id FROM events) SELECT * FROM m",
    "x_interval_join": "SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND epoch(date_trunc('second', b.ts)) - epoch(date_trunc('second', a.ts)) BETWEEN 0 AND 3600 AND (date_trunc('second', b.ts) > date_trunc('second', a.ts) OR b.event_id > a.event_id) GROUP BY 1",
    "x_rollup": f"SELECT r_name, n_name, count(*) AS n, CAST(grouping(r_name, n_name) AS BIGINT) AS gid {_ON} GROUP BY ROLLUP (r_name, n_name)",
    "x_cube": f"SELECT r_name, c_mktsegment, count(*) AS n {_ON} GROUP BY CUBE (r_name, c_mktsegment)",
    "x_grouping_sets": f"SELECT r_name, o_orderstatus, count(*) AS n {_ON} GROUP BY GROUPING SETS ((r_name), (o_orderstatus), ())",
    "x_window_functions": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS nt, round(percent_rank() OVER w, 6) AS pr, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "x_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day_count FROM events",
    "x_intersect_except": "SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)",
    "x_tumbling_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "x_sliding_window": "SELECT strftime(date_trunc('hour', ts) - INTERVAL (h) HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, range(0, 2) t(h) GROUP BY 1",
    "x_session_window": "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
    "x_pivot": "SELECT user_id, nullif(count_if(event_type = 'click'), 0) AS click, nullif(count_if(event_type = 'error'), 0) AS error, nullif(count_if(event_type = 'view'), 0) AS view FROM events GROUP BY 1",
    "x_unpivot": "SELECT l_orderkey, l_linenumber, 'l_discount' AS what, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem",
    "x_variant_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "x_exists_subquery": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1",
    "x_cosine_top_k": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT q.vec_id AS q, v.vec_id, round(list_dot_product(v.v, q.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS cos FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY cos DESC, vec_id) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 3",
    "x_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
}
