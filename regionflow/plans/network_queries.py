"""Geography, pair weights, allocation, flow and mass-check queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionflow.functions.geo import haversine_km
from regionflow.operators import flows, network, quality
from regionflow.operators.apportion import apportion, apportion_columns
from regionflow.operators.skew import stored
from regionflow.plans import views as V
from regionflow.plans.registry import query, rounded, table

_PAIRS = f"""
    e AS ({V.ENTITY_SQL}), l AS ({V.LINKS_SQL}), m AS ({V.PAIR_SQL}),
    g AS (SELECT l.src, l.dst, a.pop AS pop_i, b.pop AS pop_j, coalesce(m.mul, 1.0) AS mul,
        pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat))
        * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
        FROM l JOIN e a ON a.entity = l.src JOIN e b ON b.entity = l.dst
        LEFT JOIN m ON m.src = l.src AND m.dst = l.dst),
    d AS (SELECT *, 12742.0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM g),
    raw AS (SELECT src, dst, 1e-6 * pow(pop_i, 0.2) * pow(pop_j, 1.0) * mul
        / pow(greatest(300, km), 1.2) AS w FROM d),
    edges AS (SELECT src, dst, w * least(1.0, 2e-5 / sum(w) OVER (PARTITION BY src)) AS w FROM raw)
"""
CAP = 2e-5


def _edges(spark: SparkSession, sf_dir: str, cap: float | None = CAP) -> DataFrame:
    ends = V.nation_links(spark, sf_dir)
    return network.gravity_edges(
        V.entities(spark, sf_dir, ends), V.links(spark, sf_dir, ends), V.pair_multipliers(spark, sf_dir, ends), cap=cap
    )


@query(
    "haversine_km",
    f"WITH {_PAIRS} SELECT src, dst, round(km, 6) AS km FROM d",
)
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = network.attach_ends(
        network.pairs_ne(V.links(spark, sf_dir)), V.entities(spark, sf_dir), ["lat", "lon"]
    )
    km = haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    return rounded(ends.select("src", "dst", km.alias("km")), 6, "km")


@query("gravity_edges", f"WITH {_PAIRS} SELECT src, dst, round(w * 1e6, 8) AS w FROM edges")
def gravity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_edges(spark, sf_dir).withColumn("w", F.col("w") * 1e6), 8, "w")


@query(
    "gravity_air_edges",
    f"""
    WITH {_PAIRS}
    SELECT d.src, d.dst, round((0.5 * sqrt((a.airports + 1) * (b.airports + 1)) * a.air_scale * b.air_scale
        + 0.5 * (pop_i + 1e-6) * (pop_j + 1e-6) / pow(km + 1, 1.6))
        * ((a.connectivity + b.connectivity) / 2) * (sqrt(a.gdp * b.gdp) / 50000)
        * ((a.mobility + b.mobility) / 2)
        * (1 + 0.15 * sin(30 * pi() / 180) * ((a.climate + b.climate) / 2)), 4) AS w
    FROM d JOIN e a ON a.entity = d.src JOIN e b ON b.entity = d.dst
    """,
)
def gravity_air_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = V.entities(spark, sf_dir).withColumn("pop", F.col("pop").cast("double"))
    return rounded(network.gravity_air_edges(people, V.links(spark, sf_dir), step=30), 4, "w")


@query("pairs_ne", V.LINKS_SQL)
def pairs_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.pairs_ne(V.links(spark, sf_dir))


@query(
    "pair_attribute",
    f"SELECT l.src, l.dst, coalesce(m.mul, 1.0) AS mul FROM ({V.LINKS_SQL}) l "
    f"LEFT JOIN ({V.PAIR_SQL}) m ON m.src = l.src AND m.dst = l.dst",
)
def pair_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = network.pairs_ne(V.links(spark, sf_dir))
    return network.pair_attribute(pairs, V.pair_multipliers(spark, sf_dir))


_ROUTES_SQL = (
    "SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(o_orderkey AS VARCHAR) AS dst, o_totalprice AS w FROM orders"
)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to their orders, as an edge list that grows with the data."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("src"),
        F.col("o_orderkey").cast("string").alias("dst"),
        F.col("o_totalprice").alias("w"),
    )


@query(
    "normalize_outbound",
    f"SELECT src, dst, round(w * (0.01 / sum(w) OVER (PARTITION BY src)), 9) AS w FROM ({_ROUTES_SQL})",
)
def normalize_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.normalize_outbound(_routes(spark, sf_dir), 0.01), 9, "w")


@query(
    "normalize_null_sources",
    "WITH x AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE src END AS src, dst, w FROM "
    f"(SELECT *, CAST(dst AS BIGINT) AS o_orderkey FROM ({_ROUTES_SQL}))) "
    "SELECT src, dst, round(w * (0.01 / sum(w) OVER (PARTITION BY src)), 9) AS w FROM x",
)
def normalize_null_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without a source are scaled together."""
    known = F.col("dst").cast("bigint") % 17 != 0
    routes = _routes(spark, sf_dir).withColumn("src", F.when(known, F.col("src")))
    return rounded(network.normalize_outbound(routes, 0.01), 9, "w")


@query(
    "cap_rows",
    f"SELECT src, dst, round(w * least(1.0, 2000000 / sum(w) OVER (PARTITION BY src)), 4) AS w FROM ({_ROUTES_SQL})",
)
def cap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.cap_rows(_routes(spark, sf_dir), 2_000_000.0), 4, "w")


@query(
    "scale_edge",
    f"WITH {_PAIRS} SELECT src, dst, round(w * CASE WHEN src = 'NATION_5' AND dst = 'NATION_3' THEN 3 ELSE 1 END * 1e6, 8) "
    "AS w FROM edges",
)
def scale_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = network.scale_edge(_edges(spark, sf_dir), "NATION_5", "NATION_3", 3.0)
    return rounded(edges.withColumn("w", F.col("w") * 1e6), 8, "w")


@query(
    "scale_row",
    f"""
    WITH {_PAIRS}, f AS (SELECT src, dst, w * CASE WHEN src = 'NATION_1' THEN 4 ELSE 1 END AS w FROM edges)
    SELECT src, dst, round(1e6 * w * CASE WHEN src = 'NATION_1'
        THEN least(1.0, 3e-5 / sum(w) OVER (PARTITION BY src)) ELSE 1 END, 8) AS w FROM f
    """,
)
def scale_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = network.scale_row(_edges(spark, sf_dir), "NATION_1", 4.0, cap=3e-5)
    return rounded(edges.withColumn("w", F.col("w") * 1e6), 8, "w")


@query(
    "scale_row_uncapped",
    f"WITH {_PAIRS} SELECT src, dst, round(1e6 * w * CASE WHEN src = 'NATION_1' THEN 4 ELSE 1 END, 8) AS w FROM edges",
)
def scale_row_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = network.scale_row(_edges(spark, sf_dir), "NATION_1", 4.0, cap=None)
    return rounded(edges.withColumn("w", F.col("w") * 1e6), 8, "w")


@query(
    "one_hop",
    f"SELECT src, dst, 0.0e0 AS w FROM ({V.LINKS_SQL}) WHERE NOT (src = 'NATION_2' AND dst = 'NATION_9') "
    "UNION ALL SELECT 'NATION_2', 'NATION_9', 0.004e0",
)
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.one_hop(_edges(spark, sf_dir), "NATION_2", "NATION_9")


_APPORTION = """
    WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice AS w, 10 + o_custkey % 90 AS total FROM orders),
    r AS (SELECT *, (w / sum(w) OVER (PARTITION BY o_custkey)) * total AS raw FROM x),
    b AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM r),
    k AS (SELECT *, total - CAST(sum(base) OVER (PARTITION BY o_custkey) AS BIGINT) AS left_over,
        row_number() OVER (PARTITION BY o_custkey ORDER BY raw - base DESC, o_orderkey) AS rank FROM b)
    SELECT o_custkey, o_orderkey, base + CASE WHEN rank <= left_over THEN 1 ELSE 0 END AS share FROM k
"""


@query("apportion", _APPORTION)
def apportion_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole total per customer, split over the customer's orders."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.col("o_totalprice").alias("w"),
        (F.lit(10) + F.col("o_custkey") % 90).alias("total"),
    )
    shares = apportion(orders, ["o_custkey"], {"total": "share"}, "w", "o_orderkey")
    return shares.select("o_custkey", "o_orderkey", "share")


@query("apportion_hot", _APPORTION)
def apportion_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split, groups of more than ten orders being settled by counting."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.col("o_totalprice").alias("w"),
        (F.lit(10) + F.col("o_custkey") % 90).alias("total"),
    )
    shares = apportion(orders, ["o_custkey"], {"total": "share"}, "w", "o_orderkey", hot_rows=10)
    return shares.select("o_custkey", "o_orderkey", "share")


@query(
    "apportion_columns",
    """
    WITH x AS (SELECT o_orderkey, o_orderkey % 97 AS total, u.k, u.w FROM orders,
        LATERAL (VALUES (0, CAST(o_custkey % 7 AS DOUBLE)), (1, CAST(o_orderkey % 5 AS DOUBLE)),
                        (2, o_totalprice / 100000)) u(k, w)),
    r AS (SELECT *, CASE WHEN total > 0 THEN (w / sum(w) OVER (PARTITION BY o_orderkey)) * total ELSE 0 END AS raw FROM x),
    b AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM r),
    s AS (SELECT *, total - CAST(sum(base) OVER (PARTITION BY o_orderkey) AS BIGINT) AS left_over,
        row_number() OVER (PARTITION BY o_orderkey ORDER BY raw - base DESC, k) AS rank FROM b),
    o AS (SELECT o_orderkey, k, base + CASE WHEN rank <= left_over THEN 1 ELSE 0 END AS share FROM s)
    SELECT o_orderkey, max(CASE WHEN k = 0 THEN share END) AS a, max(CASE WHEN k = 1 THEN share END) AS b,
    max(CASE WHEN k = 2 THEN share END) AS c FROM o GROUP BY o_orderkey
    """,
)
def apportion_within_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("total", F.col("o_orderkey") % 97)
    weights = [
        ("a", (F.col("o_custkey") % 7).cast("double")),
        ("b", (F.col("o_orderkey") % 5).cast("double")),
        ("c", F.col("o_totalprice") / 100000),
    ]
    return apportion_columns(rows, {"total": weights}).select("o_orderkey", "a", "b", "c")


# flows use weights large enough that many units move
_FLOW = f"""
    WITH {_PAIRS}, st AS ({V.STOCK_SQL}),
    fe AS (SELECT src, dst, w * 5000 AS w, idx FROM edges JOIN (SELECT entity, idx FROM e) ON entity = dst),
    o AS (SELECT src, sum(w) AS out_w FROM fe GROUP BY src),
    ex AS (SELECT scenario, entity, s, i,
        CAST(least(s, floor(s * coalesce(out_w, 0) + 1e-9)) AS BIGINT) AS export_s,
        CAST(least(i, floor(i * coalesce(out_w, 0) + 1e-9)) AS BIGINT) AS export_i
        FROM st LEFT JOIN o ON src = entity),
    x AS (SELECT scenario, src, dst, idx, w / sum(w) OVER (PARTITION BY scenario, src) AS share, export_s, export_i
        FROM ex JOIN fe ON src = entity),
    b AS (SELECT *, CAST(floor(share * export_s) AS BIGINT) AS base_s, CAST(floor(share * export_i) AS BIGINT) AS base_i FROM x),
    k AS (SELECT *, export_s - CAST(sum(base_s) OVER p AS BIGINT) AS left_s, export_i - CAST(sum(base_i) OVER p AS BIGINT) AS left_i,
        row_number() OVER (PARTITION BY scenario, src ORDER BY share * export_s - base_s DESC, idx) AS rank_s,
        row_number() OVER (PARTITION BY scenario, src ORDER BY share * export_i - base_i DESC, idx) AS rank_i
        FROM b WINDOW p AS (PARTITION BY scenario, src)),
    mv AS (SELECT scenario, src, dst, base_s + CASE WHEN rank_s <= left_s THEN 1 ELSE 0 END AS move_s,
        base_i + CASE WHEN rank_i <= left_i THEN 1 ELSE 0 END AS move_i FROM k),
    net AS (SELECT scenario, entity, CAST(sum(ns) AS BIGINT) AS net_s, CAST(sum(ni) AS BIGINT) AS net_i FROM (
        SELECT scenario, dst AS entity, move_s AS ns, move_i AS ni FROM mv
        UNION ALL SELECT scenario, entity, -export_s, -export_i FROM ex) GROUP BY scenario, entity)
"""


def _flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with a tie-breaking number, written once: a step reads them several times."""
    nation = table(spark, sf_dir, "nation")
    idx = nation.select(F.col("n_name").alias("dst"), F.col("n_nationkey").alias("idx"))
    return stored(_edges(spark, sf_dir).withColumn("w", F.col("w") * 5000).join(idx, "dst"), "flow-edges")


def _flow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks, written once: a step reads them twice."""
    return stored(V.stocks(spark, sf_dir).withColumn("t", F.lit(3)), "flow-states")


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.exports(V.stocks(spark, sf_dir), _flow_edges(spark, sf_dir))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source has at most one edge per entity, so its group is small
    edges = _flow_edges(spark, sf_dir)
    exported = flows.exports(V.stocks(spark, sf_dir), edges)
    return flows.allocate_exports(exported, edges, ["scenario"], hot_rows=None)


@query("exports", f"{_FLOW} SELECT scenario, entity, export_s, export_i FROM ex")
def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exports(spark, sf_dir).select("scenario", "entity", "export_s", "export_i")


@query("allocate_exports", f"{_FLOW} SELECT scenario, src, dst, move_s, move_i FROM mv")
def allocate_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir)


@query("net_flow", f"{_FLOW} SELECT scenario, entity, net_s, net_i FROM net")
def net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.net_flow(_moves(spark, sf_dir), ["scenario"])


_STEP = f"""{_FLOW}, after AS (SELECT st.scenario, st.entity, greatest(0, s + coalesce(net_s, 0)) AS s,
    greatest(0, i + coalesce(net_i, 0)) AS i, CAST(least(4, 100) AS INTEGER) AS t
    FROM st LEFT JOIN net ON net.scenario = st.scenario AND net.entity = st.entity)"""


@query("flow_step", f"{_STEP} SELECT * FROM after")
def flow_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, edges = _flow_states(spark, sf_dir), _flow_edges(spark, sf_dir)
    return flows.flow_step(states, edges, 100, ["scenario"], hot_rows=None)


@query(
    "apply_flows",
    f"""
    SELECT scenario, entity, greatest(0, s + CAST(CASE WHEN i > 10 THEN -2 * i * 1000 ELSE 5 END AS DOUBLE)) AS s,
    greatest(0, i - 1) AS i, CAST(3 AS INTEGER) AS t FROM ({V.STOCK_SQL})
    """,
)
def apply_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that exceed the stock stop at 0; time stops at its maximum."""
    states = _flow_states(spark, sf_dir)
    out = F.when(F.col("i") > 10, F.col("i") * -2000).otherwise(F.lit(5.0)).cast("bigint")
    net = states.select("scenario", "entity", out.alias("net_s"), F.lit(-1).alias("net_i"))
    return flows.apply_flows(states, net, 3, ["scenario"])


@query(
    "check_global_mass",
    f"{_STEP}, change AS (SELECT st.scenario, sum(a.s + a.i) - sum(st.s + st.i) AS x FROM st JOIN after a "
    "ON a.scenario = st.scenario AND a.entity = st.entity GROUP BY 1) "
    "SELECT scenario, CAST(x AS BIGINT) AS mass_change FROM change WHERE x <> 0",
)
def check_global_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios whose mass the exchange changed."""
    zero = {c: F.lit(0.0) for c in "rdv"}
    before = _flow_states(spark, sf_dir).withColumns(zero)
    after = flows.flow_step(before, _flow_edges(spark, sf_dir), 100, ["scenario"], hot_rows=None)
    return quality.check_global_mass(before, after, ["scenario"])


@query(
    "check_edges",
    f"WITH {_PAIRS} SELECT src, round(1e6 * sum(w), 6) AS row_sum, 0.0e0 AS diagonal FROM raw GROUP BY src "
    "HAVING sum(w) > 2.5e-5 + 1e-12",
)
def check_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources above the cap when none has been applied."""
    bad = quality.check_edges(_edges(spark, sf_dir, cap=None), cap=2.5e-5)
    return rounded(bad.withColumn("row_sum", F.col("row_sum") * 1e6), 6, "row_sum")


@query(
    "same_rows",
    "SELECT n_regionkey, CAST(sum(d) AS BIGINT) AS surplus FROM (SELECT n_regionkey, 1 AS d FROM customer "
    "JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_regionkey, -1 FROM supplier "
    "JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1 HAVING sum(d) <> 0",
)
def same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of customers against regions of suppliers, as bags."""
    nation = table(spark, sf_dir, "nation")
    mine = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    theirs = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return quality.row_differences(mine.select("n_regionkey"), theirs.select("n_regionkey"))
