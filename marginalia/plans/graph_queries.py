"""Graph queries over the derived part, supplier and user graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.operators import domains, features, graph, pairs
from marginalia.plans.base import AS_OF, DENSE, KIN, MARKED, NOTES, PARTS, SPARSE, dense, ends, kin, marked, notes, query, segments, six, sparse
from marginalia.session import keep, table, tidied

SN = f"{SPARSE}, nodes AS (SELECT src AS id FROM sparse UNION SELECT dst FROM sparse)"


@query("a6_g3_degrees", f"WITH {SN}, i AS (SELECT dst AS id, count(*) AS c FROM sparse GROUP BY dst), o AS (SELECT src AS id, count(*) AS c FROM sparse GROUP BY src) SELECT id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, round((coalesce(i.c, 0) + coalesce(o.c, 0))::DOUBLE / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def degrees(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.degrees(ends(e), e).select("id", "in_degree", "out_degree", six(F.col("centrality"), "centrality"))


CC = f"WITH RECURSIVE {SN}, b AS (SELECT src, dst FROM sparse UNION SELECT dst, src FROM sparse), c(id, root) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT x.dst, x.m FROM (SELECT b.dst, min(c.root) AS m FROM c JOIN b ON b.src = c.id GROUP BY b.dst) x JOIN recurring.c r ON r.id = x.dst WHERE x.m < r.root)"


@query("a14_g19_metrics", f"{CC}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM sparse UNION ALL SELECT dst FROM sparse) GROUP BY id), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), m AS (SELECT count(*) AS m FROM sparse), p AS (SELECT count(*) AS components, max(k) AS largest FROM (SELECT root, count(*) AS k FROM c GROUP BY root)) SELECT n::BIGINT AS nodes, m AS edges, round(m / (n * (n - 1)), 6) AS density, round((n * max(k) - sum(k)) / ((n - 1) * (n - 2)), 6) AS centralization, components, largest FROM d, n, m, p GROUP BY n, m, components, largest")
def metrics(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.metrics(ends(e), e).select("nodes", "edges", six(F.col("density"), "density"), six(F.col("centralization"), "centralization"), "components", "largest")


@query("a22_hubs", f"WITH {SPARSE} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM sparse UNION ALL SELECT dst FROM sparse) GROUP BY id HAVING count(*) > 5")
def hubs(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.degrees(ends(e), e).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).where("degree > 5")


def _pagerank_sql(rounds: int) -> str:
    """Rounds until the change is below n times 1e-6, at most as many as are written out here."""
    steps = "".join(
        f""", l{k} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS lost FROM r{k - 1} JOIN nodes USING (id) LEFT JOIN o USING (id) WHERE k IS NULL),
r{k} AS MATERIALIZED (SELECT nodes.id, (0.15 + 0.85 * (SELECT lost FROM l{k})) / (SELECT n FROM n) + 0.85 * coalesce(f.f, 0) AS r FROM nodes LEFT JOIN (SELECT dst AS id, sum(r / k) AS f FROM sparse JOIN r{k - 1} p ON p.id = src JOIN o ON o.id = src GROUP BY dst) f USING (id))"""
        for k in range(1, rounds + 1)
    )
    ends = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.r - b.r)) < (SELECT n FROM n) * 1e-6 AS small FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM r{k}" for k in range(1, rounds + 1))
    return f"WITH {SN}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), o AS (SELECT src AS id, count(*) AS k FROM sparse GROUP BY src), r0 AS (SELECT id, 1 / n AS r FROM nodes, n){steps}, stop AS (SELECT coalesce(min(k) FILTER (small), {rounds}) AS k FROM ({ends})) SELECT id, round(r, 6) AS rank FROM ({every}) JOIN stop USING (k)"


@query("g4_pagerank", _pagerank_sql(40))
def pagerank(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.pagerank(ends(e), e, 40, tolerance=1e-6).select("id", six(F.col("rank"), "rank"))


@query("g5_betweenness")
def betweenness(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.betweenness(e, ends(e)).select("id", six(F.col("betweenness"), "betweenness"))


KN = f"{KIN}, sparse AS (SELECT src, dst FROM kin), nodes AS (SELECT src AS id FROM kin UNION SELECT dst FROM kin)"
BFS = f"WITH RECURSIVE {KN}, m(source, id, d) USING KEY (source, id) AS (SELECT id, id, 0 FROM nodes UNION SELECT DISTINCT x.source, e.dst, x.d + 1 FROM m x JOIN sparse e ON e.src = x.id LEFT JOIN recurring.m r ON r.source = x.source AND r.id = e.dst WHERE r.id IS NULL)"


@query("g6_g9_g13_path_metrics", f"{BFS}, a AS (SELECT id, sum(d) AS t, count(*) AS r, sum(1.0::DOUBLE / d) AS h, max(d) AS e FROM m WHERE d > 0 GROUP BY id) SELECT nodes.id, round(coalesce(r::DOUBLE / t * r / ((SELECT count(*) FROM nodes) - 1), 0), 6) AS closeness, round(coalesce(h, 0), 6) AS harmonic, coalesce(e, 0)::BIGINT AS eccentricity FROM nodes LEFT JOIN a USING (id)")
def path_metrics(spark, sf_dir):
    e = kin(spark, sf_dir)
    out = graph.path_metrics(e, ends(e))
    return out.select("id", six(F.col("closeness"), "closeness"), six(F.col("harmonic"), "harmonic"), F.col("eccentricity").cast("long").alias("eccentricity"))


@query("g6_g9_g13_estimated")
def estimated_path_metrics(spark, sf_dir):
    """Of the whole part graph, by sketches."""
    e = sparse(spark, sf_dir)
    return graph.estimated_path_metrics(e, ends(e)).select("id", six(F.col("closeness"), "closeness"), six(F.col("harmonic"), "harmonic"), F.col("eccentricity").cast("long").alias("eccentricity"), "reached")


@query("g7_eigenvector")
def eigenvector(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.eigenvector(ends(e), graph.undirected(e), 1000, tolerance=1e-8).select("id", six(F.col("score"), "score"))


@query("g8_katz")
def katz(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.katz(ends(e), e).select("id", six(F.col("score"), "score"))


TRI = f"""{PARTS}, tri AS (SELECT x.src AS u, x.dst AS v, y.dst AS w FROM dense x JOIN dense y ON y.src = x.dst JOIN dense z ON z.src = x.src AND z.dst = y.dst),
links AS (SELECT id, count(*) AS links FROM (SELECT u AS id FROM tri UNION ALL SELECT v FROM tri UNION ALL SELECT w FROM tri) GROUP BY id)"""


@query("g10_g12_clustering", f"WITH {TRI} SELECT id, k AS degree, coalesce(links, 0) AS links, round(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(links, 0) / (k * (k - 1)) ELSE 0 END, 6) AS coefficient, round(CASE WHEN k > 1 THEN greatest(0, k - coalesce(links, 0)::DOUBLE / k) ELSE k END, 6) AS effective_size FROM deg LEFT JOIN links USING (id)")
def clustering(spark, sf_dir):
    return graph.clustering(sparse(spark, sf_dir)).select("id", "degree", "links", six(F.col("coefficient"), "coefficient"), six(F.col("effective_size"), "effective_size"))


@query("g11_constraint", f"WITH {PARTS}, m AS (SELECT a.src AS u, a.dst AS v, sum(1.0::DOUBLE / d.k) AS s FROM both_ a JOIN both_ b ON b.src = a.src AND b.dst <> a.dst JOIN both_ c ON c.src = a.dst AND c.dst = b.dst JOIN deg d ON d.id = b.dst GROUP BY a.src, a.dst), p AS (SELECT b.src AS id, d.k, ((1 + coalesce(s, 0)) / d.k) AS x FROM both_ b JOIN deg d ON d.id = b.src LEFT JOIN m ON m.u = b.src AND m.v = b.dst) SELECT id, round(CASE WHEN max(k) > 1 THEN least(1.0, sum(x * x)) ELSE 1.0 END, 6) AS constraint_ FROM p GROUP BY id")
def constraint(spark, sf_dir):
    return graph.constraint(sparse(spark, sf_dir)).select("id", six(F.col("constraint"), "constraint_"))


@query("g1_neighbourhood", f"WITH RECURSIVE {SPARSE}, b AS (SELECT src, dst FROM sparse UNION SELECT dst, src FROM sparse), c AS (SELECT min(src) AS c FROM sparse), p(id, d) AS (SELECT c, 0 FROM c UNION SELECT dst, d + 1 FROM p JOIN b ON src = id WHERE d < 3) SELECT id, min(d)::BIGINT AS distance FROM p GROUP BY id")
def neighbourhood(spark, sf_dir):
    e = sparse(spark, sf_dir)
    center = e.agg(F.min("src")).first()[0]
    return graph.neighbourhood(e, center, 3).select("id", F.col("distance").cast("long").alias("distance"))


PAIRS = "pos AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM sparse), neg AS (SELECT pos.a + 1 AS a, pos.b + 1 AS b FROM pos WHERE NOT EXISTS (SELECT 1 FROM pos q WHERE q.a = pos.a + 1 AND q.b = pos.b + 1)), pr AS (SELECT a, b FROM pos UNION SELECT a, b FROM neg)"


@query("g20_shortest_path", f"WITH RECURSIVE {KN}, {PAIRS}, e2 AS (SELECT src, dst FROM sparse UNION SELECT dst, src FROM sparse), m(source, id, d) USING KEY (source, id) AS (SELECT id, id, 0 FROM nodes UNION SELECT DISTINCT x.source, e.dst, x.d + 1 FROM m x JOIN e2 e ON e.src = x.id LEFT JOIN recurring.m r ON r.source = x.source AND r.id = e.dst WHERE r.id IS NULL) SELECT pr.a, pr.b, coalesce(m.d, 999)::BIGINT AS shortest_path FROM pr LEFT JOIN m ON m.source = pr.a AND m.id = pr.b")
def shortest_path(spark, sf_dir):
    """Distances of the pairs that are linked and of as many next to them that are not."""
    e = kin(spark, sf_dir)
    yes = pairs.positives(e)
    no = yes.select((F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b")).join(yes, ["a", "b"], "left_anti")
    return graph.shortest_paths(e, yes.unionByName(no)).select("a", "b", F.col("shortest_path").cast("long").alias("shortest_path"))


@query("g14_components", f"{CC} SELECT id, root AS component FROM c")
def components(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.components(ends(e), e)


@query("g15_communities")
def communities(spark, sf_dir):
    e = keep(dense(spark, sf_dir), "edges")
    return graph.modularity_communities(ends(e), e)


@query("g15_label_propagation")
def label_propagation(spark, sf_dir):
    e = dense(spark, sf_dir)
    return graph.communities(ends(e), e)


@query("h10_contribution", f"WITH {DENSE}, lab AS (SELECT id, c_nationkey AS community FROM deg JOIN customer ON c_custkey = id) SELECT id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY community), 6) AS contribution FROM lab")
def contribution(spark, sf_dir):
    e = dense(spark, sf_dir)
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    return graph.modularity_contribution(n.join(ends(e), "id")).select("id", six(F.col("contribution"), "contribution"))


#: Members of the largest nation, which is the largest component of the customer graph.
LARGEST = "big AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, min(c_custkey) LIMIT 1))"


@query("g18_diameter", f"WITH RECURSIVE {DENSE}, {LARGEST}, m(source, id, d) USING KEY (source, id) AS (SELECT id, id, 0 FROM big UNION SELECT DISTINCT x.source, e.dst, x.d + 1 FROM m x JOIN both_ e ON e.src = x.id LEFT JOIN recurring.m r ON r.source = x.source AND r.id = e.dst WHERE r.id IS NULL) SELECT max(d)::BIGINT AS diameter, round(avg(d), 6) AS avg_path_length FROM m WHERE d > 0")
def diameter(spark, sf_dir):
    e = dense(spark, sf_dir)
    return graph.diameter(e, ends(e)).select(F.col("diameter").cast("long").alias("diameter"), six(F.col("avg_path_length"), "avg_path_length"))


@query("g16_a13_modularity", f"WITH {DENSE}, lab AS (SELECT id, c_mktsegment AS community FROM deg JOIN customer ON c_custkey = id), m AS (SELECT count(*)::DOUBLE AS m FROM dense), d AS (SELECT community, sum(k) AS degree, count(*) AS size FROM deg JOIN lab USING (id) GROUP BY community), i AS (SELECT a.community, count(*) AS internal FROM dense JOIN lab a ON a.id = src JOIN lab b ON b.id = dst WHERE a.community = b.community GROUP BY a.community) SELECT community, size, coalesce(internal, 0) AS internal, degree::BIGINT AS degree, round(coalesce(internal, 0) / m - (degree / (2 * m)) ** 2, 6) AS modularity FROM d LEFT JOIN i USING (community), m")
def modularity(spark, sf_dir):
    e = dense(spark, sf_dir)
    return graph.modularity(e, segments(spark, sf_dir).join(ends(e), "id").withColumnRenamed("label", "community")).select("community", "size", "internal", "degree", six(F.col("modularity"), "modularity"))


@query("g17_bridges")
def bridges(spark, sf_dir):
    e = keep(dense(spark, sf_dir), "edges")
    n = keep(ends(e), "nodes")
    out = graph.bridges(e, graph.modularity_communities(n, e), graph.betweenness(graph.undirected(e), n))
    return out.select("id", "inter", "communities", six(F.col("ratio"), "ratio"), six(F.col("bridge_score"), "bridge_score"), "is_bridge")


@query("j8_g21_m5_common_neighbours", f"WITH {PARTS}, m AS (SELECT d.src AS a, d.dst AS b, count(*) AS common, sum(CASE WHEN k > 1 THEN 1 / ln(k::DOUBLE) ELSE 0 END) AS s FROM dense d JOIN both_ x ON x.src = d.src JOIN both_ y ON y.src = d.dst AND y.dst = x.dst JOIN deg ON deg.id = x.dst GROUP BY d.src, d.dst) SELECT src AS a, dst AS b, coalesce(common, 0) AS common, round(coalesce(s, 0), 6) AS adamic_adar FROM dense LEFT JOIN m ON a = src AND b = dst")
def common_neighbours(spark, sf_dir):
    """Of all linked parts."""
    e = sparse(spark, sf_dir)
    return graph.common_neighbours(e, pairs.positives(e)).select("a", "b", "common", six(F.col("adamic_adar"), "adamic_adar"))


@query("g21_all_common_neighbours", f"WITH {DENSE} SELECT a.dst AS a, b.dst AS b, count(*) AS common, round(sum(CASE WHEN k > 1 THEN 1 / ln(k::DOUBLE) ELSE 0 END), 6) AS adamic_adar FROM both_ a JOIN both_ b ON a.src = b.src AND a.dst < b.dst JOIN deg ON deg.id = a.src GROUP BY a.dst, b.dst")
def all_common_neighbours(spark, sf_dir):
    """Of all customers with a common neighbour."""
    return graph.common_neighbours(dense(spark, sf_dir)).select("a", "b", "common", six(F.col("adamic_adar"), "adamic_adar"))


@query("u5_subgraph", f"WITH {KIN}, u AS (SELECT id FROM (SELECT src AS id FROM kin UNION ALL SELECT dst FROM kin) GROUP BY id HAVING count(*) > 2) SELECT src, dst FROM kin WHERE src IN (FROM u) AND dst IN (FROM u)")
def subgraph(spark, sf_dir):
    """Links among customers who have more than two."""
    e = kin(spark, sf_dir)
    return graph.subgraph(e, graph.degrees(ends(e), e).where("in_degree + out_degree > 2").select("id"))


@query("o2_top_by_metric", f"WITH {PARTS} SELECT id, k AS degree FROM deg ORDER BY k DESC, id LIMIT 10")
def top(spark, sf_dir):
    return graph.top(graph.triangles(sparse(spark, sf_dir)).select("id", "degree"), "degree")


@query("m44_activity", f"WITH e AS (SELECT user_id AS id, epoch(ts)::DOUBLE AS t FROM events), w AS (SELECT max(t) - min(t) AS whole FROM e) SELECT id, count(*) AS n, round(0.5 * exp(-(epoch(TIMESTAMP '{AS_OF}') - max(t)) / (365.0 * 86400)) + 0.3 * least(1.0, count(*) / 10.0) + 0.2 * CASE WHEN count(*) > 1 THEN least(1.0, (max(t) - min(t)) / whole) ELSE 0 END, 6) AS activity FROM e, w GROUP BY id, whole")
def activity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    as_of = 1706745600.0  # AS_OF in seconds
    return graph.activity(e, as_of).select("id", "n", six(F.col("activity"), "activity"))


@query("g_time_user_graph", "WITH p AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) SELECT DISTINCT src, dst FROM p WHERE src <> dst")
def user_graph(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return graph.succession(p, ["ts", "event_id"], "user_id")


@query("g22_reachable", f"WITH RECURSIVE {SPARSE}, c AS (SELECT min(src) AS c FROM sparse), p(id, d) AS (SELECT c, 0 FROM c UNION SELECT dst, d + 1 FROM p JOIN sparse ON src = id WHERE d < 3) SELECT id, min(d)::BIGINT AS distance FROM p GROUP BY id HAVING min(d) > 0")
def reachable(spark, sf_dir):
    e = sparse(spark, sf_dir)
    return graph.reachable(e, e.agg(F.min("src")).first()[0], 3).select("id", F.col("distance").cast("long").alias("distance"))


MONTHS = "o AS (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) AS dst, o_orderdate FROM orders), e AS (SELECT DISTINCT src, dst FROM o WHERE src <> dst), n AS (SELECT o_custkey AS id, min(o_orderdate) AS created FROM orders GROUP BY 1), mo AS (SELECT id, strftime(created, '%Y-%m') AS month FROM n), x AS (SELECT a.month AS ma, b.month AS mb FROM e JOIN mo a ON a.id = src JOIN mo b ON b.id = dst), per AS (SELECT month, sum(own)::BIGINT AS internal, sum(1 - own)::BIGINT AS external FROM (SELECT ma AS month, (ma = mb)::INT AS own FROM x UNION ALL SELECT mb, 0 FROM x WHERE ma <> mb) GROUP BY month), cnt AS (SELECT month, count(*) AS nodes FROM mo GROUP BY month), pm AS (SELECT month, nodes, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, CASE WHEN nodes > 1 THEN coalesce(internal, 0)::DOUBLE / (nodes * (nodes - 1)) ELSE 0 END AS density FROM cnt LEFT JOIN per USING (month))"


def _months(spark, sf_dir):
    """Customers by the month of their first order, linked to the next one who ordered on the same day."""
    o = table(spark, sf_dir, "orders")
    day = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    e = o.select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(day).alias("dst")).where("src <> dst").distinct()
    n = o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created"))
    return graph.monthly_connectivity(n, e)


@query("a15_monthly_connectivity", f"WITH {MONTHS} SELECT month, nodes, internal, external, round(density, 6) AS density FROM pm")
def monthly(spark, sf_dir):
    return _months(spark, sf_dir).select("month", "nodes", "internal", "external", six(F.col("density"), "density"))


ACTIVE = f"e AS (SELECT o_custkey AS id, epoch(o_orderdate)::DOUBLE AS t FROM orders), w AS (SELECT max(t) - min(t) AS whole FROM e), act AS (SELECT id, round(0.5 * exp(-(epoch(TIMESTAMP '{AS_OF}') - max(t)) / (365.0 * 86400)) + 0.3 * least(1.0, count(*) / 10.0) + 0.2 * CASE WHEN count(*) > 1 THEN least(1.0, (max(t) - min(t)) / whole) ELSE 0 END, 6) AS activity FROM e, w GROUP BY id, whole)"


def _insights(spark, sf_dir):
    """Customers by their orders, and months by their first orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").cast("double").alias("ts"))
    return graph.temporal_insights(graph.activity(o, 1706745600.0).select("id", six(F.col("activity"), "activity")), _months(spark, sf_dir))


@query("a16_temporal_insights", f"WITH {MONTHS} SELECT count(*) AS periods, min(month) AS first, max(month) AS last, round(avg(density), 6) AS avg_density, round(min(density), 6) AS min_density, round(max(density), 6) AS max_density, min(nodes) AS min_nodes, max(nodes) AS max_nodes FROM pm")
def temporal_insights(spark, sf_dir):
    out = _insights(spark, sf_dir)["periods"]
    return out.select("periods", "first", "last", six(F.col("avg_density"), "avg_density"), six(F.col("min_density"), "min_density"), six(F.col("max_density"), "max_density"), "min_nodes", "max_nodes")


@query("a16_activity", f"WITH {ACTIVE} SELECT count(*) AS nodes, round(avg(activity), 5) AS avg_activity FROM act")
def average_activity(spark, sf_dir):
    return _insights(spark, sf_dir)["activity"].select("nodes", F.round("avg_activity", 5).alias("avg_activity"))


@query("a16_most_active", f"WITH {ACTIVE} SELECT id, activity FROM act ORDER BY activity DESC, id LIMIT 10")
def most_active(spark, sf_dir):
    return _insights(spark, sf_dir)["top"]


@query("h11_temporal_events", "SELECT o_orderkey AS id, 'created' AS kind, epoch(o_orderdate)::DOUBLE AS ts FROM orders UNION ALL SELECT l_orderkey, 'modified', epoch(max(l_shipdate))::DOUBLE FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def temporal_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").cast("double").alias("file_created"))
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").cast("timestamp").cast("double").alias("modified_time"))
    none = F.lit(None).cast("double")
    return graph.temporal_events(o.join(l, "id", "left").withColumns({"creation_time": none, "file_modified": none}))


@query("a23_relationship_counts", "SELECT o_orderpriority AS rel_type, count(*) AS n FROM orders GROUP BY 1")
def relationship_counts(spark, sf_dir):
    return graph.relationship_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rel_type")))


@query("j17_tag_context", "WITH t AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'), l AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderstatus = 'F') SELECT id, coalesce(array_to_string(list_sort(list(dst) FILTER (dst IS NOT NULL)), ','), '') AS linked FROM t LEFT JOIN l ON src = id GROUP BY id")
def tag_context(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = graph.tag_context(o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tag")), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), "1-URGENT")
    return out.select("id", F.array_join("linked", ",").alias("linked"))


@query("t16_positive_pairs", f"WITH {SPARSE} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM sparse")
def positives(spark, sf_dir):
    return pairs.positives(sparse(spark, sf_dir))


def _drawn_sql(name: str, members: str, taken: str, n: str, turns: str, seed: int) -> str:
    """CTEs of the first n draws from the pairs of groups (grp, id), as far as `turns` turns go; the last one has the name."""
    num = lambda text: f"('0x' || substr(md5({text}), 1, 12))::BIGINT"
    key = lambda r, x: num(f"'{seed}|' || grp || '|{r}|' || {x}")
    return f"""{name}_m AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS n, count(*) OVER (PARTITION BY grp) AS m FROM (SELECT DISTINCT grp, id FROM ({members}))),
{name}_g AS (SELECT DISTINCT grp, m, md5('{seed}|' || grp) AS turn, CASE WHEN m % 2 = 0 THEN m // 2 ELSE m END AS r, CASE WHEN m % 2 = 0 THEN m - 1 ELSE (m - 1) // 2 END AS c FROM {name}_m WHERE m > 1),
{name}_0 AS (SELECT *, unnest(range(0, least({turns}, m * (m - 1) // 2))) AS j FROM {name}_g), {name}_1 AS (SELECT *, j // c AS u, j % c AS v FROM {name}_0),
{name}_2 AS (SELECT * REPLACE ((u + {key(0, 'v')}) % r AS u) FROM {name}_1), {name}_3 AS (SELECT * REPLACE ((v + {key(1, 'u')}) % c AS v) FROM {name}_2),
{name}_4 AS (SELECT * REPLACE ((u + {key(2, 'v')}) % r AS u) FROM {name}_3), {name}_5 AS (SELECT * REPLACE ((v + {key(3, 'u')}) % c AS v) FROM {name}_4),
{name}_6 AS (SELECT *, u * c + v AS k, floor((1 + sqrt(1 + 8 * (u * c + v))) / 2)::BIGINT AS w FROM {name}_5),
{name}_7 AS (SELECT *, CASE WHEN w * (w - 1) // 2 > k THEN w - 1 WHEN w * (w + 1) // 2 <= k THEN w + 1 ELSE w END AS y FROM {name}_6),
{name}_8 AS (SELECT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, min((j, turn)) AS t FROM {name}_7 x JOIN {name}_m p ON p.grp = x.grp AND p.n = k - y * (y - 1) // 2 JOIN {name}_m q ON q.grp = x.grp AND q.n = y GROUP BY 1, 2),
{name} AS (SELECT a, b FROM {name}_8 ANTI JOIN (SELECT a, b FROM {taken}) USING (a, b) ORDER BY t, a, b LIMIT ({n}))"""


NO_GROUP = "SELECT '' AS grp, id FROM nodes"


@query("t12_random_negatives", f"WITH {SN}, pos AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM sparse), {_drawn_sql('f', NO_GROUP, 'pos', 'SELECT least(count(*), (SELECT count(*) * (count(*) - 1) // 2 FROM nodes) - count(*)) FROM pos', '4 * (SELECT count(*) FROM pos)', 42)} SELECT a, b FROM f")
def random_negatives(spark, sf_dir):
    return _negatives(sparse(spark, sf_dir))


@tidied("negatives")
def _negatives(edges):
    """As many random pairs as are linked; the graph and its pairs are made once."""
    p = keep(pairs.positives(edges), "positives")
    n = keep(ends(p.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "nodes")
    return pairs.random_negatives(n, p, pairs.target_negatives(p.count(), n.count(), 1.0))


STRATA = ", ".join([
    _drawn_sql("f", "SELECT folder AS grp, doc_id AS id FROM notes", "(SELECT 0 AS a, 0 AS b)", "100", "400", 42), _drawn_sql("t", "SELECT lang AS grp, doc_id AS id FROM notes", "f", "100", "400", 43),
    "ft AS (SELECT * FROM f UNION ALL SELECT * FROM t)", _drawn_sql("x", "SELECT '' AS grp, doc_id AS id FROM notes", "ft", "SELECT 300 - count(*) FROM ft", "4000", 44),
])


@query("t13_stratified_negatives", f"WITH {NOTES}, {STRATA} SELECT a, b FROM ft UNION ALL SELECT a, b FROM x")
def stratified_negatives(spark, sf_dir):
    n = notes(spark, sf_dir).select(F.col("doc_id").alias("id"), "folder", "lang")
    taken = spark.createDataFrame([], "a long, b long")
    return pairs.stratified_negatives(n, n.select("id", F.col("folder").alias("group")), n.select("id", F.col("lang").alias("group")), taken, 300)


@query("w2_capped_pairs", f"""WITH RECURSIVE {DENSE}, o AS (SELECT src AS a, dst AS b, row_number() OVER (ORDER BY md5('42|' || src || '|' || dst), src, dst) AS k FROM dense),
g(k, nodes, a, b, ok) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT, false UNION ALL SELECT k, CASE WHEN ok THEN list_concat(nodes, [a, b]) ELSE nodes END, a, b, ok FROM (SELECT o.k, g.nodes, o.a, o.b, len(list_filter(g.nodes, lambda x: x = o.a)) < 2 AND len(list_filter(g.nodes, lambda x: x = o.b)) < 2 AS ok FROM g JOIN o ON o.k = g.k + 1))
SELECT a, b FROM g WHERE ok""")
def capped(spark, sf_dir):
    """Two pairs a customer at most, by one pass in hash order."""
    return pairs.capped(dense(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")), 2)


@query("j13_negatives_not_positives", f"WITH {SPARSE}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM sparse) SELECT p.a + 1 AS a, p.b + 1 AS b FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.a + 1 AND q.b = p.b + 1)")
def not_positive(spark, sf_dir):
    p = pairs.positives(sparse(spark, sf_dir))
    return p.select((F.col("a") + 1).alias("a"), (F.col("b") + 1).alias("b")).join(p, ["a", "b"], "left_anti")


@query("t18_pair_features", rf"""WITH {MARKED}, f AS (SELECT doc_id, folder, modified, m.content, embedding::DOUBLE[] AS e, list_distinct(list_concat([m.lang, '🌱'], regexp_extract_all(regexp_replace(m.content, '^(?s:---\s*\n.*?\n---\s*\n)', ''), '(?:^|\s)#([a-zA-Z0-9_/-]+)(?:\s|$)', 1))) AS tags FROM marked m JOIN embeddings ON vec_id = doc_id),
g AS (SELECT *, length(content) AS l, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS w FROM f)
SELECT a.doc_id AS a, b.doc_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine_similarity, len(list_intersect(a.tags, b.tags))::BIGINT AS tag_overlap_count, round(len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS tag_jaccard, CASE WHEN a.folder = b.folder THEN 2 WHEN split_part(a.folder, '/', 1) = split_part(b.folder, '/', 1) THEN 4 ELSE 6 END::BIGINT AS path_distance, (a.folder = b.folder) AS same_folder,
  round(CASE WHEN greatest(a.w, b.w) > 0 THEN least(a.w, b.w)::DOUBLE / greatest(a.w, b.w) ELSE 0 END, 6) AS word_count_ratio, round(CASE WHEN greatest(a.l, b.l) > 0 THEN least(a.l, b.l)::DOUBLE / greatest(a.l, b.l) ELSE 0 END, 6) AS content_length_ratio,
  abs(date_diff('day', b.modified, a.modified))::BIGINT AS creation_time_diff_days, 1.0::DOUBLE AS quality_compatibility, 0.0::DOUBLE AS title_similarity, false AS semantic_cluster_match FROM g a JOIN g b ON b.doc_id = a.doc_id + 20""")
def pair_features(spark, sf_dir):
    """Marked notes with the vectors of their numbers."""
    n = marked(spark, sf_dir).withColumn("fields", M.frontmatter(F.col("content")))
    tags = M.tags(F.col("content"), F.col("fields"))
    n = n.select(F.col("doc_id").alias("id"), "path", F.col("stem").alias("title"), "content", F.col("modified").alias("created"), tags.alias("tags"), features.quality_stage(F.col("fields"), features.progress(tags, F.col("fields"))).alias("quality_stage"))
    n = n.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    p = n.select(F.col("id").alias("a"), (F.col("id") + 20).alias("b"))
    out = pairs.pair_features(p, n)
    return out.select("a", "b", six(F.col("cosine_similarity"), "cosine_similarity"), F.col("tag_overlap_count").cast("long").alias("tag_overlap_count"), six(F.col("tag_jaccard"), "tag_jaccard"), F.col("path_distance").cast("long").alias("path_distance"), "same_folder", six(F.col("word_count_ratio"), "word_count_ratio"), six(F.col("content_length_ratio"), "content_length_ratio"), "creation_time_diff_days", "quality_compatibility", six(F.col("title_similarity"), "title_similarity"), "semantic_cluster_match")


@query("a18_duplicate_pairs", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_pairs(spark, sf_dir):
    return pairs.duplicate_pairs(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


@query("a17_dataset_stats", "SELECT 'doc_id' AS column, count(*) AS rows, count(*) - count(doc_id) AS nulls FROM labels UNION ALL SELECT 'quality', count(*), count(*) - count(quality) FROM labels UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic) FROM labels")
def dataset_stats(spark, sf_dir):
    return pairs.dataset_stats(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


@query("a11_domain_edges", f"WITH {DENSE}, lab AS (SELECT id, c_mktsegment AS domain FROM deg JOIN customer ON c_custkey = id), sz AS (SELECT domain, count(*) AS n FROM lab GROUP BY domain), m AS (SELECT least(a.domain, b.domain) AS d1, greatest(a.domain, b.domain) AS d2, src, dst FROM dense JOIN lab a ON a.id = src JOIN lab b ON b.id = dst WHERE a.domain <> b.domain), e AS (SELECT d1, d2, count(*) AS connections FROM m GROUP BY d1, d2 HAVING count(*) >= 2), b AS (SELECT d1, d2, count(DISTINCT note) AS k FROM (SELECT d1, d2, src AS note FROM m UNION ALL SELECT d1, d2, dst FROM m) GROUP BY d1, d2) SELECT d1 AS from_domain, d2 AS to_domain, connections, round(least(1.0, connections / greatest(1.0, 0.1 * x.n * y.n)), 6) AS strength, CASE WHEN k > 5 THEN 'hierarchical' WHEN k > 2 THEN 'associative' ELSE 'sequential' END AS connection_type FROM e JOIN b USING (d1, d2) JOIN sz x ON x.domain = d1 JOIN sz y ON y.domain = d2")
def domain_edges(spark, sf_dir):
    e = dense(spark, sf_dir)
    out = domains.domain_edges(e, segments(spark, sf_dir).join(ends(e), "id").withColumnRenamed("label", "domain"))
    return out.select("from_domain", "to_domain", "connections", six(F.col("strength"), "strength"), "connection_type")


@query("t9_density_clusters")
def density_clusters(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return domains.density_clusters(v, 0.7)


@query("t11_bridge_opportunities")
def opportunities(spark, sf_dir):
    n = notes(spark, sf_dir)
    keys = domains.cluster_keywords(n.select(F.col("vault_name").alias("cluster"), "path", "content"))
    sizes = n.groupBy(F.col("vault_name").alias("cluster")).agg(F.count("*").alias("n"))
    out = domains.bridge_opportunities(keys.join(sizes, "cluster").select(F.col("cluster").alias("domain"), "n", "keywords"))
    return out.select("d1", "d2", six(F.col("similarity"), "similarity"), "priority", "rationale")
