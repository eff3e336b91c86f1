"""The core's queries over the test tables, and for those that SQL can express the SQL that gives the same rows.

Vertices without a part stand in part vertex_id % 8; a bisection takes parity of the part as the side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.functions import bisection_limits, max_part_weight, scaled_cost
from pinloom.model import Hypergraph
from pinloom.operators import balance, coarsen, labelprop, metrics, moves, refine, sampling, simplify, skew
from pinloom.options import Metric, Options
from pinloom.plans.bisect import bisect_multilevel
from pinloom.plans import recursive
from pinloom.plans.initial import best_restart, solve_restarts
from pinloom.shipping import ship
from pinloom.sources import matrix_lines, mtx
from pinloom.sources.export import export_pins

Query = Callable[[SparkSession, str], DataFrame]
K = 8
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """WITH RECURSIVE dp AS (SELECT DISTINCT net_id, vertex_id FROM pins WHERE net_id IS NOT NULL AND vertex_id IS NOT NULL),
v AS (SELECT vertex_id, coalesce(weight, 1) AS weight, coalesce(part, vertex_id % 8) AS part FROM vertices),
s AS (SELECT vertex_id, weight, part % 2 AS part FROM v),
n AS (SELECT net_id, coalesce(cost, 1) AS cost FROM nets),
sz AS (SELECT net_id, count(*) AS size FROM dp GROUP BY net_id),
lam AS (SELECT net_id, count(DISTINCT part) AS connectivity FROM dp JOIN v USING (vertex_id) GROUP BY net_id),
c AS (SELECT net_id, count(*) FILTER (part = 0) AS c0, count(*) FILTER (part = 1) AS c1 FROM dp JOIN s USING (vertex_id) GROUP BY net_id),
g AS (SELECT vertex_id, part, CAST(coalesce(gain, 0) AS BIGINT) AS gain FROM s LEFT JOIN (
  SELECT vertex_id, sum(CASE WHEN (CASE part WHEN 0 THEN c0 ELSE c1 END) = 1 THEN cost ELSE 0 END
    - CASE WHEN (CASE part WHEN 0 THEN c1 ELSE c0 END) = 0 THEN cost ELSE 0 END) AS gain
  FROM dp JOIN s USING (vertex_id) JOIN c USING (net_id) JOIN n USING (net_id) WHERE c0 + c1 > 1 GROUP BY vertex_id) USING (vertex_id)),
smp AS (SELECT vertex_id FROM s ORDER BY (vertex_id % 1000003 * 7919 + 104729) % 1000003, vertex_id LIMIT 200),
mp AS (SELECT dp.net_id, vertex_id, cost / (size - 1) AS scaled FROM dp JOIN sz USING (net_id) JOIN n USING (net_id) WHERE size >= 2),
deg AS (SELECT vertex_id, count(*) AS degree FROM dp GROUP BY vertex_id),
ip AS (SELECT a.vertex_id, b.vertex_id AS sample_id, round(sum(a.scaled) / least(min(d1.degree), min(d2.degree)), 9) AS product
  FROM mp a JOIN mp b USING (net_id) JOIN deg d1 ON d1.vertex_id = a.vertex_id JOIN deg d2 ON d2.vertex_id = b.vertex_id
  WHERE b.vertex_id IN (SELECT vertex_id FROM smp) AND a.vertex_id NOT IN (SELECT vertex_id FROM smp) GROUP BY 1, 2),
best AS (SELECT vertex_id, sample_id, product FROM ip QUALIFY row_number() OVER (PARTITION BY vertex_id ORDER BY product DESC, sample_id) = 1),
m0 AS (SELECT child_id, max(parent_id) AS parent_id FROM vertex_matches WHERE level = 0 GROUP BY child_id),
mv AS (SELECT shard, tag, vertex_id, coalesce(gain, 0) AS gain, coalesce(dw, 0) AS dw FROM moves WHERE shard IS NOT NULL AND tag IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY shard, tag ORDER BY received_at, vertex_id, gain, dw, sent_at) = 1),
fr AS (SELECT vertex_id, weight FROM v WHERE vertex_id NOT IN (SELECT vertex_id FROM dp)),
frt AS (SELECT vertex_id, sum(greatest(weight, 0)) OVER (ORDER BY -floor(log2(greatest(weight, 0) + 1)) * 64
  + floor((vertex_id % 1000003 * 7919 + 104729) % 1000003 * 64 / 1000003), (vertex_id % 1000003 * 7919 + 104729) % 1000003, vertex_id ROWS UNBOUNDED PRECEDING) AS total FROM fr)
"""


def query(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = (BASE if base else "") + sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def graph(spark: SparkSession, folder: str) -> Hypergraph:
    h = Hypergraph.from_tables(*(table(spark, folder, t) for t in ("pins", "vertices", "nets")))
    return Hypergraph(h.vertices.withColumn("part", F.coalesce("part", F.col("vertex_id") % K)), h.nets, h.pins)


def sides_of(h: Hypergraph) -> DataFrame:
    return h.vertices.select("vertex_id", "weight", (F.col("part") % 2).alias("part"))


def first_matches(spark: SparkSession, folder: str, level: int = 0) -> DataFrame:
    m = table(spark, folder, "vertex_matches").where(F.col("level") == level)
    return m.groupBy("child_id").agg(F.max("parent_id").alias("parent_id"))


# Sources


@query("pins_scan", "SELECT net_id, vertex_id FROM dp")
def _(s, d):
    return graph(s, d).pins


@query("order_part_pins", "SELECT DISTINCT l_orderkey AS net_id, l_partkey AS vertex_id FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL", base=False)
def _(s, d):
    return Hypergraph.from_pairs(table(s, d, "lineitem"), "l_orderkey", "l_partkey").pins


LINES = """WITH l AS (SELECT file_id, line_no, line, trim(regexp_replace(line, '\\r\\z', ''), ' \t') AS t FROM matrix_lines),
b AS (SELECT file_id, regexp_split_to_array(t, '[ \t]+') AS w, line FROM l WHERE line_no = 1),
banner AS (SELECT file_id, coalesce(len(w) = 5 AND w[1] = '%%MatrixMarket' AND w[2] = 'matrix' AND w[3] = 'coordinate'
  AND w[4] IN ('real', 'integer', 'pattern') AND w[5] IN ('general', 'symmetric'), false) AS good, w[4] AS field, w[5] AS symmetry FROM b),
size AS (SELECT file_id, line_no AS size_line, regexp_extract(t, '\\A("?)([0-9]+)("?)[ \t]+("?)([0-9]+)("?)[ \t]+("?)([0-9]+)("?)\\z',
  ['q1', 'nets', 'q2', 'q3', 'vertices', 'q4', 'q5', 'entries', 'q6']) AS m FROM l
  WHERE line_no > 1 AND line IS NOT NULL AND NOT starts_with(line, '%') AND t <> ''
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line_no) = 1),
head AS (SELECT banner.*, size_line, m.nets <> '' AND m.q1 = m.q2 AND m.q3 = m.q4 AND m.q5 = m.q6 AS sized,
  TRY_CAST(m.nets AS HUGEINT) AS nets, TRY_CAST(m.vertices AS HUGEINT) AS vertices FROM banner LEFT JOIN size USING (file_id)),
x AS (SELECT l.*, head.*, regexp_extract(t, '\\A("?)([0-9]+)("?)[ \t]+("?)([0-9]+)("?)(?:[ \t]+("?)([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)("?))?\\z',
  ['q1', 'e', 'q2', 'q3', 'v', 'q4', 'q5', 'value', 'q6']) AS m FROM l JOIN head USING (file_id)),
y AS (SELECT file_id, line_no, symmetry, good, sized, size_line, line IS NULL AS is_null, line_no = 1 OR starts_with(line, '%') OR t = '' AS other,
  m.e <> '' AND m.q1 = m.q2 AND m.q3 = m.q4 AND m.q5 = m.q6 AND (m.value = '') = (field = 'pattern')
  AND TRY_CAST(m.e AS HUGEINT) BETWEEN 1 AND nets AND TRY_CAST(m.v AS HUGEINT) BETWEEN 1 AND vertices AS fine,
  TRY_CAST(m.e AS BIGINT) AS e, TRY_CAST(m.v AS BIGINT) AS v FROM x)
"""


@query("p5_found", LINES + """SELECT file_id, line_no FROM y WHERE CASE WHEN NOT good THEN line_no = 1 WHEN size_line IS NOT NULL AND NOT sized THEN line_no = size_line
  WHEN is_null THEN line_no > 1 WHEN other OR size_line IS NULL OR line_no = size_line THEN false ELSE NOT fine END""", base=False)
def _(s, d):
    return matrix_lines.rejected_lines(table(s, d, "matrix_lines")).select("file_id", "line_no")


@query("p5_entries", LINES + """SELECT file_id, line_no, e, v FROM y WHERE good AND sized AND NOT is_null AND NOT other AND line_no > size_line AND fine""", base=False)
def _(s, d):
    return matrix_lines.load_lines(table(s, d, "matrix_lines")).where("kind = 'entry'").select("file_id", "line_no", "e", "v")


@query("p5_reasons")
def _(s, d):
    return matrix_lines.rejected_lines(table(s, d, "matrix_lines"))


@query("symmetric_mirror", LINES + """, en AS (SELECT * FROM y WHERE good AND sized AND NOT is_null AND NOT other AND line_no > size_line AND fine)
SELECT DISTINCT file_id, net_id, vertex_id FROM (SELECT file_id, e - 1 AS net_id, v - 1 AS vertex_id FROM en
  UNION ALL SELECT file_id, v - 1, e - 1 FROM en WHERE symmetry = 'symmetric' AND e <> v)""", base=False)
def _(s, d):
    return matrix_lines.loaded_pins(table(s, d, "matrix_lines"))


@query("random_hypergraph")
def _(s, d):
    return mtx.random_pins(s, 600, 600, 2500)


# Metrics


@query("vertex_degree_weight", "SELECT vertex_id, coalesce(degree, 0) AS weight FROM v LEFT JOIN deg USING (vertex_id)")
def _(s, d):
    h = graph(s, d)
    return metrics.vertex_degrees(h.vertices, h.pins)


@query("net_sizes", "SELECT net_id, size FROM sz")
def _(s, d):
    return metrics.net_sizes(graph(s, d).pins)


@query("net_scaled_cost", "SELECT net_id, size, CASE WHEN size > 1 THEN round(cost / (size - 1), 9) END AS scaled FROM sz JOIN n USING (net_id)")
def _(s, d):
    h = graph(s, d)
    return metrics.net_sizes(h.pins).join(h.nets, "net_id").select("net_id", "size", F.round(scaled_cost(), 9).alias("scaled"))


@query("part_weights", "SELECT part, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight FROM (SELECT unnest(range(8)) AS part) LEFT JOIN v USING (part) GROUP BY part")
def _(s, d):
    return metrics.part_weights(graph(s, d).vertices, K)


@query("total_weight", "SELECT CAST(sum(weight) AS BIGINT) AS weight FROM v")
def _(s, d):
    return graph(s, d).vertices.agg(F.sum("weight").alias("weight"))


@query("weight_range", "SELECT CAST(max(w) AS BIGINT) AS most FROM (SELECT sum(cost) AS w FROM dp JOIN n USING (net_id) GROUP BY vertex_id)")
def _(s, d):
    return metrics.gain_range(graph(s, d))


@query("load_balance", "SELECT max(w) AS max_weight, CAST(sum(w) AS BIGINT) AS total_weight, round(max(w) * 8 / sum(w) - 1, 9) AS imbalance FROM (SELECT CAST(sum(weight) AS BIGINT) AS w FROM v GROUP BY part)")
def _(s, d):
    return metrics.load_balance(graph(s, d).vertices, K)


@query("net_counts", "SELECT net_id, c0, c1 FROM c")
def _(s, d):
    h = graph(s, d)
    return metrics.net_counts(h.pins, sides_of(h))


@query("connectivity", "SELECT net_id, connectivity FROM lam")
def _(s, d):
    h = graph(s, d)
    return metrics.connectivity(h.pins, h.vertices)


CUTS = " FROM lam JOIN n USING (net_id) WHERE connectivity > 1"


@query("cutsize_cutnet", "SELECT CAST(sum(cost) AS BIGINT) AS cutnet" + CUTS)
def _(s, d):
    h = graph(s, d)
    return metrics.cut_sizes(h.pins, h.vertices, h.nets).select("cutnet")


@query("cutsize_lambda", "SELECT CAST(sum((connectivity - 1) * cost) AS BIGINT) AS lambda_minus_one" + CUTS)
def _(s, d):
    h = graph(s, d)
    return metrics.cut_sizes(h.pins, h.vertices, h.nets).select("lambda_minus_one")


@query("cutsize_from_counts", "SELECT CAST(sum(cost) AS BIGINT) AS cut FROM c JOIN n USING (net_id) WHERE c0 > 0 AND c1 > 0")
def _(s, d):
    h = graph(s, d)
    return metrics.cut_from_counts(metrics.net_counts(h.pins, sides_of(h)), h.nets)


@query("kstart", "SELECT p AS position, CAST((SELECT count(*) FROM dp JOIN v USING (vertex_id) WHERE part < p) AS BIGINT) AS start FROM (SELECT unnest(range(9)) AS p)")
def _(s, d):
    h = graph(s, d)
    return metrics.kstart(h.pins, h.vertices, K)


@query("partition_export", "SELECT part, net_id + 1 AS net, vertex_id + 1 AS vertex FROM dp JOIN v USING (vertex_id)")
def _(s, d):
    h = graph(s, d)
    return export_pins(h.pins, h.vertices)


@query("check_incidence", "SELECT 'net' AS kind, net_id AS id FROM dp WHERE net_id NOT IN (SELECT net_id FROM n) UNION SELECT 'vertex', vertex_id FROM dp WHERE vertex_id NOT IN (SELECT vertex_id FROM v)")
def _(s, d):
    return metrics.check_incidence(graph(s, d))


REPORT = """SELECT CAST(8 AS INT) AS k, (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM dp) AS n_pins,
(SELECT round(max(w) * 8 / sum(w) - 1, 9) FROM (SELECT sum(weight) AS w FROM v GROUP BY part)) AS imbalance,
(SELECT CAST(sum(cost) AS BIGINT)""" + CUTS + """) AS cutnet, (SELECT CAST(sum((connectivity - 1) * cost) AS BIGINT)""" + CUTS + """) AS lambda_minus_one,
(SELECT string_agg(CAST(w AS VARCHAR), ',' ORDER BY part) FROM (SELECT part, CAST(sum(weight) AS BIGINT) AS w FROM v GROUP BY part)) AS part_weights"""


@query("quality_report", REPORT)
def _(s, d):
    return metrics.quality_report(graph(s, d), K)


@query("order_part_cut", """WITH op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), l AS (SELECT o, count(DISTINCT p % 4) AS x FROM op GROUP BY o)
SELECT CAST(count(*) FILTER (x > 1) AS BIGINT) AS cutnet, CAST(sum(x - 1) AS BIGINT) AS lambda_minus_one FROM l""", base=False)
def _(s, d):
    h = Hypergraph.from_pairs(table(s, d, "lineitem"), "l_orderkey", "l_partkey")
    return metrics.cut_sizes(h.pins, h.vertices.select("vertex_id", (F.col("vertex_id") % 4).alias("part")), h.nets)


# Simplification and set maintenance


@query("drop_small_nets", "SELECT net_id, vertex_id FROM dp JOIN sz USING (net_id) WHERE size > 2")
def _(s, d):
    return simplify.drop_small_nets(graph(s, d).pins, 2)


@query("free_vertices", "SELECT vertex_id, weight FROM fr")
def _(s, d):
    h = graph(s, d)
    return simplify.free_vertices(h.vertices, h.pins).select("vertex_id", "weight")


SETS = ", sets AS (SELECT net_id, list(vertex_id ORDER BY vertex_id) AS vs FROM dp GROUP BY net_id), rep AS (SELECT net_id, max(net_id) OVER (PARTITION BY vs) AS rep_id FROM sets) "


@query("duplicate_nets", SETS + "SELECT net_id, rep_id FROM rep")
def _(s, d):
    return simplify.duplicate_nets(graph(s, d).pins)


@query("merge_dup_nets", SETS + "SELECT rep_id AS net_id, CAST(sum(cost) AS BIGINT) AS cost FROM rep JOIN n USING (net_id) GROUP BY rep_id")
def _(s, d):
    return simplify.merge_duplicate_nets(graph(s, d))[0].nets


@query("cut_nets", "SELECT net_id, connectivity FROM lam WHERE connectivity > 1")
def _(s, d):
    h = graph(s, d)
    return metrics.cut_nets(h.pins, h.vertices)


@query("remove_cut_nets", "SELECT net_id, vertex_id FROM dp WHERE net_id NOT IN (SELECT net_id FROM lam WHERE connectivity > 1)")
def _(s, d):
    h = graph(s, d)
    return simplify.remove_cut_nets(h, h.vertices).pins


@query("induced_subgraph", ", i AS (SELECT dp.* FROM dp JOIN v USING (vertex_id) WHERE part < 4) SELECT net_id, vertex_id FROM i WHERE net_id IN (SELECT net_id FROM i GROUP BY net_id HAVING count(*) > 1)")
def _(s, d):
    h = graph(s, d)
    return simplify.induced_subgraph(h, h.vertices.where("part < 4")).pins


@query("remove_nets", "SELECT net_id, vertex_id FROM dp WHERE net_id NOT IN (SELECT net_id FROM n WHERE cost > 1)")
def _(s, d):
    h = graph(s, d)
    return simplify.remove_nets(h, h.nets.where("cost > 1").select("net_id")).pins


@query("remove_vertices", "SELECT net_id, vertex_id FROM dp WHERE vertex_id NOT IN (SELECT vertex_id FROM v WHERE part = 3)")
def _(s, d):
    h = graph(s, d)
    return simplify.remove_vertices(h, h.vertices.where("part = 3").select("vertex_id")).pins


@query("add_vertices", "SELECT vertex_id, weight FROM v UNION ALL SELECT p_partkey, 1 FROM part WHERE p_partkey NOT IN (SELECT vertex_id FROM v)")
def _(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("vertex_id"), F.lit(1).cast("bigint").alias("weight"), F.lit(None).cast("bigint").alias("part"))
    return simplify.add_vertices(graph(s, d), rows).vertices.select("vertex_id", "weight")


@query("add_nets", "SELECT net_id, vertex_id FROM dp UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
def _(s, d):
    h, more = graph(s, d), Hypergraph.from_pairs(table(s, d, "lineitem"), "l_orderkey", "l_partkey")
    return simplify.add_nets(h, more.nets, more.pins).pins


# Hot keys


@query("p1_found", "SELECT 'net' AS side, net_id AS key_id FROM dp GROUP BY net_id HAVING count(*) * 100 >= (SELECT count(*) FROM dp) UNION ALL SELECT 'vertex', vertex_id FROM dp GROUP BY vertex_id HAVING count(*) * 100 >= (SELECT count(*) FROM dp)")
def _(s, d):
    return skew.frequent_keys(table(s, d, "pins")).select("side", "key_id")


@query("p1_net_profile", """SELECT net_id, count(*) AS size, CAST(sum(coalesce(x.weight, 0)) AS BIGINT) AS weight, count(DISTINCT x.part) AS parts, min(nets.cost) AS cost
FROM dp LEFT JOIN vertices x USING (vertex_id) LEFT JOIN nets USING (net_id) GROUP BY net_id""")
def _(s, d):
    return skew.net_profile(*(table(s, d, t) for t in ("pins", "vertices", "nets")))


@query("p1_vertex_profile", """SELECT vertex_id, count(*) AS degree, CAST(sum(coalesce(y.cost, 1)) AS BIGINT) AS cost, CAST(max(coalesce(y.cost, 1)) AS BIGINT) AS max_cost, min(x.weight) AS weight
FROM dp LEFT JOIN nets y USING (net_id) LEFT JOIN vertices x USING (vertex_id) GROUP BY vertex_id""")
def _(s, d):
    return skew.vertex_profile(*(table(s, d, t) for t in ("pins", "vertices", "nets")))


# Gains and moves


@query("move_gains", "SELECT vertex_id, part, gain FROM g")
def _(s, d):
    h = graph(s, d)
    return metrics.move_gains(h.pins, sides_of(h), h.nets)


@query("top_moves", """SELECT CAST((vertex_id % 1000003 * 7919 + 104729) % 1000003 % 8 AS INT) AS shard, tag, vertex_id, gain, dw FROM (
  SELECT vertex_id, gain, CASE part WHEN 0 THEN -weight ELSE weight END AS dw,
    row_number() OVER (PARTITION BY (vertex_id % 1000003 * 7919 + 104729) % 1000003 % 8 ORDER BY gain DESC, vertex_id) - 1 AS tag FROM g JOIN v USING (vertex_id) WHERE gain >= 0) WHERE tag < 20""".replace("FROM g JOIN v USING (vertex_id)", "FROM (SELECT g.*, v.weight FROM g JOIN v USING (vertex_id))"))
def _(s, d):
    h = graph(s, d)
    return moves.top_moves(metrics.move_gains(h.pins, sides_of(h), h.nets), h.vertices, 8, 20)


@query("clean_moves", "SELECT shard, tag, vertex_id, gain, dw FROM mv")
def _(s, d):
    return moves.clean_moves(table(s, d, "moves"))


REJECT = """, t AS (SELECT CAST(sum(dw) AS BIGINT) AS x FROM mv), o AS (SELECT 20000 + x - 20010 AS o0, 20000 - x - 20010 AS o1 FROM t),
f AS (SELECT shard, tag, gain, dw, abs(dw) AS fills, row_number() OVER (ORDER BY gain, tag DESC, shard) AS i FROM mv, o WHERE CASE WHEN o0 > 0 THEN dw > 0 WHEN o1 > 0 THEN dw < 0 ELSE false END),
walk AS (SELECT CAST(0 AS BIGINT) AS i, greatest(o0, o1, 0) AS need, CAST(-least(o0, o1) AS BIGINT) AS room, CAST([] AS INT[]) AS stopped, false AS rejected FROM o
  UNION ALL SELECT f.i, CASE WHEN r THEN need - fills ELSE need END, CASE WHEN r THEN room - fills ELSE room END,
    CASE WHEN need > 0 AND NOT r AND NOT list_contains(stopped, shard) THEN list_append(stopped, shard) ELSE stopped END, r
  FROM walk JOIN f ON f.i = walk.i + 1, LATERAL (SELECT need > 0 AND fills <= room AND NOT list_contains(stopped, shard) AS r)),
rj AS (SELECT mv.*, coalesce(walk.rejected, false) AS rejected FROM mv LEFT JOIN f USING (shard, tag) LEFT JOIN walk ON walk.i = f.i) """


@query("reject_moves", REJECT + "SELECT shard, tag, vertex_id, gain, dw, rejected FROM rj")
def _(s, d):
    return moves.reject_unbalanced(moves.clean_moves(table(s, d, "moves")), 20_000, 20_000, 20_010, 20_010)


@query("best_prefix", "SELECT n AS moves, CAST(gs AS BIGINT) AS gain FROM (SELECT sum(gain) OVER w AS gs, count(*) OVER w AS n FROM mv WINDOW w AS (ORDER BY shard, tag ROWS UNBOUNDED PRECEDING)) WHERE gs >= 0 ORDER BY gs DESC, n DESC LIMIT 1")
def _(s, d):
    return moves.best_prefix(moves.clean_moves(table(s, d, "moves")))


@query("apply_moves", REJECT + "SELECT vertex_id, CASE WHEN vertex_id IN (SELECT vertex_id FROM rj WHERE NOT rejected) THEN 1 - part ELSE part END AS part FROM s")
def _(s, d):
    kept = moves.reject_unbalanced(moves.clean_moves(table(s, d, "moves")), 20_000, 20_000, 20_010, 20_010).where("not rejected")
    return moves.apply_moves(sides_of(graph(s, d)), kept)


@query("counts_after_moves", REJECT + """, t2 AS (SELECT vertex_id FROM rj WHERE NOT rejected), u AS (SELECT vertex_id, CASE WHEN vertex_id IN (SELECT vertex_id FROM t2) THEN 1 - part ELSE part END AS part FROM s),
touched AS (SELECT DISTINCT net_id FROM dp WHERE vertex_id IN (SELECT vertex_id FROM t2))
SELECT net_id, count(*) FILTER (part = 0) AS c0, count(*) FILTER (part = 1) AS c1 FROM dp JOIN u USING (vertex_id) WHERE net_id IN (SELECT net_id FROM touched) GROUP BY net_id""")
def _(s, d):
    h = graph(s, d)
    kept = moves.reject_unbalanced(moves.clean_moves(table(s, d, "moves")), 20_000, 20_000, 20_010, 20_010).where("not rejected")
    return moves.changed_counts(h.pins, sides_of(h).select("vertex_id", "part"), kept)


# Matching and contraction


@query("sample_hash", "SELECT vertex_id FROM smp")
def _(s, d):
    return sampling.sample_random(graph(s, d).vertices, 200)


@query("label_histogram", "SELECT label, count(v.vertex_id) AS members FROM (SELECT unnest(range(700)) AS label) LEFT JOIN v ON label = (vertex_id % 1000003 * 7919 + 104729) % 1000003 % 700 GROUP BY label")
def _(s, d):
    return sampling.label_histogram(labelprop.initial_labels(graph(s, d).vertices, 700), 700)


@query("neighbours", "SELECT a.vertex_id, b.vertex_id AS other_id, count(*) AS nets, round(sum(a.scaled), 9) AS product FROM mp a JOIN mp b USING (net_id) JOIN sz USING (net_id) WHERE size <= 64 AND a.vertex_id <> b.vertex_id GROUP BY 1, 2")
def _(s, d):
    h = graph(s, d)
    return coarsen.neighbours(h.pins, h.nets)


def _products(s, d):
    h = graph(s, d)
    return coarsen.inner_products(h.pins, h.nets, sampling.sample_random(h.vertices, 200))


@query("inner_products", "SELECT vertex_id, sample_id, product FROM ip")
def _(s, d):
    return _products(s, d)


@query("best_sample", "SELECT vertex_id, sample_id, product FROM best")
def _(s, d):
    return coarsen.best_samples(_products(s, d))


@query("accepted_matches", "SELECT vertex_id, sample_id, product FROM best QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY product DESC, vertex_id) <= 5")
def _(s, d):
    return coarsen.accepted_matches(coarsen.best_samples(_products(s, d)), 5)


@query("contract_pins", "SELECT DISTINCT net_id, coalesce(parent_id, vertex_id) AS vertex_id FROM dp LEFT JOIN m0 ON child_id = vertex_id")
def _(s, d):
    return coarsen.contract(graph(s, d), first_matches(s, d)).pins


@query("contract_weights", "SELECT coalesce(parent_id, vertex_id) AS vertex_id, CAST(sum(weight) AS BIGINT) AS weight, CASE WHEN min(part) = max(part) THEN min(part) END AS part FROM v LEFT JOIN m0 ON child_id = vertex_id GROUP BY 1")
def _(s, d):
    return coarsen.contract(graph(s, d), first_matches(s, d)).vertices


@query("project_labels", "SELECT a.vertex_id, s.part FROM s a LEFT JOIN m0 ON child_id = a.vertex_id LEFT JOIN s ON s.vertex_id = coalesce(parent_id, a.vertex_id)")
def _(s, d):
    h = graph(s, d)
    return coarsen.project_labels(h.vertices, first_matches(s, d), sides_of(h))


LINEAGE = """WITH RECURSIVE v AS (SELECT vertex_id FROM vertices WHERE vertex_id IS NOT NULL),
m AS (SELECT level, child_id, max(parent_id) AS parent_id FROM vertex_matches GROUP BY ALL),
a AS (SELECT vertex_id, vertex_id AS top_id, (SELECT min(level) FROM m) AS level FROM v
  UNION ALL SELECT a.vertex_id, coalesce(m.parent_id, a.top_id), a.level + 1 FROM a LEFT JOIN m ON m.level = a.level AND m.child_id = a.top_id WHERE a.level <= (SELECT max(level) FROM m))
SELECT vertex_id, top_id FROM a WHERE level > (SELECT max(level) FROM m)"""


@query("lineage", LINEAGE, base=False)
def _(s, d):
    return coarsen.lineage(graph(s, d).vertices, table(s, d, "vertex_matches"))


# Label propagation


def _lp_sql(rounds: int, labels: int) -> str:
    out = f", s0 AS (SELECT vertex_id, (vertex_id % 1000003 * 7919 + 104729) % 1000003 % {labels} AS label FROM v)"
    for i in range(rounds):
        out += f""", k{i} AS (SELECT net_id, label, count(*) AS n FROM dp JOIN s{i} USING (vertex_id) GROUP BY 1, 2),
q{i} AS (SELECT dp.vertex_id, k.label, sum(k.n) - sum(CASE WHEN k.label = s.label THEN 1 ELSE 0 END) AS n, min(s.label) AS own FROM dp JOIN k{i} k USING (net_id) JOIN s{i} s ON s.vertex_id = dp.vertex_id GROUP BY 1, 2),
b{i} AS (SELECT vertex_id, CASE WHEN n > 0 THEN label ELSE own END AS label FROM q{i} QUALIFY row_number() OVER (PARTITION BY vertex_id ORDER BY n DESC, label = own DESC, label) = 1),
s{i + 1} AS (SELECT vertex_id, coalesce(b.label, s.label) AS label FROM s{i} s LEFT JOIN b{i} b USING (vertex_id))"""
    return out


def _lp(s, d, rounds):
    h = graph(s, d)
    return labelprop.label_propagation(h.pins, labelprop.initial_labels(h.vertices, 16), rounds)


@query("lp_round_1", _lp_sql(1, 16) + " SELECT vertex_id, label FROM s1")
def _(s, d):
    return _lp(s, d, 1)


@query("lp_3_rounds", _lp_sql(3, 16) + " SELECT vertex_id, label FROM s3")
def _(s, d):
    return _lp(s, d, 3)


@query("sample_lp", _lp_sql(2, 100) + " SELECT vertex_id FROM s2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY (vertex_id % 1000003 * 7919 + 104729) % 1000003, vertex_id) = 1")
def _(s, d):
    h = graph(s, d)
    return sampling.sample_label_propagation(h.pins, h.vertices, 100, 2)


# Limits and capacity


@query("max_global_weight", """SELECT CAST(k AS INT) AS k, CAST(floor(w / k * lo * (1 + (m * k / w - 1.0::DOUBLE) / (floor(log2(lo)) + 1))) AS BIGINT) AS low, CAST(floor(w / k * (k - lo) * (1 + (m * k / w - 1.0::DOUBLE) / (floor(log2(k - lo)) + 1))) AS BIGINT) AS high
FROM (SELECT k, k // 2 AS lo, w, CAST(floor(1.03::DOUBLE * w / 8) AS BIGINT) AS m FROM (SELECT unnest([2, 3, 4, 7, 8]) AS k), (SELECT CAST(sum(weight) AS BIGINT) AS w FROM v))""")
def _(s, d):
    w = int(graph(s, d).vertices.agg(F.sum("weight")).first()[0])
    rows = [(k, *bisection_limits(k, k // 2, k - k // 2, w, max_part_weight(w, 8, 0.03))) for k in (2, 3, 4, 7, 8)]
    return s.createDataFrame(rows, "k int, low bigint, high bigint")


@query("free_assign_quota", "SELECT vertex_id, CAST(CASE WHEN total <= floor((SELECT sum(weight) FROM fr) / 2) THEN 0 ELSE 1 END AS BIGINT) AS part FROM frt")
def _(s, d):
    h = graph(s, d)
    free = simplify.free_vertices(h.vertices, h.pins)
    weight = int(free.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    return balance.assign_free(free, balance.free_quota(0, 0, 1, 1, weight))


def _half(h: Hypergraph, eps: float = 0.03) -> tuple[int, int]:
    w = int(h.vertices.agg(F.sum("weight")).first()[0])
    return (max_part_weight(w, 2, eps),) * 2


@query("bisect_random", """, r AS (SELECT vertex_id, (vertex_id % 1000003 * 7919 + 104729) % 1000003 % 2 AS side,
  sum(weight) OVER (PARTITION BY (vertex_id % 1000003 * 7919 + 104729) % 1000003 % 2 ORDER BY (vertex_id % 1000003 * 7919 + 209458) % 1000003, vertex_id ROWS UNBOUNDED PRECEDING) AS total FROM v)
SELECT vertex_id, CAST(CASE WHEN total <= (SELECT floor(1.03::DOUBLE * sum(weight) / 2) FROM v) THEN side ELSE 1 - side END AS BIGINT) AS part FROM r""")
def _(s, d):
    h = graph(s, d)
    return balance.bisect_random(h.vertices, *_half(h))


# Iterative algorithms: no SQL


@query("initial_partition")
def _(s, d):
    h = graph(s, d)
    pins = simplify.drop_small_nets(h.pins, 1)
    sub = Hypergraph(h.vertices.join(pins.select("vertex_id"), "vertex_id", "left_semi"), h.nets, pins)
    options = Options()
    if pins.count() > options.kernel_max_pins:  # not for restarts of the kernel as a whole
        return bisect_multilevel(sub, _half(h), options)
    return best_restart(solve_restarts(sub, _half(h), options))


@query("refine_rounds")
def _(s, d):
    h = graph(s, d)
    return refine.refine_rounds(h, sides_of(h).select("vertex_id", "part"), _half(h), Options())[0]


@query("bisect_multilevel")
def _(s, d):
    h = graph(s, d)
    return bisect_multilevel(h, _half(h), Options())


def _parts(s, d, k, metric):
    return recursive.partition(graph(s, d), Options(k=k, metric=metric))


@query("recursive_bisect_k4")
def _(s, d):
    return _parts(s, d, 4, Metric.LAMBDA_MINUS_ONE)


@query("recursive_bisect_k7")
def _(s, d):
    return _parts(s, d, 7, Metric.CUT_NET)
