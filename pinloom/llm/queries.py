"""The subpackage's queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinloom.llm import cooccurrence, mixing, personal, records, similar, tokens
from pinloom.model import clean_pins
from pinloom.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DP = "WITH dp AS (SELECT DISTINCT net_id, vertex_id FROM pins WHERE net_id IS NOT NULL AND vertex_id IS NOT NULL)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vertex_sets(s: SparkSession, d: str) -> DataFrame:
    return clean_pins(table(s, d, "pins")).select(F.col("vertex_id").alias("id"), F.col("net_id").alias("value"))


SIMILAR = DP + """, x AS (SELECT vertex_id, list(net_id) AS s, count(*) AS n FROM dp GROUP BY vertex_id HAVING count(*) >= 4),
f AS (SELECT net_id, count(*) AS c FROM dp JOIN x USING (vertex_id) GROUP BY net_id),
pre AS (SELECT vertex_id, net_id, n FROM dp JOIN x USING (vertex_id) JOIN f USING (net_id) QUALIFY row_number() OVER (PARTITION BY vertex_id ORDER BY c, net_id) <= n - (7 * n + 9) // 10 + 1),
cand AS (SELECT DISTINCT a.vertex_id AS a, b.vertex_id AS b FROM pre a JOIN pre b USING (net_id) WHERE a.vertex_id < b.vertex_id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)),
j AS (SELECT a, b, p.n AS na, q.n AS nb, len(list_intersect(p.s, q.s)) AS i FROM cand JOIN x p ON p.vertex_id = a JOIN x q ON q.vertex_id = b),
found AS (SELECT a AS vertex_a, b AS vertex_b FROM j WHERE 10 * i >= 7 * (na + nb - i))
"""


@query("p2_found", SIMILAR + "SELECT vertex_a, vertex_b FROM found")
def _(s, d):
    return similar.similar_pairs(vertex_sets(s, d), 0.7, 4).select(F.col("id_a").alias("vertex_a"), F.col("id_b").alias("vertex_b"))


@query("p2_links", SIMILAR + """, l AS (SELECT vertex_a AS v FROM found UNION ALL SELECT vertex_b FROM found),
y AS (SELECT vertex_id, min(vertex_id) OVER (PARTITION BY list_sort(s)) AS class_id FROM x)
SELECT vertex_id, class_id, (SELECT count(*) FROM l WHERE v = vertex_id) AS links FROM y""")
def _(s, d):
    return similar.record_links(vertex_sets(s, d), 0.7, 4).withColumnRenamed("id", "vertex_id")


TOGETHER = DP + """, small AS (SELECT net_id FROM dp GROUP BY net_id HAVING count(*) <= 64), i AS (SELECT dp.* FROM dp JOIN small USING (net_id)),
c AS (SELECT vertex_id, count(*) AS n FROM i GROUP BY vertex_id), t AS (SELECT count(*) AS baskets FROM small),
p AS (SELECT a.vertex_id AS vertex_a, b.vertex_id AS vertex_b, count(*) AS n_ab FROM i a JOIN i b USING (net_id) WHERE a.vertex_id < b.vertex_id GROUP BY 1, 2),
r AS (SELECT vertex_a, vertex_b, n_ab, x.n AS n_a, y.n AS n_b, baskets FROM p JOIN c x ON x.vertex_id = vertex_a JOIN c y ON y.vertex_id = vertex_b, t)
"""


@query("p3_found", TOGETHER + "SELECT vertex_a, vertex_b FROM r WHERE n_ab >= 6 AND n_ab * baskets >= 10 * n_a * n_b")
def _(s, d):
    return cooccurrence.vertex_pairs(table(s, d, "pins"), 64, 6, 10).select(F.col("item_a").alias("vertex_a"), F.col("item_b").alias("vertex_b"))


@query("p3_pairs", TOGETHER + """SELECT *, round(n_ab * baskets / (n_a::DOUBLE * n_b), 9) AS lift,
round(ln((n_ab + 0.5) * (baskets - n_a - n_b + n_ab + 0.5)::DOUBLE / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 9) AS log_odds FROM r""")
def _(s, d):
    return cooccurrence.vertex_pairs(table(s, d, "pins"), 64).withColumnsRenamed({"item_a": "vertex_a", "item_b": "vertex_b"})


SAME = """WITH p AS (SELECT rec_id, regexp_extract(lower(body), 'cost[^0-9a-z]*0*([0-9]+)', 1) AS cost,
  list_sort(list_distinct(regexp_extract_all(lower(body), 'v[^0-9a-z]*0*([0-9]+)', 1))) AS vs FROM net_records),
g AS (SELECT rec_id, cost, vs, CASE WHEN cost <> '' AND len(vs) > 0 THEN min(rec_id) OVER (PARTITION BY cost, vs) ELSE rec_id END AS keep_id FROM p)
"""


@query("p4_found", SAME + "SELECT keep_id, rec_id FROM g WHERE keep_id <> rec_id")
def _(s, d):
    return records.collapse(table(s, d, "net_records"))[0].where("keep_id <> rec_id").select("keep_id", "rec_id")


@query("p4_copies", SAME + "SELECT keep_id, min(cost) AS cost, min(len(vs))::INT AS n_vertices, count(*) AS copies FROM g GROUP BY keep_id")
def _(s, d):
    return records.collapse(table(s, d, "net_records"))[1].select("keep_id", "cost", "n_vertices", "copies")


@query("p6_ids")
def _(s, d):
    return tokens.encode_texts(table(s, d, "documents"))


@query("p7_mix")
def _(s, d):
    mixture, shares = mixing.mix_sources(table(s, d, "documents"), table(s, d, "mix_targets"))
    return mixture.join(F.broadcast(shares.select("source", "target_share", "reached_share")), "source")


@query("p7_shares")
def _(s, d):
    return mixing.mix_sources(table(s, d, "documents"), table(s, d, "mix_targets"))[1]


@query("p8_found")
def _(s, d):
    return personal.find_personal(table(s, d, "documents"))


@query("p8_redacted")
def _(s, d):
    return personal.redact_personal(table(s, d, "documents"))
