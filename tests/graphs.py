"""Small hypergraphs for the tests."""

import random

from pinloom.model import Hypergraph

THREE = [(0, 0), (1, 0), (1, 1), (0, 2)]
FOUR = [(0, 0), (1, 0), (1, 1), (0, 2), (2, 3)]
DUPS = [(0, 0), (0, 2), (1, 2), (1, 0), (2, 3), (3, 1), (4, 1)]


def make(spark, pins, n, weights=None, costs=None):
    nets = sorted({a for a, _ in pins})
    return Hypergraph(
        spark.createDataFrame([(v, weights[v] if weights else 1, None) for v in range(n)], "vertex_id bigint, weight bigint, part bigint"),
        spark.createDataFrame([(a, costs[a] if costs else 1) for a in nets], "net_id bigint, cost bigint"),
        spark.createDataFrame(pins, "net_id bigint, vertex_id bigint"),
    )


def sides(spark, parts):
    return spark.createDataFrame(list(enumerate(parts)), "vertex_id bigint, part bigint")


def clustered(n=60, clusters=2, nets=120, seed=3):
    """Nets mostly within clusters of consecutive vertices, so a small cut exists."""
    rng, pins = random.Random(seed), set()
    size = n // clusters
    for net in range(nets):
        c = rng.randrange(clusters)
        members = rng.sample(range(c * size, (c + 1) * size), rng.randint(2, 4))
        if net % 30 == 0:
            members.append(rng.randrange(n))
        pins |= {(net, v) for v in members}
    return sorted(pins)


def cut_of(pins, part):
    nets = {}
    for a, v in pins:
        nets.setdefault(a, set()).add(part[v])
    return sum(len(s) > 1 for s in nets.values())
