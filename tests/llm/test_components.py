from tests.helpers import rows

from tallyloom.llm.components import connected_components


def brute(edges, nodes=()):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in nodes:
        root(x)
    for a, b in edges:
        for x in (a, b):
            if x is not None:
                root(x)
        if a is not None and b is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, root(x)) for x in list(parent))


def table(spark, edges):
    return spark.createDataFrame([(*e, "x", 1, 2) for e in edges], "a bigint, b bigint, node string, high int, low int")


def test_random_graphs(spark, rng):
    for n, m in ((40, 20), (60, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges += edges[:5] + [(b, a) for a, b in edges[:5]] + [(3, 3), (None, 4), (5, None), (None, None), (99, None)]
        assert rows(connected_components(table(spark, edges), "a", "b")) == brute(edges)


def test_long_chain_star_and_isolated(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1060)]
    nodes = spark.createDataFrame([(5,), (100,), (None,)], "n bigint")
    assert rows(connected_components(table(spark, chain + star), "a", "b", nodes=nodes)) == brute(chain + star, [5, 100])


def test_hubs_are_split_off(spark, monkeypatch):
    monkeypatch.setattr("tallyloom.operators.graph.LEAST_HUB", 3)
    edges = [(1, i) for i in range(2, 30)] + [(29, i) for i in range(40, 60)] + [(70, 71)]
    assert rows(connected_components(table(spark, edges), "a", "b")) == brute(edges)


def test_a_very_long_chain_and_a_star_of_half_the_edges(spark):
    """A shuffled chain of 100,000 links, and as many at one node."""
    n = 100_000
    chain = spark.range(n).selectExpr("id * 7919 % 1000003 as a", "(id + 1) * 7919 % 1000003 as b")
    star = spark.range(n).selectExpr("2000000L as a", "2000001 + id as b")
    found = connected_components(chain.union(star), "a", "b")
    sizes = found.groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in sizes) == [(0, n + 1), (2_000_000, n + 1)]


def test_strings_and_empty(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("", "d")], "a string, b string")
    assert rows(connected_components(edges, "a", "b")) == [("", ""), ("a", "a"), ("b", "a"), ("c", "a"), ("d", "")]
    assert connected_components(table(spark, []), "a", "b").count() == 0
