from pyspark.sql import functions as F

from tallyloom.operators import counts, evaluate, graph
from tallyloom.operators.nearest import nearest, principal_components
from tallyloom.operators.simulate import sampled, simulated_counts
from tallyloom.streaming.running import Progress, molecules, read_stream, run_batches, running_counts
from tests.helpers import rows


def test_link_groups(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("x", "x"), (None, "z"), ("b", "a")], "g string, p string")
    assert rows(graph.link_groups(links, "g", "p")) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "g int, p int")
    assert {r.label for r in graph.link_groups(chain, "g", "p").collect()} == {0}


def test_regrouped_keeps_lone_keys(spark):
    groups = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, label string")
    values = spark.createDataFrame([("a", 1), ("b", 2), ("q", 5)], "id string, n int")
    assert rows(graph.regrouped(values, groups, key="id", value="n")) == [("a", 3), ("q", 5)]


def test_reachable(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9)], "a int, b int")
    seeds = spark.createDataFrame([(1,), (None,)], "n int")
    assert rows(graph.reachable(seeds, links, node="n", a="a", b="b")) == [(1, 0), (2, 1), (3, 2)]


def test_read_states(spark):
    a = spark.createDataFrame([("l", "r1"), ("l", "r2"), ("l", "r3"), ("l", "r4")], "locus string, read string")
    b = spark.createDataFrame([("l", "r4", True), ("m", "r1", True), ("m", "r1", False), ("m", "r2", False)], "locus string, read string, good boolean")
    lost = graph.mapping_differences(a, b, locus="locus", read="read").where("side = 'a'")
    assert rows(graph.read_states(lost, b, read="read", good="good")) == [("r1", "mapped_elsewhere"), ("r2", "filtered"), ("r3", "not_present")]


def test_alignment_filter(spark):
    data = [("ok", 255, 0, [(0, 75)]), ("low", 3, 0, None), ("unmapped", 255, 4, None), ("second", 255, 256, None), ("intron", 255, 0, [(3, 20_000)]), ("none", 255, 16, None)]
    alignments = spark.createDataFrame(data, "name string, mapq int, flag int, cigar array<struct<op:int,len:int>>")
    assert rows(graph.usable_alignments(alignments), "name") == [("none",), ("ok",)]


def test_dense_ids_over_partitions(spark):
    values = spark.range(1000).select(F.format_string("v%04d", "id").alias("v")).repartition(5)
    got = counts.dense_ids(values.union(values), "v", first=1).orderBy("id").collect()
    assert [(r.v, r.id) for r in got] == [(f"v{i:04d}", i + 1) for i in range(1000)]


def test_molecules_by_scope(spark):
    reads = spark.createDataFrame([("b", "f", "u", 0), ("b", "f", "u", 1), ("b", "f", None, 1), ("b", "g", "u", 0)], "bar string, f string, u string, batch int")
    assert rows(counts.molecule_counts(reads, barcode="bar", feature=["f"], umi="u")) == [("b", "f", 1), ("b", "g", 1)]
    assert rows(counts.molecule_counts(reads, barcode="bar", feature=["f"], umi="u", batch="batch")) == [("b", "f", 2), ("b", "g", 1)]


def test_cells(spark):
    table = spark.createDataFrame([("c1", "g1", 1), ("c1", "g2", 3), ("c2", "g1", 5), ("c3", "g1", 2), ("c3", "g2", 2)], "cell string, gene string, n bigint")
    assert rows(counts.filtered_cells(table, cell="cell", gene="gene", least_genes=2, least_cells=2), "cell", "gene") == [("c1", "g1"), ("c1", "g2"), ("c3", "g1"), ("c3", "g2")]
    values = counts.normalised(table, cell="cell")
    genes = counts.variable_genes(values, gene="gene", n_cells=3, top=1)
    assert rows(genes, "gene") == [("g2",)]
    assert counts.scaled(values, genes, gene="gene", most=0.1).agg(F.max("z")).first()[0] <= 0.1


def test_precision_recall(spark):
    data = [("a", "a"), ("a", "b"), ("a", None), (None, "a"), ("b", "b")]
    table = spark.createDataFrame(data, "t string, e string")
    r = evaluate.precision_recall(table, "t", "e").first()
    assert (r.correct, r.wrong, r.unassigned, r.precision, r.recall) == (2, 1, 1, 0.666667, 0.5)
    empty = evaluate.precision_recall(table.where("false"), "t", "e").first()
    assert empty.correct == 0 and empty.precision is None


def test_nearest_against_brute_force(spark, rng):
    data = [(i, [float(rng.randrange(4)), float(rng.randrange(4))]) for i in range(80)] + [(100, None), (None, [0.0, 0.0]), (101, [1.0])]
    vectors = spark.createDataFrame(data, "id bigint, v array<float>").repartition(3)
    got = nearest(vectors, vectors.where("id % 20 = 0 and id < 80"), key="id", vector="v", k=5)
    known = [(i, v) for i, v in data if i is not None and v is not None and len(v) == 2]
    want = []
    for q, a in known:
        if q % 20 == 0:
            order = sorted((((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5, i) for i, b in known if i != q)[:5]
            want += [(q, i, d) for d, i in order]
    assert rows(got) == sorted(want)


def test_nearest_keeps_names_and_key_types(spark):
    """Queries of another length than the first are left out with their names; keys may be of any type."""
    data = [(1, [0.0, 0.0]), (2, [1.0]), (3, [5.0, 5.0]), (4, [5.0, 6.0])]
    for kind in ("int", "string"):
        vectors = spark.createDataFrame(data, "id int, v array<double>").selectExpr(f"cast(id as {kind}) as id", "v")
        got = nearest(vectors, vectors.where("id <= '3'"), key="id", vector="v", k=1)
        assert dict(got.dtypes)["query"] == kind and [(int(q), int(n)) for q, n, _ in rows(got)] == [(1, 3), (3, 4)]


def test_stream_is_the_batch_result(spark, tmp_path):
    table = spark.range(300).selectExpr("id % 3 as k", "cast(id % 7 as string) as u", "timestamp_seconds(id) as at")
    table.repartition(6).write.parquet(str(tmp_path / "in"))
    schema = "k bigint, u string, at timestamp"
    progress = Progress()
    spark.streams.addListener(progress)
    seen = []
    run_batches(running_counts(read_stream(spark, str(tmp_path / "in"), schema, files_a_batch=2), ["k"]), lambda df, n: seen.append({r.k: r.n for r in df.collect()}), "counts-test")
    last = {}
    for batch in seen:
        last.update(batch)
    assert len(seen) >= 3 and last == {0: 100, 1: 100, 2: 100}
    kept = []
    run_batches(molecules(read_stream(spark, str(tmp_path / "in"), schema), ["k"], "u", time="at", lateness="1 hour"), lambda df, n: kept.extend(df.select("k", "u").collect()), "molecules-test", mode="append")
    assert len(kept) == len(set(map(tuple, kept))) == 21
    spark.streams.removeListener(progress)


def test_linked_and_sharing_pairs(spark):
    pairs = spark.createDataFrame([("g1", "g2"), ("g1", "g3"), (None, "g1")], "l string, r string")
    links = graph.symmetric_edges(spark.createDataFrame([("g2", "g1")], "g string, p string"), "g", "p")
    assert rows(graph.linked_pairs(pairs, links, left="l", right="r")) == [("g1", "g2", True), ("g1", "g3", False), (None, "g1", False)]
    members = spark.createDataFrame([("g1", "Alu"), ("g3", "Alu"), ("g2", "L1"), ("g2", None)], "locus string, m string")
    got = graph.pairs_sharing(pairs, members, left="l", right="r", locus="locus", member="m")
    assert rows(got) == [("g1", "g2", False), ("g1", "g3", True), (None, "g1", False)]


def test_simulated_counts_do_not_depend_on_partitions(spark):
    keys = spark.range(500).selectExpr("concat('t', id) as t").union(spark.range(1).selectExpr("cast(null as string)"))
    one, many = (rows(simulated_counts(keys.repartition(n), "t", low=10, high=1000)) for n in (1, 7))
    assert one == many and len(one) == 500
    values = [n for _, n in one]
    assert min(values) >= 10 and max(values) <= 1000 and 60 < sum(values) / 500 - 10 < 130
    assert rows(sampled(keys, "t", 20)) == rows(sampled(keys.repartition(9), "t", 20)) and sampled(keys, "t", 20).count() == 20


def test_components_of_a_line(spark):
    vectors = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)] + [(9, None)], "id int, v array<double>")
    got = {r.id: r.components[0] for r in principal_components(vectors, key="id", vector="v", k=1).collect()}
    assert all(abs(got[i] - (i - 2) * 5**0.5) < 1e-9 for i in range(5))


def test_cell_vectors_have_absent_genes(spark):
    table = spark.createDataFrame([("c1", "g1", 1), ("c1", "g2", 3), ("c2", "g1", 5), ("c3", "g1", 2), ("c3", "g2", 2), ("c4", "g3", 1)], "cell string, gene string, n bigint")
    values = counts.normalised(table, cell="cell")
    genes = counts.variable_genes(values, gene="gene", n_cells=4, top=2)
    names = sorted(r.gene for r in genes.collect())
    found = {r.cell: r.vector for r in counts.cell_vectors(values, genes, cell="cell", gene="gene").collect()}
    assert len(found) == 4 and {len(v) for v in found.values()} == {2}
    known = {(r.cell, r.gene): r.value for r in values.collect()}
    scale = {r.gene: (r["mean"], r.sd) for r in genes.collect()}
    for cell, vector in found.items():
        assert all(abs(z - (known.get((cell, g), 0.0) - scale[g][0]) / scale[g][1]) < 1e-9 for g, z in zip(names, vector, strict=True))
    nothing = counts.cell_vectors(values, genes.limit(0), cell="cell", gene="gene")
    assert rows(nothing, "cell", "vector")[0] == ("c1", [])


def test_quantiles_are_exact(spark, rng):
    given = [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)])) for _ in range(500)] + [("lone", 4), ("none", None)]
    df = spark.createDataFrame(given, "g string, v int")
    want = df.where("v is not null").groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("median"), F.percentile("v", F.lit(0.85)).alias("q85"))
    found = evaluate.quantiles_of(df, ["g"], "v", {"median": 0.5, "q85": 0.85}).select("key.g", "median", "q85")
    plain = lambda frame: [(r[0], round(r[1], 9), round(r[2], 9)) for r in rows(frame)]
    assert plain(found) == plain(want) and len(plain(want)) == 4
    assert rows(evaluate.above_quantile(df.limit(0), "v")) == []
    assert {r.above for r in evaluate.above_quantile(df.where("g = 'none'"), "v").collect()} == {None}
