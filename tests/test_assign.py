import random

import pytest

from tallyloom.operators.assign import assign_reads, run_summary
from tallyloom.operators.counts import counts_by_level


def procedural(triplets, posted, gene_of):
    """The assignment of one read, step by step."""
    if not triplets:
        return "short", None, None
    sets = [posted.get(t, set()) for t in triplets]
    together, heuristic = None, False
    for s in sets:
        together = set(s) if together is None else together & s
        if not together:
            break
        if len({gene_of[t] for t in together}) == 1:
            if len(together) == 1:
                (tx,) = together
                return "h_tx", tx, gene_of[tx]
            heuristic = True
            break
    union = set().union(*sets)
    if not union:
        return "ambiguous", None, None
    score = {t: sum(t in a and t in b for a, b in zip(sets, sets[1:], strict=False)) for t in union}
    best = {t for t in union if score[t] == max(score.values())}
    if len(best) == 1:
        (tx,) = best
        return ("h_tx" if heuristic else "s_tx"), tx, gene_of[tx]
    genes = {gene_of[t] for t in best}
    if len(genes) == 1:
        return ("h_gene" if heuristic else "s_gene"), None, genes.pop()
    return "ambiguous", None, None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_set_form_is_the_procedure(spark, seed):
    rng = random.Random(seed)
    gene_of = {t: f"g{t % 3}" for t in range(9)}
    vocabulary = [(a, b, 0) for a in range(3) for b in range(3)]
    posted = {v: set(rng.sample(range(9), rng.choice([0, 1, 1, 2, 3, 5]))) for v in vocabulary}
    reads = {i: [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5]))] for i in range(400)}
    index = spark.createDataFrame([(*v, t, gene_of[t]) for v, ts in posted.items() for t in ts], "a bigint, b bigint, c bigint, tx_id bigint, gene_id string")
    triplets = spark.createDataFrame([(i, p + 1, *v) for i, vs in reads.items() for p, v in enumerate(vs)], "read_id bigint, pos int, a bigint, b bigint, c bigint")
    found = assign_reads(spark.createDataFrame([(i,) for i in reads], "read_id bigint"), triplets, index)
    got = {r.read_id: (r.status, r.tx_id, r.gene_id) for r in found.collect()}
    assert got == {i: procedural(vs, posted, gene_of) for i, vs in reads.items()}
    if seed == 1:
        assert {s for s, _, _ in got.values()} == {"short", "h_tx", "h_gene", "s_tx", "s_gene", "ambiguous"}
        summary = run_summary(found).first()
        assert summary.short + summary.assigned_tx + summary.assigned_gene + summary.ambiguous == summary.reads == 400
        totals = {r["level"]: r["sum(n)"] for r in counts_by_level(found).groupBy("level").sum("n").collect()}
        assert totals == {"transcript": summary.assigned_tx, "gene": summary.assigned_tx + summary.assigned_gene}
