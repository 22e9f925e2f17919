"""The walk over differing loci against the same rule in plain Python."""

import pytest

from tallyloom.operators.walk import discrepancies
from tests.helpers import rows

SIDE = "read string, contig string, start int, end int, good boolean"


def overlap(x, y, padding=0):
    return x[0] == y[0] and x[1] < y[2] + padding and y[1] - padding < x[2]


def merged(places, padding):
    out = []
    for c, s, e in sorted(places):
        if out and out[-1][0] == c and s <= out[-1][2] + padding:
            out[-1] = (c, out[-1][1], max(out[-1][2], e))
        else:
            out.append((c, s, e))
    return out


def members(place, features):
    return {f[0] for f in features if overlap(place, f[1:])}


def walked(a, b, seeds, padding, genes, links, repeats):
    good = {s: [r[:4] for r in t if r[4] and None not in r[:4] and r[3] > r[2]] for s, t in (("a", a), ("b", b))}
    frontier, known, loci, lost, step = sorted(set(seeds)), set(), [], set(), 0
    while frontier:
        known |= set(frontier)
        targets = set()
        for at in frontier:
            here = {s: {r[0] for r in t if overlap(at, r[1:])} for s, t in good.items()}
            only = {"a": here["a"] - here["b"], "b": here["b"] - here["a"]}
            loci.append((*at, step, len(here["a"]), len(here["b"]), len(only["a"]), len(only["b"])))
            for s, o in ("ab", "ba"):
                lost |= {(r, s) for r in only[s]}
                targets |= {(at, r[1:]) for r in good[o] if r[0] in only[s]}
        free = set()
        for source, place in targets:
            paralogous = any((x, y) in links for x in members(source, genes) for y in members(place, genes))
            if not any(overlap(place, k, padding) for k in known) and not paralogous and not members(source, repeats) & members(place, repeats):
                free.add(place)
        frontier, step = merged(free, padding), step + 1
    states = []
    for read, side in lost:
        of = [bool(r[4]) for r in (b if side == "a" else a) if r[0] == read]
        states.append((read, side, "mapped_elsewhere" if any(of) else "filtered" if of else "not_present"))
    return sorted(loci), sorted(states)


@pytest.mark.parametrize(("padding", "barred"), [(0, False), (15, True)])
def test_walk_is_the_plain_rule(spark, rng, padding, barred):
    def side(n):
        given = [(f"r{rng.randrange(40)}", rng.choice("cd"), s := rng.randrange(1500), s + rng.randrange(1, 25), rng.random() < 0.85) for _ in range(n)]
        return [*given, given[0], (None, "c", 3, 9, True), ("r1", None, 3, 9, True), ("r2", "c", None, 9, True), ("r3", "c", 9, 9, True), ("r4", "c", 5, 9, None)]

    a, b, seeds = side(70), side(60), [("c", 100, 220), ("d", 700, 760), ("c", 100, 220)]
    genes = [(f"g{i}", c, 60 * i, 60 * i + 50) for i in range(25) for c in "cd"] if barred else []
    links = {(x, y) for x in ("g1", "g2", "g3") for y in ("g8", "g9", "g14")} if barred else set()
    links |= {(y, x) for x, y in links}
    repeats = [("L1", "c", 150, 200), ("L1", "d", 300, 500), ("L2", "c", 900, 950)] if barred else []
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    loci, reads = discrepancies(
        frame(a, SIDE), frame(b, SIDE), frame(seeds, "contig string, start int, end int"), padding=padding,
        genes=frame(genes, "gene string, contig string, start int, end int") if barred else None, links=frame(list(links), "a string, b string") if barred else None,
        repeats=frame(repeats, "repeat_class string, contig string, start int, end int") if barred else None,
    )
    want_loci, want_reads = walked(a, b, seeds, padding, genes, links, repeats)
    assert rows(loci) == want_loci and rows(reads) == want_reads
    assert max(r[3] for r in want_loci) >= 2


def test_walk_from_nowhere(spark):
    a = spark.createDataFrame([("r", "c", 1, 5, True)], SIDE)
    loci, reads = discrepancies(a, a.limit(0), spark.createDataFrame([("c", None, 4), (None, 1, 2)], "contig string, start int, end int"))
    assert rows(loci) == [] == rows(reads)
    loci, reads = discrepancies(a, a.limit(0), spark.createDataFrame([("c", 0, 4)], "contig string, start int, end int"))
    assert rows(loci) == [("c", 0, 4, 0, 1, 0, 1, 0)] and rows(reads) == [("r", "a", "not_present")]
