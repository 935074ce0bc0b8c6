import random

from telespark.operators.prefix import sum_before
from telespark.plans.traces import trace_preorder

SCHEMA = "trace_id long, span_id long, parent_span_id long, service string, start_us long, duration_us long, status int"


def _preorder(rows):
    """{(trace, span): (position, depth)} by a walk on a stack."""
    out = {}
    for t in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == t), key=lambda r: (r[4], r[1]))
        ids, kids = {r[1] for r in mine}, {}
        for r in mine:
            kids.setdefault(r[2] if r[2] in ids else None, []).append(r[1])
        stack = [(s, 0) for s in reversed(kids.get(None, [mine[0][1]]))]
        seen = set()
        while stack:
            s, d = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            out[t, s] = (len(seen) - 1, d)
            stack += [(c, d + 1) for c in reversed(kids.get(s, [])) if c not in seen]
    return out


def test_preorder_against_a_walk(spark):
    rng = random.Random(2)
    rows = []
    for t in range(40):
        n = rng.choice([1, 2, 7, 30, 90])
        ids = rng.sample(range(1000), n)
        for i, s in enumerate(ids):
            # roots, missing parents, equal starts; parents are earlier in the list, so no cycles
            up = rng.choice([None, 5000]) if i == 0 or rng.random() < 0.1 else ids[rng.randrange(max(0, i - 3), i)]
            rows.append((t, s, up, "gateway", rng.randint(0, 20), 5, 200))
    # two spans in a cycle with a child under a real root; a trace that is a cycle only
    rows += [(99, 1, None, "gateway", 0, 9, 200), (99, 5, 6, "orders", 1, 1, 200), (99, 6, 5, "orders", 2, 1, 200),
             (99, 7, 6, "orders", 3, 1, 200), (99, 8, 1, "orders", 4, 1, 200)]
    rows += [(98, 2, 3, "gateway", 1, 1, 200), (98, 3, 2, "gateway", 0, 1, 200), (98, 4, 2, "gateway", 0, 1, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for split in (500_000, 3):
        got = {(r.trace_id, r.span_id): (r.position, r.depth) for r in trace_preorder(df, split_siblings=split).collect()}
        assert got == _preorder(rows), split
    assert trace_preorder(df.where("false")).count() == 0


def test_sum_before_of_a_hot_group(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("cold", i, 1) for i in range(5)] + [(None, i, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    want, sums = {}, {}
    for g, o, v in rows:
        want[g, o] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    for split in (1000, 50):
        got = {(r.g, r.o): r.s for r in sum_before(df, ["g"], ["o"], "v", "s", split).collect()}
        assert got == want, split
