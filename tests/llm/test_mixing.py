import re
from fractions import Fraction
from hashlib import md5

from scriptorium.llm.mixing import mix


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, caps = Fraction(3, 2) * sum(sizes.values()), {s: 2 * sizes[s] for s in names}
    full, free = {}, set(names)
    while True:
        left, w = budget - sum(full.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > caps[s] * w or caps[s] == 0]
        if not over:
            return {s: full.get(s, left * weight[s] / w if w else Fraction(0)) for s in names}
        for s in over:
            full[s] = Fraction(caps[s])
            free.discard(s)


def brute(rows, quantum):
    """Serves one packet after the other, always that of the smallest finish time, until the budget is spent."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, s in rows:
        sums[s] = sums.get(s, 0) + size(t)
    goal, queues, taken = targets(sums), {}, [0] * len(rows)
    for source in sums:
        own = sorted((i for i, r in enumerate(rows) if r[2] == source), key=lambda i: (md5(f"7:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), size(rows[i][1]), str(rows[i][0])))
        at, queues[source] = 0, []
        for i in [*own, *own]:
            left = size(rows[i][1])
            while left:
                n = min(left, quantum)
                left, at = left - n, at + n
                queues[source].append((i, n, at))
    budget = int(Fraction(3, 2) * sum(sums.values()))
    while budget and any(queues.values()):
        source = min((s for s in queues if queues[s]), key=lambda s: (float(queues[s][0][2]) / float(goal[s]), s is None, s or ""))
        i, n, _ = queues[source].pop(0)
        taken[i] += min(n, budget)
        budget -= min(n, budget)
    return sorted(((d, size(t), sums[s], float(goal[s]), taken[i]) for i, (d, t, s) in enumerate(rows)), key=str)


def run(spark, rows, quantum=50):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, size string, _key string")
    return mix(df, quantum=quantum)


def check(spark, rows, quantum=50):
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in run(spark, rows, quantum).collect()), key=str)
    want = brute(rows, quantum)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 * max(1, w[3]) for g, w in zip(got, want))
    return got


def test_against_brute_force(spark):
    rows = [(i, "w " * (i * 7 % 40), ("b", "a", "a", "a", None, "Z")[i % 6]) for i in range(300)] + [(900, None, "a"), (None, "one two", "q"), (901, "long " * 50_000, "b"), (5, "dup dup", "a"), (5, "dup dup", "a"), (902, "", "only empty")]
    got = check(spark, rows)
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    assert sum(g[4] for g in got) == int(1.5 * sum(g[1] for g in got))
    check(spark, rows, 7)


def test_order_is_by_finish_time(spark):
    out = run(spark, [(i, "w " * 5, "ab"[i % 2]) for i in range(50)]).collect()
    assert [r.finish for r in out] == sorted(r.finish for r in out)


def test_degenerate(spark):
    assert run(spark, []).collect() == []
    assert [r.taken for r in run(spark, [(1, None, None), (2, "", "a")]).collect()] == [0, 0]
    check(spark, [(1, "a b c", "s")])


def test_every_source_is_near_its_target(spark):
    rows = [(i, "w " * (1 + i * 37 % 900), "abc"[i % 7 % 3]) for i in range(200)]
    sums = {}
    for r in run(spark, rows).collect():
        sums[r.source, r.target] = sums.get((r.source, r.target), 0) + r.taken
    assert all(abs(taken - target) <= 3 * 50 for (_, target), taken in sums.items())
