import hashlib
import random
import zlib

from scriptorium.llm.prefix_trie import NODE, list_hashes, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[:h] + turns[c][h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for prefix, who in members.items():
        under = [q for q in members if q[: len(prefix)] == prefix]
        kids = lambda q: [k for k in members if len(k) == len(q) + 1 and k[: len(q)] == q]
        ends = sorted(c for c in who if len(built[c]) == len(prefix))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        out.append((min(who), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(who), len(kids(prefix)), sum(not kids(q) for q in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == NODE
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_every_prefix(spark):
    rng = random.Random(5)
    shared = [[("user", f"s{k}-{i}") for i in range(9)] for k in range(3)]
    rows = []
    for c in [*range(0, 24), 100, 101, 207, 300, 301, 302, -3, -103]:
        kind = rng.choice(shared)
        n, apart = rng.randint(1, 9), rng.randint(0, 9)
        for i in range(n):
            role, text = kind[i] if i < apart else (rng.choice(["user", None]), rng.choice(["é", "", None, f"x{rng.randint(0, 2)}"]))
            rows.append((c, rng.choice([i, i, None]) if i == 0 else i, role, text))
    rows += rows[:4] + [(None, 0, "user", "lost"), (5, 3, "user", "tie"), (5, 3, "user", "other")]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_long_copies_take_one_round(spark):
    rows = [(c, i, "user", f"turn {i}") for c in (0, 100, 200) for i in range(60)] + [(200, 60, "user", "more"), (300, 0, "user", "turn 0")]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_turnless_and_alone(spark):
    # conversation 103 has no turn of its own after its first h, and no conversation 100 stands in
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "only")]
    assert got(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table_and_clashing_columns(spark):
    assert got(prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(0, 0, "user", "a"), (0, 1, "user", "b"), (100, 0, "user", "a")]
    extra = spark.createDataFrame([(*r, 9, "x", 1, 2, 3) for r in rows], SCHEMA + ", pos long, node string, a long, depth long, n long")
    assert got(prefix_trie(extra)) == brute(rows)


def test_lists_of_many_pieces(spark):
    ends = spark.range(5000).selectExpr("id * 7 as conv_id", "id % 2 as node", "3L as depth")
    want = {k: hashlib.sha256(",".join(str(i * 7) for i in range(k, 5000, 2)).encode()).hexdigest() for k in (0, 1)}
    assert {r["node"]: r["ends_sha256"] for r in list_hashes(ends).collect()} == want
