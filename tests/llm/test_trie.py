"""The trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from tidemill.llm import queries, trie

TURNS = "conv_id long, turn long, role string, text string, depth int, fp string, node string, part int, n long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in given.items()}
    made = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(given.get(c - c % 5, [])[:h] + own[h:])
    members, children = {}, {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
            if d:
                children.setdefault(t[: d - 1], set()).add(t[:d])
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children.get(k, ())) if k in children else 1
        saved[k] = sum(saved[x] for x in children.get(k, ())) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children.get(k, ())), leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def got(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in rng.sample(range(1000), 300):
        kind = rng.choice(["a", "b", "ü𝔘"])
        for t in range(rng.choice([1, 2, 3, 5, 9, 30])):
            out.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if t % 5 == 4 else "user", kind * (t + 1) if rng.random() < 0.8 else rng.choice(["", None, "x " * 3000, "y"])))
    out += [(5000, t, "user", "a" * (t + 1)) for t in range(2000)] + [(5001, t, "user", "a" * (t + 1)) for t in range(2000)]  # long ones
    out += [(None, 0, "user", "lost")] * 5 + out[:20]  # rows without an id, and repeated ones
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "f", "n", 3, 1) for r in rows], TURNS).repartition(7)


@pytest.mark.parametrize("primes", [trie.PRIMES, (7, 11)])
def test_trie_against_dictionaries(spark, rows, primes):
    some = rows if primes == trie.PRIMES else [r for r in rows if (r[0] or 0) < 5000]  # small primes: many collisions
    assert got(trie.conversation_trie(trie.rebuilt(frame(spark, some)), primes)) == brute(some)


def test_trie_of_few(spark):
    assert trie.conversation_trie(trie.rebuilt(frame(spark, [(None, 1, "a", "b")]))).count() == 0
    one = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    for r in ([(one, 1, "user", "only")], [(one, 1, "user", "only"), (3000, None, None, None)], [(0, 1, "u", "t"), (0, 1, "u", "t")]):
        assert got(trie.conversation_trie(trie.rebuilt(frame(spark, r)))) == brute(r)


def test_trie_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    df = queries.op13_conversation_trie(spark, sf)
    assert df.columns == COLUMNS and all(kind == "bigint" for c, kind in df.dtypes if c != "ends_sha256")
    assert got(df) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
