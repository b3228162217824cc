import random
import re

import numpy as np
import pytest
import xxhash

from gaugeframe.llm import simhash as S


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids, prints = [i for i, _ in rows], [slow_fingerprint(t) for _, t in rows]
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return sorted(zip(ids, (f"{p:016x}" for p in prints), label, strict=True))


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}É" if i % 7 == 0 else f"W{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(n):
        text = [r.choice(words) for _ in range(r.randint(0, 120))]
        for _ in range(r.choice([1, 1, 1, 2, 6])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2])):
                if copy:
                    copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((i, r.choice([" ", "\n", "\x0b "]).join(copy)))
            i += 1
    return rows


def test_golay_is_perfect():
    patterns, weights, begin = S.golay()
    assert len(patterns) == sum(len(list(S.combinations(range(23), w))) for w in range(6))
    assert ((np.add.reduceat((weights <= 3).astype(int), begin[:-1])) == 1).all()


@pytest.mark.parametrize("paired", [False, True])
def test_every_link_meets_at_an_anchor(paired):
    r = np.random.default_rng(3)
    a = r.integers(-(2**63), 2**63, 400, dtype=np.int64)
    b = a.copy()
    for k in range(400):
        for bit in r.choice(64, r.integers(0, 5), replace=False):
            b[k] ^= np.int64(np.uint64(1) << np.uint64(bit)) if bit < 63 else np.int64(-(2**63))
    ia, aa, ha = S.anchored(a, paired)
    ib, ab, hb = S.anchored(b, paired)
    at_home = {(i, x) for i, x in zip(ia[ha].tolist(), aa[ha].tolist(), strict=True)}
    replicas = {(i, x) for i, x in zip(ib[~hb].tolist(), ab[~hb].tolist(), strict=True)}
    assert {i for i, _ in at_home & replicas} == set(range(400))


@pytest.mark.parametrize("paired,tile", [(False, 2000), (True, 2000), (False, 3)])
def test_against_brute_force(spark, paired, tile):
    rows = corpus(60, 1) + [(10_000, ""), (10_001, None), (10_002, "one"), (10_003, "ONE"), (10_004, "a b c"), (10_004, "a b c")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, node int")
    got = sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in S.classes(docs, paired, tile).collect())
    assert got == brute_components(rows)
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_tight_cloud(spark):
    """Many distinct fingerprints around one: tiles, chains and hubs."""
    r = random.Random(5)
    prints = {0}
    while len(prints) < 300:
        prints.add(r.choice(sorted(prints)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    far = [r.getrandbits(64) for _ in range(50)]
    values = [*prints, *far]
    nodes = spark.createDataFrame([((x ^ 2**63) - 2**63, i) for i, x in enumerate(values)], "fp long, node long")
    from gaugeframe.llm.components import components

    found = {x.node: x.component for x in components(S.links(nodes, tile_rows=40)).collect()}
    assert all(found[i] == 0 for i in range(300)) and not any(i in found for i in range(300, 350))


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "q"), (2, "a b c d e f", "q"), (2, "a b c d e f", "q"), (3, "other words here at last", "q"), (3, "other words here at last", "q"), (None, "a b c d e f", "q"), (None, "nothing like it", "q"), (None, "nothing like it", "q"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_number string")
    got = sorted((r.doc_id or -1, r.text) for r in S.keep_one(docs).collect() if r.text) + [r.doc_id for r in S.keep_one(docs).collect() if not r.text]
    assert got == [(-1, "nothing like it"), (1, "a b c d e f"), (3, "other words here at last"), 4]
