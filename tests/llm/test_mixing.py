"""Mixing: the flow against an exhaustive search, and documents as the mix takes them."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import mixing as M


def brute_cost(words, member, quotas, passes):
    """(most words that reach quotas, the least cost of as many) over all whole flows."""
    arcs = [(p, s) for p, sources in enumerate(member) for s in sources]
    best = (0, 0)
    for flow in itertools.product(*(range(min(passes * words[p], quotas[s]) + 1) for p, s in arcs)):
        of_p, of_s = Counter(), Counter()
        for (p, s), n in zip(arcs, flow, strict=True):
            of_p[p] += n
            of_s[s] += n
        if all(of_p[p] <= passes * words[p] for p in of_p) and all(of_s[s] <= quotas[s] for s in of_s):
            best = min(best, (-sum(flow), cost(words, of_p)))
    return best


def cost(words, of_p):
    return sum(sum(2 * (i // max(1, words[p])) + 1 for i in range(n)) for p, n in of_p.items())


@pytest.mark.parametrize("words,member,quotas", [
    ([2, 3], [(0,), (1,)], [3, 2]), ([2, 2], [(0, 1), (1,)], [3, 2]), ([1, 2, 2], [(0,), (0, 1), (1,)], [2, 4]), ([3, 1], [(0, 1), (0, 1)], [2, 3]), ([0, 2], [(0,), (0, 1)], [1, 4]), ([1, 1, 1], [(0, 1), (1, 2), (0, 2)], [2, 2, 1]),
])
def test_flow_is_the_cheapest(words, member, quotas):
    sent = M.min_cost_flow(words, member, quotas, 2)
    of_p = {p: sum(f.values()) for p, f in enumerate(sent)}
    assert all(sum(f.get(s, 0) for f in sent) <= q for s, q in enumerate(quotas))
    assert (-sum(of_p.values()), cost(words, of_p)) == brute_cost(words, member, quotas, 2)


CLASH = {"__n": 1, "__words": 2, "__all": 3, "__i": 4, "__own": 5, "__part": 6, "mix_words": 7, "mix_p": 8, "taken": 9, "pattern": "x", "bucket": 1, "p": 2, "size": 3}


def test_documents_meet_their_quotas_with_any_columns(spark):
    rows = [(i % 40, " ".join(["w"] * (i % 7)), ("a", "b", None)[i % 3], i % 7) for i in range(120)] + [(None, None, "a", 0), (1, " \n", "b", 2)] + [(7, "same row here", "a", 13)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in CLASH.items()}).withColumn("a map", F.create_map(F.lit("k"), F.col("n_chars"))).repartition(3)
    got = M.mix_documents(docs)
    assert got.columns == docs.columns
    got = got.collect()
    words = lambda some: Counter({s: sum(len(r.text.split()) for r in some if r.source == s) for s in ("a", "b", None)})
    names, sizes = ("a", "b", None), words([r for r in docs.collect() if r.text])
    quota = M.targets([sizes[s] for s in names], [5, 2, 1], 1.5, 2)
    assert words(got) == Counter({s: round(q) for s, q in zip(names, quota, strict=True)})
    assert all(r.text.split() and (r["a map"], r.mix_words, r.__getitem__("__n")) is not None for r in got)
    taken = {(r.source, r.doc_id): 0 for r in got}
    for r in got:
        taken[r.source, r.doc_id] += len(r.text.split())
    whole = Counter()
    for r in docs.collect():
        whole[r.source, r.doc_id] += len((r.text or "").split())
    assert all(n <= 2 * whole[k] for k, n in taken.items())
    assert sorted((r.doc_id, r.text) for r in M.mix_documents(docs.repartition(5)).collect()) == sorted((r.doc_id, r.text) for r in got)


def test_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 5), [["a"], ["a", "b"], ["b", "a", "a"], ["c"], []][i % 5], 1) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, from array<string>, n_chars long")
    got = M.mix_documents(docs, sources="from").collect()
    n = Counter()
    for _, t, f, _ in rows:
        n[tuple(sorted(set(f)))] += len(t.split())
    patterns = sorted(n)
    names = ["a", "b", "c"]
    quota = [round(x) for x in M.targets([sum(w for p, w in n.items() if s in p) for s in names], [5, 2, 1], 1.5, 2)]
    sent = M.min_cost_flow([n[p] for p in patterns], [tuple(names.index(s) for s in p) for p in patterns], quota, 2)
    took = Counter()
    for r in got:
        took[tuple(sorted(set(r["from"])))] += len(r.text.split())
    assert took == Counter({p: sum(f.values()) for p, f in zip(patterns, sent, strict=True) if f})


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_PATTERNS", 3)
    docs = spark.createDataFrame([(i, "w", str(i), 1) for i in range(4)], "doc_id long, text string, source string, n_chars long")
    with pytest.raises(ValueError, match="patterns"):
        M.mix(docs)
