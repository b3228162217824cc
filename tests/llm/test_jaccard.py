import random

import numpy as np
import pytest

from gaugeframe.llm import jaccard as J
from gaugeframe.llm import simhash as S


def brute_keepers(rows):
    """Least ids of the classes at five-word Jaccard >= 0.8."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if z in (x, y) else z for z in label]
    return sorted({rows[z][0] for z in label})


def corpus(seed):
    """Copies with a few words changed, a passage that many texts share, and a large group of near copies."""
    r = random.Random(seed)
    word = lambda: f"W{r.randrange(5000)}"
    passage, crowd = [word() for _ in range(60)], [word() for _ in range(150)]
    texts = []
    for _ in range(80):
        text = [word() for _ in range(r.randint(1, 200))]
        texts += [text, *([x if r.random() > e else word() for x in text] for e in (0.005, 0.02, 0.03))]
    texts += [[word() for _ in range(r.randint(0, 30))] + passage for _ in range(60)]
    texts += [[x if r.random() > 0.02 else word() for x in crowd] for _ in range(60)] + [[], []]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sample", [J.SAMPLE, 100, 0])
@pytest.mark.parametrize("sizes", [{}, {"small": 2, "part": 10, "tile": 7}])
def test_no_near_pair_is_missed(spark, monkeypatch, sizes, sample):
    monkeypatch.setattr(J, "SAMPLE", sample)
    rows = corpus(len(sizes))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    least = {}
    for x in S.similar(docs, **sizes).collect():
        least[x["class"]] = min(x.doc_id, least.get(x["class"], x.doc_id))
    assert sorted(least.values()) == brute_keepers(rows)


def test_the_stage_drops_near_copies(spark):
    """Alike at 0.83: SimHash with 4 bits kept both."""
    import corpus_pipeline

    r = random.Random(1)
    text = [f"w{r.randrange(9999)}" for _ in range(104)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join([*text[:50], "X", *text[51:70], "Y", *text[71:]])), (3, "something else entirely in a few words")], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_prefix_order_is_the_same_for_all():
    """Half of the shingles is counted; of the others the common ones come last, the rarest of them first."""
    h = np.sort(J.mixed(np.arange(1, 41, dtype=np.uint64)).view(np.int64))
    counted = h[h >> 40 & 1 == 1]
    rest = h[h >> 40 & 1 == 0]
    common = np.sort(np.append(rest[:2], counted[:1]))
    ranks = np.array([2, 0, 1])
    first, beyond, place = J.dealt(h, common, ranks, 40)
    assert first.tolist() == [x for x in counted if x not in common]
    tail = [common[np.flatnonzero(ranks == k)[0]] for k in range(3)]
    assert beyond.tolist() == [x for x in rest if x not in common] + tail and place[-3:].tolist() == [1, 2, 0]
    assert J.dealt(h, common, ranks, len(first) + 3)[1].tolist() == beyond[:3].tolist()
    assert len(J.dealt(h, common, ranks, 3)[1]) == 0

def test_components_on_the_driver_and_in_rounds(spark):
    from gaugeframe.llm.components import components, joined

    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(9 - i, 50 + i) for i in range(5)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7), (101, 100), (-5, 2**62)]
    label = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in label:
        for u, v in links:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    df = spark.createDataFrame(links, "u long, v long")
    spark.sparkContext.setJobGroup("few", "")
    assert {tuple(x) for x in components(df).collect()} == set(label.items())
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 10  # a round takes about as many
    spark.sparkContext.setJobGroup("rest", "")
    assert {tuple(x) for x in components(df, most=0).collect()} == set(label.items())
    assert components(df.where("u = v")).count() == 0
    chain = np.arange(50_000)
    np.random.default_rng(1).shuffle(chain)
    assert (joined(chain[1:], chain[:-1])[1] == 0).all()


def test_no_task_needs_a_second_worker(spark):
    """A filter on the key, which the join adds, ran the function twice in a task."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e"), (None, "a b c")], "doc_id long, text string")
    plan = S.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_the_goals_of_a_mix_need_no_worker(spark):
    from gaugeframe.llm import mixing

    narrow = spark.createDataFrame([(["a"], 3, 1), ([None], 4, 2)], "pattern array<string>, size long, bucket int").checkpoint()
    found = mixing.cut_points(narrow, [{"pattern": ["a"], "words": 3, "taken": 5}, {"pattern": [None], "words": 4, "taken": 4}])
    assert "LocalTableScan" in found._jdf.queryExecution().executedPlan().toString()
    assert [(x.p, x.whole, x.extra) for x in found.orderBy("p").collect()] == [(0, 1, 2), (1, 1, 0)]


def test_a_tile_is_compared_in_little_memory():
    """All pairs of a tile were looked up at once, 256 K of them: over 100 MB a worker."""
    import tracemalloc

    n, r = 1_000, np.random.default_rng(1)
    entries = np.zeros(2 * n, J.ENTRY)
    entries["node"], entries["n"], entries["at"] = np.arange(2 * n), 100, 3
    sketches = r.integers(0, 2**63, (2 * n, J.BITS // 64)).astype(np.uint64)
    sketches[n::5] = sketches[:n:5]
    tracemalloc.start()
    try:
        pairs = J.across(entries, np.arange(2 * n), sketches, np.arange(2 * n) >= n, J.SIMILARITY)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs.tolist() == [[i, n + i] for i in range(0, n, 5)]
    assert peak < 16 << 20
