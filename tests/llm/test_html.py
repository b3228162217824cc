"""Alignment of lines against a quadratic table, and pages whose furniture only the difference can tell."""

import random

import pytest

from gaugeframe.llm import html_text as H


def longest(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("seed", range(200))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    r = random.Random(seed)
    x, y = ([r.randrange(r.choice((2, 4, 12))) for _ in range(r.randrange(25))] for _ in range(2))
    at = sorted(H.shared(x, y))
    part, rest = [x[i] for i in at], iter(y)
    assert len(part) == longest(x, y) and all(v in rest for v in part)


def test_many_lines_take_little_memory():
    import tracemalloc

    r = random.Random(1)
    x, y = ([r.randrange(5000) for _ in range(10_000)] for _ in range(2))
    tracemalloc.start()
    H.shared(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # a row for every line takes 12 MB and more


def test_difference_deletes_furniture_without_markup(spark):
    page = lambda k: f"<div>Site name</div><div>Home of news</div><p>Story {k} begins here.</p><p>Its text goes on, {k}.</p><div>All rights reserved</div>"
    rows = [(k, f"http://h.example/a/{k}", page(k)) for k in range(4)] + [(9, "http://other.example/a/1", page(9))]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Story 1 begins here.\nIts text goes on, 1." and got[3] == "Story 3 begins here.\nIts text goes on, 3."
    assert got[9].startswith("Site name")
