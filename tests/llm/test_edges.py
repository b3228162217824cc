"""Every query of the subpackage and the pipeline over small tables with nulls in each column, empty and very long
texts, repeated rows and further columns with clashing names, and over empty tables."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from gaugeframe.llm.registry import QUERIES

LONG = "a long text of many words " * 4000
PROSE = "the council met on monday to discuss the new bridge and the plan for roads near the river. "
DOCS = [
    (0, PROSE * 3, "en", "web", 9), (1, PROSE * 3, "en", "web", 9), (1, PROSE * 3, "en", "web", 9), (2, None, "en", "web", None), (3, "", None, None, 0),
    (4, LONG, "en", "books", 7), (5, "password = abcdefgh12345 " + PROSE, "en", None, 3), (None, PROSE + "tail", "en", "web", 9), (None, None, None, None, None), (6, " \n\t ", "en", "web", 4),
    (7, "x" * 50000, "en", "books", 50000),
]
CLASH = {"size": 5, "length": "c", "words": 1, "n_tokens": 2, "fingerprint": "f", "component_id": 3, "key": 4, "record": "r", "spans": "s", "kept": True, "__taken": 1, "__pattern": "p", "value": 0}
LABELS = [(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 0, 1), (None, 1, 0), (6, None, None), (7, 0, 1), (99, 1, 0)]
PAGES = [(0, "http://a.example/x/1", "<html><body><nav>Menu</nav><article><p>One  text</p></article></body></html>"), (1, None, None), (None, "http://a.example/x/2", ""), (2, "not a url", "<p>bare &amp; plain"), (2, "not a url", "<p>bare &amp; plain")]
VECTORS = [(0, [1.0, 2.0], 1), (50, [0.5, float("nan")], 0), (1, [1.0, 2.0], None), (2, None, 1), (3, [None, 1.0], 1), (None, [1.0, 1.0], 2), (100, [-1.0, 0.25], 1)]
BY_DOCUMENT = ("op2_simhash", "op3_classifier", "op4_token_counts", "op5_quality_rules", "op6_mixing", "op10_secrets")


def write(spark, folder, rows):
    from pyspark.sql import functions as F

    schemas = {
        "documents": (DOCS, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (LABELS, "doc_id long, quality int, toxic int"),
        "pages": (PAGES, "page_id long, url string, html string"), "embeddings": (VECTORS, "vec_id long, embedding array<float>, label int"), "benchmark": ([(0, PROSE)], "item_id long, text string"),
    }
    for name, (data, schema) in schemas.items():
        df = spark.createDataFrame(data if rows else [], schema)
        df.withColumns({k: F.lit(v) for k, v in CLASH.items()}).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edges") / "full", True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edges") / "empty", False)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline_over_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_a_row_for_each_document(spark, full, name):
    got = Counter(r.doc_id for r in QUERIES[name](spark, full).collect())
    assert got == Counter(d[0] for d in DOCS)


def test_simhash_copies_and_empty_texts(spark, full):
    rows = {r.doc_id: r for r in QUERIES["op2_simhash"](spark, full).collect() if r.doc_id is not None}
    assert rows[0].component_id == rows[1].component_id == 0
    assert {rows[i].fingerprint for i in (2, 3, 6)} == {"0" * 16} and {rows[i].component_id for i in (2, 3, 6)} == {2}


def test_mix_takes_whole_quotas(spark, full):
    rows = QUERIES["op6_mixing"](spark, full).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r["size"] for r in rows)) <= 3


@pytest.mark.parametrize("name", ["op1_packing", "op9_token_files"])
def test_every_id_lies_in_one_piece(spark, full, name):
    rows = QUERIES[name](spark, full).collect()
    if name == "op9_token_files":
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert Counter(p.doc_id for r in rows for p in r.pieces if p.start == 0) == Counter(d[0] for d in DOCS)
    else:
        assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(d[0] for d in DOCS)
        assert all(r.offset + r.length <= 2048 for r in rows)
        assert {r.ids_crc32 for r in rows if r.doc_id == 3} == {zlib.crc32((1).to_bytes(4, "little"))}


def test_pages(spark, full):
    rows = QUERIES["op8_html"](spark, full).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in rows) == Counter([(0, "One text", 8), (1, "", 0), (None, "", 0), (2, "bare & plain", 12), (2, "bare & plain", 12)])


def test_vectors(spark, full):
    rows = QUERIES["op7_kdtree"](spark, full).collect()
    # 50 has a component that is no number; 2 and 3 lack values.
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows if r.vec_id is not None)
    assert (0, 1, 1, 256 * 256 + 512 * 512) in got and all(r[2] not in (50, 2, 3) for r in got)


def test_pipeline(spark, full):
    rows = corpus_pipeline.run(spark, full).collect()
    assert all(r.offset + r.length <= 2048 for r in rows)
    assert len({r.doc_id for r in rows} & {0, 1}) <= 1  # copies
