import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gaugeframe.llm import bpe, classifier, html_text, kdtree, mixing, packing, quality_rules, token_counts, token_files
from gaugeframe.llm.common import default_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "Hello world's  end\n\n<|endoftext|> x", "é e\u0301 Σσς İ ½ ²³ a_b __ \x1c\x85\u200b", "日本語 текст 123456", " " * 40, "the " * 3000, "x" * 3000, "Hello world's  end\n\n<|endoftext|> x"]


def docs_of(spark, texts=TEXTS):
    rows = [(None if i == 3 else i, t, "c", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, size long")


@pytest.mark.parametrize("name,values", [("byte_bpe_50k.json", "counts"), ("word_bpe_49k.json", "ids")])
def test_tables_agree_with_the_library(name, values):
    path = default_tokenizer(name)
    table, library = bpe.PieceTable(path, values), Tokenizer.from_file(path)
    r = random.Random(4)
    pools = [[chr(c) for c in range(1, 0x250)], [chr(c) for c in range(1, 0x3100)], ["'s", " ", "\n", "a", "é", "1", "!", "<|endoftext|>", "\u0301", "Σ", "_", "²"]]
    for text in [t for t in TEXTS if t] + ["".join(r.choices(r.choice(pools), k=r.randint(0, 30))) for _ in range(1500)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert table.value(text) == (len(ids) if values == "counts" else b"".join(i.to_bytes(4, "little") for i in ids)), repr(text)


def test_token_counts(spark):
    library = Tokenizer.from_file(default_tokenizer("byte_bpe_50k.json"))
    want = Counter((None if i == 3 else i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 512) for i, t in enumerate(TEXTS))
    assert Counter(map(tuple, token_counts.token_counts(docs_of(spark)).collect())) == want
    assert token_counts.token_counts(docs_of(spark).limit(0)).count() == 0


def test_packing(spark):
    library = Tokenizer.from_file(default_tokenizer("word_bpe_49k.json"))
    rows = packing.pack(docs_of(spark), capacity=256).collect()
    ids = {None if i == 3 else i: [*library.encode(t or "").ids, 1] for i, t in enumerate(TEXTS)}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs_of(spark).limit(0)).count() == 0


def test_pack_histogram():
    r = random.Random(2)
    for _ in range(50):
        counts = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(0, 30))}
        patterns = packing.pack_histogram(counts, 64)
        used = Counter()
        for n, pattern in patterns:
            assert sum(k * c for k, c in pattern) <= 64
            for k, c in pattern:
                used[k] += n * c
        assert used == Counter(counts)


def test_quality_rules(spark):
    r = random.Random(1)
    texts = [None, "", "a b", "x y z w v " * 20, "one\none\ntwo\none", "#$% & |"] + [" ".join(r.choices("abcdefg", k=r.randint(0, 60))) for _ in range(60)]
    got = {x.doc_id: x for x in quality_rules.judge(docs_of(spark, ["skip"] * 4 + texts)).collect()}
    for i, t in enumerate(texts, 4):
        w, lines = WORD.findall(t or ""), [k for k in (t or "").split("\n") if WORD.search(k)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n, covered = Counter(windows), set()
        for k, x in enumerate(windows):
            if n[x] > 1:
                covered.update(range(k, k + 5))
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert x.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (x.kept and x.base_failed)
    assert quality_rules.judge(docs_of(spark).limit(0)).count() == 0


def test_classifier(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        text = [f"word{r.randint(0, 80)}" for _ in range(40)]
        text = [w + "$$$" for w in text] if kind == 1 else [*text, "nastything"] if kind == 0 else text
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    marks = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in classifier.classify(docs, marks).collect()}
    held = [i for i in range(0, 300, 2)]
    assert sum(got[i] == (i % 3 == 2) for i in held) >= 0.95 * len(held) and len(got) == 301
    assert classifier.keep_good(docs, marks.limit(0)).count() == 301


def test_targets_and_flow():
    assert mixing.targets([10, 10, 10], [5, 2, 1], 1.5, 2) == pytest.approx([20, 50 / 3, 25 / 3])
    sent = mixing.min_cost_flow([10, 10, 10], [(0,), (0, 1), (1,)], [12, 18], 2)
    assert sum(f.get(0, 0) for f in sent) == 12 and sum(f.get(1, 0) for f in sent) == 18 and all(sum(f.values()) <= 10 for f in sent)


def test_kdtree(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(200)] + [(500, None), (501, [float("nan")] * 6), (None, [1.0] * 6), (550, [1.0, 2.0])]
    got = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=60, block_rows=3, boxes=2).collect()
    usable = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v and not np.isnan(v).any()]
    want = set()
    for q, x in usable:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in usable if i != q and len(y) == len(x))[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav>Menu</nav><div class='cookie-notice'>c</div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three&nbsp;x<p>Five<aside>s</aside></article><footer>F</footer><script>a<b</script></body></html>"
    plain = ["<p>Site name</p><p>text %d</p><p>Imprint</p>" % i for i in range(2)]
    rows = [(1, "http://a/x", page), (2, "http://b/1", plain[0]), (3, "http://b/2", plain[1]), (None, None, None), (1, "http://a/x", page)]
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    article = "A & B\nOne two three x\nFive"
    assert got == Counter({(1, article, len(article)): 2, (2, "text 0", 6): 1, (3, "text 1", 6): 1, (None, "", 0): 1})


def test_token_files(spark, tmp_path):
    for n in (1, 2, 10, 1000):
        assert sorted(token_files.permute(np.arange(n), n, 9)) == list(range(n))
    folder = f"file://{tmp_path}/out"
    rows = sorted(token_files.materialise(docs_of(spark), folder, length=64, shard_records=7).collect())
    records = token_files.read(folder, 0, len(rows) + 5, 64, 7)
    assert len(records) == len(rows) and [zlib.crc32(x.tobytes()) for x in records] == [r.record_crc32 for r in rows]
    library, parts = Tokenizer.from_file(default_tokenizer("word_bpe_49k.json")), {}
    for r, record in zip(rows, records, strict=True):
        at = 0
        for p in r.pieces:
            parts.setdefault(p.doc_id, []).append((p.start, record[at : at + p.length].tolist()))
            at += p.length
    for i, t in enumerate(TEXTS):
        assert sum((x for _, x in sorted(parts[None if i == 3 else i])), []) == [*library.encode(t or "").ids, 49407]
    assert sorted(token_files.materialise(docs_of(spark), folder, length=64, shard_records=7).collect()) == rows


@pytest.mark.parametrize("chunk,stripe,run_bytes", [(1 << 21, 1 << 18, 1 << 25), (300, 64, 640)])
def test_array_encoder_equals_the_library(monkeypatch, chunk, stripe, run_bytes):
    """Any white space, runs around the longest that is remembered, punctuation, other scripts, texts beyond a chunk."""
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "STRIPE", stripe)
    monkeypatch.setattr(bpe, "_HASHES", [])
    path = default_tokenizer("word_bpe_49k.json")
    table, library = bpe.PieceTable(path, "ids", run_bytes), Tokenizer.from_file(path)
    r = random.Random(3)
    parts = ["the", "Don't", "it's", "x" * 48, "x" * 49, "y" * 130, "a_b", "1234", "café", "Слово", "naïve,", "(brackets)", "日本", "<|endoftext|>", "é", "a b", " ", "\x1c", "..."]
    texts = ["", " ", "\n"] + [r.choice((" ", "\n", "\t ", "\x0b")).join(r.choice(parts) if r.random() < 0.6 else "".join(r.choices("abcde,.'", k=r.randint(1, 12))) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts.append(" ".join(r.choice(parts[:7]) for _ in range(5000)))
    for _ in range(2):
        for text, got in zip(texts, table.ids(texts), strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_hashes_that_disagree_send_texts_the_plain_way(monkeypatch):
    path = default_tokenizer("word_bpe_49k.json")
    monkeypatch.setattr(bpe, "_HASHES", [bpe._Hash(1), bpe._Hash(0x9E3779B97F4A7C15)])  # the first only adds bytes up
    table, library = bpe.PieceTable(path, "ids"), Tokenizer.from_file(path)
    texts = ["on a saw, no was", "stop pots", "tops opts"]
    assert [x.tolist() for x in table.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
