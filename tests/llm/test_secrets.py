import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest
import zstandard

from gaugeframe.llm import secrets as S


def brute(text):
    rules = [
        (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    return sorted((m.start(), k, m.end()) for k, (rule, holds) in enumerate(rules) for m in re.finditer(rule, text) if holds(m))


CASES = ["", "password=abc", "PassWd : 'abcdefgh'", "token=token=abcdefgh", "AKIAABCDEFGHIJKL x AKIAABC", "0" * 31, "a" * 40 + "g", "api_key\": \"abcd/efgh.=", "ſecret=abcdefgh", "secret = AKIAABCDEFGHIJKLMN " + "f" * 64]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert S.base_spans(text) == brute(text)


SECRET = "token=Zm9vYmFyMTIz"
FULL = "".join(chr(ord(c) + 0xFEE0) if c.isalnum() or c == "=" else c for c in SECRET)


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


@pytest.mark.parametrize("hidden", [
    b64(SECRET), b64(SECRET).rstrip("="), b64("xx " + SECRET), "".join(f"%{ord(c):02x}" for c in SECRET), quote(b64(SECRET) + "&=", safe=""),
    quote(quote("".join(f"%{ord(c):02x}" for c in SECRET))), "".join(f"\\u{ord(c):04x}" for c in SECRET), "".join(f"&#{ord(c)};" for c in SECRET), FULL,
    b64(b64(b64(SECRET))), b64(gzip.compress(SECRET.encode())), b64(zlib.compress(SECRET.encode())), b64(bz2.compress(b"hidden " + SECRET.encode())),
    b64(gzip.compress(gzip.compress(b64(quote(b64(SECRET))).encode()))), "path/" + b64("user: me; " + SECRET), "url/x/" + b64(gzip.compress(SECRET.encode())), base64.urlsafe_b64encode(("~~??>>" + SECRET).encode()).decode(),
    "\n".join(re.findall(".{1,76}", b64("long prefix " * 20 + SECRET))),
])
def test_nested_layers_map_to_the_text(hidden):
    for before, after in (("", ""), ("Some é text\n", " and more.")):
        text = before + hidden + after + " | " + hidden
        base, spans = S.all_spans(text)
        new = set(spans) - set(base)
        at = (len(before), len(text) - len(hidden))
        for a in at:
            inside = [s for s in new if a <= s[0] and s[2] <= a + len(hidden)]
            assert any(k == 0 for _, k, _ in inside), (text, spans)
        assert SECRET not in S.redact(text) and hidden not in S.redact(text)
        assert S.redact(text).startswith(before)


@pytest.mark.parametrize("prefix", ["path/", "blob_", "a/longer/path/", "x" * 21])
@pytest.mark.parametrize("bits", [9, 12, 15])
@pytest.mark.parametrize("level", [1, 5, 6, 9])
def test_zlib_behind_a_path(prefix, bits, level):
    tool = zlib.compressobj(level, zlib.DEFLATED, bits)
    hidden = b64(tool.compress(b"user: me; " + SECRET.encode()) + tool.flush()).rstrip("=")
    text = f"see {prefix}{hidden} there"
    assert any(k == 0 and b == 4 + len(prefix + hidden) for _, k, b in S.all_spans(text)[1])
    assert hidden not in S.redact(text)


@pytest.mark.parametrize("short", [4, 8, 12, 16])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_short_last_line_without_padding(short, newline):
    n = (2 * 76 + short) // 4 * 3
    hidden = newline.join(re.findall(".{1,76}", b64(("long prefix " * 20)[: n - len(SECRET) - 1] + " " + SECRET)))
    assert len(hidden.split(newline)[-1]) == short and "=" not in hidden
    for after in ("", "\nNext line", " and more"):
        assert any(k == 0 and b == len(hidden) for _, k, b in S.all_spans(hidden + after)[1])
        assert hidden.split(newline)[-1] not in S.redact(hidden + after)


def test_clean_text_and_bomb():
    text = "An ordinary sentence with averyveryverylongwordthatlookslikenothing, 100%% and \\unit &# %zz."
    assert S.all_spans(text) == ([], []) and S.redact(text) == text
    bomb = b64(zlib.compress(b" " * 3_000_000 + SECRET.encode()))
    assert S.all_spans(bomb, max_inflated=1 << 17)[1] == [(0, 0, len(bomb.rstrip("=")))]


def test_rows(spark):
    rows = [(1, "password=abcdefgh1", 1), (None, None, 2), (3, "x " + b64(SECRET), 3), (3, "x " + b64(SECRET), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(r.doc_id, r.n_assign, r.base_sha256, r.spans) for r in S.scan_secrets(docs).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (1, 1, digest("assign:0:18"), "assign:0:18") in got and (None, 0, digest(""), "") in got
    assert any(i == 3 and n == 0 and s.startswith("assign:2:") for i, n, _, s in got)
    assert S.scan_secrets(docs.limit(0)).count() == 0
    full = docs.withColumn("n_chars", docs["spans"].cast("long"))
    out = {r.doc_id: r for r in S.redact_documents(full).collect()}
    assert out[1].text == "[SECRET]" and out[1].n_chars == 8 and out[None].text is None and S.redact_documents(full).columns == full.columns


PACKERS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, lambda x: zstandard.ZstdCompressor().compress(x), lambda x: gzip.compress(x[:9]) + gzip.compress(x[9:])]


@pytest.mark.parametrize("seed", range(60))
def test_generated_nestings_have_exact_spans(seed):
    """A chain of wrappings round a secret, alone between words: the span is the secret's own characters where
    every layer is readable, else the compressed run's."""
    r = random.Random(seed)
    data, packed = ("id; " * r.randrange(3) + SECRET + " ;" * r.randrange(3)).encode(), False
    quoted = False
    for _ in range(r.randint(1, 3)):
        if r.random() < 0.5:
            for _ in range(r.randint(1, 2)):
                data = r.choice(PACKERS)(data)
            packed = True
        data = base64.b64encode(data)
        if r.random() < 0.4:
            data, quoted = quote(data.decode(), safe="").encode(), True
    width = r.choice([0, 16, 17, 60, 76])
    hidden = data.decode()
    if width and "%" not in hidden:
        hidden = r.choice(["\n", "\r\n"]).join(hidden[i : i + width] for i in range(0, len(hidden), width))
    text = "See " + hidden + " here"
    spans = S.all_spans(text)[1]
    stop = len(hidden.rstrip("="))
    assert any(k == 0 and a >= 4 and b <= 4 + len(hidden) and (not packed or quoted or b >= 4 + stop - 3) for a, k, b in spans), (text, spans)


@pytest.mark.parametrize("before", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("after", [0, 1, 2, 4])
def test_plain_base64_maps_character_by_character(before, after):
    raw = b"-" * before + SECRET.encode() + b";" * after
    text = "x " + b64(raw)
    first, last = before * 4 // 3, -(-(before + len(SECRET)) * 4 // 3)
    assert S.all_spans(text)[1] == [(2 + first, 0, 2 + last)]


def test_nested_data_beyond_a_window():
    """What is compressed again beyond one window, and a secret at its end."""
    noise = random.Random(1).randbytes(300_000).hex().upper()
    inner = gzip.compress(("\n".join(noise[i : i + 31] for i in range(0, len(noise), 31)) + "\n" + SECRET).encode())
    text = "a " + b64(gzip.compress(inner, 0))
    assert (2, 0, len(text.rstrip("="))) in S.all_spans(text, max_inflated=1 << 17)[1]


@pytest.mark.parametrize("marker", ["H4sI", "H4sIAAAA", "eJw", "KLUv/S", "QlpoOTFBWSZTWQ", "/Td6WFoA"])
def test_many_markers_take_little_time(marker):
    import time

    text = marker * (131_072 // len(marker))
    began = time.process_time()
    assert S.all_spans(text)[0] == []
    assert time.process_time() - began < 2
