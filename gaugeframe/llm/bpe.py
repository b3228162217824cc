"""Byte-pair encoding by table: a text is split into pre-tokens, and each distinct pre-token is merged once.

For vocabularies whose pre-tokens hold no white space, texts are encoded some megabytes at a time: runs between white
space get two 64-bit hashes in array operations, only distinct runs are looked up, and the ids of all runs are gathered
from theirs. Runs that agree in one hash but not in the other send their texts the plain way.

The vocabulary file is the only source of truth. The tokenizers library merges every pre-token that the table does
not hold, and encodes whole texts with characters on which our split and the library's disagree.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np

from .common import REMEMBERED, begin

#: The pre-token patterns of the two public vocabularies, as in their files, with \p{L} and \p{N} in the
#: words of Python's re. Where the two classes differ for a character, its texts are left to the library.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"""

#: Distinct pre-tokens that a worker remembers besides the vocabulary; others are merged again when needed.
PIECES = 100_000

#: Bytes that the run table takes in a worker, and of one entry, about.
RUN_BYTES, ENTRY_BYTES = 16 << 20, 32

#: Bytes of the longest run between white space that is hashed and remembered; longer ones are split each time.
LONGEST_REMEMBERED = 48

#: Bytes of text that are encoded at a time, and that are hashed at a time.
CHUNK, STRIPE = 1 << 20, 1 << 18


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, else as the next character from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class RunTable:
    """Ids of runs between white space, as arrays: two hashes of each run, sorted by the first, and where its ids begin
    in one pool. When it is full the half that was not met for the longest time goes."""

    def __init__(self, pieces: PieceTable, most: int, kind: type):
        self.pieces, self.most, self.clock = pieces, max(2, most // ENTRY_BYTES), 0
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.size, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, kind)

    def _merged(self, run: bytes) -> bytes:
        text = run.decode()
        if text.isalpha():
            return self.pieces.merged(text)
        parts = self.pieces.split(text)
        return self.pieces.merged(text) if parts == [text] else b"".join([self.pieces[p] for p in parts])

    def look_up(self, keys: np.ndarray, checks: np.ndarray, runs: Callable[[np.ndarray], list[bytes]], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of runs with these hashes (ascending keys) begin in the pool, how many they are, and the pool.
        runs: the runs at some places; keep: which may be remembered."""
        self.clock += 1
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            taken = self.keys[at] == keys
            hit = taken & (self.checks[at] == checks) & keep
            self.met[at[hit]] = self.clock
        else:
            at, taken, hit = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        missing = np.flatnonzero(~hit)
        values = list(map(self._merged, runs(missing)))
        size, first = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        size[hit], first[hit] = self.size[at[hit]], self.first[at[hit]]
        size[missing] = np.fromiter(map(len, values), np.int64, len(values)) // 4
        first[missing] = len(self.pool) + np.cumsum(size[missing]) - size[missing]
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(values), "<u4").astype(self.pool.dtype)])
        new = missing[keep[missing] & ~taken[missing]]
        if len(new):
            where = np.searchsorted(self.keys, keys[new])
            for name, x in (("keys", keys), ("checks", checks), ("first", first), ("size", size)):
                old = getattr(self, name)
                setattr(self, name, np.insert(old, where, x[new].astype(old.dtype)))
            self.met = np.insert(self.met, where, self.clock)
            self.pool = pool
            if len(self.keys) > self.most or len(pool) > 8 * self.most:
                self._forget()
        return first, size, pool

    def _forget(self) -> None:
        left = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :])
        n = self.size[left].astype(np.int64)
        after = np.cumsum(n)
        self.pool = self.pool[np.repeat(self.first[left] - (after - n), n) + np.arange(after[-1])]
        self.keys, self.checks, self.met, self.size = self.keys[left], self.checks[left], self.met[left], self.size[left]
        self.first = (after - n).astype(np.int32)


class _Hash:
    """Of every run of bytes in a stripe: the sum of its bytes times powers of an odd number, modulo 2 ** 64, from
    differences of one running sum."""

    def __init__(self, base: int):
        n = STRIPE + LONGEST_REMEMBERED + 1
        self.powers = np.cumprod(np.full(n, base, np.uint64))
        self.inverse = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.powers[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inverse[starts]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_HASHES: list[_Hash] = []


def distinct_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Starts and ends of the runs between white space, for each its number among distinct runs, for each of these (in
    the order of its first hash) one run, the hashes, and whether both hashes agree on what is distinct. Runs beyond
    LONGEST_REMEMBERED are distinct each."""
    if not _HASHES:
        _HASHES.extend((_Hash(0x9E3779B97F4A7C15), _Hash(0xD6E8FEB86659FD93)))
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    hashes = np.zeros((2, len(starts)), np.uint64)
    for a in range(0, len(data), STRIPE):
        i, j = np.searchsorted(starts, (a, a + STRIPE))
        stripe = data[a : a + STRIPE + LONGEST_REMEMBERED].astype(np.uint64)
        last = np.minimum(ends[i:j] - a, len(stripe))
        for k in range(2):
            hashes[k, i:j] = _HASHES[k](stripe, starts[i:j] - a, last)
    hashes[0] += size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(hashes[0])
    long = size > LONGEST_REMEMBERED
    new = np.ones(len(order), bool)
    new[1:] = (hashes[0][order[1:]] != hashes[0][order[:-1]]) | long[order[1:]] | long[order[:-1]]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    alike = bool((hashes[1] == hashes[1][one][number]).all() and (size == size[one][number]).all())
    return starts, ends, number, one, hashes, alike


class PieceTable(dict):
    """Pre-token -> value (its number of tokens, or its ids as bytes). A missing pre-token is merged by the library."""

    def __init__(self, path: str, values: str, run_bytes: int = RUN_BYTES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.counts = values == "counts"
        self.word_ends = bool(getattr(self.model, "end_of_word_suffix", None))
        self.split = re.compile(WORD_PATTERN if self.word_ends else BYTE_PATTERN).findall
        self.alphabet = byte_alphabet()
        special = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in special.items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in special.values()):
            raise ValueError("only plain special tokens are known here")
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.runs = RunTable(self, run_bytes, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.known = np.zeros(sys.maxunicode + 1, np.uint8)  # of each character: 0 not met yet, 1 trusted, 2 doubted
        self.trusted = bytes(c for c in range(128) if self._agree(chr(c)))
        self.zero = 0 if self.counts else b""
        self.id_bytes = [] if self.counts else [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        if self.counts:
            self.update(self.whole_tokens())
        self.base = len(self)

    def whole_tokens(self) -> dict[str, int]:
        """The proof that the shortcut rests on: each string of the vocabulary that is a pre-token by itself and
        that the merges turn into that one token. Such a string counts 1 wherever it is a pre-token."""
        back = {c: b for b, c in self.alphabet.items()}
        proven = {}
        for entry in self.library.get_vocab(with_added_tokens=False):
            try:
                piece = bytes(back[c] for c in entry).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.split(piece) == [piece] and len(self.model.tokenize(entry)) == 1:
                proven[piece] = 1
        return proven

    def merged(self, piece: str):
        """Its value by the library's merges."""
        plain = piece.isascii() and piece.isprintable() and " " not in piece  # written as itself
        ids = self.model.tokenize(piece if plain else "".join(map(self.alphabet.__getitem__, piece.encode())))
        return len(ids) if self.counts else b"".join([self.id_bytes[t.id] for t in ids])

    def __missing__(self, piece: str):
        value = self.merged(piece)
        if len(self) > self.base + PIECES:
            for _ in range(PIECES):
                self.popitem()  # the vocabulary came first, so it stays
        self[piece] = value
        return value

    def _normal(self, text: str) -> str:
        return text.lower() if self.word_ends else text

    def _pieces(self, text: str):
        return map(self.__getitem__, self.split(self._normal(text)))

    def _join(self, values):
        return sum(values) if self.counts else b"".join(values)

    def _by_library(self, text: str):
        ids = self.library.encode(text, add_special_tokens=False).ids
        return len(ids) if self.counts else b"".join(map(int.to_bytes, ids, repeat(4), repeat("little")))

    def _agree(self, char: str) -> bool:
        """Whether split and library treat the character alike, next to each class of neighbour."""
        if 0xD800 <= ord(char) <= 0xDFFF or unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char):
            return False
        if self.word_ends and (char in "Σ" or not unicodedata.is_normalized("NFC", char.lower())):
            return False
        return all(self._split_alike(p) for p in (char, f"a{char}", f"{char}a", f"1{char}", f"{char}1", f"!{char}", f"{char}!", f" {char} ", f"{char}{char}b", f"\n{char}\n"))

    def _split_alike(self, text: str) -> bool:
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        theirs = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return theirs == ["".join(map(self.alphabet.__getitem__, p.encode())) for p in self.split(self._normal(text))]

    def _safe(self, text: str) -> bool:
        if text.isascii() and self.trusted and not text.encode().translate(None, self.trusted):
            return True
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        met = self.known[codes]
        if not met.all():
            for c in np.unique(codes[met == 0]).tolist():
                self.known[c] = 1 if self._agree(chr(c)) else 2
            met = self.known[codes]
        return int(met.max()) == 1 and self._composed(text)

    def _composed(self, text: str) -> bool:
        return not self.word_ends or unicodedata.is_normalized("NFC", text)

    def value(self, text: str):
        """Of a whole text: its number of tokens, or its ids as little-endian unsigned 32-bit integers."""
        if not text:
            return self.zero
        if not self._safe(text):
            return self._by_library(text)
        if self.special_split is None or "<|" not in text:
            return self._join(self._pieces(text))
        out = []
        for i, part in enumerate(self.special_split(text)):
            if i % 2:
                out.append(1 if self.counts else self.special[part].to_bytes(4, "little"))
            else:
                out.extend(self._pieces(part))
        return self._join(out)


    def ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as ``value`` gives them."""
        held: list[str | bytes] = []
        size = 0
        for text in texts:
            plain = self.word_ends and len(text) < CHUNK and self._safe(text) and (self.special_split is None or "<|" not in text)
            held.append(self._normal(text) if plain else self._long(text))
            size += len(held[-1])
            if size >= CHUNK:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _long(self, text: str) -> bytes:
        """The ids of a text, long ones a part at a time where white space allows."""
        if not self.word_ends or len(text) < CHUNK or not self._safe(text) or (self.special_split is not None and "<|" in text):
            return self.value(text)
        found, at = [], 0
        while at < len(text):
            gap = re.compile(r"\s").search(text, at + CHUNK)
            end = gap.end() if gap else len(text)
            found += [x.tobytes() for x in self._flush([self._normal(text[at:end])])]
            at = end
        return b"".join(found)

    def _flush(self, held: list[str | bytes]) -> Iterator[np.ndarray]:
        """The ids of texts in lower case; what is in bytes are ids already."""
        texts = [x.encode() for x in held if isinstance(x, str)]
        data = b"\n".join(texts)
        starts, ends, number, one, hashes, alike = distinct_runs(np.frombuffer(data, np.uint8))
        if alike:
            a, b = starts[one], ends[one]
            runs = lambda at: [data[i:j] for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)]
            first, size, pool = self.runs.look_up(hashes[0][one], hashes[1][one], runs, b - a <= LONGEST_REMEMBERED)
            n = size[number]
            after = np.cumsum(n)
            all_ = pool[np.repeat(first[number] - (after - n), n) + np.arange(after[-1] if len(n) else 0)].astype("<u4")
            after = np.append(0, after)
            at = np.cumsum([0, *(len(t) + 1 for t in texts)])
            bounds = after[np.searchsorted(starts, at)].tolist()
        k = 0
        for x in held:
            if isinstance(x, bytes):
                yield np.frombuffer(x, "<u4")
            else:
                yield all_[bounds[k] : bounds[k + 1]] if alike else np.frombuffer(self._join(self._pieces(x)), "<u4")
                k += 1


_TABLES: dict[tuple[str, str, int], PieceTable] = {}
REMEMBERED["bpe"] = _TABLES.clear


def piece_table(path: str, values: str, run_bytes: int = RUN_BYTES) -> PieceTable:
    """One table for each worker process. run_bytes: of each half of its run table."""
    begin("bpe")
    key = path, values, run_bytes
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(*key)
    return _TABLES[key]
