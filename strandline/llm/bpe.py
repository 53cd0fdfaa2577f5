"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

A word's symbols are leaves; a leaf holds rank * size + position of the pair that it begins, or "none". Every inner node holds
the least value below it, so the root is the leftmost pair of lowest rank. A merge changes three leaves (the merged pair, the
removed symbol, the pair before) and their paths to the root: logarithmic work. It ends when the root holds "none".

Words of up to 64 symbols are merged together: one array of trees, each step pops all roots at once. Longer words have a
tree of their own. Results are kept for each blank-free chunk of text, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_columns

NONE = np.iinfo(np.int64).max
#: Chunks kept by a worker; the store is emptied when it is full.
KEPT = 400_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte value, as byte-level vocabularies spell them: printable Latin-1 bytes stay, the others follow from U+0100."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in stay else chr(256 + extra))
        extra += b not in stay
    return out


class PairTable:
    """(left id, right id) -> rank and merged id, by open addressing in numpy arrays so that many pairs are looked up at once."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int64)
        self.scalar = merges
        key = np.array([(a << 32) | b for a, b in merges], np.int64)
        val = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            _, first = np.unique(np.where(free, slot[todo], -1 - np.arange(len(todo))), return_index=True)
            put = todo[first[free[first]]]
            self.keys[slot[put]], self.rank[slot[put]], self.made[slot[put]] = key[put], val[put, 0], val[put, 1]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE if the pair doesn't merge) and merged ids; a negative id stands for no symbol."""
        key = (left << 32) | right
        slot = self._slot(key)
        have = self.keys[slot]
        todo = np.flatnonzero((have != key) & (have != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[todo]]
            todo = todo[(have != key[todo]) & (have != -1)]
        hit = (self.keys[slot] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[slot], NONE), np.where(hit, self.made[slot], -1)


def merge_one(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge one word with a segment tree of its own."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if r := merges.get((sym[i], sym[i + 1])):
            tree[size + i] = r[0] * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] != NONE:
        i = tree[1] % size
        j = nxt[i]
        sym[i] = merges[sym[i], sym[j]][1]
        nxt[i] = nxt[j]
        put(j, NONE)
        if nxt[i] < n:
            prv[nxt[i]] = i
        r = merges.get((sym[i], sym[nxt[i]])) if nxt[i] < n else None
        put(i, r[0] * size + i if r else NONE)
        if (p := prv[i]) >= 0:
            r = merges.get((sym[p], sym[i]))
            put(p, r[0] * size + p if r else NONE)
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = nxt[i]
    return out


def merge_many(symbols: np.ndarray, length: np.ndarray, size: int, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of at most `size` symbols (a power of two) in lockstep: row w of every array belongs to word w.

    symbols: those of all words in a row, length: how many each word has. Returns both after the merges.
    """
    m, depth, col = len(length), size.bit_length() - 1, np.arange(size)
    sym = np.full((m, size + 1), -1, np.int64)  # the last column stays "no symbol"
    alive = col[None, :] < length[:, None]
    sym[:, :size][alive] = symbols
    nxt = np.where(col[None, :] + 1 < length[:, None], col[None, :] + 1, size)
    prv = np.repeat(np.arange(-1, size - 1)[None, :], m, 0)
    tree = np.full((m, 2 * size), NONE, np.int64)
    rank, _ = table.find(sym[:, : size - 1].ravel(), sym[:, 1:size].ravel())
    rank = rank.reshape(m, size - 1)
    tree[:, size : 2 * size - 1] = np.where(rank == NONE, NONE, np.where(rank == NONE, 0, rank) * size + np.arange(size - 1))
    for level in range(depth - 1, -1, -1):
        k = np.arange(1 << level, 2 << level)
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    flat = tree.ravel()  # a view

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        base, k = rows * (2 * size), at + size
        flat[base + k] = value
        for _ in range(depth):
            k = k >> 1
            flat[base + k] = np.minimum(flat[base + 2 * k], flat[base + 2 * k + 1])

    def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        r, _ = table.find(sym[rows, at], sym[rows, nxt[rows, at]])
        return np.where(r == NONE, NONE, np.where(r == NONE, 0, r) * size + at)

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        i = tree[rows, 1] % size
        j = nxt[rows, i]
        _, made = table.find(sym[rows, i], sym[rows, j])
        sym[rows, i] = made
        alive[rows, j] = False
        after = nxt[rows, j]
        nxt[rows, i] = after
        inside = after < size
        prv[rows[inside], after[inside]] = i[inside]
        put(rows, j, np.full(len(rows), NONE))
        put(rows, i, pair(rows, i))
        p = prv[rows, i]
        has = p >= 0
        put(rows[has], p[has], pair(rows[has], p[has]))
        rows = rows[tree[rows, 1] != NONE]
    return sym[:, :size][alive], alive.sum(1)


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file; encodes whole texts and decodes ids.

    The file's own normaliser and pre-tokenizer decide on texts with characters outside the ranges on which all Unicode
    versions agree; the merges are always made here.
    """

    #: Pieces of a blank-free chunk, as the tokenizer file's pattern has them.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]*"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        assert spec["decoder"] is None, "a file without decoder is asked for"
        self.token = {v: k for k, v in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {v: k for k, v in self.special.items()}
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.merges, self.table = merges, PairTable(merges)
        signs = _byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + end] for s in signs], np.int64)
        most = max(self.token) + 1
        self.number, self.name = [str(i) for i in range(most)], [self.token.get(i, "") for i in range(most)]
        self.piece, self.plain = regex.compile(self.PIECES), regex.compile(self.PLAIN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.of_sign = {s: b for b, s in enumerate(signs)}
        self.store: dict[str, tuple[str, str, int]] = {}
        self.pieces: dict[str, tuple[str, str, int]] = {}

    def _merge(self, words: list[bytes]) -> list[tuple[str, str, int]]:
        """(ids joined by a space, tokens joined by a space, number of ids) of each word."""
        if not words:
            return []
        length = np.array([len(w) for w in words])
        end = np.cumsum(length)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        sym[end - 1] = self.last[raw[end - 1]]
        out: list = [None] * len(words)
        size = np.where(length <= 64, np.maximum(4, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)), 0)
        for z in np.unique(size).tolist():
            ks = np.flatnonzero(size == z)
            for a in range(0, len(ks), 8192):
                part = ks[a : a + 8192]
                if z:
                    n = length[part]
                    at = np.arange(n.sum()) + np.repeat(end[part] - n - np.cumsum(n) + n, n)
                    ids, count = merge_many(sym[at], n, z, self.table)
                    ids, cut = ids.tolist(), np.concatenate(([0], np.cumsum(count))).tolist()
                    for k, p, q in zip(part.tolist(), cut, cut[1:]):
                        out[k] = self._said(ids[p:q])
                else:
                    for k in part.tolist():
                        out[k] = self._said(merge_one(sym[end[k] - length[k] : end[k]].tolist(), self.merges))
        return out

    def _said(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join([self.number[i] for i in ids]), " ".join([self.name[i] for i in ids]), len(ids)

    def _learn(self, chunks: set[str]) -> None:
        """Encode blank-free, normalised chunks and keep the results, of their pieces too."""
        names = list(chunks)
        pieces = [self.piece.findall(c) for c in names]
        fresh = list({p for ps in pieces for p in ps}.difference(self.pieces))
        self.pieces.update(zip(fresh, self._merge([p.encode() for p in fresh]), strict=True))
        get = self.pieces.__getitem__
        for c, ps in zip(names, pieces, strict=True):
            if len(ps) == 1:
                self.store[c] = get(ps[0])
            else:
                x = [get(p) for p in ps]
                self.store[c] = " ".join([p[0] for p in x]), " ".join([p[1] for p in x]), sum([p[2] for p in x])

    def _odd(self, text: str) -> list[tuple[str, str, int]]:
        """A text with unusual characters: the file's own normaliser and pre-tokenizer, then the merges of this class."""
        words = [bytes(self.of_sign[s] for s in w) for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self._merge([w for w in words if w])

    def encode_many(self, texts: list[str | None]) -> list[list[tuple[str, str, int]]]:
        """For each text, pieces (ids joined by a space, tokens joined by a space, number of ids) in order."""
        plan: list[list] = []
        missing: set[str] = set()
        if len(self.store) > KEPT:
            self.store.clear()
            self.pieces.clear()
        for t in texts:
            parts: list = []
            for k, part in enumerate(self.cut.split(t or "") if self.cut else [t or ""]):
                if k % 2:
                    parts.append([(str(self.special[part]), part, 1)])
                elif self.plain.fullmatch(part):
                    chunks = unicodedata.normalize("NFC", part).lower().split()
                    missing.update(c for c in chunks if c not in self.store)
                    parts.append(chunks)
                elif part:
                    parts.append(self._odd(part))
            plan.append(parts)
        if missing:
            self._learn(missing)
        get = self.store.__getitem__
        return [[x for part in parts for x in (map(get, part) if part and isinstance(part[0], str) else part)] for parts in plan]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for s, _, _ in self.encode_many([text])[0] for i in s.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """As a tokenizer without decoder does: the tokens joined by a space, special tokens kept; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text; with_text adds the decimal ids and the decoded text.

    A null text counts as empty: no ids, the digests of the empty text. Columns of docs that bear a new name are replaced;
    repeated rows stay; an empty table gives an empty result.
    """

    def make():
        bpe = WordBpe(path)

        def run(texts: pa.Array) -> list:
            found = bpe.encode_many(texts.to_pylist())
            ids = [" ".join(x[0] for x in f if x[2]) for f in found]
            said = [" ".join(x[1] for x in f if x[2]) for f in found]
            sha = lambda xs: pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in xs])
            out = [pa.array([sum(x[2] for x in f) for f in found], pa.int64()), sha(ids), sha(said)]
            return out + ([pa.array(ids), pa.array(said)] if with_text else [])

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_text:
        fields += [T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())]
    return with_columns(docs, text_col, fields, make, most=2 << 20)
