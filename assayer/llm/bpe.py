"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as the list of its parts and, beside it, the list of the merge ranks of adjacent
parts. The least rank is found by a scan, its boundary is deleted, and the ranks of the two neighbours
are refreshed. Words over SHORT bytes, for which scans would take quadratic time, keep the same ranks
in a heap. Results are those of the tokenizers library for the same file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, sliced, utf8_rows, with_row_key

SHORT = 128
#: Units kept by a Python worker in each of two generations; longer units aren't kept.
CACHE, CACHED_CHARS = 500_000, 48
_NONE, _SHIFT = 1 << 30, 20
#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this character the installed regex module and the library agree on \p{L}, \p{N} and \s.
AGREED = "԰"


def byte_symbols() -> dict[int, str]:
    """The printable symbol for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankBpe:
    """One vocabulary file; encode() and decode() of whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {s: b for b, s in symbols.items()}
        self.start = [vocab[symbols[b]] for b in range(256)]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last = [vocab[symbols[b] + suffix] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.rank[vocab[left] << _SHIFT | vocab[right]] = len(self.made)
            self.made.append(vocab[left + right])
        self.token = {i: bytes(back[c] for c in t.removesuffix(suffix)) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.added.items()}
        self.decimal = {i: b"%d" % i for i in self.token}
        self.bytes_of = {str(i).encode(): t for i, t in self.token.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        from .merging import BatchMerger

        self.batch = BatchMerger(self)
        self.odd_space = regex.compile(r" \s|\s ")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        start = self.start
        parts = [start[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank, made = self.rank.get, self.made
        near = [rank(a << _SHIFT | b, _NONE) for a, b in zip(parts, parts[1:])]
        while near:
            low = min(near)
            if low == _NONE:
                break
            i = near.index(low)
            parts[i] = made[low]
            del parts[i + 1], near[i]
            if i:
                near[i - 1] = rank(parts[i - 1] << _SHIFT | parts[i], _NONE)
            if i < len(near):
                near[i] = rank(parts[i] << _SHIFT | parts[i + 1], _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << _SHIFT | parts[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or rank(parts[i] << _SHIFT | parts[j], _NONE) != r:
                continue
            parts[i], gone[j], after[i] = self.made[r], True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (q := rank(parts[a] << _SHIFT | parts[after[a]], _NONE)) < _NONE:
                    heapq.heappush(heap, (q, a))
        return [p for p, g in zip(parts, gone) if not g]

    def words(self, text: str) -> list[str]:
        if text.isascii() or max(text) < AGREED:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _unit(self, unit: str) -> bytes:
        """Decimal ids, comma-joined, of a unit that no word crosses."""
        got = self.old.get(unit)
        if got is None:
            bare = unit[1:] if unit[0] == " " else unit
            words = [unit] if bare.isascii() and bare.isalpha() else self.words(unit)
            if len(words) == 1:
                got = b",".join(map(self.decimal.__getitem__, self.merge(unit.encode("utf-8", "replace"))))
            else:  # a word by itself is a unit too and may be known
                got = b",".join([self.new.get(w) or self.old.get(w) or b",".join(map(self.decimal.__getitem__, self.merge(w.encode("utf-8", "replace")))) for w in words])
        if len(unit) <= CACHED_CHARS:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[unit] = got
        return got

    def _units(self, text: str) -> list[str]:
        # A single space before a word belongs to it, so that every such space begins a unit; texts
        # with other runs of white space about their spaces are cut by the pattern.
        if self.odd_space.search(text) or text[0] == " " or text[-1] == " ":
            return self.words(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def _segment(self, text: str) -> list[bytes]:
        units = self._units(text)
        ids = list(map(self.new.get, units))
        i = -1
        try:
            while True:
                i = ids.index(None, i + 1)
                ids[i] = self._unit(units[i])
        except ValueError:
            return ids

    def _split_added(self, text: str) -> list[str]:
        return self.cut_added.split(text) if self.cut_added and "<" in text else [text]

    def learn(self, texts: list[str]) -> None:
        """Makes the units of many texts known; their words are merged together."""
        found: set[str] = set()
        for text in texts:
            for part in self._split_added(text):
                if part and part not in self.added:
                    found.update(self._units(part))
        fresh = [u for u in found if u not in self.new and len(u) <= CACHED_CHARS]
        if len(self.new) + len(fresh) > CACHE:
            self.old, self.new = self.new, {}
        cut: dict[str, list[str]] = {}
        need: dict[str, bytes] = {}
        for u in fresh:
            if (known := self.old.get(u)) is not None:
                self.new[u] = known
                continue
            bare = u[1:] if u[0] == " " else u
            cut[u] = [u] if bare.isascii() and bare.isalpha() else self.words(u)
            need.update((w, b"") for w in cut[u] if w not in self.new)
        decimal = self.decimal.__getitem__
        for w, ids in zip(need, self.batch.merge([w.encode("utf-8", "replace") for w in need])):
            need[w] = b",".join(map(decimal, memoryview(ids).cast("I")))
        for u, words in cut.items():
            self.new[u] = b",".join([need.get(w) or self.new[w] for w in words])

    def encode_decimal(self, text: str) -> bytes:
        """The ids as decimals joined by commas."""
        out: list[bytes] = []
        for part in self._split_added(text):
            if part in self.added:
                out.append(b"%d" % self.added[part])
            elif part:
                out += self._segment(part)
        return b",".join(out)

    def encode(self, text: str) -> list[int]:
        got = self.encode_decimal(text)
        return [int(x) for x in got.split(b",")] if got else []

    def decode_decimal(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(b","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, RankBpe] = {}


def loaded(path: str) -> RankBpe:
    """The vocabulary, read once by each Python worker."""
    if path not in _loaded:
        _loaded[path] = RankBpe(path)
    return _loaded[path]


def bpe_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row for each input row: rid, key, n_tokens and the outputs asked for: ids (array of int),
    decoded (the text that the ids decode to), ids_sha256 and decoded_sha256 (digests of the decimal
    ids joined by commas, and of the decoded text). Null counts as the empty text, which has no ids.
    Repeated rows are encoded each, also with null keys; very long texts are encoded whole; an empty
    table gives no rows; other columns are ignored. Texts stay where they are read.
    """
    rows = with_row_key(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def encoded(bpe: RankBpe, b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {o: [] for o in outputs}
        counts = []
        texts = [t.decode("utf-8", "replace") for t in utf8_rows(b.column("_text"))]
        bpe.learn(texts)
        for text in texts:
            ids = bpe.encode_decimal(text)
            counts.append(ids.count(b",") + 1 if ids else 0)
            decoded = bpe.decode_decimal(ids) if {"decoded", "decoded_sha256"} & out.keys() else ""
            for o, made in (
                ("ids", lambda: [int(x) for x in ids.split(b",")] if ids else []),
                ("decoded", lambda: decoded),
                ("ids_sha256", lambda: hashlib.sha256(ids).hexdigest()),
                ("decoded_sha256", lambda: hashlib.sha256(decoded.encode()).hexdigest()),
            ):
                if o in out:
                    out[o].append(made())
        arrays = [pa.array(v, pa.list_(pa.int32()) if o == "ids" else pa.string()) for o, v in out.items()]
        return pa.RecordBatch.from_arrays([b.column("rid"), b.column("_key"), pa.array(counts, pa.int64()), *arrays], ["rid", "_key", "n_tokens", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for b in sliced(whole, "_text", 4 << 20):
                yield encoded(bpe, b)

    kind = rows.schema["_key"].dataType.simpleString()
    schema = ", ".join(["rid long", f"_key {kind}", "n_tokens long", *[f"{o} {kinds[o]}" for o in outputs]])
    return mapped(rows, run, schema).withColumnRenamed("_key", key)
