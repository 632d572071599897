"""Best-fit packing of token sequences by a linear grouping scheme.

Everything that decides the packing is a function of the histogram of lengths, which has at most
`capacity` entries however many documents there are. The driver turns the histogram into a plan:

1. Lengths over capacity/8 are sorted and cut into groups of equal cardinality (GROUPS are the
   numbers of groups tried); in each, all lengths are rounded up to the group's largest.
2. For these few sizes the configurations of a sequence are optimised: a linear programme over
   patterns, solved by column generation, whose priced-out patterns come from a knapsack recursion.
   Its solution is rounded down.
3. Actual documents of each group take the places that the rounded sizes reserved.
4. The rest, and all small pieces, go largest first to the sequence that they fill best.

Sequences that look alike are one class with a count, so the plan's size depends on the capacity only.
Documents then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import SHORT, RankBpe
from .common import mapped, sliced, stored, utf8_rows, with_row_key
from .merging import BatchMerger

CAPACITY, END_ID, SMALL_SHARE = 4096, 1, 8
#: Numbers of groups tried; the plan with the fewest sequences is taken.
GROUPS = (12, 16, 24)
#: Pieces, of all lengths, for each part into which those of one length are dealt to be numbered.
DEAL = 1 << 16
#: Words kept by a Python worker (by generations, as many again), and the longest word kept.
CACHE, CACHED_BYTES = 300_000, 40
#: Bytes of text whose words are told apart at once, and words whose ids are laid out at once.
SLICE, EXPANDED = 4 << 20, 1 << 17
#: Fixed value: the pre-tokenization pattern of the word vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of characters below this (Latin and its marks) are lower-cased letter by letter.
PLAIN = "\u0370"


@dataclass
class Bins:
    """count sequences that look alike: slots are (length, how many side by side)."""

    count: int
    used: int = 0
    slots: list[tuple[int, int]] = field(default_factory=list)

    def part(self, count: int, length: int = 0, many: int = 0) -> Bins:
        return Bins(count, self.used + length * many, [*self.slots, *([(length, many)] if many else [])])


def groups_of(lengths: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, cut into at most k groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    out: list[list[tuple[int, int]]] = []
    done, now = 0, []
    for length, n in lengths:
        while n:
            edge = -(-total * (len(out) + 1) // k)
            take = min(n, edge - done)
            if take:
                now.append((length, take))
                done += take
                n -= take
            if done >= edge:
                out.append(now)
                now = []
    return [g for g in [*out, now] if g]


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size occurs in the filling of one sequence that is worth most."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        value = best[c - sizes[fits]] + worth[fits]
        i = int(value.argmax())
        best[c], choice[c] = (value[i], fits[i]) if value[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    out, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= sizes[choice[c]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each: the cutting-stock programme, rounded down."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        new = best_pattern(sizes, worth, capacity)
        if worth @ new <= 1 + 1e-9:
            break
        x, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    x = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-9).astype(np.int64)
    return [(basis[:, i].round().astype(np.int64), int(x[i])) for i in range(k) if x[i]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0]) -> list[Bins]:
    bins = [Bins(n, capacity, [(capacity, 1)]) for length, n in histogram.items() if length == capacity]
    left = {length: n for length, n in histogram.items() if 0 < length < capacity and n}
    large = sorted(((a, n) for a, n in left.items() if a > capacity // SMALL_SHARE), reverse=True)
    opened: list[Bins] = []
    if large:
        dealt = groups_of(large, groups)
        sizes = np.array([g[0][0] for g in dealt])
        demand = np.array([sum(n for _, n in g) for g in dealt], dtype=float)
        # groups that round to one size are one size to the programme
        distinct, which = np.unique(sizes, return_inverse=True)
        queue: list[list[list[int]]] = [[] for _ in distinct]
        for i, g in zip(which, dealt):
            queue[i] += [list(x) for x in g]
        for q in queue:
            q.sort()  # the longest are at the end and go first
        stock = [sum(n for _, n in q) for q in queue]
        for pattern, times in configurations(distinct, np.bincount(which, demand), capacity):
            for i, need in enumerate(pattern):
                times = min(times, stock[i] // need) if need else times
            slots = [i for i, need in enumerate(pattern) for _ in range(need)]
            if not times or not slots:
                continue
            rows: list[list[tuple[int, int]]] = []  # for each slot the actual lengths, in runs
            for i in slots:
                runs, need = [], times
                while need:
                    length, n = queue[i][-1]
                    take = min(n, need)
                    runs.append((length, take))
                    need -= take
                    if take == n:
                        queue[i].pop()
                    else:
                        queue[i][-1][1] -= take
                stock[i] -= times
                rows.append(runs)
            edges = sorted({0, *(int(e) for r in rows for e in np.cumsum([n for _, n in r]))})
            ends = [np.cumsum([n for _, n in r]) for r in rows]
            for a, b in zip(edges, edges[1:]):
                here = [r[int(np.searchsorted(e, a, side="right"))][0] for r, e in zip(rows, ends)]
                opened.append(Bins(b - a, sum(here), [(x, 1) for x in here]))
        for a, _ in large:
            left.pop(a)
        for q in queue:
            for length, n in q:
                left[length] = left.get(length, 0) + n
    return bins + best_fit(opened, left, capacity)


def best_fit(opened: list[Bins], left: dict[int, int], capacity: int) -> list[Bins]:
    """Largest first, each to the sequence with the least room that still takes it."""
    room: dict[int, list[Bins]] = {}
    rooms: list[int] = []
    full: list[Bins] = []

    def put(b: Bins) -> None:
        r = capacity - b.used
        if not r:
            full.append(b)
            return
        if r not in room:
            room[r] = []
            bisect.insort(rooms, r)
        room[r].append(b)

    for b in opened:
        put(b)
    for length, n in sorted(left.items(), reverse=True):
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                b = Bins(-(-n // (capacity // length)))
            else:
                r = rooms[at]
                b = room[r].pop()
                if not room[r]:
                    del room[r], rooms[at]
            many = (capacity - b.used) // length
            whole, rest = divmod(n, many)
            if whole >= b.count:
                put(b.part(b.count, length, many))
                n -= b.count * many
                continue
            for part in (b.part(whole, length, many), b.part(1 if rest else 0, length, rest), b.part(b.count - whole - (rest > 0))):
                if part.count:
                    put(part)
            n = 0
    return full + [b for r in rooms for b in room[r]]


def places(bins: list[Bins]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of a run, its first sequence, pieces side by side, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for b in bins:
        offset = 0
        for length, many in b.slots:
            start = ranks.get(length, 0)
            runs.setdefault(length, []).append((start, sequence, many, offset))
            ranks[length] = start + b.count * many
            offset += length * many
        sequence += b.count
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for length, r in runs.items()}


class WordIds:
    """Ids of a vocabulary whose pre-tokenization drops white space, so that the ids of a text are
    those of its words one after another. Words are kept; new ones below PLAIN are merged here by the
    file's ranks (see merging.py), all others are encoded by the library."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = RankBpe(path)
        self.batch = BatchMerger(self.ranks)
        self.pattern = regex.compile(WORD_PATTERN)
        self.ascii_pattern = re.compile(WORD_PATTERN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").encode())
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _parts(self, word: bytes) -> list[bytes] | None:
        """The parts that merges don't cross; None where the library must see the word."""
        if word.isalpha():  # ASCII letters only
            return [word.lower()]
        if word.isascii() and b"<|" not in word:
            return self.ascii_pattern.findall(word.lower())
        text = word.decode("utf-8", "replace")
        if max(text) >= PLAIN or "<|" in text or not unicodedata.is_normalized("NFC", text):
            return None
        return [p.encode() for p in self.pattern.findall(text.lower())]

    def known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, little-endian unsigned 32-bit."""
        got = list(map(self.new.get, words))
        gaps = [i for i, g in enumerate(got) if g is None]
        cut: list[tuple[int, list[bytes]]] = []
        need: dict[bytes, bytes] = {}
        for i in gaps:
            word = words[i]
            ids = self.old.get(word)
            if ids is None:
                parts = self._parts(word)
                if parts is None:
                    ids = np.array(self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
                else:
                    cut.append((i, parts))
                    need.update((p, b"") for p in parts if p not in self.new)
                    continue
            got[i] = ids
        short = [p for p in need if len(p) <= SHORT]
        need.update(zip(short, self.batch.merge(short)))
        for p in need:
            if len(p) > SHORT:
                need[p] = np.array(self.ranks.merge(p), dtype="<u4").tobytes()
        for i, parts in cut:
            got[i] = b"".join([need[p] if p in need else self.new[p] for p in parts])
        if len(self.new) + len(gaps) > CACHE:
            self.old, self.new = self.new, {}
        self.new.update((words[i], got[i]) for i in gaps if len(words[i]) <= CACHED_BYTES)
        return got

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Words are cut and told apart for the whole column, so that each
        distinct word is looked up once; ids are laid out for texts of about EXPANDED words (or one
        text) at a time. Null is the empty text."""
        raw = pc.fill_null(column, "")
        # The library lower-cases after composing; A-Z may be lowered first unless a combining mark
        # (lead byte CC) or the text of a special token is about.
        binary = raw.cast(pa.binary())
        odd = pc.or_(pc.match_substring(binary, b"\xcc"), pc.match_substring(binary, b"<|"))
        cut = pc.ascii_split_whitespace(pc.if_else(odd, raw, pc.ascii_lower(raw)))
        del raw, binary, odd
        ends = cut.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = cut.flatten().dictionary_encode()
        del cut
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        found = self.known(list(utf8_rows(coded.dictionary)))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        begin = np.cumsum(size) - size
        indices = coded.indices.to_numpy()
        del found, coded
        part = ends[:-1] // EXPANDED
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:]):
            which = indices[ends[a] : ends[b]]
            many = size[which]
            done = np.concatenate(([0], np.cumsum(many)))
            ids = pool[np.arange(done[-1]) + np.repeat(begin[which] - done[:-1], many)]
            upto = done[ends[a : b + 1] - ends[a]].tolist()
            yield from (ids[x:y] for x, y in zip(upto, upto[1:]))

    def ids(self, text: bytes) -> bytes:
        return next(self.texts(pa.array([text.decode("utf-8", "replace")]))).tobytes()


_loaded: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """rid, key, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) for each
    piece of each row. A row's ids end with end_id; only rows over capacity are cut."""
    rows = with_row_key(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordIds(path)
        end = np.array([end_id], dtype="<u4")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for whole in batches:
            for b in sliced(whole, "_text", SLICE):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i, ids in enumerate(_loaded[path].texts(b.column("_text"))):
                    ids = np.append(ids, end)
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        for o, v in zip(out, (i, n, start, len(cut), zlib.crc32(cut), cut.tobytes() if with_ids else None)):
                            o.append(v)
                where, *columns = [pa.array(o, k) for o, k in zip(out, kinds)][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([b.column("rid").take(where), b.column("_key").take(where), *columns], ["rid", "_key", "piece", "start", "length", "ids_crc32", "ids"][: 6 + with_ids])

    schema = f"rid long, _key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return mapped(rows, run, schema).withColumnRenamed("_key", key)


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[Bins]:
    return min((plan(dict(histogram), capacity, k) for k in groups), key=lambda bins: sum(b.count for b in bins))


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """cut (rid, piece, length and any other columns) with sequence_id and offset. Only the counts of
    each length, `capacity` rows at most, reach the driver."""
    cut = stored(cut, "pieces")
    cut = cut.withColumn("_deal", F.pmod(F.xxhash64("rid", "piece"), F.lit(16 + cut.count() // DEAL)))
    counts = stored(cut.groupBy("length", "_deal").agg(F.count("*").alias("_n")), "lengths")
    found = places(best_plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}, capacity, groups))
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_deal", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_deal").orderBy("rid", "piece")))
    ranked = ranked.join(base, ["length", "_deal"]).withColumn("_rank", F.col("_rank") + F.col("_base") - 1).drop("_deal", "_base")
    kept = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.empty(len(b), dtype=np.int64), np.empty(len(b), dtype=np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                start, first, many, at = found[int(x)]
                run_of = np.searchsorted(start, rank[here], side="right") - 1
                q, r = np.divmod(rank[here] - start[run_of], many[run_of])
                sequence[here], offset[here] = first[run_of] + q, at[run_of] + r * x
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = T.StructType([ranked.schema[c] for c in kept]).add("sequence_id", "long").add("offset", "long")
    return mapped(ranked, run, schema)


def pack_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: rid, key, piece, start, length, ids_crc32, (ids), sequence_id, offset.

    Null counts as the empty text, which is one piece of the end id. Repeated rows are packed each.
    An empty table gives no rows. Very long texts become many pieces. Other columns are ignored.
    """
    return pack(pieces(docs, path, text, key, capacity, end_id, with_ids), capacity)
