"""Line deduplication by pairwise alignment.

Overlapping documents are found through shared line hashes. A hash of a line takes in the words around
it: a line of MIN_WORDS words or more stands alone, a shorter one comes with half of the words that it
lacks before it and, as a second hash, with half after it. A run of MIN_WORDS words that two texts share
therefore has one of the two hashes in common for each whole line in it, while common short lines alone
lead nowhere. Most hashes occur in one text only and end there.

For the lines that are left, all runs of exactly MIN_WORDS words that hold the line whole are hashed.
Each leads to the first document that has the run, so a line that stands in such a run of any earlier
document finds a partner whose text holds it in a run of MIN_WORDS words too, however many documents
share the passage: rare lines need no cut-off and common ones no sampling.

Each pair is then aligned by patience diff. Aligned lines that follow each other in both texts are a
block. A block of MIN_WORDS words goes from the later document; of a smaller one those lines go that
stand in a shared run of MIN_WORDS words with the partial lines around them. What was found for the
pair and is left by the alignment, because it was moved or repeated, is aligned again until nothing is
left. In the end a line is gone if and only if it stands whole in a run of MIN_WORDS words or more that
an earlier document has too, with line ends at the same words.

Texts with the same lines are one text to all this: the first stays, the lines of the others go.
"Earlier" is by key (null last), then by row key. Lines are compared by their words; blank lines neither
match nor go. Only whole lines are taken out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mapped, scannable, sliced, stored, text_or_empty, unused, utf8_rows, with_row_key

MIN_WORDS = 50
_STEP, _MARK = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1 and so on, n at least, as 64-bit numbers."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 12), base, dtype=np.uint64))))
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MARK
    return x ^ (x >> np.uint64(29))


class Sketch:
    """The lines of a text that aren't blank: places, sizes in words, and hashes of runs of words. A run's hash
    tells where lines begin in it, but not whether one begins at its first word."""

    def __init__(self, text: bytes) -> None:
        lines = [x.split() for x in text.split(b"\n")]
        sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        self.pos = np.flatnonzero(sizes)
        self.size = sizes[self.pos]
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.total = n = int(self.size.sum())
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, [w for x in lines for w in x]), dtype=np.uint64, count=n)
        self.first = np.zeros(n + 1, dtype=np.uint64)
        self.first[self.start] = _MARK
        self.upto = np.concatenate(([np.uint64(0)], np.cumsum((self.words + self.first[:n]) * _power(_STEP, n)[:n])))

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hashes of the runs of words from a to b."""
        back = _power(pow(_STEP, -1, 1 << 64), self.total + 1)
        return _mixed((self.upto[b] - self.upto[a]) * back[a] - self.first[a])

    def lines(self) -> np.ndarray:
        return self.runs(self.start, self.end)

    def seeds(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of lines with the words around them, and the number of each one's line."""
        part = -(-np.maximum(least - self.size, 0) // 2)
        a, b = self.start - part, self.end + part
        alone = np.flatnonzero(part == 0)
        left, right = np.flatnonzero((part > 0) & (a >= 0)), np.flatnonzero((part > 0) & (b <= self.total))
        made = [self.runs(self.start[alone], self.end[alone]), _mixed(self.runs(a[left], self.end[left]) + np.uint64(1)), _mixed(self.runs(self.start[right], b[right]) + np.uint64(2))]
        return np.concatenate(made), np.concatenate([alone, left, right])

    def edges(self, least: int) -> tuple[list[bytes], list[bytes]]:
        """For each line shorter than least the words before and after it, as many as it lacks: four
        bytes for each, of which the lowest bit says that a line begins there."""
        small = (self.words.astype("<u4") & np.uint32(0xFFFFFFFE)) | (self.first[: self.total] > 0).astype("<u4")
        held, before, after = small.tobytes(), [], []
        for s, e, n in zip(self.start.tolist(), self.end.tolist(), self.size.tolist()):
            lack = 4 * max(0, least - n)
            before.append(held[max(0, 4 * s - lack) : 4 * s])
            after.append(held[4 * e : 4 * e + lack])
        return before, after


def windows(line: int, size: int, before: bytes, after: bytes, least: int) -> np.ndarray:
    """Hashes of all runs of least words that hold a line (its hash and size) whole; of the line alone if
    it has as many. They tell where in the run the line stands."""
    lack = least - size
    if lack <= 0:
        return np.array([line], dtype=np.uint64)
    b, a = np.frombuffer(before, dtype="<u4")[::-1].astype(np.uint64), np.frombuffer(after, dtype="<u4").astype(np.uint64)
    power = _power(_STEP, least + 2)
    at = np.arange(max(0, lack - len(a)), min(lack, len(b)) + 1)
    # the run's first word is taken without its mark
    inner = np.concatenate(([np.uint64(0)], np.cumsum(b * power[1 : len(b) + 1])))
    left = np.concatenate(([np.uint64(0)], inner[:-1] + (b & np.uint64(0xFFFFFFFE)) * power[1 : len(b) + 1]))
    right = np.concatenate(([np.uint64(0)], np.cumsum(a * power[1 : len(a) + 1])))
    return _mixed(_mixed(left[at] + at.astype(np.uint64)) + _mixed(right[lack - at]) * _MARK + np.uint64(line))


def sketch_table(rows: DataFrame, least: int) -> DataFrame:
    """rows: rid, _key, _text. One row for each text of least words or more; others can share no run."""
    kind = rows.schema["_key"].dataType.simpleString()
    names = ["a", "b", "pos", "line", "size", "seed", "nth", "before", "after"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "_text"):
                at, out = [], tuple([] for _ in names)
                for i, text in enumerate(utf8_rows(batch.column("_text"))):
                    if len(text) < 2 * least - 1 or (s := Sketch(text)).total < least:
                        continue
                    lines = s.lines()
                    seed, nth = s.seeds(least)
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(lines.tobytes()), dtype="<i8").tolist()
                    at.append(i)
                    for o, v in zip(out, (a, b, s.pos, lines.view(np.int64), s.size, seed.view(np.int64), nth, *s.edges(least))):
                        o.append(v)
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(where), batch.column("_key").take(where), *[pa.array(o, k) for o, k in zip(out, kinds)]], ["rid", "_key", *names])

    return mapped(rows.select("rid", "_key", "_text"), run, f"rid long, _key {kind}, a long, b long, pos array<int>, line array<long>, size array<int>, seed array<long>, nth array<int>, before array<binary>, after array<binary>")


def window_table(wanted: DataFrame, least: int) -> DataFrame:
    """wanted: rid, _key, line, size, before, after and places (numbers of lines). A row for each of
    the windows() of these lines: rid, _key, nth, w."""
    kind = wanted.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("line", "size", "before", "after", "places")]
            at, nth, found = [], [], []
            for i, (line, size, before, after, places) in enumerate(zip(*columns)):
                for p in places:
                    made = windows(line[p] % (1 << 64), size[p], before[p], after[p], least).view(np.int64)
                    at.append(np.full(len(made), i))
                    nth.append(np.full(len(made), p, dtype=np.int32))
                    found.append(made)
            if not at:
                continue
            where = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([b.column("rid").take(where), b.column("_key").take(where), pa.array(np.concatenate(nth)), pa.array(np.concatenate(found))], ["rid", "_key", "nth", "w"])

    return mapped(wanted.select("rid", "_key", "line", "size", "before", "after", "places"), run, f"rid long, _key {kind}, nth int, w long")


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest increasing run of values: the piles of patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        p = bisect.bisect_left(tops, v)
        before.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(mine: list[int], theirs: list[int]) -> list[tuple[int, int]]:
    """Places of aligned lines in both, in order.

    Common beginnings and ends are aligned; between them the lines that occur once on either side, by
    their longest common order, or where there are none the k-th of equal lines with the k-th; then
    the same anew in each gap.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(mine), 0, len(theirs))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and mine[a] == theirs[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and mine[b - 1] == theirs[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        here: dict[int, list[int]] = {}
        there: dict[int, list[int]] = {}
        for places, lines, x, y in ((here, mine, a, b), (there, theirs, c, d)):
            for i in range(x, y):
                places.setdefault(lines[i], []).append(i)
        both = [x for x in here if x in there]
        once = [x for x in both if len(here[x]) == len(there[x]) == 1]
        pairs = sorted(p for x in (once or both) for p in zip(here[x], there[x]))
        fixed = [pairs[i] for i in longest_rise([p[1] for p in pairs])]
        if fixed:
            out += fixed
            gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip([(a - 1, c - 1), *fixed], [*fixed, (b, d)])]
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """The places in the first text of aligned lines that follow each other in both."""
    out: list[list[int]] = []
    last = None
    for i, j in pairs:
        if last != (i - 1, j - 1):
            out.append([])
        out[-1].append(i)
        last = (i, j)
    return out


def gone(mine: list[int], size: list[int], theirs: list[int], sure: set[int], least: int) -> list[int]:
    """The numbers of the lines of mine that go. sure are those that stand in a run of least words that
    theirs has too; they go once they are aligned."""
    out: set[int] = set()
    held = set(theirs)
    left = [i for i, line in enumerate(mine) if line in held]
    while left:
        found = [(left[i], j) for i, j in patience([mine[i] for i in left], theirs)]
        now: set[int] = set()
        for block in blocks(found):
            now.update(block if sum(size[i] for i in block) >= least else [i for i in block if i in sure])
        out |= now
        said = {mine[i] for i in now}
        # from here on only what was found for the pair and isn't aligned yet; repeats go with the first
        left = [i for i in left if i in sure and i not in out]
        again = {i for i in left if mine[i] in said}
        out |= again
        left = [i for i in left if i not in again]
    return sorted(out)


def aligned(pairs: DataFrame, least: int) -> DataFrame:
    """pairs: rid, partner_key, pos, line, size, theirs, sure. rid, partner_key and removed (places)."""
    kind = pairs.schema["partner_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("pos", "line", "size", "theirs", "sure")]
            found = [[pos[i] for i in gone(mine, size, theirs, set(sure), least)] for pos, mine, size, theirs, sure in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("partner_key"), pa.array(found, pa.list_(pa.int32()))], ["rid", "partner_key", "removed"])

    return mapped(pairs.select("rid", "partner_key", "pos", "line", "size", "theirs", "sure"), run, f"rid long, partner_key {kind}, removed array<int>")


def removals(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """rid, removed (places of lines that go, ascending) and partners (keys of the earlier documents),
    for the rows that lose lines. Stored; rid is that of with_row_key() on scannable docs."""
    rows = with_row_key(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    made = stored(sketch_table(rows, min_words), "sketches")
    n_docs, n_seeds = made.agg(F.count("*"), F.coalesce(F.sum(F.size("seed")), F.lit(0))).first()
    order = F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("key"), F.col("rid").alias("rid"))
    # rows with the same lines
    first = made.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = stored(made.select("rid", "a", "b", "pos").join(first, ["a", "b"]).where(F.col("first.rid") != F.col("rid")).select("rid", F.col("first.key").alias("partner_key"), F.col("pos").alias("removed")), "copies", n_docs)
    # lines whose hashes occur in different texts
    seeds = made.select("rid", "a", F.inline(F.arrays_zip("seed", "nth")))
    shared = stored(seeds.groupBy("seed").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("seed"), "shared", n_seeds)
    lines = seeds.join(shared, "seed").select("rid", "nth").join(copies.select("rid"), "rid", "left_anti")
    # what is wanted grows with the corpus: the plans are the same at every size
    wanted = lines.groupBy("rid").agg(F.collect_set("nth").alias("places"))
    held = stored(window_table(made.select("rid", "_key", "line", "size", "before", "after").join(wanted.hint("merge"), "rid"), min_words), "windows")
    heads = stored(held.groupBy("w").agg(F.min(order).alias("first"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("w", "first"), "heads", held.count())
    hits = held.join(heads.hint("merge"), "w").where(F.col("first.rid") != F.col("rid"))
    found = hits.groupBy("rid", F.col("first.rid").alias("partner"), F.col("first.key").alias("partner_key")).agg(F.collect_set("nth").alias("sure"))
    theirs = made.select(F.col("rid").alias("partner"), F.col("line").alias("theirs"))
    pairs = found.join(made.select("rid", "pos", "line", "size").hint("merge"), "rid").join(theirs.hint("merge"), "partner")
    each = aligned(pairs, min_words).where(F.size("removed") > 0).unionByName(copies)
    out = stored(each.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"), F.array_sort(F.collect_list("partner_key")).alias("partners")), "removals", n_docs)
    dropped(made, copies, shared, held, heads)
    return out


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, found: str = "_dedup") -> DataFrame:
    """docs with the text that is left, and as its last column a struct of n_lines, removed (places of
    lines, ascending) and partners (keys of the earlier documents, ascending). One row for each input
    row, all columns kept. The last column is named found, with underscores before it if docs has such
    a column.

    Null text stays null and has no lines; empty and blank texts stay. Texts under min_words words and
    an empty table lose nothing. Very long texts are compared whole. Of rows with equal texts of
    min_words words or more the first stays, whatever their keys; a row whose lines all go has the
    empty text, or its blank lines.
    """
    docs = scannable(docs)
    rid, name = unused(docs, "_rid"), unused(docs, found)
    gone_ = removals(docs, text, key, min_words)
    own = gone_.select(F.col("rid").alias(rid), F.struct("removed", "partners").alias(name))
    rows = with_row_key(docs, rid)
    lines = F.split(text_or_empty(text), "\n")
    at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(f"`{name}`.removed"))
    left = F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")
    blank = F.col(text).isNull() | (F.col(text) == "")
    removed = F.coalesce(F.col(f"`{name}`.removed"), F.array().cast("array<int>"))
    partners = F.coalesce(F.col(f"`{name}`.partners"), F.array().cast(gone_.schema["partners"].dataType))
    n_lines = F.when(blank, 0).otherwise(F.size(lines)).cast("long")
    return (
        rows.join(own.hint("merge"), rid, "left")
        .select(
            *[F.when(F.col(f"`{name}`").isNotNull(), left).otherwise(F.col(c)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
            F.struct(n_lines.alias("n_lines"), removed.alias("removed"), partners.alias("partners")).alias(name),
        )
    )
