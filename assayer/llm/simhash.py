"""SimHash near-deduplication through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most r bits agree in at least 8 - r bytes at the
same positions. Postings of single bytes would be 1/256 of all fingerprints long, so the index posts
triples of positions instead: POSITIONS is the smallest family of triples of which every four
positions contain one, so each pair with four shared positional bytes meets under some triple. There
the shared bytes are tallied, pairs under the guaranteed count are dropped, and the rest are verified
by their differing bits.

Equal fingerprints are one entry. Of the links under a triple only a star over each linked set is
kept, never the pairs themselves. Entries of a triple with more than CELL of them are posted again
under that triple and each other position: two with four bytes in common meet there, in postings that
are 1/256 as long. What is still longer is dealt into blocks and each pair of blocks becomes a cell, so
that no task holds an unbounded group and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mapped, stored, utf8_rows, with_row_key
from .components import components

SEED, WORDS, RADIUS = 42, 4, 4
#: Entries of one triple that a task compares at most, and rows gathered before they are compared.
CELL, GATHER = 2048, 65536
_SLICE = 65536


def position_triples() -> list[tuple[int, ...]]:
    """Triples of 0..7 such that any four positions contain one (Turan's construction, 20 triples):
    three classes; triples inside a class, and two of a class with one of the next."""
    group = {p: p % 3 for p in range(8)}
    out = []
    for t in combinations(range(8), 3):
        g = [group[p] for p in t]
        if len(set(g)) == 1 or any(g.count(k) == 2 and (k + 1) % 3 in g for k in range(3)):
            out.append(t)
    return out


POSITIONS = position_triples()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, lowest first."""
    held = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(held, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The number whose bits are those that over half of n hashes have."""
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits; bit i is 1 if it is set in over half of the shingles' hashes. No word: 0."""
    seen = text.lower().split()
    if not seen:
        return 0
    if len(seen) <= words:
        return xxhash.xxh64_intdigest(b" ".join(seen), SEED)
    joined, digest = b" ".join(seen), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, seen), dtype=np.int64, count=len(seen)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(seen) - words + 1], ends[words - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(first), _SLICE):
        a, b = first[i : i + _SLICE].tolist(), last[i : i + _SLICE].tolist()
        ones += bit_counts(np.array([digest(joined[x:y], SEED) for x, y in zip(a, b)], dtype="<u8"))
    return majority(ones, len(first))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """rid, key and fp, a signed 64-bit number, for each row."""
    narrow = with_row_key(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in utf8_rows(b.column("_text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("_key"), pa.array(fp)], ["rid", "_key", "fp"])

    kind = narrow.schema["_key"].dataType.simpleString()
    return mapped(narrow, run, f"rid long, _key {kind}, fp long")


def _posting(triple: tuple[int, ...], which: int) -> Column:
    key = F.lit(which).cast("long")
    for p in triple:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftright(F.col("fp"), 8 * p).bitwiseAND(F.lit(255)))
    return key


def stars(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between entries of the same cell, as (entry, smallest entry linked to it). cell is
    sorted; the s-th step compares each entry with the one s places on."""
    parent = np.arange(len(cell))
    bits, alive, step = fp.view(np.uint64), np.arange(len(cell)), 1

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            x = parent[up]

    while True:
        alive = alive[alive + step < len(cell)]
        alive = alive[cell[alive] == cell[alive + step]]
        if not len(alive):
            break
        xor = bits[alive] ^ bits[alive + step]
        shared = (xor.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of positional bytes
        maybe = shared >= 8 - radius
        linked = alive[maybe][np.bitwise_count(xor[maybe]) <= radius]
        if len(linked):
            a, b = roots(linked), roots(linked + step)
            for x, y in zip(a[a != b].tolist(), b[a != b].tolist()):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    lo, hi = (x, y) if fp[x] < fp[y] else (y, x)
                    parent[hi] = lo
        step += 1
    top = roots(np.arange(len(cell)))
    child = np.flatnonzero(top != np.arange(len(cell)))
    return fp[child], fp[top[child]]


def in_cells(posts: DataFrame, compare: Callable[[dict[str, pa.Array], np.ndarray], tuple[np.ndarray, np.ndarray]], cell: int = CELL, gather: int = GATHER) -> DataFrame:
    """child, parent: what compare finds among the entries of each posting. posts: post (long), id (long)
    and any other columns. compare gets columns sorted by their cell, and the cells, of whole cells with
    gather rows or little more.

    Postings of more than cell entries are dealt into blocks by id, and each pair of blocks is a cell of
    its own, so that no task holds an unbounded group and any two entries meet."""
    large = stored(posts.groupBy("post").count().where(F.col("count") > cell), "large")
    kept = [c for c in posts.columns if c != "post"]
    if large.isEmpty():
        cells = posts.withColumnRenamed("post", "cell")
    else:
        sized = posts.join(large, "post", "left").withColumn("blocks", F.ceil(F.coalesce("count", F.lit(1)) / cell).cast("int"))
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        dealt = sized.select(*kept, "post", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
        # a clash of these hashes only adds comparisons
        cells = dealt.select(F.xxhash64("post", F.least("b", "c"), F.greatest("b", "c")).alias("cell"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: pa.Table) -> pa.RecordBatch:
            held = {c: part.column(c).combine_chunks() for c in kept}
            child, parent = compare(held, part.column("cell").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(parent, pa.int64())], ["child", "parent"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= gather:
                whole = pa.Table.from_batches(held)
                c = whole.column("cell").to_numpy()
                cut = int(np.searchsorted(c, c[-1]))  # the last cell may go on
                if cut:
                    yield edges(whole.slice(0, cut))
                held, rows = whole.slice(cut).to_batches(), len(c) - cut
        if rows:
            yield edges(pa.Table.from_batches(held))

    sorted_ = cells.select("cell", *kept).repartition("cell").sortWithinPartitions("cell")
    return mapped(sorted_, run, "child long, parent long")


def links(entries: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """child, parent (parent < child): edges whose components are those of all pairs of distinct
    fingerprints (column fp) with at most radius differing bits. radius is 4 at most."""
    if radius > 4:
        raise ValueError("four shared positional bytes are guaranteed up to 4 differing bits")
    keys = F.array(*[_posting(t, i) for i, t in enumerate(POSITIONS)])
    posts = entries.select("fp", F.posexplode(keys).alias("which", "post"))
    hot = stored(posts.groupBy("post").count().where(F.col("count") > cell).select("post"), "hot")
    if hot.isEmpty():
        posts = posts.select(F.col("fp").alias("id"), "post")
    else:
        others = [F.array(*[_posting((*t, p), 64 + 8 * i + p) for p in range(8) if p not in t]) for i, t in enumerate(POSITIONS)]
        more = F.explode(F.element_at(F.array(*others), F.col("which") + 1)).alias("post")
        split = posts.join(hot, "post", "left_semi").select(F.col("fp").alias("id"), more)
        posts = posts.join(hot, "post", "left_anti").select(F.col("fp").alias("id"), "post").unionByName(split)
    return in_cells(posts, lambda held, cells: stars(cells, held["id"].to_numpy(), radius), cell)


def simhash_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row for each input row: rid, key, fp, root (the group's smallest fingerprint) and
    component_id, the smallest key of the group.

    Rows are in one group if a chain of fingerprints, each at most radius bits from the next, joins
    them. A-Z are lower-cased; words are runs without space, tab or line control; texts with fewer
    words than a shingle are one shingle; null and wordless texts have fingerprint 0 and are linked
    like any other. Null keys are skipped for component_id, which is null if the group has no other.
    Repeated rows are rows of one group. Very long texts are hashed whole, in slices; an empty table
    gives no rows. Other columns are ignored.
    """
    rows = stored(fingerprints(docs, text, key, words), "fingerprints")
    n = rows.count()
    entries = stored(rows.groupBy("fp").agg(F.min("_key").alias("least")), "entries", n)
    tree = components(links(entries, radius))
    rooted = stored(entries.join(tree.withColumnRenamed("child", "fp"), "fp", "left").withColumn("root", F.coalesce("parent", "fp")), "rooted", n)
    tops = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "tops", n)
    labels = stored(rooted.join(tops, "root").select("fp", "root", "component_id"), "labels", n)
    dropped(entries, tree, rooted, tops)
    return rows.join(labels, "fp").select("rid", F.col("_key").alias(key), "fp", "root", "component_id")
