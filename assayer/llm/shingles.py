"""Near-duplicates by the Jaccard similarity of word-shingle sets, 0.8 or more.

First the method of simhash.py: each set has a SimHash fingerprint, the byte-position index puts
fingerprints of RADIUS differing bits or fewer together after counting shared bytes, and each entry is
verified on the whole sets against the smallest one linked to it. What lies beyond the radius, or was put
together with another than its own neighbour, is left to a wider index, which loses no link of 0.8.

The wider index is the same one, with count filtering, over other bytes: at a similarity of
0.8 two SimHash fingerprints differ in about ten of 64 bits, where shared bytes guarantee nothing, so a
text's positional bytes are those of its min-hashes here, of which two texts share a part that is
their similarity. Candidates meet where ROWS positions agree as a whole, in one of BANDS postings: a pair
of similarity s is missed with probability (1 - s ** ROWS) ** BANDS, 3.2e-6 at 0.8 and less above. Their
shared positional bytes are tallied, pairs with fewer than MATCHES are dropped (at 0.8 a pair falls under
it with probability 1.5e-6), and so are those that share less than NEARLY of the occupied ones among BINS
finer positions (five deviations below 0.8). The rest are verified on the whole sets, so nothing below
0.8 is linked.

Equal sets are one entry. Each entry that SimHash leaves is first compared with one other of its fullest
posting, twice, then the entries of every posting with one of them, with another one each time, for as long as that joins
many; all this is linear. Then those that are not yet in one component are compared with each other in
bounded cells, so no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mapped, sliced, stored, utf8_rows, with_row_key
from .components import components
from .simhash import CELL, RADIUS, bit_counts, in_cells, links, majority

SEED, BANDS, ROWS = 42, 24, 4
#: Shared positional bytes, of BANDS * ROWS, that a pair must have.
MATCHES = 58
#: Finer positions, one byte each, and the share of the occupied ones that a pair must have in common.
BINS, NEARLY = 2048, 0.755
#: Rows with all these bytes that are gathered before they are compared.
GATHER = 16384
#: Rounds with the fullest posting alone; those with every posting go on while they settle this share.
FULLEST, SHARE = 2, 0.2
_SLICE = 4096
_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLUS = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The hashes of the distinct shingles, ascending. Fewer words than a shingle are one shingle."""
    seen = text.lower().split()
    if not seen:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(seen), xxhash.xxh64_intdigest
    if len(seen) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, seen), dtype=np.int64, count=len(seen)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(seen) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[x:y], SEED) for x, y in spans), dtype=np.uint64, count=len(seen) - words + 1))


def signature(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """One signed 64-bit number for each band (none for the empty set), and the positional bytes."""
    if not len(hashes):
        return [], b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), _SLICE):
        np.minimum(least, (hashes[i : i + _SLICE, None] * _TIMES + _PLUS).min(axis=0), out=least)
    numbers = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(numbers, dtype=np.uint64).view(np.int64).tolist(), (least >> np.uint64(56)).astype(np.uint8).tobytes()


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set: the bits that over half of its hashes have, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _SLICE):
        ones += bit_counts(hashes[i : i + _SLICE])
    found = majority(ones, len(hashes))
    return found - (found >> 63 << 64)


def finer(hashes: np.ndarray) -> bytes:
    """A byte for each of BINS parts of the shingles: of the least hash in it, 0 if there is none."""
    part, first = np.unique(hashes % np.uint64(BINS), return_index=True)
    out = np.zeros(BINS, dtype=np.uint8)
    out[part.astype(np.int64)] = 1 + (hashes[first] >> np.uint64(24)) % np.uint64(255)
    return out.tobytes()


def finer_table(sets: DataFrame) -> DataFrame:
    """sets: sid, hashes (ascending as unsigned numbers). sid and finer()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("hashes")
            ends, held = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
            made = [finer(held[x:y]) for x, y in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(made, pa.binary())], ["sid", "finer"])

    return mapped(sets, run, "sid long, finer binary")


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """rows: rid, _key, _text. rid, _key, sid (a hash of the set), n (its size), fp (its SimHash) and its
    signature()."""
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n, fp, found, places = [], [], [], [], []
            for text in utf8_rows(b.column("_text")):
                hashes = shingle_set(text, words)
                sid.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                n.append(len(hashes))
                fp.append(set_fingerprint(hashes))
                numbers, held = signature(hashes)
                found.append(numbers)
                places.append(held)
            columns = [b.column("rid"), b.column("_key"), pa.array(np.array(sid, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "_key", "sid", "n", "fp", "bands", "places"])

    return mapped(rows, run, f"rid long, _key {kind}, sid long, n int, fp long, bands array<long>, places binary")


def whole_sets(rows: DataFrame, words: int) -> DataFrame:
    """rows: sid, _text. sid and all hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(batch, "_text"):
                sets = [shingle_set(text, words).view(np.int64) for text in utf8_rows(b.column("_text"))]
                yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(sets, pa.list_(pa.int64()))], ["sid", "hashes"])

    return mapped(rows.select("sid", "_text"), run, "sid long, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (child, parent) whose sets have a Jaccard similarity of 0.8 or more."""
    a = sets.select(F.col("sid").alias("child"), F.col("hashes").alias("x"))
    b = sets.select(F.col("sid").alias("parent"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    # shared / (x + y - shared) >= 4 / 5, in whole numbers
    return pairs.join(a, "child").join(b, "parent").where(shared * 9 >= (F.size("x") + F.size("y")) * 4).select("child", "parent")


def _pair(one: str, other: str) -> list:
    return [F.greatest(one, other).alias("child"), F.least(one, other).alias("parent")]


def simhash_pairs(entries: DataFrame, n: int, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """entries: sid and fp, n rows. Pairs (child, parent) whose components are those of all entries with
    fingerprints of at most radius differing bits, equal ones included; a star over each linked set."""
    first = stored(entries.groupBy("fp").agg(F.min("sid").alias("first")), "fingerprints", n)
    same = entries.join(first, "fp").where("sid <> first").select(*_pair("sid", "first"))
    edges = links(first.select("fp"), radius, cell)
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in ("child", "parent"))
    apart = edges.join(a, "child").join(b, "parent").select(*_pair("_child", "_parent"))
    found = stored(same.unionByName(apart).distinct(), "simhash")
    dropped(first)
    return found


def tallied(held: dict[str, pa.Array], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries of one cell (id, n, label, band, bands, places, finer) that aren't in one component
    yet, are near enough in size and share enough bytes. Each step compares all with those some places on.
    A pair that meets in several postings is given in the first of its bands alone."""
    ids, n, label = (held[c].to_numpy() for c in ("id", "n", "label"))
    places, bins = (np.frombuffer(b"".join(utf8_rows(held[c])), dtype=np.uint8).reshape(len(ids), -1) for c in ("places", "finer"))
    here, own = held["band"].to_numpy(), held["bands"].flatten().to_numpy().reshape(len(ids), -1)
    out: list[np.ndarray] = []
    alive, step = np.arange(len(ids)), 1
    while True:
        alive = alive[alive + step < len(ids)]
        alive = alive[cells[alive] == cells[alive + step]]
        if not len(alive):
            break
        a = alive[label[alive] != label[alive + step]]
        a = a[np.minimum(n[a], n[a + step]) * 5 >= np.maximum(n[a], n[a + step]) * 4]
        a = a[(places[a] == places[a + step]).sum(axis=1) >= MATCHES]
        first = (own[a] == own[a + step]).argmax(axis=1)
        a = a[own[a, first] == here[a]]
        x, y = bins[a], bins[a + step]
        a = a[((x == y) & (x > 0)).sum(axis=1) >= NEARLY * ((x > 0) | (y > 0)).sum(axis=1)]
        out.append(np.stack([ids[a], ids[a + step]]))
        step += 1
    found = np.concatenate(out, axis=1) if out else np.empty((2, 0), dtype=np.int64)
    return found.max(axis=0), found.min(axis=0)


def shingle_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, cell: int = CELL) -> DataFrame:
    """rid, key and root for each input row; rows are in one group (root) if a chain of texts, each with
    a similarity of 0.8 or more to the next, joins them. A-Z are lower-cased; texts without words, null
    among them, are one group. Null and repeated keys are kept as they are, repeated rows are rows of
    one group, very long texts are compared whole, an empty table gives no rows, and other columns are
    ignored. rid is that of with_row_key() on scannable docs."""
    rows = with_row_key(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")))
    made = stored(sketches(rows, words), "sketches")
    entries = stored(made.groupBy("sid").agg(F.min_by(F.struct("rid", "n", "fp", "bands", "places"), "rid").alias("e")).select("sid", "e.*"), "entries", made.count())
    n_entries = entries.count()
    posts = entries.select("sid", "rid", "n", F.explode("bands").alias("cell"))
    several = posts.groupBy("cell").agg(F.count("*").alias("held")).where("held > 1")
    shared = stored(posts.join(several, "cell"), "shared", BANDS * n_entries)
    close = simhash_pairs(entries.select("sid", "fp"), n_entries, cell=cell)
    paired = close.select(F.explode(F.array("child", "parent")).alias("sid")).distinct()
    members = shared.select("sid", "rid").unionByName(entries.select("sid", "rid").join(paired, "sid", "left_semi"))
    members = stored(members.distinct(), "members", n_entries)
    sets = stored(whole_sets(rows.join(members.hint("merge"), "rid"), words), "sets")
    near = F.least("n", "head.n") * 5 >= F.greatest("n", "head.n") * 4
    cells, tree, unsettled, turn, last = shared.withColumn("label", F.col("sid")), None, shared.count(), -1, False
    while unsettled or turn < 0:
        if last:
            more = sets.join(cells.select("sid").distinct(), "sid", "left_semi")
            bytes_ = stored(entries.select("sid", "places", "bands").join(finer_table(more), "sid").withColumnRenamed("sid", "id"), "bytes", 8 * n_entries)  # wide rows
            posts = cells.select(F.col("cell").alias("post"), F.col("cell").alias("band"), F.col("sid").alias("id"), "n", "label").join(bytes_, "id")
            pairs = in_cells(posts, tallied, cell, GATHER)
        elif turn >= 0:
            some = cells
            if turn < FULLEST:
                some = cells.groupBy("sid", "n", "label").agg(F.max_by("cell", F.struct("held", "cell")).alias("cell"))
            head = some.groupBy("cell").agg(F.min_by(F.struct("sid", "n", "label"), F.xxhash64("sid", F.lit(turn))).alias("head"))
            pairs = some.join(head, "cell").where((F.col("head.label") != F.col("label")) & near).select(*_pair("sid", "head.sid"))
        some = close if turn < 0 else stored(pairs.distinct(), "pairs", None if last else unsettled)
        found = stored(verified(some, sets), "links")
        # the tree has the components of all links so far
        before, tree = tree, components(found if tree is None else tree.unionByName(found))
        dropped(some, found, *([] if before is None else [before]))
        if last:
            break
        labelled = cells.join(tree.withColumnRenamed("child", "sid"), "sid", "left").select("cell", "held", "sid", "n", F.coalesce("parent", "sid").alias("label"))
        labelled = stored(labelled, "labelled", unsettled)
        mixed = labelled.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cell")
        dropped(cells)
        cells = stored(labelled.join(mixed, "cell"), "cells", unsettled)
        dropped(labelled)
        was, unsettled, turn = unsettled, cells.count(), turn + 1
        last = turn > FULLEST and unsettled > (1 - SHARE) * was
    dropped(shared, members, sets, cells, entries)
    roots = made.select("rid", "_key", "sid").join(tree.withColumnRenamed("child", "sid"), "sid", "left").withColumn("root", F.coalesce("parent", "sid"))
    return roots.select("rid", F.col("_key").alias(key), "root")
