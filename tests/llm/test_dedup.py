import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from assayer.llm import components, exact_dedup, simhash
from assayer.llm.common import ascii_lower


def fold(t):
    return (t or "").encode().lower().decode()


def groups_of(rows):
    by = {}
    for i, t in rows:
        by.setdefault(fold(t), []).append(i)
    return by


def test_ascii_lower(spark):
    texts = ["ABCxyz", "ÉÀİΣAŞ", "Ⅷ Ⓐ A", "", "\U0001F600A", "ß ẞ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [fold(t) for t in texts]


def check_exact(got, rows):
    by = groups_of(rows)
    largest = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((i, largest(by[fold(t)]), len(by[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(by)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup(spark, odd, none, odd_rows):
    check_exact(exact_dedup.exact_dedup(odd).collect(), odd_rows)
    assert exact_dedup.exact_dedup(none).count() == 0
    rng, rows = random.Random(1), []
    base = ["".join(rng.choice("ab\nC É") for _ in range(rng.choice([0, 10, 600, 20_000]))) for _ in range(12)]
    for i in range(120):
        t = rng.choice(base)
        rows.append((i, t if i % 3 else t[:-1] + "z" if t else t))
    check_exact(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_chunks_lose_nothing(spark):
    texts = ["", "a\n" * 5000, "x" * 20_000, "ab\n\n\u2028c" * 3000, "one two. " * 3000, "\u4e00\u4e8c" * 9000, "\U0001F600 a\n" * 700]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert ["".join(r["c"]) for r in rows] == texts
    assert all(len(c) <= exact_dedup.MAX_CHUNK for r in rows for c in r["c"])


def test_chunks_fall_into_step_after_an_insertion(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 9)))
    words = [word() for _ in range(8000)]
    texts = [" ".join(words), "".join(words), "".join(w + rng.choice([" "] * 9 + [". ", "\n"]) for w in words), "".join(rng.choice("0123456789") for _ in range(40_000))]
    rows = [(i, j, t[:777] + "inserted"[:j] + t[777:]) for i, t in enumerate(texts) for j in (0, 1, 8)]
    cut = spark.createDataFrame(rows, "i int, j int, t string").select("i", "j", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    own = {(r["i"], r["j"]): r["c"] for r in cut}
    for i in range(len(texts)):
        assert len(own[i, 0]) > 20
        for j in (1, 8):
            assert len(set(own[i, 0]) & set(own[i, j])) > 0.8 * len(own[i, 0]), i


def test_names_that_clash_are_told_apart(spark):
    part = lambda a, n: {"name": 7, "a": a, "b": 1, "n": n}
    rows = [(0, [part(1, 5)]), (1, [part(2, 5)]), (2, [part(1, 5)]), (3, [])]
    df = spark.createDataFrame(rows, "rid long, parts array<struct<name:long,a:long,b:long,n:int>>")
    ids = {r["rid"]: tuple(r["ids"]) for r in exact_dedup.verified(df).collect()}
    assert ids[0] == ids[2] != ids[1] and ids[3] == ()


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def test_triples_cover_every_four_positions():
    assert len(simhash.POSITIONS) == 20
    assert all(any(set(t) <= set(four) for t in simhash.POSITIONS) for four in combinations(range(8), 4))


def test_simhash_groups(spark, odd, none, odd_rows):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    rows = list(odd_rows)
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([3, 4, 40, 300]))]
        rows += [(100 + 3 * i, " ".join(t)), (101 + 3 * i, " ".join([*t[:-1], "z"])), (102 + 3 * i, " ".join([*t, *t, "q"]))]
    docs = odd.unionByName(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"), allowMissingColumns=True)
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    top = plain_components(fps, 4)
    least = {}
    for (i, _), t in zip(rows, top):
        least.setdefault(t, []).append(i)
    want = Counter((i, f, min((x for x in least[t] if x is not None), default=None)) for (i, _), f, t in zip(rows, fps, top))
    got = simhash.simhash_groups(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.simhash_groups(none).count() == 0


def test_links_of_dense_groups_in_blocks(spark):
    """Many fingerprints under one triple: dealt into blocks, no link may be lost."""
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centre for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)})
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), cell=16)
    tree = {r["child"]: r["parent"] for r in components.components(edges).collect()}
    label = [tree.get(f, f) for f in signed]
    top = plain_components(fps, 4)
    assert len(set(zip(label, top))) == len(set(label)) == len(set(top))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(1000 + i, 500) for i in range(30)] + [(1000, 500)]
    got = {r["child"]: r["parent"] for r in components.components(spark.createDataFrame(edges, "child long, parent long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 500 for i in range(30)}
    assert components.components(spark.createDataFrame([], "child long, parent long")).count() == 0
