import random
from itertools import combinations

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from assayer.llm import shingles


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def plain_roots(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[top(j)] = top(i)
    return [top(i) for i in range(len(texts))]


def near_copies():
    rng, texts = random.Random(5), [None, "", "a b", "A  b"]
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(1, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99999)}"
            texts.append(" ".join(w))
    return texts


def test_groups_against_all_pairs(spark):
    texts = near_copies()
    want = plain_roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in shingles.shingle_groups(docs).collect()}
    labels = [got[i] for i in range(len(texts))]
    assert len(set(zip(labels, want))) == len(set(labels)) == len(set(want)) < len(texts) - 20


def test_what_one_entry_doesn_t_settle(spark, monkeypatch):
    """Two chains of near copies with a common passage: their bands are shared by texts that aren't
    linked, so that entries are compared in cells, and those are dealt into blocks."""
    rng, texts = random.Random(6), []
    common = [f"c{i}" for i in range(300)]
    for chain in range(6):
        own = [f"o{chain}_{i}" for i in range(100)]
        for _ in range(8):
            for _ in range(6):
                own[rng.randrange(100)] = f"z{rng.randrange(99999)}"
            texts.append(" ".join([*common, *own]))
    seen = []
    real = shingles.in_cells
    monkeypatch.setattr(shingles, "in_cells", lambda posts, *a: seen.append(posts.count()) or real(posts, *a))
    want = plain_roots(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in shingles.shingle_groups(docs, cell=4).collect()}
    labels = [got[i] for i in range(len(texts))]
    assert len(set(zip(labels, want))) == len(set(labels)) == len(set(want)) > 1
    assert seen and seen[0] > 20


def test_tallied_pairs_against_plain_loops():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (4, 96), dtype=np.uint8)
    places = base[rng.integers(0, 4, 60)]
    places[rng.random(places.shape) < 0.3] = 7
    cells, ids = np.sort(rng.integers(0, 5, 60)), rng.permutation(60)
    n, label = rng.integers(80, 120, 60), rng.integers(0, 9, 60)
    bins = rng.integers(0, 3, (60, shingles.BINS), dtype=np.uint8)
    bands = rng.integers(1000, 1 << 60, (60, shingles.BANDS))
    bands[:, 3], bands[:12, 1] = cells, 777  # some meet in an earlier band too
    bins[:50] = bins[0]
    held = {"id": pa.array(ids), "n": pa.array(n), "label": pa.array(label), "places": pa.array([p.tobytes() for p in places], pa.binary()), "finer": pa.array([p.tobytes() for p in bins], pa.binary())}
    held |= {"band": pa.array(cells), "bands": pa.array(list(bands), pa.list_(pa.int64()))}
    nearly = lambda x, y: sum(a == b > 0 for a, b in zip(x.tolist(), y.tolist())) >= shingles.NEARLY * sum(a > 0 or b > 0 for a, b in zip(x.tolist(), y.tolist()))
    child, parent = shingles.tallied(held, cells)
    want = {
        (max(ids[i], ids[j]), min(ids[i], ids[j]))
        for i, j in combinations(range(60), 2)
        if cells[i] == cells[j] and label[i] != label[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and sum(x == y for x, y in zip(places[i], places[j])) >= shingles.MATCHES and nearly(bins[i], bins[j]) and j >= 12
    }
    assert set(zip(child, parent)) == want and len(want) > 5


def test_finer_bytes_are_close_to_the_similarity():
    rng = np.random.default_rng(4)
    for n in (20, 150, 1000, 20_000):
        for _ in range(20):
            common, own = rng.integers(0, 1 << 64, n, dtype=np.uint64), [rng.integers(0, 1 << 64, n // 8, dtype=np.uint64) for _ in range(2)]
            x, y = (np.frombuffer(shingles.finer(np.unique(np.concatenate([common, o]))), dtype=np.uint8) for o in own)
            share = ((x == y) & (x > 0)).sum() / ((x > 0) | (y > 0)).sum()
            assert abs(share - n / (n + 2 * (n // 8))) < 0.07 and share >= shingles.NEARLY


def test_odd_rows(odd, none, odd_rows):
    assert shingles.shingle_groups(odd).count() == len(odd_rows) and shingles.shingle_groups(none).count() == 0


def test_stage_takes_out_a_copy_beyond_four_bits(spark):
    w = [f"w{i}" for i in range(120)]
    copy = [*w[:40], "x", *w[41:80], "y", *w[81:]]
    far = [f"x{i}" if i % 20 == 10 else x for i, x in enumerate(w)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((w, copy, far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_simhash_pairs_against_all_pairs(spark):
    texts, rng = near_copies(), random.Random(7)
    long = [f"w{i}" for i in range(600)]
    texts += [" ".join([*long[:i], "x", *long[i + 1 :]]) for i in rng.sample(range(600), 12)]
    sets = [shingles.shingle_set((t or "").encode(), 5) for t in texts]
    plain = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s.tolist()) > len(s)) for s in sets]
    assert [shingles.set_fingerprint(s) % (1 << 64) for s in sets] == plain
    rows = [(i, shingles.set_fingerprint(s)) for i, s in enumerate(sets)]
    for cell in (2048, 4):
        pairs = shingles.simhash_pairs(spark.createDataFrame(rows, "sid long, fp long"), len(rows), cell=cell).collect()
        got, want = list(range(len(rows))), list(range(len(rows)))
        near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (plain[i] ^ plain[j]).bit_count() <= 4]
        for root, edges in ((got, [(r["parent"], r["child"]) for r in pairs]), (want, near)):
            for _ in range(len(rows)):
                for i, j in edges:
                    root[i] = root[j] = min(root[i], root[j])
        assert got == want and len(set(got)) < len(rows) - 12
        assert all(r["parent"] < r["child"] for r in pairs)


def test_stage_links_by_simhash_fingerprints(spark, monkeypatch):
    """Without any posting of min-hashes, near copies of four bits or fewer are linked; what SimHash puts
    together at a lower similarity is not."""
    w = [f"w{i}" for i in range(600)]
    copies = [" ".join([*w[:i], "x", *w[i + 1 :]]) for i in (50, 300, 420)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(w), *copies, "other words are here now"])], "doc_id long, text string")
    monkeypatch.setattr(shingles, "signature", lambda hashes: ([], b""))
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == [0, 4]
    monkeypatch.setattr(shingles, "set_fingerprint", lambda hashes: 0)  # all are put together
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == [0, 4]
