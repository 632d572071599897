import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assayer.llm import bpe, lattice, packing, queries

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = " \n\t\r\x0b\x1c\x1f\x85\xa0'sltredvmW aA1,.<|>éÉ中ñ😀̸̊İΣς࢏"


def noise(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 14)))
        yield t + "<|endoftext|>" + t + "<|STARTOFTEXT|>" if i % 7 == 0 else t


def test_rank_bpe_equals_the_library():
    own, library = bpe.RankBpe(BYTE), Tokenizer.from_file(BYTE)
    for t in [*noise(1, 3000), "ab" * 5000, "etaoin" * 3000, "", " ", "  a", "a  b"]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t[:40]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    own = bpe.RankBpe(BYTE)
    for t in ("international", "aaaaaaaaaaaaaaaa", "théière"):
        short = own.merge(t.encode())
        assert own._merge_long([own.start[b] for b in t.encode()]) == short


def test_documents(odd, none, odd_rows):
    library = Tokenizer.from_file(BYTE)
    got = bpe.bpe_documents(odd, BYTE, outputs=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in odd_rows]
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter((i, len(w), tuple(w), t or "") for (i, t), w in zip(odd_rows, want))
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.bpe_documents(none, BYTE).count() == 0


def test_word_ids_equal_the_library():
    own, library = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    texts = [*noise(2, 3000), "", "a" * 3000]
    for t, got in zip(texts, own.texts(pa.array(texts))):
        assert got.tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]


def check_plan(histogram, capacity):
    bins = packing.best_plan(histogram, capacity)
    packed = Counter()
    for b in bins:
        assert b.count > 0 and b.used == sum(x * n for x, n in b.slots) <= capacity
        for x, n in b.slots:
            packed[x] += n * b.count
    assert packed == Counter({k: v for k, v in histogram.items() if v})
    return sum(b.count for b in bins)


def test_plans_hold_everything_and_are_tight():
    rng = random.Random(3)
    for capacity in (16, 100, 512):
        for _ in range(8):
            h = Counter(min(capacity, 1 + int(rng.expovariate(1 / (capacity * rng.choice([0.1, 0.3, 0.5]))))) for _ in range(rng.choice([0, 1, 5, 3000])))
            n, least = check_plan(h, capacity), -(-sum(k * v for k, v in h.items()) // capacity)
            assert n >= least
            if sum(h.values()) == 3000:
                assert n <= 1.06 * least + 2
    assert check_plan({4096: 3, 1: 4096}, 4096) == 4


def fewest(items, capacity):
    """The fewest sequences that hold all items, by trying every way."""
    items = sorted(items, reverse=True)
    best = len(items)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= items[i] and room[j] not in room[:j]:
                put(i + 1, [*room[:j], room[j] - items[i], *room[j + 1 :]])
        put(i + 1, [*room, capacity - items[i]])

    put(0, [])
    return best


def test_plans_against_the_optimum():
    rng, equal = random.Random(8), 0
    for _ in range(150):
        capacity = rng.choice([10, 24, 50])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 12))]
        n, least = check_plan(Counter(items), capacity), fewest(items, capacity)
        assert least <= n <= least + 1
        equal += n == least
    assert equal >= 140


def test_plan_size_does_not_follow_the_corpus():
    rng = random.Random(4)
    h = Counter(rng.randint(1, 500) for _ in range(2000))
    assert len(packing.plan({k: v * 1000 for k, v in h.items()}, 512)) < 4 * 512


def test_packed_documents(odd, none, odd_rows):
    capacity = 64
    rows = packing.pack_documents(odd, WORD, capacity=capacity, with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in odd_rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[at : at + capacity], dtype="<u4").tobytes()
            want[(i, n, at, len(cut) // 4, zlib.crc32(cut))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(none, WORD).count() == 0


def brute(model, word):
    """All segmentations, one by one."""
    s = "▁" + word

    def ways(i):
        if i == len(s):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(s) + 1):
            score = model.trie.get(s[i:j])
            if score is not None:
                total += np.exp(score) * ways(j)
        if model.trie.get(s[i]) is None:
            total += np.exp(sum(model.byte[b] for b in s[i].encode())) * ways(i + 1)
        return total

    return np.log(ways(0))


def test_lattice_sums_all_segmentations():
    size = lattice.Lattice(PIECE).size
    p = np.random.default_rng(0).random(size)
    model = lattice.Lattice(PIECE, np.log(p / p.sum()))
    for w in ("a", "the", "thinking", "été", "x中y", "aaaa"):
        assert model.log_probability(w) == pytest.approx(brute(model, w))
    assert np.isfinite(model.log_probability("ab" * 20_000))


def test_piece_scores_count_the_vocabularys_own_segmentation(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    words = {b"the": 5, "\u00e9t\u00e9".encode(): 2, b"thinking": 3, b"unseen": 0, lattice.END: 7}
    rows = spark.createDataFrame([(bytearray(w), c, c) for w, c in words.items()], "word binary, c long, t long")
    logp, end = lattice.piece_scores(rows, PIECE)
    n = np.ones(model.get_piece_size())
    for w, c in words.items():
        if w != lattice.END:
            for piece in model.encode(w.decode()):
                n[piece] += c
    whole = n.sum() + 7 + 1
    assert np.allclose(logp, np.log(n / whole)) and end == pytest.approx(np.log(8 / whole))


def test_document_scores_against_all_segmentations(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HOT", 4)
    texts = ["the cat sat on the mat", "The CAT x\u4e2dy", "", None, "a a a b thinking", "\u00e9t\u00e9 the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = [[*(t or "").encode().lower().split(), lattice.END] for t in texts]
    seen = Counter(w for i in trained for w in tokens[i])
    logp, end = lattice.piece_scores(spark.createDataFrame([(bytearray(w), c, c) for w, c in seen.items()], "word binary, c long, t long"), PIECE)
    model = lattice.Lattice(PIECE, logp)
    for r in lattice.score_documents(docs, PIECE, queries.LM_TRAIN).collect():
        want = sum(end if w == lattice.END else brute(model, w.decode()) for w in tokens[r["doc_id"]]) / np.log(10)
        assert r["score"] == pytest.approx(want)


def test_scores(spark, odd, none, odd_rows, monkeypatch):
    monkeypatch.setattr(lattice, "HOT", 3)  # most words go the way of rare ones
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in odd_rows]
    seen = Counter(w for (i, _), ws in zip(odd_rows, tokens) for w in ws if not held(i))
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for (i, _), ws in zip(odd_rows, tokens):
        base = sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in ws)
        want[(i, held(i), len(ws), sum(seen[w] > 0 for w in ws), n, round(base, 6))] += 1
    rows = lattice.score_documents(odd, PIECE, queries.LM_TRAIN).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[5] == by[6] < 0 and by[1] < by[10] < by[5]
    assert lattice.score_documents(none, PIECE, queries.LM_TRAIN).count() == 0
    untrained = lattice.score_documents(odd, PIECE, "false").collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["held_out"] for r in untrained)


def test_ids_are_laid_out_for_some_texts_at_a_time(monkeypatch):
    import tracemalloc

    own = packing.WordIds(WORD)
    column = pa.array([f"one two three {i} " * 12_500 for i in range(30)] + [None, "", "x"])
    want = [own.ids(f"one two three {i} ".encode() * 12_500) for i in range(30)] + [b"", b"", own.ids(b"x")]
    tracemalloc.start()
    try:
        total = sum(len(ids) for ids in own.texts(column))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == sum(map(len, want)) // 4 and peak < 24 * total  # several arrays of 8 bytes an id otherwise
    for n in (1, 60_000, 1 << 30):
        monkeypatch.setattr(packing, "EXPANDED", n)
        assert [ids.tobytes() for ids in own.texts(column)] == want
        assert [ids.tobytes() for ids in own.texts(column.slice(3, 29))] == want[3:32]
        assert list(own.texts(column.slice(0, 0))) == []
