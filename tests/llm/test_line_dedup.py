import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from assayer.llm import line_dedup


def words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def removed(spark, texts, least=50):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["_dedup"]["removed"] for r in line_dedup.line_dedup(docs, min_words=least).collect()}


def tokens(text):
    """Words with whether a line begins there; the lines as (place, first word, end)."""
    out, lines = [], []
    for p, line in enumerate((text or "").split("\n")):
        if own := line.encode().split():
            lines.append((p, len(out), len(out) + len(own)))
            out += [(w, i == 0) for i, w in enumerate(own)]
    return out, lines


def plain_removed(rows, least):
    """For each row the lines that stand whole in a run of least words that an earlier row has too:
    every line against every place of it in every earlier row, words compared one by one."""
    made = [tokens(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda d: (rows[d][0] is None, rows[d][0] or 0, d))
    out = {}
    for n, d in enumerate(order):
        mine, lines = made[d]
        gone = set()
        for e in order[:n]:
            theirs, others = made[e]
            for p, s, t in lines:
                for _, u, v in others:
                    if [w for w, _ in mine[s:t]] != [w for w, _ in theirs[u:v]]:
                        continue
                    back = forth = 0
                    # the first word of a run may begin a line in one text and not in the other
                    while s - back > 0 and u - back > 0 and mine[s - back - 1][0] == theirs[u - back - 1][0]:
                        back += 1
                        if mine[s - back] != theirs[u - back]:
                            break
                    while t + forth < len(mine) and v + forth < len(theirs) and mine[t + forth] == theirs[v + forth]:
                        forth += 1
                    if back + t - s + forth >= least:
                        gone.add(p)
        out[d] = sorted(gone)
    return out


def random_rows(seed):
    rng = random.Random(seed)
    lines = [" ".join(f"v{rng.randrange(12)}" for _ in range(rng.choice([1, 2, 4, 9, 21]))) for _ in range(25)]
    passage = [rng.sample(lines, 4) for _ in range(3)]
    rows = []
    for i in range(40):
        text = [rng.choice(["", "  ", *lines]) for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(3)):
            cut = "\n".join(rng.choice(passage)).split(" ")
            x = rng.randrange(len(cut) // 2)
            text.insert(rng.randrange(len(text) + 1), f"y{i} " + " ".join(cut[x:]) + rng.choice(["", f" z{i}"]))
        rows.append((rng.choice([None, i, i, i // 2]), "\n".join(text)))
    return rows + [(100 + i, rng.choice(rows)[1].replace(" ", rng.choice([" ", "  ", "\t"]))) for i in range(15)]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    rows = random_rows(seed)
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").coalesce(1)
    # rows of one key are in the order of their row keys
    stored = line_dedup.scannable(docs)
    keyed = {r["n"]: r["rid"] for r in line_dedup.with_row_key(stored).collect()}
    order = sorted(range(len(rows)), key=keyed.get)
    want = plain_removed([rows[n] for n in order], 20)
    want = {order[d]: gone for d, gone in want.items()}
    got = {r["n"]: r for r in line_dedup.line_dedup(stored, min_words=20).collect()}
    assert sum(map(bool, want.values())) > 15
    for n, gone in want.items():
        assert got[n]["_dedup"]["removed"] == gone, n
        assert got[n]["text"] == "\n".join(x for p, x in enumerate(rows[n][1].split("\n")) if p not in gone)


def test_sources_of_half_a_passage_don_t_hide_the_whole_one(spark):
    a, b, c, d = (words(x, 15) for x in "abcd")
    whole = "\n".join([a, b, c, d])
    assert removed(spark, [f"{a}\n{b}", f"{c}\n{d}", whole, f"{whole}\nend"]) == {0: [], 1: [], 2: [], 3: [0, 1, 2, 3]}


def test_moved_and_repeated_passages(spark):
    p, q = words("p", 60), words("q", 30) + "\n" + words("r", 30)
    got = removed(spark, [f"{p}\nx\n{q}", f"{q}\nsome words\n{p}\nmore\n{p}", f"x\n{q.splitlines()[0]}\nx"])
    assert got == {0: [], 1: [0, 1, 3, 5], 2: []}


def test_a_passage_that_begins_and_ends_inside_lines(spark):
    head, inner, tail = words("h", 15), words("i", 30), words("t", 15)
    texts = [f"one {head}\n{inner}\n{tail} two", f"other words {head}\n{inner}\n{tail} more", f"x\n{inner}\ny"]
    assert removed(spark, texts) == {0: [], 1: [1], 2: []}


def test_lines_that_many_documents_have(spark):
    a, b = [words(f"a{i}_", 10) for i in range(3)], [words(f"b{i}_", 10) for i in range(3)]
    texts = ["\n".join(a), "\n".join([*a, *b]), "\n".join([*a, *b, "end"])]
    assert removed(spark, texts) == {0: [], 1: [], 2: [0, 1, 2, 3, 4, 5]}
    alone = [x for i in range(40) for x in (f"{a[0]}\nq{i}", f"{b[1]}\nr{i}", f"{a[2]}\ns{i}")]
    got = removed(spark, [*alone, *texts[1:], *[f"{t}\n{i}" for i, t in enumerate([texts[1]] * 40)]])
    assert not any(got[i] for i in range(len(alone) + 1)) and all(got[i][:6] == [0, 1, 2, 3, 4, 5] for i in range(len(alone) + 1, len(got)))


def test_words_are_told_apart_by_any_white_space(spark):
    p = words("p", 30)
    assert removed(spark, [f"{p}\n{p}x", "\t\t".join(p.split()) + "  \r\n" + f" {p}x"])[1] == [0, 1]
    gaps = "a  b" + " " * 60 + "c"
    assert removed(spark, [gaps, f"{gaps} d\n{gaps}"]) == {0: [], 1: []}


def test_rows_and_columns(spark):
    p = words("p", 60)
    rows = [(1, f"head\n{p}"), (1, f"head\n{p}"), (None, f"{p}\n\n  \nnull id"), (2, None), (3, ""), (4, " \n")]
    docs = spark.createDataFrame([(i, t, "a", "b", 3, "c") for i, t in rows], "doc_id long, text string, _dedup string, _RID string, rid long, __dedup string")
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "___dedup"]
    got = sorted((r["doc_id"] or 9, r["text"] or "", r["___dedup"]["n_lines"], tuple(r["___dedup"]["removed"]), tuple(r["___dedup"]["partners"])) for r in out.collect())
    assert got == [(1, "", 2, (0, 1), (1,)), (1, f"head\n{p}", 2, (), ()), (2, "", 0, (), ()), (3, "", 0, (), ()), (4, " \n", 2, (), ()), (9, "\n  \nnull id", 4, (0,), (1,))]
    assert {(r["_dedup"], r["_RID"], r["rid"], r["__dedup"]) for r in out.collect()} == {("a", "b", 3, "c")}


def test_odd_rows(odd, none, odd_rows):
    assert line_dedup.line_dedup(odd).count() == len(odd_rows) and line_dedup.line_dedup(none).count() == 0


def test_a_very_long_text(spark):
    lines = [words(f"l{i}_", 12) for i in range(6000)]
    got = removed(spark, ["\n".join(lines), "new\n" + "\n".join(lines[3000:] + lines[:3000]), "\n".join([lines[7]] * 5000)])
    assert got[0] == [] and got[1] == list(range(1, 6001)) and got[2] == []


def test_longest_rise():
    assert line_dedup.longest_rise([]) == [] and line_dedup.longest_rise([3, 1, 2, 5, 4]) == [1, 2, 4]
    rng = random.Random(1)
    for _ in range(200):
        v = rng.sample(range(30), rng.randrange(9))
        rises = [c for n in range(len(v) + 1) for c in combinations(v, n) if list(c) == sorted(c)]
        found = [v[i] for i in line_dedup.longest_rise(v)]
        assert found == sorted(found) and len(found) == max(map(len, rises))


def longest_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_patience():
    assert line_dedup.patience([1, 2, 3, 2], [2, 3, 2]) == [(1, 0), (2, 1), (3, 2)], "equal lines are matched anew in each gap"
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(i < x and j < y for (i, j), (x, y) in zip(found, found[1:]))
        assert len(found) <= longest_common(a, b) and bool(found) == bool(set(a) & set(b))
        a, b = rng.sample(range(12), 8), rng.sample(range(12), 8)
        x = line_dedup.patience(a, b)
        assert len(x) <= longest_common(a, b)
        assert line_dedup.patience(a, a) == [(i, i) for i in range(8)]


def test_gone():
    assert line_dedup.blocks([(0, 4), (1, 5), (3, 6), (4, 8)]) == [[0, 1], [3], [4]]
    assert line_dedup.gone([1, 2, 3], [5, 5, 5], [1, 2, 9, 3], set(), 10) == [0, 1]
    assert line_dedup.gone([1, 2, 3], [5, 5, 5], [1, 2, 9, 3], {2}, 11) == [2]
    assert line_dedup.gone([3, 1, 3, 2], [9, 9, 9, 9], [1, 2, 3], {0, 1, 2, 3}, 9) == [0, 1, 2, 3]


def test_each_run_of_words_has_a_hash_in_common():
    rng = random.Random(3)
    for _ in range(60):
        run = [f"w{rng.randrange(9)}" for _ in range(30)]
        ends = sorted(rng.sample(range(1, 30), 3))
        run = " ".join(w + ("\n" if i + 1 in ends else "") for i, w in enumerate(run)).replace("\n ", "\n")
        one, two = (line_dedup.Sketch(f"{words(t, n)} {run} {words(t, 9)}".encode()) for t, n in (("x", rng.randrange(4)), ("y", rng.randrange(4))))
        assert {int(h) for h in one.seeds(30)[0]} & {int(h) for h in two.seeds(30)[0]}
        both = [{int(w) for i in range(len(s.size)) for w in line_dedup.windows(int(s.lines()[i]), int(s.size[i]), *(e[i] for e in s.edges(30)), 30)} for s in (one, two)]
        assert both[0] & both[1]


def test_the_way_files_are_split_changes_nothing(spark, tmp_path):
    """The keys of the first scan find the same rows in a second one that is cut otherwise."""
    passages = [words(f"p{i}_", 60) for i in range(12)]
    rows = [(i % 50 if i % 7 else None, f"own {i}\n{passages[i % 12]}\nend {i}", i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5).write.parquet(f"{tmp_path}/docs")
    found = []
    for first, second in (("1k", "64m"), ("64m", "1k"), ("64m", "64m")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", first)
        try:
            done = line_dedup.line_dedup(spark.read.parquet(f"{tmp_path}/docs"))
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)
            found.append({r["n"]: (r["text"], tuple(r["_dedup"]["removed"])) for r in done.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2] and sum(bool(gone) for _, gone in found[0].values()) == 300 - 12
    for n, (text, gone) in found[0].items():
        assert text == "\n".join(x for p, x in enumerate(rows[n][1].split("\n")) if p not in gone)
        assert gone in ((), (1,))
