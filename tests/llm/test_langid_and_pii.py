import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import langid, pii, queries

SF = "/root/testdata/sf0.01"


def made(lang, rng, n=40):
    syllables = {"en": ["th", "ing", "ou", "wh"], "de": ["sch", "ung", "ü", "ei"], "fr": ["eau", "é", "oi", "ç"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(n))


def test_learns_and_predicts(spark, odd, none, odd_rows):
    rng = random.Random(0)
    rows = [(i, made(lang, rng), lang) for i in range(300) for lang in ("en", "de", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, f"NOT ({queries.LANG_HELD_OUT})", sample=120)
    assert net.labels == ["de", "en", "fr"]
    got = langid.predict(docs.withColumn("lang_pred", F.lit("x")), net, passed=("doc_id", "lang")).where(queries.LANG_HELD_OUT)
    hit, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and hit > 0.97
    out = langid.predict(odd, net, passed=("doc_id", "text")).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == langid.UNKNOWN, r["score"] == 0) == (not letters, not letters) and 0 <= r["score"] <= 1
    assert langid.predict(none, net).count() == 0
    assert langid.fit(none, "true") is None and langid.fit(odd, "true") is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {langid.UNKNOWN}


def test_windows_cover_whole_texts():
    net = langid.ByteCnn(["a", "b"], *[np.zeros(s) for s in ((256, 8),)], [np.zeros((12, k, 8)) for k in langid.WIDTHS], np.zeros(36), np.zeros((36, 2)), np.zeros(2))
    seen = []
    net.probabilities = lambda windows, tables: seen.append(windows.copy()) or np.full((len(windows), 2), 0.5)
    texts = [b"a" * 1000, b"", b"b" * 256, b"c" * 257, b"d"]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = langid.text_scores(net, [], np.frombuffer(b"".join(texts), dtype=np.uint8), ends)
    flat = np.concatenate(seen)
    assert {chr(v): int((flat == v).sum()) for v in np.unique(flat) if v} == {"a": 1000, "b": 256, "c": 257, "d": 1}
    assert got[1].sum() == 0 and np.allclose(got[[0, 2, 3, 4]], 0.5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    found = queries.op1_langid(spark, SF).where("held_out")
    both = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    hit = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.9


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}  # noqa: B023
            if good[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_plain_patterns(spark, odd, none, odd_rows):
    rng = random.Random(3)
    parts = ["a", "b@", "c.", "@", ".", "-", "+", "1", "23", "4111111111111111", "192.168.1.1", "255.256.", "0000255.1.1.1", "é", "\U0001F600", " ", "(", "ab.cd@ef.gh", "_", "%", "+1 (918) 555-4124", "12 34-56 78 90 12 34 5", "0", "\n"]
    rows = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))) for i in range(800)]
    rows += [(5000, "1." * 2000 + "a@" * 2000 + "9" * 9000 + "+1" + "(" * 9000), (5001, "x@" + "b." * 9000 + "c"), (5002, "a." * 40_000)]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    texts = {}
    for i, t in [*odd_rows, *rows]:
        texts.setdefault(i, []).append(t)
    got = pii.pii_documents(docs).collect()
    assert len(got) == len(rows) + len(odd_rows)
    for r in got:
        want = [plain_spans(t) for t in texts[r["doc_id"]]]
        digests = [hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in w).encode()).hexdigest() for w in want]
        assert r["base_sha256"] in digests
        base = want[digests.index(r["base_sha256"])]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        said = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(said)
        assert said == sorted(said, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
    assert pii.pii_documents(none).count() == 0


def test_reliabilities_find_the_true_classes():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    right = np.array([0.95, 0.85, 0.7])
    votes = np.where(rng.random((4000, 3)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((4000, 3)) < 0.2] = 0
    seen, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, said = pii.reliabilities(seen, np.zeros(len(seen), dtype=int), counts.astype(float))
    assert ((p[back.ravel()] > 0.5) == truth).mean() > 0.9
    strength = said[:, 1, 2] / (said[:, 1, 2] + said[:, 1, 0])
    assert strength[0] > strength[1] > strength[2] > 0.5


def test_weak_spans_are_added_and_decoys_are_not(spark):
    rows = [(i, f"please call ({200 + i % 700}) 234-{5000 + i} or tel +1 202 555 {1000 + i}") for i in range(300)]
    rows += [(1000 + i, f"mail me at bob{i}[at]site[dot]com or bob{i}@site.com") for i in range(200)]
    rows += [(2000 + i, f"order no. {4000000000000000 + 17 * i} is open") for i in range(200)]
    got = {r["doc_id"]: r for r in pii.pii_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    added = lambda i: {tuple(x.split(":")) for x in got[i]["spans"].split(",") if x} - {(k, str(a), str(b)) for k, a, b in plain_spans(texts[i])}
    assert sum(len(added(i)) for i in range(300)) > 250
    assert all(added(2000 + i) == set() for i in range(200))


def other_ways(rng, i):
    """A text, and the personal data in it that the base patterns don't see, in all four kinds; decoys too."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    quad = ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    body = "4" + digits(14)
    card = next(body + d for d in "0123456789" if luhn(body + d))
    bad = next(body + d for d in "0123456789" if not luhn(body + d))
    four = lambda c, s: s.join(c[j : j + 4] for j in range(0, 16, 4))
    good = [
        ("phone", f"({rng.randrange(200, 700)}) {rng.randrange(200, 999)}-{digits(4)}", "call "),
        ("email", f"bob{i} [at] site{i} [dot] com", "mail "),
        ("ip", quad.replace(".", "[.]"), "host "),
        ("ip", ":".join(["2001", *(f"{rng.randrange(65536):x}" for _ in range(7))]), "address "),
        ("card", four(card, rng.choice("./_")), "visa "),
        ("phone", "0049 30 " + digits(3) + " " + digits(5), "phone "),
    ]
    decoys = [f"order no. {bad}", f"card {four(bad, '.')}", "version 1[.]2[.]3[.]999", f"invoice {digits(3)}.{digits(2)}", f"00:{digits(2)}:{digits(2)}", f"ratio 16:9 and {digits(2)}.{digits(2)}.2024", "2024-01-02 03:04:05"]
    kind, value, cue = rng.choice(good)
    cue = cue if rng.random() < 0.7 else "so "
    text = f"é {rng.choice(decoys)}, {cue}"
    return f"{text}{value} then {rng.choice(decoys)}. a{i}@b.org, 10.0.{i % 250}.1, 4111 1111 1111 1111, +1 202 555 0101", (kind, len(text), len(text) + len(value))


def test_precision_and_recall_of_added_spans(spark):
    rng = random.Random(9)
    made = [other_ways(rng, i) for i in range(900)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    hit = found = 0
    kinds = {k: [0, 0] for k in pii.KINDS}
    for r in pii.pii_documents(rows).collect():
        text, want = made[r["doc_id"]]
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        base = plain_spans(text)
        assert set(base) <= set(spans) and len(set(spans)) == len(spans)
        added = set(spans) - set(base)
        by_start = sorted((a, b) for _, a, b in added)
        assert all(b <= c for (_, b), (c, _) in zip(by_start, by_start[1:])), "added spans don't overlap"
        assert all(b <= c or d <= a for _, a, b in added for _, c, d in base)
        found += len(added)
        hit += want in added
        kinds[want[0]][0] += want in added
        kinds[want[0]][1] += 1
    assert hit / found > 0.97 and hit / len(made) > 0.9, (hit, found)
    assert all(x / n > 0.8 for x, n in kinds.values()), kinds


def test_redaction(spark):
    spans = "array<struct<start:long,end:long,kind:string>>"
    rows = [("a b@c.d, é1.1.1.1!", [(2, 7, "email"), (10, 17, "ip")]), ("xx", []), ("abcdef", [(1, 4, "card"), (2, 5, "phone")])]
    got = spark.createDataFrame(rows, f"t string, f {spans}").select(pii.redacted(F.col("t"), F.col("f")).alias("x")).collect()
    assert [r["x"] for r in got] == ["a <EMAIL>, é<IP>!", "xx", "a<CARD>f"]
