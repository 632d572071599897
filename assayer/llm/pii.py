"""Personal data: base rules, and further spans by weak supervision. DataFrame and SQL functions only.

Candidates are the matches of wide patterns, a superset of the base rules', with other ways of writing
for each kind. Labelers vote on each: the format's own rules (regex), lists of known endings and
prefixes (gazetteer), and the words and characters around it (context). How reliable each labeler is, and how likely a candidate with given
votes is to be personal data, is estimated by expectation-maximisation; a logistic span classifier is
then trained on those estimates. Both see the corpus only as counts of distinct votes and features,
whose number is fixed by the labelers and not by the corpus. Base spans always stay; other candidates
of every format are added where the classifier is sure, and only there.

Patterns are written so that a run of characters is tried once: possessive, and begun only where a run
begins. They match what the plain forms match, leftmost and without overlap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, stored, text_or_empty, with_row_key

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: name: (kind, pattern, what a text must contain to be searched)
CANDIDATES = {
    "email": ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": ("card", r"[0-9](?:[ -]?[0-9]){12,}+", ""),
    "phone": ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    "local": ("phone", r"(?<![0-9A-Za-z+])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", ""),
    "spelled": ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}{{1,64}}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{{1,63}}+ ?[\[(]dot[\])] ?[A-Za-z]{{2,24}}+", "at"),
    "defanged": ("ip", r"(?<![0-9.\]])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9\[.])", "[.]"),
    "hexed": ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])", ":"),
    "dotted": ("card", r"(?<![0-9A-Za-z./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z./_])", ""),
    "abroad": ("phone", r"(?<![0-9A-Za-z+.,-])00[1-9](?:[ .()/-]{0,2}+[0-9]){8,14}+(?![0-9A-Za-z])", "00"),
}
BASE = ("email", "ip", "card", "phone")
#: Endings of addresses, card prefixes, and country codes of the gazetteers.
ENDINGS = "com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at|be|us|ca|au|jp|cn|ru|br"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"
COUNTRY_CODES = "1|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]"
CUES = {
    "email": r"mail|contact|write to|reach",
    "ip": r"\bip\b|host|server|address|from",
    "card": r"card|visa|master|amex|credit|debit|payment",
    "phone": r"tel|phone|call|fax|mobile|cell|dial",
}
AGAINST = r"(?:isbn|order|invoice|version|serial|ref|article|item|code|no)[ .:#]*$"
AROUND = 24
LABELERS = ("rule", "gazetteer", "cue", "against", "glued")
#: A candidate that isn't a base span is added from this probability on.
SURE = 0.95
ROUNDS = 60


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rid, _key and items: all matches with the number of characters since the last one of the same
    pattern and with what stands around. The only step that reads texts."""
    rows = with_row_key(docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")))
    empty = F.array().cast("array<string>")
    found = rows.select("rid", "_key", "_text", *[
        F.when(F.contains("_text", F.lit(must)) if must else F.lit(True), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(empty).alias(f"m_{name}")
        for name, (_, pattern, must) in CANDIDATES.items()
    ])
    cut = found.select("rid", "_key", *[f"m_{n}" for n in CANDIDATES], *[
        F.when(F.size(f"m_{name}") > 0, F.split("_text", pattern, -1)).otherwise(empty).alias(f"g_{name}")
        for name, (_, pattern, _must) in CANDIDATES.items()
    ])

    def items(name: str) -> Column:
        gap = lambda i: F.get(F.col(f"g_{name}"), i)
        return F.transform(
            f"m_{name}",
            lambda v, i: F.struct(
                F.lit(name).alias("name"),
                i.alias("i"),
                F.length(gap(i)).alias("gap"),
                v.alias("value"),
                F.lower(F.right(gap(i), F.lit(AROUND))).alias("before"),
                F.left(gap(i + 1), F.lit(1)).alias("after"),
            ),
        )

    return cut.select("rid", "_key", F.concat(*[items(n) for n in CANDIDATES]).alias("items"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _quad(value: Column) -> Column:
    """Whether the numbers between points are 255 at most."""
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255)
    return F.forall(F.split(value, r"\."), part)


def _base(name: Column, value: Column, digits: Column) -> Column:
    n = F.length(digits)
    return (
        F.when(name == "email", True)
        .when(name == "ip", _quad(value))
        .when(name == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(name == "phone", n.between(9, 15))
        .otherwise(False)
    )


def candidates(scanned: DataFrame) -> DataFrame:
    """rid, _key, name, kind, start, end (code points, end exclusive), base, the labelers' votes (1, -1
    or 0 for none) and size, a bucket of lengths. Rows without a candidate keep one row with nulls."""
    one = scanned.select("rid", "_key", F.explode_outer("items").alias("x")).select("rid", "_key", "x.*")
    upto = Window.partitionBy("rid", "name").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto)).withColumn("start", F.col("end") - F.length("value"))
    placed = placed.withColumn("digits", F.regexp_replace("value", "[^0-9]", "")).withColumn("base", _base(F.col("name"), F.col("value"), F.col("digits")))
    kind = F.create_map(*[F.lit(v) for n, (k, _, _) in CANDIDATES.items() for v in (n, k)])[F.col("name")]
    local = F.regexp_extract("digits", "^.{3}", 0)
    vote = lambda c: F.when(c, 1).otherwise(-1)
    plain = F.replace("value", F.lit("[.]"), F.lit("."))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(F.col("kind") == k, F.col("before").rlike(words)).otherwise(cue)
    return placed.withColumn("kind", kind).select(
        "rid", "_key", "name", "kind", "start", "end", "base",
        F.when(F.col("name").isin("local", "spelled", "hexed"), 0)
        .when(F.col("name") == "defanged", vote(_quad(plain)))
        .when(F.col("name") == "dotted", vote(_luhn(F.col("digits"))))
        .when(F.col("name") == "abroad", vote(F.length("digits").between(11, 17)))
        .when((F.col("name") == "card") & (F.length("digits") > 19), vote(_luhn(F.left("digits", F.lit(16)))))
        .otherwise(vote(F.col("base")))
        .alias("rule"),
        F.when(F.col("kind") == "email", vote(F.lower("value").rlike(rf"(?:{ENDINGS})$")))
        .when(F.col("name").isin("ip", "defanged"), vote(~plain.rlike(r"^0|\.0\.0\.0$")))
        .when(F.col("name") == "hexed", vote(F.lower("value").rlike("^(?:[23][0-9a-f]{3}|f[cde][0-9a-f]{2}):")))
        .when(F.col("kind") == "card", vote(F.col("digits").rlike(rf"^(?:{CARD_PREFIXES})")))
        .when(F.col("name") == "phone", vote(F.col("digits").rlike(rf"^(?:{COUNTRY_CODES})")))
        .when(F.col("name") == "abroad", vote(F.col("digits").rlike(rf"^00(?:{COUNTRY_CODES})")))
        .when(F.col("name") == "local", vote(~local.isin("555", "999", "911") & local.rlike("^[2-9][0-8]"))).alias("gazetteer"),
        F.when(cue, 1).otherwise(0).alias("cue"),
        F.when(F.col("before").rlike(AGAINST), -1).otherwise(0).alias("against"),
        F.when(F.col("before").rlike(r"[\p{L}\p{N}_]$") | F.col("after").rlike(r"^[\p{L}\p{N}_]"), -1).otherwise(0).alias("glued"),
        F.least(F.length("value") / 4, F.lit(7)).cast("int").alias("size"),
    )


def reliabilities(votes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """votes: patterns x labelers; kinds: small numbers; counts: how often each occurs. Returns the
    probability of each pattern to be personal data, and for each labeler P(vote | class) as
    labelers x class x vote (-1, 0, 1). Begun from the sum of votes, so that classes keep their sense."""
    p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    for _ in range(rounds):
        said = np.ones((votes.shape[1], 2, 3))
        for k in range(votes.shape[1]):
            for v in range(3):
                here = votes[:, k] == v - 1
                said[k, :, v] += [(counts * (1 - p))[here].sum(), (counts * p)[here].sum()]
        said /= said.sum(axis=2, keepdims=True)
        odds = np.zeros(len(votes))
        for kind in np.unique(kinds):
            here = kinds == kind
            prior = ((counts * p)[here].sum() + 1) / (counts[here].sum() + 2)
            odds[here] = np.log(prior / (1 - prior))
        for k in range(votes.shape[1]):
            odds += np.log(said[k, 1, votes[:, k] + 1] / said[k, 0, votes[:, k] + 1])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, said


def span_classifier(features: np.ndarray, target: np.ndarray, counts: np.ndarray, steps: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on weighted soft labels."""
    x = np.column_stack([features, np.ones(len(features))])
    share = counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps are small and few features make them cheap
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (share * (q - target)) + decay * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _feature_names() -> list[tuple[str, object]]:
    return [*[("name", n) for n in CANDIDATES], *[(lab, v) for lab in LABELERS for v in (-1, 1)], *[("size", s) for s in range(8)]]


def learned(found: DataFrame) -> Column:
    """The span classifier as an expression over candidates()."""
    # ten patterns, eight sizes and the labelers' votes: at most 10 * 8 * 3**5 rows
    seen = found.where("name IS NOT NULL").groupBy("name", "size", *LABELERS).count().collect()
    if not seen:
        return F.lit(0.0)
    seen = sorted(seen, key=lambda r: tuple(r))
    votes = np.array([[r[lab] for lab in LABELERS] for r in seen])
    counts = np.array([r["count"] for r in seen], dtype=float)
    kinds = np.array([list(CANDIDATES).index(r["name"]) for r in seen])
    p, _ = reliabilities(votes, kinds, counts)
    names = _feature_names()
    x = np.array([[float(r[c] == v) for c, v in names] for r in seen])
    w = span_classifier(x, p, counts)
    z = F.lit(float(w[-1]))
    for (c, v), weight in zip(names, w):
        z = z + F.when(F.col(c) == F.lit(v), float(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id", sure: float = SURE) -> DataFrame:
    """rid, _key, kind, start, end, base, probability: a row for each span, and one with null kind for
    each row without any. Added spans don't overlap base spans, and of added ones that overlap the first
    stays (of those that begin together the longest)."""
    scanned = stored(scan(docs, text, key), "scan")
    found = stored(candidates(scanned), "candidates")
    dropped(scanned)
    by = Window.partitionBy("rid").orderBy("start", "end")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    # parts of base spans are neither learned from nor added
    rated = found.withColumn("clear", (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end")))
    rated = rated.withColumn("probability", learned(rated.where("base OR clear")))
    # what fails the check of its own format (a checksum, a range) is dropped for good
    rated = rated.withColumn("more", ~F.col("base") & (F.col("probability") >= sure) & F.col("clear") & (F.col("rule") >= 0))
    ahead = Window.partitionBy("rid").orderBy("start", F.desc("end"), "name").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("taken_to", F.max(F.when(F.col("more"), F.col("end"))).over(ahead))
    taken = F.col("base") | (F.col("more") & (F.coalesce("taken_to", F.lit(0)) <= F.col("start")))
    blank = ("name", "kind", "start", "end", "base", "probability")
    return rated.select("rid", "_key", *[F.when(taken, F.col(c)).alias(c) for c in blank])


def pii_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", sure: float = SURE) -> DataFrame:
    """One row for each input row: rid, key, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (kind:start:end, comma-joined, by kind and start), n_spans (of all kinds) and found, an array of (start, end, kind)
    by start.

    Null counts as the empty text. Repeated rows are searched each. Other columns are ignored. Very long
    texts are searched whole, in time that grows with their length. An empty table gives no rows.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = spans(docs, text, key, sure).withColumn("rank", rank)
    entry = F.struct("rank", "start", "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["said"]), ",")
    out = rows.groupBy("rid", "_key").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base"), entry)).alias("own"),
        F.collect_list(F.when(F.col("kind").isNotNull(), entry)).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "end", "kind")))).alias("found"),
    )
    return out.select("rid", F.col("_key").alias(key), *[f"n_{k}" for k in KINDS], F.sha2(said(F.col("own")), 256).alias("base_sha256"), said(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"), "found")


def redacted(text: Column, found: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of spans that overlap, the first
    names the place and the rest of the later ones goes too."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = x["start"] >= a["at"]
        piece = F.concat(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(new, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    done = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, done)).otherwise(text)
