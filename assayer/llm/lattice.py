"""Subword lattice likelihood: the probability of a text, summed over all its segmentations.

The pieces come from an existing vocabulary. Its file ranks them by merges and has no probabilities, so
their unigram scores are learned here: how often each piece occurs when the vocabulary's own
segmentation is applied to the training words, plus one. Pieces don't cross white space, so the
lattice of a text is a chain of the lattices of its words and its probability the product of theirs:
each distinct word of the corpus is scored once, by a forward recursion in log space, and the word
scores are joined to the documents.

Word counts cover every training document; scores cover every word. The HOT most frequent words
(a fixed number of short words, a few MB) go to the workers; all others are joined by shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, utf8_rows, with_row_key

#: Words sent to the workers and their greatest length: at most HOT * (HOT_BYTES + 20) bytes.
HOT, HOT_BYTES = 100_000, 48
#: Distinct words that a worker counts before it hands them on.
FLUSH = 200_000
#: The key of the end token; no word contains a line end.
END = b"\n"
LN10 = math.log(10)


class Lattice:
    """Pieces of a vocabulary file with their natural log probabilities."""

    def __init__(self, path: str, logp: np.ndarray | None = None) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        if logp is None:
            return
        self.byte = [0.0] * 256
        self.trie: dict[str, float | None] = {}
        for i in range(self.size):
            piece, score = self.model.id_to_piece(i), float(logp[i])
            if self.model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = score
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.trie[piece] = score
                for n in range(1, len(piece)):
                    self.trie.setdefault(piece[:n], None)

    def log_probability(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of a word and its mark."""
        s, trie = "▁" + word, self.trie
        n = len(s)
        ways: list[list[float]] = [[] for _ in range(n + 1)]
        here = 0.0
        for i in range(n):
            if i:
                w = ways[i]
                if not w:
                    continue
                if len(w) == 1:
                    here = w[0]
                else:
                    top = max(w)
                    here = top + math.log(sum([math.exp(x - top) for x in w]))
                ways[i] = []
            for j in range(i + 1, n + 1):
                score = trie.get(s[i:j], self)
                if score is self:
                    break
                if score is not None:
                    ways[j].append(here + score)
            if trie.get(s[i]) is None:  # no piece of its own: its bytes are
                ways[i + 1].append(here + sum(self.byte[b] for b in s[i].encode("utf-8", "replace")))
        w = ways[n]
        top = max(w)
        return top + math.log(sum([math.exp(x - top) for x in w]))


def word_counts(rows: DataFrame) -> DataFrame:
    """rows: _text, _train. word (binary), c (in training rows), t (in all), the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            c = [seen[1][w] for w in words]
            t = [seen[0][w] + n for w, n in zip(words, c)]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(t, pa.int64())], ["word", "c", "t"])

        for b in batches:
            for text, train in zip(utf8_rows(b.column("_text")), b.column("_train").to_pylist()):
                seen[train].update(text.lower().split())
                seen[train][END] += 1
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()

    return mapped(rows.select("_text", "_train"), run, "word binary, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def piece_scores(words: DataFrame, path: str) -> tuple[np.ndarray, float]:
    """Natural log probabilities of the pieces and of the end, from the training counts of words.
    At most one row for each piece of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path)
        total = np.zeros(lattice.size, dtype=np.int64)
        for b in batches:
            texts = [w.decode("utf-8", "replace") for w in utf8_rows(b.column("word"))]
            ids = lattice.model.encode(texts, num_threads=1)
            times = np.repeat(b.column("c").to_numpy(), [len(x) for x in ids])
            if len(times):
                np.add.at(total, np.concatenate([np.array(x, dtype=np.int64) for x in ids]), times)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    trained = words.where((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    counted = mapped(trained.select("word", "c"), run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    n = np.ones(Lattice(path).size)
    for piece, times in counted.collect():
        n[piece] += times
    ends = words.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    whole = n.sum() + ends + 1
    return np.log(n / whole), math.log((ends + 1) / whole)


def word_scores(words: DataFrame, path: str) -> DataFrame:
    """words with lat, the log10 probability of each word over all its segmentations."""
    logp, end = piece_scores(words, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, logp)
        for b in batches:
            lat = [(end if w == END else lattice.log_probability(w.decode("utf-8", "replace"))) / LN10 for w in utf8_rows(b.column("word"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lat, pa.float64())], [*b.schema.names, "lat"])

    return mapped(words, run, "word binary, c long, t long, lat double")


def score_documents(docs: DataFrame, path: str, train: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: rid, key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train is an SQL condition over docs that says which rows to learn from. Tokens are the words of the
    text (A-Z lower-cased) and one end. base_score is the add-one unigram log10 probability of the
    tokens, score the lattice's of the text. Null text is empty: the end alone. Without training rows
    every count is 0. Repeated rows count each, null and repeated keys are kept. Very long texts are
    counted word by word, and a word of any length costs time in proportion to it. An empty table gives
    no rows. Other columns are ignored.
    """
    rows = with_row_key(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.expr(train), F.lit(False)).alias("_train")))
    words = stored(word_counts(rows), "words")
    scored = stored(word_scores(words, path), "scored")
    n_all, n_kinds = scored.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    top = scored.where(F.length("word") <= HOT_BYTES).orderBy(F.desc("t"), "word").limit(HOT).toArrow()
    end = scored.where(F.col("word") == F.lit(END)).select("c", "lat").first() or (0, 0.0)
    hot = rows.sparkSession.sparkContext.broadcast(
        (top.column("word").to_pylist(), top.column("c").to_numpy(), top.column("lat").to_numpy())
    )
    kept: dict[str, tuple] = {}  # in each worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "hot" not in kept:
            names, c, lat = hot.value
            kept["hot"] = ({w: i for i, w in enumerate(names)}, np.append(np.log10(c + 1.0), 0), np.append(lat, 0), np.append(c > 0, False))
        at, base, lat, known = kept["hot"]
        for b in batches:
            rid = b.column("rid").to_numpy()
            out: tuple[list, ...] = tuple([] for _ in range(8))
            for i, t in enumerate(utf8_rows(b.column("_text"))):
                found = t.lower().split()
                which = np.fromiter(map(at.get, found, repeat(-1)), dtype=np.int64, count=len(found))
                one = (int(rid[i]), i, b"\n" + int(rid[i]).to_bytes(8, "big", signed=True), 1, len(found) + 1, int(known[which].sum()) + (end[0] > 0), float(base[which].sum()) + math.log10(end[0] + 1), float(lat[which].sum()) + end[1])
                for o, v in zip(out, one):
                    o.append(v)
                rare = Counter([found[j] for j in np.flatnonzero(which < 0).tolist()])
                if rare:
                    out[0].extend([int(rid[i])] * len(rare))
                    out[1].extend([None] * len(rare))
                    out[2].extend(rare.keys())
                    out[3].extend(rare.values())
                    for o in out[4:]:
                        o.extend([None] * len(rare))
            where = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), b.column("_key").take(where), b.column("_train").take(where), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.float64()), pa.array(out[7], pa.float64())],
                ["rid", "_key", "_train", "word", "n", "n_tokens", "n_known", "base", "near"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    parts = mapped(rows, run, f"rid long, _key {kind}, _train boolean, word binary, n long, n_tokens long, n_known long, base double, near double")
    # each text's own row has a key that no word has, so that those rows are dealt evenly
    both = parts.join(scored.drop("t"), "word", "left")
    n = F.when(F.col("n_tokens").isNull(), F.col("n")).otherwise(0)
    out = both.groupBy("rid").agg(
        F.max("_key").alias(key),
        F.max("_train").alias("_train"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, n).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", n * F.log10(F.col("c") + 1))).alias("_base"),
        F.sum(F.coalesce("near", n * F.col("lat"))).alias("score"),
    )
    return out.select(
        "rid",
        key,
        (~F.col("_train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("_base") - F.col("n_tokens") * F.lit(math.log10(n_all + n_kinds + 1))).alias("base_score"),
        "score",
    )
