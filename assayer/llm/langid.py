"""Language identification by a byte convolutional network, trained in numpy.

Windows of WINDOW bytes (A-Z lower-cased) go through a byte embedding, filters of several widths, a
maximum over all places, and a softmax. A text is cut into consecutive windows, all of them are
applied in batches, and its scores are the windows' probabilities weighted by their bytes.

Training takes a bounded sample: at most SAMPLE rows of each label, one
window of each, chosen by a hash of the row. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, sliced

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
SAMPLE = 1200
ROUNDS, BATCH, RATE, SEED = 8, 64, 0.01, 7
APPLY = 32
UNKNOWN = "und"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class ByteCnn:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0, the padding, is zero
    filters: list[np.ndarray]  # for each width: FILTERS x width x EMBED
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each width: what byte v at place i of a filter adds, 256 x width x FILTERS."""
        return [np.einsum("vd,fkd->vkf", self.embed, w).astype(np.float32) for w in self.filters]

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        top = []
        for t in tables:
            k = t.shape[1]
            places = windows.shape[1] - k + 1
            total = t[:, 0][windows[:, :places]]
            for i in range(1, k):
                total += t[:, i][windows[:, i : i + places]]
            top.append(total.max(axis=1))
        z = np.maximum(np.concatenate(top, axis=1) + self.bias, 0) @ self.dense + self.offset
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, classes: np.ndarray, labels: list[str], rounds: int = ROUNDS) -> ByteCnn:
    """windows: uint8, n x WINDOW. Adam over shuffled batches; the same input gives the same net."""
    rng = np.random.default_rng(SEED)
    hidden = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(hidden), "dense": rng.normal(0, 0.2, (hidden, len(labels))), "offset": np.zeros(len(labels))}
    p |= {f"w{k}": rng.normal(0, 1 / np.sqrt(k * EMBED), (FILTERS, k, EMBED)) for k in WIDTHS}
    p["embed"][0] = 0
    first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            at = order[start : start + BATCH]
            x, y = windows[at], classes[at]
            tops, picks = [], []
            for k in WIDTHS:
                t = np.einsum("vd,fkd->vkf", p["embed"], p[f"w{k}"])
                places = x.shape[1] - k + 1
                total = sum(t[:, i][x[:, i : i + places]] for i in range(k))
                pick = total.argmax(axis=1)  # batch x FILTERS
                tops.append(np.take_along_axis(total, pick[:, None], axis=1)[:, 0])
                picks.append(pick)
            raw = np.concatenate(tops, axis=1) + p["bias"]
            h = np.maximum(raw, 0)
            z = h @ p["dense"] + p["offset"]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            g = {"dense": h.T @ d, "offset": d.sum(axis=0)}
            back = (d @ p["dense"].T) * (raw > 0)
            g["bias"], g["embed"] = back.sum(axis=0), np.zeros_like(p["embed"])
            for j, k in enumerate(WIDTHS):
                own = back[:, j * FILTERS : (j + 1) * FILTERS]
                seen = x[np.arange(len(y))[:, None, None], picks[j][:, :, None] + np.arange(k)]  # batch x FILTERS x k
                g[f"w{k}"] = np.einsum("bf,bfkd->fkd", own, p["embed"][seen])
                np.add.at(g["embed"], seen, own[:, :, None, None] * p[f"w{k}"][None])
            g["embed"][0] = 0
            step += 1
            for n, v in g.items():
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.999 * second[n] + 0.001 * v * v
                p[n] -= RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(labels, p["embed"], [p[f"w{k}"] for k in WIDTHS], p["bias"].astype(np.float32), p["dense"].astype(np.float32), p["offset"].astype(np.float32))


def window_rows(texts: list[bytes]) -> np.ndarray:
    """One window of each text, from its start, padded with bytes 0."""
    out = np.zeros((len(texts), WINDOW), dtype=np.uint8)
    for i, t in enumerate(texts):
        cut = np.frombuffer(t[:WINDOW], dtype=np.uint8)
        out[i, : len(cut)] = FOLD[cut]
    return out


def fit(docs: DataFrame, learn: str, text: str = "text", label: str = "lang", sample: int = SAMPLE) -> ByteCnn | None:
    """The net of the rows that meet the SQL condition learn and have a label and a letter; None if
    there are none. The window of a sampled row begins at a place that its hash chooses."""
    rows = docs.where(F.coalesce(F.expr(learn), F.lit(False)) & F.col(label).isNotNull()).select(F.col(text).alias("_text"), F.col(label).cast("string").alias("_label"))
    counts = rows.groupBy("_label").count().collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["_label"], min(1.0, 1.5 * sample / r["count"]))])
    drawn = rows.withColumn("_draw", F.xxhash64("_text", F.monotonically_increasing_id()))
    drawn = drawn.where((F.pmod("_draw", F.lit(1 << 20)) / (1 << 20) < share[F.col("_label")]) & F.col("_text").rlike(r"\p{L}"))
    start = F.pmod(F.shiftright("_draw", 20), F.greatest(F.length("_text") - WINDOW, F.lit(1))) + 1
    window = F.substring("_text", start.cast("int"), F.lit(WINDOW))
    most = int(1.6 * sample) * len(counts)
    found = drawn.select("_draw", "_label", window.alias("_window")).orderBy("_draw", "_label", "_window").limit(most).collect()
    kept: dict[str, list[bytes]] = {}
    for r in found:
        if len(own := kept.setdefault(r["_label"], [])) < sample:
            own.append(r["_window"].encode())
    labels = sorted(kept)
    if not labels:
        return None
    return train(window_rows([w for x in labels for w in kept[x]]), np.repeat(np.arange(len(labels)), [len(kept[x]) for x in labels]), labels)


def text_scores(net: ByteCnn, tables: list[np.ndarray], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """data: the bytes of texts one after another; ends: their ends, with 0 first. For each text the
    mean probabilities of its windows, weighted by bytes; 0 for the empty text."""
    sizes = np.diff(ends)
    per = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), per)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = ends[doc] + within * WINDOW
    stop = np.minimum(start + WINDOW, ends[doc + 1])
    out = np.zeros((len(sizes), len(net.labels)))
    steps = np.arange(WINDOW)
    for i in range(0, len(doc), APPLY):
        s, e = start[i : i + APPLY], stop[i : i + APPLY]
        place = s[:, None] + steps
        windows = FOLD[data[np.minimum(place, len(data) - 1)]]
        windows[place >= e[:, None]] = 0
        np.add.at(out, doc[i : i + APPLY], net.probabilities(windows, tables) * (e - s)[:, None])
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, net: ByteCnn | None, text: str = "text", passed: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns passed, the predicted label and its score (0 to 1) for each row, repeated rows too.
    Texts that are null or have no letter are `und` with score 0, and so is every text if nothing was
    learned. All windows of very long texts count; an empty table gives no rows. Other columns are
    ignored; names are those of the two new ones."""
    lettered = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise("")
    rows = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(passed)], lettered.alias("_text"))
    kept = [f"_{i}" for i in range(len(passed))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for b in (part for whole in batches for part in sliced(whole, "_text")):
            column = b.column("_text")
            _, ends, data = column.buffers()
            at = np.frombuffer(ends, dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(b) + 1].astype(np.int64)
            some = np.diff(at) > 0
            if net and some.any():
                p = text_scores(net, tables, np.frombuffer(data, dtype=np.uint8), at)
                found = np.where(some, np.array([*net.labels], dtype=object)[p.argmax(axis=1)], UNKNOWN)
                score = np.where(some, p.max(axis=1), 0.0)
            else:
                found, score = np.full(len(b), UNKNOWN, dtype=object), np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(found.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], [*kept, "lang_pred", "score"])

    schema = rows.select(kept).schema.add("lang_pred", "string").add("score", "double")
    return mapped(rows, run, schema).toDF(*passed, *names)
