import numpy as np

from assayer.llm import langid


def test_every_label_is_learned(spark):
    rows = [(f"l{i:02d}", f"{chr(97 + i % 26) * 3} {chr(97 + i // 26) * 5} words {j}") for i in range(70) for j in range(4)]
    net = langid.fit(spark.createDataFrame(rows, "lang string, text string"), "true", sample=4)
    assert list(net.labels) == sorted({x for x, _ in rows})


def plain_forward(net, window):
    """The probabilities of one window, byte by byte."""
    top = []
    for w in net.filters:
        many, width, _ = w.shape
        for f in range(many):
            top.append(max(sum(float(net.embed[window[p + i]] @ w[f, i]) for i in range(width)) for p in range(len(window) - width + 1)))
    hidden = np.maximum(np.array(top) + net.bias, 0)
    z = hidden @ net.dense + net.offset
    e = np.exp(z - z.max())
    return e / e.sum()


def few(rng, n=12, length=40, classes=3):
    return rng.integers(1, 256, (n, length)).astype(np.uint8), rng.integers(0, classes, n)


def test_forward_pass_against_plain_loops():
    rng = np.random.default_rng(0)
    windows, classes = few(rng)
    net = langid.train(windows, classes, ["a", "b", "c"], rounds=1)
    got = net.probabilities(windows, net.tables())
    for w, p in zip(windows, got):
        assert np.allclose(plain_forward(net, w), p, atol=1e-4)


def test_gradients_against_differences(monkeypatch):
    """Adam's first step moves each weight by RATE against the sign of its gradient; the signs are held
    against differences of the loss."""
    rng = np.random.default_rng(1)
    windows, classes = few(rng)
    monkeypatch.setattr(langid, "BATCH", len(windows))
    start = langid.train(windows, classes, ["a", "b", "c"], rounds=0)
    after = langid.train(windows, classes, ["a", "b", "c"], rounds=1)
    loss = lambda net: -np.mean([np.log(plain_forward(net, w)[c]) for w, c in zip(windows, classes)])
    held = lambda net, name: net.filters[name] if isinstance(name, int) else getattr(net, name)
    parts = [("dense", (3, 1)), ("dense", (20, 2)), ("offset", (0,)), ("bias", (5,)), ("bias", (30,)), ("embed", (int(windows[0, 3]), 2)), ("embed", (int(windows[5, 9]), 7)), (0, (1, 1, 3)), (1, (7, 2, 0)), (2, (11, 3, 5))]
    checked = 0
    for name, at in parts:
        moved = float(held(after, name)[at] - held(start, name)[at])
        sides = []
        for h in (1e-3, -1e-3):
            net = langid.ByteCnn(start.labels, start.embed.copy(), [f.copy() for f in start.filters], start.bias.astype(float), start.dense.astype(float), start.offset.astype(float))
            held(net, name)[at] += h
            sides.append(loss(net))
        slope = (sides[0] - sides[1]) / 2e-3
        if abs(slope) > 1e-4:
            checked += 1
            assert np.sign(moved) == -np.sign(slope) and abs(abs(moved) - langid.RATE) < 1e-3, (name, at)
    assert checked >= 6


def test_seventy_labels_are_predicted(spark):
    """Each label has byte pairs of its own."""
    rows = [(f"l{i:02d}", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 7)}" for _ in range(20)) + f" {j}") for i in range(70) for j in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    net = langid.fit(docs, "true")
    found = langid.predict(docs, net, passed=("lang",)).collect()
    hit = [r for r in found if r["lang"] == r["lang_pred"]]
    assert len(hit) > 0.8 * len(rows) and len({r["lang_pred"] for r in hit}) > 64
