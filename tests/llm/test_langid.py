"""Language identification, stated again n-gram by n-gram and weight by weight."""

import collections
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import langid

TEXTS = ["The cat sat on the mat.", "Der Hund läuft über die Straße!", "El perro corre por la calle", "", "12 34 ?!", "ß", "Ünïcode wörds  here", "a b c d e f g " * 300, "x" * 70_000]


def grams(text):
    """Counts of the buckets of a text's n-grams."""
    chars = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    out = collections.Counter()
    for n in langid.ORDERS:
        for at in range(len(chars) - n + 1):
            own = chars[at : at + n]
            inner = own if n == 1 else own[1:-1]
            if (any(c != 32 for c in own) if n < 3 else all(c != 32 for c in inner)) and (n > 1 or own[0] != 32):
                value = 0
                for c in own:
                    value = (value * (1 << 21) + c) % 2**64
                out[(((value ^ (n << 60)) % 2**64) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BITS)] += 1
    return out


def test_counts_of_ngrams():
    counts, total = langid.document_counts([TEXTS])
    want = collections.Counter(b for t in TEXTS for b in grams(t))
    assert total == len(TEXTS) and {b: int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)


def test_scores_are_a_softmax_of_tf_idf():
    rng = np.random.default_rng(2)
    idf, raw = rng.random(1 << langid.BITS) + 1, rng.normal(size=(1 << langid.BITS, 3))
    model = langid.Model(["de", "en", "es"], raw * idf[:, None] * langid.SCALE, rng.normal(size=3), 0.7)
    langs, scores = model.predict(TEXTS)
    for text, lang, score in zip(TEXTS, langs, scores, strict=True):
        own = grams(text)
        if not own:
            assert (lang, score) == ("und", 0)
            continue
        total = sum(own.values())
        z = model.bias + sum(n / total * idf[b] * langid.SCALE * raw[b] for b, n in own.items())
        p = np.exp(z / 0.7 - np.max(z / 0.7))
        p /= p.sum()
        assert lang == model.languages[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)


def test_follow_the_regularised_leader_weight_by_weight():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(40, 5, replace=False)), rng.random(5)) for _ in range(30)]
    gold = rng.integers(0, 3, 30)
    weights, bias = langid.ftrl(rows, gold, 3, epochs=2, seed=5)
    alpha, beta, l1, l2 = 2.0, 1.0, 0.02, 0.05
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(key, least):
        if abs(z[key]) <= least:
            return 0.0
        return -(z[key] - np.sign(z[key]) * least) / ((beta + n[key] ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = {(f, c): weight((f, c), l1) for f in at for c in range(3)}
            b = {c: weight(("bias", c), 0) for c in range(3)}
            logits = np.array([b[c] + sum(v * w[f, c] for f, v in zip(at, x, strict=True)) for c in range(3)])
            p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            for c in range(3):
                miss = p[c] - (gold[i] == c)
                for key, g, own in [((f, c), v * miss, w[f, c]) for f, v in zip(at, x, strict=True)] + [(("bias", c), miss, b[c])]:
                    z[key] += g - ((n[key] + g * g) ** 0.5 - n[key] ** 0.5) / alpha * own
                    n[key] += g * g
    assert np.allclose(weights[:40], [[weight((f, c), l1) for c in range(3)] for f in range(40)])
    assert np.allclose(bias, [weight(("bias", c), 0) for c in range(3)]) and not weights[40:].any()
    assert (weights[:40] == 0).any()


def test_temperature_is_the_likeliest_of_the_grid():
    rng = np.random.default_rng(4)
    z, gold = rng.normal(size=(50, 3)) * 3, rng.integers(0, 3, 50)
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [sum(-np.log(max(np.exp(r[g] / t - np.logaddexp.reduce(r / t)), 1e-12)) for r, g in zip(z, gold, strict=True)) for t in grid]
    assert langid.calibrated(z, gold) == pytest.approx(grid[int(np.argmin(loss))])


def test_rows(spark):
    """Ties, repeated rows, an empty table."""
    model = langid.Model(["de", "en"], np.zeros((1 << langid.BITS, 2)), np.zeros(2))
    docs = spark.createDataFrame([(1, "same words", "x")] * 3 + [(2, "x" * 200_000, None)], "doc_id long, text string, lang_pred string")
    got = langid.identify(docs, model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("de", 0.5)] * 4
    assert langid.identify(docs.limit(0), model).collect() == []
    labelled = docs.withColumn("lang", langid.F.lit("en"))
    assert langid.identify(docs, langid.learn(labelled)).first().lang_pred in ("en", "und")
    assert langid.learn(labelled.limit(0)).languages == []


def test_memory_does_not_follow_the_batch():
    """Workers share an executor's memory: a batch of 8 MB needs no more than
    one of its slices does."""

    class Rows:
        schema = None
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)

        def broadcast(self, value):
            return type("Held", (), {"value": value})

        def mapInArrow(self, run, schema):
            return run

    model = langid.Model(["a", "b"], np.zeros((1 << langid.BITS, 2)), np.zeros(2))
    batch = pa.RecordBatch.from_arrays([pa.array([f"word{k} " * 300 for k in range(4000)])], ["text"])
    run = langid.kept(Rows(), model, 0.0)
    assert sum(b.num_rows for b in run(iter([batch.slice(0, 10)]))) == 10
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == batch.num_rows
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()
