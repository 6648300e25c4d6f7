import itertools
import re
import zlib

import numpy as np
from lodestone.llm import crf, secrets, toxicity
from pyspark.sql import functions as F


def test_recursions_match_enumeration():
    rng = np.random.default_rng(0)
    emit, move, first = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = [5, 3, 1]
    real = np.arange(5)[None] < np.array(sizes)[:, None]
    post, moves, logz = crf.forward_backward(emit, move, first, real)
    best = crf.viterbi(emit, move, first, real)
    want_moves = np.zeros((3, 3))
    for b, n in enumerate(sizes):
        score = {p: first[p[0]] + sum(emit[b, t, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1)) for p in itertools.product(range(3), repeat=n)}
        z = np.logaddexp.reduce(list(score.values()))
        assert np.isclose(z, logz[b])
        for t in range(n):
            assert np.allclose(post[b, t], [sum(np.exp(s - z) for p, s in score.items() if p[t] == k) for k in range(3)])
        for p, s in score.items():
            for t in range(n - 1):
                want_moves[p[t], p[t + 1]] += np.exp(s - z)
        assert tuple(best[b, :n]) == max(score, key=score.get)
    assert np.allclose(moves, want_moves)


def test_whole_texts_match_enumeration():
    """Texts of several blocks: the chain does not end where a block does."""
    rng = np.random.default_rng(1)
    move, first = rng.normal(size=(2, 2)) * 2, rng.normal(size=2)
    sizes, counts = [7, 2, 0, 9, 3], np.array([3, 1, 0, 3, 1])
    emit, real = rng.normal(size=(8, 3, 2)), np.zeros((8, 3), bool)
    at = 0
    for n, c in zip(sizes, counts.tolist(), strict=True):
        real[at : at + c].reshape(-1)[:n] = True
        at += c
    post, best = crf.marginals(emit, move, first, real, counts), crf.viterbi(emit, move, first, real, counts)
    at = 0
    for n, c in zip(sizes, counts.tolist(), strict=True):
        if n:
            e = emit[at : at + c].reshape(-1, 2)
            score = {p: first[p[0]] + sum(e[t, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1)) for p in itertools.product(range(2), repeat=n)}
            z = np.logaddexp.reduce(list(score.values()))
            for t in range(n):
                assert np.allclose(post[at : at + c].reshape(-1, 2)[t], [sum(np.exp(s - z) for p, s in score.items() if p[t] == k) for k in range(2)])
            assert tuple(best[at : at + c].reshape(-1)[:n]) == max(score, key=score.get)
        at += c


def potentials(chain, words, notes=()):
    """Of each word, from its and its neighbours' features, one by one."""
    def of(role, word):
        return sum(chain.words[role, f].astype(float) for f in chain.features(word))

    out = []
    for i, w in enumerate(words):
        e = of(0, w) + sum(chain.notes[n].astype(float) for n in notes)
        e = e + (of(1, words[i - 1]) if i else 0) + (of(2, words[i + 1]) if i + 1 < len(words) else 0)
        out.append(e)
    return np.array(out)


def test_document_scores_match_a_plain_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sf = sf_dir.replace("0.001", "0.01")
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    checked = 0
    for r in docs.collect():
        words = toxicity.WORD_RE.findall(r.text or "")
        if len(words) > 1500:
            continue
        e, m = potentials(model.chain, words), model.chain.move.astype(float)
        alpha, beta = [model.chain.first + e[0]], [np.zeros(2)]
        for x in e[1:]:
            alpha.append(np.logaddexp.reduce(alpha[-1][:, None] + m, axis=0) + x)
        for x in e[:0:-1]:
            beta.append(np.logaddexp.reduce(m + (x + beta[-1])[None], axis=1))
        log = np.array(alpha) + np.array(beta[::-1])
        post = np.exp(log[:, 1] - np.logaddexp(log[:, 0], log[:, 1]))
        peak = np.clip(post.max(), 1e-4, 1 - 1e-4)
        x = np.array([np.log(peak / (1 - peak)), np.log1p(post[post > 0.05].sum()), 1])
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))) < 2e-2
        spans = ",".join(f"{w.start()}:{w.end()}" for w, p in zip(toxicity.WORD_RE.finditer(r.text), post, strict=True) if p >= 0.5)
        assert got[r.doc_id].spans == spans or np.abs(post - 0.5).min() < 1e-2
        checked += 1
    assert checked > 100


def test_tags_match_a_plain_chain(spark, sf_dir):
    rows = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    chain = secrets.train(rows)
    for text in rows[:60]:
        words = secrets.WORD_RE.findall(text)
        if not 32 < len(words) < 800:
            continue
        emit, real, counts = chain.blocks([words], [secrets.notes(text)])
        path = crf.viterbi(emit, chain.move, chain.first, real, counts).ravel()[: len(words)]
        e = potentials(chain, words, secrets.notes(text))

        def total(states, e=e):
            return chain.first[states[0]] + sum(e[t, s] for t, s in enumerate(states)) + sum(chain.move[a, b] for a, b in itertools.pairwise(states))

        best = [chain.first + e[0]]
        for x in e[1:]:
            best.append((best[-1][:, None] + chain.move).max(0) + x)
        assert abs(total(path) - best[-1].max()) < 1e-2


def base(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_base_spans():
    rng = np.random.default_rng(1)
    parts = ["password", "PassWD", "token", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123", "0123456789abcdef", "deadbeef", "é", "x", "secret=", "\n", "TOKEN: abcdefghijkl"]
    for _ in range(3000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(0, 14))))
        assert secrets.base_spans(text) == base(text), text


def test_scan_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = secrets.learn(docs)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "key AKIA" + "Z" * 20)], "doc_id long, text string")
    got = secrets.scan(docs.union(odd), chain).collect()
    texts = {r.doc_id: r.text or "" for r in docs.union(odd).collect()}
    assert len(got) == len(texts)
    for r in got:
        spans = [(s.start, s.end, s.kind) for s in r.spans]
        assert [s for s in spans if s[2] != "chain"] == base(texts[r.doc_id])
        assert spans == secrets.ordered(spans) and all(0 <= a < b <= len(texts[r.doc_id]) for a, b, _ in spans)
    assert secrets.scan(docs.limit(0), chain).collect() == []
    long = "worda wordb " * 60_000 + "key AKIA" + "Z" * 20
    extra = spark.createDataFrame([(1, long, "x", 3)] * 2, "doc_id long, text string, kind string, spans int")
    assert [[(s.start, s.kind) for s in r.spans if s.kind != "chain"] for r in secrets.scan(extra, chain).collect()] == [[(720_004, "access")]] * 2
    assert secrets.learn(docs.limit(0)).states == 3


def test_chain_finds_secrets_of_other_forms():
    rng = np.random.default_rng(3)

    def text(k):
        words = [f"word{chr(97 + x)}" for x in rng.integers(0, 20, 30)]
        value = "".join(rng.choice(list("0123456789abcdef"), 40))
        words[10:10] = ["token", "=", f'"{value}"'] if k % 2 else ["words", "only"]
        return " ".join(words)

    chain = secrets.train([text(k) for k in range(120)])
    other = "worda wordb token = \"0A1b2C3d4E5f6a7b8c9d0e1F2a3b4c5d6e7f8a9b\" wordc"
    words = [secrets.WORD_RE.findall(other)]
    emit, real, _ = chain.blocks(words, [secrets.notes(other)])
    states = crf.viterbi(emit, chain.move, chain.first, real)[0]
    long = [f"word{chr(97 + k % 20)}" for k in range(crf.BLOCK - 1)] + words[0]  # a secret over a block's border
    emit, real, counts = chain.blocks([long], [secrets.notes(" ".join(long))])
    assert crf.viterbi(emit, chain.move, chain.first, real, counts).ravel()[crf.BLOCK + 3] != secrets.OUTSIDE
    assert states[4] != secrets.OUTSIDE and not states[:2].any() and not states[5:6].any()


def test_toxicity(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    better = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert better >= 0.9
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, " \n", 0)], "doc_id long, text string, predicted int")
    assert [(r.predicted, r.spans) for r in toxicity.score(odd, model).collect()] == [(0, "")] * 3
    assert toxicity.score(odd.limit(0), model).collect() == []
    long = " ".join(["plain words in a row"] * 40_000)  # 3.2 million characters
    again = toxicity.score(spark.createDataFrame([(7, long), (7, long)], "doc_id long, text string"), model).collect()
    assert len(again) == 2 and again[0] == again[1]
    both = labels.withColumn("toxic", 1 - F.col("toxic")).limit(50).unionByName(labels)  # contradicting labels
    assert toxicity.learn(docs.unionByName(docs.limit(20)), both).chain.states == 2
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs.limit(5), none).collect()} == {0}


def test_features_see_the_whole_word():
    """What begins after many characters counts, wherever it stands."""
    for before in (100, 500):
        plain, held = '{"a":"b",' * before, '{"a":"b",' * before + '"k":"Zq7Rw9Kp2Lm4Xt6Vb8Nc1Yd3",' + '"a":"b",' * before
        assert set(secrets.features(held[:-1])) - set(secrets.features((plain + '"a":"b",' * (before + 4))[: len(held) - 1]))
        kinds = secrets.features("x-" * before + "A1b2C3d4")
        assert kinds[2] != secrets.features("x-" * before + "ABCDabcd")[2]
    assert max(len(secrets.features(w)) for w in ("token", '"a":1,' * 30, "x" * 200)) <= crf.WIDEST


class _All(crf.Chain):
    """Tags each text as one run."""

    def blocks(self, texts, notes=None):
        emit, real, counts = super().blocks(texts, notes)
        emit[:, :, secrets.OUTSIDE] = -50
        emit[:, 1:, secrets.BEGIN] = -50
        return emit, real, counts


def test_what_patterns_leave_of_a_chain_span(spark):
    text = "key AKIA" + "Z" * 20 + " Qw9-Er7 \"" + "0123456789abcdef" + "\" Ty5"
    a, h = text.index("AKIA"), text.index("0123")
    assert secrets.beside(text, (0, len(text)), [(a, a + 24), (h, h + 16)]) == [(0, 3), (a + 25, h), (h + 16, len(text))]
    assert secrets.beside(text, (h - 1, h + 17), [(h, h + 16)]) == []  # only its quotes are left
    assert secrets.beside(text, (0, 3), []) == [(0, 3)]
    assert secrets.beside(text, (a, a + 24), [(a, a + 24), (a, a + 30)]) == []
    spark.sparkContext.addPyFile(__file__)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [tuple(s) for s in secrets.scan(docs, _All(3, secrets.features, 4)).first().spans]
    assert [s for s in spans if s[2] == "chain"] == [(0, 3, "chain"), (a + 25, h, "chain"), (h + 16, len(text), "chain")]
