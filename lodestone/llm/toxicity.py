"""Toxicity of documents from a chain that tags toxic words.

The labels are of documents. Token labels come from them: words and word
beginnings are taken, in turn, that occur in the most toxic documents not yet
explained and in hardly any clean one; where they occur in toxic documents are
the toxic tokens. A
linear-chain CRF learns to tag them from the word, its affixes, its shape and
its neighbours. Forward-backward marginals give the offending offsets, and two
summaries of them, calibrated on the labelled documents, the document's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .scratch import lowest, staged
from .words import WORD_RE, slices

#: The classifier learns from at most so many documents of each label, those
#: whose ids have the lowest hashes.
SAMPLE = {1: 1200, 0: 2400}
#: Lengths of word beginnings that can explain a label, as whole words can.
STEMS = (4, 5, 6)
PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|~`_-/\\=+^@"


def core(word: str) -> str:
    return word.lower().strip(PUNCTUATION)


def features(word: str) -> list[int]:
    w = core(word)
    shape = ("D" if any(c.isdigit() for c in w) else "") + ("U" if word[:1].isupper() else "l") + str(min(len(w), 12))
    return crf.hashed([f"w={w}", f"p={w[:4]}", f"p={w[:5]}", f"p={w[:6]}", f"s={w[-4:]}", f"h={shape}", "bias"])


def signs(word: str) -> list[str]:
    """What can explain a label: the word ('=...') and its beginnings."""
    w = core(word)
    return [f"={w}", *(w[:n] for n in STEMS if len(w) > n)] if w else []


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def explain(bags: list[set[str]], toxic: list[bool], least: float = 0.01, purity: float = 0.97) -> set[str]:
    """Signs that explain the toxic label, by greedy cover."""
    left = [b for b, t in zip(bags, toxic, strict=True) if t]
    n_toxic, n_clean = max(1, len(left)), max(1, len(bags) - len(left))
    total = Counter(w for b in left for w in b)
    total = {w: n for w, n in total.items() if n >= max(2, least * n_toxic)}
    clean = Counter(w for b, t in zip(bags, toxic, strict=True) if not t for w in b if w in total)
    pure = {w for w, n in total.items() if n / n_toxic >= purity / (1 - purity) * clean[w] / n_clean}
    found: set[str] = set()
    while left:
        counts = Counter(w for b in left for w in b if w in pure)
        word, n = min(counts.items(), key=lambda x: (-x[1], x[0]), default=("", 0))
        if n < max(2, least * n_toxic):
            break
        found.add(word)
        left = [b for b in left if word not in b]
    # others that are as pure and about as spread over documents as those of the
    # cover; not a beginning that mostly stands for one whole word
    typical = np.median([total[w] for w in found]) if found else float("inf")
    more = {w for w in pure if total[w] >= 0.2 * typical and not clean[w]} | found
    one = {w[1 : 1 + n]: c for w, c in total.items() if w[0] == "=" and w in more for n in STEMS}
    return {w for w in more if w[0] == "=" or one.get(w, 0) < 0.5 * total[w]}


def summary(post: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(log odds of the most toxic word, log of the expected number of toxic
    words) of each text, from the marginals of its words."""
    peak, number = np.zeros(len(counts)), np.zeros(len(counts))
    if len(post):
        owner = np.repeat(np.arange(len(counts)), counts)
        np.maximum.at(peak, owner, post.max(1))
        np.add.at(number, owner, np.where(post > 0.05, post, 0).sum(1))
    peak = np.clip(peak, 1e-4, 1 - 1e-4)
    return np.stack([np.log(peak / (1 - peak)), np.log1p(number)], 1)


class Model:
    def __init__(self, chain: crf.Chain, weights: np.ndarray):
        self.chain, self.weights = chain, weights

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        emit, real, counts = self.chain.blocks(texts)
        if not len(emit):
            return np.zeros((0, crf.BLOCK)), counts
        return crf.marginals(emit, self.chain.move, self.chain.first, real, counts)[:, :, 1] * real, counts

    def score(self, post: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = summary(post, counts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(texts: list[str], toxic: list[bool], seed: int = 0) -> Model:
    words = [WORD_RE.findall(t or "") for t in texts]
    bags = [{s for w in set(x) for s in signs(w)} for x in words]
    lexicon = explain(bags, toxic)
    hot = {w for x, bad in zip(words, toxic, strict=True) if bad for w in set(x) if not lexicon.isdisjoint(signs(w))}
    chain = crf.Chain(2, features)
    chain.fit(words, [[int(bad and w in hot) for w in x] for x, bad in zip(words, toxic, strict=True)], seed=seed)
    model = Model(chain, np.array([0.0, 0.0, -2.0]))
    if len(set(toxic)) == 2:
        found = [summary(*model.marginals(words[i : i + 200])) for i in range(0, len(words), 200)]
        model.weights = calibrate(np.concatenate(found), np.array(toxic, float))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the bounded sample of labelled rows outside the held-out
    fold. Without rows of both labels it finds nothing toxic. Of rows that
    repeat an id the least text counts, and an id labelled both ways counts as
    both."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    parts = [lowest(known.filter(F.col("toxic") == t), "doc_id", n) for t, n in SAMPLE.items()]
    picked = staged(parts[0].unionAll(parts[1]), "picked")  # at most sum(SAMPLE) rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked.distinct()), "doc_id")
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # at most sum(SAMPLE)
    rows = sorted(rows, key=lambda r: (r.doc_id, r.toxic))
    return train([r.text for r in rows], [bool(r.toxic) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and spans ('start:end,...' in code points) of
    every row. Null and empty texts have no words and get the score of a text
    in which nothing is found; the chain runs over the whole of a text, however
    long; copies score alike; an empty table gives no rows; other columns are
    not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [WORD_RE.findall(t) for t in texts]
            post, counts = own.marginals(words)
            scores, spans, at = own.score(post, counts), [], 0
            for text, n in zip(texts, counts.tolist(), strict=True):
                hit = set(np.flatnonzero(post[at : at + n].ravel() >= 0.5).tolist()) if n else ()
                at += n
                spans.append(",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(WORD_RE.finditer(text)) if i in hit) if hit else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype("i4"), pa.int32()), pa.array(spans, pa.string())], ["doc_id", "score", "predicted", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, spans string")
