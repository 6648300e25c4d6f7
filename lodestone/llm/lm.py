"""Masked pseudo-likelihood of documents.

A small network sees the two words before and the two after a masked one and
predicts it: h = tanh(sum of position-wise projections of the neighbours'
embeddings), then a softmax over classes of words, times the word's share of
its class. A document's score is the sum over all its words of the log
probability of each given both sides.

Words are counted exactly, in a table that grows with the corpus. The most
frequent ones have an id each; the others share ids by their hash, and a word
of such an id has an equal part of what the table holds of them, so that the
probabilities are of words and sum to one over the words counted and one more,
unseen, for each shared id. Classes come from the company that words keep: how
often hashes of neighbours stand beside them, clustered. So the model has a
fixed size while all it learns from grows with the corpus; every word of every
text is predicted in training, each task trains on its own documents from the
same start, and the average of the tasks' weights, summed in two shuffles,
starts the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import mixed, word_hashes
from .scratch import release, staged
from .words import slices

#: Ids of words: 0 for none, frequent ones, those shared by hash.
IDS, FREQUENT = 1 << 13, 6000
#: Width of the network, classes, and the most frequent ids that are their own.
WIDTH, CLASSES, SINGLE = 16, 64, 16
#: Hashes of words and of their neighbours whose company is counted.
COMPANY, AROUND = 1 << 14, 32
SIDES = (-2, -1, 1, 2)
REACH = 2
#: Rounds of training, and one masked position in so many is trained on in a
#: round, the next ones in the next: each word of each text once.
ROUNDS, STRIDE, BATCH, RATE = 2, 2, 1024, 0.3
#: Pieces in which weights are averaged.
PIECES = 16
#: Words scored at a time; their class odds stay in the cache.
CHUNK = 1 << 11
#: Different words that a task counts before it sends them on.
HELD = 1 << 20

U = np.uint64
_SHAPES = {"embed": (IDS, WIDTH), "project": (len(SIDES), WIDTH, WIDTH), "shift": (WIDTH,), "out": (WIDTH, CLASSES), "bias": (CLASSES,)}


def shared_id(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) % U(IDS - 1 - FREQUENT)).astype(np.int32) + np.int32(1 + FREQUENT)


class Words:
    """Ids of words, and of each id how many words it stands for."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, different: np.ndarray):
        """Hashes of the words with ids of their own, most frequent first; words
        counted of each id, and different ones."""
        order = np.argsort(frequent)
        self.known, self.rank = frequent[order], (order + 1).astype(np.int32)
        self.counts, self.different = counts, different

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(id of each word, words of each text)."""
        hashes, counts = word_hashes(texts)
        if not len(self.known):
            return shared_id(hashes), counts
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.rank[at], shared_id(hashes)), counts

    def parts(self) -> np.ndarray:
        """Log of a word's part of its id: of a shared one, all different words
        and one unseen have equal parts."""
        return -np.log(np.where(np.arange(IDS) > FREQUENT, self.different + 1.0, 1.0))


def padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with REACH blanks around each text, places of the words in it)."""
    places = np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts) * REACH + REACH
    flat = np.zeros(len(ids) + REACH * (len(counts) + 1), np.int32)
    flat[places] = ids
    return flat, places


def clusters(rows: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Which of k clusters each row is in, by weighted k-means from rows drawn
    apart from each other."""
    rng = np.random.default_rng(seed)
    centres = rows[[int(np.argmax(weight))]]
    away = ((rows - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(rows)):
        odds = away * weight
        pick = int(rng.choice(len(rows), p=odds / odds.sum())) if odds.sum() > 0 else int(rng.integers(len(rows)))
        centres = np.concatenate([centres, rows[[pick]]])
        away = np.minimum(away, ((rows - rows[pick]) ** 2).sum(1))
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)
        mass = np.bincount(own, weight, len(centres))
        sums = np.stack([np.bincount(own, weight * rows[:, d], len(centres)) for d in range(rows.shape[1])], 1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres)
    return own


def classes(counts: np.ndarray, company: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each id, log of its share of the class).

    The most frequent ids are classes of their own; the others are clustered by
    the company that they keep.
    """
    counts = counts.astype(float) + 0.5  # what no document holds is still possible
    order = np.argsort(-counts, kind="stable")
    own = np.zeros(IDS, np.int32)
    own[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    mean = company.sum(0) + 1e-9
    kept = company[rest] + 4 * mean / mean.sum()  # few observations say little
    rows = np.sqrt(kept / kept.sum(1, keepdims=True))
    own[rest] = SINGLE + clusters(rows, np.sqrt(counts[rest]), CLASSES - SINGLE)
    return own, np.log(counts / np.bincount(own, counts, CLASSES)[own])


class Network:
    def __init__(self, weights: dict[str, np.ndarray], words: Words, of: np.ndarray, share: np.ndarray):
        self.weights, self.words, self.of, self.share = weights, words, of, share.astype(np.float32)

    @classmethod
    def fresh(cls, words: Words, company: np.ndarray, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        of, share = classes(words.counts, company)
        weights = {k: (rng.normal(size=s) * 0.3).astype(np.float32) for k, s in _SHAPES.items()}
        weights["embed"][0] = 0
        mass = np.bincount(of, words.counts + 0.5, CLASSES) + 1e-3
        weights["bias"] = np.log(mass / mass.sum()).astype(np.float32)
        weights["out"] *= 0.1
        return cls(weights, words, of, share + words.parts())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in _SHAPES])

    def with_flat(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, s in _SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return Network(out, self.words, self.of, self.share)

    def odds(self, h: np.ndarray, own: np.ndarray | None = None):
        """Odds of the classes, a row each, which sums over classes are quick on;
        with ``own`` the log probability of each place's class instead."""
        z = self.weights["out"].T @ h.T
        z += self.weights["bias"][:, None]
        z -= z.max(0)
        got = None if own is None else z[own, np.arange(len(own))]
        np.exp(z, out=z)
        return z if own is None else got - np.log(z.sum(0))

    def train(self, flat: np.ndarray, places: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """A pass of minibatches over masked ``places``, with Adagrad."""
        w = self.weights
        for at in range(0, len(places), BATCH):
            p = places[at : at + BATCH]
            around = flat[p[:, None] + np.array(SIDES)]
            x = w["embed"].take(around, 0).reshape(len(p), -1)
            project = w["project"].reshape(-1, WIDTH)
            h = np.tanh(x @ project + w["shift"])
            miss = self.odds(h)
            miss /= miss.sum(0)
            miss[self.of[flat[p]], np.arange(len(p))] -= 1
            back = (miss.T @ w["out"].T) * (1 - h * h)
            # of the embeddings only the rows around have a gradient, summed in their order
            every = around.ravel()
            order = np.argsort(every.astype(np.uint16), kind="stable")
            ordered = every[order]
            first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            rows = ordered[first]
            embed = np.add.reduceat((back @ project.T).reshape(-1, WIDTH).take(order, 0), first, 0)
            embed[rows == 0] = 0
            grads = {"embed": embed, "project": (x.T @ back).reshape(w["project"].shape), "shift": back.sum(0), "out": h.T @ miss.T, "bias": miss.sum(1)}
            for k, g in grads.items():
                on = rows if k == "embed" else slice(None)
                g = g / len(p)
                squares[k][on] += g * g
                w[k][on] -= RATE * g / (np.sqrt(squares[k][on]) + 1e-6)

    def score(self, flat: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log probability of the word at each of ``places`` given both sides."""
        w = self.weights
        tables = [w["embed"] @ m for m in w["project"]]
        out = np.empty(len(places), np.float32)
        for at in range(0, len(places), CHUNK):
            p = places[at : at + CHUNK]
            h = np.tanh(sum(t[flat[p + s]] for t, s in zip(tables, SIDES, strict=True)) + w["shift"])
            own = flat[p]
            out[at : at + CHUNK] = self.odds(h, self.of[own]) + self.share[own]
        return out


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string"))


def _read(batch: pa.RecordBatch, at: int = 0) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def counted(docs: DataFrame) -> DataFrame:
    """hash and n of every word of all texts, and, as rows of a negative piece,
    the counts of the company that words keep, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company = np.zeros(COMPANY * AROUND, np.int64)
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            hashes, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held]), len(hashes)).astype(np.int64)
            none = len(hashes)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)

        for batch in slices(batches):
            hashes, counts = word_hashes(_read(batch))
            if not len(hashes):
                continue
            own = (mixed(hashes ^ U(0xA5A5)) >> U(64 - 14)).astype(np.int64) * AROUND
            dims = np.concatenate([(hashes % U(AROUND)).astype(np.int64), [0] * REACH])
            text = np.concatenate([np.repeat(np.arange(len(counts)), counts), [-1] * REACH])
            for step in range(1, REACH + 1):
                same = text[step : len(hashes) + step] == text[: len(hashes)]
                a, b = np.flatnonzero(same), np.flatnonzero(same) + step
                company += np.bincount(np.concatenate([own[a] + dims[b], own[b] + dims[a]]), minlength=len(company))
            held.append(np.unique(hashes, return_counts=True))
            size += len(held[-1][0])
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()
        if company.any():
            parts = np.array_split(company, PIECES)
            yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    names = ["hash", "n", "piece", "company"]
    return _text(docs).mapInArrow(run, "hash long, n long, piece int, company binary")


def count(docs: DataFrame) -> tuple[Words, np.ndarray]:
    """The words of all texts, and the company that each id keeps."""
    rows = staged(counted(docs), "words")
    table = staged(rows.filter("piece IS NULL").groupBy("hash").agg(F.sum("n").alias("n")), "word-counts")

    def add(key, given):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in given.column("company"))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "company": pa.array([total.tobytes()], pa.binary())})

    kept = rows.filter("piece IS NOT NULL").select("piece", "company").withColumn("part", F.pmod(F.xxhash64("company"), F.lit(16)))
    once = kept.groupBy("piece", "part").applyInArrow(add, "piece int, company binary")
    found = sorted(once.groupBy("piece").applyInArrow(add, "piece int, company binary").collect(), key=lambda r: r.piece)
    raw = np.concatenate([np.frombuffer(bytes(r.company), np.int64) for r in found]) if found else np.zeros(COMPANY * AROUND, np.int64)
    raw = raw.reshape(COMPANY, AROUND)
    release(rows)
    top = table.orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    frequent = np.array([r.hash for r in top], np.int64).view(np.uint64)
    counts, different, company = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64), np.zeros((IDS, AROUND))
    counts[1 : 1 + len(top)] = [r.n for r in top]
    company[1 : 1 + len(top)] = raw[(mixed(frequent ^ U(0xA5A5)) >> U(64 - 14)).astype(np.int64)]
    if len(top) == FREQUENT:
        last = (top[-1].n, top[-1].hash)
        others = table.filter((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("hash") > last[1])))

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, kinds = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
            for batch in batches:
                own = shared_id(batch.column(0).to_numpy().view(np.uint64))
                sums += np.bincount(own, batch.column(1).to_numpy(), IDS).astype(np.int64)
                kinds += np.bincount(own, minlength=IDS)
            on = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(sums[on]), pa.array(kinds[on])], ["id", "n", "kinds"])

        for r in others.mapInArrow(shared, "id int, n long, kinds long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():  # at most IDS rows
            counts[r.id], different[r.id] = r.n, r.kinds
    return Words(frequent, counts, different), company


def targets(places: np.ndarray, stride: int, shift: int) -> np.ndarray:
    """The places that are masked; ``stride`` shifts in a row take all of them."""
    return places[shift % stride :: stride]


def averaged(docs: DataFrame, net: Network, stride: int, turn: int = 0) -> Network:
    """One round: each task trains on its documents, weights are averaged by
    the number of positions that they were trained on."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value.with_flat(held.value.flat())
        squares = {k: np.full(s, 1e-4, np.float32) for k, s in _SHAPES.items()}
        trained = 0
        for k, batch in enumerate(slices(batches)):
            flat, places = padded(*held.value.words.ids(_read(batch)))
            # neighbours of one text must not fill a minibatch
            mine = np.random.default_rng(len(places)).permutation(targets(places, stride, k + turn))
            own.train(flat, mine, squares)
            trained += len(mine)
        if trained:
            parts = np.array_split(own.flat().astype(np.float64) * trained, PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([float(trained)] * PIECES), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "weight", "sums"])

    def add(key, table):
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums"))
        weight = float(np.sum(table.column("weight").to_numpy()))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "weight": [weight], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, weight double, sums binary"
    rows = _text(docs).mapInArrow(run, schema).withColumn("part", F.spark_partition_id())
    fan = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    once = rows.withColumn("part", F.col("part") % fan).groupBy("piece", "part").applyInArrow(add, schema)
    found = sorted(once.groupBy("piece").applyInArrow(add, schema).collect(), key=lambda r: r.piece)
    if not found:
        return net
    return net.with_flat(np.concatenate([np.frombuffer(bytes(r.sums), np.float64) / r.weight for r in found]))


def learn(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    """A network that every word of all texts has trained, if ``rounds`` are at
    least ``stride``. Null and empty texts teach nothing; without any words all
    are equally unlikely."""
    net = Network.fresh(*count(docs))
    for turn in range(rounds):
        net = averaged(docs, net, stride, turn)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum) and mean_log_prob of every row.

    Null and empty texts have no tokens, a sum of 0 and a null mean. Equal
    texts score alike, rows that repeat give a row each, an empty table gives
    none, and a very long text is scored whole; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, counts = held.value.words.ids(_read(batch, 1))
            each = held.value.score(*padded(ids, counts))
            total = np.bincount(np.repeat(np.arange(len(counts)), counts), each, len(counts)).astype(float)
            mean = pa.array(total / np.maximum(counts, 1), mask=counts == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(total), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
