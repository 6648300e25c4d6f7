"""A linear-chain conditional random field in numpy.

Potentials of a word are sums of weights of its hashed features, in three
roles: as the word itself, as the word before and as the word after. The chain
runs over whole texts. A text is laid out in blocks of ``BLOCK`` words, all
blocks of a slice of texts side by side: a first pass multiplies up what each
block does to any state that enters it, a scan over the blocks of a text hands
the true one from block to block, and the recursions then run inside all blocks
at once. The cost per word is a dictionary lookup and some vector arithmetic,
however long a text is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np

from .words import claim

BLOCK = 32
#: Hashed features; the last row stands for no feature and stays zero.
FEATURES = 1 << 15
#: Features of a word at most.
WIDEST = 8
#: Words that an executor's table holds before it starts anew.
TABLE = 100_000


def hashed(names: Sequence[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for x in names]


def _lifted(init: np.ndarray, blocks: int) -> np.ndarray:
    return np.broadcast_to(init, (blocks, init.shape[-1]))


def forward_backward(emit: np.ndarray, move: np.ndarray, init: np.ndarray, real: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, expected moves, log of the partition sums) of blocks.

    emit: (blocks, words, states) log potentials; init: log potentials of the
    first word's state, for all blocks or each; real: (blocks, words), false
    for padding, which only stands at the end; after: what follows a block's
    last word, for each of its states.
    """
    blocks, length, states = emit.shape
    top = emit.max(2, keepdims=True)
    init = _lifted(init, blocks)
    most = init.max(1, keepdims=True)
    e, m, f = np.exp(emit - top), np.exp(move), np.exp(init - most)
    alpha, scale = np.empty_like(e), np.ones((blocks, length), e.dtype)
    for t in range(length):
        a = (f if t == 0 else alpha[:, t - 1] @ m) * e[:, t]
        s = a.sum(1)
        a /= s[:, None]
        if t and not real[:, t].all():
            s = np.where(real[:, t], s, 1)
            a = np.where(real[:, t, None], a, alpha[:, t - 1])
        alpha[:, t], scale[:, t] = a, s
    beta = np.ones_like(e)
    if after is not None:
        beta[:, -1] = after
    moves = np.zeros((states, states), e.dtype)
    for t in range(length - 2, -1, -1):
        to = e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
        on = real[:, t + 1, None]
        moves += (np.where(on, alpha[:, t], 0).T @ np.where(on, to, 0)) * m
        beta[:, t] = np.where(on, to @ m.T, beta[:, t + 1])
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    logz = np.where(real, np.log(scale) + top[:, :, 0], 0).sum(1) + most[:, 0]
    return post, moves, logz


def _turns(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block of each text with blocks, longest first; how many texts have
    a block with each number)."""
    heads = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    return heads[order], np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")


def marginals(emit: np.ndarray, move: np.ndarray, first: np.ndarray, real: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marginals of the words of whole texts, which have ``counts`` blocks each."""
    blocks, length, states = emit.shape
    e, m = np.exp(emit - emit.max(2, keepdims=True)), np.exp(move)
    # what a block does: a row for each state before it, and one for the start;
    # states first and blocks last, so that every step is a few long vectors
    by_word = np.ascontiguousarray(e.transpose(1, 2, 0))
    lead = np.concatenate([m, np.exp(first)[None]])
    rows = lead[:, :, None] * by_word[0][None]
    for t in range(1, length):
        to = np.empty_like(rows)
        for k in range(states):
            np.multiply(sum(rows[:, s] * m[s, k] for s in range(states)), by_word[t, k], out=to[:, k])
        to /= to.sum((0, 1))
        rows = to if real[:, t].all() else np.where(real[:, t], to, rows)
    through = rows.transpose(2, 0, 1)
    heads, many = _turns(counts)
    before, after = np.empty((blocks, states), e.dtype), np.ones((blocks, states), e.dtype)
    state = None
    for k, n in enumerate(many.tolist()):
        at = heads[:n] + k
        if k:
            before[at] = state[:n]
            state = np.einsum("ns,nst->nt", state[:n], through[at, :states])
        else:
            state = through[at, states].copy()
        state /= state.sum(1, keepdims=True)
    for k in range(len(many) - 1, 0, -1):
        at = heads[: many[k]] + k
        back = np.einsum("nst,nt->ns", through[at, :states], after[at])
        after[at - 1] = back / back.sum(1, keepdims=True)
    start = np.zeros(blocks, bool)
    start[heads[: many[0]] if len(many) else heads[:0]] = True
    with np.errstate(divide="ignore"):
        init = np.where(start[:, None], first, np.log(np.maximum(np.where(start[:, None], 1, before) @ m, 1e-300)))
    return forward_backward(emit, move, init.astype(emit.dtype), real, after)[0]


def viterbi(emit: np.ndarray, move: np.ndarray, first: np.ndarray, real: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The likeliest states of whole texts, which have ``counts`` blocks each
    (one, if None); padding gets state 0."""
    blocks, length, states = emit.shape
    counts = np.ones(blocks, np.int64) if counts is None else counts
    heads, many = _turns(counts)
    entered = np.zeros((blocks, states), emit.dtype)  # best scores of the word before
    by_word = np.ascontiguousarray(emit.transpose(1, 2, 0))  # states first, blocks last
    if len(many) > 1:
        best_of = np.concatenate([move, first[None]])[:, :, None] + by_word[0][None]
        for t in range(1, length):
            to = np.empty_like(best_of)
            for k in range(states):
                top = best_of[:, 0] + move[0, k]
                for j in range(1, states):
                    np.maximum(top, best_of[:, j] + move[j, k], out=top)
                np.add(top, by_word[t, k], out=to[:, k])
            best_of = to if real[:, t].all() else np.where(real[:, t], to, best_of)
        through = best_of.transpose(2, 0, 1)
        state = None
        for k, n in enumerate(many.tolist()):
            at = heads[:n] + k
            if k:
                entered[at] = state[:n]
                state = (state[:n, :, None] + through[at, :states]).max(1)
            else:
                state = through[at, states].copy()
            state -= state.max(1, keepdims=True)
    start = np.zeros(blocks, bool)
    start[heads[: many[0]] if len(many) else heads[:0]] = True
    back = np.empty((length, states, blocks), np.int8)
    best = np.ascontiguousarray(entered.T)
    for t in range(length):
        now, whole = np.empty_like(best), bool(real[:, t].all())
        for k in range(states):
            options = best + move[:, k, None]
            options.argmax(0, out=(way := np.empty(blocks, np.intp)))
            back[t, k] = way
            now[k] = options.max(0)
        if t == 0:
            now = np.where(start, first[:, None], now)
        now += by_word[t]
        if not whole:
            back[t] = np.where(real[:, t], back[t], np.arange(states, dtype=np.int8)[:, None])
            now = np.where(real[:, t], now, best)
        best = now
    # the state that each last state of a block came from, then the blocks of a text from the last
    end = best.argmax(0)
    if len(many) > 1:
        came = np.repeat(np.arange(states)[:, None], blocks, 1)
        for t in range(length - 1, -1, -1):
            came = np.take_along_axis(back[t], came, 0)
        for k in range(len(many) - 1, 0, -1):
            at = heads[: many[k]] + k
            end[at - 1] = came[end[at], at]
    path, rows = np.empty((length, blocks), np.int8), np.arange(blocks)
    path[-1] = end
    for t in range(length - 1, 0, -1):
        path[t - 1] = back[t, path[t], rows]
    path = np.ascontiguousarray(path.T)
    path[~real] = 0
    return path


class Index(dict):
    """Numbers words in the order they come; '' is 0, the blank word."""

    def __init__(self, *given):
        super().__init__(*given or ({"": 0},))

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Chain:
    """Weights of a chain over ``states`` states; ``features`` names those of a word."""

    def __init__(self, states: int, features: Callable[[str], list[int]], notes: int = 0):
        self.states, self.features = states, features
        self.words = np.zeros((3, FEATURES + 1, states), np.float32)
        self.notes = np.zeros((max(1, notes), states), np.float32)
        self.move = np.zeros((states, states), np.float32)
        self.first = np.zeros(states, np.float32)
        self.forget()

    def forget(self) -> None:
        self.index = Index()
        self.table = np.zeros((1, 3 * self.states), np.float32)
        if hasattr(self.features, "forget"):
            self.features.forget()

    def __getstate__(self):
        return self.__dict__ | {"index": Index(), "table": np.zeros((1, 3 * self.states), np.float32)}

    def _rows(self, words: list[str]) -> np.ndarray:
        wide = np.full((len(words), WIDEST), FEATURES)
        for i, w in enumerate(words):
            own = self.features(w)
            wide[i, : len(own)] = own
        out = np.zeros((3, len(words), self.states), np.float32)
        for k in range(WIDEST):
            out += self.words[:, wide[:, k]]
        return out.transpose(1, 0, 2).reshape(len(words), -1)

    def ids(self, words: list[str]) -> np.ndarray:
        """Rows of the table, which grows by the words not seen before."""
        ids = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        if len(self.index) > len(self.table):
            new = list(islice(self.index, len(self.table), None))
            self.table = np.concatenate([self.table, self._rows(new)])
        return ids

    @staticmethod
    def layout(sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, words before, words after, real, blocks of each text), a row
        a block; 0 stands for no word. ``ids`` are those of texts of ``sizes``."""
        counts = -(-sizes // BLOCK)
        flat = np.zeros(int(counts.sum()) * BLOCK + 2, np.int32)  # a blank word before and after
        at = 1 + (np.cumsum(counts) - counts).astype(np.int64) * BLOCK
        where = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
        flat[where] = ids
        real = np.zeros(len(flat) - 2, bool)
        real[where - 1] = True
        before, after = flat[:-2].copy(), flat[2:].copy()
        before[at[sizes > 0] - 1] = 0  # the first word of a text has none before it
        after[at[sizes > 0] - 2 + sizes[sizes > 0]] = 0
        return *(x.reshape(-1, BLOCK) for x in (flat[1:-1], before, after, real)), counts

    def blocks(self, texts: list[list[str]], notes: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, real, number of blocks of each text) of tokenised texts."""
        claim(self)
        if len(self.index) > TABLE:
            self.forget()
        sizes = np.array([len(x) for x in texts], np.int64)
        own, before, after, real, counts = self.layout(sizes, self.ids([w for x in texts for w in x]))
        k = self.states
        emit = self.table[own, :k] + self.table[before, k : 2 * k] + self.table[after, 2 * k :]
        if notes is not None:
            noted = np.array([self.notes[n].sum(0) for n in notes], np.float32).reshape(-1, k)
            emit += np.repeat(noted, counts, axis=0)[:, None]
        return emit, real, counts

    def fit(self, texts: list[list[str]], tags: list[list[int]], notes: list[list[int]] | None = None, rounds: int = 40, passes: int = 2, rate: float = 0.25, decay: float = 1e-3, seed: int = 0) -> Chain:
        """Likelihood ascent with Adam on all blocks of tagged texts, each of
        them in ``passes`` of the ``rounds`` at least; blocks with a tag, which
        are few, come as often as it takes to be half of a round. A block
        follows the tag before it, so that moves into it are learnt as those
        inside."""
        k, index = self.states, Index()
        sizes = np.array([len(x) for x in texts], np.int64)
        ids = np.fromiter((index[w] for x in texts for w in x), np.int32, int(sizes.sum()))
        *roles, real, counts = self.layout(sizes, ids)
        if not len(real):
            return self
        labels = np.zeros(real.shape, np.int8)
        labels[real] = np.fromiter((t for x in tags for t in x), np.int8, len(ids))
        before = np.concatenate([[-1], labels[:-1, -1]]).astype(np.int64)
        before[(np.cumsum(counts) - counts)[counts > 0]] = -1  # the first of a text
        noted = np.zeros((len(texts), len(self.notes)), np.float32)
        for i, x in enumerate(notes or []):
            noted[i, x] = 1
        noted = np.repeat(noted, counts, axis=0)
        wide = np.full((len(index), WIDEST), FEATURES)
        for i, w in enumerate(index):
            own = self.features(w) if i else []
            wide[i, : len(own)] = own
        params = [self.words, self.notes, self.move, self.first]
        means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, share = np.random.default_rng(seed), max(1, rounds // passes)
        tagged = labels.any(1)
        sides = [rng.permutation(np.flatnonzero(tagged)), rng.permutation(np.flatnonzero(~tagged))]
        shares = [min(share, max(1, round(len(x) * share / max(1, len(real) - len(x))))) for x in sides]
        for step in range(1, rounds + 1):
            some = np.sort(np.concatenate([x[step % n :: n] for x, n in zip(sides, shares, strict=True)]))
            if not len(some):
                continue
            on, own, head = real[some], labels[some].astype(np.int64), before[some]
            seen, parts = np.unique(np.concatenate([r[some].ravel() for r in roles]), return_inverse=True)
            parts = parts.reshape(len(roles), len(some), BLOCK)
            table = self.words[:, wide[seen]].sum(2)
            emit = sum(table[r][x] for r, x in enumerate(parts)) + (noted[some] @ self.notes)[:, None]
            init = np.where(head[:, None] < 0, self.first, self.move[head])
            post, moves, _ = forward_backward(emit, self.move, init, on)
            miss = np.eye(k, dtype=np.float32)[own] * on[:, :, None] - post * on[:, :, None]
            both, gold = on[:, 1:], np.zeros((k, k), np.float32)
            np.add.at(gold, (own[:, :-1][both], own[:, 1:][both]), 1)
            np.add.at(gold, head[head >= 0], miss[head >= 0, 0])  # moves into a block
            grad = np.zeros_like(self.words)
            for r, x in enumerate(parts):
                by_word = np.stack([np.bincount(x.ravel(), miss[:, :, s].ravel(), len(seen)) for s in range(k)], 1)
                for state in range(k):
                    grad[r, :, state] = np.bincount(wide[seen].ravel(), np.repeat(by_word[:, state], WIDEST), FEATURES + 1)
            grads = [grad, noted[some].T @ miss.sum(1), gold - moves, miss[head < 0, 0].sum(0)]
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g / len(some) - decay * p / 10
                means[i] += 0.1 * (g - means[i])
                squares[i] += 0.01 * (g * g - squares[i])
                p += rate * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-6)
            self.words[:, FEATURES] = 0
        return self
