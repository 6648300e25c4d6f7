import hashlib

import numpy as np
from lodestone.llm import substrings


def brute(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            raw = (t or "").encode()
            for k in range(len(raw) - 49):
                s = raw[k : k + 50]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 49):
            if i is not None and first[raw[k : k + 50]] < i:
                gone[k : k + 50] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_bytes int").repartition(parts)
    got = [tuple(r)[:5] for r in substrings.deduplicated(frame).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}é" if k % 9 == 0 else f"wo{k}" for k in range(400)]

    def some(n):
        return " ".join(words[k] for k in rng.integers(0, 400, n))

    shared = [some(30) for _ in range(4)] + ["x" * 130, "ab" * 60, "é" * 70]
    rows = []
    for i in range(120):
        parts = [some(int(rng.integers(0, 40)))]
        for s in rng.permutation(len(shared))[: int(rng.integers(0, 3))]:
            a = int(rng.integers(0, 30))
            parts += [shared[s][a : a + int(rng.integers(20, 200))], some(int(rng.integers(0, 20)))]
        rows.append((int(i * 7 % 120), " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (-5, rows[4][1]), (300, None), (301, ""), (302, "y" * 49), (303, "y" * 49), (304, "y" * 50), (305, "y" * 50), (306, "y" * 400), (None, rows[0][1])]
    rows += [(400, rows[5][1]), (400, rows[5][1]), (401, "a" + rows[5][1] + "b")]
    check(spark, rows)


def test_small_tables(spark):
    check(spark, [(1, "a" * 60)], 1)
    check(spark, [(2, "abc" * 40), (1, "zabc" * 30 + "abc" * 30)], 2)
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_tokens_are_settled_one_by_one(spark, monkeypatch):
    """A head that all documents share, with other bytes after it in each."""
    rng = np.random.default_rng(4)
    head = "all rights are reserved by their holders "
    rows = [(i, head * 2 + " ".join(f"w{k}" for k in rng.integers(0, 60, 40))) for i in range(80)]
    monkeypatch.setattr(substrings, "HOT", 3)
    check(spark, rows)


def test_long_texts_go_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(5)
    long = " ".join(f"w{k}" for k in rng.integers(0, 3000, 3000))
    rows = [(1, long), (2, "x" + long[3000:9000] + "y"), (3, long[:7000]), (3, long), (3, long)]
    monkeypatch.setattr(substrings, "BLOCK", 500)
    monkeypatch.setattr(substrings, "SLICE", 4000)
    check(spark, rows)


def test_multikey_sort_is_the_order_of_the_strings():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (300, 50)).astype(np.uint8)
    rows[:, :40] = rows[rng.integers(0, 5, 300), :40]
    rows[::7, 20:] = 255
    texts = [bytes(r) for r in rows]
    flat = np.concatenate([rows.ravel(), np.zeros(8, np.uint8)])
    order, group = substrings.multikey(substrings.suffix_words(flat, np.arange(300) * 50))
    assert [texts[k] for k in order] == sorted(texts)
    assert len({(g, texts[k]) for g, k in zip(group.tolist(), order.tolist(), strict=True)}) == len(set(texts)) == int(group[-1]) + 1


def test_blocks_cover_every_suffix_once(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)).encode() for n in (400, 3, 0, 15, 90)]
    data, starts = substrings.joined(texts)

    def tokens():
        return sorted((int(s), int(t), int(own)) for own, t, a, b, _ in zip(*substrings.stretches(data, starts), strict=True) for s in range(a, b + 1))

    whole = tokens()
    monkeypatch.setattr(substrings, "BLOCK", 97)
    assert tokens() == whole and len(whole) == sum(max(0, len(t) - 49) for t in texts)
