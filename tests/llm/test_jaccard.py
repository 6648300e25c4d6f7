import itertools
import re

import numpy as np
from lodestone.llm import components, jaccard


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, size, component, links with other sets) of each row."""
    sets, parent = [shingles(t) for _, t in rows], {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = {}
    for (i, s), (j, t) in itertools.combinations(zip([i for i, _ in rows], sets), 2):
        both = len(s & t)
        if both and 100 * both >= 75 * len(s | t):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
            if s != t:
                links.setdefault(frozenset(s), set()).add(frozenset(t))
                links.setdefault(frozenset(t), set()).add(frozenset(s))
    return sorted((i, len(s), root(i), len(links.get(frozenset(s), ()))) for (i, _), s in zip(rows, sets))


def variants(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, edits))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 10**6)}"
        yield " ".join(w)


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \t", "a", "A", "a b", "a  b\n", "Ä b c d e f", "ä b c d e f", "A B C D E", "a b c d e"]
    common = [f"c{k}" for k in range(40)]
    for k in range(12):
        base = [f"w{v}" for v in rng.integers(0, 5000, int(rng.integers(8, 160)))] + common * (k % 3 == 0)
        texts += variants(rng, base, 14, 1 + k % 5)
    texts += [" ".join(common + [f"u{k}_{j}" for j in range(9 + k % 4)]) for k in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t, "x", 1) for i, t in rows], "doc_id long, text string, n_shingles string, part int")
    assert sorted(tuple(r) for r in jaccard.components(docs).collect()) == brute(rows)


def test_repeated_ids_are_one_vertex(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (9, a), (7, c), (7, ""), (6, c), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r)[:3] for r in jaccard.components(docs).collect())
    assert got == [(3, 8, 3), (4, 0, 4), (5, 8, 3), (5, 8, 3), (6, 8, 6), (7, 0, 6), (7, 8, 6), (9, 8, 3), (9, 8, 3)]


def test_links_of_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    rng = np.random.default_rng(8)
    rows = list(enumerate(variants(rng, [f"w{v}" for v in range(90)], 130, 6)))
    rows += [(200 + k, t) for k, t in enumerate(variants(rng, [f"v{v}" for v in range(300)], 60, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.components(docs).collect()) == brute(rows)


def test_near_copies_are_not_paired_by_the_index():
    """40,000 entries of one group in a list, and one of another."""
    n = 40_000
    token, part = np.zeros(n + 1, np.int64), np.append(np.full(n, 7), 8)
    pairs = [p for p in jaccard.list_pairs(token, np.full(n + 1, 100), np.append(np.sort(np.arange(n) % 26), 0), part)]
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    assert 0 < len(i) <= n and (part[i] != part[j]).all()


def test_index_finds_all_without_shared_answers(spark):
    """The index alone has every link, in any order of the elements."""
    rng = np.random.default_rng(6)
    texts = [t for _ in range(8) for t in variants(rng, [f"w{v}" for v in rng.integers(0, 900, 60)], 12, 4)]
    elements, sizes = jaccard.shingle_sets(texts)
    ends = np.cumsum(sizes)
    sets = [set(elements[e - n : e].tolist()) for e, n in zip(ends, sizes, strict=True)]
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot = np.zeros(1 << jaccard.HOT_BITS, bool)
    hot[::7] = True
    rows = jaccard.prefixes(docs, hot).withColumn("part", jaccard.F.col("doc_id")).withColumn("p", jaccard.F.col("doc_id"))
    found = jaccard.candidates(jaccard.posted(rows))
    assert want and want <= {tuple(r) for r in found.collect()}
    described = jaccard.described(docs).filter("NOT hot").select(jaccard.F.col("doc_id").alias("p"), "n", "bits")
    assert want <= {tuple(r) for r in jaccard.plausible(found, described).collect()}


def test_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(3, "a b c d e f")] * 3 + [(None, "a b c d e f"), (7, "q")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.components(docs).filter("doc_id is not null").collect())
    assert got == [(3, 2, 3, 0)] * 3 + [(7, 1, 7, 0)]
    assert jaccard.components(docs.limit(0)).collect() == []


def test_component_labels(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, int(k)) for k in rng.integers(501, 700, 80)] + [(1, 1)]
    got = dict(map(tuple, components.labels(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(101, 141)} == {100} and 100 not in got
    assert all(got[v] == 500 for u, v in edges if u == 500)


def test_sets_beside_a_large_group_are_its_guests(spark, monkeypatch):
    """Many near copies, some of them far from the group's leader: links are
    those of brute force, and pairs don't grow with the square of the group."""
    rng = np.random.default_rng(11)
    rows = []
    for k, n in enumerate((400, 60)):
        base = [f"{k}w{v}" for v in range(120)]
        rows += list(variants(rng, base, n, 5))
        rows += [" ".join(base[: 60 + 4 * j] + [f"{k}t{v}" for v in range(j)]) for j in range(15)]
    # a set that only links with a guest, which links with members
    rows += [" ".join(f"0w{v}" for v in range(a, b)) for a, b in ((0, 95), (20, 95), (30, 95), (30, 90))]
    made, before = [], jaccard.candidates

    def counted(index):
        found = before(index)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "candidates", counted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute(list(enumerate(rows)))
    assert sorted(tuple(r) for r in jaccard.components(docs).collect()) == want
    assert 0 < made[0] < 3 * len(rows)
