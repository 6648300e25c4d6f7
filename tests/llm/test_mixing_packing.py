import zlib

import numpy as np
import public_tokenizers
import pytest
from lodestone.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


def fill(sizes):
    """Water-filling step by step."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > 2 * sizes[s]]
        if not over:
            out |= {s: level * weights[s] for s in free}
            break
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mix_fills_each_source_to_its_target(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), [None, "a", "b", "c", "ß"][int(rng.integers(0, 5))]) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "\t \n", "b"), (None, "x y", "c")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s in sizes:
        mine = [r for r in got if r.doc.source == s]
        assert mine[0].source_size == sizes[s]
        assert mine[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in mine) == int(min(np.floor(mine[0].target), 2 * sizes[s]))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert {(r.doc.doc_id, r.taken) for r in got} == {(r.doc.doc_id, r.taken) for r in again}


@pytest.mark.parametrize("seed", range(4))
def test_copies_are_taken_one_by_one(spark, seed):
    """Rows that come many times, also with one id and other texts."""
    rows = [(1, "one two three four", "a")] * 50 + [(2, "x y", "a"), (3, "p q r", "b"), (3, "p q s", "b"), (3, "p q s", "b"), (None, "u v", None), (None, "u v", None), (4, "w " * 700, "c")]
    got = mixing.mix(docs(spark, rows).repartition(3), seed=seed).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for s, target in fill(sizes).items():
        mine = [r for r in got if r.doc.source == s]
        assert sum(r.taken for r in mine) == int(min(np.floor(target), 2 * sizes[s])) and mine[0].target == pytest.approx(target)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted((r.doc.doc_id or 0, r.doc.text) for r in got) == sorted((i or 0, t) for i, t, _ in rows)
    again = mixing.mix(docs(spark, rows[::-1]), seed=seed).collect()
    assert sorted((r.doc.text, r.taken) for r in got) == sorted((r.doc.text, r.taken) for r in again)
    if seed == 0:
        assert sum(r.size for r in mixing.drawn(mixing.mix(docs(spark, rows))).select(mixing.word_count(mixing.F.col("text")).alias("size")).collect()) == sum(r.taken for r in got)


def test_many_sources_are_ranked_by_ranges(spark):
    rows = [(k, "w " * (k * 37 % 11), f"s{k * 7919 % 300:04}") for k in range(900)]
    got = mixing.mix(docs(spark, rows).repartition(5)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fill(sizes)
    assert all(r.target == pytest.approx(want[r.doc.source]) for r in got)


def test_drawn_texts_hold_the_words_taken(spark):
    mixed = mixing.mix(docs(spark, [(i, f" one two\nthree {i}", s) for i, s in enumerate("aabbbbc")]))
    taken = sum(r.taken for r in mixed.collect())
    out = mixing.drawn(mixed)
    assert out.columns == [x.split()[0] for x in DOCS.split(", ")]
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == taken
    assert all(f" one two\nthree {r.doc_id}".startswith(r.text) and r.n_chars == len(r.text) for r in rows)


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(docs(spark, [(1, None, None)])).collect()] == [0]


def test_pieces_match_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    made = Tokenizer.from_file(path)
    odd = ["", "It's <|endoftext|>x y　z İ ΣΣ é 1234 ...", "a\x1cb\x85c  d'll 'S", "x" * 9000, "wort " * 3000, None]
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = packing.pack(packing.pieces(frame, path)).toPandas()
    for doc_id, text in frame.collect():
        ids = np.array([*made.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 2048))
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in mine.start]
        assert mine.length.sum() == len(ids)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        assert rows.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1


def test_packing_nothing_and_repeats(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(none, path)).count() == 0
    same = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")
    assert packing.pack(packing.pieces(same, path), per_task=2).count() == 5


def test_fullest_bin_closes_first():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 8, 3, 2, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8), (3, 0)]
    with pytest.raises(ValueError):
        bins.put(11)


def test_packing_with_other_columns_and_long_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    long = "words again " * 150_000
    frame = spark.createDataFrame([(1, long, 5, "x"), (1, long, 5, "x"), (None, None, 0, None)], "doc_id long, text string, length int, piece string")
    got = packing.pack(packing.pieces(frame, path)).toPandas()
    assert got[got.doc_id == 1].length.sum() == 2 * 300_001 and (got.length <= 2048).all() and len(got) == 2 * 147 + 1
