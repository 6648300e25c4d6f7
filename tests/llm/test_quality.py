import re

import numpy as np
from lodestone.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    covered, longest = set(), 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            if k >= quality.LEAST:
                longest = max(longest, k)
                covered |= set(range(i, i + k)) | set(range(j, j + k))
    failed = n < 50 or 100 * len(hit) > 50 * n
    kept = not failed and len(covered) <= quality.COVERED * n and longest <= quality.LONGEST
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, kept, len(covered), longest)


def test_measures_match_brute_force():
    rng = np.random.default_rng(1)
    texts = ["", " \n\t", "a", "a a a a a a a a a a a a", "x y\nx y\n\n \nx y ", "ß# <é> $ $", "a b c d e f g h i j " * 9]
    for words in (2, 5, 40):
        for _ in range(25):
            w = [f"w{k}" for k in rng.integers(0, words, int(rng.integers(0, 120)))]
            if len(w) > 40:
                w[30:30] = w[:20]
            texts.append("".join(x + rng.choice([" ", "\n", " \t"]) for x in w))
    assert quality.measure(texts) == [brute(t) for t in texts]


def test_judge_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x " * 60)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.judge(docs.union(odd)).collect()}
    want = {r.doc_id: brute(r.text or "") for r in docs.union(odd).collect() if len(r.text or "") < 6000}
    assert {k: got[k] for k in want} == want
    assert quality.judge(docs.limit(0)).collect() == []


def test_repeats_that_only_the_method_rejects():
    """Texts that pass the base rules, but repeat a passage."""

    def text(passage, times, words):
        own, parts = [f"p{k}" for k in range(passage)], []
        for k in range(times):
            parts += own + [f"u{k}_{j}" for j in range((words - times * passage) // times)]
        return " ".join(parts)

    failed, kept = [quality.COLUMNS.split(", ").index(f"{c} boolean") for c in ("base_failed", "kept")]
    for given in ((200, 2, 1000), (390, 3, 3000), (60, 2, 2000), (12, 20, 700)):
        row = quality.measure([text(*given)])[0]
        assert not row[failed] and not row[kept], given
    row = quality.measure([text(12, 2, 700)])[0]  # a line that comes twice is no reason
    assert not row[failed] and row[kept]


def test_rows_with_other_columns_and_long_texts(spark):
    long = "\n".join(f"a{k} b{k} c{k}" for k in range(60_000))
    rows = [(1, long, 1), (1, long, 2), (None, None, 3), (2, "", 4)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumn("n_words", quality.F.lit("x"))).collect()
    assert len(got) == 4 and sorted((r.n_words, r.kept) for r in got) == [(0, False), (0, False), (180_000, True), (180_000, True)]
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
