"""The registered queries that SQL expresses, against DuckDB, on whole tables
and on tables with nulls, repeats and clashing columns."""

import duckdb
import pytest
from lodestone.llm import queries

TABLES = ("documents", "embeddings")


def rows(values, columns):
    out = []
    for r in values:
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def compare(spark, folder, name):
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')" if folder != "/root/testdata/sf0.001" else f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = base.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder)
    assert sorted(want.columns) == sorted(got.columns)
    columns = want.columns
    mine, others = rows([r.asDict() for r in got.collect()], columns), rows([dict(zip(columns, r, strict=True)) for r in want.fetchall()], columns)
    if name == "op1_jaccard":  # its SQL has a row for each id that repeats
        mine = sorted(set(mine))
    assert mine == others


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_shared_tables(spark, sf_dir, name):
    compare(spark, sf_dir, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in any column, empty and long texts, ties, repeats, other columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    texts = [(1, "a b c d e f", "x"), (2, "a b c d e f", None), (3, None, "x"), (4, "", "y"), (5, " \n", None), (6, long, "y"), (7, long + " more", "z"), *[(8, "the same row five words", "x")] * 5, (9, "Ä Ö", "ß")]
    spark.createDataFrame([(i, t, "en", s, 7, "q") for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0]), (None, [1.0, 1.0])]
    spark.createDataFrame([(i, v, 1) for i, v in vectors if not (i == 20 and v is None)], "vec_id long, embedding array<float>, rank int").dropDuplicates().write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows(spark, odd, name):
    compare(spark, odd, name)
