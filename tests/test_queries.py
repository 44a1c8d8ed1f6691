"""Every query of the engine against its SQL in another engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    got_rows = rows_of(got.columns, got.collect())
    assert got_rows == rows_of(columns, want.fetchall())
    assert got_rows or name == "eval_misses"


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert not set(SQL) - set(QUERIES)


#: Blank and null texts, characters of several code points, ends of white space, and texts whose SHA-256 begin with the same 48 bits.
ODD_TEXTS = [None, "", " ", "\n\t", "\u3000", "\x1c", "\x0b", "\x85", "\u200b", "\x00", "e\u0301", "\U0001f926\U0001f3fc\u200d\u2642", " x ", "x", "x\n", "X", "t9803473", "t18976720", "text 3012339", "t454416", None, "", " "]


@pytest.mark.parametrize("known", [["t9803473", "X"], ["t18976720", "text 3012339", "", " ", "\x1c", None]])
@pytest.mark.parametrize("name", ["classified_by_model", "cache_split"])
def test_odd_texts_against_sql(spark, tmp_path, name, known):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(ODD_TEXTS)))
    c.execute("CREATE TABLE labels (doc_id BIGINT)")
    c.executemany("INSERT INTO labels VALUES (?)", [(i,) for i in [*map(ODD_TEXTS.index, known), 99]])
    for t in ("documents", "labels"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), c.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_types_of_classified_by_model(spark, duck):
    names = {"VARCHAR": "string"}
    want = {r[0]: names.get(r[1], r[1].lower()) for r in duck.execute(f"DESCRIBE ({SQL['classified_by_model']})").fetchall()}
    assert dict(QUERIES["classified_by_model"](spark, SF).dtypes) == want
