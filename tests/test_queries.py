"""Registered queries against SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from netlume.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, SF)
    found = sql.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(map(plain, r)) for r in found.fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["ts_sec", "category", "severity", "src", "src_tag", "suppressed"] and df.count() > 0


def test_whole_terms_on_bytes(spark, tmp_path):
    texts = ["the cat of", "ét the ü of", "éétà", "tttt", "éãb", "THE of ñ", "x@é y@z.", "ü" * 60, "é" * 200 + "a", "aéa", "the é\tof", "t h eof", "theé of", "the éééééé of", "é", "", None, "世界the of"]
    docs = [(k, t, [None, "en", "zz"][k % 3]) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plain_terms = {
        "f10_literal": lambda b: b"the " in b,
        "f14_negated": lambda b: b"the" in b and b"of" not in b,
        "f15_offset_depth": lambda b: b"t" in b[2:8],
        "f16_distance_within": lambda b: (q := b.find(b"the")) >= 0 and b"of" in b[q + 4 : q + 15],
        "f23_isdataat": lambda b: b"a" in b and len(b) > 300,
        "f6_bsize": lambda b: 100 < len(b) < 400,
        "f18_byte_test": lambda b: len(b) > 1 and b[1] > 96,
        "f20_extract": lambda b: len(b) > 2 and b[0] == b[2],
        "f25_transform": lambda b: b"theof" in b.translate(None, b" \t\n\r"),
    }
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, says in plain_terms.items():
        want = [k for k, t in enumerate(texts) if t is not None and says(t.encode())]
        assert sorted(r["doc_id"] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()) == want, name
        assert sorted(r[0] for r in con.execute(catalogue.oracle_sql()[name]).fetchall()) == want, name


def test_deny_list_of_large_keys(spark, tmp_path):
    ends = [(3, '{"k": 4}'), (10_006, '{"k": 1}'), (10_007, '{"k": 70003}'), (7 * 10**12 + 3, '{"k": 7000000000000003}'), (-4, '{"k": -11}'), (None, '{"k": 10}'), (10_013, "{}")]
    rows = [(n, user, "view", 1.0, props) for n, (user, props) in enumerate(ends)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.oracle_sql()["d15_deny_list"]).fetchall())
    assert sorted(map(tuple, catalogue.queries()["d15_deny_list"](spark, str(tmp_path)).collect())) == want and len(want) == 7
