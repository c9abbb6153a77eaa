"""Lexical search against DuckDB, which scores every document, and the bounds of the first level."""

import re

import duckdb
import numpy as np
import pytest
from boxlake.llm import lexical
from hypothesis import given, settings
from hypothesis import strategies as st

DOCS, ITEMS = "doc_id long, text string, n int, row string, terms int", "item_id long, text string, item string, score int"
WORDS = "the mill stands by a river and old wheels turn slowly while herons fish below the weir at dusk".split()


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(rng.choice(WORDS, rng.integers(1, 30))), 1, "x", 2) for i in range(n)]


EDGES = rows(40) + [(None, "the mill", 1, "", 1), (None, "the mill", 1, "", 1), (7, None, 1, "", 1), (8, "", 1, "", 1), (9, " .,!\x7f\n", 1, "", 1), (5, "Mill-MILL_mill É é ÉCLAIR 'ß' ſ", 1, "", 1), (11, "mill " * 30_000, 1, "", 1), *[(100 + i, "herons fish", 1, "", 1) for i in range(30)], (100, "herons fish", 1, "", 1)]
ASKED = [(1, "The mill, the MILL!", "a", 1), (1, "herons fish", "a", 1), (2, "herons fish", "b", 1), (2, "herons fish", "b", 1), (3, None, "", 1), (4, "", "", 1), (5, "absent words only", "", 1), (None, "é mill ſ", "", 1), (6, " ".join(WORDS), "", 1)]
CASES = {"edges": (EDGES, ASKED), "no documents": ([], ASKED), "no items": (EDGES, []), "few": (rows(4), ASKED), "null texts": ([(1, None, 1, "", 1)], ASKED)}


def written(spark, folder, docs, items):
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(f"{folder}/benchmark.parquet")


def by_duckdb(folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(lexical.ORACLE).fetchall(), key=repr)


@pytest.mark.parametrize("case", CASES)
def test_search_equals_sql(spark, tmp_path, case):
    written(spark, tmp_path, *CASES[case])
    found = lexical.op12_lexical_search(spark, str(tmp_path))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    found = sorted(map(tuple, found.collect()), key=repr)
    assert found == by_duckdb(tmp_path)
    assert bool(found) == (case in ("edges", "few"))


def test_blocks_of_items_give_the_same(spark, tmp_path):
    written(spark, tmp_path, EDGES, ASKED)
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    assert sorted(map(tuple, lexical.ranked(read("documents"), read("benchmark"), block_items=2).collect()), key=repr) == by_duckdb(tmp_path)


def test_little_is_rescored(spark):
    """Of several shards, hardly more than the results reach the bound."""
    docs = spark.createDataFrame(rows(6000, 3), DOCS).repartition(6)
    ids = {w.encode(): i for i, w in enumerate(dict.fromkeys(WORDS))}
    index = lexical.build_index(docs, ids)
    items = [(0, [ids[b"herons"], ids[b"dusk"], ids[b"weir"]])]
    near = lexical._bounded(index, items, 10)
    scored = {r.row: r for r in near.collect()}
    assert 10 <= len(scored) < 600
    best = lexical.search(index, items, 10).collect()
    assert len(best) == 10 and all(min(r.lower for r in scored.values()) <= b.score for b in best)


@given(st.integers(1, 10**7), st.integers(10, 10**7), st.integers(0, 30_000))
@settings(max_examples=300, deadline=None)
def test_a_byte_bounds_an_impact(tf, m, w):
    g = int(lexical.impact(np.array([tf]), np.array([m]))[0])
    q = -(-g // lexical.UNIT)
    assert 0 <= q <= 255 and w * (q - 1) * lexical.UNIT <= w * g <= w * q * lexical.UNIT


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_terms(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    text.encode(errors="ignore")
    assert [t.decode() for t in lexical.terms_of(text.encode())] == re.findall(lexical.TERM, lowered)
