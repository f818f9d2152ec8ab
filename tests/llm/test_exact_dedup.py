from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from quernstone.llm import exact_dedup as ex
from quernstone.llm.queries import ORACLE_SQL, op4_exact_dedup
from tests_llm_odd import ODD, ODD_COLUMNS


def brute(rows):
    """(id, id that stays) of the rows that go."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text].append(key)
    out = []
    for ids in groups.values():
        ids = sorted(ids, key=lambda k: (k is None, k or 0))
        out += [(k, ids[0]) for k in ids[1:]]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("table_bytes", [ex.TABLE_BYTES, 20_000, 1_000])
def test_spilling_changes_nothing(spark, table_bytes):
    rng = random.Random(1)
    rows = [(n, f"text {rng.randrange(700)} " * rng.randrange(1, 3)) for n in range(3000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ex.duplicates(docs, table_bytes=table_bytes)) == brute(rows)
    stay = {n for n, _ in rows} - {n for n, _ in brute(rows)}
    assert sorted(r.doc_id for r in ex.distinct_documents(docs, table_bytes=table_bytes).collect()) == sorted(stay)


def test_equal_hashes_are_told_apart_by_content():
    t = ex.OpenTable()
    t.put(t.find(5, b"a"), 5, b"a", 1)
    assert t.find(5, b"b") < 0 and t.find(5, None) < 0
    t.put(t.find(5, b"b"), 5, b"b", 2)
    assert t.ids[t.find(5, b"a")] == 1 and t.ids[t.find(5, b"b")] == 2
    for n in range(5000):
        t.put(t.find(n % 7, str(n).encode()), n % 7, str(n).encode(), n)
    assert all(t.ids[t.find(n % 7, str(n).encode())] == n for n in range(5000))


@pytest.mark.parametrize("table_bytes", [ex.TABLE_BYTES, 1])
def test_odd_rows(odd, none, table_bytes):
    rows = [r[:2] for r in ODD]
    assert got(ex.duplicates(odd, table_bytes=table_bytes)) == brute(rows)
    kept = ex.distinct_documents(odd, table_bytes=table_bytes)
    assert kept.columns == ODD_COLUMNS and kept.schema.simpleString() == odd.schema.simpleString()
    assert sorted((r.doc_id for r in kept.collect())) == [1, 3, 5, 7, 8, 9]
    assert ex.duplicates(none).count() == ex.distinct_documents(none).count() == 0


def test_a_content_that_most_rows_have(spark):
    rows = [(n if n % 5 else None, "the same " * 40 if n % 3 else f"other {n // 6}") for n in range(3000)]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for table_bytes in (ex.TABLE_BYTES, 3000):
        assert got(ex.duplicates(docs, table_bytes=table_bytes)) == brute(rows)
        assert ex.distinct_documents(docs, table_bytes=table_bytes).count() == len({t for _, t in rows})
    # before they are shuffled, the copies of a task are one record
    kept = list(ex._merged(iter([pa.record_batch({"h": pa.array([7] * 900), "content": pa.array([b"x"] * 900), "id": pa.array(range(899, -1, -1))})]), 10_000))
    assert len(kept) == 1 and kept[0].num_rows == 1 and kept[0].column(2).to_pylist() == [0] and sorted(kept[0].column(3).to_pylist()[0]) == list(range(1, 900))


def test_names_that_differ_in_case_or_have_dots(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (None, "c", "x"), (3, "a", "y")], "`a.b` long, TEXT string, text string")
    assert got(ex.duplicates(docs, "a.b")) == [(2, 1), (None, 1)]
    kept = ex.distinct_documents(docs, "a.b")
    assert kept.columns == ["a.b", "TEXT", "text"] and sorted(map(tuple, kept.collect())) == [(1, "a", "x"), (3, "a", "y")]


def test_same_as_sql(spark, table, same_as_sql):
    table("documents")
    same_as_sql(op4_exact_dedup(spark, "/root/testdata/sf0.01"), ORACLE_SQL["op4_exact_dedup"])
