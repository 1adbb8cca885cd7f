"""Queries against their SQL on a small folder of odd texts."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check_oracle import compare

import duckdb
from __spark_entry__ import oracle_sql, queries

NAMES = "casa straße istan année hotel".split()
TEXTS = [
    None, "", " ", "\n", "Casa, casa casas", "straße Straße STRAẞE", "İstan casa hotel", "aİ casa", "no name",
    "CASA\r\nhotel\t année ANNÉE", "casa. hotel 12 34 123456? the hotel twelve!",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    n = len(TEXTS)
    pq.write_table(pa.table({"item_id": pa.array(range(4), pa.int64()), "text": [" ".join(NAMES)] * 4}), path / "benchmark.parquet")
    docs = {
        "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(TEXTS, pa.string()), "lang": ["en"] * n,
        "source": [f"s{i % 7}" for i in range(n)], "n_chars": pa.array([len(t or "") for t in TEXTS], pa.int64()),
    }
    pq.write_table(pa.table(docs), path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", [
    "exact_rewrite", "stream_corrections", "mention_offsets", "wer_per_utterance", "wer_number_normalised",
    "digit_exact_match", "sweep_points", "sweep_pareto", "wer_by_slice",
    "entity_error_report", "entity_outcomes", "channel_entities", "entity_false_rewrites",
])
def test_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries()[name](spark, folder)
    cur = con.execute(oracle_sql()[name])
    assert not compare((df.columns, [tuple(r) for r in df.collect()]), ([d[0] for d in cur.description], cur.fetchall()))
