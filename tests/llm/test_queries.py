"""The registered queries: columns, one row for each key, and their SQL where there is one."""

import os

import duckdb
import pytest
from check import compare
from conftest import SMALL

import __spark_entry__ as contract

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["page_id", "url", "text", "n_chars"],
    "op4": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5": ["doc_id", "fingerprint", "component_id"],
    "op6": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10": ["doc_id", "n_tokens"],
    "op11": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op12": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}
QUERIES = {name.split("_")[0]: name for name in contract.queries() if name.startswith("op")}


def test_all_are_there():
    assert QUERIES.keys() == COLUMNS.keys() and "pipeline" in contract.queries()


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_query(spark, op):
    name, columns = QUERIES[op], COLUMNS[op]
    got = contract.queries()[name](spark, SMALL).toPandas()
    assert list(got.columns[: len(columns)]) == columns
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{os.path.join(SMALL, table)}.parquet'")
    key = columns[0]
    source = {"page_id": "pages", "conv_id": "conversations", "vec_id": "embeddings"}.get(key, "documents")
    keys = {x for (x,) in con.execute(f"select {key} from {source}").fetchall()} | ({-7} if op == "op4" else set())
    assert len(got) == len(keys) and set(got[key]) == keys
    if name in contract.oracle_sql():
        assert compare(got, con.execute(contract.oracle_sql()[name]).fetch_df()).startswith("ok")
