"""Token queries over odd documents, against their SQL."""

import duckdb

from tessella.plans.registry import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Empty texts, unknown lengths, batches of nothing else, and ids that are negative, null or beyond what a double can tell apart.
LENGTHS = [(0, 0), (1, 7), (2, None), (3, 1), (8, 0), (9, 0), (16, None), (17, None), (-1, 4), (-9, 3), (None, 5), (None, 0), (2**53 + 15, 9), (2**53 + 16, 2)]


def compared(spark, folder, name, lengths):
    rows = [(i, None if n is None else "x" * n, "en", "s", n) for i, n in lengths]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    out = QUERIES[name](spark, str(folder))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = c.execute(ORACLE_SQL[name]).fetchall()
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))


def test_padding_of_empty_and_unknown_texts(spark, tmp_path):
    compared(spark, tmp_path / "odd", "label_mask_padding", LENGTHS)
    compared(spark, tmp_path / "none", "label_mask_padding", [])


def test_audit_of_empty_and_unknown_texts(spark, tmp_path):
    compared(spark, tmp_path / "odd", "token_audit", LENGTHS)
    compared(spark, tmp_path / "empty", "token_audit", [(1, 0), (2, 0)])
    compared(spark, tmp_path / "unknown", "token_audit", [(1, None)])
    compared(spark, tmp_path / "none", "token_audit", [])
