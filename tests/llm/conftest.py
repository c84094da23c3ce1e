import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample():
    """Rows (doc_id, text, lang) of the smallest table, whole texts."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["lang"]) for r in rows]


ODD = [
    (1000001, None),
    (1000002, ""),
    (1000003, " \t\n\r\x0b\x0c "),
    (1000004, "x" * 70_000),
    (1000005, "don't we'll THEY'D 's   café́ \U0001f642 <|endoftext|> 12² 　\n\n  end  "),
    (1000006, "same words here again and again"),
    (1000007, "same words here again and again"),
    (1000008, "مرحبا 你好 one"),
    (1000009, "..."),
    (1000010, "a b c d e\n" * 3000),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
