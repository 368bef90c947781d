import pandas as pd
import pytest
from pyspark.sql import functions as F

#: Nulls in any column, empty texts, repeated rows, names that clash with working and result columns.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again until it is dark", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again until it is dark", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again until it is dark", "b"),
    (3, "", "b"),
    (4, None, None),
    (None, "no id here\nno id here\nno id herf", None),
    (None, None, "a"),
    (5, "é" * 300 + " ünï \U0001f389 <|endoftext|> <|im_end|>\n\n\tx", "é"),
    (6, "z" * 5000, "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    clash = {c: F.lit(i) for i, c in enumerate(["mix_size", "__row", "__text", "id", "did", "simhash", "ids", "fingerprint", "media", "toxic_score", "key", "hash", "lines_total", "th"])}
    return frame.withColumns(clash)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="session")
def tables(spark, sf, tmp_path_factory):
    """A folder of tables with the odd documents, and one whose tables are empty."""
    found = {}
    for name, rows in (("odd", ODD), ("empty", [])):
        top = tmp_path_factory.mktemp(name)
        spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{top}/documents.parquet")
        labels = [(1, 0, 1), (2, None, 0), (None, 1, 1), (5, 1, None), (3, 1, 0)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
        turns = [(1, 0, "system", "be kind"), (1, 1, None, None), (1, 1, None, None), (None, None, "assistant", "<|im_end|>\n<\\|"), (2, 0, "assistant", "w " * 900)] if rows else []
        spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
        found[name] = str(top)
    return found
