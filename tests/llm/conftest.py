import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

# One task's worth of odd texts: null, empty, short, long, tied, repeated, not ASCII.
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "One two THREE four",
    "one two three four",
    "the quick brown fox jumps over the lazy dog and runs away from the angry bear",
    "The quick brown fox jumps over the lazy dog and runs away from the angry bear",
    "é è ñ ß İ Ä ä über café " * 30,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 400,
    "mail a.b@c.de and +1 (555) 123-4567, card 4111 1111 1111 1111, at 10.0.0.255 or 1.2.3.256",
    "Released under the MIT License. mit license; GNU General Public License, version 3.",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null ids and sources, repeated rows and columns that clash with results."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, TEXTS[6], None, None, None), (3, "another text with the same id as before", "de", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, size long"
    names = ["shard", "n_words", "score", "pii", "kept", "license", "component_id"]
    docs = spark.createDataFrame(rows, schema)
    return docs.selectExpr("*", *[f"'x' as {name}" for name in names]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    """The smallest given documents as a table and as rows."""
    folder = os.environ.get("SMALL_FOLDER", "/root/testdata/sf0.001")
    frame = pd.read_parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), list(zip(frame["doc_id"], frame["text"], strict=True)), folder


@pytest.fixture(scope="session")
def duck(small):
    connection = duckdb.connect()
    for path in sorted(Path(small[2]).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection
