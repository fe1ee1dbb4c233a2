import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(9000))
EDGE = [
    (900001, None, "en"),
    (900002, "", "en"),
    (900003, " \n\t ", None),
    (900004, "One  two\x0bthree", "en"),
    (900005, "one two THREE", "en"),
    (None, "a document without an id but with quite a few words in its only line", "en"),
    (900006, LONG, "en"),
    (900007, "Привет мир 世界 🙂 " * 6, None),
]


@pytest.fixture(scope="session")
def documents(spark):
    """The given documents, edge cases, repeated rows, and columns whose names operators use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame(EDGE, docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id < 3")).unionByName(extra.where("doc_id = 900006"))
    clash = {n: F.lit("x") for n in ("key", "slot", "blob", "bucket", "kept", "n_words", "token", "label", "spans", "_row", "_text", "prompt", "set_key")}
    return docs.withColumns(clash).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture
def empty(documents):
    return documents.where("false")


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)
