import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlight.functions import text
from siftlight.operators import chunk
from siftlight.sources import markdown


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["a  b\u001cc", "  x  y\t\nz ", "", " \n", "　q"])
def test_collapse_like_unicode_split(spark, raw):
    assert one(spark, raw, text.collapse(F.col("t"))) == " ".join(raw.split())


def test_sentences(spark):
    assert one(spark, "Hi there. (Yes) no! \"Ok\" 3.5 is. it", text.sentences(F.col("t"))) == ["Hi there.", "(Yes) no!", '"Ok" 3.5 is. it']
    assert one(spark, " \n ", text.sentences(F.col("t"))) == []


def test_tokens_hash_preview_wrap(spark):
    assert one(spark, "Café No.7, it's", text.tokens(F.col("t"))) == ["caf", "no", "7", "it", "s"]
    assert one(spark, "abc", text.content_hash(F.col("t"), "m")) == hashlib.sha256(b"m\0abc").hexdigest()
    assert one(spark, "a  bc", text.preview(F.col("t"), 4)) == "a bc..."
    assert one(spark, "abcd", text.preview(F.col("t"), 4)) == "abcd"
    assert one(spark, "w" * 60 + " a b", text.wrap(F.col("t"))) == "<br>" + "w" * 60 + "<br>a b"
    assert one(spark, "", text.wrap(F.col("t"))) == ""


def test_chunk_sizes():
    parts = [c * n for c, n in (("a", 500), ("b", 400), ("c", 53))]
    assert [len(x) for x in chunk.chunks_of(parts)] == [500, 901, 453 + 1]
    assert chunk.chunks_of([]) == []
    assert chunk.chunks_of(["x" * 25], 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunk.chunks_of(["aa bbbb " + "y" * 12 + " cc"], 8, 0) == ["aa bbbb", "y" * 8, "yyyy cc"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=40).map(str.strip).filter(bool), max_size=12), st.integers(5, 30), st.integers(-3, 45))
def test_chunk_bounds(parts, limit, overlap):
    parts = [" ".join(p.split()) for p in parts]
    chunks = chunk.chunks_of(parts, limit, overlap)
    assert all(len(c) <= (limit if overlap <= 0 else max(limit, overlap) + 1 + limit) for c in chunks)
    if overlap <= 0 and all(len(w) <= limit for p in parts for w in p.split()):
        assert " ".join(chunks) == " ".join(parts)


def test_chunk_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert chunk.chunk(df, "doc_id").count() == 1164
    assert chunk.chunk(df, "doc_id", limit=200, overlap=50).count() == 4247
    with pytest.raises(ValueError):
        chunk.chunk(df, "doc_id", limit=0)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "A. B")], "doc_id long, text string")
    assert [tuple(r) for r in chunk.chunk(odd, "doc_id").collect()] == [(None, 0, "A. B")]


MARKDOWN = """<!-- one line --> lost
intro line
<!-- opens
hidden --> also hidden
# Documents
- first
* second
- 1. x
2024. x
-
#tag
+ third

# Query about
what is it
second line
## More
tail
"""


def test_markdown():
    documents, query = markdown.parse(MARKDOWN)
    assert documents == ["intro line", "first", "second", "1. x", "x", "-", "third", "tail"]
    assert query == "what is it"
    assert markdown.parse("") == ([], None)


def test_markdown_files(spark, tmp_path):
    (tmp_path / "in.md").write_text(MARKDOWN)
    rows = markdown.read(spark, str(tmp_path / "in.md")).collect()
    assert [r["kind"] for r in rows].count("document") == 8 and rows[-1]["text"] == "what is it"
    out = spark.createDataFrame([(1, "b\n b"), (0, "a")], "ordinal long, text string")
    markdown.write(out, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "# Documents\n\n- a\n- b b\n"
    assert re.match("# Doc", part.read_text())
