import hashlib
import zipfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from siftlight.operators.embed import HashingEmbedder
from siftlight.sources import files, markdown
from siftlight.sources.store import Properties, Store, build_rows, hashed
from siftlight.sources.versions import Conflict, Versions
from siftlight.streaming import ingest


def records(spark, rows):
    return spark.createDataFrame(rows, "text string, source string")


def test_ingest_only_what_is_new(spark, tmp_path):
    store, e = Store(spark, str(tmp_path / "t")), HashingEmbedder(16)
    first = [(f"text {i}", "a") for i in range(10)]
    done = store.ingest(records(spark, first), e)
    assert (done.fresh, done.hits, done.stale) == (10, 0, 0)
    ids = {r["text"]: r["id"] for r in store.read().collect()}
    done = store.ingest(records(spark, first + [("text 1", "b")]), e)
    assert (done.fresh, done.hits, done.stale) == (0, 10, 0)
    done = store.ingest(records(spark, first + [("new", "b")]), e)
    assert (done.fresh, done.hits, done.stale) == (1, 10, 0)
    store.store_labels(store.read().selectExpr("chunk_hash", "1 AS cluster"))
    done = store.ingest(records(spark, first[1:] + [("new", "b"), ("newer", None)]), e)
    assert (done.fresh, done.hits, done.stale) == (1, 10, 1)
    rows = {r["text"]: r for r in store.read().collect()}
    assert "text 0" not in rows and rows["newer"]["cluster"] is None and rows["new"]["cluster"] == 1
    assert rows["text 5"]["id"] == ids["text 5"] and len(rows) == 11
    done = store.ingest(records(spark, first), HashingEmbedder(8))
    assert done.fresh == 10 and store.properties() == Properties("hashing-8", 8)
    assert store.ingest(records(spark, first), HashingEmbedder(8), reset=True).fresh == 10
    store.drop_old()
    assert store.read().count() == 10


def test_changes_write_only_what_changed(spark, tmp_path):
    store, e = Store(spark, str(tmp_path / "t")), HashingEmbedder(8)
    texts = [(f"text {i}", "b" if i % 2 else "a") for i in range(20)]
    store.ingest(records(spark, texts), e)
    first = store.manifest()
    store.ingest(records(spark, texts + [("one more", "c")]), e)
    then = store.manifest()
    assert then.rows[:1] == first.rows and len(then.rows) == 2 and not then.gone and store.verify() == 21
    assert spark.read.parquet(f"{store.root}/{then.rows[1]}").count() == 1
    store.ingest(records(spark, texts[1:] + [("one more", "c")]), e)
    assert store.manifest().rows == then.rows and store.verify() == 20
    store.ingest(records(spark, texts + [("one more", "c")]), e)  # a text that comes back
    assert store.verify() == 21 and len(store.manifest().rows) == 3
    held = {r["text"] for r in store.read().collect()}
    store.compact()
    assert len(store.manifest().rows) == 1 and {r["text"] for r in store.read().collect()} == held and store.verify() == 21
    store.drop_old()
    assert store.verify() == 21 and len([x for x in (tmp_path / "t").iterdir() if x.name.startswith(("rows", "gone"))]) == 1


def test_first_source_and_rows_of_given_vectors(spark, tmp_path):
    rows = spark.createDataFrame([("x", "b", 0), ("x", "a", 5), ("x", None, 0), ("y", None, 1)], "text string, source string, ordinal int")
    found = {r["text"]: r["source"] for r in hashed(rows, "m").collect()}
    assert found == {"x": "a", "y": None}
    made = build_rows(spark, ["x", "y"], [[1, 2], [3, 4]], "m").collect()
    assert [r["chunk_hash"] for r in made] == [hashlib.sha256(f"m\0{t}".encode()).hexdigest() for t in "xy"]
    with pytest.raises(ValueError):
        build_rows(spark, ["x"], [], "m")


def test_no_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert not store.exists() and store.properties() is None
    with pytest.raises(FileNotFoundError):
        store.read()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    e, store = HashingEmbedder(8), Store(spark, str(tmp_path / "t"))
    records(spark, [("a", "x"), ("b", "x"), ("a", "y")]).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema("text string, source string").parquet(str(tmp_path / "in/*"))
    ingest.start(stream, store, e, str(tmp_path / "c")).awaitTermination()
    assert store.read().count() == 2
    records(spark, [("b", "x"), ("c", "x")]).write.parquet(str(tmp_path / "in/2"))
    ingest.start(stream, store, e, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["text"] for r in store.read().collect()) == ["a", "b", "c"]


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("Hello there. This is text.")
    (tmp_path / "b.fb2").write_text("<FictionBook><body><p>One</p><p>Two  x</p></body></FictionBook>")
    (tmp_path / "c.fb2").write_text("<broken")
    (tmp_path / "d.txt").write_text("  ")
    (tmp_path / "e.log").write_text("no")
    pages = files.extract_pages(files.find(spark, str(tmp_path)))
    texts = {r["source"]: r["text"] for r in files.extract_texts(pages).collect()}
    assert texts == {"a.TXT": "Hello there. This is text.", "b.fb2": "One\nTwo x", "d.txt": "  "}
    bad = {r["source"]: r["reason"] for r in files.quarantine(pages).collect()}
    assert set(bad) == {"c.fb2", "d.txt"} and bad["d.txt"] == "no text"
    named = files.extract_pages(files.find(spark, str(tmp_path / "e.log")))
    assert named.first()["text"] == "no"
    assert files.extract_chunks(files.extract_texts(pages)).count() == 2


def test_books(spark, tmp_path):
    """Text of nested blocks comes once, that of bare containers too, in the order of the spine."""
    page = "<html xmlns='http://www.w3.org/1999/xhtml'><head><title>no</title></head><body>{}</body></html>"
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as book:
        book.writestr("META-INF/container.xml", "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='OPS/c.opf'/></rootfiles></container>")
        book.writestr("OPS/c.opf", "<package xmlns='http://www.idpf.org/2007/opf'><manifest><item id='x' href='ch%2010.xhtml'/><item id='y' href='ch2.xhtml'/></manifest><spine><itemref idref='y'/><itemref idref='x'/></spine></package>")
        book.writestr("OPS/ch 10.xhtml", page.format("<div>Bare&nbsp;text<p>in <b>bold</b></p>tail</div>"))
        book.writestr("OPS/ch2.xhtml", page.format("<ul><li><p>Item &amp; more</p></li></ul><br>not well-formed"))
    (tmp_path / "b.fb2").write_text("<FictionBook><description><title-info>no</title-info></description><body><title><p>Head</p></title><p>Text &mdash; x</p></body><binary>QUJD</binary></FictionBook>")
    pages = files.extract_pages(files.find(spark, str(tmp_path)))
    texts = {r["source"]: r["text"] for r in files.extract_texts(pages).collect()}
    assert texts == {"a.epub": "Item & more\nnot well-formed\n\nBare text\nin bold\ntail", "b.fb2": "Head\nText \u2014 x"}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        files.read_texts(spark, str(tmp_path / "none"))


def test_markdown_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0, "b0"), ("a", 1, "a  1"), ("b", 1, "b1"), ("a", 0, "a0")], "source string, ordinal int, text string").repartition(3)
    markdown.write(rows, str(tmp_path / "m"), order=("source", "ordinal"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["# Documents", "", "- a0", "- a 1", "- b0", "- b1"]
    assert [(r["ordinal"], r["text"]) for r in markdown.read(spark, str(tmp_path / "m")).orderBy("ordinal").collect()] == [(0, "a0"), (1, "a 1"), (2, "b0"), (3, "b1")]


def test_embedding_width(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    store.ingest(records(spark, [("a", None)]), HashingEmbedder(4))
    assert np.array(store.read().first()["embedding"]).shape == (4,)


def test_versions_are_whole_and_exclusive(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.last() == 0
    assert versions.publish({"a": 1}, 0) == 1 and versions.read(1) == {"a": 1}
    # A writer that has begun but not renamed is not seen.
    (tmp_path / "v" / "_versions" / ".half").write_text('{"a": ')
    assert versions.numbers() == [1]
    assert versions.publish({"a": 2}, 1) == 2
    with pytest.raises(Conflict):
        versions.publish({"a": 3}, 1)
    # Another gets there between the look and the rename.
    late = Versions(spark, str(tmp_path / "v"))
    late.last = lambda: 1
    with pytest.raises(Conflict):
        late.publish({"a": 4}, 1)
    assert versions.read(2) == {"a": 2} and sorted(x.name for x in (tmp_path / "v" / "_versions").iterdir() if not x.name.endswith(".crc")) == [".half", "000001.json", "000002.json"]


def test_two_writers_lose_nothing(spark, tmp_path):
    e, root = HashingEmbedder(8), str(tmp_path / "t")
    ingest.append_batch(Store(spark, root), records(spark, [("first", "s")]), e)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: ingest.append_batch(Store(spark, root), records(spark, [(f"text {i} {j}", "s") for j in range(4)]), e), range(3)))
    assert Store(spark, root).verify() == 13
    old = Store(spark, root)
    after = old.versions.last()
    old.ingest(records(spark, [("first", "s"), ("other", "s")]), e)
    with pytest.raises(Conflict):
        old.change(None, spark.createDataFrame([("x",)], "chunk_hash string"), after)
    # What another writer has written and not published yet stays.
    pending = tmp_path / "t" / "rows-999999-aaaaaaaa"
    pending.mkdir()
    old.drop_old()
    assert pending.exists() and old.verify() == 2 and len(old.versions.numbers()) == 1
