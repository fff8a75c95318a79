import collections
import itertools
import re
import struct
import zlib

import duckdb
import pytest

import corpus_pipeline
import public_tokenizers
from siftlight.llm import crf_langid, oracles


@pytest.fixture
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_keep_columns_and_rows(spark, sf, docs, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "simhash", "secret_scans", "packing"]
    held = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, held, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        before, now = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (held, after))
        assert now <= before and after.count() == len(now)
        if name == "secret_scans":
            assert now == before and after.where("text LIKE '%AKIA________________%'").count() == 0
        held = after
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").join(docs, "doc_id").where("size(split(trim(text), '[ \\\\s]+')) >= 20")
    texts = {r["text"] for r in held.select("text").collect()}
    lost = [r for r in good.collect() if r["text"] not in texts and "AKIA" not in r["text"] and "=" not in r["text"]]
    assert len(lost) <= 0.1 * good.count()


def test_run(spark, sf, docs):
    pieces = corpus_pipeline.run(spark, sf).collect()
    sizes = collections.Counter()
    for r in pieces:
        sizes[r["doc_id"]] += r["length"]
    assert all(sizes[r["doc_id"]] == r["doc_tokens"] for r in pieces) and 0 < len(sizes) <= docs.count()


def test_odd_rows_and_extra_columns(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rules long, key string, copies int"
    rows = [(None, None, None, None, None, 1, "k", 2), (1, "", "en", "s", 0, 1, "k", 2), (1, "", "en", "s", 0, 1, "k", 2), (2, "abc def", "en", None, 7, None, None, None)]
    odd, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, sf)
        assert found.count() <= 4 or name == "packing"
        assert stage(spark, none, sf).count() == 0
        if name != "packing":
            assert found.columns == odd.columns


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def in_sql(rows, sql):
    """Rows of a query over the given (doc_id, text), by doc_id."""
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", list(rows.items()))
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        return {r["doc_id"]: r for r in (dict(zip(names, x)) for x in found.fetchall())}


def shingles(text):
    words = re.sub("[A-Z]+", lambda m: m[0].lower(), text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_pipeline(docs, rows):
    """Texts of the documents that are left, by id: every decision by other means than the stages'."""
    model = crf_langid.fit(docs)
    told = {i: model.judge([t], familiar=True)[0] for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if told[i][0] != crf_langid.UND and told[i][2] >= 0}
    verdicts = in_sql(rows, oracles.quality_rules())
    rows = {i: t for i, t in rows.items() if verdicts[i]["kept"]}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in rows.items()}
    for a, b in itertools.combinations(sorted(rows), 2):
        p, q = sets[a], sets[b]
        if p & q and len(p & q) >= 0.8 * len(p | q):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = {i: t for i, t in rows.items() if find(i) == i}
    spans = in_sql(rows, oracles.secret_scans())
    clean = {}
    for i, text in rows.items():
        out, at = [], 0
        for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[i]["spans"].split(",") if x):
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, b)
        clean[i] = "".join(out) + text[at:]
    return clean


def test_run_against_brute_force(spark, sf, docs, tmp_path):
    from tokenizers import Tokenizer

    own = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()]
    base = max((r[1] for r in own if r[2] == "en" and 100 < len(r[1].split()) < 400 and "=" not in r[1]), key=len)
    words = base.split()
    more = [" ".join(words[:50] + ["changed"] + words[51:]), base, "token=abcdef123456 " + base[::1].replace(words[3], "else", 1) + " AKIA" + "Q7" * 10, None, "", "short"]
    rows = own + [(90_000 + i, t, None, None, None) for i, t in enumerate(more)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline(table, {r[0]: r[1] for r in rows})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in want.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(want) and 90_000 not in want and 90_001 not in want
    at = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}


def test_run_on_empty_and_repeated_rows(spark, tmp_path, docs):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    some = docs.where("lang = 'en'").limit(40)
    some.union(some).union(spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)).write.parquet(f"{tmp_path}/twice/documents.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()
    assert pieces and all(n == 1 for n in collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0).values())
