"""The registered queries against brute force, over odd rows and over the smallest table."""

import base64
import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

import public_tokenizers as P
from siftlight.llm import queries as Q

ODD = [
    None, "", " ", "a", "A b", "The the THE", "x" * 5000, "word " * 3000, "é" * 7 + "\n\n" + "日本 語 テキスト", "tok\x00en", "<|endoftext|> and <|startoftext|>",
    "password = 'abcdef123' secret:short token=token=abcdefgh", "AKIA" + "Z9" * 9 + " " + "0a" * 20, "PASSWD : abc", "api_key=\"" + "k" * 8 + "\" apikey: 123456",
    "Released under the MIT License. cc-by-nc, Apache License version 2", "released undr the mit licence", " nbsp sep", "1 2 3 4 5 6 7 8 9 " * 5,
    "line\nline\nline\n\n \nline", "😀 emoji 👩‍👩‍👧 text", "\t tabs\x0b\x0c\r\n", "don't I'LL we've 'tis", "aaa" * 20 + " " + "b" * 3,
]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def u32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    base = {r["doc_id"]: r["text"] for r in rows}
    return base | {10_000 + 37 * i: t for i, t in enumerate(ODD)}


@pytest.fixture(scope="module")
def folder(spark, sf, texts, tmp_path_factory):
    """documents with odd rows, and columns whose names results use too."""
    where = tmp_path_factory.mktemp("tables")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [(i, t, lang.get(i), "s", 0, "x", 1, 2.0, "key") for i, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, score double, fp string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{where}/documents.parquet")
    return str(where)


def result(spark, folder, name):
    return {r["doc_id"]: r for r in getattr(Q, name)(spark, folder).collect()}


def test_packing(spark, folder, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in texts.items()}
    pieces = Q.op1_packing(spark, folder).collect()
    at, room = collections.Counter(), collections.Counter()
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(u32(own[r["start"] : at[r["doc_id"]]])) == r["ids_crc32"]
    assert at == {i: len(x) for i, x in ids.items()}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == room[r["sequence_id"]]
        room[r["sequence_id"]] += r["length"]
    segments = collections.Counter(r["sequence_id"] for r in pieces)
    assert max(room.values()) <= 2048 and max(segments.values()) <= 64
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in room.values())
    assert padding < 0.02 * sum(room.values())


def test_license_scans(spark, folder, texts):
    phrases = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    found = result(spark, folder, "op2_license_scans")
    assert set(found) == set(texts)
    for i, r in found.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[i] or ""))
        starts, labels = [], set()
        for p, label in phrases:
            n = len(p.split())
            new = [j for j in range(len(words) - n + 1) if words[j : j + n] == p.split()]
            starts += new
            labels |= {label} if new else set()
        assert (r["n_words"], r["n_base"]) == (len(words), len(starts))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""}
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) and 0 <= r["score"] <= 1
    fuzzy = found[10_000 + 37 * ODD.index("released undr the mit licence")]
    assert fuzzy["labels"] == "mit" and fuzzy["base_labels"] == "" and 0 < fuzzy["score"] < 1


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secret_scans(spark, folder, texts):
    found = result(spark, folder, "op3_secret_scans")
    assert set(found) == set(texts)
    order = {"assign": 0, "access": 1, "hex": 2}
    for i, r in found.items():
        t = texts[i] or ""
        spans = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = collections.Counter(s[0] for s in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        joined = ",".join(":".join(map(str, s)) for s in sorted(spans, key=lambda s: (s[1], order[s[0]])))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t[:80]
        assert set(joined.split(",")) <= set(r["spans"].split(",")) | {""}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(spark, folder, texts):
    found = result(spark, folder, "op4_simhash")
    prints = {i: plain_fingerprint(t or "") for i, t in texts.items()}
    ids, root = list(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_bpe_tree(spark, folder, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in result(spark, folder, "op5_bpe_tree").items():
        ids = e.encode_ordinary(texts[i] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(u32(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_language_id(spark, folder, texts, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = result(spark, folder, "op6_language_id")
    assert set(found) == set(texts)
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[i] or ""))
    held = [i for i in lang if found[i]["held_out"]]
    assert np.mean([found[i]["lang_pred"] == lang[i] for i in held]) > 0.95


def test_sharding(spark, folder, texts):
    found = result(spark, folder, "op7_sharding")
    assert set(found) == set(texts)
    slots = collections.defaultdict(list)
    for i, r in found.items():
        raw = (texts[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_token_files(spark, folder, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    found, at = result(spark, folder, "op8_token_files"), 0
    for i in sorted(texts):
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert tuple(found[i])[1:] == (at, len(ids), zlib.crc32(u32(ids))), texts[i]
        at += len(ids)


def test_quality_rules(spark, folder, texts):
    for i, r in result(spark, folder, "op9_quality_rules").items():
        t = texts[i] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        covered = {j + k for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])


P36, B = 2**36 - 5, 49_329_351


def plain_items(text, fine):
    """What the grams are made of: words, or the letters of a short text."""
    import regex

    if fine and len(text) > 1024:
        return []
    if not regex.search(r"[\p{L}\p{N}]", text):
        return list(text)
    if fine:
        return list(regex.sub(r"[^\p{L}\p{N}]+", "", text.lower()))
    spaced = regex.sub(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]", r" \g<0> ", text.lower())
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", spaced) if w]
    return [x for w in words for x in (w if len(w) > 40 else [w])]


def plain_winnow(text, fine):
    """Selected (place, hash): rolling hashes by their recurrence, rightmost smallest of each window."""
    k, window = (5, 2) if fine else (5, 16)
    signed = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in plain_items(text, fine)]
    h = [(x - 2**64 if x >= 2**63 else x) % (P36 - 1) + 1 for x in signed]
    if not h:
        return []
    if len(h) <= k:
        grams = [sum(x * B ** (k - 1 - i) for i, x in enumerate(h)) % P36]
    else:
        grams = [sum(x * B ** (k - 1 - i) for i, x in enumerate(h[:k])) % P36]
        for out, new in zip(h, h[k:]):
            grams.append(((grams[-1] - out * B ** (k - 1)) * B + new) % P36)
    picked = []
    for i in range(max(1, len(grams) - window + 1)):
        place = min(range(i, min(i + window, len(grams))), key=lambda j: (grams[j], -j))
        if not picked or picked[-1][0] != place:
            picked.append((place, grams[place]))
    return picked


def plain_digest(text):
    shown = [",".join(f"{h << 27 | (2**27 - 1 - p):X}" for p, h in plain_winnow(text, fine)) for fine in (False, True)]
    return hashlib.sha256(";".join(shown).encode()).hexdigest()


def plain_likeness(a, b):
    fine = [{h for _, h in plain_winnow(t, True)} for t in (a, b)]
    p, q = fine if all(fine) else ({h for _, h in plain_winnow(t, False)} for t in (a, b))
    return len(p & q) / len(p | q) if p | q else 1.0


def test_fingerprints(spark, folder, texts):
    found = result(spark, folder, "op10_fingerprints")
    assert set(found) == set(texts)
    order = sorted(texts, reverse=True)
    by_text = {}
    for n, i in enumerate(order):
        t, following = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = found[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_digest(t), plain_digest(edited)), t[:60]
        assert r["near_edited"] == pytest.approx(plain_likeness(t, edited)) and r["near_next"] == pytest.approx(plain_likeness(t, following))
        assert edited != t or (r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"])
    long = [i for i in order if len(texts[i] or "") > 1500 and i < 10_000]
    assert np.mean([found[i]["near_edited"] for i in long]) > np.mean([found[i]["near_next"] for i in long]) + 0.15


#: Queries over documents; the others have files of their own.
DOCUMENTS = sorted(set(Q.queries()) - {"op12_hard_negatives", "op13_conversation_trie"})


@pytest.mark.parametrize("name", DOCUMENTS)
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.queries()[name](spark, str(tmp_path)).count() == 0


REPEATED = [(1, "same text of a few words here"), (1, "same text of a few words here"), (None, "no id at all"), (None, None), (2, None), (None, "no id at all")]


@pytest.mark.parametrize("name", DOCUMENTS)
def test_repeated_rows_and_null_ids(spark, tmp_path, name):
    spark.createDataFrame([(*r, None, None, None) for r in REPEATED], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.queries()[name](spark, str(tmp_path)).collect()
    if name == "op1_packing":  # short documents are packed whole, and one of them is cut for the power of two
        assert sum(r["start"] == 0 for r in rows) == len(REPEATED)
        rows = [r for r in rows if r["start"] == 0]
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in REPEATED)


def test_very_long_texts(spark, tmp_path):
    """Texts of millions of characters: of words, of one word, and of secrets and notices over and over."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))
    texts = [words, "x" * 1_000_000, "token=abcdef under the mit licence\n" * 30_000, "a b c d e f g h " * 100_000, "é" * 300_000]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {name: Q.queries()[name](spark, str(tmp_path)).collect() for name in DOCUMENTS}
    for name, rows in found.items():
        assert {r["doc_id"] for r in rows} == set(range(5)), name
    of = {name: {r["doc_id"]: r for r in rows} for name, rows in found.items()}
    assert of["op2_license_scans"][2]["n_words"] == 180_000 and of["op2_license_scans"][2]["labels"] == "mit"
    assert of["op3_secret_scans"][2]["n_assign"] == 30_000
    assert of["op4_simhash"][0]["fingerprint"] == f"{plain_fingerprint(words):016x}"
    assert of["op5_bpe_tree"][0]["decoded_sha256"] == hashlib.sha256(words.encode()).hexdigest()
    assert of["op9_quality_rules"][3]["n_repeat_words"] == 800_000
    pieces = collections.Counter()
    for r in found["op1_packing"]:
        pieces[r["doc_id"]] += r["length"]
    assert all(pieces[r["doc_id"]] == r["doc_tokens"] for r in found["op1_packing"])


@pytest.mark.parametrize("name", sorted(set(Q.oracle_sql()) & set(DOCUMENTS)))
def test_sql_agrees(spark, folder, texts, name):
    import duckdb

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        cursor = con.execute(Q.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        want = {r["doc_id"]: r for r in (dict(zip(names, x)) for x in cursor.fetchall())}
    assert {i: r.asDict() for i, r in result(spark, folder, name).items()} == want
