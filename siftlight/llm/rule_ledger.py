"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps, per document, the
measurements and one integer whose bit r says that rule r failed. A policy is a version
with a set of rules: applying one, comparing two or asking what each rule adds needs
only bitwise operations on the ledger, not the texts.

Words are runs of characters other than space and U+0009 to U+000D. Defined results: a
null or empty text has no words, and fails ``few_words``; a rule on a share of nothing
doesn't fail; repeated rows and null ids are kept; other columns are ignored; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import slices, text_or_empty, tidy

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes(c for c in range(256) if chr(c).isalpha() and c < 128 or c >= 128)
_WINDOW = 8

#: What is measured, in the order of the ledger's columns.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echo_words",
    "n_bytes", "n_letter_bytes", "n_ellipsis_lines", "n_bullet_lines",
)


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[dict[str, Column]], Column]


#: A rule's place here is its bit in every ledger: add at the end, never reorder.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("many_words", lambda m: m["n_words"] > 1_000_000),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("echoed_words", lambda m: 4 * m["n_echo_words"] > m["n_words"]),
    Rule("few_letters", lambda m: 2 * m["n_letter_bytes"] < m["n_bytes"]),
    Rule("ellipsis_lines", lambda m: 10 * m["n_ellipsis_lines"] > 3 * m["n_lines"]),
    Rule("bullet_lines", lambda m: 10 * m["n_bullet_lines"] > 9 * m["n_lines"]),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


#: Published versions; a version is never changed.
POLICIES = {
    "base": Policy("base", ("few_words", "repeated_windows")),
    "v1": Policy("v1", ("few_words", "repeated_windows", "symbols", "duplicate_lines", "few_letters")),
    "v2": Policy("v2", tuple(rule.name for rule in RULES)),
}


def _repeat_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more in the text."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = h[:n].copy()
    for j in range(1, _WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # Windows whose hashes agree are compared word by word.
    twin = np.zeros(n, dtype=bool)
    twin[1:] |= same
    twin[:-1] |= same
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in order[twin].tolist():
        first = seen.setdefault(tuple(words[i : i + _WINDOW]), i)
        if first != i:
            for at in (first, i):
                covered[at] += 1
                covered[at + _WINDOW] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    packed = raw.translate(None, _SPACES)
    ends = [x.rstrip(_SPACES) for x in lines]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        sum(map(bytes.__eq__, words, words[1:])),
        len(packed),
        len(packed) - len(packed.translate(None, _LETTERS)),
        sum(x.endswith((b"...", "…".encode())) for x in ends),
        sum(x.lstrip(_SPACES).startswith((b"-", b"*", "•".encode())) for x in lines),
    )


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``failed``: the bits of the rules that fail."""
    schema = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])

    def run(batches):
        for ids, texts in slices(batches):
            columns = list(zip(*map(measure, texts)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    measured = picked.mapInArrow(run, ", ".join(f"{x.name} long" for x in schema))
    return measured.withColumn("failed", _failed({m: F.col(m) for m in MEASURES}))


def _failed(m: dict[str, Column]) -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(BIT[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, documents that only it fails
    (kept if the rule were dropped), and the policy's own rejections. The documents are
    first counted by their bits, of which there are few different ones."""
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(BIT[x]).alias("bit")) for x in policy.rules)))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only"),
        F.coalesce(F.sum(F.when(F.col("bits") != 0, F.col("n"))), F.lit(0)).alias("rejected"),
    ).withColumn("policy", F.lit(policy.version))


def keep(docs: DataFrame, policy: Policy, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns. The text is
    measured where it is: no shuffle, and repeated or null ids don't matter."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text_col))
            good = []
            for at in range(0, batch.num_rows, 256):
                good += [_passes(measure(t or ""), policy) for t in texts.slice(at, 256).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)


def _passes(values: tuple[int, ...], policy: Policy) -> bool:
    return not _bits(dict(zip(MEASURES, values))) & policy.mask


def _bits(m: dict[str, int]) -> int:
    """The failed bits of plain measurements."""
    return sum(BIT[rule.name] for rule in RULES if rule.fails(m))
