"""Secret scanning through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean trigram query (``trigrams``). The index
holds, for blocks of documents, a posting list for every trigram that some query asks
for. A rule's candidates are the unions, over the query's alternatives, of intersections
of postings. Only candidates are verified by the rule's regular expression; rules
without mandatory trigrams scan every text.

Documents are known to the index by a hash of id and text. Should two share one, either
may become a needless candidate, which verification corrects. Blocks hold a bounded
number of documents on average, by hash, so no posting list grows with the input or with
how common a trigram is.

Defined results: a null or empty text has no spans; null ids and repeated rows each get
their own row; other columns are ignored by ``scan`` and kept by ``redact``; an empty
table gives no rows. Spans of one start are in order of kind. A text of any length is
scanned whole. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlight.llm.common import settle, text_or_empty
from siftlight.llm.trigrams import Query, trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans, leftmost and not overlapping; then those go whose
    ``group`` is shorter than ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))

_B64 = "[A-Za-z0-9+/]"
#: A PEM key from its BEGIN line through the END line, if that is the next dashed line. Else through the key's headers,
#: all base64 that follows up to its last piece of 24 or more characters, and what base64 the next line starts with,
#: which may be the key's short last line. No lookarounds or possessive loops, so that SQL's engine takes it too; loops
#: of groups are bounded, for Java's stack (lines that aren't indented all go to one loop of characters).
_PEM_END = r"(?:[^-]+-){0,30}[^-]*-----END [A-Z ]*PRIVATE KEY-----"
_PEM_HEADS = r"(?:[\r\n]+[\x20\t>]*(?:Proc-Type|DEK-Info):[^\r\n]*)*"
_PEM_PIECE = rf"[\x20\t\r\n>\\]+[A-Za-z0-9+/=\r\n\\]*{_B64}{{8}}{_B64}{{8}}{_B64}{{8}}=*"
_PEM_BODY = rf"(?:{_PEM_PIECE}){{1,120}}(?:(?:\r?\n|\\)[\x20\t>]*{_B64}+=*)?"
_PEM = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_PEM_END}|{_PEM_HEADS}{_PEM_BODY}|)"

#: The order is that of kinds at equal starts.
BASE_RULES = (
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", _PEM),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._-]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

#: So many candidates (16 bytes each) are broadcast.
_FEW = 2_000_000
_SPAN = "array<struct<start:bigint,end:bigint>>"


def _narrow(rule: Rule) -> str:
    """A pattern for whether the rule may match at all, quicker than the rule's own."""
    return rule.pattern[:-1] + f"{{{rule.least},}}" if rule.kind == "hex" else rule.pattern


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_docs: int = 4096) -> DataFrame:
    """A row per block of documents, with the posting list (keys of documents) of each
    trigram in a column of its own. ``docs``: doc_id and text, no nulls in text."""
    grams = sorted({g for rule in rules for s in rule.query or () for g in s})
    if not grams:
        raise ValueError("no rule has mandatory trigrams")
    blocks = max(1, math.ceil(docs.count() / block_docs))
    lowered = docs.select(_key().alias("key"), F.lower("text").alias("lowered"))
    held = F.filter(F.array(*map(F.lit, range(len(grams)))), lambda i: F.contains("lowered", F.element_at(F.array(*map(F.lit, grams)), i + 1)))
    postings = lowered.select("key", F.explode(held).alias("gram"))
    lists = [F.collect_set(F.when(F.col("gram") == i, F.col("key"))).alias(_column(g)) for i, g in enumerate(grams)]
    return postings.groupBy(F.pmod("key", F.lit(blocks)).alias("block")).agg(*lists)


def _column(gram: str) -> str:
    return "p_" + gram.encode().hex()


def _with_bit(keys: Column, bit: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(bit).cast("long").alias("bit")))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): documents that may match, with the bits of the rules they may match."""
    found = []
    for bit, rule in enumerate(rules):
        if rule.query is None:
            continue
        keys = None
        for alternative in rule.query:
            part = None
            for gram in sorted(alternative):
                postings = F.col(_column(gram))
                part = postings if part is None else F.array_intersect(part, postings)
            keys = part if keys is None else F.array_union(keys, part)
        found.append(_with_bit(keys, 1 << bit))
    each = index.select(F.explode(F.concat(*found)).alias("c")).select("c.key", "c.bit")
    return each.groupBy("key").agg(F.bit_or("bit").alias("rules"))


_BLOCK = 256


def _walked(pairs: Column) -> Column:
    """Spans of gaps and matches that follow each other. They are gathered by blocks, since
    every addition to an array copies it."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(s, p):
        first = s["at"] + p["gap"]
        return F.struct((first + p["size"]).alias("at"), F.concat(s["out"], F.array(F.struct(first.alias("start"), (first + p["size"]).alias("end")))).alias("out"))

    def block(s, b):
        some = F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK))
        begin = F.struct(s["last"]["at"].alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.struct(F.aggregate(some, begin, step).alias("last"), F.array_append(s["all"], s["last"]["out"]).alias("all"))

    none = F.struct(start.alias("last"), F.array().cast(f"array<{_SPAN}>").alias("all"))
    blocks = F.sequence(F.lit(0), F.floor(F.size(pairs) / _BLOCK).cast("int"))
    return F.aggregate(blocks, none, block, lambda s: F.flatten(F.array_append(s["all"], s["last"]["out"])))


def _spans(rule: Rule) -> Column:
    """Spans of a rule in ``text``: what is left of the text between the matches, and the
    matches, give the positions."""
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x))
    matches = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("size"))
    # Bound to a name, so that the pattern is searched once.
    walked = F.element_at(F.transform(F.array(pairs), _walked), 1)
    if not rule.least:
        return walked
    if rule.group == 0:
        return F.filter(walked, lambda x: x["end"] - x["start"] >= rule.least)
    parts = F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x))
    long_enough = F.filter(F.arrays_zip(walked.alias("span"), parts.alias("part")), lambda x: x["part"] >= rule.least)
    return F.transform(long_enough, lambda x: x["span"])


def _found(rule: Rule, bit: int) -> Column:
    """The rule's spans where they are called for; else none."""
    able = F.rlike("text", F.lit(_narrow(rule)))
    if rule.query is not None:
        able = (F.col("rules").bitwiseAND(F.lit(1 << bit)) != 0) & able
    return F.when(able, _spans(rule)).otherwise(F.array().cast(_SPAN))


def _verified(docs: DataFrame, rules: tuple[Rule, ...], block_docs: int) -> DataFrame:
    """``docs`` (doc_id, text and any others) with a column of spans for each kind."""
    picked = docs.select("doc_id", "text")
    found = settle(candidates(build_index(picked, rules, block_docs), rules))
    # Few enough candidates go to the texts; only where there are more do texts move.
    if found.count() <= _FEW:
        found = F.broadcast(found)
    keyed = docs.withColumn("key", _key()).join(found, "key", "left").drop("key")
    keyed = keyed.withColumn("rules", F.coalesce("rules", F.lit(0)))
    return keyed.withColumns({f"s_{rule.kind}": _found(rule, i) for i, rule in enumerate(rules)}).drop("rules")


def _merged(rules: tuple[Rule, ...]) -> Column:
    """All spans as structs in order of start, then kind."""
    def placed(i: int, rule: Rule) -> Column:
        return F.transform(
            f"s_{rule.kind}",
            lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("place"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")),
        )

    return F.array_sort(F.concat(*(placed(i, rule) for i, rule in enumerate(rules))))


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 4096) -> DataFrame:
    """doc_id, n_<kind> per base rule, ``base`` and ``found``: arrays of (start, place,
    kind, end), of the base rules and of all."""
    checked = _verified(_picked(docs, id_col, text_col), rules, block_docs)
    base = [rule for rule in rules if rule in BASE_RULES]
    return checked.select(
        "doc_id",
        *(F.size(f"s_{rule.kind}").cast("long").alias(f"n_{rule.kind}") for rule in base),
        _merged(tuple(base)).alias("base"),
        _merged(rules).alias("found"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Characters of a piece that a text is cut in, and spans that are put in at a time.
_PIECE, _SPANS = 1024, 256


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", block_docs: int = 4096) -> DataFrame:
    """``docs`` with every span, overlapping ones together, replaced by ``mark``. The
    columns and their order stay."""
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"),
    )
    checked = _verified(inner, rules, block_docs).withColumn("found", _merged(rules))
    none = F.array().cast("array<string>")

    def part(pieces, start, length):
        """Part of a text cut in pieces; only those are looked at that it lies in."""
        first, last = F.floor(start / _PIECE), F.floor((start + length) / _PIECE)
        return F.substring(F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), ""), (start % _PIECE + 1).cast("int"), length.cast("int"))

    def rebuilt(pieces):
        def step(s, x):
            kept = F.when(x["start"] >= s["at"], F.array(part(pieces, s["at"], x["start"] - s["at"]), F.lit(mark))).otherwise(none)
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], kept).alias("out"))

        def block(s, spans):
            return F.aggregate(spans, F.struct(s["at"].alias("at"), none.alias("out")), step, lambda t: F.struct(t["at"].alias("at"), F.concat(s["out"], F.array(F.array_join(t["out"], ""))).alias("out")))

        # Arrays grow within blocks of spans, so that none is copied as often as a text has spans.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("found") - 1) / _SPANS).cast("int")), lambda i: F.slice("found", i * _SPANS + 1, F.lit(_SPANS)))
        last = lambda s: F.concat(F.array_join(s["out"], ""), part(pieces, s["at"], F.length("text").cast("long") - s["at"]))
        return F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), block, last)

    # A variable of a lambda, so that texts are cut once.
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    redone = F.element_at(F.transform(F.array(cut), rebuilt), 1)
    clean = F.when(F.size("found") > 0, redone).otherwise(F.col(f"row.`{text_col}`"))
    return checked.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
