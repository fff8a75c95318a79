"""Document fingerprints by winnowing, in DataFrame operations only.

After Schleimer, Wilkerson and Aiken, "Winnowing: Local Algorithms for Document
Fingerprinting" (2003). The grams are runs of ``k`` words, hashed; of every ``window``
consecutive gram hashes the smallest is selected, the rightmost of equal ones, and kept
with its position. Any run of ``k + window - 1`` words that two texts share yields a
fingerprint that both have.

A gram's hash is the polynomial that rolls (Karp and Rabin): over the words' hashes h it is
``h1 b^(k-1) + ... + hk`` modulo a prime, and the next gram's is ``(H - h1 b^(k-1)) b + hk+1``.
A column function carries no state from gram to gram at linear cost, so each value is
evaluated as ``(((h1 b + h2) b + ...) b + hk``, in k steps that no string is hashed again for.

Each gram is one 64-bit integer: 36 bits of hash above 27 bits that fall as the position
rises. Its minimum over a window is then the smallest hash with ties to the right, and
minima of windows of 2, 4, 8, ... come from those of half the width.

Words are runs of letters and digits, in lower case; letters of scripts that don't space
words, and those of runs of more than 40, are words of their own, and so are the characters
of a text without words. Texts of at most ``SHORT`` characters have a fine fingerprint too,
of runs of 5 letters and windows of 2: any 6 letters that two such texts share yield a
fingerprint. Two texts that both have a fine fingerprint are compared by it, others by the
coarse one; an edited text is no longer than its original, so it has one if that does.

Defined results: fewer than ``k`` words make one gram; an empty text makes an empty
fingerprint, which has likeness 1 to another empty one and 0 to any other; fewer grams than
a window make one window; places from 2^27 on are held as 2^27 - 1; a null text is an empty
one; repeated rows and null ids are kept (of equal ids in order of their texts' hashes, those
without an id last); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlight.llm.common import settle, text_or_empty

#: Bits for positions.
_PLACE = 27
#: The rolling hash's modulus, the largest prime below 2^36, and base: a product stays below 2^62.
MODULUS, BASE = (1 << 36) - 5, 49_329_351

#: Heads of so many buckets (32 bytes each) are broadcast; more are joined by a shuffle.
_FEW_HEADS = 1_000_000
#: Texts of more characters have half of 512 or more, which holds the 20 words that a coarse fingerprint needs.
SHORT = 1024
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_GAP = r"[^\p{L}\p{N}]+"


def _filled(items: Column) -> Column:
    return F.filter(items, lambda w: w != "")


def _or_characters(items: Column, text: Column) -> Column:
    return F.when(text.rlike(r"[\p{L}\p{N}]"), items).otherwise(_filled(F.split(text, "")))


def _words(text: Column) -> Column:
    low = F.lower(text)
    words = _filled(F.split(F.when(low.rlike(_UNSPACED), F.regexp_replace(low, _UNSPACED, " $0 ")).otherwise(low), _GAP))
    pieces = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 40, _filled(F.split(w, ""))).otherwise(F.array(w))))
    return _or_characters(F.when(low.rlike(r"[\p{L}\p{N}]{41}"), pieces).otherwise(words), text)


def _letters(text: Column) -> Column:
    """The letters and digits of a short text; none of a longer one."""
    letters = _filled(F.split(F.regexp_replace(F.lower(text), _GAP, ""), ""))
    return F.when(F.length(text) <= SHORT, _or_characters(letters, text)).otherwise(F.array().cast("array<string>"))


def add_fine_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    return add_fingerprint(df, text, name, 5, 2, _letters)


def add_fingerprint(df: DataFrame, text: Column, name: str, k: int = 5, window: int = 16, items: Callable[[Column], Column] = _words) -> DataFrame:
    """``df`` with an array column ``name`` of the selected grams of the text's words (or
    other ``items``), in order of place.

    The steps are columns of their own, each used by the next through element_at, so no
    step is evaluated more than once a row."""
    if window & (window - 1) or k < 1:
        raise ValueError("window must be a power of two, k positive")
    a, b = f"_{name}_a", f"_{name}_b"
    # From 1 on: 0 stands for a word that a short text lacks.
    df = df.withColumn(a, F.transform(items(text), lambda w: F.pmod(F.xxhash64(w), F.lit(MODULUS - 1)) + 1))
    span = F.greatest(F.size(a) - k + 1, F.least(F.size(a), F.lit(1)))
    top = F.lit((1 << _PLACE) - 1)

    def gram(i):
        whole = F.get(F.col(a), i)
        for j in range(1, k):
            whole = (whole * F.lit(BASE).cast("long") + F.coalesce(F.get(F.col(a), i + j), F.lit(0))) % F.lit(MODULUS)
        return F.shiftleft(whole, _PLACE).bitwiseOR(F.greatest(top - i, F.lit(0)).cast("long"))

    places = F.when(span > 0, F.sequence(F.lit(0), span - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(b, F.transform(places, gram)).drop(a)
    width, now, other = 1, b, a
    while width < window:
        half = width
        # Short texts: the window shrinks to what there is.
        count = F.greatest(F.size(now) - half, F.least(F.size(now), F.lit(1)))
        steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        least = _least_of_two(steps, now, half)
        short = F.when(F.size(now) > 0, F.array(F.array_min(now))).otherwise(F.col(now))
        df = df.withColumn(other, F.when(F.size(now) <= half, short).otherwise(least)).drop(now)
        now, other, width = other, now, 2 * width
    return df.withColumn(name, F.array_distinct(now)).drop(now)


def _least_of_two(places: Column, name: str, apart: int) -> Column:
    return F.transform(places, lambda i: F.least(F.get(F.col(name), i), F.get(F.col(name), i + apart)))


def selected(name: str) -> Column:
    """The fingerprint as structs of position (in words) and hash."""
    top = (1 << _PLACE) - 1
    return F.transform(name, lambda x: F.struct((F.lit(top) - x.bitwiseAND(F.lit(top))).alias("place"), F.shiftright(x, _PLACE).alias("hash")))


def digest(*names: str) -> Column:
    """The places and hashes of fingerprints as one hex string."""
    return F.sha2(F.concat_ws(";", *(F.array_join(F.transform(x, lambda g: F.hex(g)), ",") for x in names)).cast("binary"), 256)


def hashes(name: str) -> Column:
    return F.array_distinct(F.transform(name, lambda x: F.shiftright(x, _PLACE)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def fine_or_coarse(a: str, b: str) -> Column:
    """Likeness of the columns ``a`` and ``b`` of coarse hashes, or of the fine ones."""
    both = (F.size(f"{a}_fine") > 0) & (F.size(f"{b}_fine") > 0)
    return F.when(both, likeness(f"{a}_fine", f"{b}_fine")).otherwise(likeness(a, b))


def fingerprints(docs: DataFrame, *, k: int = 5, window: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its selected fingerprints, as structs of place and hash."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return add_fingerprint(picked, F.col("text"), "fp", k, window).select("doc_id", selected("fp").alias("fingerprint"))


def _folded(numbers: list[int]) -> Column:
    """An array of numbers as one literal, which is folded before anything runs."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _zones(docs: DataFrame, total: int, wanted: int) -> Column:
    """The number of a row's zone, which rises as doc_id falls. Zones part the ids about
    evenly, at quantiles of some hundred rows a zone, taken by hash; an id of very many rows
    has one to itself, and so have rows without an id."""
    shares = [i / wanted for i in range(1, wanted)]
    taken = docs.where(F.pmod(F.xxhash64("doc_id", "rank"), F.lit(1 << 40)) < int(min(1.0, 100 * wanted / max(1, total)) * (1 << 40)))
    found = taken.agg(F.percentile_approx("doc_id", shares, 20 * wanted).alias("q")).first()["q"] or []
    many = {a for a, b in zip(found, found[1:]) if a == b and a < (1 << 63) - 1}
    bounds = sorted({*found, *(x + 1 for x in many)})
    if not bounds:
        return F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(F.lit(0))
    whole = _folded(bounds)

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        go = F.get(whole, middle) <= F.col("doc_id")
        live = s["lo"] < s["hi"]
        return F.struct(
            F.when(live & go, middle + 1).otherwise(s["lo"]).cast("int").alias("lo"),
            F.when(live & ~go, middle).otherwise(s["hi"]).cast("int").alias("hi"),
        )

    # Binary search for the number of bounds that are not above the id.
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    below = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda s: s["lo"])
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - below)


def with_next(docs: DataFrame, rows_per_bucket: int = 256, most_zones: int = 4_096) -> DataFrame:
    """``docs`` (doc_id, text, rank) with ``bucket`` and ``halo``, by which a window finds the
    next document in descending order of doc_id, and after the last the first. Rows of one
    id are in order of ``rank``, a hash of the text; rows without an id come last.

    Rows are dealt in one shuffle to buckets whose number grows with the table: at most
    ``most_zones`` zones by quantiles, of which the driver knows the counts, have as many
    buckets as they need, by id or, where all ids are one or none, by rank. Each bucket also
    gets the first row of the bucket after it, marked ``halo``."""
    total = docs.count()
    wanted = min(most_zones, max(docs.sparkSession.sparkContext.defaultParallelism * 4, total // rows_per_bucket))
    zoned = docs.withColumn("zone", _zones(docs, total, wanted).cast("int"))
    stats = sorted((r["zone"], r["n"], r["lo"], r["hi"]) for r in zoned.groupBy("zone").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect())
    if not stats:
        return docs.withColumns({"bucket": F.lit(0).cast("long"), "halo": F.lit(False)})
    parts, firsts, lows, highs = ([0] * (stats[-1][0] + 1) for _ in range(4))
    at = 0
    for number, n, lo, hi in stats:
        parts[number], firsts[number], lows[number], highs[number] = -(-n // rows_per_bucket), at, lo or 0, hi or 0
        at += parts[number]
    m, lo, hi = (F.get(_folded(x), F.col("zone")) for x in (parts, lows, highs))
    by_id = (hi.cast("double") - F.col("doc_id")) / (hi.cast("double") - lo + 1)
    by_rank = (F.shiftright("rank", 11) + (1 << 52)) / F.lit(float(1 << 53))
    part = F.floor(F.when(hi > lo, by_id).otherwise(by_rank) * m)
    dealt = zoned.withColumn("bucket", F.get(_folded(firsts), F.col("zone")) + F.when(m > 1, F.greatest(F.lit(0), F.least(m - 1, part))).otherwise(F.lit(0)))
    # Heads: the first row of each bucket, one for some hundreds of rows. A bucket's row before is in
    # the bucket before, of this zone, or in the last one of the zone before.
    head = F.min(F.struct(F.bitwise_not("doc_id").alias("turned"), F.col("rank").alias("first_rank"))).alias("head")
    heads = settle(dealt.groupBy("zone", "bucket").agg(head).select("zone", F.col("bucket").alias("of"), "head.*"))
    last = {r["zone"]: r["last"] for r in heads.groupBy("zone").agg(F.max("of").alias("last")).collect()}
    order = sorted(last)
    before_zone = [0] * (order[-1] + 1)
    for a, b in zip([order[-1], *order], order):
        before_zone[b] = last[a]
    before = F.coalesce(F.lag("of").over(Window.partitionBy("zone").orderBy("of")), F.get(_folded(before_zone), F.col("zone")))
    heads = heads.withColumn("before", before).drop("zone")
    if at <= _FEW_HEADS:
        heads = F.broadcast(heads)
    own = (F.col("bucket") == F.col("of")) & F.bitwise_not("doc_id").eqNullSafe(F.col("turned")) & (F.col("rank") == F.col("first_rank"))
    first = dealt.join(heads, own).select("doc_id", "text", "rank", F.col("before").alias("bucket")).dropDuplicates(["bucket"])
    columns = ["doc_id", "text", "rank", "bucket"]
    return dealt.select(*columns, F.lit(False).alias("halo")).unionByName(first.select(*columns, F.lit(True).alias("halo")))


def next_window() -> Window:
    return Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").desc_nulls_last(), "rank")


def compare_with_edits(docs: DataFrame, *, k: int = 5, window: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, the edited text's SHA-256 (its last half replaced by as many
    of the first characters of the next document, in descending order of id), digests of
    both fingerprints, and likenesses of the fingerprint to the edited text's and to the
    next document's."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    both = with_next(picked.withColumn("rank", F.xxhash64("text")))
    order = next_window()
    led = both.withColumn("next_text", F.lead("text").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    # Without a next document (a lone row whose halo is itself) the lead is its own text.
    following = F.coalesce("next_text", F.col("text"))
    led = led.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.left(F.col("text"), (F.length("text") - half)), F.left(following, half))
    )
    printed = add_fine_fingerprint(add_fingerprint(led, F.col("text"), "fp", k, window), F.col("text"), "fine")
    printed = printed.withColumn("hashes", hashes("fp")).withColumn("hashes_fine", hashes("fine"))
    printed = printed.withColumns({f"next_{x}": F.lead(x).over(order) for x in ("hashes", "hashes_fine")}).where(~F.col("halo"))
    printed = add_fine_fingerprint(add_fingerprint(printed, F.col("edited"), "edited_fp", k, window), F.col("edited"), "edited_fine")
    printed = printed.withColumn("edited_hashes", hashes("edited_fp")).withColumn("edited_hashes_fine", hashes("edited_fine"))
    return printed.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest("fp", "fine").alias("fingerprint"), digest("edited_fp", "edited_fine").alias("edited_fingerprint"),
        fine_or_coarse("hashes", "edited_hashes").alias("near_edited"), fine_or_coarse("hashes", "next_hashes").alias("near_next"),
    )
