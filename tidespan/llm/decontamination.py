"""Benchmark decontamination with DataFrame functions only: SimHash windows, multi-index Hamming blocks, exact verification.

Windows have as many words as the item and slide over every start; a document of fewer words is one window.  Two exact rules spare windows that can't be similar enough, in whatever
order their shingles stand: of an item with n shingles at most a fifth may be missing, so a document without any of one fifth and one more
of them is passed over in the one scan of all documents; and so are starts at which fewer of the item's shingles than needed are in the window.
Each window left has a 64-bit SimHash of its words.  Fingerprints are cut into ``radius`` + 1 blocks: two within the radius agree on a whole block, so
an equi-join on (item, block, value) finds all of them.  Pairs within the radius are verified by the exact similarity of their shingle multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Item shingles up to this number are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Shingles of which a document must hold one, up to which they are tested within the scan; more are joined.
LISTED = 20_000


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; null for null, empty for none."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(w: Column, k: int) -> Column:
    """Hashes of each run of k words of the array ``w``; none for shorter arrays."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(exploded: DataFrame, keys: list[str], word_hash: str) -> DataFrame:
    """``keys`` and simhash: bit b is set if more than half of the group's words have it set.

    Two 32-bit counters share a long, and 32 sums make the fingerprint.
    """
    bit = lambda b: f"(shiftrightunsigned({word_hash}, {b}) & 1L)"
    ones = lambda b: f"(shiftrightunsigned(g{b // 2}, {32 * (b % 2)}) & 4294967295L)"
    counted = exploded.groupBy(*keys).agg(F.count("*").alias("size"), *(F.expr(f"sum({bit(2 * g)} + shiftleft({bit(2 * g + 1)}, 32)) as g{g}") for g in range(32)))
    value = " | ".join(f"shiftleft(cast({ones(b)} * 2 > size as bigint), {b})" for b in range(64))
    return counted.selectExpr(*keys, f"{value} as simhash")


def _blocks(simhash: str, radius: int) -> Column:
    """Structs (block, value) of radius+1 blocks that cover all 64 bits."""
    m = radius + 1
    edge = [64 * i // m for i in range(m + 1)]
    parts = (f"named_struct('block', {i}, 'value', shiftrightunsigned({simhash}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(edge, edge[1:])))
    return F.expr(f"array({', '.join(parts)})")


def _starts(at: Column, m: Column, need: Column, most: Column) -> Column:
    """Starts up to ``most`` of windows of ``m`` shingles that hold ``need`` or more of the positions ``at`` (ascending, distinct).

    For each position those starts of which it is the first in the window, so no start comes twice.
    """
    def of(i: Column) -> Column:
        low = F.greatest(F.get(at, i + need - 1) - m + 1, F.coalesce(F.get(at, i - 1) + 1, F.lit(0)))
        high = F.least(F.get(at, i), most)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), of))


def _some_of_each(item: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(k, first, gram): of each item as many distinct shingles as may be missing in a similar window, and one more, with their first words.

    Those with the longest first words, as these are rare; any others would do.
    """
    k = F.least("len", F.lit(shingle))
    n = F.col("len") - k + 1
    grams = F.transform(F.sequence(F.lit(0), F.col("len") - k), lambda i: F.struct((-F.length(F.get("iw", i))).alias("order"), F.get("iw", i).alias("first"), F.slice("iw", i + 1, k).alias("gram")))
    # What stands beside explode() must not use the array, which would go into each of its rows.
    rows = item.select("kind", "len", F.explode(grams).alias("g"))
    some = rows.groupBy("kind", k.alias("k"), (n - F.ceil(n * similarity - 1e-9).cast("int") + 1).alias("most")).agg(F.array_sort(F.collect_set("g")).alias("g"))
    return some.select("k", F.explode(F.slice("g", 1, F.col("most"))).alias("g")).select("k", "g.first", "g.gram")


def _holders(docs: DataFrame, chosen: DataFrame, ks: list[int]) -> DataFrame:
    """Of documents (doc, th, text) those that hold one or more of the chosen shingles, with their words: one scan, and no shuffle of documents."""
    hashed = lambda k: F.xxhash64(*(F.get("gram", j) for j in range(k)))
    listed = common.materialize(chosen.select("k", F.xxhash64("first").alias("first"), *(hashed(k).alias(f"h{k}") for k in ks)).distinct(), "listed")
    if listed.count() <= LISTED:
        rows = listed.collect()  # LISTED rows at most
        among = lambda values: "(" + ", ".join(f"{v}L" if v > -(1 << 63) else f"cast({v} as bigint)" for v in sorted(set(values)) or [0]) + ")"
        gram = lambda k: "xxhash64(" + ", ".join(f"get(w, i + {j})" for j in range(k)) + ")"
        held = " or ".join(f"{gram(k)} in {among(r[f'h{k}'] for r in rows if r['k'] == k)}" for k in ks)
        # The words are the one element of an array, so that they are split once and not anew for each position.
        split = r"filter(split(lower(text), r'[\x20\x09-\x0D]+'), x -> x <> '')"
        some = f"filter(sequence(0, size(w) - 1), i -> xxhash64(get(w, i)) in {among(r['first'] for r in rows)})"
        return docs.where(F.expr(f"exists(array({split}), w -> size(w) > 0 and exists({some}, i -> {held}))")).select("doc", "th", words(F.col("text")).alias("w"))
    docs = docs.select("doc", "th", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    keys = None
    for k in ks:
        x = docs.select("doc", "th", F.explode(shingle_hashes(F.col("w"), k)).alias("sh")).join(listed.where(F.col("k") == k).select(F.col(f"h{k}").alias("sh")).distinct(), "sh", "left_semi").select("doc", "th")
        keys = x if keys is None else keys.union(x)
    return docs.join(keys.distinct(), ["doc", "th"], "left_semi")


def matches(docs: DataFrame, items: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 24, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item with a window that is at least ``similarity`` alike: ids, start (word of the best window; ties: one
    with a shingle in line with the item's, then the first), n_words, hamming, similarity (sum of the lesser by sum of the greater shingle counts, rounded to 6 places).

    An item of fewer words than ``shingle`` is one shingle.  Null or empty texts and null ids match nothing; rows that repeat an id count as one
    document; other columns are not looked at; long items and texts are treated like any others.  SimHash decides which windows are verified.  Equal windows are at distance 0
    and are never lost; of windows at the least similarity about one in 60 lies beyond a radius of 15, and none of 183,000
    simulated ones beyond 22 (5 to 300 words, the last of them replaced).
    """
    item = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("iw")).where(F.col("item").isNotNull() & (F.size("iw") > 0)).dropDuplicates()
    item = common.materialize(item.withColumn("len", F.size("iw")).withColumn("kind", F.monotonically_increasing_id()), "items")
    short = sorted(r.k for r in item.select(F.least("len", F.lit(shingle)).alias("k")).distinct().collect())  # at most ``shingle`` rows
    result = "doc long, item long, start int, n_words int, hamming int, similarity double"
    if not short:
        return docs.sparkSession.createDataFrame([], result).withColumnsRenamed({"doc": doc_id, "item": item_id})
    d = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    d = common.materialize(_holders(d, _some_of_each(item, shingle, similarity), short).withColumn("n", F.size("w")), "holders")
    at_item = at_doc = None
    for k in short:
        i = item.where(F.least("len", F.lit(shingle)) == k).select("item", "len", F.explode(shingle_hashes(F.col("iw"), k)).alias("sh"), F.lit(k).alias("k")).distinct()
        x = d.select("doc", "th", "n", F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "sh"), F.lit(k).alias("k"))
        at_item, at_doc = (i if at_item is None else at_item.union(i)), (x if at_doc is None else at_doc.union(x))
    side = F.broadcast(at_item) if at_item.count() <= BROADCAST_ROWS else at_item
    held = at_doc.join(side, ["sh", "k"]).groupBy("doc", "th", "n", "item", "len", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # Shingles of a window and of the item, and how many of the window's must be the item's.
    held = held.withColumn("m", F.least("n", "len") - F.col("k") + 1)
    held = held.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("m") + F.col("len") - F.col("k") + 1) * (similarity / (1 + similarity)) - 1e-9).cast("int")))
    spots = held.where(F.size("at") >= F.col("need")).select("doc", "th", "item", "len", F.explode(_starts(F.col("at"), F.col("m"), F.col("need"), F.greatest(F.lit(0), F.col("n") - F.col("len")))).alias("start"))
    windows = d.join(spots.drop("n"), ["doc", "th"]).select("doc", "start", "item", "len", F.slice("w", F.col("start") + 1, F.col("len")).alias("ww"), (F.col("start") >= F.col("n") - F.col("len")).alias("final"))
    windows = common.materialize(windows.dropDuplicates(["doc", "start", "item", "len", "ww"]), "windows")
    common.discard(d)
    # A window's words decide its fingerprint, so equal windows of many documents are fingerprinted and verified once.
    wid = F.xxhash64("ww")
    kinds = common.materialize(windows.select("item", "len", wid.alias("wid"), "ww").dropDuplicates(["item", "len", "wid", "ww"]).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    # Written, as planning a join over the 64 terms of a fingerprint takes far longer than making them.
    printed = lambda df, w: common.materialize(fingerprint(df.select("kind", F.explode(w).alias("x")).select("kind", F.xxhash64("x").alias("h")), ["kind"], "h"), "prints")
    blocked = lambda df, name, w: df.select("item", "len", "kind").join(printed(df, w), "kind").select("item", "len", F.col("kind").alias(name), F.col("simhash").alias(f"of_{name}"), F.explode(_blocks("simhash", radius)).alias("b")).select("item", "len", name, f"of_{name}", "b.*")
    near = blocked(kinds, "kind", "ww").join(blocked(item, "other", "iw"), ["item", "len", "block", "value"]).withColumn("hamming", F.bit_count(F.col("of_kind").bitwiseXOR(F.col("of_other"))).cast("int"))
    near = near.where(F.col("hamming") <= radius).select("kind", "other", "hamming").distinct()
    near = near.join(kinds, "kind").join(item.select(F.col("kind").alias("other"), "iw"), "other")
    k = F.least("len", F.lit(shingle))
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
    near = near.select("len", "wid", "ww", "item", "hamming", grams(F.col("ww")).alias("gw"), grams(F.col("iw")).alias("gi"), F.monotonically_increasing_id().alias("pair"))
    near = common.materialize(near, "near")
    for x in (kinds, item):
        common.discard(x)
    count = lambda side: near.select("pair", F.posexplode(side).alias("pos", "gram")).groupBy("pair", "gram").agg(F.count("*").alias(f"n_{side}"), F.min("pos").alias(f"first_{side}"), F.max("pos").alias(f"last_{side}"))
    both = count("gw").join(count("gi"), ["pair", "gram"]).groupBy("pair").agg(F.sum(F.least("n_gw", "n_gi")).alias("lesser"), F.max(F.col("first_gw") < F.col("last_gi")).alias("before"), F.max(F.col("last_gw") > F.col("first_gi")).alias("after"))
    near = near.join(both, "pair").withColumn("similarity", F.col("lesser") / (F.size("gw") + F.size("gi") - F.col("lesser"))).where(F.col("similarity") >= similarity)
    # Shingles at their offset in the item, before it and after it.
    same = F.exists(F.sequence(F.lit(0), F.size("gw") - 1), lambda i: F.get("gw", i) == F.get("gi", i))
    near = near.select("len", "wid", "ww", "item", "hamming", "similarity", F.coalesce(same, F.lit(False)).alias("same"), "before", "after")
    found = windows.withColumn("wid", wid).join(near, ["len", "wid", "ww", "item"])
    level = F.col("same") | ((F.col("start") == 0) & F.col("before")) | (F.col("final") & F.col("after"))
    best = found.groupBy("doc", "item").agg(F.max_by(F.struct("start", F.size("ww").alias("n"), "hamming", "similarity"), F.struct("similarity", F.coalesce(level, F.lit(False)), -F.col("start"))).alias("b"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("b.start").alias("start"), F.col("b.n").alias("n_words"), F.col("b.hamming").alias("hamming"), F.round("b.similarity", 6).alias("similarity"))
