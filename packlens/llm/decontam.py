"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of WINDOW consecutive words (an item of fewer words is one window). Words are
ordered by rarity over the whole corpus; exact containment of a window needs a prefix of one word, its
rarest, so only documents' occurrences of such words are joined. An occurrence sets where the window
would start: it must lie within the document (positional and length bounds), and the words there must equal the
window's.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import Scratch, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark words, and bytes of windows, up to which they are broadcast; beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20
#: Bits per prefix word of the one-hash filter that spares the join most words, and its bound in words of 64 bits.
FILTER_BITS, FILTER_WORDS = 64, 1 << 17


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null gives null. Texts that are all ASCII take the quicker lower().

    The text is split at runs of other characters: regexp_extract_all copies the text once a match.
    """
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(low, BREAK), "")


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """wid, words, item_id: distinct (window, item) pairs."""
    words = items.select("item_id", F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    runs = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, window))).alias("words"))
    return runs.select(F.md5(F.array_join("words", " ")).alias("wid"), "words", "item_id").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items with occurring windows, items_sha256
    hashes their ids, sorted as strings and comma-joined. A null or wordless text has no words and no hits; items that are null
    or wordless have no windows; null item_ids aren't counted. Repeated rows are judged each and alike. An empty
    table of documents gives an empty result, an empty benchmark no hits. Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pairs = scratch.write(windows_of(items, window))
    windows = pairs.select("wid", "words").distinct()
    tokens = scratch.write(windows.select("wid", "words", F.posexplode("words").alias("offset", "word")))
    vocabulary = scratch.write(tokens.select("word").distinct())
    n_vocabulary = vocabulary.count()
    texts = docs.select("doc_id", "text")

    # Rarity: how often each benchmark word stands in the corpus.
    seen = texts.select(F.explode(words_of(F.col("text"))).alias("word"))
    if n_vocabulary <= BROADCAST_ROWS:
        counts = seen.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word")
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")
    first = tokens.join(counts, "word", "left").groupBy("wid", "words").agg(F.min(rarity).alias("r"))
    entry = F.struct(F.col("r.offset").alias("offset"), "wid", "words")
    prefixes = scratch.write(first.select(F.col("r.word").alias("word"), entry.alias("entry")).groupBy("word").agg(F.collect_list("entry").alias("entries")))
    n_prefixes, n_bytes = prefixes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + 64 + F.octet_length(F.array_join(e["words"], " ")))), F.lit(0))).first()

    # Occurrences of prefix words, with the words around them.
    bits = min(FILTER_WORDS, max(1, n_prefixes * FILTER_BITS // 64)) * 64
    at = F.pmod(F.xxhash64("word"), F.lit(bits))
    on = prefixes.groupBy(F.shiftright(at, 6).alias("k")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(word), {bits}L) & 63 as int))) AS b")).collect()  # FILTER_WORDS rows at most
    mask = [0] * (bits // 64)
    for r in on:
        mask[r["k"]] = r["b"]
    masks = F.from_json(F.lit(json.dumps(mask)), "array<bigint>")

    def maybe(word: Column) -> Column:
        place = F.pmod(F.xxhash64(word), F.lit(bits))
        return F.getbit(F.get(masks, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    w = F.col("w")
    places = F.filter(F.transform(w, lambda x, i: F.when(maybe(x), i)), lambda i: i.isNotNull())
    around = F.transform(places, lambda i: F.struct(i.alias("at"), F.get(w, i).alias("word"), F.greatest(F.lit(0), i - (window - 1)).alias("from"), F.slice(w, F.greatest(F.lit(0), i - (window - 1)) + 1, 2 * window - 1).alias("words")))
    rows = texts.select("doc_id", F.xxhash64("text").alias("_text"), words_of(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "_text", F.greatest(F.lit(0), F.size("w")).cast("long").alias("n_words"), F.posexplode_outer(around).alias("k", "c"))
    rows = rows.select("doc_id", "_text", "n_words", (F.coalesce("k", F.lit(0)) == 0).alias("head"), "c.*")
    joined = rows.join(F.broadcast(prefixes) if n_bytes <= BROADCAST_BYTES else prefixes, "word", "left")

    def holds(e: Column) -> Column:
        start, size = F.col("at") - e["offset"], F.size(e["words"])
        inside = (start >= 0) & (start + size <= F.col("n_words"))
        return inside & (F.slice(F.col("words"), F.when(inside, start - F.col("from") + 1).otherwise(1), size) == e["words"])

    hits = F.transform(F.filter(F.coalesce("entries", F.array().cast(prefixes.schema["entries"].dataType)), holds), lambda e: F.struct((F.col("at") - e["offset"]).alias("start"), (F.col("at") - e["offset"] + F.size(e["words"])).alias("stop"), e["wid"].alias("wid")))
    verified = joined.select("doc_id", "_text", "n_words", "head", hits.alias("hits")).where("head OR size(hits) > 0")
    key = ["doc_id", "_text", "n_words"]
    by_doc = verified.groupBy(*key).agg(F.sum(F.col("head").cast("long")).alias("copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"))
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")), lambda a, h: F.struct(F.greatest(a["stop"], h["stop"]).alias("stop"), (a["n"] + F.greatest(F.lit(0), h["stop"] - F.greatest(h["start"], a["stop"]))).alias("n")))["n"]
    judged = scratch.write(by_doc.select(*key, "copies", covered.cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["wid"])).alias("wids")))

    leaked = judged.where("n_hit > 0").select(*key, F.explode("wids").alias("wid")).join(pairs.where("item_id is not null").select("wid", F.col("item_id").cast("string").alias("item")), "wid")
    named = leaked.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), F.col("n_words").alias("_n"), "items")
    out = judged.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")) & (F.col("n_words") == F.col("_n")), "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "copies")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_k")).drop("_k")
