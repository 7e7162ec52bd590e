"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Test items are cut into windows of ten words. A count over the whole corpus tells how rare each of their terms is. The index
stores the postings ``(term, document, position)`` of the two rarest terms of each window, since no other list is
ever asked for. A search starts from the rarest term: its postings, moved by its offset in the item, say where the item
would begin, and must meet the moved postings of the second one. What is left are alignments of an item with a document;
there all words are compared, and every run of equal words that is as long as a window is an exact phrase match.
Postings that meet only within some words' distance are proximity matches.

Texts are never shuffled, unless more documents have alignments than may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, saved, small, text_of

WINDOW = 10
# Fixed value: what separates words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Digits, a-z and all that is not ASCII, with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN_WORDS), "")


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"])


def corpus_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, h, text``. The hash tells rows of one id apart; rows alike in both are one document to the index."""
    whole = text_of(text)
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("text"))


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, item_id, words``: a key for each text of each id, the id as text. Items without words have no windows."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"),
        words_of(text_of(text)).alias("words"),
    )
    keyed = items.filter(F.size("words") > 0).distinct()
    return saved(keyed.withColumn("item", F.md5(F.array_join(F.concat(F.array("item_id"), "words"), " "))), "items")


def term_counts(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``term, n``: how often the corpus has each word of the items; those that it lacks are missing."""
    terms = small(saved(items.select(F.explode("words").alias("term")).distinct(), "terms"))
    found = rows.select(F.explode(words_of(F.col("text"))).alias("term")).join(terms, "term", "left_semi")
    return found.groupBy("term").agg(F.count("*").alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, size, term, at, term2, at2``: the two rarest places of each window, without repeats.

    A window with a word that the corpus lacks occurs nowhere and is left out. A window of one word has no second place.
    """
    places = items.select("item", F.posexplode("words").alias("at", "term"), F.size("words").alias("size"))
    ranked = places.join(small(counts), "term", "left")
    starts = F.sequence(
        F.greatest(F.lit(0), F.col("at") - window + 1),
        F.greatest(F.lit(0), F.least(F.col("at"), F.col("size") - window)),
    )
    width = F.least(F.lit(window), F.col("size"))
    in_windows = ranked.withColumn("start", F.explode(starts)).withColumn("width", width)
    rank = F.struct(F.col("n"), F.col("term"), F.col("at"))
    picked = (
        in_windows.groupBy("item", "size", "start", "width")
        .agg(F.count("n").alias("known"), F.sort_array(F.collect_list(rank)).alias("r"))
        .filter("known = width")
    )
    return picked.select(
        "item",
        "size",
        F.col("r")[0]["term"].alias("term"),
        F.col("r")[0]["at"].alias("at"),
        F.get("r", F.lit(1))["term"].alias("term2"),
        F.get("r", F.lit(1))["at"].alias("at2"),
    ).distinct()


def build_index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``term, doc_id, h, pos`` of the given terms, saved."""
    words = rows.select("doc_id", "h", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return saved(words.join(small(terms), "term", "left_semi"), "postings")


def alignments(index: DataFrame, picked: DataFrame, slop: int = 0) -> DataFrame:
    """``doc_id, h, item, size, shift``: where both lists of an anchor meet, for an item that begins ``shift`` words in.

    With ``slop``, they may miss each other by that many words.
    """
    first = index.join(small(picked), "term").select(
        "doc_id",
        "h",
        "item",
        "size",
        (F.col("pos") - F.col("at")).alias("shift"),
        "term2",
        "at2",
    )
    alone = first.filter(F.col("term2").isNull())
    wanted = (
        first.filter(F.col("term2").isNotNull())
        .select(
            "doc_id",
            "h",
            "item",
            "size",
            "shift",
            F.col("term2").alias("term"),
            F.explode(
                F.sequence(F.col("shift") + F.col("at2") - slop, F.col("shift") + F.col("at2") + slop)
            ).alias("pos"),
        )
        .distinct()
    )
    met = wanted.join(
        index,
        _same_document(wanted, index) & (wanted["term"] == index["term"]) & (wanted["pos"] == index["pos"]),
        "left_semi",
    )
    columns = ["doc_id", "h", "item", "size", "shift"]
    return met.select(*columns).unionByName(alone.select(*columns)).distinct()


def exact_runs(rows: DataFrame, items: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, h, item_id, start, stop``: words of documents that equal a stretch of the item with a window in it."""
    per_document = saved(
        found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("item", "size", "shift")).alias("found")),
        "alignments",
    )
    beside = rows.join(small(per_document), _same_document(rows, per_document)).select(
        rows["doc_id"], rows["h"], words_of(F.col("text")).alias("w"), "found"
    )

    def stretch(c: Column) -> Column:
        begin = F.greatest(c["shift"], F.lit(0))
        length = F.greatest(c["size"] + F.least(c["shift"], F.lit(0)), F.lit(0))
        return F.struct(
            c["item"].alias("item"), c["shift"].alias("shift"), F.slice(F.col("w"), begin + 1, length).alias("w")
        )

    # The stretches are cut before the rows multiply, so that whole texts do not.
    stretches = beside.select("doc_id", "h", F.explode(F.transform("found", stretch)).alias("c"))
    together = stretches.select("doc_id", "h", "c.*").join(small(items), "item")
    # Item word p lies at w[p - skipped].
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    n = F.least(F.size("w"), F.size("words") - skipped)
    same = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda p: F.when(F.get("w", p) == F.get("words", p + skipped), "1").otherwise("0"),
    )
    need = F.least(F.lit(window), F.size("words"))
    bits = together.filter(n >= need).select(
        "doc_id",
        "h",
        "item_id",
        F.greatest("shift", F.lit(0)).alias("base"),
        need.alias("need"),
        F.concat(F.lit("0"), F.array_join(same, ""), F.lit("0")).alias("bits"),
    )
    # A run of ones is between two zeros: where its pieces end gives start and length, one row per long run.
    runs = F.aggregate(
        F.split("bits", "0"),
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("runs")),
        lambda acc, ones: F.struct(
            (acc["at"] + F.length(ones) + 1).alias("at"),
            F.when(
                F.length(ones) >= F.col("need"),
                F.concat(
                    acc["runs"],
                    F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(ones)).alias("stop"))),
                ),
            )
            .otherwise(acc["runs"])
            .alias("runs"),
        ),
    )["runs"]
    return bits.select("doc_id", "h", "item_id", "base", F.explode(runs).alias("r")).select(
        "doc_id",
        "h",
        "item_id",
        (F.col("base") + F.col("r.start")).alias("start"),
        (F.col("base") + F.col("r.stop")).alias("stop"),
    )


def phrase_matches(rows: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Index, search and exact comparison: the runs of all items in all documents."""
    counts = saved(term_counts(rows, items), "counts")
    picked = saved(anchors(items, counts, window), "anchors")
    asked = picked.select("term").union(picked.filter("term2 is not null").select("term2")).distinct()
    index = build_index(rows, saved(asked, "asked"))
    return exact_runs(rows, items, saved(alignments(index, picked), "found"), window)


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, shift``: documents that have the two rarest terms of a window within ``slop`` words of
    their places, whether or not the words between agree."""
    rows, items = corpus_rows(docs, doc_id, text), benchmark_items(benchmark)
    counts = saved(term_counts(rows, items), "counts")
    picked = saved(anchors(items, counts, window), "anchors")
    asked = picked.select("term").union(picked.filter("term2 is not null").select("term2")).distinct()
    near = alignments(build_index(rows, saved(asked, "asked")), picked, slop).join(small(items), "item")
    return near.select(F.col("doc_id").alias(doc_id), "item_id", "shift").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in an occurrence of a window. Null texts have no words; a null item id counts as ``null``.
    Repeated rows each get their answer. Without items nothing is hit; an empty table gives an empty result.
    """
    rows = corpus_rows(docs, doc_id, text)
    items = benchmark_items(benchmark, item_id, item_text)
    runs = phrase_matches(rows, items, window)
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(acc["stop"], r["start"]))).alias("n"),
            F.greatest(acc["stop"], r["stop"]).alias("stop"),
        ),
    )["n"]
    hits = (
        runs.groupBy("doc_id", "h")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"),
            F.sort_array(F.collect_set("item_id")).alias("items"),
        )
        .select("doc_id", "h", covered.alias("n_hit"), "items")
    )
    hits = saved(hits, "hits")
    sizes = rows.select("doc_id", "h", F.size(words_of(F.col("text"))).alias("n_words"))
    joined = sizes.join(small(hits), _same_document(sizes, hits), "left")
    return joined.select(
        sizes["doc_id"].alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.encode(F.coalesce(F.array_join("items", ","), F.lit("")), "UTF-8"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of an item, all columns as they were."""
    rows = corpus_rows(docs, doc_id, text)
    runs = phrase_matches(rows, benchmark_items(benchmark))
    bad = saved(runs.select("doc_id", "h").distinct(), "contaminated").toDF("__bad_id", "__bad_hash")
    tagged = docs.withColumn("__text_hash", F.xxhash64(text_of(text)))
    clean = tagged.join(
        small(bad),
        tagged[doc_id].eqNullSafe(bad["__bad_id"]) & (tagged["__text_hash"] == bad["__bad_hash"]),
        "left_anti",
    )
    return clean.select(*[f"`{c}`" for c in docs.columns])
