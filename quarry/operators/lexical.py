"""BM25 over joins and aggregates.

A lexicon is three tables, each with a ``corpus_id``:

* ``postings(doc_id, term, tf, dl)``: how often a document of ``dl`` words has a term,
* ``terms(term, df, idf)``: in how many documents a term occurs, and its weight,
* ``corpora(n_docs, n_words, avgdl)``: one row per corpus.

A corpus is a column of a gold set, or the only one of an ordinary index, so tables with one row per
corpus are as small as a table is wide, and are broadcast without a check. A shuffle by ``corpus_id``
alone would bring a whole corpus to one task and does not occur.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import BM25_B, BM25_EPSILON, BM25_K1
from quarry.functions.scores import best_of_task, max_normalised, rounded, top_k
from quarry.functions.text import tokens
from quarry.session import BROADCAST_ROWS, broadcast_if_small, fits_broadcast, materialise

# Query terms up to which the scan itself is asked for them, so that it can skip what lacks them.
PUSHED_TERMS = 1_000
# Postings of one term that one task takes where the query terms are too many to broadcast.
POSTINGS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Lexicon:
    postings: DataFrame
    terms: DataFrame
    corpora: DataFrame
    # Whether the postings are stored in buckets of doc_id, so that sums per document need no shuffle.
    bucketed: bool = False
    # The postings by number of buckets, where an index outgrew its first; a document is in one of them.
    parts: tuple[DataFrame, ...] = ()


def _counted(docs: DataFrame) -> DataFrame:
    """Term counts of each row of ``docs``, made inside the row: neither a shuffle nor a table of all words in a task.

    The sorted words of a row are cut where a new word begins. The one-element arrays hold what is then worked out once
    per row and not once per word.
    """
    words = docs.select(*[c for c in docs.columns if c != "combined_text"], tokens("combined_text").alias("words"))

    def runs(w):
        starts = F.filter(F.transform(w, lambda word, i: F.when((i == 0) | (word != F.get(w, i - 1)), i)), F.isnotnull)
        return F.transform(
            F.array(starts),
            lambda s: F.transform(
                s,
                lambda i, n: F.struct(
                    F.get(w, i).alias("term"), (F.coalesce(F.get(s, n + 1), F.size(w)) - i).cast("long").alias("tf")
                ),
            ),
        )[0]

    # An inner inline would make the optimizer filter on the size of the array first, and so split every text twice.
    return words.select(
        *[c for c in words.columns if c != "words"],
        F.size("words").cast("long").alias("dl"),
        F.inline_outer(F.transform(F.array(F.sort_array("words")), runs)[0]),
    ).filter(F.col("term").isNotNull())


def postings(docs: DataFrame, partitions: int | None = None, unique: bool = False) -> DataFrame:
    """Term counts per document, counted inside its row. With ``partitions``, the texts, which are smaller than their
    postings, are dealt to that many by ``doc_id`` first. Rows of one id and length are counted as one document, unless
    ``unique`` says that there are none: their counts come together by document and term.
    """
    by_document = docs.select("corpus_id", "doc_id", "combined_text")
    if partitions:
        by_document = by_document.repartition(partitions, "doc_id")
    columns = ["corpus_id", "doc_id", "term", "tf", "dl"]
    if unique:
        return _counted(by_document).select(*columns)
    key = ["corpus_id", "doc_id"]
    ids = docs.groupBy(*key).agg(F.count("*").alias("n"))
    again = materialise(ids.filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in key]), "again")
    if again.isEmpty():
        return _counted(by_document).select(*columns)
    marked = by_document.join(
        broadcast_if_small(again.withColumn("_again", F.lit(True))),
        [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key],
        "left",
    )
    counted = _counted(marked.select(*key, "combined_text", F.col("_again").isNotNull().alias("_again")))
    merged = counted.filter("_again").groupBy(*key, "dl", "term").agg(F.sum("tf").alias("tf"))
    return counted.filter("not _again").select(*columns).unionByName(merged.select(*columns))


def corpora(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """Documents and average length of each corpus; documents without words count, with length 0."""
    sizes = docs.groupBy("corpus_id").agg(F.count("*").alias("n_docs"))
    lengths = posted.groupBy("corpus_id").agg(F.sum("tf").alias("n_words"))
    words = F.coalesce("n_words", F.lit(0)).alias("n_words")
    return _with_average(sizes.join(F.broadcast(lengths), "corpus_id", "left").select("corpus_id", "n_docs", words))


def _with_average(sizes: DataFrame) -> DataFrame:
    return sizes.select("corpus_id", "n_docs", "n_words", (F.col("n_words") / F.col("n_docs")).alias("avgdl"))


def merged_corpora(old: DataFrame, new: DataFrame) -> DataFrame:
    """The sizes of a corpus that grew."""
    parts = old.select("corpus_id", "n_docs", "n_words").unionByName(new.select("corpus_id", "n_docs", "n_words"))
    sums = [F.sum(name).alias(name) for name in ("n_docs", "n_words")]
    return _with_average(parts.groupBy("corpus_id").agg(*sums))


def merged_frequencies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Document frequencies of a corpus that grew; no document is in both parts."""
    parts = old.select("corpus_id", "term", "df").unionByName(new.select("corpus_id", "term", "df"))
    return parts.groupBy("corpus_id", "term").agg(F.sum("df").alias("df"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))


def term_weights(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """``idf`` per term. A term in more than half of the documents would weigh less than nothing; it
    gets a small share of the average raw weight over the vocabulary instead.
    """
    raw = frequencies.join(F.broadcast(stats), "corpus_id").select(
        "corpus_id",
        "term",
        "df",
        (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"),
    )
    floor = raw.groupBy("corpus_id").agg((F.avg("raw") * BM25_EPSILON).alias("floor"))
    return raw.join(F.broadcast(floor), "corpus_id").select(
        "corpus_id",
        "term",
        "df",
        F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"),
    )


def lexicon(docs: DataFrame) -> Lexicon:
    """The three tables, unsaved. To query more than once, save them with the index."""
    posted = postings(docs)
    stats = corpora(docs, posted)
    return Lexicon(posted, term_weights(document_frequencies(posted), stats), stats)


def query_terms(queries: DataFrame) -> DataFrame:
    """Words of each query with their number; a repeated word counts as often as it occurs."""
    return (
        queries.select("corpus_id", "query_id", F.explode(tokens("query_text")).alias("term"))
        .groupBy("corpus_id", "query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _of_terms(posted: DataFrame, terms: DataFrame, broadcast_rows: int, joined: bool = False) -> DataFrame:
    """The postings of ``terms(corpus_id, term)``, which are saved. With ``joined``, a join that follows leaves out the others, and
    only the scan is asked.
    """
    n = terms.count()
    if n <= PUSHED_TERMS:
        wanted = [row.term for row in terms.select("term").distinct().collect()]
        posted = posted.filter(F.col("term").isin(wanted))
    if joined:
        return posted
    if n <= broadcast_rows:
        terms = F.broadcast(terms)
    return posted.join(terms, ["corpus_id", "term"], "left_semi")


def _salted(posted: DataFrame, weighted: DataFrame) -> DataFrame:
    """Inner join by term in which a frequent term is cut into shares by its number of postings.

    Only terms with more postings than a task takes are cut; there are no more of those than the corpus fills tasks.
    """
    key = ["corpus_id", "term"]
    shares = F.ceil(F.col("df") / POSTINGS_PER_TASK)
    cut = weighted.select(*key, shares.alias("_shares")).filter("_shares > 1").distinct()
    share = F.when(F.col("_shares") > 1, F.pmod(F.xxhash64("doc_id"), F.col("_shares"))).otherwise(0)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(shares, F.lit(1)) - 1))
    return (
        posted.join(F.broadcast(cut), key, "left")
        .withColumn("_share", share)
        .drop("_shares")
        .join(weighted.withColumn("_share", copies), [*key, "_share"])
        .drop("_share")
    )


def document_scores(
    lex: Lexicon, queries: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``(corpus_id, query_id, doc_id, bm25)`` of the documents that share a word with the query."""
    key = ["corpus_id", "term"]
    asked = materialise(query_terms(queries), "asked")
    wanted = materialise(asked.select(*key).distinct(), "wanted")
    small = fits_broadcast(asked, broadcast_rows)
    terms = F.broadcast(wanted) if small else wanted
    known = lex.terms.join(F.broadcast(lex.corpora), "corpus_id").select(*key, "df", "idf", "avgdl")
    weighted = asked.join(known.join(terms, key, "left_semi"), key)
    if not small:
        weighted = materialise(weighted, "weighted")

    def sums(posted: DataFrame) -> DataFrame:
        matching = _of_terms(posted, wanted, broadcast_rows, joined=small and lex.bucketed)
        if small:
            if not lex.bucketed:
                # Only postings of the words asked for are moved, and once for all queries.
                matching = matching.repartition("doc_id")
            matched = matching.join(F.broadcast(weighted), key)
        else:
            matched = _salted(matching, weighted)
        return matched.groupBy("corpus_id", "query_id", "doc_id").agg(F.sum(_weight(F.col("qtf"))).alias("bm25"))

    return reduce(DataFrame.unionByName, [sums(part) for part in lex.parts or (lex.postings,)])


def normalised_scores(scores: DataFrame) -> DataFrame:
    """``scores`` with ``bm25_norm``, the share of the best score of the query. The scores are worked out once and saved."""
    scores = materialise(scores, "scores")
    best = scores.groupBy("corpus_id", "query_id").agg(F.max("bm25").alias("best"))
    return (
        scores.join(broadcast_if_small(best), ["corpus_id", "query_id"])
        .withColumn("bm25_norm", max_normalised("bm25", "best"))
        .drop("best")
    )


def best_matches(lex: Lexicon, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents by BM25 alone, among those that share a word with the query."""
    scores = document_scores(lex, queries).withColumnRenamed("bm25", "score")
    scores = scores.withColumn("score", rounded("score"))
    # A task holds all sums of its documents, so its own best ``k`` are all it has to pass on.
    return top_k(best_of_task(scores, k), k)


# Documents per block of the impact bounds.
BLOCK_DOCS = 256
# Scores are compared rounded; a bound that comes this near a threshold is still read.
BOUND_SLACK = 1e-6


@dataclass
class Scored:
    """Postings that ``bounded_matches`` summed, against all postings of the query terms; filled only when asked."""

    postings: int = 0
    whole: int = 0


def impacts(posted: DataFrame, known: DataFrame, blocks: int) -> DataFrame:
    """``(corpus_id, term, block, impact)``: the largest weight of a term in any document of a block, for ``qtf`` 1.

    A block is ``pmod(xxhash64(doc_id), blocks)``. ``posted`` holds the postings of the terms in ``known`` only, and a task passes
    on one row per term and block.
    """
    return (
        posted.join(broadcast_if_small(known), ["corpus_id", "term"])
        .withColumn("block", _block(blocks))
        .groupBy("corpus_id", "term", "block")
        .agg(F.max(_weight(F.lit(1))).alias("impact"))
    )


def _weight(qtf) -> F.Column:
    length = 1.0 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")
    return qtf * F.col("idf") * F.col("tf") * (BM25_K1 + 1.0) / (F.col("tf") + BM25_K1 * length)


def _block(blocks: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")


def _rounded_sums(matched: DataFrame) -> DataFrame:
    sums = matched.groupBy("corpus_id", "query_id", "doc_id").agg(F.sum(_weight(F.col("qtf"))).alias("score"))
    return sums.withColumn("score", rounded("score"))


def bounded_matches(lex: Lexicon, queries: DataFrame, k: int, scored: Scored | None = None) -> DataFrame:
    """The same rows as ``best_matches``, without summing documents that cannot be among a query's best ``k``.

    Per block of about ``BLOCK_DOCS`` documents and term, the largest weight bounds what any document of the block gets
    from that term; summed over a query's terms it bounds the block. First the documents of the query's rarest terms,
    taken by falling weight until they hold ``k`` documents, are scored with all its terms; their ``k``-th score is a
    floor for the query's ``k``-th, and only blocks whose bound reaches it are scored. A document that shares only frequent words with a query (whose weights are small) lies in blocks that
    stay below the floor and is never summed. With fewer than ``k`` documents found first, every block is read.
    """
    n_docs = lex.corpora.agg(F.max("n_docs")).first()[0] or 0
    n_blocks = max(1, -(-n_docs // BLOCK_DOCS))
    key, pair = ["corpus_id", "term"], ["corpus_id", "query_id"]
    asked = materialise(query_terms(queries), "asked")
    wanted = materialise(asked.select(*key).distinct(), "wanted")
    known = lex.terms.join(F.broadcast(lex.corpora), "corpus_id").select(*key, "df", "idf", "avgdl")
    known = materialise(known.join(broadcast_if_small(wanted), key, "left_semi"), "known")
    weighted = materialise(asked.join(known, key), "weighted")
    terms_asked = broadcast_if_small(weighted.drop("df"))
    # Only postings of the words asked for are read, and they stay in their buckets while the queries' tables are small.
    parts = [_of_terms(part, wanted, BROADCAST_ROWS) for part in lex.parts or (lex.postings,)]
    if not lex.bucketed:
        parts = [part.repartition("doc_id") for part in parts]
    posted = reduce(DataFrame.unionByName, parts)
    bounds = materialise(
        weighted.join(impacts(posted, known.drop("df"), n_blocks), key)
        .groupBy(*pair, "block")
        .agg(F.sum(F.col("qtf") * F.col("impact")).alias("bound")),
        "bounds",
    )
    # The floor: documents of each query's rarest terms, enough of them to hold k documents, scored with all terms.
    rarest = Window.partitionBy(*pair).orderBy(F.desc("idf"), "term")
    before = rarest.rowsBetween(Window.unboundedPreceding, -1)
    seeds = (
        weighted.withColumn("_held", F.coalesce(F.sum("df").over(before), F.lit(0)))
        .filter(F.col("_held") < k)
        .select(*pair, "term")
    )
    seed_docs = materialise(posted.join(broadcast_if_small(seeds), key).select(*pair, "doc_id").distinct(), "seeds")
    of_seeds = broadcast_if_small(seed_docs)
    early = reduce(
        DataFrame.unionByName,
        [
            _rounded_sums(part.join(terms_asked, key).join(of_seeds, [*pair, "doc_id"], "left_semi"))
            for part in parts
        ],
    )
    by_score = Window.partitionBy(*pair).orderBy(F.desc("score"), "doc_id")
    floor = materialise(
        early.withColumn("_n", F.row_number().over(by_score))
        .filter(F.col("_n") == k)
        .select(*pair, F.col("score").alias("floor")),
        "floor",
    )
    reach = bounds.join(floor, pair, "left").filter(
        F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - BOUND_SLACK)
    )
    reached = materialise(reach.select(*pair, "block"), "reached")
    # A query that reaches half of the blocks sums every document: looking each one up would cost more than it saves.
    n_reached = reached.groupBy(*pair).agg(F.count("*").alias("n"))
    wide = materialise(n_reached.filter(F.col("n") * 2 >= n_blocks).select(*pair), "wide")
    wide = broadcast_if_small(wide)
    later = materialise(reached.join(wide, pair, "left_anti"), "later")
    if scored is not None:
        per_block = posted.select(*key, _block(n_blocks)).groupBy(*key, "block").agg(F.count("*").alias("n"))
        terms_blocks = weighted.select(*pair, "term").join(per_block, key)
        read = terms_blocks.join(later, [*pair, "block"], "left_semi").unionByName(
            terms_blocks.join(wide, pair, "left_semi")
        )
        scored.whole += terms_blocks.agg(F.sum("n")).first()[0] or 0
        scored.postings += read.agg(F.sum("n")).first()[0] or 0
        scored.postings += (
            posted.join(terms_asked, key).join(of_seeds, [*pair, "doc_id"], "left_semi").count()
        )
    of_wide = broadcast_if_small(weighted.drop("df").join(wide, pair, "left_semi"))
    of_later = broadcast_if_small(weighted.drop("df").join(later.select(*pair).distinct(), pair, "left_semi"))
    some = broadcast_if_small(later)
    found = []
    for part in parts:
        found.append(_rounded_sums(part.join(of_wide, key)))
        in_blocks = part.withColumn("block", _block(n_blocks)).join(of_later, key)
        found.append(_rounded_sums(in_blocks.join(some, [*pair, "block"], "left_semi")))
    return top_k(reduce(DataFrame.unionByName, [best_of_task(scores, k) for scores in found]), k)
