
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from oracles import ORACLES  # noqa: E402
from quarry.config import EVALUATION, SearchSettings  # noqa: E402
from quarry.functions.scores import last_entry_wins, rounded  # noqa: E402
from quarry.functions.text import combined_text, preview, tokens  # noqa: E402
from quarry.functions.vectors import l2_normalise  # noqa: E402
from quarry.operators.clustered import LISTS, build_clustered, exact_search, probe_search
from quarry.operators.embed import HashedWords, HashedWordsSql, StoredVectors, SubwordCapped  # noqa: E402
from quarry.operators.evaluate import compare, judged, ranking_metrics  # noqa: E402
from quarry.operators.lexical import document_scores, normalised_scores, postings  # noqa: E402
from quarry.operators.reports import (  # noqa: E402
    checks_passed,
    health_checks,
    hits_per_query,
    index_report,
    norm_report,
)
from quarry.plans import build, goldset, search  # noqa: E402
from quarry.session import fresh_path, materialise, ship_package  # noqa: E402
from quarry.sources.goldset import judged_reviews, judgement_counts, judgements, label_map  # noqa: E402
from quarry.sources.reviews import (  # noqa: E402
    documents,
    documents_by_id,
    page,
    sample_one,
)
from quarry.sources.store import (  # noqa: E402
    StoredIndex,
    failed_rows,
    index_counts,
    load_index,
    read_documents,
    with_corpus,
)
from quarry.streaming.build import index_stream, read_stream  # noqa: E402

# The training-data operators can be left out as a whole.
try:
    import corpus_pipeline  # noqa: E402
    from quarry.llm.queries import ORACLES as LLM_ORACLES  # noqa: E402
    from quarry.llm.queries import QUERIES as LLM_QUERIES  # noqa: E402

    LLM_QUERIES = LLM_QUERIES | {"pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_ORACLES = LLM_ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "quarry.llm", "quarry.llm.queries"):
        raise
    LLM_QUERIES, LLM_ORACLES = {}, {}

DIMENSION = 64
EMBEDDER = HashedWords(DIMENSION)
SMOKE_DIR = "/root/testdata/sf0.001"

# Indexes are built once per session and data folder and then read from storage, as in real use.
_built: dict[tuple, object] = {}


def _once(name: str, make: Callable[[SparkSession, str], object]):
    def get(spark: SparkSession, sf: str):
        key = (name, spark.sparkContext.applicationId, sf)
        if key not in _built:
            _built[key] = make(spark, sf)
        return _built[key]

    return get


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _as_reviews(table: DataFrame) -> DataFrame:
    """The first line of a document is its summary, the rest its text; empty parts are NULL."""
    lines = table.select("doc_id", "text", "lang", "source", F.instr("text", "\n").alias("end"))
    summary = F.when(F.col("end") == 0, F.col("text")).otherwise(F.expr("left(text, end - 1)"))
    rest = F.when(F.col("end") > 0, F.expr("substring(text, end + 1)"))
    return lines.select(
        "doc_id",
        F.nullif(summary, F.lit("")).alias("summary"),
        F.nullif(rest, F.lit("")).alias("text"),
        "lang",
        "source",
    )


def _reviews(spark, sf):
    return _as_reviews(_table(spark, sf, "documents")).drop("lang", "source")


def _docs(spark, sf):
    # The table is one file here and would be one task; a large one brings its own partitions, which stay of one size.
    table = _table(spark, sf, "documents")
    if table.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        table = table.repartition(spark.sparkContext.defaultParallelism)
    return documents(_as_reviews(table), keep=["lang", "source"])


def _queries(spark, sf):
    return _table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def _gold(spark, sf):
    def verdict(name):
        return F.when(F.col(name) == 1, "YES").when(F.col(name) == 0, "NO")

    return _table(spark, sf, "labels").select(
        "doc_id", verdict("quality").alias("high quality"), verdict("toxic").alias("toxic content")
    )


def _gold_queries(spark, sf):
    names = [c for c in _gold(spark, sf).columns if c != "doc_id"]
    return _queries(spark, sf).withColumn("corpus_id", F.explode(F.lit(names)))


_index = _once("index", lambda spark, sf: build.scratch_index(_docs(spark, sf), EMBEDDER))


def _short(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "combined_text")
_gold_index = _once(
    "gold", lambda spark, sf: goldset.index_gold_set(_gold(spark, sf), _reviews(spark, sf), EMBEDDER)
)


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "doc_id", rounded("score", 6).alias("score"), "rank", *more)


def _buckets(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter(
        "w <> 0"
    ).select("doc_id", "bucket", rounded(F.col("w").cast("double"), 6).alias("weight"))


def _centroids(vectors: DataFrame, key) -> DataFrame:
    """The mean vector of each key, of length one: queries drawn from the whole table."""
    means = (
        vectors.select(key.alias("query_id"), F.posexplode("embedding").alias("p", "x"))
        .groupBy("query_id", "p")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("c"))
    )
    return means.select("query_id", l2_normalise(F.col("c.m")).alias("query_vector"))


def _vector_search(spark, sf, key) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").withColumn("doc_id", F.col("vec_id"))
    index = StoredIndex(with_corpus(vectors.select("doc_id", "embedding")), None, None)
    return _hits(search.search(index, _centroids(vectors, key)))


# Clustered indexes of the documents' vectors and of the stored vectors, built once per session and folder.
_clustered_docs = _once("clustered-docs", lambda spark, sf: build_clustered(_index(spark, sf).documents, LISTS))
_clustered_vectors = _once(
    "clustered-vectors",
    lambda spark, sf: build_clustered(
        with_corpus(_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")), LISTS
    ),
)


def _asked(spark, sf) -> DataFrame:
    return search.prepared(_queries(spark, sf), EMBEDDER)


def ivf_all_lists(spark, sf):
    """Every query probes every list: the same rows as ``semantic_batch``."""
    return _hits(probe_search(_clustered_docs(spark, sf), _asked(spark, sf), 10, probes=LISTS))


def ivf_probed(spark, sf):
    """Each query probes its 8 nearest of 32 lists."""
    return _hits(probe_search(_clustered_docs(spark, sf), _asked(spark, sf), 10, probes=8))


def semantic_batch_skipping(spark, sf):
    """Exact search that reads only the lists whose bound reaches a query's tenth score."""
    return _hits(exact_search(_clustered_docs(spark, sf), _asked(spark, sf), 10))


def semantic_topk_skipping(spark, sf):
    vectors = _table(spark, sf, "embeddings")
    return _hits(exact_search(_clustered_vectors(spark, sf), with_corpus(_centroids(vectors, F.lit(0))), 10))


def semantic_stored_vectors(spark, sf):
    """The documents that have a vector, searched with the mean vector of each label."""
    vectors = _table(spark, sf, "embeddings").withColumn("doc_id", F.col("vec_id"))
    stored = StoredVectors(vectors, DIMENSION, missing="drop")
    index = StoredIndex(build.embedded(_short(_docs(spark, sf)), stored), None, None)
    return _hits(search.search(index, _centroids(vectors, F.col("label"))))


def _search(spark, sf, **kwargs) -> DataFrame:
    return search.search(_index(spark, sf), _queries(spark, sf), EMBEDDER, **kwargs)


def combined_text_query(spark, sf):
    return _reviews(spark, sf).select(
        "doc_id", combined_text("summary", "text", mode="compat").alias("combined_text")
    )


def combined_text_space(spark, sf):
    return documents(_reviews(spark, sf), sep=" ", keep_blank=True)


def nonempty_docs(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.length("combined_text").cast("long").alias("n_chars")
    )


def doc_lookup(spark, sf):
    flagged = _table(spark, sf, "labels").filter("toxic = 1")
    return documents_by_id(_reviews(spark, sf), flagged)


def text_preview(spark, sf):
    return _reviews(spark, sf).select(
        "doc_id",
        preview("summary", 150).alias("summary_preview"),
        preview("text", 200).alias("text_preview"),
    )


def _judged_again(spark, sf):
    """Judgements with repeats, other spellings and ids without a review."""
    known = judgements(_gold(spark, sf))
    parts = [
        known.withColumn("label", F.lower("label")),
        known.filter("corpus_id = 'toxic content'").withColumn("corpus_id", F.lit("high quality")),
        _table(spark, sf, "documents").select(F.lit("toxic content"), "doc_id", F.lit("maybe")),
        known.withColumn("doc_id", -1 - F.col("doc_id")),
    ]
    for part in parts:
        known = known.union(part)
    return known


def gold_stats(spark, sf):
    return judgement_counts(_judged_again(spark, sf), _reviews(spark, sf))


def tokens_query(spark, sf):
    words = _docs(spark, sf).select("doc_id", tokens("combined_text").alias("w"))
    return words.select(
        "doc_id",
        F.size("w").cast("long").alias("n_tokens"),
        F.md5(F.concat_ws(" ", "w").cast("binary")).alias("digest"),
    )


def postings_query(spark, sf):
    return postings(with_corpus(_docs(spark, sf))).select("doc_id", "term", "tf", "dl")


def corpus_stats(spark, sf):
    stats = _index(spark, sf).lexicon.corpora
    return stats.select("corpus_id", "n_docs", rounded("avgdl", 6).alias("avgdl"))


def term_idf(spark, sf):
    return _index(spark, sf).lexicon.terms.select("term", "df", rounded("idf", 6).alias("idf"))


def hashed_embedding(spark, sf):
    return _buckets(build.embedded(_docs(spark, sf), EMBEDDER))


def hashed_embedding_capped(spark, sf):
    """``hashed_embedding`` of each text's first 64 sub-words of a public byte-level BPE tokenizer."""
    import public_tokenizers

    capped = SubwordCapped(EMBEDDER, public_tokenizers.path("byte_bpe_50k.json"), max_seq_length=64)
    return _buckets(build.embedded(_docs(spark, sf), capped))


def hashed_embedding_sql(spark, sf):
    return _buckets(build.embedded(_docs(spark, sf), HashedWordsSql(DIMENSION)))


def l2_normalise_query(spark, sf):
    unit = _table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(l2_normalise("embedding")).alias("position", "x")
    )
    return unit.select("vec_id", "position", rounded(F.col("x").cast("double"), 6).alias("value"))


def vector_norms(spark, sf):
    report = norm_report(_table(spark, sf, "embeddings"))
    return report.select(
        "n_vectors", rounded("min_norm", 6).alias("min_norm"), rounded("max_norm", 6).alias("max_norm")
    )


def index_stats(spark, sf):
    return index_report(_index(spark, sf))


def index_health(spark, sf):
    return health_checks(_reviews(spark, sf), _index(spark, sf).documents)


def bm25_scores(spark, sf):
    scores = document_scores(_index(spark, sf).lexicon, with_corpus(_queries(spark, sf)))
    return scores.select("query_id", "doc_id", rounded("bm25", 6).alias("bm25"))


def bm25_normalised(spark, sf):
    scores = document_scores(_index(spark, sf).lexicon, with_corpus(_queries(spark, sf)))
    return normalised_scores(scores).select(
        "query_id", "doc_id", rounded("bm25_norm", 6).alias("bm25_norm")
    )


def bm25_topk(spark, sf):
    return _hits(search.lexical_search(_index(spark, sf), _queries(spark, sf)))


def hybrid_vs_semantic(spark, sf):
    both = search.search_both(_index(spark, sf), _queries(spark, sf), EMBEDDER)
    return _hits(both, "search_type")


def gold_index(spark, sf):
    index, _ = _gold_index(spark, sf)
    terms = index.lexicon.terms.groupBy("corpus_id").agg(
        F.count("*").alias("n_terms"), F.avg("idf").alias("m")
    )
    return index.lexicon.corpora.join(terms, "corpus_id").select(
        "corpus_id",
        "n_docs",
        rounded("avgdl", 6).alias("avgdl"),
        "n_terms",
        rounded("m", 6).alias("mean_idf"),
    )


def judged_hits(spark, sf):
    index, labels = _gold_index(spark, sf)
    hits = search.search(index, _gold_queries(spark, sf), EMBEDDER, EVALUATION)
    return judged(hits, labels).select(
        "corpus_id", "query_id", "doc_id", "rank", rounded("score", 6).alias("score"), "label", "relevant"
    )


def ranking_metrics_query(spark, sf):
    index, labels = _gold_index(spark, sf)
    queries = _gold_queries(spark, sf)
    hits = search.search_both(index, queries, EMBEDDER, EVALUATION, (10, 15))
    names = ["recall", "reciprocal_rank", "average_precision", "ndcg"]
    found = ranking_metrics(materialise(hits, "hits"), labels, queries, (10, 15))
    return found.select(
        "corpus_id", "query_id", "search_type", "k", *[rounded(name, 6).alias(name) for name in names]
    )


def _precision(spark, sf):
    index, labels = _gold_index(spark, sf)
    return goldset.evaluate(index, labels, _gold_queries(spark, sf), (10, 15), EMBEDDER)


def precision_at_k(spark, sf):
    return _precision(spark, sf).withColumn("precision_at_k", rounded("precision_at_k", 6))


def precision_compare(spark, sf):
    wide = compare(_precision(spark, sf))
    names = ["semantic_precision", "hybrid_precision", "improvement"]
    return wide.select(
        "corpus_id", "query_id", "k", *[rounded(name, 6).alias(name) for name in names]
    )


def enriched_hits(spark, sf):
    hits = search.search_with_documents(
        _index(spark, sf), _queries(spark, sf), _reviews(spark, sf), EMBEDDER
    )
    return _hits(hits, "summary", "text")


def hits_per_query_report(spark, sf):
    index, _ = _gold_index(spark, sf)
    queries = _gold_queries(spark, sf)
    return hits_per_query(search.search(index, queries, EMBEDDER, min_score=0.5), queries)


def dedupe_last_wins(spark, sf):
    both = search.search_both(_index(spark, sf), _queries(spark, sf), EMBEDDER)
    return last_entry_wins(both).select("query_id", "doc_id", rounded("score", 6).alias("score"))


def _grown(spark, sf) -> str:
    """First the judged documents, then everything that is missing, then nothing new."""
    docs = _docs(spark, sf)
    path = fresh_path(spark, "incremental")
    judged_ids = _table(spark, sf, "labels").select("doc_id")
    build.build_index(docs.join(judged_ids, "doc_id", "left_semi"), EMBEDDER, path)
    build.add_documents(docs, EMBEDDER, path)
    build.add_documents(docs, EMBEDDER, path)
    return path


def _streamed(spark, sf) -> str:
    """The judged documents arrive as a stream; the others are added to what it made."""
    docs = _table(spark, sf, "documents")
    # A table is one file or a folder of files; Spark streams either by a pattern, here one that matches this name alone.
    arriving = documents(
        _as_reviews(read_stream(spark, f"{sf}/[d]ocuments.parquet", docs.schema)), keep=["lang", "source"]
    )
    judged_ids = _table(spark, sf, "labels").select("doc_id").distinct()
    path = fresh_path(spark, "stream")
    index_stream(
        arriving.join(judged_ids, "doc_id", "left_semi"), EMBEDDER, path, f"{path}/checkpoint"
    ).awaitTermination()
    build.add_documents(_docs(spark, sf), EMBEDDER, path)
    return path


_grown_index = _once("grown", _grown)
_streamed_index = _once("streamed", _streamed)


def incremental_build(spark, sf):
    return _buckets(read_documents(spark, _grown_index(spark, sf)))


def stream_build(spark, sf):
    return _buckets(read_documents(spark, _streamed_index(spark, sf)))


def incremental_hybrid(spark, sf):
    index = load_index(spark, _grown_index(spark, sf))
    return _hits(search.search(index, _queries(spark, sf), EMBEDDER))


def stream_hybrid(spark, sf):
    index = load_index(spark, _streamed_index(spark, sf))
    return _hits(search.search(index, _queries(spark, sf), EMBEDDER))


def stored_settings_hybrid(spark, sf):
    """An index saved with another weight, loaded and searched without saying so.

    Not 0.5: half of a score of nine decimals is a tie for rounding to nine, which engines decide differently.
    """
    path = fresh_path(spark, "weighted")
    build.build_index(_docs(spark, sf), EMBEDDER, path, SearchSettings(bm25_weight=0.6))
    return _hits(search.search(load_index(spark, path), _queries(spark, sf), EMBEDDER))


def filtered_search(spark, sf):
    return _hits(_search(spark, sf, where="lang = 'fr' AND source <> 'src0'"))


def _refusing_words():
    # Defined here so that it travels to the workers by value.
    class RefusingWords(HashedWords):
        """Hashed words that fail on texts with a bar: a model that cannot take every input."""

        def encoder(self):
            encode = super().encoder()

            def strict(texts):
                if any("|" in text for text in texts):
                    raise ValueError("bar in text")
                return encode(texts)

            return strict

    return RefusingWords(DIMENSION)


def quarantine(spark, sf):
    """A build that may lose a tenth of its rows, and what it kept and lost."""
    docs = _docs(spark, sf)
    path = fresh_path(spark, "quarantine")
    index, _ = build.build_index(docs, _refusing_words(), path, max_errors=docs.count() // 10)
    return index.documents.select("doc_id", F.lit(False).alias("failed")).unionByName(
        failed_rows(spark, path).select("doc_id", F.lit(True).alias("failed"))
    )


def entry(spark: SparkSession) -> DataFrame:
    """Hybrid search of all benchmark queries over all documents."""
    return queries()["hybrid_topk"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "combined_text": combined_text_query,
        "combined_text_space": combined_text_space,
        "nonempty_docs": nonempty_docs,
        "doc_lookup": doc_lookup,
        "sample_row": lambda spark, sf: sample_one(_short(_docs(spark, sf))),
        "page_by_id": lambda spark, sf: page(_short(_docs(spark, sf)), size=500, after=99),
        "text_preview": text_preview,
        "gold_join": lambda spark, sf: judged_reviews(
            judgements(_gold(spark, sf)), _reviews(spark, sf)
        ),
        "gold_unpivot": lambda spark, sf: judgements(_gold(spark, sf)),
        "gold_stats": gold_stats,
        "gold_label_map": lambda spark, sf: label_map(_judged_again(spark, sf)),
        "tokens": tokens_query,
        "postings": postings_query,
        "corpus_stats": corpus_stats,
        "term_idf": term_idf,
        "hashed_embedding": hashed_embedding,
        "hashed_embedding_capped": hashed_embedding_capped,
        "hashed_embedding_sql": hashed_embedding_sql,
        "l2_normalise": l2_normalise_query,
        "vector_norms": vector_norms,
        "index_stats": index_stats,
        "index_consistency": lambda spark, sf: index_counts(_index(spark, sf).documents),
        "health_checks": index_health,
        "checks_passed": lambda spark, sf: checks_passed(index_health(spark, sf)),
        "semantic_topk": lambda spark, sf: _vector_search(spark, sf, F.lit(0)),
        "semantic_stored_vectors": semantic_stored_vectors,
        "semantic_batch": lambda spark, sf: _hits(_search(spark, sf, use_bm25=False)),
        "ivf_all_lists": ivf_all_lists,
        "ivf_probed": ivf_probed,
        "semantic_batch_skipping": semantic_batch_skipping,
        "semantic_topk_skipping": semantic_topk_skipping,
        "semantic_threshold": lambda spark, sf: _hits(
            _search(spark, sf, use_bm25=False, min_score=0.5)
        ),
        "bm25_scores": bm25_scores,
        "bm25_normalised": bm25_normalised,
        "bm25_topk": bm25_topk,
        "hybrid_topk": lambda spark, sf: _hits(_search(spark, sf)),
        "hybrid_threshold": lambda spark, sf: _hits(_search(spark, sf, min_score=0.5)),
        "hybrid_vs_semantic": hybrid_vs_semantic,
        "gold_index": gold_index,
        "judged_hits": judged_hits,
        "precision_at_k": precision_at_k,
        "precision_compare": precision_compare,
        "enriched_hits": enriched_hits,
        "hits_per_query": hits_per_query_report,
        "dedupe_last_wins": dedupe_last_wins,
        "incremental_build": incremental_build,
        "stream_build": stream_build,
        "incremental_hybrid": incremental_hybrid,
        "stream_hybrid": stream_hybrid,
        "stored_settings_hybrid": stored_settings_hybrid,
        "filtered_search": filtered_search,
        "ranking_metrics": ranking_metrics_query,
        "quarantine": quarantine,
    } | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | LLM_ORACLES
