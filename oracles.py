"""The registered queries as DuckDB SQL, put together from shared table expressions."""

from __future__ import annotations

# The characters Python counts as white space, as an RE2 class.
WS = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
DIMENSION = 64


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{WS}+|{WS}+$', '', 'g')"


def words(expression: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({expression}), '{WS}+'), lambda w: w <> '')"
    )


REVIEWS = """reviews AS (
  SELECT doc_id, nullif(split_part(text, chr(10), 1), '') AS summary,
         nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS text
  FROM documents)"""


def joined(sep: str) -> str:
    return f"coalesce(summary, '') || {sep} || coalesce(text, '')"


LINES = "chr(10) || chr(10)"
DOCS = f"""docs AS (
  SELECT * FROM (
    SELECT 'all' AS corpus_id, doc_id, {strip(joined(LINES))} AS combined_text FROM reviews)
  WHERE combined_text <> '')"""
GOLD_WIDE = """gold AS (
  SELECT doc_id, CASE quality WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END AS "high quality",
         CASE toxic WHEN 1 THEN 'YES' WHEN 0 THEN 'NO' END AS "toxic content"
  FROM labels)"""
GOLD = f"""{GOLD_WIDE}, judgements AS (
  SELECT * FROM (
    SELECT 'high quality' AS corpus_id, doc_id, "high quality" AS label FROM gold
    UNION ALL SELECT 'toxic content', doc_id, "toxic content" FROM gold)
  WHERE label IS NOT NULL)"""
GOLD_DOCS = f"""docs AS (
  SELECT corpus_id, doc_id, {strip(joined("' '"))} AS combined_text
  FROM judgements JOIN reviews USING (doc_id))"""
QUERIES = """queries AS (
  SELECT 'all' AS corpus_id, item_id AS query_id, text AS query_text FROM benchmark)"""
GOLD_QUERIES = """queries AS (
  SELECT c.corpus_id, item_id AS query_id, text AS query_text
  FROM benchmark, (VALUES ('high quality'), ('toxic content')) AS c(corpus_id))"""

LEXICON = f"""worded AS (
  SELECT corpus_id, doc_id, {words("combined_text")} AS w FROM docs),
postings AS (
  SELECT corpus_id, doc_id, term, count(*) AS tf, dl FROM (
    SELECT corpus_id, doc_id, len(w) AS dl, unnest(w) AS term FROM worded)
  GROUP BY ALL),
corpora AS (
  SELECT corpus_id, count(*) AS n_docs, avg(len(w)) AS avgdl FROM worded GROUP BY corpus_id),
raw_terms AS (
  SELECT corpus_id, term, df, ln(n_docs - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
  FROM (SELECT corpus_id, term, count(*) AS df FROM postings GROUP BY ALL)
  JOIN corpora USING (corpus_id)),
terms AS (
  SELECT corpus_id, term, df, CASE WHEN raw < 0 THEN low ELSE raw END AS idf
  FROM raw_terms JOIN (
    SELECT corpus_id, 0.25::DOUBLE * avg(raw) AS low FROM raw_terms GROUP BY corpus_id)
  USING (corpus_id))"""
BM25 = """query_terms AS (
  SELECT corpus_id, query_id, term, count(*) AS qtf FROM (
    SELECT corpus_id, query_id, unnest({words}) AS term FROM queries) GROUP BY ALL),
bm25 AS (
  SELECT corpus_id, query_id, doc_id,
         sum(qtf * idf * tf * 2.5::DOUBLE
             / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25
  FROM query_terms JOIN terms USING (corpus_id, term) JOIN postings USING (corpus_id, term)
       JOIN corpora USING (corpus_id)
  GROUP BY ALL)""".replace("{words}", words("query_text"))


def embedded(name: str, source: str, keys: str, text: str) -> str:
    """Hashed bag of words of ``text``, scaled to length one and stored as float."""
    return f"""{name}_counts AS (
  SELECT {keys}, b, count(*) AS c FROM (
    SELECT {keys}, ('0x' || substr(md5(unnest({words(text)})), 1, 8))::UBIGINT % {DIMENSION} AS b
    FROM {source}) GROUP BY ALL),
{name}_norms AS (
  SELECT {keys}, sqrt(sum(c * c)::DOUBLE) AS n FROM {name}_counts GROUP BY ALL),
{name} AS (
  SELECT {keys}, list(coalesce(c / n, 0)::FLOAT::DOUBLE ORDER BY b) AS v
  FROM (SELECT {keys}, t.b::UBIGINT AS b FROM {source}, range({DIMENSION}) AS t(b))
       LEFT JOIN {name}_counts USING ({keys}, b) LEFT JOIN {name}_norms USING ({keys})
  GROUP BY {keys})"""


VECTORS = (
    embedded("doc_vectors", "docs", "corpus_id, doc_id", "combined_text")
    + ",\n"
    + embedded("query_vectors", "queries", "corpus_id, query_id", "query_text")
)
PAIRS = """pairs AS (
  SELECT corpus_id, query_id, doc_id, round(list_dot_product(q.v, d.v), 9) AS score
  FROM query_vectors q JOIN doc_vectors d USING (corpus_id))"""


def ranked(name: str, source: str, k: int) -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY corpus_id, query_id ORDER BY score DESC, doc_id)::INT AS rank
    FROM {source}) WHERE rank <= {k})"""


def semantic(k: int, name: str = "semantic") -> str:
    return ranked(name, "pairs", k)


def hybrid(k: int, name: str = "hybrid", pairs: str = "pairs", weight: float = 0.3) -> str:
    return f"""{ranked(name + "_candidates", pairs, 3 * k)},
{name}_scored AS (
  SELECT corpus_id, query_id, doc_id,
         round({round(1 - weight, 9)}::DOUBLE * score + {weight}::DOUBLE * coalesce(bm25, 0)
               / CASE WHEN best > 0 THEN best ELSE 1 END, 9) AS score
  FROM {name}_candidates LEFT JOIN bm25 USING (corpus_id, query_id, doc_id)
       LEFT JOIN (SELECT corpus_id, query_id, max(bm25) AS best FROM bm25 GROUP BY ALL)
       USING (corpus_id, query_id)),
{ranked(name, name + "_scored", k)}"""


def query(*parts: str) -> str:
    *tables, select = parts
    return "WITH " + ",\n".join(tables) + "\n" + select


SEARCH = [REVIEWS, DOCS, QUERIES, VECTORS, PAIRS]
SEARCH_BOTH = [REVIEWS, DOCS, QUERIES, LEXICON, BM25, VECTORS, PAIRS]
GOLD_BOTH = [REVIEWS, GOLD, GOLD_DOCS, GOLD_QUERIES, LEXICON, BM25, VECTORS, PAIRS]
CUTOFFS = (10, 15)


def hits(table: str, minimum: float | None = 0.0) -> str:
    where = "" if minimum is None else f" WHERE score >= {minimum}"
    return f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {table}{where}"


def gold_hits() -> list[str]:
    """Semantic and hybrid hits for each cutoff, with the label of the document."""
    tables, selects = [], []
    for k in CUTOFFS:
        tables += [semantic(k, f"semantic_{k}"), hybrid(k, f"hybrid_{k}")]
        selects += [
            f"SELECT '{kind}' AS search_type, {k} AS k, corpus_id, query_id, doc_id, rank FROM {kind}_{k}"
            for kind in ("semantic", "hybrid")
        ]
    return [
        *tables,
        "found AS (" + " UNION ALL ".join(selects) + ")",
        """precisions AS (
  SELECT corpus_id, query_id, search_type, k, count_if(label = 'YES')::BIGINT AS relevant_in_top_k,
         count_if(label = 'YES') / k::DOUBLE AS precision_at_k
  FROM found LEFT JOIN judgements USING (corpus_id, doc_id)
  GROUP BY corpus_id, query_id, search_type, k)""",
    ]


CENTROIDS = """centroids AS (
  SELECT {key} AS query_id, list(m ORDER BY p) AS c FROM (
    SELECT {key}, p, avg(x) AS m FROM (
      SELECT {key}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p
      FROM {source}) GROUP BY ALL) GROUP BY ALL),
unit_centroids AS (
  SELECT query_id, list_transform(c, lambda x:
    (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::FLOAT::DOUBLE) AS v FROM centroids),
pairs AS (
  SELECT 'all' AS corpus_id, query_id, vec_id AS doc_id,
         round(list_dot_product(v, embedding::DOUBLE[]), 9) AS score
  FROM unit_centroids, embeddings{where})"""
# Documents that have a vector.
LABEL_CENTROIDS = (
    CENTROIDS.replace("{key}", "label")
    .replace("{source}", "embeddings")
    .replace("{where}", " WHERE vec_id IN (SELECT doc_id FROM documents)")
)
CENTROID = (
    CENTROIDS.replace("{key}", "one")
    .replace("{source}", "(SELECT 0 AS one, embedding FROM embeddings)")
    .replace("{where}", "")
)
# Judgements with repeats, other spellings and ids without a review.
JUDGED_AGAIN = """again AS (
  SELECT * FROM judgements
  UNION ALL SELECT corpus_id, doc_id, lower(label) FROM judgements
  UNION ALL SELECT 'high quality', doc_id, label FROM judgements WHERE corpus_id = 'toxic content'
  UNION ALL SELECT 'toxic content', doc_id, 'maybe' FROM documents
  UNION ALL SELECT corpus_id, -1 - doc_id, label FROM judgements)"""
METRICS = """relevant AS (
  SELECT corpus_id, count(*) AS n FROM judgements WHERE label = 'YES' GROUP BY corpus_id),
places AS (
  SELECT corpus_id, query_id, search_type, k, rank,
         row_number() OVER (PARTITION BY corpus_id, query_id, search_type, k ORDER BY rank) AS nth
  FROM found JOIN judgements USING (corpus_id, doc_id) WHERE label = 'YES'),
summed AS (
  SELECT corpus_id, query_id, search_type, k, count(*) AS c, min(rank) AS first, sum(nth / rank) AS precisions,
         sum(1 / log2(rank + 1)) AS gain
  FROM places GROUP BY corpus_id, query_id, search_type, k),
asked AS (
  SELECT corpus_id, query_id, search_type, k FROM queries, (VALUES ('semantic'), ('hybrid')) AS s(search_type),
         (VALUES (10), (15)) AS c(k))"""

CHECKS = """sizes AS (
  SELECT count(*) AS n_rows, count(combined_text) AS n_vectors,
         count(DISTINCT doc_id) AS n_ids, count(combined_text) AS n_texts FROM docs),
checks AS (
  SELECT 'reviews_have_rows' AS check_name, count(*) > 0 AS ok, count(*) AS detail FROM reviews
  UNION ALL SELECT 'index_has_rows', n_rows > 0, n_rows FROM sizes
  UNION ALL SELECT 'vectors_match_rows', n_vectors = n_rows, n_vectors FROM sizes
  UNION ALL SELECT 'ids_are_unique', n_ids = n_rows, n_ids FROM sizes
  UNION ALL SELECT 'texts_match_rows', n_texts = n_rows, n_texts FROM sizes)"""

BUCKETS = (
    "SELECT doc_id, (i - 1)::INT AS bucket, round(v[i], 6) AS weight FROM ("
    f"SELECT doc_id, v, unnest(range(1, {DIMENSION + 1})) AS i FROM doc_vectors) WHERE v[i] <> 0"
)
DOC_VECTORS = embedded("doc_vectors", "docs", "corpus_id, doc_id", "combined_text")

ORACLES = {
    "combined_text": query(
        REVIEWS, f"SELECT doc_id, trim({joined(LINES)}) AS combined_text FROM reviews"
    ),
    "combined_text_space": query(
        REVIEWS, f"""SELECT doc_id, {strip(joined("' '"))} AS combined_text FROM reviews"""
    ),
    "nonempty_docs": query(
        REVIEWS, DOCS, "SELECT doc_id, length(combined_text) AS n_chars FROM docs"
    ),
    "doc_lookup": query(
        REVIEWS, "SELECT * FROM reviews WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    ),
    "sample_row": query(
        REVIEWS, DOCS, "SELECT doc_id, combined_text FROM docs ORDER BY doc_id LIMIT 1"
    ),
    "page_by_id": query(
        REVIEWS,
        DOCS,
        "SELECT doc_id, combined_text FROM docs WHERE doc_id > 99 ORDER BY doc_id LIMIT 500",
    ),
    "text_preview": query(
        REVIEWS,
        """SELECT doc_id,
  CASE WHEN length(summary) > 150 THEN left(summary, 150) || '...' ELSE summary END AS summary_preview,
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text_preview
FROM reviews""",
    ),
    "gold_join": query(
        REVIEWS,
        GOLD,
        "SELECT corpus_id, doc_id, summary, text, label FROM judgements JOIN reviews USING (doc_id)",
    ),
    "gold_unpivot": query(GOLD, "SELECT corpus_id, doc_id, label FROM judgements"),
    "gold_stats": query(
        GOLD,
        JUDGED_AGAIN,
        """SELECT corpus_id, count(*) AS total_docs, count_if(label = 'YES')::BIGINT AS relevant_docs,
  count_if(label = 'NO')::BIGINT AS irrelevant_docs
FROM again WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY corpus_id""",
    ),
    "gold_label_map": query(
        GOLD,
        JUDGED_AGAIN,
        """SELECT corpus_id, doc_id, CASE WHEN bool_or(label = 'YES') THEN 'YES' WHEN bool_or(label = 'NO') THEN 'NO'
  ELSE max(label) END AS label FROM again GROUP BY corpus_id, doc_id""",
    ),
    "tokens": query(
        REVIEWS,
        DOCS,
        f"""SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS digest
FROM (SELECT doc_id, {words("combined_text")} AS w FROM docs)""",
    ),
    "postings": query(REVIEWS, DOCS, LEXICON, "SELECT doc_id, term, tf, dl FROM postings"),
    "corpus_stats": query(
        REVIEWS, DOCS, LEXICON, "SELECT corpus_id, n_docs, round(avgdl, 6) AS avgdl FROM corpora"
    ),
    "term_idf": query(
        REVIEWS, DOCS, LEXICON, "SELECT term, df, round(idf, 6) AS idf FROM terms"
    ),
    "hashed_embedding": query(REVIEWS, DOCS, DOC_VECTORS, BUCKETS),
    "hashed_embedding_sql": query(REVIEWS, DOCS, DOC_VECTORS, BUCKETS),
    "l2_normalise": """SELECT vec_id, (p - 1)::INT AS position, round((x / n)::FLOAT::DOUBLE, 6) AS value FROM (
  SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS p,
         sqrt(list_sum(list_transform(e, lambda y: y * y))) AS n
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""",
    "vector_norms": """SELECT count(n) AS n_vectors, round(min(n), 6) AS min_norm,
  round(max(n), 6) AS max_norm FROM (
  SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) AS n FROM embeddings)""",
    "index_stats": query(
        REVIEWS,
        DOCS,
        f"""SELECT count(*) AS total_documents, 'exact inner product' AS index_type,
  'hashed-words-{DIMENSION}' AS embedding_model, {DIMENSION} AS embedding_dimension,
  true AS bm25_available, true AS bm25_enabled FROM docs""",
    ),
    "index_consistency": query(REVIEWS, DOCS, CHECKS, "SELECT * FROM sizes"),
    "health_checks": query(REVIEWS, DOCS, CHECKS, "SELECT * FROM checks"),
    "checks_passed": query(
        REVIEWS,
        DOCS,
        CHECKS,
        "SELECT count_if(ok)::BIGINT AS passed, count(*) AS total FROM checks",
    ),
    "semantic_topk": query(CENTROID, semantic(10), hits("semantic")),
    "semantic_stored_vectors": query(LABEL_CENTROIDS, semantic(10), hits("semantic")),
    "semantic_batch": query(*SEARCH, semantic(10), hits("semantic")),
    "ivf_all_lists": query(*SEARCH, semantic(10), hits("semantic")),
    "semantic_batch_skipping": query(*SEARCH, semantic(10), hits("semantic")),
    "semantic_topk_skipping": query(CENTROID, semantic(10), hits("semantic")),
    "semantic_threshold": query(*SEARCH, semantic(10), hits("semantic", 0.5)),
    "bm25_scores": query(
        REVIEWS,
        DOCS,
        QUERIES,
        LEXICON,
        BM25,
        "SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM bm25",
    ),
    "bm25_normalised": query(
        REVIEWS,
        DOCS,
        QUERIES,
        LEXICON,
        BM25,
        """SELECT query_id, doc_id, round(bm25 / CASE WHEN best > 0 THEN best ELSE 1 END, 6) AS bm25_norm
FROM (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS best FROM bm25)""",
    ),
    "bm25_topk": query(
        REVIEWS,
        DOCS,
        QUERIES,
        LEXICON,
        BM25,
        "scored AS (SELECT corpus_id, query_id, doc_id, round(bm25, 9) AS score FROM bm25)",
        ranked("best", "scored", 10),
        hits("best", None),
    ),
    "hybrid_topk": query(*SEARCH_BOTH, hybrid(10), hits("hybrid")),
    "incremental_hybrid": query(*SEARCH_BOTH, hybrid(10), hits("hybrid")),
    "stream_hybrid": query(*SEARCH_BOTH, hybrid(10), hits("hybrid")),
    "stored_settings_hybrid": query(*SEARCH_BOTH, hybrid(10, weight=0.6), hits("hybrid")),
    "filtered_search": query(
        *SEARCH_BOTH,
        """some_pairs AS (
  SELECT pairs.* FROM pairs JOIN documents USING (doc_id) WHERE lang = 'fr' AND source <> 'src0')""",
        hybrid(10, pairs="some_pairs"),
        hits("hybrid"),
    ),
    "ranking_metrics": query(
        *GOLD_BOTH,
        *gold_hits(),
        METRICS,
        """SELECT corpus_id, query_id, search_type, k, round(coalesce(c / n, 0), 6) AS recall,
  round(coalesce(1 / first, 0), 6) AS reciprocal_rank,
  round(coalesce(precisions / least(n, k), 0), 6) AS average_precision,
  round(coalesce(gain / list_sum(list_transform(range(1, least(n, k) + 1), lambda r: 1 / log2(r + 1))), 0), 6) AS ndcg
FROM asked LEFT JOIN summed USING (corpus_id, query_id, search_type, k) LEFT JOIN relevant USING (corpus_id)""",
    ),
    "hybrid_threshold": query(*SEARCH_BOTH, hybrid(10), hits("hybrid", 0.5)),
    "hybrid_vs_semantic": query(
        *SEARCH_BOTH,
        semantic(10),
        hybrid(10),
        """SELECT query_id, doc_id, rank, round(score, 6) AS score, 'semantic' AS search_type
FROM semantic WHERE score >= 0 UNION ALL
SELECT query_id, doc_id, rank, round(score, 6), 'hybrid' FROM hybrid WHERE score >= 0""",
    ),
    "gold_index": query(
        REVIEWS, GOLD, GOLD_DOCS, LEXICON,
        """SELECT corpus_id, n_docs, round(avgdl, 6) AS avgdl, n_terms, round(mean_idf, 6) AS mean_idf
FROM corpora JOIN (SELECT corpus_id, count(*) AS n_terms, avg(idf) AS mean_idf
                   FROM terms GROUP BY corpus_id) USING (corpus_id)""",
    ),
    "judged_hits": query(
        *GOLD_BOTH,
        hybrid(15),
        """SELECT corpus_id, query_id, doc_id, rank, round(score, 6) AS score,
  coalesce(label, 'UNKNOWN') AS label, coalesce(label = 'YES', false) AS relevant
FROM hybrid LEFT JOIN judgements USING (corpus_id, doc_id)""",
    ),
    "precision_at_k": query(
        *GOLD_BOTH,
        *gold_hits(),
        """SELECT corpus_id, query_id, search_type, k, relevant_in_top_k,
  round(precision_at_k, 6) AS precision_at_k FROM precisions""",
    ),
    "precision_compare": query(
        *GOLD_BOTH,
        *gold_hits(),
        """SELECT corpus_id, query_id, k, round(s.precision_at_k, 6) AS semantic_precision,
  round(h.precision_at_k, 6) AS hybrid_precision,
  round(h.precision_at_k - s.precision_at_k, 6) AS improvement
FROM (SELECT * FROM precisions WHERE search_type = 'semantic') s
JOIN (SELECT * FROM precisions WHERE search_type = 'hybrid') h USING (corpus_id, query_id, k)""",
    ),
    "enriched_hits": query(
        *SEARCH_BOTH,
        hybrid(10),
        """SELECT query_id, doc_id, rank, round(score, 6) AS score, summary, text
FROM hybrid LEFT JOIN reviews USING (doc_id) WHERE score >= 0""",
    ),
    "hits_per_query": query(
        *GOLD_BOTH,
        hybrid(10),
        """SELECT corpus_id, query_id, count(doc_id) AS total_results FROM queries
LEFT JOIN (SELECT * FROM hybrid WHERE score >= 0.5) USING (corpus_id, query_id) GROUP BY corpus_id, query_id""",
    ),
    "dedupe_last_wins": query(
        *SEARCH_BOTH,
        semantic(10),
        hybrid(10),
        """SELECT query_id, doc_id, round(min(score), 6) AS score FROM (
  SELECT * FROM semantic UNION ALL SELECT * FROM hybrid) WHERE score >= 0 GROUP BY ALL""",
    ),
    "incremental_build": query(REVIEWS, DOCS, DOC_VECTORS, BUCKETS),
    "stream_build": query(REVIEWS, DOCS, DOC_VECTORS, BUCKETS),
    "quarantine": query(
        REVIEWS,
        f"""SELECT doc_id, {strip(joined(LINES))} LIKE '%|%' AS failed FROM reviews
WHERE {strip(joined(LINES))} <> ''""",
    ),
}
