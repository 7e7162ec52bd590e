from collections import Counter

from quarry.operators.lexical import postings
from quarry.sources.store import with_corpus


def _got(df):
    return sorted((r.doc_id is None, r.doc_id, r.dl, r.term, r.tf) for r in df.collect())


def _expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        words = (text or "").lower().split()
        for word in words:
            counts[doc_id is None, doc_id, len(words), word] += 1
    return sorted((*key, n) for key, n in counts.items())


def test_words_are_counted_inside_the_row(spark):
    rows = [(1, "b a B  c\ta b"), (2, None), (3, "  \n"), (4, "one"), (None, "x y x"), (5, "é E é z")]
    docs = with_corpus(spark.createDataFrame(rows, "doc_id long, combined_text string"))
    found = postings(docs, 3, unique=True)
    assert _got(found) == _got(postings(docs)) == _expected(rows)
    # No table of words in a task: neither an aggregate nor a sort.
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_id_and_length_are_one_document(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "c b a"), (1, "a"), (2, "a b a"), (None, "a b"), (None, "b b")]
    docs = with_corpus(spark.createDataFrame(rows, "doc_id long, combined_text string"))
    assert _got(postings(docs)) == _expected(rows)
