import pytest
from pyspark.sql import functions as F

from quarry.functions.text import WHITESPACE, combined_text, not_blank, preview, safe_name, strip, tokens
from quarry.sources.reviews import documents

AWKWARD = [
    "  Two  words ",
    f"a{WHITESPACE}b",
    "".join(f"{c}x" for c in WHITESPACE),
    "",
    WHITESPACE,
    "ΣΑΣ İstanbul ÉTÉ",
    "one\ntwo\tthree\x0bfour",
]


def test_tokens_and_strip_agree_with_python(spark):
    df = spark.createDataFrame([(s,) for s in AWKWARD], "s string")
    for row in df.select("s", tokens("s").alias("t"), strip("s").alias("p")).collect():
        assert row.t == row.s.lower().split()
        assert row.p == row.s.strip()


def test_null_text_has_no_tokens(spark):
    df = spark.createDataFrame([(None,)], "s string")
    row = df.select(tokens("s").alias("t"), not_blank("s").alias("b")).first()
    assert row.t == [] and row.b is False


def test_compat_text_keeps_the_separator_of_two_empty_parts(reviews):
    text = combined_text("summary", "text", mode="compat")
    got = {r.doc_id: r.t for r in reviews.select("doc_id", text.alias("t")).collect()}
    assert got[1] == "\n\n" and got[2] == "\n\n"
    assert got[3] == "a \n\n" and got[4] == "s\n\nt"


def test_documents_drop_blank_rows_in_clean_mode_only(reviews):
    assert {r.doc_id for r in documents(reviews).collect()} == {3, 4, 5, 6, 7}
    assert documents(reviews, mode="compat").count() == 7
    spaced = {r.doc_id: r.combined_text for r in documents(reviews, " ", keep_blank=True).collect()}
    assert spaced[1] == "" and spaced[3] == "a" and spaced[4] == "s t"


def test_unknown_mode(reviews):
    with pytest.raises(ValueError, match="mode"):
        combined_text("summary", "text", mode="other")


def test_preview_and_safe_name(spark):
    df = spark.createDataFrame([("abcdef", "a/b/c")], "s string, n string")
    row = df.select(preview("s", 3).alias("x"), preview("s", 6).alias("y"), safe_name("n").alias("z")).first()
    assert (row.x, row.y, row.z) == ("abc...", "abcdef", "a_b_c")


def test_one_tokenisation_in_the_plan_of_postings(spark, reviews):
    from quarry.operators.lexical import postings
    from quarry.sources.store import with_corpus

    docs = with_corpus(reviews.select("doc_id", F.col("text").alias("combined_text")))
    plan = postings(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove") == 1
