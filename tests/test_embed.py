import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import ModelSettings
from quarry.operators.embed import HashedWords, HashedWordsSql, ModelEmbedder, StoredVectors

TEXTS = [(1, "The dog the DOG"), (2, ""), (3, None), (4, "ünïcode wörds here"), (5, "x " * 5000)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, combined_text string")


def _vectors(df):
    return {r.doc_id: np.array(r.v, dtype=np.float64) for r in df.collect()}


def test_both_hashed_forms_agree(docs):
    a = _vectors(HashedWords(16).embed(docs, "combined_text", "v"))
    b = _vectors(HashedWordsSql(16).embed(docs, "combined_text", "v"))
    assert a.keys() == b.keys()
    for key in a:
        np.testing.assert_array_equal(a[key], b[key])


def test_hashed_vectors_have_length_one_or_are_zero(docs):
    lengths = {k: np.linalg.norm(v) for k, v in _vectors(HashedWords(16).embed(docs, "combined_text", "v")).items()}
    assert lengths[2] == lengths[3] == 0
    assert all(abs(lengths[k] - 1) < 1e-6 for k in (1, 4, 5))


def test_word_limit_is_a_setting_that_is_off_by_default(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b")], "doc_id long, combined_text string")
    for form in (HashedWords, HashedWordsSql):
        short = _vectors(form(32, max_words=2).embed(df, "combined_text", "v"))
        whole = _vectors(form(32).embed(df, "combined_text", "v"))
        np.testing.assert_array_equal(short[1], short[2])
        assert (whole[1] != whole[2]).any()


class _Stub:
    def __init__(self, settings):
        self.settings = settings

    def encode(self, texts, batch_size, normalize_embeddings, convert_to_numpy):
        if any("boom" in t for t in texts):
            raise RuntimeError("boom")
        assert len(texts) <= batch_size
        return np.array([[len(t), self.settings.max_seq_length, 1.0] for t in texts])


def test_model_embedder_passes_settings_and_normalises(docs):
    model = ModelEmbedder(_Stub, 3, ModelSettings(name="stub/model", max_seq_length=7))
    got = _vectors(model.embed(docs, "combined_text", "v"))
    expected = np.array([15, 7, 1.0])
    np.testing.assert_allclose(got[1], expected / np.linalg.norm(expected), rtol=1e-6)


def test_wrong_dimension_is_an_error(docs):
    with pytest.raises(Exception, match="dimension 4"):
        ModelEmbedder(_Stub, 4).embed(docs, "combined_text", "v").collect()


def test_only_the_failing_row_is_reported(spark):
    df = spark.createDataFrame([(i, "boom" if i == 3 else "ok") for i in range(8)], "doc_id long, combined_text string")
    got = ModelEmbedder(_Stub, 3).embed_checked(df, "combined_text", "v", "error").collect()
    assert {r.doc_id for r in got if r.error} == {3}
    assert all((r.v is None) == (r.doc_id == 3) for r in got)


def test_embedder_runs_once_per_row(docs):
    df = HashedWords(8).embed(docs, "combined_text", "v").select(F.posexplode("v").alias("p", "x")).filter("x > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stored_vectors_join_by_id(spark, docs):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<double>")
    got = StoredVectors(vectors, 2, missing="drop").embed(docs, "combined_text", "v").collect()
    assert [(r.doc_id, r.v) for r in got] == [(1, [1.0, 0.0])]


def test_subword_cap_follows_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.operators.embed import HashedWords, SubwordCapped

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["short text", "word " * 300, "ünïcödé " * 50 + "tail", "", "<|endoftext|> " * 80]
    capped = SubwordCapped(HashedWords(16), path, max_seq_length=20)
    plain = Tokenizer.from_file(path)
    expected = []
    for text in texts:
        e = plain.encode(text, add_special_tokens=False)
        expected.append(text if len(e.ids) <= 20 else text[: e.offsets[19][1]])
    assert capped.cut()(texts) == expected
    assert len(plain.encode(expected[1], add_special_tokens=False).ids) == 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: list(r.v) for r in capped.embed(df, "text", "v").collect()}
    inner = HashedWords(16)
    want = {r.doc_id: list(r.v) for r in inner.embed(spark.createDataFrame(list(enumerate(expected)), "doc_id long, text string"), "text", "v").collect()}
    assert got == want
