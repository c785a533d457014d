import pytest

from samewise.operators import vectors


def test_no_term_is_left_out_in_silence(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c a")], "rid long, text string")
    monkeypatch.setattr(vectors, "TERMS", 2)
    with pytest.raises(ValueError):
        vectors.svd_scores(df)
    monkeypatch.setattr(vectors, "TERMS", 3)
    assert vectors.svd_scores(df).count() == 3
