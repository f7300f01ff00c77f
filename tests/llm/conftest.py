import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of texts (ids from 0), or of (id, text) pairs."""

    def make(texts, **columns):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        df = spark.createDataFrame([(i, t, columns.get("lang", "en"), columns.get("source", "src0"), len(t or "")) for i, t in rows], TEXTS)
        return df

    return make


#: Columns with names that operators might use themselves.
CLASHING = ["row", "h", "bucket", "key", "shard", "slot", "size", "run", "n", "found", "score", "lang_pred", "epoch", "tokens", "domain", "unit", "words", "th", "digest", "kept", "n_tokens", "known", "least", "chunk", "text_crc32", "law", "grown_shard", "rid", "spot", "chance", "block", "label"]


@pytest.fixture
def clashing():
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns})
