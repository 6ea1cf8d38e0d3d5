import pytest


@pytest.fixture(scope="session")
def make(spark):
    """documents rows (doc_id, text, lang, source, n_chars) with clashing extra columns."""

    def build(rows, extra=True):
        full = [(i, t, *(rest or ("en", "s", len(t or "")))) for i, t, *rest in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("words", "fp", "k1", "row", "sig", "blob", "spans", "key", "at", "uid", "bin", "keep", "rid", "root"):
                df = df.selectExpr("*", f"cast(null as int) AS `{name}`")
        return df

    return build


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
