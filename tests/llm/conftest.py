import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, a long text, other kinds of white space, and columns with clashing names."""
    long = " ".join(f"word{i % 977} Path{i}." for i in range(30_000)) + "\n"
    line = "this very line has more than fifty words " + " ".join(f"token{i}" for i in range(55)) + "."
    texts = [None, "", " \t\n", "one", "one two three", long, long + "tail words here", line, f"first.\n{line}\nlast one.", f"first.\n{line}\nlast one.", "\x0bsplit\x0cby\rodd space kinds", "日本語 テキスト 😀 mixed"]
    rows = [(i, t, "en", "s", 1, "x", 1, 1) for i, t in enumerate(texts)] + [(None, "null id text here", None, None, None, None, None, None), (3, "one", "en", "s", 1, "x", 1, 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n bigint, rep bigint"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
