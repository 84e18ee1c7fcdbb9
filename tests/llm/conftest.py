import random

import pytest

WORDS = "river stone cloud meadow lantern harbor velvet thunder orchard copper saddle winter compass feather marble signal garden whisper falcon timber".split()


@pytest.fixture
def prose():
    """A maker of texts: the same seed gives the same text."""

    def make(seed, n=60, line=12):
        draw = random.Random(seed)
        words = [draw.choice(WORDS) + str(draw.randrange(40)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))

    return make


@pytest.fixture
def documents(spark, tmp_path):
    """Write rows (doc_id, text, lang, source) as documents.parquet; extra columns
    have names that the operators use inside."""

    def write(rows, folder="sf"):
        schema = "doc_id long, text string, lang string, source string"
        df = spark.createDataFrame([(*r, *(None,) * (4 - len(r))) for r in rows], schema)
        df = df.selectExpr("*", "cast(length(text) AS long) AS n_chars", "1 AS raw", "2 AS n", "'x' AS fp", "3L AS size", "'y' AS grp", "4 AS score")
        df.write.mode("overwrite").parquet(f"{tmp_path}/{folder}/documents.parquet")
        return f"{tmp_path}/{folder}"

    return write
