import random

import pytest

WORDS = [a + b for a in "ka lo mi ne ru ta vi so pe du".split() for b in "r n s l t m".split()]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs_rows():
    """Prose, copies, near copies, shared passages, short, empty, null and very long texts, repeated rows."""
    r = random.Random(5)
    texts = [prose(r, r.randint(30, 200)) for _ in range(30)]
    near = texts[0].split()
    near[3], near[-2] = "changed", "altered"
    passage = prose(r, 70)
    texts += [texts[0], texts[0], " ".join(near), "", None, "one", "one two", "   \n ", prose(r, 6000)]
    texts += [prose(r, 40) + " " + passage + " " + prose(r, 20), passage + ". " + prose(r, 60), "same " * 200]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, "text without an id " + passage, None, None, None), rows[5], rows[5]]


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def extra(df):
    """The table with more columns, whose names operators use inside."""
    from pyspark.sql import functions as F

    for c in ("n", "score", "part", "block", "leaders", "at", "live", "keep", "shard", "host", "n_tokens", "c0", "i", "a", "b"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def rows(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))
