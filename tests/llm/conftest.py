import random

import pytest

LONG = " ".join(f"word{k % 977}" for k in range(60_000))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5),
        (2, None, "en", "a", 0), (3, "", None, None, None), (None, "alpha beta gamma delta epsilon zeta", "en", "a", 5),
        (None, None, None, None, None), (4, LONG, "de", "b", 1), (5, " \t\n\x0b ", "de", "b", 1), (6, "Ünïcode ½ 漢字 emoji 🙂 words here", "fr", None, 2),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(spark, edge_docs):
    """The same with extra columns that have the operators' own names."""
    from pyspark.sql import functions as F

    names = "fp root low component_id votes s n_words posterior kept row_key score salt gone high first tie key tokens ids size row_hash copies target source_size digest keep group_size".split()
    return edge_docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def prose():
    """Random prose with groups of copies and near copies."""
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su", "ta", "vo", "ne") for b in ("ra", "ti", "no", "ple", "gon", "zu")]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 200))) for _ in range(120)]
    for k in range(40):
        base = texts[k].split()
        for _ in range(k % 3):
            base[rnd.randrange(len(base))] = rnd.choice(words)
        texts.append(" ".join(base))
    return texts
