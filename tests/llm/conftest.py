import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    from memlake.llm.queries import tokenizer_path

    return tokenizer_path()


#: doc_id, text: nulls, empty and odd texts, ties, repeated rows.
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (3, "Alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "short one"),
    (8, "short one"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"),
    (9, "x " * 3000 + "Ünïcödé, it's <|endoftext|> <b>Bold</b>... don't stop\x1c12345 " * 50),
    (10, "q" * 700 + " " + "word, " * 40),
    (11, "naïve café ﬀ Å 日本語 🙂 é   end"),
    (12, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu and then other words follow here"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with extra columns whose names the operators use inside."""
    rows = [(d, t, "en", "s", len(t or ""), i, "bytes") for i, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, payload string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, n int, payload string")
