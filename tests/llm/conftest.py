import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return.
CLASHING = "score double, size long, fp long, component string, pattern string, label int, part int, words int, target int, weight int, sid int, `__mix` int, `__mark` int, id int, mark int, `no` int, row int"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from ``(doc_id, text[, source])``, with extra columns of clashing names."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 0.5, 1, 2, "c", "p", 1, 3, *range(10))
            for r in rows
        ]
        return spark.createDataFrame(full, f"{COLUMNS}, {CLASHING}").repartition(3)

    return make


LONG = " ".join(f"word{i % 977}" for i in range(60_000))

EDGE_ROWS = [
    (1, "The cat sat on the mat and looked at the moon."),
    (2, "the cat sat on the mat and looked at the MOON."),
    (2, "the cat sat on the mat and looked at the MOON."),
    (3, "", None),
    (4, None, None),
    (None, "A text without an id, mail me at someone@mail.example.com now"),
    (None, None, None),
    (5, " \n\t ", "s"),
    (6, LONG, "t"),
    (7, "one", "t"),
    (8, "Ünï¢ödé 𝒳 text with call +1 (555) 123-4567 and 10.0.0.1 in it", "é"),
    (9, LONG, "퟿"),
]


@pytest.fixture(scope="session")
def edge(documents):
    return documents(EDGE_ROWS).cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([(0, "x")]).where("doc_id < 0")
