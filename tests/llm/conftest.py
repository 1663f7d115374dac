import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, __text string, size long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) rows with columns that clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 2}", 0, 7, "x", 9) for i, t in rows], SCHEMA).repartition(3)

    return build


def words(k, n, step=1):
    return " ".join(f"w{(k + j * step) % 997}" for j in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, repeated lines, a stutter, short, long, empty and null texts, repeated rows."""
    a, b = words(1, 80), words(300, 120, 7)
    return [
        (5, a), (2, a), (9, a + " more"), (1, b), (3, "x " + b[50:400] + " y"), (4, b[:300] + " " + b[:300]), (6, ""), (7, None), (8, " \n\t "), (10, "one"),
        (11, "Ünï " * 60), (12, "a" * 400), (13, words(500, 3000, 11)), (13, words(500, 3000, 11)), (14, "### $$$ *** " * 40), (15, words(1, 40) + " é " + words(41, 39)), (None, a[:200]), (16, "line one\n" * 30),
    ]
