import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, token string, print string, toxic string, word string, n string, phrase string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names clash with those the operators use inside."""

    def make(rows):
        full = [(i, text, lang, source, len(text or ""), *["x"] * 8) for i, text, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


@pytest.fixture(scope="session")
def corpus():
    """Invented prose in three languages, with null, empty, very short and long texts and repeated rows."""
    rng = random.Random(3)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(60)] for lang, letters in LETTERS.items()}
    rows = []
    for i in range(120):
        lang = list(LETTERS)[i % 3]
        text = " ".join(rng.choices(words[lang], k=rng.randint(5, 120)))
        rows.append((i, text.capitalize() + ".", lang, f"s{i % 4}" if i % 10 else None))
    rows += [(200, None, None, None), (201, "", "aa", "s0"), (202, "  \t\n", "bb", "s1"), (203, "12 34!", None, "s2"),
             (204, "ab", "aa", "s3"), (205, " ".join(words["aa"] * 400), "aa", "s0"), rows[5], rows[5]]
    return rows
