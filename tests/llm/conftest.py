import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, token long, _removed int, _skey string, size long, dh long"


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, one word, ties, copies, repeated rows, odd characters, a very long text."""
    base = " ".join(f"word{k}" for k in range(60))
    near = base.replace("word30", "other")
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, base), (6, base), (7, near), (7, near), (8, base + "\n" + base + "\nshort\n" + near), (9, "a\x00b ퟿ é ́ x 日本語 テスト 😀 word"),
        (10, long), (11, "x" * 300_000), (12, "one two three four"), (13, "ONE two three FOUR"), (None, "no id here at all today"), (14, base.upper()), (15, "9" * 50_000),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if (i or 0) % 3 == 0 else "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 2}", len(t) if t else None, "c", 1, 2, "k", 3, 4) for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 16)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
