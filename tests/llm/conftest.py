import pytest

#: Rows that every operator must take: null in any column, empty and very long texts, ties, repeated rows, columns
#: whose names clash with the operators' own.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, key string, kept boolean, length long, rules int, "
    "_row long, _file string, _at long, _bucket long, _bits binary, _number long, _metadata string"
)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, 1, "k", True, 7, 3, 1, "f", 2, 3, b"x", 4, "m")


@pytest.fixture(scope="session")
def odd(spark):
    long = "thing word other. " * 30_000
    prose = "The thing that was said here is plain prose, and it goes on for a while.\nAnother line follows it."
    rows = [
        row(1, prose), row(2, prose), row(2, prose), row(3, None), row(4, ""), row(5, "   \n\t "), row(6, long), row(7, "x"),
        row(None, prose), row(None, None), row(8, prose.replace(" ", "  ")), row(9, "Größe über ñandú 東京 ½", None, None), row(10, "12345 !!! 678", None),
        row(11, "password = hunter22 and AKIA" + "Q" * 16 + " and " + "ab12" * 8), row(2**62, "one two three"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (6, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf1():
    return "/root/testdata/sf0.01"
