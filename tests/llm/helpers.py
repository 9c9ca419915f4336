"""Small tables and plain reference computations for the corpus operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Names that operators use inside; as extra columns they must not disturb.
CLASHING = "key long, fp long, row string, place int, kept long, id long, _spans string, wanted string, size long, copies int, bucket long, score double, segments string"


def awkward_docs(spark, extra=False):
    """Nulls in every column, empty and blank texts, repeated rows and ids, a very long text."""
    long_text = prose(random.Random(3), 30_000)
    rows = [
        (1, "one two three four five six seven eight", "en", "b", 39),
        (1, "one two three four five six seven eight", "en", "b", 39),
        (1, "another text under the same id", None, "b", None),
        (None, "no id at all for this text", "en", None, 26),
        (None, None, None, None, None),
        (2, None, "en", "a", 0),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "en", "a", 4),
        (5, long_text, "en", "c", len(long_text)),
        (6, "ünïcode Ünïcode — “quotes” 漢字 漢字 漢字", "de", "ä", 40),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        for column in CLASHING.split(", "):
            name, kind = column.split(" ")
            docs = docs.selectExpr("*", f"cast(null as {kind}) as `{name}`")
    return docs


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


WORDS = [a + b for a in ("ba", "do", "ke", "li", "mu", "na", "po", "ra", "su", "te") for b in ("ran", "ver", "mist", "lo", "kan", "del", "ro", "sta", "ning", "p")]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def rows(df):
    return [tuple(r) for r in df.collect()]
