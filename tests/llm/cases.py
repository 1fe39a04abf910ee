"""Small tables with everything that may be odd."""

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor " * 20000
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the quiet river bank at dusk and count falling leaves one by one"
#: Names that operators use inside, as columns of the documents.
CLASHING = ["kept", "uid", "node", "size", "position", "h", "score", "spans", "media", "sequence_id", "key", "label"]

ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE + "  \n", "en", "a"),
    (3, PROSE.replace("seven", "eight"), "en", None),
    (4, None, None, "b"),
    (5, "", "de", "b"),
    (5, "", "de", "b"),
    (None, "no id here", "en", "c"),
    (7, LONG, "en", "c"),
    (8, LONG + "x", "en", "c"),
    (9, "é ü 你好 \u0000 𝒳", "fr", "d"),
    (10, " \t\n\x0b\x0c\r", "fr", "d"),
    (11, PROSE, "en", "a"),
    (11, PROSE, "en", "a"),
    (12, "word", "en", "e"),
]


def docs(spark: SparkSession, rows=None) -> DataFrame:
    rows = ROWS if rows is None else rows
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], f"doc_id long, text string, lang string, source string, {extra}")


def texts(*values) -> list[tuple]:
    return [(k, t, "en", "s") for k, t in enumerate(values)]
