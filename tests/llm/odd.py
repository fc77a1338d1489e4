"""Small tables with the odd cases that every operator has to stand."""

from pyspark.sql import SparkSession

LONG = "the quick brown fox jumps over the lazy dog " * 4000
TEXTS = [None, "", " ", "word", "same text here, twice", "same text here, twice", "Ünïcode ıs  fine\t😀 ok\n", LONG, "idiot", "a.b@c.d 1.2.3.4 +1 (234) 567-8901", "x" * 5000]


def docs(spark: SparkSession, texts=None, **extra):
    """doc_id, text and columns whose names the operators use inside; one null id, one repeated row."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t, "en", "s", 1, 5, "c", 7) for i, t in enumerate(texts)]
    if texts is TEXTS:
        rows += [(None, "no id at all", "en", "s", 1, 5, "c", 7), rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, task string, shard int")


def empty(spark: SparkSession):
    return docs(spark, [])
