"""Hard cases that every operator must take, as a table with clashing extra columns."""

from pyspark.sql import functions as F

LONG = "word another1 third. " * 9000
HARD = [
    (1, "The thing and the other thing were there, and the man was in the house.", "en"),
    (1, "The thing and the other thing were there, and the man was in the house.", "en"),
    (2, None, "en"),
    (3, "", "de"),
    (4, "  \n\t ", None),
    (5, "123 456 !!", "en"),
    (6, "x" * 70_000, "en"),
    (7, LONG, None),
    (None, "Der Mann und die Frau gehen in das Haus und der Hund ist nicht da.", "de"),
    (8, "Der Mann und die Frau gehen in das Haus und der Hund ist nicht da.", "de"),
    (9, "日本語のテキスト <|endoftext|> é \U0001f600 \x00 \x85 ​", None),
]
CLASHES = ["ids", "fp", "n", "k", "root", "lang_pred", "score", "spans", "place", "shard", "block", "digest", "copies", "train", "vector", "count"]


def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id long, text string, lang string")
    return df.withColumns({"source": F.lit("s"), "n_chars": F.char_length("text").cast("bigint"), **{c: F.lit("clash") for c in CLASHES}})


def empty(spark):
    return hard(spark).filter("false")
