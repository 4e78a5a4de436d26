"""Small tables with nulls, ties, repeats, odd text and extra columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{k} and, some 'more' text é{k % 7}" for k in range(30_000))
TEXTS = [
    "The cat sat on the mat and looked at the moon over the old mill.", None, "", "   \n\t ", "one two three", "one two three",
    "Hello, it's 'start O'NEIL x H̱ J̌ é ̸= a<|endoftext|>b <|ENDOFTEXT|> T̈!", "日本語 テキスト 123abc ÀÉÎ straße",
    "\x00 nul \x1c fs \x0b vt   nbsp em", "a" * 20_000, LONG, "the the the the the the the the the the the the",
    "The cat sat on the mat and looked at the moon over the old mill.", "x", "don't!!!a'll,'S", "🙂 emoji 🙂🙂 \U0001F468‍\U0001F469",
]


def documents(spark, texts=None, extra=True):
    texts = TEXTS if texts is None else texts
    df = spark.createDataFrame([(k * 3, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    if extra:  # columns whose names clash with the operators' own
        for name in ("ids", "start", "word", "block", "n", "score", "source", "lang"):
            df = df.withColumn(name, F.lit("x"))
    return df


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
