"""Small frames for the tests of this folder."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, **extra):
    """Documents from (doc_id, text[, source[, lang]]); ``extra``: more columns with one value each."""
    full = []
    for r in rows:
        i, text, source, lang = (*r, *(None,) * (4 - len(r)))
        full.append((i, text, lang, source, len(text) if text is not None else None))
    return wider(spark.createDataFrame(full, DOCS), **extra)


def wider(df, **extra):
    """``df`` with more columns, whose names may differ from others by case alone."""
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


def rows(df):
    return [r.asDict() for r in df.collect()]
