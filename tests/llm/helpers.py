"""Small tables for the tests: the cases that every operator must stand."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0, sources=None):
    rows = [
        (start + i, t, "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOC)


def edge_cases():
    """Null, empty, blank, tiny, repeated and long texts, odd characters."""
    long = " ".join(f"word{i * 7919 % 1013}" for i in range(4000))
    base = " ".join(f"token{i}" for i in range(80))
    return [
        None,
        "",
        "   \n\t ",
        "a",
        base,
        base,
        base + " tail words here",
        "éè 你好 \U0001f600 café x\x1cy z",
        long,
        "x" * 3000,
        "be " * 400,
        "<|endoftext|> hi  <|endoftext|>\n\n there's  ",
    ]


def clashing(df):
    """The same rows with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("spans", "runs", "windows", "anchor", "digest", "label", "toxic", "payload", "size", "lo", "bucket", "start", "hash", "n", "key", "place", "first", "guest", "class_id", "score", "n_words"):
        df = df.withColumn(name, F.lit(name))
    return df
