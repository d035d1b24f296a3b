"""Small document tables with awkward rows."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, part long, key string"


def docs(spark, texts, **columns):
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["a"] * len(texts))[i], None if t is None else len(t), "x", 1, None))
    return spark.createDataFrame(rows, DOCS)
