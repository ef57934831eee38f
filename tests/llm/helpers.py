"""Small tables and plain re-statements that the tests hold the operators against."""

import re

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def docs(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]]). extra: more columns, named like the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOC)
    if extra:
        from pyspark.sql import functions as F

        for c in ("score", "size", "label", "part", "start", "host", "kept", "n", "word", "token", "line", "shard", "block", "target", "taken", "component_id", "salt", "ids", "toxic", "key"):
            df = df.withColumn(c, F.lit("clash"))
    return df
