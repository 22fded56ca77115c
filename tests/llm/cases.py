"""Awkward rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

CLASHING = ["shard", "size", "key", "sig", "band", "block", "words", "text_key", "n", "line", "form", "template", "label", "stated", "bucket", "length", "digest", "copy", "component", "n_chars"]
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward_rows():
    base = prose(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    rows = [
        (1, base), (2, None), (3, ""), (4, " \n\t\x0b "), (5, "one"), (6, "one two"), (7, base), (7, base), (8, near),
        (9, prose(2, 30_000)), (10, "Ünïcode ß ǅ <|im_start|> \\| <\\| 漢字 nbsp"), (11, "UPPER case " + base), (12, prose(3, 200)),
        (13, "x" * 20_000), (14, prose(3, 100) + " " + base), (None, base), (None, None), (15, "\n\n"), (16, "a\nb\na\nb"),
    ]
    return rows


def documents(spark, rows=None, extra=True):
    rows = awkward_rows() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHING:
            df = df.withColumn(name, F.lit(None).cast("bigint"))
    return df

