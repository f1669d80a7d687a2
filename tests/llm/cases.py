"""Rows that every operator on documents has to stand."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def prose(seed, n=120, vocabulary=400):
    r = random.Random(seed)
    known = ["the", "of", "and", "to", "in"] * 10 + ["".join(r.choice(["an", "er", "th", "ou", "re", "st"]) for _ in range(r.randint(1, 4))) + ("" if k % 7 else "é") for k in range(vocabulary)]
    return " ".join(r.choice(known) for _ in range(n))


def rows():
    base = prose(1)
    long = "\n".join(prose(s, 400) for s in range(2, 22))
    texts = [base, base, base + " tail", base.upper(), prose(3), None, "", " \t\n ", "one", "two words", long, "a" * 5000, prose(4) + " x y 🎉", "x\r\ny\x0bz", prose(5)]
    out = [(i, t, ("en", None, "fr")[i % 3], (None, "a", "b")[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, prose(6), "en", "a", 5), (99, None, None, None, None)]


def documents(spark, given=None, extra=True):
    df = spark.createDataFrame(rows() if given is None else given, DOCS)
    clash = ("n_words", "kept", "size", "t", "w", "k0", "spans", "digest", "id", "target", "block", "copies", "mix_size", "mix_k", "order", "bucket", "whole", "chance", "row", "k", "h", "node", "rows", "copy")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in clash]) if extra else df


def folder(spark, path, given=None, labels=None, **more):
    documents(spark, given).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    if labels is not None:
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    for name, df in more.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
