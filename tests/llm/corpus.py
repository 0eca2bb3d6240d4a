"""A small corpus with every odd case, and tables of the driver's shapes."""

import random

WORDS = "red green blue stone river cloud paper light house garden window bridge summer winter silver copper mirror candle".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))


def rows(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared lines, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    shared = prose(rng, 30)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(n)]
    texts = []
    for i, t in enumerate(base):
        lines = t.split(" ")
        cut = rng.randint(5, len(lines) - 5)
        text = " ".join(lines[:cut]) + "\n" + " ".join(lines[cut:])
        if i % 7 == 0:
            text += "\n  " + shared.upper() + "\t"
        if i % 9 == 0:
            text += "\n" + shared
        texts.append(text)
    texts[5] = texts[4]
    near = texts[6].split(" ")
    near[3] = "changed"
    texts[7] = " ".join(near)
    texts += [None, "", " \n\t", "x", "12345 678 !!", "one two", "one two", "é" * 300 + "\n" + "ü ö ä " * 40, prose(rng, 6000)]
    out = [(i, t, ["en", "de", "fr", None][i % 4], ["a", "b", None, "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    out.append(out[3])
    out.append((None, "no id here but some text of its own to hold", "en", "a", 40))
    out.append((None, None, None, None, None))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def odd_columns(docs):
    """Extra columns whose names meet those that operators use inside."""
    from pyspark.sql import functions as F

    names = ["id", "_id", "seq", "size", "key", "h", "h1", "h2", "c", "doc", "keys", "rep", "hub", "node", "label", "k1", "k2", "bands", "words", "slot", "length", "piece", "start", "word", "n", "lo", "hi", "spans", "kept", "grade", "lang_pred", "score", "run_start", "_bucket", "_source", "_kept_"]
    return docs.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
