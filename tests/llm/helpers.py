"""Small tables of documents with all kinds of edge cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NASTY = [None, "", " ", "\n\n", "a", "one two", "tab\tand\x0bvt\x0cff\r\n", "ß É ñ 漢字 😀", "x" * 3000, "  double   spaces  ", "a\n b \n\n c", "<|endoftext|> text"]


def documents(n=60, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    base, passage = text(60), text(45)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split()
            w[rng.randrange(60)] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = f"{text(20)} {passage} {text(15)}"
        else:
            t = text(rng.randint(1, 90))
        rows.append([i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)])
    rows += [[n + i, t, None, None, None] for i, t in enumerate(NASTY)]
    rows.append([n + len(NASTY), " ".join(rng.choices(vocab, k=6000)), "en", "s1", 0])
    return [tuple(r) for r in rows]


def frame(spark, rows, extra=True):
    """With extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("size", "node", "comp", "doc", "of", "rest", "bucket", "kept", "id", "v", "row", "key", "component_id")}) if extra else df


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
