"""Small tables with everything that may go wrong in a column."""

import random

#: Columns a table may happen to have, named as operators name theirs inside.
CLASHING = ["row", "tile", "node", "hash", "tie", "n", "key", "bucket", "last", "toxic", "size", "spans", "blocks", "source_key", "tokens", "__row_number", "row_number", "__tokens", "__source", "__block", "__key", "doc", "block", "rule", "part", "sign"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, clashing=True):
    """A documents table of (doc_id, text, lang, source) rows, with columns of clashing names."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df


def empty(spark):
    return docs(spark, [])


def sentence(rng: random.Random, words: int) -> str:
    stems = ["ka", "lo", "mi", "tu", "ren", "so", "vi", "dar", "ne", "pol"]
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(words))


def edge_rows(seed=5):
    """Nulls, empty and blank texts, repeats of texts and of rows, near copies, a very long text."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    long = sentence(rng, 6_000)
    texts = [base, near, base, base.upper(), None, "", "  \n\t ", "one two", "one two", long, "Ünïcode " + sentence(rng, 40), "12 34 -- !!", "x" * 900]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "a", None][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[0], (None, base, "en", "a"), (None, None, None, None), (40, sentence(rng, 30), "fr", "c")]
    return rows
