"""Small tables with the cases that every operator must handle."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # Names that the operators use themselves.
    + [T.StructField(c, T.StringType()) for c in ("key", "digest", "kept", "row", "class", "start", "toxic")]
)
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def texts() -> list[tuple[int | None, str | None]]:
    import random

    r = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiouéü" for c in "rstvz"]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    base = prose(200)
    near = base.split()
    near[100] = "changed"
    rows = [(i, prose(r.randint(1, 120))) for i in range(20)]
    rows += [(20, base), (21, base), (22, " ".join(near)), (23, base.replace(" ", "\n\t "))]
    rows += [(24, f"{prose(30)} {PASSAGE} {prose(9)}"), (25, f"{prose(5)}\n{PASSAGE}"), (26, f"{PASSAGE} {PASSAGE}")]
    rows += [(27, ""), (28, None), (29, " \n "), (30, "one"), (31, "two words"), (32, "ab" * 400), (33, "a" * 1000)]
    rows += [(34, prose(30_000)), (35, "All rights\nreserved. CC-BY 4.0"), (36, "naïve Straße <|endoftext|> 日本語 😀 \x01")]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None, *["x"] * 7) for i, t in rows], DOCS)


def odd(spark):
    """Null and repeated ids, and repeated rows."""
    return table(spark, [(None, "alpha beta"), (None, None), (1, "alpha beta"), (1, "alpha beta"), (1, "gamma"), (2, PASSAGE), (2, PASSAGE)])


def empty(spark):
    return table(spark, [])
