"""Small tables with everything that may go wrong in them, shared by the tests."""

import random

WORDS = "the of and to in that is for it with as was on be at by this had not are but from or have an they which one you were".split()


def prose(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 400)) for _ in range(n))


def odd_documents(spark):
    """Missing cells, empty and long texts, repeated rows and keys, columns with the operators' own names."""
    long = prose(30000, 1)
    passage = prose(70, 2)
    rows = [
        (1, None, "en", "a", "x"),
        (2, "", "en", "a", "x"),
        (3, " \n\t ", None, None, "x"),
        (4, long, "en", "a", None),
        (5, long, "en", "a", None),
        (5, long, "en", "a", None),
        (None, long, None, "b", "y"),
        (None, None, None, None, None),
        (6, prose(90, 3) + " " + passage + " " + prose(20, 4), "de", "b", "z"),
        (7, prose(50, 5) + "\n" + passage, "de", "b", "z"),
        (8, "one two", "fr", "ß", "q"),
        (9, "one TWO", "fr", "ß", "q"),
        (10, "a b c " * 400, "fr", "ß", "q"),
    ]
    schema = "doc_id long, text string, lang string, source string, size string"
    names = ["key", "id", "token", "n", "ids", "n_tokens", "kept", "broken", "taken", "target", "_key", "spans", "component_id", "_row"]
    df = spark.createDataFrame(rows, schema)
    for name in names:
        df = df.selectExpr("*", f"size AS `{name}`")
    return df
