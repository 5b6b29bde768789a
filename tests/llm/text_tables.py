"""Small tables of texts for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


BASE = " ".join(f"word{k} tail{k % 7}" for k in range(60))
ROWS = [
    (0, BASE, "b"), (1, BASE, "a"), (2, BASE + " end", None), (3, BASE.replace("word30", "other"), "a"), (4, None, "a"), (5, "", "c"), (6, " \t\n ", "a"), (7, "one", "b"), (8, "One", "b"), (9, "two words", "a"),
    (10, "x" * 30000, "a"), (11, "long " * 9000, "d"), (12, "a\x85b c d e f é日本 g h i j k l m n o p", "a"), (12, "the same id twice, another text", "b"), (13, "repeated row here", "a"), (13, "repeated row here", "a"),
    (None, "a row without an id " + BASE, "a"), (14, "mail me.now@x.example.com or +1 (234) 567-8901, 10.0.0.255 and 4111 1111 1111 1111", "c"), (15, 'token = "8f3a1b2c4d5e6f708192a3b4c5d6e7f8091a2b3c" here', "c"), (16, "Released under the MIT License.", "c"),
]
