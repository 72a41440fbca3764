"""Small tables that hold what is awkward: nulls, empty and long texts, ties, repeats, and columns whose names clash."""

LONG = "the whole passage repeats itself until it is long enough to matter to everyone who reads it, word for word and line for line. "
TEXTS = [
    None, "", " \n\t\n ", "one", "One two three four", LONG * 3, LONG * 3, "x" + LONG * 3, LONG.upper(), "All rights reserved. Licensed under CC BY-NC 4.0.\n\nAll rights reserved.",
    "short line\nshort line\nanother line here\nShort  line", "äöü ß Σας \x00 日本語 🙂 é", LONG * 400, "a" * 5000, "<|endoftext|> it's 123", "pf. " * 300, "x@" + "a." * 20000 + "1",
    LONG + "and then something else follows that is different", "before it " + LONG,
]
SCHEMA = "doc_id long, text string, id string, tag string, n_words string, spans string, key string, part string, node string, score string"


def documents(spark, texts=TEXTS, ids=None):
    """With an extra row of a null id, and the last row twice."""
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts)]
    rows += [(None, "a text without an id")] + rows[-1:] if texts else []
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], SCHEMA), rows
