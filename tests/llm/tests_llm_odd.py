"""Rows with nulls in any column, empty and long texts, ties, repeats, and columns with names that operators use for themselves."""

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h string, label string, node string, score string, copies string, item_id string, f0 string, `a.b` string"
ODD_COLUMNS = "doc_id text lang source n_chars key h label node score copies item_id f0 a.b".split()
LONG = "alpha beta gamma delta epsilon " * 20_000
SAME = "one text that several rows have, word for word, and nothing besides it"

ODD = [
    (1, SAME, "en", "s", 1),
    (2, SAME, "en", "s", 1),
    (2, SAME, "en", "s", 1),
    (None, SAME, None, None, None),
    (3, None, "en", "s", None),
    (4, None, None, "t", None),
    (5, "", "en", "t", 0),
    (6, "", "en", "t", 0),
    (7, " .,;\n\t", "de", "t", 6),
    (8, LONG, "en", "s", len(LONG)),
    (9, "é", "fr", None, 1),
    (None, None, None, None, None),
]
