"""Rows that every operator has to take: nulls, empty and very long texts, repeats, clashing columns."""

COPY = "The same text, met many times over.\nA line of more than twenty characters.\n"
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa."),
    (3, None),
    (4, ""),
    (5, " \n\t \x0b"),
    (6, "word and another " * 9_000),
    (7, "x" * 70_000),
    (8, "Straße été 中文 👍🏽 <|endoftext|> don't we'll\r\n\x85 end\x1c of it"),
    (9, "a repeated row"),
    (9, "a repeated row"),
    (10, "one id, first text\nA line of more than twenty characters."),
    (10, "one id, second text"),
    (None, "no id at all"),
    (None, COPY),
    (12, "\n\n\n"),
    (13, "12 34 !! ?? 56"),
    *[(100 + i, COPY) for i in range(60)],
    *[(200 + i, f"Document {i} says\n  A LINE of more than twenty characters. \nand ends {i * i}") for i in range(8)],
]
CLASHING = "norm string, key string, row string, tag long, h1 long, place long, fp long, mask long, splitters string"


def frame(spark, rows=ODD, clashing=True):
    """The rows as documents, with columns besides whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en" if t else None, None, len(t or "")) for i, t in rows]
    if clashing:
        schema += ", " + CLASHING
        full = [r + (None, "k", "r", 1, 2, 3, 4, 5, "s") for r in full]
    return spark.createDataFrame(full, schema).repartition(3)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
