"""Rows that every operator on documents must take."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside for columns of their own.
CLASHING = "row string, fp long, digest string, content string, at_file string, bits string, n_tokens string, ids int, left string, held_out string, score string, root int, leaf int, kept int"
LONG = "lorem ipsum dolor " * 60_000
ODD = [
    (1, "One small text. Nothing else."),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\f\r "),
    (5, "One small text. Nothing else."),
    (5, "One small text. Nothing else."),
    (6, "One  small text.\nNothing else."),
    (None, "One small text. Nothing else."),
    (None, None),
    (7, LONG),
    (8, LONG),
    (9, "²½ 12 --"),
    (10, "\U0001f600 é́ İ 漢字 'S don't x y"),
    (11, "x" * 100_000),
]


def odd_documents(spark):
    """Odd rows with nulls in every other column and clashing names."""
    rows = [(i, t, None, None, None) for i, t in ODD]
    return with_clashing(spark.createDataFrame(rows, DOCUMENTS))


def no_documents(spark):
    return with_clashing(spark.createDataFrame([], DOCUMENTS))


def with_clashing(df):
    for field in CLASHING.split(", "):
        name, kind = field.split(" ")
        df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS `{name}`")
    return df
