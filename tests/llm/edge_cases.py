"""Documents with everything that a table can hold."""
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "one two three four five six seven eight nine ten.\n" * 4000


def documents_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as results and working columns are."""
    texts = [None, "", " \n\t ", "one", "Mixed CASE Ünï 日本", LONG, "same text here", "same text here", "x" * 30_000, "a b c d e f g\n" * 9, "tail \n<|endoftext|>\n tail"]
    rows = [(k if k != 3 else None, t, None if k == 4 else "en", None if k % 4 == 1 else "s", None if k == 2 else 1) for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[0]]
    df = spark.createDataFrame([(*r, f"t{k}", 1.5, "z", 3, True) for k, r in enumerate(rows)],
                               SCHEMA + ", tag string, score double, target string, n_tokens int, kept boolean")
    return df
