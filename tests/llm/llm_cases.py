"""Small tables with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet consectetur " * 4000

ODD_TEXTS = [
    None, "", " ", "\n\t \x0b\x0c\r", "one", "one two", "One TWO one two", "a  b   c ", " lead", "trail ",
    "Ünïcödé wörds ñ ß é", "日本語 テキスト 🙂🙂", "x" * 3000, "= " * 700, "same line here\nsame line here\nsame line here",
    "<|endoftext|> <s> </s> <unk>", "don't we'll it's I'VE", "1234567890 12 3 !!! ###", "a b c", "tab\tsep\nnew\r\nline",
    "the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and again",
    "\u0000 nul \u0001", "▁under ▁▁score", LONG,
]


def documents(spark, texts=None, extra: bool = True):
    """doc_id, text, source and clashing extra columns; one doc_id repeats and one is null."""
    texts = ODD_TEXTS if texts is None else texts
    rows = [(i, t, ["b", "a", None, "é"][i % 4]) for i, t in enumerate(texts)]
    if extra:
        rows += [(0, texts[0], "b"), (None, "no id at all here", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if not extra:
        return df
    clashes = ["score", "n_words", "place", "size", "fp", "tie", "bucket", "y", "key", "_text", "_rank", "_id", "train", "fingerprint", "kept"]
    return df.selectExpr("*", *(f"'x' AS {c}" for c in clashes))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df) -> dict:
    return {r.doc_id: r for r in df.collect()}
