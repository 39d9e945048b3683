"""Rows that every operator must stand."""

from __future__ import annotations

from pyspark.sql import types as T

#: Texts that any operator must stand: null, empty, blank, one word, ties, repeats, long, odd white space, special strings.
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "a"), (4, "word", "en", None),
    (5, "The cat of the house and the dog of the yard went to town with a friend. " * 3, "en", "a"),
    (5, "The cat of the house and the dog of the yard went to town with a friend. " * 3, "en", "a"),
    (14, "El perro de la casa y el gato del patio fueron a la ciudad con un amigo. " * 3, "es", "b"),
    (7, "x" * 5000, "en", "b"), (8, "lorem ipsum dolor sit amet " * 4000, None, None), (None, "a row without an id is still a row", "en", "a"),
    (9, "tab\tnew\nline\x0bvt  two  spaces  nb İstanbul 文字 \U0001f600 é", "en", "a"),
    (10, "<|endoftext|>inside<|startoftext|> WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "en", "a"),
    (11, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" and card 4111111111111111', "en", "a"),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
])
#: Columns that operators use inside; they must neither clash nor get lost.
CLASH = ["row", "no", "fp", "id", "kept", "n_words", "cell", "part", "hits", "k0", "batch", "_text"]
