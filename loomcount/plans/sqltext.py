"""Fragments of DuckDB SQL that several queries share."""

from loomcount.functions.text import PUNCTUATION

_SIGNS = PUNCTUATION.replace("'", "''")


def tok(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({text}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: trim(x, '{_SIGNS}')), lambda x: x <> '')"


TOKENS = f"w AS (SELECT doc_id, lang, source, {tok('text')} AS w FROM documents)"
PADDED = "list_concat(['<s>'], w, ['</s>'])"


def grams(words: str, order: int) -> str:
    """Space-joined n-grams of a list, as a list."""
    return f"list_transform(range(1, greatest(len({words}) - {order} + 2, 1)), lambda i: array_to_string(({words})[i:i + {order - 1}], ' '))"
