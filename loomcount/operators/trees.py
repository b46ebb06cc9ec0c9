"""Bracketed derivations as nested intervals (S30, S37): nodes, yields and the alignment of a binary-branching or wider ITG derivation.

A derivation such as `(S (<> a b) (A c))` has a label after each opening bracket, then words and nodes. A node labelled `<>` gives its children in reverse order on
the target side, all others keep it. A derivation is a sentence or document and fits a task: tasks take theirs as they come, some megabytes at a time, and pair all brackets
at once by sums and sorts in arrays, so nothing is shuffled. Null and empty strings give no rows; a derivation with brackets that don't match, or without a label after
one, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcount.sources.tables import spread

INVERTED = "<>"
#: Characters of texts that are read at once, 30 bytes of arrays and more for each.
TOGETHER = 1 << 21
#: Words in the yields of nodes that are given at once.
YIELDED = 1 << 20


class _Read:
    """Tokens of some derivations side by side. doc and pos of each token, lo: words before it in its derivation, toks: the tokens (Arrow); is_word, opens, closes: which are what,
    labels are nothing of it. Of nodes, by level: enter and leave (their brackets' places in the arrays) and level (1: a root)."""

    def __init__(self, texts: list[str | None]):
        import re
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = [re.findall(r"[()]|[^\s()]+", x or "", re.ASCII) for x in texts]
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        self.toks = pa.array(chain.from_iterable(found), pa.string(), size=int(sizes.sum()))
        del found
        ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.pos = np.arange(len(self.toks)) - np.repeat(ends - sizes, sizes)
        is_ = lambda sign: pc.equal(self.toks, sign).to_numpy(zero_copy_only=False)
        self.opens, self.closes = is_("("), is_(")")
        label = np.zeros(len(self.toks), dtype=bool)
        label[1:] = self.opens[:-1]
        depth = np.cumsum(self.opens.astype(np.int64) - self.closes)
        if (label & (self.opens | self.closes)).any() or (depth < 0).any() or depth[ends[sizes > 0] - 1].any():
            raise ValueError("brackets of a derivation don't match")
        self.is_word = ~(self.opens | self.closes | label)
        self.depth = depth
        so_far = np.concatenate([[0], np.cumsum(self.is_word)])
        self.lo = so_far[:-1] - so_far[np.repeat(ends - sizes, sizes)]
        # a level's brackets stand in turn, so its n-th closing one belongs to its n-th opening one
        by_level = lambda at, level: at[np.argsort(level, kind="stable")]
        at_open, at_close = np.flatnonzero(self.opens), np.flatnonzero(self.closes)
        self.enter, self.leave = by_level(at_open, depth[at_open]), by_level(at_close, depth[at_close] + 1)
        self.level = depth[self.enter]
        self.label = self.toks.take(pa.array(self.enter + 1))

    def node_of(self, at, level):
        """The node of a level in which each place lies, -1 for level 0: the last one of that level that begins before it."""
        import numpy as np

        n = len(self.toks) + 1
        return np.searchsorted(self.level * n + self.enter, level * n + at) - 1


def _read(rows: DataFrame, key: str, text: str, out: list[T.StructField], of) -> DataFrame:
    """key, and what `of(_Read)` yields for some derivations: (the derivation of each row, a list of Arrow columns)."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            sizes = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
            at = 0
            while at < len(sizes):
                end, chars = at + 1, sizes[at]
                while end < len(sizes) and chars + sizes[end] <= TOGETHER:
                    chars, end = chars + sizes[end], end + 1
                part = b.slice(at, end - at)
                for doc, columns in of(_Read(part.column(1).to_pylist())):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *columns], names=[key, *[f.name for f in out]])
                at = end

    t = rows.select(key, text)
    return spread(t).mapInArrow(run, T.StructType([t.schema[key], *out]))


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, enter, leave, level (1: the root), label, lo, hi, words: a node's interval of tokens, and of words from lo up to but without hi, with the words of its yield."""

    def of(r: _Read):
        import numpy as np
        import pyarrow as pa

        words = r.toks.filter(pa.array(r.is_word))
        before = np.concatenate([[0], np.cumsum(r.is_word)])  # words before a place, of all derivations
        lo, hi, first = r.lo[r.enter], r.lo[r.leave], before[r.enter]
        said = np.concatenate([[0], np.cumsum(hi - lo)])
        at = 0
        while at < len(lo):
            end = max(at + 1, int(np.searchsorted(said, said[at] + YIELDED, side="right")) - 1)
            n = slice(at, end)
            offsets = said[at : end + 1] - said[at]
            place = np.arange(offsets[-1]) + np.repeat(first[n] - offsets[:-1], (hi - lo)[n])
            yields = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(place)))
            ints = lambda x, kind: pa.array(x, kind)
            yield r.doc[r.enter[n]], [ints(r.pos[r.enter[n]], pa.int32()), ints(r.pos[r.leave[n]], pa.int32()), ints(r.level[n], pa.int64()), r.label.slice(at, end - at), ints(lo[n], pa.int64()), ints(hi[n], pa.int64()), yields]
            at = end

    out = [_field("enter", T.IntegerType()), _field("leave", T.IntegerType()), _field("level", T.LongType()), _field("label", T.StringType()), _field("lo", T.LongType()), _field("hi", T.LongType()), _field("words", T.ArrayType(T.StringType()))]
    return _read(rows, key, text, out, of)


def below(all_nodes: DataFrame, tops: DataFrame, key: str) -> DataFrame:
    """top, and the nodes at or below each of the nodes `tops` (key, enter, leave): their intervals lie in it."""
    top = tops.select(key, F.col("enter").alias("top"), F.col("leave").alias("_end"))
    return all_nodes.join(top, key).filter((F.col("enter") >= F.col("top")) & (F.col("leave") <= F.col("_end"))).drop("_end")


def alignment(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, i, j, word: the i-th word of the source side stands at place j of the target side (both from 0).

    A child's words come after those of the siblings that the node puts before it: the ones to its left, or in an inverted node to its right. A word's place is the
    sum of that over the word and the nodes above it, so a sum over the tokens up to it of what is added where a node begins and taken off where it ends."""

    def of(r: _Read):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lo, hi = r.lo[r.enter], r.lo[r.leave]
        inverted = pc.equal(r.label, INVERTED).to_numpy(zero_copy_only=False)

        def shift(at, level, first, end):
            """Words that the node of a level puts before its child at a place, which has words from first up to but without end."""
            up = r.node_of(at, level)
            if not len(lo):
                return np.zeros(len(at), dtype=np.int64)
            return np.where(up < 0, 0, np.where(inverted[up], hi[up] - end, first - lo[up]))

        at = np.flatnonzero(r.is_word)
        add = np.zeros(len(r.toks), dtype=np.int64)
        add[r.enter] = shift(r.enter, r.level - 1, lo, hi)
        add[r.leave] = -add[r.enter]
        i = r.lo[at]
        j = np.cumsum(add)[at] + shift(at, r.depth[at], i, i + 1)
        yield r.doc[at], [pa.array(i), pa.array(j), r.toks.take(pa.array(at))]

    return _read(rows, key, text, [_field("i", T.LongType()), _field("j", T.LongType()), _field("word", T.StringType())], of)
