"""N-gram Jaccard join with set-relation skipping.

A document's set are the hashes (64 bits) of its distinct SIZE-word shingles. Two sets link when 100 * |A and B| >= 80 * |A or B|. Documents
with equal sets are one node. Nodes are indexed by the prefix of their set: with the rarest shingles first, two linked sets of sizes n and m
need o = ceil(4 (n + m) / 9) shingles in common, so their first common one stands at most at n - o in one and m - o in the other. Rareness
comes from a table of 2^SKETCH_BITS counts over all documents; it orders the shingles and decides nothing else.

Index lists hold (node, set size, position), a hot one in salted parts, and are skipped by position and by relation:

1. A row that is too far back to reach the overlap with any size near its own in its list goes; so do lists of a single row.
2. In each class of sizes of a list the row with the smallest position leads: the fewer rare shingles of its own a set has, the nearer it is to
   what its copies have in common. Rows point to the leaders of their class and the neighbouring ones in another component; each set is compared with
   the LEADERS leaders that it meets most often, and links join components. A set takes over the answer of the leader that it links
   with: what lies in one component is compared no more. This is done ROUNDS times, with the components of the time before.
3. What remains is derived from leaders. Each comparison with a leader leaves the difference of the two sets (shingles missing and added). A set takes the leader
   that most sets were compared with as its root, roots that meet in lists are compared with the most frequent of them (JOINS times), differences to a leader that has a root of its own are composed
   (the symmetric difference of two differences), and the difference of two sets of one root is that of their differences: a and b link when 9 |D(a) xor D(b)| <= |a| + |b|. So sets of one template that differ in a few words each are compared by these few shingles, in
   blocks of GROUP, and only those that link come out, a row a set: near misses cost no pairs.
4. Of lists that still hold several components and roots, sorted in blocks of sizes and by position inside a block, a node meets only blocks of sizes that can
   link, and of these only the positions from which the overlap can be reached; pairs of one component or one root are left out. All of them are verified: no component loses a link.

`join` gives the components and leaves links inside a component untried. `links` and `link_counts` give all links: a link never leaves a component,
so the different sets of each component are dealt into blocks of BLOCK and every two sets of a component are compared exactly, block by block.

Verification intersects whole sets, made anew from the texts of the nodes in lists, which are written once (a bit table, sized by the number of these nodes
up to 2^NODE_BITS, picks them out; what passes by chance goes in the join). A leader of many nodes is copied once for each HOT of its pairs.
Components are found by alternating large and small stars on tables in the shared folder. Lists of more than LIST nodes are dealt
as pairs of parts, so that no task holds more than two parts.

Defined results: words are separated by space and the characters 09-0D, A-Z count as a-z; fewer than SIZE words make one shingle of
all of them; a null, empty or blank text has the empty set and links with nothing; texts of any length are read whole; null doc_ids take part but never name a component that
has an id; rows that repeat a doc_id or text are linked; an empty table gives an empty result; other columns are not read, and `keep_one` keeps them whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcount.llm.common import drop_written, new_path, unused, written

SIZE, SKETCH_BITS, SLICES, NODE_BITS, LIST, SALT_AT, LEADERS, ROUNDS, BLOCK, HOT = 5, 22, 64, 27, 32_768, 50_000, 2, 2, 128, 4_096
GROUP, JUMPS, JOINS = 1_024, 3, 2


def _sets(column):
    """Number and sorted distinct shingle hashes of each text with words, of an Arrow string column."""
    import numpy as np

    from loomcount.llm import ngram_hash as ng

    data, offsets = ng.arrow_strings(column)
    for a, b in ng.chunks(offsets):
        hashed, text = ng.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True, False)
        grams, of = ng.shingles(hashed, text, SIZE)
        n = b - a
        at = np.searchsorted(of, np.arange(n + 1))
        words_at = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            if at[i + 1] > at[i]:
                yield a + i, np.unique(grams[at[i] : at[i + 1]])
            elif words_at[i + 1] > words_at[i]:
                few = hashed[words_at[i] : words_at[i + 1]]
                yield a + i, ng.mix(np.array([(few * ng.PLACE[: len(few)]).sum() + np.uint64(len(few))], dtype=np.uint64))


def _node(grams) -> int:
    """A 64-bit name of a set."""
    import numpy as np

    from loomcount.llm import ngram_hash as ng

    return int(ng.mix(np.array([ng.mix(grams).sum() + np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0])


def _fits(n_x, pos_x, n_y, pos_y):
    """Whether sets of these sizes can link if their first common shingle stands at these positions."""
    import numpy as np

    need = -(-4 * (n_x + n_y) // 9)
    return (np.minimum(n_x, n_y) * 5 >= np.maximum(n_x, n_y) * 4) & (pos_x <= n_x - need) & (pos_y <= n_y - need)


def _texts(docs: DataFrame, *cols: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*[F.xxhash64(text).alias("h") if c == "h" else F.col(c).cast("long").alias(c) for c in cols], text.alias("text"))


def _first_pass(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), node, n of each document (kind 0) and the task's shingle counts by slices (kind 1)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["kind", "doc_id", "h", "node", "n", "slice", "counts"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)

        def add(some):
            bucket, n = np.unique(np.concatenate(some) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            total[bucket] += n.astype(np.uint32)

        for b in batches:
            node, n = [None] * b.num_rows, np.zeros(b.num_rows, dtype=np.int64)
            some, held = [], 0
            for i, grams in _sets(b.column(2)):
                node[i], n[i] = _node(grams), len(grams)
                some.append(grams)
                held += len(grams)
                if held > 500_000:
                    add(some)
                    some, held = [], 0
            if some:
                add(some)
            m = b.num_rows
            cols = [np.zeros(m, dtype=np.int32), b.column(0), b.column(1), node, n, [None] * m, [None] * m]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        if total.any():
            parts = np.split(total, SLICES)
            cols = [[1] * SLICES, *[[None] * SLICES] * 4, list(range(SLICES)), [zlib.compress(np.ascontiguousarray(p.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1) for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return _texts(docs, "doc_id", "h").mapInArrow(run, "kind int, doc_id long, h long, node long, n long, slice int, counts binary")


def _levels(first: DataFrame):
    """One byte for each sketch bucket: four times the logarithm of its count. 2^SKETCH_BITS bytes come to the driver."""
    import numpy as np

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.ascontiguousarray(np.frombuffer(zlib.decompress(c.as_py()), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
                total[s] = total[s] + x if s in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], names=["slice", "level"])

    got = first.filter("kind = 1").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, level binary").collect()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    width = len(out) // SLICES
    for r in got:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(bytes(r["level"]), dtype=np.uint8)
    return out


def _postings(docs: DataFrame, levels) -> DataFrame:
    """token, salt (0 for a list in one part), node, n, pos of the prefixes; a task names each of its nodes once."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        level, seen = sent.value, set()
        names = ["token", "salt", "node", "n", "pos"]

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

        for b in batches:
            out, rows = [], 0
            for _, grams in _sets(b.column(0)):
                node, n = _node(grams), len(grams)
                if node in seen:
                    continue
                seen.add(node)
                p = n - -(-4 * n // 5) + 1
                common = level[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                best = np.lexsort((grams, common))[:p]
                parts = np.maximum(1, (2.0 ** (common[best] / 4) / SALT_AT).astype(np.int64))
                salt = np.where(parts > 1, 1 + (node & 0x7FFFFFFF) % parts, 0).astype(np.int32)
                out.append((grams[best].view(np.int64), salt, np.full(p, node), np.full(p, n, dtype=np.int32), np.arange(p, dtype=np.int32)))
                rows += p
                if rows > 50_000:
                    yield made(out)
                    out, rows = [], 0
            if out:
                yield made(out)

    return _texts(docs).mapInArrow(run, "token long, salt int, node long, n int, pos int")


def _whole_lists(batches: Iterator, keys: int) -> Iterator:
    """The columns of sorted batches as NumPy arrays, cut so that rows with the same first `keys` columns stay together."""
    import numpy as np

    held = None
    for b in batches:
        x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(x[0]):
            continue
        if held is not None:
            x = [np.concatenate([h, c]) for h, c in zip(held, x, strict=True)]
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in x[:keys]]))
        stop = other[-1] + 1 if len(other) else 0
        if stop:
            yield [c[:stop] for c in x]
        held = [c[stop:] for c in x]
    if held is not None:
        yield held


def _leaders(batches: Iterator, first: bool) -> Iterator:
    """Candidates from lists (token, salt, kind, pos, node, n, comp) sorted by token, salt, kind, pos, node: each row with the first rows of its class of sizes and of the
    neighbouring classes that lie in another component. In the first round the rows worth keeping come out too, with null for `leader`."""
    import numpy as np
    import pyarrow as pa

    names = ["token", "salt", "node", "n", "pos", "leader"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    for token, salt, kind, pos, node, n, comp in _whole_lists(batches, 2):
        if first:
            again = np.zeros(len(token), dtype=bool)
            again[1:] = (token[1:] == token[:-1]) & (node[1:] == node[:-1])  # copies that other tasks named too
            token, salt, kind, pos, node, n, comp = (c[~again] for c in (token, salt, kind, pos, node, n, comp))

        def cut():
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            run = new.copy()
            run[1:] |= kind[1:] != kind[:-1]
            return np.flatnonzero(run), np.cumsum(run) - 1, np.cumsum(new) - 1

        start, run, list_of = cut()
        if first:
            # what is too far back for every size in its own and the neighbouring classes goes
            low = np.minimum.reduceat(n, start)
            best = low.copy()
            beside = (list_of[start[1:]] == list_of[start[:-1]]) & (kind[start[1:]] - kind[start[:-1]] == 1)
            best[1:][beside] = np.minimum(best[1:], low[:-1])[beside]
            size = np.maximum(best[run], -(-4 * n // 5))
            keep = (salt > 0) | (pos <= n - -(-4 * (n + size) // 9))
            for _ in range(2):
                many = np.bincount(list_of[keep], minlength=list_of[-1] + 1)
                keep &= (salt > 0) | (many[list_of] > 1)
                if not keep.any():
                    break
                # of short lists, rows that no other row of the list can link with go as well
                few = (many[list_of] <= 4) & keep & (salt == 0)
                at = np.flatnonzero(few)
                good = np.zeros(len(at), dtype=bool)
                for d in (1, 2, 3):
                    x, y = at[:-d], at[d:]
                    ok = (list_of[x] == list_of[y]) & _fits(n[x], pos[x], n[y], pos[y])
                    good[:-d] |= ok
                    good[d:] |= ok
                keep[at[~good]] = False
            if not keep.any():
                continue
            token, salt, kind, pos, node, n, comp = (c[keep] for c in (token, salt, kind, pos, node, n, comp))
            start, run, list_of = cut()
            nothing = pa.nulls(len(token), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip((token, salt, node, n, pos), types, strict=False)), nothing], names=names)
        index = np.arange(len(token))
        differs = np.where(comp != comp[start[run]], index, len(token))
        two = np.minimum.reduceat(differs, start)  # the first row of another component than the first one's
        for step in (0, -1, 1):
            to = np.arange(len(start)) + step
            there = (to >= 0) & (to < len(start))
            to = np.where(there, to, 0)
            there &= (list_of[start[to]] == list_of[start]) & (kind[start[to]] - kind[start] == step)
            a, b = start[to][run], two[to][run]
            y = np.where(comp[a] != comp, a, b)
            ok = there[run] & (y < len(token))
            y = np.where(ok, y, 0)
            ok &= (comp[y] != comp) & _fits(n, pos, n[y], pos[y])
            if ok.any():
                none = [pa.nulls(int(ok.sum()), t) for t in types]
                none[2], none[5] = pa.array(node[ok], pa.int64()), pa.array(node[y[ok]], pa.int64())
                yield pa.RecordBatch.from_arrays(none, names=names)


def _dealt(rows: DataFrame, first: bool) -> DataFrame:
    """Candidates (node, leader) of rows (token, salt, node, n, pos, comp) and, in the first round, the kept rows, whose leader is null."""
    kind = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    cols = ["token", "salt", "kind", "pos", "node", "n", "comp"]
    dealt = rows.repartition("token", "salt").withColumn("kind", kind).select(*cols).sortWithinPartitions(*cols[:5])
    return dealt.mapInArrow(lambda b: _leaders(b, first), "token long, salt int, node long, n int, pos int, leader long")


def _cross(lists: DataFrame) -> DataFrame:
    """Pairs a, b of different components and roots that one of the lists (token, i, j; sorted) lets link."""

    def pairs(node, n, pos, comp, part, root, i, j):
        import numpy as np

        if len(node) <= 64:
            x, y = np.triu_indices(len(node), 1)
            good = (comp[x] != comp[y]) & (root[x] != root[y]) & _fits(n[x], pos[x], n[y], pos[y])
            if i != j:
                good &= part[x] != part[y]
            x, y = node[x[good]], node[y[good]]
            if len(x):
                yield np.minimum(x, y), np.maximum(x, y)
            return
        block = np.floor(np.log(n) / np.log(1.05)).astype(np.int64)
        order = np.lexsort((pos, block))
        node, n, pos, comp, part, root, block = (c[order] for c in (node, n, pos, comp, part, root, block))
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(starts[1:], len(block))
        low = np.array([n[s:e].min() for s, e in zip(starts, ends, strict=True)])
        high = np.array([n[s:e].max() for s, e in zip(starts, ends, strict=True)])
        names, of, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        small = of != sizes.argmax()  # every pair has a member outside the largest component
        for x in np.flatnonzero(small):
            # blocks of sizes that can link, and of these the places up to the last that can count
            for k in np.flatnonzero((high * 5 >= n[x] * 4) & (low * 4 <= n[x] * 5)):
                s, e = starts[k], ends[k]
                room = -(-4 * (int(n[x]) + int(low[k])) // 9)
                if pos[x] > n[x] - room:
                    continue
                y = np.arange(s, s + np.searchsorted(pos[s:e], high[k] - room, side="right"))
                y = y[(comp[y] != comp[x]) & (root[y] != root[x]) & (~small[y] | (y < x))]
                if i != j:
                    y = y[part[y] != part[x]]
                y = y[_fits(n[x], pos[x], n[y], pos[y])]
                if len(y):
                    yield np.minimum(node[y], node[x]), np.maximum(node[y], node[x])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

        for x in _whole_lists(batches, 3):
            token, i, j = x[:3]
            cut = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            out, held = [], 0
            for s, e in zip(np.append(0, cut), np.append(cut, len(token)), strict=True):
                for some in pairs(*(c[s:e] for c in x[3:]), i[s], j[s]) if e - s > 1 else ():
                    out.append(some)
                    held += len(some[0])
                    if held > 50_000:
                        yield made(out)
                        out, held = [], 0
            if out:
                yield made(out)

    cols = ["token", "i", "j", "node", "n", "pos", "comp", "part", "root"]
    return lists.select(*cols).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _node_texts(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """node, h of the given nodes, h being the hash of one text of the node; h, text, bucketed by h; and the name of this table. Rows are picked by a table of bits; what passes by chance meets no node."""
    import numpy as np

    spark = docs.sparkSession
    reps = written(rows.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("h").alias("h")), "jaccard-nodes")
    width = min(1 << NODE_BITS, 1 << max(16, (8 * reps.count()).bit_length()))
    slot = F.pmod(F.col("h"), F.lit(width))
    bits = reps.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    flags = np.zeros(width, dtype=bool)
    for r in bits.collect():  # 2^NODE_BITS bits at most
        one = np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8), bitorder="little").astype(bool)
        at = (r["bucket"] - 1) * len(one)
        flags[at : at + len(one)] = one[: max(0, width - at)]
    sent = spark.sparkContext.broadcast(np.packbits(flags, bitorder="little"))

    def pick(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wanted, seen = sent.value, set()
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            at = x & (width - 1)  # width is a power of two
            some = np.flatnonzero((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            new = []
            for k, h in zip(some.tolist(), x[some].tolist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    new.append(k)
            if new:
                yield b.take(pa.array(new, pa.int64()))

    got = _texts(docs, "h").mapInArrow(pick, "h long, text string")
    name, buckets = f"jaccard_texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = got.repartition(buckets, "h").groupBy("h").agg(F.first("text").alias("text"))
    one.write.format("parquet").bucketBy(buckets, "h").sortBy("h").option("path", new_path(spark, "jaccard-texts")).saveAsTable(name)
    return reps, spark.table(name), name


def _drop_texts(texts: tuple[DataFrame, DataFrame, str]) -> None:
    reps, table, name = texts
    drop_written(reps)
    drop_written(table)
    table.sparkSession.sql(f"DROP TABLE {name}")


def _verified(texts: tuple[DataFrame, DataFrame, str], pairs: DataFrame) -> DataFrame:
    """The pairs node, leader compared by whole sets: a (leader), b (node), good (they link), diff (the shingles that only one of them has, if
    half of the shingles are common). A text goes to the leader's, which is copied once for each HOT of its pairs; the table of texts itself is read in its buckets."""
    reps, table, _ = texts
    parts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts"))
    heads = parts.join(reps.withColumnRenamed("node", "leader"), "leader").join(table.hint("merge"), "h")
    heads = heads.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("text").alias("text_a"))
    left = pairs.join(parts, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left = left.join(reps, "node").join(table.hint("merge"), "h").select("leader", "salt", "node", F.col("text").alias("text_b"))
    both = left.join(heads.hint("merge"), ["leader", "salt"]).select("leader", "node", "text_a", "text_b")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["a", "b", "good", "diff"]
        for b in batches:
            left = b.column(0).to_pylist()
            new = [k for k, x in enumerate(left) if k == 0 or x != left[k - 1]]
            sets_a = dict(_sets(b.column(2).take(pa.array(new, pa.int64()))))
            good, diff, at = np.zeros(len(left), dtype=bool), [None] * len(left), -1
            for k, other in _sets(b.column(3)):
                while at + 1 < len(new) and new[at + 1] <= k:
                    at += 1
                kept = sets_a[at]
                at_other = np.searchsorted(kept, other)
                at_other[at_other == len(kept)] = 0
                both = int((kept[at_other] == other).sum())
                total = len(kept) + len(other)
                good[k] = 100 * both >= 80 * (total - both)
                if 4 * both >= total:
                    diff[k] = np.setxor1d(kept, other, assume_unique=True).view(np.int64)
            some = pa.array(np.flatnonzero(good | np.array([d is not None for d in diff], dtype=bool)))
            cols = [b.column(0), b.column(1), pa.array(good), pa.array(diff, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.take(some) for c in cols], names=names)

    return both.mapInArrow(run, "a long, b long, good boolean, diff array<long>")


def _homes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, n, comp, diff of those nodes (node, n, comp) that were compared with a leader, and of the roots among them."""
    pairs = found.filter("diff IS NOT NULL")  # either one may lead
    pairs = pairs.select(F.col("a").alias("leader"), F.col("b").alias("node"), "diff").union(pairs.select("b", "a", "diff"))
    times = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("times"))
    own = times.select(F.col("leader").alias("node"), F.col("times").alias("own"))
    up = pairs.join(times, "leader").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    up = up.filter("times > own OR (times = own AND leader < node)")  # towards leaders of more sets: no circles
    k = F.row_number().over(W.partitionBy("node").orderBy(F.desc("times"), F.size("diff"), "leader"))
    up = written(up.withColumn("k", k).filter("k = 1").select("node", F.col("leader").alias("root"), "diff"), "jaccard-homes")
    spent = [up]
    for _ in range(JUMPS):
        over = up.select(F.col("node").alias("root"), F.col("root").alias("top"), F.col("diff").alias("more"))
        both = F.concat(F.array_except("diff", "more"), F.array_except("more", "diff"))
        up = up.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.when(F.col("top").isNull(), F.col("diff")).otherwise(both).alias("diff"))
        up = written(up, "jaccard-homes")
        spent.append(up)
    roots = up.select(F.col("root").alias("node")).distinct().join(up.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.array().cast("array<bigint>").alias("diff"))
    out = written(up.unionByName(roots).join(nodes, "node"), "jaccard-homes")
    for x in spent:
        drop_written(x)
    return out


def _derived(homes: DataFrame) -> DataFrame:
    """node, label for nodes of one root that link, by their differences to it: the label names their component inside a block, as far as it is not one component before."""
    size = homes.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("root", "parts")
    rows = homes.join(size, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("k", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("root", F.least("k", "part").alias("i"), F.greatest("k", "part").alias("j"), "part", "node", "n", "comp", "diff")

    def run(table):
        import numpy as np
        import pyarrow as pa

        node, n, comp, part = (table.column(c).to_numpy() for c in ("node", "n", "comp", "part"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        diff = table.column("diff").combine_chunks()
        sizes = diff.value_lengths().to_numpy(zero_copy_only=False)
        owner, element = np.repeat(np.arange(len(node)), sizes), diff.flatten().to_numpy()
        _, at, times = np.unique(element, return_inverse=True, return_counts=True)
        some = times[at] > 1  # the others are in no intersection
        owner, at = owner[some], (np.cumsum(times > 1) - 1)[at[some]]
        order = np.argsort(at, kind="stable")
        owner, at, width = owner[order], at[order], 4_096
        rows, columns = np.flatnonzero(part == i), np.flatnonzero(part == j)
        both = np.zeros((len(rows), len(columns)), dtype=np.int64)
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            s, e = np.searchsorted(at, (low, low + width))
            has = np.zeros((len(node), width), dtype=np.float32)
            has[owner[s:e], at[s:e] - low] = 1
            both += (has[rows] @ has[columns].T).astype(np.int64)
        apart = sizes[rows][:, None] + sizes[columns][None, :] - 2 * both
        good = (9 * apart <= n[rows][:, None] + n[columns][None, :]) & (comp[rows][:, None] != comp[columns][None, :])
        x, y = np.nonzero(good)
        x, y = rows[x], columns[y]
        label = labels_of(len(node), x, y)
        linked = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"node": pa.array(node[linked], pa.int64()), "label": pa.array(node[label[linked]], pa.int64())})

    return rows.groupBy("root", "i", "j").applyInArrow(run, "node long, label long")


def labels_of(n: int, x, y):
    """The smallest place that each of n places reaches by the pairs x, y."""
    import numpy as np

    label = np.arange(n)
    while True:
        after = label.copy()
        np.minimum.at(after, x, label[y])
        np.minimum.at(after, y, label[x])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its smallest node) of every node in edges a, b."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    while True:
        sym = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = written(small.filter("u <> v").distinct(), "small-stars")
        drop_written(large)
        drop_written(now)
        now = after
        # done when every node either has one parent or is a root
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if not ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > 1 OR (ups = 1 AND low = 0)").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame, str]]:
    """doc_id, h, node, n of every row of docs; node, comp of the nodes that link with another; the texts of these and more nodes as from _node_texts."""
    first = written(_first_pass(docs), "jaccard-docs")
    rows = first.filter("kind = 0").select("doc_id", "h", "node", "n")
    dealt = written(_dealt(_postings(docs, _levels(first)).withColumn("comp", F.col("node")), True), "jaccard-lists")
    lists = dealt.filter("leader IS NULL").drop("leader")
    texts = _node_texts(docs, rows, lists.select("node"))
    met, spent, compared = dealt.filter("leader IS NOT NULL").select("node", "leader"), [dealt], []
    tried = links = comp = docs.sparkSession.createDataFrame([], "a long, b long")
    comp = comp.toDF("node", "comp")

    def with_comp(some: DataFrame) -> DataFrame:
        return some.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def add(more: DataFrame) -> bool:
        """Verifies the pairs node, leader that are new; whether some of them link."""
        a, b = F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
        new = more.groupBy(a, b).agg(F.min("leader").alias("leader")).join(tried, ["a", "b"], "left_anti")
        new = written(new.select("a", "b", "leader", F.when(F.col("leader") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node")), "jaccard-tried")
        spent.append(new)
        if new.isEmpty():
            return False
        got = written(_verified(texts, new.select("node", "leader")), "jaccard-links")
        spent.append(got)
        compared.append(got)
        return known(new, got.filter("good").select("a", "b"))

    def known(new: DataFrame, found: DataFrame) -> bool:
        nonlocal tried, links, comp
        tried, links = tried.union(new.select("a", "b")), links.union(found)
        if found.isEmpty():
            return False
        comp = written(components(links), "jaccard-components")
        return True

    by_node = W.partitionBy("node").orderBy(F.desc("times"), "leader")
    for k in range(ROUNDS):
        if k:
            met = _dealt(with_comp(lists), False).select("node", "leader")
        times = met.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("times"))
        if not add(times.withColumn("k", F.row_number().over(by_node)).filter(F.col("k") <= LEADERS).select("node", "leader")):
            break

    # lists of several components; of these the rows that can link with a size near their own in the whole list
    now = with_comp(lists).withColumn("kind", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    kinds = now.groupBy("token", "kind").agg(F.min("n").alias("low"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    kinds = kinds.groupBy("token").agg(F.collect_list(F.struct("kind", "low")).alias("kinds"), F.min("x").alias("x"), F.max("y").alias("y")).filter("x <> y").drop("x", "y")
    near = F.expr("exists(kinds, k -> abs(k.kind - kind) <= 1 AND 9 * pos <= 5 * n - 4 * greatest(k.low, cast(ceil(0.8 * n) AS int)))")
    left = written(now.join(kinds, "token").filter(near).select("token", "node", "n", "pos", "comp"), "jaccard-left")
    spent.append(left)
    if compared and not left.isEmpty():
        nodes = left.select("node", "n", "comp").distinct()
        for k in range(JOINS + 1):
            homes = _homes(reduce(DataFrame.union, compared), nodes)
            spent.append(homes)
            rooted = left.join(homes.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
            if k == JOINS:
                break
            # roots of one list are compared with its most frequent one, each with the one that it meets most often
            times = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("times"))
            top = times.groupBy("token").agg(F.max_by("root", F.struct("times", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
            meet = times.join(top, "token").filter("root <> top").groupBy("root", "top").agg(F.count(F.lit(1)).alias("times"))
            meet = meet.withColumn("k", F.row_number().over(W.partitionBy("root").orderBy(F.desc("times"), "top"))).filter("k = 1")
            before = len(compared)
            add(meet.select(F.col("root").alias("node"), F.col("top").alias("leader")))
            if len(compared) == before:
                break
        derived = written(_derived(homes), "jaccard-derived")
        spent.append(derived)
        known(tried.limit(0), derived.select(F.col("label").alias("a"), F.col("node").alias("b")))
        left = with_comp(rooted.drop("comp"))
    else:
        left = left.withColumn("root", F.col("node"))
    several = F.count(F.lit(1)) / LIST
    mixed = left.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("root").alias("u"), F.max("root").alias("v"), F.ceil(several).cast("int").alias("parts")).filter("x <> y AND u <> v").select("token", "parts")
    parts = left.join(mixed, "token").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    parts = parts.withColumn("k", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("i", F.least("k", "part")).withColumn("j", F.greatest("k", "part"))
    add(_cross(parts).select(F.col("a").alias("node"), F.col("b").alias("leader")))
    for x in spent:
        drop_written(x)
    return rows, comp, texts


def _named(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """node, component_id of the nodes of rows."""
    low = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = low.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return named.join(named.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("node", "component_id")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    rows, comp, texts = _grouped(docs)
    _drop_texts(texts)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(_named(rows, comp), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component)


def _blocks(rows: DataFrame, comp: DataFrame, texts: tuple[DataFrame, DataFrame, str]) -> DataFrame:
    """comp, i, j, part, node, w (rows of docs with that set), text: the sets of each component in parts of about BLOCK, a row for each pair of parts that a set's part is in."""
    size = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    w = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("w"))
    parts = comp.join(size, "comp").join(w, "node").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    parts = parts.join(texts[0], "node").join(texts[1].hint("merge"), "h").withColumn("k", F.explode(F.expr("sequence(0, parts - 1)")))
    return parts.select("comp", F.least("k", "part").alias("i"), F.greatest("k", "part").alias("j"), "part", "node", "w", "text").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "part", "node")


def _compared(blocks: DataFrame, counts: bool) -> DataFrame:
    """Every two sets of the same pair of parts compared: a, b of those that link, or for each set the rows that it links with (node, n)."""

    def linked(sets, cut, same):
        """Which of the first `cut` sets link with which of the others (of all, when both parts are the same)."""
        import numpy as np

        sizes = np.array([len(x) for x in sets])
        gram, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, at, times = np.unique(gram, return_inverse=True, return_counts=True)
        owner, at = owner[times[at] > 1], (np.cumsum(times > 1) - 1)[at[times[at] > 1]]  # shingles of a single set are in no intersection
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        both, width = np.zeros((cut, len(sets) if same else len(sets) - cut), dtype=np.int64), 8192
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            s, e = np.searchsorted(at, (low, low + width))
            has = np.zeros((len(sets), width), dtype=np.float32)
            has[owner[s:e], at[s:e] - low] = 1
            both += (has[:cut] @ (has if same else has[cut:]).T).astype(np.int64)
        good = 100 * both >= 80 * (sizes[:cut, None] + (sizes if same else sizes[cut:])[None, :] - both)
        if same:
            np.fill_diagonal(good, False)
        return good

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["node", "n"] if counts else ["a", "b"]

        def found(i, j, part, node, w, text):
            sets = [None] * len(node)
            for k, grams in _sets(pa.array(text, pa.string())):
                sets[k] = grams
            same = i == j
            cut = len(node) if same else int((part == i).sum())
            if cut == 0 or (cut == len(node)) != same:
                return
            good = linked(sets, cut, same)
            x, y = (node, node) if same else (node[:cut], node[cut:])
            if counts:
                out = [(x, good @ (w if same else w[cut:]))] + ([] if same else [(y, good.T @ w[:cut])])
                out = [np.concatenate(c) for c in zip(*out, strict=True)]
            else:
                u, v = np.nonzero(np.triu(good) if same else good)
                out = [np.minimum(x[u], y[v]), np.maximum(x[u], y[v])]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

        key, held = None, []
        for b in batches:
            comp, i, j, part, node, w = (c.to_numpy(zero_copy_only=False) for c in b.columns[:6])
            text = b.column(6).to_pylist()
            cuts = np.flatnonzero((comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip(np.append(0, cuts), np.append(cuts, len(comp)), strict=True):
                if s == e:
                    continue
                now = (comp[s], i[s], j[s])
                if held and now != key:
                    yield from found(*key[1:], *(np.concatenate([h[k] for h in held]) for k in range(3)), [t for h in held for t in h[3]])
                    held = []
                key = now
                held.append((part[s:e], node[s:e], w[s:e], text[s:e]))
        if held:
            yield from found(*key[1:], *(np.concatenate([h[k] for h in held]) for k in range(3)), [t for h in held for t in h[3]])

    return blocks.mapInArrow(run, "node long, n long" if counts else "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b of every two different sets that link, a below b; and the rows with their sets: doc_id, node, n_shingles. Rows of one node have equal sets and link too."""
    rows, comp, texts = _grouped(docs)
    found = written(_compared(_blocks(rows, comp, texts), False), "jaccard-pairs")
    _drop_texts(texts)
    return found, rows.select("doc_id", "node", F.col("n").alias("n_shingles"))


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (the other rows of docs that it links with) of every row of docs."""
    rows, comp, texts = _grouped(docs)
    found = written(_compared(_blocks(rows, comp, texts), True), "jaccard-counts")
    _drop_texts(texts)
    others = found.groupBy("node").agg(F.sum("n").alias("others"))
    own = rows.filter("node IS NOT NULL").groupBy("node").agg((F.count(F.lit(1)) - 1).alias("own")).join(others, "node", "left")
    to = own.join(_named(rows, comp), "node").select("node", "component_id", (F.col("own") + F.coalesce("others", F.lit(0))).alias("n_links"))
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(to, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component; of rows that repeat it and its text, all. Without an id a row stays."""
    name = unused("id", docs)
    few = join(docs).filter("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(few, docs["doc_id"].cast("long").eqNullSafe(few[name]), "left_semi")
