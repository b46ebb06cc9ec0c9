"""Hashes, sketches and stores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2_147_483_647
#: Counts of a Bloomier store are below 2^COUNT_BITS, its cells and fingerprints have CELL_BITS.
COUNT_BITS, CELL_BITS = 40, 63


def universal(x: Column, a: int, b: int, width: int) -> Column:
    """(a x + b) mod a prime, into `width` cells; x below 2^31."""
    return F.pmod(F.pmod(F.lit(a).cast("bigint") * x + F.lit(b).cast("bigint"), F.lit(PRIME).cast("bigint")), F.lit(width).cast("bigint"))


def multiply_shift(x: Column, a: int, bits: int) -> Column:
    """The top `bits` of the low 32 bits of a x, for x below 2^31 and odd a below 2^31."""
    return F.shiftright((F.lit(a).cast("bigint") * x).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), 32 - bits)


def shift_add_xor(s: Column, seed: int = 31, left: int = 5, right: int = 2) -> Column:
    """h := h xor ((h << left) + (h >> right) + code) over the signs, 31 bits kept."""
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    step = lambda h, c: h.bitwiseXOR(F.shiftleft(h, left) + F.shiftright(h, right) + c).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint"))
    return F.aggregate(codes, F.lit(seed).cast("bigint"), step)


def tabulation(x: Column, seed: int) -> Column:
    """Xor over the four bytes of x of a table entry, the entry made by hashing (seed, place, byte)."""
    entry = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("bigint")).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return entry(0).bitwiseXOR(entry(1)).bitwiseXOR(entry(2)).bitwiseXOR(entry(3))


def cell(key: Column, row: Column | int, width: int) -> Column:
    """Cell of a key in a row of a count-min table."""
    r = F.lit(str(row)) if isinstance(row, int) else row.cast("string")
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", r, key)), 1, 12), 16, 10).cast("bigint"), F.lit(width))


def count_min(df: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """row, cell, total."""
    each = df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return each.groupBy("row", cell(F.col(key), F.col("row"), width).alias("cell")).agg(F.sum("c").alias("total"))


def point_estimates(keys: DataFrame, key: str, sketch: DataFrame, depth: int, width: int) -> DataFrame:
    """key, estimate: never below the truth. The sketch has depth * width rows at most."""
    each = keys.select(key).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("cell", cell(F.col(key), F.col("row"), width))
    return each.join(sketch, ["row", "cell"], "left").groupBy(key).agg(F.coalesce(F.min("total"), F.lit(0)).alias("estimate"))


def fingerprint_store(counts: DataFrame, key: str, buckets: int, bits: int) -> DataFrame:
    """bucket, finger, cnt: the approximate store. Keys that share both are one cell; a zero finger is replaced by a second hash."""
    h = F.xxhash64(key)
    finger = F.shiftrightunsigned(h, 64 - bits)
    finger = F.when(finger == 0, F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 64 - bits).bitwiseOR(F.lit(1))).otherwise(finger)
    return counts.withColumn("bucket", F.pmod(h, F.lit(buckets))).withColumn("finger", finger).groupBy("bucket", "finger").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("keys"))


def updated(store: DataFrame, batch: DataFrame, key: str, add: bool) -> DataFrame:
    """The exact store after a batch: add sums, else the batch overwrites what it names."""
    new = batch.groupBy(key).agg(F.sum("cnt").alias("new"))
    both = store.join(new, key, "full_outer")
    cnt = F.coalesce("cnt", F.lit(0)) + F.coalesce("new", F.lit(0)) if add else F.coalesce("new", "cnt")
    return both.select(key, cnt.alias("cnt"))


def entropy(counts: DataFrame, *by: str) -> DataFrame:
    """Sum of p log2(1 / p)."""
    total = counts.groupBy(*by).agg(F.sum("cnt").alias("total"))
    met = counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))  # one row
    p = F.col("cnt") / F.col("total")
    return met.groupBy(*by).agg(F.sum(-p * F.log2(p)).alias("entropy"))


def sampled_entropy(tokens: DataFrame, pos: str, key: str, s1: int, s2: int) -> DataFrame:
    """The AMS estimate over a stream with places from 1: the first s1 * s2 places are the samples, r their key's occurrences from there
    on, X = m (r/m log2(m/r) - (r-1)/m log2(m/(r-1))); the mean over s1, then the (upper) median over s2."""
    few = tokens.filter(F.col(pos) <= s1 * s2).select(F.col(pos).alias("at"), F.col(key).alias("k"))
    m = tokens.agg(F.count(F.lit(1)).alias("m"))
    seen = tokens.join(F.broadcast(few), F.col(key) == F.col("k")).filter(F.col(pos) >= F.col("at"))  # s1 * s2 rows
    r = seen.groupBy("at").agg(F.count(F.lit(1)).alias("r")).crossJoin(F.broadcast(m))  # one row
    term = lambda x: F.when(x > 0, x * F.log2(F.col("m") / F.nullif(x, F.lit(0)))).otherwise(0.0)
    means = r.groupBy(F.floor((F.col("at") - 1) / s1).alias("g")).agg(F.avg(term(F.col("r")) - term(F.col("r") - 1)).alias("x"))
    return means.agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.get("xs", F.expr("size(xs) div 2")).alias("entropy"))


def bloomier(counts: DataFrame, key: str, parts: int = 10, space: float = 1.23, most_tries: int = 50) -> DataFrame:
    """part, seed, width, table of a static function from keys to counts below 2^COUNT_BITS: three hashed cells a key are peeled one by one, counts are
    set by xor with a fingerprint of the cell's width. A larger count is an error. A part is one group; choose `parts` so that it fits a task."""
    import pandas as pd

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        n, width = len(rows), max(4, int(space * len(rows)) + 3)
        if rows["cnt"].max() >> COUNT_BITS:
            raise ValueError(f"a count has more than {COUNT_BITS} bits")
        keys = rows["k"].to_numpy().astype(np.uint64)
        for seed in range(most_tries):
            cells, finger = _cells(keys, seed, width)
            held = [[] for _ in range(width)]
            for i in range(n):
                for c in set(cells[i]):
                    held[c].append(i)
            degree = [len(h) for h in held]
            todo, order, done = [c for c in range(width) if degree[c] == 1], [], [False] * n
            while todo:
                c = todo.pop()
                if degree[c] != 1:
                    continue
                i = next(x for x in held[c] if not done[x])
                done[i] = True
                order.append((i, c))
                for d in set(cells[i]):
                    degree[d] -= 1
                    if degree[d] == 1:
                        todo.append(d)
            if len(order) == n:
                table = np.zeros(width, dtype=np.int64)
                codes = rows["cnt"].to_numpy()
                for i, c in reversed(order):
                    v = int(codes[i]) ^ int(finger[i])
                    for d in cells[i]:
                        if d != c:
                            v ^= int(table[d])
                    table[c] = v
                return pd.DataFrame({"part": [rows["part"].iloc[0]], "seed": [seed], "width": [width], "codes": [table.tolist()]})
        raise ValueError("no acyclic graph found")

    keyed = counts.select(F.xxhash64(key).alias("k"), "cnt").withColumn("part", F.pmod("k", F.lit(parts)))
    return keyed.groupBy("part").applyInPandas(build, "part long, seed int, width int, codes array<long>")


def _cells(keys, seed: int, width: int):
    """Three different cells and a fingerprint for each 64-bit key."""
    import numpy as np

    def mixed(salt):
        x = keys ^ np.uint64((seed * 4 + salt) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    a, b, c = (mixed(k) % np.uint64(w) for k, w in ((0, width), (1, width - 1), (2, width - 2)))
    cells = np.empty((len(keys), 3), dtype=np.int64)
    cells[:, 0] = a
    cells[:, 1] = (a + np.uint64(1) + b) % np.uint64(width)
    low, high = np.minimum(cells[:, 0], cells[:, 1]), np.maximum(cells[:, 0], cells[:, 1])
    third = c.astype(np.int64)
    third += third >= low
    third += third >= high
    cells[:, 2] = third
    return cells, (mixed(3) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def bloomier_query(keys: DataFrame, key: str, tables: DataFrame, most: int, parts: int = 10) -> DataFrame:
    """key, cnt: null where the answer is no count from 1 to `most` (an unknown key passes by chance in about most / 2^CELL_BITS of cases)."""
    import pandas as pd

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(left) or not len(right):
            return pd.DataFrame({key: left[key], "cnt": pd.array([None] * len(left), dtype="Int64")})
        t = right.iloc[0]
        table = np.array(t["codes"], dtype=np.int64)
        cells, finger = _cells(left["k"].to_numpy().astype(np.uint64), int(t["seed"]), int(t["width"]))
        v = table[cells[:, 0]] ^ table[cells[:, 1]] ^ table[cells[:, 2]] ^ finger
        return pd.DataFrame({key: left[key], "cnt": pd.array([int(x) if 1 <= x <= most else None for x in v], dtype="Int64")})

    keyed = keys.select(key, F.xxhash64(key).alias("k")).withColumn("part", F.pmod("k", F.lit(parts)))
    return keyed.groupBy("part").cogroup(tables.groupBy("part")).applyInPandas(look, f"{key} string, cnt long")


WORD_BITS = 32


def packed(values: DataFrame, width: int) -> DataFrame:
    """cell, bits: an array of numbers of `width` bits (31 at most) without gaps in cells of 32 bits, from (address, value, finger) with different addresses from 0 on. What
    is written is the value xor the finger's low bits (finger 0: the value itself). A value that is null or needs more bits is an error; cells of zeros only
    are there if an address in them was written."""
    if not 0 < width < WORD_BITS:
        raise ValueError("1 to 31 bits")
    mask = (1 << width) - 1
    fits = F.when(F.col("value").between(0, mask), F.col("value").cast("long")).otherwise(F.raise_error(F.lit("a value does not fit its bits")).cast("long"))
    bit = F.col("address").cast("long") * width
    rows = values.select(F.shiftright(bit, 5).alias("at"), F.pmod(bit, F.lit(WORD_BITS)).cast("int").alias("off"), fits.bitwiseXOR(F.col("finger").cast("long").bitwiseAND(F.lit(mask))).alias("v"))
    rows = rows.select("at", "off", F.expr("shiftleft(v, off)").alias("both"))
    low = F.struct(F.col("at").alias("cell"), F.col("both").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("bits"))
    high = F.struct((F.col("at") + 1).alias("cell"), F.shiftright("both", WORD_BITS).alias("bits"))
    parts = F.when(F.col("off") + width > WORD_BITS, F.array(low, high)).otherwise(F.array(low))
    return rows.select(F.inline(parts)).groupBy("cell").agg(F.bit_or("bits").alias("bits"))


def unpacked(asked: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """asked (address, finger) with `value`: what stands there xor the finger's low bits; addresses in cells that are absent hold zero. One join: an
    address whose number goes over the end of its cell asks for two."""
    mask, bit = (1 << width) - 1, F.col("address").cast("long") * width
    places = asked.withColumn("_at", F.shiftright(bit, 5)).withColumn("_off", F.pmod(bit, F.lit(WORD_BITS)).cast("int"))
    over = F.when(F.col("_off") + width > WORD_BITS, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    met = places.withColumn("_k", F.explode(over)).withColumn("cell", F.col("_at") + F.col("_k")).join(cells, "cell", "left")
    part = F.expr("shiftright(shiftleft(coalesce(bits, 0L), 32 * _k), _off)").bitwiseAND(F.lit(mask))
    whole = met.groupBy("address", "finger").agg(F.bit_or(part).alias("value"))
    return whole.withColumn("value", F.col("value").bitwiseXOR(F.col("finger").cast("long").bitwiseAND(F.lit(mask))))
