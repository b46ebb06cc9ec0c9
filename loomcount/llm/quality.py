"""Quality classifier by importance resampling.

Texts become hashed counts of their words and pairs of neighbouring words (BUCKETS buckets; words end at white space and where letters
meet other signs). Two multinomial models over the buckets are fitted: the raw one over every document of the corpus, the target one over a bounded,
seeded sample of labelled good documents (quality 1, not toxic; at most SAMPLE labelled rows are looked at). A document's log weight is
the sum over its n-grams of log p_target - log p_raw. Documents are then sampled without replacement in proportion to their
weights: Gumbel noise, seeded by the document, is added to the log weights and the k largest are kept. Unless given, k is the number of
documents whose log weight reaches a level. The level is found on a half of the labelled sample that the target model has not seen: it parts good
from other rows best among the levels that keep at least KEEP of the good ones, and is never above 0, the weight of a text without evidence.

Counting and scoring read the texts twice; what is gathered is BUCKETS counts a task, and what is broadcast are BUCKETS weights. The
k-th largest key is found by counting keys in ever smaller ranges, without sorting the corpus into one task.

Defined results: a null or empty text has no n-grams and log weight 0; repeated rows have equal keys and are kept or left
together, except that ties at the k-th key are cut by row order; without labelled good rows all weights are 0 and everything is kept; an empty
table gives an empty result; columns of docs other than doc_id and text are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcount.llm.common import unused, written

BITS = 14
BUCKETS, SAMPLE, KEEP, SEED = 1 << BITS, 20_000, 0.995, 11


def _features(column):
    """Bucket and text number of each n-gram of an Arrow string column, chunk by chunk with the number of the chunk's first text and its size."""
    import numpy as np

    from loomcount.llm import ngram_hash as ng

    data, offsets = ng.arrow_strings(column)
    for a, b in ng.chunks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        one, text = ng.words(data[offsets[a] : offsets[b]], at, False, True)
        two, text2 = ng.shingles(one, text, 2)
        yield a, b - a, (np.concatenate([one, two]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([text, text2])


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, n over all rows of docs (text)."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for _, _, bucket, _ in _features(b.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    each = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(docs: DataFrame):
    """The counts as an array of BUCKETS numbers, a bounded size."""
    import numpy as np

    out = np.zeros(BUCKETS)
    for bucket, n in bucket_counts(docs).collect():
        out[bucket] = n
    return out


def log_ratio(target, raw):
    import numpy as np

    p = (raw + 1) / (raw.sum() + BUCKETS)  # also the prior of the target, worth one count a bucket
    return np.log((target + BUCKETS * p) / (target.sum() + BUCKETS)) - np.log(p) if target.sum() else np.zeros(BUCKETS)


def scored(docs: DataFrame, weights, name: str = "log_weight") -> DataFrame:
    """docs with the log weight appended."""
    import numpy as np

    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, dtype=np.float64))
    names = docs.columns
    at = names.index("text")

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        w = sent.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for a, n, bucket, text in _features(pc.fill_null(b.column(at), "")):
                out[a : a + n] = np.bincount(text, weights=w[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*names, name])

    return docs.mapInArrow(score, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{name}` double")


def gumbel(seed: int, *cols: Column) -> Column:
    """Gumbel noise that depends on the columns alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, parts: int = 4096) -> float:
    """The k-th largest value of keys.key (k at least 1, at most their number), by counting ranges of values."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        step = (high - low) / parts
        if step <= 0 or low + step <= low:
            break
        part = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(parts - 1))
        inside = keys.filter(F.col("key").between(low, high)).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("z"))
        above = keys.filter(F.col("key") > high).count()
        for r in sorted(inside.collect(), key=lambda r: -r["p"]):  # at most `parts` rows
            if above + r["n"] >= k:
                low, high = r["a"], r["z"]
                break
            above += r["n"]
    return high


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, text, good of at most `limit` labelled documents, chosen by a hash of their ids."""
    few = labels.filter("quality IS NOT NULL").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    few = few.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(limit)
    got = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most `limit` rows of nine bytes
    return got.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))  # one text of rows that repeat an id


def level(good, other, keep: float = KEEP) -> float:
    """The score that parts good from other best, among those that keep at least this share of good."""
    import numpy as np

    if not len(good):
        return 0.0
    most = np.quantile(good, 1 - keep)
    at = np.unique(np.concatenate([good[good <= most], other[other <= most], [most]]))
    lost = np.searchsorted(np.sort(good), at, side="left") / len(good)
    caught = np.searchsorted(np.sort(other), at, side="left") / max(1, len(other))
    return min(0.0, float(at[np.argmax(caught - lost)]))


def key_of(name: str = "log_weight") -> Column:
    return F.col(name) + gumbel(SEED, F.col("doc_id").cast("long"), F.xxhash64("text"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple:
    """The buckets' weights and the level for the log weight."""
    import numpy as np

    half = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2)) == 0
    sample = written(labelled_sample(docs, labels).withColumn("fitted", half), "quality-sample")
    weights = log_ratio(_counts(sample.filter("good AND fitted")), _counts(docs))
    seen = scored(sample.filter("NOT fitted"), weights).select("good", "log_weight").collect()  # at most SAMPLE rows
    good, other = (np.array([r[1] for r in seen if r[0] == x]) for x in (True, False))
    return weights, level(good, other)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[DataFrame, object, float]:
    """(rows, weights, key): doc_id, log_weight, gumbel_key, kept of every row of docs; the weights; the k-th largest key."""
    weights, at = fit(docs, labels)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights)
    got = written(rows.select("doc_id", "log_weight", key_of().alias("gumbel_key"), F.monotonically_increasing_id().alias("_u")), "quality-scores")
    n = got.count()
    k = min(n, got.filter(F.col("log_weight") >= at).count() if k is None else k)
    if k <= 0:
        return got.drop("_u").withColumn("kept", F.lit(False)), weights, float("inf")
    key = kth_largest(got.select(F.col("gumbel_key").alias("key")), k)
    over = k - got.filter(F.col("gumbel_key") > key).count()
    last = kth_largest(got.filter(F.col("gumbel_key") == key).select((-F.col("_u")).cast("double").alias("key")), over)
    kept = (F.col("gumbel_key") > key) | ((F.col("gumbel_key") == key) & (-F.col("_u").cast("double") >= last))
    return got.withColumn("kept", kept).drop("_u"), weights, key


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of docs whose key reaches the k-th largest one, all columns, whatever their names; texts are scored where they are, not shuffled.
    Equal keys belong to rows that repeat doc_id and text: all of them stay, where `resample` cuts at k."""
    _, weights, key = resample(docs, labels, k)
    name = unused("_log_weight", docs)
    return scored(docs, weights, name).filter(key_of(name) >= key).select(*docs.columns)
