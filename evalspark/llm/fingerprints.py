"""Document fingerprints by one-permutation MinHash, in DataFrame operations only.

Every shingle of a text is hashed once; the first bits of a hash choose its bin, and a bin keeps its
least hash. An empty bin borrows from another: it tries bins in an order drawn by hashing its own number, the
same for all documents, until one isn't empty (optimal densification). The fingerprint is the low-order
byte of each bin. Two fingerprints agree in a bin by chance with probability 1/256, for which
the estimate of likeness is corrected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SHINGLE_WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
# tries of an empty bin before the order is completed over the bins that aren't empty
TRIES = 8
LEAST_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingle_hashes(text: Column, words: int) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    hashed = F.transform(F.split(trimmed, BLANKS), lambda w: F.xxhash64(w))

    def shingles(hs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hs) - words, F.lit(0)))
        # past the end of a short text the words are null, and count for nothing
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(words)]))

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(_let(hashed, shingles))


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The low byte of every bin, as an array of small numbers.

    A text with fewer words than a shingle is one shingle; a text without words has -1 in every
    bin, which agrees with no other text's.
    """
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")
    every = F.sequence(F.lit(0), F.lit(BINS - 1))

    def densified(least: Column) -> Column:
        def with_bins(bins: Column) -> Column:
            own = F.transform(every, lambda j: F.get(least, (F.array_position(bins, j) - 1).cast("int")))

            def filled(sparse: Column) -> Column:
                def borrowed(j: Column) -> Column:
                    tries = [
                        F.get(sparse, F.pmod(F.hash(j, F.lit(t)), F.lit(BINS))) for t in range(TRIES)
                    ]
                    ordered = F.transform(
                        bins, lambda b: F.struct(F.hash(j, b, F.lit(TRIES)).alias("o"), b.alias("b"))
                    )
                    nearest = F.get(sparse, F.array_min(ordered)["b"])
                    return F.coalesce(F.get(sparse, j), *tries, nearest)

                return F.transform(every, borrowed)

            return _let(own, filled)

        return _let(F.transform(least, bin_of), with_bins)

    def least_of_bins(hashes: Column) -> Column:
        # sorted hashes stand by bin, the least of each first
        return F.filter(
            hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.coalesce(F.get(hashes, i - 1), h)))
        )

    def low(values: Column) -> Column:
        return F.transform(
            values,
            lambda v: F.coalesce(v.bitwiseAND(F.lit((1 << LOW_BITS) - 1)), F.lit(-1)).cast("smallint"),
        )

    sorted_hashes = F.sort_array(_shingle_hashes(text, words))
    return _let(_let(sorted_hashes, lambda h: _let(least_of_bins(h), densified)), low)


def packed(bins: Column) -> Column:
    """The fingerprint as text, two hexadecimal digits for a bin; ``--`` in a text without words."""
    digits = F.transform(
        bins, lambda v: F.when(v < 0, F.lit("--")).otherwise(F.lpad(F.lower(F.hex(v)), 2, "0"))
    )
    return F.array_join(digits, "")


def likeness(left: Column, right: Column) -> Column:
    """Estimate of the Jaccard similarity from two fingerprints, corrected for chance agreement."""
    same = F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda e: e)) / float(BINS)
    chance = 1.0 / (1 << LOW_BITS)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1.0 - chance)))


def _bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Least doc_ids of ranges with about equal numbers of documents."""
    shares = [i / buckets for i in range(1, buckets)]
    row = docs.agg(F.percentile_approx("doc_id", shares, 10 * buckets)).first() if shares else None
    return sorted(set(row[0])) if row and row[0] else []


def _bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at most the key, by halving."""
    steps = max(1, len(bounds).bit_length())
    padded = bounds + [None] * ((1 << steps) - len(bounds))
    values = F.array(*[F.lit(b).cast("bigint") for b in padded])

    def halved(step: int) -> Callable[[Column], Column]:
        def next_place(at: Column) -> Column:
            below = F.get(values, at + F.lit(step - 1)) <= key
            return F.when(F.coalesce(below, F.lit(False)), at + F.lit(step)).otherwise(at)

        return next_place

    found = F.lit(0)
    for k in reversed(range(steps)):
        found = _let(found, halved(1 << k))
    return found


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``doc_id`` and ``carried`` columns, with those of the next row as ``next_…``.

    Rows stand in ascending order of doc_id (null first), then of the carried columns; after the last comes
    the first. Each range of doc_ids is one task; it borrows the first row of the range after it.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(docs.where("doc_id IS NOT NULL"), buckets)
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    rows = docs.select("doc_id", *carried).select(
        "*", key.alias("_key"), _bucket(key, bounds).alias("_bucket"), F.lit(False).alias("_guest")
    )
    firsts = sorted(
        tuple(r)
        for r in docs.select(key.alias("k"))
        .select("k", _bucket(F.col("k"), bounds).alias("b"))
        .groupBy("b")
        .agg(F.min("k").alias("k"))
        .select("b", "k")
        .collect()
    )  # a row per range
    order = [F.col("_key"), *[F.col(c) for c in carried]]
    if not firsts:
        guests = rows.limit(0)
        hosts = None
    else:
        hosts = F.create_map(
            *[F.lit(v) for i, (_, k) in enumerate(firsts) for v in (k, firsts[i - 1][0])]
        )
        nth = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
        guests = (
            rows.where(F.col("_key").isin([k for _, k in firsts]))
            .withColumn("_n", nth)
            .where("_n = 1")
            .drop("_n")
            .withColumn("_bucket", F.element_at(hosts, F.col("_key")))
            .withColumn("_guest", F.lit(True))
        )
    run = Window.partitionBy("_bucket").orderBy(F.col("_guest"), *order)
    return (
        rows.unionByName(guests)
        .select("*", *[F.lead(c).over(run).alias(f"next_{c}") for c in carried])
        .where(~F.col("_guest"))
        .drop("_key", "_bucket", "_guest")
    )


def edited_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half (rounded down, in code points) replaced by as many first code points of
    the next document, or all it has. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. A null text is the empty text; texts without words agree
    with each other only. Rows with equal doc_id stand in order of their text; a single row is its own next. An
    empty table gives an empty result. Other columns play no part.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn(
        "bins", fingerprint(F.col("body"), words)
    )
    pairs = with_next(rows, ["body", "bins"])
    chars = F.char_length("body")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.left(F.col("body"), chars - half), F.left(F.col("next_body"), half))
    done = pairs.select(
        "doc_id", chars.cast("bigint").alias("n_chars"), "bins", "next_bins", edited.alias("edited")
    ).withColumn("edited_bins", fingerprint(F.col("edited"), words))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
