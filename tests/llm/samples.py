"""Small tables with the cases every operator must take: nulls, blanks, repeats, clashing names."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that operators add or use inside
CLASHES = (
    "n_lines n_dropped size source_size target copies taken weight chance score predicted sample ids "
    "log_prob n_tokens prefix_counts class tokens node group h slot bucket_ body"
).split()

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def sentence(rng, length):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(length))


def edge_texts():
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    base = [sentence(rng, 40) for _ in range(12)]
    texts = [None, "", " \t\n\x0b ", "one", "One\n\n one ", "two words", "é 　 \U0001f389\nABC", long, long, long + " end"]
    texts += [f"  Shared LINE \n{b}\nshared line\x0c\n\nonly {i}" for i, b in enumerate(base)]
    texts += [base[0], base[0].replace(" ", "  "), base[0].replace(" ", "\n"), base[0] + " more"]
    return texts


def edge_rows():
    texts = edge_texts()
    rows = [(i, t, "en", ("b", "a", None)[i % 3], None) for i, t in enumerate(texts)]
    rows += [(None, "one", None, None, 1), (None, base_of(texts), None, "a", 1)]
    # repeated rows, and one id with two texts
    rows += [rows[4], rows[4], (5, "other text for five", "en", "b", 1)]
    return rows


def base_of(texts):
    return texts[-4]


def documents(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, DOCUMENTS)
    if clashing:
        from pyspark.sql import functions as F

        for name in CLASHES:
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df
