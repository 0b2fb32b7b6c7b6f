"""Small tables with all that is awkward: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

CLASHING = ("k1", "k2", "row", "spans", "kept", "new", "sid", "n", "label", "cluster", "toxic", "severity", "digest", "id", "part", "bucket", "a.b", "found", "whole", "windows")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3, groups=25):
    """(doc_id, text) rows with exact and near copies, shared passages, repeats and edge cases."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    rows = []
    for _ in range(groups):
        base = words(rng, rng.choice([1, 2, 3, 5, 9, 12, 20, 40, 80, 200])).split()
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                j = rng.randrange(len(t)) if t else 0
                roll = rng.random()
                if roll < 0.4 and t:
                    t[j] = f"w{rng.randrange(400)}"
                elif roll < 0.7:
                    t.insert(j, f"w{rng.randrange(400)}")
                elif t:
                    del t[j]
            text = " ".join(t)
            if rng.random() < 0.2:
                text += ". " + passage + ". "
            rows.append((len(rows), text))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "   \n\t "), (n + 3, rows[4][1].upper() if rows[4][1] else "X"), (n + 4, "ä é \u6f22\u5b57 \U0001f600 " * 20), (n + 5, "a" * 5000), (n + 6, "ab " * 4000)]
    rows += [rows[7], rows[8], rows[8]]  # repeated rows
    return rows


def table(spark, rows, clashing=False, parts=3):
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src0", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, DOCUMENTS)
    if clashing:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit(7) if c != "a.b" else F.lit(None).cast("string"))
    return df.repartition(parts)


def saved(spark, path, rows, name="documents"):
    table(spark, rows).write.parquet(f"{path}/{name}.parquet")
    return str(path)
