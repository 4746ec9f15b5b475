import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot long, kept boolean, size int"


def odd_rows():
    """Nulls, empty and long texts, ties, repeats, near copies; extra columns that clash."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "", " \t\n", "a", "A", "one two three", "one  two\nthree", "é" * 3000, "x" * 200_000, " ".join(rng.choices(vocabulary, k=9000))]
    base = rng.choices(vocabulary, k=120)
    texts += [" ".join(base)] * 4 + [" ".join(base) + "\n"]
    for k in range(12):
        copy = list(base)
        for i in rng.sample(range(120), k // 3):
            copy[i] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(60)]
    rows = [(i * 7 % 101 + 100 * (i % 3), t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), None if t is None else len(t), 0.5, 3, True, 1) for i, t in enumerate(texts)]
    rows.append((None, "no id", None, None, None, None, None, None, None))
    rows.append((None, rows[11][1], None, None, None, None, None, None, None))  # a copy without id
    rows.append(rows[15])  # a whole row twice
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """(folder, rows) of a documents table with every odd case."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], i % 2, int("w1" in (r[1] or "").split()[:20])) for i, r in enumerate(rows) if r[0] is not None]
    spark.createDataFrame([*labels, (None, None, None), labels[0]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    """Empty tables."""
    folder = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder
