"""Small corpora for the operators' tests."""

import random

SYLLABLES = "an er on th in re st en ou ing tion ble ha he wh ed".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, words):
    return " ".join(word(rng) for _ in range(words))


def edited_copy(rng, text):
    """The text with its last word changed, where it is long enough for that to stay near."""
    w = text.split()
    return " ".join([*w[:-1], word(rng) + "x"]) if len(w) > 50 else " ".join(w).upper()


def write(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(texts, lang="en"):
    return [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
