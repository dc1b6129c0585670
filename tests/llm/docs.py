"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string, row string, label int, item long, bucket string, target string, doc string, kept boolean, text_key string, first_doc long, class_id long, spans string, shard int"
EXTRA = (0.5, 7, "k", "r", 1, 2, "b", "t", "d", True, "x", 3, 4, "s", 5)


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = ["tha", "ne", "ri", "so", "lumi", "ka", "été", "ß", "on", "ter", "vi", "mo"]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    base = [prose(i, 40 + 13 * i) for i in range(12)]
    near = base[3].split()
    near[20] = "changed"
    texts: list[str | None] = [
        *base, base[2], base[2], " ".join(near), None, "", None, "   \n\t ", "word", "word", "one two three", "!!! ... ---",
        prose(99, 9000), "x" * 70_000, base[5] + " " + base[6], base[7][:200] + " tail " + base[8][100:300], "é" * 60, "aaaa " * 40,
    ]
    out = [(i, t, "en", ["a", "b", None, "Ä", "b"][i % 5] if i % 7 else "hot") for i, t in enumerate(texts)]
    out += [(3, base[3], "en", "Ä"), (3, base[3], "en", "Ä"), (4, "another text for the same id " + base[9], "de", "b"), (None, base[1], None, None), (None, base[10] + " more", None, "a")]
    return [(d, t, lang, source, len(t or ""), *EXTRA) for d, t, lang, source in out]


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def write(spark, tmp_path, docs=None, benchmark=None, labels=None) -> str:
    folder = str(tmp_path)
    (frame(spark) if docs is None else docs).write.parquet(f"{folder}/documents.parquet")
    items = [(1, "none of this"), (2, prose(5, 30)), (3, None), (4, "word"), (5, "")] if benchmark is None else benchmark
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(i, i % 2, i % 3 // 2) for i in range(25)] if labels is None else labels
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder
