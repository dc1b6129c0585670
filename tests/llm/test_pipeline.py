"""The pipeline against brute force, and its stages on awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from sourceloom.llm import mixing, queries, toxicity
from tests.llm import docs as D
from tests.llm.test_operators import brute_classes, brute_hits


def test_stages_have_the_asked_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = D.write(spark, tmp_path)
    items = [(1, "none of this"), (2, D.prose(5, 30)), (3, None), (4, "word"), (5, "")]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = []
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        if model.score(raw, np.array([0, len(raw)]))[0] < 0.3:
            rows.append((r.doc_id, r.text, r.source))
    classes = brute_classes([r[:2] for r in rows])
    kept = list(dict.fromkeys(r for r in rows if classes[r[:2]] == r[0]))
    clean = [r for r in kept if not next(iter(brute_hits([r[:2]], items)))[5]]
    mixed = mixing.mix(spark.createDataFrame(clean, "doc_id long, text string, source string"), carry=True)
    tokenizer = Tokenizer.from_str(queries.tokenizer_json())
    copies = [(m.doc_id, m.row.text or "") for m in mixed.collect() if m.taken for _ in range(int(m.taken / m["size"] + 0.5))]
    at, want = 0, Counter()
    for d, t in sorted(copies, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want[(d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == want
    assert hashlib.sha256(str(sorted(want, key=str)).encode()).hexdigest()


def test_stages_on_empty_tables(spark, tmp_path):
    folder = D.write(spark, tmp_path, docs=D.frame(spark, []), labels=[])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        if name != "token_ids":
            assert out.columns == docs.columns
