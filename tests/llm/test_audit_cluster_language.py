"""Divergence audit, centroid clustering and language identification against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from sourceloom.llm import clusters, divergence, language_id, queries
from tests.llm import docs as D

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def audited(rows, least, top=10):
    """All rows of the audit of (text, lang, source), term by term."""
    seen, docs, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = terms_of(text)
        seen[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update({w: seen[lang, s][w] for w in kept})

        def p(counts, kept=kept):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * len(kept)) for w in kept}

        of, q = {s: p(seen[lang, s]) for s in sources}, p(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(of[s][w], of[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            best = [(-f(of[s][w], q[w]), w.encode()) for w in kept if seen[lang, s][w] and of[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def as_set(frame):
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("least", [1, 2, 6])
def test_audit_equals_brute_force_on_awkward_rows(spark, least):
    rows = D.rows()
    assert as_set(divergence.audit(D.frame(spark, rows), least)) == audited([(r[1], r[2], r[3]) for r in rows], least)


def test_audit_of_ties_hot_terms_and_languages_without_terms(spark):
    texts = [("tie" + chr(97 + k % 26) + "é" * (k % 3), "x", f"s{k % 4}") for k in range(120)] + [("the the The", "x", "s1")] * 50
    texts += [("123 !!", "y", "a"), (None, "y", "b"), ("", "y", None), ("alone", "z", "only")]
    rows = [(k, t, lang, source, 0, *D.EXTRA) for k, (t, lang, source) in enumerate(texts)]
    got = as_set(divergence.audit(D.frame(spark, rows), 2))
    assert got == audited(texts, 2)
    assert ("y", "a", "pair", "b", 0, 2) in got and not any(r[0] == "z" for r in got)
    assert divergence.audit(D.frame(spark, rows[:0])).count() == 0


def test_audit_counts_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    many = 9 * 10**15
    terms = spark.createDataFrame([("l", "w", many + 5, [("a", many), ("b", 5)]), ("l", "v", 7, [("a", 7)])], "lang string, term string, lang_n long, sources array<struct<source:string,n:long>>")
    groups = spark.createDataFrame([("l", "a", many + 7, many + 12, 2), ("l", "b", 5, many + 12, 2)], "lang string, source string, total long, lang_total long, terms long")

    def p(c, n):
        return 1 + 10**9 * (c + 2) // (n + 4)

    def f(a, b):
        return (a - b) ** 2 // (a + b)

    want = f(p(many, many + 7), p(5, 5)) + f(p(7, many + 7), p(0, 5))
    assert {(r.source, r.item, r.value) for r in divergence.pair_values(terms, groups).collect()} == {("a", "b", want), ("b", "a", want)}
    top = divergence.top_terms(terms, groups).filter(F.col("source") == "b").collect()
    assert [(r.item, r.value) for r in top if r.item == "w"] == ([("w", f(p(5, 5), p(many + 5, many + 12)))] if p(5, 5) > p(many + 5, many + 12) else [])


@pytest.mark.parametrize("name", ["op11_divergence", "op12_centroids"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert Counter(map(tuple, want.fetchall())) == Counter(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf).collect())


# ------------------------------------------------------------------ centroids


def clustered(rows, k=8, rounds=10, dim=64):
    """(id, cluster, distance), final centroids, from (id, vector) in plain whole numbers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(centroids)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def vectors(n=60, dim=64, seed=5):
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=dim) + 3 * (i % 5 == np.arange(dim) % 5)).tolist()) for i in range(n)]


def test_clusters_equal_brute_force_with_awkward_vectors(spark):
    rows = vectors()
    rows += [rows[3], (70, None), (71, []), (72, [1.0] * 63), (73, [None] + [0.0] * 63), (74, [float("nan")] * 64), (75, [float("inf")] * 64), (None, [0.25] * 64), (76, [0.0] * 64), (77, [-0.0] * 64), (78, [-1e-9] * 64)]
    rows += [(100 + i, [2.5] * 64) for i in range(30)]
    frame = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = clusters.cluster(frame).collect()
    want, centroids = clustered(rows)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    total = Counter()
    for _, j, d in want:
        total[j] += d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (total[r.cluster], sum(total.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_vectors_ties_large_numbers_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.cluster(spark.createDataFrame([], schema)).collect() == []
    same = [(i, [1.0] * 64) for i in range(5)]
    assert {(r.cluster, r.distance) for r in clusters.cluster(spark.createDataFrame(same, schema)).collect()} == {(0, 0)}
    far = [(1, [131072.0] * 64), (2, [-131072.0] * 64), (3, [131071.0] * 64)]
    assert Counter((r.vec_id, r.cluster, r.distance) for r in clusters.cluster(spark.createDataFrame(far, schema), k=2).collect()) == Counter(clustered(far, k=2)[0])
    with pytest.raises(Exception, match="component is over"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema)).collect()


def test_products_move_by_the_changes_only():
    r = np.random.default_rng(1)
    v, old = r.integers(-50, 50, (20, 8)), r.integers(-50, 50, (3, 8))
    new = old.copy()
    new[1, 2] += 5
    dots = v @ old.T
    dots[:, 1] += v[:, [2]] @ (new - old)[1, [2]]
    assert (dots == v @ new.T).all()
    distances = ((v[:, None, :] - new) ** 2).sum(axis=2)
    assert (clusters.nearest(dots, new) == distances.argmin(axis=1)).all()


# ------------------------------------------------------------------- language


def plain_vector(text):
    """The sum of the text's n-gram vectors, one by one."""
    total = np.zeros(language_id.BITS)
    low = language_id.lowered()
    points = [0, *(int(low[ord(c)]) for c in text), 0]
    for k in range(1, len(points) - 1):
        if points[k]:
            signs = np.ones(language_id.BITS)
            for place in range(3):
                bits = np.unpackbits(np.roll(language_id.letter_vectors(np.array([points[k - 1 + place]])), 2 - place, axis=1).view(np.uint8))
                signs = signs * np.where(bits == 1, -1, 1)
            total += -signs
    return total


def encoded(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


def test_vectors_equal_plain_loops_and_pieces_change_nothing(monkeypatch):
    texts = ["Hallo Welt", "", "été! 12 İß", "a", "日本語 テキスト", "x" * 50, D.prose(3, 30), "1 2 3", "éa 𝒳y"]
    whole = language_id.text_vectors(*encoded(texts))
    for text, v in zip(texts, whole, strict=True):
        assert (v == plain_vector(text)).all()
    for size in (4, 7, 16):
        monkeypatch.setattr(language_id, "PIECE_BYTES", size)
        assert (language_id.text_vectors(*encoded(texts)) == whole).all()


def test_language_of_awkward_rows_and_held_out(spark):
    from pyspark.sql import functions as F

    rows = [(k, (D.prose(k, 30) if k % 2 else " ".join(["zwo", "qui", "xaf", "ypp"][(k * j) % 4] * (j % 3 + 1) for j in range(30))), "one" if k % 2 else "two", "s", 0, *D.EXTRA) for k in range(80)]
    rows += [(200, None, "one", "s", 0, *D.EXTRA), (201, "", "two", "s", 0, *D.EXTRA), (202, "12 !? 、", "one", "s", 0, *D.EXTRA), (203, "é", None, None, 0, *D.EXTRA), (None, D.prose(5, 9), "three", None, 0, *D.EXTRA)]
    docs = D.frame(spark, rows)
    model = language_id.fit(docs)
    assert model.names == ["one", "two"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(got) == len(rows)
    for k in range(80):
        assert got[k].lang_pred == ("one" if k % 2 else "two") and 0 <= got[k].score <= 1
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    assert [(got[k].lang_pred, got[k].score) for k in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203].lang_pred in model.names and got[None].held_out is False
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "wrong").otherwise(F.col("lang")))
    assert language_id.fit(changed).names == ["one", "two"]
    nothing = language_id.fit(docs.filter("doc_id < 0"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.filter("doc_id < 0"), model).count() == 0


def test_held_out_accuracy_on_a_whole_small_table(spark, sf):
    found = queries.op13_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 0
