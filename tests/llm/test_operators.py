"""The operators against brute force, on awkward rows, empty tables and whole small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sourceloom.llm import components, decontaminate, mixing, multi_index, near_dup, perfect_hash, quality, queries, repeats, reshard, token_ids, toxicity, warc
from sourceloom.llm.induced_sort import equal_groups, suffix_order
from tests.llm import docs as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(low)


# ------------------------------------------------------------------ resharding


@pytest.mark.parametrize("seed", range(6))
def test_transfers_move_the_fewest_bytes(seed):
    r = random.Random(seed)
    sizes = [r.randint(0, 60) for _ in range(r.randint(1, 6))]
    caps = reshard.capacities(sum(sizes), r.randint(1, 6))
    plan = reshard.plan_transfers(sizes, caps)
    assert [sum(b for i, _, b in plan if i == k) for k in range(len(sizes))] == sizes
    assert [sum(b for _, j, b in plan if j == k) for k in range(len(caps))] == caps
    moved = sum(b for i, j, b in plan if i != j)
    assert moved == sum(sizes) - sum(min(s, c) for s, c in zip(sizes, caps, strict=False))


def test_resharding_places_every_row_once(spark):
    from pyspark.sql import functions as F

    docs = D.frame(spark)
    rows = reshard.reshard(docs, 5, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in D.rows())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard in by.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    text_of = {r[0]: r[1] for r in D.rows() if r[0] not in (None, 3, 4)}
    for r in rows:
        if r.doc_id in text_of:
            raw = (text_of[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_whole_small_table_is_spread_evenly(spark, sf):
    rows = queries.op1_sharding(spark, sf).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    largest = max(r["size"] for r in rows)
    total = sum(size.values())
    assert set(size) <= set(range(40)) and all(abs(size[k] - total / 40) <= largest + 1 for k in range(40))


def test_rewriting_touches_only_changed_shards(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "x" * 84, f"f{i // 10}") for i in range(30)] + [(99, "x" * 184, "f3")], "doc_id long, text string, file string")
    placed = reshard.reshard(docs, 3, F.col("file"))
    done = reshard.rewrite(docs, placed, ["f0", "f1", "f2", "f3"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == placed.filter(F.col("shard").isin(done)).count()


@pytest.mark.parametrize("by_row", [False, True])
def test_rewriting_keeps_null_and_repeated_ids(spark, tmp_path, by_row):
    from pyspark.sql import functions as F

    data = [([None, 7, i, i][i % 4], f"text {i % 11} of {i // 3} " * (1 + i % 5), None if i % 6 == 0 else f"f{i % 3}", i, 9) for i in range(120)]
    data += [(None, "same", "f1", 200 + i, 9) for i in range(40)] + [(None, None, None, 300, 9), (7, None, "f0", 301, 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, file string, row long, shard int").repartition(3)
    row_id = F.col("row") if by_row else None
    placed = reshard.reshard(docs, 4, F.col("file"), row_id)
    names = reshard.shard_names(placed)
    assert names == ["f0", "f1", "f2", None]
    done = reshard.rewrite(docs, placed, names, str(tmp_path / "out"), *([F.col("file"), row_id] if by_row else []))
    assert done == [0, 1, 2, 3]
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text, r.file, r.row, r.shard) for r in rows) == Counter(data)
    raw = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, len(raw(r)) + 16, zlib.crc32(raw(r)), r.shard_, r.slot) for r in rows) == Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in placed.collect())


def test_the_sharding_query_reads_back_rewritten_files(spark, tmp_path):
    folder = D.write(spark, tmp_path)
    found = queries.op1_sharding(spark, folder)
    files = [f for f in found.inputFiles() if "reshard-files" in f]
    assert files and all("/shard_=" in f for f in files)  # the table has a column shard
    rows = spark.read.parquet(*{f.split("/shard_=")[0] for f in files})
    assert Counter((r.doc_id, r.text) for r in rows.collect()) == Counter((r[0], r[1]) for r in D.rows())
    raw = [(r[0], (r[1] or "").encode()) for r in D.rows()]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found.collect()) == Counter((i, len(x) + 16, zlib.crc32(x)) for i, x in raw)


def test_files_that_fit_stay_where_they_are(spark, tmp_path):
    docs = [spark.createDataFrame([(10 * k + i, "x" * 84) for i in range(4 if k < 2 else 2)], "doc_id long, text string").coalesce(1) for k in range(4)]
    for k, part in enumerate(docs):
        part.write.parquet(str(tmp_path / f"f{k}"))
    whole = spark.read.parquet(*[str(tmp_path / f"f{k}") for k in range(4)])
    found = reshard.reshard_files(whole, 3, str(tmp_path / "out"))
    rows = found.collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows if r.shard < 2) == [(10 * k + i, k, i) for k in range(2) for i in range(4)]
    assert sorted((r.doc_id, r.shard) for r in rows if r.shard == 2) == [(i, 2) for i in (20, 21, 30, 31)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["shard=2"]


def test_the_planner_is_linear_in_files():
    r = random.Random(8)
    sizes = [r.randint(0, 1000) for _ in range(20_000)]
    caps = reshard.capacities(sum(sizes), 19_000)
    plan = reshard.plan_transfers(sizes, caps)  # minutes if it were quadratic
    assert sum(b for i, j, b in plan if i != j) == sum(sizes) - sum(min(s, c) for s, c in zip(sizes, caps, strict=False))


def test_rows_without_an_id_fill_many_pieces(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(None, f"text {i}") for i in range(200)] + [(5, "same")] * 100, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    rows = reshard.reshard(docs, 3, F.lit("f"), F.col("row")).collect()
    assert len({r.piece for r in rows if r.doc_id is None}) > 100 and len({r.piece for r in rows if r.doc_id == 5}) > 50


def test_resharding_an_empty_table(spark):
    from pyspark.sql import functions as F

    assert reshard.reshard(D.frame(spark, []), 4, F.lit("f")).count() == 0


# ------------------------------------------------------------- near-duplicates


def cells_of(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    texts = sorted({t for _, t in rows if t is not None})
    cells = {t: cells_of(t) for t in texts}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            union = sum((cells[a] | cells[b]).values())
            if union and sum((cells[a] & cells[b]).values()) >= 0.8 * union:
                parent[find(a)] = find(b)
    ids = defaultdict(list)
    for d, t in rows:
        if t is not None and d is not None:
            ids[find(t)].append(d)
    return {(d, t): (d if t is None else min(ids[find(t)], default=None)) for d, t in rows}


def test_near_duplicates_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in D.rows()]
    found = near_dup.near_duplicates(D.frame(spark)).collect()
    expected = brute_classes(rows)
    key = {t: hashlib.md5(t.encode()).digest() for _, t in rows if t is not None}
    want = Counter((d, key.get(t), expected[(d, t)]) for d, t in rows)
    assert Counter((r.doc_id, None if r.text_key is None else bytes(r.text_key), r.class_id) for r in found) == want


def test_one_of_each_keeps_columns_and_single_rows(spark):
    kept = near_dup.one_of_each(D.frame(spark))
    assert kept.columns == D.frame(spark).columns
    rows = kept.collect()
    count = Counter((r.doc_id, r.text) for r in rows)
    assert max(v for (d, t), v in count.items()) == 1
    ids = [r.doc_id for r in rows]
    assert 3 in ids and 15 in ids and not {12, 13, 14, None} & set(ids)


def test_a_large_near_group_and_outsiders(spark):
    r = random.Random(3)
    base = D.prose(1, 150).split()
    data = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(r.randint(1, 14)):
            w[r.randrange(len(w))] = f"v{r.random()}"
        data.append((i, " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    expected = brute_classes(data)
    assert sum(expected[(x.doc_id, data[x.doc_id][1])] != x.class_id for x in found) == 0


def packed(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("heavy", [False, True])
def test_dart_signatures_estimate_weighted_similarity(heavy):
    a, b = D.prose(5, 400).split(), D.prose(5, 400).split()
    b[100:140] = D.prose(6, 40).split()
    if heavy:  # shingles of weights up to 90
        a, b = a[:50] + ["x", "y", "z"] * 90 + a[50:], b[:50] + ["x", "y", "z"] * 60 + b[50:]
    owner, value = near_dup.shingles(*packed(" ".join(a), " ".join(b)))
    text, element, weight = near_dup.weighted(owner, value)
    s = near_dup.dart_signatures(text, element, weight, 2, 2000)
    p, q = cells_of(" ".join(a)), cells_of(" ".join(b))
    assert sorted(weight[text == 0]) == sorted(p.values()) and weight.max() == max(p.values())
    true = sum((p & q).values()) / sum((p | q).values())
    assert abs((s[0] == s[1]).mean() - true) < 0.05
    cell = near_dup.cells(owner, value)
    assert len(np.intersect1d(cell[owner == 0], cell[owner == 1])) == sum((p & q).values())
    assert (near_dup.dart_signatures(text, element, weight / 4, 2, 2000)[0] == s[0]).mean() < 1  # any positive weights


def thue_morse(n, swap=False):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_long_words_with_one_polynomial_hash_differ():
    from sourceloom.llm import words as W

    for n in (1024, 2048):
        data, offs = packed(thue_morse(n), thue_morse(n, True))
        h = W.SpanHasher(data)(offs[:-1], offs[1:])
        assert h[0] == h[1]  # the weakness
        assert len(set(W.words(data, offs).hashes.tolist())) == 2


def test_near_duplicates_of_a_whole_table(spark):
    """Classes of sf0.01 against all pairs that share a shingle."""
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    found = {(r.doc_id): r.class_id for r in near_dup.near_duplicates(spark.read.parquet(path)).collect()}
    texts = sorted({t for _, t in rows if t is not None})
    cells = [cells_of(t) for t in texts]
    size = [sum(c.values()) for c in cells]
    at = defaultdict(list)
    for i, c in enumerate(cells):
        for k in c:
            at[k].append(i)
    shared = Counter()
    for own in at.values():
        shared.update((i, j) for n, i in enumerate(own) for j in own[n + 1 :])
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in shared:
        both = sum((cells[i] & cells[j]).values())
        if both >= 0.8 * (size[i] + size[j] - both):
            parent[find(i)] = find(j)
    first = {}
    place = {t: i for i, t in enumerate(texts)}
    for d, t in rows:
        if t is not None:
            first[find(place[t])] = min(d, first.get(find(place[t]), d))
    assert found == {d: d if t is None else first[find(place[t])] for d, t in rows}


@pytest.mark.parametrize("cell_rows", [4096, 5])
def test_near_groups_in_one_bucket(spark, monkeypatch, cell_rows):
    """Groups of near copies around one passage, whose members share bands with other groups; a cell's members in one block or in several."""
    monkeypatch.setattr(near_dup, "CELL_ROWS", cell_rows)
    r = random.Random(11)
    base = D.prose(70, 120).split()
    data = []
    for g in range(12):
        own = base[:84] + D.prose(100 + g, 36).split()  # groups are 0.55 alike
        for _ in range(8):
            w = list(own)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"v{r.random()}"
            data.append((len(data), " ".join(w)))
    found = near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    expected = brute_classes(data)
    assert {x.doc_id: x.class_id for x in found} == {d: expected[(d, t)] for d, t in data}


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dup.near_duplicates(D.frame(spark, [])).count() == 0
    assert near_dup.one_of_each(D.frame(spark, [])).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.item: r.label for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {got[0]} and got[100] == got[101] == got[103] != got[0]


# --------------------------------------------------------------------- repeats


def test_suffixes_are_sorted_to_depth():
    r = np.random.default_rng(1)
    for _ in range(60):
        text = np.append(r.integers(0, r.integers(2, 6), r.integers(1, 300)), 0).astype(np.uint8)
        order = suffix_order(text, 20)
        raw = text.tobytes()
        keys = [raw[i : i + 20].ljust(20, b"\0") for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        group = equal_groups(text, order, 20)
        assert all((group[i] == group[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        b, d = (t or "").encode(), repeats._NULL_ID if d is None else d
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(d, first.get(b[k : k + 50], d))
    out = Counter()
    for d, t in rows:
        b, own = (t or "").encode(), repeats._NULL_ID if d is None else d
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < own:
                gone[k : k + 50] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(left).hexdigest())] += 1
    return out


def test_repeats_match_brute_force(spark):
    rows = [(r[0], r[1]) for r in D.rows()]
    assert Counter(tuple(r) for r in repeats.remove_repeats(D.frame(spark)).collect()) == brute_repeats(rows)


def test_repeats_of_overlapping_passages(spark):
    r = random.Random(9)
    text = "".join(r.choices("abcdefgh ", k=400))
    rows = [(5, text), (2, text[100:300]), (9, "z" * 30 + text[250:340] + "q" * 70 + "z" * 30), (1, "q" * 55), (7, text[:49]), (8, text[351:])]
    got = Counter(tuple(x) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(D.frame(spark, [])).count() == 0


# ------------------------------------------------------------- decontamination


def test_repeats_with_null_ids_in_many_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    passage = [D.prose(500 + i, 30) for i in range(12)]
    rows = []
    for i, p in enumerate(passage):  # a batch with a null id and document i, and one with null ids only
        rows += [(None, f"{p} first {i}"), (i, f"second {i} {p}"), (None, f"third {i} {p}"), (None, f"fourth {i}")]
        rows += [(77, f"fifth {i} {D.prose(600 + i, 30)}"), (78, f"sixth {i} {D.prose(600 + i, 30)}"), (77, f"{D.prose(600 + i, 30)} seventh {i}"), (77, "eighth")]
    spark.conf.set(key, "2")
    try:
        got = Counter(tuple(x) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    finally:
        spark.conf.set(key, before)
    assert got == brute_repeats(rows)


def test_a_hot_string_spreads_over_many_groups(spark, monkeypatch):
    phrase, longer = "twenty-six bytes, no more.", D.prose(700, 40)
    rows = [([None, 5, i][i % 3 if i % 7 else 2], f"{D.prose(800 + i, 12)} {phrase} {D.prose(800 + i // 2 * 2, 9 + i % 5)}" + f" {longer}" * (i % 4 == 0)) for i in range(90)]
    judged = []
    real = repeats._hot_windows
    monkeypatch.setattr(repeats, "HOT_BYTES", 2000)
    monkeypatch.setattr(repeats, "_hot_windows", lambda texts, slots, hot: judged.append(len(hot)) or real(texts, slots, hot))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(x) for x in repeats.remove_repeats(docs).collect())
    assert judged and judged[0] >= 1
    assert got == brute_repeats(rows)
    monkeypatch.setattr(repeats, "HOT_BYTES", 0)  # all windows one by one
    assert Counter(tuple(x) for x in repeats.remove_repeats(D.frame(spark)).collect()) == brute_repeats([(r[0], r[1]) for r in D.rows()])


def test_repeats_don_t_trust_hashes(spark, monkeypatch):
    """With hashes that only tell lengths, and a long text, results are the same."""

    class Weak:
        def __init__(self, data):
            pass

        def __call__(self, starts, ends):
            return (ends - starts).astype(np.uint64)

    a, b = D.prose(40, 60), D.prose(41, 60)
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, a[:150] + b[:150]), (5, thue_morse(2048)), (6, thue_morse(2048, True)), (7, D.prose(42, 190_000)), (8, D.prose(42, 40) + a)]
    assert len(rows[6][1]) > 1 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_repeats(rows)
    monkeypatch.setattr(repeats, "SpanHasher", Weak)
    assert Counter(tuple(x) for x in repeats.remove_repeats(docs).collect()) == want
    monkeypatch.setattr(repeats, "HOT_BYTES", 0)
    assert Counter(tuple(x) for x in repeats.remove_repeats(docs).collect()) == want


def brute_hits(rows, items):
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(item)
    sizes = {len(k) for k in windows}
    out = Counter()
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out[(d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_matches_brute_force(spark, block_bytes):
    base = D.rows()
    items = [(1, D.prose(4, 60)), (2, "WORD"), (10, base[6][1]), (11, base[6][1]), (7, None), (8, "..."), (9, "one two"), (12, " ".join(base[8][1].split()[10:22]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.digest(decontaminate.find_hits(D.frame(spark), bench, block_bytes=block_bytes)).collect())
    want = brute_hits([(r[0], r[1]) for r in base], items)
    assert got == want
    clean = decontaminate.drop_contaminated(D.frame(spark), bench, block_bytes=block_bytes)
    assert clean.count() == sum(v for k, v in want.items() if not k[5]) and clean.columns == D.frame(spark).columns


def test_decontamination_with_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.find_hits(D.frame(spark), bench)).filter("contaminated").count() == 0
    assert decontaminate.find_hits(D.frame(spark, []), bench).count() == 0


# ------------------------------------------------------------------------ warc


@pytest.mark.parametrize("block_bytes", [1, 1 << 30])
def test_benchmark_items_without_an_id(spark, block_bytes):
    a, b, c = (D.prose(900 + i, 14) for i in range(3))
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} {c}"), (3, "clean"), (None, f"{a} {b}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, c), (8, b), (9, None), (None, None)], "item_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = decontaminate.digest(decontaminate.find_hits(docs, items, block_bytes=block_bytes)).collect()
    assert {r.doc_id: tuple(r)[2:] for r in rows} == {1: (14, 1, sha(""), True), 2: (28, 2, sha("8"), True), 3: (0, 0, sha(""), False), None: (28, 2, sha("8"), True)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items, block_bytes=block_bytes).collect()] == [3]


def brute_warc(rows):
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    top = {}
    for p, b in raw:
        if p is not None and len(b) >= 1000:
            top[b] = max(p, top.get(b, p))
    return Counter((p, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", top[b]) if p is not None and p < top.get(b, p) else ("response", None))) for p, b in raw)


def test_archives_come_back(spark, tmp_path):
    big, small = "<p>" + "é" * 900 + "</p>", "<p>small</p>"
    rows = [(i, f"http://x/{i}", D.prose(i, 60)) for i in range(40)] + [(100, "http://a b/\r\nX: 1", big), (101, None, big), (102, "u", big), (102, "u", big), (103, "v", small), (104, "v", small), (105, "n", None), (None, "w", big), (106, "e", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", __import__("pyspark").sql.functions.lit("clash"))
    path = warc.write_archives(pages, str(tmp_path / "w"))
    assert Counter(tuple(r) for r in warc.read_archives(spark, path).collect()) == brute_warc(rows)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i % 50, f"http://x/{i}", D.prose(i % 40, 300)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=20_000)
    assert Counter(tuple(r) for r in warc.read_archives(spark, path).collect()) == brute_warc(rows)
    assert len([p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]) > 10


def test_empty_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "w"))).count() == 0


def test_damaged_records_are_refused():
    good = warc.encode_record(1, "http://x/", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    assert warc.decode_record(good)[:2] == (1, 3)
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), b"WARC/1.0" + good[8:]):
        with pytest.raises((ValueError, KeyError)):
            warc.decode_record(bad)


# ------------------------------------------------------------------- token ids


def test_token_shards_come_back(spark, tmp_path):
    from tokenizers import Tokenizer

    text = queries.tokenizer_json()
    tokenizer = Tokenizer.from_str(text)
    extra = [(200 + i, t, "", "", 0, *D.EXTRA) for i, t in enumerate(["It's 'strong <|endoftext|> O'Neil", "ÀÉß×÷ naïve é … x　y", "a\x1cb c", "<|x|>12,345.6"])]
    rows = D.rows() + extra
    path = token_ids.write_shards(D.frame(spark, rows), text, str(tmp_path / "t"))
    got = token_ids.read_shards(path, spark).collect()
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    at, want = 0, Counter()
    for d, t in ordered:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want[(d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in got) == want


def test_words_with_one_hash_and_long_texts_get_their_own_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    text = queries.tokenizer_json()
    tokenizer = Tokenizer.from_str(text)
    rows = [(i, t) for i, t in enumerate([thue_morse(1024), thue_morse(1024, True), thue_morse(2048), thue_morse(2048, True), D.prose(43, 190_000), "a" * 15 + " " + "a" * 16, "ab" * 7 + "\u00e9"])]
    path = token_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), text, str(tmp_path / "t"))
    got = {r.doc_id: r.ids_crc32 for r in token_ids.read_shards(path, spark).collect()}
    assert got == {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows}


def test_lookup_through_the_index(spark, tmp_path):
    from tokenizers import Tokenizer

    text = queries.tokenizer_json()
    tokenizer = Tokenizer.from_str(text)
    rows = [(i // 2 if i < 400 else None, f"{D.prose(i, 6)} {i}") for i in range(600)]
    path = token_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), text, str(tmp_path / "t"))
    token_ids.write_index(spark, path)
    index = spark.read.parquet(f"{path}/{token_ids.INDEX}").collect()
    assert sum(r.rows for r in index) == 600
    assert len({r.file for r in index}) > 1
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_ids.lookup(spark, path, [0, 77, 199, 5000]).collect())
    assert got == Counter((d, (*tokenizer.encode(t, add_special_tokens=False).ids, 2)) for d, t in rows if d in (0, 77, 199))
    assert token_ids.lookup(spark, path, [9999]).count() == 0


def test_shard_lookup_by_key():
    keys = np.array([0, 3, 3, 9, 12], np.int64)
    null = np.array([True, False, False, False, False])
    offsets = np.array([0, 1, 3, 4, 6, 7])
    raw = token_ids.pack_shard(keys, null, offsets, np.arange(7, dtype=np.uint16), (4, 1))
    shard = token_ids.Shard(memoryview(raw))
    assert [x.tolist() for x in shard.ids_of(3)] == [[1, 2], [3]] and [x.tolist() for x in shard.ids_of(12)] == [[6]]
    assert shard.ids_of(5) == [] and shard.ids_of(0) == []
    with pytest.raises(ValueError):
        token_ids.Shard(memoryview(raw[:-6] + b"\0\1" + raw[-4:]))


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64)
    slots = perfect_hash.slots(perfect_hash.build_levels(keys), keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_token_shards_of_an_empty_table(spark):
    assert token_ids.read_shards(token_ids.write_shards(D.frame(spark, []), queries.tokenizer_json()), spark).count() == 0


# ---------------------------------------------------------- nearest neighbours


def test_neighbours_on_awkward_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(260, 8)).astype(np.float32)
    x[40:90] = x[40]  # a hot vector
    data = [(i, [float(v) for v in x[i]], "c") for i in range(260)]
    data += [(300, None, "c"), (400, [0.0] * 8, "c"), (500, [float("nan")] * 8, "c"), (600, [1.0, None] + [0.0] * 6, "c"), (700, [float("inf")] * 8, "c"), (None, [1.0] * 8, "c"), (800, [1.0, 2.0], "c"), (900, [1.0, 2.5], "c"), (100, data[100][1], "c"), (1000, [], "c")]
    got = multi_index.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>, class string")).collect()
    usable = {d: np.array(v, np.float64) for d, v, _ in data if d is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    by = defaultdict(list)
    for row in got:
        by[row.query_id].append((row["rank"], row.score, row.vec_id))
    assert set(by) == {d for d in usable if d % 100 == 0}
    hits = total = 0
    for q, found in by.items():
        true = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), d) for d, v in usable.items() if d != q and len(v) == len(usable[q]))[:10]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, len(true) + 1))
        hits += len({d for _, d in true} & {f[2] for f in found})
        total += len(true)
        assert all(abs(f[1] - float(np.sqrt(((usable[f[2]] - usable[q]) ** 2).sum()))) < 1e-12 for f in found)
    assert hits / total >= 0.9


def test_queries_in_lots_find_the_same(spark, monkeypatch):
    r = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, r.normal(size=16).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, multi_index.nearest(frame, 5, 4).collect()))
    monkeypatch.setattr(multi_index, "QUERY_ROWS", 7)
    monkeypatch.setattr(multi_index, "GROUP_ROWS", 100)
    assert sorted(map(tuple, multi_index.nearest(frame, 5, 4).collect())) == whole and len(whole) == 750


def test_recall_on_the_whole_small_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    got = defaultdict(set)
    for r in queries.op8_nearest(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


def test_probing_finds_every_code_once():
    subs = np.random.default_rng(5).integers(0, 1 << 16, (400, 4)).astype(np.uint16)
    buckets = [multi_index.Buckets(subs, j) for j in range(4)]
    counts = np.stack([np.bincount(subs[:, j] >> 13, minlength=8) for j in range(4)])
    layout = multi_index.Layout(counts, 3, 20)
    groups = [layout.group(j, subs[:, j], np.arange(400)) for j in range(4)]
    assert all(layout.substring_of(g) == j for j in range(4) for g in groups[j].tolist())
    assert max(np.unique(np.concatenate(groups), return_counts=True)[1]) <= 40
    for radius in (0, 3, 9, 20, 30, 64):
        code = subs[7] ^ np.uint16(5)
        want = [i for i in range(400) if sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(subs[i], code, strict=True)) <= radius]
        found = [b.within(code, radius) for b in buckets]
        assert sorted(np.concatenate(found).tolist()) == want
        probed = set(layout.probed(code, radius // 4).tolist())
        assert all(groups[j][i] in probed for j in range(4) for i in found[j])


def test_neighbours_in_many_groups_and_of_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "GROUP_ROWS", 16)
    r = np.random.default_rng(6)
    centres = r.normal(size=(6, 16))
    x = centres[r.integers(0, 6, 500)] + 0.1 * r.normal(size=(500, 16))
    x[450:480] *= 1e200
    x[480:] *= 1e-200
    rows = [(i, x[i].tolist()) for i in range(500)] + [(600, (x[470] * 1.5).tolist()), (700, (x[490] * 1.5).tolist())]
    got = defaultdict(list)
    for row in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[row.query_id].append((row["rank"], row.score, row.vec_id))
    assert set(got) == {0, 100, 200, 300, 400, 600, 700}
    hits = 0
    for q, found in got.items():
        own = np.array(dict(rows)[q])
        true = sorted((float(np.hypot.reduce(np.array(v) - own)), i) for i, v in rows if i != q)[:10]
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        assert all(np.isclose(s, np.hypot.reduce(np.array(dict(rows)[v]) - own), rtol=1e-9, atol=0) for _, s, v in found)
        hits += len({i for _, i in true} & {f[2] for f in found})
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_of_an_empty_table(spark):
    assert multi_index.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ----------------------------------------------------------------- classifiers


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_awkward_rows(spark, module, label):
    for marks in ([(i, i % 2, i % 2) for i in range(20)], [], [(1, 1, 1)], [(None, 1, 0), (2, None, None)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        rows = module.score(D.frame(spark), module.fit(D.frame(spark), labels)).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in D.rows())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert module.score(D.frame(spark, []), module.fit(D.frame(spark, []), labels)).count() == 0


def test_toxicity_learns_a_pair_of_terms(spark):
    r = random.Random(1)
    rows, y = [], []
    for i in range(600):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.unique(np.array([10 + r.randrange(20), *([1] if a else []), *([2] if b else [])])))
        y.append(int(a and b))
    model = toxicity.fit_machine(rows, np.array(y), steps=400)
    z = [model.raw(*model.pairs(np.zeros(len(t), np.int64), np.array(t)), 1)[0] for t in ([1], [2], [1, 2])]
    assert z[0] < 0 and z[1] < 0 and z[2] > 0


def test_toxicity_learns_exactly_one_of_two_terms():
    """Neither term tells anything alone."""
    r = random.Random(1)
    rows, y = [], []
    for _ in range(800):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.unique(np.array([*(10 + r.randrange(60) for _ in range(8)), *([1] if a else []), *([2] if b else [])])))
        y.append(int(a != b))
    model = toxicity.fit_machine(rows, np.array(y))
    assert len(model.w) < 10
    z = [model.raw(*model.pairs(np.zeros(len(t), np.int64), np.array(t)), 1)[0] for t in ([20], [1], [2], [1, 2])]
    assert z[0] < 0 and z[1] > 0 and z[2] > 0 and z[3] < 0


def test_toxicity_scores_match_a_plain_loop(spark, sf):
    """The query's scores, from the fitted weights term by term and pair by pair."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op4_toxicity(spark, sf).collect()}
    for r in docs.select("doc_id", "text").limit(60).collect():
        _, term = toxicity.terms(*packed(r.text or ""))
        active = sorted({int(model.place[t]) for t in term.tolist()} - {-1})
        z = model.w0 + sum(float(model.w[i]) for i in active)
        for n, i in enumerate(active):
            for j in active[n + 1 :]:
                z += sum(float(a) * float(b) for a, b in zip(model.v[i], model.v[j], strict=True))
        score = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.3)


def test_quality_scores_match_a_plain_walk(spark, sf):
    """The query's scores, from the fitted trees node by node."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op9_quality(spark, sf).collect()}
    for r in docs.select("doc_id", "text").limit(60).collect():
        x = quality.statistics(*packed(r.text or ""))[0]
        z = model.base
        for feature, cut, leaf in zip(model.feature.tolist(), model.cut.tolist(), model.leaf.tolist(), strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
            z += leaf[node - len(feature)]
        score = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.7)


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    scored = queries.QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", label).collect()
    assert sum(a == b for a, b in scored) / len(scored) >= least


# ---------------------------------------------------------------------- mixing


def brute_quotas(targets, seats):
    got = [0] * len(targets)
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_quotas_are_those_of_the_highest_quotients(spark):
    for targets in ([5000.0, 333.0, 70.5, 1.0], [64.0, 64.0], [10.0, 3.0, 0.0]):
        rows = [(i + 1, t) for i, t in enumerate(targets)]
        got = mixing.sainte_lague(spark.createDataFrame(rows, "place int, target double")).orderBy("place").collect()
        assert [r.quota for r in got] == brute_quotas(targets, round(sum(targets) / mixing.BLOCK))


def test_mixing_on_awkward_rows(spark):
    rows = mixing.mix(D.frame(spark), block=4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in D.rows())
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == size[r.source] for r in rows)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert all(t <= 3 * size[s] + 1e-9 for s, t in target.items())
    assert all(abs(taken[s] - target[s]) <= 12 for s in target)
    again = mixing.mix(D.frame(spark), block=4).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))


def test_mixture_repeats_whole_documents(spark):
    out = mixing.mixture(D.frame(spark))
    assert out.columns == D.frame(spark).columns and max(Counter(r.doc_id for r in out.collect() if r.doc_id not in (None, 3, 4)).values()) <= 3
    assert mixing.mixture(D.frame(spark, [])).count() == 0 and mixing.mix(D.frame(spark, [])).count() == 0


def test_rows_without_an_id_spread_over_pieces_and_runs_agree(spark):
    rows = [(None, D.prose(k % 700, 3), "en", "s", 0, *D.EXTRA) for k in range(900)] + [(k, D.prose(k, 5), "en", "t", 0, *D.EXTRA) for k in range(60)]
    taken = []
    for parts in (1, 5):
        mixed = mixing.mix(D.frame(spark, rows).repartition(parts), block=4, carry=True)
        taken.append(Counter((r.row.text, r.taken) for r in mixed.collect()))
    assert taken[0] == taken[1] and sum(taken[0].values()) == len(rows)
    texts = sorted(r.text for r in mixing.mixture(D.frame(spark, rows), block=4).collect())
    assert texts == sorted(r.text for r in mixing.mixture(D.frame(spark, rows[::-1]).repartition(4), block=4).collect())


def test_blocks_of_repeated_and_long_items(spark):
    items = [(7, "one two three " * 8)] * 2000 + [(k, f"item {k} " * 5) for k in range(300)] + [(None, None), (999, "x y " * 900)]
    blocks = list(decontaminate._blocks(spark.createDataFrame(items, "item_id long, text string"), 1000))
    assert sorted((r for b in blocks for r in b), key=str) == sorted(set(items), key=str)
    assert all(len(b) == 1 or sum(len(t or "") + 16 for _, t in b) <= 1000 for b in blocks) and len(blocks) > 10
    assert list(decontaminate._blocks(spark.createDataFrame([], "item_id long, text string"), 10)) == [[]]


def test_labelled_rows_are_bounded_with_repeated_ids(spark):
    from sourceloom.llm.labelled import labelled_sample

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(k, "other") for k in range(3, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(k, k % 2) for k in range(3, 40)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 10).count() <= 10
    whole = labelled_sample(docs, labels, "toxic", 1000)
    assert whole.count() == len({k for k in (1, *range(3, 40)) if zlib.crc32(str(k).encode()) % 4 != 2})
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in labelled_sample(docs.repartition(7), labels, "toxic", 1000).collect()}
