"""Corpus operators against brute force: special tokens, short texts, repeated and null ids, renamed items, chains of three categories."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wanderlake.llm import decontam, fingerprint, neardup, packing, quality, queries, sharding, toxicity
from wanderlake.llm import features as ft
from wanderlake.llm import text as tx

from .test_llm import DOCS, SF, prose


def test_ids_of_an_unaltered_tokenizer():
    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["<|endoftext|>", "a<|endoftext|>b", "no end", "", "x <|endoftext", "漢<|endoftext|>"]
    got = packing.token_ids(packing._encoder(queries.tokenizer_path()), pa.array(texts))
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0].tolist() == [50256]


def test_plan_of_a_whole_table_comes_from_indexed_sums(spark):
    cut = packing.pieces(spark.read.parquet(f"{SF}/documents.parquet"), queries.tokenizer_path())
    histogram = dict(map(tuple, cut.groupBy("length").count().collect()))
    plan = packing.plan(histogram)
    assert sum(n for _, n in plan) <= 193
    # Sequences that end in two or three short pieces and are exactly full.
    filled = [x for x, _ in plan if sum(x) == 1024 and len(x) > 2 and sum(k < 64 for k in x) >= 2]
    assert filled


def test_long_words_that_fool_a_polynomial():
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    word, _ = tx.words(pa.array([a, a.translate(str.maketrans("ab", "ba")), a]))
    assert word[0] != word[1] and word[0] == word[2]


def test_fingerprints_of_short_texts():
    words = [f"w{i}" for i in range(400)]
    one = fingerprint.fingerprints(pa.array([" ".join(words[i : i + 3]) for i in range(0, 120, 3)] + ["", " "]))
    for i, j in itertools.combinations(range(40), 2):
        assert fingerprint.likeness(one[i : i + 1], one[j : j + 1])[0] < 0.3
    assert fingerprint.likeness(one[40:41], one[41:42])[0] == 1 and not fingerprint.likeness(one[:40], np.repeat(one[40:41], 40, axis=0)).any()
    r, errors = random.Random(4), []
    for n in range(1, 21):
        for _ in range(20):
            a, b = ([r.choice(words) for _ in range(n + 4)] for _ in range(2))
            b[: r.randrange(n + 5)] = a[: len(b)][: r.randrange(n + 5)]
            sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b)]
            f = fingerprint.fingerprints(pa.array([" ".join(a), " ".join(b)]))
            errors.append(fingerprint.likeness(f[:1], f[1:])[0] - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.03


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    owner, shingle, count, n = neardup.weighted(pa.array(list(rows.values())))
    sets = [(shingle[owner == i], count[owner == i]) for i in range(n)]
    ids, texts = list(rows), list(rows.values())
    links = [(a, b) for a, b in itertools.combinations(range(n), 2) if texts[a] == texts[b] or neardup.similarity(sets[a], sets[b]) >= neardup.LEAST]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    want = collections.defaultdict(list)
    for i in range(n):
        want[root(i)].append(ids[i])
    got = collections.defaultdict(list)
    for r in neardup.near_duplicates(docs).collect():
        got[r.class_id].append(r.doc_id)
    assert all(min(v) == k for k, v in got.items())
    pairs = lambda groups: {p for g in groups for p in itertools.combinations(sorted(g), 2)}
    found, all_pairs = pairs(got.values()), pairs(want.values())
    assert found <= all_pairs and len(found) >= 0.9 * len(all_pairs) > 0


def test_null_and_repeated_ids_keep_their_texts(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(None, a), (None, b), (5, prose(60, 3)), (5, prose(60, 4)), (7, a), (8, a), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], DOCS + ", class_id int").withColumnRenamed("class_id", "label")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == collections.Counter([(7, a), (None, b), (5, rows[2][1]), (5, rows[3][1]), (9, "")])
    assert neardup.near_duplicates(docs).count() == len(rows)


def test_more_texts_than_a_chunk_has(spark):
    docs = spark.createDataFrame([(i, f"short text number {i % 4500} of many") for i in range(5000)], "doc_id long, text string").coalesce(1)
    classes = neardup.near_duplicates(docs).collect()
    assert len(classes) == 5000 and len({r.class_id for r in classes}) == 4500


def test_items_with_other_names_numbers_and_units(spark):
    items = [
        "Mary has 5 apples. Tom has 3 apples. How many apples do both of them have together in the end?",
        "At 3 pm there were five wagons on the track, and it took two hours until all of them had left the yard.",
    ]
    changed = [
        "Susan has 7 apples. Peter has 4 apples. How many apples do both of them have together in the end?",
        "At 4 pm there were six wagons on the track, and it took three hours until all of them had left the yard.",
    ]
    broken = "Susan has 7 apples. Peter has 4 pears. Who knows how many fruits and trees do grow in this garden?"
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    long = f"{prose(3000, 8)}. {changed[1]} {prose(3000, 9)}"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in enumerate([*changed, broken, long, *items])], DOCS + ", item_id string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert found == {(0, 0), (1, 1), (3, 1), (4, 0), (5, 1)}
    assert [r.doc_id for r in decontam.keep_clean(docs.withColumnRenamed("lang", "bad_id"), bench).collect()] == [2]


def test_items_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "WINDOWS_BROADCAST", 0)
    monkeypatch.setattr(decontam, "IDS_BROADCAST", 0)
    monkeypatch.setattr(neardup, "IDS_BROADCAST", 0)
    test_items_with_other_names_numbers_and_units(spark)
    test_null_and_repeated_ids_keep_their_texts(spark)


def test_shards_against_an_independent_fill(spark):
    """The table is filled again by plain lists of preferences, and rows are placed by it."""
    import hashlib

    names, size = [f"s{i}" for i in range(7)], 1009
    h = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    wishes = {s: [(h(s, "offset") % size + j * (h(s, "skip") % (size - 1) + 1)) % size for j in range(size)] for s in names}
    owner: dict[int, str] = {}
    while len(owner) < size:
        for s in names:
            slot = next((x for x in wishes[s] if x not in owner), None)
            if slot is not None:
                owner[slot] = s
    df = spark.createDataFrame([(i, "x") for i in range(300)] + [(None, "x"), (5, "x")], "doc_id long, slot string")
    rows = sharding.assign(df, "doc_id", names, size, "place", "owner").collect()
    assert len(rows) == 302 and all(r.owner == owner[r.place] for r in rows)
    assert sharding.assign(df.limit(0), "doc_id", names, size, "place", "owner").count() == 0


def test_chain_of_three_categories():
    """The last category follows from the first two alone, so the chain's earlier probabilities must reach it."""
    r = np.random.default_rng(1)
    y1, y2 = r.integers(0, 2, 1200), r.integers(0, 2, 1200)
    y3 = y1 & y2
    texts = pa.array([prose(30, i) + (" vile" if a else "") + (" threat" if b else "") for i, (a, b) in enumerate(zip(y1, y2, strict=True))])
    x = ft.Sparse(*ft.tokens(texts))
    y = np.stack([y1, y2, y3], axis=1)
    half = np.arange(600)
    chain = toxicity.Chain().fit(x.take(half), y[:600], ft.folds(half, 4), [0.5, 0.5, 0.25])
    p = chain.predict(x.take(half + 600))
    assert [len(m.w) - len(m.kept) for m in chain.models] == [len(ft.SHAPE), len(ft.SHAPE) + 1, len(ft.SHAPE) + 2]
    assert np.mean((p >= 0.5) == y[600:]) > 0.97


def test_views_learn_from_all_unlabelled_documents(spark):
    rows = [(i, ("plain " if i % 2 else "junk ") + prose(40, i), "en", "good" if i % 2 else "bad", 200) for i in range(900)]
    rows += [(None, None, None, None, None), (901, "", "en", "s", 0), (1, rows[1][1], "en", "good", 200)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("quality", F_lit("own"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    # 700 unlabelled documents of two kinds, nearly all of them sure.
    assert all(600 < e.documents.sum() <= 702 for e in model.evidence)
    keep = {r.doc_id: r.keep for r in quality.score(docs, model).collect()}
    assert np.mean([keep[i] == bool(i % 2) for i in range(200, 900)]) > 0.98
    assert quality.keep_good(docs, model).columns == docs.columns


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


@pytest.mark.parametrize("name", ["toxicity", "quality", "near_duplicates", "decontamination", "packing"])
def test_stages_take_empty_tables_and_odd_rows(spark, name, tmp_path):
    import corpus_pipeline as p

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    stage = dict(p.STAGES)[name]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (2, "word", "en", "s", 4)], DOCS)
    out = stage(spark, odd, str(tmp_path))
    if name != "packing":
        assert out.columns == odd.columns
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in odd.collect()}
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    else:
        assert out.count() == 4 and stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_sums_beat_best_fit_where_they_must():
    """Three lengths that only together fill a sequence; best fit puts the long ones together."""
    h = {400: 50, 324: 50, 300: 50}
    assert sum(n for _, n in packing.plan(h)) == 50 < sum(n for *_, n in packing._best_fit(dict(h), 1024, []))
    # A single complement, a pair, and a triple, with the counts that they have.
    h = {1000: 3, 24: 3, 900: 5, 100: 5, 700: 4, 124: 4, 110: 4, 90: 4}
    assert sum(n for _, n in packing.plan(h)) == 12


def test_plans_use_every_piece_once():
    r = random.Random(9)
    for _ in range(150):
        size = r.choice([16, 64, 1024])
        h = {k: r.randrange(4) for k in r.sample(range(1, size + 1), min(size, r.randrange(1, 60)))}
        plan = packing.plan(h, size)
        used = collections.Counter()
        for lengths, n in plan:
            assert sum(lengths) <= size and n > 0
            used.update({k: c * n for k, c in collections.Counter(lengths).items()})
        assert used == collections.Counter({k: n for k, n in h.items() if n})
        assert sum(n for _, n in plan) <= sum(n for *_, n in packing._best_fit({k: n for k, n in h.items() if n}, size, []))
    assert packing.plan({}) == []


def test_fillings_against_all_combinations():
    r = random.Random(10)
    for _ in range(60):
        left = np.array([0] + [r.choice([0, 0, 0, 1, 2]) for _ in range(40)], np.int64)
        sums = packing.Sums(left, 2)
        for gap in range(2, 41):
            found = sums.filling(gap, True)
            own = [k for k in range(2, 41) for _ in range(left[k])]
            there = any(sum(c) == gap for many in (1, 2, 3) for c in itertools.combinations(own, many))
            assert (found is not None) == there and (found is None or (sum(found) == gap and all(found.count(k) <= left[k] for k in found)))


def test_scores_where_batches_have_no_trigram(spark):
    """Texts that are empty, blank or one word, each in a partition of its own, between others."""
    from wanderlake.llm import lm

    texts = ["", None, " \t", "a", "b", "", "a b c a b", "c", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(9, "doc_id")
    for part in (docs, docs.where("text is null or trim(text) = ''"), docs.where("doc_id in (3, 4, 7)"), docs.where("doc_id = 0"), docs.limit(0)):
        n = part.count()
        for order in (2, 3):
            rows = lm.score(part, lm.fit(part, order)).collect()
            assert len(rows) == n and all(r.n_tokens == len((texts[r.doc_id] or "").split()) + 1 and r.score <= 0 for r in rows)
