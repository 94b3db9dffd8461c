"""The corpus operators against plain versions on small fixtures, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from wanderlake.llm import chat, decontam, fingerprint, lm, neardup, packing, quality, queries, sharding, toxicity, urlfilter
from wanderlake.llm import eliasfano as ef
from wanderlake.llm import text as tx

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(120, i) for i in range(12)]
    near = base[0].replace(base[0].split()[60], "changed", 1)
    texts = [*base, near, base[1], None, "", "one two", "one two", prose(60_000, 99)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, prose(50, 5), None, None, None), rows[3]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_equal_for_equal_words_only():
    texts = ["The cat\tthe  CAT", "", None, " dog\n", "a", "the cat sat on the mat"]
    word, at = tx.words(pa.array(texts))
    want = [w for t in texts for w in re.split(r"[ \t-\r]+", (t or "").lower()) if w]
    assert at.tolist()[-1] == len(want) == len(word)
    by = dict(zip(want, word.tolist(), strict=True))
    assert [by[w] for w in want] == word.tolist() and len(set(by.values())) == len(by)


def test_near_duplicates(docs, none):
    got = {}
    for r in neardup.near_duplicates(docs.withColumn("label", docs.lang)).collect():
        got[r.doc_id] = r.class_id
    assert got[12] == 0 and got[13] == 1 and got[15] == 14 and got[17] == 16
    assert got[None] is None and sum(k == v for k, v in got.items()) == len(got) - 4
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(got) - 4


def test_probability_jaccard():
    a = collections.Counter({1: 3, 2: 1, 3: 1})
    b = collections.Counter({1: 1, 2: 1, 4: 2})
    want = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)
    arrays = [(np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
    assert neardup.similarity(*arrays) == pytest.approx(want)


def test_bounds_keep_every_link_between_components(spark):
    """Brute force over families of edited texts, each text its own component."""
    r = random.Random(11)
    texts = []
    for family in range(6):
        words = (prose(60, 500 + family) + " ") * (1 + family % 2)
        for _ in range(12):
            w = words.split()
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += ["", "one two", texts[0]]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, label long, text string")
    owner, shingle, count, n = neardup.weighted(pa.array(texts))
    sets = [(shingle[owner == i], count[owner == i]) for i in range(n)]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if neardup.similarity(sets[a], sets[b]) >= neardup.LEAST}
    got = {tuple(x) for x in neardup.may_link(neardup.heads(df)).collect()}
    assert len(want) > 20 and want <= got and len(got) < 3 * len(want)
    assert neardup.heads(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", None, "", "a\\b\\h####<join/>\\", "é 💥 \\c:"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "odd: role"], texts, strict=True))]
    rows += [(None, 0, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    f = chat.format_conversations(df)
    back = {r.conv_id: [(x.role, x.text) for x in r.t] for r in f.select("conv_id", chat.read_turns(f.formatted).alias("t")).collect()}
    assert back[1] == [(r or "", t or "") for _, _, r, t in rows[:5]] and back[None] == [("", "x")] and back[2] == [("assistant", "y")] * 2
    d = {r.conv_id: r for r in chat.digest(f).collect()}
    loss = "".join(t or "" for _, _, r, t in rows[:5] if r == "assistant")
    assert d[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and d[1].loss_chars == len(loss)
    turns = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:5])
    assert d[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_sharding_is_even_and_moves_little(spark):
    names = [f"s{i}" for i in range(10)]
    full, less = sharding.fill(names, 10_007), sharding.fill(names[:-1], 10_007)
    sizes = collections.Counter(full)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sum(a != b for a, b in zip(full, less, strict=True) if a != 9) < 0.1 * 10_007
    df = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    rows = sharding.assign(df, "doc_id", names, 10_007).collect()
    assert len(rows) == 3 and all(r.shard == names[full[r.slot]] for r in rows) and rows[0].slot == rows[1].slot
    with pytest.raises(ValueError):
        sharding.assign(df.selectExpr("doc_id", "1 as slot"), "doc_id", names)


def test_url_filter(spark):
    urls = ["http://A.example.net/en/1?x", "https://a.net", "x://net/q#r", "http://deep.example.com/de/", "http://example.com.de/de/", None, "nothing", "http://listed.io/p/", "http://u@w.org/fr/a/b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, action string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules, spark.createDataFrame([("listed.io/p",)], "url string")).collect()}
    assert got == {0: ("example.net/en/", "allow"), 1: (None, "allow"), 2: ("net/", "block"), 3: ("example.com/de/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: ("org/fr/", "allow")}
    assert urlfilter.judge(pages.limit(0), rules, rules.limit(0).select(rules.host.alias("url"))).count() == 0


def test_url_query_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(map(str, c.sql(queries.OP6_SQL).fetchall()))
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict, r.listed)) for r in queries.op6_url_filters(spark, SF).collect())
    assert got == want


def test_decontamination(spark, none):
    item = "If John has 5 apples and Mary takes 3 of them, how many apples does John have left in the basket?"
    bench = spark.createDataFrame([(1, item), (2, "tiny"), (3, None)], "item_id long, text string")
    same, swapped = item.replace("John", "Bob").replace("5", "7"), item.replace("John have", "Tim have")
    rows = [(1, f"{prose(40, 1)}. {same} {prose(40, 2)}"), (2, swapped), (3, None), (4, prose(100, 3)), (None, item), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == {1, None}
    assert sorted(r.doc_id for r in decontam.keep_clean(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_fingerprints(docs, none):
    rows = fingerprint.compare_neighbours(docs).collect()
    data = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert len(rows) == len(data)
    want = collections.Counter()
    for k, (i, t) in enumerate(data):
        nxt = data[(k + 1) % len(data)][1]
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()] += 1
    assert want == collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    assert fingerprint.compare_neighbours(none).count() == 0
    by_text = collections.defaultdict(set)
    for r, (_, t) in zip(sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.n_chars)), data, strict=True):
        by_text[t].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_likeness_is_unbiased():
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    errors = []
    for seed in range(40):
        a = prose(600, seed)
        w = a.split()
        b = " ".join(w[: 150 + 10 * seed] + prose(600, seed + 1000).split()[150 + 10 * seed :])
        x, y = shingles(a), shingles(b)
        got = fingerprint.likeness(*(fingerprint.fingerprints(pa.array([t])) for t in (a, b)))[0]
        errors.append(got - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.12


def test_tokens_equal_the_tokenizers_library():
    encoder = packing._encoder(queries.tokenizer_path())
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()] + ["", None, "a  b\n c", "<|endoftext|>", "é\u00a0x\u3000y 漢字", "don't\r\n\r\n  x"]
    want = [e.ids for e in encoder[0].encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in packing.token_ids(encoder, pa.array(texts))] == want


def test_packing(spark, docs, none):
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    whole = packing._encoder(queries.tokenizer_path())[0]
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == r.length <= 1024
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(ids[r.doc_id]) for r in docs.collect())
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_plan_is_near_the_bound():
    r = random.Random(3)
    h = collections.Counter(r.randint(1, 1023) for _ in range(20_000))
    plan = packing.plan(h)
    # No two pieces of over half a sequence share one.
    bound = max(math.ceil(sum(k * v for k, v in h.items()) / 1024), sum(v for k, v in h.items() if k > 512))
    assert sum(n for _, n in plan) <= 1.01 * bound
    used = collections.Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 1024
        for k in lengths:
            used[k] += n
    assert used == h


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (1000, 1000), (5000, 1 << 60), (300, 70_000)):
        v = np.sort(r.integers(0, universe, n, dtype=np.uint64))
        s = ef.Sequence(ef.unpack(np.frombuffer(ef.pack(ef.encode(v, universe, "x")), np.uint8)), "x")
        assert n == 0 or (s.get(np.arange(n)) == v).all()
        probe = np.concatenate([v, r.integers(0, universe, 200, dtype=np.uint64)])
        at = s.find(probe)
        assert all((p in set(v.tolist())) == (i >= 0) and (i < 0 or v[i] == p) for p, i in zip(probe.tolist(), at.tolist(), strict=True))


def test_lm_scores(spark, docs, none):
    got = lm.score(docs, lm.fit(docs)).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tok = lambda t: [*(t or "").lower().split(), None]
    c, b, ctx, kinds = (collections.Counter() for _ in range(4))
    for i, t in rows:
        if not held(i):
            w = tok(t)
            c.update(w)
            b.update(zip(["<s>", *w[:-1]], w, strict=True))
    for (x, _), n in b.items():
        ctx[x] += n
        kinds[x] += 1
    total, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (total + 0.1 * (v + 1))
    want = collections.defaultdict(list)
    for i, t in rows:
        w = tok(t)
        s = 0.0
        for x, y in zip(["<s>", *w[:-1]], w, strict=True):
            s += math.log10((max(b[x, y] - 0.75, 0) + 0.75 * kinds[x] * p1(y)) / ctx[x] if ctx[x] else p1(y))
        want[i].append((held(i), len(w), sum(c[x] > 0 for x in w), sum(math.log10(p1(x)) for x in w), s))
    assert len(got) == len(rows)
    for r in got:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*x[:3], total) and abs(r.base_score - x[3]) < 1e-6 and abs(r.score - x[4]) < 0.03 * x[1] for x in want[r.doc_id])
    assert lm.score(none, lm.fit(none)).count() == 0 and lm.score(docs, lm.fit(none)).count() == len(rows)


def held_out_accuracy(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic, low = i % 5 == 0, i % 7 == 0
        w = prose(80, i).split()
        if toxic:
            w[r.randrange(80)], w[r.randrange(80)] = "vile", "nasty"
        t = " ".join(w)
        rows.append((i, (t.upper() + "!!!") if low else t, "en", f"src{i % 3}", len(t)))
        if i % 2:
            labels.append((i, int(not low), int(toxic)))
    rows += [(None, None, None, None, None), (9999, "", "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (1, None, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark, none):
    docs, labels = held_out_accuracy(spark)
    tox = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.train(docs, labels, queries.categories()), ["low_quality", "toxic"]).collect()}
    good = {r.doc_id: r.keep for r in quality.score(docs, quality.train(docs, labels)).collect()}
    unseen = range(0, 600, 2)
    assert np.mean([tox[i] == (i % 5 == 0) for i in unseen]) > 0.95
    assert np.mean([good[i] == (i % 7 != 0) for i in unseen]) > 0.95
    chain = toxicity.train(docs, labels.limit(0), queries.categories())
    assert toxicity.score(docs, chain, ["low_quality", "toxic"]).count() == 602 and toxicity.keep_clean(none, chain).count() == 0
    assert quality.score(docs, quality.train(docs, labels.limit(0))).where("keep").count() == 602


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    assert p.run(spark, SF).count() > 0


@pytest.mark.parametrize("load", [lm.LOAD, 40])
def test_lm_counts_trigrams_and_cuts_hot_contexts(spark, none, monkeypatch, load):
    """Against a plain model of order 3. With the small load the contexts w0 and (w0, w0) lie in several shards."""
    monkeypatch.setattr(lm, "LOAD", load)
    r = random.Random(3)
    texts = [" ".join("w0" if r.random() < 0.5 else f"w{r.randrange(40)}" for _ in range(r.randrange(60))) for _ in range(60)]
    rows = [*enumerate([*texts, None, "never seen before", texts[0]]), (None, "w0 w0 w1"), (3, "w0 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tok = lambda t: [*(t or "").lower().split(), "</s>"]
    gram, total, kinds = (collections.Counter() for _ in range(3))
    for i, t in rows:
        if not held(i):
            w = ["<s>", *tok(t)]
            gram.update((x,) for x in w[1:])
            gram.update(zip(w, w[1:], strict=False))
            gram.update(zip(w, w[1:], w[2:], strict=False))
    for g, n in gram.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    assert kinds["w0",] > 30

    def p(g):
        if len(g) == 1:
            return (gram[g] + 0.1) / (total[()] + 0.1 * (kinds[()] + 1))
        c = g[:-1]
        return (max(gram[g] - 0.75, 0) + 0.75 * kinds[c] * p(g[1:])) / total[c] if total[c] else p(g[1:])

    want = collections.Counter()
    for i, t in rows:
        w = ["<s>", *tok(t)]
        want[i, round(sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(1, len(w))), 6)] += 1
    trie = lm.fit(df, 3)
    assert load > 40 or (np.unique(trie.two.first).size < len(trie.two.first) and np.unique(trie.three.first).size < len(trie.three.first))
    assert collections.Counter((x.doc_id, round(x.score, 6)) for x in lm.score(df, trie).collect()) == want
    assert lm.score(none, lm.fit(none, 3)).count() == 0 and lm.score(df, lm.fit(none, 3)).count() == len(rows)


def test_decontamination_finds_renamed_openers_and_exact_copies(spark):
    tom = "Tom has 5 apples. Tom buys 3 pears. How many does Tom have now?"
    sums, caps, same = "Compute 12 + 7 * 3 - 4", "Why do the small birds of the north fly so far away each winter?", "Give the sum when Bob owns 4 red hats and also Eve owns 9 blue hats."
    items = [(1, tom), (2, sums), (3, "ab initio"), (4, caps), (5, same)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [tom.replace("Tom", "Ann"), tom.replace("Tom", "Ann Lee"), f"{prose(30, 1)}. {sums} {prose(30, 2)}", "Then AB Initio!", caps.upper(), caps.title(), same.replace("Eve", "Bob")]
    others = [tom.replace("Tom buys", "Ann buys"), "Compute 13 + 7 * 3 - 4", "ab ovo initio", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, *others])], DOCS)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 5)}


def test_listed_urls_without_host_are_blocked(spark):
    pages = spark.createDataFrame([(1, "file:///x/"), (2, "http:///y"), (3, "http://"), (4, None)], "page_id long, url string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, action string")
    listed = spark.createDataFrame([("/x",), ("",)], "url string")
    got = {r.page_id: (r.verdict, r.listed) for r in urlfilter.judge(pages, rules, listed).collect()}
    assert got == {1: ("block", True), 2: ("allow", False), 3: ("allow", False), 4: ("allow", False)}


@pytest.mark.parametrize(("load", "bits"), [(lm.LOAD, 12), (40, 12), (40, 8)])
def test_lm_quantised_levels(spark, monkeypatch, load, bits):
    """Against a plain model that rounds to the same grid; within two half steps a token of the exact one. With the small load hot contexts lie in several shards."""
    monkeypatch.setattr(lm, "LOAD", load)
    r = random.Random(5)
    texts = [" ".join("w0" if r.random() < 0.5 else f"w{r.randrange(40)}" for _ in range(r.randrange(60))) for _ in range(60)]
    rows = [*enumerate([*texts, None, "never seen w0 w0 never", texts[0]]), (9, "w0 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gram, total, kinds = (collections.Counter() for _ in range(3))
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            w = ["<s>", *(t or "").split(), "</s>"]
            gram.update((x,) for x in w[1:])
            gram.update(zip(w, w[1:], strict=False))
            gram.update(zip(w, w[1:], w[2:], strict=False))
    for g, n in gram.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    step = lm.DECADES / 2**bits
    grid = lambda x: -min(round(-x / step), 2**bits - 1) * step

    def logp(g, q):
        if len(g) == 1:
            return math.log10((gram[g] + 0.1) / (total[()] + 0.1 * (kinds[()] + 1)))
        c, lower = g[:-1], logp(g[1:], q)
        if not total[c]:
            return lower
        weight = 0.75 * kinds[c] / total[c]
        return q(math.log10((gram[g] - 0.75) / total[c] + weight * 10**lower)) if gram[g] else q(math.log10(weight)) + lower

    def of(t, q):
        w = ["<s>", *(t or "").split(), "</s>"]
        return sum(logp(tuple(w[max(0, k - 2) : k + 1]), q) for k in range(1, len(w)))

    trie = lm.fit(df, 3, bits=bits)
    got = sorted((x.doc_id, x.score, x.n_tokens) for x in lm.score(df, trie).collect())
    want = sorted((i, of(t, grid), of(t, lambda x: x)) for i, t in rows)
    for (i, score, n), (j, rounded, exact) in zip(got, sorted(want), strict=True):
        assert i == j and abs(score - exact) <= n * step + 1e-9
        # Two rows share the id 9, and a value on the middle between two steps may go either way.
        assert i == 9 or abs(score - rounded) < 1e-6
    # Counts are gone, what is left is pointers, successors and bits.
    left = trie.store._fs()[0].get_file_info(__import__("pyarrow.fs", fromlist=["fs"]).FileSelector(trie.store._fs()[1], recursive=True))
    assert left and not any("counts" in f.path for f in left)
    packed = trie.store.read("triples-model-0")["prob"]
    assert packed.dtype == np.uint64 and len(packed) == int(trie.three.base[1]) * bits // 64 + 2


def test_packed_bits():
    r = np.random.default_rng(1)
    for width in (0, 1, 7, 12, 33, 63):
        for n in (0, 1, 64, 1000):
            v = r.integers(0, 1 << width, n, dtype=np.uint64) if width else np.zeros(n, np.uint64)
            i = r.permutation(n)
            assert np.array_equal(ef.take_bits(ef.pack_bits(v, width), i, width), v[i])
