"""Conversation repair, phrases and SimHash against plain versions."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wanderlake.llm import phrases, queries, repair, simhash

SF = "/root/testdata/sf0.001"


def plain_repair(rows):
    """Cheapest edits by a best-first search over (rows read, state); a word is (initial, must go, truncated) a row."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        # States with a system turn before and without are told apart by what may follow, which is the same after u and a.
        done.add((i, state))
        for x in "ua":
            if (state, x) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[state, x]))
        if i < len(rows):
            initial, must, open_ = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if not must:
                if (state, initial) in step:
                    heapq.heappush(heap, (cost + 5 * open_, audit + "K", i + 1, step[state, initial]))
                for x in "ua":
                    if (state, x) in step:
                        heapq.heappush(heap, (cost + 1 + 5 * open_, audit + "R", i + 1, step[state, x]))
    raise AssertionError


def letters(rows):
    return "".join("-" if must else (c if c in "sua" and c else "o").upper() if t else (c if c in "sua" and c else "o") for c, must, t in rows)


def test_cheapest_edits_of_short_and_long_words():
    kinds = [(c, m, t) for c in ("s", "u", "a", "x") for m, t in ((False, False), (True, False), (False, True))]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.cheapest(letters(rows)) == plain_repair(rows), rows
    r = random.Random(3)
    for _ in range(60):
        rows = [r.choice(kinds) for _ in range(r.randrange(4, 90))]
        assert repair.cheapest(letters(rows)) == plain_repair(rows)


def plain_op11(rows):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if code == 1:
                text = ""
            if code == 2:
                text = re.sub("[.!?]", "", text)
            if code == 4:
                role = "user"
            own += [(turn is not None, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        own.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        seen, counts, word = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in own:
            solid = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            word.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(word))
        cost, audit = plain_repair(word)
        lines, i, n = [], 0, sum(x != "D" for x in audit)
        for x in audit:
            new = ("user", "assistant")[(len(lines) + n) % 2]
            if x == "I":
                lines.append(f"{new}:")
                continue
            _, _, role, text = own[i]
            i += 1
            if x != "D":
                lines.append(f"{role if x == 'K' else new}:{text}")
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture
def sf_with(spark, tmp_path):
    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired_rows(spark, sf):
    got = queries.op11_conversation_repair(spark, sf).select(*COLUMNS).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0]: tuple(r[1:]) for r in got}


def test_repair_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired_rows(spark, SF) == plain_op11(rows)


def test_repair_of_odd_rows(spark, sf_with):
    r = random.Random(5)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "usher"], [None, "", " \t", "Yes.", "no", "Why? ", "x ", "long " * 20000 + "end."]
    rows = [(c, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts), "x", 1) for c in [None, *range(12)] for _ in range(r.randrange(1, 9))]
    rows += [(77, k, "user" if k % 2 else "assistant", f"Turn {k % 40}.", "x", 1) for k in range(300)] + rows[:5]
    # A conversation whose rows are all dropped.
    rows += [(next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "Gone.", "x", 1)]
    rows += [(78, -(1 << 63), "user", "Low.", "x", 1), (78, 3, "assistant", "High.", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, at int")
    got = repaired_rows(spark, sf_with(conversations=df))
    assert got == plain_op11([x[:4] for x in rows])


def test_repair_of_an_empty_table(spark, sf_with):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired_rows(spark, sf_with(conversations=df)) == {}


def plain_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fingerprint); the least doc_id that each can reach."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in rows), key=str)


def simhash_rows(spark, sf):
    return sorted((tuple(r) for r in queries.op13_simhash_near_dedup(spark, sf).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_simhash_of_a_whole_table(spark):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert simhash_rows(spark, SF) == plain_components(rows)


def test_simhash_of_odd_rows(spark, sf_with, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    r = random.Random(8)
    base = " ".join(f"w{r.randrange(400)}" for _ in range(300))
    near = [base.replace(f"w{k}", f"v{k}", 1) for k in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "one\ttwo", "one  two", "\xc9t\xe9 one", "a\nb\x0bc d", *near, base, base, "x " * 30000, "end\x1fof"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, base, "x", 1), (None, "alone in the world", "x", 1), (3, "one", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, cell int")
    got = simhash_rows(spark, sf_with(documents=df))
    assert got == plain_components([(i, plain_fingerprint(t)) for i, t, _, _ in rows])
    assert len({g[1] for g in got}) > 20


def test_simhash_of_an_empty_table(spark, sf_with):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_rows(spark, sf_with(documents=df)) == []


def test_tiles_keep_every_link(spark, monkeypatch):
    """Random balls of fingerprints, over many small tiles."""
    monkeypatch.setattr(simhash, "TILE", 4)
    r = random.Random(2)
    fps = set()
    for _ in range(30):
        centre = r.getrandbits(64)
        for _ in range(20):
            for _ in range(r.randrange(3)):
                centre ^= 1 << r.randrange(64)
            fps.add(centre)
    fps |= {0, (1 << 64) - 1, 1, 7, 15}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    pairs = simhash.near_tiles(simhash.tiles(spark.createDataFrame([(f,) for f in signed], "fp long")))
    found = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(pairs).collect()]
    assert all((a ^ b).bit_count() for a, b in found)

    def groups(edges):
        label = {f: f for f in fps}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                m = min(label[a], label[b])
                if label[a] != m or label[b] != m:
                    label[a] = label[b] = m
                    changed = True
        return label

    want = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    assert groups(found) == groups(want)


def plain_pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split("[.,;:!?\n-\r]", text) if (w := re.findall("[^ \t]+", p))]


def plain_counts(rows, depth=3):
    f = collections.Counter()
    for lang, text in rows:
        for w in plain_pieces(text):
            for k in range(1, depth + 1):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def plain_collocations(rows, least=10, most=2000):
    f = plain_counts(rows)
    kept = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (o, q), b in f.items() if o == lang and len(q) == 3 > len(p) and b >= least and p in (q[:2], q[1:])]
        if not any(100 * b >= 50 * a for b in longer):
            kept[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, found in kept.items():
        n = sum(c for (o, p), c in f.items() if o == lang and len(p) == 1)
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_intervals_of_an_index(depth):
    r = random.Random(depth)
    texts = [" ".join(r.choice("abcdE. ,") + r.choice(["", " ", "\t"]) for _ in range(r.randrange(60))) for _ in range(30)] + ["", None, "a", "b"]
    shard = phrases.Shard(pa.array(texts))
    want = plain_counts([("x", t) for t in texts], depth)
    pieces = [w for t in texts for w in plain_pieces(t)]
    before, after = collections.Counter(), collections.Counter()
    for w in pieces:
        for k in range(1, depth + 1):
            for i in range(len(w) - k + 1):
                before["x", tuple(w[i : i + k])] += i > 0
                after["x", tuple(w[i : i + k])] += i + k < len(w)
    got = {}
    for k, (place, *numbers) in enumerate(phrases.enumerate_phrases(shard, depth), 1):
        for p, *n in zip(place.tolist(), *(x.tolist() for x in numbers), strict=True):
            i = shard.word[p]
            phrase = shard.bytes[shard.start[i] : shard.start[i + k - 1] + shard.size[i + k - 1]].tobytes().decode()
            assert ("x", tuple(phrase.split(" "))) not in got
            got["x", tuple(phrase.split(" "))] = n
    assert got == {p: [n, before[p], after[p]] for p, n in want.items()}


def collocation_rows(spark, sf):
    return sorted(tuple(r) for r in queries.op12_phrase_collocations(spark, sf).collect())


def test_collocations_of_a_whole_table(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collocation_rows(spark, SF) == plain_collocations(rows) != []


def test_collocations_of_odd_rows(spark, sf_with, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 4000)
    monkeypatch.setattr(phrases, "PART_BYTES", 3000)
    r = random.Random(6)
    words = ["a", "B", "the", "\xe9t\xe9", "\u6f22", "x\u00a0y", "of", "q\x0b", "z.", "w,", "new york", "New York city", "a a a"]
    rows = [(r.choice([None, "und", "en", "de"]), " ".join(r.choice(words) for _ in range(r.randrange(1, 200))), "x", 1) for _ in range(60)]
    rows += [("en", None, "x", 1), ("fr", "", "x", 1), ("fr", "a b", "x", 1), ("en", "Very long text\there. " * 5000, "x", 1)] + rows[:4]
    df = spark.createDataFrame(rows, "lang string, text string, phrase string, n int")
    got = collocation_rows(spark, sf_with(documents=df))
    assert got == plain_collocations([x[:2] for x in rows]) and {g[0] for g in got} == {"en", "de", "und"}


def test_collocations_of_an_empty_table(spark, sf_with):
    assert collocation_rows(spark, sf_with(documents=spark.createDataFrame([], "lang string, text string"))) == []


def test_collocations_match_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(queries.OP12_SQL).fetchall()
    assert sorted(want) == collocation_rows(spark, SF)


def test_chat_spans_of_long_conversations_and_clashing_columns(spark):
    """Spans against running sums in Python, for conversations of 1 to 3,000 turns, beside columns named as the operator's own."""
    from wanderlake.llm import chat

    r = random.Random(9)
    rows = []
    for conv, n in [(1, 1), (2, 2), (3, 3), (4, 4), (5, 3000), (None, 17)]:
        rows += [(conv, k, r.choice(["user", "assistant", "assistant", "system", "o:dd", None]), r.choice(["", None, "<join/> \\", "a </turn> b", "é" * 5]), "x", "x", "x") for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string, p string, begins string").repartition(5)
    show = {"user": "User", "assistant": "Assistant", "system": "System"}
    for row in chat.format_conversations(df).collect():
        out, spans, last = "", [], None
        for _, _, role, text, *_ in [x for x in rows if x[0] == row.conv_id]:
            role, text = role or "", text or ""
            for plain, code in chat.ESCAPES:
                text = text.replace(plain, code)
            out += "<join/>" if role == last else ("</turn>\n" if last is not None else "") + "### " + show.get(role, "=" + role.replace(":", "\\c")) + ": "
            spans += [(len(out), len(text))] if role == "assistant" else []
            out, last = out + text, role
        assert row.formatted == out + "</turn>\n" and [tuple(x) for x in row.loss_spans] == spans
