"""Ranked search, shards and spelling variants against brute force, and on hard inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from wiretally.llm import ranked_search, sharding, spelling

SCHEMA = "doc_id long, text string, bucket string, row string, n long, shard string, word string, block long, home long"
ITEMS = "item_id long, text string, doc_id long, term string, rank long, score long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}
HARD = ["", " ", "\n\n", "a", "Hello <|endoftext|> World", "İstanbul ΣΑΣ ÀÉ×÷ÿ", "a\x1cb \x1f c d　e​f", "½²Ⅷ一二 12345", "日本語 한국어 ไทย", "x" * 700, "ab" * 30_000, "🎉👨‍👩‍👧 ok", "nul\x00inside thenul\x00"]


def frame(spark, rows, parts=3):
    """Rows of (doc_id, text) with more columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", None, 1, "s", "w", 2, 3) for d, t in rows], SCHEMA).repartition(parts)


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, "t", 1, 2) for i, t in rows], ITEMS)


def ranked(docs, items, k):
    """Brute force: every document scored for every item."""
    found = [(d, collections.Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    found = [x for x in found if x[1]]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    held = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            m, score = 100 - 25 + (25 * sum(c.values()) * n) // total, 0
            for t, r in collections.Counter(TERM.findall((text or "").translate(UPPER))).items():
                if t in c:
                    score += r * math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank + 1, d, -s) for rank, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, chunk_terms", [(8_192, 100_000), (16, 100_000), (64, 7)])
def test_search(spark, block, chunk_terms):
    random.seed(block)
    words = ["the", "The", "of", "é", "É", "12", "日本"] + [f"w{i}" for i in range(60)] + ["".join(random.choices("abcd", k=3)) for _ in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: random.choice([" ", "-", "\n"]).join(random.choices(words, weights, k=n))
    docs = [(i, text(random.choice([1, 3, 30, 200]))) for i in range(300)] + [(i + 1000, t) for i, t in enumerate(HARD)]
    docs += [(7, docs[7][1])] * 3 + [(None, docs[5][1]), (None, None), (2000, None)] + [(3000 + i, "w1 w2 tie") for i in range(60)]
    items = [(i, text(random.choice([1, 5, 40, 400]))) for i in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (103, "tie"), (104, " ".join(words) * 2), (105, "日本語 ab")]
    got = ranked_search.search(frame(spark, docs), items_frame(spark, items), k=10, block=block, chunk_terms=chunk_terms)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == ranked(docs, items, 10)


def test_search_stops_before_all_masks():
    """Masks that cannot reach the k-th score are not evaluated."""
    import numpy as np

    n = 4_000
    blocks = ranked_search.Blocks(np.arange(n), np.zeros(n, bool), np.full(n, 50), n, 50 * n)
    random.seed(5)
    wanted = []
    for i, share in enumerate((0.01, 0.02, 0.5, 0.9)):
        places = np.array(sorted(random.sample(range(n), int(n * share))))
        blocks.add(b"%d" % i, 1000 >> (3 * i), places, np.ones(len(places), np.int64))
        wanted.append((b"%d" % i, 1))
    looked = []
    scores = blocks.scores
    blocks.scores = type("Counted", (dict,), {"__getitem__": lambda self, t: (looked.append(t), scores[t])[1]})(scores)
    best = blocks.best(wanted, 5)
    whole = sorted(((-sum(int(scores[t][list(blocks.places[t]).index(p)]) for t, _ in wanted if p in set(blocks.places[t].tolist())), p) for p in range(0, n, 1) if p in set(blocks.places[b"0"].tolist()) | set(blocks.places[b"1"].tolist())))[:5]
    assert [(-s, p) for s, p in whole] == best
    assert len(looked) <= 3 * len(wanted)


def test_search_of_nothing(spark):
    some, none = frame(spark, [(1, "a b"), (2, None)]), frame(spark, [])
    assert ranked_search.search(none, items_frame(spark, [(1, "a")])).collect() == []
    assert ranked_search.search(some, items_frame(spark, [])).collect() == []
    assert ranked_search.search(frame(spark, [(1, None), (2, "")]), items_frame(spark, [(1, "a")])).collect() == []


def descended(key, leaves):
    node, nodes = "", sharding.children(leaves)
    while node in nodes:
        draws = []
        for child, weight in nodes[node].items():
            unit = (int(hashlib.md5(f"{key}/{child}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            draws.append((math.log(unit) / weight, child))
        node = max(draws)[1]
    return int(node.split("/")[-1])


def test_shards(spark):
    rows = [(i, f"text {i % 7}") for i in range(400)] + [(i + 1000, t) for i, t in enumerate(HARD)] + [(None, "x")] * 200 + [(5, None), (5, "text 5"), (-3, "")]
    leaves = sharding.planned(16)
    got = sharding.assign(frame(spark, rows), leaves).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == descended(key, leaves) and r.grown_shard == descended(key, sharding.grown(leaves))
        assert r.grown_shard in (r.shard, 16)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    for some in slots.values():
        some.sort()
        assert [x[0] for x in some] == list(range(len(some)))
        assert [x[1:] for x in some] == sorted(x[1:] for x in some)
    assert sharding.assign(frame(spark, []), leaves).collect() == []


def test_weights_confine_movement(spark):
    from pyspark.sql import functions as F

    leaves = sharding.planned(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 0.0 if x.shard == 12 else 1.0) for x in leaves]
    key = F.col("id").cast("string")
    moved = spark.range(20_000).select(sharding.shard_of(key, leaves).alias("was"), sharding.shard_of(key, heavier).alias("now")).collect()
    counts = collections.Counter(r.was for r in moved)
    assert all(abs(n - 1250) < 200 for n in counts.values()) and len(counts) == 16
    region, rack = {x.shard: x.region for x in leaves}, {x.shard: x.rack for x in leaves}
    for r in moved:
        if r.was != r.now:  # into the rack that grew, or out of the one that shrank
            assert rack[r.now] == rack[5] or rack[r.was] == rack[12] or (region[r.was], region[r.now]) == (1, 0)
            assert not (region[r.was] == 0 and region[r.now] == 1)
    assert 12 not in {r.now for r in moved}
    assert collections.Counter(r.now for r in moved)[5] > 2100
    with pytest.raises(ValueError):
        sharding.shard_of(key, [])


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def formed(counts):
    letters, out = sorted(set("".join(counts))), {}
    for word, n in counts.items():
        near = sorted(edits(word, letters) & counts.keys(), key=lambda w: (-counts[w], w))
        form = near[0] if near and counts[near[0]] >= 5 * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    rows = []
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.append((word, form, root, n, n_near, form_n))
    return sorted(rows)


@pytest.mark.parametrize("home", [40_000, 40])
def test_variants(spark, home):
    random.seed(home)
    stems = ["".join(random.choices("abcé", k=random.randint(5, 9))) for _ in range(25)] + ["abcabc" + x for x in ("", "a", "b", "aa", "ab", "ba", "abc", "×ÿ")]
    words = stems + [w[:i] + random.choice(["", "b", "éa"]) + w[i + 1 :] for w in stems for i in range(len(w))]
    docs = []
    for i in range(600):
        some = random.choices(words, [3.0 ** -(j % 7) for j in range(len(words))], k=40)
        docs.append((i, random.choice([" ", "-", "日", "1"]).join(random.choice([w, w.upper() if w.isascii() else w]) for w in some)))
    docs += [(i + 1000, t) for i, t in enumerate(HARD)] + [(None, None), (None, "abcabc abcabc"), (3, docs[3][1]), (3, docs[3][1])] + [(2000 + i, "y" * 500 + " " + "y" * 501) for i in range(6)]
    docs += [(4000 + i, w) for i, w in enumerate(["pathone"] * 7 + ["pathons"] * 45 + ["pathoss"] * 260)]
    counts = collections.Counter()
    for d, t in docs:
        for run in RUN.findall((t or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = spelling.variants(frame(spark, docs), home=home)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == formed(counts)
    assert any(r[1] and r[1] != r[2] for r in formed(counts))  # a path of two steps


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, None), (2, "short"), (None, "")])).collect() == []


@pytest.mark.parametrize("rightwards", [True, False])
def test_index_finds_words_outside_it(rightwards):
    random.seed(2)
    words = sorted({"".join(random.choices("abc", k=random.randint(6, 8))).encode() for _ in range(400)})
    index = spelling.Index(words[::2])
    queries = [*words[1::2], b"zzzzzz", b"abcabz"]
    got = {(queries[q], index.words[t]) for q, t in zip(*index.near(queries, rightwards), strict=True)}
    want = set()
    for q in queries:
        half = len(q) // 2
        for t in edits(q.decode(), "abcz"):
            t = t.encode()
            if t in words[::2] and (t[:half] == q[:half] if rightwards else t.endswith(q[half:])):
                want.add((q, t))
    assert got == want and want
