"""The operators against brute force, libraries and held-out rows, and on hard inputs."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wiretally.llm import bpe, decontaminate, exact_dedup, language, licenses, near_dedup, suffix_dedup, token_counts, token_files, toxicity
from wiretally.llm.anchors import groups
from wiretally.llm.common import work_folder
from wiretally.llm.queries import ORACLES, QUERIES
from wiretally.llm.shingles import Shingler, jaccard

SF = "/root/testdata/sf0.001"
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, bucket string, row string, n long, name string, batch long"
HARD = ["", " ", "\n\n", "a", "a  b\t\tc", "Hello <|endoftext|> World<|STARTOFTEXT|>x", "it's they'LL 'sofa", "İstanbul ΣΑΣ", "a\x1cb \x1f c d　e​f", "½²Ⅷ一二 12345", "<s> a▁ b </s>", "日本語 한국어 ไทย", "x" * 700, "ab" * 30_000, "🎉👨‍👩‍👧 ok", " \n b ", "a \nb", "a\r\nb\n", "nul\x00 a\x00b \x00", "𓀀" * 64 + " " + "𓀀" * 64, "݆᷶ a\u1df6\u0746b", "e\u0301\u0327 \u0323\u0307q", "ꟍ\u1c89Ა\U00011f02 \u2c2f"]


@pytest.fixture(scope="module")
def hard(spark):
    """Hard texts, repeated rows, nulls, and columns named like those inside the operators."""
    rows = [(i, t, "x", "y", None, None, 1) for i, t in enumerate(HARD + [None])] + [(3, "a", "x", "y", None, None, 1), (None, "a", None, None, 2, "n", None)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def removed(rows, length):
    """Brute force: for each row its bytes, and which of them an earlier document's window covers."""
    order = lambda d: float("inf") if d is None else d
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            least[w] = min(least.get(w, float("inf")), order(d))
    for d, t in rows:
        raw, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < order(d):
                gone[i : i + length] = b"\1" * length
        yield d, raw, gone


@pytest.mark.parametrize("seed", range(2))
def test_repeated_spans(spark, seed):
    random.seed(seed)
    stock = ["".join(random.choices("abé \n", k=random.randint(1, 90))) for _ in range(12)]
    texts = [(random.choice([i, i, 4, None]), "".join(random.choices(stock, k=random.randint(0, 7)))) for i in range(50)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), length=24)
    want = sorted(((d, len(raw), bytes(x for x, g in zip(raw, gone) if not g)) for d, raw, gone in removed(texts, 24)), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got.collect()), key=repr) == want


def test_groups_hold_every_window_once():
    random.seed(3)
    texts = ["".join(random.choices("abc", k=n)).encode() for n in (0, 10, 49, 50, 51, 400, 0, 90)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    found = groups(data, ends, 50)
    windows = [w for a, b in zip(found.first, found.last) for w in range(a, b + 1)]
    begins = ends - [len(t) for t in texts]
    assert sorted(windows) == [int(b) + i for b, t in zip(begins, texts) for i in range(len(t) - 49)]


def test_suffix_query_on_documents(spark, documents):
    want = sorted(
        (d, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
        for d, raw, gone in removed(documents, 50)
    )
    assert rows_of(QUERIES["op1_suffix_array_dedup"](spark, SF)) == sorted(want, key=repr)


def test_token_counts(spark, documents, hard):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in documents]
    assert rows_of(QUERIES["op2_token_counts"](spark, SF)) == sorted(want, key=repr)
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in hard.collect()]
    assert rows_of(token_counts.count_tokens(hard, PIECES)) == sorted(want, key=repr)


def test_token_counts_of_odd_characters(spark, empty):
    """Frequent pre-tokens with a NUL, and of 64 characters that each take several tokens."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["a \x00 b\x00c", "\x00", "𓀀" * 64 + " x " + "𓀀" * 64, "▁ a", "x\ty", "end\x00 " * 50] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [(i, len(t.encode()), len(model.encode(t))) for i, t in enumerate(texts)]
    assert rows_of(token_counts.count_tokens(docs, PIECES)) == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, PIECES).collect() == []


def test_bpe(spark, documents, hard):
    library = Tokenizer.from_file(WORD_BPE)

    def both(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)

    want = [(d, len(ids := both(t)[0]) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(both(t)[1].encode()).hexdigest()) for d, t in documents]
    assert rows_of(QUERIES["op8_bpe_encode_decode"](spark, SF)) == sorted(want, key=repr)
    got = bpe.round_trip(hard, WORD_BPE).collect()
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in got), key=repr) == sorted(((r.doc_id, *both(r.text)) for r in hard.collect()), key=repr)
    apart = bpe.decode(bpe.encode(hard, WORD_BPE), WORD_BPE)
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, got))


def test_any_unicode_as_the_library():
    """20,000 random texts: all planes, unassigned characters, pairs of combining marks, and characters from each range that is held to be sure."""
    library, vocabulary = Tokenizer.from_file(WORD_BPE), bpe.Vocabulary(WORD_BPE)
    random.seed(12)
    marks = [*range(0x300, 0x370), *range(0x1DC0, 0x1E00), *range(0x730, 0x74B), *range(0x610, 0x61B), 0x3099, 0x309A]
    sure = [chr(c) for c in range(0x10000) if re.match(f"[{bpe.SURE}]", chr(c))]

    def text():
        kind = random.randrange(5)
        if kind == 0:
            return "".join(chr(random.choice([random.randrange(0xD800), random.randrange(0xE000, 0x110000)])) for _ in range(random.randrange(1, 9)))
        if kind == 1:
            return "".join(random.choice("aeoé ") + chr(random.choice(marks)) + chr(random.choice(marks)) for _ in range(3))
        if kind == 2:
            return "".join(chr(random.randrange(0x20, 0x3000)) for _ in range(random.randrange(1, 12)))
        return "".join(random.choices(sure, k=random.randrange(1, 20))) + random.choice(["", " ", "'s", "İ", "Σ"])

    for _ in range(20_000):
        t = text()
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert vocabulary.encode(t) == ids, ascii(t)


def test_long_words_merge_alike():
    vocabulary = bpe.Vocabulary(WORD_BPE)
    random.seed(5)
    for _ in range(50):
        raw = "".join(random.choices("theangi", k=random.randint(1, 150))).encode()
        parts = [vocabulary.inner[b] for b in raw]
        assert vocabulary.merge(list(parts)) == vocabulary.merge_long(list(parts))


def test_words_beyond_the_switch_merge_alike():
    vocabulary = bpe.Vocabulary(WORD_BPE)
    random.seed(16)
    for size in [bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, *(random.randint(bpe.LONG, 3000) for _ in range(20))]:
        raw = "".join(random.choices("theangi", k=size)).encode()
        parts = [*(vocabulary.inner[b] for b in raw[:-1]), vocabulary.final[raw[-1]]]
        assert vocabulary.merge(list(parts)) == vocabulary.merge_long(list(parts)) == vocabulary.merge_word(raw)


def test_directly_addressable_codes():
    random.seed(2)
    tokens = np.array([random.choice([0, 5, 255, 256, 49_407, 70_000, 2**32 - 1]) for _ in range(3000)], np.uint32)
    block = token_files.Block(token_files.encode_levels(tokens))
    for _ in range(200):
        a, b = sorted(random.choices(range(3001), k=2))
        assert (block.tokens(a, b) == tokens[a:b]).all()
        assert block.token(min(a, 2999)) == tokens[min(a, 2999)]
    assert len(token_files.Block(token_files.encode_levels(tokens[:0])).tokens(0, 0)) == 0


def test_token_files(spark, documents, hard, empty):
    library, start, want = Tokenizer.from_file(WORD_BPE), 0, []
    for d, t in documents:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(QUERIES["op7_token_files"](spark, SF)) == sorted(want, key=repr)
    for df in (hard, empty):
        folder = f"{work_folder(spark)}/t"
        token_files.write(df, folder, WORD_BPE, end_id=2)
        found = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
        assert len(found) == df.count()
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in found]
        assert ids == sorted(ids)
        for before, after in zip(found, found[1:]):
            assert after.start == before.start + len(before.ids) // 4


def test_exact_classes(spark, hard, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 3)
    plain = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    random.seed(1)
    extra = [(random.choice([i, 5, None]), random.choice(["a b", "a \n b", "abc" * 7, "abc" * 7 + "d", "é" * 10, "abcabd" * 3])) for i in range(40)]
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("row", F.lit(1))
    rows = [(r.doc_id, plain(r.text)) for r in df.collect()]
    members = collections.defaultdict(list)
    for d, t in rows:
        members[t].append(d)
    got = exact_dedup.exact_classes(df).collect()
    want = [(d, min((x for x in members[t] if x is not None), default=None), len(members[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.kept for r in got) == len(members)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_leads_that_clash(spark, monkeypatch):
    """Blocks alike in all that cuts the ranges are told apart, and equal ones across ranges are not."""
    from wiretally.llm.common import written

    rows = [(random.choice(["aa1", "aa2", "aa3", "b"]), i, 0, 1, i, b"") for i in range(400)]
    df = spark.createDataFrame(rows, "block string, row long, at long, n long, doc_id long, sha binary").repartition(5)
    for lead in ({"_lead": F.substring("block", 1, 2)}, {"_lead": F.col("block")}, None):
        folder = work_folder(spark)
        named = written(exact_dedup.sorted_names(df, ["block"], folder, "r", lead), folder, "out").join(df.select("row", "block"), "row")
        assert {(r.name, r.block) for r in named.select("name", "block").distinct().collect()} == {(i, b) for i, b in enumerate(sorted({r[0] for r in rows}))}


def test_exact_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLES['op4_exact_dedup']})").fetchall()
    assert rows_of(QUERIES["op4_exact_dedup"](spark, SF)) == sorted(sql, key=repr)


def classes_of(rows, similarity=0.8):
    """Brute force: the smallest id of the connected component of each document."""
    shingler = Shingler()
    sets = {d: shingler.set_of(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= similarity:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in sets}


def edited(words, share):
    return " ".join(w if random.random() > share else f"new{random.randint(0, 999)}" for w in words)


def test_similarity_join(spark):
    random.seed(4)
    rows = []
    for _ in range(12):
        base = [f"w{random.randint(0, 400)}" for _ in range(random.choice([3, 40, 300]))]
        rows += [edited(base, random.choice([0, 0, 0.005, 0.02, 0.2])) for _ in range(12)]
    rows = list(enumerate(rows))
    random.shuffle(rows)
    classes, links = near_dedup.similarity_join(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, row int").repartition(3))
    got = classes.collect()
    assert {r.doc_id: r.class_id for r in got} == classes_of(rows)
    assert {r.doc_id for r in got if r.kept} == set(classes_of(rows).values())
    assert links.where("similarity < 0.8 or a >= b").isEmpty()


def test_near_links_are_all_pairs(spark, monkeypatch):
    """Links and their numbers against brute force, with classes of many sub-blocks; exact copies are one text."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 5)
    random.seed(14)
    texts = []
    for _ in range(6):
        base = [f"w{random.randint(0, 400)}" for _ in range(200)]
        texts += [edited(base, random.choice([0, 0.005, 0.01, 0.02, 0.03])) for _ in range(25)]
    shingler = Shingler()
    sets = [shingler.set_of(t) for t in texts]
    first = {x.tobytes(): i for i, x in reversed(list(enumerate(sets)))}
    want = {(i, j): jaccard(sets[i], sets[j]) for i in first.values() for j in first.values() if i < j}
    want = {pair: found for pair, found in want.items() if found >= 0.8}
    degrees = collections.Counter(i for pair in want for i in pair)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    classes, links = near_dedup.similarity_join(rows, row_col="doc_id")
    assert {(r.a, r.b): r.similarity for r in links.collect()} == want and links.count() == len(want)
    assert {r.doc_id: r.n_links for r in classes.collect()} == {i: degrees[first[x.tobytes()]] for i, x in enumerate(sets)}


def test_near_pairs_in_a_large_node(spark):
    """Pairs of copies among thousands of texts of one template, nearly as close to one another as the threshold."""
    random.seed(15)
    base = [f"w{i}" for i in range(300)]
    changed = lambda words, n: [f"x{random.random()}" if i in at else w for at in [set(random.sample(range(0, len(words), 6), n))] for i, w in enumerate(words)]
    texts = [changed(base, 10) for _ in range(2600)]
    texts += [changed(base, 2) for _ in range(300)]  # one class of many texts
    pairs = []
    for i in range(0, 400):
        pairs.append((i, len(texts)))
        texts.append(changed(texts[i], 6))
    shingler = Shingler()
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    near = [(a, b) for a, b in pairs if jaccard(shingler.set_of(rows[a][1]), shingler.set_of(rows[b][1])) >= 0.8]
    assert len(near) > 300
    classes, _ = near_dedup.similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), row_col="doc_id")
    of = {r.doc_id: r.class_id for r in classes.collect()}
    assert [pair for pair in near if of[pair[0]] != of[pair[1]]] == []


def test_near_query_on_documents(spark, documents):
    got = {r.doc_id: r.class_id for r in QUERIES["op3_ngram_jaccard_join"](spark, SF).collect()}
    assert got == classes_of(documents)


def test_near_joins_hard_rows(hard, empty):
    got = near_dedup.similarity_join(hard)[0].collect()
    assert len(got) == hard.count()
    assert {r.class_size for r in got if r.doc_id == 18} == {1}  # a null text is a class of its own
    assert near_dedup.similarity_join(empty)[0].count() == 0


def test_leaks(spark, documents, hard, empty):
    random.seed(6)
    items = [(i, " ".join(f"q{random.randint(0, 900)}" for _ in range(30))) for i in range(5)] + [(5, None), (6, ""), (7, "short item")]
    filler = lambda n: " ".join(f"f{random.randint(0, 900)}" for _ in range(n))
    docs = [(i, f"{filler(40)} {edited(items[i][1].split(), s)} {filler(20)}") for i, s in ((0, 0), (1, 0.1), (2, 0.15))]
    docs += [(10, filler(300)), (11, " ".join(items[3][1].split()[:5]) + " " + filler(50)), (12, None), (13, "a SHORT, item b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.leaks(df, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 1), (2, 2), (13, 7)]
    assert [(r.score, r.begin, r.end) for r in got if r.doc_id == 0] == [(1.0, 40, 70)]
    assert sorted(r.doc_id for r in decontaminate.clean(df, benchmark).collect()) == [10, 11, 12]
    assert decontaminate.leaks(hard, benchmark).count() == 0
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(df, benchmark.limit(0)).count() == 0


def test_leaks_that_many_documents_hold(spark):
    """A short item and edited copies with one seed left are found, however many rows hold the items."""
    items = [(1, "a b c d e"), (2, "p q r s t u v w"), (3, "so short")]
    texts = ["x a b c d e y", "x p q r z t u v w y", "x so short y", "x y z"]
    rows = [(i, texts[i % 4]) for i in range(400)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(i, i % 4 + 1, 0.8125 if i % 4 == 1 else 1.0) for i in range(400) if i % 4 < 3]


def test_leaks_in_documents(spark, documents):
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, t in documents if any(f" {i} " in f" {plain(t)} " for i in items)}
    assert want <= {r.doc_id for r in QUERIES["op5_decontamination"](spark, SF).collect()}


def smith_waterman(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table)) / (2 * len(a))


def test_leaks_against_every_pair(spark):
    """Edited copies in longer texts: the pairs that share a run of four words, each aligned whole, at and around the threshold."""
    random.seed(21)
    stock = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(random.choices(stock, k=random.choice([1, 3, 5, 12, 30])))) for i in range(40)]

    def edited(words):
        return [w for x in words for w in random.choice([[x]] * 8 + [[], [x, "zz"], ["yy"]])]

    docs = []
    for i in range(150):
        own = edited(random.choice(items)[1].split()) if i % 3 else []
        docs.append((i, " ".join(random.choices(stock, k=random.randint(0, 40)) + own + random.choices(stock, k=random.randint(0, 40)))))
    docs.append((900, " ".join(t for _, t in items) * 40))  # a very long text that holds every item
    want = {}
    for d, text in docs:
        words = text.split()
        for item, known in items:
            own = known.split()
            size = min(4, len(own))
            runs = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
            if d < 900 and any(tuple(words[i : i + size]) in runs for i in range(len(words) - size + 1)):
                score = smith_waterman(own, words)
                if score >= 0.5:
                    want[d, item] = score
    want |= {(900, item): 1.0 for item, _ in items}
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), benchmark).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(got) == len(want)


def test_items_of_common_phrases_are_found(spark):
    """Every seed of these items is held by many items: the next rarest ones stand in."""
    phrases = ["please answer the following question now", "choose one of the four answers below", "read the text and then reply"]
    items = [(i, " ".join(phrases[(i + k) % 3] for k in range(3))) for i in range(60)]
    docs = [(i, f"x{i} " + items[i][1] + " y") for i in range(60)]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(i, i) for i in range(60)} <= {(r.doc_id, r.item_id) for r in got.collect() if r.score == 1.0}


def test_alignment():
    random.seed(8)
    for _ in range(60):
        a = np.array(random.choices(range(5), k=random.randint(1, 12)), np.uint64)
        b = np.array(random.choices(range(5), k=random.randint(1, 25)), np.uint64)
        assert decontaminate.align(a, b)[0] == pytest.approx(smith_waterman(a.tolist(), b.tolist()))


def test_license_scan(spark, documents, hard, empty):
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    want = {(d, name) for d, t in documents for name, notice in licenses.NOTICES.items() if plain(notice) in plain(t)}
    assert {(r.doc_id, r.license) for r in QUERIES["op6_license_scan"](spark, SF).collect()} == want
    grant = licenses.NOTICES["MIT-grant"].split()
    changed = " ".join(["foo"] * 30 + grant[:20] + ["else"] + grant[21:] + ["bar"] * 9)
    assert [(r.license, r.containment < 1) for r in licenses.scan(spark.createDataFrame([(1, changed)], "doc_id long, text string")).collect()] == [("MIT-grant", True)]
    assert licenses.scan(hard).count() == 0
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(hard, spark.createDataFrame([("x", None), ("y", "")], "license string, text string")).count() == 0
    plan = licenses.scan(hard)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark, hard, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97
    profiles = language.learn(docs)
    found = {r.doc_id: r for r in language.predict(hard, profiles).collect()}
    assert (found[0].lang_pred, found[0].score, found[len(HARD)].lang_pred) == ("und", 0.0, "und")
    place, langs = {(r.lang, r.gram): r["rank"] for r in profiles.collect()}, sorted({r.lang for r in profiles.collect()})
    for row in docs.limit(8).collect():  # a plain sum of out-of-place distances
        own = language.ranked(language.ngrams(row.text)).tolist()
        apart = {lang: sum(abs(place[lang, g] - i) if (lang, g) in place else language.TOP for i, g in enumerate(own)) for lang in langs}
        best = min(langs, key=lambda lang: (apart[lang], lang))
        got = language.predict(docs.where(F.col("doc_id") == row.doc_id), profiles).first()
        assert (got.lang_pred, got.score) == (best, pytest.approx(1 - apart[best] / (language.TOP * len(own))))
    assert language.predict(hard, profiles).count() == hard.count()
    assert language.predict(empty, profiles).count() == 0
    assert {r.lang_pred for r in language.predict(hard, language.learn(docs.limit(0))).collect()} == {"und"}


def test_toxicity(spark, hard, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op10_toxicity"](spark, sf)
    judged = got.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    count = {(r.toxic, r.predicted): r["count"] for r in judged}
    assert count[1, 1] / (count[1, 1] + count.get((1, 0), 0)) > 0.85
    assert count.get((0, 1), 0) / count[0, 0] < 0.02
    assert got.count() == 1000
    machine = toxicity.fit(hard, labels.limit(0))
    assert {r.score < 0.01 for r in toxicity.score(hard, machine).collect()} == {True}
    assert toxicity.score(empty, machine).count() == 0


def test_factors_learn_pairs():
    """Two terms that are harmless alone and toxic together, which weights alone can't tell."""
    random.seed(9)
    rows = [np.array(sorted({i for i in (0, 1) if random.random() < 0.5} | {2 + random.randrange(20)}), np.uint16) for _ in range(4000)]
    labels = np.array([float({0, 1} <= set(r.tolist())) for r in rows], np.float32)
    machine = toxicity.train(np.arange(22), rows, labels)
    assert machine.score([0, 1, 5]) > 0.5 > max(machine.score([0, 5]), machine.score([1, 5]))


def test_scores_are_sums_over_all_pairs(spark, hard):
    """The score of each text against the formula, pair by pair."""
    random.seed(4)
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame([(i, " ".join(random.choices(["Bad", "good", "badly", "é", "insult", "x1"], k=9))) for i in range(30)], "doc_id long, text string"))
    known = sorted(set().union(*(toxicity.buckets(w) for w in ("bad", "badly", "insult", "hello", "日本語", "x"))))
    machine = toxicity.Machine(np.array(known), -0.5, np.array([random.gauss(0, 1) for _ in known]), np.array([[random.gauss(0, 1) for _ in range(toxicity.FACTORS)] for _ in known]))
    index = {t: i for i, t in enumerate(known)}

    def plain(text):
        own = set(re.findall(r"\w+", (text or "").lower()))
        at = [index[b] for b in set().union(*(toxicity.buckets(w) for w in own)) if b in index]
        pairs = sum(float(machine.factors[a] @ machine.factors[b]) for n, a in enumerate(at) for b in at[:n])
        raw = machine.bias + sum(machine.weights[a] for a in at) + pairs / max(1, toxicity.WIDTH * len(own))
        return 1 / (1 + np.exp(-max(-30, min(30, raw))))

    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(round(plain(r.text), 9))
    got = collections.defaultdict(list)
    for r in toxicity.score(docs, machine).collect():
        got[r.doc_id].append(round(r.score, 9))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_toxicity_of_pairs_alone(spark):
    """Labels that no single word tells: exactly one of two words. Repeated ids with conflicting labels take the largest."""
    random.seed(3)
    stock = ["".join(random.choices("abcdefghijklmnop", k=random.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(3000):
        a, b = random.random() < 0.5, random.random() < 0.5
        text = random.choices(stock, k=random.randint(5, 30)) + ["insult"] * a + ["group"] * b
        random.shuffle(text)
        rows.append((i, " ".join(text)))
        labels += [(i, int(a != b)), (i, 0)][: 1 + (i % 5 == 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    want = {}
    for i, label in labels:
        want[i] = max(label, want.get(i, 0))
    judged = [(r.score >= 0.5) == (want[r.doc_id] == 1) for r in toxicity.score(docs, machine).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(judged) / len(judged) > 0.95


def test_held_out_rows_do_not_teach(spark):
    docs = spark.createDataFrame([(i, "aaaa bbbb" if zlib.crc32(str(i).encode()) % 4 == 2 else "cccc dddd", "xx") for i in range(40)], "doc_id long, text string, lang string")
    grams = {r.gram for r in language.learn(docs).collect()}
    assert ord("c") in grams and ord("a") not in grams


def test_pipeline(spark, documents):
    plain = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    left = [(d, t) for d, t in documents if any(c.isalpha() for c in t or "")]
    first = {}
    for d, t in left:
        first.setdefault(plain(t), d)
    left = [(d, t) for d, t in left if first[plain(t)] == d]
    classes = classes_of(left)
    left = [(d, t) for d, t in left if classes[d] == d]
    leaked = {r.doc_id for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    library = Tokenizer.from_file(WORD_BPE)
    want = [(d, len(library.encode(t, add_special_tokens=False).ids)) for d, t in left if d not in leaked]
    got = QUERIES["pipeline"](spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want


def test_stages_on_hard_and_empty_rows(spark, hard, empty):
    for df in (hard.withColumn("lang", F.lit("en")), empty.withColumn("lang", F.lit("en"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "token_ids" or out.columns == df.columns
            assert out.count() <= df.count()


def test_work_folder_is_the_shared_one(spark):
    assert work_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert not os.path.exists(work_folder(spark))
