"""Operators 1 to 8 on odd rows, empty tables and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from paths import SF, TINY

from terrane.llm import chat, decontaminate, langid, lm, pieces, pii, quality, queries, simhash
from terrane.llm.shared import documents
from terrane.llm.text import Words, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- kernels

def test_words_and_hashes():
    texts = ["a bb  ccc", None, "", "x" * 100 + " y", "Éa\tb\n" + "z" * 9]
    w = Words(pa.array(texts, pa.string()))
    assert [w.word(k).decode() for k in range(len(w.starts))] == [x for t in texts for x in WORD.findall(t or "")]
    assert w.n_words.tolist() == [3, 0, 0, 2, 3]
    again = Words(pa.array(["y " + "x" * 100, "zzzzzzzzz b"], pa.string()))
    assert set(again.hashes()) <= set(w.hashes()) and len(set(w.hashes())) == len(w.starts)


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["a" * 10, None, "", "b" * 50, "c"])})
    assert sum(p.num_rows for p in slices(batch, "t", 20)) == 5
    assert list(slices(batch.slice(0, 0), "t")) == []


# ---- 1

def _passage(rng, vocabulary, n):
    return [rng.choice(vocabulary) for _ in range(n)]


def _leaky(spark):
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in", "is"]
    rare = [f"w{k}" for k in range(6000)]
    draw = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [(k, " ".join(draw(rng.randint(14, 60)))) for k in range(60)]
    rows, truth = [], set()
    for doc in range(400):
        words = draw(rng.randint(40, 400))
        if doc % 5 == 0:
            item, text = items[(doc // 5) % 60]
            part = text.split()
            if doc % 10 == 0:  # a paraphrase: a sixth of the words gone, another sixth replaced
                part = [rng.choice(rare) if rng.random() < 1 / 6 else w for w in part if rng.random() > 1 / 6]
            at = rng.randint(0, len(words))
            words[at:at] = part
            truth.add((doc, item))
        rows.append((doc, " ".join(words).capitalize() + "."))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), truth


def test_planted_items_are_found(spark):
    docs, items, truth = _leaky(spark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got <= truth and len(got & truth) >= 0.9 * len(truth)


def test_candidates_recall_against_brute_force_cosine(spark):
    """Latent candidates against exact TF-IDF cosines of all passages and items."""
    docs, items, _ = _leaky(spark)
    rows, bench = docs.collect(), items.collect()
    df = Counter(t for r in rows for t in set(WORD.findall(lower(r.text).replace(".", " "))))
    idf = lambda t: max(math.log((len(rows) + 1) / (df[t] + 0.5)), 0.05)
    known = {t for b in bench for t in b.text.split()}
    weight = lambda t: idf(t) if t in known else math.log((len(rows) + 1) / 1.5)
    vectors = [({t: math.sqrt(c) * weight(t) for t, c in Counter(b.text.split()).items()}, b.item_id) for b in bench]
    near = set()
    for r in rows:
        words = WORD.findall(lower(r.text).replace(".", " "))
        for at in range(0, max(len(words) - 24, 1), 24):
            p = {t: math.sqrt(c) * weight(t) for t, c in Counter(words[at : at + 48]).items()}
            size = math.sqrt(sum(v * v for v in p.values()))
            for q, item in vectors:
                if sum(p.get(t, 0) * v for t, v in q.items()) / size / math.sqrt(sum(v * v for v in q.values())) >= 0.35:
                    near.add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.candidates(docs, items).collect()}
    assert len(near) > 50 and len(near & got) >= 0.9 * len(near)


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "The end of a plain line. Another line of it."), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()} == {(1, 1)}
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.where("item_id > 1")).count() == 0


def test_blocks_agree(spark):
    docs, items, _ = _leaky(spark)
    one, many = ({(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, block=b).collect()} for b in (2000, 25))
    assert one == many


def test_blocks_are_bounded_by_terms(spark, monkeypatch):
    docs, items, _ = _leaky(spark)
    monkeypatch.setattr(decontaminate, "BLOCK_TERMS", 250)
    sizes = [len(set(np.concatenate([x.words for x in b]).tolist())) for b in decontaminate._blocks(items, 2000)]
    assert max(sizes) <= 250 and len(sizes) > decontaminate.PASS_BLOCKS
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} >= {(5, 1), (15, 3)}


def _verdicts(texts, items):
    """Brute force: every item against every stretch of every document, without any cosine."""
    told = decontaminate.read_items(items)
    out = set()
    for doc, text in texts:
        h = decontaminate._hashes([text or ""])[0]
        n = len(h)
        for at in range(0, max(n - 24, 1), 24):
            inside = set(h[max(at - 60, 0) : at + 108].tolist())
            for x in told:
                if sum(k in inside for k in x.words.tolist()) >= decontaminate.LCS_WITH_ANSWER * len(x.words):
                    region = h[max(at - len(x.words), 0) : min(at + 48, n) + len(x.words)]
                    ratio = decontaminate.lcs(x.words, region) / len(x.words)
                    if ratio >= decontaminate.LCS_ALONE or ratio >= decontaminate.LCS_WITH_ANSWER and decontaminate.lcs(x.answer, region) >= 0.6 * len(x.answer):
                        out.add((doc, x.item_id))
    return out


def test_recall_against_the_check_of_all_pairs(spark):
    """The tables as they are, and paraphrases of every item in long documents, at the threshold of the query."""
    docs, items = documents(spark, TINY), spark.read.parquet(f"{TINY}/benchmark.parquet")
    bench = [(r.item_id, r.text) for r in items.collect()]
    rng = random.Random(12)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    words = [w for _, t in texts for w in t.split()]
    for k, (text, rate) in enumerate((t, r) for _, t in bench for r in (1 / 12, 1 / 8, 1 / 6)):
        part = [rng.choice(words) if rng.random() < rate else w for w in text.split() if rng.random() > rate]
        at = rng.randint(0, 200)
        texts.append((10_000 + k, " ".join([*rng.choices(words, k=at), *part, *rng.choices(words, k=200 - at)])))
    want = _verdicts(texts, bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    print(f"recall {len(got & want) / len(want):.4f} of {len(want)}, beyond brute force {len(got - want)}")
    assert len(want) > 50 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_sample_is_bounded_whatever_repeats(spark):
    """Rows without an id are drawn by their text, copies of a row once."""
    from pyspark.sql import functions as F

    lost = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text of row "), "id").alias("text"))
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    drawn = decontaminate._read(lost.union(same), np.zeros(1, np.uint64), 300).drawn.count()
    assert 0 < drawn < 300


def _weighed(words, number, idf):
    """Rows of words as TF-IDF vectors of length one."""
    out = np.zeros((len(words), len(number)))
    for k, row in enumerate(words):
        for t, c in Counter(row).items():
            out[k, number[t]] = math.sqrt(c) * idf[number[t]]
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_latent_space_is_of_all_passages(spark, monkeypatch):
    """30,000 passages, each document with terms of its own, against an exact SVD of all of them (as many dimensions tried as terms)."""
    monkeypatch.setattr(decontaminate, "OVERSAMPLE", 300)
    rng = random.Random(3)
    topics = [[f"t{d}x{k}" for k in range(25)] for d in range(12)]
    docs = [_passage(rng, topic, 24 * 2501) for topic in topics]
    number = {t: k for k, t in enumerate(t for topic in topics for t in topic)}
    items = [_passage(rng, list(number), 30) for _ in range(40)]
    idf = np.full(len(number), math.log((len(docs) + 1) / 1.5))
    queries = _weighed(items, number, idf)
    # words outside the items only add to a passage's length
    passages = [_weighed([d[at : at + 48] for at in range(0, len(d) - 24, 24)], number, idf) * queries.any(0) for d in docs]
    rank, n = 12, sum(map(len, passages))
    gram = sum(p.T @ p for p in passages) + n / len(items) * queries.T @ queries
    basis = np.linalg.eigh(gram)[1][:, -rank:]
    latent = queries @ basis
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    near = {(d, i): x for d, p in enumerate(passages) for i, x in enumerate(np.maximum(p @ basis @ latent.T, p @ queries.T).max(0))}
    frames = (spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id")))
    got: dict = {}
    for r in decontaminate.candidates(*frames, rank=rank).collect():
        got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), r.cosine)
    want = {k for k, x in near.items() if x >= decontaminate.COSINE + 0.001}
    assert n == 30_000 and len(want) > 100 and want <= got.keys()
    assert max(abs(near[k] - x) for k, x in got.items()) < 0.001


def test_products_of_terms_by_brute_force(spark, monkeypatch):
    """Every way to sum them (matrix product, table, sorted keys sent early), for two blocks in one pass."""
    docs, items, _ = _leaky(spark)
    for name, value in (("GRAM_DENSE", 4), ("GRAM_CELLS", 4000), ("GRAM_PAIRS", 64), ("GRAM_HELD", 512), ("SHARD_CELLS", 5000)):
        monkeypatch.setattr(decontaminate, name, value)
    blocks, others = [], np.full(decontaminate.BUCKETS, 2.0, np.float32)
    for rows in (items.where("item_id < 40").collect(), items.where("item_id >= 40").collect()):
        terms = [t for t, _ in Counter(t for r in rows for t in r.text.split()).most_common()]
        blocks.append((terms, np.linspace(1, 3, len(terms))))
    hashed = [(np.concatenate(decontaminate._hashes(terms)), idf) for terms, idf in blocks]
    want = [np.zeros((len(terms),) * 2) for terms, _ in blocks]
    for r in docs.collect():
        words = WORD.findall(lower(r.text).replace(".", " "))
        for at in range(0, max(len(words) - 24, 1), 24):
            count = Counter(words[at : at + 48])
            for (terms, idf), sums in zip(blocks, want, strict=True):
                weight = dict(zip(terms, idf, strict=True))
                row = np.array([math.sqrt(count[t]) * weight[t] for t in terms])
                row /= math.sqrt(sum(c * weight.get(t, 2.0) ** 2 for t, c in count.items()))
                some = np.flatnonzero(row)
                sums[np.ix_(some, some)] += np.outer(row[some], row[some])
    got = [np.zeros_like(x) for x in want]
    for r in decontaminate.term_products(docs, hashed, others).collect():
        n = len(got[r.block])
        cell = np.frombuffer(r.cell, "<i4")
        got[r.block][cell // n * decontaminate._shards(n) + r.shard, cell % n] += np.frombuffer(r.value, "<f4")
    for a, b in zip(got, want, strict=True):
        assert np.abs(a - np.triu(b)).max() < 1e-3


def test_more_items_than_dimensions(spark):
    """2,000 items in one block: verbatim and paraphrased leaks in long documents, all found."""
    rng = random.Random(11)
    rare = [f"w{k}" for k in range(20_000)]
    draw = lambda n: _passage(rng, rare, n)
    items = [(k, draw(rng.randint(15, 30))) for k in range(2000)]
    rows, truth = [], set()
    for doc in range(300):
        item, part = items[doc * 6]
        if doc % 2:
            part = [rng.choice(rare) if rng.random() < 1 / 8 else w for w in part if rng.random() > 1 / 12]
        words, at = draw(400), rng.randint(100, 300)
        words[at:at] = part
        rows.append((doc, " ".join(words)))
        own, region = (np.array([int(w[1:]) for w in x]) for x in (items[doc * 6][1], part))
        if decontaminate.lcs(own, region) >= decontaminate.LCS_ALONE * len(own):
            truth.add((doc, item))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(truth) > 200 and len(truth - got) == 0 and all(item == 6 * doc for doc, item in got)


def test_cosines_do_not_depend_on_corpus_size(spark):
    from pyspark.sql import functions as F

    docs, items, truth = _leaky(spark)
    few, many = ({(r.doc_id, r.item_id): r.cosine for r in decontaminate.contaminated(d, items).collect()} for d in (docs, docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))))
    assert few.keys() == many.keys() and max(abs(few[k] - many[k]) for k in few) < 0.03


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 20)).astype(np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


# ---- 2

def test_language_model_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, TINY).collect()]
    got = {r.doc_id: r for r in lm.score(documents(spark, TINY), langid.held_out(5, 1)).collect()}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    train = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    c = Counter(t for i in train for t in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel=1e-12)
        assert r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution(spark):
    """Every next token of a context, the unknown one included, adds up to one."""
    corpus = [(k, " ".join(random.Random(k).choices("abcd", k=6))) for k in range(60)]
    probes = [(1000 + k, x) for k, x in enumerate(["a", "a a", "a b", "a c", "a d", "a zz"])]
    df = spark.createDataFrame(corpus + probes, "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r.doc_id: 10**r.score for r in lm.score(df, F.col("doc_id") >= 1000).collect()}
    weights = lm.learn_weights(np.zeros((0, 4), np.int64), 0.1)
    assert np.allclose(weights.sum(1), 1) and weights[0, 0] == 0
    assert all(0 < p < 1 for p in got.values())


def test_two_hops_give_the_answers_of_one(spark):
    """Many small groups: the merged exchange returns what the direct one does, in fewer rows."""
    docs = documents(spark, TINY)
    one, two = (sorted(lm.score(docs, langid.held_out(5, 1), group_bytes=4000, direct=d).collect()) for d in (10_000, 16))
    assert one == two and len(one) == docs.count()


def test_exchange_grows_by_less_than_the_square(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, SF)
    rows = lambda g: docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(g)).alias("g"), "text", F.lit(True).alias("train"))
    sent = [lm._exchange(rows(g), g, 4)[0].count() for g in (25, 100)]
    assert sent[0] <= 25 * 5 and sent[1] <= 100 * 10


def test_copies_of_one_row_are_dealt_to_several_groups(spark):
    """A row repeated far beyond a group's size, and null ids: scores as by brute force over the same counts."""
    rows = [(1, "the same words again and again " * 20)] * 400 + [(None, f"a b c {k}") for k in range(200)] + [(k, f"the words {k % 7} again") for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = (lm.score(df, langid.held_out(5, 1), group_bytes=b).collect() for b in (3000, 1 << 20))
    for r in small + large:
        assert r.train_tokens == small[0].train_tokens
    base = lambda x: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 9)) for r in x)
    assert base(small) == base(large) and len(small) == len(rows)


def test_em_finds_the_better_part():
    cells = np.array([[3, 0, 40, 900], [3, -1, 12, 100]])
    w = lm.learn_weights(cells, 1e-6)[3]
    assert w[0] > 0.85 and w.sum() == pytest.approx(1)


def test_language_model_odd_rows(spark, odd, none):
    got = lm.score(odd, langid.held_out(5, 1)).collect()
    assert len(got) == odd.count() and [r.n_tokens for r in got if r.doc_id == 2] == [1]
    assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 1 for r in got) == 2
    assert lm.score(none, langid.held_out(5, 1)).count() == 0


# ---- 3

TALK = "conv_id long, turn long, role string, text string, window long"


def _digest(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "\\|", "<", "|", "<\\|", "word ", "\n", "é🙂", ""]
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and c % 2 else ("user" if t % 2 else "assistant")
            rows.append((c, t, role, "".join(rng.choices(bits, k=rng.randint(0, 40))), 0))
    for budget, history in ((60, 20), (400, 100)):
        windows = chat.windows(spark.createDataFrame(rows, TALK), budget, history)
        got = {r.conv_id: r for r in chat.digests(windows).collect()}
        for c in range(30):
            own = [(r, t) for i, _, r, t, _ in rows if i == c]
            loss = "".join(t for r, t in own if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256) == (len(own), _digest(own))
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        for w in windows.collect():
            assert not w.over_budget or w.n_turns == 1
            if w.conv_id % 2 and w.window:
                assert chat.parse(w.text)[0][0] == "system"


def test_chat_odd_rows(spark):
    rows = [(1, None, "user", "first", 0), (1, 0, None, None, 0), (1, 0, "a\nb", "x", 0), (None, 0, "user", "lost", 0), (1, 0, "a\nb", "x", 0), (2, 0, "assistant", "y" * 50_000, 1)]
    got = {r.conv_id: r for r in chat.digests(chat.windows(spark.createDataFrame(rows, TALK), 100, 20)).collect()}
    assert got[1].turns_sha256 == _digest([("user", "first"), ("", ""), ("a\nb", "x"), ("a\nb", "x")])
    assert got[None].n_turns == 1 and got[2].loss_chars == 50_000 and got[2].n_over_budget == 1
    assert chat.digests(chat.windows(spark.createDataFrame([], TALK))).count() == 0


def test_budget_counts_tokens_of_the_vocabulary(spark):
    """Every window's tokens, counted again with the library from the written text."""
    import base64

    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in queries.vocabulary("byte_bpe_multi_50k.tiktoken").splitlines())}
    library = tiktoken.Encoding("b", pat_str=queries.RANK_PATTERN, mergeable_ranks=merges, special_tokens={})
    count = lambda t: len(library.encode_ordinary(t))
    ranks = chat.Ranks(spark, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.RANK_PATTERN)
    told = spark.read.parquet(f"{TINY}/conversations.parquet")
    for w in chat.windows(told, 300, 60, measure=ranks).collect():
        turns = re.findall(r"<\|im_start\|>([^\n]*\n)(.*?)<\|im_end\|>\n", w.text, re.S)
        assert w.n_tokens == sum(count(a) + count(b) + 3 for a, b in turns) and (w.n_tokens <= 300 or w.over_budget)


def test_hostile_conversation(spark):
    r = {r.conv_id: r for r in queries.op3_budgeted_chat(spark, TINY).collect()}[-1]
    assert r.n_turns == 2 and r.turns_sha256 == _digest([("user", queries.HOSTILE), ("assistant", queries.HOSTILE)])


# ---- 4

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _base(t):
    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return found + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(3)
    bits = ["1", "2", "0", "5", "25", "255", "256", ".", ".", "-", " ", "+", "(", ")", "@", "a", "B", "_", "é", "4111111111111111", "\n", "x.y"]
    for _ in range(20_000):
        t = "".join(rng.choices(bits, k=rng.randint(1, 30)))
        assert sorted(pii.base_spans(t)) == sorted(_base(t)), t
    for r in documents(spark, SF).collect():
        assert sorted(pii.base_spans(r.text)) == sorted(_base(r.text))


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("to jane at example dot org please", "email", "jane at example dot org"),
        ("jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("a​b@c​.de", "email", "a​b@c​.de"),
        ("call plus four nine one seven six one two three four five six ok", "phone", "plus four nine one seven six one two three four five six"),
        ("＋１ ３８９ ５５５ ５０１０", "phone", "＋１ ３８９ ５５５ ５０１０"),
        ("ip 192 (dot) 168 (dot) 1 (dot) 1", "ip", "192 (dot) 168 (dot) 1 (dot) 1"),
        ("card four one one one 1111 1111 1111.", "card", "four one one one 1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, every = pii.find(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in every] == [(kind, span)]
    assert pii.redact(text, every) == text.replace(span, f"<{kind.upper()}>")


def test_clean_prose_is_left_alone(spark):
    for text in ("look at the dot one two", "Meet at noon. One of two, three or four.", "naïve — “quoted” text…", "a at b dot c"):
        assert pii.find(text) == ([], [])
    assert all(pii.find(r.text)[0] == pii.find(r.text)[1] for r in documents(spark, TINY).collect())


@pytest.mark.parametrize("text", ["4111–1111–1111–1111", "4111‐1111‑1111−1111", "+49\u00a0151\u00a023456789", "192．168．1．1", "jane@example。com", "jane@example․com", "four 111 1111 1111 11111", "jane\u00a0at\u00a0example\u00a0dot\u00a0com"])
def test_a_disguise_is_found_whatever_else_the_text_holds(text):
    whole = {pii.normalise(text).source(a, b) for _, a, b in pii.base_spans(pii.normalise(text).text)}
    assert whole or text.startswith("four")
    assert {(a, b) for _, a, b in pii.find(text)[1]} == whole
    assert [s[0] for s in pii.find(text + " ж а")[1]] == [s[0] for s in pii.find(text)[1]]


@pytest.mark.parametrize("text", ["jоhn@example.com", "john@example.cоm", "+49 151 2345678９", "192.168.1.1１"])
def test_a_truncated_base_match_does_not_hide_the_whole(text):
    base, every = pii.find(f"to {text} now")
    assert set(base) <= set(every) and any((a, b) == (3, 3 + len(text)) for _, a, b in every)
    assert re.fullmatch("to <[A-Z]+> now", pii.redact(f"to {text} now", every))


@pytest.mark.parametrize("text", ["ivan at mail dot ru", "bob at example dot it", "jane at example.com", "Jane At Example Dot Com", "jane  at  example  dot  com", "john dot doe at example dot com", "192 dot 168 dot 1 dot 1"])
def test_spelled_marks_without_brackets(text):
    for before, after in (("", ""), ("mail ", " now"), ("contact: ", ".")):
        assert any((a, b) == (len(before), len(before + text)) for _, a, b in pii.find(before + text + after)[1])


@pytest.mark.parametrize("text", ["He works at example.com now.", "We looked at the dot on the map.", "Look at example.com", "She stared at one dot in it", "available at www.example.com"])
def test_spelled_marks_in_prose(text):
    assert pii.find(text) == ([], [])


def test_the_gate_is_a_necessary_condition(monkeypatch):
    """With and without it every text has the same spans."""
    rng = random.Random(5)
    bits = ["at", "dot", "AT", "Dot", " ", "  ", "@", ".", "[at]", "(dot)", "{ . }", "one", "two", "four", "1", "23", "192", "ю", "о", "‑", "\u00a0", "john", "example", "com", "plus", "+", "-", "\n", ",", "İ", "ſ", "\u212a", "mail", ":", "\t"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 24))) for _ in range(30_000)]
    gated = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    assert gated == [pii.find(t) for t in texts]


def test_spans_do_not_depend_on_text_beside_them():
    rng = random.Random(9)
    disguised = ["card 4111\u20111111\u20111111\u20111111", "card 4111\u00a01111\u00a01111\u00a01111", "four 111 1111 1111 11111", "j\u043ehn@example.com", "jane at example dot org", "192 (dot) 168 (dot) 1 (dot) 1", "a@b.de"]
    clean = ["Plain words. ", "\u200b", "ж ", "naïve \u2014 text ", "Meet at noon. ", "№ 5\n"]
    for text in disguised:
        _, alone = pii.find(text)
        for _ in range(20):
            before, after = "".join(rng.choices(clean, k=3)) + "\n", "\n" + "".join(rng.choices(clean, k=3))
            assert pii.find(before + text + after)[1] == [(k, a + len(before), b + len(before)) for k, a, b in alone], (before, text, after)


def test_kept_columns_may_not_clash(spark, odd):
    for run in (lambda d: pii.scan(d, keep=["spans"]), lambda d: pieces.encode(d, queries.vocabulary("piece_bpe_32k.model"), keep=["IDs"]), lambda d: langid.identify(d, langid.Model([], np.zeros((2, 0)), 1), keep=["score"])):
        with pytest.raises(ValueError, match="named like"):
            run(odd.withColumn("spans", odd.text).withColumn("IDs", odd.text))


def test_pii_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000, "a@" * 50_000, "one " * 20_000):
        pii.find(text)


def test_pii_odd_rows(spark, odd, none):
    got = pii.scan(odd).collect()
    assert len(got) == odd.count() and all(r.spans == "" for r in got)
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert [r.redacted for r in got if r.doc_id == 2] == [None]
    assert pii.scan(none).count() == 0


# ---- 5

def _fingerprint(text, n=3):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(len(w) - n + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(values):
    """Brute-force components of (id, fingerprint): {id: smallest id}."""
    left, out = dict(values), {}
    while left:
        seed = min(left)
        group, todo = {seed}, [left.pop(seed)]
        while todo:
            f = todo.pop()
            for i in [i for i, x in left.items() if (x ^ f).bit_count() <= 2]:
                group.add(i)
                todo.append(left.pop(i))
        out |= dict.fromkeys(group, min(group))
    return out


def test_fingerprints_and_classes_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, TINY).collect()]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, TINY)).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == {i: _fingerprint(t) for i, t in rows}
    assert {i: r.component_id for i, r in got.items()} == _classes([(i, _fingerprint(t)) for i, t in rows])


def test_links_on_dense_fingerprints(spark):
    """Chains and clouds of fingerprints around few centres, against all pairs."""
    rng = random.Random(8)
    values = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            values.add(f)
            g = f ^ (1 << rng.randrange(64)) if rng.random() < 0.5 else f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            f = g if rng.random() < 0.7 else f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    index = {s: k for k, s in enumerate(signed)}
    # stars through shared neighbours join within four bits, so compare the classes
    star = dict(enumerate(range(len(values))))

    def root(x):
        while star[x] != x:
            x = star[x]
        return x

    for u, v in edges:
        a, b = root(index[u]), root(index[v])
        star[max(a, b)] = min(a, b)
    assert {k: root(k) for k in star} == _classes(list(enumerate(values)))


def test_near_duplicates_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    empty = {r.doc_id: r for r in got if r.fingerprint == "0" * 16}
    assert set(empty) == {2, 3, 4} and {r.component_id for r in empty.values()} == {2}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


# ---- 6

@pytest.fixture(scope="module")
def model():
    return queries.vocabulary("piece_bpe_32k.model")


def test_encoding_equals_the_library(spark, model):
    machine, library = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    letters = list("aaabbteo ne rs  \n\tthe▁é😀漢字и1.,&&'")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(5000)]
    known = [p for p in machine.pieces if len(p) > 3]
    texts += ["".join(rng.choice(known).replace("▁", rng.choice([" ", ""])) for _ in range(rng.randint(0, 6))) for _ in range(5000)]
    texts += [r.text for r in documents(spark, TINY).collect()]
    assert [machine.encode(t).tolist() for t in texts] == library.encode(texts, num_threads=1)
    assert all(machine.decode(machine.encode(t)) == t.replace("▁", " ") for t in texts)


def _field(number, value):
    return bytes([number << 3 | 2, len(value)]) + value


def test_unigram_path_is_the_cheapest():
    import itertools
    import struct

    vocabulary = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.2, "ba": -5.0, "aba": -9.0}
    parts = [_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02")]
    parts += [_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", s)) for p, s in vocabulary.items()]
    parts += [_field(2, b"\x18\x01"), _field(3, b"\x18\x01\x20\x00")]
    machine = pieces.Transducer(b"".join(parts))
    for text in map("".join, itertools.product("ab", repeat=6)):
        full = "▁" + text
        best = [0.0] + [math.inf] * len(full)
        for end in range(1, len(full) + 1):
            best[end] = min(best[s] - vocabulary.get(full[s:end], -math.inf) for s in range(end))
        assert -sum(machine.scores[k] for k in machine.encode(text)) == pytest.approx(best[-1])
    assert machine.encode("z").tolist()[-1] == 0


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _blob(number, value):
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _unigram(rules=b"", squeeze=True, fallback=False, prefix=True):
    """A unigram model of some syllables, built by hand with a normaliser of the library's own."""
    import struct

    rng = random.Random(4)
    vocabulary = {"▁": -2.5} | {c: -5.0 - k / 7 for k, c in enumerate("abcdefghijklmnopqrstuvwxyzé1.")}
    while len(vocabulary) < 300:
        vocabulary[rng.choice(["", "▁"]) + "".join(rng.choices("abcdeinorst", k=rng.randint(2, 5)))] = -rng.uniform(3, 12)
    parts = [_blob(1, _blob(1, p) + b"\x15" + struct.pack("<f", 0.0) + bytes([0x18, t])) for p, t in ((b"<unk>", 2), (b"<s>", 3), (b"</s>", 3))]
    if fallback:
        parts += [_blob(1, _blob(1, f"<0x{k:02X}>".encode()) + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x06") for k in range(256)]
    parts += [_blob(1, _blob(1, p.encode()) + b"\x15" + struct.pack("<f", x)) for p, x in vocabulary.items()]
    parts += [_blob(2, b"\x18\x01" + (_varint(35 << 3) + b"\x01" if fallback else b"")), _blob(3, _blob(1, b"own") + (_blob(2, rules) if rules else b"") + bytes([0x18, prefix, 0x20, squeeze]))]
    return b"".join(parts)


@pytest.mark.parametrize(("name", "squeeze", "fallback", "prefix"), [("nmt_nfkc", True, True, True), ("nfkc_cf", True, False, True), ("nfkc", False, True, True), (None, True, True, False), (None, False, False, True)])
def test_unigram_models_and_normalisers_equal_the_library(spark, name, squeeze, fallback, prefix):
    rules = dict(pieces._fields(dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto()))[3]))[2] if name else b""
    proto = _unigram(rules, squeeze, fallback, prefix)
    machine, library = pieces.Transducer(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(7)
    letters = [*"aabbcdeeinorst  ", "\t", "\n", "é", "e\u0301", "Å", "ﬁ", "①", "ｆｕｌｌ", "漢", "🙂", "\u200b", "½", "…", "Ω", "ß", "İ", "  ", "\u3000", "가", "\u1100\u1161", ".", "1", "▁"]
    texts = ["", " ", "   ", *("".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(3000)), *(r.text.lower() for r in documents(spark, TINY).limit(40).collect())]
    wrong = [(t, machine.encode(t).tolist(), y) for t, y in zip(texts, library.encode(texts, num_threads=1)) if machine.encode(t).tolist() != y]
    assert wrong == [] and all(library.normalize(t) == ("▁" * (prefix and machine.normal(t) != "")) + machine.normal(t).replace(" ", "▁") for t in texts if "▁" not in t)
    assert not fallback or all(machine.decode(machine.encode(t)) == machine.normal(t) for t in texts if "▁" not in t and not machine.normal(t).startswith(" "))


def test_tables_are_decoded(spark, odd, none, model):
    got = {(r.doc_id, r.source): r.decoded for r in pieces.decode(pieces.encode(odd, model, keep=["doc_id", "source"]), model, keep=["doc_id", "source"]).collect()}
    assert got == {(r.doc_id, r.source): (r.text or "").replace("▁", " ") for r in odd.collect()}
    assert pieces.decode(pieces.encode(none, model), model).count() == 0


def test_pieces_odd_rows(spark, odd, none, model):
    got = {r.doc_id: r for r in pieces.encode(odd, model).collect()}
    assert got[2].ids == [] and got[3].ids == [] and got[5].round_trip and got[6].round_trip
    assert not got[7].round_trip  # the space mark reads as a space
    assert pieces.encode(none, model).count() == 0


# ---- 7

def _rated(spark, df):
    return quality.rate(df, queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.RANK_PATTERN)


def test_quality_counts_against_brute_force(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = {r.doc_id: r.text for r in documents(spark, TINY).collect()}
    for r in _rated(spark, documents(spark, TINY)).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = list(zip(w, w[1:], w[2:]))
        often = Counter(windows)
        words = {k + d for k, g in enumerate(windows) if often[g] > 1 for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(words))
        assert r.base_failed == (len(w) < 50 or 100 * len(words) > 50 * len(w)) and not (r.base_failed and r.kept)
        ids = [i for x in library.encode(w) for i in x]
        p = np.array(list(Counter(ids).values())) / len(ids)
        assert r.n_tokens == len(ids) and r.entropy == pytest.approx(-(p * np.log2(p)).sum())


def test_long_words_are_whole(spark, model):
    """Words beyond any size are encoded as the libraries do, whatever stands beside them."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["x" * 10_000, "=" * 9000, "ab-" * 40_000, "x" * 9000 + " " + "x" * 9000 + " y"]
    for r in _rated(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.n_tokens == sum(map(len, library.encode(texts[r.doc_id].split())))


def test_fertility_measures_against_brute_force(spark, model):
    """Characters per token, byte share and script, and the verdict that follows from them and the quartiles."""
    import base64

    import tiktoken
    import unicodedata

    merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in queries.vocabulary("byte_bpe_multi_50k.tiktoken").splitlines())}
    byte_level = tiktoken.Encoding("b", pat_str=queries.RANK_PATTERN, mergeable_ranks=merges, special_tokens={})
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = {r.doc_id: r for r in documents(spark, TINY).collect()}
    got = _rated(spark, documents(spark, TINY)).collect()
    judged = {}
    for r in got:
        w = WORD.findall(docs[r.doc_id].text)
        ids = [i for x in library.encode(w) for i in x]
        second = sum(len(byte_level.encode_ordinary(" " + x)) for x in w)
        assert r.chars_per_token == pytest.approx(sum(map(len, w)) / max(len(ids), 1)) and r.chars_per_byte_token == pytest.approx(sum(map(len, w)) / max(second, 1))
        assert r.byte_share == pytest.approx(sum(map(library.is_byte, ids)) / max(len(ids), 1))
        names = Counter(unicodedata.name(c, "?").split()[0].lower() for c in docs[r.doc_id].text if c.isalpha())
        assert not names or r.script == names.most_common(1)[0][0]
        if not r.base_failed and len(ids) >= quality.MIN_TOKENS:
            judged.setdefault((r.script, docs[r.doc_id].lang), []).append(round(r.chars_per_byte_token, 3))
    for r in got:
        band = quality.BANDS[r.script]
        fine = r.n_tokens < quality.MIN_TOKENS or band.chars_low <= r.chars_per_token <= band.chars_high and band.chars_low / 2 <= r.chars_per_byte_token <= band.chars_high and r.byte_share <= band.byte_share and r.entropy >= band.entropy_low
        own = sorted(judged.get((r.script, docs[r.doc_id].lang), []))
        if fine and len(own) >= quality.MIN_TEXTS and r.n_tokens >= quality.MIN_TOKENS:
            q = [own[max(math.ceil(len(own) * p) - 1, 0)] for p in (0.25, 0.5, 0.75)]
            reach = quality.FENCE * max(q[2] - q[0], quality.LEAST_SPREAD * q[1])
            fine = q[0] - reach <= r.chars_per_byte_token <= q[2] + reach
        assert r.kept == (fine and not r.base_failed)


def test_scripts_by_code_point():
    texts = {"Tiếng Việt ạ ế": "latin", "한국어 문장": "hangul", "日本語 です": "han", "Привет": "cyrillic", "ελληνικά": "greek", "שלום": "hebrew", "مرحبا": "arabic", "ქართული": "other", "": "latin", "12": "latin"}
    w = Words(pa.array(list(texts)))
    assert [quality._SCRIPTS[k] for k in quality.scripts_of(w.data, np.stack([w.doc_start, w.doc_end], 1))] == list(texts.values())


def test_quality_bands(spark):
    rng = random.Random(1)
    prose = " ".join(rng.choices("the quick brown fox jumps over lazy dogs while small birds sing near old houses and rivers".split(), k=200))
    noise = " ".join("".join(rng.choices("அஜሀቀ", k=12)) + str(k) for k in range(200))
    junk = " ".join("".join(rng.choices("\ue000\ue001\ue002\ue003", k=10)) + "ab"[k % 2] for k in range(200))
    got = {r.doc_id: r for r in _rated(spark, spark.createDataFrame([(1, prose), (2, noise), (3, junk)], "doc_id long, text string")).collect()}
    assert not got[3].kept and got[3].byte_share > 0.5 and got[2].script == "other"
    assert got[1].script == "latin" and got[1].byte_share == 0


def test_bands_of_languages_part_symbols_from_prose(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, SF)
    rated = queries.op7_fertility_quality(spark, SF).where("not base_failed and n_tokens >= 64")
    n, clean, junk, clean_out, junk_out = rated.join(docs.select("doc_id", "lang"), "doc_id").where("lang = 'en'").withColumn("junk", F.expr("n_symbols > 0.3 * n_words")).agg(F.count("*"), F.sum(F.expr("int(not junk)")), F.sum(F.expr("int(junk)")), F.sum(F.expr("int(not junk and not kept)")), F.sum(F.expr("int(junk and not kept)"))).first()
    assert n > 100 and clean_out <= 0.02 * clean and junk_out >= 0.8 * junk > 0


def test_quality_odd_rows(spark, odd, none):
    got = _rated(spark, odd).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert _rated(spark, none).count() == 0


# ---- 8

def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op8_mixture_language_id(spark, SF).collect()}
    rows = documents(spark, SF).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_mixtures_are_told_apart(spark):
    by = {}
    for r in documents(spark, SF).collect():
        by.setdefault(r.lang, []).append(r.text)
    model = langid.fit(documents(spark, SF))
    half = lambda t, n: " ".join(t.split()[:n])
    long = {k: max(v, key=len) for k, v in by.items()}
    texts = [half(long["de"], 150) + " " + half(long["fr"], 150), half(long["en"], 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = langid.identify(rows, model).orderBy("doc_id").collect()
    assert set(a.languages) == {"de", "fr"} and all(0.3 < s < 0.7 for s in a.shares)
    assert b.lang_pred == "en" and b.score == pytest.approx(1.0)


def test_five_languages_in_one_text(spark):
    """No number of languages is too many: five invented alphabets, one text of all."""
    rng = random.Random(3)
    sets = ["abcde", "fghij", "klmno", "pqrst", "uvwxyz"]
    draw = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n))
    taught = [(10 * k + j, draw(s, 300), f"l{k}") for k, s in enumerate(sets) for j in range(5)]
    model = langid.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    mixed = " ".join(draw(s, 80) for s in sets)
    got = langid.identify(spark.createDataFrame([(1, mixed), (2, draw(sets[3], 50))], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert sorted(got[0].languages) == [f"l{k}" for k in range(5)] and all(0.15 < s < 0.25 for s in got[0].shares)
    assert got[1].languages == ["l3"]


def _best_set(ll, penalty):
    """Brute force over one text: every nested set by a plain EM in full precision."""
    def em(p):
        pi = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(langid.ROUNDS):
            joint = p * pi
            pi = (joint / joint.sum(1, keepdims=True)).mean(0)
        return pi, np.log((p * pi).sum(1)).sum()

    p = np.exp(ll.astype(np.longdouble))
    full, _ = em(p)
    rank = np.argsort(-full, kind="stable")
    found = (ll.sum(0).max(), (int(ll.sum(0).argmax()),), np.array([1.0]))
    for k in range(2, p.shape[1] + 1):
        if full[rank[k - 1]] * len(ll) >= 1:
            pi, value = em(p[:, rank[:k]])
            if value - penalty * (k - 1) * math.log(max(len(ll), 2)) > found[0]:
                found = (value - penalty * (k - 1) * math.log(max(len(ll), 2)), tuple(rank[:k].tolist()), pi)
    return dict(zip(found[1], map(float, found[2])))


def test_inference_against_brute_force(spark):
    """Chosen sets and proportions of whole documents and of mixtures, text by text."""
    rows = documents(spark, TINY).collect()
    model = langid.fit(documents(spark, TINY))
    rng = random.Random(1)
    texts = [r.text for r in rows] + [" ".join(rng.choice(rows).text.split()[:40] + rng.choice(rows).text.split()[:25]) for _ in range(60)]
    got, _ = langid.infer(model, pa.array(texts))
    mixed = 0
    for k, t in enumerate(texts):
        w, first, end, hashed = langid._windows(pa.array([t]), model.bits)
        if w.n_words[0]:
            ll = np.array([model.table[hashed[a:b]].sum(0) for a, b in zip(first, end)])
            want = _best_set(ll, langid.PENALTY)
            mixed += len(want) > 1
            assert {j: x for j, x in enumerate(got[k]) if x > 0}.keys() == want.keys() and all(abs(got[k][j] - x) < 1e-3 for j, x in want.items())
    assert mixed > 10


def test_language_likelihoods_do_not_depend_on_blocks(spark, monkeypatch):
    model = langid.fit(documents(spark, TINY))
    texts = ["a bc def ghij klmno", None, "", "x" * 5000 + " y z", "der Hund und die Katze " * 40, "1 2 3"]
    w, first, end, hashed = langid._windows(pa.array(texts, pa.string()), model.bits)
    want = np.array([model.table[hashed[a:b]].sum(0, dtype=np.float64) for a, b in zip(first, end, strict=True)])
    whole = langid._likelihoods(model, first, end, hashed)
    assert whole.shape == want.shape and np.allclose(whole, want, rtol=1e-5)
    for gathered in (1, 64, 4000):
        monkeypatch.setattr(langid, "GATHERED", gathered)
        got = langid._likelihoods(model, first, end, hashed)
        fits = end - first <= max(1, gathered // len(model.langs))
        assert (got[fits] == whole[fits]).all() and np.allclose(got, want, rtol=1e-5)
    assert langid._likelihoods(model, first[:0], end[:0], hashed).shape == (0, len(model.langs))


def test_many_languages_share_the_table():
    assert langid._bits(17, 4) == 17 and langid._bits(17, 512) == 17 and langid._bits(17, 5000) == 13


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(2)
    p = np.log(rng.random((50, 3)) + 0.01)
    off, allowed = np.array([0, 20, 50]), np.ones((2, 3))
    ll = [langid._em(p, off, allowed, k)[1] for k in range(6)]
    assert all((b >= a - 1e-6).all() for a, b in zip(ll, ll[1:]))


def test_language_odd_rows(spark, odd, none):
    model = langid.fit(documents(spark, TINY))
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 4, 6} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 for r in got)
    untaught = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(odd, untaught).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
