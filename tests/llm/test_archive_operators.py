"""Operators 9 and 10 and the pipeline."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import numpy as np
import oracle
import pyarrow as pa
import pytest
from paths import SF, TINY
from pyspark.sql import functions as F

from terrane.llm import licences, pii, queries, simhash, warc
from terrane.llm.shared import documents, shared_dir

RECORD = "archive long, record long, data string, size long, node long"


def _archives(spark, rows):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], RECORD)


# ---- 9

def test_identical_replicas_have_no_damage(spark):
    a = _archives(spark, [(k % 3, k, "x" * (k * 37 % 900)) for k in range(200)])
    assert warc.audit(a, a, range_bytes=512).count() == 0
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0


def test_damage_against_brute_force(spark):
    rng = random.Random(6)
    rows = {(rng.randrange(4), k): "".join(rng.choices("abcdef\n", k=rng.randint(0, 800))) for k in range(400)}
    other = dict(rows)
    for key in rng.sample(sorted(rows), 12):
        if rng.random() < 0.3:
            del other[key]
        else:
            other[key] = other[key][: rng.randint(0, 5)] + "?" * rng.randint(0, 3) + other[key][5:]
    other[2, 9999] = "new"
    for fanout, size in ((2, 256), (16, 4096)):
        got = {(r.archive, r.record): r for r in warc.audit(_archives(spark, [(*k, v) for k, v in rows.items()]), _archives(spark, [(*k, v) for k, v in other.items()]), size, fanout).collect()}
        assert set(got) == {k for k in rows.keys() | other.keys() if rows.get(k) != other.get(k)}
        for k, r in got.items():
            assert r.status == ("missing" if k not in other else "added" if k not in rows else "changed")
            assert r.primary_digest == (hashlib.sha256(rows[k].encode()).hexdigest() if k in rows else None)
            if k in rows:
                assert r.primary_start == sum(len(v.encode()) for (a, n), v in rows.items() if a == k[0] and n < k[1])


def test_repeated_and_null_records(spark):
    a = _archives(spark, [(1, 1, "a"), (1, 1, "b"), (1, 1, "b"), (1, 2, None)])
    b = _archives(spark, [(1, 1, "a"), (1, 1, "b"), (1, 1, "c"), (1, 2, "")])
    got = warc.audit(a, b).collect()
    assert [(r.record, r.status) for r in got] and all(r.record == 1 for r in got)
    pages = spark.createDataFrame([(None, None, None, 1), (5, "u", "é", 2)], "page_id long, url string, html string, size long")
    made = {r.record: r.data for r in warc.records(pages).collect()}
    assert 5 in made and len(made) == 2 and min(made) <= warc.UNNUMBERED and "Content-Length: 2\r\n" in made[5]


def test_pages_without_an_id_spread_and_clash_with_none(spark):
    rows = [(None, f"u{k}", "x") for k in range(300)] + [(-k, "u", "y") for k in range(1, 300)]
    got = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    lost, named = ({r.archive for r in got.where(c).collect()} for c in (f"record <= {warc.UNNUMBERED}", f"record > {warc.UNNUMBERED}"))
    assert len(lost) > 250 and named == {-1, -2} and not lost & named


def test_empty_records_do_not_crowd_a_range(spark):
    a = _archives(spark, [(1, k, "") for k in range(5000)])
    sizes = [r["count"] for r in warc.leaves(a, 4096).groupBy("node").count().collect()]
    assert max(sizes) <= 4096 // warc.LEAST_BYTES and sum(sizes) == 5000
    b = _archives(spark, [(1, k, "") for k in range(5000) if k != 77] + [(1, 77, "x" * 100_000)])
    assert [(r.record, r.status, r.primary_start) for r in warc.audit(a, b, 4096).collect()] == [(77, "changed", 0)]


# ---- 10

MIT = dict((i, t) for i, t in licences.KNOWN if len(t) > 500)["MIT"]


def test_whole_licences_and_notices(spark):
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + MIT.upper()),
        (2, "(c) 2001-2004 A. Author\nAll rights reserved.\n" + MIT.replace("license", "licence").replace(",", " ,")),
        (3, MIT + "\nand one line more"),
        (4, "Some text.\nReleased under the MIT license\nMore. \nLicensed under CC BY-NC 4.0."),
        (5, None),
        (6, ""),
        (6, ""),
        (None, MIT),
    ]
    got = licences.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int"), licences.known(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and [by[k].licence_id for k in (1, 2, 3, 4, 5, 6, None)] == ["MIT", "MIT", None, None, None, None, "MIT"]
    assert by[4].notice_ids == "CC-BY-NC-4.0,MIT" and by[5].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    assert licences.scan(documents(spark, TINY).limit(0), licences.known(spark)).count() == 0


def test_equal_spellings_side_by_side(spark):
    rows = [(1, "the licence licence licences licence"), (2, "The license, license licenses license")]
    a, b = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.known(spark)).collect()
    assert a.canonical_sha256 == b.canonical_sha256


def test_many_notices_are_joined(spark):
    docs = documents(spark, SF)
    few, many = (sorted(licences.scan(docs, licences.known(spark), plan_notices=n).collect()) for n in (1000, 3))
    assert few == many and any(r.notice_ids for r in few)
    texts = spark.createDataFrame([(f"id{k}", f"notice number {k} of many") for k in range(3000)], "licence_id string, text string")
    got = licences.scan(spark.createDataFrame([(1, "x\nNotice number 7 of many.\nnotice number 2999 of many"), (1, None), (2, "notice number 5 of many " * 5000)], "doc_id long, text string"), texts)
    assert sorted((r.doc_id, r.notice_ids) for r in got.collect()) == [(1, ""), (1, "id2999,id7"), (2, "")]


def test_empty_collections_and_ties(spark):
    docs = spark.createDataFrame([(1, "A notice."), (2, ""), (3, MIT)], "doc_id long, text string")
    none = licences.known(spark).limit(0)
    assert {r.licence_id for r in licences.scan(docs, none).collect()} == {None}
    two = spark.createDataFrame([("b", "a notice"), ("a", "A NOTICE!"), ("c", ""), (None, "other")], "licence_id string, text string")
    assert {r.doc_id: (r.licence_id, r.notice_ids) for r in licences.scan(docs, two).collect()} == {1: ("a", "a"), 2: (None, ""), 3: (None, "")}


def test_long_licences_are_known_by_digest(spark):
    """The texts that lie on this machine, rewrapped and in capitals."""
    from pathlib import Path

    names = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "CC0-1.0": "CC0-1.0"}
    rows = [(k, v, p.read_text()) for k, v in names.items() if (p := Path("/usr/share/common-licenses", v)).exists()]
    docs = spark.createDataFrame([(n, text.upper().replace(",", " , ")) for n, (_, _, text) in enumerate(rows)] + [(99, "GPL")], "doc_id long, text string")
    got = {r.doc_id: r.licence_id for r in licences.scan(docs, licences.known(spark), more=licences.known_digests(spark)).collect()}
    assert got == {n: k for n, (k, _, _) in enumerate(rows)} | {99: None}


def test_known_texts_have_distinct_digests_by_licence(spark):
    got = licences.known(spark).select("licence_id", F.sha2(F.array_join(licences.canonical_lines(F.col("text")), " "), 256).alias("d")).collect()
    owner = {}
    assert all(owner.setdefault(r.d, r.licence_id) == r.licence_id for r in got)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.differences(queries.queries()[name](spark, SF), oracle.connection(SF), queries.oracle_sql()[name]) == []


# ---- pipeline

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the small tables."""
    docs, out = documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = (before, docs)
    return out


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        assert before.count() >= after.count() > 0


def test_language_stage_keeps_clean_documents(stages):
    before, after = stages["language"]
    assert after.count() >= 0.99 * before.count()


def test_language_stage_learns_from_every_row(spark, monkeypatch):
    """6,000 rows of one language: the windows of all of them are in the model."""
    from terrane.llm import langid

    models, plain = [], langid.identify
    monkeypatch.setattr(langid, "identify", lambda docs, model, **options: models.append(model) or plain(docs, model, **options))
    rows = [(k, f"onlyword{k} and some more", "en" if k % 7 else "de", "a", 1) for k in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.language(spark, docs, SF)
    (model,) = models
    for column, lang in enumerate(model.langs):
        counts = 0.5 + langid._counts(pa.array([r[1] for r in rows if r[2] == lang]), model.bits)
        assert np.allclose(model.table[:, column], np.log(counts / counts.sum()), atol=1e-4)


def test_one_document_of_each_group_stays(spark, stages):
    before, after = stages["near_duplicates"]
    kept = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert {r.doc_id for r in after.select("doc_id").collect()} == kept


def test_no_benchmark_item_is_left(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in before.collect() if any(t in r.text for t in items)}
    left = {r.doc_id for r in after.select("doc_id").collect()}
    assert leaky and not leaky & left
    assert before.count() - after.count() <= 1.1 * len(leaky)


def test_decontamination_drops_rows_not_ids(spark):
    """Null and repeated ids: only the rows that hold an item go."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = [(None, f"row {k} of plain words that nobody tests") for k in range(5)] + [(7, "another clean line"), (7, "another clean line"), (8, None)]
    rows = [(i, t, "en", "a", 1) for i, t in [*clean, (None, item), (7, item), (9, item)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontamination(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in clean)


def test_personal_data_is_replaced(stages):
    before, after = stages["personal_data"]
    texts = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        _, spans = pii.find(r.text)
        assert texts[r.doc_id].text == pii.redact(r.text, spans) and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
        assert pii.find(texts[r.doc_id].text)[0] == []


def test_tokens_read_back(stages):
    import sentencepiece

    before, after = stages["tokens"]
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.vocabulary("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.round_trip and library.decode(r.ids) == texts[r.doc_id]


def test_pipeline_on_odd_and_empty_tables(spark, odd, none):
    """Every stage's rows over nulls, repeats, blank and long texts."""
    stage = dict(corpus_pipeline.STAGES)
    for step in stage.values():
        assert step(spark, none, TINY).count() == 0
    rows = lambda df: sorted((str(r.doc_id), str(r.text)[:30]) for r in df.collect())
    line, said = "The end of a plain line.\nAnother line of it.", [("1", "The end of a plain line.\nAnother line of it."[:30])]
    assert {r.doc_id for r in stage["language"](spark, odd, TINY).collect()} == {1, None, 5, 7}
    once = stage["near_duplicates"](spark, odd, TINY)
    assert rows(once) == sorted([*said, ("2", "None"), ("5", "x" * 30), ("6", "12345 678"), ("7", "Grüße, 漢字 🙂 <|im_end|> \\ ▁ é"[:30]), ("None", "no id here")])
    assert rows(stage["decontamination"](spark, odd, TINY)) == rows(odd)
    clean = stage["personal_data"](spark, odd, TINY)
    assert rows(clean) == rows(odd) and {r.doc_id: r.n_chars for r in clean.collect()}[2] is None
    encoded = stage["tokens"](spark, odd, TINY).collect()
    assert len(encoded) == odd.count() and all(r.ids == [] for r in encoded if r.doc_id in (2, 3))


def test_rows_without_ids_are_deduplicated_by_text(spark):
    rows = [(None, "a b c d e f", "en", "a", 1), (None, "a b c d e f", "en", "b", 1), (None, "other words in this one here", "en", "a", 1), (4, "A b c D e f", "en", "a", 1), (4, "not the same text at all", "en", "a", 1), (9, "not the same text at all", "en", "a", 1)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), TINY)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("4", "A b c D e f"), ("4", "not the same text at all"), ("None", "other words in this one here")]


def test_run_leaves_only_its_result(spark):
    import os

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, TINY)
    assert got.count() > 0 and not [x for x in set(os.listdir(folder)) - before if x.startswith("cut-")]
    made = [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")]
    assert len(made) == 1 and os.listdir(f"{folder}/{made[0]}") == ["tokens"]
