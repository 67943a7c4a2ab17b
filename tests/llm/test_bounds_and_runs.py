"""Long runs of one character, bounds on what a model learns from, and odd names."""

import hashlib
import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracework.llm import language_id, neighbours, packing, quality, token_counts, warc
from tracework.llm.common import written

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("filler", [" ", "\n", "\t", "　", "a", "7", "-"])
def test_ids_of_very_long_runs_are_those_of_tokenizers(filler):
    text = "a" + filler * 2_000_000 + " b"
    assert packing.encoder(FILE)([text, "x"])[0] == Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids


def test_packing_of_a_long_run(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "short")], "doc_id long, text string")
    rows = packing.pack(docs, FILE).collect()
    total = len(Tokenizer.from_file(FILE).encode(docs.first().text, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id == 1) == total and max(r.length for r in rows) <= 2048


def test_learning_rows_are_bounded_whatever_repeats(spark):
    learned = [i for i in range(200) if not spark.range(1).select(F.expr(f"crc32(cast('{i}' as binary)) % 4 = 2")).first()[0]][:20]
    docs = spark.createDataFrame([(i, f"text {i} number {k}") for i in learned for k in range(50)] + [(learned[0], "text 0 number 0")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in learned], "doc_id long, quality int")
    assert len(quality.fit(docs, labels, max_train_docs=10).y) == 10
    assert len(quality.fit(docs, labels, max_train_docs=5000).y) == 1000
    assert len(quality.fit(docs.limit(0), labels).y) == 0


def test_a_thousand_languages_hold_one_block_at_a_time(spark, monkeypatch):
    made, freed = [], []
    plain = language_id.Model.blocks

    def blocks(self):
        for names, block in plain(self):
            made.append(len(names))
            assert len(made) - len(freed) <= 1
            yield names, block

    monkeypatch.setattr(language_id.Model, "blocks", blocks)
    kind = type(spark.sparkContext.broadcast(0))
    destroy = kind.destroy
    monkeypatch.setattr(kind, "destroy", lambda self, *a, **b: (freed.append(1), destroy(self, *a, **b))[1])
    monkeypatch.setattr(language_id, "LANGS", 250)
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    docs = spark.createDataFrame([(i, word(i % 1000), f"l{i % 1000:04d}") for i in range(2000)], "doc_id long, text string, lang string")
    found = language_id.predict(docs).collect()
    assert made == [250] * 4 and len(freed) == 3 and len(found) == 2000
    want = {r.doc_id: r.lang for r in docs.collect()}
    sure = [r for r in found if not r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in sure) > 0.9 * len(sure)


def test_token_counts_keep_odd_names(spark, tmp_path):
    vocab = {"a</w>": 0, "b": 1, "b</w>": 2, "<unk>": 3}
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"type": "BPE", "vocab": vocab, "merges": []}}))
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, `a.b` int, N_TOKENS int, `c``d` int")
    found = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert found.columns == ["doc_id", "a.b", "c`d", "n_words", "n_tokens"] and found.first()[1] == 5 and found.first().n_words == 2


def test_archives_and_neighbours_leave_odd_names_out(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1200, 1, 2), (2, "u", "x" * 1200, 3, 4), (None, None, None, 5, 6)], "page_id long, url string, html string, `a.b` int, PAYLOAD_BYTES int")
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()) == [(0, 0, "response", None), (1, 1200, "revisit", 2), (2, 1200, "response", None)]
    vectors = spark.createDataFrame([(i, [1.0, float(i)], 1, 2) for i in range(6)], "vec_id long, embedding array<double>, `a.b` int, Query_ID int")
    found = neighbours.nearest(vectors, lambda v: v == 0, k=2, beam=8, hops=2, links=4, descents=1).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 1), (0, 2, 2)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage_of_the_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_last_stages_of_the_pipeline_on_nulls_and_a_long_run(spark):
    docs = written(spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "one two three", "en", None, 13), (None, "four five", None, "b", 9), (3, "one two three", "en", None, 13), (4, "a" + " " * 700_000 + "b", "en", "a", 700_002)], DOCS), "odd-docs")
    left = written(corpus_pipeline.repeated_passages(spark, docs, ""), "odd-left")
    assert {r.doc_id for r in left.collect()} >= {1, 2, 3, 4, None}
    mixed = written(corpus_pipeline.mixed(spark, left, ""), "odd-mixed")
    assert mixed.columns == docs.columns and all(r.text for r in mixed.collect())
    packed = corpus_pipeline.packed(spark, mixed, "").collect()
    assert sum(r.length for r in packed if r.start == 0) > 0 and max(r.length for r in packed) <= 2048
