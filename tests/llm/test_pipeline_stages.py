"""Each stage of the pipeline on its own: what goes, what stays, and that columns and n_chars hold."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from leafpress.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "web"), len(t or "")) for i, t in texts], COLUMNS)


def test_toxic_documents_go(spark, tmp_path):
    r = random.Random(3)
    clean, bad = [f"{a}{b}nd" for a in "bdfgk" for b in "aeiou"], ["vilest", "rotten", "scumbag"]
    texts = [(i, " ".join(r.choice(clean) for _ in range(20)) + (" " + " ".join(r.choice(bad) for _ in range(6)) if i % 4 == 0 else "")) for i in range(240)] + [(900, None), (901, "")]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, texts)
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in texts if i >= 900 or i % 4)


def test_lines_go(spark):
    docs = table(spark, [(1, "one line here\nown"), (2, "one line here\nother\n\n"), (3, "one line hare"), (4, None), (4, None), (5, "")])
    kept = corpus_pipeline.drop_lines(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x.text or "", x.n_chars or 0) for x in kept.collect()) == [(1, "one line here\nown", 17), (2, "other\n\n", 7), (3, "", 0), (4, "", 0), (4, "", 0), (5, "", 0)]


def test_mix(spark):
    docs = table(spark, [(i, "word " * 10) for i in range(20)], {i: "a" if i < 18 else "b" for i in range(20)})
    drawn = corpus_pipeline.mix(spark, docs, "")
    rows = drawn.collect()
    assert drawn.columns == docs.columns and all(x.n_chars == len(x.text) for x in rows)
    words = {s: sum(len(x.text.split()) for x in rows if x.source == s) for s in "ab"}
    # 200 words by 5 to 2, each in whole words.
    assert words == {"a": 200 * 5 // 7, "b": 200 * 2 // 7}


def test_encoding(spark):
    texts = [(1, "Some words, twice."), (2, None), (3, ""), (3, ""), (4, "long " * 200_000)]
    library = Tokenizer.from_file(bpe.default_path())
    coded = corpus_pipeline.encode(spark, table(spark, texts), "").collect()
    assert sorted((x.doc_id, x.n_tokens) for x in coded) == sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert all(x.ids == library.encode(dict(texts)[x.doc_id] or "", add_special_tokens=False).ids and x.decoded == library.decode(x.ids, skip_special_tokens=False) for x in coded)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]], ids=[n for n, _ in corpus_pipeline.STAGES[1:]])
def test_empty_tables(spark, stage):
    assert stage(spark, table(spark, []), "").count() == 0
