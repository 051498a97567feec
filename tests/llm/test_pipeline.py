import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from evalspark.llm import queries
from llm.samples import documents, edge_rows
from llm.test_line_dedup import brute as brute_lines
from llm.test_near_dedup import brute as brute_near
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    if name in queries.ORACLES:
        assert compare(df, connect(SF_DIR), queries.ORACLES[name]) == ""
    else:
        assert df.count() >= 200


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF_DIR), corpus_pipeline.scratch_path(spark, name))
        out.append(docs.collect())
    return out


def test_quality(stages, spark):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    before, kept = ({r["doc_id"] for r in rows} for rows in stages[:2])
    right = [(i in kept) == (marks[i] == 1) for i in before if i in marks]
    assert kept < before and sum(right) > 0.95 * len(right)


def test_lines(stages):
    want = {r[0]: r[3] for r in brute_lines([(r["doc_id"], r["text"]) for r in stages[1]], 10, 1)}
    import hashlib

    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in stages[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near(stages):
    want = brute_near([(r["doc_id"], r["text"]) for r in stages[2]], 5, 80, 100)
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(r[0] for r in want if r[3])


def test_mix(stages):
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert abs(words(stages[4]) / words(stages[3]) - 1.5) < 0.25
    assert {r["doc_id"] for r in stages[4]} <= {r["doc_id"] for r in stages[3]}


def test_encoded(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(stages[4]) < len(stages[5]) <= 2 * len(stages[4])
    drawn = {}
    for r in stages[5]:
        drawn.setdefault(r["doc_id"], {}).setdefault(r["sample"], set()).add(tuple(r["ids"]))
        assert r["log_inclusion"] <= 0 and r["n_tokens"] == len(r["ids"])
    assert all(len(set().union(*d.values())) == len(d) for d in drawn.values())
    assert all(library.decode(r["ids"]) == library.decode(library.encode(texts[r["doc_id"]])) for r in stages[5])


def test_stages_keep_columns_and_take_edges(spark):
    docs = documents(spark, edge_rows(), clashing=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF_DIR), corpus_pipeline.scratch_path(spark, name))
        assert docs.columns == list(corpus_pipeline.DOCUMENT)
        assert docs.count() > 0
    assert docs.count() <= corpus_pipeline.encode(spark, docs, SF_DIR).count() <= 2 * docs.count()


def test_empty_documents(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(7, text), (7, text), (7, text + " end"), (9, text), (None, other), (None, other), (None, other + " end"), (3, other + " x")]
    rows += [(None, None), (None, ""), (4, None), (5, "alone of all"), (5, "alone of all"), (5, "quite another one")]
    rows += [(None, f"{text} {other}"), (None, f"{text} {other}")]
    docs = documents(spark, [(i, t, "en", "a", 0) for i, t in rows])
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    sevens = [r for r in got if r[0] == 7]
    assert len(sevens) == 1 and sevens[0][1].startswith(text)
    want = [(3, other + " x"), (None, None), (None, ""), (4, None), (5, "alone of all"), (5, "quite another one"), (None, f"{text} {other}")]
    assert [r for r in got if r[0] != 7] == sorted(want, key=repr)
