"""The stages of the pipeline over a small corpus, each held against what it must keep and change."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from tracemill.llm.common import materialize


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = say(30)
    rows = []
    for i in range(240):
        text = say(80)
        if i % 4 == 0:
            text = text.replace(" ", "### ")  # junk
        elif i == 9:
            text = rows[5][1]  # a copy
        elif i == 13:
            text = rows[5][1].rsplit(" ", 2)[0]  # a near copy
        elif i in (21, 23):
            text = say(20) + " " + item + " " + say(20)
        elif i == 33:
            text = say(30) + ' é password: "b7db7aa4a5fcc78305" ' + say(30)
        elif i == 35:
            text = "too short"
        rows.append((i, text, "en", "src1", len(text)))
    rows.append((None, None, None, None, None))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r for r in rows}


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, {i for i in rows if i is not None}
    goes = [{i for i in left if i % 4 == 0} | {35}, {9, 13}, {21, 23}, set()]
    for (_, stage), gone in zip(corpus_pipeline.STAGES, goes, strict=False):
        docs = materialize(stage(spark, docs, path))
        assert docs.columns == columns
        left -= gone
        got = {r.doc_id: r for r in docs.collect()}
        assert set(got) == left
    for i, r in got.items():
        want = rows[i][1].replace('password: "b7db7aa4a5fcc78305', corpus_pipeline.REDACTED)
        assert (r.text, r.n_chars) == (want, len(want)) and (i == 33) == (corpus_pipeline.REDACTED in r.text)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in last} == left
    for r in last:
        ids = known.encode(got[r.doc_id].text, add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(got[r.doc_id].text.encode()).hexdigest()


def test_near_duplicates_of_repeated_and_null_ids(spark, tmp_path):
    """Exactly one row of each group stays, whatever the doc_ids; clean text under a doc_id that repeats stays too."""
    rng = random.Random(10)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c, d, clean, nulls = (say() for _ in range(6))
    near = lambda t: t.rsplit(" ", 2)[0]
    rows = [(1, a), (1, a), (1, a), (2, b), (None, near(b)), (3, c), (4, near(c)), (4, clean), (5, d), (5, near(d)), (None, nulls), (None, nulls), (None, near(nulls)), (None, None), (6, ""), (6, "")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    own = {5: [(5, d), (5, near(d))], None: [(None, nulls), (None, near(nulls))]}
    for x in own.values():
        assert sum(got.count(r) for r in x) == 1
    rest = [r for r in got if r not in own[5] + own[None]]
    assert sorted(rest, key=str) == sorted([(1, a), (2, b), (3, c), (4, clean), (None, None), (6, ""), (6, "")], key=str)


def test_stages_of_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    """Columns with the names that stages use themselves pass through; an empty table stays one."""
    path, _ = folder
    own = ["row", "row_", "verdict", "rule", "counts", "features", "number", "own", "marks", "clean", "component", "hash", "sig"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = materialize(docs.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in own)))
    empty = materialize(wide.where("false"))
    left = None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide, empty = materialize(stage(spark, wide, path)), materialize(stage(spark, empty, path))
        assert wide.columns == empty.columns == [*docs.columns, *own] and empty.count() == 0
        for r in wide.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in own)
    left = {r.doc_id for r in wide.collect()}
    assert left == {i for i in range(240) if i % 4} - {35, 9, 13, 21, 23}
