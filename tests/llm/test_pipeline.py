import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline as pipeline
from lodespar.llm import quality
from lodespar.llm._shared import documents


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Each stage's result, written and reread, as the pipeline does it."""
    out, docs = {"input": documents(spark, sf)}, documents(spark, sf)
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(steps):
    columns = steps["input"].columns
    assert all(steps[name].columns == columns for name, _ in pipeline.STAGES[:-1])


def test_quality_drops_what_is_rejected(spark, sf, steps):
    scored = quality.classify(steps["input"], spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(texts(steps["quality"])) == {r.doc_id for r in scored.where("predicted = 1").collect()}


def test_near_duplicates_keep_the_first(steps):
    want = brute.near(list(texts(steps["quality"]).items()))
    assert set(texts(steps["near_dedup"])) == {d for d, (_, c) in want.items() if d == c}


def test_repeats_are_cut(steps):
    before, after = texts(steps["near_dedup"]), texts(steps["substring_dedup"])
    for d, (n, gone, sha) in brute.removals(list(before.items())).items():
        if gone == 0:
            assert after[d] == before[d]
        elif gone < n:
            assert hashlib.sha256(after[d].encode()).hexdigest() == sha
        else:
            assert d not in after
    assert all(r.n_chars == len(r.text) for r in steps["substring_dedup"].collect())


def test_mixture_comes_near_its_targets(steps):
    size, took, source = {}, {}, {}
    for r in steps["substring_dedup"].collect():
        n = len(brute.words(r.text))
        size[r.source], source[r.doc_id] = size.get(r.source, 0) + n, r.source
    longest = max(len(brute.words(t)) for t in texts(steps["substring_dedup"]).values())
    for r in steps["mix"].collect():
        took[r.source] = took.get(r.source, 0) + len(brute.words(r.text))
    for s, target in brute.mix_targets(size).items():
        assert abs(took.get(s, 0) - target) <= longest


def test_packing_holds_every_token(steps):
    rows = steps["pack"].collect()
    ends = {}
    for r in rows:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert max(ends.values()) <= 4096 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert {r.doc_id for r in rows} == set(texts(steps["mix"]))
    assert all(r.length == len(r.ids) <= 4096 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    # Copies of a document are told apart, and each is whole.
    copies = {}
    for r in rows:
        copies.setdefault((r.doc_id, r.row), []).append(r)
    assert len(copies) == steps["mix"].count()
    for parts in copies.values():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [4096 * p for p in range(len(parts))]


def test_run_is_its_stages(spark, sf, steps):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, pipeline.run(spark, sf).collect())) == sorted(map(key, steps["pack"].collect()))


def test_empty_and_odd_documents(spark, sf):
    rows = [(None, None, None, None, None, 1), (5, "", "en", "s", 0, 2), (5, "", "en", "s", 0, 2), (7, "one two three", "en", None, 13, 3), (7, "four five", "en", None, 9, 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int")
    docs = odd
    for name, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == odd.columns
        docs = spark.createDataFrame(out.collect(), odd.schema)  # as run() writes it, before the next stage drops tables
        # Blank texts, rows without id and short texts pass all of these stages, each row as itself.
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str), name
    packed = pipeline.pack(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == [(0, 1), (5, 1), (5, 1), (7, 3), (7, 4)] and len({r.row for r in packed}) == 5
    judged = pipeline.quality(spark, odd, sf)
    assert judged.columns == odd.columns and set(map(tuple, judged.collect())) <= set(rows)
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0


def test_stages_decide_by_row(spark, sf):
    """Rows of one doc_id with different texts: no text goes because of the other row."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    near = text("b").replace("b17", "x")
    rows = [(3, text("a"), "s", 1), (5, text("a"), "s", 2), (5, text("b"), "s", 3), (7, near, "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    assert sorted(r.n for r in pipeline.near_dedup(spark, docs, sf).collect()) == [1, 3]
