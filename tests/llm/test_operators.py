import gc
import hashlib
import random
import sys
import textwrap
import tracemalloc
import weakref
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from lodespar.llm import audio, catalogue, license_scan, lm, minhash, mixing, order_minhash, packing, quality, sharding, substrings
from lodespar.llm.elias_fano import EliasFano, encode, read_arrays, write_arrays

rng = random.Random(5)
VOCABULARY = ["".join(rng.choices("abcdeéßthing", k=rng.randint(1, 8))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


def corpus():
    """Rows with copies, near copies, shared passages, blanks, nulls, odd spaces and one very long text."""
    rows, passage, base = [], prose(60), prose(200)
    for i in range(60):
        rows.append(prose(rng.randint(1, 250)))
    rows += [base] * 4 + [base.upper()]
    for _ in range(6):
        w = base.split()
        w[rng.randrange(200)] = "changed"
        rows.append(" ".join(w))
    rows += [prose(30) + " " + passage + "\n" + prose(30) for _ in range(5)]
    rows += ["", None, " \t\n ", "one", "One two", "one  two\x0bthree\x0cfour", "x" * 300, "a b " * 200, prose(4000), "nbsp\xa0here\x85and there", "Zoë – naïve’s 12ab"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", None if d % 5 == 0 else f"src{d % 4 if d % 3 else 0}", len(t or ""), "clash", 7) for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot string, size int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_mix_takes_the_targets(docs, none):
    got = mixing.taken(mixing.mix(docs, [5, 2, 1], block_words=64)).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = {}
    for d, t in DOCS:
        sizes[source[d]] = sizes.get(source[d], 0) + len(brute.words(t))
    want = brute.mix_targets(sizes)
    assert sorted(r.doc_id for r in got) == [d for d, _ in DOCS]
    took = {}
    for r in got:
        assert r.size == len(brute.words(dict(DOCS)[r.doc_id])) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        took[source[r.doc_id]] = took.get(source[r.doc_id], 0) + r.taken
    assert all(abs(took[s] - want[s]) <= 0.5 + 1e-9 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(mixing.mix(docs.repartition(7), [5, 2, 1], block_words=64)).collect()))
    assert mixing.taken(mixing.mix(none, [5, 2, 1])).count() == 0


def test_mix_schedule_follows_the_weights_all_along(docs):
    rows = mixing.sized(docs, 17)
    targets = mixing.targets(rows, [5, 2, 1], 3)
    slots = mixing.schedule(targets, 911, 16).orderBy("slot").toPandas()
    quota = {r["_k"]: r["quota"] for r in targets.collect()}
    half = slots.iloc[: len(slots) // 2]["_k"].value_counts()
    for k, q in quota.items():
        assert abs(half.get(k, 0) - 0.5 * len(slots) * q / sum(quota.values())) <= 6


def test_mix_of_nothing_but_blanks(spark):
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None), (3, " ", "a")], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.taken(mixing.mix(blank, [5, 2, 1])).collect())) == [(i, 0, 0, 0.0, 0, None, 0) for i in (1, 2, 3)]


def test_mixed_documents_keep_rows_whole(docs):
    out = mixing.mix_documents(docs, [5, 2, 1])
    assert out.columns == docs.columns
    texts = dict(DOCS)
    assert all(r.text == texts[r.doc_id] for r in out.collect())
    assert out.where(r"text is null or text rlike '^\\s*$'").count() == 3


def test_repeated_rows_are_rows(spark):
    twice = spark.createDataFrame([(1, "a b c", "s")] * 2 + [(2, "d e", "t")], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mix(twice, [1])).count() == 3
    assert sharding.interleave(twice, 2).count() == 3
    assert minhash.near_duplicates(twice).count() == 3
    assert substrings.removal_digests(twice).count() == 3
    assert lm.score_corpus(twice).count() == 3
    assert order_minhash.fingerprint_documents(twice).count() == 3
    assert packing.pack(packing.pieces(twice, catalogue.tokenizer_path())).count() == 3


def test_near_duplicates_are_exact(docs, none):
    want = brute.near(DOCS)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(DOCS)
    for d, (n, component) in want.items():
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n, component, d == component)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_across_components(spark):
    """A chain whose ends are far apart, and a group whose members are near only to their base."""
    base = prose(120).split()
    rows = [base]
    for i in range(12):
        w = list(rows[-1])
        w[i * 9] = f"step{i}"
        rows.append(w)
    hub = prose(150).split()
    for i in range(25):
        w = list(hub)
        for j in rng.sample(range(0, 150, 7), 2):
            w[j] = f"own{i}{j}"
        rows.append(w)
    rows.append(hub)
    data = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.near(data)


def test_null_ids_are_kept(spark):
    rows = spark.createDataFrame([(None, prose(20)), (None, None), (4, None)], "doc_id long, text string")
    assert [r.kept for r in minhash.near_duplicates(rows).collect()] == [True] * 3
    assert substrings.removal_digests(rows).where("n_removed = 0").count() == 3
    assert order_minhash.fingerprint_documents(rows).count() == 3
    assert lm.score_corpus(rows).count() == 3


def test_rows_of_one_id_are_one_document_but_no_text_is_lost(spark):
    a, b = prose(120), prose(140)
    near = b.split()
    near[70] = "other"
    rows = [(3, a), (5, a), (5, b), (7, " ".join(near)), (9, prose(50)), (9, prose(50)), (None, a), (None, a), (11, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _t int")
    got = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (3, 3), (5, 3), (5, 3), (7, 3), (9, 9), (9, 9), (11, 11)]
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # One row of each group of texts: (3, a) for a, (5, b) for b and its near copy.
    assert sorted(r._t for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8]
    twice = minhash.drop_near_duplicates(df.unionByName(df.where("doc_id is not null"))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in twice) == sorted((rows[i][0] or 0, rows[i][1]) for i in [0, 2, 4, 5, 6, 7, 8, 8])


def test_quality_decides_by_row(spark, monkeypatch):
    class Longer:
        def score(self, x):
            return (x[:, 0] > np.log1p(3.5)).astype(float)  # words

    monkeypatch.setattr(quality, "train", lambda *_: Longer())
    df = spark.createDataFrame([(5, "one two three four", 1), (5, "one", 2), (None, "a b c d e", 3), (None, None, 4)], "doc_id long, text string, score int")
    assert sorted(r.score for r in quality.keep_good(df, df).collect()) == [1, 3]


def test_equal_rows_share_their_copies(spark, monkeypatch):
    rows = [(1, "a b c d", "s", 7)] * 3 + [(i, prose(20), "s", i) for i in range(10, 30)] + [(i, prose(40), "t", i) for i in range(40, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int")
    for run in (1000, 1):
        monkeypatch.setattr(mixing, "RUN", run)
        for weights in ([5, 2], [1, 9]):
            parts = mixing.mix(df, weights).where("doc_id = 1").groupBy("_rank", "epoch").agg(F.sum("n_words").alias("n"))
            want = parts.where("n >= 2").count()
            out = mixing.mix_documents(df, weights)
            assert out.columns == df.columns and out.where("doc_id = 1 and _copies = 7").count() == want


def test_pack_of_hashes_and_estimates():
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 4000, dtype=np.uint64))
    b = np.concatenate([a[:3000], a[3000:] ^ np.uint64(1 << 40)])
    signatures = minhash.pack(np.stack([minhash.minima(a), minhash.minima(b)]))
    assert minhash._estimates(signatures)[0, 1] == pytest.approx(0.6, abs=0.2)


def test_removed_windows_are_exact(docs, none):
    want = brute.removals(DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digests(docs).collect()}
    assert got == want
    assert substrings.removal_digests(none).count() == 0


def test_removed_windows_in_small_runs(docs, monkeypatch):
    """Many runs, ranges and buckets give the same."""
    monkeypatch.setattr(substrings, "RANGE_BYTES", 5000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digests(docs).collect()}
    assert got == brute.removals(DOCS)


def test_removed_windows_of_rows_without_id(spark, monkeypatch):
    """They are the last document, wherever their rows lie: earlier documents cut them, they do not cut each other."""
    passage, own = prose(30), prose(40)
    rows = [(None, f"{own} {passage}"), (None, f"{passage} {own}"), (None, f"{own} {passage}"), (3, passage), (3, f"{passage} x"), (None, None)] + [(None, f"{own} {i}") for i in range(40)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _key int").repartition(7, "_key")
    for held in (substrings.HELD, 50):
        monkeypatch.setattr(substrings, "HELD", held)
        got = substrings.remove_repeats(df).collect()
        left = {r._key: r.text for r in got}
        assert left == {i: own if i in (0, 1, 2) else t for i, (_, t) in enumerate(rows)}


def test_remove_repeats_keeps_columns_and_untouched_texts(docs):
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    want = brute.removals(DOCS)
    rows = {r.doc_id: r for r in out.collect()}
    for d, t in DOCS:
        n, gone, _ = want[d]
        if gone == 0:
            assert rows[d].text == t and rows[d].slot == "clash"
        elif gone == n:
            assert d not in rows
        else:
            assert hashlib.sha256(rows[d].text.encode()).hexdigest() == want[d][2]


def test_pieces_are_the_tokenizers(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(catalogue.tokenizer_path())
    rows = packing.pack(packing.pieces(docs, catalogue.tokenizer_path(), 64), 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(by) == [d for d, _ in DOCS]
    for d, t in DOCS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(p, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 64))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[d]) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 64 and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
    assert len(sequences) == brute.best_fit_decreasing([r.length for r in rows], 64)
    assert packing.pack(packing.pieces(none, catalogue.tokenizer_path())).count() == 0
    again = packing.pack(packing.pieces(docs, catalogue.tokenizer_path(), 64, with_ids=True), 64)
    assert again.count() == len(rows) and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in again.collect())


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "don't it's'll", "İstanbul ǅ", "À b́", " x y\x1cz\x0bq\x85", "ÀÉÎ,.!", "ß ẞ Straße", "''s", "naïve—yes", "12ab34", "ａｂｃ", "क़", "\x00", "x'"])
def test_word_tokens_equal_whole_text_tokens(text):
    from tokenizers import Tokenizer

    path = catalogue.tokenizer_path()
    data = np.frombuffer(text.encode(), np.uint8)
    ids, first = packing.WordTokens(path).ids(data, np.array([0, len(data)]))
    assert first.tolist() == [0, len(ids)]
    assert ids[:-1].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = catalogue.tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    texts = ["  Two words", "", "naïve—Yes  12ab\n\n x"]
    raw = [t.encode() for t in texts]
    tokens = packing.WordTokens(path)
    ids, first = tokens.ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert not tokens.by_words and packing.WordTokens(catalogue.tokenizer_path()).by_words
    whole = Tokenizer.from_file(path)
    for t, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1]


def test_word_tokens_go_with_their_task():
    """Without a collection of cycles, which comes after the worker has given its memory back."""
    gc.disable()
    try:
        tokens = packing.WordTokens(catalogue.tokenizer_path())
        tokens.ids(np.frombuffer(b"one two", np.uint8), np.array([0, 7]))
        gone = weakref.ref(tokens)
        del tokens
        assert gone() is None
    finally:
        gc.enable()


def test_pieces_hold_little_of_a_batch():
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows = [" ".join(rng.choices(words, k=2000)) for _ in range(700)]
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array([r.encode() for r in rows]), pa.array(range(len(rows)))], ["doc_id", "text", "row"])
    work = packing._pieces(catalogue.tokenizer_path(), 4096, True)
    tracemalloc.start()
    try:
        made = work([batch])
        found = next(made).num_rows
        tracemalloc.reset_peak()  # without what reading the tokenizer took
        found += sum(b.num_rows for b in made)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found >= len(rows)
    assert peak < 70e6


def test_packing_starts_no_workers_for_its_stretches(spark, docs, monkeypatch):
    cut = packing.pieces(docs, catalogue.tokenizer_path(), 64)
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)  # whose rows Python workers would serialize
    assert packing.pack(cut, 64).count() >= docs.count()


def test_sweep_is_best_fit_decreasing():
    for seed in range(30):
        r = random.Random(seed)
        lengths = [r.randint(1, 40) for _ in range(r.randint(1, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        stretches = packing.sweep(counts, 40)
        fill = {}
        for length, _, n, first, offset, each in stretches:
            for i in range(n):
                fill.setdefault(first + i // each, []).append((offset + i % each * length, length))
        assert sum(map(len, fill.values())) == len(lengths)
        for parts in fill.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert ends[-1] <= 40 and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert len(fill) == brute.best_fit_decreasing(lengths, 40)


def test_language_model_scores(docs, none):
    want = brute.language_model(DOCS)
    rows = lm.score_corpus(docs).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=5e-3, abs=5e-3)
    assert lm.score_corpus(none).count() == 0


def test_language_model_in_many_shards(docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 600)
    want = brute.language_model(DOCS)
    for r in lm.score_corpus(docs).collect():
        assert r.score == pytest.approx(want[r.doc_id][5], rel=5e-3, abs=5e-3)


@pytest.mark.parametrize("shard_bytes", [lm.SHARD_BYTES, 600])
def test_language_model_query_keeps_what_occurs_once(spark, docs, monkeypatch, shard_bytes):
    """The query as registered: pairs and triples of one training text count."""
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(catalogue, "documents", lambda *_: docs)
    want, pruned = brute.language_model(DOCS, least=1), brute.language_model(DOCS)
    for r in catalogue.op6_ngram_trie_scores(spark, "").collect():
        assert r.score == pytest.approx(want[r.doc_id][5], rel=5e-3, abs=5e-3)
    assert sum(abs(want[d][5] - pruned[d][5]) > 0.1 * abs(pruned[d][5]) for d in want) > 10


def test_elias_fano_round_trip(tmp_path):
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (7, 9), (1000, 1 << 40), (5000, (1 << 64) - 1), (3000, 3100)):
        v = np.unique(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
        write_arrays(f"{tmp_path}/{n}", encode(v, "x"))
        e = EliasFano(read_arrays(f"file://{tmp_path}/{n}"), "x")
        assert e.access(np.arange(len(v))).tolist() == v.tolist()
        asked = np.concatenate([v, r.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
        place = {int(x): i for i, x in enumerate(v)}
        assert e.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def test_counts_survive_packing():
    r = np.random.default_rng(2)
    keys, counts = lm.counted(r.integers(0, 1 << 40, 3000, dtype=np.uint64) // np.uint64(1 << 30))
    a, b = lm.unpack(lm.pack(keys, counts))
    assert a.tolist() == keys.tolist() and b.tolist() == counts.tolist()


def test_order_minhash_contract(docs, none):
    got = {r.doc_id: r for r in order_minhash.fingerprint_documents(docs).collect()}
    order = sorted((d for d, _ in DOCS), reverse=True)
    texts = {d: t or "" for d, t in DOCS}
    following = dict(zip(order, order[1:] + order[:1]))
    again = {t: r.fingerprint for r in got.values() for t in [texts[r.doc_id]]}
    for d in order:
        t, n = texts[d], texts[following[d]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[d].fingerprint == again[t]
        assert got[d].near_edited == pytest.approx(brute.order_minhash_likeness(t, edited))
        assert got[d].near_next == pytest.approx(brute.order_minhash_likeness(t, n))
        if t == n:
            assert got[d].near_next == 1
    long = [r for r in got.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long if texts[r.doc_id] != texts[following[r.doc_id]]])
    assert order_minhash.fingerprint_documents(none).count() == 0


def test_order_minhash_sees_order_and_repeats(spark):
    a = prose(200)
    w = a.split()
    rows = [(0, a), (1, " ".join(w[100:] + w[:100])), (2, " ".join(reversed(w))), (3, a + " " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", order_minhash.fingerprint(F.col("text")))
    one = df.where("doc_id = 0").select(F.col("fp").alias("own"))
    like = {r.doc_id: r.x for r in df.crossJoin(one).select("doc_id", order_minhash.likeness("fp", "own").alias("x")).collect()}
    assert like[0] == 1 and like[2] < 0.1 and like[2] < like[1] < 1 and like[3] < 1


def test_order_minhash_sees_order_in_short_texts(spark):
    rows = []
    for n in (20, 40, 80, 160, 640):
        for i in range(12):
            w = [f"{rng.random()}" for _ in range(n)]
            rows.append((n, i, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    df = spark.createDataFrame(rows, "n int, i int, a string, b string")
    df = df.select("n", order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b"))).alias("x"))
    assert all(0.3 < r.x < 0.6 for r in df.groupBy("n").agg(F.avg("x").alias("x")).collect())


def test_next_rows_over_many_ranges(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 7).cast("string").alias("v"))
    got = {r.k: r.next_v for r in order_minhash.with_next(df, "k", ["v"]).collect()}
    assert got == {k: str(((k - 1) % 500) * 7) for k in range(500)}


def test_next_rows_of_equal_and_null_keys(spark):
    """A third of the rows without key and a third with one key are dealt to many ranges, in one ring."""
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(5)).otherwise(F.col("id") + 10).cast("long").alias("k"), F.col("id").cast("string").alias("v"))
    rows = order_minhash.with_next(df, "k", ["v"]).collect()
    after = {r.v: r.next_v for r in rows}
    assert len(rows) == 900 and sorted(after.values()) == sorted(after)
    keys, at, ring = {r.v: r.k for r in rows}, max(after, key=lambda v: int(v) * (int(v) % 3 == 2)), []
    for _ in range(900):
        ring.append(keys[at])
        at = after[at]
    assert at == max(after, key=lambda v: int(v) * (int(v) % 3 == 2))
    assert ring == sorted(ring, key=lambda k: -1e9 if k is None else k, reverse=True)
    bounds = order_minhash._ranges(df.select(F.coalesce("k", F.lit(-(1 << 63))).alias("_at"), F.xxhash64("v").alias("_tie")))
    assert len(bounds) >= 10 and sum(a == 5 for a, _ in bounds) > 3


def test_quality_model_learns_shapes_and_pairs():
    r = np.random.default_rng(3)
    x = r.random((4000, len(quality.FEATURES))).astype(np.float32)
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) & (np.abs(x[:, 2] - 0.5) < 0.4)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.9


def test_quality_boosting_equals_the_plain_version(monkeypatch):
    for name, value in dict(BINS=7, PAIR_BINS=4, PAIRS=2, ROUNDS=3, PAIR_ROUNDS=2).items():
        monkeypatch.setattr(quality, name, value)
    r = np.random.default_rng(8)
    x = r.random((90, 3)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2] * 3)  # few values
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6)).astype(float)
    model = quality.fit(x[:70], y[:70])
    pairs, score = brute.additive_model(x[:70].tolist(), y[:70].tolist(), 7, 4, 2, 3, 2, quality.RATE, quality.RIDGE)
    assert model.pairs == pairs
    assert np.allclose(model.score(x), [score(row) for row in x.tolist()], atol=1e-9)


def test_quality_scores_every_row(spark, docs, none, sf):
    labels = spark.createDataFrame([(d, int(d % 2), 0) for d, _ in DOCS[:40]] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == [d for d, _ in DOCS]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == len(DOCS)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = catalogue.op8_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id")
    right, n = got.select(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.95


def test_audio_round_trip(docs, none):
    rows = audio.audio_columns(docs).collect()
    texts = dict(DOCS)
    assert len(rows) == len(DOCS)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert audio.decode(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r.slots) == audio.SLOTS and all(a.end <= b.start for a, b in zip(r.segments, r.segments[1:]))
        tensor, feature = brute.audio_features(payload)
        got = pa.ipc.read_tensor(pa.BufferReader(bytes(r.tensor))).to_numpy()
        assert got.shape == (audio.SLOTS, audio.BANDS) and np.allclose(got, tensor, atol=2e-3)
        assert np.abs(np.array(r.feature.split(";")[0].split(), int) - feature).max() <= 1
    table = audio.tensor_column(pa.table({"tensor": pa.array([bytes(r.tensor) for r in rows[:3]])}))
    assert table["tensor"].type == pa.fixed_shape_tensor(pa.float32(), (audio.SLOTS, audio.BANDS))
    digest = {r.doc_id: r for r in audio.summary(audio.audio_columns(docs)).collect()}
    for r in rows:
        assert (digest[r.doc_id].media_bytes, digest[r.doc_id].media_sha256, digest[r.doc_id].tensor) == (len(r.media), hashlib.sha256(r.media).hexdigest(), r.tensor)
    assert audio.audio_columns(none).count() == 0


def test_audio_of_odd_rows(spark):
    rows = [(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (2, "word " * 300_000)]
    got = audio.summary(audio.audio_columns(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, media int"))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes) for r in got) == [(0, 0, 64), (0, 3, 64), (1, 3, 64), (1, 3, 64), (2, 1_500_000, 1_500_032)]
    assert len({r.feature for r in got if r.n_bytes == 3}) == 1


def test_resampling_equals_direct_convolution():
    x = np.random.default_rng(4).random(1000).astype(np.float32)
    got, phases = audio.resample(x), audio._filter(audio.UP, audio.DOWN, audio.TAPS)
    for n in (0, 1, 7, 100, len(got) - 1):
        at, phase = divmod(n * audio.DOWN, audio.UP)
        want = sum(phases[phase, k] * (x[at - k] if 0 <= at - k < len(x) else 0) for k in range(audio.TAPS))
        assert got[n] == pytest.approx(want, abs=1e-5)
    tone = np.sin(np.arange(16000) * 2 * np.pi * 440 / 16000).astype(np.float32)
    peak = np.abs(np.fft.rfft(audio.resample(tone))).argmax()
    assert peak == pytest.approx(440, abs=2)


def test_hysteresis_segments():
    energy = np.array([0, 0, 1, 10, 6, 5, 1, 0, 5, 0, 9, 9.0])
    assert audio.hysteresis(energy).tolist() == [[3, 6], [10, 12]]


def license_documents():
    """Notices wrapped, in comments, within a line, misspelt, shortened, doubled, and texts that only look like one."""
    t = dict(license_scan.HEADERS)
    code = "x = compute(y, z)  # of the house and in any garden\n" * 30
    wrap = lambda x, width, mark="": "\n".join(mark + line for line in textwrap.wrap(x, width))
    rows = [
        wrap(t["Apache-2.0-header"], 76, "# ") + "\n" + code, code + wrap(t["GPL-3.0-header"], 70, " * ") + "\n" + prose(100), wrap(t["MIT-grant"], 70) + "\n" + prose(60),
        prose(50) + " " + t["BSD-clause"] + " " + prose(50), "This work is available\nunder the MIT licence, see there.", "Distributed under the GNU GPL v2.", "Published under CC BY-SA 4.0",
        "Not under any license of the software, the License or the public.", "Released under the MIT License.\n" * 3 + "Licensed under the ISC License", t["GPL-2.0-header"].replace("version 2", "version 3"),
        t["ISC-grant"] + " " + t["MIT-grant"] + " " + t["BSD-clause"], None, "", "license", " \n ", prose(2000) + " Licensed under CC BY 4.0",
    ]
    for text in t.values():
        for share in (0.05, 0.15, 0.3):
            w = text.split()
            for i in rng.sample(range(len(w)), int(share * len(w))):
                w[i] = rng.choice(["", "some words", w[i - 1]])
            rows.append(prose(9) + " " + " ".join(w) + " " + prose(9))
    return [(i, x) for i, x in enumerate(rows)]


def test_license_hits_are_those_of_every_window(spark, none):
    small = [x for x in license_scan.TEMPLATES if len(x[1]) < 600]
    rows = license_documents()
    got = {r.doc_id: [(h.license, h.dice, h.first_word, h.n_words) for h in r.license_hits] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), small).collect()}
    assert got == {i: brute.license_hits(x, small) for i, x in rows}
    names = [[h[0] for h in got[i]] for i in range(len(rows))]
    assert names[:10] == [["Apache-2.0-header"], ["GPL-3.0-header"], ["MIT-grant"], ["BSD-clause"], ["MIT"], ["GPL-2.0"], ["CC-BY-SA-4.0"], [], ["MIT", "ISC"], ["GPL-3.0-header"]]
    assert sum(map(bool, names)) > 20
    assert license_scan.summary(license_scan.scan(none)).count() == 0


def test_whole_license_texts(spark):
    """Among prose, shortened and with words changed; a seeded run begins them, as in the brute version."""
    whole = sorted(license_scan.FULL_TEXTS.items())
    rows = []
    for n, text in whole:
        w = text.split()
        for i in rng.sample(range(len(w)), len(w) // 25):
            w[i] = "changed"
        rows += [(f"A page of prose.\n\n{text}\nMore prose."), " ".join(w), " ".join(w[: int(len(w) * 0.9)])]
    df = spark.createDataFrame([(i, x, 7, [i]) for i, x in enumerate(rows)], "doc_id long, text string, _b int, license_hits array<int>")
    scanned = license_scan.scan(df)
    assert scanned.columns == ["doc_id", "text", "_b", "license_hits"]
    got = {r.doc_id: {h.license: (h.dice, h.first_word, h.n_words) for h in r.license_hits} for r in scanned.collect()}
    for i in got:
        n = whole[i // 3][0]
        assert n in got[i] and got[i][n][0] > (0.99 if i % 3 == 0 else 0.8)
    short = [x for x in whole if len(x[1]) < 2000]
    for i in (k for k in got if len(rows[k]) < 2000):
        for name, dice, first, words in brute.license_hits(rows[i], short):
            assert got[i][name] == (dice, first, words)


def test_license_scan_of_odd_rows(spark):
    rows = [(None, "Released under the MIT License."), (None, None), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, "word " * 250_000 + "Released under the MIT License.")]
    got = license_scan.summary(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id or 0, r.licenses, r.first_word) for r in got if r.licenses) == [(0, "MIT", 0), (1, "MIT", 0), (1, "MIT", 0), (2, "MIT", 250_000)] and len(got) == 5


def test_shards_hold_the_mixture(docs, none):
    rows = sharding.interleave(docs, 4).collect()
    texts = dict(DOCS)
    assert sorted(r.doc_id for r in rows) == [d for d, _ in DOCS]
    count, by = {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        count.setdefault(r.shard, []).append(r.slot)
        by.setdefault(r.source, {}).setdefault(r.shard, 0)
        by[r.source][r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in count.values())
    assert max(map(len, count.values())) - min(map(len, count.values())) <= 1
    assert all(max(c.values()) - min(c.get(i, 0) for i in range(4)) <= 2 for c in by.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.interleave(docs.repartition(9), 4).collect()))
    assert sharding.interleave(none, 4).count() == 0


#: Null ids and texts, one id with two texts, a row twice, a blank, a text of 1.3 MB; columns whose names operators use.
ODD = [(None, None), (None, "alpha beta gamma"), (5, "one two three four five six"), (5, "seven eight nine"), (7, "Released under the MIT License."), (7, "Released under the MIT License."), (8, ""), (9, "long words of a text " * 65_000)]
CLASHING = "size _k _h _t _b _w _m _row slot taken target media tensor node component sig score held_out license_hits piece row length shard fp text_crc32 _at _tie gone n_words n_removed kept x quality _near_t a.b c`d".split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "s" if d in (5, 7) else None, *[i] * len(CLASHING)) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in CLASHING)).repartition(3)


OPERATORS = {
    "op1": lambda df, _: mixing.taken(mixing.mix(df, [5, 2, 1])),
    "op2": lambda df, _: audio.summary(audio.audio_columns(df)),
    "op3": lambda df, _: minhash.near_duplicates(df),
    "op4": lambda df, _: substrings.removal_digests(df),
    "op5": lambda df, _: packing.pack(packing.pieces(df, catalogue.tokenizer_path(), with_ids=True)).where("piece = 0"),
    "op6": lambda df, _: lm.score_corpus(df, least=1),
    "op7": lambda df, _: order_minhash.fingerprint_documents(df),
    "op8": lambda df, labels: quality.classify(df, labels),
    "op9": lambda df, _: license_scan.summary(license_scan.scan(df)),
    "op10": lambda df, _: sharding.interleave(df, 3),
}
#: What two equal rows need not share: where they went.
PLACES = {"taken", "first_slot", "n_slots", "row", "sequence_id", "offset", "edited_sha256", "edited_fingerprint", "near_edited", "near_next", "shard", "slot"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1), (8, None), (9, 1), (9, 0)], "doc_id long, quality int")
    rows = [r.asDict() for r in OPERATORS[name](odd, labels).collect()]
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(d or 0 for d, _ in ODD)
    a, b = ({k: v for k, v in r.items() if k not in PLACES} for r in rows if r["doc_id"] == 7)
    assert a == b
    empty = OPERATORS[name](odd.where("false"), labels.where("false"))
    assert empty.count() == 0


def test_odd_rows_in_stages(spark, odd):
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    kept = {"near": minhash.drop_near_duplicates(odd), "cut": substrings.remove_repeats(odd), "mix": mixing.mix_documents(odd, [5, 2, 1]), "good": quality.keep_good(odd, labels)}
    for df in kept.values():
        assert df.columns == odd.columns
        assert all(ODD[r.size] == (r.doc_id, r.text) or df is kept["cut"] for r in df.collect())
    assert sorted(r.size for r in kept["near"].collect())[:4] == [0, 1, 2, 3] and kept["near"].where("doc_id = 7").count() == 1
    assert kept["cut"].count() == len(ODD)


def test_rows_without_id_are_spread(spark):
    """20,000 of them: no bucket, range or key of an operator holds more than a few."""
    df = spark.range(20_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    from lodespar.llm._shared import bucket_bits, row_hash

    largest = lambda c: df.groupBy(c.alias("b")).count().agg(F.max("count")).first()[0]
    assert largest(F.shiftright(row_hash(17), 60 - bucket_bits(20_000))) < 1500
    assert largest(substrings._key()) < 5
    bounds = order_minhash._ranges(df.select(F.lit(-(1 << 63)).alias("_at"), F.xxhash64("text").alias("_tie")))
    assert len(bounds) > 30
    got = sharding.interleave(df, 7)
    assert {r["count"] for r in got.groupBy("shard").count().collect()} <= {2857, 2858}
