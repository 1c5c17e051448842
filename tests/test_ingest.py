import json

import pytest
from pyspark.sql import functions as F

from lodespar.functions import claims as C
from lodespar.functions import skills as S
from lodespar.functions import text as T
from lodespar.plans import evaluate, ingest, rungs
from lodespar.sources import logs, postings, threads
from lodespar.streaming import landing

POSTS = [
    ("11", "Acme | Senior Engineer | Remote (US) | $180k-$230k<p>We use Python, Kubernetes &amp; Go.<p>VISA sponsorship available"),
    ("12", "Globex | Engineer | NYC | $30-120/hr<p>Docker and React"),
    ("13", "We build things. Write to us."),
]


def thread(number, title, posts):
    return {"thread_id": str(number), "title": title, "created_at": "2026-07-01", "thread_date": None, "comments": [{"objectID": i, "author": "a", "comment_text": t, "parent_id": number, "story_id": number, "created_at": "x"} for i, t in posts]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("raw")
    (path / "1.json").write_text(json.dumps(thread(1, "Ask: Who is hiring? (July 2026)", POSTS), indent=1))
    (path / "2.json").write_text(json.dumps(thread(2, "Ask: Who is hiring? (June 2026)", [("21", "Initech | Intern | Onsite")]), indent=1))
    return str(path)


def test_ingest_end_to_end(spark, folder, tmp_path):
    ingest.run(spark, folder, f"{tmp_path}/p", f"{tmp_path}/unsure")
    rows = {r.comment_id: r for r in postings.read(spark, f"{tmp_path}/p").collect()}
    assert len(rows) == 4
    a = rows[11]
    assert (a.company, a.location, a.remote, a.salary_min, a.salary_max, a.skills, a.seniority, a.visa_sponsor, a.thread_month) == ("Acme", "US", "remote", 180000, 230000, ["Go", "Kubernetes", "Python"], "senior", True, "2026-07")
    assert (rows[12].salary_min, rows[12].salary_period) == (30 * 2080, "hour") and rows[13].skills == [] and rows[21].thread_month == "2026-06"
    assert [r.objectID for r in spark.read.json(f"{tmp_path}/unsure").orderBy("objectID").collect()] == ["13", "21"]


def test_reports(spark, folder):
    rows = ingest.extracted(ingest.with_text(threads.posts(threads.dated(threads.threads(spark, folder)))))
    got = {r.field: r.hits for r in ingest.coverage(rows).collect()}
    assert got["salary"] == 2 and got["all of them"] == 2 and got["company"] == 3
    assert ingest.n_threads(rows).first()[0] == 2 and {r.salary_period: r.n for r in ingest.periods(rows).collect()} == {"year": 1, "hour": 1}
    counts = ingest.counts(rows).first()
    assert counts.total_posts == counts.skills == counts.role_titles == 4 and counts.visa_sponsor == 1


def test_threads(spark, folder, tmp_path):
    all_of_them = threads.dated(threads.threads(spark, folder))
    posts = threads.posts(all_of_them)
    assert threads.latest(all_of_them).first().thread_id == "1"
    assert [r.objectID for r in threads.by_id(posts, ["21", "11"]).collect()] == ["21", "11"]
    with pytest.raises(KeyError, match="99"):
        threads.by_id(posts, ["11", "99"])
    assert threads.top_level(posts).count() == 4 and threads.first_posts(posts, 1).count() == 2 and threads.hiring(all_of_them, 1).count() == 1
    with pytest.raises(FileNotFoundError):
        threads.threads(spark, str(tmp_path))


def test_landing_is_write_once(spark, tmp_path):
    pages = [{"nbPages": 2, "hits": [{"parent_id": 7, "objectID": "1"}, {"parent_id": 1, "objectID": "2"}]}, {"nbPages": 2, "hits": [{"parent_id": "7", "objectID": "3"}]}]
    get = lambda path, params: pages[params["page"]] if path == "/search" else {"hits": [{"title": "Freelancer?"}, {"title": "Who is Hiring? (May 2026)"}]}
    assert len(threads.hiring_threads(get, "someone", 3)) == 1
    assert threads.land(spark, get, str(tmp_path), "7", "Who is hiring? (May 2026)", pause=0) == 2
    assert threads.land(spark, get, str(tmp_path), "7", pause=0) == 0
    assert json.loads((tmp_path / "7.json").read_text())["thread_date"] == "2026-05-01"


def test_history_upsert(spark, tmp_path):
    row = lambda d, t, n: (d, t, n, *[n] * 11)
    frame = lambda *rows: spark.createDataFrame(list(rows), logs.HISTORY)
    path = f"{tmp_path}/h"
    logs.update_history(spark, path, frame(row("2026-07-02", "1", 5), row("2026-07-01", "1", 4)))
    got = logs.update_history(spark, path, frame(row("2026-07-01", "1", 9)))
    assert [(r.date, r.total_posts) for r in logs.valid_history(got).collect()] == [("2026-07-01", 9), ("2026-07-02", 5)]
    assert logs.latest_totals(got, ["total_posts"]).first()[0] == 5
    assert logs.trend_table(got, ["date", "total_posts"]).splitlines()[1].split() == ["2026-07-01", "9"]
    assert logs.valid_history(frame(row("July", "1", 1), ("2026-07-01", "1", 1, *[2] * 11))).count() == 0


def labels(spark, ids):
    rows = [(i, "dev", "s", "Acme", "US", "remote", 180000, 230000, "USD", "year", "senior", ["go", "k8s", "python"], [], None, True, None, False) for i in ids]
    return spark.createDataFrame(rows, logs.LABEL)


def test_labels_and_frozen_splits(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"tune": ["11", "12"], "held-out": ["13"]}))
    splits = logs.frozen_splits(spark, f"{tmp_path}/s.json")
    all_of_them = labels(spark, ["11", "12", "13"])
    assert logs.labelled(all_of_them, splits, "dev").count() == 2 and logs.labelled(all_of_them, splits).count() == 3
    with pytest.raises(ValueError):
        logs.labelled(labels(spark, ["11", "12"]), splits)
    with pytest.raises(ValueError):
        logs.labelled(all_of_them, splits, "test")
    logs.save_labels(all_of_them, f"{tmp_path}/l")
    assert logs.labels(spark, f"{tmp_path}/l").count() == 3 and logs.uncertain(all_of_them).count() == 0
    assert logs.spliced("a <!-- tally:start -->x<!-- tally:end --> b", "T") == "a <!-- tally:start -->\nT\n<!-- tally:end --> b"


@pytest.fixture
def pairs(spark, folder):
    posts = ingest.with_text(threads.posts(threads.dated(threads.threads(spark, folder))))
    return evaluate.with_labels(posts, labels(spark, ["11", "99"]).where("comment_id = '11'"))[0]


def test_evaluation_of_the_rules(spark, pairs, tmp_path):
    record = evaluate.run(pairs, "rules")
    s = record["scores"]
    assert (s["n"], s["company_extracted"], s["salary_precision"], s["location_extracted"], s["skills_f1"], s["remote_accuracy"], s["seniority_accuracy"]) == (1, 1, 1.0, 1, 1.0, 1.0, 1.0)
    assert record["slices"] == {"pipe": {"n": 1, "skills_f1": 1.0}}
    logs.append(spark.createDataFrame([(record["run_id"], record["n"])], "run_id string, n int"), f"{tmp_path}/runs")
    assert logs.runs(spark, f"{tmp_path}/runs").count() == 1 and logs.runs(spark, f"{tmp_path}/none") is None


def test_missing_posts(spark, folder):
    posts = ingest.with_text(threads.posts(threads.threads(spark, folder)))
    with pytest.raises(KeyError):
        evaluate.with_labels(posts, labels(spark, ["11", "99"]))
    kept, missing = evaluate.with_labels(posts, labels(spark, ["11", "99"]), skip_missing=True)
    assert kept.count() == 1 and missing == ["99"]


def predict(spark, name, text, *answers):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return rungs.predictor(name, rungs.Scripted(*answers))(df).first()


def test_workflow_revises_once(spark):
    text = "Acme | Engineer | Berlin"
    r = predict(spark, "W", text, {"company": "Google", "salary_min": 500000}, {"company": "Acme"})
    assert (r.prediction.company, r.prediction.salary_min, r.trace.revised, r.trace.model_calls, r.trace.verify_failures) == ("Acme", None, True, 2, 2)
    r = predict(spark, "W", text, {"company": "Acme", "usage": {"input_tokens": 7}})
    assert not r.trace.revised and r.trace.input_tokens == 7
    r = predict(spark, "W", text, {"surprise": 1})
    assert r.prediction.company is None and r.trace.error.startswith("ValueError")


def test_fallback_asks_only_for_what_is_missing(spark):
    text = "We are a team in  Berlin building Python and Go tools for Meta."
    r = predict(spark, "F", text, {"company": "META", "location": "Munich"})
    assert (r.prediction.company, r.prediction.location, r.trace.verify_failures) == ("META", None, 1)
    r = predict(spark, "F", "Acme | Engineer | Remote (US)", {"company": "x"})
    assert (r.prediction.company, r.trace.model_calls) == ("Acme", 0)
    r = predict(spark, "F", text, {"nonsense": 1})
    assert r.prediction.skills == ["go", "python"] and r.trace.error


def test_agent_uses_tools_within_its_limit(spark):
    call = {"tool_calls": [{"name": "verify_claim", "args": {"value": "Google"}}]}
    r = predict(spark, "agent:C", "Acme", call, {"output": {"company": "Acme"}})
    assert (r.prediction.company, list(r.trace.tool_calls), r.trace.verify_failures, r.trace.model_calls) == ("Acme", ["verify_claim"], 1, 2)
    r = predict(spark, "agent:E", "Acme", call)
    assert r.trace.model_calls == rungs.MOST_CALLS and r.prediction.company is None
    assert rungs.config("e").seeded and not rungs.config("D").seeded and rungs.config("A").tools == ()
    assert rungs.parse_rungs("f, b") == ("B", "F")
    with pytest.raises(ValueError):
        rungs.parse_rungs("A")
    with pytest.raises(KeyError):
        rungs.predictor("agent:Z", rungs.Scripted({}))


def test_ladder(pairs):
    good = rungs.Scripted({"company": "Acme", "usage": {"input_tokens": 1000, "output_tokens": 100}})
    records, off = evaluate.ladder(pairs, {"W": good, "F": good}, {"input": 1.0, "output": 2.0})
    assert records[0]["cost_usd"] == pytest.approx(1200 / 1e6) and records[1]["cost_usd"] == 0 and records[1]["cost_complete"]
    assert {r.field: (r.W, r.F) for r in off.collect()}["salary"] == (1, 0)


def test_claims(spark):
    rows = [(61_000, 74_500, ["Kafka", "golang"]), (88_000, None, None)]
    said = {
        1: ("2 roles from £61,000 to £74,500, one with Kafka", [("money", "£61,000 ", True), ("money", "£74,500, ", True), ("number", "2", True), ("skill", "kafka", True)]),
        2: ("88%? No: $88k, or $9k, for 5 people in Rust", [("money", "$88k", True), ("money", "$9k", False), ("number", "5", False), ("skill", "rust", False)]),
        3: ("roughly 3 roles, over 12,000 others", [("number", "3", True), ("number", "12,000", False)]),
        4: ("3 roles of 61 a day", [("number", "3", False), ("number", "61", True)]),
        5: ("Go and golang", [("skill", "golang", True), ("skill", "go", True)]),
        6: ("", []),
        7: (None, []),
    }
    kind = "id int, summary string, rows array<struct<salary_min: long, salary_max: long, skills: array<string>>>, allowed array<int>, text string"
    df = spark.createDataFrame([(i, t, rows, None, "own") for i, (t, _) in said.items()] + [(8, "7 of them, 2 more", rows, [7, 9], "own"), (9, "1 role", None, [], "own"), (10, "0 roles", None, None, "own")], kind)
    found = {}
    for r in C.claims(df.drop("text"), "summary", "rows", "allowed").collect():
        found.setdefault(r.id, []).append((r.kind, r.text, r.grounded))
        assert bool(r.reason) is not r.grounded
    want = {i: x for i, (_, x) in said.items() if x} | {8: [("number", "7", True), ("number", "2", False)], 9: [("number", "1", False)], 10: [("number", "0", True)]}
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in want.items()}
    every = C.claims(df.drop("text"), "summary", "rows")
    sums = {r.id: (r.grounded, r.n_ungrounded) for r in C.summary_grounded(every, ["id"]).collect()}
    assert sums[1] == (True, 0) and sums[2] == (False, 3)
    assert {r.id for r in C.ungrounded_claims(every).collect()} == {i for i, (ok, _) in sums.items() if not ok}
    with pytest.raises(Exception, match="ungrounded"):
        C.require_grounded(every).collect()


def test_verification(spark):
    cases = [("95000", "£95,000", True), ("95000", "95K base", True), ("Quillon", "by QUILLON", True), ("7", "17", True), ("12", "9,1 23", True), ("95000", "96k", False), ("41", "4 of 2", False), ("", "x", True), (None, "x", True)]
    df = spark.createDataFrame([c[:2] for c in cases], "v string, t string")
    assert [r.x for r in df.select(C.verify_claim(F.col("v"), F.col("t"))["grounded"].alias("x")).collect()] == [ok for *_, ok in cases]
    assert [C.is_grounded(v, t) for v, t, _ in cases] == [ok for *_, ok in cases]
    spans = spark.createDataFrame([("Oslo", "the Oslofjord"), ("ｏslo ", "At OSLO  now"), ("Rio  Verde", "in rio verde.")], "v string, t string")
    assert [r.x for r in spans.select(C.source_span("v", "t").alias("x")).collect()] == [None, "ｏslo", "Rio  Verde"]


def test_roles_and_candidates(spark):
    two = "We have two:\n1) Platform engineer who keeps our many clusters alive\n2) Product designer for maps, charts and other pictures"
    texts = [two, "1. three years\n2. some patience", "no list at all", "", "Role 1: Researcher of weather models and their errors\n\nrole 2 - Manager of researchers, with a love of spreadsheets"]
    assert [len(C.split_roles(t)) for t in texts] == [2, 1, 1, 1, 2] and C.split_roles(texts[1]) == [texts[1]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in df.select("i", C.roles(F.col("t")).alias("x")).orderBy("i").collect()] == [C.split_roles(t) for t in texts]
    assert [c["match"] for c in C.salary_candidates("raised £3M, pays $66k-$72k")] == ["$66k-$72k", "£3", "$72k"]
    assert C.salary_candidates("x" * 60 + "\n€50k") == [{"match": "€50k", "context": "x" * 44 + " €50k"}]


def test_skill_names(spark):
    terms = ["K8s", " py ", "cobol", "", None]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    for t, r in zip(terms, df.select(S.canonical_skill(F.col("t")).alias("s")).collect()):
        assert {k: v for k, v in r.s.asDict().items() if k != "reason" or v} == S.canonical_local(t)


def test_text_functions(spark):
    pages = ["<p>Caf&eacute; &amp;amp; bar&#8217;s &#x1F600;<br>x &notit; &copy", " &lt;b&gt; ", None, ""]
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    assert [r.x for r in df.select(T.html_to_text(F.col("h")).alias("x")).collect()] == ["Café &amp; bar’s 😀x ¬it; ©", "<b>", "", ""]
    pairs = [("night", "nacht", 0.25), ("aaaa", "aaa", 0.8), ("ab ab", "ab", 2 / 5), ("a", "b", 0.0), ("Same ", "same", 1.0), ("abcabc", "bcbc", 2 * 2 / 8)]
    df = spark.createDataFrame(pairs, "a string, b string, x double")
    assert all(abs(r.y - r.x) < 1e-12 for r in df.select("x", T.dice(F.col("a"), F.col("b")).alias("y")).collect())
    at = spark.createDataFrame([("2026-07-01 02:30:05",)], "t string").select(T.local_time(F.col("t")).alias("x"), T.share_text(F.lit(1), F.lit(8)).alias("s"), T.share_text(F.lit(1), F.lit(0)).alias("n")).first()
    assert tuple(at) == ("2026-06-30, 22:30:05", "12.5%", "—")


def test_last_row_of_an_id_wins(spark, tmp_path):
    for i, v in enumerate(("old", "new")):
        spark.createDataFrame([(1, v), (2 + i, v)], "k int, v string").coalesce(1).write.json(f"{tmp_path}/{i}")
    df = spark.createDataFrame([(1, "old"), (2, "x"), (1, "new")], "k int, v string").coalesce(1)
    assert [(r.k, r.v) for r in threads.by_id(df, [2, 1, 2], "k").collect()] == [(2, "x"), (1, "new"), (2, "x")]
    assert threads.example(df, 2, "k", v="x") == {"k": 2, "v": "x"}
    assert threads.example(df, 2, "k", v="y") is threads.example(df, 1, "k") is threads.example(df, 9, "k") is None


def test_label_checks_and_samples(spark, tmp_path):
    row = dict(comment_id="4", done=True, remote="onsite", seniority=None, salary_period="year", salary_min=5, salary_max=9, uncertain=["salary", "salary", "remote"])
    frame = lambda *rows: spark.createDataFrame([{**row, **r} for r in rows], "comment_id string, done boolean, remote string, seniority string, salary_period string, salary_min long, salary_max long, uncertain array<string>")
    good, bad = frame({}, {"comment_id": "5", "uncertain": []}), [{"remote": "sometimes"}, {"done": None}, {"comment_id": "x"}, {"salary_max": 4}, {"seniority": "boss"}, {"salary_period": "week"}]
    assert logs.checked_labels(good).count() == 2
    for b in bad:
        with pytest.raises(Exception, match="bad "):
            logs.checked_labels(frame(b)).collect()
        assert logs.checked_labels(frame(b, {}), strict=False).count() == 1
    assert {r.field: r.n for r in logs.uncertain_fields(good).collect()} == {"salary": 1, "remote": 1}
    sample = spark.createDataFrame([("4", "a"), ("5", "b"), ("6", "b")], "comment_id string, stratum string")
    assert [r.comment_id for r in logs.to_recheck(sample, good).collect()] == ["4"]
    logs.write_sample(sample, f"{tmp_path}/s/sample.json", 7, "proportional", {"a": 1, "b": 2})
    written = json.loads((tmp_path / "s/sample.json").read_text())
    assert (written["seed"], written["n"], written["strata"]) == (7, 3, {"a": 1, "b": 2}) and written["posts"][0] == {"comment_id": "4", "stratum": "a"}


def test_streaming_postings(spark, folder, tmp_path):
    landing.write(landing.postings(spark, folder), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 23:00:00", "a"), (3, "2024-01-05 01:00:00", "b")], "id int, at string, kind string").select("id", F.to_timestamp("at").alias("at"), "kind").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("id int, at timestamp, kind string").parquet(f"{tmp_path}/e")
    q = landing.counts_by_window(stream, "at", "kind", key="id").writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.kind, r.n) for r in spark.table("windowed").collect()] == [("a", 2)]
