"""Every query of the library by name, with its SQL for the oracle.

The test tables hold no job posts, so each operator runs on an analogue. Orders stand for postings: the
order key is the id, the month (or year) of the order its thread, a line's brands its skills, the price
its pay, the status its arrangement. Documents with their labels stand for scored texts, pages for
HTML, conversations for threads of comments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespar.functions import claims as C
from lodespar.functions import skills as S
from lodespar.functions import text as T
from lodespar.functions.extraction import extraction, is_confident, normalized
from lodespar.functions.vocabulary import DISPLAY, SYNONYMS
from lodespar.operators import sampling, scoring, serve
from lodespar.session import new_path, spread
from lodespar.sources import logs, threads
from lodespar.sources import postings as stored
from lodespar.sources.schemas import POSTING, parsed

FLAGSHIP = "a4_trends_share"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str, bucket: str = "yyyy-MM") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    brands = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("skills"))
    pay = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").join(brands, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("comment_id"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("company"),
        F.lit(None).cast("string").alias("location"),
        F.when(F.col("o_orderstatus") == "F", "remote").when(F.col("o_orderstatus") == "O", "hybrid").otherwise("onsite").alias("remote"),
        pay.alias("salary_min"),
        F.when(~F.col("o_orderpriority").startswith("1"), pay + 1000).alias("salary_max"),
        F.lit("year").alias("salary_period"),
        F.col("o_orderpriority").alias("seniority"),
        "skills",
        F.date_format("o_orderdate", bucket).alias("thread_month"),
    )


def p_sql(bucket: str = "%Y-%m") -> str:
    return f"""p AS (
  SELECT o_orderkey AS comment_id, 'customer ' || o_custkey AS company, CAST(NULL AS VARCHAR) AS location,
    CASE o_orderstatus WHEN 'F' THEN 'remote' WHEN 'O' THEN 'hybrid' ELSE 'onsite' END AS remote,
    CAST(floor(o_totalprice) AS BIGINT) AS salary_min,
    CASE WHEN NOT starts_with(o_orderpriority, '1') THEN CAST(floor(o_totalprice) AS BIGINT) + 1000 END AS salary_max,
    'year' AS salary_period, o_orderpriority AS seniority, skills, strftime(o_orderdate, '{bucket}') AS thread_month
  FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS skills
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _plain(df: DataFrame, *lists: str) -> DataFrame:
    """Lists as text, so that any engine compares them alike."""
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


WANTED = ["Brand#11", "Brand#23"]
MINE = ["Brand#2", "Brand#11", "Brand#12", "Brand#17", "Brand#23"]
_MINE = "[" + ", ".join(f"'{b}'" for b in MINE) + "]"
_JOBS = "comment_id, company, location, remote, salary_min, salary_max, salary_period, seniority, array_to_string(skills, ',') AS skills, thread_month"


@query(f"WITH {p_sql()} SELECT count(*) AS postings FROM p")
def a1_health_count(spark, sf_dir):
    return serve.health(postings(spark, sf_dir))


@query(f"""WITH {p_sql('%Y')} SELECT {_JOBS} FROM p WHERE thread_month = (SELECT max(thread_month) FROM p)
  AND list_contains(skills, 'Brand#11') AND remote = 'hybrid' AND salary_min >= 20000
  ORDER BY p.salary_max DESC NULLS LAST, comment_id LIMIT 50""")
def p2_jobs_latest(spark, sf_dir):
    return _plain(serve.jobs(postings(spark, sf_dir, "yyyy"), skill="Brand#11", remote="hybrid", min_salary=20000), "skills")


@query(f"WITH {p_sql()} SELECT {_JOBS} FROM p WHERE thread_month = '1997-03' ORDER BY p.salary_max DESC NULLS LAST, comment_id LIMIT 50")
def p3_jobs_month(spark, sf_dir):
    return _plain(serve.jobs(postings(spark, sf_dir), month="1997-03"), "skills")


_TRENDS = """t AS (SELECT thread_month, count(*) AS total FROM p GROUP BY 1),
c AS (SELECT thread_month, skill, count(*) AS postings FROM (SELECT thread_month, unnest(skills) AS skill FROM p)
  WHERE skill IN ('Brand#11', 'Brand#23') GROUP BY 1, 2),
r AS (SELECT c.*, round(postings / total, 4) AS share, dense_rank() OVER (ORDER BY c.thread_month DESC) AS k FROM c JOIN t USING (thread_month))"""


@query(f"WITH {p_sql()}, {_TRENDS} SELECT thread_month, skill, postings, share FROM r WHERE k <= 24")
def a4_trends_share(spark, sf_dir):
    return serve.trends(postings(spark, sf_dir), WANTED, 24)


@query(f"""WITH {p_sql('%Y')}, {_TRENDS}, g AS (SELECT * FROM (SELECT DISTINCT thread_month FROM r), (SELECT DISTINCT skill FROM r))
SELECT g.thread_month, g.skill, coalesce(share, 0.0) AS share FROM g LEFT JOIN r USING (thread_month, skill)""")
def j16_trend_grid(spark, sf_dir):
    return serve.trend_grid(serve.trends(postings(spark, sf_dir, "yyyy"), WANTED, 120))


@query(f"WITH {p_sql()} SELECT comment_id, thread_month, count(*) OVER (PARTITION BY thread_month) AS n FROM p")
def w1_window_total(spark, sf_dir):
    return serve.with_month_total(postings(spark, sf_dir)).select("comment_id", "thread_month", "n")


@query(f"WITH {p_sql()} SELECT thread_month, skill, count(*) AS n FROM (SELECT thread_month, unnest(skills) AS skill FROM p) GROUP BY 1, 2 ORDER BY n DESC, thread_month, skill LIMIT 20")
def a5_topk_explode(spark, sf_dir):
    return serve.top_skills(postings(spark, sf_dir))


_IDF = "w AS (SELECT skill, ln((n + 1) / (c + 1)) + 1 AS weight FROM (SELECT unnest(skills) AS skill, count(*) AS c FROM {0} GROUP BY 1), (SELECT count(*) AS n FROM {0}))"


@query(f"WITH {p_sql()}, {_IDF.format('p')} SELECT skill, round(weight, 9) AS weight FROM w")
def a26_idf(spark, sf_dir):
    return serve.idf(postings(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


_MATCH = f"""l AS (SELECT * FROM p WHERE thread_month = (SELECT max(thread_month) FROM p)), {_IDF.format('l')},
e AS (SELECT comment_id, company, salary_min, salary_max, list_sort(list_intersect(skills, {_MINE})) AS matched,
  list_sort(list_filter(skills, lambda x: NOT list_contains({_MINE}, x))) AS missing, unnest(skills) AS skill FROM l),
m AS (SELECT comment_id, any_value(company) AS company, any_value(salary_min) AS salary_min, any_value(salary_max) AS salary_max,
  any_value(matched) AS matched, any_value(missing) AS missing, sum(CASE WHEN list_contains(matched, skill) THEN weight ELSE 0 END) / sum(weight) AS score
  FROM e JOIN w USING (skill) WHERE len(matched) >= 2 GROUP BY 1)"""


@query(f"""WITH {p_sql('%Y')}, {_MATCH} SELECT comment_id, company, round(score, 6) AS score, array_to_string(matched, ',') AS matched,
array_to_string(missing, ',') AS missing, salary_min, salary_max FROM m ORDER BY round(score, 9) DESC, comment_id LIMIT 10""")
def t2_match_rank(spark, sf_dir):
    latest = serve.in_latest_month(postings(spark, sf_dir, "yyyy"))
    return _plain(serve.match(latest, MINE, canonical=False), "matched", "missing").withColumn("score", F.round("score", 6))


@query(f"""WITH {p_sql()}, x AS (SELECT comment_id, coalesce(skills, []) AS skills FROM p)
SELECT comment_id, array_to_string(list_sort(list_intersect(skills, {_MINE})), ',') AS matched,
array_to_string(list_sort(list_filter(skills, lambda x: NOT list_contains({_MINE}, x))), ',') AS missing,
CASE WHEN len(skills) = 0 THEN 0.0 ELSE len(list_intersect(skills, {_MINE})) / len(skills) END AS p,
CASE WHEN len(skills) = 0 THEN 0.0 ELSE len(list_intersect(skills, {_MINE})) / 5 END AS r,
CASE WHEN len(skills) = 0 THEN 0.0 ELSE 2 * len(list_intersect(skills, {_MINE})) / (len(skills) + 5) END AS f1 FROM x""")
def u1_matched_gap_sets(spark, sf_dir):
    rows = postings(spark, sf_dir).withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    matched, missing = serve.overlap(F.col("skills"), MINE)
    s = scoring.set_scores(F.col("skills"), F.array(*map(F.lit, MINE)), canonical=False)
    return _plain(rows.select("comment_id", matched.alias("matched"), missing.alias("missing"), s.alias("s")).select("comment_id", "matched", "missing", "s.*"), "matched", "missing")


@query("SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS precision FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)")
def a28_precision_at_k(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return serve.precision_at_k(orders, orders.where("o_orderstatus = 'F'"), [F.desc("o_totalprice"), "o_orderkey"], 10, "o_orderkey")


@query("""SELECT p_partkey + c * 100000000 AS p_partkey, p_brand FROM part, (SELECT unnest(range(3)) AS c)""")
def j7_replicate(spark, sf_dir):
    return serve.replicated(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), 3, "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 10 AND contains(lower(concat_ws(chr(31), p_name, p_brand, p_type)), 'ring')")
def p13_search(spark, sf_dir):
    return serve.searched(table(spark, sf_dir, "part"), "RING", ["p_name", "p_brand", "p_type"], p_size=10).select("p_partkey", "p_name")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a predicted quality by length, and the label where there is one."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.withColumn("predicted", F.when(F.col("n_chars") > 400, 1).when(F.col("n_chars") > 100, 0)).withColumn("outcome", scoring.outcome(F.col("predicted"), F.col("quality"), text=False))


_SCORED = """s AS (SELECT *, CASE WHEN quality IS NULL AND predicted IS NULL THEN 'abstained' WHEN quality IS NULL THEN 'hallucinated'
  WHEN predicted IS NULL THEN 'missed' WHEN predicted = quality THEN 'extracted' ELSE 'wrong' END AS outcome
  FROM (SELECT d.*, quality, toxic, CASE WHEN n_chars > 400 THEN 1 WHEN n_chars > 100 THEN 0 END AS predicted FROM documents d LEFT JOIN labels USING (doc_id)))"""


@query(f"WITH {_SCORED} SELECT count(*) AS total_posts, count(quality) AS quality, count(toxic) AS toxic, count(predicted) AS predicted, count(text) AS text FROM s")
def a9_nonnull_counts(spark, sf_dir):
    from lodespar.plans.ingest import counts

    return counts(_scored(spark, sf_dir), ["quality", "toxic", "predicted", "text"])


@query(f"WITH {_SCORED} SELECT lang, outcome, count(*) AS n FROM s GROUP BY 1, 2")
def a10_outcomes(spark, sf_dir):
    return scoring.outcomes(_scored(spark, sf_dir), ["lang"])


_WILSON = """CASE WHEN attempts = 0 THEN {0}.0 ELSE {1}({0}.0, ((p + 1.959963984540054 * 1.959963984540054 / (2 * attempts)) {2} 1.959963984540054 * sqrt(p * (1 - p) / attempts + 1.959963984540054 * 1.959963984540054 / (4 * attempts * attempts))) / (1 + 1.959963984540054 * 1.959963984540054 / attempts)) END"""


@query(f"""WITH {_SCORED}, c AS (SELECT lang, count(*) AS n, count_if(outcome = 'extracted') AS extracted, count_if(outcome = 'hallucinated') AS h,
  count_if(outcome IN ('extracted', 'wrong', 'hallucinated')) AS attempts FROM s GROUP BY 1), q AS (SELECT *, extracted / attempts AS p FROM c)
SELECT lang, n, round(attempts / n, 9) AS coverage, round(coalesce(p, 0), 9) AS precision, round(h / n, 9) AS hallucination_rate,
round({_WILSON.format(0, 'greatest', '-')}, 9) AS precision_low, round({_WILSON.format(1, 'least', '+')}, 9) AS precision_high FROM q""")
def a11_wilson(spark, sf_dir):
    r = scoring.nullable_report(_scored(spark, sf_dir), "outcome", ["lang"])
    return r.select("lang", "n", *[F.round(c, 9).alias(c) for c in ("coverage", "precision", "hallucination_rate", "precision_low", "precision_high")])


@query(f"""WITH {_SCORED}, c AS (SELECT lang, count(*) AS n, count_if(outcome IN ('extracted', 'abstained')) AS extracted FROM s GROUP BY 1),
q AS (SELECT lang, n, n AS attempts, extracted / n AS p FROM c)
SELECT lang, round(p, 9) AS accuracy, round({_WILSON.format(0, 'greatest', '-')}, 9) AS accuracy_low, round({_WILSON.format(1, 'least', '+')}, 9) AS accuracy_high FROM q""")
def a33_derived_accuracy(spark, sf_dir):
    r = scoring.derived_accuracy(scoring.nullable_report(_scored(spark, sf_dir), "outcome", ["lang"]))
    return r.select("lang", *[F.round(c, 9).alias(c) for c in ("accuracy", "accuracy_low", "accuracy_high")])


@query(f"WITH {_SCORED} SELECT coalesce(CAST(quality AS VARCHAR), 'None') AS truth, coalesce(CAST(predicted AS VARCHAR), 'None') AS predicted, count(*) AS n FROM s GROUP BY 1, 2")
def a15_confusion(spark, sf_dir):
    return scoring.confusion(_scored(spark, sf_dir), "quality", "predicted")


@query(f"""WITH {_SCORED}, m AS (SELECT coalesce(CAST(quality AS VARCHAR), 'None') AS truth, coalesce(CAST(predicted AS VARCHAR), 'None') AS predicted FROM s)
SELECT truth, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 4) AS recall FROM m GROUP BY 1""")
def a15_recall(spark, sf_dir):
    return scoring.class_recall(scoring.confusion(_scored(spark, sf_dir), "quality", "predicted"))


@query(f"""WITH {_SCORED}, m AS (SELECT coalesce(CAST(quality AS VARCHAR), 'None') AS truth, coalesce(CAST(predicted AS VARCHAR), 'None') AS predicted FROM s)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM m""")
def a15_accuracy(spark, sf_dir):
    return scoring.accuracy(scoring.confusion(_scored(spark, sf_dir), "quality", "predicted")).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {p_sql()}, x AS (SELECT thread_month, coalesce(skills, []) AS skills FROM p), f AS (SELECT thread_month,
  CASE WHEN len(skills) = 0 THEN 0.0 ELSE 2 * len(list_intersect(skills, {_MINE})) / (len(skills) + 5) END AS f1 FROM x)
SELECT thread_month, count(*) AS n, round(avg(f1), 9) AS macro_f1 FROM f GROUP BY 1""")
def a17_slice_f1(spark, sf_dir):
    rows = postings(spark, sf_dir)
    rows = rows.withColumn("s", scoring.set_scores(F.coalesce("skills", F.array().cast("array<string>")), F.array(*map(F.lit, MINE)), canonical=False))
    return scoring.set_report(rows, "s", ["thread_month"]).select("thread_month", "n", F.round("macro_f1", 9).alias("macro_f1"))


_RANKED = "e AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)"


@query(f"WITH {_RANKED} SELECT event_type, len(v) AS n, round((v[(len(v) + 1) // 2] + v[(len(v) + 2) // 2]) / 2, 9) AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT)] AS p95 FROM e")
def a18_p50_p95(spark, sf_dir):
    return scoring.latencies(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", "n", F.round("p50", 9).alias("p50"), "p95")


@query(f"WITH {_RANKED} SELECT event_type, v[CAST(ceil(len(v) * 0.95) AS BIGINT)] AS p95_nearest FROM e")
def a19_p95_nearest(spark, sf_dir):
    return scoring.latencies(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", "p95_nearest")


@query("""SELECT lang, 'mean_chars' AS field, round(avg(n_chars), 6) AS score FROM documents GROUP BY 1
UNION ALL SELECT lang, 'n' AS field, CAST(count(*) AS DOUBLE) AS score FROM documents GROUP BY 1""")
def s28_unpivot_scores(spark, sf_dir):
    wide = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return scoring.unpivoted(wide, ["lang"], {"n": "n", "mean_chars": "mean_chars"})


_HEADER = r"regexp_extract(text, '(?m)^[^\S\n]*(\S[^\n]*?)[^\S\n]*$', 1)"
_STRATUM = f"""CASE WHEN len(string_split({_HEADER}, '|')) > 2 THEN 'pipe' ELSE 'prose' END || '/' ||
CASE WHEN contains(text, 'token') THEN 'has_salary' ELSE 'no_salary' END || '/' || CASE WHEN length(text) > 1200 THEN 'long' ELSE 'short' END"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("stratum", T.stratum(F.col("text"), F.col("text").contains("token")))


@query(f"SELECT {_STRATUM} AS stratum, count(*) AS n FROM documents GROUP BY 1")
def f28_strata(spark, sf_dir):
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN len(string_split({_HEADER}, '|')) > 2 THEN 'pipe' WHEN length(text) > 1200 THEN 'long_prose' ELSE 'prose' END AS slice, count(*) AS n FROM documents GROUP BY 1")
def f29_slices(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.slice_name(F.col("text")).alias("slice")).agg(F.count(F.lit(1)).alias("n"))


_PICK = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('20260801:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20"


@query(_PICK)
def w4_stratified_pick(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.pick(docs, dict.fromkeys(("de", "en", "es", "fr"), 20), "doc_id", "lang").select("doc_id", "lang")


@query("""SELECT item_id, CASE WHEN row_number() OVER (ORDER BY md5('20260802:' || item_id), item_id) <= round_even((SELECT count(*) FROM benchmark) * (2 / 3), 0) THEN 'dev' ELSE 'held-out' END AS split FROM benchmark""")
def w5_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "split")


@query(f"""WITH c AS (SELECT lang AS value, count(*) AS attempts FROM ({_PICK}) GROUP BY 1), q AS (SELECT *, round_even(attempts * 0.8, 0) / attempts AS p FROM c)
SELECT value, attempts AS n, round((({_WILSON.format(1, 'least', '+')}) - ({_WILSON.format(0, 'greatest', '-')})) / 2, 9) AS margin FROM q""")
def a30_slice_power(spark, sf_dir):
    return sampling.slice_power(w4_stratified_pick(spark, sf_dir), ["lang"]).select("value", "n", F.round("margin", 9).alias("margin"))


#: References that the made-up pages below have, by themselves and as the text of another.
_REFERENCES = {"&eacute;": "é", "&rsquo;": "’", "&#8211;": "–", "&#x20AC;": "€", "&frac12;": "½", "&AMP;": "&", "&NotEqualTilde;": "≂̸"}
_PAGE = "html || '<p>" + " ".join(_REFERENCES) + " &amp;lt;p&amp;gt; <b>&'"


def _decoded_sql(text: str, references: dict[str, str]) -> str:
    # One reference at a time, the ampersand's last, is right for these pages.
    for written, plain in references.items():
        text = f"replace({text}, '{written}', '{plain}')"
    return text


_PLAIN_REFERENCES = _REFERENCES | {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "''", "&#39;": "''", "&nbsp;": "\xa0", "&copy;": "©", "&middot;": "·", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


@query(rf"SELECT page_id, md5(regexp_replace(regexp_replace({_decoded_sql(f"regexp_replace(replace({_PAGE}, '<p>', chr(10) || chr(10)), '<[^>]+>', '', 'g')", _PLAIN_REFERENCES)}, '^\s+', ''), '\s+$', '')) AS hash FROM pages")
def f1_html_to_text(spark, sf_dir):
    page = F.concat("html", F.lit("<p>" + " ".join(_REFERENCES) + " &amp;lt;p&amp;gt; <b>&"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_to_text(page)).alias("hash"))


@query("""WITH x AS (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part),
g AS (SELECT *, [substr(a, i, 2) FOR i IN range(1, length(a))] AS ga, [substr(b, i, 2) FOR i IN range(1, length(b))] AS gb FROM x),
s AS (SELECT *, list_sum([least(len(list_filter(ga, lambda y: y = z)), len(list_filter(gb, lambda y: y = z))) FOR z IN list_distinct(ga)]) AS shared FROM g)
SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE round(2.0 * shared / (len(ga) + len(gb)), 9) END AS dice FROM s""")
def f24_dice(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.dice(F.col("p_name"), F.col("p_type")), 9).alias("dice"))


_TERMS = ["go", "c++", "next.js", "python", "rust", "k8s"]
_RESUME = "['Five years of Go; C++, rust.', 'next.js and Python3', 'python, K8S and node.next.js', 'let us go', 'C+++ rusty'][p_partkey % 5 + 1]"
_AROUND = lambda t: "(^|[^\\w.+#])" + "".join("\\" + c if c in ".+" else c for c in t) + "($|[^\\w+#])"
_NAMED = {"k8s": "kubernetes"}


@query(f"""WITH x AS (SELECT p_partkey, lower({_RESUME}) AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(t, '{_AROUND(t)}') THEN '{_NAMED.get(t, t)}' END" for t in _TERMS)}], lambda s: s IS NOT NULL)), ',') AS skills FROM x""")
def f30_skills_in_text(spark, sf_dir):
    resume = F.get(F.array(*map(F.lit, ["Five years of Go; C++, rust.", "next.js and Python3", "python, K8S and node.next.js", "let us go", "C+++ rusty"])), (F.col("p_partkey") % 5).cast("int"))
    return _plain(table(spark, sf_dir, "part").select("p_partkey", S.in_text(resume, _TERMS).alias("skills")), "skills")


_WORDS = "CASE (p_partkey % 5) WHEN 0 THEN ['K8s', ' postgres ', 'Python'] WHEN 1 THEN ['golang', 'go', 'TS'] WHEN 2 THEN [lower(p_brand)] WHEN 3 THEN ['rails', 'JS', 'js'] ELSE [] END"
_CASES = lambda t, x: f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.items()) + f" ELSE {x} END"


@query(f"""WITH w AS (SELECT p_partkey, list_sort(list_distinct([{_CASES(SYNONYMS, 'lower(trim(s))')} FOR s IN {_WORDS}])) AS c FROM part)
SELECT p_partkey, array_to_string(c, ',') AS canonical, array_to_string([{_CASES(DISPLAY, 's')} FOR s IN c], ',') AS shown FROM w""")
def f18_normalize(spark, sf_dir):
    k = F.col("p_partkey") % 5
    lists = [["K8s", " postgres ", "Python"], ["golang", "go", "TS"], None, ["rails", "JS", "js"]]
    skills = F.when(k == 2, F.array(F.lower("p_brand")))
    for i, x in enumerate(lists):
        if x:
            skills = skills.when(k == i, F.array(*map(F.lit, x)))
    rows = table(spark, sf_dir, "part").withColumn("skills", skills)
    return _plain(rows.select("p_partkey", S.canonical(F.col("skills")).alias("canonical"), S.displayed(F.col("skills")).alias("shown")), "canonical", "shown")


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 12 WHEN '3' THEN 2080 END AS annual FROM orders")
def f20_annualise(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    period = F.when(first == "1", "year").when(first == "2", "month").when(first == "3", "hour").when(first == "4", "week")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.to_annual(F.floor("o_totalprice").cast("long"), period).alias("annual"))


@query("SELECT conv_id, turn, role, md5(text) AS hash FROM conversations")
def s7_flatten_thread(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    nested = turns.groupBy(F.col("conv_id").alias("thread_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("comments"))
    posts = threads.posts(nested.withColumn("thread_date", F.lit("2026-07-01")), "2026-07-01")
    return posts.select(F.col("thread_id").alias("conv_id"), "turn", "role", F.md5("text").alias("hash"))


_MONTHS = "(list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(regexp_extract(t, '\\(([A-Za-z]+)\\s+(\\d{4})\\)', 1))))"


@query(f"""WITH x AS (SELECT o_orderkey, 'Who is hiring? (' || strftime(o_orderdate, '%B %Y') || ')' AS t FROM orders)
SELECT o_orderkey, regexp_extract(t, '\\((\\w+)\\s+(\\d{{4}})\\)', 2) || '-' || lpad(CAST({_MONTHS} AS VARCHAR), 2, '0') || '-01' AS thread_date FROM x""")
def f2_thread_date(spark, sf_dir):
    title = F.concat(F.lit("Who is hiring? ("), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(")"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.thread_date(title).cast("string").alias("thread_date"))


@query("SELECT w.position, w.item_id, md5(text) AS hash FROM (VALUES (0, 7), (1, 3), (2, -1)) w(position, item_id) LEFT JOIN benchmark b ON b.item_id = w.item_id")
def j1_lookup_ordered(spark, sf_dir):
    return threads.lookup(table(spark, sf_dir, "benchmark"), [7, 3, -1], "item_id").select("position", "item_id", F.md5("text").alias("hash"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j3_semi(spark, sf_dir):
    return logs.covered(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9_anti(spark, sf_dir):
    return logs.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS only_a,
(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS only_b, CAST(0 AS BIGINT) AS repeated""")
def j8_set_equality(spark, sf_dir):
    return logs.same_ids(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w3_latest_per_key(spark, sf_dir):
    return threads.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("""WITH o AS (SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(user_id AS VARCHAR) AS thread_id, count(*) AS n FROM events GROUP BY 1, 2),
u AS (SELECT * FROM o WHERE user_id_is_even(thread_id)) SELECT 1""".replace("user_id_is_even(thread_id)", "CAST(thread_id AS BIGINT) % 2 = 0").replace("SELECT 1", "SELECT date, thread_id, CASE WHEN CAST(thread_id AS BIGINT) % 2 = 0 THEN n + 1000 ELSE n END AS n FROM o"))
def s18_history_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("user_id").cast("string").alias("thread_id")).agg(F.count(F.lit(1)).alias("n"))
    new = old.where(F.col("thread_id").cast("long") % 2 == 0).withColumn("n", F.col("n") + 1000)
    return logs.upserted(old, new)


@query("""WITH o AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS r FROM o) WHERE r = 1""")
def a32_latest_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("thread_id"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return logs.latest_totals(rows, ["n"])


@query("SELECT lang AS stratum, count(*) AS total, CAST(count_if(quality IS NOT NULL) AS BIGINT) AS done FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a25_progress(spark, sf_dir):
    sample = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("comment_id"), F.col("lang").alias("stratum"))
    return logs.progress(sample, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id")))


@query("""WITH b AS (SELECT doc_id, [x[1] FOR x IN [['p', contains(text, '|')::VARCHAR], ['n', contains(text, '!!')::VARCHAR]] IF x[2] = 'true'] AS m FROM documents)
SELECT k.bucket, k.shape, count(b.doc_id) AS n FROM (VALUES ('p', 'bars'), ('n', 'shouting'), ('z', 'never')) k(bucket, shape) LEFT JOIN b ON list_contains(b.m, k.bucket) GROUP BY 1, 2""")
def a24_tally(spark, sf_dir):
    text = F.col("text")
    marks = F.filter(F.array(F.when(text.contains("|"), F.lit("p")), F.when(text.contains("!!"), F.lit("n"))), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "documents").select("doc_id", marks.alias("buckets"))
    return logs.tally(rows, {"p": "bars", "n": "shouting", "z": "never"})


@query("SELECT item_id, substr(sha256(text), 1, 8) AS hash FROM benchmark")
def f31_sha_prefix(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.short_hash(F.col("text")).alias("hash"))


@query("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto', '%Y-%m-%d') AS run_date FROM events")
def f32_toronto_date(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.run_date(F.col("ts")).alias("run_date"))


_DIGITS = "regexp_replace(v, '\\D', '', 'g')"


@query(rf"""WITH x AS (SELECT conv_id, turn, lower(text) AS h, CASE turn % 3 WHEN 0 THEN substr(text, 3, 12) WHEN 1 THEN '12,000' ELSE 'no such thing' END AS v FROM conversations),
y AS (SELECT *, trim(lower(v)) AS n, regexp_replace(v, '\D', '', 'g') AS d, regexp_replace(h, '[,\s]', '', 'g') AS c FROM x)
SELECT conv_id, turn, n = '' OR contains(h, n) OR (length(d) >= 2 AND contains(c, d)) OR (length(d) >= 2 AND ends_with(d, '000') AND contains(c, regexp_replace(d, '000$', '') || 'k')) AS grounded FROM y""")
def f35_verify_claim(spark, sf_dir):
    k = F.col("turn") % 3
    value = F.when(k == 0, F.substring("text", 3, 12)).when(k == 1, "12,000").otherwise("no such thing")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.verify_claim(value, F.col("text"))["grounded"].alias("grounded"))


@query("""SELECT l_returnflag, CAST(sum(CAST(floor(l_quantity) AS BIGINT) * 10 - CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS input, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS output,
round((sum(CAST(floor(l_quantity) AS BIGINT) * 9) * 3.0 + sum(CAST(floor(l_quantity) AS BIGINT)) * 15.0 + sum(CAST(floor(l_quantity) AS BIGINT)) * 0.3) / 1000000, 9) AS cost_usd FROM lineitem GROUP BY 1""")
def a22_cost(spark, sf_dir):
    q = F.floor("l_quantity").cast("long")
    usage = table(spark, sf_dir, "lineitem").select("l_returnflag", (q * 10).alias("input_tokens"), q.alias("output_tokens"), q.alias("cache_read"), F.lit(0).cast("long").alias("cache_write"))
    spent = scoring.cost(scoring.tokens(usage, ["l_returnflag"]), {"input": 3.0, "output": 15.0, "cache_read": 0.3, "cache_write": 0.0})
    return spent.select("l_returnflag", "input", "output", F.round("cost_usd", 9).alias("cost_usd"))


@query()
def f17_extract(spark, sf_dir):
    """All fields of the rules' extraction over whole documents (Arrow-batched; no SQL form)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", extraction(F.col("text")).alias("e")).select("doc_id", "e.company", "e.location", "e.remote", "e.salary_min", "e.salary_max", F.array_join("e.skills", ",").alias("skills"), "e.seniority", "e.visa_sponsor", is_confident(F.col("e.confidence")).alias("confident"))


@query(f"""WITH {p_sql('%Y')}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_month, seniority ORDER BY salary_min DESC, comment_id) AS r FROM p),
g AS (SELECT thread_month, seniority, count(*) AS n, max(salary_min) AS top FROM r WHERE r <= 3 GROUP BY 1, 2)
SELECT thread_month, seniority, unnest(['money', 'number', 'skill']) AS kind, unnest(['$' || format('{{:,}}', top) || ' ', '3', 'python']) AS text, unnest([true, n >= 2, false]) AS grounded FROM g""")
def x5_claims(spark, sf_dir):
    """Claims of made-up summaries of a group's three best paid orders. The rank bounds the rows of a list."""
    by = Window.partitionBy("thread_month", "seniority").orderBy(F.desc("salary_min"), "comment_id")
    best = postings(spark, sf_dir, "yyyy").withColumn("r", F.row_number().over(by)).where("r <= 3")
    rows = best.groupBy("thread_month", "seniority").agg(F.collect_list(F.struct("salary_min", "salary_max", "skills")).alias("rows"), F.max("salary_min").alias("top"))
    said = rows.withColumn("summary", F.concat(F.lit("About 3 roles pay up to $"), F.format_number("top", 0), F.lit(" and ask for Python")))
    return C.claims(said, "summary", "rows").select("thread_month", "seniority", "kind", "text", "grounded")


@query(f"WITH {p_sql()} SELECT thread_month, count(*) AS n FROM p GROUP BY 1")
def a3_postings_per_month(spark, sf_dir):
    return serve.postings_per_month(postings(spark, sf_dir))


@query(f"WITH {p_sql('%Y')} SELECT comment_id FROM p WHERE thread_month = (SELECT max(thread_month) FROM p)")
def a2_latest_only(spark, sf_dir):
    return serve.in_latest_month(postings(spark, sf_dir, "yyyy")).select("comment_id")


@query(f"WITH {p_sql()} SELECT count(DISTINCT thread_month) AS threads FROM p")
def a7_distinct_threads(spark, sf_dir):
    from lodespar.plans.ingest import n_threads

    return n_threads(postings(spark, sf_dir).withColumnRenamed("thread_month", "thread_date"))


@query("SELECT o_orderpriority AS salary_period, count(*) AS n FROM orders WHERE NOT starts_with(o_orderpriority, '5') GROUP BY 1")
def a8_period_histogram(spark, sf_dir):
    from lodespar.plans.ingest import periods

    return periods(table(spark, sf_dir, "orders").select(F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("salary_period")))


@query("""WITH c AS (SELECT n_chars > 300 AS company, contains(text, '|') AS salary, n_chars > 50 AS skills, contains(text, '!!') AS remote, contains(text, '@') AS seniority FROM documents),
s AS (SELECT count(*) AS total, count_if(salary AND skills) AS a, count_if(company) AS b, count_if(salary) AS c, count_if(skills) AS d, count_if(remote) AS e, count_if(seniority) AS f FROM c)
SELECT unnest(['all of them', 'company', 'salary', 'skills', 'remote', 'seniority']) AS field, CAST(unnest([a, b, c, d, e, f]) AS BIGINT) AS hits, total FROM s""")
def a6_coverage(spark, sf_dir):
    from lodespar.plans.ingest import coverage

    text, n = F.col("text"), F.col("n_chars")
    confidence = F.struct((n > 300).alias("company"), text.contains("|").alias("salary"), (n > 50).alias("skills"), text.contains("!!").alias("remote"), text.contains("@").alias("seniority"))
    rows = table(spark, sf_dir, "documents").select(confidence.alias("confidence"))
    return coverage(rows.withColumn("confident", is_confident(F.col("confidence"))))


@query(f"""WITH {p_sql()}, x AS (SELECT coalesce(skills, []) AS skills FROM p), f AS (SELECT
  CASE WHEN len(skills) = 0 THEN 0.0 ELSE len(list_intersect(skills, {_MINE})) / len(skills) END AS p,
  CASE WHEN len(skills) = 0 THEN 0.0 ELSE len(list_intersect(skills, {_MINE})) / 5 END AS r,
  CASE WHEN len(skills) = 0 THEN 0.0 ELSE 2 * len(list_intersect(skills, {_MINE})) / (len(skills) + 5) END AS f1 FROM x)
SELECT count(*) AS n, round(avg(f1), 9) AS macro_f1, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall FROM f""")
def a14_macro_scores(spark, sf_dir):
    rows = postings(spark, sf_dir).withColumn("s", scoring.set_scores(F.coalesce("skills", F.array().cast("array<string>")), F.array(*map(F.lit, MINE)), canonical=False))
    return scoring.set_report(rows, "s").select("n", *[F.round(c, 9).alias(c) for c in ("macro_f1", "macro_precision", "macro_recall")])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions of themselves, with some fields left out, changed or made up."""
    k = F.col("comment_id") % 7
    rows = postings(spark, sf_dir).withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    known = lambda c, off: F.when(k != off, F.col(c))
    label = F.struct(known("company", 1).alias("company"), F.when(k != 2, F.lit("Berlin, Germany")).alias("location"), "remote", known("salary_min", 3).alias("salary_min"), known("salary_min", 3).alias("salary_max"), F.lit("year").alias("salary_period"), "seniority", "skills")
    guess = F.struct(known("company", 4).alias("company"), F.when(k == 5, "Berlin").when(k != 6, "Berlin, Germany").alias("location"), F.when(k == 1, F.lit(None)).otherwise(F.col("remote")).alias("remote"), known("salary_min", 5).alias("salary_min"), F.when(k == 4, F.col("salary_min") + 1).otherwise(F.col("salary_min")).alias("salary_max"), F.lit("year").alias("salary_period"), F.lit("1-URGENT").alias("seniority"), F.slice("skills", 1, 3).alias("skills"))
    return scoring.judged(rows.select("comment_id", label.alias("label"), guess.alias("prediction")))


_JUDGED = f"""x AS (SELECT comment_id % 7 AS k, * REPLACE (coalesce(skills, []) AS skills) FROM p), j AS (SELECT k, remote, seniority, skills,
  CASE WHEN k = 1 THEN 'hallucinated' WHEN k = 4 THEN 'missed' ELSE 'extracted' END AS company,
  CASE WHEN k = 2 THEN 'hallucinated' WHEN k = 6 THEN 'missed' WHEN k = 5 THEN 'wrong' ELSE 'extracted' END AS location,
  CASE WHEN k = 3 THEN 'hallucinated' WHEN k = 5 THEN 'missed' WHEN k = 4 THEN 'wrong' ELSE 'extracted' END AS salary,
  CASE WHEN len(skills) = 0 THEN 1.0 ELSE 2 * least(3, len(skills)) / (least(3, len(skills)) + len(skills)) END AS f1 FROM x)"""


@query(f"""WITH {p_sql()}, {_JUDGED} SELECT count(*) AS n, CAST(count_if(company = 'extracted') AS BIGINT) AS company_extracted, CAST(count_if(company = 'hallucinated') AS BIGINT) AS company_hallucinated,
CAST(count_if(salary = 'wrong') AS BIGINT) AS salary_wrong, CAST(count_if(location = 'missed') AS BIGINT) AS location_missed, round(avg(f1), 9) AS skills_f1,
round(avg(CASE WHEN k = 1 THEN 0.0 ELSE 1.0 END), 9) AS remote_accuracy, round(avg(CASE WHEN seniority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 9) AS seniority_accuracy,
round(count_if(salary = 'extracted') / count_if(salary IN ('extracted', 'wrong', 'hallucinated')), 9) AS salary_precision FROM j""")
def a16_scores_block(spark, sf_dir):
    wide = scoring.scores(_judged(spark, sf_dir))
    return wide.select("n", "company_extracted", "company_hallucinated", "salary_wrong", "location_missed", *[F.round(c, 9).alias(c) for c in ("skills_f1", "remote_accuracy", "seniority_accuracy", "salary_precision")])


@query(f"""WITH {p_sql()}, {_JUDGED} SELECT unnest(['company', 'salary', 'location', 'skills', 'remote', 'seniority']) AS field, CAST(unnest([count_if(company <> 'extracted'), count_if(salary <> 'extracted'),
count_if(location <> 'extracted'), count_if(f1 < 1), count_if(k = 1), count_if(seniority <> '1-URGENT')]) AS BIGINT) AS X FROM j""")
def a23_field_disagreements(spark, sf_dir):
    return scoring.disagreements(_judged(spark, sf_dir).withColumn("config", F.lit("X")), ["X"])


@query("""SELECT lang AS config, CAST(max(CASE WHEN f = 'mean' THEN v END) AS DOUBLE) AS mean, CAST(max(CASE WHEN f = 'n' THEN v END) AS DOUBLE) AS n FROM
(SELECT lang, 'mean' AS f, round(avg(n_chars), 6) AS v FROM documents GROUP BY 1 UNION ALL SELECT lang, 'n', count(*) FROM documents GROUP BY 1) GROUP BY 1""")
def j15_comparison(spark, sf_dir):
    long = s28_unpivot_scores(spark, sf_dir).withColumnRenamed("lang", "config").withColumn("field", F.regexp_replace("field", "_chars", ""))
    return scoring.comparison(long, fields=["mean", "n"])


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def j10_drafts_to_review(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return logs.drafts_to_review(table(spark, sf_dir, "documents").where("lang = 'en'"), labels, labels.where("quality = 0"), "doc_id").select("doc_id")


@query("""WITH u AS (SELECT l_returnflag AS config, CAST(floor(l_quantity) AS BIGINT) AS q, l_linenumber AS n FROM lineitem)
SELECT config, CAST(sum(CASE WHEN n <> 7 AND q >= 5 THEN q - 5 ELSE 0 END) AS BIGINT) AS input, CAST(sum(CASE WHEN n <> 7 AND q >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS output, count(*) AS responses, bool_or(n = 7 OR q < 5) AS usage_missing FROM u GROUP BY 1""")
def a21_token_sums(spark, sf_dir):
    q = F.floor("l_quantity").cast("long")
    usage = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("config"), F.when(F.col("l_linenumber") != 7, q).alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(5).cast("long").alias("cache_read"), F.lit(0).cast("long").alias("cache_write"))
    return scoring.tokens(usage, ["config"]).select("config", "input", "output", "responses", "usage_missing")


@query("SELECT l_returnflag, round(sum(l_extendedprice) / nullif(count_if(l_quantity > 25), 0), 6) AS per_post FROM lineitem GROUP BY 1")
def a36_cost_per_post(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("c"), F.count_if(F.col("l_quantity") > 25).alias("n"))
    return sums.select("l_returnflag", F.round(scoring.cost_per_post(F.col("c"), F.col("n")), 6).alias("per_post"))


@query("""SELECT conv_id, count(*) AS n_claims, CAST(count_if(NOT contains(text, 'a')) AS BIGINT) AS n_ungrounded, bool_and(contains(text, 'a')) AS grounded FROM conversations GROUP BY 1""")
def a35_all_grounded(spark, sf_dir):
    return C.summary_grounded(table(spark, sf_dir, "conversations").withColumn("grounded", F.col("text").contains("a")), ["conv_id"])


@query("""SELECT conv_id, turn, role, CAST(position - 1 AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position FROM conversations) WHERE position <= 2""")
def t7_first_posts(spark, sf_dir):
    nested = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("thread_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "conv_id"))).alias("comments"))
    posts = threads.posts(nested.withColumn("thread_date", F.lit("2026-07-01")))
    return threads.first_posts(posts, 2).select("conv_id", "turn", "role", "position")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'USD ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '-' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT) + 1)
WHEN o_orderstatus = 'F' THEN 'USD ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '+' ELSE 'USD up to ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT) + 1) END AS pay FROM orders""")
def f41_salary_text(spark, sf_dir):
    low = F.floor("o_totalprice").cast("long")
    first, last = F.when(F.col("o_orderstatus") == "F", low), F.when((F.col("o_orderstatus") != "F") | (F.col("o_totalprice") > 100000), low + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.salary_text(first, last, F.lit(None).cast("string")).alias("pay"))


@query("SELECT lang, CASE WHEN m <= 0.15 THEN 'usable' WHEN m <= 0.25 THEN 'weak' ELSE 'too small' END AS verdict FROM (SELECT lang, 10.0 / count(*) AS m FROM documents GROUP BY 1)")
def f45_verdict(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg((10.0 / F.count(F.lit(1))).alias("m")).select("lang", scoring.verdict(F.col("m")).alias("verdict"))


@query(f"""WITH t AS (SELECT p_partkey, ['K8s', 'cobol', ' Rust ', '', 'py'][p_partkey % 5 + 1] AS term FROM part)
SELECT p_partkey, term IN ('K8s', ' Rust ', 'py') AS known, CASE term WHEN 'K8s' THEN 'kubernetes' WHEN ' Rust ' THEN 'rust' WHEN 'py' THEN 'python' END AS canonical,
CASE term WHEN '' THEN 'empty term' WHEN 'cobol' THEN 'not in the vocabulary: only if the post clearly names it as a technology' END AS reason FROM t""")
def f36_canonical_skill(spark, sf_dir):
    terms = F.array(*map(F.lit, ["K8s", "cobol", " Rust ", "", "py"]))
    found = S.canonical_skill(F.get(terms, (F.col("p_partkey") % 5).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("s")).select("p_partkey", "s.*")


_ROLES = "['Open roles' || chr(10) || '1. Engineer for ' || p_name || ' in every one of its sizes' || chr(10) || '2) Designer of ' || p_type || ' and whatever goes with it', 'role 1: Analyst of ' || p_name || ' who reads a great many tables' || chr(10) || 'role 2: none', 'We make ' || p_name][p_partkey % 3 + 1]"


@query(f"""WITH x AS (SELECT p_partkey, p_partkey % 3 AS k, p_name, p_type, {_ROLES} AS t FROM part),
y AS (SELECT p_partkey, CASE WHEN k = 0 THEN ['Engineer for ' || p_name || ' in every one of its sizes', 'Designer of ' || p_type || ' and whatever goes with it'] ELSE [t] END AS c FROM x)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS n, md5(c[i]) AS hash FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM y)""")
def x3_split_roles(spark, sf_dir):
    """Role chunks: two roles, one that is too short to count, and no list."""
    k, name, kind = F.col("p_partkey") % 3, F.col("p_name"), F.col("p_type")
    two = F.concat(F.lit("Open roles\n1. Engineer for "), name, F.lit(" in every one of its sizes\n2) Designer of "), kind, F.lit(" and whatever goes with it"))
    one = F.concat(F.lit("role 1: Analyst of "), name, F.lit(" who reads a great many tables\nrole 2: none"))
    text = F.when(k == 0, two).when(k == 1, one).otherwise(F.concat(F.lit("We make "), name))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.roles(text)).alias("n", "chunk")).select("p_partkey", "n", F.md5("chunk").alias("hash"))


@query("""WITH x AS (SELECT o_orderkey, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS a, format('{:,}', CAST(round_even(o_totalprice * 2, 0) AS BIGINT)) AS b FROM orders),
y AS (SELECT *, 'We pay $' || a || ' or more, up to $' || b AS t FROM x) SELECT o_orderkey, unnest(['$' || a || ' ', '$' || b]) AS match, t AS context FROM y""")
def x4_salary_candidates(spark, sf_dir):
    """Salary-like strings of orders written as prose, with their surroundings."""
    said = F.concat(F.lit("We pay $"), F.format_number("o_totalprice", 0), F.lit(" or more, up to $"), F.format_number(F.col("o_totalprice") * 2, 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(C.candidates(said)).alias("c")).select("o_orderkey", "c.*")


_PAID = "CAST(floor(o_totalprice) AS BIGINT)"


@query(f"""WITH x AS (SELECT o_orderkey, o_orderkey % 7 AS k, {_PAID} AS a FROM orders),
z AS (SELECT * REPLACE (CASE WHEN k = 0 AND a < 10000 THEN a + 5000 ELSE a END AS a), k = 0 AND a < 10000 AS upper FROM x),
y AS (SELECT *, k = 4 OR a >= 10000 AS ok FROM z)
SELECT o_orderkey, CASE WHEN k = 5 OR NOT ok THEN NULL WHEN k = 1 THEN a // 1000 * 1000 WHEN k = 2 THEN NULL WHEN k = 4 THEN a % 200 + 10 ELSE a END AS low,
CASE WHEN k = 5 OR NOT ok THEN NULL WHEN k = 0 AND NOT upper THEN a + 5000 WHEN k = 1 THEN a // 1000 * 1000 + 9000 WHEN k = 3 THEN NULL WHEN k = 4 THEN a % 200 + 10 ELSE a END AS high,
CASE WHEN k = 5 OR NOT ok THEN NULL WHEN k = 1 THEN 'EUR' WHEN k = 6 THEN 'GBP' ELSE 'USD' END AS currency, CASE WHEN k = 5 OR NOT ok THEN NULL WHEN k = 4 THEN 'hour' ELSE 'year' END AS period FROM y""")
def f5_salary(spark, sf_dir):
    """Orders' prices as pay in prose: two forms of ranges, bounds, a rate an hour, a bonus, a figure with separators. Of a range
    whose low end is too low for a year's pay, the high end may still be a figure."""
    k, a = F.col("o_orderkey") % 7, F.floor("o_totalprice").cast("long")
    t, text = lambda c: c.cast("string"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    thousands = F.floor(a / 1000).cast("long")
    said = F.when(k == 0, text("Base $", t(a), "-$", t(a + 5000), " and stock")).when(k == 1, text("Pays ", t(thousands), " - ", t(thousands + 9), "k EUR"))
    said = said.when(k == 2, text("up to $", t(a))).when(k == 3, text("starting at $", t(a), ", more later")).when(k == 4, text("$", t(a % 200 + 10), "/hour"))
    said = said.when(k == 5, text("Signing bonus: $", t(a))).otherwise(text("We pay £", F.format_number(a, 0), " flat"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", extraction(said).alias("e"))
    return found.select("o_orderkey", F.col("e.salary_min").alias("low"), F.col("e.salary_max").alias("high"), F.col("e.salary_currency").alias("currency"), F.col("e.salary_period").alias("period"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_partkey & 1 > 0 THEN 'node.js' END, CASE WHEN p_partkey & 2 > 0 THEN 'react native' END, CASE WHEN p_partkey & 4 > 0 THEN 'go' END,
CASE WHEN p_partkey & 8 > 0 THEN 'c++' END, CASE WHEN p_partkey & 16 > 0 THEN 'react' END, CASE WHEN p_partkey & 128 > 0 THEN 'rails' END, CASE WHEN p_partkey & 256 > 0 THEN 'ruby' END], lambda x: x IS NOT NULL)), ',') AS skills FROM part""")
def f8_skills(spark, sf_dir):
    """Terms by the bits of the key, among text that only looks like them."""
    parts = ["NodeJS", "React Native", "Go", "C++", "React!", "we go on", "https://rust.example", "Ruby on Rails", "Ruby scripts", "R&D"]
    said = F.concat_ws("; ", *[F.when(F.col("p_partkey").bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(parts)])
    return _plain(table(spark, sf_dir, "part").select("p_partkey", extraction(said)["skills"].alias("skills")), "skills")


_HEADED = {
    "title": ["Senior Engineer", "Staff Developer", "Analyst", "Junior Designer & Intern", "Senior Engineer + Engineer"],
    "place": ["Berlin", "Remote (US)", "Toronto (hybrid)", "Oslo, NO / Remote"],
    "visa": ["visa support available", "no visa", "we travel a lot"],
}
_PICKED = lambda x, k, values: f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][{k} % {len(values)} + 1] AS {x}"


@query(f"""SELECT c_custkey, c_name AS company, {_PICKED('location', 'c_custkey', ['Berlin', 'US', 'Toronto', 'Oslo, NO'])}, {_PICKED('remote', 'c_custkey', [None, 'remote', 'hybrid', 'remote'])},
{_PICKED('seniority', 'c_custkey', ['senior', 'staff+', None, 'junior', None])}, {_PICKED('visa', 'c_custkey', [True, False, None])}, {_PICKED('title', 'c_custkey', _HEADED['title'])} FROM customer""")
def f17_header(spark, sf_dir):
    """Customers as piped headers: company, title, place with its arrangement; a line on visas below."""
    part = lambda name: F.get(F.array(*map(F.lit, _HEADED[name])), (F.col("c_custkey") % len(_HEADED[name])).cast("int"))
    said = F.concat(F.concat_ws(" | ", "c_name", part("title"), part("place"), F.lit("Full-time")), F.lit("\n\n"), part("visa"))
    found = table(spark, sf_dir, "customer").select("c_custkey", extraction(said).alias("e"))
    return found.select("c_custkey", "e.company", "e.location", "e.remote", "e.seniority", F.col("e.visa_sponsor").alias("visa"), F.get("e.role_titles", F.lit(0)).alias("title"))


@query("""WITH x AS (SELECT conv_id, turn, text, array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D\\xA0]+')[1:3], ' ') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN w = '' OR turn % 3 = 1 THEN NULL WHEN turn % 3 = 0 THEN w ELSE lower(w) END AS span FROM x""".replace("\\\\", "\\"))
def f37_source_span(spark, sf_dir):
    """The first words of a turn as they are and in small letters, and words that are not there."""
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D\\xA0]+"), 0), 1, 3), " ")
    k = F.col("turn") % 3
    value = F.when(k == 0, F.concat(F.lit(" "), words)).when(k == 1, "no such words").otherwise(F.lower(words))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.source_span(value, F.col("text")).alias("span"))


@query(f"""WITH {p_sql()} SELECT comment_id, array_to_string(list_filter([CASE WHEN comment_id % 2 = 0 THEN 'company' END, CASE WHEN comment_id % 3 = 0 AND NOT ends_with(salary_min::VARCHAR, '000') THEN 'salary_min' END,
CASE WHEN salary_max IS NOT NULL AND comment_id % 5 = 0 THEN 'salary_max' END], lambda x: x IS NOT NULL), ',') AS fields FROM p WHERE salary_min >= 10000""")
def f38_ungrounded(spark, sf_dir):
    """Orders as predictions of a sentence about them: names and figures that the sentence does not have."""
    rows, k = postings(spark, sf_dir).where("salary_min >= 10000").withColumn("company", F.lit("Quillon")), F.col("comment_id")
    low = F.when(k % 3 == 0, F.concat(F.floor(F.col("salary_min") / 1000).cast("string"), F.lit("k"))).otherwise(F.format_number("salary_min", 0))
    high = F.when(k % 5 == 0, "more").otherwise(F.coalesce(F.format_number("salary_max", 0), F.lit("none")))
    said = F.concat(F.when(k % 2 == 0, "someone").otherwise("QUILLON"), F.lit(" pays $"), low, F.lit(" to $"), high)
    return _plain(rows.select("comment_id", C.ungrounded(F.struct("company", "location", "salary_min", "salary_max"), said).alias("fields")), "fields")


@query("""SELECT l_returnflag AS config, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS steps, CAST(sum(l_linenumber % 3) AS BIGINT) AS model_calls, CAST(sum(l_linenumber % 4) AS BIGINT) AS tool_calls,
CAST(sum(l_linenumber % 2) AS BIGINT) AS verify_failures, CAST(count_if(l_linenumber = 7) AS BIGINT) AS errors FROM lineitem GROUP BY 1""")
def a31_trajectories(spark, sf_dir):
    i = F.col("l_linenumber").cast("int")
    trace = F.struct(i.alias("steps"), (i % 3).alias("model_calls"), F.array_repeat(F.lit("verify_claim"), i % 4).alias("tool_calls"), (i % 2).alias("verify_failures"), F.when(i == 7, "timeout").alias("error"))
    return scoring.trajectories(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("config"), trace.alias("trace")), ["config"])


@query("""SELECT CAST(o_orderdate AS VARCHAR)[1:10] AS ts, o_orderpriority AS config, 'dev' AS split, o_custkey AS n, round(o_totalprice / 612347, 4) AS company_precision, NULL::DOUBLE AS salary_precision,
round(o_totalprice / 712349, 4) AS location_precision, round(o_totalprice / 812347, 4) AS skills_f1, o_totalprice AS p50_ms, o_totalprice * 2 AS p95_ms FROM orders""")
def f44_frontier(spark, sf_dir):
    pay = F.col("o_totalprice")
    scores = F.struct((pay / 612347).alias("company_precision"), F.lit(None).cast("double").alias("salary_precision"), (pay / 712349).alias("location_precision"), (pay / 812347).alias("skills_f1"))
    return scoring.frontier(table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.col("o_orderpriority").alias("config"), F.lit("dev").alias("split"), F.col("o_custkey").alias("n"), scores.alias("scores"), pay.alias("p50_ms"), (pay * 2).alias("p95_ms")))


@query("SELECT o_orderkey, o_totalprice / 1000000 AS share, o_custkey AS n, o_totalprice / 2000000 AS low, o_totalprice / 900000 AS high FROM orders WHERE o_totalprice < 900000")
def f42_checked(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_totalprice < 900000")
    pay = F.col("o_totalprice")
    rows = rows.select("o_orderkey", (pay / 1000000).alias("share"), F.col("o_custkey").alias("n"), (pay / 2000000).alias("low"), (pay / 900000).alias("high"))
    return scoring.checked(rows, ["share"], ["n"], [("low", "high")])


@query("SELECT doc_id AS comment_id, quality FROM labels WHERE doc_id % 3 = 1")
def s15_labelled_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id"), "quality", F.lit(True).alias("done"))
    splits = labels.select("comment_id", F.when(F.col("comment_id") % 3 == 1, "held-out").otherwise("tune").alias("split"))
    return logs.labelled(labels, splits, "held-out").select("comment_id", "quality")


@query("""WITH d AS (SELECT doc_id, ["remote", "salary", "remote"] AS u FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, ["skills"] FROM documents WHERE n_chars <= 500)
SELECT field, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(u)) AS field FROM d) GROUP BY 1""".replace('"', "'"))
def a25_uncertain_fields(spark, sf_dir):
    marks = F.when(F.col("n_chars") > 500, F.array(*map(F.lit, ["remote", "salary", "remote"]))).otherwise(F.array(F.lit("skills")))
    return logs.uncertain_fields(table(spark, sf_dir, "documents").select("doc_id", marks.alias("uncertain")))


@query("SELECT doc_id AS comment_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j11_to_recheck(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("uncertain"))
    return logs.to_recheck(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("comment_id"), "lang"), labels)


@query("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto', '%Y-%m-%d, %H:%M:%S') AS at FROM events")
def f41_toronto_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.local_time(F.col("ts")).alias("at"))


DRAWN, BOOSTED, GOAL = 60, "pipe", 25


@query(f"""WITH d AS (SELECT doc_id, {_STRATUM} AS stratum FROM documents), s AS (SELECT stratum, count(*) AS c FROM d GROUP BY 1),
f AS (SELECT *, sum(c) OVER () AS total, greatest(2, {DRAWN} // (3 * count(*) OVER ())) AS floor, list_contains(string_split(stratum, '/'), '{BOOSTED}') AS held FROM s),
a AS (SELECT *, least(c, greatest(floor, CAST(round_even({DRAWN} * c / total, 0) AS BIGINT))) AS t0 FROM f),
b AS (SELECT *, CASE WHEN held THEN least(greatest({GOAL} - sum(t0) OVER (PARTITION BY held) - coalesce(sum(c - t0) OVER (PARTITION BY held ORDER BY c DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), c - t0) ELSE 0 END + t0 AS t1 FROM a),
g AS (SELECT *, {DRAWN} - sum(t1) OVER () AS short, c - t1 AS room, CASE WHEN held THEN 0 ELSE greatest(t1 - floor, 0) END AS spare FROM b),
h AS (SELECT *, t1 + least(greatest(short - coalesce(sum(room) OVER (ORDER BY c DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), room)
  - least(greatest(-short - coalesce(sum(spare) OVER (ORDER BY c, stratum DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), spare) AS wanted FROM g),
r AS (SELECT d.*, row_number() OVER (PARTITION BY stratum ORDER BY md5('20260801:' || doc_id), doc_id) AS r FROM d)
SELECT doc_id, stratum FROM r JOIN h USING (stratum) WHERE r <= wanted""")
def a29_draw(spark, sf_dir):
    """A stratified sample: proportional, a floor for each stratum, piped posts brought up to a number."""
    return sampling.draw(_strata(spark, sf_dir), DRAWN, "doc_id", oversample={BOOSTED: GOAL}).select("doc_id", "stratum")


# Sources and sinks: what is written to the shared folder and read again.


def _new_folder(spark: SparkSession, label: str) -> str:
    return new_path(spark, f"query-{label}")


def _threads_of(spark: SparkSession, sf_dir: str, label: str) -> str:
    """Conversations landed as raw threads: a JSON file each, turns as comments, every fifth comment a reply."""
    turns = table(spark, sf_dir, "conversations")
    comment = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("objectID"), F.col("role").alias("author"), F.concat(F.lit("<p>"), "text").alias("comment_text"),
        F.when(F.col("turn") % 5 == 4, F.lit(-1)).otherwise(F.col("conv_id")).cast("long").alias("parent_id"), F.col("conv_id").cast("long").alias("story_id"), F.lit("2026-07-01").alias("created_at"),
    )
    month = F.get(F.array(*[F.lit(m) for m in ("May 2026", "June 2026", "July 2026")]), (F.col("conv_id") % 3).cast("int"))
    title = F.when(F.col("conv_id") % 4 == 0, "Freelancers?").otherwise(F.concat(F.lit("Who is hiring? ("), month, F.lit(")")))
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", comment.alias("c")))).alias("c"))
    raw = nested.select(F.col("conv_id").cast("string").alias("thread_id"), title.alias("title"), F.lit("2026-07-01").alias("created_at"), F.lit(None).cast("string").alias("thread_date"), F.col("c.c").alias("comments"))
    folder = _new_folder(spark, label)
    raw.write.option("maxRecordsPerFile", 1).json(folder)  # a file holds one thread
    return folder


_THREADS = "h AS (SELECT conv_id, turn, role, text, conv_id % 4 <> 0 AS hiring, ['2026-05-01', '2026-06-01', '2026-07-01'][conv_id % 3 + 1] AS date FROM conversations)"


@query(f"WITH {_THREADS} SELECT CAST(conv_id AS VARCHAR) AS thread_id, date AS thread_date, count(*) AS n FROM h WHERE hiring AND turn % 5 <> 4 GROUP BY 1, 2")
def s5_landed_threads(spark, sf_dir):
    """Threads scanned from JSON, hiring ones by title, dated by it, their top-level comments counted."""
    found = threads.hiring(threads.dated(threads.threads(spark, _threads_of(spark, sf_dir, "threads"))))
    return threads.top_level(threads.posts(found)).groupBy("thread_id", "thread_date").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_THREADS} SELECT DISTINCT CAST(conv_id AS VARCHAR) AS thread_id FROM h WHERE hiring AND date = (SELECT max(date) FROM h WHERE hiring)")
def s6_latest_threads(spark, sf_dir):
    found = threads.hiring(threads.dated(threads.threads(spark, _threads_of(spark, sf_dir, "threads"))))
    return threads.latest(found).select("thread_id")


@query(f"WITH {_THREADS} SELECT conv_id || '-' || turn AS id, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS hash FROM h WHERE hiring AND date = '2026-06-01'")
def p8_posts_of_month(spark, sf_dir):
    found = threads.hiring(threads.dated(threads.threads(spark, _threads_of(spark, sf_dir, "threads"))))
    return threads.posts(found, "2026-06-01").select(F.col("objectID").alias("id"), F.md5(T.html_to_text(F.col("comment_text"))).alias("hash"))


@query("SELECT o_orderkey AS comment_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Kubernetes,Python' ELSE 'Go' END AS skills, strftime(o_orderdate, '%Y') || '-01' AS thread_month FROM orders WHERE strftime(o_orderdate, '%Y') = '1996'")
def s9_postings_table(spark, sf_dir):
    """Orders written as a partitioned table of postings, one month read back by SQL with a parameter."""
    orders = table(spark, sf_dir, "orders")
    kinds = {f.name: f.dataType for f in parsed(POSTING)}
    known = {"comment_id": F.col("o_orderkey"), "thread_date": F.to_date(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-01-01"))), "extracted_by": F.lit("rules"), "skills": F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("python"), F.lit("k8s"))).otherwise(F.array(F.lit("golang"))), "role_titles": F.array().cast("array<string>")}
    rows = orders.select(*[known.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items() if c != "thread_month"])
    folder = _new_folder(spark, "postings")
    stored.write(rows, folder)
    stored.read(spark, folder, "stored_postings")
    return stored.query(spark, "SELECT comment_id, array_join(skills, ',') AS skills, thread_month FROM stored_postings WHERE thread_month = :month", month="1996-01")


@query("SELECT CAST(doc_id AS VARCHAR) AS \"objectID\" FROM documents WHERE NOT (n_chars > 300 AND contains(text, '|'))")
def s10_unsure_ids(spark, sf_dir):
    folder = _new_folder(spark, "unsure")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("objectID"), is_confident(F.struct(F.col("text").contains("|").alias("salary"), (F.col("n_chars") > 300).alias("skills"))).alias("confident"))
    stored.write_unsure(rows, folder)
    return spark.read.schema("objectID string").json(folder)


@query("SELECT CAST(doc_id AS VARCHAR) AS comment_id, quality = 1 AS done FROM labels WHERE quality = 1")
def s16_label_store(spark, sf_dir):
    """Labels written sorted by id and read again, the finished ones."""
    folder = _new_folder(spark, "labels")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("comment_id"), (F.col("quality") == 1).alias("done"))
    logs.save_labels(rows, folder)
    return logs.done(logs.checked_labels(logs.labels(spark, folder))).select("comment_id", "done")


@query("SELECT lang AS config, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 1")
def s17_run_log(spark, sf_dir):
    """Runs appended to a log twice and read whole; a log that is not there is none."""
    folder, docs = _new_folder(spark, "runs"), table(spark, sf_dir, "documents")
    if logs.runs(spark, folder) is not None:
        raise ValueError("a new log has no runs")
    logs.append(docs.groupBy(F.col("lang").alias("config")).agg(F.count(F.lit(1)).alias("n")), folder)
    logs.append(docs.where("source is not null").groupBy(F.col("source").alias("config")).agg(F.count(F.lit(1)).alias("n")), folder)
    return logs.runs(spark, folder).select("config", "n")


@query("""WITH h AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CAST(o_orderkey AS VARCHAR) AS thread_id, o_custkey AS total_posts, o_custkey - o_orderkey % 13 + 2 AS company FROM orders)
SELECT date, thread_id, total_posts FROM h WHERE date <> 'soon' AND company BETWEEN 0 AND total_posts""")
def s27_valid_history(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), k.cast("string").alias("thread_id"), F.col("o_custkey").alias("total_posts"), (F.col("o_custkey") - k % 13 + 2).alias("company"))
    return logs.valid_history(rows).select("date", "thread_id", "total_posts")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'go,kubernetes' ELSE '' END AS skills, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 4 WHEN 1 THEN 12 WHEN 2 THEN 2080 ELSE 1 END AS salary_min,
['year', 'month', 'hour', NULL][o_orderkey % 4 + 1] AS salary_period FROM orders""")
def f21_normalized(spark, sf_dir):
    k, pay = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    period = F.get(F.array(F.lit("year"), F.lit("month"), F.lit("hour"), F.lit(None)), (k % 4).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 2 == 0, F.array(F.lit(" K8s"), F.lit("golang"), F.lit("Go"))).alias("skills"), pay.alias("salary_min"), pay.alias("salary_max"), period.alias("salary_period"))
    return _plain(normalized(rows).select("o_orderkey", "skills", "salary_min", "salary_period"), "skills")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 5 AS t, c_custkey % 6 AS k FROM customer)
SELECT count(*) AS n, CAST(count_if(k <> 1) AS BIGINT) AS company_extracted, CAST(count_if(k = 1) AS BIGINT) AS company_hallucinated, CAST(count_if(k = 2) AS BIGINT) AS location_wrong, CAST(count_if(k <> 2) AS BIGINT) AS location_extracted,
CAST(count(*) AS BIGINT) AS salary_abstained, 1.0 AS remote_accuracy, 1.0 AS skills_f1 FROM c""")
def x1_rules_judged(spark, sf_dir):
    """The rules as a predictor of customers' headers, judged against labels: some without a company, some elsewhere."""
    from lodespar.plans.evaluate import normalised, with_labels
    from lodespar.plans.rungs import predictor

    part = lambda name: F.get(F.array(*map(F.lit, _HEADED[name])), (F.col("c_custkey") % len(_HEADED[name])).cast("int"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int"))
    k, nothing = F.col("c_custkey") % 6, F.lit(None)
    rows = table(spark, sf_dir, "customer")
    posts = rows.select(F.col("c_custkey").cast("string").alias("objectID"), F.concat_ws(" | ", "c_name", part("title"), part("place"), F.lit("Full-time")).alias("text"))
    labels = rows.select(
        F.col("c_custkey").cast("string").alias("comment_id"), F.when(k != 1, F.col("c_name")).alias("company"), F.when(k == 2, "Lima").otherwise(pick(["Berlin", "US", "Toronto", "Oslo, NO"])).alias("location"),
        pick([None, "remote", "hybrid", "remote"]).alias("remote"), nothing.cast("long").alias("salary_min"), nothing.cast("long").alias("salary_max"), nothing.cast("string").alias("salary_period"),
        pick(["senior", "staff+", None, "junior", None]).alias("seniority"), F.array().cast("array<string>").alias("skills"),
    )
    pairs, _ = with_labels(posts, labels)
    wide = scoring.scores(scoring.judged(normalised(predictor("rules")(pairs))))
    return wide.select("n", "company_extracted", "company_hallucinated", "location_wrong", "location_extracted", "salary_abstained", "remote_accuracy", "skills_f1")


# Model-backed rungs, with a client that answers by rule.


def _says_quillon(prompt, schema) -> dict:
    """A model that claims one company of every post, and gives it up when told that the post does not name it."""
    return {"usage": {"input_tokens": 100, "output_tokens": 10}, **({} if "not in the post" in prompt else {"company": "Quillon"})}


def _asks_first(messages, tools, system) -> dict:
    """A model that has its claim verified, and answers by what the tool says."""
    last = messages[-1]
    if last["role"] != "tool":
        return {"usage": {"input_tokens": 50, "output_tokens": 5}, "tool_calls": [{"name": "verify_claim", "args": {"value": "Quillon"}}, {"name": "canonical_skill", "args": {"term": "K8s"}}]}
    grounded = any('"grounded": true' in m["content"] for m in messages if m["role"] == "tool")
    return {"usage": {"input_tokens": 70, "output_tokens": 7}, "output": {"company": "Quillon" if grounded else None, "skills": ["kubernetes"]}}


def _copies_quillon(prompt, missing) -> dict:
    return {"company": " Quillon ", "usage": {"input_tokens": 30, "output_tokens": 3}}


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as prose: a third names the company, a third another one that the rules find, a third none."""
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "Some of us at QUILLON make maps, in Oslo or elsewhere.").when(k == 1, F.concat("c_name", F.lit(" | Engineer | Berlin"))).otherwise("We make maps, wherever we are.")
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Quillon' END AS company, c_custkey % 3 <> 0 AS revised, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS failures,
CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS calls, CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 200 END AS tokens FROM customer""")
def x11_workflow(spark, sf_dir):
    from lodespar.plans.rungs import predictor

    got = predictor("W", _says_quillon)(_posts(spark, sf_dir))
    return got.select("c_custkey", "prediction.company", "trace.revised", F.col("trace.verify_failures").alias("failures"), F.col("trace.model_calls").alias("calls"), F.col("trace.input_tokens").alias("tokens"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Quillon' END AS company, 'kubernetes' AS skills, 'verify_claim,canonical_skill' AS tools, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS failures,
CAST(4 AS INTEGER) AS steps, 12 AS tokens FROM customer""")
def x10_agent(spark, sf_dir):
    from lodespar.plans.rungs import predictor

    got = predictor("agent:C", _asks_first)(_posts(spark, sf_dir))
    return got.select("c_custkey", "prediction.company", F.array_join("prediction.skills", ",").alias("skills"), F.array_join("trace.tool_calls", ",").alias("tools"), F.col("trace.verify_failures").alias("failures"), "trace.steps", F.col("trace.output_tokens").alias("tokens"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Quillon' WHEN 1 THEN c_name END AS company, CASE WHEN c_custkey % 3 = 1 THEN 'Berlin' END AS location,
CAST(CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS failures, CAST(CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE 1 END AS INTEGER) AS calls FROM customer""")
def x13_fallback(spark, sf_dir):
    """The rules, and a model only for posts without company or place, believed only if the post has its words."""
    from lodespar.plans.rungs import predictor

    got = predictor("F", _copies_quillon)(_posts(spark, sf_dir))
    return got.select("c_custkey", "prediction.company", "prediction.location", F.col("trace.verify_failures").alias("failures"), F.col("trace.model_calls").alias("calls"))
