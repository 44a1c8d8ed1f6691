import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies as A, classify as C, dashboard as B, evaluation as E, facts as X, mentions as N, rankings as R, rollups as U, summaries as Q
from tidemark.operators.automaton import mentions_by_automaton
from tidemark.plans import gold
from tidemark.schemas import SENTIMENTS, empty, schema
from tidemark.sources import files

DICT = [
    N.Entity("gold", (N.Alias("Gold Stone"), N.Alias("Gold", "word_boundary"), N.Alias("Stone", "word_boundary", 0.7), N.Alias("six arms", "substring", 0.85), N.Alias("the tallest", "requires_context", 0.6))),
    N.Entity("king", (N.Alias("King", "word_boundary", 0.95),)),
    N.Entity("mia", (N.Alias("Mia", "word_boundary", 0.9), N.Alias("Fern", "substring", 0.95))),
    N.Entity("get", (N.Alias("get", "requires_context", 0.7),)),
]


def found(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [[(m.character_id, m.alias_matched, m.weight) for m in r[0]] for r in df.select(N.mentions_of(F.col("t"), DICT)).collect()]


def test_mentions(spark):
    got = found(spark, ["BeforeGold Stoneafter", "Goldie", "so Gold!", "asking the tallest team", "the tallest", "together with Mia", "Mia and Fern", "Stone has six arms", "", None])
    assert got == [[("gold", "Gold Stone", 1.0)], [], [("gold", "Gold", 1.0)], [("gold", "the tallest", 0.6)], [], [("mia", "Mia", 0.9), ("get", "get", 0.7)], [("mia", "Mia", 0.9)], [("gold", "Stone", 0.7)], [], []]


def test_mentions_against_plain_rules(spark):
    rng = random.Random(5)
    parts = [a.string for e in DICT for a in e.aliases] + [" ", " ", "é", "_", "x", ".", "GOLD", "king", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(2_000)]
    want = [N.reference_mentions(t, DICT) for t in texts]
    assert found(spark, texts) == want
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted(map(tuple, mentions_by_automaton(df, F.col("t"), files.alias_table(spark, DICT), ["i"]).collect()))
    assert got == sorted((i, *m) for i, ms in enumerate(want) for m in ms)
    with pytest.raises(ValueError):
        N.Alias("x", "other")


def post(i, title, body="", at=datetime(2024, 1, 9), score=1):
    return {"id": i, "subreddit": "s", "created_at": at, "created_utc": 0, "title": title, "title_clean": title, "selftext": body, "selftext_clean": body, "score": score, "num_comments": 0, "permalink": f"/r/{i}/", "is_deleted": False, "spoiler": False}


def rows(spark, name, items):
    names = schema(name).names
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in items], schema(name))


def label(i, sentiment, confidence=0.9, intensity="high"):
    return {"id": i, "sentiment": sentiment, "confidence": confidence, "intensity": intensity, "target": "about_arc"}


def test_fan_out_and_upsert(spark):
    posts = rows(spark, "silver_posts", [post("p1", "Gold vs King was peak"), post("p2", "nothing"), post("p3", "Gold")])
    labels = rows(spark, "classifications", [label("p1", "mixed"), label("p2", "positive")])
    f = X.post_facts(posts, labels, DICT)
    assert sorted((r.post_id, r.character_id, r.sentiment, r.sentiment_score) for r in f.collect()) == [("p1", "gold", "mixed", 0.0), ("p1", "king", "mixed", 0.0)]
    again = X.post_facts(rows(spark, "silver_posts", [post("p1", "Stone vs King")]), rows(spark, "classifications", [label("p1", "negative")]), DICT)
    merged = X.upsert(f, again, X.POST_KEY)  # an older alias stays
    assert sorted((r.alias_matched, r.sentiment) for r in merged.collect()) == [("Gold", "mixed"), ("King", "negative"), ("Stone", "negative")]
    assert sorted(r.alias_matched for r in X.upsert(f, again, X.POST_KEY, replace=["post_id"]).collect()) == ["King", "Stone"]
    comments = rows(spark, "silver_comments", [{"id": "c", "body": "King", "link_id": "t3_p1", "subreddit": "s"}])
    assert X.comment_facts(comments, rows(spark, "classifications", [label("c", "positive")]), DICT).first().post_id == "p1"


def fact(entity, at, sentiment, weight=1.0, confidence=1.0, kind="post"):
    return (entity, sentiment, {"positive": 1.0, "negative": -1.0}.get(sentiment, 0.0), confidence, "low", weight, at, kind)


KIND = "character_id string, sentiment string, sentiment_score double, sentiment_confidence double, intensity string, mention_weight double, created_at timestamp, kind string"


def test_weekly_rollup_and_new_year(spark):
    at = datetime(2024, 1, 8)
    f = [fact("a", at, "positive", 0.5), fact("a", at + timedelta(2), "negative"), fact("b", at, "positive", 0.0), fact("c", datetime(2020, 12, 31), "neutral"), fact("c", datetime(2021, 1, 1), "neutral", kind="comment")]
    got = {(r.character_id, r.year, r.week): r for r in U.weekly(spark.createDataFrame(f, KIND)).collect()}
    a = got["a", 2024, 2]
    assert (a.mention_count, a.polarisation_index, round(a.mean_sentiment_score, 6), a.weighted_sentiment) == (2, 1.0, round(-0.5 / 1.5, 6), 1.5)
    assert got["b", 2024, 2].mean_sentiment_score == 0.0
    assert {k for k in got if k[0] == "c"} == {("c", 2020, 53), ("c", 2021, 53)} and math.isnan(got["c", 2020, 53].polarisation_index)
    ranks = {r.character_id: (r.polarisation_rank, r.most_mentioned_rank) for r in R.ranked(U.all_time(U.weekly(spark.createDataFrame(f, KIND)))).collect()}
    assert ranks == {"a": (1, 1), "b": (2, 3), "c": (3, 2)}


def week_rows(spark, scores, counts=None, start=datetime(2024, 1, 1)):
    items = [{"character_id": "x", "year": 2024, "week": i, "week_start": start + timedelta(7 * i), "mention_count": (counts or {}).get(i, 100), "mean_sentiment_score": s} for i, s in enumerate(scores)]
    return rows(spark, "agg_char_week", items)


def test_anomalies(spark):
    base = [0.30, 0.35, 0.40] * 4
    got = A.anomalies(week_rows(spark, [*base, -0.5])).collect()
    assert len(got) == 1 and got[0].z_score < -2
    assert A.anomalies(week_rows(spark, [*base, -0.5], {12: 3})).count() == 0  # too few mentions
    assert A.anomalies(week_rows(spark, [*base[:9], -0.5])).count() == 0  # too short a baseline
    assert A.anomalies(week_rows(spark, [0.3] * 12 + [-0.5])).count() == 0  # a constant one


def test_nearest_event(spark):
    line = lambda *days: spark.createDataFrame([(f"e{k}", "t", d, k) for k, d in enumerate(days)], "event_id string, title string, event_date timestamp, pos int")
    week = spark.createDataFrame([(datetime(2024, 1, 8),)], "week_start timestamp")
    best = lambda *days: (lambda r: (r.paired_event_id, r.paired_event_distance_days))(A.nearest_event(week, line(*days)).first())
    assert best(datetime(2024, 1, 9), datetime(2024, 1, 14)) == ("e0", 1)
    assert best(datetime(2023, 1, 1)) == (None, None) == best()
    assert best(datetime(2024, 1, 15)) == ("e0", 7) and best(datetime(2024, 1, 16)) == (None, None)
    assert best(datetime(2024, 1, 10), datetime(2024, 1, 6)) == ("e0", 2)


def test_classify_with_cache_and_failures(spark, tmp_path):
    texts = spark.createDataFrame([("a", "good"), ("b", "good"), ("c", " "), ("d", "bad json"), ("e", "known")], "id string, text string")
    cache = empty(spark, "cache")
    known = spark.createDataFrame([("known",)], "text string").select(C.T.cache_key(F.col("text"), "v1").alias("key"), F.struct(F.lit("negative").alias("sentiment"), F.lit(0.5).alias("confidence"), F.lit("low").alias("intensity"), F.lit("about_arc").alias("target")).alias("result"), F.lit("x").alias("cached_at"))
    calls = str(tmp_path / "calls")

    def model():
        def call(text):
            with open(calls, "a") as f:
                f.write(text + "\n")
            return "{" if text == "bad json" else json.dumps({"sentiment": "positive", "confidence": 0.8, "intensity": "high", "target": "about_meta"})

        return call

    out, fresh = C.classify(texts, cache.unionByName(known), model, "v1", "stub", tasks=2, per_second=1e6, attempts=3, waits=(0, 0))
    got = {r.id: (r.sentiment, r.confidence) for r in out.collect()}
    assert got == {"a": ("positive", 0.8), "b": ("positive", 0.8), "c": ("neutral", 1.0), "e": ("negative", 0.5)}
    assert sorted(open(calls).read().split("\n"))[1:] == ["bad json"] * 3 + ["good"]
    path = str(tmp_path / "cache")
    files.append_cache(fresh, path)
    files.append_cache(known, path)
    with open(f"{path}/part-broken.json", "w") as f:
        f.write("{not json\n\n")
    assert files.cache(spark, path).count() == 2
    assert C.messages("s", [("q", {"a": 1})], "t")[-1] == {"role": "user", "content": "t"} and len(C.messages("s", [("q", {})] * 8, "t")) == 18
    slept, now = [], [0.0]
    wait = C.paced(2, lambda: now[0], slept.append)
    for _ in range(2):
        wait()
    assert slept == [0.5]


def test_evaluation(spark):
    df = spark.createDataFrame([(a, "positive") for a in SENTIMENTS], "actual string, predicted string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in E.per_class(df, [*SENTIMENTS, "none"]).collect()}
    assert got == {"positive": (0.25, 1.0, 0.4, 1), "negative": (0.0, 0.0, 0.0, 1), "mixed": (0.0, 0.0, 0.0, 1), "neutral": (0.0, 0.0, 0.0, 1), "none": (0.0, 0.0, 0.0, 0)}
    assert E.accuracy(df).first()[0] == 0.25 and E.accuracy(df.limit(0)).first()[0] == 0.0
    assert [r[0] for r in spark.createDataFrame([(0.0625,), (0.0635,)], "x double").select(E.half_even(F.col("x"))).collect()] == [round(0.0625, 3), round(0.0635, 3)]
    cases = spark.createDataFrame([("1", "idiom", "t", "positive", "low", "about_arc"), ("2", "idiom", "u", "mixed", "low", "about_arc")], "id string, category string, text string, expected_sentiment string, expected_intensity string, expected_target string")
    guess = rows(spark, "classifications", [label("1", "positive", intensity="low"), label("2", "negative")])
    judged = E.judged(cases, guess)
    assert E.by_category(judged).first()[1:] == (2, 1)
    assert E.misses(judged).first().wrong_axes == ["intensity", "sentiment"][::-1]
    report = json.loads(E.report(cases, guess, {"sentiment": SENTIMENTS, "intensity": ("low", "high"), "target": ("about_arc",)}, "v1", "m").first()[0])
    assert report["eval_set_size"] == 2 and report["sentiment"]["accuracy"] == 0.5 and report["per_category"]["idiom"]["all_correct"] == 1 and len(report["misses"]) == 1


def test_dashboard_edges(spark):
    t = rows(spark, "agg_polarisation", [{"character_id": c, "total_mentions": n, "mean_sentiment_score": m, "polarisation_index": p} for c, n, m, p in [("a", 60, 0.5, 0.2), ("b", 70, -0.5, float("nan")), ("c", 70, 0.1, 0.9), ("d", 3, 0.9, 1.0)]])
    dim = rows(spark, "dim_character", [{"character_id": c, "display_name": c.upper()} for c in "abcd"])
    assert [r.character_id for r in B.top_characters(t, dim, 2).collect()] == ["b", "c"]
    assert [r.character_id for r in B.polarisation_ranking(t, dim).collect()] == ["b", "c", "a"]  # NaN comes first, as stored
    assert [r.display_name for r in B.bubbles(B.top_characters(t, dim)).orderBy("display_name").collect()] == ["A", "C", "D"]
    assert tuple(B.hero_stats(B.top(t, 3)).first()) == ("a", "b", "c")
    assert {r.category: r.character_id for r in Q.headliners(t, dim, 3).collect()} == {"warmest": "a", "coldest": "b", "most_polarising": "c"}
    assert {r.category: r.character_id for r in Q.headliners(t.where("character_id = 'd'"), dim).collect()} == {"warmest": "d"}
    sample = [r.id for r in B.sample(spark.range(100), 5, 1).collect()]
    assert sample == [r.id for r in B.sample(spark.range(100).repartition(7), 5, 1).collect()] and len(set(sample)) == 5


def test_gold_end_to_end(spark, tmp_path):
    silver, out = str(tmp_path / "silver"), str(tmp_path / "gold")
    start, posts, labels = datetime(2023, 1, 2), [], []
    for week in range(20):
        for k in range(12):
            for name in ("Gold", "King", "Mia"):
                i = f"{week}-{k}-{name}"
                posts.append(post(i, f"a post about {name}", "body", start + timedelta(7 * week, k * 3600), k))
                labels.append(label(i, "negative" if week == 15 and name == "Gold" else ("positive", "mixed", "negative", "positive")[(k + week) % 4 if (k, week % 2) != (0, 0) else 0]))
    files.replace_table(rows(spark, "silver_posts", posts), silver, "silver_posts")
    (tmp_path / "events.json").write_text(json.dumps([{"id": "ev", "date": "2023-04-18", "title": "it", "verified": True}]))
    timeline = files.events(spark, str(tmp_path / "events.json"))
    args = (spark, silver, out, rows(spark, "classifications", labels), empty(spark, "classifications"), DICT, timeline)
    counts = gold.build(*args)
    assert counts["fact_post_sentiment"] == 720 and counts["agg_char_week"] == 60 and counts["agg_polarisation"] == 3
    assert gold.build(*args) == counts  # the same again
    moments = files.table(spark, out, "moments").where("character_id = 'gold' and week_start = timestamp'2023-04-17'").collect()
    assert [(m.paired_event_id, m.paired_event_distance_days) for m in moments] == [("ev", 1)] and moments[0].z_score < -2
    with pytest.raises(gold.TooFewWeeks):
        gold.build(*args, least_weeks=61)
    gold.summaries(spark, silver, out, lambda d: (f"{len(d['positive_examples'])} good", "bad"))
    s = files.table(spark, out, "char_summary").collect()
    for r in s:  # texts and quotes of the camps that a category asks for, and no others
        for camp, text in (("positive", "8 good" if r.category != "coldest" else ""), ("negative", "bad" if r.category != "warmest" else "")):
            scores = [q.score for q in r[f"{camp}_examples"]]
            assert r[f"{camp}_summary"] == text and len(scores) == (8 if text else 0) and scores == sorted(scores, reverse=True)
    assert {r.category for r in s} >= {"warmest", "coldest"}
    files.register(spark, out, ["agg_polarisation", "dim_character"])
    assert spark.sql("SELECT count(*) FROM agg_polarisation JOIN dim_character USING (character_id)").first()[0] == 3


def test_summaries_by_camps():
    from tidemark.operators import summaries as Q

    head = {"display_name": "Gold", "category": "most_polarising", "positive_examples": [{"score": 5, "text": "so good"}], "negative_examples": [{"score": 3, "text": "so bad"}]}
    assert "(5↑) so good" in Q.prompt_of(head) and "(3↑) so bad" in Q.prompt_of(head)
    assert "so bad" not in Q.prompt_of(head | {"category": "warmest"}) and "so good" not in Q.prompt_of(head | {"category": "coldest"})
    answers = iter(["not json", '{"positive": "p"}', '{"positive": " p ", "negative": "n"}'])
    asked = []
    summarise = Q.by_camps(lambda m: asked.append(m) or next(answers), dict.fromkeys(Q.CATEGORIES, "rules"), 4, (0.0, 0.0))
    assert summarise(head) == ("p", "n") and len(asked) == 3 and asked[0][0] == {"role": "system", "content": "rules"}
    assert Q.texts_of('{"negative": "n"}', "coldest") == ("", "n")


def test_summaries_need_their_camps_quotes(spark):
    from tidemark.operators import summaries as Q

    quote = "array<struct<text: string, score: bigint, subreddit: string, permalink: string>>"
    heads = spark.createDataFrame([(c, c.upper(), g, 5, 0.5, i) for c, g, i in (("a", "warmest", None), ("b", "coldest", 0.25), ("c", "most_polarising", 1.0), ("d", "warmest", float("nan")))], "character_id string, display_name string, category string, mentions long, mean_sentiment_score double, polarisation_index double")
    one = [("good", 3, "s", "p")]
    found = spark.createDataFrame([("a", one, one), ("b", one, one), ("c", one, []), ("d", [], one)], f"character_id string, positive_examples {quote}, negative_examples {quote}")
    asked = []
    got = {r.character_id: r for r in Q.summarised(heads, found, lambda d: asked.append(d["character_id"]) or ("p", "n"), "m", "v").collect()}
    assert sorted(got) == sorted(asked) == ["a", "b"]  # c lacks negative quotes, d positive ones
    assert (got["a"].positive_summary, got["a"].negative_summary, got["a"].negative_examples, got["a"].polarisation_index) == ("p", "", [], 0.0)
    assert (got["b"].positive_summary, got["b"].negative_summary, got["b"].positive_examples, got["b"].polarisation_index) == ("", "n", [], 0.25)


class Lost(RuntimeError):
    pass


@pytest.mark.parametrize("broken", ["guard", 3, "pointer"])
def test_gold_is_published_whole_or_not_at_all(spark, tmp_path, monkeypatch, broken):
    silver, out = str(tmp_path / "silver"), str(tmp_path / "gold")
    make = lambda n: [post(f"{w}-{k}", "a post about Gold", "body", datetime(2023, 1, 2) + timedelta(7 * w, 60 * k), k) for w in range(4) for k in range(n)]
    timeline = spark.createDataFrame([], "event_id string, event_date timestamp, chapter int, arc string, title string, description string, spoiler_intensity string, medium string, verified boolean, characters array<string>, pos int")
    args = lambda n: (spark, silver, out, rows(spark, "classifications", [label(p["id"], "positive") for p in make(n)]), empty(spark, "classifications"), DICT, timeline)
    files.replace_table(rows(spark, "silver_posts", make(3)), silver, "silver_posts")
    before = gold.build(*args(3), least_weeks=1)
    reader = files.table(spark, out, "fact_post_sentiment")
    files.replace_table(rows(spark, "silver_posts", make(5)), silver, "silver_posts")
    write, point, n = files.Publication.write, files._point, iter(range(99))
    with monkeypatch.context() as m:
        if isinstance(broken, int):
            m.setattr(files.Publication, "write", lambda self, df, name: write(self, df, name) if next(n) < broken else (_ for _ in ()).throw(Lost()))
        if broken == "pointer":
            m.setattr(files, "_point", lambda *a: (_ for _ in ()).throw(Lost()))
        with pytest.raises(gold.TooFewWeeks if broken == "guard" else Lost):
            gold.build(*args(5), least_weeks=99 if broken == "guard" else 1)
    now = {name: files.table(spark, out, name).count() for name in gold.Gold.__dataclass_fields__}
    assert now == before and before["fact_post_sentiment"] == 12
    after = gold.build(*args(5), least_weeks=1)
    assert after["fact_post_sentiment"] == 20 and reader.count() == 12
    assert files._point is point
