"""Column rules and operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import hashes as H
from albumetry.functions import intent as I
from albumetry.functions import quality as QF
from albumetry.functions import text as X
from albumetry.operators import audits as U
from albumetry.operators import catalog as C
from albumetry.operators import ingest as N
from albumetry.operators import pairs as P
from albumetry.operators import quality as Q
from albumetry.operators import records as R
from albumetry.operators import search as S
from albumetry.operators import vectors as V
from albumetry.operators.scale import global_rank, lookup_join


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("score,grade", [
    (0.90, "EXCELLENT"), (0.85, "EXCELLENT"), (0.84, "GOOD"), (0.70, "GOOD"), (0.69, "FAIR"), (0.50, "FAIR"),
    (0.49, "POOR"), (0.30, "POOR"), (0.29, "VERY_POOR"), (0.0, "VERY_POOR"),
])
def test_grade_boundaries(spark, score, grade):
    assert one(spark, QF.grade(F.lit(score))) == grade


def test_issues(spark):
    def found(s, e, a, r, b, blur):
        return one(spark, QF.issues(*[F.lit(float(x)) for x in (s, e, a, r, b, blur)]))

    assert found(0.1, 0.5, 0.5, 1, 0.01, 100) == ["LENS_OBSTRUCTION"]
    assert found(0.9, 0.5, 0.9, 1, 0.10, 0) == []  # dark alone is no issue
    assert found(0.9, 0.5, 0.3, 1, 0.10, 0) == ["LOW_EXPOSURE"]
    assert found(0.9, 0.1, 0.5, 1, 0.95, 0) == ["OVER_EXPOSURE"]
    assert found(0.3, 0.9, 0.5, 1, 0.5, 70) == ["MOTION_BLUR"]
    assert found(0.1, 0.9, 0.5, 0.01, 0.5, 0) == ["OUT_OF_FOCUS", "LOW_RESOLUTION"]


def test_fuse_is_confidence_weighted(spark):
    rows = [("a", "p", True, 0.8, None, None, None, 1.0, 0.4, 10.0), ("a", "q", True, 0.2, None, 0.6, None, 0.5, 0.9, None),
            ("a", "r", False, 0.0, 0.0, 0.0, 0.0, 1.0, None, None), ("b", "p", False, 0.9, 0.9, 0.9, 0.9, 0.0, None, None)]
    df = spark.createDataFrame(rows, "asset_id string, provider string, is_available boolean, sharpness double, exposure double, "
                                     "aesthetic double, resolution double, confidence double, brightness double, blur_score double")
    got = {r["asset_id"]: r for r in Q.fuse_providers(df, ["q", "p", "r"]).collect()}
    assert got["a"]["sharpness"] == pytest.approx(0.6)
    assert got["a"]["exposure"] == 0.5 and got["a"]["aesthetic"] == 0.6
    assert got["a"]["confidence"] == pytest.approx(0.5)
    assert got["a"]["raw_brightness"] == 0.9 and got["a"]["raw_blur_score"] == 10.0
    assert (got["b"]["overall"], got["b"]["confidence"]) == (0.5, 0.0)
    with pytest.raises(ValueError):
        Q.validate_weights({**vocab.QUALITY_WEIGHTS, "sharpness": 0.9}, ["p"])
    with pytest.raises(ValueError):
        Q.validate_weights(vocab.QUALITY_WEIGHTS, [])


def test_assess_tells_missing_from_unavailable(spark):
    df = spark.createDataFrame([("b", "p", False, None, None, None, None, 0.0, None, None)],
                               "asset_id string, provider string, is_available boolean, sharpness double, exposure double, "
                               "aesthetic double, resolution double, confidence double, brightness double, blur_score double")
    assets = spark.createDataFrame([("b",), ("c",)], "asset_id string")
    got = {r["asset_id"]: r for r in Q.assess(assets, df, ["p"]).collect()}
    assert got["c"]["issues"] == ["UNKNOWN"] and got["c"]["quality_grade"] == "FAIR"
    assert got["b"]["issues"] == [] and got["b"]["quality_grade"] == "FAIR"


def test_normalise_records(spark):
    rows = [
        ("a", '```json\n{"caption":" a dog ","objects":["B","a",null,"n/a",2,"b"],"people_count":2.5,"keywords":["X","y"],'
              '"ai_confidence":"1.7","dominant_colors":["ff0000","#00FF00","zz"],"travel_event":"yes","scene":" Beach "}\n```'),
        ("b", '{"people_count":true,"keywords":{"foo":1,"p_hash":"ab"},"objects":"x","caption":"NONE","mood":"happy"}'),
        ("c", "[1]"), ("d", "nope"), ("e", " "), ("f", '{"keywords":{"tags":["T"]},"people_count":-4,"ai_confidence":null}'), ("g", "null"),
    ]
    df = spark.createDataFrame(rows, "media_asset_id string, response string")
    got = {r["media_asset_id"]: r for r in R.normalise_records(df).collect()}
    assert set(got) == {"a", "b", "f"}
    a, b, f = got["a"], got["b"], got["f"]
    assert (a["caption"], a["scene"], a["objects"], a["people_count"]) == ("A dog", "beach", ["2", "a", "b"], 2)
    assert (a["ai_confidence"], a["travel_event"], a["dominant_colors"]) == (1.0, True, ["#FF0000", "#00FF00"])
    assert (a["keyword_tags"], a["keyword_keys"]) == (["x", "y"], ["tags"])
    assert (b["caption"], b["people_count"], b["objects"], b["mood"], b["p_hash"]) == (None, 1, None, None, "ab")
    assert (f["keyword_tags"], f["people_count"], f["ai_confidence"]) == (["t"], 0, None)
    errors = {r["media_asset_id"] for r in R.parse_records(df).filter("parse_error is not null").collect()}
    assert errors == {"c", "d", "e", "g"}


def test_merge_keeps_what_new_record_lacks(spark):
    old = R.normalise_records(spark.createDataFrame(
        [("a", '{"caption":"old","mood":"serene","keywords":{"p_hash":"aa","x":1},"indoor_outdoor":"outdoor"}')], "media_asset_id string, response string"))
    new = R.normalise_records(spark.createDataFrame(
        [("a", '{"caption":"new","keywords":["k"],"indoor_outdoor":"indoor"}'), ("z", '{"caption":"z"}')], "media_asset_id string, response string"))
    got = {r["media_asset_id"]: r for r in R.merge_records(old, new).collect()}
    assert (got["a"]["caption"], got["a"]["mood"], got["a"]["p_hash"], got["a"]["is_indoor"]) == ("New", "serene", "aa", True)
    assert got["a"]["keyword_tags"] == ["k"] and got["a"]["keyword_keys"] == ["tags", "p_hash"]
    assert got["z"]["caption"] == "Z"


RECORD = ("asset_id long, caption string, objects array<string>, keyword_tags array<string>, keyword_keys array<string>, scene string, "
          "detected_text string, event_type string, document_type string, people_count int, indoor_outdoor string, is_indoor boolean")


def scored(spark, text, rows, cosine):
    hits = spark.createDataFrame(rows, RECORD).withColumn("query_id", F.lit(1)).withColumn("query_text", F.lit(text))
    return hits.withColumn("score", F.element_at(F.create_map(*[F.lit(x) for kv in cosine.items() for x in kv]), F.col("asset_id")))


def test_rerank_prefers_records_that_match(spark):
    rows = [(1, "a lake", None, None, None, None, None, None, None, 0, None, None),
            (2, "Group of friends on the beach", ["person"], ["beach"], ["tags"], "beach", None, "casual_outing", None, 5, "outdoor", None)]
    got = S.rerank(scored(spark, "group photo at the beach", rows, {1: 0.30, 2: 0.28})).orderBy("hybrid_rank").collect()
    assert [r["asset_id"] for r in got] == [2, 1]
    top = got[0]
    assert top["caption_score"] == 1.0 and top["scene_score"] == 1.0 and top["people_score"] == 1.0
    assert top["hybrid_score"] == pytest.approx(0.55 * 0.28 + 0.15 + 0.08 * 0.5 + 0.06 + 0.03)
    assert top["boost_reasons"][0] == 'Caption mentions "beach", "group"'


def test_strict_documents_and_contradictions(spark):
    rows = [(1, "a lake", None, None, None, None, None, None, None, 0, None, None),
            (2, "paper", None, None, None, None, "Total of receipt", None, "receipt", 0, "indoor", None)]
    asked = S.with_intent(scored(spark, "receipts", rows, {1: 0.9, 2: 0.4}))
    page = S.page(S.judge_hits(S.rerank(asked))).collect()
    assert [(r["asset_id"], r["match_type"], r["total"]) for r in page] == [(2, "Confirmed", 1)]
    assert "Document detected (receipt)" in page[0]["explanation"]
    asked = S.with_intent(scored(spark, "dog", rows, {1: 0.9, 2: 0.9}))
    assert [r["asset_id"] for r in S.page(S.judge_hits(S.rerank(asked))).collect()] == [1]
    asked = S.with_intent(scored(spark, "dog", rows, {1: 0.1, 2: 0.9}))
    assert S.page(S.judge_hits(S.rerank(asked))).count() == 0


@pytest.mark.parametrize("text,intent,entity", [
    ("my Receipts", "DOCUMENT", "receipt"), ("video", "DOCUMENT", "id"), ("a red car", "OBJECT", "car"),
    ("sunset by the sea", "SCENE", "sunset"), ("email", "TEXT", "email"), ("  Blue  ", "GENERAL", "blue"),
])
def test_intent(spark, text, intent, entity):
    got = one(spark, I.classify(F.lit(text)))
    assert (got["intent"], got["entity"]) == (intent, entity)


def test_intent_whole_word(spark):
    assert one(spark, I.classify(F.lit("video"), whole_word=True))["intent"] == "GENERAL"


def test_blank_queries_are_refused(spark):
    q = spark.createDataFrame([(1, " \n"), (2, "x")], "query_id int, query_text string")
    assert [r["query_id"] for r in S.blank_queries(q).collect()] == [1]


def test_top_k_of_one_query(spark):
    import random

    rng = random.Random(5)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "asset_id long, embedding array<double>")
    q = v.filter("asset_id = 7").first()["embedding"]
    assert V.top_k(v, F.array(*map(F.lit, q)), 3, offset=0).collect()[0]["asset_id"] == 7


def test_hash_helpers(spark):
    assert one(spark, H.hamming(F.lit("8000000000000001"), F.lit("0000000000000000"))) == 2
    assert one(spark, H.hamming(F.lit("80"), F.lit("0000000000000000"))) == 999
    assert one(spark, H.hamming(F.lit(None).cast("string"), F.lit("0000000000000000"))) == 999
    assert one(spark, H.bits_hex(H.hash_bits(F.lit("ffff00000000000f")))) == "ffff00000000000f"
    assert one(spark, X.clean_stem(F.lit("IMG 1 (Copy 2) (3).JPG"))) == "img 1"
    assert one(spark, X.migrated_path(F.lit("C:\\x\\Storage\\2024\\a.jpg"))) == "/storage/2024/a.jpg"
    assert one(spark, X.mime_from_name(F.lit("a.JPG"))) == "image/jpeg"


def test_scene_rule_is_asymmetric(spark):
    assert one(spark, P.scene_compatible(F.lit("sunset"), F.lit("office"))) is False
    assert one(spark, P.scene_compatible(F.lit("office"), F.lit("sunset"))) is True
    assert one(spark, P.scene_compatible(F.lit("floor"), F.lit("dusk"))) is False
    assert one(spark, P.scene_compatible(F.lit(None).cast("string"), F.lit("dusk"))) is True


def test_trash_days_count_whole_days(spark):
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    days = lambda t: one(spark, C.remaining_days(F.lit(t).cast("timestamp"), now))
    assert days("2024-01-31 13:00:00") == 30
    assert days("2024-01-31 12:00:00") == 29
    assert days("2023-12-01 00:00:00") == 0
    assert days(None) == 30


def test_exif_blocks(spark):
    rows = [("a", "base", "FNumber", "2.8"), ("a", "exif", "ISOSpeedRatings", "200"), ("a", "base", "DateTimeOriginal", "bad"),
            ("a", "exif", "DateTimeOriginal", "2024:01:02 03:04:05"), ("a", "gps", "GPSLatitude", "10,30,0"), ("a", "gps", "GPSLatitudeRef", "S"),
            ("b", "base", "FNumber", "odd"), ("b", "base", "GPSLatitude", "1,x,3"), ("b", "base", "GPSLatitudeRef", "N")]
    got = {r["asset_id"]: r for r in N.normalise_exif(spark.createDataFrame(rows, "asset_id string, ifd string, tag string, value string")).collect()}
    assert (got["a"]["f_number"], got["a"]["iso_speed"], got["a"]["gps_latitude"]) == ("f/2.80", 200, -10.5)
    assert str(got["a"]["taken_at"]) == "2024-01-02 03:04:05"
    assert got["b"]["f_number"] == "odd" and got["b"]["gps_latitude"] is None


def test_lookup_join_splits_hot_keys(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    out = lookup_join(rows, table, "k", "id", rows_per_task=100)
    assert out.count() == 1000 and out.filter("k = 'hot' and first = 0").count() == 900


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    assert global_rank(df, F.col("x")).filter("rank <> x + 1").count() == 0


def test_funnel_counts_equal_list_scan(spark):
    import random

    rng = random.Random(4)
    n = 60
    edges = sorted({(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.05})
    match = set(edges)
    visited, compared, reached, lead = set(), 0, 0, {}
    for i in range(n):
        if i in visited:
            continue
        for j in range(i + 1, n):
            if j in visited:
                continue
            compared += 1
            if (i, j) in match:
                reached += 1
                lead[j] = i
                visited.add(j)
    leaders = set(lead.values())
    rows = [(i, (i, i), lead.get(i, i if i in leaders else None)) for i in range(n)]
    ranked = spark.createDataFrame(rows, "id long, ord struct<t:long,i:long>, leader_id long")
    assert U._pairs_seen(ranked).first()["pairs"] == compared
    pairs = spark.createDataFrame([(a, (a, a), b) for a, b in edges], "a_id long, a_ord struct<t:long,i:long>, b_id long")
    assert U._reached(pairs, ranked).count() == reached


def test_edit_pairs_over_blocks(spark):
    import random

    rng = random.Random(6)
    rows = [(f"dark_{'a' if i % 3 else 'b'}.jpg", f"{rng.getrandbits(6):016x}") for i in range(120)]
    df = spark.createDataFrame(rows, "filename string, p_hash string")
    want = {r["bucket"]: r["pairs"] for r in U.edit_pair_distances(df).collect()}
    got = {r["bucket"]: r["pairs"] for r in U.edit_pair_distances(df, block=4).collect()}
    total = sum(k * (k - 1) // 2 for k in (40, 80))
    assert got == want and sum(got.values()) == total


def test_deep_pages_equal_the_sort(spark):
    """Pages of keys that are even, crowded in one place, all equal, or null, against the sorted whole."""
    from albumetry.operators.scale import page_of

    n = 3000
    keys = {"even": lambda k: k * 7919 % 100_003, "crowded": lambda k: 5 if k % 3 else k * 10**12, "equal": lambda k: 1,
            "null": lambda k: None if k % 2 else -k, "two": lambda k: k % 2 * (1 << 50)}
    for name, key in keys.items():
        rows = [(k, key(k)) for k in range(n)]
        df = spark.createDataFrame(rows, "id long, key long").repartition(4)
        order = [k for k, _ in sorted(rows, key=lambda r: (1 << 62 if r[1] is None else r[1], r[0]))]
        for offset, limit in ((0, 10), (1490, 25), (2995, 10), (n, 5), (700, 2500)):
            got = [r["id"] for r in page_of(df, F.col("key"), [F.col("id")], offset, limit, slice_rows=50).collect()]
            assert got == order[offset: offset + limit], (name, offset)
    empty = spark.createDataFrame([], "id long, key long")
    assert page_of(empty, F.col("key"), [F.col("id")], 0, 5).count() == 0


def test_sentence_case_is_one_letter(spark):
    """A letter whose upper case has several characters stays one letter, as in the SQL."""
    got = [one(spark, X.sentence_case(F.lit(w))) for w in ("ßel", "été", "ŉa", "ﬁn", "ᾳx", "1a", "", "日a")]
    assert got == ["ẞel", "Été", "ŉa", "ﬁn", "ᾼx", "1a", "", "日a"]


def test_whole_text_must_be_json(spark):
    """What follows the first value makes the answer unreadable."""
    texts = ["4305024215708615 words follow", "12", '{"caption": "a"}', '{"caption": "a"} and more', '{"caption": "a"}]', "1] x", "1, 2",
             '"open', "null", "[1, 2]", "true story", "", '{"a": [1, {"b": "]"}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "media_asset_id long, response string")
    got = {r["media_asset_id"]: r["parse_error"] for r in R.parse_records(df).collect()}
    bad, other = "Failed to parse JSON response", "Provider response parsed to non-object JSON structure."
    assert [got[i] for i in range(len(texts))] == [bad, other, None, bad, bad, bad, bad, bad, other, other, bad,
                                                   "Empty response received from provider.", None]
    assert sorted(r["media_asset_id"] for r in R.normalise_records(df).collect()) == [2, 12]


def test_tags_are_dealt_out_before_they_are_sorted(spark):
    """No task sorts all the tags of the file it reads."""
    rows = spark.createDataFrame([("a", "base", "Make", " x "), ("b", "other", "Unknown", "y")], "asset_id string, ifd string, tag string, value string")
    out = N.normalise_exif(rows)
    assert {r["asset_id"]: r["camera_make"] for r in out.collect()} == {"a": "x", "b": None}
    executed = N.normalise_exif(rows)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1 and executed.rindex("SortAggregate") < executed.index("Exchange hashpartitioning")


def test_letter_grid_of_texts_beyond_ascii(spark):
    """Slices go by characters, whatever their bytes; no text is brought to four bytes a character."""
    from albumetry.plans.views import letter_grid

    texts = ["", "e", "née\U0001F600e" * 40, "eé" * 64 + "\u6565\u0165e\x00e", "plain e text, " * 31, "\U0001D556" * 70 + "e", "\x80\u07ff\uffffe" * 33]
    df = spark.createDataFrame([(t, len(t)) for t in texts], "t string, n long")
    out = df.select("t", letter_grid(F.col("t"), F.col("n")).alias("g"))
    got = {r["t"]: r["g"] for r in out.collect()}
    for t in texts:
        assert got[t] == [t[i * len(t) // 64 : (i + 1) * len(t) // 64].count("e") for i in range(64)]
    assert "UTF-32" not in out._jdf.queryExecution().toString()
