"""Vector and lexical search, intent, collections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import intent as I
from albumetry.functions import text as X
from albumetry.operators import search as S
from albumetry.operators import vectors as V
from albumetry.operators.stored import StoredTable
from albumetry.plans import views as W
from albumetry.plans.registry import joined, query
from albumetry.plans.sql import first_in, strip, tokens, with_views
from albumetry.session import scratch_dir

SCORE = "round(score, 6) AS score"


@query("tokens", f"SELECT doc_id, len(t) AS n, array_to_string(list_sort(t), '|') AS tokens FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)")
def tokens_query(spark, sf):
    d = W.table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), joined(F.sort_array("t")).alias("tokens"))


DOT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("vector_topk", f"""
WITH parts AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY i))
SELECT asset_id, {SCORE} FROM (
  SELECT vec_id AS asset_id, round(list_cosine_similarity({DOT}, q), 9) AS score FROM embeddings, mean)
ORDER BY score DESC, asset_id LIMIT 20""")
def vector_topk(spark, sf):
    """Nearest 20 to the mean of all vectors."""
    parts = W.table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    hits = V.top_k_batch(centre.withColumn("query_id", F.lit(0).cast("long")), W.vectors(spark, sf), 20)
    return hits.select("asset_id", F.round("score", 6).alias("score"))


@query("vector_topk_batch", with_views(
    "SELECT query_id, asset_id, round(score, 6) AS score, place AS rank FROM hits WHERE place <= 10", "hits"))
def vector_topk_batch(spark, sf):
    hits = V.top_k_batch(W.queries(spark, sf), W.vectors(spark, sf), 10)
    return hits.select("query_id", "asset_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("similar_to", with_views("""
SELECT source_id, asset_id, round(score, 6) AS score, round(score * 100, 4) AS percentage FROM cut
JOIN assets a USING (asset_id) WHERE NOT a.is_deleted""", "assets",
    vec=f"SELECT vec_id, {DOT} AS e FROM embeddings",
    near="""SELECT s.vec_id AS source_id, t.vec_id AS asset_id, round(list_cosine_similarity(s.e, t.e), 9) AS score
        FROM vec s JOIN assets a ON a.asset_id = s.vec_id AND NOT a.is_deleted, vec t""",
    pool="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, asset_id) AS place FROM near)
        WHERE place <= 6 AND source_id <> asset_id AND score >= 0.25""",
    cut="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, asset_id) AS p2 FROM pool) WHERE p2 <= 5"))
def similar_to(spark, sf):
    """Five nearest active neighbours of every active asset, cosine at least 0.25."""
    assets = W.assets(spark, sf).select("asset_id", "is_deleted")
    out = V.similar_assets(assets, W.vectors(spark, sf), assets, 5, 0.25)
    return out.select("source_id", "asset_id", F.round("score", 6).alias("score"), F.round("percentage", 4).alias("percentage"))


def _scored(spark, sf):
    hits = S.candidates(W.queries(spark, sf), W.vectors(spark, sf), W.assets(spark, sf), W.records(spark, sf))
    return S.score_hits(hits)


SUBS = ["caption_score", "objects_score", "keywords_score", "scene_score", "ocr_score", "event_score", "people_score", "document_score"]


@query("hybrid_score", with_views(
    "SELECT query_id, asset_id, round(score, 6) AS score, hybrid_score, "
    + ", ".join(f"round(CAST({s} AS DOUBLE), 6) AS {s}" for s in SUBS) + " FROM scored", "scored"))
def hybrid_score(spark, sf):
    return _scored(spark, sf).select(
        "query_id", "asset_id", F.round("score", 6).alias("score"), "hybrid_score", *[F.round(s, 6).alias(s) for s in SUBS]
    )


@query("boost_reasons", with_views("SELECT query_id, asset_id, array_to_string(boost_reasons, '|') AS reasons FROM scored", "scored"))
def boost_reasons(spark, sf):
    return _scored(spark, sf).select("query_id", "asset_id", joined("boost_reasons").alias("reasons"))


@query("rerank", with_views("""SELECT query_id, asset_id, hybrid_score, row_number() OVER (
    PARTITION BY query_id ORDER BY hybrid_score DESC, score DESC, asset_id) AS place FROM scored""", "scored"))
def rerank(spark, sf):
    hits = S.candidates(W.queries(spark, sf), W.vectors(spark, sf), W.assets(spark, sf), W.records(spark, sf))
    return S.rerank(hits).select("query_id", "asset_id", "hybrid_score", F.col("hybrid_rank").cast("long").alias("place"))


def _class_sql(q: str) -> str:
    k = vocab.INTENT_KEYWORDS
    return ", ".join(f"{first_in(q, ws)} AS w_{name.lower()}" for name, ws in k.items())


INTENT = """CASE WHEN w_document IS NOT NULL THEN 'DOCUMENT' WHEN w_object IS NOT NULL THEN 'OBJECT'
    WHEN w_scene IS NOT NULL THEN 'SCENE' WHEN w_text IS NOT NULL THEN 'TEXT' ELSE 'GENERAL' END AS intent,
    coalesce(w_document, w_object, w_scene, w_text, clean) AS entity"""


@query("intent_classify", f"""
WITH asked AS (
    SELECT 'doc' AS kind, doc_id AS id, 0 AS turn, text FROM documents UNION ALL
    SELECT 'talk', conv_id, turn, text FROM conversations UNION ALL
    SELECT 'page', page_id, 0, html FROM pages),
cleaned AS (SELECT kind, id, turn, text, {strip('lower(text)')} AS clean FROM asked),
classed AS (SELECT kind, id, turn, text, clean, {_class_sql('clean')} FROM cleaned)
SELECT kind, id, turn, intent, entity,
  CASE WHEN intent = 'DOCUMENT' AND entity IN ('receipt','receipts') THEN 'No receipts were found in your library.'
       WHEN intent = 'DOCUMENT' AND entity IN ('passport','passports') THEN 'No passport images were found in your library.'
       WHEN intent = 'DOCUMENT' AND entity IN ('invoice','invoices') THEN 'No invoices were found in your library.'
       WHEN intent = 'DOCUMENT' THEN 'No ' || entity || ' documents were found in your library.'
       WHEN intent IN ('OBJECT','SCENE') THEN 'No ' || entity || ' photos were found in your library.'
       ELSE 'No matching photos found for ''' || text || '''.' END AS message
FROM (SELECT *, {INTENT} FROM classed)""")
def intent_classify(spark, sf):
    """Every document, conversation turn and page taken as a query text."""
    zero = F.lit(0).cast("long")
    docs = W.table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), zero.alias("turn"), "text")
    talk = W.table(spark, sf, "conversations").select(F.lit("talk").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    page = W.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), zero.alias("turn"), F.col("html").alias("text"))
    out = docs.unionByName(talk).unionByName(page).withColumn("i", I.classify(F.col("text")))
    return out.select(
        "kind", "id", "turn", F.col("i.intent").alias("intent"), F.col("i.entity").alias("entity"),
        I.empty_message(F.col("text"), F.col("i.intent"), F.col("i.entity")).alias("message"),
    )


CLASSED = f"SELECT *, {INTENT} FROM (SELECT *, {_class_sql('clean')} FROM (SELECT *, {strip('lower(query_text)')} AS clean FROM scored))"
EVIDENCE = """
SELECT *, rtrim(entity, 's') AS stem, lower(coalesce(document_type, '')) AS doc, lower(coalesce(detected_text, '')) AS ocr,
    lower(coalesce(caption, '')) AS cap, lower(coalesce(scene, '')) AS place, upper(entity[1:1]) || lower(entity[2:]) AS named FROM classed"""
FACTS = """
SELECT *, doc <> '' AND doc NOT IN ('other','unknown','none') AND ((stem <> '' AND contains(doc, stem)) OR contains(entity, doc)) AS by_type,
    (stem <> '' AND contains(ocr, stem)) OR contains(ocr, entity) AS by_ocr, (stem <> '' AND contains(cap, stem)) OR contains(cap, entity) AS by_caption,
    (stem <> '' AND contains(place, stem)) OR contains(place, entity) AS by_scene,
    stem <> '' AND len(list_filter(objects, lambda o: contains(lower(o), stem))) > 0 AS by_object,
    stem <> '' AND len(list_filter(keyword_keys, lambda o: contains(lower(o), stem))) > 0 AS by_key FROM evidence"""
JUDGED = """
SELECT *, CASE WHEN intent = 'DOCUMENT' THEN list_filter([
        CASE WHEN by_type THEN 'Document detected (' || document_type || ')' END,
        CASE WHEN by_ocr THEN 'OCR contains ''' || named || '''' END,
        CASE WHEN by_caption THEN 'Caption mentions ''' || entity || '''' END], lambda r: r IS NOT NULL)
    ELSE list_filter([
        CASE WHEN by_object THEN named || ' detected in image' END, CASE WHEN by_scene THEN named || ' scene classification' END,
        CASE WHEN by_caption THEN 'Caption mentions ''' || entity || '''' END,
        CASE WHEN by_key THEN 'AI keyword match (' || entity || ')' END], lambda r: r IS NOT NULL) END AS reasons
FROM facts"""
VALID = """
SELECT *, CASE WHEN intent = 'DOCUMENT' THEN by_type OR by_ocr OR by_caption
        ELSE NOT (doc IN ('receipt','passport','invoice') AND intent IN ('OBJECT','SCENE')) AND NOT (intent = 'OBJECT' AND len(reasons) = 0 AND hybrid_score < 0.20) END AS is_valid
FROM judged"""
LEVELS = """
SELECT *, CASE WHEN NOT is_valid THEN 'Low' WHEN intent = 'DOCUMENT' THEN CASE WHEN hybrid_score >= 0.35 THEN 'Very High' ELSE 'High' END
        WHEN hybrid_score >= 0.30 OR len(reasons) >= 2 THEN 'Very High' WHEN hybrid_score >= 0.20 OR len(reasons) >= 1 THEN 'High' ELSE 'Medium' END AS confidence
FROM valid"""
JUDGE = dict(classed=CLASSED, evidence=EVIDENCE, facts=FACTS, judged=JUDGED, valid=VALID, levels=LEVELS)


@query("intent_validate", with_views(
    """SELECT query_id, asset_id, intent, is_valid, confidence,
        CASE WHEN is_valid THEN array_to_string(reasons, '|') ELSE '' END AS reasons FROM levels""", "scored", **JUDGE))
def intent_validate(spark, sf):
    out = _scored(spark, sf).withColumn("i", I.classify(F.col("query_text")))
    out = out.withColumn("v", I.validate(F.col("i.intent"), F.col("i.entity"), F.col("hybrid_score"), F.col("document_type"),
                                         F.col("detected_text"), F.col("caption"), F.col("scene"), F.col("objects"), F.col("keyword_keys")))
    return out.select("query_id", "asset_id", F.col("i.intent").alias("intent"), "v.is_valid", "v.confidence", joined("v.reasons").alias("reasons"))


FINAL = dict(
    JUDGE,
    typed="""SELECT *, is_valid AND (len(reasons) > 0 OR confidence IN ('Very High', 'High')) AS confirmed FROM levels
        WHERE is_valid OR intent = 'GENERAL'""",
    finals="""SELECT *, CASE WHEN confirmed THEN 'Confirmed' ELSE 'Similar' END AS match_type, CASE WHEN confirmed THEN confidence ELSE 'Similar' END AS level,
        round(hybrid_score + CASE WHEN confirmed THEN 0.35 ELSE 0.0 END, 6) AS final_score,
        CASE WHEN confirmed THEN list_concat(boost_reasons, reasons) ELSE ['Visual & semantic vector similarity match'] END AS told FROM typed""",
    placed="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, hybrid_score DESC, score DESC, asset_id) AS rank,
        count(*) OVER (PARTITION BY query_id) AS total FROM finals""",
    paged="""SELECT *, count(*) FILTER (match_type = 'Similar') OVER (PARTITION BY query_id) AS total_similar,
        CAST(least(100, greatest(0, round_even(final_score * 100, 0))) AS INT) AS pct,
        CASE WHEN len(told) > 0 THEN list_filter(told, lambda r, i: list_position(told, r) = i)[1:4] WHEN final_score * 100 >= 84.5
            THEN ['High visual & semantic similarity'] ELSE ['Semantic similarity to your search'] END AS lines FROM placed WHERE rank <= 10""",
    explained="""SELECT *, CASE WHEN contains(lower(query_text), 'duplicate') THEN ['Perceptual hash is nearly identical', 'Visual similarity: ' || pct || '%', 'Potential duplicate']
        ELSE list_concat(lines, list_filter([CASE WHEN len(lines) < 4 THEN CASE indoor_outdoor WHEN 'indoor' THEN 'Indoor scene' WHEN 'outdoor' THEN 'Outdoor scene' END END], lambda r: r IS NOT NULL),
        ['Similarity: ' || pct || '%', 'Confidence: ' || level])[1:6] END AS explanation FROM paged""",
)


@query("hybrid_search", with_views(
    """SELECT query_id, rank, asset_id, match_type, final_score, hybrid_score, total, total_similar,
        array_to_string(explanation, '|') AS explanation FROM explained""", "scored", **FINAL))
def hybrid_search(spark, sf):
    """The first page of ten for every query."""
    out = S.hybrid_search(W.queries(spark, sf), W.vectors(spark, sf), W.assets(spark, sf), W.records(spark, sf))
    return out.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "asset_id", "match_type", "final_score", "hybrid_score",
        "total", F.col("total_similar").cast("long").alias("total_similar"), joined("explanation").alias("explanation"),
    )


ASKED = {0: "receipts", 1: "passport", 2: "invoice"}  # query texts by number; the others ask their passage


def _messages_sql(sql: str) -> str:
    asked = " ".join(f"WHEN {k} THEN '{v}'" for k, v in ASKED.items())
    return sql.replace("item_id AS query_id, text AS query_text", f"item_id AS query_id, CASE item_id % 4 {asked} ELSE text END AS query_text")


@query("search_messages", _messages_sql(with_views(
    f"""SELECT query_id, message FROM (
    SELECT query_id, CASE WHEN intent = 'DOCUMENT' AND entity IN ('receipt','receipts') THEN 'No receipts were found in your library.'
       WHEN intent = 'DOCUMENT' AND entity IN ('passport','passports') THEN 'No passport images were found in your library.'
       WHEN intent = 'DOCUMENT' AND entity IN ('invoice','invoices') THEN 'No invoices were found in your library.'
       WHEN intent = 'DOCUMENT' THEN 'No ' || entity || ' documents were found in your library.'
       WHEN intent IN ('OBJECT','SCENE') THEN 'No ' || entity || ' photos were found in your library.'
       ELSE 'No matching photos found for ''' || query_text || '''.' END AS message, intent
    FROM (SELECT *, {INTENT} FROM (SELECT *, {_class_sql('clean')} FROM (SELECT query_id, query_text, {strip('lower(query_text)')} AS clean FROM queries)))
    WHERE query_id NOT IN (SELECT query_id FROM finals)) WHERE intent <> 'GENERAL'""",
    "scored", **{k: v for k, v in FINAL.items() if k in [*JUDGE, "typed", "finals"]})))
def search_messages(spark, sf):
    """Queries that were searched and found nothing."""
    number, text = F.col("query_id") % 4, F.col("query_text")
    for k, v in ASKED.items():
        text = F.when(number == k, v).otherwise(text)
    asked = W.queries(spark, sf).withColumn("query_text", text)
    found = S.hybrid_search(asked, W.vectors(spark, sf), W.assets(spark, sf), W.records(spark, sf))
    return S.empty_messages(asked, found.select("query_id"), W.vectors(spark, sf).count())


@query("search_photo", with_views(
    """SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, asset_id) AS rank,
        asset_id, 1.0::DOUBLE AS final_score, (SELECT count(*) FROM assets WHERE NOT is_deleted) AS total
    FROM assets, (SELECT min(item_id) AS item_id FROM benchmark) WHERE NOT is_deleted""", "assets"))
def search_photo(spark, sf):
    """The first query asks for the whole library."""
    asked = W.queries(spark, sf)
    first = W.table(spark, sf, "benchmark").agg(F.min("item_id").alias("query_id"))
    photo = asked.join(F.broadcast(first), "query_id").withColumn("query_text", F.lit("Photo"))  # one row
    out = S.hybrid_search(photo, W.vectors(spark, sf), W.assets(spark, sf), W.records(spark, sf))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "asset_id", "final_score", "total")


@query("search_all", with_views("SELECT asset_id, filename, 1.0::DOUBLE AS score FROM assets WHERE NOT is_deleted", "assets"))
def search_all(spark, sf):
    return S.search_all(W.assets(spark, sf)).select("asset_id", "filename", "score")


@query("orphans", with_views("""SELECT h.query_id, h.asset_id FROM hits h
    WHERE h.asset_id NOT IN (SELECT asset_id FROM assets WHERE NOT is_deleted)""", "hits", "assets"))
def orphans(spark, sf):
    hits = V.top_k_batch(W.queries(spark, sf), W.vectors(spark, sf), vocab.CANDIDATES_PER_QUERY)
    return S.orphans(hits, W.assets(spark, sf)).select("query_id", "asset_id")


@query("recent_searches", """
WITH log AS (SELECT user_id, event_type || ' ' || json_extract_string(props, '$.k') AS term, max(ts) AS ts FROM events GROUP BY ALL)
SELECT user_id, term, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, term) AS place FROM log) WHERE place <= 5""")
def recent_searches(spark, sf):
    return S.recent_searches(W.search_log(spark, sf)).select("user_id", "term", F.col("place").cast("long").alias("place"))


def _collection_rows() -> str:
    rows = []
    for i, (key, name, desc, words) in enumerate(vocab.DEFAULT_COLLECTIONS):
        listed = ", ".join(f"'{w}'" for w in words)
        rows.append(f"({i}, '{key}', '{name}', '{desc}', [{listed}], false)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(position, id, name, description, keywords, is_custom)"


def _custom(spark, sf):
    """One custom collection per language; German ones override the first default."""
    d = W.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return d.select(
        F.regexp_extract("source", "(\\d+)$", 1).cast("int").alias("position"),
        F.when((F.col("lang") == "de") & (F.col("source") == "src0"), "beach").otherwise(F.concat("lang", F.lit("_"), "source")).alias("id"),
        F.concat(F.lit("Mine "), "source").alias("name"), F.concat(F.col("n").cast("string"), F.lit(" items in "), "lang").alias("description"),
        F.array("lang", "source").alias("keywords"), F.lit(True).alias("is_custom"),
    )


@query("resolve_collections", f"""
WITH defaults AS ({_collection_rows()}),
custom AS (SELECT CASE WHEN lang = 'de' AND source = 'src0' THEN 'beach' ELSE lang || '_' || source END AS id, 'Mine ' || source AS name,
    count(*) || ' items in ' || lang AS description, [lang, source] AS keywords FROM documents GROUP BY lang, source)
SELECT id, name, description, array_to_string(keywords, '|') AS keywords, is_custom, id LIKE '%src1' AS pinned FROM (
    SELECT coalesce(c.id, d.id) AS id, coalesce(c.name, d.name) AS name, coalesce(c.description, d.description) AS description,
        coalesce(c.keywords, d.keywords) AS keywords, c.id IS NOT NULL AS is_custom FROM defaults d FULL JOIN custom c ON c.id = d.id)
WHERE contains(lower(name), 'e') OR contains(lower(description), 'e') OR len(list_filter(keywords, lambda k: contains(lower(k), 'e'))) > 0""")
def resolve_collections(spark, sf):
    custom = _custom(spark, sf)
    pinned = custom.filter(F.col("id").endswith("src1")).select("id")
    out = S.resolve_collections(S.default_collections(spark), custom, pinned, search="e")
    return out.select("id", "name", "description", joined("keywords").alias("keywords"), "is_custom", "pinned")


COLLECTION_QUERIES = f"""
SELECT d.id AS query_id, array_to_string(keywords, ' ') AS query_text, v.e AS embedding FROM ({_collection_rows()}) d JOIN (
    SELECT label, list(m ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS m FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label
    ) v ON v.label = d.position"""


def _preview_sql() -> str:
    from albumetry.plans import sql as Q

    saved = dict(Q.CTES), {k: list(v) for k, v in Q.NEEDS.items()}
    try:
        Q.CTES["queries"] = COLLECTION_QUERIES
        chain = {k: v for k, v in FINAL.items() if k in [*JUDGE, "typed", "finals"]}
        return Q.with_views(
            """SELECT query_id AS id, count(*) FILTER (match_type = 'Confirmed') AS confirmed, count(*) FILTER (match_type = 'Similar') AS similar,
                array_to_string(list(CAST(asset_id AS VARCHAR) ORDER BY slot) FILTER (slot <= 4), '|') AS covers
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE match_type WHEN 'Confirmed' THEN 0 ELSE 1 END, final_score DESC, hybrid_score DESC, score DESC, asset_id) AS slot
                FROM finals) GROUP BY query_id""", "scored", **chain)
    finally:
        Q.CTES.clear()
        Q.CTES.update(saved[0])


@query("collection_preview", _preview_sql())
def collection_preview(spark, sf):
    """The default collections with the mean vector of one label each as query vector."""
    collections = S.default_collections(spark)
    vec = W.label_vectors(spark, sf).select(F.col("label").alias("position"), "embedding")
    asked = S.collection_queries(collections).join(collections.select(F.col("id").alias("query_id"), "position"), "query_id").join(vec, "position")
    found = S.hybrid_search(asked.drop("position"), W.vectors(spark, sf), W.assets(spark, sf), W.records(spark, sf), limit=24)
    out = S.collection_preview(found)
    return out.select("id", "confirmed", "similar", joined(F.col("covers").cast("array<string>")).alias("covers"))


WHOLE = "array_to_string(list_transform({0}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), '|') AS vector"


def _whole(c):
    """All elements of a vector, as millionths."""
    return joined(F.transform(c, lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string"))).alias("vector")


def _stored_vectors(spark, sf):
    rows = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"), F.lit("m").alias("model_name"), "embedding", "label")
    return StoredTable(spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}", buckets=32).create(rows)


@query("stored_upsert", f"""
WITH fresh AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT vec_id AS asset_id, label, {WHOLE.format("CASE WHEN f.doc_id IS NULL THEN embedding ELSE list_reverse(embedding) END")}
FROM embeddings LEFT JOIN fresh f ON f.doc_id = vec_id""")
def stored_upsert(spark, sf):
    """Vectors of well labelled assets are replaced in their buckets by their reversed form."""
    table = _stored_vectors(spark, sf)
    good = W.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("asset_id"))
    table.upsert(table.read().join(good, "asset_id", "left_semi").withColumn("embedding", F.reverse("embedding")), ["asset_id", "model_name"])
    return table.read().select("asset_id", "label", _whole(F.col("embedding")))


@query("stored_delete", f"""SELECT vec_id AS asset_id, label, {WHOLE.format("embedding")} FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def stored_delete(spark, sf):
    table = _stored_vectors(spark, sf)
    table.delete(W.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("asset_id")), F.col("model_name") == "m")
    return table.read().select("asset_id", "label", _whole(F.col("embedding")))


@query("upsert_vectors", """
WITH fresh AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT vec_id AS asset_id, CASE WHEN f.doc_id IS NULL THEN 'clip-A.1' ELSE 'clip-A.1' END AS model_name,
    round(CASE WHEN f.doc_id IS NULL THEN CAST(embedding[1] AS DOUBLE) ELSE CAST(embedding[64] AS DOUBLE) END, 6) AS first_value
FROM embeddings LEFT JOIN fresh f ON f.doc_id = vec_id""")
def upsert_vectors(spark, sf):
    """Vectors of well labelled assets are replaced by their reversed form."""
    old = W.vectors(spark, sf).withColumn("model_name", F.lit("clip-A.1"))
    good = W.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("asset_id"))
    new = old.join(good, "asset_id", "left_semi").withColumn("embedding", F.reverse("embedding"))
    out = V.upsert_vectors(old, new)
    return out.select("asset_id", "model_name", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


@query("vector_register", """
SELECT DISTINCT vec_id AS asset_id, 'clip-ViT.B-32' AS model_name, 'media_embeddings_clip_vit_b_32' AS model_key, len(embedding) AS vector_dimension FROM embeddings""")
def vector_register(spark, sf):
    v = W.vectors(spark, sf).withColumn("model_name", F.lit("clip-ViT.B-32"))
    return V.vector_register(v.unionByName(v)).select(
        "asset_id", "model_name", X.collection_key(F.col("model_name")).alias("model_key"),
        F.col("vector_dimension").cast("long").alias("vector_dimension"),
    )


@query("delete_vectors", "SELECT vec_id AS asset_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_vectors(spark, sf):
    v = W.table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"), "label", F.lit("m").alias("model_name"))
    gone = W.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("asset_id"))
    return V.delete_vectors(v, gone, "m").select("asset_id", "label")


@query("index_payload", with_views("""SELECT asset_id, CAST(asset_id AS VARCHAR) AS id, filename, CAST(epoch(taken_at) AS BIGINT) AS taken_at FROM assets""", "assets"))
def index_payload(spark, sf):
    return V.index_payload(W.assets(spark, sf)).select("asset_id", "payload.id", "payload.filename", "payload.taken_at")


LABEL_MEANS = """SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM (
    SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""


@query("zero_shot_label", f"""
WITH means AS ({LABEL_MEANS}),
sims AS (SELECT vec_id AS asset_id, means.label, list_dot_product({DOT}, v) AS s FROM embeddings, means),
ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY s DESC, label) AS place, sum(exp(s)) OVER (PARTITION BY asset_id) AS total FROM sims)
SELECT asset_id, 'label ' || label AS label, round(exp(s) / total, 6) AS probability FROM ranked WHERE place = 1""")
def zero_shot_label(spark, sf):
    """Mean vector per label taken as the label prompts."""
    prompts = W.label_vectors(spark, sf).select(
        F.col("label").alias("label_no"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), "embedding"
    )
    return V.label_scores(W.vectors(spark, sf), prompts).select("asset_id", "label", F.round("probability", 6).alias("probability"))


@query("aesthetic_score", f"""
WITH means AS ({LABEL_MEANS}),
pairs AS (SELECT p.label AS pair, p.v AS pos, n.v AS neg FROM means p JOIN means n ON n.label = p.label + 5),
probs AS (SELECT vec_id AS asset_id, 1 / (1 + exp((list_dot_product({DOT}, neg) - list_dot_product({DOT}, pos)) / 0.1)) AS p FROM embeddings, pairs)
SELECT asset_id, round(avg(p), 6) AS aesthetic FROM probs GROUP BY asset_id""")
def aesthetic_score(spark, sf):
    """Labels 0-4 as positive and 5-9 as negative prompts."""
    m = W.label_vectors(spark, sf)
    pos = m.select(F.col("label").alias("pair"), F.col("embedding").alias("positive"))
    neg = m.select((F.col("label") - 5).alias("pair"), F.col("embedding").alias("negative"))
    out = V.prompt_aesthetics(W.vectors(spark, sf), pos.join(neg, "pair"), vocab.PROMPT_TEMPERATURE)
    return out.select("asset_id", F.round("aesthetic", 6).alias("aesthetic"))
