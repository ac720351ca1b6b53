"""Hybrid search for tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import intent as I
from albumetry.functions import text as X
from albumetry.operators.scale import global_rank, maybe_among
from albumetry.operators.vectors import top_k_batch
from albumetry.session import written

RECORD_COLUMNS = [
    "caption", "objects", "keyword_tags", "keyword_keys", "scene", "detected_text",
    "event_type", "document_type", "people_count", "indoor_outdoor", "is_indoor",
]
SUB_SCORES = ["caption", "objects", "keywords", "scene", "ocr", "event", "people", "document"]


def _spaced(c: Column) -> Column:
    return F.translate(c, "_", " ")


def score_hits(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds the lexical sub-scores, ``hybrid_score`` and ``boost_reasons``.

    hits: query_text, score (cosine; null counts as 0) and RECORD_COLUMNS; a hit
    without record has only nulls there and keeps its cosine share.
    """
    w = {**vocab.HYBRID_WEIGHTS, **(weights or {})}
    found = {
        "caption": X.tokens(F.col("caption")),
        "objects": X.list_tokens(F.col("objects")),
        "keywords": X.list_tokens(F.col("keyword_tags")),
        "scene": X.tokens(F.col("scene")),
        "ocr": X.tokens(F.col("detected_text")),
        "event": X.tokens(_spaced(F.col("event_type"))),
        "document": X.tokens(_spaced(F.col("document_type"))),
    }
    out = hits.withColumn("_q", X.tokens(F.col("query_text")))
    out = out.withColumns({f"_m_{k}": F.array_intersect("_q", t) for k, t in found.items()})
    q = F.col("_q")
    share = lambda k: F.size(f"_m_{k}") / F.greatest(F.size(q), F.lit(1))
    one = lambda k: (F.size(f"_m_{k}") > 0).cast("double")
    count = F.col("people_count")
    about_people = F.arrays_overlap(q, X.words_array(vocab.PEOPLE_WORDS))
    about_documents = F.arrays_overlap(q, X.words_array(vocab.DOCUMENT_WORDS))
    people = F.when(
        about_people,
        F.when(count.isNull() | (count == 0), 0.0).when(count == 1, 0.3).when(count <= 3, 0.6).otherwise(1.0),
    ).otherwise(0.0)
    out = out.withColumns(
        {
            "caption_score": share("caption"), "objects_score": share("objects"),
            "keywords_score": share("keywords"), "scene_score": one("scene"),
            "ocr_score": share("ocr"), "event_score": one("event"), "people_score": people,
            "document_score": F.when(about_documents, one("document")).otherwise(0.0),
        }
    )
    total = F.lit(w["embedding"]) * F.coalesce("score", F.lit(0.0))
    for name in SUB_SCORES:
        total = total + F.lit(w[name]) * F.col(f"{name}_score")

    def listed(k: str, n: int, quote: bool = False) -> Column:
        words = F.slice(F.sort_array(f"_m_{k}"), 1, n)
        if quote:
            words = F.transform(words, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
        return F.array_join(words, ", ")

    def told(name: str, line: Column) -> Column:
        return F.when(F.col(f"{name}_score") > 0, line)

    reasons = F.array_compact(
        F.array(
            told("caption", F.concat(F.lit("Caption mentions "), listed("caption", 2, True))),
            told("objects", F.concat(F.lit("Objects include "), listed("objects", 2))),
            told("scene", F.concat(F.lit("Scene matched: "), F.col("scene"))),
            told("keywords", F.concat(F.lit("Keywords: "), listed("keywords", 3))),
            told("ocr", F.concat(F.lit("OCR text matched "), listed("ocr", 2, True))),
            told("event", F.concat(F.lit("Event: "), _spaced(F.col("event_type")))),
            told("people", F.concat(F.lit("People detected: "), count.cast("string"))),
            told("document", F.concat(F.lit("Document type: "), _spaced(F.col("document_type")))),
        )
    )
    clamped = F.when(total < 0, 0.0).when(total > 1, 1.0).otherwise(total)
    return (
        out.withColumn("hybrid_score", F.round(clamped, 6))
        .withColumn("boost_reasons", reasons)
        .drop("_q", *[f"_m_{k}" for k in found])
    )


def rerank(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Hits of every query ordered by hybrid score, then cosine, then id."""
    w = Window.partitionBy("query_id").orderBy(
        F.col("hybrid_score").desc(), F.col("score").desc(), F.col("asset_id")
    )
    return score_hits(hits, weights).withColumn("hybrid_rank", F.row_number().over(w))


def with_intent(queries: DataFrame, whole_word: bool = False) -> DataFrame:
    """Intent and entity once per query, before any hit is joined."""
    out = queries.withColumn("_i", I.classify(F.col("query_text"), whole_word))
    return out.withColumns({"intent": F.col("_i.intent"), "entity": F.col("_i.entity")}).drop("_i")


def judge_hits(reranked: DataFrame) -> DataFrame:
    """Intent check, match type, boost and final score per hit.

    ``is_hit`` is false for hits to drop; they are dropped by ``page`` after its
    window, so that the checks are evaluated once and not again in a filter.
    """
    out = reranked.withColumn(
        "_v",
        I.validate(
            F.col("intent"), F.col("entity"), F.col("hybrid_score"), F.col("document_type"),
            F.col("detected_text"), F.col("caption"), F.col("scene"), F.col("objects"), F.col("keyword_keys"),
        ),
    )
    valid = F.col("_v.is_valid")
    sure = valid & ((F.size("_v.reasons") > 0) | F.col("_v.confidence").isin("Very High", "High"))
    out = out.withColumns({"is_hit": valid | (F.col("intent") == "GENERAL"), "_sure": sure})
    sure = F.col("_sure")
    return (
        out.withColumn("match_type", F.when(sure, "Confirmed").otherwise("Similar"))
        .withColumn("confidence_level", F.when(sure, F.col("_v.confidence")).otherwise("Similar"))
        .withColumn(
            "all_reasons",
            F.when(sure, F.concat("boost_reasons", "_v.reasons"))
            .otherwise(F.array(F.lit("Visual & semantic vector similarity match"))),
        )
        .withColumn("final_score", F.round(F.col("hybrid_score") + F.when(sure, vocab.CONFIRMED_BOOST).otherwise(0.0), 6))
        .drop("_v", "_sure")
    )


def page(judged: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """One page per query in final order, with explanations and totals.

    ``total`` counts every hit of the query, ``total_similar`` the page only.
    """
    per_query = Window.partitionBy("query_id")
    order = per_query.orderBy(
        F.col("is_hit").desc(), F.col("final_score").desc(), F.col("hybrid_score").desc(),
        F.col("score").desc(), F.col("asset_id"),
    )
    on_page = F.col("is_hit") & (F.col("rank") > offset) & (F.col("rank") <= offset + limit)
    similar = F.count_if(on_page & (F.col("match_type") == "Similar")).over(per_query)
    return (
        judged.withColumn("rank", F.row_number().over(order))
        .withColumn("total", F.count_if(F.col("is_hit")).over(per_query))
        .withColumn("total_similar", similar)
        .filter(on_page)
        .withColumn(
            "explanation",
            I.explain(F.col("query_text"), F.col("final_score"), F.col("all_reasons"),
                      F.col("confidence_level"), F.col("indoor_outdoor"), F.col("is_indoor")),
        )
    )


def candidates(queries: DataFrame, vectors: DataFrame, assets: DataFrame, records: DataFrame,
               pool: int = vocab.CANDIDATES_PER_QUERY, prefilter: bool = False) -> DataFrame:
    """Nearest ``pool`` vectors per query with their records; deleted assets are
    dropped after the cut (before it with ``prefilter``).

    Names and records are read by the scan but only those of hits leave it: a mark of the hits' ids filters them there.
    """
    active = assets.filter(~F.col("is_deleted")).select("asset_id", "filename")
    if prefilter:
        vectors = vectors.join(active, "asset_id", "left_semi")
    hits = written(top_k_batch(queries, vectors, pool).drop("rank"))
    active, records = maybe_among(active, hits, "asset_id"), maybe_among(records, hits, "asset_id")
    wide = records.select("asset_id", *[c for c in RECORD_COLUMNS if c in records.columns])
    missing = {c: F.lit(None).cast("boolean" if c == "is_indoor" else "string")
               for c in RECORD_COLUMNS if c not in records.columns}
    return (
        hits.join(queries.drop("embedding"), "query_id")
        .join(active, "asset_id").join(wide, "asset_id", "left").withColumns(missing)
    )


def hybrid_search(queries: DataFrame, vectors: DataFrame, assets: DataFrame, records: DataFrame,
                  limit: int = 10, offset: int = 0, weights: dict[str, float] | None = None,
                  pool: int = vocab.CANDIDATES_PER_QUERY, prefilter: bool = False,
                  whole_word: bool = False) -> DataFrame:
    """Vector candidates, lexical rerank, intent rules, page and explanation.

    queries: query_id, query_text, embedding. Blank query texts return no rows (see ``blank_queries``). The query that
    asks for the whole library is answered without vectors: every active asset, newest first, score 1, no paging.
    """
    whole = is_whole_library(F.col("query_text"))
    asked = with_intent(queries.filter((X.strip(F.col("query_text")) != "") & ~whole), whole_word)
    hits = candidates(asked, vectors, assets, records, pool, prefilter)
    found = page(judge_hits(rerank(hits, weights)), limit, offset)
    if queries.filter(whole).isEmpty():
        return found
    return found.unionByName(_everything(queries.filter(whole), assets), allowMissingColumns=True)


def _everything(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """All active assets for each whole-library query; ranks come from one pass over the list, not per query."""
    order = [F.col("created_at").desc(), F.col("asset_id")]
    listed = global_rank(assets.filter(~F.col("is_deleted")).select("asset_id", "filename", "created_at"), *order).drop("created_at")
    asked = queries.select("query_id", "query_text").withColumn("_all", F.lit(True))
    total = listed.agg(F.count("*").alias("total"))
    return (
        listed.withColumn("_all", F.lit(True)).join(asked, "_all").crossJoin(F.broadcast(total))  # one row
        .withColumns({"score": F.lit(1.0), "hybrid_score": F.lit(1.0), "final_score": F.lit(1.0), "total_similar": F.lit(0).cast("long"),
                      "is_hit": F.lit(True), "rank": F.col("rank").cast("int")}).drop("_all")
    )


def blank_queries(queries: DataFrame) -> DataFrame:
    """Queries that are refused, with the message."""
    return queries.filter(F.coalesce(X.strip(F.col("query_text")), F.lit("")) == "").select(
        "query_id", F.lit("Invalid search request: Query string cannot be empty.").alias("message")
    )


def empty_messages(queries: DataFrame, results: DataFrame, indexed: int | None = None) -> DataFrame:
    """Message per query that was searched and found nothing (general queries give none).

    ``indexed``: how many vectors there are, where the caller knows; without any, every query gets the message for an
    empty index.
    """
    unmatched = with_intent(queries).join(results.select("query_id").distinct(), "query_id", "left_anti")
    empty = F.lit(indexed == 0)
    message = F.when(empty, vocab.EMPTY_INDEX).otherwise(I.empty_message(F.col("query_text"), F.col("intent"), F.col("entity")))
    return unmatched.filter(empty | (F.col("intent") != "GENERAL")).select("query_id", message.alias("message"))


def orphans(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """Vector hits that have no active catalog row."""
    return hits.join(assets.filter(~F.col("is_deleted")).select("asset_id"), "asset_id", "left_anti")


def is_whole_library(query: Column) -> Column:
    return F.lower(query) == vocab.WHOLE_LIBRARY_QUERY


def search_all(assets: DataFrame) -> DataFrame:
    """Every active asset, newest first, score 1; paging does not apply."""
    return assets.filter(~F.col("is_deleted")).withColumn("score", F.lit(1.0)).orderBy(
        F.col("created_at").desc(), "asset_id"
    )


# --- smart collections ---------------------------------------------------------------

def default_collections(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, *c, False) for i, c in enumerate(vocab.DEFAULT_COLLECTIONS)],
        "position int, id string, name string, description string, keywords array<string>, is_custom boolean",
    )


def resolve_collections(defaults: DataFrame, custom: DataFrame, pinned: DataFrame, counts: DataFrame | None = None,
                        search: str = "") -> DataFrame:
    """Custom rows override defaults by id; filtered, pinned ones first, empty ones hidden."""
    fields = ["position", "name", "description", "keywords", "is_custom"]
    theirs = custom.select("id", *[F.col(c).alias(f"c_{c}") for c in fields])
    merged = defaults.join(theirs, "id", "full_outer").select(
        "id",
        # an overriding row keeps the default's place; new ones follow
        F.coalesce("position", F.col("c_position") + 1_000_000).alias("position"),
        *[F.coalesce(f"c_{c}", c).alias(c) for c in fields[1:]],
    )
    q = search.lower()
    if q.strip():
        merged = merged.filter(
            F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("description"), F.lit(q))
            | F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(q)))
        )
    if counts is not None:
        hidden = counts.filter("confirmed = 0 and similar = 0").select("id")
        merged = merged.join(hidden, "id", "left_anti")
    marked = merged.join(pinned.select("id", F.lit(True).alias("pinned")).distinct(), "id", "left")
    return marked.withColumn("pinned", F.coalesce("pinned", F.lit(False))).orderBy(F.col("pinned").desc(), "position")


def collection_queries(collections: DataFrame) -> DataFrame:
    """One search query per collection: its keywords, or its name."""
    return collections.select(
        F.col("id").alias("query_id"),
        F.when(F.size("keywords") > 0, F.array_join("keywords", " ")).otherwise(F.col("name")).alias("query_text"),
    )


def collection_preview(results: DataFrame, covers: int = 4) -> DataFrame:
    """Per collection: confirmed and similar counts and up to four covers.

    ``results`` is a hybrid_search page (limit 24), so groups hold at most 24 rows.
    """
    best_first = Window.partitionBy("query_id").orderBy(
        F.when(F.col("match_type") == "Confirmed", 0).otherwise(1), "rank"
    )
    placed = results.withColumn("_place", F.row_number().over(best_first))
    return placed.groupBy(F.col("query_id").alias("id")).agg(
        F.count_if(F.col("match_type") == "Confirmed").alias("confirmed"),
        F.count_if(F.col("match_type") == "Similar").alias("similar"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("_place") <= covers, F.struct("_place", "asset_id")))),
            lambda c: c["asset_id"],
        ).alias("covers"),
    )


def recent_searches(log: DataFrame, keep: int = 5) -> DataFrame:
    """Last distinct terms per user, newest first."""
    latest = log.filter(F.col("term") != "").groupBy("user_id", "term").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "term")
    return latest.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
