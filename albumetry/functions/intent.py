"""Query intent, evidence rules, match type and explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions.text import capitalise, first_contained, strip


def classify(query: Column, whole_word: bool = False) -> Column:
    """struct(intent, entity): first class, then first word, found in the query."""
    clean = strip(F.lower(query))

    def first_word(words: list[str]) -> Column:
        if not whole_word:
            return first_contained(clean, words)
        return F.coalesce(*[F.when(clean.rlike(f"\\b{w}\\b"), F.lit(w)) for w in words])

    hits = {name: first_word(words) for name, words in vocab.INTENT_KEYWORDS.items()}
    chain = F.coalesce(
        *[F.when(word.isNotNull(), F.struct(F.lit(name).alias("intent"), word.alias("entity"))) for name, word in hits.items()]
    )
    return F.coalesce(chain, F.struct(F.lit("GENERAL").alias("intent"), clean.alias("entity")))


def _text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _has(text: Column, word: Column) -> Column:
    return F.contains(text, word) & (word != "")


def _any_has(words: Column, stem: Column) -> Column:
    return F.coalesce(F.exists(words, lambda w: F.contains(F.lower(w), stem)), F.lit(False)) & (stem != "")


def validate(intent: Column, entity: Column, score: Column, document_type: Column, detected_text: Column,
             caption: Column, scene: Column, objects: Column, keyword_keys: Column) -> Column:
    """struct(is_valid, confidence, reasons) of one hit for one query.

    Document queries need hard evidence; other queries are rejected only on
    contradiction or, for objects, on no evidence with a low score.
    """
    doc, ocr, cap, place = (_text(c) for c in (document_type, detected_text, caption, scene))
    stem = F.rtrim(entity, F.lit("s"))
    named = capitalise(entity)

    known = (doc != "") & ~doc.isin(vocab.NOT_A_DOCUMENT_TYPE)
    by_type = known & (_has(doc, stem) | F.contains(entity, doc))
    by_ocr = _has(ocr, stem) | _has(ocr, entity)
    by_caption = _has(cap, stem) | _has(cap, entity)
    strict_ok = by_type | by_ocr | by_caption
    strict_reasons = F.array_compact(
        F.array(
            F.when(by_type, F.concat(F.lit("Document detected ("), document_type, F.lit(")"))),
            F.when(by_ocr, F.concat(F.lit("OCR contains '"), named, F.lit("'"))),
            F.when(by_caption, F.concat(F.lit("Caption mentions '"), entity, F.lit("'"))),
        )
    )
    by_object = _any_has(objects, stem)
    by_scene = _has(place, stem) | _has(place, entity)
    by_key = _any_has(keyword_keys, stem)
    soft_reasons = F.array_compact(
        F.array(
            F.when(by_object, F.concat(named, F.lit(" detected in image"))),
            F.when(by_scene, F.concat(named, F.lit(" scene classification"))),
            F.when(by_caption, F.concat(F.lit("Caption mentions '"), entity, F.lit("'"))),
            F.when(by_key, F.concat(F.lit("AI keyword match ("), entity, F.lit(")"))),
        )
    )
    evidence = by_object.cast("int") + by_scene.cast("int") + by_caption.cast("int") + by_key.cast("int")
    contradicts = doc.isin(vocab.CONTRADICTING_TYPES) & intent.isin("OBJECT", "SCENE")
    weak = (intent == "OBJECT") & (evidence == 0) & (score < 0.20)

    def verdict(ok, confidence, reasons) -> Column:
        return F.struct(ok.alias("is_valid"), confidence.alias("confidence"), reasons.alias("reasons"))

    nothing = verdict(F.lit(False), F.lit("Low"), F.array().cast("array<string>"))
    strict_level = F.when(score >= 0.35, "Very High").otherwise("High")
    soft_level = (
        F.when((score >= 0.30) | (evidence >= 2), "Very High")
        .when((score >= 0.20) | (evidence >= 1), "High").otherwise("Medium")
    )
    return (
        F.when((intent == "DOCUMENT") & ~strict_ok, nothing)
        .when(intent == "DOCUMENT", verdict(F.lit(True), strict_level, strict_reasons))
        .when(contradicts | weak, nothing)
        .otherwise(verdict(F.lit(True), soft_level, soft_reasons))
    )


def empty_message(query: Column, intent: Column, entity: Column) -> Column:
    e = strip(F.lower(entity))
    photos = F.concat(F.lit("No "), e, F.lit(" photos were found in your library."))
    return (
        F.when((intent == "DOCUMENT") & e.isin("receipt", "receipts"), "No receipts were found in your library.")
        .when((intent == "DOCUMENT") & e.isin("passport", "passports"), "No passport images were found in your library.")
        .when((intent == "DOCUMENT") & e.isin("invoice", "invoices"), "No invoices were found in your library.")
        .when(intent == "DOCUMENT", F.concat(F.lit("No "), e, F.lit(" documents were found in your library.")))
        .when(intent.isin("OBJECT", "SCENE"), photos)
        .otherwise(F.concat(F.lit("No matching photos found for '"), query, F.lit("'.")))
    )


def explain(query: Column, score: Column, reasons: Column, confidence: Column,
            indoor_outdoor: Column, is_indoor: Column) -> Column:
    """Up to six lines that tell why a hit was returned."""
    raw = F.bround(score * 100, 0).cast("int")
    pct = F.when(raw < 0, 0).when(raw > 100, 100).otherwise(raw)
    none = F.array().cast("array<string>")
    told = F.slice(F.array_distinct(F.filter(F.coalesce(reasons, none), lambda r: r != "")), 1, 4)
    fallback = F.when(pct >= 85, "High visual & semantic similarity").otherwise("Semantic similarity to your search")
    told = F.when(F.size(told) > 0, told).otherwise(F.array(fallback))
    place = (
        F.when(indoor_outdoor != "", F.when(indoor_outdoor == "indoor", "Indoor scene").otherwise("Outdoor scene"))
        .when(is_indoor, "Indoor scene").when(~is_indoor, "Outdoor scene")
    )
    level = F.coalesce(
        F.when(confidence != "", confidence),
        F.when(pct >= 85, "Very High").when(pct >= 70, "High").when(pct >= 50, "Medium").otherwise("Low"),
    )
    lines = F.concat(
        told,
        F.array_compact(F.array(F.when(F.size(told) < 4, place))),
        F.array(F.concat(F.lit("Similarity: "), pct.cast("string"), F.lit("%")), F.concat(F.lit("Confidence: "), level)),
    )
    duplicate = F.array(
        F.lit("Perceptual hash is nearly identical"),
        F.concat(F.lit("Visual similarity: "), pct.cast("string"), F.lit("%")),
        F.lit("Potential duplicate"),
    )
    return F.when(F.lower(query).contains("duplicate"), duplicate).otherwise(F.slice(lines, 1, 6))
