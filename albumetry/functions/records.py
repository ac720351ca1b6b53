"""Normalisation of model-produced JSON values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions.quality import clamp
from albumetry.functions.text import sentence_case, strip, words_array

NUMERIC = "^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"
HEX_COLOUR = "^#?[0-9a-fA-F]{6}$"


def unfenced(text: Column) -> Column:
    """Trimmed text without a surrounding code fence."""
    clean = strip(text)
    inner = F.regexp_replace(clean, "^```[a-zA-Z0-9]*\\s*", "")
    inner = strip(F.regexp_replace(inner, "\\s*```$", ""))
    return F.when(clean.startswith("```"), inner).otherwise(clean)


def field(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def norm_string(c: Column, limit: int, as_sentence: bool = False) -> Column:
    clean = strip(c)
    kept = F.when((clean != "") & ~F.lower(clean).isin(vocab.NULL_WORDS), F.substring(clean, 1, limit))
    return sentence_case(kept) if as_sentence else kept


def norm_enum(c: Column, vocabulary: list[str]) -> Column:
    clean = F.lower(strip(c))
    return F.when(clean.isin(vocabulary), clean)


def norm_list(items: Column, limit: int) -> Column:
    """Lower-case, distinct, sorted, cut; null stays null."""
    clean = F.transform(items, lambda w: F.lower(strip(w)))
    kept = F.filter(clean, lambda w: w.isNotNull() & (w != "") & ~w.isin(vocab.NULL_WORDS))
    return F.slice(F.sort_array(F.array_distinct(kept)), 1, limit)


def norm_colours(items: Column, limit: int = vocab.LIST_LIMITS["dominant_colors"]) -> Column:
    clean = F.filter(F.transform(items, strip), lambda w: w.rlike(HEX_COLOUR))
    named = F.transform(
        clean, lambda w: F.upper(F.when(w.startswith("#"), w).otherwise(F.concat(F.lit("#"), w)))
    )
    return F.slice(named, 1, limit)


def to_number(c: Column) -> Column:
    return F.when(c.rlike(NUMERIC), F.trim(c).try_cast("double"))


def norm_people(number: Column) -> Column:
    """Half-even rounding, 0 to 100."""
    return clamp(F.bround(number, 0), 0.0, 100.0).cast("int")


def norm_confidence(number: Column) -> Column:
    return clamp(number)


def norm_bool(c: Column) -> Column:
    clean = F.lower(strip(c))
    return F.when(clean.isin(vocab.TRUE_WORDS), True).when(clean.isin(vocab.FALSE_WORDS), False)


def keyword_words(scene: Column, objects: Column, colours: Column) -> Column:
    """Search words of a locally labelled image: topic words added, template words dropped."""
    main = F.get(objects, F.lit(0))
    topics = (
        F.when(main == "clock", words_array(vocab.TOPIC_WORDS["clock"]))
        .when(main == "flower", words_array(vocab.TOPIC_WORDS["flower"]))
        .when(scene == "mountain", words_array(vocab.TOPIC_WORDS["mountain"]))
        .when(scene == "beach", words_array(vocab.TOPIC_WORDS["beach"]))
        .otherwise(F.array().cast("array<string>"))
    )
    none = F.array().cast("array<string>")
    raw = F.concat(F.array(scene), F.coalesce(objects, none), F.coalesce(colours, none), topics)
    clean = F.transform(raw, lambda w: strip(F.lower(w)))
    return F.array_distinct(
        F.filter(clean, lambda w: (F.length(w) >= 3) & ~w.isin(vocab.TEMPLATE_WORDS))
    )


def keyword_map(scene: Column, objects: Column, colours: Column, p_hash: Column | None = None) -> Column:
    """Words with their fixed weight, and the hash under ``p_hash``, as text values."""
    words = keyword_words(scene, objects, colours)
    weights = F.map_from_arrays(
        words, F.transform(words, lambda _: F.lit(str(vocab.KEYWORD_VALUE)))
    )
    if p_hash is None:
        return weights
    return set_metric(weights, "p_hash", p_hash)


def set_metric(metrics: Column, key: str, value: Column) -> Column:
    """Map with one key set and all others kept; null map counts as empty."""
    kept = F.map_filter(
        F.coalesce(metrics, F.create_map().cast("map<string,string>")), lambda k, _: k != key
    )
    return F.map_concat(kept, F.create_map(F.lit(key), value))


def map_scene(label: Column) -> Column:
    chain = F.coalesce(*[F.when(label.contains(w), w) for w in vocab.SCENE_RULES], F.lit("indoor"))
    return F.when(label.isNotNull(), chain)


def map_objects(label: Column) -> Column:
    return F.array_compact(F.array(F.coalesce(*[F.when(label.contains(w), w) for w in vocab.OBJECT_RULES])))


def map_document_type(label: Column) -> Column:
    return F.coalesce(*[F.when(label.contains(w), w) for w in vocab.DOCUMENT_RULES])


def indoor_outdoor_of(scene: Column) -> Column:
    return F.when(scene.isin(vocab.INDOOR_SCENES), "indoor").otherwise("outdoor")


def filename_hints(filename: Column, width: Column, height: Column, scene: Column, objects: Column) -> Column:
    """struct(scene, objects): gaps filled from the file name and the shape."""
    name = F.lower(filename)
    has = name.contains
    no_scene = scene.isNull() | (scene == "")
    new_scene = F.when(
        no_scene,
        F.when(has("clock"), "indoor")
        .when(has("beach") | has("coast"), "beach")
        .when(has("mountain"), "mountain")
        .when(has("flower") | has("garden"), "garden")
        .when(has("city") | has("skyline"), "city")
        .when(width > height, "outdoor")
        .otherwise("indoor"),
    ).otherwise(scene)

    def one(word: str) -> Column:
        return F.array(F.lit(word))

    named = F.when(
        no_scene,
        F.when(has("clock"), one("clock"))
        .when(has("beach") | has("coast") | has("mountain"), objects)
        .when(has("flower") | has("garden"), one("flower"))
        .when(has("city") | has("skyline"), one("building"))
        .otherwise(objects),
    ).otherwise(objects)
    fallback = F.coalesce(
        *[F.when(has(w), one(w)) for w in ("clock", "flower", "mountain", "car", "dog")],
        *[F.when(new_scene == s, words_array(ws)) for s, ws in vocab.SCENE_OBJECTS.items()],
        F.array().cast("array<string>"),
    )
    new_objects = F.when(F.size(F.coalesce(named, F.array().cast("array<string>"))) > 0, named).otherwise(fallback)
    return F.struct(new_scene.alias("scene"), new_objects.alias("objects"))


def _cap(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def caption_template(objects: Column, scene: Column, colour: Column, document_type: Column, filename: Column) -> Column:
    main = F.get(objects, F.lit(0))
    name = F.lower(filename)
    colour = F.coalesce(colour, F.lit("dark"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(main == "clock"), F.concat(_cap(colour), F.lit(" analog clock on a dark background")))
        .when(yes(main == "flower") | yes(scene == "garden"), F.concat(_cap(colour), F.lit(" flowers growing in a garden")))
        .when(yes(scene == "mountain") | yes(main == "mountain"),
              F.concat(F.lit("Mountain landscape view under "), colour, F.lit(" sky")))
        .when(yes(scene == "beach"), "Foggy beach at sunrise with ocean view")
        .when(yes(scene == "city"), "City skyline viewed through haze")
        .when(yes(document_type == "receipt") | yes(name.contains("receipt")), "Store purchase receipt document")
        .when(yes(document_type == "passport") | yes(name.contains("passport")), "Official passport document page")
        .when(main.isNotNull(), F.concat(_cap(colour), F.lit(" "), main, F.lit(" in a "), scene, F.lit(" setting")))
        .otherwise(F.concat(_cap(scene), F.lit(" scene with "), colour, F.lit(" color tones")))
    )


def ingest_caption(filename: Column) -> Column:
    has = F.lower(filename).contains
    return (
        F.when(has("clock"), "Black analog clock on a dark background")
        .when(has("beach"), "Foggy beach at sunrise")
        .when(has("flower") | has("garden"), "Purple flowers growing in a garden")
        .when(has("city") | has("skyline"), "City skyline viewed through haze")
        .when(has("mountain"), "Mountain landscape view under blue sky")
        .when(has("receipt"), "Store purchase receipt document")
        .when(has("passport"), "Official passport document page")
        .otherwise("Photo capturing scenic subject composition")
    )


def analysis_prompt(taken_at: Column, make: Column, model: Column, lat: Column, lng: Column, filename: Column) -> Column:
    """Request text for batch inference with whatever context the row has."""
    base = "Analyze the provided image and generate the conforming Knowledge Record JSON object."
    filled = lambda c: F.when(c != "", c)
    camera = F.when(
        filled(make).isNotNull(),
        strip(F.concat(F.lit("- Camera: "), make, F.lit(" "), F.coalesce(model, F.lit("")))),
    )
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("- Capture Time: "), filled(taken_at)),
        camera,
        F.concat(F.lit("- GPS Coordinates: Latitude "), lat.cast("string"), F.lit(", Longitude "), lng.cast("string")),
        F.concat(F.lit("- Original Filename: "), filled(filename)),
    )
    intro = "Here is some reliable, pre-extracted context from the file's metadata to assist your analysis:"
    outro = (
        "Use this context to resolve ambiguities (for example, using GPS coordinates to determine "
        "the location or timestamps for the season/event, if applicable)."
    )
    return F.when(
        lines != "",
        F.concat(F.lit(f"{base}\n\n{intro}\n"), lines, F.lit(f"\n\n{outro}")),
    ).otherwise(base)
