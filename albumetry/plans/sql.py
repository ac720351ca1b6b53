"""The same views as ANSI SQL, for comparison runs."""

from __future__ import annotations

from albumetry import vocab


def texts(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def one_of(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def tokens(c: str) -> str:
    return (
        f"list_filter(list_distinct(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+')), "
        f"lambda w: len(w) >= 2 AND w NOT IN {one_of(vocab.STOP_WORDS)})"
    )


def any_in(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def first_in(c: str, words: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({c}, '{w}') THEN '{w}' END" for w in words) + ")"


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def meaningful(c: str) -> str:
    """Words of a text as the duplicate rules see them."""
    breaks = "[\\s,._\\-:;!?\"''()]+"
    return (
        f"list_filter(string_split_regex(lower(coalesce({c}, '')), '{breaks}'), "
        f"lambda w: len(w) >= 3 AND w NOT IN {one_of(vocab.GENERIC_WORDS)})"
    )


def words(c: str, low: int, high: int) -> str:
    return (
        f"list_sort(list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), "
        f"lambda w: len(w) BETWEEN {low} AND {high})))"
    )


def grid(c: str, cells: int = 64) -> str:
    part = f"substring({c}, 1 + (i * length({c})) // {cells}, ((i + 1) * length({c})) // {cells} - (i * length({c})) // {cells})"
    return f"list_transform(range({cells}), lambda i: length({part}) - length(replace({part}, 'e', '')))"


def exact_round(c: str, digits: int) -> str:
    """Half-up on the shortest decimal form of a double."""
    return f"CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"

CTES = {
    "assets": f"""
        SELECT d.doc_id AS asset_id,
            CASE n_chars % 7 WHEN 0 THEN 'dark_' WHEN 1 THEN 'resized_' WHEN 2 THEN 'screenshot_' ELSE '' END
              || source || '_' || lang || CASE n_chars % 3 WHEN 0 THEN ' (copy 1)' ELSE '' END
              || CASE n_chars % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.webp' ELSE '.mp4' END AS filename,
            'PHOTO' AS media_type, strlen(text) AS file_size, sha256(text) AS file_hash,
            CASE l.quality WHEN 1 THEN 'READY' WHEN 0 THEN 'FAILED' ELSE 'UPLOADED' END AS status,
            {EPOCH} + to_seconds(n_chars) AS taken_at, {EPOCH} + to_minutes(d.doc_id) AS created_at,
            coalesce(l.toxic = 1, false) AS is_deleted,
            CASE WHEN l.toxic = 1 THEN {EPOCH} + to_minutes(n_chars) END AS deleted_at,
            CASE WHEN l.toxic = 1 THEN source END AS deleted_from,
            n_chars + 1000 AS width, n_chars % 1000 + 500 AS height
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "records": f"""
        SELECT d.doc_id AS asset_id, text AS caption, html AS detected_text,
            {texts(vocab.SCENES)}[1 + CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % {len(vocab.SCENES)}] AS scene,
            {words('text', 12, 10000)} AS objects, {words('text', 10, 11)} AS keyword_tags, {words('text', 9, 9)} AS keyword_keys,
            CASE lang WHEN 'fr' THEN 'receipt' WHEN 'de' THEN 'letter' WHEN 'es' THEN 'other' END AS document_type,
            CASE n_chars % 4 WHEN 0 THEN 'birthday' WHEN 1 THEN 'new_year' WHEN 2 THEN 'travel' END AS event_type,
            CASE lang WHEN 'en' THEN 'outdoor' WHEN 'fr' THEN 'indoor' END AS indoor_outdoor,
            length(text) - length(replace(text, chr(10), '')) AS people_count,
            CASE lang WHEN 'en' THEN ['red', 'blue'] WHEN 'fr' THEN ['black', 'white'] WHEN 'de' THEN ['green', 'brown'] ELSE ['blue'] END AS dominant_colors
        FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""",
    "grids": f"SELECT doc_id AS asset_id, {grid('text')} AS grid FROM documents",
    "hashes": """
        SELECT asset_id, CAST(list_sum(list_transform(range(64), lambda i:
                CASE WHEN grid[i + 1] * 64 >= list_sum(grid) THEN CAST(pow(2, 63 - i) AS HUGEINT) ELSE 0 END)) AS UBIGINT) AS bits
        FROM grids""",
    "hashed": "SELECT asset_id, bits, lpad(lower(to_hex(bits)), 16, '0') AS p_hash FROM hashes",
    "queries": """
        SELECT item_id AS query_id, text AS query_text, embedding
        FROM benchmark JOIN embeddings ON vec_id = item_id""",
    "scores": """
        SELECT q.query_id, q.query_text, e.vec_id AS asset_id,
            round(list_cosine_similarity(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))), 9) AS score
        FROM queries q, embeddings e""",
    "hits": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, asset_id) AS place FROM scores)
        WHERE place <= 20""",
    "candidates": """
        SELECT h.query_id, h.query_text, h.score, h.asset_id, r.* EXCLUDE (asset_id)
        FROM hits h JOIN assets a ON a.asset_id = h.asset_id AND NOT a.is_deleted JOIN records r ON r.asset_id = h.asset_id""",
    "matched": f"""
        SELECT *, {tokens('query_text')} AS q,
            list_intersect({tokens('query_text')}, {tokens('caption')}) AS m_caption,
            list_intersect({tokens('query_text')}, {tokens("array_to_string(objects, ' ')")}) AS m_objects,
            list_intersect({tokens('query_text')}, {tokens("array_to_string(keyword_tags, ' ')")}) AS m_keywords,
            list_intersect({tokens('query_text')}, {tokens('scene')}) AS m_scene,
            list_intersect({tokens('query_text')}, {tokens('detected_text')}) AS m_ocr,
            list_intersect({tokens('query_text')}, {tokens("replace(event_type, '_', ' ')")}) AS m_event,
            list_intersect({tokens('query_text')}, {tokens("replace(document_type, '_', ' ')")}) AS m_document
        FROM candidates""",
    "subscores": f"""
        SELECT *, len(m_caption) / greatest(len(q), 1) AS caption_score, len(m_objects) / greatest(len(q), 1) AS objects_score,
            len(m_keywords) / greatest(len(q), 1) AS keywords_score, CASE WHEN len(m_scene) > 0 THEN 1.0 ELSE 0.0 END AS scene_score,
            len(m_ocr) / greatest(len(q), 1) AS ocr_score, CASE WHEN len(m_event) > 0 THEN 1.0 ELSE 0.0 END AS event_score,
            CASE WHEN NOT list_has_any(q, {texts(vocab.PEOPLE_WORDS)}) OR people_count = 0 THEN 0.0 WHEN people_count = 1 THEN 0.3
                 WHEN people_count <= 3 THEN 0.6 ELSE 1.0 END AS people_score,
            CASE WHEN list_has_any(q, {texts(vocab.DOCUMENT_WORDS)}) AND len(m_document) > 0 THEN 1.0 ELSE 0.0 END AS document_score
        FROM matched""",
    "scored": """
        SELECT *, round(least(1.0, greatest(0.0, 0.55 * CAST(score AS DOUBLE) + 0.15 * caption_score + 0.10 * objects_score + 0.08 * keywords_score
            + 0.06 * CAST(scene_score AS DOUBLE) + 0.05 * ocr_score + 0.03 * CAST(event_score AS DOUBLE) + 0.03 * CAST(people_score AS DOUBLE)
            + 0.03 * CAST(document_score AS DOUBLE))), 6) AS hybrid_score,
            list_filter([
                CASE WHEN caption_score > 0 THEN 'Caption mentions ' || array_to_string(list_transform(list_sort(m_caption)[1:2], lambda w: '"' || w || '"'), ', ') END,
                CASE WHEN objects_score > 0 THEN 'Objects include ' || array_to_string(list_sort(m_objects)[1:2], ', ') END,
                CASE WHEN scene_score > 0 THEN 'Scene matched: ' || scene END,
                CASE WHEN keywords_score > 0 THEN 'Keywords: ' || array_to_string(list_sort(m_keywords)[1:3], ', ') END,
                CASE WHEN ocr_score > 0 THEN 'OCR text matched ' || array_to_string(list_transform(list_sort(m_ocr)[1:2], lambda w: '"' || w || '"'), ', ') END,
                CASE WHEN event_score > 0 THEN 'Event: ' || replace(event_type, '_', ' ') END,
                CASE WHEN people_score > 0 THEN 'People detected: ' || people_count END,
                CASE WHEN document_score > 0 THEN 'Document type: ' || replace(document_type, '_', ' ') END
            ], lambda r: r IS NOT NULL) AS boost_reasons
        FROM subscores""",
    "metrics": """
        SELECT doc_id AS asset_id, n_chars + 1000 AS width, n_chars % 1000 + 500 AS height,
            (n_chars % 101) / 100 AS brightness, CAST(strlen(text) % 67 AS DOUBLE) AS sharpness
        FROM documents""",
    "classical": """
        SELECT asset_id, round(1 / (1 + exp(-0.12 * (sharpness - 20.0))), 4) AS sharpness,
            round(greatest(0.0, (cos((brightness - 0.5) * 2 * pi()) + 1) / 2), 4) AS exposure,
            round(least(1.0, CAST(width AS DOUBLE) * height / 1000000.0 / 12.0), 4) AS resolution,
            round(brightness, 4) AS brightness, round(greatest(0.0, 100.0 - sharpness * 3.0), 4) AS blur_score
        FROM metrics""",
    "assessed": """
        SELECT c.*, round(coalesce(l.quality * 0.7 + 0.2 - l.toxic * 0.1, 0.5), 4) AS aesthetic, CASE WHEN l.doc_id IS NULL THEN 0.5 ELSE 1.0 END AS confidence,
            l.doc_id IS NOT NULL AS labelled,
            0.35 * c.sharpness + 0.30 * c.exposure + 0.25 * round(CAST(coalesce(l.quality * 0.7 + 0.2 - l.toxic * 0.1, 0.5) AS DOUBLE), 4) + 0.10 * c.resolution AS overall
        FROM classical c LEFT JOIN labels l ON l.doc_id = c.asset_id""",
    "graded": """
        SELECT *, CASE WHEN overall >= 0.85 THEN 'EXCELLENT' WHEN overall >= 0.70 THEN 'GOOD' WHEN overall >= 0.50 THEN 'FAIR' WHEN overall >= 0.30 THEN 'POOR' ELSE 'VERY_POOR' END AS quality_grade,
            CASE WHEN brightness < 0.05 AND sharpness < 0.15 THEN ['LENS_OBSTRUCTION'] ELSE list_filter([
                CASE WHEN brightness < 0.15 AND aesthetic < 0.45 THEN 'LOW_EXPOSURE' END,
                CASE WHEN brightness > 0.92 AND exposure < 0.40 THEN 'OVER_EXPOSURE' END,
                CASE WHEN blur_score > 60 AND sharpness < 0.35 THEN 'MOTION_BLUR' WHEN sharpness < 0.20 THEN 'OUT_OF_FOCUS' END,
                CASE WHEN resolution < 0.5 / 12.0 THEN 'LOW_RESOLUTION' END], lambda i: i IS NOT NULL) END AS issues
        FROM assessed""",
    "quality": "SELECT * FROM graded WHERE labelled",
    "items": f"""
        SELECT a.*, h.p_hash, h.bits, r.* EXCLUDE (asset_id), q.quality_grade, q.issues, {exact_round('q.overall', 4)} AS overall_score,
            q.sharpness AS sharpness_score, q.exposure AS exposure_score, q.resolution AS resolution_score
        FROM assets a JOIN hashed h ON h.asset_id = a.asset_id JOIN records r ON r.asset_id = a.asset_id
        LEFT JOIN quality q ON q.asset_id = a.asset_id
        WHERE NOT a.is_deleted""",
    "exact_sets": """
        SELECT p_hash, count(*) AS n, first(asset_id ORDER BY created_at DESC, asset_id) AS leader_id
        FROM items GROUP BY p_hash HAVING count(*) > 1""",
    "exact": "SELECT leader_id, asset_id AS id FROM items JOIN exact_sets USING (p_hash)",
    "lone": "SELECT *, row_number() OVER (ORDER BY created_at DESC, asset_id) AS pos FROM items WHERE asset_id NOT IN (SELECT id FROM exact)",
    "worded": f"""
        SELECT asset_id, pos, bits, width, height, scene, document_type, event_type, people_count, taken_at,
            list_filter(objects, lambda w: len(w) >= 3 AND w NOT IN {one_of(vocab.GENERIC_WORDS)}) AS objs,
            list_filter(keyword_keys, lambda w: len(w) >= 3 AND w NOT IN {one_of(vocab.GENERIC_WORDS + vocab.METRIC_KEYS)}) AS keys,
            {meaningful('caption')} AS cap, {meaningful('detected_text')} AS txt, dominant_colors AS colours
        FROM lone""",
}

NEEDS = {
    "hashes": ["grids"], "hashed": ["hashes"], "scores": ["queries"], "hits": ["scores"],
    "candidates": ["hits", "assets", "records"], "matched": ["candidates"], "subscores": ["matched"],
    "scored": ["subscores"], "classical": ["metrics"], "assessed": ["classical"], "graded": ["assessed"],
    "quality": ["graded"], "items": ["assets", "hashed", "records", "quality"], "exact_sets": ["items"],
    "exact": ["items", "exact_sets"], "lone": ["items", "exact"], "worded": ["lone"],
}


def with_views(body: str, *names: str, recursive: bool = False, **more: str) -> str:
    """``body`` with the named views (and what they need) in front; ``more`` adds
    named sub-queries after them."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
