"""Duplicate and similar groups, recommendations, analytics, audits, life cycles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from albumetry import vocab
from albumetry.functions import hashes as H
from albumetry.functions import quality as QF
from albumetry.functions import text as X
from albumetry.operators import analytics as A
from albumetry.operators import audits as U
from albumetry.operators import catalog as C
from albumetry.operators import groups as G
from albumetry.operators import pairs as P
from albumetry.operators import recommend as R
from albumetry.plans import views as W
from albumetry.plans.registry import joined, query
from albumetry.plans.sql import NOW, any_in, one_of, with_views
from albumetry.session import scratch_dir, written
from albumetry.streaming import jobs as J


NARROW = ["asset_id", "filename", "file_size", "taken_at", "created_at", "p_hash", "quality_grade", "overall_score", "issues"]


def _items(spark, sf):
    """(items without any text, written once; items with all that the rules read, from the source)."""
    items = W.items(spark, sf)
    return written(items.select(*NARROW)), items


def _plain(spark, sf):
    """Active assets with their hash, without records and quality."""
    return written(C.active(W.assets(spark, sf, p_hash=True)))


# --- SQL pieces --------------------------------------------------------------------------

SCENE_OK = f"""(coalesce(a.scene, '') = '' OR coalesce(b.scene, '') = '' OR a.scene = b.scene
    OR ({any_in('a.scene', vocab.BEACH_LEFT)} AND {any_in('b.scene', vocab.BEACH_RIGHT)})
    OR ({any_in('a.scene', vocab.MOUNTAIN_LEFT)} AND {any_in('b.scene', vocab.MOUNTAIN_RIGHT)})
    OR NOT (({any_in('a.scene', vocab.BEACH_LEFT)} AND {any_in('b.scene', vocab.INDOOR_RIGHT)})
        OR ({any_in('a.scene', vocab.INDOOR_LEFT)} AND {any_in('b.scene', vocab.BEACH_RIGHT)})))"""
MONO = "len(list_filter({0}, lambda c: NOT (contains(c, 'black') OR contains(c, 'white') OR contains(c, 'gray')))) = 0"
RULES = {
    "aspect": ("true", "(abs(a.width / a.height - b.width / b.height) <= 0.40 OR abs(a.width / a.height - b.height / b.width) <= 0.40)"),
    "scene": ("(coalesce(a.scene, '') <> '' AND coalesce(b.scene, '') <> '')", SCENE_OK),
    "objects": ("(len(a.objs) > 0 AND len(b.objs) > 0)", "list_has_any(a.objs, b.objs)"),
    "caption": ("(len(a.cap) >= 3 AND len(b.cap) >= 3)", "list_has_any(a.cap, b.cap)"),
    "colours": ("(len(a.colours) >= 2 AND len(b.colours) >= 2)",
                f"(list_has_any(a.colours, b.colours) OR {MONO.format('a.colours')} OR {MONO.format('b.colours')})"),
}
NEAR_OK = " AND ".join(f"(NOT {applies} OR {passes})" for applies, passes in RULES.values())
D = "bit_count(xor(a.bits, b.bits))"
CLOSE = f"""SELECT a.pos AS a, b.pos AS b, a.asset_id AS a_id, b.asset_id AS b_id, {D} AS distance, {NEAR_OK} AS accepted,
    {', '.join(f"CASE WHEN NOT {x} THEN 'SKIPPED' WHEN {y} THEN 'PASSED' ELSE 'REJECTED' END AS {n}_rule" for n, (x, y) in RULES.items())}
    FROM worded a JOIN worded b ON a.pos < b.pos AND {D} BETWEEN 1 AND 4"""


def scan_sql(prefix: str, edges: str) -> dict[str, str]:
    """Sub-queries that walk the list in order; ``edges`` has a and b as positions.

    ``{prefix}_led`` gives (leader, member) positions, leaders included."""
    p = prefix
    return {
        f"{p}_nodes": f"SELECT p, row_number() OVER (ORDER BY p) AS r FROM (SELECT a AS p FROM {edges} UNION SELECT b FROM {edges})",
        f"{p}_adj": f"""SELECT x.r, list(y.r) AS nexts FROM {edges} e JOIN {p}_nodes x ON x.p = e.a JOIN {p}_nodes y ON y.p = e.b GROUP BY x.r""",
        f"{p}_scan": f"""SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken UNION ALL
            SELECT i + 1, CASE WHEN list_contains(taken, i + 1) OR nexts IS NULL THEN taken ELSE list_distinct(list_concat(taken, nexts)) END
            FROM {p}_scan LEFT JOIN {p}_adj ON r = i + 1 WHERE i < (SELECT count(*) FROM {p}_nodes)""",
        f"{p}_taken": f"SELECT p FROM {p}_nodes WHERE r IN (SELECT unnest(taken) FROM {p}_scan WHERE i = (SELECT count(*) FROM {p}_nodes))",
        f"{p}_member": f"""SELECT b AS member, min(a) AS leader FROM {edges} WHERE a NOT IN (SELECT p FROM {p}_taken) AND b IN (SELECT p FROM {p}_taken) GROUP BY b""",
        f"{p}_led": f"SELECT leader, member FROM {p}_member UNION SELECT leader, leader FROM {p}_member",
    }


NEAR = {"close": CLOSE, "near_edges": "SELECT a, b FROM close WHERE accepted", **scan_sql("near", "near_edges")}


# --- pairs and groups ---------------------------------------------------------------------

def _codes(spark, sf):
    d = W.table(spark, sf, "documents")
    h = H.ahash64(W.letter_grid(F.col("text"), F.col("n_chars")))
    return d.select(H.hash_bits(h).alias("code")).distinct()


def _brute(radius: int) -> str:
    return with_views(
        f"""SELECT least(a.h, b.h) AS low_hash, greatest(a.h, b.h) AS high_hash, {D} AS distance
        FROM codes a JOIN codes b ON a.h < b.h AND {D} <= {radius}""",
        "hashed", codes="SELECT DISTINCT p_hash AS h, bits FROM hashed")


def _pairs(spark, sf, radius):
    a, b = H.bits_hex(F.col("code_a")), H.bits_hex(F.col("code_b"))
    return P.hash_pairs(_codes(spark, sf), radius).select(
        F.least(a, b).alias("low_hash"), F.greatest(a, b).alias("high_hash"), F.col("distance").cast("long").alias("distance"))


@query("hamming_pairs_4", _brute(4))
def hamming_pairs_4(spark, sf):
    return _pairs(spark, sf, 4)


@query("hamming_pairs_8", _brute(8))
def hamming_pairs_8(spark, sf):
    return _pairs(spark, sf, 8)


@query("hamming", with_views("""SELECT a.asset_id, bit_count(xor(a.bits, b.bits)) AS distance FROM hashed a JOIN (
    SELECT lead(asset_id) OVER (ORDER BY asset_id) AS next_id, asset_id, bits FROM hashed) b ON b.next_id = a.asset_id""", "hashed"))
def hamming(spark, sf):
    """Distance of every asset's hash to the one numbered before it."""
    d = W.table(spark, sf, "documents").select(
        F.col("doc_id").alias("asset_id"), H.ahash64(W.letter_grid(F.col("text"), F.col("n_chars"))).alias("h"))
    before = d.select((F.col("asset_id") + 1).alias("asset_id"), F.col("h").alias("g"))
    return d.join(before, "asset_id").select("asset_id", H.hamming(F.col("h"), F.col("g")).cast("long").alias("distance"))


@query("clean_stem", with_views("""SELECT asset_id, regexp_replace(regexp_replace(lower(filename), '\\.[^.]*$', ''), ' \\(copy 1\\)', '') AS stem,
    replace(replace(filename, 'resized_', ''), 'dark_', '') AS base, NOT (starts_with(filename, 'dark_') OR starts_with(filename, 'resized_')) AS original FROM assets""", "assets"))
def clean_stem(spark, sf):
    f = F.col("filename")
    return W.assets(spark, sf).select("asset_id", X.clean_stem(f).alias("stem"), X.base_name(f).alias("base"), X.is_original_name(f).alias("original"))


@query("exact_groups", with_views("SELECT leader_id, id FROM exact", "exact"))
def exact_groups(spark, sf):
    return R.exact_groups(_plain(spark, sf))


MIXED = {
    "coded": """SELECT a.*, CASE WHEN width % 4 = 0 THEN NULL ELSE bits END AS code, row_number() OVER (ORDER BY created_at DESC, a.asset_id) AS pos,
        file_size || '|' || epoch_us(taken_at) || '|' || regexp_replace(regexp_replace(lower(filename), '\\.[^.]*$', ''), ' \\(copy 1\\)', '') AS fallback
        FROM assets a JOIN hashed h ON h.asset_id = a.asset_id WHERE NOT is_deleted""",
    "mixed_edges": """SELECT a.pos AS a, b.pos AS b FROM coded a JOIN coded b ON a.pos < b.pos
        AND CASE WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN a.code = b.code ELSE a.fallback = b.fallback END""",
    **scan_sql("mixed", "mixed_edges"),
}


@query("exact_groups_mixed", with_views(
    "SELECT x.asset_id AS leader_id, y.asset_id AS id FROM mixed_led JOIN coded x ON x.pos = leader JOIN coded y ON y.pos = member",
    "assets", "hashed", recursive=True, **MIXED))
def exact_groups_mixed(spark, sf):
    """Part of the items have no hash, part an upper-case one."""
    items = C.active(W.assets(spark, sf, p_hash=True))
    part = F.col("width") % 4
    return R.exact_groups(written(items.withColumn("p_hash", F.when(part == 1, F.upper("p_hash")).when(part != 0, F.col("p_hash")))))


@query("near_pairs", with_views("SELECT a_id, b_id, distance FROM close WHERE accepted", "worded", close=CLOSE))
def near_pairs(spark, sf):
    items, details = _items(spark, sf)
    out = R.near_pairs(items, R.exact_groups(items), details)
    return out.select("a_id", "b_id", F.col("distance").cast("long").alias("distance"))


@query("rule_trace", with_views(
    "SELECT a_id, b_id, " + ", ".join(f"{n}_rule" for n in RULES) + ", CASE WHEN accepted THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision FROM close",
    "worded", close=CLOSE))
def rule_trace(spark, sf):
    items, details = _items(spark, sf)
    rest = G.copy_items(items).join(R.exact_groups(items).select("id"), "id", "left_anti")
    out = P.rule_trace(R.with_details(P.near_items(rest, vocab.NEAR_RADIUS), details, P.NEAR_COLUMNS))
    return out.select("a_id", "b_id", *[f"{n}_rule" for n in RULES], "decision")


NAMED = "SELECT x.asset_id AS leader_id, y.asset_id AS id FROM {0}_led JOIN lone x ON x.pos = leader JOIN lone y ON y.pos = member"


@query("near_groups", with_views(NAMED.format("near"), "worded", recursive=True, **NEAR))
def near_groups(spark, sf):
    items, details = _items(spark, sf)
    return R.near_groups(items, written(R.exact_groups(items)), details)


DOCS = "coalesce(a.document_type, '') <> '' AND coalesce(b.document_type, '') <> ''"
COMMON = "len(list_filter({0}, lambda w: list_contains({1}, w)))"
SIMILAR = {
    "rest": "SELECT * FROM worded WHERE pos NOT IN (SELECT member FROM near_led)",
    "sides": f"""SELECT a.pos AS a, b.pos AS b, a.asset_id AS a_id, b.asset_id AS b_id, {D} AS d, a.scene AS scene, a.document_type AS dt, a.event_type AS ev, a.people_count AS pc,
        len(a.objs) > 0 AND len(b.objs) > 0 AS obj_known, list_filter(a.objs, lambda w: list_contains(b.objs, w))[1] AS obj,
        coalesce(a.scene, '') <> '' AND coalesce(b.scene, '') <> '' AS scenes,
        list_concat(a.cap, a.keys) AS wa, list_concat(b.cap, b.keys) AS wb, {DOCS} AND a.document_type = b.document_type AS same_doc,
        len(b.txt) > 0 AND {COMMON.format('a.txt', 'b.txt')} >= 2 AS same_text, abs(a.people_count - b.people_count) <= 1 AS people,
        coalesce(a.event_type = b.event_type, false) AS same_event, abs(epoch_us(a.taken_at) - epoch_us(b.taken_at)) / 1000000 AS seconds
        FROM rest a JOIN rest b ON a.pos < b.pos AND {D} <= 8
        WHERE NOT ({DOCS} AND a.document_type <> b.document_type AND a.document_type <> 'other' AND b.document_type <> 'other') AND {SCENE_OK}""",
    "weighed": f"""SELECT *, CASE WHEN NOT obj_known THEN 0.5 WHEN obj IS NOT NULL THEN 1.0 ELSE 0.1 END::DOUBLE AS o, CASE WHEN scenes THEN 1.0 ELSE 0.5 END::DOUBLE AS s,
        CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.5 WHEN {COMMON.format('wa', 'wb')} / len(list_distinct(list_concat(wa, wb))) >= 0.2 THEN 1.0
            WHEN {COMMON.format('wa', 'wb')} > 0 THEN 0.7 ELSE 0.3 END::DOUBLE AS k,
        CASE WHEN same_doc OR same_text THEN 1.0 ELSE 0.5 END::DOUBLE AS t, CASE WHEN people THEN 1.0 ELSE 0.2 END::DOUBLE AS p, CASE WHEN same_event THEN 1.0 ELSE 0.5 END::DOUBLE AS e FROM sides""",
    "summed": """SELECT *, CAST(floor((o * 0.35::DOUBLE + s * 0.25::DOUBLE + k * 0.20::DOUBLE + t * 0.10::DOUBLE + p * 0.05::DOUBLE + e * 0.05::DOUBLE) * 100 + 0.5) AS INT) AS consistency, list_filter([
        CASE WHEN obj_known AND obj IS NOT NULL THEN 'Depict matching ' || obj END, CASE WHEN scenes THEN scene || ' scene detected' END,
        CASE WHEN k = 1 THEN 'Matching caption descriptions' END, CASE WHEN same_doc THEN 'Same document type (' || dt || ')' END,
        CASE WHEN same_text THEN 'Matching OCR text' END, CASE WHEN people AND pc > 0 THEN 'Matching people count' END,
        CASE WHEN same_event THEN 'Matching ' || ev || ' event' END, CASE WHEN seconds <= 30 THEN 'Captured within ' || CAST(floor(seconds + 0.5) AS INT) || ' seconds' END], lambda r: r IS NOT NULL) AS reasons FROM weighed""",
    "alike_edges": """SELECT a, b, a_id, b_id, d AS distance, consistency, CAST(floor(0.5 * CASE WHEN d = 0 THEN 100 WHEN d <= 2 THEN 95 WHEN d <= 4 THEN 90 WHEN d <= 6 THEN 85 ELSE 80 END + 0.5 * consistency + 0.5) AS INT) AS confidence,
        'Grouped because: • ' || array_to_string(reasons, ' • ') AS explanation FROM summed WHERE consistency >= 40 AND len(reasons) > 0""",
}
SIMILAR_ALL = {**NEAR, **SIMILAR, **scan_sql("alike", "alike_edges")}


@query("similar_pairs", with_views("SELECT a_id, b_id, distance, consistency, confidence, explanation FROM alike_edges", "worded", recursive=True, **NEAR, **SIMILAR))
def similar_pairs(spark, sf):
    items, details = _items(spark, sf)
    exact = written(R.exact_groups(items))
    out = R.similar_pairs(items, exact, written(R.near_groups(items, exact, details)), details=details)
    return out.select("a_id", "b_id", F.col("distance").cast("long").alias("distance"), "consistency", "confidence", "explanation")


def _similar(spark, sf):
    items, details = _items(spark, sf)
    exact = written(R.exact_groups(items))
    return R.similar_groups(items, exact, written(R.near_groups(items, exact, details)), details)


@query("similar_groups", with_views(NAMED.format("alike"), "worded", recursive=True, **SIMILAR_ALL))
def similar_groups(spark, sf):
    return _similar(spark, sf)[0]


@query("similar_explained", with_views("""SELECT x.asset_id AS leader_id, max(confidence) AS confidence, first(explanation ORDER BY confidence DESC, b) AS explanation
    FROM alike_member m JOIN alike_edges e ON e.a = m.leader AND e.b = m.member JOIN lone x ON x.pos = m.leader GROUP BY x.asset_id""", "worded", recursive=True, **SIMILAR_ALL))
def similar_explained(spark, sf):
    return _similar(spark, sf)[1]


BEST = """SELECT leader_id, id, score, reasons FROM (
    SELECT *, row_number() OVER (PARTITION BY leader_id ORDER BY score DESC, created_at DESC, id) AS place FROM (
        SELECT e.leader_id, e.id, created_at, CASE WHEN original THEN 30 ELSE 0 END + CASE WHEN file_size = top THEN 20 WHEN file_size >= top * 0.95 THEN 10 ELSE 0 END + CASE WHEN taken_at = late THEN 5 ELSE 0 END AS score,
            CASE WHEN NOT original AND file_size < top * 0.95 THEN 'Largest file' ELSE array_to_string(list_filter([CASE WHEN original THEN 'Original (unprocessed)' END,
            CASE WHEN file_size = top THEN 'Highest resolution' WHEN file_size >= top * 0.95 THEN 'Near-highest resolution' END], lambda r: r IS NOT NULL), '|') END AS reasons
        FROM (SELECT *, NOT (starts_with(filename, 'dark_') OR starts_with(filename, 'resized_')) AS original, max(file_size) OVER (PARTITION BY leader_id) AS top, max(taken_at) OVER (PARTITION BY leader_id) AS late
            FROM exact JOIN items ON items.asset_id = exact.id) e)) WHERE place = 1"""


@query("keep_best", with_views(f"SELECT leader_id, id AS keep_id, score, reasons FROM ({BEST})", "exact"))
def keep_best(spark, sf):
    items = _plain(spark, sf)
    out = G.keep_best(G.group_members(R.exact_groups(items), items))
    return out.select("leader_id", "keep_id", "score", joined("reasons").alias("reasons"))


@query("group_savings", with_views("""SELECT leader_id, count(*) AS items, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum(file_size) - max(file_size) AS BIGINT) AS savings
    FROM exact JOIN items ON items.asset_id = exact.id GROUP BY leader_id""", "exact"))
def group_savings(spark, sf):
    items = _plain(spark, sf)
    return G.group_savings(G.group_members(R.exact_groups(items), items))


# --- classes of single items -----------------------------------------------------------------

IS_LOW = "(quality_grade IN ('POOR', 'VERY_POOR') OR (quality_grade = 'FAIR' AND overall_score < 0.45))"
IS_SHOT = "(contains(lower(filename), 'screenshot') OR contains(lower(caption), 'screenshot') OR coalesce(document_type, '') = 'screenshot')"
IS_DOC = "(coalesce(document_type, '') NOT IN ('', 'screenshot', 'receipt') OR coalesce(length(detected_text), 0) > 120)"
TEXT, CAPTION = "lower(coalesce(detected_text, ''))", "lower(coalesce(caption, ''))"
IS_RECEIPT = f"(coalesce(document_type, '') = 'receipt' OR {any_in(TEXT, vocab.RECEIPT_WORDS)})"
IS_ID = f"({any_in(TEXT, vocab.ID_TEXT_WORDS)} OR {any_in(CAPTION, vocab.ID_CAPTION_WORDS)})"


@query("low_quality", with_views(f"SELECT asset_id, quality_grade, overall_score FROM items WHERE {IS_LOW}", "items"))
def low_quality(spark, sf):
    return R.rank_low_quality(W.items(spark, sf)).select("asset_id", "quality_grade", "overall_score")


REVIEW = "CASE i " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.REVIEW_LABELS.items()) + " ELSE lower(replace(i, '_', ' ')) END"


@query("quality_reasons", with_views(f"""SELECT asset_id, array_to_string(CASE WHEN len(issues) > 0 THEN list_transform(issues, lambda i: {REVIEW}) ELSE list_filter([
    CASE WHEN sharpness < 0.3 THEN 'Low sharpness' END, CASE WHEN exposure < 0.3 THEN 'Poor exposure' END, CASE WHEN resolution < 0.2 THEN 'Low resolution' END], lambda r: r IS NOT NULL) END, '|') AS reasons FROM graded""", "graded"))
def quality_reasons(spark, sf):
    from albumetry.operators import quality as Q

    out = Q.assess(W.assets(spark, sf), W.provider_results(spark, sf), W.PROVIDERS)
    return out.select("asset_id", joined(QF.quality_reasons(F.col("issues"), F.col("sharpness_score"), F.col("exposure_score"), F.col("resolution_score"))).alias("reasons"))


@query("screenshots", with_views(f"SELECT asset_id, filename FROM items WHERE {IS_SHOT}", "items"))
def screenshots(spark, sf):
    return R.screenshots(W.items(spark, sf)).select("asset_id", "filename")


@query("documents_class", with_views(f"SELECT asset_id, document_type, coalesce(document_type, '') NOT IN ('', 'screenshot', 'receipt', 'other', 'unknown', 'none') OR coalesce(length(detected_text), 0) > 120 AS audit FROM items WHERE {IS_DOC}", "items"))
def documents_class(spark, sf):
    return R.documents(W.items(spark, sf)).select("asset_id", "document_type", R.is_document_item(True).alias("audit"))


@query("receipts", with_views(f"SELECT asset_id, document_type FROM items WHERE {IS_RECEIPT}", "items"))
def receipts(spark, sf):
    return R.receipts(W.items(spark, sf)).select("asset_id", "document_type")


@query("ids", with_views(f"SELECT asset_id, {IS_ID} AS strict, {any_in(TEXT, vocab.ID_AUDIT_WORDS)} OR {any_in(CAPTION, vocab.ID_AUDIT_WORDS)} AS audit FROM items", "items"))
def ids(spark, sf):
    """Both readings per active asset."""
    return W.items(spark, sf).select("asset_id", R.is_id_item().alias("strict"), R.is_id_item(True).alias("audit"))


def _class_totals(place: int, name: str, hit: str, freed: bool) -> str:
    size = f"coalesce(sum(file_size) FILTER ({hit}), 0)" if freed else "0"
    return f"SELECT {place} AS place, '{name}' AS category, count(*) FILTER ({hit}) AS entries, count(*) FILTER ({hit}) AS items, CAST({size} AS BIGINT) AS bytes FROM items"


SUMMARY = {
    "grouped": "SELECT 0 AS place, 'duplicates' AS category, leader_id, id FROM exact UNION ALL SELECT 1, 'near_duplicates', leader_id, id FROM near_named",
    "near_named": NAMED.format("near"),
    "freed": "SELECT place, category, leader_id, count(*) AS n, sum(file_size) - max(file_size) AS s FROM grouped JOIN items ON asset_id = id GROUP BY ALL",
    "summary": "SELECT * FROM (SELECT place, category, count(*) AS entries, CAST(sum(n) AS BIGINT) AS items, CAST(sum(s) AS BIGINT) AS bytes FROM freed GROUP BY ALL UNION ALL "
    + " UNION ALL ".join(
        _class_totals(i + 2, n, hit, i < 2)
        for i, (n, hit) in enumerate([("low_quality", IS_LOW), ("screenshots", IS_SHOT), ("documents", IS_DOC), ("receipts", IS_RECEIPT), ("ids", IS_ID)])
    ) + ") WHERE items > 0",
}
SUMMARY = {k: SUMMARY[k] for k in ("near_named", "grouped", "freed", "summary")}


def _summary(spark, sf):
    """(items without texts, items, exact groups, near groups, summary)."""
    narrow, items = _items(spark, sf)
    exact = written(R.exact_groups(narrow))
    near = written(R.near_groups(narrow, exact, items))
    return narrow, items, exact, near, R.category_summary(items, exact, near, narrow=narrow)


@query("category_summary", with_views("SELECT place, category, entries, items, bytes FROM summary", "worded", recursive=True, **NEAR, **SUMMARY))
def category_summary(spark, sf):
    return _summary(spark, sf)[4]


@query("recoverable_bytes", with_views("SELECT CAST(sum(bytes) AS BIGINT) AS recoverable_bytes FROM summary", "worded", recursive=True, **NEAR, **SUMMARY))
def recoverable_bytes(spark, sf):
    return R.recoverable_bytes(_summary(spark, sf)[4])


@query("distinct_recoverable_bytes", with_views(f"""SELECT CAST(sum(file_size) AS BIGINT) AS distinct_bytes FROM items WHERE {IS_LOW} OR {IS_SHOT} OR asset_id IN (
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY leader_id ORDER BY file_size DESC, created_at DESC, id) AS p FROM grouped JOIN items ON asset_id = id) WHERE p > 1)""",
    "worded", recursive=True, **NEAR, **SUMMARY))
def distinct_recoverable_bytes(spark, sf):
    narrow, items, exact, near, _ = _summary(spark, sf)
    return R.distinct_recoverable_bytes(items, exact, near, narrow)


@query("library_health", with_views("""
SELECT photos, review_items, round(review_items / photos, 6) AS review_ratio, CASE WHEN review_items / photos > 0.30 THEN 'Requires Cleanup' WHEN review_items / photos > 0.10 THEN 'Needs Attention' ELSE 'Great' END AS health,
    CASE WHEN low >= dup AND low >= near THEN 'Most recoverable space comes from Low Quality Photos.' WHEN dup > 0 AND dup >= total * 0.35 THEN 'Exact Duplicates account for nearly 40% of recoverable storage.'
        WHEN shots > 0 AND shots <= photos * 0.02 THEN 'Screenshots make up only a small portion of your library.' ELSE 'Reviewing duplicate photos first will free the most storage.' END AS insight, biggest_opportunity
FROM (SELECT CAST(sum(entries) AS BIGINT) AS review_items, sum(bytes) AS total, coalesce(sum(bytes) FILTER (category = 'low_quality'), 0) AS low, coalesce(sum(bytes) FILTER (category = 'duplicates'), 0) AS dup,
    coalesce(sum(bytes) FILTER (category = 'near_duplicates'), 0) AS near, coalesce(sum(items) FILTER (category = 'screenshots'), 0) AS shots,
    first(category ORDER BY bytes DESC, place) FILTER (place <= 3) AS biggest_opportunity FROM summary), (SELECT count(*) AS photos FROM items)""", "worded", recursive=True, **NEAR, **SUMMARY))
def library_health(spark, sf):
    narrow, _, _, _, summary = _summary(spark, sf)
    return R.library_health(summary, narrow)


# --- analytics --------------------------------------------------------------------------------

@query("overview", with_views(f"""SELECT count(*) FILTER (NOT is_deleted) AS photos, CAST(sum(file_size) FILTER (NOT is_deleted) AS BIGINT) AS bytes,
    count(*) FILTER (NOT is_deleted AND asset_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS favourites,
    count(*) FILTER (NOT is_deleted AND {NOW} - created_at <= INTERVAL 30 DAY) AS added_30_days, count(*) FILTER (NOT is_deleted AND {NOW} - created_at <= INTERVAL 7 DAY) AS added_7_days,
    count(*) FILTER (is_deleted) AS deleted, CAST(8 AS BIGINT) AS collections FROM assets""", "assets"))
def overview(spark, sf):
    fav = W.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("asset_id"), F.lit(True).alias("is_favourite"))
    return A.overview(W.assets(spark, sf).join(fav, "asset_id", "left"), W.at(W.NOW))


CLASSES = {
    "sets": "SELECT bits, first(asset_id ORDER BY created_at DESC, asset_id) AS head, min(pos) AS pos FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, asset_id) AS pos FROM items) GROUP BY bits",
    "touch": f"SELECT a.pos AS a, b.pos AS b FROM sets a JOIN sets b ON a.pos < b.pos AND {D} <= 4",
    **scan_sql("dup", "touch"),
    "dups": """SELECT coalesce(m.leader, s.pos) AS leader, i.file_size FROM items i JOIN sets s ON s.bits = i.bits LEFT JOIN dup_member m ON m.member = s.pos""",
    "dup_sets": "SELECT leader, count(*) AS n, sum(file_size) - max(file_size) AS s FROM dups GROUP BY leader HAVING count(*) > 1",
}


@query("duplicate_totals", with_views("SELECT count(*) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_count, CAST(sum(s) AS BIGINT) AS duplicate_savings FROM dup_sets", "items", recursive=True, **CLASSES))
def duplicate_totals(spark, sf):
    return A.duplicate_totals(_plain(spark, sf))


A_LOW = "(quality_grade IN ('POOR', 'VERY_POOR') OR (quality_grade = 'FAIR' AND list_has_any(issues, ['MOTION_BLUR', 'OUT_OF_FOCUS', 'LOW_RESOLUTION'])))"


@query("potential_savings", with_views(f"""SELECT *, duplicate_savings + low_quality_bytes AS potential_savings FROM (SELECT count(*) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_count, CAST(sum(s) AS BIGINT) AS duplicate_savings FROM dup_sets),
    (SELECT CAST(sum(file_size) AS BIGINT) AS low_quality_bytes FROM items WHERE {A_LOW})""", "items", recursive=True, **CLASSES))
def potential_savings(spark, sf):
    return A.potential_savings(_items(spark, sf)[0])


@query("analytics_low_quality", with_views(f"SELECT asset_id, quality_grade FROM items WHERE {A_LOW}", "items"))
def analytics_low_quality(spark, sf):
    return A.low_quality(W.items(spark, sf)).select("asset_id", "quality_grade")


@query("analytics_documents", with_views("SELECT asset_id, document_type FROM items WHERE coalesce(document_type, '') NOT IN ('', 'screenshot') OR coalesce(length(detected_text), 0) > 50", "items"))
def analytics_documents(spark, sf):
    return A.documents(W.items(spark, sf)).select("asset_id", "document_type")


@query("format_breakdown", with_views("""SELECT CASE regexp_extract(filename, '\\.([^.]*)$', 1) WHEN 'jpg' THEN 'JPEG' WHEN 'png' THEN 'PNG' WHEN 'webp' THEN 'WEBP' WHEN 'mp4' THEN 'Videos' ELSE 'Other' END AS format, count(*) AS items
    FROM assets WHERE NOT is_deleted GROUP BY ALL""", "assets"))
def format_breakdown(spark, sf):
    return A.format_breakdown(C.active(W.assets(spark, sf)))


@query("capacity", with_views(f"""SELECT CAST(sum(file_size) AS BIGINT) AS used_bytes, round(least(100.0, greatest(0.5, sum(file_size) / {vocab.CAPACITY_BYTES} * 100)), 6)::DOUBLE AS used_percentage,
    CAST(greatest(0, {vocab.CAPACITY_BYTES} - sum(file_size)) AS BIGINT) AS remaining_bytes FROM assets WHERE NOT is_deleted""", "assets"))
def capacity(spark, sf):
    return A.capacity(C.active(W.assets(spark, sf)))


@query("cache_estimate", with_views("SELECT count(*) * 15360 AS cache_bytes FROM assets WHERE NOT is_deleted", "assets"))
def cache_estimate(spark, sf):
    return A.cache_estimate(C.active(W.assets(spark, sf)))


# --- audits -------------------------------------------------------------------------------------

def _hashed(spark, sf):
    return W.assets(spark, sf, p_hash=True).withColumn("p_hash", F.when(F.col("status") != "FAILED", F.col("p_hash")).otherwise(F.lit("zz")))


@query("hash_population", with_views("SELECT count(*) AS assets, count(*) AS with_hash, count(*) FILTER (status <> 'FAILED') AS valid_hash FROM assets", "assets"))
def hash_population(spark, sf):
    """Failed assets carry a broken hash."""
    return U.hash_population(_hashed(spark, sf))


@query("hamming_histogram")
def hamming_histogram(spark, sf):
    return U.hamming_histogram(_hashed(spark, sf))


BASES = "SELECT replace(replace(filename, 'resized_', ''), 'dark_', '') AS base, a.asset_id, bits FROM assets a JOIN hashed h ON h.asset_id = a.asset_id WHERE status <> 'FAILED'"


@query("edit_pair_distances", with_views(f"""SELECT CASE WHEN d = 0 THEN '0' WHEN d <= 4 THEN '1-4' WHEN d <= 15 THEN '5-15' ELSE '>15' END AS bucket, count(*) AS pairs
    FROM (SELECT {D} AS d FROM bases a JOIN bases b ON a.base = b.base AND a.asset_id < b.asset_id) GROUP BY ALL""", "assets", "hashed", bases=BASES))
def edit_pair_distances(spark, sf):
    return U.edit_pair_distances(_hashed(spark, sf))


@query("cross_image_pairs", with_views(f"""SELECT least(a.h, b.h) AS low_hash, greatest(a.h, b.h) AS high_hash, {D} AS distance, count(*) AS cross_pairs
    FROM named a JOIN named b ON a.asset_id < b.asset_id AND {D} BETWEEN 1 AND 4 AND a.base <> b.base GROUP BY ALL""", "assets", "hashed", bases=BASES,
    named="SELECT bases.*, p_hash AS h FROM bases JOIN hashed USING (asset_id)"))
def cross_image_pairs(spark, sf):
    a, b = H.bits_hex(F.col("code_a")), H.bits_hex(F.col("code_b"))
    return U.cross_image_pairs(_hashed(spark, sf)).select(
        F.least(a, b).alias("low_hash"), F.greatest(a, b).alias("high_hash"), F.col("distance").cast("long").alias("distance"), "cross_pairs")


@query("null_rates", with_views("""SELECT count(*) AS records, count(*) FILTER (coalesce(caption, '') = '') AS empty_caption, count(*) FILTER (len(objects) = 0) AS empty_objects,
    count(*) FILTER (coalesce(scene, '') = '') AS empty_scene, count(*) FILTER (len(keyword_keys) = 0) AS empty_keywords FROM records""", "records"))
def null_rates(spark, sf):
    return U.null_rates(W.records(spark, sf))


COVERED = ["ing", "beach", "screen", "ou"]


@query("tag_coverage", with_views("\nUNION ALL ".join(f"""SELECT '{w}' AS word, count(*) FILTER (o) AS in_objects, count(*) FILTER (c) AS in_caption, count(*) FILTER (k) AS in_keywords, count(*) FILTER (o OR c OR k) AS tagged,
    count(*) FILTER (contains(lower(filename), '{w}') AND NOT (o OR c OR k)) AS name_only FROM (SELECT filename, len(list_filter(objects, lambda x: contains(lower(x), '{w}'))) > 0 AS o,
    contains(lower(caption), '{w}') AS c, len(list_filter(keyword_keys, lambda x: contains(lower(x), '{w}'))) > 0 AS k FROM items)""" for w in COVERED), "items"))
def tag_coverage(spark, sf):
    return U.tag_coverage(W.items(spark, sf), COVERED)


@query("class_funnel", with_views("\nUNION ALL ".join(f"SELECT '{c}' AS category, '{s}' AS stage, count(*) FILTER ({hit}) AS items FROM items" for c, s, hit in [
    ("documents", "type", f"coalesce(document_type, '') NOT IN {one_of(['', 'screenshot', 'receipt', *vocab.NOT_A_DOCUMENT_TYPE])}"),
    ("documents", "text", "length(detected_text) > 120"),
    ("documents", "returned", f"coalesce(document_type, '') NOT IN {one_of(['', 'screenshot', 'receipt', *vocab.NOT_A_DOCUMENT_TYPE])} OR length(detected_text) > 120"),
    ("receipts", "type", "document_type = 'receipt'"), ("receipts", "text", any_in(TEXT, vocab.RECEIPT_WORDS)), ("receipts", "returned", IS_RECEIPT),
    ("ids", "returned", f"{any_in(TEXT, vocab.ID_AUDIT_WORDS)} OR {any_in(CAPTION, vocab.ID_AUDIT_WORDS)}"),
    ("screenshots", "filename", "contains(lower(filename), 'screenshot')"), ("screenshots", "caption", "contains(lower(caption), 'screenshot')"),
    ("screenshots", "type", "document_type = 'screenshot'"), ("screenshots", "returned", IS_SHOT)]), "items"))
def class_funnel(spark, sf):
    return U.class_funnel(W.items(spark, sf))


@query("group_funnel")
def group_funnel(spark, sf):
    return U.group_funnel(*_items(spark, sf))


# --- life cycles ---------------------------------------------------------------------------------

STATES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.LIFECYCLE_STATES.items()) + " END"
ANALYSIS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.ANALYSIS_STATES.items()) + " END"


ASSET_STATUS = f"""
WITH e AS (SELECT user_id AS asset_id, event_id AS seq, {STATES} AS state, CASE WHEN event_type = 'error' THEN 'failed with ' || props END AS error FROM events),
since AS (SELECT * FROM e WHERE seq >= coalesce((SELECT max(seq) FROM e r WHERE r.asset_id = e.asset_id AND r.state = 'UPLOADED'), 0)),
fin AS (SELECT asset_id, bool_or(state = 'READY') AS done, last(state ORDER BY seq) AS state, last(error ORDER BY seq) AS error FROM since GROUP BY asset_id)
SELECT asset_id, CASE WHEN done THEN 'READY' ELSE state END AS status, CASE WHEN NOT done AND state = 'FAILED' THEN error END AS error_message FROM fin"""


@query("asset_lifecycle", ASSET_STATUS)
def asset_lifecycle(spark, sf):
    return J.asset_lifecycle(W.status_events(spark, sf, W.LIFECYCLE_STATES))


ANALYSIS_STATUS = f"""
WITH e AS (SELECT user_id AS asset_id, event_id AS seq, {ANALYSIS} AS state, CASE WHEN event_type = 'error' THEN 'failed with ' || props END AS error FROM events)
SELECT asset_id, last(state ORDER BY seq) AS status, count(*) FILTER (state = 'FAILED') AS retry_count, last(error ORDER BY seq) FILTER (state = 'FAILED') AS error_message FROM e GROUP BY asset_id"""


@query("analysis_lifecycle", ANALYSIS_STATUS)
def analysis_lifecycle(spark, sf):
    return J.analysis_lifecycle(W.status_events(spark, sf, W.ANALYSIS_STATES))


def _streamed(spark, sf, states, job):
    """Last row per asset of a life-cycle job that runs over the events as a stream, as far as they are there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    schema = W.table(spark, sf, "events").schema
    # as a pattern: a stream's path must else be a folder
    events = W.status_of(spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet"), states)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    job(events).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}/state").trigger(
        availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    values = [c for c in rows.columns if c not in ("asset_id", "batch")]
    return rows.groupBy("asset_id").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("asset_id", "v.*")


@query("stream_asset_lifecycle", ASSET_STATUS)
def stream_asset_lifecycle(spark, sf):
    return _streamed(spark, sf, W.LIFECYCLE_STATES, J.stream_asset_lifecycle)


@query("stream_analysis_lifecycle", ANALYSIS_STATUS)
def stream_analysis_lifecycle(spark, sf):
    return _streamed(spark, sf, W.ANALYSIS_STATES, J.stream_analysis_lifecycle)


@query("stream_dedupe", """SELECT DISTINCT user_id || '/' || event_type AS file_hash FROM events
WHERE user_id || '/' || event_type NOT IN (SELECT user_id || '/' || event_type FROM events WHERE value > 99)""")
def stream_dedupe(spark, sf):
    """Events as a stream of uploads, named by user and type; those of high value stand for the catalog."""
    name = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("file_hash")
    schema = W.table(spark, sf, "events").schema
    known = W.table(spark, sf, "events").filter("value > 99").select(name).distinct()
    rows = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet").select(name, F.col("ts").cast("timestamp").alias("ts"))
    out = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    J.stream_dedupe(rows, "ts", "60 days", known).writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("file_hash")
