"""Declared schemas of the catalog tables."""

TABLES = {
    "media_assets": (
        "asset_id string, filename string, mime_type string, media_type string, original_path string, "
        "thumbnail_path string, file_size long, file_hash string, status string, error_message string, "
        "taken_at timestamp, created_at timestamp, updated_at timestamp, is_deleted boolean, "
        "deleted_at timestamp, deleted_from string"
    ),
    "photo_metadata": (
        "asset_id string, width int, height int, camera_make string, camera_model string, "
        "exposure_time string, f_number string, iso_speed int, gps_latitude double, gps_longitude double"
    ),
    "media_embeddings": "asset_id string, model_name string, vector_dimension int, created_at timestamp",
    "vectors": "asset_id string, model_name string, embedding array<float>",
    "image_ai_analysis": (
        "asset_id string, processing_status string, model_name string, model_version string, caption string, "
        "detailed_description string, scene string, objects array<string>, activities array<string>, "
        "indoor_outdoor string, is_indoor boolean, weather string, season string, "
        "dominant_colors array<string>, people_count int, detected_text string, document_type string, "
        "event_type string, travel_event boolean, location_guess string, mood string, "
        "keyword_tags array<string>, keyword_keys array<string>, metrics map<string,string>, "
        "p_hash string, hash_kind string, ai_confidence double, raw_response string, retry_count int, "
        "error_message string, processed_at timestamp, analysis_timestamp timestamp"
    ),
    "image_quality_assessments": (
        "asset_id string, overall_score double, quality_grade string, sharpness_score double, "
        "blur_score double, exposure_score double, brightness_score double, aesthetic_score double, "
        "resolution_score double, confidence double, issues array<string>, recommendation string, "
        "provider_versions map<string,string>, evaluated_at timestamp"
    ),
}
