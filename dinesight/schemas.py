"""Schemas of provider dumps and of the library's own tables."""

from __future__ import annotations

OSM_DUMP = """elements ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE,
    center: STRUCT<lat: DOUBLE, lon: DOUBLE>, tags: MAP<STRING, STRING>>>, fetched_at STRING"""

GEOAPIFY_DUMP = """features ARRAY<STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, properties: STRUCT<
    name: STRING, formatted: STRING, distance: DOUBLE, categories: ARRAY<STRING>, website: STRING, phone: STRING,
    opening_hours: STRING, place_id: STRING, contact: STRUCT<website: STRING, phone: STRING>,
    datasource: STRUCT<raw: MAP<STRING, STRING>>>>>, fetched_at STRING"""

_HOURS = "STRUCT<weekdayDescriptions: ARRAY<STRING>, openNow: BOOLEAN>"
GOOGLE_DUMP = f"""places ARRAY<STRUCT<id: STRING, displayName: STRUCT<text: STRING>, formattedAddress: STRING,
    location: STRUCT<latitude: DOUBLE, longitude: DOUBLE>, rating: DOUBLE, userRatingCount: INT, priceLevel: STRING,
    primaryType: STRING, types: ARRAY<STRING>, websiteUri: STRING, nationalPhoneNumber: STRING, internationalPhoneNumber: STRING,
    businessStatus: STRING, currentOpeningHours: {_HOURS}, regularOpeningHours: {_HOURS},
    servesBreakfast: BOOLEAN, servesLunch: BOOLEAN, servesDinner: BOOLEAN, servesBrunch: BOOLEAN, servesVegetarianFood: BOOLEAN,
    servesBeer: BOOLEAN, servesWine: BOOLEAN, servesCocktails: BOOLEAN, servesDessert: BOOLEAN, servesCoffee: BOOLEAN,
    menuForChildren: BOOLEAN, takeout: BOOLEAN, delivery: BOOLEAN, dineIn: BOOLEAN, curbsidePickup: BOOLEAN,
    reservable: BOOLEAN>>, fetched_at STRING"""

RESTAURANT = """name STRING, address STRING, latitude DOUBLE, longitude DOUBLE, distance_meters DOUBLE, rating DOUBLE,
    review_count INT, price_level STRING, categories ARRAY<STRING>, website_url STRING, phone_number STRING,
    opening_hours STRING, business_status STRING, is_open_now BOOLEAN, service_options MAP<STRING, BOOLEAN>,
    source_last_updated STRING, data_quality_score DOUBLE, source_name STRING, source_id STRING, fetched_at STRING,
    raw_payload STRING"""

MENU_SOURCE = """restaurant_name STRING, restaurant_source_id STRING, website_url STRING, candidate_url STRING,
    source_type STRING, link_text STRING, confidence DOUBLE, evidence_grade STRING, reason STRING,
    is_primary_menu_candidate BOOLEAN, validation_status STRING, validation_reason STRING, fetched_at STRING,
    raw_payload STRING"""

MENU_TEXT = """restaurant_name STRING, restaurant_source_id STRING, menu_source_url STRING, source_type STRING,
    extraction_method STRING, char_count INT, price_count INT, dietary_terms ARRAY<STRING>,
    allergen_terms ARRAY<STRING>, fetched_at STRING, extracted_text STRING"""

MENU_ITEM = """restaurant_name STRING, restaurant_source_id STRING, menu_source_url STRING, category STRING,
    item_name STRING, description STRING, price STRING, dietary_terms ARRAY<STRING>, allergen_terms ARRAY<STRING>,
    source_type STRING, extraction_method STRING, confidence DOUBLE, raw_text STRING, fetched_at STRING,
    matrix_allergen_columns ARRAY<STRING>, is_component BOOLEAN, parent_item STRING,
    cross_contact_terms ARRAY<STRING>"""

PROFILE_REQUEST = """severity STRING, crossContact STRING, nutTypes ARRAY<STRING>, diets ARRAY<STRING>,
    allergens ARRAY<STRUCT<allergen: STRING, severity: STRING, crossContact: STRING, nutTypes: ARRAY<STRING>>>"""

RUN_RESULT = """chain STRING, query STRING, home_country STRING, ok BOOLEAN, error STRING, resolved_name STRING,
    website STRING, address STRING, host STRING, regdomain STRING, tld STRING, n_candidates INT,
    cand_kinds MAP<STRING, INT>, cand_sources MAP<STRING, INT>, item_count INT, allergen_item_count INT,
    methods MAP<STRING, INT>, llm_calls INT, incomplete BOOLEAN, allergy_signals INT,
    coverage ARRAY<STRUCT<found: BOOLEAN, kind: STRING, interp: STRING, items: INT, conf: DOUBLE, reason: STRING, host: STRING>>,
    source_hosts MAP<STRING, INT>, sample_items ARRAY<STRING>, elapsed_s DOUBLE"""

EVIDENCE = """restaurant_name STRING, menu_items ARRAY<STRUCT<candidate_id: STRING, is_menu_item: BOOLEAN, category: STRING,
    item_name: STRING, description: STRING, price: STRING, currency: STRING, dietary_tags: ARRAY<STRING>,
    allergen_mentions: ARRAY<STRING>, modification_options: ARRAY<STRING>, evidence_quote: STRING, source_url: STRING,
    source_type: STRING, extraction_method: STRING, rule_parser_confidence: DOUBLE, raw_text: STRING,
    cleanup_notes: STRING, confidence: DOUBLE>>, restaurant_notes ARRAY<STRUCT<note_type: STRING, note_text: STRING,
    applies_to: ARRAY<STRING>, evidence_quote: STRING, source_url: STRING, confidence: DOUBLE>>"""
