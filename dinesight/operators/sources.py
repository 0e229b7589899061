"""Candidate menu sources: discovery over stored pages, ranking, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.functions import urls as u
from dinesight.functions.literals import contains_any, ends_with_any, lookup, text_array
from dinesight.functions.text import (
    fold_accents, has_value, norm_locality, score_page_text, words)
from dinesight.operators.common import keep_first
from dinesight.vocab import web

_SEARCH_KINDS = ("allergen", "menu_pdf", "website")


def search_queries(restaurants: DataFrame, kind: str) -> DataFrame:
    """Ordered distinct query strings per restaurant for an outside search job."""
    if kind not in _SEARCH_KINDS:
        raise ValueError(f"kind must be one of {_SEARCH_KINDS}")
    name, address, site = F.col("name"), F.col("address"), F.col("website_url")
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    city, region = F.get(parts, F.lit(1)), u.region_token(u.home_country(address, site))
    if kind == "allergen":
        queries = u.allergen_queries(u.host(site), name, city, region)
    elif kind == "menu_pdf":
        queries = u.menu_pdf_queries(name, city, region)
    else:
        queries = u.website_recovery_queries(name, address, F.col("phone_number"), F.col("categories"))
    return restaurants.select("restaurant_id", F.posexplode(queries).alias("query_ord", "query"))


def seed_urls(restaurants: DataFrame) -> DataFrame:
    """The given URL, plus the site root when the URL is a deeper page."""
    site = F.col("website_url")
    root = F.concat(F.regexp_extract(site, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.lit("://"), u.netloc(site), F.lit("/"))
    deeper = F.length(F.regexp_replace(u.url_path(site), "^/+|/+$", "")) > 0
    seeds = F.array_distinct(F.array_compact(F.array(site, F.when(deeper, root))))
    return restaurants.where(has_value(site)).select("restaurant_id", F.posexplode(seeds).alias("seed_ord", "seed_url"))


def probe_urls(restaurants: DataFrame) -> DataFrame:
    """Site root joined to each fixed allergen page and PDF path."""
    site = F.col("website_url")
    root = F.concat(F.regexp_extract(site, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.lit("://"), u.netloc(site))
    paths = F.explode(text_array(web.ALLERGEN_PROBE_PATHS + web.ALLERGEN_PDF_PATHS)).alias("path")
    return (restaurants.where(has_value(site)).select("restaurant_id", root.alias("_root"), paths)
            .select("restaurant_id", F.concat("_root", "path").alias("probe_url")))


def link_kind(url: Column, anchor: Column) -> Column:
    """First link kind whose words occur in the raw or accent-folded link."""
    raw = F.lower(F.concat(url, F.lit(" "), F.coalesce(anchor, F.lit(""))))
    both = F.concat(raw, F.lit("\n"), fold_accents(raw))
    kind = None
    for name, tokens in web.LINK_KINDS:
        hit = contains_any(both, tokens)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


def classify_links(links: DataFrame) -> DataFrame:
    """Links of a menu-relevant kind, with that kind."""
    return links.withColumn("kind", link_kind(F.col("url"), F.col("anchor"))).where(F.col("kind").isNotNull())


def dedupe_sources(sources: DataFrame, ordinal: str) -> DataFrame:
    """Highest confidence per restaurant and canonical URL, first row on ties."""
    keyed = sources.withColumn("canonical", u.canonical_url(F.col("url")))
    return keep_first(keyed, ["restaurant_id", "canonical"], [F.desc("confidence"), F.asc(ordinal)])


def sources_by_confidence(sources: DataFrame, ordinal: str, limit: int = 25) -> DataFrame:
    """The most confident candidates of every restaurant."""
    return keep_first(sources, ["restaurant_id"], [F.desc("confidence"), F.asc(ordinal)], limit, rank="position")


def collapse_dated_reuploads(candidates: DataFrame, ordinal: str) -> DataFrame:
    """Only the newest copy of a dated PDF; everything else passes through."""
    recency = u.source_recency(F.col("url"))
    marked = candidates.withColumn("_recency", recency).withColumn(
        "_eligible", u.is_pdf_url(F.col("url")) & (F.col("_recency") > 0))
    # Rows that may not collapse keep a key of their own.
    keyed = marked.withColumn("_key", F.when(F.col("_eligible"), u.dated_duplicate_key(F.col("url"))).otherwise(
        F.concat(F.lit("row:"), F.col(ordinal).cast("string"))))
    return keep_first(keyed, ["restaurant_id", "_key"], [F.desc("_recency"), F.asc(ordinal)]).drop("_recency", "_eligible", "_key")


def finalize_candidates(candidates: DataFrame, ordinal: str, limit: int = 12) -> DataFrame:
    """Best kind per URL, re-uploads collapsed, ordered and capped per restaurant."""
    priority = lookup(F.col("kind"), web.KIND_PRIORITY)
    ranked = candidates.withColumn("kind_rank", priority)
    best = keep_first(ranked, ["restaurant_id", "url"], [F.asc("kind_rank"), F.asc(ordinal)])
    deduped = collapse_dated_reuploads(best, ordinal)
    order = [F.asc("kind_rank"), F.asc((~u.is_pdf_url(F.col("url"))).cast("int")),
             F.desc(u.source_recency(F.col("url"))), F.asc(ordinal)]
    return keep_first(deduped, ["restaurant_id"], order, limit, rank="position")


def rank_sources(sources: DataFrame, ordinal: str, limit: int) -> DataFrame:
    """Provenance first, then recency; foreign sources last but kept."""
    url = F.col("url")
    marked = sources.withColumn("provenance", u.provenance_rank(url, F.col("official_domain"), F.col("home"))) \
        .withColumn("recency", u.source_recency(url))
    return keep_first(marked, ["restaurant_id"], [F.asc("provenance"), F.desc("recency"), F.asc(ordinal)], limit, rank="position")


def web_candidates(results: DataFrame, kind: str = "allergen", limit: int = 8) -> DataFrame:
    """Search hits that are documents of the wanted kind, deduped and ranked.

    Expects restaurant_id, query_ord, result_ord, url, title, official_domain, home.
    """
    url = F.col("url")
    hay = F.lower(F.concat(url, F.lit(" "), F.coalesce(F.col("title"), F.lit(""))))
    pdf = u.is_pdf_url(url)
    wanted = pdf if kind == "menu" else pdf | hay.contains("allerg") | hay.contains("nutrition")
    hits = results.where(wanted).withColumn("found_by", F.when(pdf, "pdf").otherwise("page"))
    order = F.struct("query_ord", "result_ord")
    first = keep_first(hits.withColumn("_ord", order), ["restaurant_id", "url"], [F.asc("_ord")])
    return rank_sources(first, "_ord", limit).drop("_ord")


def best_source_per_restaurant(sources: DataFrame, ordinal: str) -> DataFrame:
    """The source with the best grade, status, confidence and type."""
    grade = lookup(F.col("evidence_grade"), {"A": 5, "B": 4, "C": 3, "D": 2, "F": 1})
    status = lookup(F.col("validation_status"), {"validated": 3, "unvalidated": 2, "not_fetchable": 1})
    kind = lookup(F.col("source_type"), {"schema_org_menu": 6, "pdf": 5, "nutrition_or_allergen_page": 4,
                                         "website_link": 3, "ordering_page": 2, "image": 1})
    order = [F.desc(F.coalesce(c, F.lit(0))) for c in (grade, status)]
    order += [F.desc("confidence"), F.desc(F.coalesce(kind, F.lit(0))), F.asc(ordinal)]
    return keep_first(sources, ["restaurant_id"], order)


def filter_validated_sources(sources: DataFrame, include_ordering: bool = False, include_images: bool = False) -> DataFrame:
    """Opt-in types as asked; anything else must be validated and primary."""
    kind = F.col("source_type")
    return sources.where(F.when(kind == "ordering_page", F.lit(include_ordering)).when(kind == "image", F.lit(include_images))
                         .otherwise((F.col("validation_status") == "validated") & F.col("is_primary")))


def second_hop(candidates: DataFrame, link_graph: DataFrame, ordinal: str, pages: int = 3) -> DataFrame:
    """Documents and menu sub-pages one hop behind the best candidate pages.

    ``link_graph`` holds page_url, url, anchor, link_ord of the crawled pages.
    """
    page = u.bare_url(F.col("url"))
    followable = ~ends_with_any(F.regexp_replace(F.lower(F.col("url")), r"\?.*$", ""), [".pdf", *web.HOP_IMAGE_EXTENSIONS])
    eligible = candidates.where(followable).withColumn("_norm", page) \
        .withColumn("_hop", F.coalesce(lookup(F.col("kind"), web.HOP_PRIORITY), F.lit(9)))
    order = [F.asc("_hop"), F.asc(ordinal)]
    one_per_page = keep_first(eligible, ["restaurant_id", "_norm"], order)
    parents = keep_first(one_per_page, ["restaurant_id"], order, pages, rank="parent_rank").select(
        "restaurant_id", "kind", "parent_rank", F.col("url").alias("page_url"))
    low = F.regexp_replace(F.lower(F.col("url")), r"\?.*$", "")
    hay = F.lower(F.concat(F.col("url"), F.lit(" "), F.coalesce(F.col("anchor"), F.lit(""))))
    useful = link_graph.where(ends_with_any(low, [".pdf", *web.HOP_IMAGE_EXTENSIONS]) | contains_any(hay, web.SECOND_HOP_WORDS))
    children = parents.join(useful, "page_url").join(candidates.select("restaurant_id", "url").distinct(),
                                                     ["restaurant_id", "url"], "left_anti")
    return keep_first(children, ["restaurant_id", "url"], [F.asc("parent_rank"), F.asc("link_ord")])


def site_fallback_candidates(restaurants: DataFrame, candidates: DataFrame) -> DataFrame:
    """The site itself, for restaurants without any menu candidate."""
    site = F.col("website_url")
    usable = restaurants.where(has_value(site) & ~u.is_noise_website(site)).select("restaurant_id", site.alias("url"))
    with_menu = candidates.where("kind = 'menu'").select("restaurant_id").distinct()
    return (usable.join(with_menu, "restaurant_id", "left_anti")
            .join(candidates.select("restaurant_id", "url").distinct(), ["restaurant_id", "url"], "left_anti")
            .withColumn("kind", F.lit("menu")).withColumn("reason", F.lit("spa_fallback")))


def subdomain_seeds(links: DataFrame, restaurants: DataFrame, limit: int = 2) -> DataFrame:
    """Same-site subdomains whose label names the restaurant's locality."""
    base = u.registrable_domain(u.netloc(F.col("website_url")))
    segments = F.split(F.coalesce(F.col("address"), F.lit("")), ",")
    pieces = F.concat(F.transform(segments, lambda s: norm_locality(s)),
                      F.transform(F.split(F.regexp_replace(F.coalesce(F.col("address"), F.lit("")), ",", " "), r"\s+"),
                                  lambda w: norm_locality(w)))
    local = F.array_distinct(F.filter(pieces, lambda p: F.length(p) >= 4))
    homes = restaurants.select("restaurant_id", base.alias("base"), u.host(F.col("website_url")).alias("current"), local.alias("local"))
    hosted = links.select("restaurant_id", "link_ord", u.host(F.col("url")).alias("host"))
    label = norm_locality(F.expr("substring(host, 1, length(host) - length(base) - 1)"))
    joined = hosted.join(homes, "restaurant_id").where(
        (F.col("host") != F.col("current")) & (F.length("base") > 0) & F.col("host").endswith(F.concat(F.lit("."), F.col("base"))))
    marked = joined.withColumn("label", label).where(F.length("label") > 0)
    hit = F.exists("local", lambda t: (t == F.col("label")) | (
        (F.length(t) >= 6) & (F.col("label").contains(t) | t.contains(F.col("label")))))
    first = keep_first(marked.where(hit), ["restaurant_id", "host"], [F.asc("link_ord")])
    return keep_first(first, ["restaurant_id"], [F.asc("link_ord")], limit, rank="seed_rank").select(
        "restaurant_id", "seed_rank", F.concat(F.lit("https://"), "host", F.lit("/")).alias("seed_url"))


def source_budget(candidates: DataFrame, max_sources: int = 4, enough_items: int = 30, matrix_enough: int = 10) -> DataFrame:
    """Sources taken in priority order until their yield is enough.

    Expects restaurant_id, position (1..), url, kind, n_items, n_allergen,
    n_matrix. Allergen and nutrition sources are skipped once three allergen
    dishes are known. The fold sees the ranked candidates of one restaurant
    (see finalize_candidates, which bounds them by its own argument).
    """
    wanted = candidates.where("kind <> 'allergy_info'")
    rows = wanted.groupBy("restaurant_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "url", "kind", *[F.col(c).cast("bigint").alias(c) for c in ("n_items", "n_allergen", "n_matrix")]))).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("items"),
                     F.lit(0).cast("bigint").alias("allergen"), F.lit(0).cast("bigint").alias("matrix"),
                     F.expr("CAST(array() AS ARRAY<INT>)").alias("kept"))

    def step(state: Column, row: Column) -> Column:
        have = (state.allergen >= 3) | (state.matrix >= matrix_enough)
        done = ((state.taken >= max_sources) | (state.matrix >= matrix_enough) | (have & (state["items"] >= enough_items)))
        skip = done | (have & row.kind.isin("allergen", "nutrition"))
        taken = F.struct((state.taken + 1).alias("taken"), (state["items"] + row.n_items).alias("items"),
                         (state.allergen + row.n_allergen).alias("allergen"), (state.matrix + row.n_matrix).alias("matrix"),
                         F.concat(state.kept, F.array(row.position)).alias("kept"))
        return F.when(skip, state).otherwise(taken)

    folded = rows.select("restaurant_id", "rows", F.aggregate("rows", start, step).alias("s"))
    chosen = F.filter("rows", lambda r: F.array_contains(F.col("s.kept"), r.position))
    return folded.select("restaurant_id", F.inline(chosen))


def signal_pages(candidates: DataFrame, pages: DataFrame, limit: int = 2) -> DataFrame:
    """Up to two pages worth an allergy-signal read, PDFs excluded."""
    from dinesight.vocab.allergens import NUT_FREE_PAGE_WORDS
    joined = candidates.join(pages.select("url", "text", "source_type"), "url").where("source_type <> 'pdf'")
    narrative = F.col("kind").isin("allergy_info", "allergen", "nutrition")
    priority = F.when(narrative, 0).when(contains_any(F.lower("text"), NUT_FREE_PAGE_WORDS), 1)
    marked = joined.withColumn("priority", priority).where(F.col("priority").isNotNull()).drop("text")
    return keep_first(marked, ["restaurant_id"], [F.asc("priority"), F.asc("position")], limit, rank="signal_rank")


def needs_recovery(restaurants: DataFrame, items: DataFrame, thin: int = 8) -> DataFrame:
    """Restaurants with a thin menu, or whose used source names another city."""
    per_source = items.groupBy("restaurant_id", "menu_source_url").agg(F.count("*").alias("n"))
    joined = per_source.join(restaurants.select("restaurant_id", "name", "address"), "restaurant_id", "right")
    mismatch = u.menu_city_mismatch(F.col("menu_source_url"), F.col("address"), F.col("name"))
    return joined.groupBy("restaurant_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        F.coalesce(F.bool_or(mismatch), F.lit(False)).alias("city_mismatch")).withColumn(
        "needs_recovery", (F.col("n_items") < thin) | F.col("city_mismatch"))


def evaluate_website_candidates(restaurants: DataFrame, results: DataFrame) -> DataFrame:
    """Weighted evidence that a search hit is the restaurant's own site.

    ``results`` holds restaurant_id, url, title, description, page_text.
    """
    joined = results.join(restaurants.select("restaurant_id", "name", "address", "phone_number"), "restaurant_id")
    url, name, address = F.col("url"), F.col("name"), F.col("address")
    text = F.array_join(words(F.concat_ws(" ", "title", "description", "url", "page_text", u.host(url))), " ")
    marked = joined.withColumn("_text", text)
    text = F.col("_text")
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    street = F.trim(F.substring_index(F.coalesce(address, F.lit("")), ",", 1))
    number = F.regexp_extract(street, r"\b(\d{2,6})\b", 1)
    from dinesight.vocab.places import STREET_SUFFIXES
    street_words = F.filter(words(street, 4), lambda t: (t != number) & ~t.isin(STREET_SUFFIXES))
    area = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 2, 2), ", ")).otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    city_words = F.filter(words(area, 4), lambda t: ~t.isin("usa", "united", "states"))
    phone = F.regexp_replace(F.coalesce(F.col("phone_number"), F.lit("")), r"\D+", "")
    facts = marked.select(
        "*", u.name_match_score(name, text, url).alias("name_score"),
        ((F.length(number) > 0) & text.contains(number) & F.exists(street_words, lambda t: text.contains(t))).alias("address_match"),
        ((F.length(phone) >= 7) & F.regexp_replace(text, r"\D+", "").contains(F.expr("right(regexp_replace(coalesce(phone_number, ''), '[^0-9]+', ''), 7)"))).alias("phone_match"),
        u.domain_matches_name(name, url).alias("domain_match"),
        F.exists(city_words, lambda t: text.contains(t)).alias("city_match"),
        u.is_known_non_official(u.host(url)).alias("third_party"))
    score = (F.when(F.col("name_score") >= 0.8, 0.4).when(F.col("name_score") >= 0.55, 0.28).otherwise(0.0)
             + F.when(F.col("address_match"), 0.38).otherwise(0.0) + F.when(F.col("phone_match"), 0.42).otherwise(0.0)
             + F.when(F.col("domain_match"), 0.15).otherwise(0.0) + F.when(F.col("city_match"), 0.08).otherwise(0.0)
             + F.when(text.contains("official"), 0.04).otherwise(0.0))
    confidence = F.when(F.col("third_party") | ~u.is_http_url(url), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 3))
    rejection = (F.when(F.col("third_party"), "known third-party/listing host").when(~u.is_http_url(url), "not an HTTP URL")
                 .when(F.col("name_score") < 0.55, "restaurant name did not match enough")
                 .when(~F.col("domain_match"), "domain did not resemble restaurant name")
                 .when(~(F.col("address_match") | F.col("phone_match") | F.col("city_match")),
                       "no address/phone evidence for this location"))
    return facts.withColumn("confidence", confidence).withColumn("rejection", rejection).withColumn(
        "accepted", F.col("rejection").isNull() & (F.col("confidence") >= 0.62)).drop("_text")


def search_results_to_sources(results: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Search hits as candidate sources: site filter, score, thresholds."""
    joined = results.join(restaurants.select("restaurant_id", "name", "address"), "restaurant_id")
    url, text = F.col("url"), F.concat_ws(" ", "title", "description", "url")
    hint = F.coalesce(F.when(has_value(F.col("address")), F.col("address")), F.col("name"))
    normal = F.array_join(words(text), " ")
    name = F.col("name")
    score = (u.score_source_candidate(url, text, hint)["score"]
             + F.when(u.domain_matches_name(name, url), 0.1).otherwise(0.0)
             + F.when(u.name_match_score(name, normal, url) >= 0.55, 0.1).otherwise(0.0))
    kind, hostname = u.source_type(url, text), u.host(url)
    scored = joined.where(u.is_http_url(url) & u.official_host(hostname)).withColumn("source_type", kind).withColumn("_score", score)
    kept = scored.where(((F.col("source_type") != "ordering_page") | u.is_allowed_platform(hostname))
                        & ((F.col("_score") >= 0.25) | F.col("source_type").isin("pdf", "image")))
    confidence = F.round(F.least(F.col("_score") + 0.12, F.lit(1.0)), 3)
    return kept.withColumn("confidence", confidence).withColumn(
        "evidence_grade", u.evidence_grade(F.col("confidence"), F.lit("unvalidated"), F.col("source_type"))).withColumn(
        "is_primary", F.col("source_type").isin("pdf", "image") | F.array_join(words(F.concat(url, F.lit(" "), text)), " ").contains("menu")
    ).drop("_score")


def allergen_sources(results: DataFrame, restaurants: DataFrame, limit: int = 5) -> DataFrame:
    """Allergen documents of the first productive query of every restaurant."""
    sources = search_results_to_sources(results, restaurants)
    hay = F.lower(F.concat(F.col("url"), F.lit(" "), F.coalesce(F.col("title"), F.lit(""))))
    relevant = sources.where((F.col("source_type") == "nutrition_or_allergen_page") | hay.contains("allergen") | hay.contains("allergy"))
    first = relevant.groupBy("restaurant_id").agg(F.min("query_ord").alias("query_ord"))
    productive = relevant.join(first, ["restaurant_id", "query_ord"])
    return keep_first(dedupe_sources(productive, "result_ord"), ["restaurant_id"], [F.asc("result_ord")], limit, rank="position")


def page_scores(pages: DataFrame, text: Column) -> DataFrame:
    """Menu-likeness of every page's text."""
    return pages.withColumn("_s", score_page_text(text)).select("*", "_s.*").drop("_s")


def snippet_bundle(snippets: DataFrame, name: Column, limit: int = 6000) -> DataFrame:
    """Per restaurant, relevant distinct-URL snippets joined up to a length.

    Expects restaurant_id, url, snippet_ord, blob. Only snippets that can
    reach the output survive the budget, so no unbounded group is collected.
    """
    from dinesight.functions.text import mentions_entity
    from dinesight.operators.common import prefix_budget
    first = keep_first(snippets, ["restaurant_id", "url"], [F.asc("snippet_ord")])
    relevant = first.where(mentions_entity(F.col("blob"), name)).select(
        "restaurant_id", "snippet_ord", "url", F.substring("blob", 1, limit).alias("blob"))
    kept = prefix_budget(relevant, ["restaurant_id"], [F.asc("snippet_ord"), F.asc("url")], F.length("blob") + 1, limit)
    ordered = F.array_sort(F.collect_list(F.struct("snippet_ord", "url", "blob")))
    return kept.groupBy("restaurant_id").agg(ordered.alias("s")).select(
        "restaurant_id", F.substring(F.array_join("s.blob", " "), 1, limit).alias("bundle"),
        F.element_at("s.url", 1).alias("primary_url"), F.size("s").alias("n_snippets"))


