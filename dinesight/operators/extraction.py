"""Text-to-table jobs over stored pages: links, lines, grids, JSON, regions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinesight.functions import urls as u
from dinesight.functions.literals import alternation, contains_any, ends_with_any, let, lookup, text_array
from dinesight.functions.text import (
    blank_to_empty, clean_text, dedupe_price, dedupe_text, drop_markup, extract_prices, has_value, item_confidence,
    looks_like_category, looks_like_item_name, is_negative_text, page_lines, price_count, schema_item_confidence,
    split_name_description, visible_text)
from dinesight.operators.common import keep_first
from dinesight.operators.evidence import fold_by_name
from dinesight.operators.tagging import chart_token, matched_terms
from dinesight.session import cut_lineage
from dinesight.vocab import allergens as av
from dinesight.vocab import places as pv
from dinesight.vocab import web

_REFERENCE = r"(?s)&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"


def decode_entities(c: Column) -> Column:
    """Character references decoded in one pass: all named ones of HTML 5, decimal and hexadecimal ones."""
    # The standard library's table; no-break spaces become plain ones.
    named = {f"&{name}": " " if value == "\u00a0" else value for name, value in html5.items() if name.endswith(";")}
    table = F.from_json(F.lit(json.dumps(named, ensure_ascii=False)), "map<string,string>")

    def one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#([0-9]+);$", 1).try_cast("int")
        hexadecimal = F.conv(F.nullif(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10).try_cast("int")
        code = F.coalesce(digits, hexadecimal)
        usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(code == 160, " ").when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(~piece.startswith("&") | (F.length(piece) < 3), piece).when(code.isNotNull(), char).otherwise(F.coalesce(F.try_element_at(table, piece), piece))

    return F.when(c.contains("&"), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), one), "")).otherwise(c)


def plain(html: Column) -> Column:
    """Text of a piece of markup."""
    return clean_text(decode_entities(drop_markup(html)))


def attribute(tag: Column, name: str) -> Column:
    """Attribute value of an opening tag, quoted either way or bare."""
    quoted = F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'[^']*'|[^\s>\"']+)", 1)
    single = F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*([^\s>\"']+)", 1)
    return F.when(F.length(quoted) > 0, quoted).when(F.length(single) > 0, single).otherwise(bare)


def blocks(html: Column, tag: str) -> Column:
    """Non-nested elements of one kind."""
    return F.regexp_extract_all(blank_to_empty(html), F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), F.lit(0))


# --- Links ---------------------------------------------------------------------------
def _anchors(html: Column) -> Column:
    tags = F.regexp_extract_all(blank_to_empty(html), F.lit(r"(?is)<a\s[^>]*>.*?(?:</a\s*>|(?=<a\s)|$)"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.trim(decode_entities(attribute(t, "href"))).alias("href"), t.alias("tag")))


def _distinct_by_url(rows: Column) -> Column:
    """First struct of every url of an array."""
    return let(rows, lambda r: F.filter(r, lambda x, i: F.array_position(r.url, x.url) == i + 1))


def extract_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Same-site or PDF links of each page, absolute, first per page."""
    base = F.col("url")
    usable = F.filter(_anchors(F.col("html")), lambda a: (F.length(a.href) > 0) & ~a.href.rlike("^(?:#|mailto:|tel:|javascript:)"))
    absolute = F.transform(usable, lambda a: F.struct(
        F.regexp_replace(u.resolve_url(base, a.href), "#.*$", "").alias("url"), a.tag.alias("tag")))
    staged = pages.select(id_col, F.col("url").alias("page_url"), u.registrable_domain(u.netloc(base)).alias("_site"), absolute.alias("_links"))
    site = F.col("_site")

    def kept(link: Column) -> Column:
        name = u.host(link.url)
        same = (F.length(site) > 0) & ((name == site) | name.endswith(F.concat(F.lit("."), site)))
        return link.url.rlike("^https?://") & (same | u.is_pdf_url(link.url))

    return staged.select(id_col, "page_url", F.posexplode(_distinct_by_url(F.filter("_links", kept))).alias("link_ord", "l")).select(
        id_col, "page_url", "link_ord", "l.url", F.substring(plain(F.col("l.tag")), 1, 140).alias("anchor"))


def extract_social_links(pages: DataFrame, id_col: str = "page_id", limit: int = 6) -> DataFrame:
    """First distinct social-profile links of each page."""
    pattern = rf"(?i)(?:{alternation(web.PROFILE_LINK_HOSTS)})/"
    found = F.filter(_anchors(F.col("html")), lambda a: a.href.rlike(pattern))
    absolute = F.array_distinct(F.transform(found, lambda a: u.resolve_url(F.col("url"), a.href)))
    return pages.select(id_col, F.posexplode(F.slice(absolute, 1, limit)).alias("link_ord", "social_url"))


def image_candidates(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Images with a menu signal in source, text or surrounding tags, scored."""
    shots = F.regexp_extract_all("html", F.lit(r"(?is)(?:<(?!img\b)[a-z][^<>]*>\s*){0,4}<img\b[^>]*>"), F.lit(0))
    exploded = pages.select(id_col, F.col("url").alias("page_url"), F.posexplode(shots).alias("image_ord", "_shot"))
    tag = F.regexp_extract("_shot", r"(?is)(<img\b[^>]*>)$", 1)
    around = F.regexp_extract_all("_shot", F.lit(r"(?is)\b(?:id|class|role|aria-label|title)\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    src, alt = attribute(tag, "src"), F.trim(attribute(tag, "alt"))
    text = F.concat_ws(" ", F.when(F.length(alt) > 0, alt), F.array_join(around, " "))
    staged = exploded.select(id_col, "image_ord", u.resolve_url(F.col("page_url"), src).alias("url"), src.alias("_src"), text.alias("context"))
    path = F.lower(u.url_path(F.col("url")))
    label = F.when(has_value(F.col("context")), F.col("context")).otherwise(path)
    score = u.score_source_candidate(F.col("url"), label)["score"]
    return staged.where((F.length("_src") > 0) & u.is_http_url(F.col("url")) & ends_with_any(path, web.IMAGE_EXTENSIONS)
                        & u.has_strict_menu_signal(F.col("url"), label)).withColumn(
        "confidence", F.least(score, F.lit(1.0))).where("confidence > 0").withColumn("evidence_grade", F.lit("C")).drop("_src")


def image_menu_score(html: Column) -> Column:
    """Score of a page whose menu is images: contexts, tab anchors, sections."""
    def menu_word(texts: Column) -> Column:
        return F.size(F.filter(texts, lambda x: contains_any(F.lower(x), web.STRICT_MENU_WORDS)))

    images = menu_word(F.regexp_extract_all(html, F.lit(r"(?is)(?:<(?!img\b)[a-z][^<>]*>\s*){0,4}<img\b[^>]*>"), F.lit(0)))
    tabs = menu_word(F.transform(F.filter(_anchors(html), lambda a: a.href.startswith("#")), lambda a: a.tag))
    sections = F.regexp_count(html, F.lit(r"(?is)\bclass\s*=\s*[\"'](?:[^\"']*\s)?menu(?:\s[^\"']*)?[\"']"))
    return (F.when(images >= 3, 0.25).otherwise(0.0) + F.when(tabs >= 2, 0.12).otherwise(0.0)
            + F.when(sections > 0, 0.08).otherwise(0.0))


# --- Text ------------------------------------------------------------------------------
def visible_lines(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Cleaned non-empty visible lines with their ordinal."""
    lines = F.transform(page_lines(F.col("html")), lambda line: clean_text(decode_entities(line)))
    return pages.select(id_col, F.posexplode(lines).alias("line_ord", "line"))


def running_category(lines: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Carries the last section header of a page forward."""
    before = Window.partitionBy(id_col).orderBy("line_ord").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(looks_like_category(F.col("line")), F.substring("line", 1, 80))
    return lines.withColumn("category", F.coalesce(F.last(header, ignorenulls=True).over(before), F.lit("")))


_BARE = (r"(?iU)(?<![\w.$])(?<!(?:" + alternation(web.PRICE_PRECEDERS) + r")\s{0,8})(?:(?:[2-9]|[1-9]\d|1[0-6]\d|17[0-4])(?:\.\d{1,2})?|175(?:\.0{1,2})?)"
         r"(?![\w.])(?!\s{0,7}(?:\p{L}|-|‑|" + alternation(web.PRICE_FOLLOWERS) + "))")


def items_from_price_lines(lines: DataFrame, id_col: str = "page_id", allow_bare: bool = False) -> DataFrame:
    """Dish rows between prices, under the running category.

    ``lines`` holds the id, line_ord and line.
    """
    staged = running_category(lines, id_col).where(~looks_like_category(F.col("line")) & ~is_negative_text(F.col("line")))
    low = F.lower("line")
    bare_ok = ~contains_any(low, web.NON_MENU_PHRASES) & ~low.rlike(r"(?U)\b(?:fy|form|section)\s*\d")
    priced = F.regexp_count("line", F.lit(web.PRICE_PATTERN)) > 0

    def split_by(pattern: str) -> Column:
        return F.struct(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)).alias("prices"), F.split("line", pattern, -1).alias("pieces"))

    cut = F.when(priced, split_by(web.PRICE_PATTERN))
    if allow_bare:
        cut = cut.when(bare_ok, split_by(_BARE))
    trim = r"^[ \-:|]+|[ \-:|]+$"
    rows = staged.withColumn("_cut", cut).where("_cut IS NOT NULL").select(
        id_col, "line_ord", "category", F.col("_cut.pieces").alias("_pieces"), F.posexplode("_cut.prices").alias("price_ord", "_price"))
    piece, after = F.get("_pieces", F.col("price_ord")), F.get("_pieces", F.col("price_ord") + 1)
    segment = F.regexp_replace(F.concat(piece, "_price"), trim, "")
    before = F.regexp_replace(piece, trim, "")
    named = rows.select(id_col, "line_ord", "price_ord", "category", F.trim("_price").alias("price"), F.substring(segment, 1, 240).alias("raw_text"),
                        F.length(segment).alias("_size"), before.alias("_before"), F.substring(F.regexp_replace(after, trim, ""), 1, 120).alias("_after"))
    named = named.where(F.col("_size").between(5, 260) & (F.length("_before") > 0) & ~looks_like_category(F.col("_before")))
    named = named.withColumn("_s", split_name_description(F.col("_before"))).withColumns({
        "item_name": F.col("_s.name"), "description": F.when(F.length("_s.description") > 0, F.col("_s.description")).otherwise(F.col("_after"))})
    kept = named.where(looks_like_item_name(F.col("item_name"))).withColumn(
        "_key", F.concat_ws("\u0001", F.lower("item_name"), F.lower("price"), F.lower("raw_text")))
    first = keep_first(kept, [id_col, "_key"], [F.asc("line_ord"), F.asc("price_ord")])
    tagged = first.withColumns({"dietary_terms": matched_terms(F.col("raw_text"), av.DIETARY_TERMS),
                                "allergen_terms": matched_terms(F.col("raw_text"), av.ALLERGEN_TERMS, av.ALLERGEN_FALSE_FRIENDS)})
    has_terms = (F.size("dietary_terms") > 0) | (F.size("allergen_terms") > 0)
    return tagged.withColumn("confidence", item_confidence(F.col("category"), F.col("description"), has_terms)).drop(
        "_size", "_before", "_after", "_s", "_key")


def menu_text_records(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per page: visible characters, prices, dietary and allergen terms."""
    staged = pages.select(id_col, clean_text(visible_text(F.col("html"))).alias("text"))
    return staged.select(id_col, F.length("text").alias("char_count"), price_count(F.col("text")).alias("price_count"),
                         matched_terms(F.col("text"), av.DIETARY_TERMS).alias("dietary_terms"),
                         matched_terms(F.col("text"), av.ALLERGEN_TERMS, av.ALLERGEN_FALSE_FRIENDS).alias("allergen_terms"))


def chunk_text(docs: DataFrame, text: str, id_cols: Sequence[str], size: int = 24000, overlap: int = 400) -> DataFrame:
    """Overlapping windows over each whole text."""
    staged = docs.select(*id_cols, clean_text(F.col(text)).alias("_t"))
    starts = F.when(F.length("_t") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(size - overlap)))
    return staged.select(*id_cols, "_t", F.posexplode(starts).alias("chunk_ord", "_start")).select(
        *id_cols, "chunk_ord", F.col("_t").substr(F.col("_start") + 1, F.lit(size)).alias("chunk"))


def detect_source_region(text: Column, url: Column) -> Column:
    """Country of a document: its ccTLD, else the one clear winner of its tells."""
    def winner(low: Column) -> Column:
        domains = F.regexp_extract_all(low, F.lit(r"([a-z0-9][a-z0-9.\-]*\.[a-z]{2,})"), F.lit(1))
        votes = F.array_compact(F.transform(domains, lambda d: lookup(F.regexp_extract(d, r"\.([^.]*)$", 1), pv.CCTLD)))
        tells = F.array_compact(F.array(*[F.when(low.rlike(rx), code) for code, rx in pv.STRUCTURAL_TELLS.items()]))
        names = F.array_compact(F.array(*[F.when(contains_any(low, phrases), code) for code, phrases in pv.STRONG_NAMES.items()]))
        return let(F.concat(votes, F.array_intersect(names, F.array_union(votes, tells))), decide)

    def decide(votes: Column) -> Column:
        counts = F.transform(F.array_distinct(votes), lambda c: F.struct(F.size(F.filter(votes, lambda v: v == c)).alias("n"), c.alias("code")))
        return let(counts, lambda cs: let(F.filter(cs, lambda c: c.n == F.array_max(cs.n)), lambda best: F.when(F.size(best) == 1, F.get(best.code, F.lit(0)))))

    return F.coalesce(u.host_country(u.netloc(url)), let(F.lower(visible_text(blank_to_empty(text))), winner))


def endpoint_candidates(pages: DataFrame, id_col: str = "page_id", limit: int = 14) -> DataFrame:
    """Data-like URLs written in inline scripts, allergen and nutrition first."""
    scripts = F.filter(blocks(F.col("html"), "script"), lambda t: F.length(attribute(F.regexp_extract(t, r"(?is)^(<[^>]*>)", 1), "src")) == 0)
    body = F.array_join(F.transform(scripts, lambda t: F.regexp_replace(t, r"(?is)^<[^>]*>|</script\s*>$", "")), "\n")
    found = F.regexp_extract_all(body, F.lit(r"[\"'`](https?://[^\"'`\s]+|/[A-Za-z0-9_][^\"'`\s]{2,})[\"'`]"), F.lit(1))
    urls = F.array_distinct(F.transform(found, lambda h: u.resolve_url(F.col("url"), h)))

    def wanted(x: Column) -> Column:
        low = F.lower(x)
        return (x.rlike("^https?://") & ~ends_with_any(F.regexp_replace(low, r"\?.*$", ""), web.ENDPOINT_SKIP)
                & (contains_any(low, web.ENDPOINT_HINTS) | contains_any(low, web.ENDPOINT_HOSTS)))

    ranked = F.array_sort(F.transform(F.filter(urls, wanted), lambda x: F.struct(
        (~F.lower(x).rlike("allergen|nutrition")).cast("int").alias("rank"), x.alias("endpoint"))))
    return pages.select(id_col, F.posexplode(F.slice(ranked, 1, limit)).alias("endpoint_ord", "e")).select(id_col, "endpoint_ord", "e.endpoint")


# --- Allergen grids -----------------------------------------------------------------------
def _any_of(text: Column, values) -> Column:
    return contains_any(text, values)


def text_cell_marked(cell: Column) -> Column:
    """A plain-text grid cell marks its allergen as present."""
    raw = blank_to_empty(cell)
    norm = F.regexp_replace(F.lower(F.trim(raw)), r"^[ .•]+|[ .•]+$", "")
    negative = (F.length(norm) == 0) | norm.isin(av.CELL_NEGATIVE_WORDS)
    return F.when(negative, False).otherwise(
        norm.isin(av.CELL_POSITIVE_WORDS) | raw.rlike(f"[{av.CELL_POSITIVE_SYMBOLS}]")
        | (norm.contains("contain") & ~norm.rlike("not|no |free")))


def html_cell_marked(cell: Column) -> Column:
    """An HTML grid cell marks its allergen: word, symbol, image, class, icon or fill."""
    text = F.lower(plain(cell))
    norm = F.regexp_replace(text, r"^[ .•]+|[ .•]+$", "")
    opening = F.regexp_extract(cell, r"(?is)^(<[^>]*>)", 1)
    alts = F.lower(F.array_join(F.regexp_extract_all(cell, F.lit(r"(?is)<img\b[^>]*\balt\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)), "\n"))
    style = F.lower(attribute(opening, "style"))
    filled = style.contains("background") & ~_any_of(style, av.CELL_BLANK_FILLS)
    empty = F.length(norm) == 0
    return (F.when(norm.isin(av.CELL_POSITIVE_WORDS) | text.rlike(f"[{av.CELL_POSITIVE_SYMBOLS}]")
                   | (norm.contains("contain") & ~norm.rlike("not|no |free")), True)
            .when(~empty & norm.isin(av.CELL_NEGATIVE_WORDS), False)
            .otherwise(_any_of(alts, av.CELL_ALT_WORDS) | _any_of(F.lower(attribute(opening, "class")), av.CELL_CLASS_WORDS)
                       | (empty & (cell.rlike(r"(?is)<(?:svg|i)\b") | filled))))


def _grid_items(rows: DataFrame, id_cols: Sequence[str], name_text, marked) -> DataFrame:
    """Shared plan of both grids: header tokens, name column, marked cells.

    ``rows`` holds the ids, row_ord, header (texts), cells and category.
    """
    tokens = F.transform("header", lambda h: chart_token(h))
    staged = rows.withColumn("_tokens", tokens)
    columns = F.array_sort(F.array_distinct(F.array_compact("_tokens")))
    name_col = F.coalesce(F.array_min(F.filter(F.transform("_tokens", lambda t, i: F.when(t.isNull(), i)), lambda i: i.isNotNull())), F.lit(0))
    last_col = F.array_max(F.transform("_tokens", lambda t, i: F.when(t.isNotNull(), i)))
    staged = staged.withColumns({"matrix_allergen_columns": columns, "_name_col": name_col, "_needed": F.greatest(name_col, last_col)})
    staged = staged.where((F.size("matrix_allergen_columns") >= 3) & (F.size("cells") > F.col("_needed")))
    hits = F.filter(F.transform("_tokens", lambda t, i: F.when(t.isNotNull() & marked(F.get("cells", i)), t)), lambda t: t.isNotNull())
    named = staged.withColumn("item_name", name_text(F.get("cells", F.col("_name_col"))))
    return named.where(looks_like_item_name(F.col("item_name"))).select(
        *id_cols, "row_ord", "item_name", "category", F.array_sort(F.array_distinct(hits)).alias("allergen_terms"), "matrix_allergen_columns",
        F.lit("allergen_matrix").alias("extraction_method"), F.lit(0.9).alias("confidence"))


def own_tables(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id_col, table_ord, _table``: markup of every table, tables inside it left out; they are rows of their own.

    A page is cut at the tags of tables. Running sums give the depth of each piece (a stray end tag does not go below the page), and a
    piece belongs to the table that was opened last at its depth. A table without an end goes to the end of the page.
    """
    parts = F.split("html", r"(?i)(?=<table\b)|(?=</table\s*>)")
    pieces = pages.where(F.col("html").rlike(r"(?i)<table\b")).select(id_col, F.xxhash64("html").alias("_page"), F.posexplode(parts).alias("_i", "_piece"))
    order = Window.partitionBy(id_col, "_page").orderBy("_i")
    # The same page given twice is one page.
    pieces = pieces.withColumn("_again", F.lag("_i").over(order) == F.col("_i")).where(F.coalesce(~F.col("_again"), F.lit(True)))
    step = F.when(F.col("_piece").rlike(r"(?i)^<table\b"), 1).when(F.col("_piece").rlike(r"(?i)^</table"), -1).otherwise(0)
    pieces = pieces.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(order))
    pieces = pieces.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order)))
    opened = F.last(F.when(F.col("_step") == 1, F.col("_i")), ignorenulls=True).over(Window.partitionBy(id_col, "_page", "_depth").orderBy("_i"))
    inside = pieces.where("_depth > 0").withColumn("table_ord", opened).withColumn("_piece", F.regexp_replace("_piece", r"(?i)^</table\s*>", " "))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_piece"))), lambda p: p["_piece"]), "")
    return inside.groupBy(id_col, "_page", "table_ord").agg(joined.alias("_table")).drop("_page")


def allergen_grid_long(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Dish rows of HTML dish-by-allergen tables, one row per dish and page, also of tables inside tables."""
    tables = own_tables(pages, id_col)

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>.*?(?=<t[dh]\b|</tr|$)"), F.lit(0))

        def span(cell: Column) -> Column:
            value = attribute(F.regexp_extract(cell, r"(?is)^(<[^>]*>)", 1), "colspan").try_cast("int")
            return F.greatest(F.lit(1), F.least(F.lit(30), F.coalesce(value, F.lit(1))))

        return F.flatten(F.transform(found, lambda c: F.array_repeat(c, span(c))))

    table = F.col("_table")
    head_part = F.get(blocks(table, "thead"), F.lit(0))
    all_rows = blocks(table, "tr")
    head_rows = blocks(head_part, "tr")
    body = F.get(blocks(table, "tbody"), F.lit(0))
    header_row = F.coalesce(F.get(head_rows, F.lit(0)), F.get(all_rows, F.lit(0)))
    data_rows = F.when(body.isNotNull(), blocks(body, "tr")).otherwise(F.slice(all_rows, F.lit(2), F.greatest(F.size(all_rows) - 1, F.lit(0))))
    caption = F.substring(plain(F.coalesce(F.get(blocks(table, "caption"), F.lit(0)), F.lit(""))), 1, 80)
    rows = tables.select(id_col, "table_ord", caption.alias("category"), F.transform(cells(header_row), lambda c: plain(c)).alias("header"),
                         F.posexplode(data_rows).alias("row_ord", "_row")).withColumn("cells", cells(F.col("_row")))
    items = _grid_items(rows, [id_col, "table_ord"], plain, html_cell_marked)
    arrival = F.struct("table_ord", "row_ord")
    return fold_by_name(items.withColumn("arrival", arrival), keys=(id_col,), arrays=("allergen_terms", "matrix_allergen_columns"))


def text_grid_long(grids: DataFrame, id_col: str = "grid_id") -> DataFrame:
    """Same from tabulated grids: ``grid`` is array<array<string>>, header first."""
    clean = F.transform("grid", lambda row: F.transform(row, lambda c: clean_text(c)))
    staged = grids.select(id_col, clean.alias("_g")).where(F.size("_g") >= 2)
    rows = staged.select(id_col, F.get("_g", F.lit(0)).alias("header"), F.lit("").alias("category"),
                         F.posexplode(F.slice("_g", F.lit(2), F.size("_g") - 1)).alias("row_ord", "cells"))
    items = _grid_items(rows, [id_col], lambda c: F.trim(c), text_cell_marked)
    return keep_first(items.withColumn("_key", F.lower("item_name")), [id_col, "_key"], [F.asc("row_ord")]).drop("_key")


# --- Embedded JSON -----------------------------------------------------------------------
#: Levels of nesting that one job opens; deeper ones follow in further jobs.
LEVELS = 8


def walk_levels(rows: DataFrame, keep: Sequence[str], start: Column, children: Callable[[Column], Column], levels: int = LEVELS) -> DataFrame:
    """``keep, node_ord, node``: the entries of the array ``start`` and all that ``children`` finds below them, breadth first.

    ``children`` turns an entry into the array of the entries below it. A job opens ``levels`` of them within the row; rows that have
    more go on in the next job, from a checkpoint that holds only their unopened entries, until none is left. JSON nested more than
    1,000 deep is no JSON to the parser, so there are at most that many levels.
    """
    found, frontier = [], rows.select(*keep, start.alias("_0"))
    while True:
        staged = frontier
        for i in range(levels):
            staged = staged.withColumn(f"_{i + 1}", F.flatten(F.transform(f"_{i}", children)))
        opened = F.concat(*[F.col(f"_{i}") for i in range(levels)])
        found.append(staged.select(*keep, F.posexplode(opened).alias("_ord", "node")).select(
            *keep, (F.col("_ord") + F.lit(len(found)).cast("long") * (1 << 32)).alias("node_ord"), "node"))
        frontier = cut_lineage(staged.where(F.size(f"_{levels}") > 0).select(*keep, F.col(f"_{levels}").alias("_0")))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _as_list(json: Column) -> Column:
    """JSON text of an object or list -> array of element texts."""
    return F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.startswith("{"), F.array(json)).otherwise(text_array([]))


def _field(json: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(json, f"$['{name}']") for name in names])


def json_ld_objects(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """schema.org objects of a page; lists and @graph opened however deep they go."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*ld\+json[^>]*>(.*?)</script\s*>"), F.lit(1))
    texts = F.filter(F.transform(scripts, lambda s: F.trim(s)), lambda j: j.rlike(r"^[\[{]"))

    def below(j: Column) -> Column:
        inner = F.when(j.startswith("["), j).otherwise(F.coalesce(_field(j, "@graph"), F.lit("")))
        return F.filter(F.coalesce(_as_list(inner), text_array([])), lambda v: v.rlike(r"^[\[{]"))

    objects = walk_levels(pages, [id_col], texts, below).where(F.col("node").startswith("{"))
    return objects.where(F.try_parse_json("node").isNotNull()).withColumnsRenamed({"node_ord": "object_ord", "node": "object"})


def _is_type(obj: Column, name: str) -> Column:
    return F.lower(F.coalesce(_field(obj, "@type"), F.lit(""))).rlike(rf"^(?:{name}|\[.*\"{name}\".*\])$")


def _schema_text(value: Column) -> Column:
    """Text of a schema.org value: plain, or the first naming field of an object."""
    named = F.coalesce(*[F.when(has_value(F.get_json_object(value, f"$['{k}']")), F.get_json_object(value, f"$['{k}']"))
                         for k in ("@value", "name", "text", "@id", "url")])
    text = clean_text(F.when(value.startswith("{"), named).otherwise(value))
    return F.when(F.lower(text).isin("none", "null") | value.startswith("["), "").otherwise(blank_to_empty(text))


def _schema_price(value: Column) -> Column:
    text = clean_text(value)
    whole = text.rlike(r"^\d+(?:\.0+)?$")
    return F.when(whole, F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


_PRICE_NAME = r"^\$?\s?\d{1,3}(?:\.\d{2})?(?:\s*/\s*\$?\s?\d{1,3}(?:\.\d{2})?)*$"


def _item_price(item: Column) -> Column:
    offers = _as_list(F.coalesce(_field(item, "offers"), F.lit("")))
    offered = F.array_compact(F.transform(offers, lambda o: F.coalesce(
        F.when(has_value(_field(o, "price")), _field(o, "price")),
        F.get_json_object(o, "$.priceSpecification.price"))))
    add_ons = _as_list(F.coalesce(_field(item, "menuAddOn"), F.lit("")))
    names = F.flatten(F.transform(add_ons, lambda a: F.concat(
        F.array(F.coalesce(_field(a, "name"), F.lit(""))),
        F.transform(_as_list(F.coalesce(_field(a, "hasMenuItem", "menuItem"), F.lit(""))), lambda i: F.coalesce(_field(i, "name"), F.lit(""))))))
    priced_names = F.filter(names, lambda n: n.rlike(_PRICE_NAME))
    return _schema_price(blank_to_empty(F.coalesce(
        F.get(offered, F.lit(0)), F.when(has_value(_field(item, "price")), _field(item, "price")),
        F.when(has_value(_field(item, "priceRange")), _field(item, "priceRange")), F.get(priced_names, F.lit(0)))))


def schema_menu_items(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Items of schema.org menus: sections however deep they nest, inherited categories."""
    # Opened once: its sections are walked in jobs of their own.
    objects = cut_lineage(json_ld_objects(pages, id_col).where(_is_type(F.col("object"), "menu") | _is_type(F.col("object"), "menuitem")))

    def sections(parent: Column, category: Column, *names: str) -> Column:
        return F.transform(_as_list(F.coalesce(_field(parent, *names), F.lit(""))), lambda s: F.struct(
            F.when(F.length(_schema_text(F.coalesce(_field(s, "name"), F.lit("")))) > 0, _schema_text(_field(s, "name"))).otherwise(category).alias("category"),
            s.alias("section")))

    obj = F.col("object")
    menus = walk_levels(objects.where(_is_type(obj, "menu")), [id_col, "object_ord"], sections(obj, F.lit(""), "hasMenuSection"),
                        lambda s: sections(s.section, s.category, "hasMenuSection", "menuSection"))
    listed = menus.select(id_col, "object_ord", "node_ord", "node.category", F.posexplode(
        _as_list(F.coalesce(_field(F.col("node.section"), "hasMenuItem", "menuItem"), F.lit("")))).alias("item_ord", "item"))
    own = objects.where(_is_type(obj, "menuitem")).select(
        id_col, "object_ord", F.lit(0).cast("long").alias("node_ord"), F.lit("").alias("category"), F.lit(0).alias("item_ord"), obj.alias("item"))
    rows = listed.unionByName(own).select(id_col, "object_ord", F.struct("node_ord", "item_ord").alias("item_ord"), F.struct("category", "item").alias("m"))
    item = F.col("m.item")
    fields = rows.select(id_col, "object_ord", "item_ord", "m.category", _schema_text(F.coalesce(_field(item, "name"), F.lit(""))).alias("item_name"),
                         _schema_text(F.coalesce(_field(item, "description"), F.lit(""))).alias("description"), _item_price(item).alias("price"))
    named = fields.where(looks_like_item_name(F.col("item_name"))).withColumns({
        "_c": dedupe_text(F.col("category")), "_n": dedupe_text(F.col("item_name")), "_p": dedupe_price(F.col("price"))})
    first = keep_first(named, [id_col, "_c", "_n", "_p"], [F.asc("object_ord"), F.asc("item_ord")]).drop("_c", "_n", "_p")
    raw = clean_text(F.concat_ws(" ", "category", "item_name", "description", "price"))
    tagged = first.withColumn("raw_text", raw).withColumns({
        "dietary_terms": matched_terms(F.col("raw_text"), av.DIETARY_TERMS),
        "allergen_terms": matched_terms(F.col("raw_text"), av.ALLERGEN_TERMS, av.ALLERGEN_FALSE_FRIENDS)})
    return tagged.withColumns({"extraction_method": F.lit("schema_org_menu_item"),
                               "confidence": schema_item_confidence(F.col("price"), F.col("category"), F.col("description"))})


def schema_menu_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Menu URLs declared in JSON-LD, as scored source candidates."""
    objects = json_ld_objects(pages, id_col).join(pages.select(id_col, F.col("url").alias("page_url")), id_col)
    values = F.concat(*[_menu_values(F.coalesce(_field(F.col("object"), name), F.lit(""))) for name in ("hasMenu", "menu")])

    def to_url(v: Column) -> Column:
        inner = F.coalesce(*[F.when(has_value(_field(v, k)), _field(v, k)) for k in ("url", "@id", "sameAs")])
        return F.trim(F.when(v.startswith("{"), inner).otherwise(v))

    rows = objects.select(id_col, "object_ord", "page_url", F.explode(values).alias("_v")).withColumn("_u", to_url(F.col("_v"))).where(has_value(F.col("_u")))
    found = rows.withColumn("url", u.resolve_url(F.col("page_url"), F.col("_u"))).where(u.is_http_url(F.col("url")))
    score = u.score_source_candidate(F.col("url"), F.lit("schema.org hasMenu menu"))["score"]
    kind = u.source_type(F.col("url"), F.lit("schema.org menu"))
    return found.select(id_col, "object_ord", "url", F.least(F.lit(1.0), F.greatest(F.lit(0.75), score + 0.35)).alias("confidence"),
                        F.when(kind == "website_link", "schema_org_menu").otherwise(kind).alias("source_type"))


def _menu_values(json: Column) -> Column:
    return F.when(json.startswith("["), F.from_json(json, "array<string>")).when(F.length(json) > 0, F.array(json)).otherwise(text_array([]))


def microdata_items(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Items written as HTML microdata, with their section's name."""
    def prop(block: Column, name: str) -> Column:
        tag = rf"(?is)<[^>]*\bitemprop\s*=\s*[\"']{name}[\"'][^>]*"
        content = F.regexp_extract(block, tag + r"\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)
        inner = F.regexp_extract(block, tag + r">(.*?)</", 1)
        return F.when(F.length(F.trim(content)) > 0, clean_text(content)).otherwise(plain(inner))

    def starts(kind: str) -> str:
        return rf"(?is)(?=<[^<>]*\bitemtype\s*=\s*[\"'][^\"']*{kind}[\"'])"

    sections = pages.select(id_col, F.posexplode(F.split("html", starts("menusection"))).alias("section_ord", "_sec"))
    pieces = sections.select(id_col, "section_ord", F.posexplode(F.split("_sec", starts("menuitem"))).alias("item_ord", "_piece"),
                             F.get(F.split("_sec", starts("menuitem")), F.lit(0)).alias("_head"))
    in_section = F.col("_head").rlike(r"(?is)\bitemtype\s*=\s*[\"'][^\"']*menusection")
    price = F.coalesce(F.when(has_value(prop(F.col("_piece"), "price")), prop(F.col("_piece"), "price")), prop(F.col("_piece"), "lowPrice"))
    rows = pieces.where(F.col("_piece").rlike(r"(?is)^<[^<>]*\bitemtype\s*=\s*[\"'][^\"']*menuitem")).select(
        id_col, "section_ord", "item_ord", prop(F.col("_piece"), "name").alias("item_name"), prop(F.col("_piece"), "description").alias("description"),
        F.when(price.rlike("[$€£¥₹฿]"), price).otherwise(_schema_price(price)).alias("price"),
        F.when(in_section, F.substring(prop(F.col("_head"), "name"), 1, 80)).otherwise("").alias("category"))
    return rows.where(looks_like_item_name(F.col("item_name")))


def json_blobs(html: Column) -> Column:
    """JSON texts embedded in a page: data scripts, state variables, streamed rows."""
    data = F.regexp_extract_all(html, F.lit(r"(?is)<script\b(?=[^>]*(?:__NEXT_DATA__|type\s*=\s*[\"']application/json[\"']))[^>]*>\s*([\[{].*?)\s*</script\s*>"), F.lit(1))
    state = F.regexp_extract_all(html, F.lit(
        r"(?is)(?:__NUXT__|__APOLLO_STATE__|__INITIAL_STATE__|__PRELOADED_STATE__|__REDUX_STATE__)\s*=\s*([\[{].*?[\]}])\s*;?\s*</script\s*>"), F.lit(1))
    pushes = F.regexp_extract_all(html, F.lit(r"(?s)self\.__next_f\.push\((\[.*?\])\)\s*;?\s*(?=</script|self\.__next_f)"), F.lit(1))
    chunks = F.array_join(F.transform(pushes, lambda p: F.coalesce(F.get(F.from_json(p, "array<string>"), F.lit(1)), F.lit(""))), "")
    flight = F.regexp_extract_all(chunks, F.lit(r"(?m)^[0-9A-Za-z]+:([\[{].*)$"), F.lit(1))
    return F.concat(data, state, flight)


def json_nodes(pages: DataFrame, id_col: str, blobs: Column) -> DataFrame:
    """Every object inside a page's JSON texts, breadth first, down to the leaves."""
    def children(j: Column) -> Column:
        values = F.when(j.startswith("{"), F.map_values(F.from_json(j, "map<string,string>"))).when(
            j.startswith("["), F.from_json(j, "array<string>"))
        return F.filter(F.coalesce(values, text_array([])), lambda v: v.rlike(r"^[\[{]"))

    return walk_levels(pages, [id_col], blobs, children).where(F.col("node").startswith("{"))


def _first_string(node: Column, keys: Sequence[str]) -> Column:
    """First text value whose key is listed, skipping links, ids and structures."""
    fields = F.map_entries(F.from_json(node, "map<string,string>"))
    good = F.filter(fields, lambda e: F.lower(e.key).isin(list(keys)) & (F.length(F.trim(e.value)) > 0)
                    & ~e.value.rlike(r"^(?:https?://|/|[\[{])") & ~e.value.rlike(r"^[0-9a-f\-]{8,}$"))
    return F.get(good.value, F.lit(0))


def _money(value: Column, quoted: Column) -> Column:
    """Price text of a JSON value; whole numbers from 100 up are cents."""
    number = value.try_cast("double")
    is_int = value.rlike(r"^-?\d+$")
    dollars = F.when(number <= 0, "").when(is_int & (number >= 100), F.format_string("$%.2f", number / 100)).when(
        number == F.floor(number), F.concat(F.lit("$"), number.cast("bigint").cast("string"))).otherwise(F.format_string("$%.2f", number))
    text = F.trim(value)
    as_text = F.when(~text.rlike(r"\d") | (F.length(text) > 16), "").when(
        text.rlike(r"^\d+(?:\.\d{1,2})?$"), F.concat(F.lit("$"), text)).otherwise(text)
    return F.when(~quoted & number.isNotNull(), dollars).otherwise(as_text)


def _node_price(node: Column) -> Column:
    fields = F.map_entries(F.from_json(node, "map<string,string>"))
    priced = F.filter(fields, lambda e: F.lower(e.key).isin(list(av.OBJECT_PRICE_KEYS)))

    def is_quoted(owner: Column, key: Column) -> Column:
        pattern = F.concat(F.lit('"\\Q'), key, F.lit('\\E"\\s*:\\s*"'))
        return F.regexp_like(owner, pattern)

    def amount(e: Column) -> Column:
        inner = F.filter(F.coalesce(F.map_entries(F.when(e.value.startswith("{"), F.from_json(e.value, "map<string,string>"))),
                                    F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)")),
                         lambda x: x.key.isin("amount", "units", "value", "price"))
        nested = F.get(F.transform(inner, lambda x: _money(x.value, is_quoted(e.value, x.key))), F.lit(0))
        return F.when(e.value.startswith("{"), nested).when(e.value.startswith("[") | e.value.isin("true", "false"), "").otherwise(
            _money(e.value, is_quoted(node, e.key)))

    found = F.filter(F.transform(priced, amount), lambda p: p.isNotNull() & (F.length(p) > 0))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def embedded_json_items(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Objects with a name and a price inside a page's data blobs."""
    nodes = json_nodes(pages, id_col, json_blobs(F.col("html")))
    fields = nodes.select(id_col, "node_ord", F.trim(_first_string(F.col("node"), av.OBJECT_NAME_KEYS)).alias("item_name"),
                          blank_to_empty(F.trim(_first_string(F.col("node"), av.OBJECT_TEXT_KEYS))).alias("description"),
                          _node_price(F.col("node")).alias("price"))
    usable = fields.where(F.length("item_name").between(2, 120) & (F.length("price") > 0))
    first = keep_first(usable.withColumns({"_n": F.lower("item_name"), "_p": F.lower("price")}), [id_col, "_n", "_p"], [F.asc("node_ord")])
    raw = F.trim(F.concat_ws(" ", "item_name", "description", "price"))
    return first.drop("_n", "_p").withColumn("raw_text", raw).withColumns({
        "dietary_terms": matched_terms(F.col("raw_text"), av.DIETARY_TERMS),
        "allergen_terms": matched_terms(F.col("raw_text"), av.ALLERGEN_TERMS, av.ALLERGEN_FALSE_FRIENDS),
        "extraction_method": F.lit("embedded_json"), "confidence": F.lit(0.6)})


def _truthy(value: Column) -> Column:
    return F.coalesce(value.try_cast("double") > 0, F.lower(F.trim(value)).isin(av.TRUE_WORDS))


def embedded_allergen_items(pages: DataFrame, id_col: str = "page_id", json: Column | None = None) -> DataFrame:
    """Objects with a name and structured allergen data: lists, flag maps, flag rows.

    ``json`` replaces the page's blobs, e.g. captured API responses.
    """
    blobs = json_blobs(F.col("html")) if json is None else F.array(json)
    nodes = json_nodes(pages, id_col, blobs)
    fields = F.filter(F.map_entries(F.from_json("node", "map<string,string>")), lambda e: ~F.lower(e.key).isin(av.OBJECT_NAME_KEYS))

    def words(e: Column) -> Column:
        items = F.from_json(e.value, "array<string>")
        texts = F.filter(items, lambda x: ~x.rlike(r"^[\[{]") & (F.length(x) <= 40))
        flags = F.transform(F.filter(items, lambda x: x.startswith("{")), flag_name)
        listed = F.when(F.forall(items, lambda x: x.startswith("{")), flags).when(F.forall(items, lambda x: ~x.rlike(r"^[\[{]")), texts)
        mapped = F.transform(F.filter(F.map_entries(F.from_json(e.value, "map<string,string>")), lambda x: _truthy(x.value)), lambda x: x.key)
        return F.coalesce(F.when(e.value.startswith("["), listed).when(e.value.startswith("{"), mapped), text_array([]))

    def flag_name(entry: Column) -> Column:
        flags = F.filter(F.map_entries(F.from_json(entry, "map<string,string>")), lambda x: F.lower(x.key).isin(av.FLAG_KEYS))
        present = F.coalesce(_truthy(F.get(flags.value, F.lit(0))), F.lit(True))
        return F.when(present, F.coalesce(_first_string(entry, av.FLAG_NAME_KEYS), F.lit(""))).otherwise("")

    localized = F.get(F.filter(F.map_entries(F.from_json("node", "map<string,string>")),
                               lambda e: F.lower(e.key).isin(av.OBJECT_NAME_KEYS) & e.value.startswith("{")).value, F.lit(0))
    name = F.trim(F.coalesce(_first_string(F.col("node"), av.OBJECT_NAME_KEYS), _first_string(localized, av.LOCALE_KEYS)))
    staged = nodes.select(id_col, "node_ord", name.alias("item_name"), F.array_join(F.flatten(F.transform(fields, words)), "\n").alias("_w"))
    found = staged.where(F.length("item_name").between(2, 120) & (F.length("_w") > 0)).withColumn(
        "allergen_terms", matched_terms(F.col("_w"), av.ALLERGEN_TERMS, av.ALLERGEN_FALSE_FRIENDS)).where(F.size("allergen_terms") > 0)
    first = keep_first(found.withColumn("_n", F.lower("item_name")), [id_col, "_n"], [F.asc("node_ord")])
    return first.drop("_n", "_w").withColumns({"extraction_method": F.lit("embedded_allergens"), "confidence": F.lit(0.6)})
