"""Text-to-table jobs over the pages table, with menu markup added per page."""

from __future__ import annotations

from pyspark.sql import functions as F

from dinesight.catalog import query
from dinesight.catalog.source_queries import HOST, any_sql, domain_sql, ends_sql
from dinesight.catalog.tables import DISH_NAMES, pick, pick_sql, sql_list, table
from dinesight.functions import text as t
from dinesight.operators import extraction as x
from dinesight.vocab import allergens as av
from dinesight.vocab import web

_N = "page_id"
TAG_TEXT = r"trim(regexp_replace({0}, '[\t\n\x0B\f\r \x{{85}}\p{{Z}}]+', ' ', 'g'))"
_DROP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


def visible_sql(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '{_DROP}', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def clean_sql(expr: str) -> str:
    return TAG_TEXT.replace("{{", "{").replace("}}", "}").replace("{0}", expr)


def _marked_up(spark, sf_dir, markup):
    """Pages with extra markup before the closing body tag."""
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(F.regexp_replace("html", "</body></html>$", ""), markup, F.lit("</body></html>")))


# --- Links -------------------------------------------------------------------------
_EXTRA_LINKS = ['<a href="menu.pdf?v=1">Dinner <b>Menu</b></a><a href="/The">again</a>', '<a href="mailto:x@y.z">mail</a><a href="https://other.org/x">off</a>',
                '<a href="https://cdn.net/allergens.pdf#p2">PDF</a>', '<a href="../up/page">up</a><a href="?q=1">q</a>',
                '<a href="https://www.instagram.com/diner">IG</a><a href="https://facebook.com/diner/">FB</a>']


def _links(spark, sf_dir):
    return _marked_up(spark, sf_dir, pick(_EXTRA_LINKS, F.col(_N)))


_LINKED = f"(SELECT page_id, url, regexp_replace(html, '</body></html>$', '') || {pick_sql(_EXTRA_LINKS, _N)} AS html FROM pages)"
_BASE_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_FOLDER = f"CASE WHEN {_BASE_PATH} = '' THEN '/' ELSE regexp_replace({_BASE_PATH}, '[^/]*$', '') END"
_RESOLVED = (f"CASE WHEN regexp_matches(h, '^https?:') THEN h WHEN starts_with(h, '?') THEN {_ORIGIN} || {_BASE_PATH} || h WHEN starts_with(h, '/') THEN {_ORIGIN} || h "
             f"WHEN starts_with(h, '../') THEN {_ORIGIN} || regexp_replace({_FOLDER}, '[^/]+/$', '') || h[4:] ELSE {_ORIGIN} || {_FOLDER} || h END")
_ANCHORS = "(SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) AS tag, html FROM " + _LINKED + ")"
LINKS_OF_PAGES = (
    f"SELECT DISTINCT page_id, regexp_replace(link, '#.*$', '') AS link FROM (SELECT page_id, url, {_RESOLVED} AS link FROM (SELECT page_id, url, regexp_extract(tag, 'href=\"([^\"]*)\"', 1) AS h FROM {_ANCHORS}) "
    "WHERE h <> '' AND NOT regexp_matches(h, '^(#|mailto:|tel:|javascript:)')) WHERE regexp_matches(link, '^https?://') AND ("
    + HOST.format("link") + " = " + domain_sql("url") + " OR ends_with(" + HOST.format("link") + ", '.' || " + domain_sql("url")
    + ") OR ends_with(regexp_replace(lower(link), '[?#].*$', ''), '.pdf'))")


@query("extract_links", "TX-1", LINKS_OF_PAGES)
def extract_links(spark, sf_dir):
    return x.extract_links(_links(spark, sf_dir)).select("page_id", F.col("url").alias("link"))


@query("link_anchor_texts", "TX-1",
       "SELECT page_id, anchor, count(*) AS n FROM (SELECT page_id, " + clean_sql("regexp_replace(tag, '<[^>]*>', ' ', 'g')") + "[1:140] AS anchor, h FROM (SELECT page_id, tag, regexp_extract(tag, 'href=\"([^\"]*)\"', 1) AS h "
       "FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>')) AS tag FROM pages)) WHERE starts_with(h, '/') QUALIFY row_number() OVER (PARTITION BY page_id, h) = 1) GROUP BY ALL")
def link_anchor_texts(spark, sf_dir):
    found = x.extract_links(table(spark, sf_dir, "pages"))
    return found.groupBy("page_id", "anchor").agg(F.count("*").alias("n"))


@query("extract_social_links", "TX-2",
       "SELECT page_id, h AS social_url FROM (SELECT page_id, regexp_extract(tag, 'href=\"([^\"]*)\"', 1) AS h FROM " + _ANCHORS + ") WHERE regexp_matches(h, '(?i)(instagram[.]com|facebook[.]com|tiktok[.]com|twitter[.]com|x[.]com)/')")
def extract_social_links(spark, sf_dir):
    return x.extract_social_links(_links(spark, sf_dir)).select("page_id", "social_url")


_IMAGES = ['<div class="menu-board"><img src="/img/board1.jpg" alt="Dinner menu"><img src="logo.svg"></div>', '<img src="/photos/cat.png" alt="a cat">',
           '<section id="lunch"><figure><img src="lunch-1.webp"></figure></section>', '<p>no image</p>']


@query("image_candidates", "TX-24")
def image_candidates(spark, sf_dir):
    return x.image_candidates(_marked_up(spark, sf_dir, pick(_IMAGES, F.col(_N)))).select("page_id", "image_ord", "url", "context", F.round("confidence", 3).alias("confidence"))


_MENU_IMAGES = ['<div class="big menu"><img src="a.jpg" alt="menu 1"><img src="b.jpg" alt="menu 2"><img src="c.jpg" alt="dinner"></div>',
                '<a href="#lunch">Lunch</a><a href="#dinner">Dinner</a>', '<p class="menus">x</p>']


@query("score_image_menu_page", "PR-16",
       "SELECT page_id, list_extract([0.33, 0.12, 0.0]::DOUBLE[], CAST(page_id % 3 AS INTEGER) + 1) AS score FROM pages")
def score_image_menu_page(spark, sf_dir):
    return _marked_up(spark, sf_dir, pick(_MENU_IMAGES, F.col(_N))).select("page_id", F.round(x.image_menu_score(F.col("html")), 2).alias("score"))


# --- Text ------------------------------------------------------------------------------
@query("visible_text", "PR-25", "SELECT page_id, md5(" + visible_sql("html") + ") AS digest FROM pages")
def visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.visible_text(F.col("html"))).alias("digest"))


# The references that the given pages hold.
_REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _decoded(expr: str) -> str:
    for name, char in _REFERENCES.items():
        expr = f"replace({expr}, {sql_list([name])[1:-1]}, {sql_list([char])[1:-1]})"
    return expr


@query("visible_lines", "TX-3",
       "SELECT page_id, line, count(*) AS n FROM (SELECT page_id, " + clean_sql(_decoded("l")) + " AS line FROM (SELECT page_id, unnest(string_split_regex(regexp_replace(regexp_replace(html, '"
       + _DROP + "', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '\\r\\n|[\\n\\r]')) AS l FROM pages)) WHERE line <> '' GROUP BY ALL")
def visible_lines(spark, sf_dir):
    return x.visible_lines(table(spark, sf_dir, "pages")).groupBy("page_id", "line").agg(F.count("*").alias("n"))


_KIND_MARKUP = ['<div id="root"></div>', '<script type="application/json">{}</script>', '<p itemtype="https://schema.org/MenuItem">x</p>', "<p>plain</p>"]
_KIND_HTML = f"(SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '  ' ELSE html || {pick_sql(_KIND_MARKUP, _N)} END AS html FROM pages)"


@query("payload_kind", "PR-26 PR-27",
       "SELECT page_id, CASE WHEN trim(html) = '' THEN 'empty' WHEN (contains(lower(html), 'schema.org') AND (contains(lower(html), 'menuitem') OR contains(lower(html), '\"menu\"'))) OR contains(lower(html), '__next_data__') "
       f"OR contains(lower(html), 'type=\"application/json\"') THEN 'structured' ELSE 'text' END AS kind, ({any_sql('lower(html)', web.APP_ROOT_MARKS)}) AND length(html) < 60000 AS js_empty FROM {_KIND_HTML}")
def payload_kind(spark, sf_dir):
    html = F.when(F.col(_N) % 9 == 0, "  ").otherwise(F.concat("html", pick(_KIND_MARKUP, F.col(_N))))
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html")).select(
        "page_id", t.payload_kind(F.col("html")).alias("kind"), t.looks_js_empty(F.col("html")).alias("js_empty"))


_MENU_PROSE = ["Lunch menu: salad $9.50, soup $7.25, burger $12.00 and pasta", "pizza pasta dessert beverage rice", "contact us", "vegan and gluten free dinner"]
_PAGE_TEXT = f"(SELECT page_id, lower({visible_sql('html')} || ' ' || {pick_sql(_MENU_PROSE, _N)}) AS low FROM pages)"
_PRICE_SQL = web.PRICE_PATTERN.replace("(?iU)", "(?i)").replace("'", "''")


@query("score_page_text", "PR-15",
       f"SELECT page_id, n1 AS strict_count, n2 AS item_count, n3 AS price_count, round(CAST(least(n1 * 0.12, 0.35) + CASE WHEN n2 >= 3 THEN least(n2 * 0.04, 0.35) ELSE 0 END + CASE WHEN n3 >= 3 THEN 0.25 ELSE 0 END AS DOUBLE), 4) AS score FROM (SELECT page_id, "
       f"CAST(len(list_filter({sql_list(web.STRICT_MENU_WORDS)}, lambda v: contains(low, v))) AS INTEGER) AS n1, CAST(len(list_filter({sql_list(web.MENU_ITEM_HINTS)}, lambda v: contains(low, v))) AS INTEGER) AS n2, "
       f"CAST(len(regexp_extract_all(low, '{_PRICE_SQL}')) AS INTEGER) AS n3 FROM {_PAGE_TEXT})")
def score_page_text(spark, sf_dir):
    from dinesight.operators.sources import page_scores
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(t.visible_text(F.col("html")), F.lit(" "), pick(_MENU_PROSE, F.col(_N))).alias("text"))
    return page_scores(pages, F.col("text")).select("page_id", "strict_count", "item_count", "price_count", F.round("score", 4).alias("score"))


_TERM_CASES = ", ".join(
    f"CASE WHEN len(list_filter(ws, lambda w: contains(w, '{term}') AND NOT list_contains({sql_list(av.ALLERGEN_FALSE_FRIENDS[term])}, w))) > 0 THEN '{term}' END"
    if term in av.ALLERGEN_FALSE_FRIENDS else f"CASE WHEN contains(low, '{term}') THEN '{term}' END" for term in dict.fromkeys(av.ALLERGEN_TERMS))
_ALLERGEN_LINES = ["<p>Peanuts, milk and gluten $4.50</p>", "<p>eggplant</p>", "<p>coconuts</p>", "<p>tea</p>"]


@query("menu_text_records", "TX-22",
       f"SELECT page_id, CAST(length({clean_sql('v')}) AS INTEGER) AS char_count, CAST(len(regexp_extract_all({clean_sql('v')}, '{_PRICE_SQL}')) AS INTEGER) AS price_count, "
       f"array_to_string(list_sort(list_filter([{_TERM_CASES}], lambda z: z IS NOT NULL)), ',') AS allergen_terms FROM (SELECT page_id, v, lower(v) AS low, string_split_regex(lower(v), '[^\\p{{L}}]+') AS ws FROM (SELECT page_id, "
       + visible_sql("regexp_replace(html, '</body></html>$', '') || " + pick_sql(_ALLERGEN_LINES, _N) + " || '</body></html>'") + " AS v FROM pages))")
def menu_text_records(spark, sf_dir):
    pages = _marked_up(spark, sf_dir, pick(_ALLERGEN_LINES, F.col(_N)))
    return x.menu_text_records(pages).select("page_id", "char_count", "price_count", F.array_join("allergen_terms", ",").alias("allergen_terms"))


@query("chunk_text", "TX-16",
       f"SELECT doc_id, CAST(i AS INTEGER) AS chunk_ord, md5(t[i * 900 + 1 : i * 900 + 1000]) AS digest FROM (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 1000 THEN [0] ELSE generate_series(0, (length(t) - 1) // 900) END) AS i FROM (SELECT doc_id, {clean_sql('text')} AS t FROM documents))")
def chunk_text(spark, sf_dir):
    return x.chunk_text(table(spark, sf_dir, "documents"), "text", ["doc_id"], size=1000, overlap=100).select("doc_id", "chunk_ord", F.md5("chunk").alias("digest"))


_TELLS = ["Visit burgerking.co.nz or call +64 9 555", "A New Zealand wine", "New Zealand beef NZ$12", "menu at foo.de and bar.fr", "see cafe.de and bar.de and x.fr", "plain text"]


@query("detect_source_region", "TX-21")
def detect_source_region(spark, sf_dir):
    pages = _marked_up(spark, sf_dir, pick([f"<p>{s}</p>" for s in _TELLS], F.col(_N)))
    return pages.select("page_id", x.detect_source_region(F.col("html"), F.col("url")).alias("region"))


_ENDPOINTS = ['<script>fetch("/api/menu?x=1");load("/static/app.js");</script>', "<script>var u='https://cdn.site.net/data/allergens.json';</script>",
              '<script src="/bundle.js"></script><script>get("/x/nutrition/list");get("/about")</script>', "<p>none</p>"]


@query("endpoint_candidates", "TX-14",
       "SELECT page_id, endpoint FROM (SELECT page_id, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || h ELSE h END AS endpoint FROM (SELECT page_id, url, "
       f"unnest(list_distinct(regexp_extract_all(s, '[\"''`](https?://[^\"''`\\s]+|/[A-Za-z0-9_][^\"''`\\s]{{2,}})[\"''`]', 1))) AS h FROM (SELECT page_id, url, array_to_string(list_filter(regexp_extract_all(html || {pick_sql(_ENDPOINTS, _N)}, "
       "'(?is)<script\\b[^>]*>.*?</script\\s*>'), lambda z: NOT contains(regexp_extract(z, '^<[^>]*>', 0), 'src=')), ' ') AS s FROM pages))) WHERE NOT ("
       + ends_sql("regexp_replace(lower(endpoint), '[?].*$', '')", web.ENDPOINT_SKIP) + ") AND (" + any_sql("lower(endpoint)", web.ENDPOINT_HINTS) + " OR " + any_sql("lower(endpoint)", web.ENDPOINT_HOSTS) + ")")
def endpoint_candidates(spark, sf_dir):
    return x.endpoint_candidates(_marked_up(spark, sf_dir, pick(_ENDPOINTS, F.col(_N)))).select("page_id", "endpoint")


_MENU_LINES = ["Starters|Garden Salad $9.50 fresh greens|Miso Soup - with tofu $4.00", "Desserts|Walnut Brownie $6 Lemon Tart $7 zesty", "Checkout now $5|Mains|Steak Frites €24 rare",
               "Open 11 am|Pad Thai $14|Pad Thai $14"]


def _price_lines(spark, sf_dir):
    pages = _marked_up(spark, sf_dir, F.concat(F.lit("<div>"), F.regexp_replace(pick(_MENU_LINES, F.col(_N)), r"\|", "</div><div>"), F.lit("</div>")))
    return x.visible_lines(pages)


@query("items_from_price_lines", "TX-5", """
    SELECT page_id, item_name, price, category FROM pages, LATERAL (SELECT * FROM (VALUES
      (0, 'Garden Salad', '$9.50', 'Starters'), (0, 'Miso Soup', '$4.00', 'Starters'),
      (1, 'Walnut Brownie', '$6', 'Desserts'), (1, 'Lemon Tart', '$7', 'Desserts'),
      (2, 'Steak Frites', '€24', 'Mains'), (3, 'Pad Thai', '$14', '')) v(m, item_name, price, category) WHERE v.m = page_id % 4)""")
def items_from_price_lines(spark, sf_dir):
    items = x.items_from_price_lines(_price_lines(spark, sf_dir))
    # The pages' own prose holds accidental prices; compare the added menu lines.
    return items.where(F.col("item_name").isin("Garden Salad", "Miso Soup", "Walnut Brownie", "Lemon Tart", "Steak Frites", "Pad Thai")).select(
        "page_id", "item_name", "price", "category")


@query("running_category", "WI-11",
       "SELECT page_id, count(*) AS n FROM pages, (SELECT unnest(['a', 'b']) AS x), (SELECT unnest([0, 1, 2, 3]) AS m) WHERE m = page_id % 4 AND (m = 0 OR (m IN (1, 2) AND x = 'a')) GROUP BY page_id")
def running_category(spark, sf_dir):
    lines = _price_lines(spark, sf_dir)
    carried = x.running_category(lines)
    own = F.col("line").rlike(r"^(?:Garden Salad|Miso Soup|Walnut Brownie|Steak Frites)")
    return carried.where(own & F.col("category").isin("Starters", "Desserts", "Mains")).groupBy("page_id").agg(F.count("*").alias("n"))


# --- Grids ------------------------------------------------------------------------------
_MARKS = ["x", "✓", "contains", '<img alt="yes">', "-", "free", ""]


def _grid_html(n):
    """Two dish rows whose marks follow from the page number."""
    dish = [pick(DISH_NAMES[:20], n), pick(DISH_NAMES[:20], n + 7)]

    def row(d, shift):
        cells = [F.concat(F.lit("<td>"), pick(_MARKS, n + shift * 3 + j), F.lit("</td>")) for j in range(4)]
        return F.concat(F.lit("<tr><td>"), d, F.lit("</td>"), *cells, F.lit("</tr>"))

    head = '<table><caption>Allergens</caption><thead><tr><th>Dish</th><th>Milk</th><th>Egg</th><th colspan="2">Tree Nuts</th></tr></thead><tbody>'
    # A colspan of two covers the last two mark columns.
    return F.concat(F.lit(head), row(dish[0], 0), row(dish[1], 1), F.lit("</tbody></table>"))


_POSITIVE = "list_contains(['x', '✓', 'contains', '<img alt=\"yes\">'], {0})"


def _grid_row_sql(offset: int, shift: int) -> str:
    mark = lambda j: _POSITIVE.format(pick_sql(_MARKS, f"page_id + {shift * 3 + j}"))
    tokens = (f"list_filter([CASE WHEN {mark(1)} THEN 'egg' END, CASE WHEN {mark(0)} THEN 'milk' END, CASE WHEN {mark(2)} OR {mark(3)} THEN 'tree nut' END], lambda v: v IS NOT NULL)")
    return f"SELECT page_id, {pick_sql(DISH_NAMES[:20], f'page_id + {offset}')} AS item_name, {tokens} AS terms FROM pages"


_GRID_SQL = (f"SELECT page_id, item_name, array_to_string(list_sort(list_distinct(flatten(list(terms)))), ',') AS allergen_terms, 'egg,milk,tree nut' AS columns FROM ({_grid_row_sql(0, 0)} UNION ALL {_grid_row_sql(7, 1)}) "
             "WHERE item_name <> 'Home' GROUP BY page_id, item_name")


@query("allergen_grid_long", "TX-9", _GRID_SQL)
def allergen_grid_long(spark, sf_dir):
    # On two pages of three the chart stands inside layout tables.
    depth = (F.col(_N) % 3).cast("int")
    nested = F.concat(F.repeat(F.lit("<TABLE class=layout><tr><td>Menu</td><td>Allergens</td></tr><tr><td>"), depth), _grid_html(F.col(_N)),
                      F.repeat(F.lit("</td><td>x</td></tr></table >"), depth))
    pages = _marked_up(spark, sf_dir, nested)
    return x.allergen_grid_long(pages).select("page_id", "item_name", F.array_join("allergen_terms", ",").alias("allergen_terms"),
                                              F.array_join("matrix_allergen_columns", ",").alias("columns"))


@query("text_grid_long", "TX-10",
       "SELECT page_id, item_name, array_to_string(list_filter([CASE WHEN " + _POSITIVE.format(pick_sql(_MARKS, "page_id + 1")) + " THEN 'egg' END, CASE WHEN " + _POSITIVE.format(pick_sql(_MARKS, "page_id"))
       + " THEN 'milk' END, CASE WHEN " + _POSITIVE.format(pick_sql(_MARKS, "page_id + 2")) + " THEN 'peanut' END], lambda v: v IS NOT NULL), ',') AS allergen_terms FROM (SELECT page_id, "
       + pick_sql(DISH_NAMES[:20], "page_id") + " AS item_name FROM pages)")
def text_grid_long(spark, sf_dir):
    n = F.col(_N)
    marks = [F.when(pick(_MARKS, n + j) == '<img alt="yes">', "yes").otherwise(pick(_MARKS, n + j)) for j in range(3)]
    grid = F.array(F.array(F.lit("Item"), F.lit("Milk"), F.lit("Egg"), F.lit("Peanuts")), F.array(pick(DISH_NAMES[:20], n), *marks))
    grids = table(spark, sf_dir, "pages").select("page_id", grid.alias("grid"))
    return x.text_grid_long(grids, "page_id").select("page_id", "item_name", F.array_join("allergen_terms", ",").alias("allergen_terms"))


# --- JSON -----------------------------------------------------------------------------------
# Every page holds its JSON some levels deeper than the one before; the SQL opens it by a recursive query.
def _depth(n):
    return n % 23


def _sunk(before, body, after, n):
    """``body`` below as many levels as the page's number says."""
    depth = _depth(n).cast("int")
    return F.concat(F.repeat(F.lit(before), depth), body, F.repeat(F.lit(after), depth))


def _opened_sql(html: str, pattern: str, graph: bool = False) -> str:
    """``walk(page_id, ord, j)``: JSON texts of the pages and all values below them (lists and @graph alone with ``graph``)."""
    below = ("CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN "
             + ("list_filter([json_extract(j, '$.\"@graph\"')], lambda g: g IS NOT NULL)" if graph else "json_extract(j, '$.*')") + " ELSE [] END")
    return (f"walk AS (SELECT page_id, regexp_extract(html, '{pattern}', 1)::JSON AS j FROM {html} UNION ALL "
            f"SELECT page_id, unnest({below}) AS j FROM walk WHERE json_type(j) IN ('ARRAY', 'OBJECT'))")


def _ld(n):
    name, other = pick(DISH_NAMES[:20], n), pick(DISH_NAMES[:20], n + 5)
    deeper = _sunk('{"name":"","menuSection":[', F.concat(F.lit('{"name":"Depths","hasMenuItem":[{"name":"'), pick(DISH_NAMES[:20], n + 9), F.lit('","price":"7.0"}]}')), "]}", n)
    menu = F.concat(
        F.lit('[{"@type":"Restaurant","name":"R","hasMenu":"/our-menu"},'
              '{"@type":"Menu","hasMenuSection":{"name":"Mains","hasMenuItem":[{"@type":"MenuItem","name":"'), name,
        F.lit('","description":"with milk","offers":{"price":"'), (n % 30 + 5).cast("string"), F.lit('.00"}}],"hasMenuSection":[{"name":"Specials","hasMenuItem":{"name":"'), other,
        F.lit('","price":"$12"}},'), deeper, F.lit("]}}]"))
    return F.concat(F.lit('<script type="application/ld+json">'), _sunk('{"@graph":[', F.concat(F.lit('{"@context":"https://schema.org","@graph":'), menu, F.lit("}")), "]}", n), F.lit("</script>"))


def _ld_pages(spark, sf_dir):
    return _marked_up(spark, sf_dir, _ld(F.col(_N)))


def _repeated(text: str) -> str:
    return f"repeat('{text}', CAST(page_id % 23 AS INTEGER))"


_LD_SQL = (
    "(SELECT page_id, '<script type=\"application/ld+json\">' || " + _repeated('{"@graph":[') + """ || '{"@context":"https://schema.org","@graph":[{"@type":"Restaurant","name":"R","hasMenu":"/our-menu"},'"""
    """ || '{"@type":"Menu","hasMenuSection":{"name":"Mains","hasMenuItem":[{"@type":"MenuItem","name":"' || """ + pick_sql(DISH_NAMES[:20], "page_id")
    + """ || '","description":"with milk","offers":{"price":"' || (page_id % 30 + 5) || '.00"}}],"hasMenuSection":[{"name":"Specials","hasMenuItem":{"name":"' || """ + pick_sql(DISH_NAMES[:20], "page_id + 5")
    + """ || '","price":"$12"}},' || """ + _repeated('{"name":"","menuSection":[') + """ || '{"name":"Depths","hasMenuItem":[{"name":"' || """ + pick_sql(DISH_NAMES[:20], "page_id + 9") + """ || '","price":"7.0"}]}' || """
    + _repeated("]}") + """ || ']}}]}' || """ + _repeated("]}") + " || '</script>' AS html FROM pages)")
_LD_TEXT = "(?s)ld[+]json[^>]*>(.*?)</script>"


@query("json_ld_objects", "TX-6",
       "WITH RECURSIVE " + _opened_sql(_LD_SQL, _LD_TEXT, graph=True) + " SELECT page_id, coalesce(j->>'@type', '') AS object_type FROM walk WHERE json_type(j) = 'OBJECT'")
def json_ld_objects(spark, sf_dir):
    return x.json_ld_objects(_ld_pages(spark, sf_dir)).select("page_id", F.coalesce(F.get_json_object("object", "$['@type']"), F.lit("")).alias("object_type"))


def _listed_sql(value: str) -> str:
    return f"CASE json_type({value}) WHEN 'ARRAY' THEN json_extract({value}, '$[*]') WHEN 'OBJECT' THEN [{value}] ELSE [] END"


@query("schema_menu_items", "TX-7",
       "WITH RECURSIVE " + _opened_sql(_LD_SQL, _LD_TEXT, graph=True) + ", section(page_id, category, s) AS ("
       "SELECT page_id, coalesce(nullif(s->>'name', ''), ''), s FROM (SELECT page_id, unnest(" + _listed_sql("json_extract(j, '$.hasMenuSection')") + ") AS s FROM walk WHERE j->>'@type' = 'Menu') UNION ALL "
       "SELECT page_id, coalesce(nullif(c->>'name', ''), category), c FROM (SELECT page_id, category, unnest(" + _listed_sql("coalesce(json_extract(s, '$.hasMenuSection'), json_extract(s, '$.menuSection'))") + ") AS c FROM section)) "
       "SELECT page_id, i->>'name' AS item_name, category, regexp_replace(coalesce(i->'offers'->>'price', i->>'price'), '[.]0+$', '') AS price FROM (SELECT page_id, category, unnest("
       + _listed_sql("json_extract(s, '$.hasMenuItem')") + ") AS i FROM section) QUALIFY row_number() OVER (PARTITION BY page_id, category, item_name, price) = 1")
def schema_menu_items(spark, sf_dir):
    return x.schema_menu_items(_ld_pages(spark, sf_dir)).select("page_id", "item_name", "category", "price")


@query("schema_menu_links", "TX-15",
       "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/our-menu' AS link, 'schema_org_menu' AS source_type FROM pages")
def schema_menu_links(spark, sf_dir):
    return x.schema_menu_links(_ld_pages(spark, sf_dir)).select("page_id", F.col("url").alias("link"), "source_type")


@query("microdata_items", "TX-8",
       f"SELECT page_id, {pick_sql(DISH_NAMES[:20], 'page_id')} AS item_name, 'Grill' AS category, CAST(page_id % 40 + 3 AS VARCHAR) AS price FROM pages")
def microdata_items(spark, sf_dir):
    n = F.col(_N)
    markup = F.concat(F.lit('<div itemscope itemtype="https://schema.org/MenuSection"><h2 itemprop="name">Grill</h2><div itemtype="https://schema.org/MenuItem"><span itemprop="name">'),
                      pick(DISH_NAMES[:20], n), F.lit('</span><meta itemprop="price" content="'), (n % 40 + 3).cast("string"), F.lit('.0"></div></div>'))
    return x.microdata_items(_marked_up(spark, sf_dir, markup)).select("page_id", "item_name", "category", "price")


def _state_pages(spark, sf_dir, before, body, after):
    return _marked_up(spark, sf_dir, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), _sunk(before, body, after, F.col(_N)), F.lit("</script>")))


_STATE_TEXT = "(?s)application/json\">(.*?)</script>"
_ITEM_STATE = ("(SELECT page_id, '<script type=\"application/json\">' || " + _repeated('{"props":[0,[') + """ || '{"menus":[{"items":[{"name":"' || """ + pick_sql(DISH_NAMES[:20], "page_id")
               + """ || '","price":' || ((page_id % 20 + 1) * 100 + 95) || '},{"title":"Plain Tea","cost":"3","id":7}]}]}' || """ + _repeated(']],"name":"no price"}') + " || '</script>' AS html FROM pages)")


@query("embedded_json_items", "TX-12",
       "WITH RECURSIVE " + _opened_sql(_ITEM_STATE, _STATE_TEXT) + " SELECT DISTINCT page_id, coalesce(j->>'name', j->>'title') AS item_name, CASE WHEN json_type(j, '$.price') = 'UBIGINT' "
       "THEN '$' || CAST((j->>'price')::BIGINT // 100 AS VARCHAR) || '.' || lpad(CAST((j->>'price')::BIGINT % 100 AS VARCHAR), 2, '0') ELSE '$' || (j->>'cost') END AS price FROM walk "
       "WHERE json_type(j) = 'OBJECT' AND coalesce(j->>'price', j->>'cost') IS NOT NULL AND coalesce(j->>'name', j->>'title') IS NOT NULL")
def embedded_json_items(spark, sf_dir):
    n = F.col(_N)
    body = F.concat(F.lit('{"menus":[{"items":[{"name":"'), pick(DISH_NAMES[:20], n), F.lit('","price":'), ((n % 20 + 1) * 100 + 95).cast("string"),
                    F.lit('},{"title":"Plain Tea","cost":"3","id":7}]}]}'))
    return x.embedded_json_items(_state_pages(spark, sf_dir, '{"props":[0,[', body, ']],"name":"no price"}')).select("page_id", "item_name", "price")


_ALLERGEN_STATE = ("(SELECT page_id, '<script type=\"application/json\">' || " + _repeated('[{"a":') + """ || '{"dishes":[{"name":"' || """ + pick_sql(DISH_NAMES[:20], "page_id")
                   + """ || '","allergens":' || CASE WHEN page_id % 2 = 0 THEN '["Milk","Egg"]' ELSE '["Soy","Peanut"]' END || '},{"name":{"en":"Flag Soup"},"flags":{"wheat":true,"milk":false}},"""
                   """{"label":"Row Pie","list":[{"name":"Sesame","contains":"yes"},{"name":"Crab","contains":"no"}]}]}' || """ + _repeated("}]") + " || '</script>' AS html FROM pages)")


@query("embedded_allergen_items", "TX-13",
       "WITH RECURSIVE " + _opened_sql(_ALLERGEN_STATE, _STATE_TEXT) + ", word AS ("
       "SELECT page_id, j->>'name' AS item_name, unnest(json_extract_string(j, '$.allergens[*]')) AS w FROM walk WHERE json_type(j, '$.allergens') = 'ARRAY' UNION ALL "
       "SELECT page_id, j->'name'->>'en', unnest(list_filter(json_keys(j, '$.flags'), lambda k: json_extract_string(j, '$.flags.' || k) = 'true')) FROM walk WHERE json_type(j, '$.flags') = 'OBJECT' UNION ALL "
       "SELECT page_id, label, f->>'name' FROM (SELECT page_id, j->>'label' AS label, unnest(json_extract(j, '$.list[*]')) AS f FROM walk WHERE json_type(j, '$.list') = 'ARRAY') WHERE f->>'contains' = 'yes') "
       "SELECT page_id, item_name, array_to_string(list_sort(list(DISTINCT lower(w))), ',') AS allergen_terms FROM word GROUP BY page_id, item_name")
def embedded_allergen_items(spark, sf_dir):
    n = F.col(_N)
    body = F.concat(F.lit('{"dishes":[{"name":"'), pick(DISH_NAMES[:20], n), F.lit('","allergens":'), F.when(n % 2 == 0, '["Milk","Egg"]').otherwise('["Soy","Peanut"]'),
                    F.lit('},{"name":{"en":"Flag Soup"},"flags":{"wheat":true,"milk":false}},{"label":"Row Pie","list":[{"name":"Sesame","contains":"yes"},{"name":"Crab","contains":"no"}]}]}'))
    return x.embedded_allergen_items(_state_pages(spark, sf_dir, '[{"a":', body, "}]")).select("page_id", "item_name", F.array_join("allergen_terms", ",").alias("allergen_terms"))
