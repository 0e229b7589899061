"""Restaurant-shaped views of the given tables, in Spark and in SQL.

The given tables hold no food vocabulary, so places, links and dishes are
derived from their keys by the same arithmetic on both sides. Every view keeps
one row per source row, so its size (and every query on it) grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dinesight.functions.literals import text_array
from dinesight.operators.common import spread


TEXT_TABLES = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the ones holding long texts are dealt out when they scan as too few pieces."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in TEXT_TABLES else scan


def pick(values: list[str], key: Column) -> Column:
    """The value a key selects, round-robin."""
    return F.element_at(text_array(values), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def pick_sql(values: list[str], key: str) -> str:
    return f"list_extract({sql_list(values)}, CAST(({key}) % {len(values)} AS INTEGER) + 1)"


def with_tables(body: str, **tables: str) -> str:
    """``body`` with the derived views it names as leading CTEs."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in tables.items()) + "\n" + body


# --- Places: customers and suppliers as records of two providers -----------------
NAME_HEADS = ["Golden", "Blue", "Thai", "Little", "Royal", "Sushi", "Green"]
NAME_TAILS = ["Kitchen", "Diner", "Garden", "House", "Bakery"]
ADDRESS_TAILS = [
    "Cupertino, CA 95014, USA", "London, United Kingdom", "Salem, Oregon", "Tbilisi, Georgia",
    "Atlanta, Georgia 30301", "Al Barsha - Dubai - United Arab Emirates", "Santa Monica, CA 90401, USA", "Oslo, Norway",
]
SITE_TAILS = [".com/", ".co.uk/menu/", ".de/speisekarte#top", ".com/locations/salem?utm_source=x", ".co.nz", ".no/"]
CATEGORY_LISTS = [
    "cuisine:thai;indian|amenity:restaurant", "primary_type:italian_restaurant|restaurant|food",
    "catering.restaurant.mexican|catering", "amenity:cafe", "primary_type:shopping_mall|food_court",
    "restaurant|point_of_interest", "cuisine:japanese|diet:vegan:yes|vegan",
]
_PLACE_COLUMNS = ("restaurant_id", "k", "source_name", "name", "address", "latitude", "longitude", "website_url",
                  "phone_number", "opening_hours", "categories", "source_last_updated")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spread(table(spark, sf_dir, "customer").select(F.lit("c").alias("p"), F.col("c_custkey").alias("k"))
                  .unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("p"), F.col("s_suppkey").alias("k"))))
    k = F.col("k")
    name = F.concat(pick(NAME_HEADS, k), F.lit(" "), pick(NAME_TAILS, k))
    return keys.select(
        F.concat("p", F.col("k").cast("string")).alias("restaurant_id"), k,
        F.when(F.col("p") == "c", "geoapify").otherwise("openstreetmap").alias("source_name"),
        F.when(k % 41 != 0, name).alias("name"),
        F.when(k % 37 != 0, F.concat((k % 900 + 10).cast("string"), F.lit(" Main St, "), pick(ADDRESS_TAILS, k)))
        .alias("address"),
        (F.lit(37.0) + (k * 37 % 1000) / 20000.0).alias("latitude"),
        (F.lit(-122.0) + (k * 91 % 1000) / 20000.0).alias("longitude"),
        F.when(k % 3 != 0, F.concat(F.lit("https://www."), F.lower(pick(NAME_HEADS, k)), F.lower(pick(NAME_TAILS, k)),
                                    pick(SITE_TAILS, k))).alias("website_url"),
        F.when(k % 3 == 0, F.concat(F.lit("+1 555 010 "), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone_number"),
        F.when(k % 4 == 0, F.lit("Mo-Su 10:00-22:00")).alias("opening_hours"),
        F.split(pick(CATEGORY_LISTS, k), r"\|").alias("categories"),
        F.when(k % 5 == 0, F.lit("2026-06-16")).when(k % 5 == 1, F.lit(" ")).alias("source_last_updated"))


PLACES_SQL = f"""
SELECT p || CAST(k AS VARCHAR) AS restaurant_id, k,
  CASE WHEN p = 'c' THEN 'geoapify' ELSE 'openstreetmap' END AS source_name,
  CASE WHEN k % 41 <> 0 THEN {pick_sql(NAME_HEADS, 'k')} || ' ' || {pick_sql(NAME_TAILS, 'k')} END AS name,
  CASE WHEN k % 37 <> 0 THEN CAST(k % 900 + 10 AS VARCHAR) || ' Main St, ' || {pick_sql(ADDRESS_TAILS, 'k')} END AS address,
  CAST(37.0 AS DOUBLE) + (k * 37 % 1000) / CAST(20000 AS DOUBLE) AS latitude,
  CAST(-122.0 AS DOUBLE) + (k * 91 % 1000) / CAST(20000 AS DOUBLE) AS longitude,
  CASE WHEN k % 3 <> 0 THEN 'https://www.' || lower({pick_sql(NAME_HEADS, 'k')}) || lower({pick_sql(NAME_TAILS, 'k')})
    || {pick_sql(SITE_TAILS, 'k')} END AS website_url,
  CASE WHEN k % 3 = 0 THEN '+1 555 010 ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone_number,
  CASE WHEN k % 4 = 0 THEN 'Mo-Su 10:00-22:00' END AS opening_hours,
  string_split({pick_sql(CATEGORY_LISTS, 'k')}, '|') AS categories,
  CASE WHEN k % 5 = 0 THEN '2026-06-16' WHEN k % 5 = 1 THEN ' ' END AS source_last_updated
FROM (SELECT 'c' AS p, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier)
"""

# --- Links: pages as candidate menu documents ------------------------------------------
LINK_HOSTS = ["www.goldendiner.com", "order.toasttab.com", "bluegarden.co.uk", "menu.thaihouse.de", "www.facebook.com",
              "cdn.files.net", "royalkitchen.co.nz", "allmenus.com"]
LINK_PATHS = [
    "/menu/", "/wp-content/uploads/2023/05/dinner-menu.pdf?v=2", "/allergens", "/files/menu-2021-2022.pdf",
    "/img/menu-board.png", "/order/online", "/docs/menu_020422.pdf", "/docs/menu-20240317.pdf#p2",
    "/locations/santa-monica/menu", "/about", "/nutrition?lang=en", "/2019/11/dinner-menu.pdf", "/cupertino/lunch",
]
LINK_TEXTS = ["Menu", "Allergen guide", "Order online", "About us", "Unsere Speisekarte", "Nutrition info",
              "Food allergy advice", "Menú del día", "Dinner & drinks", ""]


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        i.alias("link_id"), F.concat(F.lit("r"), (i % 20).cast("string")).alias("restaurant_id"),
        F.concat(F.lit("https://"), pick(LINK_HOSTS, i), pick(LINK_PATHS, i)).alias("url"),
        pick(LINK_TEXTS, i).alias("anchor"),
        F.concat(pick(NAME_HEADS, i % 20), F.lit(" "), pick(NAME_TAILS, i % 20)).alias("name"),
        F.concat(F.lit("1 Main St, "), pick(ADDRESS_TAILS, i % 20)).alias("address"),
        F.element_at(F.array(F.lit("US"), F.lit("GB"), F.lit("DE"), F.lit(None).cast("string")),
                     (i % 4 + 1).cast("int")).alias("home"),
        ((i * 7 % 100) / 100.0).alias("confidence"),
        pick(["validated", "unvalidated", "not_fetchable", "rejected"], i).alias("validation_status"))


LINKS_SQL = f"""
SELECT page_id AS link_id, 'r' || CAST(page_id % 20 AS VARCHAR) AS restaurant_id,
  'https://' || {pick_sql(LINK_HOSTS, 'page_id')} || {pick_sql(LINK_PATHS, 'page_id')} AS url,
  {pick_sql(LINK_TEXTS, 'page_id')} AS anchor,
  {pick_sql(NAME_HEADS, 'page_id % 20')} || ' ' || {pick_sql(NAME_TAILS, 'page_id % 20')} AS name,
  '1 Main St, ' || {pick_sql(ADDRESS_TAILS, 'page_id % 20')} AS address,
  list_extract(['US', 'GB', 'DE', NULL], CAST(page_id % 4 AS INTEGER) + 1) AS home,
  (page_id * 7 % 100) / CAST(100 AS DOUBLE) AS confidence,
  {pick_sql(["validated", "unvalidated", "not_fetchable", "rejected"], 'page_id')} AS validation_status
FROM pages
"""

# --- Dishes: line items as dish rows -----------------------------------------------------
DISH_NAMES = [
    "Pad Thai", "Garden Salad", "Chicken Satay", "Guacamole", "Mole Poblano", "Almond Croissant", "Walnut Brownie",
    "Coconut Macaroon", "French Macaron", "Beef Burger", "Margherita Pizza", "Pesto Pasta", "Miso Soup", "Eggplant Curry",
    "Cheese Plate", "Nut-Free Cookie", "Peanut Sauce Udon", "Baklava", "Buckwheat Pancakes", "Grilled Salmon",
    "Vegan Caesar", "Shrimp Tempura", "Tofu Bowl", "Lemon Tart", "Butter Chicken", "Tahini Dip", "Steamed Rice",
    "Oyster Mushroom Stir Fry", "Egg Fried Rice", "Hazelnut Gelato", "Apple Strudel", "Home", "lowercase dish",
]
DISH_TEXTS = ["", "with coconut milk", "served with peanut butter", "in a creamy alfredo sauce", "gluten-free on request",
              "dairy free, may contain nuts", "panko crust and soy sauce"]
DISH_TERMS = ["", "milk|gluten", "peanut", "tree nut|egg", "milk", "may contain milk", "fish|soy", "almond"]
DISH_CROSS = ["", "", "tree nut", "", "peanut|milk"]
DISH_COLUMNS = ["peanut|tree nut|milk", "milk|egg|gluten", "peanut|milk|soy"]
DISH_METHODS = ["allergen_matrix", "gemini_text", "html_visible_text", "community_mention", "schema_org_menu_item"]


def _split(values: list[str], key: Column) -> Column:
    return F.filter(F.split(pick(values, key), r"\|"), lambda t: F.length(t) > 0)


def _split_sql(values: list[str], key: str) -> str:
    return f"list_filter(string_split({pick_sql(values, key)}, '|'), lambda t: length(t) > 0)"


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    order = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    return spread(lines).select(
        F.concat(F.lit("s"), supplier.cast("string")).alias("restaurant_id"), supplier.alias("k"),
        F.concat(F.lpad(order.cast("string"), 14, "0"), line.cast("string"), F.lpad(part.cast("string"), 12, "0"),
                 F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 3, "0")).alias("arrival"),
        pick(DISH_NAMES, part).alias("item_name"), pick(DISH_TEXTS, part * 7 + line).alias("description"),
        F.when(line % 2 == 0, F.concat(F.lit("$"), F.col("l_quantity").cast("bigint").cast("string"))).otherwise("").alias("price"),
        pick(["Starters", "Mains", ""], line).alias("category"),
        _split(DISH_TERMS, part * 3 + line).alias("allergen_terms"), _split(DISH_CROSS, part + order).alias("cross_contact_terms"),
        _split(["", "vegan", "vegetarian|gluten-free", ""], part + line).alias("dietary_terms"),
        pick(DISH_METHODS, supplier * 3 + line % 2 * (supplier % 3)).alias("extraction_method"),
        _split(DISH_COLUMNS, supplier).alias("matrix_allergen_columns"),
        F.concat(F.lit("https://"), pick(LINK_HOSTS, supplier), F.lit("/"), pick(["2024", "2019", "menu"], line)).alias("menu_source_url"),
        pick(["website_link", "pdf", "community", "ordering_page"], supplier + line).alias("source_type"),
        F.round(F.lit(0.4) + F.col("l_discount") * 5, 2).alias("confidence"))


DISHES_SQL = f"""
SELECT 's' || CAST(l_suppkey AS VARCHAR) AS restaurant_id, l_suppkey AS k,
  lpad(CAST(l_orderkey AS VARCHAR), 14, '0') || CAST(l_linenumber AS VARCHAR) || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
    || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0') AS arrival,
  {pick_sql(DISH_NAMES, 'l_partkey')} AS item_name, {pick_sql(DISH_TEXTS, 'l_partkey * 7 + l_linenumber')} AS description,
  CASE WHEN l_linenumber % 2 = 0 THEN '$' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END AS price,
  {pick_sql(["Starters", "Mains", ""], 'l_linenumber')} AS category,
  {_split_sql(DISH_TERMS, 'l_partkey * 3 + l_linenumber')} AS allergen_terms,
  {_split_sql(DISH_CROSS, 'l_partkey + l_orderkey')} AS cross_contact_terms,
  {_split_sql(["", "vegan", "vegetarian|gluten-free", ""], 'l_partkey + l_linenumber')} AS dietary_terms,
  {pick_sql(DISH_METHODS, 'l_suppkey * 3 + l_linenumber % 2 * (l_suppkey % 3)')} AS extraction_method,
  {_split_sql(DISH_COLUMNS, 'l_suppkey')} AS matrix_allergen_columns,
  'https://' || {pick_sql(LINK_HOSTS, 'l_suppkey')} || '/' || {pick_sql(["2024", "2019", "menu"], 'l_linenumber')} AS menu_source_url,
  {pick_sql(["website_link", "pdf", "community", "ordering_page"], 'l_suppkey + l_linenumber')} AS source_type,
  round(CAST(0.4 AS DOUBLE) + l_discount * 5, 2) AS confidence
FROM lineitem
"""
