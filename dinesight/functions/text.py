"""Text normalisation, price, name-gate and score expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from dinesight.functions.literals import (
    alternation, contained, contains_any, count_contained, ends_with_any, let, text_array)
from dinesight.vocab import web


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """Collapse whitespace runs and trim; a blank that stands alone is left as it is."""
    return F.trim(F.regexp_replace(blank_to_empty(c), r"(?U) \s+|[^\S ]\s*", " "))


def norm_ws(c: Column) -> Column:
    """Lower-case, collapsed, trimmed: the usual match key."""
    return F.lower(clean_text(c))


def strip_ws(c: Column) -> Column:
    """Lower-case with all whitespace removed (survives letter-spaced text)."""
    return F.regexp_replace(F.lower(blank_to_empty(c)), r"(?U)\s+", "")


def norm_key(c: Column) -> Column:
    """Lower-case letters and digits only: the entity and dish key."""
    return F.regexp_replace(F.lower(blank_to_empty(c)), "[^a-z0-9]+", "")


def slugify(c: Column, default: str = "item") -> Column:
    """Identifier-safe slug, with a default for empty results."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(slug) > 0, slug).otherwise(F.lit(default))


def hyphen_slug(c: Column) -> Column:
    """Alphanumeric runs joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(blank_to_empty(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def has_value(c: Column, kind: str = "string") -> Column:
    """Non-null; strings non-blank; collections non-empty."""
    if kind == "string":
        return c.isNotNull() & (F.length(F.trim(c)) > 0)
    if kind == "collection":
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def quality_score(fields: dict[str, str]) -> Column:
    """Share of the named fields that carry a value: {column: kind}."""
    present = sum((has_value(F.col(name), kind).cast("int") for name, kind in fields.items()), F.lit(0))
    return F.round(present / F.lit(len(fields)), 3)


# Letters folded by hand (fixed values); everything else folds by the rule below.
_FOLD_PAIRS = {"æ": "ae", "ð": "d", "þ": "th", "ß": "ss", "ø": "o"}


def _fold_table() -> tuple[str, str]:
    """Single letters whose compatibility form is one base letter plus marks."""
    source, target = [], []
    for code in [*range(0x00A0, 0x2000), *range(0xFF01, 0xFF5F)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch and ch not in _FOLD_PAIRS:
            source.append(ch)
            target.append(base)
    for ch, base in _FOLD_PAIRS.items():
        if len(base) == 1:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold_accents(c: Column) -> Column:
    """Lower-case without diacritics, words kept."""
    folded = F.translate(F.lower(blank_to_empty(c)), _FOLD_FROM, _FOLD_TO)
    for ch, base in _FOLD_PAIRS.items():
        if len(base) > 1:
            folded = F.replace(folded, F.lit(ch), F.lit(base))
    return F.regexp_replace(folded, r"\p{M}+", "")


def norm_locality(c: Column) -> Column:
    """Accent-folded letters and digits only."""
    return F.regexp_replace(fold_accents(c), r"[^\p{L}\p{N}]+", "")


def words(c: Column, min_length: int = 1) -> Column:
    """Lower-case alphanumeric tokens."""
    tokens = F.split(F.lower(blank_to_empty(c)), "[^a-z0-9]+")
    return F.filter(tokens, lambda t: F.length(t) >= min_length)


def trim_text(c: Column, limit: int) -> Column:
    """Collapse, then cut at the last space within the limit."""
    text = clean_text(c)
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.trim(F.regexp_replace(cut, r" [^ ]*$", "")))


# --- HTML ---------------------------------------------------------------------
_HTML_HINT = r"(?i)<(?:!doctype|html|head|body|script|style|meta|link|div)[\s>]"
_HTML_DROP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"


def drop_markup(c: Column) -> Column:
    """Remove comments, scripts, styles and tags unconditionally."""
    return F.regexp_replace(F.regexp_replace(blank_to_empty(c), _HTML_DROP, " "), "<[^>]*>", " ")


def visible_text(c: Column) -> Column:
    """Human-visible text of HTML; plain text passes through."""
    return F.when(c.rlike(_HTML_HINT), drop_markup(c)).otherwise(c)


def page_lines(html: Column) -> Column:
    """Cleaned non-empty visible lines: a break at every tag boundary."""
    text = F.regexp_replace(F.regexp_replace(blank_to_empty(html), _HTML_DROP, "\n"), "<[^>]*>", "\n")
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda line: clean_text(line))
    return F.filter(lines, lambda line: F.length(line) > 0)


def looks_js_empty(html: Column) -> Column:
    """An application root on a small page: content is rendered client-side."""
    return contains_any(F.lower(html), web.APP_ROOT_MARKS) & (F.length(html) < 60000)


def payload_kind(html: Column, has_grid: Column | None = None) -> Column:
    """empty / structured / text, by explicit schema only."""
    low = F.lower(html)
    structured = ((low.contains("schema.org") & (low.contains("menuitem") | low.contains('"menu"')))
                  | low.contains("__next_data__") | low.contains('type="application/json"'))
    if has_grid is not None:
        structured = structured | F.coalesce(has_grid, F.lit(False))
    return (F.when(html.isNull() | (F.length(clean_text(html)) == 0), "empty")
            .when(structured, "structured").otherwise("text"))


# --- Prices -------------------------------------------------------------------
def extract_prices(c: Column) -> Column:
    """Price strings, any currency."""
    return F.regexp_extract_all(c, F.lit(web.PRICE_PATTERN), F.lit(0))


def price_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(web.PRICE_PATTERN))


def bare_prices(line: Column) -> Column:
    """Plausible bare numeric prices of a line without a currency price.

    Each candidate is kept only when its neighbours do not mark it as a size,
    time, calorie or legal reference, and its value lies in 2..175.
    """
    follow = alternation(web.PRICE_FOLLOWERS)
    pattern = (r"(?iU)(?<![\w.$])(?<!(?:" + alternation(web.PRICE_PRECEDERS) + r")\s{0,8})"
               r"((?:[2-9]|[1-9]\d|1\d{2})(?:\.\d{1,2})?)(?![\w.])(?!\s{0,7}(?:\p{L}|-|‑|" + follow + "))")
    hits = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    plausible = F.filter(hits, lambda v: v.cast("double").between(2, 175))
    low = F.lower(line)
    blocked = contains_any(low, web.NON_MENU_PHRASES) | low.rlike(r"(?U)\b(?:fy|form|section)\s*\d")
    return F.when(blocked, text_array([])).otherwise(plausible)


def line_prices(line: Column, allow_bare: bool = False) -> Column:
    """Currency prices; bare numbers only when the line has none."""
    priced = extract_prices(line)
    if not allow_bare:
        return priced
    return F.when(F.size(priced) > 0, priced).otherwise(bare_prices(line))


def dedupe_text(c: Column) -> Column:
    """Words only, ampersand spelled out."""
    spelled = F.replace(F.lower(blank_to_empty(c)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def dedupe_price(c: Column) -> Column:
    """Numeric price key: no thousands commas, no trailing zeros."""
    number = F.regexp_extract(F.replace(blank_to_empty(c), F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0)
    trimmed = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(trimmed, r"^0+(?=\d)", "")


def price_value(c: Column) -> Column:
    """Numeric value beside the raw price string."""
    number = F.regexp_extract(F.replace(blank_to_empty(c), F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0)
    return number.try_cast("decimal(12,2)")


def price_ok(c: Column) -> Column:
    """A real price: currency symbol or code, or a two-decimal amount."""
    text = F.trim(blank_to_empty(c))
    return ((F.length(text) > 0)
            & (text.rlike(f"[{web.CURRENCY_SYMBOLS}]") | text.rlike("(?iU)" + web.CURRENCY_CODES)
               | text.rlike(r"\d+[.,]\d{2}(?!\d)")))


# --- Dish-name gates ------------------------------------------------------------
def _space_words(c: Column) -> Column:
    return F.filter(F.split(blank_to_empty(c), r"(?U)\s+"), lambda w: F.length(w) > 0)


def _repeats(tokens: Column) -> Column:
    distinct = F.size(F.array_distinct(F.transform(tokens, lambda w: F.lower(w))))
    return (F.size(tokens) >= 4) & (distinct <= F.floor(F.size(tokens) / 2))


def is_negative_text(c: Column) -> Column:
    return contains_any(F.lower(c), web.NEGATIVE_ITEM_WORDS)


def looks_like_category(c: Column) -> Column:
    """A line that is exactly a known menu section name."""
    low = F.trim(F.lower(blank_to_empty(c)))
    key = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    keys = sorted(set(web.CATEGORY_LINES))
    return ~low.rlike(web.PRICE_PATTERN) & (F.length(low) <= 45) & key.isin(keys)


def looks_like_item_name(c: Column) -> Column:
    """Gates a dish name must pass: length, letters, case, noise, run-ons."""
    low = F.lower(c)
    stripped = F.regexp_replace(low, r"^[ .!*#|]+|[ .!*#|]+$", "")
    tokens = _space_words(c)
    digits = F.regexp_count(c, F.lit(r"\p{Nd}"))
    return F.coalesce(
        F.length(c).between(2, 80)
        & ~low.isin(web.TOTAL_WORDS)
        & ~is_negative_text(c)
        & c.rlike(r"\p{L}")
        & ~stripped.isin(web.NON_DISH_EXACT)
        & ~contains_any(low, web.NON_DISH_PHRASES)
        & ~_repeats(tokens)
        & ~c.rlike(r"^[(\[\"'¡¿]*\p{Ll}")
        & ~ends_with_any(F.regexp_replace(low, r"(?U)\s+$", ""), web.NAME_END_CONNECTORS)
        & (F.size(tokens) <= 10)
        & ~c.rlike(f"[{web.SENTENCE_MARKS}]")
        & (digits / F.length(c) <= 0.5), F.lit(False))


def looks_noise(c: Column) -> Column:
    """Evaluation-time test: the text is not a clean dish name."""
    name = F.trim(blank_to_empty(c))
    low = F.lower(name)
    stripped = F.regexp_replace(low, r"^[ .!*#|]+|[ .!*#|]+$", "")
    tokens = _space_words(name)
    digits = F.regexp_count(name, F.lit(r"\p{Nd}"))
    return (~F.length(name).between(2, 60)
            | ~name.rlike(r"(?i)[a-zÀ-ʸऀ-퟿]")
            | stripped.isin(web.NON_DISH_EXACT) | contains_any(low, web.NON_DISH_PHRASES)
            | _repeats(tokens) | name.rlike(r"^\p{Ll}") | low.isin(web.NOISE_MODIFIERS)
            | ends_with_any(low, web.NOISE_ENDINGS) | contains_any(low, web.NOISE_UI_WORDS)
            | name.rlike(web.SIZE_LINE) | name.rlike(web.TIME_LINE)
            | name.rlike(f"[{web.NOISE_MARKS}]") | (F.size(tokens) > 8)
            | ((digits > 0) & (digits / F.length(name) > 0.4)))


def strip_size_suffix(c: Column) -> Column:
    """Peel size and variant decoration off the end, repeatedly."""
    body = web.SIZE_SUFFIX.removeprefix("(?i)").removesuffix(r"\s*$")
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)(?:" + body + r"\s*)+$", ""))


_EDGE = r"[()\[\]{}.,;:!?'\"]*"
_TITLE = rf"{_EDGE}(?:\p{{Lu}}\S*|[^\p{{Ll}}\s]*\p{{Lu}}[^\p{{Ll}}\s]*)(?=\s|$)"
_JOINER = rf"{_EDGE}(?i:{alternation(web.NAME_CONNECTORS)}){_EDGE}(?=\s+{_TITLE})"
_TITLE_RUN = rf"^(?:{_TITLE}|{_JOINER})(?:\s+(?:{_TITLE}|{_JOINER})){{0,7}}"


def split_name_description(c: Column) -> Column:
    """struct(name, description): separator, then title words, then four words."""
    spaced = clean_text(c)
    run = F.regexp_extract(spaced, _TITLE_RUN, 0)
    n_words = F.regexp_count(spaced, F.lit(" ")) + 1

    def pieces(head: Column, tail: Column) -> Column:
        return F.struct(F.trim(head).alias("name"), F.trim(tail).alias("description"))

    def after(head: Column) -> Column:
        return pieces(head, spaced.substr(F.length(head) + 1, F.length(spaced)))

    result = F.when(run.contains(" ") & (F.length(run) < F.length(spaced)), after(run)) \
        .when(n_words >= 7, after(F.substring_index(spaced, " ", 4))).otherwise(pieces(c, F.lit("")))
    for separator in reversed([" - ", " – ", " — ", ": "]):
        head = F.substring_index(c, separator, 1)
        result = F.when(c.contains(separator),
                        pieces(head, c.substr(F.length(head) + len(separator) + 1, F.length(c)))).otherwise(result)
    return result


def item_confidence(category: Column, description: Column, has_terms: Column) -> Column:
    """Confidence of a text-parsed dish row."""
    score = (F.lit(0.55) + F.when(has_value(category), 0.15).otherwise(0.0)
             + F.when(has_value(description), 0.15).otherwise(0.0) + F.when(has_terms, 0.10).otherwise(0.0))
    return F.round(F.least(score, F.lit(0.95)), 2)


def schema_item_confidence(price: Column, category: Column, description: Column) -> Column:
    """Confidence of a schema-declared dish row."""
    score = (F.lit(0.9) + F.when(has_value(price), 0.05).otherwise(0.0)
             + F.when(has_value(category), 0.03).otherwise(0.0) + F.when(has_value(description), 0.02).otherwise(0.0))
    return F.round(F.least(score, F.lit(0.99)), 2)


# --- Page scores -----------------------------------------------------------------
def score_page_text(c: Column) -> Column:
    """struct(score, strict_count, item_count, price_count) of a page's text."""
    low = F.lower(c)
    strict, hints, prices = (count_contained(low, web.STRICT_MENU_WORDS),
                             count_contained(low, web.MENU_ITEM_HINTS), price_count(low))
    score = (F.least(strict * 0.12, F.lit(0.35))
             + F.when(hints >= 3, F.least(hints * 0.04, F.lit(0.35))).otherwise(0.0)
             + F.when(prices >= 3, 0.25).otherwise(0.0))
    return F.struct(score.alias("score"), strict.alias("strict_count"), hints.alias("item_count"),
                    prices.alias("price_count"))


def mentions_entity(text: Column, name: Column, mode: str = "all") -> Column:
    """The text names the entity: compact match, or all / most of its words."""
    compact = strip_ws(name)
    tokens = F.filter(F.split(norm_ws(name), " "), lambda t: F.length(t) >= 3)

    def named(low: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda t: low.contains(t)))
        needed = F.size(tokens) if mode == "all" else F.greatest(F.lit(1), F.floor((F.size(tokens) + 1) / 2))
        whole = (F.length(compact) > 0) & F.replace(low, F.lit(" "), F.lit("")).contains(compact)
        return (F.length(low) > 0) & (whole | ((F.size(tokens) > 0) & (hits >= needed)))

    return let(norm_ws(text), named)


def strict_menu_words(c: Column) -> Column:
    return contained(F.lower(c), web.STRICT_MENU_WORDS)
