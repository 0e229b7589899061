"""Word-list scans against a look-up word by word, and how much of a plan they take."""

import random
import re

from pyspark.sql import functions as F

from dinesight.catalog import tables
from dinesight.functions import literals as li
from dinesight.functions.text import clean_text
from dinesight.operators.entities import cuisine_prior, cuisines_for, infer_from_name
from dinesight.operators.risk import term_facts
from dinesight.operators.tagging import grid_prefilter, infer_allergens
from dinesight.vocab import allergens as av
from dinesight.vocab import cuisines as cv


def _texts(spark, words, n=300):
    random.seed(11)
    joints = [" ", "", "s ", "-", "x", " é", "  ", "\t", "_", "1"]
    rows = [("".join(random.choice(words) + random.choice(joints) for _ in range(random.randint(0, 4))),) for _ in range(n)]
    return spark.createDataFrame([*rows, ("",), (None,)], "t string")


def test_letter_tree_finds_the_longest_word_of_every_place(spark):
    words = ["a", "ab", "abc", "abd", "b.c", "b", "ca", "cab", "dé", "d", "éa", "erdnüsse", "f-g", "花生", "花", "g", "h", "i", "j", "\U0001F95C"]
    scan = li.first_letters(words) + f"(?=({li.letter_tree(words)}))"
    for row in _texts(spark, words).select("t", F.regexp_extract_all("t", F.lit(scan), F.lit(1)).alias("got"), li.contains_any(F.col("t"), words).alias("any")).collect():
        if row.t is None:
            assert row.got is None and row.any is None
            continue
        places = [max((w for w in words if row.t.startswith(w, i)), key=len, default=None) for i in range(len(row.t))]
        assert row.got == [w for w in places if w] and row.any == any(w in row.t for w in words)


def test_scans_skip_by_one_class(spark):
    assert li.first_letters(["aé", "éa", "花生", "b"]) == r"(?=[ab\x80-\uFFFF])"


def test_cuisines_of_a_name_take_one_scan(spark):
    cues = list(cv.NAME_HINTS)
    df = _texts(spark, cues)
    for row in df.select("t", infer_from_name(F.col("t")).alias("got")).collect():
        low = re.sub(r"\s+", " ", row.t or "").strip().lower()
        assert row.got == list(dict.fromkeys(cv.NAME_HINTS[c] for c in cues if re.search(rf"(?<!\w){re.escape(c)}(?!\w)", low))), row.t
    places = spark.createDataFrame([(["cuisine:thai"], "Pho House", "TH")], "c array<string>, n string, r string")
    plan = places.select(cuisine_prior(cuisines_for(F.col("c"), F.col("n")), F.col("r")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all|RLIKE", plan)) <= 2


def test_whitespace_runs(spark):
    df = spark.createDataFrame([("a b",), (" a  b ",), ("a\t b",), ("a  b",), ("a b",), ("\n a\nb \n",), (" ",), ("",), (None,)], "t string")
    for row in df.select("t", clean_text(F.col("t")).alias("got")).collect():
        assert row.got == re.sub(r"\s+", " ", row.t or "").strip(" "), repr(row.t)


def test_grid_prefilter_reads_a_text_once(spark):
    forms = [f for _, names in av.CHART_HEADERS for f in names]
    df = _texts(spark, [*forms, *av.CHART_GRID_WORDS[:1], "menu", "Milk", "egg"])
    for row in df.select("t", grid_prefilter(F.col("t")).alias("got")).collect():
        low = (row.t or "").lower()
        tokens = {token for token, names in av.CHART_HEADERS if any(n in low for n in names)}
        assert row.got == (len(tokens) >= 3 or any(w in low for w in av.CHART_GRID_WORDS)), row.t
    plan = df.select(grid_prefilter(F.col("t")).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_\w+\(|RLIKE", plan)) == 1


def test_no_pattern_is_decoded_per_element(spark):
    df = spark.createDataFrame([(["Walnut"], "soy milk bread")], "terms array<string>, t string")
    plan = df.select(term_facts(F.col("terms")).alias("f"), infer_allergens(F.col("t")).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


def test_places_and_terms_use_every_core(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(5).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    places = tables.places(spark, str(tmp_path))
    assert places.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and places.count() == 55
