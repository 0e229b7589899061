"""Operator 13: secret scan with corpus-wide ownership frequency. DataFrame functions only.

Patterns give candidates with their places; the hash of every candidate's value is
counted over the whole corpus by distinct repositories (texts) and distinct owners
(sources). A value that several owners hold in several different texts is a widely
copied example; any other value that looks live (letters and digits, enough different
characters, no word of a placeholder) belongs to its owner. Spans of the base kinds
always stay; those of the method's own kinds are added where their value is live.

A hash may stand in a third of all rows: counts combine before the shuffle, and
verdicts of values that hold a thousandth of the candidates (at most a thousand)
are broadcast, all others joined by hash.

Null texts are empty and have no spans. A null owner is an owner of its own. Rows that are
equal in id and text get equal results, one each. Copies of a text are one repository, however
many there are. Texts are scanned whole; positions are running sums over blocks, so the work
stays linear in the number of matches. An empty table gives no rows. Other columns are not
read. Spans are in order of start, then of the kinds as listed in ``KINDS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinesight.llm.common import written

#: Base patterns (fixed values): keyword and assigned value, access key, hexadecimal run.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: Patterns of the method's own kinds: keys with a provider's prefix, passwords in URLs, private keys, long mixed runs.
PROVIDER = r"(gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
URL = r"://[A-Za-z0-9._~%-]{1,64}:([A-Za-z0-9._~%!$&*+,;=-]{6,})@"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]{0,20}PRIVATE KEY-----"
RANDOM = r"[A-Za-z0-9]{24,}"
PLACEHOLDER = r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Cc][Hh][Aa][Nn][Gg][Ee]_?[Mm][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Yy][Oo][Uu][Rr]_"

#: A value is a widely copied example from so many owners and different texts on.
WIDE_OWNERS = 3
WIDE_REPOSITORIES = 3
#: Different characters of a value that looks live.
LIVE_CHARACTERS = 8
#: A value that holds this share of the candidates is hot; there are at most as many as the inverse says.
HOT_SHARE = 1_000
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, and what the value needs: a least length, capitals, small letters and digits."""
    name: str
    pattern: str
    group: int
    least: int
    base: bool
    mixed: bool = False


KINDS = (Kind("assign", ASSIGN, 2, 12, True), Kind("access", ACCESS, 0, 18, True), Kind("hex", HEX, 0, 16, True),
         Kind("provider", PROVIDER, 0, 24, False), Kind("url", URL, 1, 6, False), Kind("pem", PEM, 0, 64, False), Kind("random", RANDOM, 0, 24, False, True))


def _sums(values: Column) -> Column:
    """0, then the sums up to and with each of ``values``."""
    return F.aggregate(values, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def wanted(kind: Kind, value: Column) -> Column:
    enough = F.length(value) >= kind.least
    return enough & value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]") if kind.mixed else enough


def with_places(df: DataFrame, text: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add a column per kind: array of (start, end, value) of its leftmost non-overlapping matches that are ``wanted``.

    Matches and the texts between them alternate, so their lengths add up to places. The running sums go block by block, as
    an array that grows by one value at a time has to stay short. What is read more than once is a column of its own.
    """
    def step(prefix: str, make: Callable[[Kind], Column]) -> dict[str, Column]:
        return {f"_{prefix}_{kind.name}": make(kind) for kind in kinds}

    def col(prefix: str, kind: Kind) -> Column:
        return F.col(f"_{prefix}_{kind.name}")

    def some(kind: Kind) -> Column:
        return F.size(col("match", kind)) > 0

    def steps(kind: Kind) -> Column:
        between = F.transform(F.split(text, kind.pattern, -1), F.length)
        return F.when(some(kind), F.zip_with(F.slice(between, F.lit(1), F.size(col("match", kind))), col("match", kind), lambda g, m: g + F.length(m)))

    def blocks(kind: Kind) -> Column:
        values = col("step", kind)
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        return F.when(some(kind), F.transform(starts, lambda b: _sums(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))))

    def ends(kind: Kind) -> Column:
        return F.flatten(F.zip_with(col("block", kind), F.slice(col("before", kind), F.lit(1), F.size(col("block", kind))),
                                    lambda block, start: F.transform(F.slice(block, F.lit(2), F.size(block) - 1), lambda x: x + start)))

    def found(kind: Kind) -> Column:
        values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else col("match", kind)
        places = F.zip_with(ends(kind), col("match", kind), lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
        every = F.zip_with(places, values, lambda place, value: F.struct(place["start"].alias("start"), place["end"].alias("end"), value.alias("value")))
        none = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.when(some(kind), F.filter(every, lambda x: wanted(kind, x["value"]))).otherwise(none)

    given = df.columns
    df = df.withColumns(step("match", lambda kind: F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))))
    df = df.withColumns(step("step", steps))
    df = df.withColumns(step("block", blocks))
    df = df.withColumns(step("before", lambda kind: _sums(F.transform(col("block", kind), lambda block: F.element_at(block, -1)))))
    return df.select(*given, *[found(kind).alias(kind.name) for kind in kinds])


def looks_live(value: Column) -> Column:
    """Letters and digits, enough different characters, no word of a placeholder."""
    return (value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)
            & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS))


def candidates(df: DataFrame, owner: str = "source") -> DataFrame:
    """One row per row of ``df (doc_id, text, owner)``: ``doc_id, row_key, owner, repository, spans``.

    ``spans`` holds (start, rank of the kind, end, hash of the value, whether it looks live). ``row_key`` is equal only for
    rows equal in id and text; ``repository`` is the hash of the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("owner"), text.alias("text"))
    rows = with_places(rows, "text")

    def entries(rank: int, kind: Kind) -> Column:
        return F.transform(kind.name, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
            F.unhex(F.sha2(x["value"], 256)).alias("hash"), looks_live(x["value"]).alias("live")))
    spans = F.concat(*[entries(rank, kind) for rank, kind in enumerate(KINDS)])
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text"))))
    return rows.select("doc_id", key.alias("row_key"), "owner", F.xxhash64("text").alias("repository"), spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n, owners, repositories, wide`` of every candidate value, counted over the whole corpus."""
    each = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    # Copies of a text within one owner count once, and combine before they are shuffled.
    once = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    counted = once.groupBy("hash").agg(F.sum("n").alias("n"), F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    return counted.withColumn("wide", (F.col("owners") >= WIDE_OWNERS) & (F.col("repositories") >= WIDE_REPOSITORIES))


def judged(found: DataFrame) -> DataFrame:
    """``row_key, judged``: every candidate span of a row with ``wide`` and ``live`` beside it; rows without candidates are absent."""
    counts = written(ownership(found))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # At most HOT_SHARE values hold a HOT_SHARE-th of all candidates each.
    hot = F.broadcast(counts.join(F.broadcast(total), F.col("n") * HOT_SHARE >= F.col("total")).select("hash", "wide"))
    each = found.select("row_key", F.explode("spans").alias("s")).select("row_key", "s", F.col("s.hash").alias("hash"))
    known = each.join(hot, "hash").unionByName(each.join(hot, "hash", "left_anti").join(counts.select("hash", "wide"), "hash"))
    span = F.struct("s.start", "s.rank", "s.end", "wide", (F.col("s.live") & ~F.col("wide")).alias("live"))
    return known.groupBy("row_key").agg(F.collect_set(span).alias("judged"))


def secret_scan(df: DataFrame, owner: str = "source") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied`` of every row of ``df (doc_id, text, owner)``.

    ``n_live`` counts the spans whose value is owner-specific and looks live, ``n_copied`` those of widely copied values.
    """
    found = written(candidates(df, owner))
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    n_base = sum(kind.base for kind in KINDS)

    def joined(spans: Column) -> Column:
        placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"])))
        return F.array_join(F.transform(placed, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank].name}")

    rows = found.select("doc_id", "row_key", F.filter("spans", lambda s: s["rank"] < n_base).alias("base"))
    rows = rows.join(judged(found), "row_key", "left")
    verdicts = F.coalesce("judged", F.array().cast("array<struct<start:int,rank:int,end:int,wide:boolean,live:boolean>>"))
    kept = F.filter(verdicts, lambda s: (s["rank"] < n_base) | s["live"])
    return rows.select(
        "doc_id", *[count(rank) for rank in range(n_base)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(kept).alias("spans"),
        F.size(F.filter(verdicts, lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter(verdicts, lambda s: s["wide"])).cast("long").alias("n_copied"))
