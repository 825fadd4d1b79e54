"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question keeps its template
when its values change.  Windows of template words are joined by hash; along each
alignment of a document with an item the values behind the placeholders must map one
to one, which tells a re-parameterised question from a chance meeting of templates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddledger.session import staged

# fixed values: the placeholders, the patterns behind them, what is not part of a word
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
NAME_PATTERN = r"([^.!?:\x20\x09-\x0D][ ]+)\p{Lu}\p{Ll}\p{L}*"
START_PATTERN = r"(^|[\x20\x09-\x0D])\p{Lu}\p{Ll}\p{L}*"
NUMBER_PATTERN = r"[0-9][0-9.,:/-]*"
UNITS = (
    "kilometers kilometres kilometer kilometre meters metres meter metre centimeters miles mile "
    "feet foot inches inch km cm mm kilograms kilogram kg grams gram mg pounds pound ounces ounce "
    "liters litres liter litre ml hours hour minutes minute seconds second days day weeks week "
    "months month years year dollars dollar euros euro cents cent percent degrees degree mph kmh"
).split()
UNIT_PATTERN = f"{NUMBER}([ ]?)({'|'.join(UNITS)})([^\\p{{L}}]|$)"
DROPPED = ".,;:!?\"()[]{}"
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Templates:
    """``words`` of a window; one with ``literal`` words that are no placeholders is matched
    whatever its values, one with fewer only with the same values.  An item shows when
    ``coverage`` of its windows is matched, of all or of those with enough literal words.  An
    item below ``shortest`` words counts only where it is the whole document.  Up to ``broadcast_rows`` windows of the benchmark are
    counted and broadcast, more are joined by shuffle."""

    words: int = 8
    literal: int = 4
    coverage: float = 0.5
    shortest: int = 5
    broadcast_rows: int = 100_000


def _words(text: Column) -> Column:
    """The words of a text; one empty word when there are none, as a condition on the
    text would have all of it computed twice."""
    bare = F.trim(F.regexp_replace(F.translate(F.lower(text), DROPPED, ""), BLANKS, " "))
    return F.split(bare, " ")


def raw_words(text: Column) -> Column:
    """Words in lower case, without punctuation; aligned with ``template_words``."""
    return _words(F.coalesce(text, F.lit("")))


def template_words(text: Column, starts: bool = False) -> Column:
    """Words with placeholders.

    A capitalised word within a sentence is a name; with ``starts`` one that begins a sentence
    is so too, as in a question about Tom whose sentences begin with Tom.  Names within
    sentences are replaced twice, as a match takes the character before, which may end another.
    """
    named = F.coalesce(text, F.lit(""))
    if starts:
        # what begins a sentence includes what does not
        named = F.regexp_replace(named, START_PATTERN, f"$1{NAME}")
    else:
        for _ in range(2):
            named = F.regexp_replace(named, NAME_PATTERN, f"$1{NAME}")
    numbered = F.regexp_replace(F.lower(named), NUMBER_PATTERN, NUMBER)
    return _words(F.regexp_replace(numbered, UNIT_PATTERN, f"{NUMBER}$1{UNIT}$3"))


def is_slot(word: Column) -> Column:
    return F.contains(word, F.lit(NUMBER)) | word.isin(NAME, UNIT)


# how a window was read: by its raw words, with names within sentences, with names everywhere
RAW, WITHIN, EVERY = 0, 1, 2
READINGS = {RAW: "raw", WITHIN: "words", EVERY: "every"}


# words of a window that the benchmark's own are looked up by, and the most such beginnings
HEAD, HEADS = 2, 50_000


def _window(words: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from position ``at`` on."""
    return F.xxhash64(F.slice(words, at + 1, size))


def _head(words: str, at: str, size: int) -> str:
    """Hash of the first words of a window, as SQL."""
    return f"xxhash64({', '.join(f'get({words}, {at} + {j})' for j in range(min(HEAD, size)))})"


def _places(words: Column, size: int) -> Column:
    """Positions at which ``size`` words begin."""
    places = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, places).otherwise(F.array().cast("array<int>"))


def _split(text: Column) -> list[Column]:
    """The words of a text in all three readings, of one length."""
    return [
        raw_words(text).alias("raw"),
        template_words(text).alias("words"),
        template_words(text, starts=True).alias("every"),
    ]


def _item_windows(items: DataFrame, p: Templates) -> DataFrame:
    """(item_id, size, reading, ipos, hash, head) of the items' windows; head is that of their first words.

    A window with enough literal words stands for its template, any other for its raw words.
    """
    size = F.least(F.lit(p.words), F.size("words"))
    sized = items.withColumn("size", size)
    # at most ``words`` different sizes
    sizes = sorted(r["size"] for r in sized.select("size").distinct().collect())
    out = None
    for k in sizes:
        own = sized.filter(F.col("size") == k)

        def literal(name: str, size: int = k) -> Column:
            part = F.slice(name, F.col("ipos") + 1, size)
            return F.size(F.filter(part, lambda w: ~is_slot(w))) >= F.least(F.lit(p.literal), F.lit(size))

        for reading, name in READINGS.items():
            placed = own.withColumn("ipos", F.explode(_places(F.col(name), k)))
            kept = ~literal("words") if reading == RAW else literal(name)
            part = placed.filter(kept).select(
                "item_id",
                "size",
                F.lit(reading).alias("reading"),
                "ipos",
                _window(F.col(name), F.col("ipos"), k).alias("hash"),
                F.expr(_head(name, "ipos", k)).alias("head"),
            )
            out = part if out is None else out.unionByName(part)
    return out


def _read_as(reading: Column) -> Column:
    """The item's words as the window was read; raw windows need no placeholders to agree."""
    return F.when(reading == EVERY, F.col("every")).otherwise(F.col("words"))


def matches(docs: DataFrame, benchmark: DataFrame, p: Templates | None = None) -> DataFrame:
    """(doc_id, mark, item_id, windows, matched, changed): items that show in documents.

    ``mark`` is a hash of the text, which tells rows with one doc_id apart.  ``changed``
    counts the values that differ from the item's: above 0, the question was re-parameterised.
    A window is matched when any reading of it is one of the item's; all windows of a text are
    made in one pass.
    """
    p = p or Templates()
    spark = docs.sparkSession
    items = staged(
        benchmark.filter("text is not null and item_id is not null")
        .select("item_id", "text")
        .distinct()
        .select("item_id", *_split(F.col("text")))
        .filter("words[0] <> ''"),
        "items",
    )
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = _item_windows(items, p)
    if found is None:
        return spark.createDataFrame(
            [], "doc_id long, mark long, item_id long, windows long, matched long, changed long"
        )
    index = staged(found, "windows")
    free = F.col("reading") != RAW
    counted = index.groupBy("item_id").agg(
        F.countDistinct("ipos").alias("all"),
        F.countDistinct(F.when(free, F.col("ipos"))).alias("free"),
    )
    # at most twice as many as sizes
    kinds = sorted({(r["reading"] != RAW, r["size"]) for r in index.select("reading", "size").distinct().collect()})
    probe = index.drop("head").join(items.select("item_id", F.size("words").alias("n")), "item_id").withColumn(
        "whole", F.when(F.col("n") < p.shortest, F.col("n"))
    ).withColumn("free", free).drop("n")
    few = index.count() <= p.broadcast_rows
    if few:
        probe = F.broadcast(probe)

    def begins(open_: bool, size: int) -> str | None:
        """The beginnings of the benchmark's windows as a list, unless they are many."""
        own = index.filter((free == open_) & (F.col("size") == size)).select("head").distinct()
        heads = own.limit(HEADS + 1).collect() if few else []
        return ", ".join(str(r["head"]) for r in heads) if 0 < len(heads) <= HEADS else None

    def found_in(name: str, open_: bool, size: int) -> Column:
        """Windows of a document's words that begin as one of the benchmark's does."""
        words, heads = F.col(name), begins(open_, size)
        places = _places(words, size)
        if heads is not None:
            longest = f"CASE WHEN size({name}) >= {size} THEN sequence(0, size({name}) - {size}) ELSE array() END"
            places = F.expr(f"filter({longest}, i -> {_head(name, 'i', size)} IN ({heads}))")
        return F.transform(
            places,
            lambda i: F.struct(
                F.lit(open_).alias("free"),
                F.lit(size).alias("size"),
                i.alias("dpos"),
                _window(words, i, size).alias("hash"),
            ),
        )

    made = [
        found_in(name, open_, size)
        for open_, size in kinds
        for name in (("words", "every") if open_ else ("raw",))
    ]
    hit = (
        marked.select("doc_id", "mark", *_split(F.col("text")))
        .select("doc_id", "mark", F.size("words").alias("n"), F.inline(F.concat(*made)))
        .join(probe, ["free", "size", "hash"])
        .filter("whole is null or whole = n")
    )
    aligned = staged(
        hit.groupBy("doc_id", "mark", "item_id", "size", "reading", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(
            F.collect_set("ipos").alias("at")
        ),
        "aligned",
    )
    rows = aligned.select("doc_id", "mark").distinct()
    own = marked.join(
        rows.withColumnsRenamed({"doc_id": "d", "mark": "m"}),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")),
        "left_semi",
    ).dropDuplicates(["doc_id", "mark"])
    own = own.select(
        F.col("doc_id").alias("d"), F.col("mark").alias("m"), raw_words(F.col("text")).alias("own")
    )
    full = aligned.join(
        own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    ).join(items, "item_id")
    reached = F.array_distinct(
        F.flatten(F.transform("at", lambda i: F.sequence(i, i + F.col("size") - 1)))
    )
    read = _read_as(F.col("reading"))
    slots = F.filter(reached, lambda i: is_slot(F.get(read, i)))
    values = F.array_distinct(
        F.transform(
            slots,
            lambda i: F.struct(
                F.get(read, i).alias("kind"),
                F.get("raw", i).alias("item"),
                F.get("own", i + F.col("shift")).alias("doc"),
            ),
        )
    )
    checked = full.withColumn("values", values).select(
        "doc_id",
        "mark",
        "item_id",
        "reading",
        "at",
        F.size(F.filter("values", lambda v: v["item"] != v["doc"])).alias("changed"),
        F.size(F.array_distinct(F.transform("values", lambda v: F.struct(v["kind"], v["item"])))).alias("from"),
        F.size(F.array_distinct(F.transform("values", lambda v: F.struct(v["kind"], v["doc"])))).alias("to"),
        F.size("values").alias("pairs"),
    )
    # one to one: no value of the item stands for two of the document, nor the other way round
    agreeing = checked.filter((F.col("reading") == RAW) | ((F.col("pairs") == F.col("from")) & (F.col("pairs") == F.col("to"))))
    # the windows that need the same values never count against those that do not
    enough = (F.col("free") > 0) & (F.col("of_free") >= p.coverage * F.col("free"))
    return (
        agreeing.select("doc_id", "mark", "item_id", "reading", "changed", F.explode("at").alias("ipos"))
        .groupBy("doc_id", "mark", "item_id")
        .agg(
            F.countDistinct("ipos").alias("of_all"),
            F.countDistinct(F.when(free, F.col("ipos"))).alias("of_free"),
            F.coalesce(F.min(F.when(free, F.col("changed"))), F.lit(0)).cast("long").alias("changed"),
        )
        .join(counted, "item_id")
        .filter(enough | (F.col("of_all") >= p.coverage * F.col("all")))
        .select(
            "doc_id",
            "mark",
            "item_id",
            F.when(enough, F.col("free")).otherwise(F.col("all")).alias("windows"),
            F.when(enough, F.col("of_free")).otherwise(F.col("of_all")).alias("matched"),
            "changed",
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Templates | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id) with what it shows of the benchmark.

    contaminated; items: how many items show; item_id: the one matched most fully, the
    smallest of equals; changed: differing values of that item.  Null and empty texts
    show nothing, and neither do null or empty items.  Rows with equal doc_id and text
    get the same result; a null doc_id is a value like any other.
    """
    found = matches(docs, benchmark, p)
    best = found.groupBy("doc_id", "mark").agg(
        F.count(F.lit(1)).alias("items"),
        F.min_by(
            F.struct("item_id", "changed"),
            F.struct((-F.col("matched") / F.col("windows")).alias("order"), "item_id"),
        ).alias("best"),
    )
    best = best.withColumnsRenamed({"doc_id": "d", "mark": "m"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    joined = rows.join(
        best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left"
    )
    return joined.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.lit(0).cast("long")).alias("items"),
        F.col("best.item_id").alias("item_id"),
        F.coalesce("best.changed", F.lit(0).cast("long")).alias("changed"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, p: Templates | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that show no item of the benchmark."""
    found = matches(docs, benchmark, p).select("doc_id", "mark").distinct()
    # the columns of ``docs`` may have any names
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("own"),
    )
    same = F.col("id").eqNullSafe(found["doc_id"]) & (F.col("own") == found["mark"])
    return rows.join(found, same, "left_anti").select("row.*")
