"""Personal data, and terms that disclose it, in DataFrame functions alone.

Base spans are e-mail and IP addresses, card and phone numbers. Beyond them, information theory tells which words give a
protected entity away: a term in a document of an entity (an address or number as such) is compared with the corpus.
With N documents, n(t) of them holding the term, n(e) the entity and n(t, e) both, the pointwise mutual information
log(N n(t, e) / (n(t) n(e))) is set against the entity's own information log(N / n(e)). The ratio is 1 for a term that
occurs in that entity's documents only. In those documents every occurrence counts, whether near or far: terms at or above REMOVE are removed, those at or above GENERALISE are
replaced by their kind. Entities of a single document count as any other; what few documents tell is weighed by SMOOTH
documents in which a term meets the entity by chance only. Texts that are equal count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarmotion.llm.common import written

REMOVE = 0.75
GENERALISE = 0.5
SMOOTH = 1.0
FILTER_BITS = 1 << 21

# The patterns of the base kinds, written so that no start inside a failed run is tried again: a start follows a
# character that cannot belong to the first run, or the last match; runs are possessive, as nothing that follows
# them can be part of them.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# A term: a run of letters and digits, joined by hyphens, apostrophes or underscores, of LEAST code points or more.
_TERM = r"[\p{L}\p{M}\p{N}]++(?:[-'\u2019_][\p{L}\p{M}\p{N}]++){0,4}+"
LEAST = 3

_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum holds; from the right, every second digit is doubled."""
    number = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(number, F.lit(0), lambda acc, d: acc + d.cast("int") - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when((n < 13) | (n > 19), False).otherwise(_luhn(_digits(match)))
    if kind == "phone":
        n = F.length(_digits(match))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    """What makes two mentions the same entity."""
    if kind == "card" or kind == "phone":
        return F.concat(F.lit(f"{kind}:"), _digits(match))
    return F.concat(F.lit(f"{kind}:"), F.lower(match))


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match begins: the lengths of all gaps and matches before it."""
    lengths = F.zip_with(
        F.transform(gaps, F.char_length), F.concat(F.array(F.lit(0)), F.transform(matches, F.char_length)), lambda g, m: g + m
    )
    step = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    ends = F.aggregate(F.slice(lengths, 1, F.size(matches)), F.array(F.lit(0)), step)
    # Each sum holds the match before it and the gap up to the own match.
    return F.slice(ends, 2, F.size(matches))


def _span_at(number: int, kind: str, gaps: Column, starts: Column):
    """A match with its place and what is beside it; without a value where it fails the kind's test."""

    def span(match: Column, i: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind"), starts[i].alias("start"), (starts[i] + F.char_length(match)).alias("end"),
            F.when(_holds(kind, match), _value(kind, match)).alias("value"),
        )

    return span


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of id and text), copy (of the text), spans of the base kinds with their value, and the text of rows with spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("copy", F.xxhash64("text"))
    rows = rows.select("doc_id", "key", "copy", "text", *(F.regexp_extract_all("text", F.lit(p), 0).alias(f"m_{k}") for k, p in KINDS.items()))
    # Split only where there is a match.
    rows = rows.select(
        "doc_id", "key", "copy", "text", *(f"m_{k}" for k in KINDS),
        *(F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in KINDS.items()),
    )
    rows = rows.select(
        "doc_id", "key", "copy", "text", *(f"m_{k}" for k in KINDS), *(f"g_{k}" for k in KINDS),
        *(F.when(F.size(f"m_{k}") > 0, _starts(F.col(f"g_{k}"), F.col(f"m_{k}"))).alias(f"s_{k}") for k in KINDS),
    )
    found = []
    for number, kind in enumerate(KINDS):
        m, g, s = F.col(f"m_{kind}"), F.col(f"g_{kind}"), F.col(f"s_{kind}")
        spans = F.transform(m, _span_at(number, kind, g, s))
        kept = F.filter(spans, lambda x: x["value"].isNotNull())
        found.append(F.when(F.size(m) > 0, kept).otherwise(F.array().cast(f"array<{_SPAN}>")))
    rows = rows.select("doc_id", "key", "copy", "text", F.concat(*found).alias("spans"))
    return rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    raw = F.array_distinct(F.regexp_extract_all(text, F.lit(_TERM), 0))
    return F.array_distinct(F.transform(F.filter(raw, lambda t: F.char_length(t) >= LEAST), F.lower))


def _mentions(base: DataFrame) -> DataFrame:
    """Each entity of each document once."""
    each = base.where(F.size("spans") > 0).select("key", F.explode("spans.value").alias("entity"))
    return each.groupBy("entity", "key").agg(F.lit(1).alias("_")).select("entity", "key")


def _neighbours(base: DataFrame) -> DataFrame:
    """One row (key, entity, n_e, term) for each term of each document that holds the entity, of n_e documents.

    Entities of the same documents have the same counts, so the first of them stands for all: a document with many
    addresses that occur nowhere else pairs its terms once.
    """
    mentions = _mentions(base)
    sets = mentions.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b")
    )
    first = sets.groupBy("n_e", "a", "b").agg(F.min("entity").alias("entity")).select("entity", "n_e")
    held = mentions.join(first, "entity").groupBy("key").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities"))
    terms = base.where(F.size("spans") > 0).select("key", _terms(F.col("text")).alias("terms"))
    return terms.join(held, "key").select("key", "terms", F.explode("entities").alias("e")).select(
        "key", "e.entity", "e.n_e", F.explode("terms").alias("term")
    )


def _places(base: DataFrame) -> DataFrame:
    """(key, term, start, end) of every occurrence of a term in the documents with spans."""
    parts = base.where(F.size("spans") > 0).select(
        "key", F.regexp_extract_all("text", F.lit(_TERM), 0).alias("term"), F.split("text", _TERM, -1).alias("gap")
    )
    # The last gap has no term behind it.
    each = parts.select("key", F.posexplode(F.arrays_zip("gap", "term")).alias("at", "p")).where(F.col("p.term").isNotNull())
    each = each.select(
        "key", "at", F.col("p.term").alias("raw"), F.char_length("p.term").alias("size"), F.char_length("p.gap").alias("gap")
    )
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key").orderBy("at")).cast("int")
    return each.withColumn("end", end).where(F.col("size") >= LEAST).select(
        "key", F.lower("raw").alias("term"), (F.col("end") - F.col("size")).alias("start"), "end"
    )


def _outside(terms: Column, spans: Column) -> Column:
    """Terms cut to what lies before or behind the base spans that they run into; without those inside."""

    def cut(t: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] <= t["start"]) & (s["end"] > t["start"]))
        start = F.coalesce(F.array_max(F.transform(inside, lambda s: s["end"])), t["start"])
        ahead = F.filter(spans, lambda s: (s["start"] > t["start"]) & (s["end"] > start) & (s["start"] < t["end"]))
        end = F.coalesce(F.array_min(F.transform(ahead, lambda s: s["start"])), t["end"])
        return F.struct(start.alias("start"), end.alias("end"), t["remove"].alias("remove"))

    return F.filter(F.transform(terms, cut), lambda t: t["start"] < t["end"])


def _texts(docs: DataFrame, base: DataFrame, text_col: str) -> DataFrame:
    """Each text once. Only texts that share a bit of a filter of fixed size with one that is there twice are shuffled."""
    place = lambda copy: F.pmod(copy, F.lit(FILTER_BITS)).cast("int")
    again = base.groupBy("copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(place(F.col("copy")).alias("at"))
    bits = bytearray(FILTER_BITS >> 3)
    for row in again.groupBy(F.shiftright("at", 3).alias("byte")).agg(
        F.bit_or(F.pow(F.lit(2), F.col("at") % 8).cast("int")).alias("bits")
    ).toLocalIterator():
        bits[row["byte"]] = row["bits"]
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    at = place(F.xxhash64("text"))
    byte = F.conv(F.hex(F.substring(F.lit(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    shared = F.getbit(byte, at % 8) == 1
    return texts.where(~shared).unionByName(texts.where(shared).distinct())


def _ratios(
    docs: DataFrame, near: DataFrame, base: DataFrame, text_col: str, least: float, smooth: float, named: bool,
) -> DataFrame:
    """(key, entity, term, ratio). An entity of one document needs no count of pairs: it has its key, and a name if ``named``."""
    single = near.where("n_e = 1").select(
        "key", F.col("entity") if named else F.lit(None).cast("string").alias("entity"), "n_e", "term", F.lit(1).cast("long").alias("n_te")
    )
    several = near.where("n_e > 1").groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te")).select(
        F.lit(None).cast("long").alias("key"), "entity", "n_e", "term", "n_te"
    )
    usage = docs.select(F.explode(_terms(F.col(text_col).cast("string"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_t")
    )
    total = base.groupBy("key").agg(F.lit(1).alias("_")).agg(F.count(F.lit(1)).alias("n"))
    held = (F.col("n_te") + smooth * F.col("n_e") / F.col("n")) / (F.greatest("n_t", "n_te") + smooth)
    information = F.log(F.greatest(F.col("n") / F.col("n_e"), F.lit(1.0)))
    ratio = F.when(information > 0, 1 + F.log(held) / information).otherwise(0.0)
    return (
        single.unionByName(several).join(usage, "term").crossJoin(F.broadcast(total))
        .select("key", "entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= least)
    )


def disclosing_terms(
    docs: DataFrame, near: DataFrame, base: DataFrame, text_col: str = "text", least: float = GENERALISE, smooth: float = 0.0,
) -> DataFrame:
    """(entity, term, ratio) with a ratio of at least ``least``.

    All counts are of documents (rows of ``docs``, keys of ``base``) over the whole corpus. The share of a term's
    documents that hold the entity is taken with ``smooth`` more documents of which the entity has its usual share.
    Counts are summed within tasks before they are shuffled; pairs are distinct by document already.
    """
    return _ratios(docs, near, base, text_col, least, smooth, True).select("entity", "term", "ratio")


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE,
) -> DataFrame:
    """One row per document: doc_id, key, spans (kind, start, end: base kinds in order, then start), terms (start, end, remove).

    Places are code points, ends exclusive. Null and empty texts have no spans. Rows of equal text count as one document
    in the corpus counts and get equal results; a null doc_id is carried. Only the two named columns are read. An empty
    table gives an empty result.
    """
    base = written(base_spans(docs, id_col, text_col))
    # One row for each text. Rows without spans need only their keys.
    held = written(base.where(F.size("spans") > 0).select(F.col("copy").alias("key"), "spans", "text").dropDuplicates(["key"]))
    single = held.unionByName(
        base.where(F.size("spans") == 0).select(F.col("copy").alias("key")).distinct().select(
            "key", F.array().cast(f"array<{_SPAN}>").alias("spans"), F.lit(None).cast("string").alias("text")
        )
    )
    near = written(_neighbours(single))
    telling = written(_ratios(_texts(docs, base, text_col), near, single, "text", generalise, SMOOTH, False))
    several = telling.where("key is null").select("entity", "term", "ratio")
    marked = telling.where("key is not null").select("key", "term", "ratio").unionByName(
        near.where("n_e > 1").join(several, ["entity", "term"]).select("key", "term", "ratio")
    ).groupBy("key", "term").agg(F.max("ratio").alias("ratio"))
    terms = _places(held).join(marked, ["key", "term"]).groupBy(F.col("key").alias("copy")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", (F.col("ratio") >= remove).alias("remove")))).alias("terms")
    )
    plain = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # Only rows with spans have terms.
    nothing = F.array().cast("array<struct<start:int,end:int,remove:boolean>>")
    rows = base.select("doc_id", "key", "copy", plain.alias("spans"))
    return rows.where(F.size("spans") > 0).join(terms, "copy", "left").select(
        "doc_id", "key", "spans", _outside(F.coalesce("terms", nothing), F.col("spans")).alias("terms")
    ).unionByName(rows.where(F.size("spans") == 0).select("doc_id", "key", "spans", nothing.alias("terms")))


def written_spans(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))


def written_terms(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with entities and telling terms replaced by their kind, or left out where removed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    marks = F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), names[s["kind"]].alias("by"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["remove"], "").otherwise("[TERM]").alias("by"))),
    )
    rows = rows.join(found.dropDuplicates(["key"]).select("key", F.array_sort(marks).alias("marks")), "key", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, m: F.when(
        m["start"] >= acc["at"],
        F.struct(m["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, m["start"] - acc["at"]), m["by"]).alias("out")),
    ).otherwise(acc)
    done = F.aggregate(F.coalesce("marks", F.array().cast("array<struct<start:int,end:int,by:string>>")), start, step)
    rest = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.char_length("text")))
    return rows.select("doc_id", F.when(F.size("marks") > 0, rest).otherwise(F.col("text")).alias("text"))
