"""Information-theoretic sanitisation with DataFrame functions alone.

Protected entities are the base matches (email, ip, card, phone).  How strongly a term t reveals an entity e is their
pointwise mutual information over the corpus, PMI(t; e) = log(N co(t, e) / (df(t) df(e))), where co counts documents that
hold both, t outside the entities; its share of what there is to know about e, PMI / log(N / df(e)), is t's disclosure.
In a document that mentions e, terms whose disclosure reaches ``generalise_at`` become a general label, and
those that reach ``remove_at`` go.  Counts are over all documents, and an entity or a term that a third of them hold is
counted in each task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.session import cut

NO_ID = -(2**63)
KINDS = ["email", "ip", "card", "phone"]

# The base patterns.  Each can start only where a match can start (after a character that is no part of it, or at the end of
# the match before), so that a long run is read once instead of once from each of its characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[^\p{L}]+"
TERM_LENGTH = 4


def located(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points; empty without a match."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        here = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        # the last gap has no match behind it
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["value"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(here))).alias("out"))

    found = F.aggregate(pairs, state, step, lambda s: s["out"])
    return F.when(F.regexp_like(text, regex), found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(terms, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _valid(kind: str):
    return lambda m: VALID[kind](m["value"])


def _each(kind: str, make) -> Column:
    """The kind's array of spans, each turned into ``make(kind, span)``."""
    return F.transform(F.col(kind), lambda m: make(kind, m))


def with_base(rows: DataFrame) -> DataFrame:
    """Add one array of spans for each kind to rows with a non-null ``text``."""
    for kind in KINDS:
        rows = rows.withColumn(kind, F.filter(located(F.col("text"), PATTERNS[kind]), _valid(kind)))
    return rows


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), TERM)), lambda t: F.length(t) >= TERM_LENGTH)


def disclosing_terms(based: DataFrame, rows: DataFrame, documents: int, generalise_at: float, support: int) -> DataFrame:
    """id, term, disclosure: the terms that reveal an entity of the document, at their strongest."""
    spans = F.concat(*[_each(k, lambda k, m: F.struct(F.concat(F.lit(f"{k}:"), F.lower(m["value"])).alias("entity"), m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS])
    met = based.where(F.size(F.concat(*KINDS)) > 0).select("id", "text", F.array_sort(F.transform(spans, lambda m: F.struct(m["start"], m["end"], m["entity"]))).alias("spans"))
    holds = cut(met.select("id", F.explode("spans.entity").alias("entity")).distinct())
    entities = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("df_e")).where(F.col("df_e") >= support)
    known = holds.join(entities.select("entity"), "entity")
    # every term of a document that holds such an entity, wherever it stands outside the entities themselves
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    gap = lambda s, m: F.struct(F.greatest(s["at"], m["end"]).alias("at"), F.when(m["start"] > s["at"], F.concat(s["out"], F.array(F.substring(F.col("text"), s["at"] + 1, m["start"] - s["at"])))).otherwise(s["out"]).alias("out"))
    beside = F.aggregate("spans", begin, gap, lambda s: F.concat_ws(" ", F.concat(s["out"], F.array(F.substring(F.col("text"), s["at"] + 1, F.length("text"))))))
    within = met.join(known.select("id").distinct(), "id", "left_semi").select("id", F.explode(_terms(beside)).alias("term")).distinct()
    pairs = known.join(within, "id").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("co")).where(F.col("co") >= support)
    terms = rows.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    scored = pairs.join(entities, "entity").join(terms, "term").withColumn(
        "disclosure",
        F.log(F.col("co") * F.lit(float(documents)) / (F.col("df_t") * F.col("df_e"))) / F.log(F.lit(float(documents)) / F.col("df_e")),
    ).where(F.col("disclosure") >= generalise_at)
    return holds.join(scored.select("entity", "term", "disclosure"), "entity").groupBy("id", "term").agg(F.max("disclosure").alias("disclosure"))


def sanitise(
    docs: DataFrame, generalise_at: float = 0.95, remove_at: float = 0.999, support: int = 3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, arrays of spans (start, end, value) email, ip, card, phone, term, gone, and the sanitised text.

    One row per input row.  A null text counts as empty; offsets are code points, the end exclusive.  Terms are runs of
    ``TERM_LENGTH`` letters or more that stand with an entity in at least ``support`` documents, at any distance.  Null ids
    count as one id; rows that repeat an id are one document to the counts' entities and keep their own spans; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    based = with_base(rows)
    found = disclosing_terms(based, rows, max(rows.count(), 1), generalise_at, support)
    strong = F.col("disclosure") >= remove_at
    own = cut(found.groupBy("id").agg(F.collect_set(F.when(~strong, F.col("term"))).alias("weak"), F.collect_set(F.when(strong, F.col("term"))).alias("strong")))
    pattern = lambda c: F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.sort_array(F.col(c)), "|"), F.lit(r")(?!\p{L})"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    out = based.join(own.withColumnRenamed("id", "own_id"), F.col("id") == F.col("own_id"), "left")
    for name, c in (("term", "weak"), ("gone", "strong")):
        out = out.withColumn(name, F.when(F.size(c) > 0, located(F.col("text"), pattern(c))).otherwise(none))
    labelled = F.array_sort(F.concat(*[_each(k, lambda k, m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("" if k == "gone" else f"[{k.upper()}]").alias("label"))) for k in [*KINDS, "term", "gone"]]))
    text = F.col("text")

    def step(s, m):
        fresh = m["start"] >= s["at"]
        return F.struct(
            F.greatest(m["end"], s["at"]).alias("at"),
            F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), m["label"])).otherwise(s["out"]).alias("out"),
        )

    clean = F.aggregate(labelled, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return out.select("doc_id", *KINDS, "term", "gone", clean.alias("sanitised"))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans of the kinds, comma-joined."""
    return F.array_join(F.concat(*[_each(k, lambda k, m: F.concat_ws(":", F.lit(k), m["start"].cast("string"), m["end"].cast("string"))) for k in kinds]), ",")
