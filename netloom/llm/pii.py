"""Personal data: fixed forms, and information-theoretic sanitisation of terms that reveal them.

Base. Emails, addresses, card and phone numbers are found by regular expressions without backtracking over long runs.
Places come from the text between the matches: pieces and matches alternate, and a running sum of their lengths (in two
levels, so that it is linear) gives every match's code points.

Disclosure. A protected entity c is one base value. A term t is a word that touches no base value. With n documents, p(c)
and p(t) their document frequencies and p(c, t) that of documents that hold both, t reveals the share

    PMI(c; t) / IC(c) = log(p(c, t) / (p(c) p(t))) / -log p(c)

of c's information; 1 means that whoever reads t knows c. Terms met with c in at least ``MIN_MEETINGS`` documents whose
share reaches ``GENERALISE`` are protected wherever they stand, in all documents: from ``REMOVE`` on they are removed, below
they are generalised to <term>; a term that reveals several entities goes by its largest share. All frequencies are exact
counts over all documents. As p(c, t) is at most p(c), the share bounds the count of t by c^G n^(1 - G), G being
``GENERALISE``: only such pairs are formed, so frequent words meet frequent entities alone, and this loses none.

Everything is DataFrame code.

Defined results: null and empty texts have no spans; texts of any length are searched whole; repeated rows are documents
of their own and get the same spans; a null doc_id is an id like others; an empty table gives an empty result; extra
columns are not used by ``find`` and pass through ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import BROADCAST_ROWS, fresh, let, materialise, same

LOCAL = r"[A-Za-z0-9._%+-]"
#: kind: Java pattern. A match starts where its first run starts, or where the last match ended: starting inside the run
#: would give the same rest, so the look-behind only saves time. Possessive loops give the same matches as greedy ones.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[\p{L}\p{N}_'-]++"
MASK = "\uE000"  # stands for the characters of base values: words that hold it touch one
MASKED_WORD = rf"[\p{{L}}\p{{N}}_'{MASK}-]++"
MIN_MEETINGS = 3
GENERALISE, REMOVE = 0.8, 0.95
CHUNK = 256


def running(lengths: Column) -> Column:
    """Sums of all elements before each, in two levels."""
    def grow(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        step = lambda x, v: F.struct((x["s"] + v).alias("s"), F.concat(x["a"], F.array(x["s"])).alias("a"))
        return F.aggregate(values, start, step, lambda x: x["a"])

    def levels(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(n), F.lit(CHUNK))
        sums = F.transform(starts, lambda i: F.aggregate(F.slice(n, i, CHUNK), F.lit(0), lambda a, v: a + v))
        return let(grow(sums), lambda before: F.flatten(F.transform(starts, lambda i, j: F.transform(
            grow(F.slice(n, i, CHUNK)), lambda x: x + F.get(before, j)))))

    return let(lengths, lambda n: F.when(F.size(n) == 0, F.array().cast("array<int>")).otherwise(levels(n)))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, code points."""
    def placed(match: Column) -> Column:
        between = F.split(text, pattern, -1)
        pairs = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(match)).alias("gap"), match.alias("m")),
                            lambda x: F.struct(F.length(x["gap"]).alias("g"), x["m"].alias("m")))
        total = lambda p: F.transform(p, lambda x: x["g"] + F.length(x["m"]))
        return let(pairs, lambda p: let(running(total(p)), lambda before: F.transform(p, lambda x, i: F.struct(
            (F.get(before, i) + x["g"]).alias("start"), (F.get(before, i) + x["g"] + F.length(x["m"])).alias("end"),
            x["m"].alias("value")))))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(~text.rlike(pattern), none).otherwise(let(F.regexp_extract_all(text, F.lit(pattern), 0), placed))


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")

    def valid(d: Column) -> Column:
        n = F.length(d)
        marks = F.transform(F.sequence(F.lit(1), n), lambda i: let(
            F.substring(d, i, F.lit(1)).cast("int"), lambda x: F.when((n - i) % 2 == 0, x).otherwise(
                F.when(x > 4, 2 * x - 9).otherwise(2 * x))))
        return F.aggregate(marks, F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(digits, lambda d: F.when(F.length(d).between(12, 19), valid(d)).otherwise(F.lit(False)))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> of the fixed forms, by start, then kind as listed."""
    whole = F.coalesce(text, F.lit(""))

    def of_kind(rank: int, kind: str, pattern: str) -> Column:
        kept = F.filter(found(whole, pattern), lambda x: valid(kind, x["value"]))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
                                                    F.lit(kind).alias("kind"), x["value"].alias("value")))

    return F.sort_array(F.concat(*[of_kind(rank, *item) for rank, item in enumerate(PATTERNS.items())]))


def entity(span: Column) -> Column:
    """One name for one value in its spellings."""
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def masked(text: Column, spans: Column) -> Column:
    """The text with ``MASK`` for every character of a base span, and nowhere else."""
    plain = F.translate(text, MASK, " ")

    def cover(plain: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda s, x: let(F.greatest(s["at"], x["start"]), lambda a: let(F.greatest(s["at"], x["end"]), lambda b: F.struct(
            b.alias("at"), F.concat(s["out"], F.substring(plain, s["at"] + 1, a - s["at"]), F.repeat(F.lit(MASK), b - a)).alias("out"))))
        return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(plain, s["at"] + 1, F.length(plain))))

    return F.when(F.size(spans) == 0, plain).otherwise(let(plain, cover))


def terms_of(text: Column) -> Column:
    """Distinct terms of a masked text."""
    words = F.filter(F.regexp_extract_all(text, F.lit(MASKED_WORD), 0), lambda w: ~F.contains(w, F.lit(MASK)))
    return F.array_distinct(F.transform(words, F.lower))


def on_terms(left: DataFrame, terms: DataFrame) -> DataFrame:
    """Join with stored ``terms`` on the term."""
    return left.join(F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms, "term")


def reveal(stored: DataFrame, spoken: DataFrame) -> DataFrame:
    """Stored (term, share): terms that reveal an entity, with their largest share."""
    n = stored.count()
    named = stored.select("row", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    entities = named.groupBy("entity").agg(F.count("*").alias("c")).filter(F.col("c").between(MIN_MEETINGS, n - 1))
    most = F.pow("c", F.lit(GENERALISE)) * F.lit(float(n) ** (1 - GENERALISE)) * (1 + 1e-9)
    held = materialise(named.distinct().join(entities, "entity").withColumn("most", most), "pii-entities")
    top = held.agg(F.max("most")).first()[0] or 0.0
    terms = materialise(spoken.groupBy("term").agg(F.count("*").alias("t")).filter(F.col("t").between(MIN_MEETINGS, top)), "pii-terms")
    # Equal rows share ``row``; here each of them brings its own terms, and so counts.
    words = on_terms(stored.filter(F.size("spans") > 0).select("row", F.explode("words").alias("term")), terms)
    share = F.log(F.col("ct") * F.lit(float(n)) / (F.col("c") * F.col("t"))) / F.log(F.lit(float(n)) / F.col("c"))
    return materialise(words.join(held, "row").filter("t <= most").groupBy("entity", "term", "c", "t").agg(F.count("*").alias("ct"))
                       .filter(F.col("ct") >= MIN_MEETINGS).withColumn("share", share).filter(F.col("share") >= GENERALISE)
                       .groupBy("term").agg(F.max("share").alias("share")), "pii-revealing")


def find(docs: DataFrame) -> DataFrame:
    """(row, doc_id, spans, terms) per document: its base spans, and all places of revealing terms with their share.

    ``row`` names a row by its content; equal rows share it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    rowed = docs.select("doc_id", text.alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("row"))
    based = rowed.select("row", "doc_id", "text", F.explode(F.array(base_spans(F.col("text")))).alias("spans"))
    words = F.when(F.size("spans") > 0, terms_of(masked(F.col("text"), F.col("spans")))).otherwise(none)
    stored = materialise(based.select("row", "doc_id", "spans", words.alias("words")), "pii-base")

    spoken = rowed.select("row", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(WORD), 0), F.lower))).alias("term"))
    revealing = reveal(stored, spoken)
    hits = on_terms(spoken, revealing).groupBy("row").agg(F.collect_set(F.struct("term", "share")).alias("hits"))
    there = (rowed.join(hits, "row").select("row", "hits", "text", F.explode(F.array(base_spans(F.col("text")))).alias("spans"))
             .select("row", "hits", F.explode(F.array(masked(F.col("text"), F.col("spans")))).alias("text")))
    placed = F.transform(found(F.col("text"), MASKED_WORD), lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), let(F.lower(w["value"]), lambda v: F.get(F.filter(
            "hits", lambda h: h["term"] == v), F.lit(0))["share"]).alias("share")))
    marks = there.select("row", F.filter(placed, lambda w: w["share"].isNotNull()).alias("terms")).dropDuplicates(["row"])
    return stored.join(marks, "row", "left").select("row", "doc_id", "spans", F.coalesce("terms", F.array().cast(
        "array<struct<start:int,end:int,share:double>>")).alias("terms"))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("/", same(doc_id), F.md5(F.coalesce(text, F.lit("")))))


def all_spans(spans: Column, terms: Column) -> Column:
    """Base spans and revealing terms, as array<struct<start, rank, end, kind>>."""
    narrow = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    added = F.transform(terms, lambda w: F.struct(w["start"].alias("start"), F.lit(len(PATTERNS)).alias("rank"), w["end"].alias("end"),
                                                  F.lit("term").alias("kind")))
    return F.sort_array(F.concat(F.transform(spans, narrow), added))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by <kind>, strongly revealing terms removed, and weaker ones made <term>.

    Overlapping base spans go as one, under the first kind.
    """
    row, cuts = fresh(docs, "pii_row"), fresh(docs, "pii_cuts")
    seen = find(docs).filter((F.size("spans") > 0) | (F.size("terms") > 0)).dropDuplicates(["row"])
    marked = F.sort_array(F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("put"))),
        F.transform("terms", lambda w: F.struct(w["start"].alias("a"), w["end"].alias("b"), F.when(w["share"] >= REMOVE, "").otherwise("<term>").alias("put")))))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, c: F.struct(F.greatest(s["at"], c["b"]).alias("at"), F.when(c["a"] >= s["at"], F.concat(
        s["out"], F.substring(text, s["at"] + 1, c["a"] - s["at"]), c["put"])).otherwise(s["out"]).alias("out"))
    clean = F.aggregate(F.col(cuts), start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    keyed = docs.withColumn(row, row_key(F.col("doc_id"), text)).join(seen.select(F.col("row").alias(row), marked.alias(cuts)), row, "left")
    return keyed.withColumn("text", F.when(F.col(cuts).isNull(), text).otherwise(clean)).select(*docs.columns)
