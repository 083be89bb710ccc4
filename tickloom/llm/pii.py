"""Information-theoretic sanitisation, in DataFrame functions only.

Personal data found by pattern (email, ip, card, phone) are the protected entities. A term in a document with an entity
reveals it as far as their mutual information reaches: with document counts n over N documents,
``PMI = ln(n(e, t) N / (n(e) n(t)))`` is compared with the information of the entity itself, ``IC = ln(N / n(e))``. Terms
that give away a share of at least ``generalise`` are generalised, from ``remove`` on removed, wherever they stand in the documents that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import packed, text_of
from tickloom.session import materialized

KINDS = ("email", "ip", "card", "phone")
#: Equal in what they match to the plain forms, but without a second look at characters: a match starts where its
#: run starts or where the last match ended, and runs do not give characters back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a maximal chain of digits with single separators; shorter chains could not pass
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
SIGNS = {"email": "@", "phone": "+"}
GENERALISE, REMOVE, SUPPORT = 0.6, 0.9, 2
SPAN = "array<struct<start: bigint, end: bigint, value: string>>"


def found(text: Column, pattern: str) -> Column:
    """Spans (start, end, value) of the matches, in code points: gaps and matches are measured one after the other."""
    both = rf"(?s)\G(.*?)({pattern})"  # \G: what follows the last match is searched once, not from each place
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(both), F.lit(2)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("value")))).alias("spans"))

    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _part_fits(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(False)


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _part_fits),
    "card": lambda v: F.when(F.length(_digits(v)) <= 19, _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(text: str, kind: str) -> Column:
    """The spans of one kind that pass its check; none for a text without its signs."""
    c, plain = F.col(text), PATTERNS[kind].replace(r"\G|", "")
    sign = c.contains(SIGNS[kind]) if kind in SIGNS else F.lit(True)
    return F.when(sign & c.rlike(plain), F.filter(found(c, PATTERNS[kind]), lambda s: CHECKS[kind](s["value"]))).otherwise(F.array().cast(SPAN))


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _free_terms(text: str, every: str) -> Column:
    """The different letter runs of three or more, in lower case, that no span of ``every`` touches.

    Each span becomes a mark between its outer characters, so that a run that reaches into it goes with the mark."""
    c = F.translate(F.col(text), "\0", " ")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = lambda begin, n: F.substring(c, (begin + 1).cast("int"), n.cast("int"))

    def step(acc: Column, s: Column) -> Column:
        gap = cut(acc["at"], F.greatest(F.lit(0).cast("long"), s["start"] - acc["at"]))
        put = F.concat(acc["out"], gap, cut(s["start"], F.lit(1)), F.lit("\0"), cut(s["end"] - 1, F.lit(1)))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), put.alias("out")))

    marked = F.aggregate(F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), first, step,
                         lambda acc: F.concat(acc["out"], F.substring(c, (acc["at"] + 1).cast("int"), F.length(c))))
    return _terms(F.regexp_replace(marked, r"(?<!\p{L})\p{L}*+\x00\p{L}*+", " "))


def _terms(text: Column) -> Column:
    """The different letter runs of three or more, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]++"), lambda w: F.length(w) >= 3), F.lower))


def entities(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Per document: id, hash of the text, spans of each kind; and, where there are any, all spans, the text and its terms."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.select("doc_id", "text", *[base_spans("text", k).alias(k) for k in KINDS])
    every = F.concat(*[F.transform(k, lambda s, k=k: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"))) for k in KINDS])
    rows = rows.withColumn("every", every)
    some = F.size("every") > 0
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), *KINDS, F.when(some, F.col("every")).alias("every"), F.when(some, F.col("text")).alias("text"), F.when(some, _free_terms("text", "every")).alias("terms"))


def disclosing(mentions: DataFrame, held: DataFrame, docs: DataFrame, text: str, generalise: float, remove: float, support: int) -> DataFrame:
    """(kind, value, term, removed) of the terms that reveal an entity; all counts are over whole documents.

    mentions: (kind, value, doc) of the entities of each document, held: the documents that have any; ``docs`` and ``held`` have
    each document once."""
    n = docs.count()
    holders = held.groupBy(F.struct("doc_id", "text_hash").alias("doc")).agg(F.first("terms").alias("terms"))
    of_entity = mentions.groupBy("kind", "value").agg(F.count("*").alias("n_e"))
    # a pair has at most as many documents as its entity, and an entity of all documents has no information
    of_entity = materialized(of_entity.filter((F.col("n_e") >= support) & (F.col("n_e") < n)), "often")
    asked = mentions.join(of_entity.hint("shuffle_merge"), ["kind", "value"]).select("doc", "kind", "value")
    pairs = asked.join(holders.hint("shuffle_merge"), "doc").select("kind", "value", F.explode("terms").alias("term"))
    of_pair = pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("n_et"))
    of_pair = materialized(of_pair.filter(F.col("n_et") >= support), "pairs")
    corpus = docs.select(F.explode(_terms(text_of(text))).alias("term"), F.lit(1).alias("n"))
    inside = held.select(F.explode(F.array_except(_terms(F.col("text")), "terms")).alias("term"), F.lit(-1).alias("n"))  # in entities alone
    # counted before the join, so that what is shuffled are the different words of each task, at every size
    of_term = corpus.unionByName(inside).groupBy("term").agg(F.sum("n").alias("n_t"))
    met = of_pair.join(of_entity, ["kind", "value"]).join(of_term.hint("shuffle_merge"), "term")
    share = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col("n_t").cast("double"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    met = met.withColumn("share", share)
    return met.filter(F.col("share") >= generalise).select("kind", "value", "term", (F.col("share") >= remove).alias("removed"))


def _places(text: str, every: str, asked: str) -> Column:
    """Where the asked terms (term -> removed) stand in the text, outside the spans: (general, start, end), sorted."""
    c = F.col(text)
    both = r"(?s)\G(.*?)(\p{L}{3,}+)"
    runs = F.arrays_zip(F.regexp_extract_all(c, F.lit(both), F.lit(1)).alias("gap"), F.regexp_extract_all(c, F.lit(both), F.lit(2)).alias("hit"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<general: boolean, start: bigint, end: bigint>>").alias("out"))

    def step(acc: Column, run: Column) -> Column:
        begin = acc["at"] + F.length(run["gap"])
        end = begin + F.length(run["hit"])
        removed = F.element_at(F.col(asked), F.lower(run["hit"]))
        free = ~F.exists(every, lambda e: (e["start"] < end) & (e["end"] > begin))
        # only what is asked for is put to the list, so the walk is linear in the words
        out = F.when(removed.isNotNull() & free, F.concat(acc["out"], F.array(F.struct((~removed).alias("general"), begin.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.array_sort(F.aggregate(runs, first, step, lambda acc: acc["out"]))


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text_hash.

    ``spans`` lists the patterns' spans by kind and start, then the method's: ``removed`` and ``term`` (generalised).
    A pair of entity and term counts from ``support`` documents on. Terms are found in the whole text, at any distance
    from their entity, in the documents that hold it; a document without personal data has no spans.

    * null text counts as empty: no spans, digest of the empty text. Null ids count as one document per text.
    * rows that repeat an id and text count once and get the same spans; an empty table gives an empty result; other
      columns of the input are not looked at.
    """
    rows = materialized(entities(docs, text, doc_id), "entities")
    # a document is its id and text, however often the row is repeated
    doc = F.struct("doc_id", "text_hash").alias("doc")
    held = rows.filter("every is not null")
    # where rows repeat, all counts take each document once; without repeats no text needs to move for that
    if not rows.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        held = materialized(held.dropDuplicates(["doc_id", "text_hash"]), "held")
        docs = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text)).withColumn("_hash", F.xxhash64(text_of(text)))
        docs = materialized(docs.dropDuplicates([doc_id, "_hash"]).drop("_hash"), "once")
    mentions = materialized(held.select(doc, F.explode("every").alias("e")).select("doc", "e.kind", "e.value").distinct(), "mentions")
    flagged = materialized(disclosing(mentions, held, docs, text, generalise, remove, support), "flagged")
    asked = mentions.join(flagged.hint("shuffle_merge"), ["kind", "value"]).groupBy("doc", "term").agg(F.max("removed").alias("removed"))
    asked = asked.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("asked"))
    texts = held.groupBy(doc).agg(F.first("text").alias("text"), F.first("every").alias("every"))
    added = texts.join(asked.hint("shuffle_merge"), "doc").select(F.col("doc.doc_id").alias("_id"), F.col("doc.text_hash").alias("_hash"), _places("text", "every", "asked").alias("added"))
    met = rows.drop("every", "text", "terms").join(materialized(added, "added"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    base = F.array_join(F.concat(*[_written(k, F.col(k)) for k in KINDS]), ",")
    more = F.transform("added", lambda s: F.concat_ws(":", F.when(s["general"], "term").otherwise("removed"), s["start"].cast("string"), s["end"].cast("string")))
    every = F.concat_ws(",", *[_written(k, F.col(k)) for k in KINDS], F.coalesce(more, F.array().cast("array<string>")))
    return met.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), "text_hash")


def redacted(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with their spans replaced: ``[EMAIL]`` and so on, ``[TERM]`` for generalised terms, nothing for removed ones."""
    own = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans").dropDuplicates(["_id", "_hash"])
    met = docs.select(packed(docs), "doc_id", "text", F.xxhash64(text_of()).alias("hash"))
    met = met.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    parts = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end"), F.split(s, ":")[0].alias("kind")))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = text_of()

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["start"] - acc["at"]).cast("int"))
        done = s["end"] <= acc["at"]  # inside a span that is gone already
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(done, acc["out"]).otherwise(F.concat(acc["out"], kept, mark)).alias("out"))

    clean = F.aggregate(F.sort_array(parts), first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.size(parts) > 0, clean).otherwise(F.col("text"))
    return met.select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
