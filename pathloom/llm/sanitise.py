"""Personal data: pattern spans, and terms whose company gives a protected value away.

Pattern matches (email, ip, card, phone) are the protected entities, by normalised value.  The terms of a
document are all words of its whole text outside the matches, in lower case and without punctuation at
their ends.  Over the whole corpus the number of
documents of a term, of an entity and of both together give the share of a term's documents that name the
entity and the normalised pointwise mutual information of the two.  A term seen with an entity in two
documents or more whose share reaches a threshold discloses it: every occurrence of it, in every document,
is removed, or generalised where the disclosure is weaker.

All of it is built-in column functions: matches come from regexp_extract_all, their places from the
lengths of the gaps that split leaves.  The patterns are written without backtracking (possessive), which
changes no match and keeps very long texts linear.

Cases: null text is empty and has no spans; rows are told apart by id and text, so equal rows get equal
results; null ids are kept; an empty table gives an empty table.  Other columns pass through ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.tables import own_names, text_part
from pathloom.session import save_shared

# The patterns of the base kinds, in the order in which kinds are listed.  (?<!) anchors a
# match to the start of a run where a later start in the run could not match either.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "general", "term")
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]++"
FILTER_BITS = 1 << 23  # of the filters that keep other rows out of a shuffle
MIN_DOCUMENTS = 2
REMOVE_SHARE, GENERALISE_SHARE = 0.6, 0.3  # documents with the entity, of the term's documents
MIN_NPMI = 0.6
# Punctuation at both ends of a word; (?<!) anchors the last run, so that long runs stay linear.
ENDS = r"^[\p{P}\p{Punct}]++|(?<![\p{P}\p{Punct}])[\p{P}\p{Punct}]++$"
_SPAN = "array<struct<start:int,kind:int,end:int,entity:string>>"


def _found(text: Column, pattern: str, may: Column) -> tuple[Column, Column]:
    """Matches of a pattern and the text between them."""
    none = F.array().cast("array<string>")
    return (
        F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        F.when(may, F.split(text, pattern, -1)).otherwise(none),
    )


def _placed(found: Column, gaps: Column) -> Column:
    """(start, end, value) of the matches, in code points."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.aggregate(pairs, zero, step, lambda state: state["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and kind, each with the normalised value it protects."""
    digit = text.rlike("[0-9]")
    rules = (
        (EMAIL, text.contains("@"), lambda v: F.lit(True), F.lower),
        (IP, digit, lambda v: v.rlike(IP_PARTS), lambda v: v),
        (CARD, digit, lambda v: F.length(_digits(v)).between(12, 19) & _luhn(_digits(v)), _digits),
        (PHONE, text.contains("+"), lambda v: F.length(_digits(v)).between(9, 15), _digits),
    )
    def spans(kind: int, pattern: str, may: Column, good, value) -> Column:
        found = F.filter(_placed(*_found(text, pattern, may)), lambda s: good(s["value"]))
        entity = lambda s: F.concat(F.lit(f"{KINDS[kind]}:"), value(s["value"])).alias("entity")
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), entity(s)))

    return F.array_sort(F.concat(*[spans(kind, *rule) for kind, rule in enumerate(rules)]))


def _masked(text: Column, base: Column) -> Column:
    """The text with blanks in the places of its base spans; all other places stay as they are."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        blank = F.repeat(F.lit(" "), s["end"] - F.greatest(state["at"], s["start"]))
        end = F.greatest(state["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.when(s["start"] > state["at"], gap).otherwise(""), blank).alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(base, zero, step, rest))


def _term(word: Column) -> Column:
    """The term that a word counts as: in lower case, without punctuation at its ends; empty if nothing is left."""
    return F.lower(F.regexp_replace(word, ENDS, ""))


def _terms(text: Column) -> Column:
    """The distinct terms of a whole text."""
    return F.array_remove(F.array_distinct(F.transform(F.array_distinct(F.split(text, SPACE)), _term)), "")


def _places(text: Column, known: Column) -> Column:
    """(start, kind, end, entity) of every word whose term is a key of the map ``known``."""
    found, gaps = _found(text, WORD, F.lit(True))
    words = F.zip_with(
        found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))),
        lambda w, g: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"), F.try_element_at(known, _term(w)).alias("kind")),
    )
    words = F.filter(words, lambda w: w["size"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state, w):
        start = state["at"] + w["gap"]
        span = F.struct(start.alias("start"), w["kind"].alias("kind"), (start + w["size"]).alias("end"), F.lit("").alias("entity"))
        spans = F.when(w["kind"].isNotNull(), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + w["size"]).alias("at"), spans.alias("spans"))

    return F.aggregate(words, zero, step, lambda state: state["spans"])


def _bit(key: Column) -> tuple[Column, Column]:
    """(word, bit in it) of a key in a filter of FILTER_BITS bits."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return F.floor(at / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def _only(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``keys``; a filter of fixed size, which costs rows, not results."""
    word, bit = _bit(F.col(column))
    words = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("word"))
    every = every.join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    every = every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("_bits"))
    every = save_shared(every, "private-filter")
    return rows.join(F.broadcast(every), F.get("_bits", word).bitwiseAND(bit) != 0).drop("_bits")


def _npmi(n_docs: int, n_both: Column, n_term: Column, n_entity: Column) -> Column:
    bits = F.log2(n_both * F.lit(float(n_docs)) / (n_term * n_entity))
    most = F.log2(F.lit(float(max(n_docs, 1))) / n_both)
    return F.when(most > 0, bits / most).otherwise(0.0)


def disclosing_terms(texts: DataFrame) -> DataFrame:
    """(entity, term, kind): terms that reveal an entity, from document counts over the whole corpus.

    ``texts`` has a row per document: row (its key), base and its distinct terms.  Share and information
    both grow with the number of common documents, which the rarer of the two bounds: pairs that could not
    pass even then are never formed, so common words meet only common entities.
    """
    n_docs = texts.count()
    protected = texts.filter(F.size("base") > 0).select("row", F.explode(F.array_distinct("base.entity")).alias("entity"))
    per_entity = protected.groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= MIN_DOCUMENTS)
    shared = save_shared(protected.join(per_entity, "entity"), "private-entities")
    most = (shared.agg(F.max("n_entity")).first()[0] or 0) / GENERALISE_SHARE
    per_term = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    per_term = save_shared(per_term.filter((F.col("n_term") >= MIN_DOCUMENTS) & (F.col("n_term") <= most)), "private-counts")
    entities = shared.groupBy("row").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    terms = texts.filter(F.size("base") > 0).join(entities.select("row"), "row", "left_semi").select("row", F.explode("terms").alias("term"))
    terms = _only(terms, per_term, "term").join(per_term, "term")

    pairs = terms.join(entities, "row").select(F.explode("entities").alias("e"), "term", "n_term").select("e.*", "term", "n_term")
    best = F.least("n_term", "n_entity")
    may = (best / F.col("n_term") >= GENERALISE_SHARE) & (_npmi(n_docs, best, F.col("n_term"), F.col("n_entity")) >= MIN_NPMI - 1e-9)
    both = pairs.filter(may).groupBy("entity", "n_entity", "term", "n_term").agg(F.count("*").alias("n_both"))
    scored = both.filter(F.col("n_both") >= MIN_DOCUMENTS).withColumn("share", F.col("n_both") / F.col("n_term")).filter(F.col("share") >= GENERALISE_SHARE)
    scored = scored.withColumn("npmi", _npmi(n_docs, F.col("n_both"), F.col("n_term"), F.col("n_entity"))).filter(F.col("npmi") >= MIN_NPMI)
    kind = F.when(F.col("share") >= REMOVE_SHARE, KINDS.index("term")).otherwise(KINDS.index("general"))
    return scored.select("entity", "term", kind.alias("kind"), "share", "npmi")


def _described(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their base spans, rows with their disclosing spans); a row is told by id and text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("part", text_part()).withColumn("row", F.xxhash64("doc_id", "text")).withColumn("base", base_spans(F.col("text")))
    source = source.withColumn("text", _masked(F.col("text"), F.col("base"))).withColumn("terms", _terms(F.col("text")))
    spans = save_shared(source, "private-texts", codec="zstd")  # holds all texts
    texts = spans.select("row", "base", "text", "terms")
    if not spans.groupBy("row").count().filter("count > 1").isEmpty():  # a repeated row is one document
        texts = save_shared(texts.dropDuplicates(["row"]), "private-documents")
    known = disclosing_terms(texts).groupBy("term").agg(F.max("kind").alias("kind"))  # removed if one entity asks for it
    known = save_shared(known, "private-terms")
    hits = _only(texts.select("row", F.explode("terms").alias("term")), known, "term").join(known, "term")
    hits = save_shared(hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("known")), "private-hits")
    # The hits grow with the corpus: the same join at every size.
    extra = _only(texts.select("row", "text"), hits, "row").join(hits.hint("merge"), "row").select("row", _places(F.col("text"), F.col("known")).alias("extra"))
    return spans.drop("text", "terms"), extra


def find_private(docs: DataFrame) -> DataFrame:
    """Per document: base spans and all spans, as arrays of (start, kind, end, entity)."""
    spans, extra = _described(docs)
    extra_spans = F.coalesce("extra", F.array().cast(_SPAN))
    return spans.join(extra, "row", "left").select("doc_id", "part", "base", F.array_sort(F.concat("base", extra_spans)).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets (terms: removed)."""
    found = find_private(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_part"])
    names = F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "")])
    named, at = own_names(docs)
    own = F.col(at["text"])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        new = s["start"] >= state["at"]
        gap = F.substring(own, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], F.when(new, F.concat(gap, F.get(names, s["kind"]))).otherwise("")).alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(own, state["at"] + 1, F.length(own)))
    text = F.when(F.col("_spans").isNull(), own).otherwise(F.aggregate("_spans", zero, step, rest))
    on = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_id")) & (text_part(at["text"]) == F.col("_part"))
    joined = named.join(found, on, "left")
    return joined.select(*[(text if name == "text" else F.col(c)).alias(name) for name, c in at.items()])
