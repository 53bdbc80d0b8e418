"""Personal data: pattern spans, and terms that give a protected entity away.

Base spans are emails, IP addresses, card numbers and phone numbers. Protected
entities form a hierarchy: each distinct value found; what values share (mail
domain, IP network, card prefix, phone area); the kind; personal data at all.
A term is a word of three or more letters or digits that begins with a letter
and stands outside e-mail addresses. It is judged by how much of an entity's
information it reveals: its pointwise mutual information with the entity, both
counted over documents, as a share of the entity's own information content,

    PMI(t, e) / IC(e) = 1 + log(n_te / n_t) / log(N / n_e).

Of documents with personal data that are copies or near copies of each other
only one counts, in every count. A term counts for an entity if they meet in
SUPPORT documents and chance would give fewer than one such meeting in the whole
corpus (binomial tail bound: n_t KL(n_te / n_t || n_e / N) is at least the log of
the number of judgements, terms times entities with SUPPORT).
Terms above GENERALISE are replaced by a word for the kind of what they reveal
most, those above REMOVE are taken out, wherever they occur in the corpus.

Everything is DataFrame functions. A match's place comes from the pieces
between matches (split by the same pattern) by a doubling prefix sum; patterns
are written with possessive runs and anchored at the start of a run (or at the
last match's end), so the work is near linear in the text and in its matches.

Defined results: a null text counts as empty; offsets are code points, end
exclusive; matches of one kind do not overlap, those of two kinds may;
repeated rows of equal id and text count as one document and each gets the
spans; a null id is a document like any other; an empty table gives no rows;
very long texts are read whole; other columns are ignored or carried, whatever
their names; of equal disclosures the entity last in order gives the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_side

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PATTERNS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+-])|\G){_EMAIL}",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # whole runs of digits with single separators, of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
SUPPORT = 3
#: Term sets share a context if they agree in one of so many bands of so many minima.
BANDS, BAND_ROWS = 8, 12
GENERALISE = 0.8
REMOVE = 0.95
#: The general word for a term, by the kind of what it reveals most.
GENERAL_WORDS = {"email": "[mail contact]", "ip": "[network host]", "card": "[payment detail]", "phone": "[phone contact]", "": "[personal]"}
#: An e-mail address, which is no term, or a term.
_TOKEN = rf"(?<![A-Za-z0-9._%+-]){_EMAIL}|(\p{{L}}[\p{{L}}\p{{N}}]{{2,}}+)"
#: Code points in a piece of a text that is cut at many places.
_PIECE = 1024


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda part: F.regexp_replace(part, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda part: (F.length(short(part)) <= 3) & (F.coalesce(short(part).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _running(values: Column, join) -> Column:
    """join of each value of an array with all before it, by doubling: n log n steps, whatever the size."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int") - 1)
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda v, i: join(v, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))))


def _spans(text: Column, pattern: str, keep, entry) -> Column:
    """Array of entry(start, end, value) of the matches that keep(value) holds for."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda piece, match: F.length(piece) + F.length(match))
    placed = F.zip_with(_running(steps, lambda a, b: a + b), matches, lambda end, match: entry(end - F.length(match), end, match))
    return F.when(F.size(matches) > 0, F.filter(placed, lambda s: keep(s["value"]))).otherwise(F.filter(F.array(entry(F.lit(0), F.lit(0), F.lit(""))), lambda x: F.lit(False)))


def _entry(kind: str, word: Column | None = None):
    shown = F.lit(f"<{kind.upper()}>") if word is None else word
    return lambda start, end, value: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), shown.alias("word"))


def _no_spans() -> Column:
    return F.filter(F.array(_entry("")(F.lit(0), F.lit(0), F.lit(""))), lambda x: F.lit(False))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value, word), by kind as listed and then by start."""
    found = []
    for kind in KINDS:
        own = _spans(text, PATTERNS[kind], lambda value, kind=kind: _valid(kind, value), _entry(kind))
        found.append(F.when(text.contains(_NEEDS[kind]), own).otherwise(_no_spans()) if kind in _NEEDS else own)
    return F.concat(*found)


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))


def terms(text: Column) -> Column:
    """The distinct terms of a text, lower case."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)))
    return F.array_distinct(F.transform(F.array_remove(words, ""), F.lower))


def entities(spans: Column) -> Column:
    """The distinct protected entities, level:kind:key, of an array of base spans, of every level."""

    def levels(s: Column) -> Column:
        kind, value = s["kind"], F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
        shared = (
            F.when(kind == "email", F.regexp_extract(value, "@(.*)$", 1))
            .when(kind == "ip", F.substring_index(value, ".", 3))
            .when(kind == "card", F.substring(value, 1, 6))
            .otherwise(F.substring(value, F.lit(1), F.length(value) - 7))
        )
        named = lambda level, key: F.concat(F.lit(f"{level}:"), kind, F.lit(":"), key)
        return F.array(named("value", value), named("shared", shared), named("kind", F.lit("")), F.lit("any::"))

    return F.array_distinct(F.flatten(F.transform(spans, levels)))


def _once(rows: DataFrame, base: DataFrame) -> tuple[DataFrame, int]:
    """The rows with those of equal id and text reduced to one, and their number; only repeated rows are shuffled."""
    again, n = small_side(base.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.count("*").alias("n")).where("n > 1"), 32)
    if n == 0:
        return rows, base.count()
    keys = again.drop("n")
    single = rows.join(keys, _same_document(), "left_anti").unionByName(rows.join(keys, _same_document(), "left_semi").dropDuplicates(["doc_id", "t"]))
    return single, base.count() - again.agg(F.sum(F.col("n") - 1)).first()[0]


def with_context(texts: DataFrame) -> DataFrame:
    """texts (t, terms, ...) with context: the smallest t among texts that share a band with it, its own where none does.

    A band is the hash of the BAND_ROWS least of the terms' hashes under one
    of BANDS orders, so two texts share one with probability J ** BAND_ROWS
    for term sets of Jaccard similarity J: almost surely for near copies,
    seldom for texts of one template.
    """
    orders = F.array(*(F.expr(f"xxhash64({k})") for k in range(BANDS)))
    hashed = texts.select("t", F.transform("terms", lambda x: F.xxhash64(x)).alias("h"))
    band = lambda s, k: F.xxhash64(F.slice(F.sort_array(F.transform("h", lambda x: x.bitwiseXOR(s))), 1, BAND_ROWS), k)
    keyed = cut(hashed.select("t", F.explode(F.transform(orders, band)).alias("band")))
    firsts, _ = small_side(keyed.groupBy(F.col("band").alias("_band")).agg(F.min("t").alias("first"), F.max("t").alias("last")).where("first <> last").drop("last"), 32)
    shared = keyed.join(firsts, F.col("band") == F.col("_band")).groupBy(F.col("t").alias("_t")).agg(F.min("first").alias("first"))
    return texts.join(shared, F.col("t") == F.col("_t"), "left").withColumn("context", F.coalesce("first", "t")).drop("_t", "first")


def disclosures(base: DataFrame, rows: DataFrame) -> DataFrame:
    """(term, disclosure, kind): how much a term with enough support and evidence gives away at most, and the kind of what it gives away.

    base: doc_id, t, base and (where there are spans) terms of every row; rows:
    doc_id, t and text. Counts are summed before they are shuffled, so what
    travels is distinct terms and (entity, term) pairs, not occurrences.
    """
    rows, n_rows = _once(rows, base)
    own = base.where(F.size("base") > 0).dropDuplicates(["doc_id", "t"]).select("t", entities(F.col("base")).alias("entities"), "terms")
    texts = cut(own.groupBy("t").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("n")))
    texts = cut(with_context(texts))
    # only one document of a context counts; the others leave the corpus of all counts
    surplus = texts.withColumn("n", F.col("n") - F.when(F.col("context") == F.col("t"), 1).otherwise(0)).where("n > 0")
    n_docs = n_rows - (surplus.agg(F.sum("n")).first()[0] or 0)
    texts = texts.where(F.col("context") == F.col("t"))
    # a term has no more support than its entity has contexts
    named = cut(texts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT))
    often, n_entities = small_side(named.select(F.col("entity").alias("_entity")), F.length("_entity") + 32)
    held = texts.select("terms", F.explode("entities").alias("entity")).join(often, F.col("entity") == F.col("_entity"), "left_semi")
    n_te = held.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT)
    counted = rows.select(F.explode(terms(F.col("text"))).alias("term"), F.lit(1).cast("bigint").alias("n")).unionByName(surplus.select(F.explode("terms").alias("term"), (-F.col("n")).alias("n")))
    n_t = cut(counted.groupBy("term").agg(F.sum("n").alias("n_t")).where(F.col("n_t") >= SUPPORT))
    judgements = float(max(n_t.count() * n_entities, 1))
    paired = n_te.join(named, "entity").join(n_t, "term").where(F.col("n_e") < n_docs)
    near, base_rate = F.col("n_te") / F.col("n_t"), F.col("n_e") / F.lit(float(n_docs))
    evidence = F.col("n_t") * (near * F.log(near / base_rate) + F.when(near < 1, (1 - near) * F.log((1 - near) / (1 - base_rate))).otherwise(0.0))
    share = 1 + F.log(near) / -F.log(base_rate)
    judged = paired.where((near > base_rate) & (evidence >= F.log(F.lit(judgements))))
    best = F.max(F.struct(share.alias("disclosure"), "entity")).alias("best")
    return judged.groupBy("term").agg(best).select("term", "best.disclosure", F.split_part("best.entity", F.lit(":"), F.lit(2)).alias("kind"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text's hash), base and terms: the spans of every document, one row per row."""
    rows = _documents(docs, id_col, text_col)
    spans = rows.withColumn("base", base_spans(F.col("text")))
    base = cut(spans.select("doc_id", "t", "base", F.when(F.size("base") > 0, terms(F.col("text"))).alias("terms")))
    flagged = disclosures(base, rows).where(F.col("disclosure") >= GENERALISE)
    word = F.lit(GENERAL_WORDS[""])
    for kind in KINDS:
        word = F.when(F.col("kind") == kind, GENERAL_WORDS[kind]).otherwise(word)
    flagged, n = small_side(flagged.select(F.col("term").alias("_term"), F.when(F.col("disclosure") >= REMOVE, "").otherwise(word).alias("_word")), F.length("_term") + 64)
    base = base.select("doc_id", "t", "base")
    if n == 0:
        return base.withColumn("terms", _no_spans())
    held = rows.select("doc_id", "t", F.explode(terms(F.col("text"))).alias("term")).join(flagged, F.col("term") == F.col("_term"), "left_semi")
    held, _ = small_side(held.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct(), 32)
    place = lambda start, end, value: F.struct(start.alias("start"), end.alias("end"), value.alias("value"))
    placed = rows.join(held, _same_document(), "left_semi").select("doc_id", "t", F.explode(_spans(F.col("text"), _TOKEN, lambda value: ~value.contains("@"), place)).alias("s"))
    placed = placed.join(flagged, F.lower("s.value") == F.col("_term"))
    entry = _entry(TERM, F.col("_word"))(F.col("s.start"), F.col("s.end"), F.col("s.value"))
    own = placed.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.sort_array(F.collect_set(entry)).alias("terms"))
    own, _ = small_side(own, F.size("terms") * 96 + 48)
    return base.join(own, _same_document(), "left").select("doc_id", "t", "base", F.coalesce("terms", _no_spans()).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans as text, and how many of them are terms and are there in all."""
    rows = found(docs)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    more = (F.size("terms").cast("bigint").alias("n_term"), (F.size("base") + F.size("terms")).cast("bigint").alias("n_spans"))
    return rows.select("doc_id", *(n(kind) for kind in KINDS), F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.concat("base", "terms")).alias("spans"), *more)


def _replaced(text: Column, edits: Column) -> Column:
    """The text with its sorted edits (start, -end, word) made; one that begins inside an earlier one goes with it, of one start the longest is made.

    Pieces between edits are cut out of chunks of _PIECE code points, so that
    a cut does not walk the whole text.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def filled(x: Column) -> Column:
        """x: struct(chunks, edits, ends: the furthest end up to each edit)."""

        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / _PIECE).cast("int")
            whole = F.array_join(F.slice(x["chunks"], first + 1, F.greatest(F.floor((b - 1) / _PIECE).cast("int") - first + 1, F.lit(0))), "")
            return F.when(b > a, whole.substr(a - first * _PIECE + 1, b - a)).otherwise("")

        def edited(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
            return F.when(s["start"] >= before, F.concat(piece(before, s["start"]), s["word"])).otherwise("")

        last = F.element_at(x["ends"], -1)
        return F.concat(F.array_join(F.transform(x["edits"], edited), ""), piece(last, F.length(text)))

    ends = _running(F.transform(edits, lambda s: -s["back"]), F.greatest)
    bound = F.array(F.struct(chunks.alias("chunks"), edits.alias("edits"), ends.alias("ends")))
    return F.get(F.transform(bound, filled), F.lit(0))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' rows with base spans replaced by <KIND>, terms generalised or taken out; overlapping spans become one."""
    spans = found(docs, id_col, text_col)
    edits = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["word"].alias("word"))))
    edits = spans.where((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), edits.alias("_edits")).dropDuplicates(["_id", "_t"])
    edits, _ = small_side(edits, F.size("_edits") * 64 + 48)
    carried = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).withColumn("t", F.xxhash64(F.coalesce("_text", F.lit(""))))
    joined = carried.join(edits, _same_document(), "left")
    text = F.when(F.col("_edits").isNull(), F.col("_text")).otherwise(_replaced(F.col("_text"), F.col("_edits")))
    return joined.select(*((text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))
