"""Personal data, and the terms that give it away, in DataFrame operations only.

Patterns find e-mail and IP addresses, card and telephone numbers.  Sanitisation then follows information theory (Sanchez and Batet,
"C-sanitized", 2016): over the corpus, what a term reveals of a protected entity is their pointwise mutual information, the entity's information
content less what a reader who knows the term still does not know, -log2 P(entity | term).  That rest, in bits, is what the thresholds bound; it
follows from the rows that have the term and not from how many others there are, so a text is treated alike in a table of any size.  The chance
is the lower end of Wilson's interval for the rows counted, so a single row proves little and many prove much.  Terms near an entity that leave
``generalise`` bits or fewer are replaced by their shape, those that leave ``remove`` or fewer are taken out, wherever they stand in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole

KINDS = ("email", "ip", "card", "phone")

# Every expression consumes its runs possessively and begins either where no run goes on or where the last match ended, so that a failing
# run is tried once and not from each of its characters; the matches are the leftmost non-overlapping ones of the plain expressions.  The
# card expression leaves out runs of fewer than 13 digits, which would be dropped anyway.
_EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Code points on either side of an entity that count as its context.
CONTEXT = 60
#: Standard deviations to the lower end of the interval: 95 of 100 chances lie above it.
SURE = 1.645
#: Spans of a text are placed in runs of so many, which are then shifted; code points to a cell of a text.
RUN, CELL = 512, 64
#: Bits of an entity that a term may leave unknown before it is generalised, and before it is removed: one sighting in one row, three of three.
GENERALISE, REMOVE = 2.0, 1.0
_TERM = r"[\p{L}]{3,}"

SPAN = "struct<start:long,end:long,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _found(text: Column, expression: str) -> Column:
    """The matches in ``text`` with their places: the lengths of what lies between matches tell where they begin."""
    hits = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    gaps = F.transform(F.split(text, expression, -1), lambda g: F.length(g).cast("long"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.filter(F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))), lambda p: p["hit"].isNotNull())
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("bases"))

    # a state that grows is copied at every step, so it is kept short: runs of pairs are placed from 0 and then moved
    def runs(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(pairs, i * RUN + 1, RUN), begin, step))

    def moved(runs: Column) -> Column:
        bases = F.aggregate(runs, none, lambda s, r: F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["bases"], F.array(s["at"])).alias("bases")), lambda s: s["bases"])
        shift = F.zip_with(runs, bases, lambda r, b: F.transform(r["spans"], lambda s: F.struct((s["start"] + b).alias("start"), (s["end"] + b).alias("end"), s["value"].alias("value"))))
        return F.flatten(shift)

    return _with(pairs, lambda p: F.when(F.size(p) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(_with(runs(p), moved)))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _of_kind(kind: str, spans: Column) -> Column:
    kept = F.filter(spans, lambda s: _valid(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Personal data in ``text`` as an array of (kind, start, end, value), by kind and then start; null text has none."""
    text = F.coalesce(text, F.lit(""))
    parts = []
    for kind in KINDS:
        expression = _EXPRESSIONS[kind]
        there = text.rlike(expression)
        for hint in {"email": "@", "phone": "+"}.get(kind, ""):
            there = F.contains(text, F.lit(hint)) & there
        parts.append(F.when(there, _of_kind(kind, _found(text, expression))).otherwise(F.array().cast("array<struct<kind:string,start:long,end:long,value:string>>")))
    return F.concat(*parts)


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("email", "ip"), F.lower(span["value"])).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, row_key, base, words): one pass over the texts for entities and, where there are any, for all words of three letters or more.

    ``row`` numbers the rows, of which some may be equal.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.explode(F.array(base_spans(F.col("text")))))
    words = F.when(F.size("base") > 0, _found(F.col("text"), _TERM)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "row_key", "base", words.alias("words")))


def _cells(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(F.greatest(start, F.lit(0)) / CELL), F.floor(F.greatest(end - 1, start, F.lit(0)) / CELL)))


def _placed(scanned: DataFrame, context: int) -> tuple[DataFrame, DataFrame]:
    """(row, term, start, end) of the words outside all entities, and (row, entity, term) of those that lie whole within ``context`` of the entity.

    Words and entities meet by the cells of the text that they lie in, so a text full of both costs no more than its length.
    """
    words = scanned.select("row", F.explode("words").alias("w")).select("row", F.lower("w.value").alias("term"), "w.start", "w.end").withColumn("cell", _cells(F.col("start"), F.col("end")))
    entities = scanned.select("row", F.explode("base").alias("b")).select("row", _entity(F.col("b")).alias("entity"), F.col("b.start").alias("from"), F.col("b.end").alias("to"))
    covered = entities.select("row", "from", "to", _cells(F.col("from"), F.col("to")).alias("cell"))
    within = words.join(covered, ["row", "cell"]).where("start < to and from < end").select("row", "start").distinct()
    free = words.drop("cell").distinct().join(within, ["row", "start"], "left_anti")
    free = saved(free)
    wide = entities.select("*", _cells(F.col("from") - context, F.col("to") + context).alias("cell"))
    near = free.withColumn("cell", _cells(F.col("start"), F.col("end"))).join(wide, ["row", "cell"]).where((F.col("start") >= F.col("from") - context) & (F.col("end") <= F.col("to") + context))
    return free, saved(near.select("row", "entity", "term").distinct())


def lower_chance(hits: Column, of: Column, sure: float) -> Column:
    """The lower end of Wilson's interval for a chance of which ``hits`` cases of ``of`` are known."""
    p, z = hits / of, sure * sure / of
    return (p + z / 2 - F.sqrt(z * p * (1 - p) + z * z / 4)) / (1 + z)


def _disclosing(scanned: DataFrame, docs: DataFrame, context: int, sure: float, most: float) -> DataFrame:
    """(row, start, end, left) of every occurrence, in its row, of a term near an entity that leaves ``most`` bits of it or fewer unknown.

    All counts are of rows.  What the rows hold anyway, an entity in as large a share of all of them, no term reveals.
    """
    free, near = _placed(scanned, context)
    total = scanned.count()
    entities = scanned.select("row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    both = near.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    plain = F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0))
    # the small letter of U+0130 ends in a mark, at which a word of the lower-cased text would end
    exact = F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower)
    words = docs.select(F.explode(F.array_distinct(F.when(F.contains("text", F.lit("\u0130")), exact).otherwise(plain))).alias("term"))
    # an inner join stays above the aggregation, so what is joined is a row a term and not a row an occurrence
    terms = words.groupBy("term").agg(F.count("*").alias("n_term")).join(near.select("term").distinct(), "term")
    left = -F.log2(lower_chance(F.col("n_both"), F.greatest("n_term", "n_both"), sure))
    told = both.join(terms, "term").join(entities, "entity").withColumn("left", left).where((F.col("left") <= most) & (F.col("left") < F.log2(total / F.col("n_entity"))))
    flagged = near.join(told.select("entity", "term", "left"), ["entity", "term"]).groupBy("row", "term").agg(F.min("left").alias("left"))
    return free.join(flagged, ["row", "term"]).select("row", "start", "end", "left")


def personal_data(docs: DataFrame, context: int = CONTEXT, sure: float = SURE, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, row_key, spans) for every row of ``docs`` (doc_id, text, any other columns).

    ``spans`` is an array of (kind, start, end, action) in code points: the kinds of personal data first, in their order, then ``term`` for
    words that give an entity away, by start.  Null text is empty; texts without an entity have no span whatever their words; null ids are
    kept; repeated rows stay repeated and each counts as a document; a term near several entities is treated as for the one of which it leaves
    least; no row gives no row.  ``row_key`` is a hash of doc_id and text.
    """
    scanned = _scanned(docs)
    told = _disclosing(scanned, docs, context, sure, generalise)
    action = F.when(F.col("left") <= remove, "remove").otherwise("generalise")
    terms = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", action.alias("action")))).alias("terms"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("mask").alias("action")))
    none = F.array().cast("array<struct<kind:string,start:long,end:long,action:string>>")
    return scanned.drop("words").join(terms, "row", "left").select("doc_id", "row_key", F.concat(base, F.coalesce("terms", none)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and listing of the spans of each row."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, telling terms by their shape or by nothing; other rows stay as they are.

    Where spans overlap, the one that begins first is replaced and those within it go with it.
    """
    found = personal_data(docs, **options).where(F.size("spans") > 0).select("row_key", "spans").dropDuplicates(["row_key"])
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text", whole(docs)).join(found, "row_key", "left")
    by_start = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(b["end"] - a["end"])).cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring("text", (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        term = F.substring("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        shape = F.regexp_replace(F.regexp_replace(term, r"\p{Lu}", "X"), r"\p{Ll}", "x")
        instead = F.when(s["action"] == "mask", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["action"] == "generalise", shape).otherwise("")
        taken = F.struct(s["end"].alias("at"), F.concat(state["out"], between, instead).alias("out"))
        return F.when(s["start"] < state["at"], state).otherwise(taken)

    text = F.aggregate(by_start, begin, step, lambda s: F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.length("text"))))
    changed = F.when(F.size("spans") > 0, text).otherwise(F.col("text"))
    return rows.select(F.col("row__").withField("text", changed).alias("row__")).select("row__.*")
