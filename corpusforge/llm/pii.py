"""Personal data by weak supervision (operator 12), in DataFrame functions only.

Spans of four kinds come from patterns in two strengths. The strict ones,
with their checks, are the base and always stay. The loose ones propose
further spans: written-out addresses, numbers without a country code, cards
that a longer digit run swallowed, version 6 addresses.

Three labelers vote on every proposal (0 no, 1 yes, 2 no opinion): its form,
a gazetteer (domain endings, calling codes, address ranges, issuers), and its
context (cue words, what it is glued to). Expectation-maximisation estimates
each labeler's reliability by kind from how often each combination of votes
occurs; its posteriors are the soft labels of a naive Bayes classifier over
the span's shape, length, digits and neighbours, which decides on the
proposals outside the base.

Texts are scanned once. What is found is narrow and written; positions are
running sums within a document; the votes' combinations (27 a kind) and the
classifier's weights (some hundreds) are bounded whatever the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Base patterns as the task states them. Possessive repeats match the same
#: spans without backtracking; a match starts where a run starts or where the
#: match before ended, so a long run is tried once and not from each place.
STRICT = {
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[(\[{](?i:at)[)\]}]\x20?", r"(?:\.|\x20?[(\[{](?i:dot)[)\]}]\x20?)"
LOOSE = {
    EMAIL: rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    CARD: r"(?<![0-9A-Za-z])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{13,16})(?![0-9A-Za-z])",
    PHONE: r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z]|[.-][0-9])",
}
#: A text without this holds no match.
_NEEDS = {(EMAIL, True): "@", (PHONE, True): "+", (IP, True): ".", (IP, False): ":"}

#: Gazetteers.
ENDINGS = "com org net edu gov info biz io eu de at ch fr be es mx ar uk ie us ca au nz it nl pt br pl se no dk fi jp cn kr in ru".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421".split()
ISSUERS = r"^(?:4|5[0-8]|2[2-7]|3[04-9]|6)"
NATIONAL = r"^(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"
UNROUTED = r"^0*(?:0|10|127|22[4-9]|2[345][0-9])\."

#: Words before a span that speak for its kind, and those that speak against any.
CUES = {
    EMAIL: "email e-mail mail mailto correo courriel contact kontakt write",
    IP: "ip address host server adresse direccion from",
    CARD: "card visa mastercard amex credit debit karte carte tarjeta kreditkarte",
    PHONE: "phone tel telephone telefon telefono fax mobile handy call fon movil",
}
AGAINST = "token key hash id isbn issn sku version license licence serial build commit order"
CONTEXT = 48  # code points before a span in which cue words count

EM_ROUNDS = 40
SHAPES = 64
#: A proposal outside the base is added from this probability on.
LEAST = 0.9


def _hits(text: Column, kind: int, strict: bool) -> Column:
    pattern = (STRICT if strict else LOOSE)[kind]
    needed = _NEEDS.get((kind, strict))
    holds = text.contains(needed) if needed is not None else text.rlike("[0-9]" if kind != EMAIL else _AT)
    return F.when(holds, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _matches(hits: str, pieces: str, kind: int, strict: bool) -> Column:
    """One struct for each match of a pattern, with what lies around it."""
    zipped = F.arrays_zip(
        F.col(hits).alias("hit"),
        F.slice(pieces, F.lit(1), F.size(hits)).alias("piece"),
        F.slice(pieces, F.lit(2), F.size(hits)).alias("next"),
    )

    def match(z: Column, n: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(strict).alias("strict"),
            n.alias("n"),
            F.char_length(z["piece"]).cast("bigint").alias("before"),
            z["hit"].alias("hit"),
            F.lower(F.right(z["piece"], F.lit(CONTEXT))).alias("left"),
            F.substring(z["next"], 1, 1).alias("after"),
        )

    return F.transform(zipped, match)


def _found(texts: DataFrame) -> DataFrame:
    """Every match of every pattern, one row each; a document without any has
    one row with null kind. ``before`` is the length of what lies between the
    match and the one before it of the same pattern."""
    sources = [(k, strict) for strict in (True, False) for k in range(len(KINDS))]
    hits = texts.withColumns({f"h{i}": _hits(F.col("text"), *s) for i, s in enumerate(sources)})
    parts = hits.withColumns(
        {
            f"p{i}": F.when(F.size(f"h{i}") > 0, F.split("text", (STRICT if strict else LOOSE)[kind], -1))
            for i, (kind, strict) in enumerate(sources)
        }
    )
    none = F.array().cast("array<struct<kind:int,strict:boolean,n:int,before:bigint,hit:string,left:string,after:string>>")
    every = F.concat(*[F.coalesce(_matches(f"h{i}", f"p{i}", *source), none) for i, source in enumerate(sources)])
    return parts.select("row", "id", F.explode_outer(every).alias("m")).select("row", "id", "m.*")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    places = F.sequence(F.lit(1), F.char_length(digits))
    reverse = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substr(reverse, k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _sound(kind: Column, hit: Column, digits: Column) -> Column:
    """The checks that a span of its kind must pass."""
    n = F.char_length(digits)
    small = F.forall(
        F.split(hit, r"\."), lambda part: (F.char_length(F.ltrim(part, F.lit("0"))) <= 3) & (F.right(part, F.lit(3)).try_cast("int") <= 255)
    )
    return (
        F.when(kind == IP, hit.contains(":") | small)
        .when(kind == CARD, F.when(n.between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == PHONE, n.between(9, 15))
        .otherwise(True)
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def _by_kind(choose) -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == k, choose(k)), range(1, 4), F.when(F.col("kind") == 0, choose(0)))


def _votes() -> Column:
    """The labelers' votes: form, gazetteer, context."""
    hit, digits = F.col("hit"), F.col("digits")
    form = _by_kind(
        lambda k: _vote(F.col("strict") & F.col("sound"), ~F.col("sound")) if k != CARD else _vote(F.col("sound"), ~F.col("sound"))
    )
    calling = F.regexp_extract(hit, r"^\+([0-9]{1,3})", 1)
    known_code = reduce(lambda c, n: c | F.left(calling, F.lit(n)).isin(CALLING), (2, 3), F.left(calling, F.lit(1)).isin(CALLING))
    ending = F.lower(F.substring_index(hit, ".", -1))
    gazetteer = _by_kind(
        lambda k: {
            EMAIL: lambda: _vote(ending.isin(ENDINGS), ending.rlike("^[0-9-]+$")),
            IP: lambda: _vote(~hit.rlike(UNROUTED) & F.col("strict"), hit.rlike(UNROUTED)),
            CARD: lambda: _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
            PHONE: lambda: _vote(known_code | (~hit.startswith("+") & hit.rlike(NATIONAL)), hit.startswith("+") & ~known_code),
        }[k]()
    )
    glued = F.col("left").rlike(r"[\p{L}\p{N}_=\"'/#]$") | F.col("after").rlike(r"[\p{L}\p{N}_\"'/#]")
    against = F.col("left").rlike(rf"\b(?:{'|'.join(AGAINST.split())})\W{{0,6}}$")
    cue = _by_kind(lambda k: F.col("left").rlike(rf"(?<![\p{{L}}])(?:{'|'.join(CUES[k].split())})(?![\p{{L}}])[^.!?\n]*$"))
    return F.array(form, gazetteer, _vote(cue & ~glued, (glued & (F.col("kind") != EMAIL)) | against))


def _features() -> Column:
    """What the classifier sees: shape, length, digits, neighbours."""
    shape = F.regexp_replace(F.regexp_replace("hit", "[A-Za-z]+", "a"), "[0-9]+", "9")

    def char_class(c: Column) -> Column:
        return (
            F.when(c == "", "none").when(c.rlike(r"\s"), "blank").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "digit").otherwise("mark")
        )

    return F.array(
        F.concat(F.lit("shape:"), F.pmod(F.crc32(shape.cast("binary")), F.lit(SHAPES)).cast("string")),
        F.concat(F.lit("length:"), F.least(F.floor(F.char_length("hit") / 4), F.lit(15)).cast("string")),
        F.concat(F.lit("digits:"), F.least(F.char_length("digits"), F.lit(24)).cast("string")),
        F.concat(F.lit("left:"), char_class(F.right("left", F.lit(1)))),
        F.concat(F.lit("after:"), char_class(F.col("after"))),
    )


def reliabilities(votes: DataFrame) -> DataFrame:
    """(kind, em) of ``votes(kind, votes)``: ``em.prior`` is the share of true
    spans, ``em.yes`` and ``em.no`` the chance of each of the three labelers'
    votes 0, 1 and 2 (in this order, labeler by labeler) on true and on false
    ones. The combinations of votes are counted over all rows; the rounds of
    expectation and maximisation run over the counts, 27 of a kind at most."""
    counted = votes.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    held = counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("seen"))
    chance = "aggregate(sequence(0, 2), {p}, (p, j) -> p * element_at({s}, 3 * j + element_at(x.votes, j + 1) + 1))"
    yes, no = chance.format(p="em.prior", s="em.yes"), chance.format(p="1D - em.prior", s="em.no")
    true = f"{yes} / ({yes} + {no})"
    rows = f"transform(seen, x -> struct(x.votes as votes, x.n as n, {true} as q))"
    # the sums of a round: true and false spans, by vote and in all
    by_vote = "transform(sequence(0, 8), k -> (aggregate(r, 0D, (a, x) -> a + if(element_at(x.votes, cast(k div 3 as int) + 1) = k % 3, x.n * {w}, 0D)) + 1D) / (aggregate(r, 0D, (a, x) -> a + x.n * {w}) + 3D))"
    prior = "(aggregate(r, 0D, (a, x) -> a + x.n * x.q) + 1D) / (aggregate(r, 0D, (a, x) -> a + x.n) + 2D)"
    step = f"element_at(transform(array({rows}), r -> struct({prior} as prior, {by_vote.format(w='x.q')} as yes, {by_vote.format(w='(1D - x.q)')} as no)), 1)"
    start = "struct(0.5D as prior, flatten(array_repeat(array(0.1D, 0.7D, 0.2D), 3)) as yes, flatten(array_repeat(array(0.5D, 0.2D, 0.3D), 3)) as no)"
    return held.select("kind", F.expr(f"aggregate(sequence(1, {EM_ROUNDS}), {start}, (em, i) -> {step})").alias("em"))


def _posterior() -> Column:
    chance = "aggregate(sequence(0, 2), {p}, (p, j) -> p * element_at({s}, 3 * j + element_at(votes, j + 1) + 1))"
    yes, no = chance.format(p="em.prior", s="em.yes"), chance.format(p="1D - em.prior", s="em.no")
    return F.expr(f"{yes} / ({yes} + {no})")


def train(candidates: DataFrame) -> DataFrame:
    """(kind, bias, weights) of ``candidates(kind, votes, features)``: naive
    Bayes on the labelers' posteriors, one row a kind; a feature value's weight
    is its smoothed log ratio. Feature values are bounded in number."""
    labelled = candidates.join(F.broadcast(reliabilities(candidates)), "kind").withColumn("q", _posterior())
    prior = labelled.groupBy("kind").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    values = labelled.select("kind", "q", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(
        F.sum("q").alias("fyes"), F.sum(1 - F.col("q")).alias("fno")
    )
    ratio = F.log((F.col("fyes") + 1) / (F.col("yes") + SHAPES)) - F.log((F.col("fno") + 1) / (F.col("no") + SHAPES))
    weighed = values.join(F.broadcast(prior), "kind").withColumn("w", ratio)
    weights = F.map_from_entries(F.collect_list(F.struct("feature", "w")))
    return weighed.groupBy("kind").agg(
        F.first(F.log((F.col("yes") + 1) / (F.col("no") + 1))).alias("bias"), weights.alias("weights")
    )


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans; ``spans`` is an array of
    struct(start, order, end, kind, hit, base, p), sorted, in code points, end
    exclusive.

    Base spans are leftmost and non-overlapping within their kind; spans of
    different kinds may overlap. A proposal that overlaps a base span of any
    kind, or that fails its kind's checks, is never added. A null or empty text
    has no spans. Repeated rows and null ids are rows like others: rows are
    known by a key written with the matches. A table without matches trains no
    classifier and has no spans; an empty table gives an empty result. Other
    columns are ignored. Long texts are scanned whole, in time linear in their
    length."""
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = scratch.cut(_found(texts), "found")
    some = found.where("kind is not null").repartition("row")
    up_to = Window.partitionBy("row", "kind", "strict").orderBy("n")
    length = F.char_length("hit").cast("bigint")
    placed = some.withColumn("end", F.sum(F.col("before") + length).over(up_to)).withColumn("digits", _digits(F.col("hit")))
    placed = placed.withColumns({"start": F.col("end") - length, "sound": _sound(F.col("kind"), F.col("hit"), F.col("digits"))})
    placed = placed.withColumn("base", F.col("strict") & F.col("sound"))
    # both ways as running values: a frame that ends with the partition costs its square
    forwards, backwards = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.desc("start"))
    placed = placed.withColumn("reached", F.max(F.when(F.col("base"), F.col("end"))).over(forwards))
    placed = placed.withColumn("ahead", F.min(F.when(F.col("base"), F.col("start"))).over(backwards))
    free = F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") >= F.col("end"), F.lit(True))
    # a card proposal is one only where the strict pattern kept nothing; strict matches that fail teach what is false
    placed = placed.where(F.col("strict") | free).withColumns({"votes": _votes(), "features": _features()})
    candidates = scratch.cut(
        placed.select("row", "id", "kind", "strict", "sound", "base", "start", "end", "hit", "votes", "features"), "candidates"
    )
    model = train(candidates.select("kind", "votes", "features"))
    scored = candidates.join(F.broadcast(model), "kind", "left")
    log_odds = F.aggregate("features", F.col("bias"), lambda s, f: s + F.coalesce(F.col("weights")[f], F.lit(0.0)))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-log_odds)))
    kept = F.col("base") | (~F.col("strict") & F.col("sound") & F.coalesce(F.col("p") >= LEAST, F.lit(False)))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", F.col("kind").alias("order"), "end", name.alias("kind"), "hit", "base", "p")
    spans = scored.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.when(kept, span))).alias("spans"))
    none = found.where("kind is null").select("id", F.array().cast(spans.schema["spans"].dataType).alias("spans"))
    return spans.select("id", "spans").union(none).withColumnRenamed("id", id_col)
