"""Personal data: fixed patterns, and terms that reveal it by their corpus co-occurrence.

Patterns give the protected entities.  For every word that stands outside them in a document
with an entity, the corpus says how strongly it reveals the entity, and the entity's kind
(after Sanchez and Batet): the pointwise mutual information of word and entity (or kind), as
a share of the entity's own information,

    log(N * n(term and entity) / (n(term) * n(entity))) / log(N / n(entity)),

all n being numbers of documents, over the whole corpus.  It is 1 for a term that occurs only
in documents with the entity and at most 0 for one that does so no more often than by chance.
From ``generalise_at`` on all the term's occurrences in documents with the entity are spans
too; the sanitised text replaces them by a general word, from ``remove_at`` on it leaves them
out.

There is no least number of documents, but a share must not be due to chance.  If term and
entity were independent, the probability of so many common documents would be at most

    exp(-n(term) * D),  D = divergence of n(term and entity)/n(term) from n(entity)/N

(Chernoff and Hoeffding).  Times the number of comparisons (terms by entities, or terms by
kinds) it must be at most ``chance``.  Entities with too few documents to get there whatever
the term are left out before anything is counted; this changes no result.

Only DataFrame functions are used.  Positions come from the pieces between matches, so they
count code points.  Statistics are combined in the map tasks; only the numbers of documents,
terms, entities and kinds reach the driver.

A null text counts as empty and has no spans; null or repeated ids each give a row.  An entity
or kind that every document has reveals nothing.  Entities are told apart by kind and by
lower-cased address, IP without leading zeros, or digits.  Patterns run in linear time on long
runs of one character class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from oreline.llm.common import swept
from oreline.sources.paths import stored

# The kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPANS = "array<struct<start:bigint,end:bigint>>"
_TERM_SPANS = "array<struct<start:bigint,end:bigint,remove:boolean>>"
_MARK, _OTHER = "\x1f", "\x1e"

# The patterns of the contract.  Possessive runs and the checks of what stands before keep
# the search linear: where a run of the class fails at its first character, it fails at all.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
_CARD = rf"[0-9][0-9{_MARK}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _found(text: Column, pattern: str) -> Column:
    """Matches as ``start, end, value``, from their lengths and those of the pieces between."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    pairs = F.arrays_zip(values.alias("value"), F.slice(pieces, 1, F.size(values)).alias("gap"))

    def step(state, pair):
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return {"at": end}, F.array(one), F.lit(True)

    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    return swept(pairs, {"at": F.lit(0).cast("bigint")}, step, kind)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        digit = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_parts(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(
        parts,
        lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)),
    )


def base_spans(text: Column) -> dict[str, Column]:
    """Valid matches per kind, each an array of ``start, end`` in order of start."""
    # Separators inside a card number become one mark, so that a run is one character class.
    marked = F.regexp_replace(
        F.translate(text, _MARK, _OTHER), "[ -](?<=[0-9][ -])(?=[0-9])", _MARK
    )
    plan = {
        "email": (F.contains(text, F.lit("@")), text, _EMAIL, lambda v: F.lit(True)),
        "ip": (F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), text, _IP, _small_parts),
        "card": (
            F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){12}")),
            marked,
            _CARD,
            lambda v: F.length(_digits(v)).between(13, 19) & _luhn(_digits(v)),
        ),
        "phone": (
            F.contains(text, F.lit("+")),
            text,
            _PHONE,
            lambda v: F.length(_digits(v)).between(9, 15),
        ),
    }

    def spans(gate, source, pattern, valid):
        matches = F.filter(_found(source, pattern), lambda m: valid(m["value"]))
        matches = F.transform(
            matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
        )
        return F.when(gate, matches).otherwise(F.array().cast(_SPANS))

    return {kind: spans(*parts) for kind, parts in plan.items()}


_STEP = 4096


def _with_pieces(text: Column, use) -> Column:
    """``use(piece)``, where ``piece(start, length)`` is a part of ``text``.

    A substring is searched for from the front of a text, so that taking many from a long one
    is slow; these are taken from short steps of it, which are cut once."""
    count = F.floor(F.length(text) / _STEP).cast("int")
    steps = F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(text, i * _STEP + 1, F.lit(_STEP)))

    def inside(steps):
        def piece(start, length):
            at = F.floor(start / _STEP).cast("int")
            near = F.concat(F.get(steps, at), F.coalesce(F.get(steps, at + 1), F.lit("")))
            near = F.substring(near, (start - at * _STEP + 1).cast("int"), length.cast("int"))
            far = F.substring(text, (start + 1).cast("int"), length.cast("int"))
            return F.when(length <= _STEP, near).otherwise(far)

        return use(piece)

    return F.transform(F.array(steps), inside)[0]


def _values(text: Column, kind: str) -> Column:
    """The entities of a kind as they are told apart."""
    same = {
        "email": F.lower,
        "ip": lambda v: F.regexp_replace(v, r"(?<![0-9])0+(?=[0-9])", ""),
        "card": _digits,
        "phone": _digits,
    }[kind]
    return _with_pieces(
        text, lambda piece: F.transform(kind, lambda s: same(piece(s["start"], s["end"] - s["start"])))
    )


def _held(text: Column) -> Column:
    """The kinds of a row (with an empty value) and its entities, each once."""

    def of(kind: str) -> Column:
        named = lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        # Of strings Spark finds the distinct ones by hash, of structs one by one.
        values = F.array_distinct(F.concat(F.array(F.lit("")), _values(text, kind)))
        return F.when(F.size(kind) > 0, F.transform(values, named)).otherwise(
            F.array().cast("array<struct<kind:string,value:string>>")
        )

    return F.concat(*[of(k) for k in KINDS])


def _outside(text: Column) -> Column:
    """The text with its entities blanked, so that all positions stay."""

    def step(piece, state, span):
        begin = F.greatest(span["start"], state["at"])
        gap = piece(state["at"], begin - state["at"])
        blank = F.repeat(F.lit(" "), F.greatest(span["end"] - begin, F.lit(0)).cast("int"))
        return {"at": F.greatest(span["end"], state["at"])}, F.array(gap, blank), span["end"] > state["at"]

    spans = F.array_sort(F.concat(*KINDS))
    blanked = _with_pieces(
        text,
        lambda piece: swept(
            spans,
            {"at": F.lit(0).cast("bigint")},
            lambda state, span: step(piece, state, span),
            "array<string>",
            lambda out, s: F.concat(
                F.array_join(out, ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
            ),
        ),
    )
    return F.when(F.size(spans) > 0, blanked).otherwise(text)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))


def _lowered(text: Column) -> Column:
    return F.transform(_words(text), F.lower)


def protected(based: DataFrame, documents: int, terms: int, chance: float) -> tuple[DataFrame, DataFrame]:
    """``target, of, least`` for kinds and entities that a term may reveal, with the number of
    their documents and the score to reach, and ``row, target`` for the rows that hold them."""
    held = based.select("row", F.explode("held").alias("h")).select("row", "h.*")
    counted = stored(held.groupBy("kind", "value").agg(F.count("*").alias("of")), "entities")
    kinds, entities = counted.agg(F.count_if(F.col("value") == ""), F.count_if(F.col("value") != "")).first()
    least = F.when(F.col("value") == "", F.lit(kinds)).otherwise(F.lit(entities))
    least = F.log(least.cast("double") * max(terms, 1) / chance)
    able = counted.where(F.col("of") < documents).withColumn("least", least)
    able = able.where(F.col("of") * F.log(F.lit(documents) / F.col("of")) >= F.col("least"))
    able = stored(able.withColumn("target", F.monotonically_increasing_id()), "protected")
    holding = held.join(able.select("kind", "value", "target"), ["kind", "value"])
    return able.select("target", "of", "least"), stored(holding.select("row", "target"), "holding")


def _outside_of(based: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``outside``; no text without an entity is shuffled for it."""
    return based.where(F.size("held") > 0).select("row", "outside").join(rows, "row")


def _with_targets(based: DataFrame, holding: DataFrame) -> DataFrame:
    return _outside_of(based, holding.groupBy("row").agg(F.collect_list("target").alias("targets")))


def disclosure(based: DataFrame, chance: float) -> tuple[DataFrame, DataFrame]:
    """``target, term, share`` for terms that go with an entity or kind by more than chance,
    and ``row, target`` for the rows that hold these."""
    terms = based.select(F.explode(F.array_distinct(_lowered(F.col("outside")))).alias("term"))
    terms = stored(terms.groupBy("term").agg(F.count("*").alias("having")), "terms")
    documents = based.count()
    targets, holding = protected(based, documents, terms.count(), chance)
    both = (
        _with_targets(based, holding)
        .select("targets", F.explode(F.array_distinct(_lowered(F.col("outside")))).alias("term"))
        .select(F.explode("targets").alias("target"), "term")
        .groupBy("target", "term")
        .agg(F.count("*").alias("both"))
    )
    n, k, t, e = F.lit(float(documents)), F.col("both"), F.col("having"), F.col("of")
    # No term with so few common documents can reach the score, whatever its own number is.
    both = both.join(targets, "target").where(k * F.log(n / e) >= F.col("least"))
    share = F.log(n * k / (t * e)) / F.log(n / e)
    apart = F.when(t > k, (t - k) * F.log((t - k) * n / (t * (n - e)))).otherwise(0.0)
    found = (
        both.join(terms, "term")
        .where((k * n > t * e) & (k * F.log(n * k / (t * e)) + apart >= F.col("least")))
        .select("target", "term", share.alias("share"))
    )
    return found, holding


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chance: float = 0.05,
    generalise_at: float = 0.6,
    remove_at: float = 0.9,
    with_text: bool = False,
) -> DataFrame:
    """``doc_id``, an array of spans per kind, and ``terms`` (``start, end, remove``) per row.

    ``with_text`` adds the text as ``sanitised`` needs it.  Runs jobs for the statistics."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    based = rows.withColumns(base_spans(F.col("text")))
    # Numbered once, as written: later reads all see the same numbers.
    based = based.withColumns(
        {
            "outside": _outside(F.col("text")),
            "held": _held(F.col("text")),
            "row": F.monotonically_increasing_id(),
        }
    )
    based = stored(based if with_text else based.drop("text"), "personal")
    found, holding = disclosure(based, chance)
    risky = found.where(F.col("share") >= generalise_at)
    risky = stored(risky.select("target", "term", (F.col("share") >= remove_at).alias("remove")), "revealing")
    holding = holding.join(risky.select("target").distinct(), "target", "left_semi")
    words = _with_targets(based, holding).select(
        "row", "targets", F.posexplode(_lowered(F.col("outside"))).alias("number", "term")
    )
    words = words.select("row", "number", "term", F.explode("targets").alias("target"))
    marks = words.join(risky, ["target", "term"]).groupBy("row", "number").agg(F.max("remove").alias("remove"))
    marks = marks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", "remove"))).alias("marks"))
    terms = _outside_of(based, marks).select("row", _marked(F.col("outside"), F.col("marks")).alias("terms"))
    none = F.array().cast(_TERM_SPANS)
    found = based.drop("held", "outside").join(terms, "row", "left").drop("row")
    return found.withColumn("terms", F.coalesce("terms", none))


def _marked(text: Column, marks: Column) -> Column:
    """``start, end, remove`` of the words of ``text`` whose numbers are in ``marks``."""
    gaps = F.transform(F.split(text, _TERM, -1), lambda p: F.length(p).cast("bigint"))
    lengths = F.transform(_words(text), lambda w: F.length(w).cast("bigint"))
    pairs = F.arrays_zip(lengths.alias("length"), F.slice(gaps, 1, F.size(lengths)).alias("gap"))
    zero = {"at": F.lit(0).cast("bigint"), "number": F.lit(0), "next": F.lit(0)}

    def step(state, pair):
        begin = state["at"] + pair["gap"]
        end = begin + pair["length"]
        mark = F.get(marks, state["next"])
        hit = F.coalesce(mark["number"] == state["number"], F.lit(False))
        one = F.struct(begin.alias("start"), end.alias("end"), mark["remove"].alias("remove"))
        after = {"at": end, "number": state["number"] + 1, "next": state["next"] + hit.cast("int")}
        return after, F.array(one), hit

    return swept(pairs, zero, step, _TERM_SPANS)


def sanitised(found: DataFrame) -> DataFrame:
    """``doc_id, text``: entities as their kind in brackets, revealing terms generalised to
    ``[term]`` or left out.  Of overlapping spans the first, then the longer, is replaced."""

    def tagged(kind: str, by: Column) -> Column:
        return F.transform(
            by,
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(f"[{kind}]").alias("by")
            ),
        )

    terms = F.transform(
        "terms",
        lambda s: F.struct(
            s["start"].alias("start"),
            (-s["end"]).alias("end"),
            F.when(s["remove"], "").otherwise("[term]").alias("by"),
        ),
    )
    spans = F.array_sort(F.concat(*[tagged(k, F.col(k)) for k in KINDS], terms))
    text = F.col("text")

    def step(state, span):
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        free = span["start"] >= state["at"]
        return {"at": F.when(free, -span["end"]).otherwise(state["at"])}, F.array(gap, span["by"]), free

    whole = swept(
        spans,
        {"at": F.lit(0).cast("bigint")},
        step,
        "array<string>",
        lambda out, s: F.concat(
            F.array_join(out, ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
        ),
    )
    return found.select("doc_id", whole.alias("text"))


def report(found: DataFrame) -> DataFrame:
    """Counts and spans as text, kind by kind, then by start."""

    def written(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    base = F.concat(*[written(k, F.col(k)) for k in KINDS])
    every = F.concat(base, written("term", F.col("terms")))
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )
