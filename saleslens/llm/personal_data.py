"""Personal data: spans by pattern, and terms that give protected values away by their co-occurrence.

A term's disclosure of a value is its pointwise mutual information with the
value, as a share of all the information that the value holds. Frequencies are
counted over the whole corpus; everything runs in built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import stage
from .near_copies import BROADCAST_IDS

#: Stands for each character of a span where terms are looked for.
_MASK = "\u0001"
#: Numbers are summed up in chunks of 256, texts are cut into blocks of 1,024 code points.
_CHUNK_BITS, _BLOCK_BITS = 8, 10
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


@dataclass(frozen=True)
class Kind:
    """`pattern` finds what the stated expression finds; a match can only start where a run of its signs does,
    so it says so, and repeats without going back. `hint` is true for every text that has a match."""

    name: str
    hint: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    placeholder: str


KINDS = (
    Kind(
        "email",
        lambda text: text.contains("@"),
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda value: F.lit(True),
        "[EMAIL]",
    ),
    Kind(
        "ip",
        lambda text: text.rlike(r"[0-9]\.[0-9]"),
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda value: value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "[IP]",
    ),
    Kind(
        "card",
        lambda text: text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda value: F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value)),
        "[CARD]",
    ),
    Kind(
        "phone",
        lambda text: text.rlike(r"\+[0-9][\x20().0-9-]"),
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda value: F.length(_digits(value)).between(9, 15),
        "[PHONE]",
    ),
)
TERM = "term"


@dataclass(frozen=True)
class DisclosureRule:
    """`reach` characters on each side of a value are its context; terms have `term_length` signs at least.

    A term counts from `support` distinct contexts of one value on. From
    `generalise` on it is replaced by its kind, from `remove` on it is removed.
    """

    reach: int = 80
    term_length: int = 4
    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body's inner functions name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of `numbers`, which aren't negative, the `join` (sum, greatest) of all before it, from 0 on.

    An array that grows is copied at every step, so it grows within a chunk only, and then over chunks.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))

    def step(so_far: Column, number: Column) -> Column:
        return F.struct(
            join(so_far["at"], number).alias("at"), F.concat(so_far["seen"], F.array(so_far["at"])).alias("seen")
        )

    def chunks(all_: Column) -> Column:
        last = F.shiftright(F.greatest(F.size(all_) - 1, F.lit(0)), _CHUNK_BITS)
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda at: F.aggregate(F.slice(all_, F.shiftleft(at, _CHUNK_BITS) + 1, F.lit(1 << _CHUNK_BITS)), start, step),
        )

    def joined(parts: Column) -> Column:
        ahead = F.aggregate(F.transform(parts, lambda part: part["at"]), start, step)["seen"]
        return F.flatten(F.zip_with(parts, ahead, lambda part, at: F.transform(part["seen"], lambda seen: join(at, seen))))

    return _let(numbers, lambda all_: _let(chunks(all_), joined))


def _blocks(text: Column) -> Column:
    """The text in blocks of equal length, so that a place in it is found without counting from its begin."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << _BLOCK_BITS}}}+"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from code point `start` to `end` (exclusive; beyond the text: to its end), empty if `end` isn't greater."""
    first, last = F.shiftright(start, _BLOCK_BITS), F.shiftright(end - 1, _BLOCK_BITS)
    near = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(near, start - F.shiftleft(first, _BLOCK_BITS) + 1, end - start)).otherwise("")


def _spans(text: Column, pattern: Column | str, value: Callable[[Column, Column], Column]) -> Column:
    """`value(match, start)` of each match, its start by the lengths of what lies between matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))

    def placed(found: Column) -> Column:
        widths = F.zip_with(found["matches"], found["gaps"], lambda match, gap: F.coalesce(F.length(match), F.lit(0)) + gap)
        starts = F.zip_with(_before(widths, lambda a, b: a + b), found["gaps"], lambda before, gap: before + gap)
        return F.zip_with(found["matches"], F.slice(starts, F.lit(1), F.size(found["matches"])), value)

    return _let(F.struct(matches.alias("matches"), gaps.alias("gaps")), placed)


def _kind_spans(kind: Kind, text: Column) -> Column:
    found = _spans(
        text,
        kind.pattern,
        lambda match, start: F.struct(
            start.alias("start"), (start + F.length(match)).alias("end"), match.alias("value")
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(kind.hint(text), F.filter(found, lambda span: kind.valid(span["value"]))).otherwise(none)


def _replaced(text: Column, spans: Column, instead: Callable[[Column], Column]) -> Column:
    """The text with `instead(span)` for each stretch of spans, which are in order of `start` and may overlap."""
    ends = _before(F.transform(spans, lambda span: span["end"]), F.greatest)

    def put(of: Column) -> Column:
        def part(span: Column, at: Column) -> Column:
            own = F.struct(F.greatest(span["start"], at).alias("start"), *(span[c].alias(c) for c in ("end", "kind", "value")))
            shown = F.concat(_cut(of["blocks"], at, span["start"]), instead(own))
            return F.when(span["end"] <= at, "").otherwise(shown)

        parts = F.zip_with(of["spans"], of["ends"], part)
        last = F.coalesce(F.array_max(F.transform(of["spans"], lambda span: span["end"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), _cut(of["blocks"], last, of["length"]))

    whole = F.struct(_blocks(text).alias("blocks"), spans.alias("spans"), ends.alias("ends"), F.length(text).alias("length"))
    return _let(whole, put)


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with an array column for each kind: `start`, `end` and `value` of its valid matches.

    The four columns are named `_email`, `_ip`, `_card` and `_phone`. A null
    text is taken as empty, which has none.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({f"_{kind.name}": _kind_spans(kind, whole) for kind in KINDS})


def _all_spans(extra: Column | None = None) -> Column:
    """All spans as `start`, `end`, `kind`, `value`, in order of their starts."""

    def named(kind: str) -> Column:
        return F.transform(
            f"_{kind}",
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")
            ),
        )

    return F.array_sort(F.concat(*(named(kind.name) for kind in KINDS), *([] if extra is None else [extra])))


def _terms(text: Column, length: int) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda word: F.length(word) >= length)


def _disclosures(held: DataFrame, docs: DataFrame, rule: DisclosureRule) -> DataFrame:
    """`entity` and its `terms` (`term`, `disclosure`) from `rule.generalise` on, one row for each value.

    `held` has `_key`, `entity`, `context`. Term, value, both together and corpus are counted in documents, copies
    among them; only a term's support counts distinct contexts, by their hash. Documents that have the same contexts
    of a value are counted before their terms are, so a group of copies costs the terms of one.
    """
    known = held.withColumn("term", F.array_distinct(_terms(F.col("context"), rule.term_length)))
    known = stage(known.select("_key", "entity", F.xxhash64("context").alias("which"), "term"), "contexts")
    counted = stage(known.dropDuplicates(["entity", "which"]), "distinct-contexts")
    alike = (
        known.select("_key", "entity", "which")
        .distinct()
        .groupBy("_key", "entity")
        .agg(F.bit_xor(F.xxhash64("which")).alias("contexts"), F.count("*").alias("n_contexts"))
        .groupBy("entity", "contexts", "n_contexts")
        .agg(F.count("*").alias("docs"), F.min("_key").alias("_key"))
    )
    alike = stage(alike.select("_key", "entity", "docs"), "alike")
    values = stage(alike.groupBy("entity").agg(F.sum("docs").alias("with_value")), "values")
    total = float(max(docs.count(), 2))
    n = F.lit(total)
    # A term of as many documents as this, or more, can't reach the threshold; it is in as many at least as have it
    # in some context. So frequent words are left out before all texts are searched for the others.
    most = F.col("together") * F.pow(n / F.col("with_value"), F.lit(1 - rule.generalise)) * (1 + 1e-9)
    near = known.select("_key", F.explode("term").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("near"))
    together = (
        known.join(alike, ["_key", "entity"])
        .select("_key", "entity", "docs", F.explode("term").alias("term"))
        .distinct()
        .groupBy("entity", "term")
        .agg(F.sum("docs").alias("together"))
    )
    pairs = (
        counted.select("entity", F.explode("term").alias("term"))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("support"))
        .filter(F.col("support") >= rule.support)
        .join(together, ["entity", "term"])
        .join(near, "term")
        .join(values, "entity")
        .filter(F.col("near") <= most)
    )
    pairs = stage(pairs.select("entity", "term", "together", "with_value"), "co-occurrence")
    wanted = stage(pairs.select("term").distinct(), "terms")
    whole = docs.select(F.explode(F.array_distinct(_terms(F.col("text"), rule.term_length))).alias("term"))
    few = wanted.count() <= BROADCAST_IDS
    spread = (
        whole.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("with_term"))
    )
    surprise = F.log2(n / F.col("with_value"))
    shared = F.log2(n * F.col("together") / (F.col("with_value") * F.col("with_term")))
    return (
        pairs.join(spread, "term")
        .withColumn("disclosure", F.when(surprise > 0, F.least(shared / surprise, F.lit(1.0))).otherwise(0.0))
        .filter(F.col("disclosure") >= rule.generalise)
        .groupBy("entity")
        .agg(F.collect_list(F.struct("term", "disclosure")).alias("terms"))
    )


def _shape(word: Column) -> Column:
    """What a word is generalised to."""
    return (
        F.when(word.rlike(r"\p{N}"), F.lit("[NUMBER]")).when(word.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
    )


def find_personal_data(docs: DataFrame, rule: DisclosureRule = DisclosureRule(), text: str = "text") -> DataFrame:
    """`docs` with `spans`, in order of kind and start, and `sanitised`, the text without them.

    A span has `kind` (email, ip, card, phone, term), `start` and `end` in code
    points (end exclusive), `value`, and for terms their `disclosure`. Values
    are replaced by placeholders; terms by what kind of word they are, or by
    nothing. Where spans overlap, the one that starts first stands for them.

    A null text has no spans and stays null; an empty one stays empty. Repeated
    rows agree. A value that a third of the documents hold, in copies or not,
    costs one row for each distinct context. Columns of the two names are
    replaced, others stay; they travel packed, so none of their names can clash.
    """
    kept = [c for c in docs.columns if c not in ("spans", "sanitised")]
    packed = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept) if c != text))
    found = _find(docs.select(F.col(f"`{text}`").alias("text"), packed.alias("others")), rule)
    columns = {c: F.col(f"others.c{i}") for i, c in enumerate(kept)} | {text: F.col("text")}
    return found.select(*(columns[c].alias(c) for c in kept), "spans", "sanitised")


def _find(docs: DataFrame, rule: DisclosureRule) -> DataFrame:
    """`find_personal_data` of documents whose only columns are `text` and `others`."""
    text, kept = "text", ["text", "others"]
    names = [f"_{kind.name}" for kind in KINDS]
    based = find_base(docs.select(*(f"`{c}`" for c in kept)), text)
    any_found = F.greatest(*(F.size(c) for c in names)) > 0
    based = stage(based.withColumn("_found", any_found), "base-spans")
    spanned = based.filter("_found").withColumns(
        {"_all": _all_spans(), "_key": F.monotonically_increasing_id()}
    )
    mask = lambda span: F.repeat(F.lit(_MASK), span["end"] - span["start"])
    masked = stage(spanned.withColumn("_masked", _replaced(F.col(text), F.col("_all"), mask)), "masked")

    def entity(span: Column) -> Column:
        value = span["value"]
        same = F.when(span["kind"] == "email", F.lower(value)).when(span["kind"] == "ip", value).otherwise(_digits(value))
        return F.concat_ws(":", span["kind"], same)

    def around(blocks: Column, span: Column) -> Column:
        return _cut(blocks, F.greatest(span["start"] - rule.reach, F.lit(0)), span["end"] + rule.reach)

    contexts = _let(
        F.struct(_blocks(F.col("_masked")).alias("blocks"), F.col("_all").alias("spans")),
        lambda of: F.transform(
            of["spans"], lambda span: F.struct(entity(span).alias("entity"), around(of["blocks"], span).alias("context"))
        ),
    )
    held = masked.select("_key", F.explode(contexts).alias("_held")).select("_key", "_held.entity", "_held.context")
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    disclosed = stage(_disclosures(held, whole, rule), "disclosures")
    few = disclosed.count() <= BROADCAST_IDS
    of_doc = (
        held.select("_key", "entity")
        .distinct()
        .join(F.broadcast(disclosed) if few else disclosed, "entity")
        .select("_key", F.explode("terms").alias("_term"))
        .groupBy("_key", F.col("_term.term").alias("term"))
        .agg(F.max("_term.disclosure").alias("disclosure"))
        .groupBy("_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_terms"))
    )
    joined = masked.join(stage(of_doc, "terms-of-documents"), "_key", "left")
    alternatives = F.array_join(F.map_keys("_terms"), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), alternatives, F.lit(r")(?![\p{L}\p{N}])"))
    term_spans = _spans(
        F.col("_masked"),
        pattern,
        lambda match, start: F.struct(
            start.alias("start"), (start + F.length(match)).alias("end"), F.lit(TERM).alias("kind"), match.alias("value")
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    full = joined.withColumn("_term_spans", F.when(F.col("_terms").isNotNull(), term_spans).otherwise(none)).withColumn(
        "_all", _all_spans(F.col("_term_spans"))
    )

    def instead(span: Column) -> Column:
        disclosure = F.element_at("_terms", F.lower(span["value"]))
        shown = F.when(disclosure >= rule.remove, "").otherwise(_shape(span["value"]))
        return reduce(lambda rest, kind: F.when(span["kind"] == kind.name, kind.placeholder).otherwise(rest), KINDS, shown)

    span_type = "array<struct<kind:string,start:int,end:int,value:string,disclosure:double>>"

    def of_kind(spans: Column, kind: str) -> Column:
        disclosure = (lambda s: F.element_at("_terms", F.lower(s["value"]))) if kind == TERM else (lambda s: F.lit(None))
        return F.transform(
            F.filter(spans, lambda s: s["kind"] == kind),
            lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], disclosure(s).cast("double")),
        ).cast(span_type)

    listed = F.concat(*(of_kind(F.col("_all"), kind) for kind in (*(kind.name for kind in KINDS), TERM)))
    changed = full.select(
        *(f"`{c}`" for c in kept),
        listed.alias("spans"),
        _replaced(F.col(text), F.col("_all"), instead).alias("sanitised"),
    )
    untouched = based.filter("not _found").select(
        *(f"`{c}`" for c in kept), F.array().cast(span_type).alias("spans"), F.col(text).alias("sanitised")
    )
    return changed.unionByName(untouched)


def span_texts(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, rule: DisclosureRule = DisclosureRule(), text: str = "text") -> DataFrame:
    """`docs` with the sanitised text in place of the text, all columns as before; `n_chars` follows, if there.

    The other columns travel packed, so none of their names can clash.
    """
    others = [c for c in docs.columns if c != text]
    packed = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    found = _find(docs.select(F.col(f"`{text}`").alias("text"), packed.alias("others")), rule)
    after = {c: F.col(f"others.c{i}") for i, c in enumerate(others)} | {text: F.col("sanitised")}
    if "n_chars" in others:
        length = F.length("sanitised").cast(docs.schema["n_chars"].dataType)
        after["n_chars"] = F.when(F.size("spans") > 0, length).otherwise(after["n_chars"])
    return found.select(*(after[c].alias(c) for c in docs.columns))
