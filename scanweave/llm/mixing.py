"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words, and so every document of it the same expected
number of copies.  The whole part is given to all; the fractional part is rounded so that
the words taken, not only their expectation, meet the target.  Two documents are paired and
words of copy probability move from one to the other, in a random direction, until one of
them is 0 or 1; the other stays open and is paired again.  What moves is the same number of
words on both sides, so the source's total never changes.

The pairing runs as a reduction tree.  Documents of a source are dealt by a hash into chunks
of a few hundred; each chunk is folded, largest document first, and leaves one open
document; the open ones are dealt into chunks again, until one is left per source.  A
document with more than 1/256 of its source's words, at most 256 of them, is paired before
that with all smaller ones together as one unit, and so does not end up as the open one;
where these cannot give or take enough words in the direction drawn, the other is taken.
The last open document of a source is rounded to the nearer value.

Defined cases: a null text has no words; a null source is a source of its own, the last
one; documents without words take 0 words; rows equal in source, id and size are one unit
and all get the same number of copies; an empty table gives an empty result; other columns
are ignored.  Random numbers are hashes of the ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_facts, numbered, packed, store, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
CHUNK = 256
LARGE_SHARE = 256
EPSILON = 1e-9
SEED = 7

_SOURCE = ["_no_source", "_source"]
_ITEM = "struct<id: {id}, size: bigint, rows: bigint>"


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``_id``, source key and ``size``, the number of words of the whole text."""
    return docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
    )


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Add ``target`` to ``sources(_no_source, _source, source_size)``.

    Sources share all words by weight; a target stops at ``most`` times its source's size,
    and what is above that is shared again by weight among the others, until none is above.
    """
    ranked = numbered(sources, [F.col("_no_source").asc(), F.col("_source").asc()], "_rank")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("_rank", F.lit(len(weights))).cast("int"))
    ranked = store(ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most))
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    level = (total or 0) / (all_weights or 1)
    while True:
        full = F.col("_cap") <= level * F.col("_weight")
        used, left = ranked.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not left:
            break
        higher = (total - (used or 0)) / left
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_weight"))
    return ranked.withColumn("target", target).drop("_rank", "_weight", "_cap")


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _uniform(*keys: str) -> str:
    """A number in [0, 1) that depends on the keys only."""
    return f"(shiftrightunsigned(xxhash64({', '.join(keys)}, {SEED}), 11) / 9007199254740992.0D)"


def _fold_large(id_type: str) -> str:
    """Settle the large documents of a source, each against all that come after it.

    State: words and copy probability of what is left, and the settled documents.
    """
    item = _ITEM.format(id=id_type)
    done = f"CAST(array() AS ARRAY<STRUCT<item: {item}, extra: INT>>)"

    def then(words: str, p: str, extra: str) -> str:
        settled = f"named_struct('item', i.item, 'extra', CAST({extra} AS INT))"
        return f"named_struct('words', {words}, 'p', {p}, 'done', concat(s.done, array({settled})))"

    rest = "CAST(s.words - i.weight AS DOUBLE)"
    up = f"least(1D - s.p, {rest} * s.p / i.weight)"
    down = f"least(s.p, {rest} * (1D - s.p) / i.weight)"
    # A move that the rest cannot complete is not made if the opposite one can be.
    upwards = (
        "CASE WHEN t.up < 1D - s.p AND t.down >= s.p THEN false WHEN t.down < s.p AND t.up >= 1D - s.p THEN true "
        "ELSE t.u * (t.up + t.down) < t.down END"
    )
    move = _let(
        "t", f"named_struct('up', {up}, 'down', {down}, 'u', {_uniform('i.item')})",
        f"CASE WHEN {upwards} THEN "
        f"IF(t.up >= 1D - s.p, {then(rest, f'greatest(0D, s.p - i.weight * t.up / {rest})', '1')}, "
        f"{then(rest, '0D', 'round(s.p + t.up)')}) ELSE "
        f"IF(t.down >= s.p, {then(rest, f'least(1D, s.p + i.weight * t.down / {rest})', '0')}, "
        f"{then(rest, '1D', 'round(s.p - t.down)')}) END",
    )
    step = (
        f"CASE WHEN s.p <= {EPSILON} OR s.p >= 1 - {EPSILON} OR {rest} <= 0.5D "
        f"THEN {then(rest, 's.p', 'round(s.p)')} ELSE {move} END"
    )
    return f"aggregate(items, named_struct('words', CAST(source_size AS DOUBLE), 'p', p, 'done', {done}), (s, i) -> {step})"


def _fold_chunk(id_type: str) -> str:
    """Pair the documents of a chunk one after the other; one of each pair stays open."""
    item = _ITEM.format(id=id_type)
    unit = f"STRUCT<weight: DOUBLE, x: DOUBLE, item: {item}>"
    done = f"CAST(array() AS ARRAY<STRUCT<item: {item}, extra: INT>>)"
    start = f"named_struct('open', CAST(NULL AS {unit}), 'done', {done})"
    taken = "named_struct('weight', i.weight, 'x', i.x, 'item', i.item)"

    def settled(which: str, extra: str) -> str:
        return f"named_struct('item', {which}, 'extra', CAST({extra} AS INT))"

    def state(open_: str, *out: str) -> str:
        return f"named_struct('open', {open_}, 'done', concat(s.done, array({', '.join(out)})))"

    def open_at(unit_: str, x: str) -> str:
        return f"named_struct('weight', {unit_}.weight, 'x', least(1D, greatest(0D, {x})), 'item', {unit_}.item)"

    bounds = (
        "named_struct('up', least(1D - s.open.x, i.weight * i.x / s.open.weight), "
        f"'down', least(s.open.x, i.weight * (1D - i.x) / s.open.weight), 'u', {_uniform('s.open.item', 'i.item')})"
    )
    moved = (
        "IF(t.u * (t.up + t.down) < t.down, "
        "named_struct('by', t.up, 'first', t.up >= 1D - s.open.x, 'value', 1), "
        "named_struct('by', -t.down, 'first', t.down >= s.open.x, 'value', 0))"
    )
    other = "i.x - s.open.weight * m.by / i.weight"
    both = state(f"CAST(NULL AS {unit})", settled("s.open.item", "m.value"), settled("i.item", f"round({other})"))
    first = state(open_at("i", other), settled("s.open.item", "m.value"))
    second = state(open_at("s.open", "s.open.x + m.by"), settled("i.item", "1 - m.value"))
    result = f"CASE WHEN NOT m.first THEN {second} WHEN {other} <= {EPSILON} OR {other} >= 1 - {EPSILON} THEN {both} ELSE {first} END"
    step = f"CASE WHEN s.open IS NULL THEN named_struct('open', {taken}, 'done', s.done) ELSE {_let('t', bounds, _let('m', moved, result))} END"
    return f"aggregate(items, {start}, (s, i) -> {step})"


def _folded(units: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """Fold ``units(weight, x, item)`` of each group, largest first."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("order"), "item", "weight", "x")))
    return units.groupBy(*keys).agg(listed.alias("items")).withColumn("f", F.expr(fold))


def round_copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, chunk: int = CHUNK) -> DataFrame:
    """Decide the copies of ``rows(_id, _no_source, _source, size)``, a stored table.

    One row per unit: its key, ``rows``, ``source_size``, ``target`` and ``copies``.
    """
    id_type = rows.schema["_id"].dataType.simpleString()
    units = store(rows.groupBy(*_SOURCE, "_id", "size").agg(F.count("*").alias("rows")))
    weight = F.col("size") * F.col("rows")
    sources = store(units.groupBy(*_SOURCE).agg(F.sum(weight).alias("source_size"), F.count("*").alias("_units")))
    targets = source_targets(sources, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A rate within rounding error of a whole number is that number.
    whole = F.floor(F.col("_rate") + EPSILON)
    targets = targets.withColumn("_rate", rate).withColumn("_whole", whole.cast("long"))
    targets = store(targets.withColumn("p", F.greatest(F.lit(0.0), F.col("_rate") - F.col("_whole"))).drop("_rate"))

    known = join_facts(units, targets, _SOURCE, "_units").withColumns({
        "weight": weight.cast("double"), "item": F.struct(F.col("_id").alias("id"), "size", "rows"),
    })
    about = [*_SOURCE, "source_size", "target", "_whole"]
    known = store(known)
    is_large = (F.col("weight") > 0) & (F.col("weight") * LARGE_SHARE >= F.col("source_size"))

    large = known.where(is_large).withColumn("x", F.col("p"))
    folded = store(_folded(large, [*about, "p", "_units"], _fold_large(id_type)))
    settled = [folded.select(*about, F.inline("f.done"))]

    # What the large documents left for the others of their source.
    left = folded.select(*_SOURCE, F.col("f.p").alias("_left"), "_units")
    small = known.where(~is_large)
    small = join_facts(small.drop("_units"), store(left), _SOURCE, "_units") if not folded.isEmpty() else small.withColumn("_left", F.col("p"))
    # Read by three queries: stored, so that none of them repeats the joins and their broadcasts.
    small = store(small.withColumn("x", F.coalesce("_left", "p")))
    empty = F.col("weight") == 0
    certain = (F.col("x") <= EPSILON) | (F.col("x") >= 1 - EPSILON)
    chance = F.expr(_uniform("item")) < F.col("x")
    settled.append(small.where(empty | certain).select(*about, "item", F.when(empty, chance.cast("int")).otherwise(F.round("x").cast("int")).alias("extra")))

    open_units = small.where(~empty & ~certain)
    per_source = store(open_units.groupBy(*_SOURCE).agg(F.count("*").alias("_open")))
    most_open = per_source.agg(F.max("_open")).first()[0] or 0
    chunks = F.ceil(F.col("_open") / chunk)
    level = join_facts(open_units.select(*about, "weight", "x", "item"), per_source, _SOURCE, "_open")
    level = level.withColumn("_chunks", chunks).withColumn("_chunk", F.pmod(F.xxhash64("item", F.lit(SEED)), "_chunks"))
    while most_open:
        folded = store(_folded(level, [*about, "_chunks", "_chunk"], _fold_chunk(id_type)))
        settled.append(folded.select(*about, F.inline("f.done")))
        remaining = folded.where("f.open IS NOT NULL").select(*about, "_chunks", "_chunk", "f.open.weight", "f.open.x", "f.open.item")
        most_open = -(-most_open // chunk)
        if most_open == 1:
            settled.append(remaining.select(*about, "item", F.round("x").cast("int").alias("extra")))
            break
        level = remaining.withColumn("_chunks", F.ceil(F.col("_chunks") / chunk)).withColumn("_chunk", F.pmod("_chunk", "_chunks"))
    decided = settled[0]
    for part in settled[1:]:
        decided = decided.unionByName(part)
    return decided.select(
        *_SOURCE, F.col("item.id").alias("_id"), F.col("item.size").alias("size"), F.col("item.rows").alias("rows"),
        "source_size", "target", (F.col("_whole") + F.col("extra")).alias("copies"),
    )


def mix_words(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target`` and ``taken`` words."""
    decided = round_copies(store(sized(docs, id_col, source_col, text_col)))
    return decided.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
        F.explode(F.sequence(F.lit(1), "rows")).alias("_no"),
    ).drop("_no")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, which may be never."""
    decided = round_copies(store(sized(docs, id_col, source_col, text_col)))
    decided = store(decided.where("copies > 0").select(*_SOURCE, F.col("_id").alias("_key"), "size", "copies"))
    keyed = packed(
        docs, _id=F.col(id_col), _none=F.col(source_col).isNull(), _name=F.coalesce(F.col(source_col), F.lit("")),
        _size=F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"),
    )
    same = (
        (keyed["_none"] == decided["_no_source"]) & (keyed["_name"] == decided["_source"])
        & (keyed["_size"] == decided["size"]) & keyed["_id"].eqNullSafe(decided["_key"])
    )
    # The decisions grow with the documents, so they are not broadcast at any size.
    copied = keyed.join(decided.hint("shuffle_hash"), same).withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copied.select("_row.*")
