"""Spelling variants by a relational trie frontier.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. All words are one trie, held as a table of edges (node, label,
child); a node is the hash of its prefix. A state (word, node) says that the
word begins with the node's prefix. All states of a level are joined with the
edges of that level: an edge's label is read as it is, or it tells of one edit
there: the word has one code point too many, or another one in its place.

A pair is searched from one of its words only, the longer one or, of equally
long ones, that with the greater code point where they differ; it is turned
round at the end. So nothing is ever put into a word, which would follow every
edge of a node.

Only half of a word is ever searched. If the edit lies in its second half, the
first half is shared and the search starts at that prefix's node; if not, the
same holds of the reversed words, which are a second trie in the same tables.
Words in the middle of which thousands of others branch are thus never walked
from the root.

After an edit the rest of the word must follow as it is, so the neighbour is
known as a whole, and is looked up among the words. Every edge carries a
sketch (a bit each) of the rests of the words beyond it, and neighbours whose
rest isn't in it are not looked up; nor are states kept once no other word lies
beyond.

Labels are single code points up to depth ``SINGLE`` and grow by half from
there, so the number of levels grows with the logarithm of the longest word.
Where two node hashes coincide, states are added and none is lost (an edge is
told apart by 128 bits, those of both its ends), and neighbours are looked up
whole.

Defined results: null texts have no words, a null id counts as empty text in
the rule that deletes code points. Repeated rows and ids count as often as
they come. Ties among forms go to the smallest word in code-point order. Words
of any length take part. Other columns have no influence, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize

MIN_POINTS, MIN_COUNT, RATIO = 7, 2, 10
#: One in so many runs (by hash) loses a code point.
DELETE_MOD = 31
SINGLE, LONGEST = 32, 1 << 31
#: 64-bit words of an edge's sketch.
SKETCH = 4
#: Distinct words a worker holds before it passes them on.
HELD = 500_000

#: Words are in Latin-1 throughout: one byte per code point, others become "?".
_RUN = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % MIN_POINTS)


def variants(doc_id: int | None, text: str) -> Counter:
    """Occurrences of a document's words (Latin-1) after the deletions."""
    out: Counter = Counter()
    head = b"%s:" % str("" if doc_id is None else doc_id).encode()
    # a run of another case has the same lower-case form, so its hash is taken once
    for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(head + (run if run.isascii() else run.decode("latin-1").encode()))
        if h % DELETE_MOD == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_POINTS:
                continue
        out[run] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        keys = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.update(variants(doc_id, text))
        if len(held) > HELD:
            yield flush()
            held.clear()
    yield flush()


def words(docs: DataFrame, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``."""
    x = docs.where(col(text_col).isNotNull()).select(col(id_col), col(text_col)).mapInArrow(_count, "word string, n bigint")
    return x.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def depths(single: int = SINGLE) -> list[int]:
    """Depths of the trie's levels."""
    out = list(range(single + 1))
    while out[-1] < LONGEST:
        out.append(out[-1] * 3 // 2 + 1)
    return out


def _node(prefix: str) -> str:
    return f"xxhash64(back, {prefix})"


def _slot(rest: str) -> str:
    """SQL: the bit of a rest in the sketches."""
    return f"cast(xxhash64({rest}) & {64 * SKETCH - 1}L as int)"


def _beyond(slot: str) -> str:
    """SQL: an edge's sketch has the bit."""
    part = " ".join(f"when {i} then s{i}" for i in range(SKETCH))
    return f"(case shiftright({slot}, 6) {part} end & shiftleft(1L, {slot} & 63)) <> 0L"


#: SQL: where the searches of a word start, in its middle; at least two points
#: are left.
_START = "greatest(0, least(length(word) div 2, length(word) - 2))"


def _level_at(points: str, single: int) -> str:
    """SQL: number of the last level at or above so many points."""
    longer = f"size(filter(array({', '.join(f'{d}L' for d in depths(single))}), d -> d <= {points})) - 1"
    return f"if({points} <= {single}, {points}, {longer})"


def both_ways(w: DataFrame) -> DataFrame:
    """``word, back``: every word as it is and reversed."""
    ways = F.array(F.struct(F.col("word"), F.lit(False).alias("back")), F.struct(F.reverse("word").alias("word"), F.lit(True).alias("back")))
    return w.select(F.explode(ways).alias("x")).select("x.word", "x.back")


def edges(w: DataFrame, single: int = SINGLE) -> DataFrame:
    """``level, node, label, child, beneath`` (words beyond the edge) and their
    rests' sketch of both tries, from the levels on that a search by a word of
    as many code points starts at (one of more never starts above)."""
    levels = depths(single)
    starts = f"array({', '.join(f'{d}L' for d in levels)})"
    x = both_ways(w).withColumn("len", F.length("word"))
    x = x.withColumn("level", F.explode(F.expr(f"sequence({_level_at(_START, single)}, {_level_at('(length(word) - 1)', single)})")))
    x = x.withColumn("lo", F.expr(f"cast({starts}[level] as int)")).withColumn("hi", F.expr(f"cast(least({starts}[level + 1], len) as int)"))
    x = x.select("level", F.expr(_node("substring(word, 1, lo)")).alias("node"), F.expr("substring(word, lo + 1, hi - lo)").alias("label"),
                 F.expr(_node("substring(word, 1, hi)")).alias("child"), F.expr(_slot("substring(word, hi + 1)")).alias("slot"))
    # numbers only, so that rows are added up by hash and not sorted
    bits = [F.bit_or(F.expr(f"if(shiftright(slot, 6) = {i}, shiftleft(1L, slot & 63), 0L)")).alias(f"s{i}") for i in range(SKETCH)]
    return x.groupBy("level", "node", "label", "child").agg(F.count("*").alias("beneath"), *bits)


#: Moves over a label of one code point at ``{pos}``: read it (no neighbour),
#: another in its place, one too many before it, one too many at the word's end
#: after it. What a state knows of its word is taken before the join, so a pair
#: of state and edge costs a few comparisons.
_KNOWN = {"len": "length(word)", "c1": "ascii(substring(word, {pos} + 1, 1))", "c2": "ascii(substring(word, {pos} + 2, 1))",
          "q1": _slot("substring(word, {pos} + 2)"), "q2": _slot("substring(word, {pos} + 3)"), "q3": _slot("''")}
_READ = "c1 = code and beneath > 1"
_OTHER = f"c1 > code and {_beyond('q1')}"
_SKIP = f"c2 = code and {_beyond('q2')}"
_LAST = f"c1 = code and len = {{pos}} + 2 and {_beyond('q3')}"
_ANY = f"({_READ}) or ({_OTHER}) or ({_SKIP}) or ({_LAST})"
_MOVES = f"""filter(array(
  if({_READ}, named_struct('near', cast(null as string)), null),
  if({_OTHER}, named_struct('near', concat(substring(word, 1, {{pos}}), label, substring(word, {{pos}} + 2))), null),
  if({_SKIP}, named_struct('near', concat(substring(word, 1, {{pos}}), substring(word, {{pos}} + 2))), null),
  if({_LAST}, named_struct('near', substring(word, 1, {{pos}} + 1)), null)), s -> s is not null)"""
#: The same over a longer label of ``m`` points, the edit anywhere in it.
_EDITED = ("{pos} + {n} <= len and {less} levenshtein(substring(word, {pos} + 1, {n}), label, 1) = 1 and "
           + _beyond(_slot("substring(word, {pos} + {n} + 1)")))
_NEAR = "named_struct('near', concat(substring(word, 1, {pos}), label, substring(word, {pos} + {n} + 1)))"
_LONG_MOVES = f"""filter(array(
  if(m = {{points}} and beneath > 1 and substring(word, {{pos}} + 1, m) = label, named_struct('near', cast(null as string)), null),
  if({_EDITED.replace('{n}', 'm').replace('{less}', 'label < substring(word, {pos} + 1, m) and')}, {_NEAR.replace('{n}', 'm')}, null),
  if({_EDITED.replace('{n}', '(m + 1)').replace('{less}', '')}, {_NEAR.replace('{n}', '(m + 1)')}, null)),
  s -> s is not null)"""


def _step(states: DataFrame, edge: DataFrame, pos: int, points: int) -> DataFrame:
    """Moves of all states, which stand at ``pos``, over the edges at their
    nodes; labels have at most so many code points. ``near`` is what an edit
    would make of the word; where there was none, ``node`` is the next."""
    edge = edge.withColumnRenamed("node", "at")
    if points == 1:
        known = states.select("*", *[F.expr(e.replace("{pos}", str(pos))).alias(c) for c, e in _KNOWN.items()])
        x = known.join(edge.withColumn("code", F.ascii("label")), (F.col("node") == F.col("at")) & F.expr(_ANY.replace("{pos}", str(pos))))
        moves = _MOVES
    else:
        x = states.join(edge, F.col("node") == F.col("at")).withColumn("m", F.length("label")).withColumn("len", F.length("word"))
        moves = _LONG_MOVES.replace("{points}", str(points))
    x = x.withColumn("s", F.explode(F.expr(moves.replace("{pos}", str(pos)))))
    return x.select("word", "back", F.when(F.col("s.near").isNull(), F.col("child")).alias("node"), F.col("s.near").alias("near"))


def near_pairs(w: DataFrame, single: int = SINGLE) -> DataFrame:
    """``word, near`` for every ordered pair of near words of ``w``."""
    levels = depths(single)
    # in the order of levels, so that a level's step reads its own rows only
    way = materialize(both_ways(w).withColumn("level", F.expr(_level_at(_START, single))).sortWithinPartitions("level"), "ways")
    edge = materialize(edges(w, single).sortWithinPartitions("level"), "edges")
    last = edge.agg(F.max("level").alias("k")).first()["k"]
    found, frontier = [], None
    for k in range(-1 if last is None else last + 1):
        start = way.where(F.col("level") == k).select("word", "back", F.expr(_node(f"substring(word, 1, {levels[k]})")).alias("node"))
        states = start if frontier is None else frontier.unionAll(start)
        step = materialize(_step(states, edge.where(F.col("level") == k).drop("level"), levels[k], levels[k + 1] - levels[k]), "frontier")
        found.append(step.where("near is not null").select("word", "back", "near"))
        frontier = step.where("near is null").select("word", "back", "node")
    if not found:
        return w.select("word", F.col("word").alias("near")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    turn = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    pairs = out.select(turn("word"), turn("near")).join(w.select(F.col("word").alias("near")), "near", "left_semi").distinct()
    ways = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    return pairs.select(F.explode(ways).alias("x")).select("x.word", "x.near")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms lead from each word that has one. A
    form's count is ``RATIO`` times its word's at least, so there are no
    rings; paths are followed by doubling."""
    x = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        hop = x.select(F.col("word").alias("via"), F.col("root").alias("next"))
        x = materialize(x.join(hop, F.col("root") == F.col("via"), "left")
                        .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if x.where("moved").isEmpty():
            return x.select("word", "root")
        x = x.select("word", "root")


def group_variants(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, single: int = SINGLE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n``."""
    w = materialize(words(docs, min_count, id_col, text_col), "words")
    pairs = near_pairs(w, single).join(w.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("form")))
    # a word has few neighbours (its points times the letters), so one row a word comes of partial sums
    x = w.join(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "word", "left")
    takes = -F.col("best.neg") >= F.col("n") * ratio
    x = materialize(x.select("word", F.when(takes, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                             F.when(takes, -F.col("best.neg")).alias("form_n")), "forms")
    up = roots(x.where("form is not null"))
    return x.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
