"""Line dedup by content-defined chunks (DataFrame functions only).

Lines are hashed (28 bits of md5); a polynomial over a rolling window of
``SPAN`` line hashes ends a chunk after the lines where it is 0 modulo
``MEAN_LINES``. Boundaries
depend on the last lines only, so a passage that moves within or between
documents falls into the same chunks once the window is inside it. A chunk of
``MIN_LINES`` lines or more whose text occurs more than once in the corpus
stays where it comes first (smallest doc_id, then position) and goes
elsewhere.

A narrow table of chunk hashes is written first, and repeated hashes are found
on it. Only then are texts cut again, and only chunks whose hash repeats move:
they are grouped by hash *and* text, which is the byte comparison. A common
chunk is reduced by a partial ``min`` before it moves. The joins that mark its
copies have one row a hash on the other side, read from a written table, so
both sides are dealt anew and AQE may split it. Lists of chunks go to the
documents by id and hash of the text. All these tables grow with the corpus,
so the joins are sort-merge joins at any size and none is broadcast.

Chunk edges depend on the line before a passage and the last chunk on the text
after it, so chunks alone miss much of a short repeated passage.
``dedup_lines`` therefore cuts by a second family of boundaries, one after
every line: its chunks are all runs of two neighbouring lines, and those that
hold a word and occur earlier in the corpus (smallest doc_id, then position)
go too. That carries each match of chunks on to the ends of the longest common
run and covers every repeated run of ``MIN_LINES`` lines or more whole,
wherever it lies. Only a SHA-256 of each pair is shuffled, whose equality stands
for that of the bytes. A line that goes has an equal one at an earlier place,
so the first of equal lines always stays. ``dedup_runs`` removes by the second
family alone.

Defined results of both: a null text stays null. A text keeps its other lines in
order; one that loses all lines becomes empty. Rows with a null id lose
nothing and remove nothing. Rows that repeat both id and text share their
decisions (a repeat inside them is removed from the second on); rows that
repeat an id with other texts are documents of their own. Ties in the order go
to the smaller hash of the text. Texts of any length are cut whole. Columns of
any name are kept, helper columns take names that the table doesn't have. Line
ends are ``\\n``; a lone empty text is one empty line. An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, materialize

SPAN = 2
MEAN_LINES = 3
MIN_LINES = 2
BASE, MODULUS = 31, 1_000_003
LINE_HASH = "cast(conv(substr(md5(cast(x as binary)), 1, 7), 16, 10) as bigint)"
#: Blank chunks (no word) are layout, not repeated content.
HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _chunk_ends(lines: str, span: int, mean: int) -> str:
    """SQL array of the index of each chunk's last line."""
    window = " + ".join(f"{BASE ** k}L * coalesce(get(h, i - {k}), 0L)" for k in range(span))
    return (f"transform(array(transform({lines}, x -> {LINE_HASH})), h -> "
            f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 "
            f"or ({window}) % {MODULUS}L % {mean}L = 0L))[0]")


def chunks(docs: DataFrame, id_col: str, text_col: str, span: int = SPAN, mean: int = MEAN_LINES) -> DataFrame:
    """``doc_id, copy`` (hash of the text), ``chunk`` (number), ``n_lines,
    body`` of every chunk."""
    x = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull()) \
            .select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("copy"), F.split(col(text_col), "\n", -1).alias("lines"))
    x = x.select("doc_id", "copy", "lines", F.expr(_chunk_ends("lines", span, mean)).alias("ends"))
    body = f"transform(sequence(0, size(ends) - 1), k -> struct({_size('ends')} as n_lines, {_body('lines', 'ends')} as body))"
    return x.select("doc_id", "copy", F.posexplode(F.expr(body)).alias("chunk", "c")).select("doc_id", "copy", "chunk", "c.n_lines", "c.body")


def _start(ends: str) -> str:
    return f"(coalesce(get({ends}, k - 1), -1) + 1)"


def _size(ends: str) -> str:
    return f"(get({ends}, k) - coalesce(get({ends}, k - 1), -1))"


def _body(lines: str, ends: str) -> str:
    """SQL text of chunk ``k``."""
    return f"array_join(slice({lines}, coalesce(get({ends}, k - 1), -1) + 2, {_size(ends)}), '\\n')"


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                    mean: int = MEAN_LINES, min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, copy, chunk, start`` (its first line)``, n_lines`` of every
    chunk to remove."""
    every = chunks(docs, id_col, text_col, span, mean).where(F.col("n_lines") >= min_lines) \
        .where(F.col("body").rlike(HAS_WORD)) \
        .withColumn("hash", F.xxhash64("body"))
    narrow = materialize(every.select("hash", "doc_id", "copy", "chunk"), "chunks")
    twice = narrow.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("hash2"))
    # written, as ``first`` is: a side that ends in an aggregate on the same hash keeps AQE from splitting the other
    twice = materialize(twice, "repeated")
    wanted = narrow.join(twice.hint("merge"), F.col("hash") == F.col("hash2"), "left_semi").distinct() \
                   .groupBy(F.col("doc_id").alias("_want_id"), F.col("copy").alias("_want_copy")).agg(F.collect_list("chunk").alias("_want"))
    wanted = materialize(wanted, "wanted")
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    texts = texts.join(wanted.hint("merge"), (F.col("doc_id") == F.col("_want_id")) & (F.xxhash64("text") == F.col("_want_copy"))) \
                 .select("doc_id", F.col("_want_copy").alias("copy"), "_want", F.split("text", "\n", -1).alias("lines"))
    texts = texts.withColumn("ends", F.expr(_chunk_ends("lines", span, mean)))
    body = f"transform(_want, k -> struct(k as chunk, {_start('ends')} as start, {_size('ends')} as n_lines, {_body('lines', 'ends')} as body))"
    maybe = texts.select("doc_id", "copy", F.explode(F.expr(body)).alias("c")).select("doc_id", "copy", "c.*").withColumn("hash", F.xxhash64("body"))
    maybe = materialize(maybe, "maybe")
    first = maybe.groupBy("hash", "body").agg(F.min(F.struct("doc_id", "copy", "chunk")).alias("first"), F.count("*").alias("n")) \
                 .where("n > 1").select(F.col("hash").alias("h1"), F.col("body").alias("b1"), "first")
    first = materialize(first, "first")
    return maybe.join(first.hint("merge"), (F.col("hash") == F.col("h1")) & (F.col("body") == F.col("b1"))) \
                .where(F.struct("doc_id", "copy", "chunk") != F.col("first")).select("doc_id", "copy", "chunk", "start", "n_lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                mean: int = MEAN_LINES, min_lines: int = MIN_LINES, removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated chunks and all other repeated runs of two lines
    or more removed from ``text_col``; ``removed_col`` adds the number of lines
    removed."""
    found = repeated_chunks(docs, id_col, text_col, span, mean, min_lines).select("doc_id", "copy", "start", "n_lines")
    pairs = repeated_runs(docs, id_col, text_col).select("doc_id", "copy", F.col("pos").alias("start"), F.lit(MIN_LINES).alias("n_lines"))
    return _without(docs, found.unionAll(pairs), id_col, text_col, removed_col)


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, removed_col: str | None) -> DataFrame:
    """``docs`` without the lines of the runs ``doc_id, copy, start, n_lines``."""
    key, copy, cut = fresh(docs, "cut_id", "cut_copy", "cut_lines")
    # a set, since rows that repeat an id and a text repeat their runs
    gone = gone.distinct().groupBy(F.col("doc_id").alias(key), F.col("copy").alias(copy)) \
               .agg(F.collect_list(F.struct("start", "n_lines")).alias(cut))
    lines_of = "flatten(transform(`{0}`, r -> sequence(r.start, r.start + r.n_lines - 1)))".format(cut)
    gone = materialize(gone.withColumn(cut, F.array_distinct(F.expr(lines_of))), "gone")
    x = docs.join(gone.hint("merge"), (col(id_col) == col(key)) & (F.xxhash64(col(text_col)) == col(copy)), "left")
    lines, = fresh(x, "cut_text_lines")
    x = x.withColumn(lines, F.when(col(cut).isNotNull(), F.split(col(text_col), "\n", -1)))
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size(`{lines}`) - 1), `{cut}`), i -> get(`{lines}`, i)), '\\n')")
    text = F.when(col(cut).isNull(), col(text_col)).otherwise(kept)
    out = [text.alias(c) if c == text_col else col(c) for c in docs.columns]
    return x.select(*out, *([F.coalesce(F.size(cut), F.lit(0)).cast("bigint").alias(removed_col)] if removed_col else []))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, copy`` (hash of the text), ``pos`` of the first of every two
    lines to remove."""
    x = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull()) \
            .select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("copy"), F.split(col(text_col), "\n", -1).alias("lines")) \
            .where("size(lines) > 1")
    pair = "concat(get(lines, i), '\\n', get(lines, i + 1))"
    word = HAS_WORD.replace("\\", "\\\\")
    marks = f"transform(sequence(0, size(lines) - 2), i -> case when {pair} rlike '{word}' then unhex(sha2(cast({pair} as binary), 256)) end)"
    pairs = materialize(x.select("doc_id", "copy", F.posexplode(F.expr(marks)).alias("pos", "mark")).where("mark is not null"), "pairs")
    first = pairs.groupBy(F.col("mark").alias("m1")).agg(F.min(F.struct("doc_id", "copy", "pos")).alias("first"), F.count("*").alias("n")) \
                 .where("n > 1").select("m1", "first")
    # written, as the first copies of chunks are
    first = materialize(first, "first")
    return pairs.join(first.hint("merge"), F.col("mark") == F.col("m1")) \
                .where(F.struct("doc_id", "copy", "pos") != F.col("first")).select("doc_id", "copy", "pos")


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with all repeated runs of two lines or more removed from
    ``text_col``; ``removed_col`` adds the number of lines removed."""
    pairs = repeated_runs(docs, id_col, text_col).select("doc_id", "copy", F.col("pos").alias("start"), F.lit(MIN_LINES).alias("n_lines"))
    return _without(docs, pairs, id_col, text_col, removed_col)
