"""Source divergence audit: how the word use of each source departs from the others of its language.

A pair of sources starts at what all terms would add if neither had any: V
times the distance of the two zero-count shares. An inverted index then corrects
this where a count is not zero: the postings of one source move it against the
other's zero share, all at once through a running sum over its shares; the
postings that two sources have in common are corrected term by term, in blocks
of sources, and leave a task as one sum for each pair.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Steps, arrow_batches, spread, whole_text

#: Documents of its language that a term stands in at least, and terms that a source's report has.
LEAST_DOCS, TOP = 30, 50
#: A share is counted in units of 1 / UNIT, SMOOTH being added to each count.
UNIT, SMOOTH = 1_000_000_000, 5
#: Sources on a side of a block: a task holds one square of sums.
SIDE = 512
#: Counted terms that a task holds before it hands them on, and their bytes.
HELD, HELD_BYTES = 200_000, 16 << 20
#: Bytes of a text that are split at a time, up to the next gap.
PIECE = 1 << 20

#: A-Z to a-z; a-z and bytes of other characters stay; all else parts terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text, in UTF-8."""
    flat, out, at = text.translate(_FOLD), Counter(), 0
    while at < len(flat):
        stop = flat.find(b" ", at + PIECE)
        stop = len(flat) if stop < 0 else stop
        out.update(flat[at:stop].split())
        at = stop
    return out


def _counted(most: int, most_bytes: int):
    """(lang, source, term, n, docs), summed as far as a task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = defaultdict(dict)
        held = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in groups.items():
                names = list(terms)
                for at in range(0, len(names), 10_000):
                    part = names[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[w][0] for w in part], pa.int64()), pa.array([terms[w][1] for w in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = groups[lang, source]
                for w, n in term_counts(text.as_buffer().to_pybytes()).items():
                    if w in own:
                        own[w][0] += n
                        own[w][1] += 1
                    else:
                        own[w] = [n, 1]
                        held, size = held + 1, size + len(w)
                if held >= most or size >= most_bytes:
                    yield from flush()
                    held = size = 0
        yield from flush()

    return run


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), exact; 0 without terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + CAST({UNIT} AS decimal(38,0)) * ({n} + {SMOOTH}) div ({total} + {SMOOTH} * {terms}) ELSE 0L END")


def _common(side: int):
    """(lang, i, j, value): what the terms that sources i and j share add to their pair, for rows in order of lang, block and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, np.zeros((side, side), np.int64)
        tail: pa.Table | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held is None:
                return
            lang, a, b = held
            i, j = np.nonzero(sums)
            value = sums[i, j]
            i, j = i + a * side, j + b * side
            if a == b:
                i, j, value = i[i != j], j[i != j], value[i != j]
            else:
                i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
            for at in range(0, len(i), 10_000):
                s = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i[s]), pa.string()), pa.array(i[s].astype(np.int32)), pa.array(j[s].astype(np.int32)), pa.array(value[s])], names=["lang", "i", "j", "value"])
            sums[:] = 0

        def add(rows: pa.Table) -> None:
            """All postings of some terms of one language and block."""
            _, a, b = held
            i, p, z = (rows[c].to_numpy() for c in ("i", "p", "z"))
            codes = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for s, e in zip(cuts, cuts[1:]):
                left = s + np.flatnonzero(i[s:e] // side == a)
                right = left if a == b else s + np.flatnonzero(i[s:e] // side == b)
                x, y, u, v = p[left, None], p[right], z[left, None], z[right]
                sums[np.ix_(i[left] % side, i[right] % side)] += np.abs(x - y) - np.abs(x - v) - np.abs(u - y) + np.abs(u - v)

        def parts(rows: pa.Table) -> Iterator[tuple[tuple, pa.Table]]:
            keys = [rows[c].combine_chunks() for c in ("lang", "a", "b")]
            change = np.zeros(len(rows), bool)
            for k in keys:
                codes = k.dictionary_encode().indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(rows)]
            for s, e in zip(cuts, cuts[1:]):
                yield (keys[0][s].as_py(), keys[1][s].as_py(), keys[2][s].as_py()), rows.slice(s, e - s)

        def whole_terms(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
            """Rows up to the last term, which may go on, and that term's."""
            same = np.ones(len(rows), bool)
            for c in ("lang", "a", "b", "term"):
                codes = rows[c].combine_chunks().dictionary_encode().indices.to_numpy()
                same &= codes == codes[-1]
            first = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            return rows.slice(0, first), rows.slice(first)

        def take(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for key, part in parts(rows):
                if key != held:
                    yield from flush()
                    held = key
                add(part)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if tail is None else pa.concat_tables([tail, rows])
            if len(rows):
                done, tail = whole_terms(rows)
                if len(done):
                    yield from take(done)
        if tail is not None and len(tail):
            yield from take(tail)
        yield from flush()

    return run


def divergence(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of letters A-Z, in either case, and of characters beyond
    ASCII; each language keeps the V terms that stand in at least ``least_docs``
    of its documents. A source's share of a term is 1 + floor(10^9 (count + 5) /
    (N + 5 V)), N being its occurrences of all kept terms, zero counts included.
    Part ``pair``: for every other source of the language, the distances of the
    two shares summed over all kept terms. Part ``term``: the terms that the
    source has and whose share is above the language's, by how much, up to
    ``top``. rank counts from 1 in each source and part, by value descending,
    then by item in order of code points.

    Null text, language and source are empty. Repeated rows are separate
    documents. A source without terms is paired as any other; a language without
    kept terms has distances of 0; a language of one source has no pairs. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    steps = Steps(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), whole_text(text_col).alias("text"))
    counted = spread(named).mapInArrow(_counted(HELD, HELD_BYTES), "lang string, source string, term string, n bigint, docs bigint")
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("lang_docs", F.sum("docs").over(per_term)).filter(F.col("lang_docs") >= least_docs)
    kept = kept.withColumn("lang_n", F.sum("n").over(per_term)).withColumn("once", F.row_number().over(per_term.orderBy("source")) == 1)
    kept = steps.cut(kept.select("lang", "source", "term", "n", "lang_n", "once"), "kept-terms")

    langs = kept.filter("once").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")])
    # Numbered within a language; the report has a row for each pair of them anyway.
    numbered = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    groups = steps.cut(numbered.withColumn("z", share("0", "total", "v")), "groups")

    postings = kept.join(groups.select("lang", "source", "i", "total", "v", "z", "lang_total", "sources"), ["lang", "source"])
    postings = steps.cut(
        postings.select("lang", "source", "term", "i", "z", "sources", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q")), "postings"
    )
    ordered = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    terms = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ordered("item"))).filter(F.col("rank") <= top)

    # What a source's postings add against any zero share: shares and asked zero shares in one order, with running sums.
    other = groups.select("lang", F.col("i").alias("j"), F.col("z").alias("at"))
    pairs = groups.select("lang", "i", "z", "v").join(other, "lang").filter("i != j")
    none = lambda kind: F.lit(None).cast(kind)
    asked = pairs.select("lang", "i", "at", F.lit(1).alias("asks"), "j", "z", "v", zero.alias("m"), zero.alias("mp"))
    had = postings.groupBy("lang", "i", F.col("p").alias("at")).agg(F.count("*").alias("m"))
    had = had.select("lang", "i", "at", F.lit(0).alias("asks"), none("int").alias("j"), none("bigint").alias("z"), none("bigint").alias("v"), "m", (F.col("m") * F.col("at")).alias("mp"))
    line = Window.partitionBy("lang", "i")
    up_to = line.orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = asked.unionByName(had)
    for name, w in (("below", up_to), ("all", line)):
        sums = sums.withColumn(f"{name}_m", F.sum("m").over(w)).withColumn(f"{name}_mp", F.sum("mp").over(w))
    apart = F.expr("at * below_m - below_mp + (all_mp - below_mp) - at * (all_m - below_m)")
    gap = F.abs(F.col("z") - F.col("at"))
    one_sided = sums.filter("asks = 1").select("lang", "i", "j", (F.col("v") * gap).alias("start"), (apart - F.col("all_m") * gap).alias("value"))
    both_ways = one_sided.select("lang", F.explode(F.array(F.struct("i", "j", (F.col("start") + F.col("value")).alias("value")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value"))).alias("x")).select("lang", "x.*")

    block = F.expr(f"i div {SIDE}").cast("int")
    tiled = postings.select("lang", "term", "i", "p", "z", block.alias("own"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((sources - 1) div {SIDE} as int)"))).alias("beside"))
    tiled = tiled.select("lang", F.least("own", "beside").alias("a"), F.greatest("own", "beside").alias("b"), "term", "i", "p", "z")
    common = tiled.repartition("lang", "a", "b", "term").sortWithinPartitions("lang", "a", "b", "term").mapInArrow(_common(SIDE), "lang string, i int, j int, value bigint")

    value = both_ways.unionByName(common).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "i", "source")
    pair = value.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ordered("item")))
    return steps.end(pair.unionByName(terms), "divergence")
