"""Lines that one site repeats over many of its volumes (problem 2).

Method: distributed PrefixSpan. Each text is a sequence of line identifiers (128-bit digests of the
line with case, digits, spacing, punctuation and look-alikes set aside). Level 1 counts, per site, the
volumes each line is found in; the frequent lines' positions form the projected database. Longer
sequences are grown from it: a prefix is extended by the frequent sequence that begins where it ends,
as long again at first and then by halves, so the longest frequent sequence from every place takes two
rounds for each doubling of its length, however many sub-sequences it has. Sequences are of lines that
follow each other, blank and short ones between them not counted. Suffixes are only pointed at, never
copied, and a place is one row at every level, so nothing grows from level to level. Support is the
number of distinct volumes.

A line of a frequent sequence is frequent itself, so the lines to delete are known after level 1;
repeated_sequences() tells in which sequences they stand.

All counts are pre-aggregated before the shuffle and keyed by site *and* line (and volume), so a site
that holds a third of the rows is spread over all tasks.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.llm.canonical import canonical
from vellumetry.session import stored

#: Lines with fewer letters don't count.
MIN_LETTERS = 12
#: A line is repeated excessively from this many volumes and this share of its site's volumes on.
MIN_VOLUMES, MIN_SHARE = 4, 0.2


class _Letters(dict):
    """For str.translate: letters and their marks in lower case, line ends as they are, all else deleted; filled as characters are met."""

    def __missing__(self, o: int) -> int | str | None:
        c = chr(o)
        self[o] = out = o if c == "\n" else c.casefold() if ud.category(c)[0] in "LM" else None
        return out


_letters = _Letters()


def line_keys(text: str, min_letters: int = MIN_LETTERS) -> list[str | None]:
    """What lines must have in common to be the same, for each line of a text; None for one of too few letters."""
    keys = canonical(text.replace("\r", " ")).translate(_letters).split("\n")
    return [k if len(k) >= min_letters and (k.isalpha() or sum(map(str.isalpha, k)) >= min_letters) else None for k in keys]


def line_items(texts: DataFrame, id_col: str, text_col: str, source_col: str, unit_col: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(doc, source, unit, line_no, item): one row for each line that counts. Null texts, sources and units give none."""
    picked = texts.where(f"`{text_col}` is not null and `{source_col}` is not null and `{unit_col}` is not null").select(
        F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), F.col(unit_col).cast("string").alias("unit"), F.col(text_col).alias("text")
    )
    kind = dict(picked.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, keys = [], [], []
            for r, text in enumerate(batch.column(3).to_pylist()):
                for n, key in enumerate(line_keys(text, min_letters)):
                    if key is not None:
                        rows.append(r)
                        numbers.append(n)
                        keys.append(key)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in range(3)), pa.array(numbers, pa.int64()), pa.array(keys, pa.string())],
                names=["doc", "source", "unit", "line_no", "key"],
            )

    lines = picked.mapInArrow(run, f"doc {kind}, source string, unit string, line_no bigint, key string")
    return lines.select("doc", "source", "unit", "line_no", F.struct(F.xxhash64(F.lit(1), "key").alias("x"), F.xxhash64(F.lit(2), "key").alias("y")).alias("item"))


def _frequent(found: DataFrame, by: str, least: DataFrame, floor: int) -> DataFrame:
    """Support of each (source, by) in distinct units, where it reaches the source's threshold, which is floor at least.

    What is below floor, nearly everything, is gone before the join on source, so a large source isn't gathered there.
    """
    support = found.select("source", by, "unit").distinct().groupBy("source", by).agg(F.count("*").alias("support"))
    return support.where(F.col("support") >= floor).join(least, "source").where("support >= least").select("source", by, "support")


def frequent_lines(items: DataFrame, least: DataFrame, floor: int = 1) -> tuple[DataFrame, DataFrame]:
    """PrefixSpan's level 1: (source, item, support) of the frequent items, and the projected database, the rows of items they are in.

    items: (doc, source, unit, line_no, item); least: (source, least), the support each source asks for.
    """
    singles = stored(_frequent(items, "item", least, floor), "p2-level1")
    return singles, stored(items.join(singles.select("source", "item"), ["source", "item"], "left_semi"), "p2-projected")


def frequent_sequences(items: DataFrame, singles: DataFrame, base: DataFrame, least: DataFrame, floor: int = 1) -> DataFrame:
    """(source, doc, unit, from_line, to_line, length, pattern, support): the longest frequent sequence from each place it isn't a part of a longer one.

    items: all lines that count; singles and base: level 1, see frequent_lines(). pattern is the
    sequence's digest. Rows that are in items twice (same doc and line) count once.
    """
    order = Window.partitionBy("doc").orderBy("line_no")  # one text's lines
    numbered = items.select("doc", "line_no").distinct().withColumn("n", F.row_number().over(order))
    first = base.select("doc", "line_no", "source", "unit", "item").distinct().join(singles, ["source", "item"]).join(numbered, ["doc", "line_no"])
    first = first.select("doc", "n", "line_no", "source", "unit", F.col("item").alias("pattern"), "support")
    levels = [stored(first, "p2-sequences1")]

    def grown(prefixes: DataFrame, by: DataFrame, name: str) -> DataFrame:
        """(doc, n, next, sup): prefixes, made longer by the sequences of by, where the sum of both is frequent."""
        follow = by.select(F.col("doc").alias("_doc"), F.col("n").alias("_at"), F.col("pattern").alias("_more"))
        digest = F.struct(F.xxhash64(F.lit(1), "pattern", "_more").alias("x"), F.xxhash64(F.lit(2), "pattern", "_more").alias("y"))
        met = prefixes.join(follow, (F.col("doc") == F.col("_doc")) & (F.col("n") + F.col("length") == F.col("_at")))
        sums = stored(met.select("doc", "n", "source", "unit", digest.alias("next")), f"p2-sums{name}")
        return sums.join(_frequent(sums, "next", least, floor), ["source", "next"]).select("doc", "n", "next", F.col("support").alias("sup"))

    # upward: sequences of 2, 4, 8 lines
    length = 1
    while True:
        last = levels[-1].withColumn("length", F.lit(length))
        found = grown(last, last, f"-up{length}")
        longer = last.join(found, ["doc", "n"]).select("doc", "n", "line_no", "source", "unit", F.col("next").alias("pattern"), F.col("sup").alias("support"))
        longer = stored(longer, f"p2-sequences{2 * length}")
        if longer.isEmpty():
            break
        levels.append(longer)
        length *= 2
    # downward: from the longest of these at each place on, by halves; so a sequence has one digest, whatever it is grown from
    best = levels[0].withColumn("length", F.lit(1))
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if k:
            start = levels[k].select("doc", "n", F.col("pattern").alias("next"), F.col("support").alias("sup"))
            take = (F.col("length") == 1) & F.col("next").isNotNull()
            best = best.join(start, ["doc", "n"], "left").select(
                "doc", "n", "line_no", "source", "unit", *(F.when(take, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in (("pattern", "next"), ("support", "sup"))), F.when(take, step).otherwise(F.col("length")).alias("length")
            )
        more = grown(best.where(F.col("length") > step), levels[k], f"-down{step}")
        best = best.join(more, ["doc", "n"], "left").select(
            "doc", "n", "line_no", "source", "unit", F.coalesce("next", "pattern").alias("pattern"), F.coalesce("sup", "support").alias("support"), F.when(F.col("next").isNotNull(), F.col("length") + step).otherwise(F.col("length")).alias("length")
        )
        best = stored(best, f"p2-best{step}")
    reach = F.max(F.col("n") + F.col("length")).over(Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    whole = best.withColumn("_reach", reach).where("_reach is null or n + length > _reach").withColumn("_last", F.col("n") + F.col("length") - 1)
    last_line = numbered.select("doc", F.col("n").alias("_last"), F.col("line_no").alias("to_line"))
    return whole.join(last_line, ["doc", "_last"]).select("source", "doc", "unit", F.col("line_no").alias("from_line"), "to_line", "length", "pattern", "support")


def thresholds(volumes: DataFrame, source_col: str, unit_col: str, min_volumes: int, min_share: float) -> DataFrame:
    """(source, least): the support each source asks for, by all units it has."""
    units = volumes.select(F.col(source_col).cast("string").alias("source"), F.col(unit_col).alias("unit")).where("source is not null and unit is not null").distinct()
    sized = units.groupBy("source").agg(F.count("*").alias("n"))
    return sized.select("source", F.greatest(F.lit(min_volumes).cast("double"), F.col("n") * F.lit(min_share) - 1e-9).alias("least"))


def repeated_sequences(
    texts: DataFrame,
    volumes: DataFrame,
    id_col: str = "result_id",
    text_col: str = "text",
    source_col: str = "site_id",
    unit_col: str = "volume_id",
    min_volumes: int = MIN_VOLUMES,
    min_share: float = MIN_SHARE,
    min_letters: int = MIN_LETTERS,
) -> DataFrame:
    """Each occurrence of a sequence of lines repeated excessively: ({id_col}, from_line, to_line, n_lines, sequence, support).

    The longest from each place, single lines included; sequence is a name for it within its site,
    support the volumes it is found in. Every line of repeated_lines() is in one of them.
    """
    least = thresholds(volumes, source_col, unit_col, min_volumes, min_share)
    items = stored(line_items(texts, id_col, text_col, source_col, unit_col, min_letters), "p2-items")
    singles, base = frequent_lines(items, least, min_volumes)
    kept = items.join(base.select("doc").distinct(), "doc", "left_semi")  # texts without a frequent line have no sequence
    found = frequent_sequences(kept, singles, base, least, min_volumes)
    name = F.concat(F.hex("pattern.x"), F.hex("pattern.y"))
    return found.select(F.col("doc").alias(id_col), "from_line", "to_line", F.col("length").cast("bigint").alias("n_lines"), name.alias("sequence"), "support").distinct()


def repeated_lines(
    texts: DataFrame,
    volumes: DataFrame,
    id_col: str = "result_id",
    text_col: str = "text",
    source_col: str = "site_id",
    unit_col: str = "volume_id",
    min_volumes: int = MIN_VOLUMES,
    min_share: float = MIN_SHARE,
    min_letters: int = MIN_LETTERS,
) -> DataFrame:
    """Each occurrence of a line repeated excessively: ({id_col}, line_no), distinct.

    volumes has a row for each (source, unit) there is, with or without texts; the share is of these.
    Lines count from 0, blank ones too. Empty inputs give an empty result.
    """
    least = thresholds(volumes, source_col, unit_col, min_volumes, min_share)
    items = stored(line_items(texts, id_col, text_col, source_col, unit_col, min_letters), "p2-items")
    _, base = frequent_lines(items, least, min_volumes)
    return base.select(F.col("doc").alias(id_col), "line_no").distinct()


def without_lines(texts: DataFrame, found: DataFrame, id_col: str = "result_id", text_col: str = "text") -> DataFrame:
    """texts with the found (id, line_no) lines taken out; texts without any, null ones too, stay as they are."""
    drop = found.groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("line_no").alias("_drop"))  # bounded by a text's lines
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, n: ~F.array_contains("_drop", n.cast("bigint"))), "\n")
    joined = texts.join(drop, F.col(id_col) == F.col("_id"), "left")
    return joined.withColumn(text_col, F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(kept)).drop("_id", "_drop")
