"""The expected layout of a volume, learned from its confirmed pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.operators.model import TEMPLATE, Template

BOX = ("x", "y", "w", "h")


def slotted(regions: DataFrame) -> DataFrame:
    """Adds k: the rank by y, from 0, among a page's regions of one type; regions of unknown type are left out."""
    order = Window.partitionBy("page_id", "rtype").orderBy("y", "slot")
    return regions.where(F.col("rtype") != "unknown").withColumn("k", (F.row_number().over(order) - 1).cast("bigint"))


def variance(column: str, n: Column, p: Template = TEMPLATE) -> Column:
    return F.when(n < 2, F.lit(p.variance_of_one)).otherwise(F.var_samp(column))


def slot_confidence(n: Column, std_x: Column, std_y: Column, p: Template = TEMPLATE) -> Column:
    return F.when(n < p.needed, 0.0).otherwise(F.greatest(F.lit(p.least), F.least(F.lit(p.base), p.base - p.slope * (std_x + std_y))))


def slots(regions: DataFrame, by: tuple[str, ...] = ("volume_id",), p: Template = TEMPLATE) -> DataFrame:
    """(by, rtype, k, n, mean_*, var_*, confidence) of each slot. regions: by, page_id, slot, rtype, x, y, w, h.

    Aggregates are partial before the shuffle, so a volume of any size costs a row per slot and task.
    """
    n = F.count("*")
    found = slotted(regions).groupBy(*by, "rtype", "k").agg(
        n.alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in BOX), *(variance(c, n, p).alias(f"var_{c}") for c in BOX)
    )
    return found.withColumn("confidence", slot_confidence(F.col("n"), F.sqrt("var_x"), F.sqrt("var_y"), p))


def samples(regions: DataFrame, by: tuple[str, ...] = ("volume_id",), p: Template = TEMPLATE) -> DataFrame:
    """(by, n_samples, active, needed): pages learned from, counted up to a limit; pages of nothing but unknown regions count too."""
    counted = regions.groupBy(*by).agg(F.least(F.countDistinct("page_id"), F.lit(p.counted)).alias("n_samples"))
    return counted.withColumn("active", F.col("n_samples") >= p.needed).withColumn("needed", F.greatest(F.lit(0).cast("bigint"), p.needed - F.col("n_samples")))


def predicted(found: DataFrame, counted: DataFrame, by: tuple[str, ...] = ("volume_id",), p: Template = TEMPLATE) -> DataFrame:
    """(by, rtype, k, x, y, w, h, confidence, source) of the slots seen often enough in active volumes."""
    ready = found.where(F.col("n") >= p.needed).join(counted.where("active").select(*by), list(by), "left_semi")
    return ready.select(*by, "rtype", "k", *(F.col(f"mean_{c}").alias(c) for c in BOX), "confidence", F.lit("template").alias("source"))


def summary(found: DataFrame, counted: DataFrame, by: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """counted with slots, a map from type to its number of slots."""
    types = found.groupBy(*by, "rtype").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rtype", "n")))).alias("slots"))
    return counted.join(types, list(by), "left")


_XYWH = "struct<x:double,y:double,w:double,h:double>"
#: A saved template (fixed names): each type's slots in order.
DOCUMENT = f"volume_id string, n_samples int, stats map<string,array<struct<n:bigint,mean:{_XYWH},std:{_XYWH},confidence:double>>>"


def documents(found: DataFrame, counted: DataFrame, by: str = "volume_id") -> DataFrame:
    """(by, template): each volume's template as JSON; a volume's slots are few. Volumes without a slot have an empty one."""
    box = lambda f: F.struct(*(f(c).alias(c) for c in BOX))
    slot = F.struct("k", F.struct("n", box(lambda c: F.col(f"mean_{c}")).alias("mean"), box(lambda c: F.sqrt(f"var_{c}")).alias("std"), "confidence").alias("s"))
    types = found.groupBy(by, "rtype").agg(F.transform(F.array_sort(F.collect_list(slot)), lambda x: x.s).alias("slots"))
    stats = types.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rtype", "slots"))).alias("stats"))
    whole = counted.select(by, "n_samples").join(stats, by, "left").withColumn("stats", F.coalesce("stats", F.from_json(F.lit("{}"), DOCUMENT.split("stats ")[1])))
    return whole.select(by, F.to_json(F.struct(F.col(by).cast("string").alias("volume_id"), F.col("n_samples").cast("int").alias("n_samples"), "stats")).alias("template"))


def from_documents(saved: DataFrame, p: Template = TEMPLATE) -> tuple[DataFrame, DataFrame]:
    """(slots, samples) from documents(): deviations become variances again, exact from two pages on. JSON that can't be read gives nothing."""
    read = saved.select(F.from_json("template", DOCUMENT).alias("t")).where("t.volume_id is not null").select("t.*")
    samples_ = read.select("volume_id", "n_samples", (F.col("n_samples") >= p.needed).alias("active"), F.greatest(F.lit(0), p.needed - F.col("n_samples")).alias("needed"))
    each = read.select("volume_id", F.explode("stats").alias("rtype", "slots")).select("volume_id", "rtype", F.posexplode("slots").alias("k", "s"))
    deviation = lambda c: F.when(F.col("s.n") < 2, p.variance_of_one).otherwise(F.col(f"s.std.{c}") * F.col(f"s.std.{c}"))
    found = each.select("volume_id", "rtype", F.col("k").cast("bigint").alias("k"), F.col("s.n").alias("n"), *(F.col(f"s.mean.{c}").alias(f"mean_{c}") for c in BOX), *(deviation(c).alias(f"var_{c}") for c in BOX))
    return found.withColumn("confidence", slot_confidence(F.col("n"), F.sqrt("var_x"), F.sqrt("var_y"), p)), samples_


class Running:
    """The same statistics kept page by page (Welford), for streams: n, means and sums of squared deviations of a slot."""

    def __init__(self, n: int = 0, mean: list[float] | None = None, m2: list[float] | None = None):
        self.n, self.mean, self.m2 = n, mean or [0.0] * 4, m2 or [0.0] * 4

    def add(self, values: list[float]) -> None:
        self.n += 1
        for i, v in enumerate(values):
            before = v - self.mean[i]
            self.mean[i] += before / self.n
            self.m2[i] += before * (v - self.mean[i])

    def merge(self, other: Running) -> Running:
        """Statistics of both sets of pages, exact whatever the order."""
        n = self.n + other.n
        if not n:
            return Running()
        step = [b - a for a, b in zip(self.mean, other.mean, strict=True)]
        mean = [a + d * other.n / n for a, d in zip(self.mean, step, strict=True)]
        m2 = [a + b + d * d * self.n * other.n / n for a, b, d in zip(self.m2, other.m2, step, strict=True)]
        return Running(n, mean, m2)

    def variance(self, p: Template = TEMPLATE) -> list[float]:
        return [p.variance_of_one if self.n < 2 else m / (self.n - 1) for m in self.m2]

    def confidence(self, p: Template = TEMPLATE) -> float:
        if self.n < p.needed:
            return 0.0
        vx, vy, *_ = self.variance(p)
        return max(p.least, min(p.base, p.base - p.slope * (math.sqrt(vx) + math.sqrt(vy))))

    @classmethod
    def restored(cls, n: int, mean: list[float], std: list[float]) -> Running:
        """From stored means and deviations; exact from two pages on."""
        return cls(n, list(mean), [s * s * max(1, n - 1) for s in std])
