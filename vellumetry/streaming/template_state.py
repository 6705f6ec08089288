"""Layout statistics kept up to date by a stream of confirmed pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumetry.operators.model import TEMPLATE, Template
from vellumetry.operators.template import BOX, Running

OUTPUT = "volume_id string, rtype string, k bigint, n bigint, " + ", ".join(f"mean_{c} double" for c in BOX) + ", confidence double"
_STATE = "n bigint, mean array<double>, m2 array<double>"


def update_slots(slotted: DataFrame) -> DataFrame:
    """A streaming DataFrame (volume_id, rtype, k, x, y, w, h) to each touched slot's new statistics.

    One small state for each slot: counts, means and squared deviations; its size doesn't depend on the pages seen.
    k is the region's rank on its page, which the writer of the stream knows.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, None, None)
        slot = Running(n, list(mean) if mean is not None else None, list(m2) if m2 is not None else None)
        for pdf in batches:
            for row in pdf[list(BOX)].itertuples(index=False):
                slot.add([float(v) for v in row])
        state.update((slot.n, slot.mean, slot.m2))
        yield pd.DataFrame([(*key, slot.n, *slot.mean, slot.confidence())], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return slotted.groupBy("volume_id", "rtype", "k").applyInPandasWithState(run, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)


PAGES_OUTPUT = "volume_id string, n_samples bigint, rtype string, k bigint, n bigint, " + ", ".join(f"mean_{c} double" for c in BOX) + ", confidence double"
_TEMPLATE_STATE = "n_samples bigint, rtype array<string>, k array<bigint>, n array<bigint>, mean array<array<double>>, m2 array<array<double>>"


def update_templates(pages: DataFrame, p: Template = TEMPLATE) -> DataFrame:
    """A streaming DataFrame of confirmed pages (volume_id, segments ARRAY<STRUCT<rtype, x, y, w, h>>) to each touched volume's whole template.

    The state of a volume is its template: pages counted up to a limit, and the statistics of each slot;
    its size doesn't depend on the pages seen. Regions of unknown type are left out, but their page
    counts. A volume without a slot yet has one row, of null type.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        samples, slots = 0, {}
        if state.exists:
            samples, *lists = state.get
            slots = {(t, k): Running(n, list(mean), list(m2)) for t, k, n, mean, m2 in zip(*lists, strict=True)}
        for pdf in batches:
            for segments in pdf["segments"]:
                samples = min(samples + 1, p.counted)
                seen: dict[str, int] = {}
                for s in sorted((x for x in ([] if segments is None else segments) if x["rtype"] != "unknown"), key=lambda x: x["y"]):
                    k = seen[s["rtype"]] = seen.get(s["rtype"], -1) + 1
                    slots.setdefault((s["rtype"], k), Running()).add([float(s[c]) for c in BOX])
        names = sorted(slots)
        state.update((samples, [t for t, _ in names], [k for _, k in names], [slots[x].n for x in names], [slots[x].mean for x in names], [slots[x].m2 for x in names]))
        rows = [(*key, samples, t, k, (r := slots[t, k]).n, *r.mean, r.confidence(p)) for t, k in names] or [(*key, samples, None, None, None, *[None] * len(BOX), None)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES_OUTPUT.split(", ")]).astype({"k": "Int64", "n": "Int64"})

    return pages.groupBy("volume_id").applyInPandasWithState(run, PAGES_OUTPUT, _TEMPLATE_STATE, "update", GroupStateTimeout.NoTimeout)
