"""SQL of the merges whose result depends on the order boxes are taken in: recursive queries, a step for each box or pair of boxes.

Tables taken and given have page_id, slot, rtype, confidence, source, col_no, x, y, w, h.
"""

from __future__ import annotations

from vellumetry.operators.model import LAYOUT, Layout

_STRUCT = "{'slot': slot, 'rtype': rtype, 'confidence': confidence, 'source': source, 'col_no': col_no, 'x': x, 'y': y, 'w': w, 'h': h}"
_FIELDS = "b.slot, b.rtype, b.confidence, b.source, b.col_no, b.x, b.y, b.w, b.h"


def _shared(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))"


def iou(a: str, b: str) -> str:
    return f"(case when {_shared(a, b)} = 0 then 0 else {_shared(a, b)} / ({a}.w*{a}.h + {b}.w*{b}.h - {_shared(a, b)}) end)"


def overlaps(source: str, out: str, p: Layout = LAYOUT) -> str:
    """CTEs that end in table out: each box not yet taken, in order of y, x, slot, takes those that overlap it."""
    more = f"{iou('l[1]', 'b')} > {p.overlap}"
    return f"""{out}_step as (
  select page_id, list({_STRUCT} order by y, x, slot) l, 0 as step, list({_STRUCT}) filter (where false) grp from {source} group by page_id
  union all
  select page_id, list_filter(l[2:], lambda b: not {more}), step + 1, list_concat([l[1]], list_filter(l[2:], lambda b: {more})) from {out}_step where len(l) > 0),
 {out}_all as (select page_id, step, generate_subscripts(grp, 1) i, unnest(grp) b, len(grp) n from {out}_step where step > 0),
 {out}_best as (select page_id, step, n, i, b from {out}_all qualify row_number() over (partition by page_id, step order by b.confidence desc, i) = 1),
 {out}_box as (select page_id, step, min(b.x) x, min(b.y) y, max(b.x + b.w) x2, max(b.y + b.h) y2 from {out}_all group by page_id, step),
 {out} as (select t.page_id, b.slot, b.rtype, case when n > 1 then b.confidence * {p.merged_confidence}::double else b.confidence end confidence, b.source, b.col_no,
   case when n > 1 then g.x else b.x end x, case when n > 1 then g.y else b.y end y, case when n > 1 then x2 - g.x else b.w end w, case when n > 1 then y2 - g.y else b.h end h
  from {out}_best t join {out}_box g on t.page_id = g.page_id and t.step = g.step)"""


def adjacent(source: str, out: str, gap: float, where: str, p: Layout = LAYOUT) -> str:
    """CTEs that end in table out: passes over the boxes of source that where picks, each box growing by the later ones that fit it."""
    a, b = "l[i]", "l[j]"
    joins = f"""({a}.rtype = {b}.rtype and {a}.col_no = {b}.col_no and {b}.y - ({a}.y + {a}.h) >= 0 and {b}.y - ({a}.y + {a}.h) <= {gap}
   and least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x) >= {p.column_overlap} * least({a}.w, {b}.w))"""
    x, y = f"least({a}.x, {b}.x)", f"least({a}.y, {b}.y)"
    grown = f"""{{'slot': {a}.slot, 'rtype': {a}.rtype, 'confidence': greatest({a}.confidence, {b}.confidence), 'source': {a}.source, 'col_no': {a}.col_no, 'x': {x}, 'y': {y},
   'w': greatest({a}.x+{a}.w, {b}.x+{b}.w) - {x}, 'h': greatest({a}.y+{a}.h, {b}.y+{b}.h) - {y}}}"""
    by_place = "list_transform(list_sort(list_transform(l, lambda b: {'y': b.y, 'x': b.x, 's': b.slot, 'b': b})), lambda t: t.b)"
    return f"""{out}_step as (
  select page_id, list({_STRUCT} order by y, x, slot) l, 1 as i, 2 as j, false as changed, false as done from {source} where {where} group by page_id
  union all
  select page_id,
   case when i > len(l) then {by_place} when j > len(l) then l when {joins} then list_concat(list_concat(l[:i-1], [{grown}]), list_concat(l[i+1:j-1], l[j+1:])) else l end,
   case when i > len(l) then 1 when j > len(l) then i + 1 else i end,
   case when i > len(l) then 2 when j > len(l) then i + 2 when {joins} then j else j + 1 end,
   case when i > len(l) then false when j > len(l) then changed when {joins} then true else changed end,
   i > len(l) and not changed
  from {out}_step where not done),
 {out} as (select page_id, {_FIELDS} from (select page_id, unnest(l) b from {out}_step where done) z)"""


def collapsed(source: str, out: str) -> str:
    """Table out: one box of all body of a page's column; the uppermost one's slot and source."""
    return f"""{out} as (select page_id, arg_min(slot, (y, x, slot)) slot, 'body' rtype, max(confidence) confidence, arg_min(source, (y, x, slot)) source, col_no,
   min(x) x, min(y) y, case when count(*) > 1 then max(x + w) - min(x) else max(w) end w, case when count(*) > 1 then max(y + h) - min(y) else max(h) end h from {source} group by page_id, col_no)"""


def blended(found: str, expected: str, out: str, p: Layout = LAYOUT) -> str:
    """Table out: each expected box raises the found one that overlaps it most, the first to ask for it, or is added."""
    return f"""{out}_met as (select e.page_id, e.slot es, f.slot fs, {iou('f', 'e')} v from {expected} e join {found} f on e.page_id = f.page_id),
 {out}_best as (select page_id, es, fs from (select *, row_number() over (partition by page_id, es order by v desc, fs) rn from {out}_met where v > 0) z where rn = 1 and v > {p.blend_overlap}),
 {out}_used as (select page_id, es, fs from (select *, row_number() over (partition by page_id, fs order by es) rn from {out}_best) z where rn = 1),
 {out}_top as (select page_id, max(slot) top from {found} group by page_id),
 {out} as (select f.page_id, f.slot, f.rtype, case when u.es is not null then least(0.98::double, f.confidence + 0.15::double) else f.confidence end confidence,
   case when u.es is not null then 'detected+template' else f.source end source, f.col_no, f.x, f.y, f.w, f.h from {found} f left join {out}_used u on f.page_id = u.page_id and f.slot = u.fs
  union all select e.page_id, e.slot + coalesce(t.top, 0), e.rtype, coalesce(e.confidence, 0.70::double) * 0.85::double, 'template', 0, e.x, e.y, e.w, e.h from {expected} e
   left join {out}_used u on e.page_id = u.page_id and e.slot = u.es left join {out}_top t on e.page_id = t.page_id where u.es is null)"""
