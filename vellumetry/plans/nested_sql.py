"""SQL of the rows of nested documents with their parents, over the tree of each body's JSON."""

from __future__ import annotations

from vellumetry.operators.nested import PROJECT, Collection, plain

_NAME = "lower(regexp_replace({0}, '[_\\-\\s]', '', 'g'))"


def _listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _level(of: Collection, above: str, out: str, carried: list[str], before: str | None = None) -> str:
    """CTEs that end in table out (record_id, place, label, key and what is carried): the elements of a collection, in any of its forms, of the elements of above.

    Children are numbered through: after those of table before, the sibling collection that comes first.
    """
    own = _listed([plain(x) for x in (*of.keys, *of.fields, *(c.name for c in of.children))])
    fixed = f"and exists (select 1 from tree x where x.record_id = c.record_id and x.parent = c.id and x.norm not in ({_listed([plain(p) for p in of.places])}))" if of.places else ""
    mine = ", ".join(f"p.{c}" for c in carried)
    keys = ", ".join(f"(select any_value(k.atom ->> '$') from tree k where k.record_id = e.record_id and k.parent = e.place and k.norm = '{plain(k)}' and k.type not in ('NULL', 'OBJECT', 'ARRAY'))" for k in of.keys)
    first = f"coalesce((select max(b.ordinal) + 1 from {before} b where b.record_id = p.record_id and b.up = p.label), 0)" if before else "0"
    return f"""{out}_c as (select {mine}{', ' if mine else ''}p.record_id, p.label as up, {first} as first_no, c.id, c.type, c.type = 'OBJECT' and exists (select 1 from tree x where x.record_id = c.record_id and x.parent = c.id and x.norm in ({own})) {fixed}
   and exists (select 1 from tree x where x.record_id = c.record_id and x.parent = c.id and x.type not in ('OBJECT', 'NULL')) single
  from {above} p join tree c on c.record_id = p.record_id and c.parent = p.place and c.norm = '{plain(of.name)}'),
 {out}_e as (select p.* exclude (id, type, single), p.id place, 0 as n, null kept from {out}_c p where single union all by name
  select p.* exclude (id, type, single), e.id place, e.n, case when p.type = 'OBJECT' then e.key end kept
   from {out}_c p join (select *, row_number() over (partition by record_id, parent order by id) - 1 n from tree) e on e.record_id = p.record_id and e.parent = p.id where not single and p.type in ('ARRAY', 'OBJECT') and (e.type = 'OBJECT' or p.type = 'OBJECT' and e.type not in ('NULL', 'ARRAY'))),
 {out} as (select e.* exclude (kept), n + first_no as ordinal, up || '.' || (n + first_no) as label, coalesce({keys}, kept) as key from {out}_e e)"""


_BARE = "trim(ltrim({0}, chr(65279)), ' ' || chr(9) || chr(10) || chr(13))"


def _tree() -> str:
    """CTEs tree, all nodes of all complete documents, and root, the project of each."""
    body = "body"
    for _ in range(3):  # a string of JSON is unwrapped
        body = f"case when json_valid({_BARE.format(body)}) and json_type({_BARE.format(body)}) = 'VARCHAR' then {_BARE.format(body)} ->> '$' else {_BARE.format(body)} end"
    return f"""docs as (select record_id, j from (select record_id, {body} j from project_files where body is not null) z where json_valid(j)),
 tree as materialized (select d.record_id, t.id, t.parent, t.key, t.type, t.atom, {_NAME.format('t.key')} norm from docs d, lateral (select * from json_tree(d.j)) t),
 root as (select r.record_id, '0' as label, coalesce((select max(c.id) from tree c where c.record_id = r.record_id and c.parent = r.id and c.norm = 'project' and c.type = 'OBJECT'), r.id) as place from tree r where r.parent is null and r.type = 'OBJECT')"""


def _tables() -> str:
    """CTEs vol, spr, pag, seg and res: the elements of each table."""
    volumes = PROJECT.children[0]
    spreads = volumes.children[0]
    pages = spreads.children[0]
    segments, results = pages.children
    return f"""{_tree()}, {_level(volumes, 'root', 'vol', [])}, vols as (select *, key volume_id from vol), {_level(spreads, 'vols', 'spr', ['volume_id'])}, sprs as (select *, key spread_id from spr),
 {_level(pages, 'sprs', 'pag', ['volume_id', 'spread_id'])}, pags as (select *, key side from pag), {_level(segments, 'pags', 'seg', ['volume_id', 'spread_id', 'side'])},
 {_level(results, 'pags', 'res', ['volume_id', 'spread_id', 'side'], 'seg')}"""


def found() -> str:
    """record_id, volume_id, spread_id, side, kind, child_id of every segment and result of the saved projects."""
    return f"""with {_tables()}
 select distinct record_id, volume_id, spread_id, side, 'segment' kind, key child_id from seg union select distinct record_id, volume_id, spread_id, side, 'result', key from res"""


def flat(name: str) -> str:
    """The flat table of a collection: record, label, parent, key and the scalar fields."""

    def visit(of: Collection) -> dict[str, Collection]:
        out = {of.name: of}
        for child in of.children:
            out |= visit(child)
        return out

    of = visit(PROJECT)[name]
    table = {"volumes": "vol", "spreads": "spr", "pages": "pag", "segments": "seg", "ocrResults": "res"}[name]
    value = lambda f: f"(select any_value(case when k.type in ('OBJECT', 'ARRAY') then null else k.atom ->> '$' end) from tree k where k.record_id = e.record_id and k.parent = e.place and k.norm = '{plain(f)}')"
    own = "(select case when v.type not in ('OBJECT', 'NULL') then v.atom ->> '$' end from tree v where v.record_id = e.record_id and v.id = e.place)"
    fields = ", ".join(f"{f'coalesce({value(f)}, {own})' if n == 0 else value(f)} as \"{f}\"" for n, f in enumerate(of.fields))
    return f"with {_tables()} select e.record_id record, e.label, regexp_replace(e.label, '\\.[0-9]+$', '') as parent, e.key, {fields} from {table} e"
