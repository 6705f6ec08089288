"""SQL that gives the rows of the text queries SQL can express: p2, p6 and p8."""

from __future__ import annotations

import sys
import unicodedata as ud

from vellumetry.llm.canonical import HYPHENS, INVISIBLE, JOINERS, LOOKALIKE_FROM, LOOKALIKE_TO, RESHAPED, SELECTORS
from vellumetry.llm.leaks import MIN_WORDS
from vellumetry.llm.repeated_lines import MIN_LETTERS, MIN_SHARE, MIN_VOLUMES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _form(text: str) -> str:
    """The canonical form of a text as an expression; the characters that change by themselves come from the Unicode properties."""
    singles: dict[str, str] = dict.fromkeys(HYPHENS, "-")
    longer: dict[str, str] = {}
    for o in range(0xA0, sys.maxunicode + 1):
        c = chr(o)
        d = ud.decomposition(c)
        if d.startswith(("<wide>", "<narrow>")) or 0xFB00 <= o <= 0xFB06 or o in (0x132, 0x133) or 0x1C4 <= o <= 0x1CC:
            n = ud.normalize("NFKC", c)
            if len(n) == 1:
                singles[c] = n
            else:
                longer[c] = n
        elif ud.category(c) == "Zs":
            singles[c] = " "
    gone = INVISIBLE + SELECTORS
    out = f"replace(replace({text}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
    out = f"translate({out}, {_quoted(''.join(singles) + gone)}, {_quoted(''.join(singles.values()))})"
    for c, n in longer.items():
        out = f"replace({out}, {_quoted(c)}, {_quoted(n)})"
    # joiners go, but for those beside letters they reshape
    kept = f"[{RESHAPED}{JOINERS}\U0001f000-\U0001ffff☀-➿]"
    out = f"array_to_string(list_transform(regexp_extract_all({out}, {_quoted(f'{kept}+|[^{JOINERS}]|[{JOINERS}]+')}), lambda x: case when regexp_full_match(x, {_quoted(f'[{JOINERS}]+')}) then '' else x end), '')"
    out = f"nfc_normalize({out})"
    latin = f"translate(x, {_quoted(LOOKALIKE_FROM)}, {_quoted(LOOKALIKE_TO)})"
    word = f"case when regexp_matches(x, {_quoted(f'[{LOOKALIKE_FROM}]')}) and not regexp_matches({latin}, '[Ͱ-ԯ]') then {latin} else x end"
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({out}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: {word}), ''))"


_BODY = r"""body as (select distinct r.* from ocr_results r where r.text is not null and regexp_matches(r.text, '[^\s\p{Z}\x{FEFF}\x{200B}\x0b]') and exists
 (select 1 from ocr_regions g where g.region_id = r.region_id and lower(trim(g.region_type, ' ' || chr(9) || chr(10) || chr(13))) in ('body', 'footnote')))"""

P2_FOUND = rf"""with {_BODY}, lines as (select result_id, site_id, volume_id, generate_subscripts(l, 1) - 1 line_no, unnest(l) line from
  (select result_id, site_id, volume_id, string_split({_form("replace(text, chr(13), ' ')")}, chr(10)) l from body where site_id is not null and volume_id is not null) z),
 keys as (select result_id, site_id, volume_id, line_no, replace(lower(regexp_replace(line, '[^\p{{L}}\p{{M}}]', '', 'g')), 'ß', 'ss') k from lines),
 counted as (select * from keys where length(regexp_replace(k, '\p{{M}}', '', 'g')) >= {MIN_LETTERS}),
 sites as (select site_id, count(distinct volume_id) n from scan_volumes where volume_id is not null group by site_id),
 often as (select c.site_id, k from counted c join sites s on c.site_id = s.site_id group by c.site_id, k, n having count(distinct c.volume_id) >= greatest({MIN_VOLUMES}, n * {MIN_SHARE} - 1e-9))
 select distinct c.result_id, cast(line_no as bigint) line_no from counted c join often o on c.site_id = o.site_id and c.k = o.k"""

P6_FOUND = f"""with {_BODY}, forms as materialized (select distinct result_id, text, {_form("text")} form from body)
 select distinct a.result_id result_id_a, b.result_id result_id_b from forms a join forms b on a.form = b.form where a.result_id < b.result_id and a.text <> b.text"""

_UNSPACED = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}々ｦ-ﾟ\x{0e00}-\x{0e7f}\x{0e80}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}"


def _tokens(text: str) -> str:
    """The words of a text as an expression: letters of scripts without spaces each, others between what isn't letter, mark or digit."""
    joined = rf"regexp_replace({text}, '([\p{{L}}\p{{N}}\p{{M}}_])[-=‐‑\x{{ad}}¬﹣－][\s\p{{Z}}]*\n[\s\p{{Z}}]*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    plain = f"replace(lower({_form(joined)}), 'ß', 'ss')"
    for _ in range(2):  # neighbours share a letter at times
        plain = rf"regexp_replace({plain}, '(\p{{L}})[''’ʼ`´·-](\p{{L}})', '\1\2', 'g')"
    plain = rf"regexp_replace({plain}, '(\p{{N}})[.,](\p{{N}})', '\1\2', 'g')"
    marks = r"\x{300}-\x{36f}\x{900}-\x{903}\x{93a}-\x{93c}\x{93e}-\x{94f}\x{951}-\x{957}\x{962}\x{963}\x{981}-\x{983}\x{9bc}\x{9be}-\x{9cd}\x{9d7}"
    letters = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{Devanagari}\p{Bengali}\p{Arabic}\p{Hebrew}\p{N}"
    return rf"list_filter(regexp_extract_all({plain}, '[{_UNSPACED}]|(?:[{letters}{marks}])+'), lambda x: not regexp_full_match(x, '[।॥॰]+'))"


def _windows(table: str, id_col: str, out: str) -> str:
    """Table out: (id, gram), for each word the shortest stretch from it on that counts for MIN_WORDS."""
    weight = f"case when length(w) = 1 and regexp_matches(w, '[{_UNSPACED}]') then 0.5::double else 1.0::double end"
    return rf"""{out}_w as (select {id_col} id, generate_subscripts(l, 1) i, unnest(l) w from (select distinct {id_col}, {_tokens('text')} l from {table} where text is not null) z),
 {out}_c as (select id, i, w, sum({weight}) over (partition by id order by i) c, {weight} v from {out}_w),
 {out}_e as (select s.id, s.i, min(e.i) j from {out}_c s join {out}_c e on s.id = e.id and e.i >= s.i + {MIN_WORDS - 1} and e.i <= s.i + {2 * MIN_WORDS} and e.c - s.c + s.v >= {MIN_WORDS} group by s.id, s.i),
 {out} as (select distinct e.id, array_to_string(l[e.i:e.j], ' ') gram from {out}_e e join (select id, list(w order by i) l from {out}_w group by id) t on e.id = t.id)"""


P8_FOUND = f"with {_windows('eval_items', 'item_id', 'it')}, {_windows('documents', 'doc_id', 'dc')} select distinct d.id doc_id, i.id item_id from dc d join it i on d.gram = i.gram"

SQL = {"p2_found": P2_FOUND, "p6_found": P6_FOUND, "p8_found": P8_FOUND}
